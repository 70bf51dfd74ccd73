"""``spark.read.format("gridloom")``: container files as headers or pixels, and a writer for blobs.

Options: ``path`` (a file, folder or glob that all workers see), ``content`` = ``header`` (default), ``pixel`` or
``blob``, ``recursive``, ``filesperpartition``, and two that leave out whole files by their headers: ``valuemin`` and
``valuemax`` (files none of whose values, 0 of invalid pixels included, lie in that range are never decoded). Headers are read
from a file's first bytes where it is one band.

Files are ruled out by options and not by pushed filters: Spark keeps what a Python reader was pushed with the
DataFrame, so one that is used twice, first with a filter and then without, would miss rows the second time.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions import container
from ..operators.codec import HEADER, PIXELS, _band_rows, header_row

SUFFIX = ".grid"


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    paths: list[str]


def raster_name(path: str) -> str:
    return unquote(os.path.splitext(os.path.basename(path))[0])


def file_name(raster_id: str | None) -> str:
    """A file's name for an id, which :func:`raster_name` turns back: slashes and the like are percent-escaped, and so is a dot that would hide the file."""
    if not raster_id:
        raise ValueError("a container needs a raster_id to be named by")
    name = quote(raster_id, safe=" ()+,=@")
    return "%2E" + name[1:] if name[0] == "." else name


class BlobSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom"

    def schema(self) -> str:
        return {"header": f"raster_id string, path string, {HEADER}", "pixel": PIXELS, "blob": "raster_id string, blob binary"}[self.options.get("content", "header")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return BlobReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return BlobWriter(self.options["path"], overwrite)


class BlobReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.content = options["path"], options.get("content", "header")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.group = int(options.get("filesperpartition", "16"))
        self.low, self.high = float(options.get("valuemin", "-inf")), float(options.get("valuemax", "inf"))

    def partitions(self) -> list[Files]:
        at = os.path.join(self.path, "**" if self.recursive else "", "*" + SUFFIX) if os.path.isdir(self.path) else self.path
        found = sorted(glob.glob(at, recursive=self.recursive))
        return [Files(found[i : i + self.group]) for i in range(0, len(found), self.group)]

    def _may_hold(self, info: container.Info) -> bool:
        """Whether a value of the file may lie in the range; with mixed no-data values the header does not tell."""
        return bool(info.uses_no_data) or (max(info.z_max, 0.0) >= self.low and min(info.z_min, 0.0) <= self.high)

    def read(self, partition: Files) -> Iterator:
        for p in partition.paths:
            if self.content == "header":
                yield (raster_name(p), p, *header_row(_prefix(p)))
                continue
            with open(p, "rb") as f:
                raw = f.read()
            if self.content == "blob":
                yield pa.RecordBatch.from_arrays([pa.array([raster_name(p)]), pa.array([raw], pa.binary())], ["raster_id", "blob"])
                continue
            if self._may_hold(container.read_info(raw)):
                d = container.decode(raw)
                for k in range(len(d.values)):
                    yield from _band_rows(raster_name(p), k, d, False)


def _prefix(path: str) -> bytes:
    """As much of a file as its headers need: all of it, unless it is a single band."""
    with open(path, "rb") as f:
        raw = f.read(4096)
        if raw[:6] == container.KEY:
            h, _ = container.read_header(raw)
            if h.version >= 6 and h.more == 0:
                return raw
        return raw + f.read()


class BlobWriter(DataSourceWriter):
    """One file a row (raster_id, blob), first under another name, so that a failed or repeated task leaves nothing."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        os.makedirs(path, exist_ok=True)
        if not overwrite and glob.glob(os.path.join(path, "*" + SUFFIX)):
            raise FileExistsError(f"{path} already holds containers")

    def write(self, iterator: Iterator) -> Written:
        paths = []
        for row in iterator:
            part = os.path.join(self.path, f".{uuid.uuid4().hex}.{file_name(row.raster_id)}.part")
            with open(part, "wb") as f:
                f.write(row.blob)
            paths.append(part)
        return Written(paths)

    def commit(self, messages: list[Written | None]) -> None:
        """Refuse ids that come twice, put the new files in their places, and only then remove the others."""
        parts = {}
        for part in (p for m in messages if m for p in m.paths):
            name = os.path.basename(part).split(".", 2)[2].removesuffix(".part") + SUFFIX
            if name in parts:
                self.abort(messages)
                raise ValueError(f"two rows have the raster_id {raster_name(name)!r}")
            parts[name] = part
        old = {os.path.basename(p) for p in glob.glob(os.path.join(self.path, "*" + SUFFIX))}
        for name, part in parts.items():
            os.replace(part, os.path.join(self.path, name))
        for name in old - set(parts) if self.overwrite else ():
            os.remove(os.path.join(self.path, name))

    def abort(self, messages: list[Written | None]) -> None:
        for part in (p for m in messages if m for p in m.paths):
            if os.path.exists(part):
                os.remove(part)


def register(spark) -> None:  # noqa: ANN001
    """Make the format known to a session."""
    spark.dataSource.register(BlobSource)
