"""Near-duplicate vectors by collision-counting projections.

Unit vectors of cosine c lie sqrt(2 - 2 c) apart, and a projection on a random normal direction tells them
apart by a normal amount of that deviation. So a window of the right width about a query's place on a
sorted projection holds a true partner with a known probability p, and of ``n_projections`` windows a true
partner is in ``min_count`` or more but for a chance of ``miss``: the count is calibrated, not tuned to data.
One projection with a wide window is the sorted order in which vectors meet; the counts over the
others decide which pairs are worth their exact cosine.

Equal vectors of a label are one, with a weight. Small labels meet as a whole. Of a label with more vectors than a
block holds, the vectors meet cell by cell: a cell holds those on the same side of the origin in each of
some projections, which halve the label until a cell is a block. A pair at the threshold stays on one side
of a projection with probability 1 - angle / pi whatever the data, so the number of independent partitions
is calibrated, too; a pair counts in the first partition only in which it shares a cell. So the work on a label
grows with a power of its size that is near 1 and not 2. A cell that the data leave too large is cut into
blocks that meet in pairs. A task returns link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .durable import settle
from .sigjoin import run_bounds, runs_of, small
from .textkit import longs, mix


def calibrate(cosine: float, n_projections: int, inside: float, miss: float) -> tuple[float, int]:
    """(half width of the windows, least count): a pair at ``cosine`` is in each window with probability ``inside``, and in fewer windows than the count with probability ``miss`` at most."""
    apart = sqrt(max(2 - 2 * cosine, 1e-12))
    low, high = 0.0, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if erf(mid / sqrt(2)) < inside else (low, mid)
    tail, count = 0.0, 0
    while count < n_projections:
        tail += comb(n_projections, count) * inside**count * (1 - inside) ** (n_projections - count)
        if tail > miss:
            break
        count += 1
    return apart * high, count


def partitions(n: int, cosine: float, block: int, miss: float) -> tuple[int, int]:
    """(projections of a partition, partitions) for a label of n vectors: a pair at ``cosine`` shares no cell with probability ``miss`` at most."""
    bits = max(0, ceil(log2(max(n, 1) / block)))
    if not bits:
        return 0, 1
    same = (1 - acos(cosine) / pi) ** bits
    return bits, ceil(log(miss) / log(1 - same))


def _unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1, usable): null, zero and non-finite vectors, and those of another length, are not usable."""
    out, ok = np.zeros((len(col), dim)), np.zeros(len(col), dtype=bool)
    values = col.cast(pa.list_(pa.float64()))
    for i, v in enumerate(values):
        if v.is_valid and len(v.values) == dim and not v.values.null_count:
            out[i] = v.values.to_numpy(zero_copy_only=False)
            ok[i] = np.isfinite(out[i]).all() and out[i].any()
    top = np.abs(out).max(axis=1, initial=0)
    out[ok] /= top[ok, None]  # no overflow in the squares
    out[ok] /= np.linalg.norm(out[ok], axis=1)[:, None]
    return out, ok


def links(vectors: DataFrame, *, cosine: float = 0.93, n_projections: int = 48, inside: float = 0.8, miss: float = 1e-6, part_miss: float = 1e-4, block: int = 8192, seed: int = 7) -> DataFrame:
    """vectors (vec_id, embedding, label, ...) -> vec_id, n_links, component_id, kept: one row for each row of vectors.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double
    precision, is ``cosine`` or more. n_links counts the other rows linked directly; component_id is the smallest vec_id that links
    reach; kept is vec_id = component_id. Vectors that are null, empty, zero or hold a null or non-finite
    number link with nothing; so do vectors of different lengths with each other. Repeated rows count as
    rows; a null vec_id links with nothing, has component_id null and is kept. Other columns are ignored; an empty table gives an empty one.

    A pair at the threshold is missed by the count with probability ``miss``, and in a label of more than
    ``block`` vectors by the partitions with ``part_miss``; closer pairs with less. block: vectors to a cell; a
    task holds up to four times as many.
    """
    vectors = vectors.select("vec_id", "embedding", "label")
    half, least = calibrate(cosine, n_projections, inside, miss)
    wide, _ = calibrate(cosine, 1, 1 - miss, miss)
    usable = vectors.where("embedding is not null and label is not null and vec_id is not null")
    # vectors are told apart by their exact components
    rows = settle(usable.select(F.col("vec_id").cast("long"), "label", F.md5(F.to_json(F.struct("embedding"))).alias("name"), "embedding"))
    same = rows.groupBy("label", "name").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))

    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(3).value_lengths().to_numpy()
            for dim in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == dim)))
                unit, ok = _unit(part.column(3), int(dim))
                if not ok.any():
                    continue
                part = part.filter(pa.array(ok))
                raw = np.array(part.column(3).flatten(), dtype=kind).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(part.num_rows, dim, np.int32)), pa.array([v.tobytes() for v in raw], pa.binary())], names)

    names = ["label", "rep", "weight", "dim", "raw"]
    label = vectors.schema["label"].dataType.simpleString()
    placed = settle(same.select("label", "rep", "weight", "embedding").mapInArrow(project, f"label {label}, rep long, weight long, dim int, raw binary"))
    return _joined(vectors, rows, placed, half, least, wide, cosine, n_projections, part_miss, block, seed, kind)


def normed(raw: pa.Array, kind: type) -> np.ndarray:
    """Rows of length 1 from packed vectors of one dimension."""
    out = np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64)
    out /= np.abs(out).max(axis=1, initial=0)[:, None]  # no overflow in the squares
    out /= np.linalg.norm(out, axis=1)[:, None]
    return out


def _joined(vectors: DataFrame, rows: DataFrame, placed: DataFrame, half: float, least: int, wide: float, cosine: float, n_projections: int, part_miss: float, block: int, seed: int, kind: type) -> DataFrame:
    sizes = settle(placed.groupBy(F.col("label").alias("s_label"), F.col("dim").alias("s_dim")).agg(F.count("*").alias("n")))
    sized = placed.join(small(sizes), (F.col("label") == F.col("s_label")) & (F.col("dim") == F.col("s_dim")))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group, rep, weight, dim, n = (b.column(k).to_numpy() for k in range(5))
            for d, m in set(zip(dim.tolist(), n.tolist())):
                at = np.flatnonzero((dim == d) & (n == m))
                part, g = b.take(pa.array(at)), group[at].view(np.uint64)
                bits, trees = partitions(m, cosine, block, part_miss)
                codes = np.zeros((len(at), trees), dtype=np.int32)
                if bits:
                    sides = normed(part.column(5), kind) @ np.random.default_rng(seed + 2).standard_normal((d, trees * bits)) > 0
                    codes = (sides.reshape(len(at), trees, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                for t in range(trees):
                    task = mix(g ^ mix((np.uint64(t) << np.uint64(32)) + codes[:, t].astype(np.uint64)))
                    yield pa.RecordBatch.from_arrays([longs(task), pa.array(np.full(len(at), t, np.int32)), part.column(1), part.column(2), part.column(5), packed], ["task", "tree", "rep", "weight", "raw", "codes"])

    posted = sized.select(F.xxhash64("label", "dim").alias("group"), "rep", "weight", "dim", "n", "raw").mapInArrow(post, "task long, tree int, rep long, weight long, raw binary, codes binary")
    full = settle(posted.groupBy("task").agg(F.count("*").alias("m")).where(F.col("m") > 2 * block))
    zero = F.lit(0)
    if full.head(1):
        # cells that are too large: each pair of their blocks meets once
        own = posted.join(small(full), "task", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("m") / block), F.lit(1)).cast("int"))
        own = own.withColumn("home", F.pmod(F.xxhash64("rep"), F.col("blocks").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(zero, F.col("blocks") - 1)))
        met = own.withColumns({"bi": F.least("home", "other"), "bj": F.greatest("home", "other")})
    else:
        met = posted.withColumns({"bi": zero, "bj": zero, "home": zero})
    pairs = met.select("task", "bi", "bj", "home", "tree", "rep", "weight", "raw", "codes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for t in runs_of(batches, 3):
            cut = run_bounds(t, 3)
            for lo, hi in zip(cut[:-1], cut[1:]):
                if hi - lo < 2:
                    continue
                part = t.slice(lo, hi - lo)
                bi, bj, side, tree, rep, weight = (part.column(k).to_numpy() for k in range(1, 7))
                unit = normed(part.column(7).combine_chunks(), kind)
                codes = np.frombuffer(b"".join(part.column(8).to_pylist()), np.int32).reshape(len(rep), -1)
                place = unit @ np.random.default_rng(seed).standard_normal(unit.shape[1])
                order = np.argsort(place, kind="stable")
                side, rep, weight, place, unit, codes = side[order], rep[order], weight[order], place[order], unit[order], codes[order]
                within, before = bi[0] == bj[0], codes[:, : tree[0]]
                dim = unit.shape[1]
                if dim not in directions:
                    directions[dim] = np.random.default_rng(seed + 1).standard_normal((dim, n_projections))
                proj = np.ascontiguousarray((unit @ directions[dim]).T.astype(np.float32))
                width = np.float32(half)
                n_links, root, a, b = np.zeros(len(rep), np.int64), np.arange(len(rep)), [], []
                ends = np.searchsorted(place, place + wide, side="right")
                for i in range(0, len(rep), 64):
                    j = min(i + 64, len(rep))
                    e = int(ends[j - 1])
                    # later ones in the window of the wide projection, counted over all the others
                    hits = np.zeros((j - i, e - i), dtype=np.int16)
                    for p in proj:
                        hits += np.abs(p[i:j, None] - p[None, i:e]) <= width
                    ok = hits >= least
                    ok &= np.arange(i, e)[None, :] > np.arange(i, j)[:, None]
                    if not within:
                        ok &= side[i:j, None] != side[None, i:e]
                    x, y = np.nonzero(ok)
                    x, y = x + i, y + i
                    near = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine if len(x) else np.zeros(0, bool)
                    x, y = x[near], y[near]
                    first = ~(before[x] == before[y]).any(axis=1)  # no earlier partition has them in one cell
                    x, y = x[first], y[first]
                    np.add.at(n_links, x, weight[y])
                    np.add.at(n_links, y, weight[x])
                    for u, v in zip(x, y):
                        if root[u] != root[v]:
                            low, high = sorted((root[u], root[v]))
                            root[root == high] = low
                            a.append(rep[u])
                            b.append(rep[v])
                has = np.flatnonzero(n_links)
                out = [np.concatenate([rep[has], np.array(a, np.int64)]), np.concatenate([n_links[has], np.zeros(len(a), np.int64)]), np.concatenate([np.full(len(has), -1), np.array(b, np.int64)])]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1]), pa.array(out[2], mask=np.arange(len(out[2])) < len(has))], ["rep", "n", "to"])

    found = settle(pairs.repartition("task", "bi", "bj").sortWithinPartitions("task", "bi", "bj").mapInArrow(count, "rep long, n long, to long"))
    counts = found.where("to is null").groupBy(F.col("rep").alias("c_rep")).agg(F.sum("n").alias("n"))
    roots = components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    of_class = placed.select("label", "rep", "weight").join(counts, F.col("rep") == F.col("c_rep"), "left").join(roots, F.col("rep") == F.col("v"), "left")
    of_class = of_class.select(F.col("label").alias("k_label"), F.col("rep").alias("k_rep"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    rep = rows.groupBy("label", "name").agg(F.min("vec_id").alias("rep"))
    members = rows.select("vec_id", "label", "name").distinct().join(rep, ["label", "name"]).join(of_class, (F.col("label") == F.col("k_label")) & (F.col("rep") == F.col("k_rep")))
    members = members.groupBy(F.col("vec_id").alias("m_id"), F.col("label").alias("m_label"), F.col("name").alias("m_name")).agg(F.max("n_links").alias("n_links"), F.min("component").alias("component"))
    name = F.md5(F.to_json(F.struct("embedding")))
    out = vectors.withColumn("__name", name).join(members, (F.col("vec_id") == F.col("m_id")) & (F.col("label") == F.col("m_label")) & (F.col("__name") == F.col("m_name")), "left")
    component = F.coalesce("component", F.col("vec_id").cast("long")).alias("component_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component, F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
