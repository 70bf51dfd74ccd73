"""Packing documents into training sequences of nearly equal attention cost.

A piece of n tokens costs n + n * n / ``window``: the linear layers, and attention within the piece. Within a
batch of documents, whole sequences are cut from long documents first; the rest are assigned in descending
order to the sequence with the lowest cost so far that still has room, over as many sequences as the batch's
tokens fill; what fits nowhere is cut over the sequences with room. The last, part-filled sequence of a batch is
cut into sequences of a power of two, which need no padding. So nothing is padded, and nothing moves: a task
packs what it reads, and a lost task packs the same again.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Words whose ids a worker remembers.
MEMO = 400_000
_ODD_SPACE = re.compile(r"\s | \s|^ | $")


def byte_bpe(json_path: str, ranks_path: str, pattern: str) -> Callable[[str], np.ndarray]:
    """Token ids, as 32-bit numbers, of the byte-level vocabulary in both files.

    Ids are those of the ``tokenizers`` library for ``json_path`` without added special tokens. A space that
    stands between two characters which are no white space begins a new pre-token, so texts are split there
    and each part is tokenized once and remembered. A text with other spacing is tokenized whole, and one
    that has the string of a special token goes to the library itself, which takes it as that token.
    """
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb"))}
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(json_path)
    special = re.compile("|".join(re.escape(t.content) for t in exact.get_added_tokens_decoder().values()) or r"(?!)")
    memo: dict[str, bytes] = {}

    def encode(text: str) -> np.ndarray:
        if special.search(text):
            return np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
        if _ODD_SPACE.search(text):
            return np.array(fast.encode_ordinary(text), dtype="<u4")
        parts = text.split(" ")
        if len(memo) > MEMO:
            memo.clear()
        out = []
        lead = ""
        for p in parts:
            key = lead + p
            ids = memo.get(key)
            if ids is None:
                ids = np.array(fast.encode_ordinary(key), dtype="<u4").tobytes()
                if len(key) < 64:
                    memo[key] = ids
            out.append(ids)
            lead = " "
        return np.frombuffer(b"".join(out), dtype="<u4")

    return encode


def powers_of_two(n: int) -> list[int]:
    """n as falling powers of two."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class _Cheapest:
    """Sequences by remaining room, with the cheapest one (then the first) of any least room at hand.

    A heap for each room, and over the heaps a binary tree of their tops, so a search takes log2(window) steps
    whatever the number of sequences and always finds the cheapest one with room.
    """

    _NONE = (float("inf"), -1)

    def __init__(self, window: int, rooms: list[int]) -> None:
        self.base = 1 << window.bit_length()  # rooms 0 .. window are its leaves
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(window + 1)]
        for s, room in enumerate(rooms):
            self.heaps[room].append((0.0, s))  # rising numbers are a heap already
        self.top = [self._NONE] * (2 * self.base)
        for room in range(1, window + 1):
            if self.heaps[room]:
                self.top[self.base + room] = self.heaps[room][0]
        for k in range(self.base - 1, 0, -1):
            self.top[k] = min(self.top[2 * k], self.top[2 * k + 1])

    def _set(self, room: int) -> None:
        top, k = self.top, self.base + room
        top[k] = self.heaps[room][0] if self.heaps[room] else self._NONE
        k >>= 1
        while k:
            low = top[2 * k] if top[2 * k] <= top[2 * k + 1] else top[2 * k + 1]
            if top[k] == low:
                break
            top[k] = low
            k >>= 1

    def take(self, least: int) -> tuple[float, int] | None:
        """Remove and return (cost, sequence) of the cheapest sequence with room for ``least``."""
        top, k = self.top, self.base + least
        best, at = top[k], k
        while k > 1:
            if not k & 1 and top[k + 1] < best:
                best, at = top[k + 1], k + 1
            k >>= 1
        if best[1] < 0:
            return None
        while at < self.base:
            at = 2 * at if top[2 * at] == best else 2 * at + 1
        heapq.heappop(self.heaps[at - self.base])
        self._set(at - self.base)
        return best

    def put(self, room: int, cost: float, s: int) -> None:
        if room:
            heapq.heappush(self.heaps[room], (cost, s))
            self._set(room)


def pack(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of pieces; sequences are numbered from 0 and hold ``window`` tokens or a power of two.

    Every token of every item is in one piece. Items of length 0 have none.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    left: list[tuple[int, int, int]] = []  # length, item, start
    n_seq = 0
    for i, n in enumerate(lengths):
        n, start = int(n), 0
        while n - start >= window:
            pieces.append((i, start, window, n_seq, 0))
            n_seq, start = n_seq + 1, start + window
        if n > start:
            left.append((n - start, i, start))
    left.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in left)
    full, tail = divmod(total, window)
    # sequences with room: the full ones, and the tail as one of its own length
    room = [window] * full + ([tail] if tail else [])
    used = [0] * len(room)
    inside: list[list[tuple[int, int, int]]] = [[] for _ in room]
    cheapest = _Cheapest(window, room)
    spill: list[tuple[int, int, int]] = []
    for n, item, start in left:
        found = cheapest.take(n)
        if found is None:
            spill.append((n, item, start))
            continue
        cost, s = found
        inside[s].append((item, start, n))
        used[s] += n
        cheapest.put(room[s] - used[s], cost + n + n * n / window, s)
    gaps = [s for s in range(len(room)) if used[s] < room[s]]
    gaps.sort(key=lambda s: used[s] - room[s])
    g = 0
    for n, item, start in spill:
        while n:
            s = gaps[g]
            k = min(n, room[s] - used[s])
            inside[s].append((item, start, k))
            used[s] += k
            n, start = n - k, start + k
            g += used[s] == room[s]
    for s, items in enumerate(inside):
        sizes = [window] if room[s] == window else powers_of_two(room[s])
        at, bounds = 0, np.cumsum(sizes)
        for item, start, n in items:
            while n:
                q = int(np.searchsorted(bounds, at, side="right"))
                k = min(n, int(bounds[q]) - at)
                pieces.append((item, start, k, n_seq + q, at - int(bounds[q] - sizes[q])))
                n, start, at = n - k, start + k, at + k
        n_seq += len(sizes)
    return pieces


def pack_documents(docs: DataFrame, encoder: Callable[[], Callable[[str], np.ndarray]], *, window: int = 2048, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary) with ``with_ids``.

    encoder: makes the tokenizer, on each worker. A document is its text's ids and then ``end_id``; a null
    text is empty, so it is the one id. Rows are packed one by one, so repeated rows are packed as often as
    they come. Documents of any length are cut freely, each id being in exactly one piece. Other columns are
    ignored, a null doc_id is kept, and an empty table gives an empty one. sequence_id names the task and the
    sequence in it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(), TaskContext.get().partitionId() << 36
        held: list[tuple[object, np.ndarray]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal base
            ids = [x[1] for x in held]
            pieces = pack(np.array([len(x) for x in ids]), window)
            item, start, length, seq, offset = np.array(pieces, dtype=np.int64).reshape(-1, 5).T
            raw = [ids[i][s : s + k].tobytes() for i, s, k in zip(item, start, length)]
            cols = [pa.array([held[i][0] for i in item], b.schema.field(0).type), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([len(ids[i]) for i in item], pa.int64()), pa.array(seq + base), pa.array(offset)]
            base += int(seq.max()) + 1
            held.clear()
            return pa.RecordBatch.from_arrays(cols + ([pa.array(raw, pa.binary())] if with_ids else []), names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.append((doc, np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")))
                n += len(held[-1][1])
                if n >= PACK_TOKENS:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


#: Tokens that are packed together, at least.
PACK_TOKENS = 4_000_000
