"""Repeated passages by recompression.

A text is a sequence of symbols, at first its words. A pass names either runs (a symbol n times in a row, n
of any size, becomes one) or pairs (a symbol on the left side of a hash coin and the one after it, if on
the right side, become one). A name is a function of what it replaces and whether symbols join depends on
them alone, so equal passages turn into equal symbols but for a margin at either end, which is followed
exactly: with each symbol go the last window start and the first window end for which it lies beyond that margin.

A Spark round does some passes and posts the names that result. Only names found in two texts or more come
back; a symbol whose name does not is dead: it joins with nothing any more, and the windows of which it is
an inner symbol occur in no other text and are dropped. Rounds go on, on ever longer symbols of ever fewer
stretches of text, until symbols span a window:

1. Rounds name runs and pairs globally; what is left are the windows all of whose inner symbols are shared.
   The name of a whole text is posted in two halves of 64 bits: a text that has both from an earlier one is all repeat.
2. Windows that are left are verified: named by 96 bits of their words, they are kept as repeats if a
   smaller doc_id has the same.
3. Words under such a window are removed.

Every shuffle of names is combined before it: within a batch of texts only the smallest doc_id of a name
goes on to the others, and what the batch can settle goes straight to the result, so a name that a third of
all texts hold is a few rows a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk

#: Windows that a task compares among themselves before it sends them on.
COMBINE = 1 << 20
#: Key of rows without a doc_id.
NOWHERE = -(1 << 63)

_LEFT, _RIGHT = np.uint64(0xD1B54A32D192ED03), np.uint64(0xABC98388FB8FAC03)
_BEFORE, _AFTER = -(1 << 30), 1 << 30  # a window start, and end, that no window has
_SYMBOL = np.dtype([("name", "<u8"), ("start", "<i4"), ("end", "<i4"), ("left", "<i4"), ("right", "<i4"), ("dead", "?")])


def plan(window: int) -> list[int]:
    """Pair passes of each round. A pass makes symbols 4/3 as long on average; the last round's are a third of a window."""
    total = max(2, ceil(log(max(window / 3, 1.4)) / log(4 / 3)))
    first = min(total - 1, max(1, round(log(max(window / 9, 1)) / log(4 / 3))))
    return [first] + [min(2, total - k) for k in range(first, total, 2)]


@dataclass
class Parse:
    """Symbols of several texts over a common count of words; ``left``: the last window start, ``right``: the first window end, for which the symbol is inner."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray
    dead: np.ndarray
    doc: np.ndarray

    def take(self, keep: np.ndarray) -> Parse:
        return Parse(*(getattr(self, f)[keep] for f in ("name", "start", "end", "left", "right", "dead", "doc")))

    def beside(self) -> np.ndarray:
        """Whether each symbol but the last is followed at once by the next one."""
        return (self.doc[1:] == self.doc[:-1]) & (self.end[:-1] == self.start[1:])

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(beside, left of the symbol before each, right of the one after each)."""
        near = self.beside()
        before, after = np.full(len(self.name), _BEFORE, np.int64), np.full(len(self.name), _AFTER, np.int64)
        before[1:][near] = self.left[:-1][near]
        after[:-1][near] = self.right[1:][near]
        return near, before, after

    def runs(self, salt: int, every: bool) -> Parse:
        """Name the runs of all symbols, or of a fourth of them by hash: each pass costs the margin a symbol that it may name."""
        if not len(self.name):
            return self
        near, before, after = self.neighbours()
        may = ~self.dead if every else ~self.dead & (tk.mix(self.name + np.uint64(salt)) >> np.uint64(62) == 0)
        head = np.ones(len(self.name), dtype=bool)
        head[1:] = ~(near & may[1:] & may[:-1] & (self.name[1:] == self.name[:-1]))
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(head)) - 1
        n = (last - first + 1).astype(np.uint64)
        name = self.name[first]
        name = np.where(n > 1, tk.mix(name * _LEFT + n * _RIGHT + np.uint64(salt)), name)
        left, right = np.where(may[first], before[first], self.left[first]), np.where(may[last], after[last], self.right[last])
        return Parse(name, self.start[first], self.end[last], left, right, self.dead[first], self.doc[first])

    def pairs(self, salt: int) -> Parse:
        """Name the pairs of a left and a right symbol."""
        if not len(self.name):
            return self
        near, before, after = self.neighbours()
        side = (tk.mix(self.name + np.uint64(salt)) >> np.uint64(63)).astype(bool)
        joins = np.zeros(len(side), dtype=bool)
        joins[:-1] = near & ~side[:-1] & side[1:] & ~self.dead[:-1] & ~self.dead[1:]
        keep = np.ones(len(side), dtype=bool)
        keep[1:] = ~joins[:-1]
        first = np.flatnonzero(keep)
        last = first + joins[first]
        name = self.name[first]
        both = joins[first]
        name[both] = tk.mix(name[both] * _LEFT + self.name[last[both]] * _RIGHT + np.uint64(salt))
        # a right symbol may have joined one before it in another text, a left symbol one after it
        left, right = np.where(side[first], before[first], self.left[first]), np.where(side[last], self.right[last], after[last])
        return Parse(name, self.start[first], self.end[last], left, right, self.dead[first], self.doc[first])

    def round(self, k: int, passes: int) -> Parse:
        p = self.runs(1000 * k + 1, k == 0)
        for j in range(passes):
            p = p.pairs(1000 * k + 2 + j)
        return p


def parse(w: tk.Words) -> Parse:
    at = np.arange(len(w.hash))
    return Parse(w.hash, at, at + 1, at, at + 1, np.zeros(len(at), dtype=bool), w.doc_of_word())


def _inner(p: Parse, open_: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the window starts for which each symbol is inner: to < from for none."""
    low = np.maximum(p.right - window, first[p.doc])
    high = np.minimum(p.left, first[p.doc + 1] - 1)
    return low, high


def posted(p: Parse, open_: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Whether each symbol is alive and inner to an open window."""
    low, high = _inner(p, open_, first, window)
    c = np.concatenate([[0], np.cumsum(open_)])
    some = (low <= high) & ~p.dead
    some[some] = c[high[some] + 1] > c[low[some]]
    return some


def close(p: Parse, dead: np.ndarray, open_: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """open_ without the windows that have an inner symbol that is dead."""
    low, high = _inner(p, open_, first, window)
    dead = dead & (low <= high)
    step = np.bincount(low[dead], minlength=len(open_) + 1)[: len(open_) + 1] - np.bincount(high[dead] + 1, minlength=len(open_) + 1)[: len(open_) + 1]
    return open_ & (np.cumsum(step[:-1]) == 0)


def bare(p: Parse, open_: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Starts of open windows without an inner symbol, as in a long run."""
    return np.flatnonzero(close(p, np.ones(len(p.name), dtype=bool), open_, first, window))


def under(p: Parse, open_: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Whether each symbol has a word in an open window."""
    c = np.concatenate([[0], np.cumsum(open_)])
    return c[p.end] > c[np.maximum(p.start - window + 1, first[p.doc])]


def window_starts(first: np.ndarray, window: int) -> np.ndarray:
    n = np.diff(first)
    at = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return at <= np.repeat(n, n) - window


def whole_names(w: tk.Words, which: np.ndarray) -> np.ndarray:
    """128 bits, as two numbers, that name the whole sequence of words of texts."""
    names = [xxhash.xxh3_128_intdigest(w.hash[w.first[i] : w.first[i + 1]].tobytes()) for i in which]
    return np.array([(x >> 64, x & (2**64 - 1)) for x in names], dtype=np.uint64).reshape(-1, 2)


# ---- what a text is between rounds: its whole name, its open windows and their symbols ----


def pack_states(p: Parse, open_: np.ndarray, first: np.ndarray, whole: np.ndarray) -> list[bytes | None]:
    """A state for each text; None where no window is open."""
    rec = np.empty(len(p.name), dtype=_SYMBOL)
    base = first[p.doc]
    rec["name"], rec["dead"] = p.name, p.dead
    for f in ("start", "end", "left", "right"):
        rec[f] = np.clip(getattr(p, f) - base, _BEFORE, _AFTER)
    cut = np.searchsorted(p.doc, np.arange(len(first)))
    c = np.concatenate([[0], np.cumsum(open_)])[first]
    out: list[bytes | None] = []
    for i in range(len(first) - 1):
        if c[i] == c[i + 1]:
            out.append(None)
        else:
            out.append(whole[i].tobytes() + int(first[i + 1] - first[i]).to_bytes(8, "little") + np.packbits(open_[first[i] : first[i + 1]]).tobytes() + rec[cut[i] : cut[i + 1]].tobytes())
    return out


def unpack_states(states: list[bytes]) -> tuple[Parse, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, open windows, first[], whole names)."""
    sizes = np.array([int.from_bytes(s[16:24], "little") for s in states], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.array([np.frombuffer(s, "<u8", 2) for s in states], dtype=np.uint64).reshape(-1, 2)
    bits = [np.unpackbits(np.frombuffer(s, np.uint8, (n + 7) // 8, 24), count=n) for s, n in zip(states, sizes)]
    recs = [np.frombuffer(s, _SYMBOL, offset=24 + (int(n) + 7) // 8) for s, n in zip(states, sizes)]
    doc = np.repeat(np.arange(len(states)), [len(r) for r in recs])
    rec = np.concatenate(recs) if recs else np.zeros(0, _SYMBOL)
    base = first[doc]
    p = Parse(rec["name"].copy(), *(rec[f].astype(np.int64) + base for f in ("start", "end", "left", "right")), rec["dead"].copy(), doc)
    return p, (np.concatenate(bits) if bits else np.zeros(0, np.uint8)).astype(bool), first, whole


def _firsts(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each row has the smallest id of its key; rows need not be sorted."""
    order = np.lexsort((ids, key))
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.empty(len(k), dtype=bool)
    out[order] = ids[order] == least
    return out


class _Shared:
    """Fed (name, doc_id) sorted so, tells (doc_id, name, later) of names in two texts or more; later: a smaller doc_id has it."""

    def __init__(self) -> None:
        self.last: tuple | None = None

    def feed(self, name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.last is not None and name[0] == self.last[0]:
            # the run goes on; its first row, told or not, is told again if it is shared
            name, doc = np.append(self.last[0], name), np.append(self.last[1], doc)
        new = np.ones(len(name), dtype=bool)
        new[1:] = name[1:] != name[:-1]
        low = doc[new]
        group = np.cumsum(new) - 1
        later = doc > low[group]
        some = np.zeros(len(low), dtype=bool)
        some[group[later]] = True
        self.last = (name[-1], low[-1])
        take = some[group]
        return doc[take], name[take], later[take]


_POSTED = "route long, name long, doc_id long, settled boolean, state binary"


def _postings(name: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the names of a batch; settled ones are known to be shared with a smaller doc_id."""
    order = np.lexsort((own, name))
    name, own = name[order], own[order]
    new = np.ones(len(name), dtype=bool)
    new[1:] = (name[1:] != name[:-1]) | (own[1:] != own[:-1])
    name, own = name[new], own[new]
    settled = ~_firsts(name, own)
    # the smallest one is still to be told that it is not alone: it goes on with the next one as witness
    witness = np.zeros(len(name), dtype=bool)
    if len(name):
        witness[1:] = settled[1:] & ~settled[:-1]
    route = np.where(settled, tk.mix(own.astype(np.uint64)), name)
    for flag, part in ((True, settled), (False, ~settled | witness)):
        n, r = int(part.sum()), (route if flag else name)[part]
        yield pa.RecordBatch.from_arrays([tk.longs(r), tk.longs(name[part]), pa.array(own[part]), pa.array(np.full(n, flag)), pa.nulls(n, pa.binary())], ["route", "name", "doc_id", "settled", "state"])


def _kept(own: np.ndarray, states: list[bytes]) -> pa.RecordBatch:
    n = len(states)
    return pa.RecordBatch.from_arrays([tk.longs(tk.mix(own.astype(np.uint64))), pa.nulls(n, pa.int64()), pa.array(own, pa.int64()), pa.array(np.full(n, True)), pa.array(states, pa.binary())], ["route", "name", "doc_id", "settled", "state"])


def _told(found: DataFrame) -> DataFrame:
    """Postings -> key, names (those a text shares, and whether a smaller doc_id has them; may repeat), states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = _Shared()
        for b in batches:
            done = b.column(3)
            yes = b.filter(done)
            if yes.num_rows:
                yield pa.RecordBatch.from_arrays([yes.column(2), yes.column(1), pa.array(np.full(yes.num_rows, True)), yes.column(4)], names)
            if yes.num_rows < b.num_rows:
                no = b.filter(pa.compute.invert(done))
                doc, name, later = shared.feed(no.column(1).to_numpy(), no.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(doc), pa.array(later), pa.nulls(len(doc), pa.binary())], ["name", "doc_id", "later", "state"]).select(names)

    names = ["doc_id", "name", "later", "state"]
    told = found.repartition("route").sortWithinPartitions("settled", "name", "doc_id").mapInArrow(run, "doc_id long, name long, later boolean, state binary")
    listed = told.groupBy("doc_id").agg(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "later"))).alias("names"), F.collect_list("state").alias("states"))
    return listed.select(F.coalesce("doc_id", F.lit(NOWHERE)).alias("key"), "names", "states")


def _lists(col: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    return col.flatten(), np.concatenate([[0], np.cumsum(col.value_lengths().to_numpy())])


def _in_text(name: np.ndarray, owner: np.ndarray, known: np.ndarray, known_owner: np.ndarray) -> np.ndarray:
    """Whether each text's name is among those known of that text."""
    return np.isin(tk.mix(name + owner.astype(np.uint64) * _LEFT), tk.mix(known + known_owner.astype(np.uint64) * _LEFT))


def _first_round(docs: DataFrame, window: int, passes: int) -> DataFrame:
    """doc_id, text -> postings of the symbols after the first round, and of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            names, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, _, w in tk.each(b.column(1)):
                p = parse(w).round(0, passes)
                open_ = window_starts(w.first, window)
                some, none = posted(p, open_, w.first, window), bare(p, open_, w.first, window)
                long = np.flatnonzero(w.counts >= window)
                names += [p.name[some], whole_names(w, long).ravel()]
                owners += [p.doc[some] + i, np.repeat(long, 2) + i]
                if len(none):  # such a window goes by its own name
                    names.append(tk.run_names(w.hash, window, 7)[none])
                    owners.append(w.doc_of_word()[none] + i)
            yield from _postings(np.concatenate(names), ids[np.concatenate(owners)])

    return docs.mapInArrow(run, _POSTED)


def _second_round(found: DataFrame, window: int, passes: list[int]) -> DataFrame:
    """Texts with their shared names -> postings and states after the second round. A text that an earlier one equals has no window to verify: its state is its whole name alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            flat, first = _lists(b.column(2))
            value, later = flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy(zero_copy_only=False)
            names, owners, states, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
            for i, j, w in tk.each(b.column(1)):
                span = slice(first[i], first[j])
                v, owner = value[span], np.repeat(np.arange(j - i), np.diff(first[i : j + 1]))
                long = np.flatnonzero(w.counts >= window)
                whole = np.zeros((j - i, 2), np.uint64)
                whole[long] = whole_names(w, long)
                old = later[span]
                copy = np.zeros(j - i, dtype=bool)
                copy[long] = _in_text(whole[long, 0], long, v[old], owner[old]) & _in_text(whole[long, 1], long, v[old], owner[old])
                p = parse(w).round(0, passes[0])
                open_ = window_starts(w.first, window) & ~np.repeat(copy, w.counts)
                alive, none = _in_text(p.name, p.doc, v, owner), bare(p, open_, w.first, window)
                if len(none):
                    open_[none] = _in_text(tk.run_names(w.hash, window, 7)[none], w.doc_of_word()[none], v, owner)
                open_ = close(p, ~alive, open_, w.first, window)
                p.dead = ~alive
                p = p.take(under(p, open_, w.first, window)).round(1, passes[1])
                some = posted(p, open_, w.first, window)
                names.append(p.name[some])
                owners.append(p.doc[some] + i)
                made = pack_states(p, open_, w.first, whole)
                made = [whole[k].tobytes() if copy[k] else s for k, s in enumerate(made)]
                have = np.flatnonzero([s is not None for s in made])
                states += [made[k] for k in have]
                of.append(have + i)
            yield from _postings(np.concatenate(names), ids[np.concatenate(owners)])
            yield _kept(ids[np.concatenate(of)], states)

    return found.mapInArrow(run, _POSTED)


def _open_states(names: pa.ListArray, states: pa.ListArray, window: int) -> tuple[np.ndarray, list[bytes], Parse, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each state, states of whole texts that are copies, symbols, open windows, first[], whole names, rows of copies) once dead symbols have closed their windows."""
    flat, first = _lists(names)
    value = flat.field(0).to_numpy().view(np.uint64)
    packed, at = _lists(states)
    raw = packed.to_pylist()
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    copy = np.array([len(s) == 16 for s in raw], dtype=bool)
    p, open_, begin, whole = unpack_states([s for s in raw if len(s) != 16])
    of = row[~copy]
    alive = _in_text(p.name, of[p.doc], value, np.repeat(np.arange(len(first) - 1), np.diff(first))) if len(p.name) else np.zeros(0, bool)
    open_ = close(p, ~alive & ~p.dead, open_, begin, window)
    p.dead = p.dead | ~alive
    return of, [s for s in raw if len(s) == 16], p, open_, begin, whole, row[copy]


def _next_round(told: DataFrame, window: int, k: int, passes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                cut = b.slice(i, 2000)
                ids = cut.column(0).to_numpy()
                of, copies, p, open_, first, whole, copy_rows = _open_states(cut.column(1), cut.column(2), window)
                p = p.take(under(p, open_, first, window)).round(k, passes)
                some = posted(p, open_, first, window)
                yield from _postings(p.name[some], ids[of[p.doc[some]]])
                made = pack_states(p, open_, first, whole)
                have = np.flatnonzero([s is not None for s in made])
                yield _kept(ids[np.concatenate([of[have], copy_rows])], [made[j] for j in have] + copies)

    return told.select("key", "names", "states").mapInArrow(run, _POSTED)


def _positions(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """(doc_id, positions packed as 32-bit numbers), a row for each text."""
    order = np.argsort(doc, kind="stable")
    doc, at = doc[order], at[order].astype(np.int32)
    new = np.ones(len(doc), dtype=bool)
    new[1:] = doc[1:] != doc[:-1]
    head = np.append(np.flatnonzero(new), len(doc))
    packed = pa.Array.from_buffers(pa.binary(), len(head) - 1, [None, pa.py_buffer((4 * head).astype(np.int32).tobytes()), pa.py_buffer(at.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(doc[head[:-1]]), packed], ["doc_id", "at"])


def _windows(found: DataFrame, window: int) -> DataFrame:
    """Texts with their names and states -> (h1, h2, doc_id, at, done): windows to be compared; done: packed windows that are settled as repeats."""
    fields = ["h1", "h2", "doc_id", "at", "done"]

    def settled(doc: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = _positions(doc, at)
        k = rows.num_rows
        if k:
            yield pa.RecordBatch.from_arrays([tk.longs(tk.mix(rows.column(0).to_numpy().astype(np.uint64))), pa.nulls(k, pa.int32()), rows.column(0), pa.nulls(k, pa.int32()), rows.column(1)], fields)

    def combined(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        h1, h2, doc, at = (np.concatenate(x) for x in zip(*parts))
        first = _firsts(h1 ^ tk.mix(h2.astype(np.uint64)), doc)
        yield from settled(doc[~first], at[~first])
        h1, h2, doc, at = h1[first], h2[first], doc[first], at[first]
        for i in range(0, len(h1), 1 << 17):
            k = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([tk.longs(h1[k]), pa.array(h2[k]), pa.array(doc[k]), pa.array(at[k]), pa.nulls(len(h1[k]), pa.binary())], fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            of, _, _, open_, begin, whole, copy_rows = _open_states(b.column(2), b.column(3), window)
            # rows that repeat a doc_id share its states: each takes that of its own words
            mine = {(int(r), *map(int, x)): k for k, (r, x) in enumerate(zip(of, whole))}
            copies = set(copy_rows.tolist())
            parts, n = [], 0
            for i, j, w in tk.each(b.column(1)):
                long = np.flatnonzero(w.counts >= window)
                flag = np.zeros(len(w.hash), dtype=bool)
                for t, name in zip(long, whole_names(w, long)):
                    k = mine.get((int(i + t), *map(int, name)))
                    if k is not None:
                        flag[w.first[t] : w.first[t + 1]] = open_[begin[k] : begin[k + 1]]
                    elif int(i + t) in copies:
                        last = w.counts[t] - window
                        yield from settled(np.full(last // window + 2, ids[i + t]), np.append(np.arange(0, last + 1, window), last))
                at = np.flatnonzero(flag)
                if not len(at):
                    continue
                doc = w.doc_of_word()[at]
                h2 = (tk.run_names(w.hash, window, 5)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                parts.append((tk.run_names(w.hash, window, 3)[at], h2, ids[i:j][doc], (at - w.first[doc]).astype(np.int32)))
                n += len(at)
                if n > COMBINE:
                    yield from combined(parts)
                    parts, n = [], 0
            if parts:
                yield from combined(parts)

    return found.mapInArrow(run, "h1 long, h2 int, doc_id long, at int, done binary")


def _repeats(named: DataFrame) -> DataFrame:
    """(doc_id, at): first words of windows that start in a smaller doc_id as well, packed; several rows a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            done = b.column(4).is_valid()
            if done.true_count:
                yield pa.RecordBatch.from_arrays([b.column(2).filter(done), b.column(4).filter(done)], ["doc_id", "at"])
            if done.true_count == b.num_rows:
                continue
            b = b.filter(b.column(4).is_null())
            h1, h2, doc, at = (b.column(k).to_numpy() for k in range(4))
            new = np.ones(len(h1), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last is None or (h1[0], h2[0]) != last[:2]
            low = np.concatenate([[last[2] if last else 0], doc[new]])[np.cumsum(new)]
            last = (h1[-1], h2[-1], low[-1])
            if (doc > low).any():
                yield _positions(doc[doc > low], at[doc > low])

    return named.repartition("h1").sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(run, "doc_id long, at binary")


def covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie under a window that begins in starts."""
    step = np.zeros(n + 1, dtype=np.int32)
    starts = np.unique(starts)
    step[starts] += 1
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, *, window: int = 50) -> DataFrame:
    """docs (doc_id, text, ...) -> docs with n_words, n_removed, kept_text: words under a repeated window are left out.

    A window is ``window`` consecutive words of one text. A word goes if a window over it also starts in a
    row with a smaller doc_id, judged on the texts as given. kept_text holds the other words, joined by one
    space; it is the empty string if none is left and for a null, empty or blank text.
    Rows that repeat a doc_id never count as smaller than each other; if their texts differ, each is cut at
    the places found in any of them. Rows without a doc_id come back whole. Other columns of docs stay as they are, but for former n_words,
    n_removed and kept_text, which are replaced. An empty table gives an empty one.
    """
    if window < 1:
        raise ValueError("a window has a word at least")
    docs = docs.drop("n_words", "n_removed", "kept_text")
    # all joins read the texts under a key that is never null and with all columns, so that one exchange serves them
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NOWHERE)).alias("key"), "text", F.struct(*[c for c in docs.columns if c != "text"]).alias("rest"))
    passes = plan(window)
    told = _told(_first_round(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), window, passes[0]))
    told = _told(_second_round(keyed.join(told, "key").select("key", "text", "names", "rest"), window, passes))
    for k in range(2, len(passes)):
        told = _told(_next_round(told, window, k, passes[k]))
    repeats = _repeats(_windows(keyed.join(told, "key").select("key", "text", "names", "states", "rest"), window)).groupBy("doc_id").agg(F.collect_list("at").alias("gone"))
    repeats = repeats.select(F.coalesce("doc_id", F.lit(NOWHERE)).alias("key"), "gone")
    packed = keyed.join(repeats, "key", "left").select("text", "gone", "rest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column(1)
            n_words, n_removed, kept = [], [], []
            for i, text in enumerate(b.column(0).to_pylist()):
                w = (text or "").encode().split()
                n_words.append(len(w))
                if gone[i].is_valid:
                    at = np.frombuffer(b"".join(gone[i].as_py()), np.int32)
                    cut = covered(len(w), at[at + window <= len(w)], window)
                    w = [w[k] for k in np.flatnonzero(~cut)]
                n_removed.append(n_words[-1] - len(w))
                kept.append(b" ".join(w))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["text", "rest", "n_words", "n_removed", "kept_text"])

    out = packed.mapInArrow(run, f"text string, rest {packed.schema['rest'].dataType.simpleString()}, n_words long, n_removed long, kept_text string")
    return out.select(*[F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns], "n_words", "n_removed", "kept_text")
