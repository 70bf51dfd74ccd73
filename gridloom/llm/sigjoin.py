"""MinHash near-duplicates by an inverted join on signature coordinates.

Every distinct shingle set gets a signature of ``n_coords`` min-hash coordinates. Two sets of similarity s
agree on each coordinate with probability s, so a pair at the threshold agrees on ``min_match`` of them or
more but for a chance below 1e-5 (defaults: 32 coordinates, 16 matches, s = 0.85). Any such pair must agree
on one of the first ``n_coords - min_match + 1`` coordinates (the prefix), so sets are posted under those
coordinate-value pairs only; in each posting list the whole signatures are merged and matches counted, a
pair whose ends already hang together there being skipped. Lists return a spanning forest, never their
pairs. The families that result are brought together once with their full texts, and a link stands only
if the full shingle sets confirm it.

Lists and families above a size are cut into blocks, and a few of their members, the pivots, visit every
block first. What hangs together by its links to pivots is not compared again; only the rest visits the
other blocks. So the work on a family of copies grows in proportion to its size, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .durable import settle

_STEP = [np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)]


def shingle_hashes(w: tk.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``width`` words, first[]), a text of fewer words giving one run of all of them."""
    n, m = w.counts, len(w.hash)
    h = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        h[: m - k] += w.hash[k:] * _STEP[k % 5] * np.uint64(2 * (k // 5) + 1)
    h = tk.mix(h)
    at = np.arange(m) - np.repeat(w.first[:-1], n)
    take = at <= np.repeat(n - width, n)
    short = np.flatnonzero((n > 0) & (n < width))
    if len(short):
        whole = tk.rolling(w.hash)
        h[w.first[:-1][short]] = tk.mix(tk.span(whole, w.first[:-1][short], w.first[1:][short]) + n[short].astype(np.uint64))
        take[w.first[:-1][short]] = True
    return h[take], np.concatenate([[0], np.cumsum(np.where(n >= width, n - width + 1, (n > 0).astype(np.int64)))])


def shingle_sets(w: tk.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles in rising order, and first[]."""
    h, first = shingle_hashes(w, width)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.searchsorted(doc[new], np.arange(len(first)))


def set_names(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in two halves, that name each set of shingles."""
    n = np.diff(first).astype(np.uint64)
    out = []
    for item in (tk.mix(h ^ np.uint64(0x51ED270B)), tk.mix(h + np.uint64(0xC2B2AE3D27D4EB4F))):
        c = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(item, out=c[1:])
        out.append(tk.mix((c[first[1:]] - c[first[:-1]]) + n))
    return out[0], out[1]


def _signatures(h: np.ndarray, first: np.ndarray, n_coords: int, prefix: int) -> tuple[np.ndarray, np.ndarray]:
    """(16 bits of each min-hash coordinate, a name of each of the first ``prefix`` coordinate-value pairs); rows of empty sets are 0.

    Names are of 58 bits of the value, so that lists do not fill up by chance as the corpus grows; the low six bits are the coordinate.
    """
    out = np.zeros((len(first) - 1, n_coords), dtype=np.uint16)
    names = np.zeros((len(first) - 1, prefix), dtype=np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        rng = np.random.default_rng(8)
        for k, (x, a) in enumerate(rng.integers(1, 2**63, (n_coords, 2), dtype=np.uint64)):
            low = tk.mix(np.minimum.reduceat((h ^ x) * (a | np.uint64(1)), first[:-1][full]))
            out[full, k] = low >> np.uint64(48)
            if k < prefix:
                names[full, k] = low & ~np.uint64(63) | np.uint64(k)
    return out, names


def sketch(docs: DataFrame, width: int, n_coords: int, prefix: int) -> DataFrame:
    """doc_id -> doc_id, n_shingles, set_a, set_b (128 bits that name the shingle set), sig, tokens (names of the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for i, j, w in tk.each(b.column(1), fold=True):
                h, first = shingle_sets(w, width)
                n = np.diff(first)
                a, c = set_names(h, first)
                sig, names = _signatures(h, first, n_coords, prefix)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * prefix), tk.longs(names.ravel()))
                yield pa.RecordBatch.from_arrays([ids[i:j], pa.array(n.astype(np.int64)), tk.longs(a), tk.longs(c), pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * n_coords), j - i, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary()), tokens], ["doc_id", "n_shingles", "set_a", "set_b", "sig", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_a long, set_b long, sig binary, tokens array<long>")


def runs_of(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Whole runs of equal leading columns from batches that are sorted by them; tables of many runs."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = [b.column(k).to_numpy(zero_copy_only=False) for k in range(n_keys)]
        new = np.ones(b.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        new[0] = last is not None and tuple(k[0] for k in keys) != last
        last = tuple(k[-1] for k in keys)
        cut = np.flatnonzero(new)
        if len(cut):
            head = pa.Table.from_batches([*held, b.slice(0, cut[-1])])
            if head.num_rows:
                yield head
            held = [b.slice(cut[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def run_bounds(t: pa.Table, n_keys: int) -> np.ndarray:
    """Where each run begins, and the number of rows."""
    keys = [t.column(k).to_numpy() for k in range(n_keys)]
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.append(np.flatnonzero(new), t.num_rows)


def _sig_matrix(col: pa.ChunkedArray, n_coords: int) -> np.ndarray:
    col = pa.concat_arrays(col.chunks) if col.num_chunks > 1 else col.chunk(0)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint16).reshape(len(col), n_coords)


#: Members of a heavy group that visit all its blocks first.
PIVOTS = 8


def forest(label: np.ndarray, active: np.ndarray, guest: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray], sure: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Pairs that, with the labels, hang together all rows that link: each active row is compared with every row.

    Rows of one label hang together already; guests do not meet each other here. near tells which of some rows
    may link with row i, sure (where given) whether one does.
    """
    root = np.unique(label, return_inverse=True)[1]
    at, every, out = np.arange(len(root)), bool(active.all()), []
    for i in np.flatnonzero(active):
        rest = root != root[i]
        if every:
            rest[: i + 1] = False
        else:
            rest &= ~active | (at > i)
        if guest[i]:
            rest &= ~guest
        rest = np.flatnonzero(rest)
        if not len(rest):
            continue
        for j in rest[near(int(i), rest)]:
            if root[i] != root[j] and (sure is None or sure(int(i), int(j))):
                root[root == root[j]] = root[i]
                out.append((int(i), int(j)))
    return out


#: Rows of a table of heavy groups up to which it is broadcast (some 16 MB); beyond, joins shuffle it.
SMALL = 1_000_000


def small(table: DataFrame) -> DataFrame:
    """``table``, which is settled, to be broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def spanning_links(members: DataFrame, key: str, heavy: DataFrame, weight: str, limit: int, connect: Callable[[pa.Table, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]) -> DataFrame:
    """members (key, doc_id, ...) -> (a, b): links that span, group by group of ``key``, all that ``connect`` finds in the group.

    heavy: (key, weight) of the groups heavier than ``limit``, each cut into blocks of about that weight.
    connect(rows, label, active, guest): a forest of one block, as of :func:`forest`.
    """
    payload = [c for c in members.columns if c not in (key, "doc_id")]
    cols = [key, "block", "doc_id", "label", "active", "guest", *payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, 2):
            cut = run_bounds(t, 2)
            ids, label = t.column(2).to_numpy(), t.column(3).to_numpy()
            active, guest = (t.column(k).to_numpy(zero_copy_only=False) for k in (4, 5))
            a, b = [], []
            for r in np.flatnonzero(np.diff(cut) > 1):
                lo, hi = cut[r], cut[r + 1]
                if active[lo:hi].any():
                    for i, j in connect(t.slice(lo, hi - lo), label[lo:hi], active[lo:hi], guest[lo:hi]):
                        a.append(ids[lo + i])
                        b.append(ids[lo + j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def meet(rows: DataFrame) -> DataFrame:
        return rows.select(cols).repartition(key, "block").sortWithinPartitions(key, "block").mapInArrow(run, "a long, b long").distinct()

    yes, no = F.lit(True), F.lit(False)
    whole = {"block": F.lit(0), "label": F.col("doc_id"), "active": yes, "guest": no}
    if not heavy.head(1):
        return meet(members.withColumns(whole))
    heavy = small(heavy)
    light = meet(members.join(heavy, key, "left_anti").withColumns(whole))
    n_blocks = F.ceil(F.col(weight) / F.lit(limit)).cast("int")
    hot = members.join(heavy, key).withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks").cast("long")).cast("int"))
    hot = settle(hot.drop(weight))
    every_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id"))
    pivots = hot.withColumn("nth", first).where(F.col("nth") <= PIVOTS).withColumns({"block": every_block, "active": yes})
    by_pivot = settle(meet(pivots.drop("nth").unionByName(hot.withColumn("active", no)).withColumns({"label": F.col("doc_id"), "guest": no})))
    hung = hot.join(components(by_pivot).withColumnsRenamed({"v": "c_v", "root": "c_root"}), F.col("doc_id") == F.col("c_v"), "left").withColumn("label", F.coalesce("c_root", "doc_id")).drop("c_v", "c_root")
    most = hung.groupBy(key, "label").agg(F.count("*").alias("n")).groupBy(key).agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    hung = settle(hung.join(most, key).withColumn("active", F.col("label") != F.col("most")))
    rest = hung.where("active")
    guests = rest.withColumns({"home": F.col("block"), "block": every_block, "guest": yes}).where("block != home").drop("home")
    left = hung.withColumn("guest", no).join(rest.select(key).distinct(), key, "left_semi")
    return light.union(by_pivot).union(meet(left.unionByName(guests)))


def candidate_links(reps: DataFrame, n_coords: int, min_match: int, list_limit: int) -> DataFrame:
    """reps (doc_id, sig, tokens) -> (a, b): a forest which, list by list, spans all pairs with enough matches."""
    before = F.transform("tokens", lambda x, k: F.struct(x.alias("token"), F.when(k > 0, F.element_at("tokens", k)).alias("prior")))
    posted = reps.select(F.explode(before).alias("x"), "doc_id", "sig").select("x.token", "doc_id", F.coalesce("x.prior", F.lit(0)).alias("prior"), "sig")
    def longer(lists: DataFrame) -> DataFrame:
        return settle(lists.groupBy("token").agg(F.count("*").alias("n_posted")).where(F.col("n_posted") > list_limit))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, sig = b.column(0).to_numpy().view(np.uint64), _sig_matrix(pa.chunked_array([b.column(3)]), n_coords)
            at = (token & np.uint64(63)).astype(np.int64)
            for k in range(1, n_coords - min_match + 2):
                r = np.flatnonzero(at < k)
                if len(r):
                    name = tk.mix(token[r] ^ tk.mix(sig[r, k].astype(np.uint64) << np.uint64(8) | np.uint64(k)))
                    part = b.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays([tk.longs(name), part.column(1), pa.array(np.zeros(len(r), np.int64)), part.column(3)], ["token", "doc_id", "prior", "sig"])

    def connect(t: pa.Table, label: np.ndarray, active: np.ndarray, guest: np.ndarray) -> list[tuple[int, int]]:
        # skip merging: a pair that shares the list of the coordinate before as well met there, by the same rule at its first one
        prior = t.column(6).to_numpy()
        if prior[0] and (prior == prior[0]).all():
            return []
        sig = _sig_matrix(t.column(7), n_coords)

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            ok = (sig[rest] == sig[i]).sum(axis=1) >= min_match
            return ok & (prior[rest] != prior[i]) if prior[i] else ok

        return forest(label, active, guest, near)

    long_lists = longer(reps.select(F.explode("tokens").alias("token")))
    if not long_lists.head(1):
        return spanning_links(posted, "token", long_lists, "n_posted", list_limit, connect)
    # a long list is parted by the coordinate of the second match, which a pair with enough matches has by coordinate n - m + 1;
    # what is still long then is mostly a family of copies
    long_lists = small(long_lists)
    light = spanning_links(posted.join(long_lists, "token", "left_anti"), "token", long_lists.limit(0), "n_posted", list_limit, connect)
    parted = posted.join(long_lists.select("token"), "token").select("token", "doc_id", "prior", "sig").mapInArrow(refine, "token long, doc_id long, prior long, sig binary")
    parted = settle(parted)
    return light.union(spanning_links(parted, "token", longer(parted), "n_posted", list_limit, connect))


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, n_coords: int = 32, min_match: int = 13, list_limit: int = 4096, family_limit: int = 2_000_000) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept: one row for each row of docs.

    A-Z count as a-z. Two texts link if 100 * |intersection| >= percent * |union| of their sets of distinct
    ``width``-word shingles (a text of fewer words: all of them as one shingle). component_id is the
    smallest doc_id that links reach, kept whether it is the row's own.
    Null, empty and blank texts have n_shingles 0 and link with nothing. Equal texts are one group whatever
    their number. Rows that repeat a doc_id are judged by their own texts, except that two texts whose
    groups have the same smallest doc_id count as linked. Rows without a doc_id come back with component_id
    null and kept true. Further columns of docs are ignored. An empty table gives an empty one.

    min_match: matching coordinates that make a candidate; for another threshold take a number whose
    binomial tail at that similarity is negligible (0.80: 13 of 32, 0.85: 16 of 32).
    list_limit: postings, family_limit: words, beyond which a list or family is cut into blocks.
    """
    prefix = n_coords - min_match + 1
    if prefix > 64:
        raise ValueError("more than 64 prefix coordinates")
    base = settle(sketch(docs, width, n_coords, prefix))
    full = base.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "sig", "tokens")).alias("r"))
    reps = settle(classes.select("set_a", "set_b", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n_shingles"), F.col("r.sig").alias("sig"), F.col("r.tokens").alias("tokens")))
    family = components(candidate_links(reps.select(F.col("rep").alias("doc_id"), "sig", "tokens"), n_coords, min_match, list_limit))
    links = _verify(docs, reps, family, width, percent, n_coords, min_match, family_limit)
    of_class = components(links)
    named = reps.select("set_a", "set_b", "rep").join(of_class.withColumnsRenamed({"v": "rep"}), "rep", "left").select("set_a", "set_b", F.coalesce("root", "rep").alias("c"))
    out = base.select("doc_id", "n_shingles", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that :func:`near_duplicates` keeps, with their columns; of rows equal in doc_id and text, one."""
    nowhere = F.lit(-1 << 63)
    kept = near_duplicates(docs, **options).where("kept").select(F.coalesce("doc_id", nowhere).alias("key")).distinct()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), nowhere).alias("key"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    return keyed.join(kept, "key", "left_semi").dropDuplicates(["key", "hash"]).select("row.*")


def _verify(docs: DataFrame, reps: DataFrame, family: DataFrame, width: int, percent: int, n_coords: int, min_match: int, family_limit: int) -> DataFrame:
    """Families brought together with their texts -> (a, b): a forest of the links that the full sets confirm."""
    member = reps.select(F.col("rep").alias("doc_id"), "set_a", "set_b", "n_shingles", "sig").join(family.select(F.col("v").alias("doc_id"), "root"), "doc_id")
    member = settle(member)
    heavy = settle(member.groupBy("root").agg(F.sum("n_shingles").alias("n_words")).where(F.col("n_words") > family_limit))
    # the same plan at every size: the texts are sent to the ids once, by a merge join
    texts = docs.select(F.col("doc_id").cast("long"), "text").hint("merge").join(member.drop("n_shingles"), "doc_id")

    def connect(t: pa.Table, label: np.ndarray, active: np.ndarray, guest: np.ndarray) -> list[tuple[int, int]]:
        sets: list[np.ndarray] = []
        ours = []
        wanted = [t.column(k).to_numpy().view(np.uint64) for k in (6, 7)]
        for i, j, w in tk.each(t.column(9).combine_chunks(), fold=True):
            h, first = shingle_sets(w, width)
            a, c = set_names(h, first)
            # of rows that repeat a doc_id, those with the class's own set stand for the class
            ours.append((a == wanted[0][i:j]) & (c == wanted[1][i:j]))
            sets += np.split(h, first[1:-1])
        take = np.flatnonzero(np.concatenate(ours))
        if len(take) < 2:
            return []
        n = np.array([len(sets[k]) for k in take])
        first = np.concatenate([[0], np.cumsum(n)])
        vocabulary, code = np.unique(np.concatenate([sets[k] for k in take]), return_inverse=True)
        sig, mark, marked = _sig_matrix(t.column(8), n_coords)[take], np.zeros(len(vocabulary), dtype=bool), [-1]

        def near(i: int, rest: np.ndarray) -> np.ndarray:
            return ((sig[rest] == sig[i]).sum(axis=1) >= min_match) & (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest]))

        def sure(i: int, j: int) -> bool:
            if marked[0] != i:
                mark[:] = False
                mark[code[first[i] : first[i + 1]]] = True
                marked[0] = i
            both = int(np.count_nonzero(mark[code[first[j] : first[j + 1]]]))
            return 100 * both >= percent * (int(n[i]) + int(n[j]) - both)

        return [(int(take[i]), int(take[j])) for i, j in forest(label[take], active[take], guest[take], near, sure)]

    return spanning_links(texts.select("root", "doc_id", "set_a", "set_b", "sig", "text"), "root", heavy, "n_words", family_limit, connect)
