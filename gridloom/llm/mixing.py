"""Mixing sources to target weights by systematic sampling; DataFrame functions only.

Within a source, every document is due the same number of copies, target / size of the source (3 at most).
Lay these expected copies end to end, add one random offset, and each integer boundary that a document's
stretch crosses is one copy. Documents lie in order of size, so each stretch of the line holds like sizes
and the words taken differ from the target by about one document.

The prefix sums come in two steps, so that no source, however hot, is sorted in one task: documents are
numbered within blocks (source, size class, hash class), and the blocks, whose number a source bounds, are
summed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle

#: Hash classes of each (source, size class).
SPREAD = 64
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digits(key: Column, start: int, n: int) -> Column:
    """n hex digits of the key's md5, as a number."""
    return F.conv(F.substring(F.md5(key), start, n), 16, 10).cast("long")


def targets(sizes: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    Sources in order of code point, null last, have the weights in turn, repeating, and share the sum of all
    sizes by weight. A target stops at ``cap`` times its source's size and the excess is shared by weight
    among the others until none is above: the level L with sum(least(weight * L, cap * size)) = total. In
    order of cap * size / weight, the sources that stop are a prefix.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())  # one row a source
    turn = F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights)))
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), turn + 1))
    w = w.withColumns({"most": F.lit(cap) * F.col("source_size"), "total": F.sum("source_size").over(Window.partitionBy())})
    w = w.withColumn("at", F.col("most") / F.col("weight"))
    line = Window.orderBy("at", F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rest = line.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    w = w.withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that does not stop sets the level for all after it
    w = w.withColumn("final", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(Window.partitionBy())["level"])
    stops = F.col("final").isNull() | (F.col("at") < F.col("final"))
    return w.select("source", "source_size", F.when(stops, F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _size_class(size: Column) -> Column:
    """The number of binary digits of size + 1, and the three after the first: classes of an eighth of an octave."""
    digits = F.bin(size + 1)
    return (F.length(digits) * 8 + F.conv(F.rpad(F.substring(digits, 2, 3), 3, "0"), 2, 10).cast("int")).cast("int")


def copies(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0, seed: int = 0, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, source, size, source_size, target, n_copies: one row for each row of docs.

    size is the number of words of the text (null: 0). Reruns give the same copies: the offset of a source
    is a hash of it and ``seed``. Rows that tie in every respect are interchangeable, so which of repeated
    rows has the copy does not matter. A source without words has target 0 and its texts no copies. A row
    has at most ceil(cap) copies. Other columns are ignored, or with ``carry`` come along in the struct
    ``row``; an empty table gives an empty one.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    counted = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *([F.struct(*docs.columns).alias("row")] if carry else []))
    counted = counted if carry else settle(counted)  # texts are read once, unless they come along
    placed = counted.withColumns({"size_class": _size_class(F.col("size")), "spread": F.pmod(_digits(key, 1, 6), F.lit(SPREAD)).cast("int")})
    place = ["source", "size_class", "spread"]
    blocks = placed.groupBy(*place).agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")), weights=weights, cap=cap)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(cap))).otherwise(F.lit(0.0))
    goal = goal.select(F.col("source").alias("g_source"), "source_size", "target", rate.alias("rate"))
    # by hash, from 1 / 2 ** 33 to 1 less that
    offset = (_digits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), 1, 8) + 0.5) / float(16**8)
    before = F.sum("n").over(Window.partitionBy("source").orderBy("size_class", "spread")) - F.col("n")
    blocks = blocks.withColumns({"before": before, "offset": offset}).join(goal, F.col("source").eqNullSafe(F.col("g_source")))
    blocks = blocks.select(*[F.col(c).alias(f"b_{c}") for c in place], "before", "source_size", "target", "rate", "offset")
    number = F.row_number().over(Window.partitionBy(*place).orderBy("size", "doc_id"))
    same = F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size_class") == F.col("b_size_class")) & (F.col("spread") == F.col("b_spread"))
    out = placed.withColumn("number", number).join(blocks, same)
    rank = F.col("before") + F.col("number")
    reach = lambda r: F.floor(F.col("offset") + F.col("rate") * r)
    n = F.least(reach(rank) - reach(rank - 1), F.lit(-int(-cap // 1))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", n.alias("n_copies"), *(["row"] if carry else []))


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """docs (doc_id, text, source, ...) -> the rows of docs that the mix takes, each as often as it takes it.

    Options and edge cases: :func:`copies`.
    """
    taken = copies(docs, carry=True, **options).where("n_copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_copies")).alias("copy")).select("row.*")
