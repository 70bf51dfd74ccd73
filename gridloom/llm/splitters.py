"""Sharding by sampled splitters; DataFrame functions only.

Records are ordered by a hash of their text, so equal texts lie together. A sample in which a record's chance
is proportional to its size gives the splitters, which are quantiles of the bytes; they cut the hashes into
many more ranges than shards. Ranges that come out too large are subdivided by another hash of the text, and
what is still too large (a hot text) by a hash of doc_id. Then the true bytes of the ranges are summed, and ranges go to shards in order, each to the shard
in whose share of all bytes its middle lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import settle

#: Splitters, and sampled records for each: both bounded, whatever the table.
RANGES, SAMPLES = 4096, 32
_STEP = 64


def _unit(*cols: Column) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many of the rising cuts are at most ``key``, by two short steps."""
    if not cuts:
        return F.lit(0)
    array = lambda xs: "array(" + ", ".join(xs) + ")"
    longs = [[f"{x}L" for x in cuts[i : i + _STEP]] for i in range(0, len(cuts), _STEP)]
    at_most = lambda xs: F.size(F.filter(xs, lambda c: c <= key))
    heads = at_most(F.expr(array([r[0] for r in longs])))
    lists = F.expr(array([array(r) for r in longs]))
    return F.when(heads == 0, F.lit(0)).otherwise((heads - 1) * _STEP + at_most(F.element_at(lists, F.greatest(heads, F.lit(1)))))


def shard(docs: DataFrame, *, n_shards: int = 8) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, shard (int), slot (long): one row for each row of docs.

    size: UTF-8 bytes of the text (null: none) plus 1. text_crc32 is that of the UTF-8 bytes, null texts as
    empty. Shards have nearly equal bytes; slots number the rows of a shard from 0 without gaps. Equal texts
    are in one shard unless they are too many for a range or a range's border in bytes parts them. Repeated
    rows get slots of their own. Reruns give the same shards. Other columns are ignored; an empty table gives
    an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    rows = settle(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key")))
    total, count = rows.agg(F.sum("size"), F.count("*")).first()
    if not count:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # a record stands for each time that the line of sizes, from a random place in it, crosses a mark: size / mark times
    mark = max(1.0, total / (RANGES * SAMPLES))
    drawn = rows.select("key", F.floor(F.col("size") / mark + _unit("doc_id", "key")).alias("times")).where("times > 0")
    # keys are told apart to 53 bits; the sample has about RANGES * SAMPLES marks, so one task can sort it
    coarse = F.shiftright("key", 11)
    marks = drawn.groupBy(coarse.alias("key")).agg(F.sum("times").alias("times"))
    line = Window.orderBy("key")
    upto = F.sum("times").over(line)
    step = F.lit(RANGES) / F.sum("times").over(Window.partitionBy())
    # the key at which the running weight crosses a multiple of 1 / RANGES
    crossed = marks.select("key", F.floor(upto * step).alias("now"), F.floor((upto - F.col("times")) * step).alias("before")).where("now > before").select("key")
    cuts = sorted(r["key"] + 1 for r in crossed.collect())[:-1]  # RANGES at most; the last key has the whole weight
    ranged = rows.withColumn("range", _range_of(coarse, cuts))
    # ranges beyond twice their share are subdivided
    share = max(1.0, total / RANGES)
    over = ranged.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * share)
    over = over.select(F.col("range").alias("o_range"), F.ceil(F.col("bytes") / share).cast("int").alias("parts"))
    ranged = ranged.join(F.broadcast(over), F.col("range") == F.col("o_range"), "left")  # at most RANGES rows
    # by text, so equal texts stay together; what a single text makes too large is then cut by doc_id
    ranged = ranged.withColumn("piece", F.coalesce(F.floor(_unit(F.lit(8), "key") * F.col("parts")), F.lit(0)).cast("int"))
    hot = ranged.where("parts is not null").groupBy("range", "piece").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > 2 * share)
    hot = hot.select(F.col("range").alias("h_range"), F.col("piece").alias("h_piece"), F.ceil(F.col("bytes") / share).cast("int").alias("cuts"))
    ranged = ranged.join(F.broadcast(hot), (F.col("range") == F.col("h_range")) & (F.col("piece") == F.col("h_piece")), "left")  # at most RANGES / 2 rows
    spread = F.floor(_unit(F.lit(9), "doc_id") * F.col("cuts"))
    ranged = ranged.withColumn("part", F.struct("piece", F.coalesce(spread, F.lit(0)).cast("int").alias("cut")))
    ranges = ranged.groupBy("range", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # at most some RANGES rows: one task numbers them
    line = Window.orderBy("range", "part")
    ranges = ranges.withColumn("middle", F.sum("bytes").over(line) - F.col("bytes") / 2)
    ranges = ranges.withColumn("shard", F.least(F.floor(F.col("middle") * n_shards / F.lit(total)), F.lit(n_shards - 1)).cast("int"))
    ranges = ranges.withColumn("first", F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part")) - F.col("n"))
    ranges = ranges.select(F.col("range").alias("r_range"), F.col("part").alias("r_part"), "shard", "first")
    number = F.row_number().over(Window.partitionBy("range", "part").orderBy("key", "doc_id"))
    out = ranged.withColumn("number", number).join(F.broadcast(ranges), (F.col("range") == F.col("r_range")) & (F.col("part") == F.col("r_part")))
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("number") - 1).alias("slot"))
