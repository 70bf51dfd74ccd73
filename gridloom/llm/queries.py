"""The query opN_<name> of each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langkernel, mixing, projcount, recompress, reply_trees, seqpack, sigjoin, splitters, urlrules, weakrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(probe)
    return reply_trees.read_back(reply_trees.conversations(reply_trees.chains(rows)))


def encoder():
    import public_tokenizers as public

    return seqpack.byte_bpe(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op2_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqpack.pack_documents(_table(spark, sf_dir, "documents"), encoder, window=2048, end_id=1, with_ids=False)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weakrules.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langkernel.identify(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = recompress.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"))


def op7_vector_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projcount.links(_table(spark, sf_dir, "embeddings"), cosine=0.93)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigjoin.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85, min_match=16)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splitters.shard(_table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.copies(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_sequence_packing": op2_sequence_packing,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_url_filters": op6_url_filters,
    "op7_vector_near_duplicates": op7_vector_near_duplicates,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_sharding": op9_sharding,
    "op10_source_mixing": op10_source_mixing,
}

ORACLE_SQL = {
    "op1_chat_formatting": r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS k,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?ROLE\]|/?INST\])', '\1\\\2\3', 'g')) AS er,
         length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?ROLE\]|/?INST\])', '\1\\\2\3', 'g')) AS et FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(9 + er + 7 + et + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op5_substring_dedup": r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
k AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS i,
         unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
  FROM w WHERE len(w) >= 50),
f AS (SELECT h, min(doc_id) AS f FROM k GROUP BY h),
c AS (SELECT DISTINCT k.doc_id, k.i + j.j AS p FROM k JOIN f ON f.h = k.h AND f.f < k.doc_id, (SELECT unnest(range(0, 50)) AS j) j),
p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
r AS (
  SELECT p.doc_id, count(c.p) AS n_removed, string_agg(p.word, ' ' ORDER BY p.p) FILTER (WHERE c.p IS NULL) AS kept
  FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(r.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN r ON r.doc_id = w.doc_id
""",
    "op8_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = d.doc_id
""",
    "op10_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
p AS (
  SELECT *, length(bin(size + 1)) * 8 + CAST('0b' || rpad(substr(bin(size + 1), 2, 3), 3, '0') AS INTEGER) AS size_class,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '-')), 1, 6) AS BIGINT) % 64 AS spread FROM d),
s AS (
  SELECT source, sum(size) AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END) AS weight
  FROM p GROUP BY source),
l AS (
  SELECT a.source, (SELECT arg_min(x, edge) FROM (
      SELECT greatest(3e0 * c.source_size / c.weight, 0) AS edge,
             ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum(3e0 * b.source_size) FROM s b WHERE 3e0 * b.source_size / b.weight < 3e0 * c.source_size / c.weight), 0))
             / (SELECT sum(b.weight) FROM s b WHERE 3e0 * b.source_size / b.weight >= 3e0 * c.source_size / c.weight) AS x
      FROM s c) WHERE x <= edge) AS level FROM s a),
g AS (
  SELECT s.source, CAST(s.source_size AS BIGINT) AS source_size, CAST(CASE WHEN level IS NULL THEN 3e0 * s.source_size ELSE least(3e0 * s.source_size, weight * level) END AS DOUBLE) AS target
  FROM s JOIN l ON s.source IS NOT DISTINCT FROM l.source),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size_class, spread, size, doc_id) AS rank FROM p),
r AS (
  SELECT n.doc_id, n.size, g.source_size, g.target, n.rank, CASE WHEN g.source_size > 0 THEN least(g.target / g.source_size, 3e0) ELSE 0e0 END AS rate,
         (CAST('0x' || substr(md5('0:' || coalesce('s' || n.source, 'n')), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0 AS o
  FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(o + rate * rank) - floor(o + rate * (rank - 1)), 3) AS BIGINT) AS taken FROM r
""",
    "op6_url_filters": r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
t AS (
  SELECT *, CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
         list_sort(list_distinct(list_concat(
           list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
           list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'p:' || x)))) AS tokens FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM t),
u AS (SELECT id, said, unnest(tokens) AS token FROM v),
k AS (SELECT * FROM u WHERE said IS NOT NULL),
c AS (
  SELECT id, said, [token] AS a FROM k
  UNION ALL SELECT x.id, x.said, [x.token, y.token] FROM k x JOIN k y ON y.id = x.id AND y.token > x.token
  UNION ALL SELECT x.id, x.said, [x.token, y.token, z.token] FROM k x JOIN k y ON y.id = x.id AND y.token > x.token JOIN k z ON z.id = x.id AND z.token > y.token),
m AS (SELECT ceil(0.01e0 * count(*)) AS least FROM v WHERE said IS NOT NULL AND len(tokens) > 0),
r AS (
  SELECT a, said AS label, count(*) AS support, count(*) / CAST(sum(count(*)) OVER (PARTITION BY a) AS DOUBLE) AS confidence FROM c GROUP BY a, said),
g AS (SELECT r.* FROM r, m WHERE support >= least AND confidence >= 0.8e0),
b AS (
  SELECT v.id, arg_min(g.label, {'a': -confidence, 'b': -support, 'c': len(a), 'd': a}) AS label
  FROM v JOIN g ON list_has_all(v.tokens, g.a) WHERE v.said IS NULL GROUP BY v.id)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.said, b.label, 'allow') AS verdict FROM v LEFT JOIN b ON b.id = v.id
""",
    "op7_vector_near_duplicates": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93e0),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.v WHERE r.c < e.b),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT x.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, m.c AS component_id, x.vec_id = m.c AS kept
FROM embeddings x LEFT JOIN n ON n.a = x.vec_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) m ON m.v = x.vec_id
""",
}
