"""URL filtering by hand-written rules and by association rules mined from what they say; DataFrame functions only.

URLs that a rule decides are labelled examples. FP-growth finds the token combinations that are frequent
among them, with and without their label; a combination predicts a label if it is frequent with it and
if the label holds for most URLs with the combination. Mined rules are matched through an inverted index: a rule is
posted under its rarest token only, and a URL that has that token is checked for the others. URLs are
matched by their distinct token sets, so a host with a third of all rows is matched a few times only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .durable import settle

_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` + ``path`` (from its first slash on): fits that host and its subdomains where the path begins so."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


DEFAULT_RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SPLIT, 2)


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct labels of the host and segments of the path; segments with a digit name single pages and are left out."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    steps = F.transform(F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("[0-9]")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_sort(F.array_distinct(F.concat(labels, steps)))


def _fitting(rules: tuple[Rule, ...], host: Column, path: Column) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest rule that fits, else null."""
    pattern, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, F.lit(r.pattern)).otherwise(pattern), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return pattern, verdict


def mine(labelled: DataFrame, *, min_support: float = 0.01, min_confidence: float = 0.8, max_tokens: int = 3) -> DataFrame:
    """labelled (tokens, label) -> antecedent, label, support (rows), confidence.

    Rules of at most ``max_tokens`` tokens whose combination with the label is in ``min_support`` of the rows
    or more. An empty table, or one without tokens, gives no rules.
    """
    items = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("y:"), "label"))).alias("items"))
    if not items.head(1):
        return labelled.sparkSession.createDataFrame([], "antecedent array<string>, label string, support long, confidence double")
    found = settle(FPGrowth(itemsCol="items", minSupport=min_support).fit(items).freqItemsets)
    is_label = lambda x: x.startswith("y:")
    parts = found.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("antecedent"), F.filter("items", is_label).alias("y"), "freq")
    parts = parts.where((F.size("antecedent") > 0) & (F.size("antecedent") <= max_tokens))
    alone = parts.where(F.size("y") == 0).select(F.col("antecedent").alias("a"), F.col("freq").alias("of"))
    with_label = parts.where(F.size("y") == 1).join(alone, F.col("antecedent") == F.col("a"))
    scored = with_label.select("antecedent", F.substring(F.element_at("y", 1), 3, 1 << 20).alias("label"), F.col("freq").alias("support"), (F.col("freq") / F.col("of")).alias("confidence"))
    return scored.where(F.col("confidence") >= min_confidence)


def match(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """token_sets (tokens) -> tokens, label of the best rule: by confidence, support, fewest tokens, then order. Sets without a rule are left out."""
    common = rules.select(F.explode("antecedent").alias("token"), "support").groupBy("token").agg(F.max("support").alias("seen"))
    posted = rules.select("*", F.explode("antecedent").alias("token")).join(common, "token")
    rarest = posted.groupBy("antecedent", "label", "support", "confidence").agg(F.min_by("token", F.struct("seen", "token")).alias("token"))
    hits = token_sets.select("tokens", F.explode("tokens").alias("token")).join(rarest, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.min(F.struct(-F.col("confidence"), -F.col("support"), F.size("antecedent"), "antecedent", "label")).alias("best")
    return hits.groupBy("tokens").agg(best).select("tokens", F.col("best.label").alias("label"))


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] = DEFAULT_RULES, default: str = "allow", **mining: object) -> DataFrame:
    """pages (page_id, url, ...) -> page_id, host, path, rule, verdict: one row for each row of pages.

    host: after the first ``://`` up to a slash, question mark, hash or the end, A-Z as a-z; path: from there
    up to a question mark, hash or the end. A null url, or one without ``://``, has both empty. verdict:
    that of the longest hand-written rule that fits, else of the best mined rule, else ``default``. Repeated
    rows are judged alike; other columns are ignored; an empty table gives an empty one.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    pattern, verdict = _fitting(rules, F.col("host"), F.col("path"))
    read = split.withColumns({"rule": pattern, "said": verdict, "tokens": tokens_of(F.col("host"), F.col("path"))})
    # URLs that agree in all that counts are one row with a weight, except for mining, which counts them all
    known = read.where("said is not null and size(tokens) > 0").select("tokens", F.col("said").alias("label"))
    mined = settle(mine(known, **mining))
    sets = read.where("said is null and size(tokens) > 0").select("tokens").distinct()
    told = match(sets, mined).withColumnsRenamed({"tokens": "t"})
    out = read.join(told, F.when(F.col("said").isNull(), F.col("tokens")) == F.col("t"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", "label", F.lit(default)).alias("verdict"))
