"""Quality by weak supervision.

Rules over counts of a whole text vote good or bad or abstain. Expectation-maximisation fits, from the
votes of all texts and no labels, how often each rule votes what on good and on bad texts, and the share of
good ones; a text stays if its posterior probability of being good is a half or more. The fit needs only
how many texts cast each combination of votes: at most 3 ** (number of rules) rows, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .durable import settle
from .sigjoin import shingle_hashes

COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_symbol_words", "n_echo_words", "n_distinct_words"]
GOOD, BAD, ABSTAIN = 1, 0, 2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_HEAD = np.zeros(256, dtype=bool)  # the first byte of a code point
_HEAD[[b for b in range(256) if b & 0xC0 != 0x80]] = True


def _again(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key was there before, key is there twice or more), by position."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, dtype=bool)
    same[1:-1] = k[1:] == k[:-1]
    before, twice = np.empty(len(k), dtype=bool), np.empty(len(k), dtype=bool)
    before[order], twice[order] = same[:-1], same[:-1] | same[1:]
    return before, twice


def count(w: tk.Words) -> list[np.ndarray]:
    """COUNTS of texts."""
    n_docs, n = len(w.off) - 1, len(w.data)
    inside = np.zeros(n + 1, dtype=np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    # a line ends at each \n and at the end of its text
    feed = np.flatnonzero(w.data == 10)
    stop = np.concatenate([feed, w.off[1:]])
    owner = np.concatenate([np.searchsorted(w.off, feed, side="right") - 1, np.arange(n_docs)])
    order = np.lexsort((stop, owner))
    stop, owner = stop[order], owner[order]
    begin = np.concatenate([[0], stop[:-1] + 1])
    head = np.concatenate([[True], owner[1:] != owner[:-1]])
    begin[head] = w.off[owner[head]]
    has_word = np.searchsorted(w.start, stop) > np.searchsorted(w.start, begin)
    salt = tk.mix(np.arange(n_docs, dtype=np.uint64) + np.uint64(7))
    lines, of = tk.stretches(w.data, w.prefix, begin[has_word], stop[has_word]), owner[has_word]
    dup, _ = _again(tk.mix(lines + salt[of]))
    h, first = shingle_hashes(w, 3)
    many = w.counts >= 3
    sizes = np.diff(first)
    use = np.repeat(many, sizes)
    doc = np.repeat(np.arange(n_docs), sizes)[use]
    start = (np.arange(len(h)) - np.repeat(first[:-1], sizes))[use] + w.first[:-1][doc]
    _, twice = _again(tk.mix(h[use] + salt[doc]))
    under = np.zeros(len(w.hash), dtype=bool)
    for k in range(3):
        under[start[twice] + k] = True
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data])])
    of_word = w.doc_of_word()
    echo = np.zeros(len(w.hash), dtype=bool)
    echo[1:] = (w.hash[1:] == w.hash[:-1]) & (of_word[1:] == of_word[:-1])
    before, _ = _again(tk.mix(w.hash + salt[of_word]))
    more = [tk.sums(symbols[w.end] > symbols[w.start], w.first), tk.sums(echo, w.first), tk.sums(~before, w.first)]
    return [w.counts, w.per_doc(inside & _HEAD[w.data]), w.per_doc(_SYMBOL[w.data]), np.bincount(of, minlength=n_docs), np.bincount(of[dup], minlength=n_docs), tk.sums(under, w.first), *more]


def profile(docs: DataFrame, carry: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id and COUNTS (long) of each row's whole text; a null text has none of anything.

    With ``carry`` the whole row comes along in the struct ``row``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, w in tk.each(b.column(1)):
                rest = [b.column(2)[i:j]] if carry else []
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], *(pa.array(c.astype(np.int64)) for c in count(w)), *rest], ["doc_id", *COUNTS, *["row"] * carry])

    given = docs.select("doc_id", "text", *[F.struct(*docs.columns).alias("row")] * carry)
    schema = T.StructType([given.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in COUNTS], *([given.schema["row"]] if carry else [])])
    return given.mapInArrow(run, schema)


def _rule(bad: str, good: str) -> Column:
    return F.when(F.expr(bad), F.lit(BAD)).when(F.expr(good), F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def rules() -> dict[str, Column]:
    """name -> vote. Each leaves a band between good and bad in which it abstains; each kind of bad text shows in two rules or more, else votes could not tell it from a rule's errors."""
    return {
        "length": _rule("n_words < 50", "n_words >= 80"),
        "word_length": _rule("word_chars < 3 * n_words or word_chars > 12 * n_words", "10 * word_chars between 38 * n_words and 80 * n_words"),
        "symbols": _rule("10 * n_symbols > n_words", "50 * n_symbols < n_words"),
        "symbol_words": _rule("20 * n_symbol_words > n_words", "100 * n_symbol_words < n_words"),
        "repeated_lines": _rule("n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines", "20 * n_dup_lines <= n_lines"),
        "repeated_words": _rule("100 * n_repeat_words > 25 * n_words", "100 * n_repeat_words < 15 * n_words"),
        "echoes": _rule("10 * n_echo_words > n_words", "25 * n_echo_words < n_words"),
        "variety": _rule("10 * n_distinct_words < n_words", "4 * n_distinct_words > n_words"),
    }


@dataclass
class Model:
    """Share of good texts, and for each rule P(vote | bad) and P(vote | good) over BAD, GOOD, ABSTAIN."""

    prior: float
    votes: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good for rows of votes."""
        p = np.log([1 - self.prior, self.prior])[None, :].repeat(len(patterns), 0)
        for r in range(patterns.shape[1]):
            p += np.log(self.votes[r][:, patterns[:, r]]).T
        p -= p.max(axis=1, keepdims=True)
        p = np.exp(p)
        return p[:, 1] / p.sum(axis=1)


#: What a rule is taken to do before any text is seen: P(vote | bad) and P(vote | good) over BAD, GOOD, ABSTAIN. A vote of
#: bad is a symptom and rare among good texts; a vote of good only says that this one symptom is missing.
PRIOR_VOTES = np.array([[0.35, 0.5, 0.15], [0.002, 0.948, 0.05]])
PRIOR_GOOD = 0.85
#: Weight of that belief, as a share of all texts (so that tables of every size are treated alike).
BELIEF = 0.02


def fit(patterns: np.ndarray, weight: np.ndarray, rounds: int = 300) -> Model:
    """Expectation-maximisation from the prior belief about rules, which also stays in the estimates with a small weight.

    Votes alone could not tell a rule for a kind of bad text that no other rule sees from a rule that errs:
    the belief settles that. A rule never comes out as worse than chance.
    """
    n_rules, total = patterns.shape[1], float(weight.sum())
    model = Model(PRIOR_GOOD, np.repeat(PRIOR_VOTES[None], n_rules, axis=0))
    q = model.posterior(patterns)
    for _ in range(rounds):
        share = np.stack([(1 - q) * weight, q * weight])
        belief = BELIEF * total * np.array([1 - PRIOR_GOOD, PRIOR_GOOD]) + 1e-9
        prior = float((share[1].sum() + belief[1]) / (share.sum() + belief.sum()))
        votes = np.empty((n_rules, 2, 3))
        for r in range(n_rules):
            for v in (BAD, GOOD, ABSTAIN):
                votes[r, :, v] = share[:, patterns[:, r] == v].sum(axis=1)
            votes[r] += belief[:, None] * PRIOR_VOTES
            votes[r] /= votes[r].sum(axis=1, keepdims=True)
            # a vote of bad must not speak for good, nor the other way round
            for v, up in ((BAD, 0), (GOOD, 1)):
                if votes[r, up, v] < votes[r, 1 - up, v]:
                    votes[r, :, v] = votes[r, :, v].mean()
        model = Model(min(max(prior, 1e-6), 1 - 1e-6), votes)
        new = model.posterior(patterns)
        if np.abs(new - q).max(initial=0) < 1e-9:
            break
        q = new
    return model


def _voted(profiled: DataFrame) -> tuple[DataFrame, list[str]]:
    named = rules()
    return profiled.select("*", *[v.cast("int").alias(f"v_{k}") for k, v in named.items()]), [f"v_{k}" for k in named]


def _posteriors(voted: DataFrame, cols: list[str]) -> Column:
    """P(good) of a row by its votes, fitted on all rows of ``voted``."""
    rows = sorted(voted.groupBy(*cols).count().collect())  # at most 3 ** len(cols), in an order of their own so that sums come out alike
    patterns = np.array([[r[c] for c in cols] for r in rows], dtype=np.int64).reshape(-1, len(cols))
    model = fit(patterns, np.array([r["count"] for r in rows], dtype=float))
    codes = (patterns * 3 ** np.arange(len(cols))).sum(axis=1)
    known = ", ".join(f"{int(c)}L, {float(p)!r}D" for c, p in zip(codes, model.posterior(patterns)))
    code = sum((F.col(c).cast("long") * 3**k for k, c in enumerate(cols)), F.lit(0).cast("long"))
    return F.element_at(F.expr(f"map({known})"), code) if known else F.lit(0.0)


_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, COUNTS, base_failed, p_good, kept for each row.

    base_failed: fewer than 50 words, or 100 * n_repeat_words > 50 * n_words. kept: not base_failed, and
    p_good >= threshold. A null, empty or blank text has counts of 0 and fails. Texts with equal counts get
    equal verdicts, so copies and repeated rows do. Columns of docs other than doc_id and text are ignored;
    a null doc_id stays. An empty table gives an empty one.
    """
    voted, cols = _voted(settle(profile(docs)))
    out = voted.withColumns({"base_failed": F.expr(_FAILED), "p_good": _posteriors(voted, cols)})
    return out.select("doc_id", *COUNTS, "base_failed", "p_good", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))


def keep(docs: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that :func:`judge` keeps, with their columns. Texts are counted twice and never shuffled."""
    voted, cols = _voted(profile(docs))
    p = _posteriors(voted, cols)
    return _voted(profile(docs, carry=True))[0].where(~F.expr(_FAILED) & (p >= threshold)).select("row.*")
