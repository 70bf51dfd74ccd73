"""Chat formatting, URL filters and vectors: brute force and edges; all llm queries against their SQL."""

from __future__ import annotations

import hashlib
import itertools
import random
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.llm import projcount, queries, reply_trees, urlrules

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import assert_same  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, duck, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), duck.sql(queries.ORACLE_SQL[name]))


# ---- 1: chat formatting ----

PARTS = ["<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "\\", "<", "[", "s>", "/s>", "ROLE]", "a", "\n", " ", "é", "😀", "<\\s>", "[\\\\INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=6).map("".join), st.lists(st.sampled_from(PARTS), max_size=12).map("".join)), max_size=5))
def test_template_is_reversible(turns):
    turns = [("assistant" if k % 2 else role, text) for k, (role, text) in enumerate(turns)]
    formatted, spans = reply_trees.format_turns(turns)
    assert reply_trees.parse_turns(formatted) == turns
    assert [reply_trees.restore(formatted[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]
    for _, text in turns:
        escaped = reply_trees.escape(text)
        assert reply_trees.restore(escaped) == text and not any(c in escaped for c in PARTS[:6])


TREE = "tree_id long, node_id long, parent_id long, score double, role string, text string"


def brute_paths(rows, top):
    trees = defaultdict(dict)
    for t, n, p, s, *_ in rows:
        if n is not None:
            trees[t][n] = (p if p != n else None, s or 0.0)
    out = set()
    for t, nodes in trees.items():
        parents = {p for p, _ in nodes.values()}
        leaves = []
        for n in nodes:
            path, at = [], n
            while at is not None and at in nodes and at not in path:
                path.append(at)
                at = nodes[at][0]
            if (at is None or at not in nodes) and n not in parents:
                leaves.append((-sum(nodes[x][1] for x in path), n, path[::-1]))
        for rank, (_, _, path) in enumerate(sorted(leaves)[:top], 1):
            out |= {(t, rank, k, n) for k, n in enumerate(path)}
    return out


def tree_rows():
    r = random.Random(1)
    rows = []
    for t in range(12):
        for n in range(1, r.randint(2, 40)):
            rows.append((t, n, None if n == 1 or r.random() < 0.05 else r.randint(1, n - 1), float(r.randint(0, 3)), r.choice(["user", "assistant", None]), r.choice(["x", None, "</s>", "y" * 50])))
    rows += [(50, k, k - 1 if k else None, None, "user", str(k)) for k in range(70)]  # deep
    rows += [(51, 1, 2, 1.0, "user", "in a cycle"), (51, 2, 1, 1.0, "user", "in a cycle"), (51, 3, 2, 1.0, "user", "under it"), (51, 9, 77, 1.0, "user", "orphan"), (51, 10, 10, 0.0, "user", "its own parent")]
    rows += [(52, 1, 2, 1.0, "user", "only a cycle"), (52, 2, 1, 1.0, "user", "only a cycle"), (None, 1, None, 1.0, "user", "no tree"), (None, 2, 1, 1.0, "user", "no tree either"), (53, None, None, 1.0, "user", "no node")]
    return rows


@pytest.mark.parametrize("top", [1, 3])
def test_paths(spark, top):
    df = spark.createDataFrame(tree_rows(), TREE).withColumns({"jump": F.lit(1), "depth": F.lit("x"), "t": F.lit(0)})
    got = {(x.tree_id, x.path_rank, x.position, x.node_id) for x in reply_trees.best_paths(df, top=top).collect()}
    assert got == brute_paths(tree_rows(), top)
    made = {(x.tree_id, x.path_rank): x for x in reply_trees.conversations(df, top=top).collect()}
    text = {(t, n): (role or "", body or "") for t, n, _, _, role, body in tree_rows()}
    for key in {(t, k) for t, k, _, _ in got}:
        path = [n for t, k, p, n in sorted(got, key=lambda x: x[2]) if (t, k) == key]
        assert reply_trees.parse_turns(made[key].formatted) == [text[key[0], n] for n in path]


def test_chains_and_read_back(spark):
    rows = [(None, 0, "user", "u"), (None, 1, "assistant", "v"), (1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, ""), (3, 5, "assistant", "<s>[ROLE]user[/ROLE]x</s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in reply_trees.read_back(reply_trees.conversations(reply_trees.chains(df))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha("user\n\nassistant\nb\nassistant\nb\n") and (got[1].loss_chars, got[1].loss_sha256) == (2, sha("bb"))
    assert got[None].turns_sha256 == sha("user\nu\nassistant\nv\n") and got[None].loss_sha256 == sha("v")
    assert got[2].turns_sha256 == sha("\n\n") and got[2].loss_chars == 0 and got[2].loss_sha256 == sha("")
    assert got[3].loss_sha256 == sha("<s>[ROLE]user[/ROLE]x</s>")
    none = df.limit(0)
    assert reply_trees.read_back(reply_trees.conversations(reply_trees.chains(none))).count() == 0


# ---- 6: URL filters ----

URLS = [
    "http://a.net/x", "https://a.net", "http://NET/", "http://b.example.net/en/1?x=/y", "http://example.net/en", "http://c.example.com/de/5#f", "http://example.org/fr/", "ftp://u@x.org:80/fr/z",
    "no scheme", "", None, "http://", "http:///path", "x://h?q=a/b", "x://h#f", "http://internet/", "http://xexample.net/en/", "http://É.ORG/fr/a", "http://h\nost.net/p\nq", "a://b://c.net/", "http://.net/", "http://a..org/fr/",
]


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k])
    rest = rest[k:]
    return host, rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]


def brute_rule(host, path):
    fits = [(len(r.pattern), r.pattern, r.verdict) for r in urlrules.DEFAULT_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits)[1:] if fits else (None, None)


def brute_tokens(host, path):
    return sorted({"h:" + x for x in host.split(".") if x} | {"p:" + x for x in path.split("/") if x and not any(c in "0123456789" for c in x)})


def brute_verdicts(urls, min_support=0.01, min_confidence=0.8):
    split = [brute_split(u) for u in urls]
    rules = [brute_rule(*s) for s in split]
    tokens = [brute_tokens(*s) for s in split]
    known = [(t, v) for t, (_, v) in zip(tokens, rules) if v and t]
    least = int(np.ceil(min_support * len(known)))
    both, alone = Counter(), Counter()
    for t, v in known:
        for k in (1, 2, 3):
            for a in itertools.combinations(t, k):
                alone[a] += 1
                both[a, v] += 1
    mined = [(-n / alone[a], -n, len(a), a, v) for (a, v), n in both.items() if n >= least and n / alone[a] >= min_confidence]
    out = []
    for s, (p, v), t in zip(split, rules, tokens):
        hits = [m for m in mined if set(m[3]) <= set(t)]
        out.append((*s, p, v or (min(hits)[4] if hits else "allow")))
    return out


def test_urls(spark):
    r = random.Random(3)
    urls = URLS + [f"http://{r.choice(['www', 'm', 'ads'])}.{r.choice(['example', 'other'])}.{r.choice(['net', 'org', 'com'])}/{r.choice(['en', 'fr', 'de', 'x'])}/{r.randint(0, 99)}" for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"rule": F.lit("?"), "verdict": F.lit("?"), "tokens": F.lit("?"), "label": F.lit("?"), "host": F.lit("?")})
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in urlrules.judge(df).collect()}
    for k, want in enumerate(brute_verdicts(urls)):
        assert got[k] == want, urls[k]
    assert urlrules.judge(df.limit(0)).count() == 0
    few = spark.createDataFrame([(1, None), (1, None), (None, "http://a.com/x")], "page_id long, url string")
    assert sorted(map(str, (tuple(x) for x in urlrules.judge(few).collect()))) == sorted(map(str, [(1, "", "", None, "allow")] * 2 + [(None, "a.com", "/x", None, "allow")]))


def test_url_plan_is_native(spark, sf_dir):
    plan = queries.op6_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ---- 7: vectors ----

def vector_rows():
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        if k % 4 == 0 or not rows:
            v = rng.standard_normal(16)
        else:
            v = np.array(rows[rng.integers(0, len(rows))][1], float) + rng.standard_normal(16) * rng.choice([0.0, 0.05, 0.25, 0.3, 0.4])
        rows.append((k, [float(x) for x in v.astype(np.float32)], [None, 0, 0, 0, 1, 2][k % 6]))
    rows += [(300, None, 0), (301, [], 0), (302, [0.0] * 16, 0), (303, [float("nan")] * 16, 0), (304, [None] * 16, 0), (305, [1.0] * 3, 0), (306, [2.0] * 3, 0), (307, [3e38] * 16, 1), (308, [1e-38] * 16, 1), (309, [float("inf")] + [1.0] * 15, 1)]
    rows += [rows[5], rows[5], (None, rows[5][1], rows[5][2])]
    return rows


def brute_links(rows, cosine):
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float64) / np.abs(v).max() if good(v) else None for _, v, _ in rows]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, up = [0] * len(rows), {i: i for i, _, _ in rows if i is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        (i, _, p), (j, _, q) = rows[a], rows[b]
        if i is not None and j is not None and p is not None and p == q and unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
            n[a] += 1
            n[b] += 1
            x, y = root(i), root(j)
            up[max(x, y)] = min(x, y)
    return [(i, k, root(i) if i is not None else None) for (i, _, _), k in zip(rows, n)]


@pytest.mark.parametrize("block,part_miss", [(8192, 1e-4), (25, 1e-6)])
def test_vectors(spark, block, part_miss):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"rep": F.lit(1), "place": F.lit("x"), "name": F.lit("x"), "v": F.lit(2), "n": F.lit(3), "weight": F.lit(0), "component": F.lit(0)})
    got = projcount.links(df, cosine=0.93, block=block, part_miss=part_miss).collect()
    assert sorted(map(str, [(r.vec_id, r.n_links, r.component_id) for r in got])) == sorted(map(str, brute_links(rows, 0.93)))
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_a_cell_of_like_vectors_is_cut_into_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in (np.ones(8) + rng.standard_normal(8) * 0.2).astype(np.float32)], 1) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = projcount.links(df, cosine=0.93, block=10, part_miss=1e-6).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(brute_links(rows, 0.93))


def test_partitions_hold_what_they_promise():
    rng = np.random.default_rng(1)
    assert projcount.partitions(8192, 0.93, 8192, 1e-4) == (0, 1)
    bits, trees = projcount.partitions(100_000, 0.93, 8192, 1e-2)
    a = rng.standard_normal((4000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    c = rng.standard_normal((4000, 32))
    c -= (a * c).sum(1)[:, None] * a
    c /= np.linalg.norm(c, axis=1)[:, None]
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * c
    d = rng.standard_normal((32, trees * bits))
    same = ((a @ d > 0) == (b @ d > 0)).reshape(4000, trees, bits).all(axis=2).any(axis=1)
    assert (~same).mean() < 0.02


def test_no_vectors(spark):
    assert projcount.links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    only = spark.createDataFrame([(1, None, 0), (2, [1.0, 0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in projcount.links(only).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_calibration_holds():
    half, least = projcount.calibrate(0.93, 48, 0.8, 1e-6)
    rng = np.random.default_rng(0)
    apart = np.sqrt(2 - 2 * 0.93)
    hits = (np.abs(rng.standard_normal((20_000, 48)) * apart) <= half).sum(axis=1)
    assert abs(hits.mean() / 48 - 0.8) < 0.01 and (hits < least).mean() < 1e-3
