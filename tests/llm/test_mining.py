"""Hard negatives, embedding near-duplicates and collocations against brute force, and odd tables."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("marketlens.llm")
pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from marketlens.llm import blockjoin, negatives, phrases  # noqa: E402

VECTOR = "vec_id long, embedding array<float>, label int"


def vectors(seed=3, n=900, d=24):
    """Clusters, a large group of copies, near copies and ties; then odd rows."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[100:220] = x[100] + rng.normal(size=(120, d)) * 0.12      # a dense group, not a clique
    x[300:560] = x[300]                                         # a third are copies
    x[600:640] = np.round(x[600:640])                           # ties
    x[640:660] = -x[640:660] * 3
    x = x.astype(np.float32)
    label = rng.integers(0, 4, n)
    label[100:220] = 1
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(n)]
    odd = [(1000, None, 1), (1100, [0.0] * d, 1), (1200, [float("nan")] * d, 1), (1300, [None] * d, 1), (1400, x[1].tolist(), None),
           (None, x[1].tolist(), 1), (1500, [], 1), (1600, [float("inf")] * d, 1), (1700, x[100, :5].tolist(), 1),
           (1800, (x[100, :5] * 2).tolist(), 1), (300, x[300].tolist(), int(label[300]))]
    return rows + odd


def usable(v):
    return bool(v) and all(c is not None and np.isfinite(c) for c in v)


# --------------------------------------------------------------------------- 11
def expected_negatives(rows, every, scale=256, positives=5, negatives_=10, low=30, high=90):
    ok = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v):
            ok[i] = (np.floor(np.array(v, np.float64) * scale).astype(object), label)
    out = set()
    for a in (i for i in ok if i % every == 0):
        va, la = ok[a]
        s = {i: int((va * v).sum()) for i, (v, _) in ok.items() if i != a and len(v) == len(va)}
        order = sorted(s, key=lambda i: (-s[i], i))
        for p in [i for i in order if ok[i][1] == la][:positives]:
            hard = [i for i in order if ok[i][1] != la and low * s[p] <= 100 * s[i] <= high * s[p]][:negatives_]
            out |= {(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(hard)}
    return out


@pytest.mark.parametrize("leaf,fan,anchors", [(16, 4, 8), (512, 16, 256)])
def test_negatives_equal_brute_force(spark, leaf, fan, anchors):
    rows = vectors()
    df = spark.createDataFrame(rows, VECTOR).repartition(3).withColumn("g", F.lit("clash")).withColumn("NODE", F.lit(1))
    got = [tuple(r) for r in negatives.mine(df, every=25, leaf=leaf, fan=fan, block=anchors).collect()]
    want = expected_negatives(rows, 25)
    assert len(got) == len(set(got)) and set(got) == want
    assert len(want) > 300


def test_negatives_prune_subtrees_without_losing_rows(spark):
    rng = np.random.default_rng(1)
    centre = np.repeat(rng.normal(size=(20, 8)) * 3, 40, axis=0)
    x = (centre + rng.normal(size=centre.shape) * 0.05).astype(np.float32)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    groups = spark.createDataFrame([(i, i % 2, i % 40 == 0, np.floor(v.astype(float) * 256).astype(int).tolist()) for i, v in enumerate(x)],
                                   "g long, label long, asked boolean, v array<long>")
    search = negatives.Search(groups, fan=8, leaf=16, block=1)
    windows = groups.where("asked").select(F.col("g").alias("a"), F.lit(0).cast("long").alias("w"),
                                           F.expr("aggregate(v, 0L, (s, c) -> s + c * c)").alias("lo"),
                                           F.lit(negatives.MOST).cast("long").alias("hi"))
    windows = windows.withColumn("lo", (F.col("lo") * 0.99).cast("long"))
    ready = search._ready(windows)
    met = search._met(search._descend(ready), ready, search.leaves.select("node", "d", "n")).agg(F.sum("n")).first()[0]
    assert met < 0.5 * 20 * 800      # of all pairs of anchors and vectors
    df = spark.createDataFrame(rows, VECTOR)
    assert {tuple(r) for r in negatives.mine(df, every=40, fan=8, leaf=16, block=1).collect()} == expected_negatives(rows, 40)


def test_negatives_of_large_numbers_ties_and_nothing(spark):
    rows = [(i, [float(2 ** 20 * (i % 3)), 1.0], i % 2) for i in range(60)] + [(100 + i, [0.0, 0.0], i % 2) for i in range(4)]
    df = spark.createDataFrame(rows, VECTOR)
    assert {tuple(r) for r in negatives.mine(df, every=10).collect()} == expected_negatives(rows, 10)
    assert negatives.mine(df.limit(0)).count() == 0
    assert negatives.mine(df.where("label is null")).count() == 0


# --------------------------------------------------------------------------- 12
def expected_links(rows, least):
    first = {}
    for i, v, label in rows:
        if i is not None and label is not None and usable(v) and any(v):
            first[i] = (np.array(v, float), label)
    ids = sorted({i for i, _, _ in rows if i is not None})
    links, root = Counter(), {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and a in first and b in first and first[a][1] == first[b][1] and len(first[a][0]) == len(first[b][0]):
                u, v = first[a][0], first[b][0]
                if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                    links[a] += 1
                    links[b] += 1
                    ra, rb = find(a), find(b)
                    root[max(ra, rb)] = min(ra, rb)
    return {(i, links[i], find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("tile,cell,fan", [(8, 4, 1), (2048, 256, 6)])
def test_near_duplicate_vectors_equal_brute_force(spark, tile, cell, fan):
    rows = vectors(n=700)
    df = spark.createDataFrame(rows, VECTOR).repartition(3).withColumn("KEY", F.lit("clash")).withColumn("root", F.lit(1))
    got = [tuple(r) for r in blockjoin.near_duplicates(df, least=0.93, shape=blockjoin.Shape(8, tile, cell, fan)).collect()]
    named = [r for r in got if r[0] is not None]
    assert len(named) == len(set(named)) and set(named) == expected_links(rows, 0.93)
    assert [r[1:] for r in got if r[0] is None] == [(0, None, None)]
    assert sum(r[1] for r in named) > 10_000     # the copies count each other


def test_near_duplicate_vectors_of_an_empty_table(spark):
    df = spark.createDataFrame(vectors(n=700), VECTOR)
    assert blockjoin.near_duplicates(df.limit(0)).count() == 0
    assert {tuple(r) for r in blockjoin.near_duplicates(df.where("embedding is null")).collect()} == {(1000, 0, 1000, True)}


def test_blocks_hold_every_pair_within_the_limit():
    rng = np.random.default_rng(2)
    for d in (3, 16, 40, 100):
        u = blockjoin._unit(rng.normal(size=(300, d)))
        v = blockjoin._unit(u + rng.normal(size=u.shape) * 0.3 / np.sqrt(d))
        near = (u * v).sum(1) >= 0.93
        gap = (blockjoin.rotate(u, 0) - blockjoin.rotate(v, 0)) ** 2
        ok = np.array([gap[:, b].sum(1) <= s for b, s in zip(blockjoin._blocks(d, 16), blockjoin._budgets(d, 16, 0.14))]).any(0)
        assert near.sum() > 50 and ok[near].all()


# --------------------------------------------------------------------------- 13
TEXT = "text string, lang string"


def expected_phrases(rows, least, longest=4, top=2000, scale=2_000_000, pct=80):
    out = set()
    for lang in {r[1] or "und" for r in rows}:
        f, m = Counter(), {}
        for text, of in rows:
            if (of or "und") == lang:
                text = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
                for piece in re.split("[.,;:!?\x0a-\x0d]", text):
                    w = re.findall("[^\x20\x09]+", piece)
                    for k in range(1, longest + 1):
                        for i in range(len(w) - k + 1):
                            f[" ".join(w[i:i + k])] += 1
                            m[" ".join(w[i:i + k])] = tuple(w[i:i + k])
        n = sum(c for p, c in f.items() if len(m[p]) == 1)
        cand = {p: c for p, c in f.items() if len(m[p]) > 1 and c >= least}
        scored = []
        for p, a in cand.items():
            w = m[p]
            if any(len(m[q]) > len(w) and 100 * b >= pct * a and f" {p} " in f" {q} " for q, b in cand.items()):
                continue
            s, _, l, r = min((scale * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k, f[" ".join(w[:k])], f[" ".join(w[k:])])
                             for k in range(1, len(w)))
            scored.append((-s, -a, p.encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n, -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])}
    return out


def texts():
    rng = np.random.default_rng(4)
    words = ["the", "of", "new", "york", "city", "é", "Über", "a\x00b", "x y", "san"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(240):
        w = rng.choice(words, rng.integers(0, 60)).tolist()
        text = "".join(c + str(rng.choice([" ", "  ", "\t", " ", " ", ". ", ",", "\n", "\x0b"])) for c in w)
        rows.append((text + " New York City hall" * int(rng.integers(0, 3)) + " a a a a a", str(rng.choice(["en", "de"]))))
    rows += [(None, "en"), ("", "en"), ("...", None), ("the of " * 400, None), ("New York\fCity", "xx"), ("las vegas " * 40_000, "en")]
    return rows + [rows[0]] * 5


@pytest.mark.parametrize("chunk,partitions", [(64, "7"), (8 << 20, "2")])
def test_collocations_equal_brute_force(spark, chunk, partitions):
    rows = texts()
    df = spark.createDataFrame(rows, TEXT).repartition(4).withColumn("NEXT", F.lit(1)).withColumn("prefix", F.lit(None).cast("string"))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in phrases.collocations(df, least=5, top=150, chunk=chunk).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = expected_phrases(rows, 5, top=150)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, "en"), ("one", None)], TEXT)
    assert phrases.collocations(df, least=1).count() == 0
    assert phrases.collocations(df.limit(0)).count() == 0


def test_collocation_scores_pass_64_bits(spark):
    row = spark.sql("SELECT 9000000000000 AS a, 9000000000001 AS l, 9000000000000 AS r")
    score = row.select(F.expr("(CAST(a AS DECIMAL(24,0)) * 2000000BD) div (CAST(l AS DECIMAL(24,0)) + CAST(r AS DECIMAL(24,0)))")).first()[0]
    assert score == 2_000_000 * 9_000_000_000_000 // 18_000_000_000_001
