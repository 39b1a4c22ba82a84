"""Quality classifier: a document's own evidence, combined with what its site is like.

Evidence is the log-odds of a logistic model over text statistics, less the
model's base rate. Sites form two levels: the host (``source`` up to the first
``/``) and the path below it (the rest of ``source``, and the language section,
as in ``host/en/``). Hierarchical empirical Bayes gives each a share of good
documents: grouped sums over all documents, a host's share shrunk towards the
global one and a path's towards its host's, the more the fewer documents it
has; the strength of either prior comes from how much the groups really differ
(method of moments). A document's posterior log-odds are its evidence plus
those of its path's share, counted without the document itself.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import columns_beside, sized_broadcast, written

LABELLED_ROWS = 20_000   # labelled documents the model is fitted on at most, taken by hash of doc_id
THRESHOLD = 0.5
_SYMBOLS = "!\"#$%&'()*+-/:;<=>?@[\\]^_`{|}~"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LIMITS = (1.0, 100_000.0)   # of a prior's strength, in documents


def statistics(text: Column) -> Column:
    """Text statistics as an array: words, distinct words, symbols, capitals, digits, word and line lengths."""
    def of(t: Column) -> Column:
        n = F.greatest(F.length(t), F.lit(1)).cast("double")
        words, lines = F.split(F.translate(t, "\n\t\r", "   "), " "), F.split(t, "\n")
        count, rows = F.size(words).cast("double"), F.size(lines).cast("double")
        share = lambda chars: (n - F.length(F.translate(t, chars, ""))) / n
        return F.array(F.log1p(count), F.size(F.array_distinct(words)) / count, share(_SYMBOLS), share(_UPPER),
                       share("0123456789"), F.least(n / count, F.lit(100.0)), F.size(F.array_distinct(lines)) / rows,
                       F.log1p(n / rows))
    return of(F.coalesce(text, F.lit("")))


def fit(sample: list[tuple[list[float], int]]) -> list[float]:
    """Logistic weights (bias first) by Newton's method with a small ridge, statistics standardised and
    the scale folded back in. One class only, or no rows: all zero."""
    if len({q for _, q in sample}) < 2:
        return [0.0] * 9
    x, y = np.array([s for s, _ in sample]), np.array([q for _, q in sample], float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z, w = np.c_[np.ones(len(x)), (x - mean) / scale], np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
    slope = w[1:] / scale
    base = math.log(y.mean() / (1 - y.mean()))   # evidence is what the text adds to the base rate
    return [float(w[0] - (slope * mean).sum() - base), *map(float, slope)]


def evidence(weights: list[float], stats: Column) -> Column:
    e = F.lit(weights[0])
    for i, w in enumerate(weights[1:]):
        e = e + stats[i] * F.lit(w)
    return F.least(F.greatest(e, F.lit(-30.0)), F.lit(30.0))


def _site(docs: DataFrame) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit(""))
    return [F.substring_index(source, "/", 1).alias("host"),
            F.concat_ws("/", source, F.coalesce(F.col("lang"), F.lit(""))).alias("path")]


def _strength(n: Column, share: Column, mean: Column) -> Column:
    """Strength of a beta prior by moments: how far group shares lie apart beyond chance."""
    chance = F.sum(mean * (1 - mean))
    apart = F.sum(n * (share - mean) ** 2)
    between = F.greatest((apart - chance) / F.greatest(F.sum(n) - F.sum(n * n) / F.sum(n), F.lit(1e-9)), F.lit(1e-9))
    within = F.sum(n * mean * (1 - mean)) / F.sum(n)
    return F.least(F.greatest(within / between - 1, F.lit(_LIMITS[0])), F.lit(_LIMITS[1]))


def _chance(e: Column, base: float) -> Column:
    """A document's own probability of being good, at the base rate."""
    return 1 / (1 + F.exp(-(e + math.log(base / (1 - base)))))


def site_counts(scored: DataFrame, base: float) -> DataFrame:
    """``(host, path, e)`` of all documents -> per path ``mean, hk, hs, hn, pk, s, n``: the global share, the
    strengths of the host's and the path's prior, and either's sum of probabilities and number of documents.

    Only grouped sums are shuffled, and two rows (the strengths) reach the driver.
    """
    paths = written(scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(_chance(F.col("e"), base)).alias("s")),
                    "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hs") / F.sum("hn")).first()[0]
    mean = min(max(total if total is not None else base, 1e-6), 1 - 1e-6)
    hk = hosts.agg(_strength(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(mean))).first()[0] or _LIMITS[1]
    both = paths.join(hosts, "host").withColumns({"mean": F.lit(mean), "hk": F.lit(hk)})
    host = (F.col("hk") * F.col("mean") + F.col("hs")) / (F.col("hk") + F.col("hn"))
    pk = both.agg(_strength(F.col("n"), F.col("s") / F.col("n"), host)).first()[0] or _LIMITS[1]
    return both.select("path", "mean", "hk", "hs", "hn", F.lit(pk).alias("pk"), "s", "n")


def site_share(own: Column | None = None) -> Column:
    """Posterior share of good documents of a path, from :func:`site_counts`; without the document whose
    probability is ``own``, so that its evidence does not count twice."""
    p, one = (F.lit(0.0), F.lit(0.0)) if own is None else (own, F.lit(1.0))
    host = (F.col("hk") * F.col("mean") + F.col("hs") - p) / (F.col("hk") + F.col("hn") - one)
    return (F.col("pk") * host + F.col("s") - p) / (F.col("pk") + F.col("n") - one)


def classify(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS) -> DataFrame:
    """Documents with ``p_good`` added (0 to 1; in place of a column of that name): every other column and
    row of ``docs`` stays.

    The model is fitted on at most ``labelled_rows`` documents with a quality label (those
    with the smallest hash of doc_id); everything else covers all documents. Null or blank
    text: 0. Null source or lang: the site without a name. Labels that are null, neither 0
    nor 1 or of one class only teach nothing (then the site's share, from the base rate 0.5,
    decides); a doc_id labelled twice counts with its lower label. Empty table: no rows.
    """
    stats = statistics(F.col("text"))
    sites = written(docs.select("doc_id", *_site(docs), stats.alias("x"), F.trim(F.col("text")).alias("t"))
                    .select("doc_id", "host", "path", "x", (F.coalesce(F.length("t"), F.lit(0)) > 0).alias("some")), "quality-stats")
    chosen = (labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows))
    sample = [(list(r.x), int(r.quality)) for r in
              sites.where("some").join(chosen, "doc_id").dropDuplicates(["doc_id"]).select("x", "quality").collect()]
    weights = fit(sample)
    good = np.mean([q for _, q in sample]) if any(weights) else 0.5
    shares = written(site_counts(sites.where("some").select("host", "path", evidence(weights, F.col("x")).alias("e")),
                                 float(good)), "quality-shares")

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _site(docs)[1],
                       evidence(weights, stats).alias("e"), (F.coalesce(F.length(F.trim("text")), F.lit(0)) > 0).alias("some"))
    joined = rows.join(sized_broadcast(shares, shares.count()), "path", "left")
    share = F.coalesce(site_share(_chance(F.col("e"), float(good))), F.lit(float(good)))
    share = F.least(F.greatest(share, F.lit(1e-6)), F.lit(1 - 1e-6))
    p = F.when(F.col("some"), 1 / (1 + F.exp(-(F.col("e") + F.log(share / (1 - share)))))).otherwise(0.0)
    return joined.select(*[F.col(f"row.`{c}`").alias(c) for c in columns_beside(docs, "p_good")], p.alias("p_good"))
