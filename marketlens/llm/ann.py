"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector by three rounds of random signs and a fast
Hadamard transform, twice over, and notes the nearest signed axis of either
rotation: a cell and a sub-cell. A query probes, over all tables, the
(cell, sub-cell) pairs whose two axes it is nearest to in sum: ``probes`` of
them, or a tenth of all pairs where that is more.
Vectors are indexed under their cells; a cell too large for one task is dealt
out in parts. Cells and probes meet in a shuffle, and each task reranks the
members of probed sub-cells by exact cosine on the original vectors, sending on
the ``k + 1`` best per query and part.

Equal vectors are searched for once: a group of copies is indexed as one vector
that carries its ``k + 1`` smallest ids, which are all that can be returned, and
copies among the queries share one search. Queries that found fewer than ``k``
candidates are answered again with every pair probed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import written
from marketlens.llm.vectors import usable

SEED = 5
SHARE = 0.1     # of all pairs of cells that are probed at least
PART = 8192     # members of a cell that one task reranks at a time


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """Pseudo-random rotation ``number`` of the rows (padded with zeros to a power of two)."""
    n = 1 << max(x.shape[1] - 1, 0).bit_length()
    y = np.zeros((len(x), n))
    y[:, :x.shape[1]] = x
    signs = np.random.Generator(np.random.PCG64([SEED, number, n])).choice([-1.0, 1.0], (3, n))
    for s in signs:
        y *= s
        h = 1
        while h < n:
            y = y.reshape(len(x), -1, 2, h)
            y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
            h *= 2
        y /= np.sqrt(n)
    return y


def _axes(y: np.ndarray) -> np.ndarray:
    """Closeness to every signed axis."""
    return np.concatenate([y, -y], axis=1)


def _matrices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of a batch, by length of the vectors."""
    v = batch.column(column)
    lengths = np.diff(v.offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)    # very large and very small vectors do not overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _index(tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 1):
                u, d = _unit(x), x.shape[1]
                rows = batch.take(pa.array(at))
                for t in range(tables):
                    a, b = (_axes(rotate(u, 2 * t + i)).argmax(1) for i in range(2))
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(at), pa.int32()), pa.array([t] * len(at), pa.int32()),
                                                      pa.array(a, pa.int32()), pa.array(b, pa.int32()),
                                                      rows.column(0), rows.column(1)], names=["d", "t", "cell", "sub", "g", "v"])
    return run


def _probe(tables: int, probes: int):
    """Per query and (table, cell) with a probed sub-cell: the nearness to the cell's axis and the
    smallest sum that is probed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, 1):
                u, d = _unit(x), x.shape[1]
                near = [_axes(rotate(u, i)) for i in range(2 * tables)]
                rows = batch.take(pa.array(at))
                width = near[0].shape[1]
                for k in range(len(at)):
                    sums = np.concatenate([np.add.outer(near[2 * t][k], near[2 * t + 1][k]).ravel() for t in range(tables)])
                    most = len(sums) if probes is None else min(max(probes, int(SHARE * len(sums))), len(sums))
                    cut = float(np.partition(sums, len(sums) - most)[len(sums) - most])
                    t, cell = np.nonzero((sums.reshape(tables, width, width) >= cut).any(axis=2))
                    n = len(t)
                    one = rows.slice(k, 1).take(pa.array(np.zeros(n, np.int64)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([d] * n, pa.int32()), pa.array(t, pa.int32()), pa.array(cell, pa.int32()), one.column(0),
                        pa.array([near[2 * a][k][c] for a, c in zip(t, cell)], pa.float64()),
                        pa.array([cut] * n, pa.float64()), one.column(1)], names=["d", "t", "cell", "q", "near", "cut", "qv"])
    return run


def _rerank(k: int):
    """Queries and members of one part of a cell -> the best members of the probed sub-cells."""

    def run(key, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(members):
            t = int(key[1])
            x = np.stack(members["v"].to_numpy())
            unit, sub, ids = _unit(x), members["sub"].to_numpy(), members["g"].to_numpy()
            for i in range(0, len(queries), 256):
                q = queries.iloc[i:i + 256]
                u = _unit(np.stack(q["qv"].to_numpy()))
                b = _axes(rotate(u, 2 * t + 1))
                probed = q["near"].to_numpy()[:, None] + b[:, sub] >= q["cut"].to_numpy()[:, None] - 1e-12
                score = np.where(probed, u @ unit.T, -np.inf)
                score[ids[None, :] == q["q"].to_numpy()[:, None]] = 1.0    # itself: no rounding
                n = min(k, score.shape[1])
                best = np.argpartition(-score, n - 1, axis=1)[:, :n]
                edge = np.take_along_axis(score, best, 1).min(axis=1)
                for r, name in enumerate(q["q"].tolist()):
                    at = best[r] if np.isneginf(edge[r]) else np.flatnonzero(score[r] >= edge[r])   # all ties
                    at = at[~np.isneginf(score[r, at])]
                    at = at[np.lexsort((ids[at], -score[r, at]))][:k]
                    out += zip([name] * len(at), ids[at].tolist(), score[r, at].tolist())
        return pd.DataFrame(out, columns=["q", "g", "score"])
    return run


def _search(groups: DataFrame, queries: DataFrame, k: int, tables: int, probes: int | None) -> DataFrame:
    """The ``k`` nearest groups of each query group: ``q, g, score``."""
    index = groups.select("g", "v").mapInArrow(_index(tables), "d int, t int, cell int, sub int, g long, v array<double>")
    probe = queries.select("g", "v").mapInArrow(
        _probe(tables, probes), "d int, t int, cell int, q long, near double, cut double, qv array<double>")
    sizes = index.groupBy("d", "t", "cell").agg(F.ceil(F.count("*") / PART).alias("parts"))
    key = ["d", "t", "cell"]
    index = index.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("g"), "parts"))
    probe = probe.join(sizes, key).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    found = (probe.select(*key, "part", "q", "near", "cut", "qv").groupBy(*key, "part")
             .cogroup(index.select(*key, "part", "sub", "g", "v").groupBy(*key, "part"))
             .applyInPandas(_rerank(k), "q long, g long, score double"))
    best = found.groupBy("q", "g").agg(F.max("score").alias("score"))
    w = Window.partitionBy("q").orderBy(F.desc("score"), "g")
    return best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("q", "g", "score")


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5, tables: int = 10, probes: int = 4000) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> the ``k`` nearest found of each query (rows whose vec_id is
    divisible by ``every``): ``query_id, rank, vec_id, score``, score the cosine on the original vectors.

    Null, empty, zero vectors and vectors with null or non-finite components take no part; vectors of
    another length are no candidates; a repeated vec_id counts once. Ties go to the smaller vec_id.
    """
    v = usable(embeddings, allow_zero=False)
    # groups of equal vectors: their smallest ids (limited before the shuffle), named by the smallest
    first = (v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
             .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    groups = written(first.select(F.col("ids")[0].alias("g"), "v", "ids"), "ann-groups")
    asked = written(v.where(F.col("vec_id") % every == 0).join(groups.select("g", "v"), "v").select("vec_id", "g"), "ann-asked")
    wanted = groups.join(asked.select("g").distinct(), "g", "left_semi").select("g", "v")
    # k other vectors and the query's own group are enough for k rows
    hits = written(_search(groups, wanted, k + 1, tables, probes), "ann-hits")
    rows = hits.join(groups.select("g", "ids"), "g").select("q", F.explode("ids").alias("vec_id"), "score")
    few = (wanted.join(rows.groupBy(F.col("q").alias("g")).agg(F.count("*").alias("n")), "g", "left")
           .where(F.coalesce("n", F.lit(0)) <= k).select("g", "v"))
    few = written(few, "ann-few")
    if few.limit(1).count():
        more = _search(groups, few, k + 1, tables, None)
        hits = written(hits.join(few.select(F.col("g").alias("q")), "q", "left_anti").unionByName(more), "ann-all")
        rows = hits.join(groups.select("g", "ids"), "g").select("q", F.explode("ids").alias("vec_id"), "score")
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    best = (rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
            .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("best")))
    own = F.filter("best", lambda b: b["vec_id"] != F.col("query_id"))
    return (asked.select(F.col("vec_id").alias("query_id"), F.col("g").alias("q")).join(best, "q")
            .select("query_id", F.posexplode(F.slice(own, 1, k)).alias("i", "b"))
            .select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "b.vec_id", "b.score"))
