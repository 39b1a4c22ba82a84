"""Exact top-k by inner product: three-phase uniform threshold.

A vector's components are dealt to ``nodes``; a node's score is the inner
product over its components, and a candidate's score is the sum over the nodes.

1. Every node lists its ``k`` best candidates for each query; the exact scores
   of all listed ones give a safe cutoff, the k-th best of them.
2. If a candidate reaches the cutoff, at least one of its node scores reaches
   cutoff / nodes. That uniform threshold is sent back, and every node collects
   all entries that reach it.
3. Upper bounds (known node scores, the threshold for the others) drop what
   cannot reach the cutoff; the rest are scored exactly and ranked.

Queries are a stated set (ids divisible by ``every``) and meet all rows in
blocks: a task scores a block of queries against a block of one node's
sub-vectors, as one matrix product, and only list entries leave it.
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

ROWS, QUERIES = 8192, 512     # block sizes


def integers(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """Usable vectors with every component x as floor(scale * x): ``vec_id, v array<long>``."""
    return usable(embeddings, allow_zero=True).select(
        "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _product(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products: in doubles where no sum can pass 2^53, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if most < 2.0 ** 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def _blocks(size: int, nodes: int):
    """Rows -> per node, length and block of rows: ids and the node's sub-vectors as one matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(d: int) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([a for a, _ in held[d]])
            x = np.concatenate([b for _, b in held[d]])
            held[d] = []
            for i in range(0, len(ids), size):
                for node, part in enumerate(np.array_split(x[i:i + size], nodes, axis=1)):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([node], pa.int32()), pa.array([d], pa.int32()), pa.array([ids[i:i + size].tobytes()], pa.binary()),
                        pa.array([np.ascontiguousarray(part).tobytes()], pa.binary())], names=["node", "d", "ids", "x"])

        for batch in batches:
            v, ids = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.diff(v.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                held.setdefault(d, []).append((ids[at], x))
                if sum(len(a) for a, _ in held[d]) >= size:
                    yield from flush(d)
        for d in held:
            if held[d]:
                yield from flush(d)
    return run


_BLOCK_DDL = "node int, d int, ids binary, x binary"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(node, query ids, cutoffs or None, row ids, scores) of each pair of blocks; a query's own row is lowest."""
    for batch in batches:
        for row in batch.to_pylist():
            q, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
            s = _product(np.frombuffer(row["q_x"], np.int64).reshape(len(q), -1),
                         np.frombuffer(row["x"], np.int64).reshape(len(ids), -1))
            yield row, q, ids, s, q[:, None] == ids[None, :]


_ENTRY_DDL = "node int, query_id long, vec_id long, s long"


def _entries(node: int, q: np.ndarray, ids: np.ndarray, s: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    a, b = np.nonzero(hit)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), node), pa.int32()), pa.array(q[a]), pa.array(ids[b]),
                                       pa.array(s[a, b])], names=["node", "query_id", "vec_id", "s"])


def _local_lists(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q, ids, s, own in _tiles(batches):
            s = np.where(own, np.iinfo(np.int64).min, s)
            n = min(k + 1, s.shape[1])
            hit = np.zeros(s.shape, bool)
            np.put_along_axis(hit, np.argpartition(-s.astype(np.float64), n - 1, axis=1)[:, :n], True, axis=1)
            yield _entries(row["node"], q, ids, s, hit & ~own)
    return run


def _over_threshold(nodes: int):
    """Entries that reach their query's cutoff / nodes (rounded down to an integer)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, q, ids, s, own in _tiles(batches):
            cut = dict(zip(row["c_ids"], row["c"]))
            least = np.iinfo(np.int64).min
            t = np.array([cut.get(i, least) for i in q.tolist()], np.int64)
            need = np.where(t == least, least, -(-t // nodes))    # s >= t / nodes, for integers
            yield _entries(row["node"], q, ids, s, (s >= need[:, None]) & ~own)
    return run


def _met(rows: DataFrame, queries: DataFrame, parts: int) -> DataFrame:
    """Every block of rows with every block of queries of its node and length.

    Blocks of rows are dealt out to ``parts`` (their column ``part``; no more than there are blocks), and each part
    gets every block of queries.
    """
    spread = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return spread.repartition(2 * parts, "node", "d", "part").join(rows.repartition(2 * parts, "node", "d", "part"), ["node", "d", "part"])


def _score(pairs: DataFrame, v: DataFrame) -> DataFrame:
    """Exact scores of ``(query_id, vec_id)`` pairs from the whole vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns[2:])
            at = np.concatenate([[0], np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))])[:-1]
            s = np.add.reduceat(a * b, at) if len(a) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.int64())],
                                             names=["query_id", "vec_id", "score"])

    q, x = (v.select(F.col("vec_id").alias(i), F.col("v").alias(n)) for i, n in (("query_id", "qv"), ("vec_id", "xv")))
    return (pairs.join(q, "query_id").join(x, "vec_id").select("query_id", "vec_id", "qv", "xv")
            .mapInArrow(run, "query_id long, vec_id long, score long"))


def _ranked(scores: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(embeddings: DataFrame, every: int = 100, k: int = 10, nodes: int = 2, scale: int = 1024) -> DataFrame:
    """``embeddings(vec_id, embedding)`` -> ``query_id, rank, vec_id, score``: for each query (vec_id
    divisible by ``every``) the ``k`` largest integer inner products, ties to the smaller vec_id.

    Null and empty vectors, null ids and vectors with null or non-finite components take no part;
    vectors of another length are no candidates; a repeated vec_id counts once. Fewer than ``k``
    candidates: all of them. Products are 64-bit integers.
    """
    v = written(integers(embeddings, scale), "topk-vectors")
    asked = v.where(F.col("vec_id") % every == 0)
    rows = written(v.mapInArrow(_blocks(ROWS, nodes), _BLOCK_DDL), "topk-rows")
    parts = max(min(rows.count() // nodes, int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    queries = written(asked.mapInArrow(_blocks(QUERIES, nodes), _BLOCK_DDL)
                      .withColumn("b", F.monotonically_increasing_id()), "topk-queries")
    q = queries.select("node", "d", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), "b")

    # 1: local lists, and the k-th best exact score among what they hold
    lists = _met(rows, q, parts).drop("b").mapInArrow(_local_lists(k), _ENTRY_DDL)
    w = Window.partitionBy("node", "query_id").orderBy(F.desc("s"), "vec_id")
    listed = lists.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).select("query_id", "vec_id").distinct()
    cutoffs = (_ranked(_score(listed, v), k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("c"))
               .where(F.col("n") == k).select("query_id", "c"))
    cutoffs = written(cutoffs, "topk-cutoffs")

    # 2: cutoffs go to the query blocks, and nodes collect what reaches the threshold
    in_block = q.mapInArrow(_ids, "b long, query_id long").join(cutoffs, "query_id").groupBy("b").agg(
        F.collect_list("query_id").alias("c_ids"), F.collect_list("c").alias("c"))
    q2 = q.join(in_block, "b", "left").withColumns({"c_ids": F.coalesce("c_ids", F.array().cast("array<long>")),
                                                    "c": F.coalesce("c", F.array().cast("array<long>"))}).drop("b")
    entries = _met(rows, q2, parts).mapInArrow(_over_threshold(nodes), _ENTRY_DDL)

    # 3: drop by upper bound, score the rest exactly
    sums = entries.groupBy("query_id", "vec_id").agg(F.count("*").alias("m"), F.sum("s").alias("known"))
    rest = (sums.join(cutoffs, "query_id", "left")
            .where(F.col("c").isNull() | (F.col("known") + (nodes - F.col("m")) * F.ceil(F.col("c") / nodes) >= F.col("c")))
            .select("query_id", "vec_id"))
    return _ranked(_score(rest, v), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = {n: i for i, n in enumerate(batch.schema.names)}
        for node, b, ids in zip(*(batch.column(at[n]).to_pylist() for n in ("node", "b", "q_ids"))):
            ids = np.frombuffer(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), b)), pa.array(ids)], names=["b", "query_id"])
