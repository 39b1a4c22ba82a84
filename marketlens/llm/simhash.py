"""SimHash near-duplicates through a hierarchical index in Gray order.

Distinct fingerprints are sorted by Gray rank (range partitions), so that
neighbours share bits. Every 64 consecutive ones form a leaf, every 64
consecutive leaves a node above it, and so on up to one root; a node keeps the
bit pattern that all below it share (a mask of the shared bits, and their
values). The self-join walks the index from the root pair downwards: the
children of two nodes go on only if their patterns differ in at most
``max_bits`` of the bits that both share, which prunes whole groups. Leaves are
the nodes whose children share all 64 bits, so the same test decides links.

A leaf pair emits a spanning forest of its links, not all pairs; that keeps
components whole without output that is quadratic in a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import connected_components, written

FAN = 64
_CHUNK = 200_000   # shingles hashed at a time: bounds memory for very long texts


# --------------------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text: A-Z lower-cased, words split at ASCII white space, ``words``-word
    shingles with repeats (fewer words: the whole sequence), XXH64 each; a bit is set where
    over half the hashes have it. No words (or null): 0."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    body = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words, len(tokens))
    starts, ends = starts[:len(tokens) - k + 1], ends[k - 1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), _CHUNK):
        spans = zip(starts[i:i + _CHUNK].tolist(), ends[i:i + _CHUNK].tolist())
        h = np.array([digest(body[a:b], seed) for a, b in spans], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(starts), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, fp)``, fp the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None, words, seed)
                   for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
            .mapInArrow(run, "doc_id long, fp long"))


# --------------------------------------------------------------------------- index
def _gray_rank(col: str):
    """Rank in Gray order (prefix parity of the bits), shifted so that signed order is unsigned order."""
    x = F.col(col)
    for s in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, s))
    return x.bitwiseXOR(F.lit(-(1 << 63)))


def _common(patterns: np.ndarray, masks: np.ndarray) -> tuple[int, int]:
    """What all children share: pattern (0 outside the mask) and mask."""
    same = ~np.bitwise_or.reduce(patterns ^ patterns[0]) & np.bitwise_and.reduce(masks)
    return int(patterns[0] & same), int(same)


_NODE_DDL = "id long, patterns array<long>, masks array<long>, pattern long, mask long"
_NODE = pa.schema([("id", pa.int64()), ("patterns", pa.list_(pa.int64())), ("masks", pa.list_(pa.int64())),
                   ("pattern", pa.int64()), ("mask", pa.int64())])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted fingerprints of one range partition -> its leaves, numbered (partition, position)."""
    base, n, held = TaskContext.get().partitionId() << 40, 0, np.empty(0, np.int64)

    def leaf(fps: np.ndarray, k: int) -> dict:
        pattern, mask = _common(fps, np.full(len(fps), -1, np.int64))
        return {"id": base + k, "patterns": fps, "masks": None, "pattern": pattern, "mask": mask}

    for batch in batches:
        held = np.concatenate([held, batch.column(0).to_numpy(zero_copy_only=False)])
        full = len(held) // FAN
        if full:
            yield pa.RecordBatch.from_pylist([leaf(held[i * FAN:(i + 1) * FAN], n + i) for i in range(full)], _NODE)
            n, held = n + full, held[full * FAN:]
    if len(held):
        yield pa.RecordBatch.from_pylist([leaf(held, n)], _NODE)


def build_index(fps: DataFrame) -> list[DataFrame]:
    """Distinct ``fp`` -> the index's levels, leaves first, the last one a single root.

    Nodes of a level: ``id, patterns, masks`` (of up to 64 children; null masks: all
    bits) and the node's own ``pattern, mask``. A node's parent is its id / 64.
    """
    spark = fps.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranked = (fps.select("fp", _gray_rank("fp").alias("g")).repartitionByRange(n, "g")
              .sortWithinPartitions("g").select("fp"))
    raw = written(ranked.mapInArrow(_leaves, _NODE_DDL), "simhash-leaves")
    # renumber densely enough for few levels: partition number and position keep their order
    top = raw.agg(F.max(F.col("id").bitwiseAND((1 << 40) - 1)), F.max(F.shiftright("id", 40))).first()
    if top[0] is None:
        return []
    bits = 6
    while (1 << bits) <= top[0]:
        bits += 6
    leaves = raw.withColumn("id", F.shiftleft(F.shiftright("id", 40), bits) + F.col("id").bitwiseAND((1 << 40) - 1))
    largest, levels = (top[1] + 1 << bits) - 1, [leaves]
    while largest:
        below, largest = levels[-1], largest >> 6
        kids = below.groupBy(F.shiftright("id", 6).alias("id")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("id").alias("kid"), "pattern", "mask"))).alias("k"))
        same = F.expr("aggregate(k, mask_of, (m, x) -> m & x.mask & ~(x.pattern ^ k[0].pattern))")
        node = (kids.select("id", "k", F.lit(-1).cast("long").alias("mask_of")).withColumn("mask", same)
                .select("id", "k.kid", F.col("k.pattern").alias("patterns"), F.col("k.mask").alias("masks"),
                        F.expr("k[0].pattern & mask").alias("pattern"), "mask"))
        levels.append(written(node, "simhash-nodes"))
    return levels


# --------------------------------------------------------------------------- self-join
def _close(p: np.ndarray, pm: np.ndarray | None, q: np.ndarray, qm: np.ndarray | None, bits: int) -> np.ndarray:
    """Pairs of children whose patterns differ in at most ``bits`` of the bits both share."""
    diff = p[:, None] ^ q[None, :]
    if pm is not None:
        diff &= pm[:, None] & qm[None, :]
    return np.argwhere(np.bitwise_count(diff.view(np.uint64)) <= bits)


def _descend(bits: int):
    """Node pairs -> pairs of children that may hold links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                p, pm, pk, q, qm, qk = (c[n][i].values.to_numpy() for n in ("pp", "pm", "pk", "qp", "qm", "qk"))
                hit = _close(p, pm, q, qm, bits)
                a, b = pk[hit[:, 0]], qk[hit[:, 1]]
                keep = a <= b     # both orders occur below a node paired with itself
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["p", "q"])
    return run


def _forest(bits: int):
    """Leaf pairs -> links (a spanning forest of them within the pair) and the number of links found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                p, q = c["pp"][i].values.to_numpy(), c["qp"][i].values.to_numpy()
                hit = _close(p, None, q, None, bits)
                left, right = p[hit[:, 0]], q[hit[:, 1]]
                root: dict[int, int] = {}

                def find(x: int) -> int:
                    while root.get(x, x) != x:
                        x = root[x]
                    return x

                for a, b in zip(left[left != right].tolist(), right[left != right].tolist()):
                    ra, rb = find(a), find(b)
                    if ra != rb:
                        root[max(ra, rb)] = min(ra, rb)
                        out_a.append(a)
                        out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())],
                                             names=["a", "b"])
    return run


def links(levels: list[DataFrame], max_bits: int) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints: every pair within ``max_bits`` is
    connected by them, and each is such a pair."""
    spark = levels[0].sparkSession
    pairs = spark.range(1).select(F.col("id").alias("p"), F.col("id").alias("q"))
    for depth in range(len(levels) - 1, -1, -1):
        nodes, leaf = levels[depth], depth == 0
        cols = ["patterns"] if leaf else ["patterns", "masks", "kid"]

        def side(s: str) -> DataFrame:
            short = {"patterns": "p", "masks": "m", "kid": "k"}
            return nodes.select(F.col("id").alias(s), *[F.col(c).alias(s + short[c]) for c in cols])

        both = pairs.join(side("p"), "p").join(side("q"), "q").drop("p", "q")
        if leaf:
            return both.mapInArrow(_forest(max_bits), "a long, b long")
        pairs = written(both.mapInArrow(_descend(max_bits), "p long, q long"), "simhash-pairs")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, text, ...)`` -> one row per document: ``doc_id, fp, component_id``.

    Fingerprints link at ``max_bits`` or fewer differing bits; ``component_id`` is the
    smallest doc_id of the connected group. Null or wordless texts have fingerprint 0
    and link like any other. Repeated rows stay, in one group; a null doc_id is never
    the smallest unless the group has no other. Empty table: no rows.
    """
    fps = written(fingerprints(docs, words), "simhash-fps")
    firsts = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    levels = build_index(firsts.select("fp"))
    if not levels:
        return fps.withColumn("component_id", F.col("doc_id"))
    found = connected_components(written(links(levels, max_bits), "simhash-links"))
    grouped = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    component = written(grouped.select("fp", "root").join(smallest, "root").select("fp", "component_id"),
                        "simhash-components")
    return fps.join(component, "fp").select("doc_id", "fp", "component_id")
