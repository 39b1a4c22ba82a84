"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated (signed Hadamard rounds) and split into blocks of up to
16 dimensions. The squared distance of two vectors is the sum of that of their
blocks, so a pair within the limit is, in one block at least, within the block's share
of it, which is proportional to the block's width. Every block is joined by range under
that budget:

1. Per label, length and block, vectors are sorted along a space-filling order of the
   block's coordinates (range partitions) and cut into tiles with their bounding box.
   64 consecutive tiles form a node with the box around them, and so on to one root.
2. Pairs of nodes are walked from the root pair down; only pairs of boxes no further apart
   than the budget go on. What is left are pairs of tiles.
3. A pair of tiles finds its candidates by the block's distances, keeps those whose first
   block within budget is this one (so the union over the blocks holds each pair once) and
   verifies them by the exact cosine of the original vectors.

No pair leaves a task: a tile pair sends the number of links of each vector and, per
group of linked vectors, one edge to its smallest. Equal vectors with one label are one
vector with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.ann import rotate
from marketlens.llm.common import connected_components, written



class Shape(NamedTuple):
    """Sizes of the join; results do not depend on them."""

    width: int = 16      # dimensions of a block
    tile: int = 2048     # vectors of a tile at most (and 1 MB, but at least a cell)
    cell: int = 256      # vectors of a cell, the part of a tile compared at a time
    fan_bits: int = 6    # children of a node of the box index, as a power of two


CHUNK = 1 << 21  # numbers in the differences verified at a time
SLACK = 1e-9     # added to the squared limit before it is dealt to the blocks


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks(d: int, width: int) -> list[slice]:
    """The blocks of rotated vectors of length ``d`` (padded to a power of two)."""
    n = 1 << max(d - 1, 0).bit_length()
    return [slice(i, min(i + width, n)) for i in range(0, n, width)]


def _tile_rows(d: int, shape: Shape) -> int:
    return min(shape.tile, max(shape.cell, (1 << 20) // (8 * d)))


def _budgets(d: int, width: int, limit: float) -> list[float]:
    blocks = _blocks(d, width)
    return [(limit + SLACK) * (b.stop - b.start) / blocks[-1].stop for b in blocks]


def _order(y: np.ndarray) -> np.ndarray:
    """Bits of all coordinates interleaved, most significant first: 64 / columns bits each, at least one."""
    columns = y.shape[1]
    depth = max(1, min(16, 64 // columns))
    scale = 4 / np.sqrt(columns)          # a block's coordinates lie well inside +-1
    cell = np.clip((y * scale + 1) / 2 * (1 << depth), 0, (1 << depth) - 1).astype(np.uint64)
    out = np.zeros(len(y), np.uint64)
    for bit in range(depth - 1, -1, -1):
        for c in range(columns):
            out = (out << np.uint64(1)) | ((cell[:, c] >> np.uint64(bit)) & np.uint64(1))
    return (out ^ np.uint64(1 << 63)).view(np.int64)    # signed order = unsigned order


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by length."""
    v = batch.column(batch.schema.get_field_index(column))
    lengths = np.diff(v.offsets.to_numpy())
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)


# --------------------------------------------------------------------------- tiles and boxes
_KEYED_DDL = "key string, z long, g long, n long, v array<double>"


def _keyed(width: int):
    """Every vector once per block: the block's key and the place on its space-filling curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch, "v"):
                y, d = rotate(_unit(x), 0), x.shape[1]
                rows = batch.take(pa.array(at))
                labels = rows.column(0).to_pylist()
                for i, b in enumerate(_blocks(d, width)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([f"{label}/{d}/{i}" for label in labels], pa.string()), pa.array(_order(y[:, b])),
                         *rows.columns[1:]], names=["key", "z", "g", "n", "v"])
    return run


_TILE_DDL = "key string, id long, lo array<double>, hi array<double>, g binary, n binary, x binary"
_TILE = pa.schema([("key", pa.string()), ("id", pa.int64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())),
                   ("g", pa.binary()), ("n", pa.binary()), ("x", pa.binary())])


def _tiles(shape: Shape):
    """Sorted rows of one range partition -> tiles of one key each, numbered (partition, position)."""

    def tile(key: str, number: int, held: list) -> pa.RecordBatch:
        g, n, x = (np.concatenate(c) for c in zip(*held))
        d, block = (int(p) for p in key.rsplit("/", 2)[1:])
        y = rotate(_unit(x), 0)[:, _blocks(d, shape.width)[block]]
        single = x.astype(np.float32)
        if (single == x).all():     # float vectors travel as floats
            x = single
        return pa.RecordBatch.from_pylist([{"key": key, "id": number, "lo": y.min(0), "hi": y.max(0), "g": g.tobytes(),
                                            "n": n.tobytes(), "x": x.tobytes()}], _TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, key, held, size = TaskContext.get().partitionId() << 40, None, [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            g, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            v = batch.column(4)
            i = 0
            while i < len(keys):
                if held and keys[i] != key:
                    yield tile(key, number, held)
                    number, held, size = number + 1, [], 0
                key, j = keys[i], i
                most = _tile_rows(int(key.rsplit("/", 2)[1]), shape)
                while j < len(keys) and keys[j] == key and size + j - i < most:
                    j += 1
                x = v.slice(i, j - i).flatten().to_numpy(zero_copy_only=False).reshape(j - i, -1)
                held.append((g[i:j], n[i:j], x))
                size, i = size + j - i, j
                if size == most:
                    yield tile(key, number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield tile(key, number, held)
    return run


def build_index(keyed: DataFrame, shape: Shape) -> list[DataFrame]:
    """``_KEYED_DDL`` rows -> the index, tiles first: ``key, id, lo, hi`` and, above the tiles,
    ``kid, los, his`` of up to 64 children. At the last level every key has the one node 0."""
    spark = keyed.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    tiles = written(keyed.repartitionByRange(n, "key", "z", "g").sortWithinPartitions("key", "z", "g")
                    .mapInArrow(_tiles(shape), _TILE_DDL), "blockjoin-tiles")
    low = (1 << 40) - 1
    top = tiles.agg(F.max(F.col("id").bitwiseAND(low)), F.max(F.shiftright("id", 40))).first()
    if top[0] is None:
        return []
    bits = shape.fan_bits
    while (1 << bits) <= top[0]:
        bits += shape.fan_bits
    tiles = tiles.withColumn("id", F.shiftleft(F.shiftright("id", 40), bits) + F.col("id").bitwiseAND(low))
    levels, largest = [tiles], ((top[1] + 1) << bits) - 1
    while True:
        largest >>= shape.fan_bits
        kids = (levels[-1].groupBy("key", F.shiftright("id", shape.fan_bits).alias("id"))
                .agg(F.sort_array(F.collect_list(F.struct(F.col("id").alias("kid"), "lo", "hi"))).alias("k")))
        around = [F.expr(f"transform(k[0].{c}, (x, i) -> array_{f}(transform(k, t -> t.{c}[i])))").alias(c)
                  for c, f in (("lo", "min"), ("hi", "max"))]
        node = kids.select("key", "id", "k.kid", F.flatten("k.lo").alias("los"), F.flatten("k.hi").alias("his"), *around)
        levels.append(written(node, "blockjoin-nodes"))
        if not largest:
            return levels


def _descend(limit: float, width: int):
    """Pairs of nodes -> pairs of children whose boxes come within the block's budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i, key in enumerate(c["key"].to_pylist()):
                d, block = (int(p) for p in key.rsplit("/", 2)[1:])
                pk, plo, phi, qk, qlo, qhi = (c[n][i].values.to_numpy() for n in ("pkid", "plos", "phis", "qkid", "qlos", "qhis"))
                plo, phi, qlo, qhi = (a.reshape(n, -1) for a, n in ((plo, len(pk)), (phi, len(pk)), (qlo, len(qk)), (qhi, len(qk))))
                apart = np.zeros((len(pk), len(qk)))
                for k in range(plo.shape[1]):
                    gap = np.maximum(plo[:, None, k] - qhi[None, :, k], qlo[None, :, k] - phi[:, None, k])
                    apart += np.maximum(gap, 0) ** 2
                a, b = np.nonzero(apart <= _budgets(d, width, limit)[block] + SLACK)
                a, b = pk[a], qk[b]
                keep = a <= b      # below a node paired with itself both orders occur
                n = int(keep.sum())
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array(a[keep]), pa.array(b[keep])],
                                                 names=["key", "p", "q"])
    return run


# --------------------------------------------------------------------------- verification
_FOUND_DDL = "g long, links long, root long"


def _pairs_of_cells(y: np.ndarray, z: np.ndarray, budget: float, same: bool, cell: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of two tiles within a block's budget (roughly: from products), by cells whose boxes are near."""
    boxes = [[(i, c, c.min(0), c.max(0), (c * c).sum(1)) for i in range(0, len(m), cell) for c in [m[i:i + cell]]] for m in (y, z)]
    for i, a, alo, ahi, aa in boxes[0]:
        for j, b, blo, bhi, bb in boxes[1]:
            if same and j < i:
                continue
            gap = np.maximum(np.maximum(alo - bhi, blo - ahi), 0)
            if gap @ gap > budget + SLACK:
                continue
            r, s = np.nonzero(aa[:, None] + bb[None, :] - 2 * (a @ b.T) <= budget + SLACK)
            r, s = r + i, s + j
            if same:
                keep = r < s
                r, s = r[keep], s[keep]
            for k in range(0, len(r), chunk):
                yield r[k:k + chunk], s[k:k + chunk]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable over the edges (a, b), for nodes 0 to n - 1."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _verify(least: float, shape: Shape):
    limit = 2 - 2 * least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                made = _tile_pair(row, least, limit, shape)
                if made is not None:
                    yield made
    return run


def _tile_pair(row: dict, least: float, limit: float, shape: Shape) -> pa.RecordBatch | None:
    """Links of one pair of tiles: per vector their number and the smallest vector of its group here."""
    d, block = (int(p) for p in row["key"].rsplit("/", 2)[1:])
    blocks, budgets = _blocks(d, shape.width), _budgets(d, shape.width, limit)
    side = {}
    for s in "pq":
        g = np.frombuffer(row[s + "g"], np.int64)
        kind = np.float32 if len(row[s + "x"]) == 4 * d * len(g) else np.float64
        x = np.frombuffer(row[s + "x"], kind).reshape(len(g), d).astype(np.float64)
        side[s] = g, np.frombuffer(row[s + "n"], np.int64), x, _unit(x)
    (pg, pn, px, pu), (qg, qn, qx, qu) = side["p"], side["q"]
    same = row["p"] == row["q"]
    py, qy = rotate(pu, 0), rotate(qu, 0)
    b = blocks[block]
    out_r, out_s, chunk = [], [], max(CHUNK // py.shape[1], 1)
    for r, s in _pairs_of_cells(np.ascontiguousarray(py[:, b]), np.ascontiguousarray(qy[:, b]), budgets[block], same,
                                shape.cell, chunk):
        # block by block, in one order of operations whatever tile the vectors are in
        gap = (py[r] - qy[s]) ** 2
        first = np.full(len(r), -1)
        for k in range(len(blocks) - 1, -1, -1):
            first[np.add.reduce(gap[:, blocks[k]], axis=1) <= budgets[k]] = k
        r, s = r[first == block], s[first == block]
        cosine = np.add.reduce(pu[r] * qu[s], axis=1)
        near = np.flatnonzero(np.abs(cosine - least) < 1e-9)
        if len(near):      # at the limit: as plainly as cosine is defined
            a, c = px[r[near]], qx[s[near]]
            cosine[near] = (a * c).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((c * c).sum(1)))
        hit = cosine >= least
        out_r.append(r[hit])
        out_s.append(s[hit])
    r = np.concatenate(out_r) if out_r else np.empty(0, np.int64)
    if not len(r):
        return None
    s = np.concatenate(out_s) + (0 if same else len(pg))
    g, n = (pg, pn) if same else (np.concatenate([pg, qg]), np.concatenate([pn, qn]))
    links = np.zeros(len(g), np.int64)
    np.add.at(links, r, n[s])
    np.add.at(links, s, n[r])
    by_id = np.argsort(g, kind="stable")
    place = np.empty(len(g), np.int64)
    place[by_id] = np.arange(len(g))
    root = _roots(len(g), place[r], place[s])
    at = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(g[at]), pa.array(links[at]), pa.array(g[by_id][root[place[at]]])],
                                      names=["g", "links", "root"])


def links(keyed: DataFrame, least: float, shape: Shape) -> DataFrame:
    """Keyed vectors -> ``g, links, root`` per vector and tile pair with links."""
    levels = build_index(keyed, shape)
    spark = keyed.sparkSession
    if not levels:
        return spark.createDataFrame([], _FOUND_DDL)
    limit = 2 - 2 * least
    pairs = levels[-1].select("key", F.col("id").alias("p"), F.col("id").alias("q"))
    for level in levels[:0:-1]:
        sides = [level.select("key", F.col("id").alias(s), *[F.col(c).alias(s + c) for c in ("kid", "los", "his")]) for s in "pq"]
        met = pairs.join(sides[0], ["key", "p"]).join(sides[1], ["key", "q"])
        pairs = written(met.mapInArrow(_descend(limit, shape.width), "key string, p long, q long"), "blockjoin-pairs")
    sides = [levels[0].select("key", F.col("id").alias(s), *[F.col(c).alias(s + c) for c in "gnx"]) for s in "pq"]
    # the second exchange carries the pair with one tile; the other joins it there
    met = pairs.join(sides[0], ["key", "p"]).join(sides[1], ["key", "q"])
    return met.mapInArrow(_verify(least, shape), _FOUND_DDL)


def near_duplicates(embeddings: DataFrame, least: float = 0.93, shape: Shape = Shape()) -> DataFrame:
    """``embeddings(vec_id, embedding, label)`` -> one row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors link if their labels are equal and not null and their cosine is at least
    ``least`` (0 < least <= 1). ``component_id`` is the smallest vec_id reachable by links,
    ``kept`` whether that is the vector itself.

    Null, empty and zero vectors, and those with null or non-finite components, link with
    nothing, nor do vectors of different lengths; they keep their row. A vec_id names one
    vector: of rows that repeat it the smallest usable vector (then label) stands, for one
    row. Rows without a vec_id link with nothing; each keeps a row with null ids. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                          F.col("label").cast("string").alias("label"))
    usable = (F.coalesce(F.size("v") > 0, F.lit(False)) & F.col("label").isNotNull()
              & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
              & F.exists("v", lambda x: x != 0))
    rows = v.select("vec_id", F.when(usable, F.struct("v", "label")).alias("r"))
    nameless = rows.where("vec_id is null")
    rows = written(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("r").alias("r"))
                   .select("vec_id", "r.v", "r.label"), "blockjoin-rows")
    some = rows.where("v is not null")
    groups = written(some.groupBy("label", "v").agg(F.min("vec_id").alias("g"), F.count("*").alias("n")), "blockjoin-groups")
    found = written(links(groups.select("label", "g", "n", "v").mapInArrow(_keyed(shape.width), _KEYED_DDL),
                          least, shape), "blockjoin-links")
    counts = found.groupBy("g").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("g").alias("a"), F.col("root").alias("b")))
    known = (groups.join(counts, "g", "left").join(parts.withColumnRenamed("node", "g"), "g", "left")
             .select("label", "v", F.coalesce("root", "g").alias("component_id"),
                     (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    linked = some.join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id").unionByName(nameless.select("vec_id")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
