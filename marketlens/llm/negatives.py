"""Hard negatives through a multiway hyperplane tree.

The tree splits a node's vectors among up to 16 split points, each vector to the
nearest (so the cells are bounded by hyperplanes). A split point keeps the range of its
distances to the vectors of every sibling's subtree, and a subtree the range of its
vectors' squared lengths. Nodes of up to 512 vectors are leaves.

A window of scores is an annulus of distances around the anchor, as
``|a - x|^2 = |a|^2 + |x|^2 - 2 a.x``. At a node an anchor goes on into a child only if,
for every split point, the child's range meets the annulus moved by the anchor's distance
to that split point. Leaves are scored exactly, in integers.

An anchor's own leaf is scored first: what it finds there narrows the window from below.
Anchors are sorted by leaf and searched in blocks, a bit for each anchor that still needs
the subtree; trees, pairs and leaves meet in joins, level by level.

Split points come from a sample of about ``4 * CANDIDATES`` vectors of the node; every
vector is indexed. Equal vectors with one label are one vector with its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import sized_broadcast, written
from marketlens.llm.topk import _product as exact_product

FAN, LEAF, ANCHORS = 16, 512, 256
CANDIDATES = 64
DEPTH = 12                 # a node at this depth is a leaf of as many blocks as it takes
SMALL_POINTS = 2_000       # split points of as many nodes are hinted for broadcast
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_EPS = 1e-11               # relative slack of distances

_BLOCK = pa.schema([("node", pa.string()), ("d", pa.int32()), ("n", pa.int32()), ("g", pa.binary()),
                    ("label", pa.binary()), ("asked", pa.binary()), ("x", pa.binary())])
_BLOCK_DDL = "node string, d int, n int, g binary, label binary, asked binary, x binary"


class _Rows:
    """Vectors of one node: ids, labels, whether they are asked for, and components."""

    def __init__(self, g, label, asked, x):
        self.g, self.label, self.asked, self.x = g, label, asked, x

    @classmethod
    def of(cls, row: dict, d: int) -> _Rows:
        return cls(np.frombuffer(row["g"], np.int64), np.frombuffer(row["label"], np.int64),
                   np.frombuffer(row["asked"], bool), np.frombuffer(row["x"], np.int64).reshape(-1, d))

    @classmethod
    def joined(cls, parts: list[_Rows]) -> _Rows:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("g", "label", "asked", "x")))

    def __len__(self) -> int:
        return len(self.g)

    def take(self, at) -> _Rows:
        return _Rows(self.g[at], self.label[at], self.asked[at], self.x[at])

    def block(self, node: str) -> dict:
        return {"node": node, "d": self.x.shape[1], "n": len(self), "g": self.g.tobytes(), "label": self.label.tobytes(),
                "asked": self.asked.tobytes(), "x": np.ascontiguousarray(self.x).tobytes()}


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


# --------------------------------------------------------------------------- building
def _pack(leaf: int):
    """``g, label, asked, v`` -> blocks of the root of their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[_Rows]] = {}

        def full(d: int, least: int) -> Iterator[pa.RecordBatch]:
            if sum(map(len, held[d])) >= least:
                rows = _Rows.joined(held[d])
                held[d] = []
                yield pa.RecordBatch.from_pylist([rows.take(slice(i, i + leaf)).block(str(d)) for i in range(0, len(rows), leaf)], _BLOCK)

        for batch in batches:
            g, label, asked = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            v = batch.column(3)
            lengths = np.diff(v.offsets.to_numpy())
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d)
                held.setdefault(d, []).append(_Rows(g[at], label[at], asked[at].astype(bool), x))
                yield from full(d, leaf)
        for d in held:
            yield from full(d, 1)
    return run


def _uniform(g: np.ndarray) -> np.ndarray:
    """A hash of ids, uniform in 0 to 1."""
    h = (g.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their node's number of vectors -> a sample of its vectors."""
    for batch in batches:
        for row in _rows(batch):
            rows = _Rows.of(row, row["d"])
            u = _uniform(rows.g)
            at = np.flatnonzero(u * row["rows"] < 4 * CANDIDATES)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["node"]] * len(at), pa.string()), pa.array(u[at]),
                pa.array([rows.x[i].tobytes() for i in at], pa.binary())], names=["node", "u", "x"])


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of two sets of vectors, and what rounding may have added or taken."""
    size = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :]
    return np.maximum(size - 2 * (x @ y.T), 0), _EPS * size


def _choose(fan: int):
    """A node's sample -> its split points: each the farthest from those before; none where all are equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                x = np.stack([np.frombuffer(c, np.int64) for c in row["sample"]])
                far, chosen = _squares(x[:1].astype(float), x.astype(float))[0][0], [0]
                while len(chosen) < fan and (x != x[chosen[0]]).any() and far.max() > 0:
                    chosen.append(int(far.argmax()))
                    far = np.minimum(far, _squares(x[chosen[-1:]].astype(float), x.astype(float))[0][0])
                    far[chosen] = 0
                if len(chosen) > 1:
                    yield pa.RecordBatch.from_arrays([pa.array([row["node"]]), pa.array([x[chosen].tobytes()], pa.binary())],
                                                     names=["node", "points"])
    return run


_PIECE_DDL = "parent string, child int, " + _BLOCK_DDL + ", nlo double, nhi double, lo array<double>, hi array<double>"
_PIECE = pa.schema([("parent", pa.string()), ("child", pa.int32()), *_BLOCK, ("nlo", pa.float64()), ("nhi", pa.float64()),
                    ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])


def _assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their node's split points -> their part of each child, with its ranges of distances."""
    for batch in batches:
        for row in _rows(batch):
            rows, out = _Rows.of(row, row["d"]), []
            points = np.frombuffer(row["points"], np.int64).reshape(-1, row["d"]).astype(float)
            x = rows.x.astype(float)
            square, off = _squares(x, points)
            nearest, size = square.argmin(1), (x * x).sum(1)
            low, high = np.sqrt(np.maximum(square - off, 0)), np.sqrt(square + off)
            for c in np.unique(nearest).tolist():
                at = nearest == c
                out.append({"parent": row["node"], "child": c, **rows.take(at).block(f"{row['node']}.{c}"),
                            "nlo": size[at].min() * (1 - _EPS), "nhi": size[at].max() * (1 + _EPS),
                            "lo": low[at].min(0), "hi": high[at].max(0)})
            yield pa.RecordBatch.from_pylist(out, _PIECE)


def _merge(leaf: int):
    """Pieces sorted by node -> blocks of up to ``leaf`` vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def out(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held and sum(map(len, held)) >= least:
                rows = _Rows.joined(held)
                full = len(rows) if least == 1 else len(rows) // leaf * leaf
                held = [rows.take(slice(full, None))] if full < len(rows) else []
                yield pa.RecordBatch.from_pylist([rows.take(slice(i, min(i + leaf, full))).block(node)
                                                  for i in range(0, full, leaf)], _BLOCK)

        for batch in batches:
            for row in _rows(batch):
                if row["node"] != node:
                    yield from out(1)
                    node, held = row["node"], []
                held.append(_Rows.of(row, row["d"]))
                yield from out(leaf)
        yield from out(1)
    return run


def build_tree(groups: DataFrame, fan: int = FAN, leaf: int = LEAF) -> tuple[list[DataFrame], DataFrame]:
    """``g, label, asked, v`` -> the levels of inner nodes, top first, and the blocks of the leaves."""
    frontier, levels, leaves = written(groups.mapInArrow(_pack(leaf), _BLOCK_DDL), "tree-root"), [], []
    for _ in range(DEPTH):
        sizes = frontier.groupBy("node").agg(F.sum("n").alias("rows"))
        big = written(sizes.where(F.col("rows") > leaf), "tree-big")
        sample = (frontier.join(sized_broadcast(big, big.count()), "node").select("node", "rows", "d", "n", "g", "label", "asked", "x")
                  .mapInArrow(_candidates, "node string, u double, x binary").groupBy("node")
                  .agg(F.slice(F.sort_array(F.collect_list(F.struct("u", "x"))), 1, CANDIDATES).getField("x").alias("sample")))
        points = written(sample.mapInArrow(_choose(fan), "node string, points binary"), "tree-points")
        n = points.count()
        if not n:
            break
        leaves.append(frontier.join(points.select("node"), "node", "left_anti"))
        split = frontier.join(F.broadcast(points) if n <= SMALL_POINTS else points, "node")
        pieces = written(split.mapInArrow(_assign, _PIECE_DDL), "tree-pieces")
        kids = pieces.groupBy("parent", "child").agg(
            F.min("nlo").alias("nlo"), F.max("nhi").alias("nhi"),
            F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(fan)]).alias("lo"),
            F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(fan)]).alias("hi"))
        kids = kids.groupBy(F.col("parent").alias("node")).agg(
            F.collect_list(F.struct("child", "nlo", "nhi", "lo", "hi")).alias("kids"))
        levels.append(written(points.join(kids, "node"), "tree-nodes"))
        # a large node's pieces are merged in as many places as it has 64 leaves' worth of vectors
        parts = pieces.groupBy("node").agg(F.ceil(F.sum("n") / (64 * leaf)).alias("parts"))
        salted = pieces.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("g"), "parts"))
        frontier = written(salted.select("node", "d", "n", "g", "label", "asked", "x", "part").repartition("node", "part")
                           .sortWithinPartitions("node").drop("part").mapInArrow(_merge(leaf), _BLOCK_DDL), "tree-blocks")
    blocks = frontier
    for leaf in leaves:
        blocks = blocks.unionByName(leaf)
    return levels, (written(blocks, "tree-leaves") if leaves else frontier)


# --------------------------------------------------------------------------- anchors
def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in _rows(batch):
            rows = _Rows.of(row, row["d"])
            rows = rows.take(rows.asked)
            yield pa.RecordBatch.from_arrays([
                pa.array([row["node"]] * len(rows), pa.string()), pa.array([row["d"]] * len(rows), pa.int32()), pa.array(rows.g),
                pa.array(rows.label), pa.array([x.tobytes() for x in rows.x], pa.binary())], names=["home", "d", "g", "label", "x"])


_ANCHOR_DDL = "b long, d int, ag array<long>, alabel array<long>, ax binary, homes array<string>"


def _anchor_blocks(size: int):
    """Anchors sorted by length and leaf -> blocks of them."""

    def block(b: int, held: list) -> pa.RecordBatch:
        home, d, g, label, x = zip(*held)
        return pa.RecordBatch.from_arrays([pa.array([b]), pa.array([d[0]], pa.int32()), pa.array([list(g)]), pa.array([list(label)]),
                                           pa.array([b"".join(x)], pa.binary()), pa.array([list(home)], pa.list_(pa.string()))],
                                          names=["b", "d", "ag", "alabel", "ax", "homes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, held = TaskContext.get().partitionId() << 40, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (len(held) == size or held[0][1] != row[1]):
                    yield block(made, held)
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield block(made, held)
    return run


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors -> (block, leaf, which of the anchors are in it)."""
    for batch in batches:
        for row in _rows(batch):
            homes = np.array(row["homes"], object)
            nodes = sorted(set(row["homes"]))
            yield pa.RecordBatch.from_arrays([pa.array([row["b"]] * len(nodes)), pa.array(nodes, pa.string()),
                                              pa.array([(homes == n).tobytes() for n in nodes], pa.binary())], names=["b", "node", "mask"])


# --------------------------------------------------------------------------- search
def _windows(row: dict) -> tuple[np.ndarray, ...]:
    """The windows of the anchors that a mask leaves: position, name, least and largest score."""
    pos, w, lo, hi = (np.array([x[c] for x in row["wins"]], np.int64) for c in ("pos", "w", "lo", "hi"))
    on = np.frombuffer(row["mask"], bool)[pos]
    return pos[on], w[on], lo[on], hi[on]


def _eliminate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of anchors at a node -> its children with the anchors that go on into them."""
    for batch in batches:
        for row in _rows(batch):
            d = row["d"]
            a = np.frombuffer(row["ax"], np.int64).reshape(-1, d).astype(float)
            p = np.frombuffer(row["points"], np.int64).reshape(-1, d).astype(float)
            pos, _, lo, hi = _windows(row)
            lo, hi = np.where(lo == LEAST, -np.inf, lo.astype(float)), np.where(hi == MOST, np.inf, hi.astype(float))
            size = (a * a).sum(1)
            square, off = _squares(a, p)
            near, far = np.sqrt(np.maximum(square - off, 0)), np.sqrt(square + off)
            apart, _ = _squares(p, p)
            nodes, masks = [], []
            for kid in row["kids"]:
                c, k = kid["child"], len(p)
                klo, khi = np.array(kid["lo"][:k]), np.array(kid["hi"][:k])
                least = np.maximum(near - khi, klo - far).max(1)
                # x is nearer to its own split point than to any other: so far is the hyperplane between
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (square[:, [c]] - square - off[:, [c]] - off - 2 * _EPS * (kid["nhi"] + apart[c])) / (2 * np.sqrt(apart[c]))
                least = np.maximum(least, np.where(apart[c] > 0, plane, -np.inf).max(1))
                most = (far + khi).min(1)
                slack = _EPS * (size + kid["nhi"])
                outer = size[pos] + kid["nhi"] - 2 * lo + 4 * slack[pos]
                inner = size[pos] + kid["nlo"] - 2 * hi - 4 * slack[pos]
                ok = ((outer >= 0) & (np.maximum(least[pos], 0) <= np.sqrt(np.maximum(outer, 0)) * (1 + _EPS))
                      & (most[pos] * (1 + _EPS) >= np.sqrt(np.maximum(inner, 0))))
                if ok.any():
                    mask = np.zeros(len(a), bool)
                    mask[pos[ok]] = True
                    nodes.append(f"{row['node']}.{c}")
                    masks.append(mask.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([row["b"]] * len(nodes), pa.int64()), pa.array(nodes, pa.string()),
                                              pa.array(masks, pa.binary())], names=["b", "node", "mask"])


def _score(k: int, same: bool):
    """Blocks of anchors at a block of a leaf -> the best ``k`` of each window (ties to the smaller id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                pos, w, lo, hi = _windows(row)
                rows = _Rows.of(row, row["d"])
                rows = rows.take(np.argsort(rows.g, kind="stable"))
                on, where = np.unique(pos, return_inverse=True)
                a = np.frombuffer(row["ax"], np.int64).reshape(-1, row["d"])[on]
                label, ids = np.array(row["alabel"], np.int64)[pos], np.array(row["ag"], np.int64)[pos]
                s = exact_product(a, rows.x)[where]
                ok = (s >= lo[:, None]) & (s <= hi[:, None]) & ((label[:, None] == rows.label[None, :]) == same)
                n = len(rows)
                if int(np.abs(s).max(initial=0)) < (1 << 62) // (n + 1):      # one number orders by score, then id
                    key = np.where(ok, s * n + np.arange(n)[::-1], LEAST)
                else:
                    key = np.where(ok, s, LEAST)                              # ties all go on
                if n > k:
                    ok &= key >= np.partition(key, n - k, axis=1)[:, [n - k]]
                r, c = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(w[r]), pa.array(rows.g[c]), pa.array(s[r, c])],
                                                 names=["a", "w", "g", "s"])
    return run


def _best(entries: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a", "w").orderBy(F.desc("s"), "g")
    return entries.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


class Search:
    """Searches of one tree for one set of anchors."""

    def __init__(self, groups: DataFrame, fan: int = FAN, leaf: int = LEAF, block: int = ANCHORS):
        self.levels, self.leaves = build_tree(groups, fan, leaf)
        rows = written(self.leaves.mapInArrow(_asked, "home string, d int, g long, label long, x binary"), "tree-anchors")
        few = max(1, -(-rows.count() // (8 * block)))
        self.anchors = written(rows.orderBy("d", "home", "g").coalesce(few).mapInArrow(_anchor_blocks(block), _ANCHOR_DDL), "tree-anchor-blocks")
        self.homes = self.anchors.select("b", "homes").mapInArrow(_homes, "b long, node string, mask binary")
        self.places = self.anchors.select("b", F.posexplode("ag").alias("pos", "a"))
        self.count = self.anchors.count()

    def _ready(self, windows: DataFrame) -> DataFrame:
        """Blocks of anchors with their windows ``(a, w, lo, hi)``; blocks without any are left out."""
        wins = (windows.join(self.places, "a").groupBy("b")
                .agg(F.collect_list(F.struct("pos", "w", "lo", "hi")).alias("wins")))
        return written(self.anchors.select("b", "d", "ag", "alabel", "ax").join(wins, "b"), "tree-windows")

    def _met(self, pairs: DataFrame, ready: DataFrame, other: DataFrame) -> DataFrame:
        """Pairs with their block of anchors (a few hundred vectors; 64 blocks are hinted for broadcast) and node."""
        return pairs.join(F.broadcast(ready) if self.count <= 64 else ready, "b").join(other.drop("d"), "node")

    def _descend(self, ready: DataFrame) -> DataFrame:
        whole = F.expr("unhex(repeat('01', size(ag)))")
        pairs, out = written(ready.select("b", F.col("d").cast("string").alias("node"), whole.alias("mask")), "tree-pairs"), []
        for level in self.levels:
            out.append(pairs.join(level.select("node"), "node", "left_anti").select("b", "node", "mask"))
            pairs = written(self._met(pairs, ready, level).mapInArrow(_eliminate, "b long, node string, mask binary"), "tree-pairs")
        for p in out:
            pairs = pairs.unionByName(p)
        return pairs

    def run(self, windows: DataFrame, k: int, same: bool, home: bool) -> DataFrame:
        """The best ``k`` groups of each window (in the anchors' own leaves alone if ``home``): ``a, w, g, s, r``."""
        ready = self._ready(windows)
        pairs = self.homes if home else self._descend(ready)
        return _best(self._met(pairs, ready, self.leaves).mapInArrow(_score(k, same), "a long, w long, g long, s long"), k)


def _floor_pct(c: Column, pct: int) -> Column:
    """``pct`` percent, rounded down; the product may pass 64 bits."""
    return F.floor(c.cast("decimal(24,0)") * F.lit(pct) / F.lit(100))


def mine(embeddings: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low_pct: int = 30,
         high_pct: int = 90, scale: int = 256, fan: int = FAN, leaf: int = LEAF, block: int = ANCHORS) -> DataFrame:
    """``embeddings(vec_id, embedding, label)`` -> ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Components x become ``floor(scale * x)``; scores are inner products of integers, larger
    ones first, ties to the smaller vec_id. Anchors are rows whose vec_id is divisible by
    ``every``; their positives the first ``positives`` other rows of their label; for each
    positive the first ``negatives`` rows of another label whose score is ``low_pct`` to
    ``high_pct`` percent of the positive's come out (none: no rows).

    Rows with a null vec_id, label or vector, an empty vector or a null or non-finite
    component take no part; vectors of another length are neither positives nor negatives; of
    rows that repeat a vec_id the smallest vector (then label) stands. Labels are integers.
    Other columns are ignored, whatever their names. Empty table: no rows. ``fan``, ``leaf``
    and ``block`` are the sizes of the tree and of the anchors' blocks; results do not depend on them.
    """
    keep = max(positives, negatives) + 1
    v = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"),
                          F.col("label").cast("long").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = (v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad)
         .groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r"))
         .select("vec_id", "r.label", F.transform("r.v", lambda x: F.floor(x * scale).cast("long")).alias("v")))
    v = written(v, "negatives-vectors")
    # equal vectors of a label: their smallest ids (limited before the shuffle) are all that can come out
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    groups = (v.withColumn("r", F.row_number().over(order)).where(F.col("r") <= keep).groupBy("label", "v")
              .agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("g", F.col("ids")[0]))
    groups = written(groups, "negatives-groups")
    asked = written(v.where(F.col("vec_id") % every == 0).join(groups, ["label", "v"]).select("vec_id", "g"), "negatives-asked")
    wanted = asked.select("g").distinct().withColumn("asked", F.lit(True))
    search = Search(groups.join(wanted, "g", "left").select("g", "label", F.coalesce("asked", F.lit(False)).alias("asked"), "v"),
                    fan, leaf, block)

    def rows(found: DataFrame, k: int) -> DataFrame:
        """Groups found -> the first ``k`` rows of each window."""
        w = Window.partitionBy("a", "w").orderBy(F.desc("s"), "vec_id")
        return (found.join(groups.select("g", "ids"), "g").select("a", "w", "s", F.explode("ids").alias("vec_id"))
                .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))

    # positives: one more than asked for, as the anchor itself may be among them
    k = positives + 1
    windows = wanted.select(F.col("g").alias("a"), F.lit(0).cast("long").alias("w"), F.lit(LEAST).cast("long").alias("lo"),
                            F.lit(MOST).cast("long").alias("hi"))
    first = search.run(windows, k, True, home=True).where(F.col("r") == k).select("a", F.col("s").alias("least"))
    windows = windows.join(first, "a", "left").withColumn("lo", F.coalesce("least", "lo")).drop("least")
    best = written(rows(search.run(windows, k, True, home=False), k), "negatives-positives")

    # negatives: a window for each score of a positive
    s = F.col("w")
    windows = best.select("a", F.col("s").alias("w")).distinct().select(
        "a", "w", (-_floor_pct(-s, low_pct)).cast("long").alias("lo"), _floor_pct(s, high_pct).cast("long").alias("hi")).where("lo <= hi")
    windows = written(windows, "negatives-windows")
    first = (search.run(windows, negatives, False, home=True).where(F.col("r") == negatives)
             .select("a", "w", F.col("s").alias("least")))
    windows = windows.join(first, ["a", "w"], "left").withColumn("lo", F.coalesce("least", "lo")).drop("least")
    hard = written(rows(search.run(windows, negatives, False, home=False), negatives), "negatives-found")

    w = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = (asked.select(F.col("vec_id").alias("anchor_id"), F.col("g").alias("a"))
             .join(best.select("a", F.col("vec_id").alias("positive_id"), F.col("s").alias("positive_score")), "a")
             .where("anchor_id <> positive_id").withColumn("r", F.row_number().over(w)).where(F.col("r") <= positives))
    return (pairs.join(hard.select("a", F.col("w").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"),
                                   F.col("s").alias("negative_score")), ["a", "positive_score"])
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))
