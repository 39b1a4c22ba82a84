"""Collocations by stripes: each prefix keys an associative counter of the words that follow it.

Level k holds the stripes of all prefixes of k words (level 0: the empty prefix, whose
counter holds every word, and whose total is the number of words). A task counts the
stripes of its texts in arrays and sends one row per prefix with its next words and
counts; stripes of one prefix meet sorted and are merged elementwise, batch by batch.
Entries under ``least`` are dropped there: no phrase holding such a part can be frequent.

Everything comes from the merged stripes: an entry is an extension and its count; the
total of a prefix is its own entry one level down; the largest entry of a prefix's
stripe, and of the entries that end in it, bounds every longer phrase around it.

Between levels the frequent phrases go back to the tasks as a bitmap of hashes, so that
only extensions of frequent phrases by frequent phrases are counted. It has at most
2^``FILTER_BITS`` bits: it may let rare phrases through, which the merge then drops, but
never loses one. Prefixes with more than their share of all words (an eighth of what one
partition would get) are split by their next word; there are at most eight times as many
of those as partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import sized_broadcast, written

FILTER_BITS = 27          # the bitmap has 16 MB at most
CHUNK = 8 << 20           # bytes of text counted at a time (one longer text: at once)

_TABLE = bytearray(range(256))
_TABLE[65:91] = range(97, 123)
_TABLE[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _TABLE[_c] = 10
_TABLE = bytes(_TABLE)

_STRIPE_DDL = "lang string, prefix string, part int, next array<string>, n array<long>"
_STRIPE = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("part", pa.int32()),
                     ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


# --------------------------------------------------------------------------- words and hashes
def _words(raw: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the number of each word of the text, and the piece it is in."""
    a = np.frombuffer(raw.translate(_TABLE), np.uint8)
    line = np.flatnonzero(a == 10)
    inside = a > 32
    inside |= (a < 32) & (a != 10)
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    start, length = edge[::2], edge[1::2] - edge[::2]
    piece = np.searchsorted(line, start).astype(np.int32)
    # 64-bit offsets: a single text may be of any length
    offsets = np.concatenate([[0], np.cumsum(length)])
    del edge, start, length
    words = pa.Array.from_buffers(pa.large_binary(), len(piece), [None, pa.py_buffer(offsets), pa.py_buffer(a[inside])])
    del inside
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), piece


def _word_hashes(words: list[bytes], lang: str) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _mixed(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _listed(bitmap: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    at = _slots(h, bits)
    return (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


# --------------------------------------------------------------------------- counting
def _count(raw: bytes, lang: str, level: int, bitmap: np.ndarray | None, bits: int, heavy: dict, parts: int) -> pa.RecordBatch | None:
    """The stripes of one text (pieces end at line feeds) at a level."""
    words, ids, piece = _words(raw)
    if not len(ids):
        return None
    v, hashes = len(words), _word_hashes(words.to_pylist(), lang)
    if level == 0:
        following, n = np.arange(v), np.bincount(ids, minlength=v)
        group, prefixes = np.zeros(v, np.int64), pa.array([""])
        split = np.array([parts])
    else:
        h = np.zeros(len(ids), np.uint64)
        for k in range(level):
            h = _mixed(h[:len(ids) - k], hashes[ids[k:]])
        ok = _listed(bitmap, bits, h)
        last = len(ids) - level
        at = np.flatnonzero(ok[:last] & ok[1:last + 1] & (piece[:last] == piece[level:]))
        del h, ok
        if not len(at):
            return None
        used = np.zeros(v, bool)
        used[ids[at]] = True
        group, spelled = (np.cumsum(used) - 1)[ids[at]], [np.flatnonzero(used)]
        for k in range(1, level):
            key, group = np.unique(group * v + ids[at + k], return_inverse=True)
            spelled = [s[key // v] for s in spelled] + [key % v]
        group *= v
        group += ids[at + level]
        del at
        pair, n = np.unique(group, return_counts=True)
        group, following = pair // v, pair % v
        columns = [words.take(pa.array(s)).cast(pa.large_string()) for s in spelled]
        prefixes = (pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if level > 1 else columns[0]).cast(pa.string())
        split = np.array([heavy.get(p, 1) for p in prefixes.to_pylist()]) if heavy else np.ones(len(prefixes), np.int64)
    part = (hashes[following] % split[group].astype(np.uint64)).astype(np.int64)
    order = np.lexsort((following, part, group))
    group, part, following, n = group[order], part[order], following[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(group) != 0) | (np.diff(part) != 0)]))
    offsets = pa.array(np.append(new, len(group)).astype(np.int32))
    nexts = words.take(pa.array(following)).cast(pa.string())
    return pa.RecordBatch.from_arrays([
        pa.array([lang], pa.string()).take(pa.array(np.zeros(len(new), np.int32))), prefixes.take(pa.array(group[new])),
        pa.array(part[new], pa.int32()), pa.ListArray.from_arrays(offsets, nexts),
        pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int64)))], schema=_STRIPE)


def _counted(level: int, filtered, heavy, parts: int, chunk: int):
    """Texts -> stripes of a level, counted per language in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = filtered.value if filtered is not None else (None, 0)
        split = heavy.value if heavy is not None else {}
        for batch in batches:
            texts = batch.column(0)
            langs = batch.column(1).dictionary_encode()
            where = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                held, size = [], 0
                rows = np.flatnonzero(where == i)
                for j, r in enumerate(rows.tolist()):
                    t = texts[r].as_buffer()
                    held.append(t)
                    size += t.size
                    if size >= chunk or j + 1 == len(rows):
                        made = _count(b"\n".join(held), lang, level, bitmap, bits, split.get(lang, {}), parts)
                        held, size = [], 0
                        if made is not None:
                            yield made
    return run


# --------------------------------------------------------------------------- merging
_MERGED_DDL = "lang string, prefix string, total long, next array<string>, n array<long>"
_MERGED = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("total", pa.int64()),
                     ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


def _merged(least: int):
    """Stripes sorted by key -> one per key, summed elementwise; entries under ``least`` are
    dropped after their sum has gone into ``total``. The last key of a batch may go on in the
    next one and is carried over."""

    def add(stripes: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
        keys = [stripes.column(c) for c in range(3)]
        change = np.zeros(stripes.num_rows, bool)
        for c in keys:
            change[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        run_of = np.cumsum(change)
        first = np.flatnonzero(np.concatenate([[True], change[1:]]))
        lists = stripes.column(3)
        entry_run = np.repeat(run_of, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = lists.flatten().dictionary_encode()
        v = max(len(coded.dictionary), 1)
        key = entry_run * v + coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(key, kind="stable")
        key = key[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(stripes.column(4).flatten().to_numpy(zero_copy_only=False)[order], at) if len(at) else np.empty(0, np.int64)
        runs, following = key[at] // v, key[at] % v
        offsets = np.searchsorted(runs, np.arange(len(first) + 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [*[c.take(pa.array(first)) for c in keys],
             pa.ListArray.from_arrays(pa.array(offsets), coded.dictionary.take(pa.array(following))),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(n))], schema=_STRIPE), runs, n

    def done(stripes: pa.RecordBatch, runs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        rows = stripes.num_rows
        keep = n >= least
        total = np.zeros(rows, np.int64)
        np.add.at(total, runs, n)
        offsets = pa.array(np.searchsorted(runs[keep], np.arange(rows + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([
            stripes.column(0), stripes.column(1), pa.array(total),
            pa.ListArray.from_arrays(offsets, stripes.column(3).flatten().filter(pa.array(keep))),
            pa.ListArray.from_arrays(offsets, pa.array(n[keep]))], schema=_MERGED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns, _STRIPE)], schema=_STRIPE)
            if carried is not None:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
            made, runs, n = add(batch)
            last = made.num_rows - 1
            if last:
                yield done(made.slice(0, last), runs[runs < last], n[runs < last])
            carried = made.take(pa.array([last]))    # a copy, so that the batch itself can go
        if carried is not None:
            made, runs, n = add(carried)
            yield done(made, runs, n)
    return run


# --------------------------------------------------------------------------- between levels
def _bitmap(frequent: DataFrame, rows: int):
    """``(lang, phrase)`` as a bitmap of phrase hashes: (64-bit slots, number of bits as a power of two)."""
    bits = min(max(int(16 * rows).bit_length(), 10), FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = np.zeros(1, np.uint64)
                for w in _word_hashes(phrase.encode().split(b" "), lang):
                    h = _mixed(h, w)
                at.append(_slots(h, bits))
            at = np.unique(np.concatenate(at)) if at else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(at & 63)], names=["slot", "bit"])

    held = (frequent.select("lang", "phrase").mapInArrow(run, "slot long, bit long")
            .groupBy("slot").agg(F.bit_or(F.expr("shiftleft(1L, cast(bit as int))")).alias("w")).toArrow())
    bitmap = np.zeros(1 << max(bits - 6, 0), np.uint64)
    bitmap[held.column("slot").to_numpy()] = held.column("w").to_numpy().view(np.uint64)
    return frequent.sparkSession.sparkContext.broadcast((bitmap, bits))


def _heavy(frequent: DataFrame, words: int, partitions: int):
    """Phrases with more than an eighth of a partition's share of all words -> their number of parts."""
    share = max(words / (8 * partitions), 1.0)
    out: dict[str, dict] = {}
    for r in frequent.where(F.col("f") > share).select("lang", "phrase", F.ceil(F.col("f") / share).alias("parts")).collect():
        out.setdefault(r.lang, {})[r.phrase] = min(int(r.parts), partitions)
    return frequent.sparkSession.sparkContext.broadcast(out)


def stripes(docs: DataFrame, least: int, longest: int, chunk: int = CHUNK) -> list[DataFrame]:
    """Merged stripes of levels 0 to ``longest - 1``: ``lang, prefix, total, next, n`` (entries of
    ``least`` and more; ``total`` is the sum of what was counted, at level 0 of all words)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"),
                        F.coalesce(F.col("lang"), F.lit("und")).alias("lang"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    levels, words, filtered, heavy = [], 0, None, None
    for level in range(longest):
        counted = texts.mapInArrow(_counted(level, filtered, heavy, partitions, chunk), _STRIPE_DDL)
        merged = (counted.repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
                  .mapInArrow(_merged(least), _MERGED_DDL))
        levels.append(written(merged, "phrase-stripes"))
        if level == 0:
            words = levels[0].agg(F.sum("total")).first()[0] or 0
        frequent = entries(levels[-1])
        rows = frequent.count()
        if not rows or level + 1 == longest:
            break
        filtered, heavy = _bitmap(frequent, rows), _heavy(frequent, words, partitions)
    return levels


def entries(level: DataFrame) -> DataFrame:
    """Stripes -> ``lang, prefix, phrase, f``, one row per entry."""
    return (level.select("lang", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
            .select("lang", "prefix", F.when(F.col("prefix") == "", F.col("e.next"))
                    .otherwise(F.concat("prefix", F.lit(" "), "e.next")).alias("phrase"), F.col("e.n").alias("f")))


# --------------------------------------------------------------------------- collocations
def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(24,0)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000,
                 scale: int = 2_000_000, inside_pct: int = 80, chunk: int = CHUNK) -> DataFrame:
    """``(text, lang, ...)`` -> each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and into words at
    blanks and tabs. A phrase of 2 to ``longest`` words inside a piece with ``a >= least``
    occurrences is scored ``floor(scale * a / (l + r))`` at each cut, ``l`` and ``r`` the counts
    of the parts; the lowest cut counts (ties: the first). A phrase goes if a longer one around
    it has at least ``inside_pct`` percent of its occurrences. Ties in score: more occurrences
    first, then the phrase in byte order. ``n`` is the number of words of the language.

    Null texts are empty, a null lang is ``und``; repeated rows count every time; other columns
    are ignored, whatever their names; texts of any length are counted whole; an empty table gives
    no rows. Counts are 64-bit, products decimals of 38 digits.
    """
    levels = stripes(docs, least, longest, chunk)
    known = [entries(x) for x in levels]
    words = levels[0].groupBy("lang").agg(F.sum("total").alias("n"))
    counts = known[0]
    for k in known[1:]:
        counts = counts.unionByName(k)
    counts = written(counts.select("lang", "phrase", "f", F.size(F.split("phrase", " ")).alias("m")), "phrase-counts")
    found = counts.where("m > 1")

    # what surrounds a phrase: the largest entry of its own stripe, and of those that end in it
    longer = found.where("m > 2")
    around = (longer.select("lang", F.expr("substring_index(phrase, ' ', m - 1)").alias("phrase"), "f")
              .unionByName(longer.select("lang", F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("phrase"), "f"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("most")))
    kept = (found.join(around, ["lang", "phrase"], "left")
            .where(F.col("most").isNull() | (_wide("most") * 100 < _wide("f") * inside_pct)))
    kept = written(kept.select("lang", "phrase", F.col("f").alias("a"), "m"), "phrase-kept")

    # both parts of every cut, looked up in one join
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    sides = cuts.select("lang", "phrase", "a", "k", F.posexplode(F.expr(
        "array(substring_index(phrase, ' ', k), substring_index(phrase, ' ', k - m))")).alias("side", "part"))
    shorter = counts.where(F.col("m") < longest).select("lang", F.col("phrase").alias("part"), "f")
    both = sides.join(sized_broadcast(shorter, shorter.count()), ["lang", "part"])
    per_cut = both.groupBy("lang", "phrase", "a", "k").agg(*[
        F.max(F.when(F.col("side") == side, F.col("f"))).alias(name) for side, name in ((0, "l"), (1, "r"))])
    score = F.expr(f"(CAST(a AS DECIMAL(24,0)) * {scale}BD) div (CAST(l AS DECIMAL(24,0)) + CAST(r AS DECIMAL(24,0)))")
    best = (per_cut.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
            .groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")))
    w = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
    return (ranked.join(words, "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
