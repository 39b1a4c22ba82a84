"""Token files: ids of whole documents in ascending doc_id order, boundaries Elias-Fano coded.

A file is a Parquet file of blocks. A block holds the concatenated ids of
consecutive documents (little-endian, 2 bytes each where the vocabulary allows)
and two Elias-Fano sequences: the documents' ends within the block, and their
doc_ids. Elias-Fano stores n ascending numbers below u in about 2 + log2(u / n)
bits each; sampled positions of the high part give ``select(i)`` without a
table of 64-bit offsets.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm.tokens import encoder

SAMPLE = 64            # every 64th high position is kept for select
SELECTED = 4096        # ends selected at a time when documents are read
BLOCK_IDS = 1 << 20    # ids after which a block ends (a document is never cut)


#: Byte and k -> position of its k-th set bit.
_ONE_OF_BYTE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = [b for b in range(8) if _byte >> b & 1]
    _ONE_OF_BYTE[_byte, :len(_set)] = _set


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        u = int(v[-1]) + 1 if n else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        low = v & np.uint64((1 << bits) - 1)
        lows = (low[:, None] >> np.arange(bits, dtype=np.uint64)).astype(np.uint8) & 1
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        ones[at] = 1
        return cls(n, bits, np.packbits(lows.ravel(), bitorder="little"), np.packbits(ones, bitorder="little"),
                   at[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return (struct.pack("<QBII", self.n, self.low_bits, len(self.low), len(self.high))
                + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes())

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, a, b = struct.unpack_from("<QBII", data)
        at = struct.calcsize("<QBII")
        raw = np.frombuffer(data, np.uint8)
        return cls(n, bits, raw[at:at + a], raw[at + a:at + a + b], np.frombuffer(data, "<u4", offset=at + a + b))

    def _lows(self, i: int, j: int) -> np.ndarray:
        first, last = i * self.low_bits, j * self.low_bits
        bits = np.unpackbits(self.low[first // 8:(last + 7) // 8], bitorder="little")
        bits = bits[first % 8:first % 8 + last - first].reshape(j - i, self.low_bits).astype(np.uint64)
        return (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(1, dtype=np.uint64)

    def select(self, i: int) -> int:
        """The i-th number: the sampled position before it, then the ones after that."""
        at = int(self.samples[i // SAMPLE])
        rest, byte = i % SAMPLE, at // 8
        bits = self.high[byte:byte + 1] & np.uint8(0xFF << at % 8 & 0xFF)
        while (ones := int(np.bitwise_count(bits)[0])) <= rest:
            rest, byte = rest - ones, byte + 1
            bits = self.high[byte:byte + 1]
        pos = byte * 8 + int(np.flatnonzero(np.unpackbits(bits, bitorder="little"))[rest])
        return (pos - i) << self.low_bits | int(self._lows(i, i + 1)[0])

    def select_many(self, at: np.ndarray) -> np.ndarray:
        """The numbers at many places: each sampled position bounds the bytes that a place's one can be in."""
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)])
        first = self.samples[at // SAMPLE].astype(np.int64) // 8
        beyond = np.append(self.samples[1:].astype(np.int64) // 8, len(self.high) - 1)[at // SAMPLE]
        while (wide := first < beyond).any():      # the byte that holds one number at + 1
            middle = (first + beyond) // 2
            later = ones[middle + 1] <= at
            first, beyond = np.where(wide & later, middle + 1, first), np.where(wide & ~later, middle, beyond)
        pos = first * 8 + _ONE_OF_BYTE[self.high[first], at - ones[first]]
        low = np.zeros(len(at), np.uint64)
        for b in range(self.low_bits):
            bit = at * self.low_bits + b
            low |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
        return ((pos - at).astype(np.uint64) << np.uint64(self.low_bits)) | low

    def all(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return ((at - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | self._lows(0, self.n)


# --------------------------------------------------------------------------- writing
def _encode(path: str, end_id: int | None, width: int, bounds: list[int]):
    """Documents -> their range bucket (the number of bounds below doc_id; 0 without one) and ids."""
    cuts = np.array(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), [] if end_id is None else [end_id]
        for batch in batches:
            ids = [np.concatenate([x, end]).astype(f"<u{width}").tobytes() for x in enc.encode(batch.column(1).to_pylist())]
            doc = batch.column(0)
            bucket = np.searchsorted(cuts, doc.fill_null(0).to_numpy(zero_copy_only=False), side="left").astype(np.int32)
            bucket[doc.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays([pa.array(bucket), doc, pa.array(ids, pa.binary())], names=["bucket", "doc_id", "ids"])
    return run


_BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("docs", pa.int64()), ("nulls", pa.int64()),
                    ("total", pa.int64()), ("width", pa.int32()), ("base", pa.int64()), ("doc_ids", pa.binary()),
                    ("ends", pa.binary()), ("ids", pa.binary())])
_BLOCK_DDL = ("bucket int, block int, docs long, nulls long, total long, width int, base long, doc_ids binary, "
              "ends binary, ids binary")


def _blocks(width: int):
    """Documents sorted by (bucket, doc_id) -> blocks, each within one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, block, held, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            known = np.array([d for d, _ in held if d is not None], np.int64)
            base = int(known[0]) if len(known) else 0
            lengths = np.array([len(x) // width for _, x in held], np.int64)
            row = {"bucket": bucket, "block": block, "docs": len(held), "nulls": len(held) - len(known),
                   "total": int(lengths.sum()), "width": width, "base": base,
                   "doc_ids": EliasFano.encode(known.astype(np.uint64) - np.int64(base).astype(np.uint64)).to_bytes(),
                   "ends": EliasFano.encode(np.cumsum(lengths)).to_bytes(), "ids": b"".join(x for _, x in held)}
            return pa.RecordBatch.from_pylist([row], _BLOCK)

        for batch in batches:
            buckets, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for b, d, x in zip(buckets, docs, batch.column(2)):
                if held and (b != bucket or size >= BLOCK_IDS * width):
                    yield flush()
                    block, held, size = block + 1 if b == bucket else 0, [], 0
                bucket = b
                held.append((d, x.as_py()))
                size += len(held[-1][1])
        if held:
            yield flush()
    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> str:
    """Encode ``docs(doc_id, text)`` whole and write the token files under ``path``.

    Null text: only the end id. Null doc_ids come first; rows with equal doc_id are
    ordered by their ids. Other columns are ignored, whatever their names; a text of any
    length is encoded whole and lies in one block; an empty table gives no blocks. The order is made by range buckets whose bounds come from
    doc_ids alone, so texts are encoded once.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], max(10_000, 10 * n))).first()[0]
    bounds = sorted(set(cuts or []))
    width = 2 if max(encoder(tokenizer).lib.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
    (docs.mapInArrow(_encode(tokenizer, end_id, width, bounds), "bucket int, doc_id long, ids binary")
     .repartitionById(len(bounds) + 1, F.col("bucket"))
     .sortWithinPartitions("bucket", "doc_id", "ids")
     .mapInArrow(_blocks(width), _BLOCK_DDL)
     .write.option("compression", "zstd").parquet(path))
    return path


# --------------------------------------------------------------------------- reading
def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            coded, n = EliasFano.from_bytes(row["ends"]), row["docs"]
            ends = (np.concatenate([coded.select_many(np.arange(i, min(i + SELECTED, n))) for i in range(0, n, SELECTED)])
                    .astype(np.int64))
            ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
            docs = EliasFano.from_bytes(row["doc_ids"]).all() + np.int64(row["base"]).astype(np.uint64)
            starts = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays([
                pa.array([row["bucket"]] * len(ends), pa.int32()), pa.array([row["block"]] * len(ends), pa.int32()),
                pa.array([None] * row["nulls"] + docs.astype(np.int64).tolist(), pa.int64()), pa.array(starts, pa.int64()),
                pa.array(ends - starts, pa.int64()),
                pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)], pa.int64())],
                names=["bucket", "block", "doc_id", "rel", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the token files: ``doc_id, start, n_tokens, ids_crc32``, ``start`` the
    number of ids before it in all files. Empty files: no rows."""
    files = spark.read.parquet(path)
    sizes = files.groupBy("bucket").agg(F.sum("total").alias("t"))
    before = sizes.selectExpr("bucket", "sum(t) over (order by bucket) - t as before")   # a row per bucket
    inside = files.select("bucket", "block", "total").selectExpr(
        "bucket", "block", "sum(total) over (partition by bucket order by block) - total as inside")
    starts = inside.join(before, "bucket").selectExpr("bucket", "block", "before + inside as first")
    docs = files.mapInArrow(_documents, "bucket int, block int, doc_id long, rel long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["bucket", "block"]).selectExpr(
        "doc_id", "first + rel as start", "n_tokens", "ids_crc32")


def document_ids(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents, ``doc_id, ids array<long>``: blocks are narrowed by doc_id,
    and each document's bounds come from ``select``."""
    wanted = sorted({int(d) for d in doc_ids})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = EliasFano.from_bytes(row["doc_ids"]).all().astype(np.int64) + row["base"]
                ends, ids = EliasFano.from_bytes(row["ends"]), np.frombuffer(row["ids"], f"<u{row['width']}")
                for i in np.flatnonzero(np.isin(known, wanted)):
                    k = int(i) + row["nulls"]
                    a, b = ends.select(k - 1) if k else 0, ends.select(k)
                    yield pa.RecordBatch.from_pylist([{"doc_id": int(known[i]), "ids": ids[a:b].tolist()}],
                                                     pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]))

    files = spark.read.parquet(path).where(F.col("base") <= (wanted[-1] if wanted else 0))
    return files.mapInArrow(run, "doc_id long, ids array<long>")
