"""Bounded-space online packing of token ids into sequences.

Every task keeps at most ``windows`` open sequences while it reads its
documents. A document's full-length stretches become sequences of their own;
what remains goes into the open window that it fits best. When none fits, the
fullest is closed: filled up with the head of the document if the gap is worth
a cut, padded otherwise. The windows left open at the end are merged over
groups of 16 tasks at a time, piece by piece, until one group is left, so no
task ever sees more than 16 * ``windows`` windows.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import written
from marketlens.llm.tokens import encoder

MERGE = 16
_PIECE_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, src long, closed boolean")
_NAMES = [c.split()[0] for c in _PIECE_DDL.split(", ")]
_SCHEMA = pa.schema([(n, pa.bool_() if n == "closed" else pa.int64()) for n in _NAMES])


class _Windows:
    """Open windows, ordered by free space; closed ones get a sequence id."""

    def __init__(self, size: int, most: int, first_id: int):
        self.size, self.most, self.next = size, most, first_id
        self.open: list[tuple[int, int, list]] = []   # (free, age, pieces), ascending
        self.age = 0

    def _push(self, free: int, pieces: list) -> None:
        self.age += 1
        bisect.insort(self.open, (free, self.age, pieces))

    def fit(self, length: int, piece) -> bool:
        """Put a piece into the fullest window that still has room for it, or a new one."""
        k = bisect.bisect_left(self.open, (length,))
        if k < len(self.open):
            free, _, pieces = self.open.pop(k)
            pieces.append(piece)
            self._push(free - length, pieces)
        elif len(self.open) < self.most:
            self._push(self.size - length, [piece])
        else:
            return False
        return True

    def close(self, pieces: list) -> Iterator[tuple]:
        at = 0
        for piece in pieces:
            yield (*piece, self.next, at)
            at += piece[2]
        self.next += 1


def _pack(tokenizer: str, end_id: int, size: int, windows: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        w = _Windows(size, windows, part << 32)
        out: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist())):
                ids = np.append(ids, end_id).astype("<u4")
                n, at = len(ids), 0

                def piece(length: int) -> tuple:
                    return doc, at, length, zlib.crc32(ids[at:at + length]), n

                while n - at >= size:
                    out += [(*p, part, True) for p in w.close([piece(size)])]
                    at += size
                while at < n:
                    if w.fit(n - at, piece(n - at)):
                        break
                    free, _, pieces = w.open.pop(0)
                    if free >= min_cut:
                        pieces.append(piece(free))
                        at += free
                    out += [(*p, part, True) for p in w.close(pieces)]
            yield flush(out)
            out = []
        for _, _, pieces in w.open:
            out += [(*p, part, False) for p in w.close(pieces)]
        yield flush(out)
    return run


def _merge(level: int, size: int, windows: int, last: bool):
    """Pieces of the open windows of some tasks, largest first, best fit; the fullest are
    closed until at most ``windows`` stay open (none, in the last group)."""

    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        w = _Windows(size, len(rows), (level << 58) + (int(key[0]) << 32))
        rows = rows.sort_values(["length", "doc_id", "start", "sequence_id", "offset"],
                                ascending=[False, True, True, True, True], kind="stable")
        cols = [rows[c].tolist() for c in ("start", "length", "ids_crc32", "doc_tokens")]
        docs = [None if pd.isna(d) else int(d) for d in rows["doc_id"]]
        for doc, start, length, crc, n in zip(docs, *cols):
            w.fit(length, (doc, start, length, crc, n))
        stay = 0 if last else windows
        out = []
        for k, (_, _, pieces) in enumerate(w.open):
            out += [(*p, int(key[0]), k < len(w.open) - stay) for p in w.close(pieces)]
        return pd.DataFrame(out, columns=_NAMES).astype({"doc_id": "Int64"})
    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = 4096, windows: int = 64,
         min_cut: int = 32) -> DataFrame:
    """``docs(doc_id, text)`` -> pieces: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every id of every document (its text's ids, then ``end_id``) is in exactly one piece.
    Null text: the end id alone. Repeated rows are packed each; a null doc_id stays null.
    Empty table: no rows. Other columns are ignored, whatever their names; a text of any
    length is encoded whole and cut at full sequences. A sequence ends short of ``size`` by less than ``min_cut``,
    save the last ones of the merge.
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    pieces = written(src.mapInArrow(_pack(tokenizer, end_id, size, windows, min_cut), _PIECE_DDL), "packing-pieces")
    done, open_ = pieces.where("closed"), pieces.where("not closed")
    level, groups = 1, open_.agg(F.max("src")).first()[0]
    while groups is not None:
        groups //= MERGE
        # doc_id is an integer column with nulls, which pandas would turn into a double: it travels as text
        merged = written(open_.withColumn("doc_id", F.col("doc_id").cast("string"))
                         .groupBy((F.col("src") / MERGE).cast("long").alias("g"))
                         .applyInPandas(_merge(level, size, windows, groups == 0), _PIECE_DDL), "packing-merged")
        done = done.unionByName(merged.where("closed"))
        if groups == 0:
            break
        open_, level = merged.where("not closed"), level + 1
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
