"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, derived from its code point
alone. An n-gram's vector binds its letters' vectors, each rotated by its
place (elementwise product); a text's vector bundles (sums) those of all its
n-grams; a language's prototype bundles the unit vectors of all its training
texts. A text is of the language whose prototype has the largest cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from marketlens.llm.common import columns_beside

DIM, N, SEED = 1024, 3, 20
UNIT = 1 << 20          # unit vectors are rounded to this, so that sums do not depend on their order
MAX_LANGUAGES = 10_000  # prototypes come to the driver: 8 KB each
_KNOWN = 20_000         # n-gram vectors remembered by a worker


class Profiler:
    """Vectors of texts; n-gram vectors are made once and kept."""

    def __init__(self) -> None:
        low = [chr(c).lower()[:1] if chr(c).isalpha() else "" for c in range(1 << 16)]
        self.letter = np.array([ord(c) if c else 0 for c in low], np.int64)   # code point -> small letter, else 0
        self.vectors: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.codes = np.empty(0, np.int64)      # known n-grams, ascending, and their rows
        self.rows = np.empty(0, np.int64)
        self.grams = np.empty((0, DIM), np.float32)

    def _letter_vector(self, cp: int) -> np.ndarray:
        if cp not in self.vectors:
            self.vectors[cp] = (np.random.Generator(np.random.PCG64([SEED, cp])).integers(0, 2, DIM) * 2 - 1).astype(np.float32)
        return self.vectors[cp]

    def _learn(self, codes: np.ndarray) -> None:
        new = np.setdiff1d(codes, self.codes)
        if len(new):
            made = np.empty((len(new), DIM), np.float32)
            for row, code in zip(made, new.tolist()):
                row[:] = 1
                for place in range(N):
                    row *= np.roll(self._letter_vector(code >> 21 * place & 0x1FFFFF), place)
            codes, rows = np.concatenate([self.codes, new]), np.concatenate([self.rows, len(self.grams) + np.arange(len(new))])
            order = np.argsort(codes)
            self.codes, self.rows = codes[order], rows[order]
            self.grams = np.concatenate([self.grams, made])

    def ngrams(self, text: str | None) -> np.ndarray:
        """Codes of the letter n-grams; a run of other characters is one boundary, as are both ends."""
        cps = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
        x = self.letter[np.minimum(cps, 0xFFFF)]
        for i in np.flatnonzero(cps > 0xFFFF):
            x[i] = ord(chr(cps[i]).lower()[:1]) if chr(cps[i]).isalpha() else 0
        x = np.concatenate([[0], x, [0]])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        if not x.any():
            return np.empty(0, np.int64)
        x = x if x[-1] == 0 else np.append(x, 0)
        return sum(x[N - 1 - place:len(x) - place] << 21 * place for place in range(N))

    def vectors_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bundled vectors of texts, and which have any letter."""
        grams = [self.ngrams(t) for t in texts]
        some = np.array([len(g) > 0 for g in grams], bool)
        every = np.concatenate(grams)
        if not len(every):
            return np.zeros((len(texts), DIM), np.float32), some
        codes, place = np.unique(every, return_inverse=True)
        if len(codes) > _KNOWN:    # many scripts at once: vectors of these n-grams only, in portions
            out = np.zeros((len(texts), DIM), np.float32)
            doc = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
            for i in range(0, len(codes), _KNOWN // 2):
                self._clear()
                here = (place >= i) & (place < i + _KNOWN // 2)
                self._learn(codes[i:i + _KNOWN // 2])
                out += self._count(doc[here], self._rows(codes, place[here]), len(texts)) @ self.grams
            self._clear()
            return out, some
        if len(self.codes) + len(codes) > 2 * _KNOWN:
            self._clear()
        self._learn(codes)
        doc = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
        return self._count(doc, self._rows(codes, place), len(texts)) @ self.grams, some

    def _rows(self, codes: np.ndarray, place: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return self.rows[at][place]

    def _count(self, doc: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        v = len(self.grams)
        return np.bincount(doc * v + rows, minlength=n * v).reshape(n, v).astype(np.float32)


_profiler: list[Profiler] = []


def profiler() -> Profiler:
    if not _profiler:
        _profiler.append(Profiler())
    return _profiler[0]


def _portions(texts: list) -> Iterator[tuple[int, int]]:
    """Stretches of at most 64 texts and about 500,000 characters."""
    i = size = 0
    for j, t in enumerate(texts):
        if j > i and (j - i >= 64 or size > 500_000):
            yield i, j
            i, size = j, 0
        size += len(t or "")
    if i < len(texts):
        yield i, len(texts)


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training texts of one task -> one summed vector per language."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, j in _portions(texts):
            v, some = profiler().vectors_of(texts[i:j])
            norm = np.linalg.norm(v.astype(np.float64), axis=1)
            units = np.rint(v / np.maximum(norm, 1e-12)[:, None] * UNIT).astype(np.int64)
            for k in np.flatnonzero(some).tolist():
                sums[langs[i + k]] = sums.get(langs[i + k], 0) + units[k]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))],
                                     names=["lang", "v"])


def learn(training: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes from every row of ``(lang, text)`` with a language and a letter: unit vectors by language."""
    sums = (training.where("lang is not null and text is not null").select("lang", "text")
            .mapInArrow(_bundle, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
            .groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang")
            .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x"))
    rows = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out = {}
    for lang, x in sorted(map(tuple, rows)):
        v = np.array(x, np.float64)
        if norm := np.linalg.norm(v):
            out[lang] = v / norm
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (cosine, 0 to 1) to documents, from their whole text alone.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned;
    ties go to the first language in order. Columns of these two names are replaced.
    """
    names = list(prototypes)
    matrix = np.array([prototypes[n] for n in names], np.float64).reshape(len(names), DIM).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            for i, j in _portions(texts) if names else ():
                v, some = profiler().vectors_of(texts[i:j])
                v = v.astype(np.float64)
                cos = v @ matrix / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                best = cos.argmax(1)
                for k in np.flatnonzero(some).tolist():
                    pred[i + k], score[i + k] = names[best[k]], float(min(max(cos[k, best[k]], 0.0), 1.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())],
                                             names=["row", "lang_pred", "score"])

    kept = columns_beside(docs, "lang_pred", "score")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(f"`{text}`").alias("text"))
    schema = StructType([d.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return d.mapInArrow(run, schema).select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "lang_pred", "score")


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the doc_id as text leaves 1 when divided by 3; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def evaluate(docs: DataFrame) -> DataFrame:
    """Learn from rows that are not held out (a null doc_id trains nothing), predict all:
    ``doc_id, held_out, lang_pred, score``. Repeated rows each count; empty table: no rows."""
    proto = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), proto).drop("text")
