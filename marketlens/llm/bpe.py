"""Byte-level BPE by speculation: propose by longest match, verify pairs, merge only what fails.

A sequence of tokens is the BPE encoding of its bytes exactly if every adjacent
pair is: merging the two tokens' bytes on their own gives back these two
tokens. So each distinct word is first cut greedily into the longest vocabulary
entries; then the adjacent pairs of all new words are looked up at once in a
table of known verdicts (each pair is merged exactly once per worker to learn
its verdict); only words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.tokens import Lexicon, portions, ragged

# The split pattern of byte-level BPE, with Unicode white space spelt out.
_SPACE = r"\t-\r \x85\xa0  -     　"
_SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+"
                       rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_LONG = 64   # words over this many bytes are not remembered


def _byte_chars() -> dict[str, int]:
    """Character that stands for each byte in the vocabulary file: itself where printable, else 256 onwards."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class SpeculativeBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if (spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space")
                or not pre.get("use_regex", True) or model.get("ignore_merges") or model.get("byte_fallback")):
            raise ValueError("not a plain byte-level BPE file")
        char = _byte_chars()
        raw = lambda token: bytes(char[c] for c in token)
        self.ids = {raw(t): i for t, i in model["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {(self.ids[raw(a)], self.ids[raw(b)]): (r, self.ids[raw(a + b)]) for r, (a, b) in enumerate(merges)}
        self.longest = max(map(len, self.ids))
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = [t for t in sorted(self.added, key=len, reverse=True)]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, plain)) + ")") if plain else None
        table = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        size = max(table) + 1
        self.lengths = np.array([len(table.get(i, b"")) for i in range(size)], np.int64)
        self.at = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        self.table = table
        self.fits: dict[int, bool] = {}      # (left << 32 | right) -> verdict
        self.whole: dict[int, bool] = {}     # token -> its bytes merge back to it
        self.words = Lexicon()

    def merge(self, word: bytes) -> list[int]:
        """Exact BPE: the pair of lowest rank first, the leftmost among equals (heap over a linked list)."""
        tok = [self.ids[word[i:i + 1]] for i in range(len(word))]
        n = len(tok)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(self.ranks[p][0], i) for i in range(n - 1) if (p := (tok[i], tok[i + 1])) in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = nxt[i] if tok[i] >= 0 else -1
            found = self.ranks.get((tok[i], tok[j])) if j >= 0 else None
            if found is None or found[0] != rank:
                continue   # one of the two has merged since
            tok[i], tok[j], nxt[i] = found[1], -1, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for a, b in ((prv[i], i), (i, nxt[i])):
                if a >= 0 and b >= 0 and (tok[a], tok[b]) in self.ranks:
                    heapq.heappush(heap, (self.ranks[tok[a], tok[b]][0], a))
        return [t for t in tok if t >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Longest vocabulary entry at each position."""
        out, at, n, ids = [], 0, len(word), self.ids
        while at < n:
            end = min(n, at + self.longest)
            while (t := ids.get(word[at:end])) is None:
                end -= 1
            out.append(t)
            at = end
        return out

    def _check(self, pairs: np.ndarray) -> np.ndarray:
        """Verdicts of pairs (left << 32 | right), unknown ones merged exactly."""
        distinct, back = np.unique(pairs, return_inverse=True)
        for p in distinct.tolist():
            if p not in self.fits:
                a, b = p >> 32, p & 0xFFFFFFFF
                self.fits[p] = self.merge(self.table[a] + self.table[b]) == [a, b]
        return np.array([self.fits[p] for p in distinct.tolist()], bool)[back]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Speculate over all words, verify all adjacent pairs at once, merge the failing words."""
        found = [self.propose(w) for w in words]
        n = np.array([len(f) for f in found], np.int64)
        flat = np.array([t for f in found for t in f], np.int64)
        word = np.repeat(np.arange(len(words)), n)
        fails = np.zeros(len(words), bool)
        inside = word[1:] == word[:-1]
        pairs = (flat[:-1] << 32 | flat[1:])[inside]
        if len(pairs):
            fails[word[1:][inside][~self._check(pairs)]] = True
        for k in np.flatnonzero(n == 1).tolist():
            t = found[k][0]
            if t not in self.whole:
                self.whole[t] = self.merge(words[k]) == [t]
            fails[k] = not self.whole[t]
        for k in np.flatnonzero(fails).tolist():
            found[k] = self.merge(words[k])
        if len(self.fits) > 4_000_000:   # verdicts remembered by a worker: bounds its memory
            self.fits.clear()
        return found

    def _learn(self, words: set[str]) -> None:
        words = list(words)
        self.words.add(words, self.encode_words([w.encode() for w in words]))

    def _ids(self, words: list[str]) -> np.ndarray:
        """Ids of one stretch of words; overlong ones are encoded on their own, the rest from memory."""
        if max(map(len, words), default=0) <= _LONG:
            return self.words.join([words], self._learn)[0]
        out = []
        for long, run in groupby(words, lambda w: len(w) > _LONG):
            run = list(run)
            out += ([np.array(x, np.uint32) for x in self.encode_words([w.encode() for w in run])] if long
                    else self.words.join([run], self._learn))
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of texts (null: none); added tokens that stand in a text get their own ids."""
        out = []
        for part in portions(texts):
            split = [_SPLIT.findall(t or "") for t in part]
            plain = [not any(t in (x or "") for t in self.added) and max(map(len, w), default=0) <= _LONG
                     for x, w in zip(part, split)]
            known = iter(self.words.join([w for w, p in zip(split, plain) if p], self._learn))
            out += [next(known) if p else self._with_added(x) for x, p in zip(part, plain)]
        return out

    def _with_added(self, text: str) -> np.ndarray:
        out = [np.empty(0, np.uint32)]
        for part in (self.cut.split(text) if self.cut else [text]):
            out.append(np.array([self.added[part]], np.uint32) if part in self.added else self._ids(_SPLIT.findall(part)))
        return np.concatenate(out)

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids: their bytes, malformed UTF-8 replaced."""
        ids = ids.astype(np.int64)
        return ragged(self.bytes, self.at[ids], self.lengths[ids]).tobytes().decode("utf-8", "replace")


_coders: dict[str, SpeculativeBpe] = {}


def coder(path: str) -> SpeculativeBpe:
    """The worker's coder for a vocabulary file (made once per process)."""
    if path not in _coders:
        _coders[path] = SpeculativeBpe(path)
    return _coders[path]


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            ids = [x.astype(np.int64) for x in bpe.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))],
                                             names=["doc_id", "ids"])
    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, ids array<long>``; null or empty text: no ids."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _ids(path), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids)`` -> ``doc_id, text``; null ids: empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            texts = [bpe.decode(np.array(x.as_py() or [], np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every whole text in one pass: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
    Repeated rows and null doc_ids stay as they are; empty table: no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            n, a, b = [], [], []
            for ids in bpe.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                b.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
