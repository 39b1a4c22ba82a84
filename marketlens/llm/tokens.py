"""Token ids of whole texts, as a tokenizer file of the ``tokenizers`` library gives them.

``WordEncoder`` serves tokenizers that drop white space before they split (the
file's normalizer and pre-tokenizer are read to make sure): the ids of a text
are then those of its white-space separated chunks. Chunks are found and numbered in
arrays, some megabytes of text at a time. A worker remembers chunks that come more than
once, up to a bound; the others are encoded once per batch, those of plain letters many in
one text, cut apart again after the ids that end a word.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

_KEPT = 1_200_000   # distinct keys remembered by a worker before it starts anew: bounds its memory


class Lexicon:
    """Keys with their ids, in one array; many keys are looked up and put together at once."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict = {}
        self.ids = np.empty(1 << 20, np.uint32)
        self.at = np.zeros(1 << 16, np.int64)      # key -> where its ids start
        self.n = np.zeros(1 << 16, np.int64)       # key -> how many ids
        self.used = 0

    def add(self, keys: list, ids: list) -> None:
        """Add new keys with a list of ids each."""
        k, n = len(self.index), np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))
        self.index.update(zip(keys, range(k, k + len(keys))))
        while k + len(keys) > len(self.at):
            self.at, self.n = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.at, self.n))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(len(self.ids), np.uint32)])
        self.at[k:k + len(keys)] = self.used + np.cumsum(n) - n
        self.n[k:k + len(keys)] = n
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def get(self, key) -> np.ndarray:
        k = self.index[key]
        return self.ids[self.at[k]:self.at[k] + self.n[k]]

    def join(self, texts: list[list], learn) -> list[np.ndarray]:
        """For each list of keys the ids of all of them in a row; ``learn`` gets the unknown keys, to add them."""
        if len(self.index) > _KEPT:
            self.clear()
        get = self.index.get
        found = [[get(c, -1) for c in keys] for keys in texts]
        new = {c for keys, f in zip(texts, found) if -1 in f for c, k in zip(keys, f) if k < 0}
        if new:
            learn(new)
            found = [[self.index[c] for c in keys] if -1 in f else f for keys, f in zip(texts, found)]
        out = []
        for f in found:
            k = np.array(f, np.int64)
            out.append(ragged(self.ids, self.at[k], self.n[k]))
        return out


def portions(values: list, most: int = 1 << 21):
    """Consecutive runs of texts of about ``most`` characters or bytes together: bounds what is split at a time."""
    held, size = [], 0
    for v in values:
        held.append(v)
        size += len(v or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def ragged(values: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``values[at[i]:at[i] + n[i]]`` of all i in a row."""
    ends = np.cumsum(n)
    return values[np.repeat(at - (ends - n), n) + np.arange(int(ends[-1]) if len(n) else 0)]


_SIGN = np.isin(np.arange(256), list(b",.;:!?"))
_REMEMBERED = 200_000      # chunks a worker remembers, some 40 MB
_PORTION = 8 << 20          # bytes of text split and numbered at a time (one longer text: at once)
_TOGETHER = 1_000           # chunks encoded as one text


class WordEncoder:
    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.by_chunk = (steps == ["NFC", "Replace", "Lowercase"] and len(split) == 2 and split[0]["type"] == "Split"
                         and split[0]["behavior"] == "Removed" and split[0]["invert"]
                         and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
                         and not any(len(t.split()) > 1 for t in self.added))
        suffix = spec["model"].get("end_of_word_suffix")
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.index: dict[bytes, int] = {}                              # remembered chunk -> place
        self.ids, self.n = np.empty(0, np.uint32), np.empty(0, np.int64)

    def _each(self, chunks: list[bytes]) -> list[np.ndarray]:
        found = self.lib.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _encode_chunks(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks in some order, and for each chunk where its ids start and how many there are."""
        # one word each: letters that lower-casing and composing leave one letter each
        plain = np.array([c.isalpha() or (s := c.decode()).isalpha() and max(s) < "\u0100" for c in chunks], bool)
        ids, n = [], np.zeros(len(chunks), np.int64)
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        words = [chunks[i] for i in np.flatnonzero(plain)]
        done = []
        for i in range(0, len(words), _TOGETHER * 64):
            groups = [words[j:j + _TOGETHER] for j in range(i, min(i + _TOGETHER * 64, len(words)), _TOGETHER)]
            for group, e in zip(groups, self.lib.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
                found = np.array(e.ids, np.uint32)
                ends = np.flatnonzero(self.ends_word[found]) + 1
                if len(ends) == len(group) and ends[-1] == len(found):
                    ids.append(found)
                    done.append(np.diff(ends, prepend=0))
                else:      # not cut where words end: one by one
                    each = self._each(group)
                    ids += each
                    done.append(np.array([len(x) for x in each]))
        for i in range(0, len(chunks) - len(words), 20_000):
            each = self._each([chunks[k] for k in order[len(words) + i:len(words) + i + 20_000]])
            ids += each
            done.append(np.array([len(x) for x in each]))
        n[order] = np.concatenate(done) if done else 0
        at = np.empty(len(chunks), np.int64)
        at[order] = np.cumsum(n[order]) - n[order]
        return (np.concatenate(ids) if ids else np.empty(0, np.uint32)), np.stack([at, n])

    def _lowered(self, text: bytes | None) -> bytes:
        # lower-casing A-Z first makes fewer chunks; not where it could make an added token appear,
        # nor before combining marks (U+0300..U+036F), which may compose with one case only
        low = (text or b"").lower()
        if low and (b"\xcc" in text or b"\xcd" in text or any(t in low for t in self.added)):
            return text
        return low

    def _split(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Distinct chunks, the number of each chunk of the texts, and where each text's chunks start. A
        word of Latin-1 letters before a sign of punctuation is that word, then the sign."""
        lowered = [self._lowered(t) for t in texts]
        a = np.frombuffer(b"\n".join(lowered), np.uint8)
        starts = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        inside = (a != 32) & ((a < 9) | (a > 13))
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        first, length = edge[::2], edge[1::2] - edge[::2]
        if not len(first):
            return [], np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        bounds = np.searchsorted(first, starts)
        offsets = np.concatenate([[0], np.cumsum(length)])
        a = a[inside]
        letters = (a | 32) - 97 < 26
        lead = a == 0xC3           # U+00C0 to U+00FF: letters but for the signs of multiplication and division
        tail = np.flatnonzero(lead[:-1]) + 1
        letters[tail] = (a[tail] != 0x97) & (a[tail] != 0xB7)
        letters = (letters | lead).view(np.int8)
        marked = np.flatnonzero((length > 1) & _SIGN[a[offsets[1:] - 1]]
                                & (np.add.reduceat(letters, offsets[:-1], dtype=np.int32) == length - 1))
        offsets = np.insert(offsets, marked + 1, offsets[marked + 1] - 1)
        bounds += np.searchsorted(marked, bounds)
        coded = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(a)]).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), bounds

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of UTF-8 texts (null: none), without special tokens added."""
        if not self.by_chunk:
            return self._each([t or b"" for t in texts])
        known, new, parts, times = len(self.n), {}, [], []
        for part in portions(texts, _PORTION):
            chunks, code, bounds = self._split(part)
            place = np.fromiter((known + new.setdefault(c, len(new)) if (k := self.index.get(c)) is None else k for c in chunks),
                                np.int64, len(chunks))
            parts.append((place.astype(np.int32)[code], bounds))
            times.append((place, np.bincount(code, minlength=len(chunks))))
        count = np.zeros(known + len(new), np.int64)
        for place, n in times:
            count[place] += n
        new = list(new)
        flat, (at, n) = self._encode_chunks(new)
        values = np.concatenate([self.ids, flat])
        where = np.concatenate([np.cumsum(self.n) - self.n, len(self.ids) + at])
        many = np.concatenate([self.n, n])
        out = []
        for code, bounds in parts:
            ids = ragged(values, where[code], many[code])
            ends = np.concatenate([[0], np.cumsum(many[code])])[bounds]
            out += [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        keep = np.flatnonzero(count[known:] > 1)[:max(_REMEMBERED - known, 0)]
        if len(keep):
            self.index.update(zip((new[k] for k in keep), range(known, known + len(keep))))
            self.ids = np.concatenate([self.ids, ragged(flat, at[keep], n[keep])])
            self.n = np.concatenate([self.n, n[keep]])
        return out


# a task has one core: the library's own threads would only add memory
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file (made once per process)."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
