"""Byte-level BPE with word ends, over chunks of text between ASCII white space.

All steps of the tokenizer act within such a chunk (normalisation, added tokens,
splitting, merges), so a text's tokens are those of its chunks in order.  A
worker keeps the values of the chunks it met, bounded in number; each distinct
chunk is split once, each distinct pre-token merged once.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex

MOST_CHUNKS = 600_000  # held by a worker, about 90 MB, then started anew
MOST_WORDS = 400_000  # about 60 MB
LONG = 64  # bytes; longer chunks and pre-tokens are not held
_NONE = np.int32(2**31 - 1)


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte, as byte-level vocabularies write it."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file: symbols of bytes, ranks of pairs, added tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        chars = _byte_chars()
        self.bytes_of = {c: b for b, c in enumerate(chars)}
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        size = max(vocab.values()) + 1
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        if len(np.unique(made)) != len(made):
            raise ValueError("a token with two merges: ranks may be applied out of order")
        self.size, self.made = size, made
        self._hash_pairs(key)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.split_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.tokens: list[bytes] = [b""] * (max(size, *(i + 1 for i in added.values())) if added else size)
        for t, i in [*vocab.items(), *added.items()]:
            self.tokens[i] = t.encode()
        tok = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = tok.normalizer.normalize_str, tok.pre_tokenizer.pre_tokenize_str
        self.added_lead = {t[0] for t in added}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # for Latin letters this module and the tokenizer's agree on classes, and NFC changes nothing
        self.find = regex.compile(pattern + "| ").findall
        self.odd = re.compile("[\x1c-\x1f\x85\xa0ɐ-\U0010ffff]").search

    def split(self, chunks: list[bytes]) -> list[list]:
        """Pre-tokens of each chunk, an added token as its id."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        plain = [i for i, t in enumerate(texts) if not self.odd(t) and "<|" not in t]
        out: list = [None] * len(texts)
        # all plain chunks at once, the spaces between them found as well
        found, last = self.find(" ".join([texts[i] for i in plain]).lower()), 0
        at = [k for k, w in enumerate(found) if w == " "]
        for i, k in zip(plain, [*at, len(found)], strict=True) if plain else ():
            out[i] = found[last:k]
            last = k + 1
        for i, t in enumerate(texts):
            if out[i] is None:
                out[i] = self._split_odd(t)
        return out

    def _split_odd(self, text: str) -> list:
        """By the library's own normaliser and pre-tokeniser."""
        out: list = []
        for part in self.split_added.split(text) if self.split_added else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += [bytes(map(self.bytes_of.__getitem__, w)).decode("utf-8", "replace") for w, _ in self.pre_tokenize(self.normalize(part))]
        return out

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressed table from pair to rank, a sixteenth full at most."""
        bits = max(4, int(len(keys)).bit_length() + 3)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot_key, self.slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        rank, at = np.arange(len(keys)), self._slot(keys)
        while len(rank):
            free = np.flatnonzero(self.slot_key[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slot_key[at[put]], self.slot_rank[at[put]] = keys[rank[put]], rank[put]
            rest = np.ones(len(rank), bool)
            rest[put] = False
            rank, at = rank[rest], at[rest] + 1 & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = self._slot(key)
        held = self.slot_key[at]
        out = np.where(held == key, self.slot_rank[at], _NONE)
        more = np.flatnonzero((held != key) & (held != -1))
        at = at[more]
        while len(more):
            at = at + 1 & self.mask
            held = self.slot_key[at]
            hit = held == key[more]
            out[more[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (held != -1)
            more, at = more[on], at[on]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and the offsets of each word's ids.

        The symbols of all words lie in one array.  A round finds the lowest
        rank of each word's adjacent pairs and applies it at all its places at
        once, left to right where places overlap.  As each token is made by one
        merge, all merges of a pair precede those that use its token, so this equals
        merging one pair at a time.
        """
        n = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym = self.inner[data]
        end = np.cumsum(n) - 1
        sym[end] = self.last[data[end]]
        word = np.repeat(np.arange(len(words)), n)
        done_w, done_s = [], []
        while len(sym):
            rank = np.full(len(sym), _NONE, np.int32)
            same = np.flatnonzero(word[:-1] == word[1:])
            rank[same] = self.rank_of(sym[same], sym[same + 1])
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, head)
            low = np.repeat(best, np.diff(np.concatenate([head, [len(sym)]])))
            over = low == _NONE
            if over.any():
                done_w.append(word[over])
                done_s.append(sym[over])
                sym, word, rank, low = sym[~over], word[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == low)
            start = np.concatenate([[True], np.diff(hit) != 1])
            first = hit[np.flatnonzero(start)][np.cumsum(start) - 1]
            hit = hit[(hit - first) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        word = np.concatenate(done_w) if done_w else np.zeros(0, np.int64)
        sym = np.concatenate(done_s) if done_s else np.zeros(0, np.int32)
        sym = sym[np.argsort(word, kind="stable")]
        return sym, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def merged_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        ids, off = self.merge(words)
        raw, off = ids.astype("<u4").tobytes(), (off * 4).tolist()
        return [raw[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]

    def merged_counts(self, words: list[bytes]) -> list[int]:
        """How many symbols survive in each word."""
        return np.diff(self.merge(words)[1]).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with a space between, as the library without a decoder gives it."""
        return b" ".join(map(self.tokens.__getitem__, ids.tolist()))


class Chunks:
    """Values of chunks: ids (bytes) or numbers of tokens (int), found by merge."""

    def __init__(self, vocabulary: Vocabulary, merge, ids: bool):
        self.v, self.merge, self.ids = vocabulary, merge, ids
        self.chunks: dict[bytes, bytes | int] = {}
        self.words: dict[str | int, bytes | int] = {}

    def _add(self, missing: list[bytes]) -> None:
        pieces = self.v.split(missing)
        have = self.words
        words = list({w for p in pieces for w in p if w not in have})
        raw = [w for w in words if isinstance(w, str)]
        have.update((w, w.to_bytes(4, "little") if self.ids else 1) for w in words if isinstance(w, int))
        if raw:
            have.update(zip(raw, self.merge([w.encode() for w in raw]), strict=True))
        get = have.__getitem__
        total = b"".join if self.ids else sum
        self.chunks.update((c, total(map(get, p))) for c, p in zip(missing, pieces, strict=True))
        for w in raw:
            if len(w) > LONG:
                del have[w]

    def of(self, texts: list[str | None]) -> list:
        """The value of each text: all ids as bytes, or the number of tokens."""
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks.clear()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        get = self.chunks.get
        found, gaps, missing = [], [], set()
        for t in texts:
            chunks = t.encode("utf-8", "replace").split() if t else []
            values = list(map(get, chunks))
            at = -1
            for _ in range(values.count(None)):
                at = values.index(None, at + 1)
                missing.add(chunks[at])
                gaps.append((values, at, chunks[at]))
            found.append(values)
        todo = list(missing)
        for lo in range(0, len(todo), 20_000):
            self._add(todo[lo : lo + 20_000])
        have = self.chunks
        for values, at, c in gaps:
            values[at] = have[c]
        for c in todo:
            if len(c) > LONG:
                del have[c]
        return [b"".join(v) for v in found] if self.ids else [sum(v) for v in found]


_worker: dict = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker process."""
    if ("v", path) not in _worker:
        _worker["v", path] = Vocabulary(path)
    return _worker["v", path]


def id_chunks(path: str) -> Chunks:
    if ("ids", path) not in _worker:
        v = vocabulary(path)
        _worker["ids", path] = Chunks(v, v.merged_ids, True)
    return _worker["ids", path]


def count_chunks(path: str) -> Chunks:
    if ("n", path) not in _worker:
        v = vocabulary(path)
        _worker["n", path] = Chunks(v, v.merged_counts, False)
    return _worker["n", path]


def release() -> None:
    """Free what this worker holds for encoding; called where another operator's work begins."""
    _worker.clear()
