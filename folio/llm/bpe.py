"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word's adjacent pairs are the leaves of a segment tree; a leaf's key is rank * leaves + place, so the root holds the
lowest rank and, among equals, the leftmost place. A merge changes three leaves, each of which is carried up to the
root in a logarithmic number of steps; the word is done when its root holds no mergeable pair. The words of a batch that
have not been seen yet go through the same steps together, as rows of arrays.

Null text: like the empty one, no ids. Whole texts of any length are encoded; a word of any length is.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folio.llm.common import arrow_append, load, take_cache, tune

#: The split of byte-level vocabularies of this family, as their description gives it.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NONE = np.int64(1) << 60
#: Encoded words of a generation of a Python worker's cache (it keeps two), and cells of an array in the tree: both bound memory only.
CACHE_WORDS, CELLS = 150_000, 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE of the tokenizers library's JSON form (no normaliser, no prefix space)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.bytes_of = {i: bytes(letters[ch] for ch in w) for w, i in vocab.items()} | {i: x.encode() for x, i in self.special.items()}
        self.first = np.array([vocab[ch] for ch, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        known = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of, default=-1) + 1)]
        self.flat, self.starts = np.frombuffer(b"".join(known), np.uint8), np.cumsum([0, *map(len, known)])

    def forget(self) -> None:
        self.cache, self.older = {}, {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_ranks[at], -1)

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: a row of symbols for each word, filled up with -1 to a power of two.

        Returns the symbols left after all merges, word after word, and the number of each word's.
        """
        n, size = ids.shape
        wide = size + 1  # a place after the last symbol
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int64)], axis=1)
        after, before = np.tile(np.arange(1, wide + 1), n), np.tile(np.arange(-1, size), n)
        tree = np.full((n, 2 * size), NONE)
        r = self.ranks(ids[:, :size], ids[:, 1:])
        tree[:, size:] = np.where(r >= 0, r * size + np.arange(size), NONE)
        level = size // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.flatnonzero(tree[:, 1] < NONE)
        ids, tree = ids.reshape(-1), tree.reshape(-1)
        while rows.size:
            own, top = rows * wide, rows * (2 * size)
            root = tree[top + 1]
            i, rank = root % size, root // size
            j = after[own + i]
            k = after[own + j]
            new = self.merged[rank]
            ids[own + i], ids[own + j] = new, -2
            after[own + i] = k
            inner = k <= size
            before[(own + k)[inner]] = i[inner]
            p = before[own + i]
            # The leaves of the merged pair's place, of the place that went, and of the pair to the left.
            right = self.ranks(new, ids[own + np.minimum(k, size)])
            tree[top + size + j] = NONE
            tree[top + size + i] = np.where(right >= 0, right * size + i, NONE)
            has = p >= 0
            q = p[has]
            left = self.ranks(ids[own[has] + q], new[has])
            tree[top[has] + size + q] = np.where(left >= 0, left * size + q, NONE)
            base, node = np.concatenate([top, top, top[has]]), np.concatenate([i, j, q]) + size >> 1
            while node[0]:
                kid = base + 2 * node
                tree[base + node] = np.minimum(tree[kid], tree[kid + 1])
                node >>= 1
            rows = rows[tree[top + 1] < NONE]
        there = ids >= 0
        return ids[there], there.reshape(n, wide).sum(1)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of each word."""
        out: dict[str, bytes] = {w: np.array([self.special[w]], "<u4").tobytes() for w in words if w in self.special}
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            if w not in out:
                raw = w.encode()
                by_size.setdefault(1 << max(1, (len(raw) - 1).bit_length()), []).append((w, raw))
        for size, group in by_size.items():
            step = max(1, CELLS // size)
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                lengths = np.fromiter((len(raw) for _, raw in part), np.int64, len(part))
                ids = np.full((len(part), size), -1, np.int64)
                ids[np.arange(size) < lengths[:, None]] = self.first[np.frombuffer(b"".join(raw for _, raw in part), np.uint8)]
                flat, counts = self.merge_rows(ids)
                packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
                for (w, _), a, b in zip(part, [0, *ends], ends, strict=False):
                    out[w] = packed[a:b]
        return out

    def pieces(self, text: str) -> list[str]:
        """The words of a text; a special token is a word of its own."""
        if text[1:].isalpha() and (text[0] == " " or text[0].isalpha()):
            return [text]
        if self.special_split is None or not any(x in text for x in self.special):
            return WORDS.findall(text)
        return [w for k, part in enumerate(self.special_split.split(text)) for w in ([part] if k % 2 else WORDS.findall(part))]

    def learn(self, chunks: set[str]) -> dict[str, bytes | None]:
        """The packed ids of chunks, which go to the cache; None for a chunk that depends on what stands around it."""
        known = {c: x for c in chunks if (x := self.older.get(c)) is not None}
        sure = [c for c in chunks if c not in known and len(c) > 1 and not c[1].isspace() and not c[-1].isspace()]
        split = {c: self.pieces(c) for c in sure}
        ids = self.encode_words(list({w for words in split.values() for w in words}))
        out: dict[str, bytes | None] = dict.fromkeys(chunks) | known
        for c, words in split.items():
            out[c] = ids[words[0]] if len(words) == 1 else b"".join([ids[w] for w in words])
        self.cache.update(out)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text.

        A blank belongs to the word after it, so a text may be cut before each blank that stands between two characters
        that are no white space: such chunks are encoded once and kept. A text with other cuts is encoded as one.
        """
        take_cache("bpe", self.forget)
        out: list[np.ndarray] = []
        cut = not any(" " in x for x in self.special)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 21):  # words of so many characters at once
                size += len(texts[end] or "")
                end += 1
            if len(self.cache) > CACHE_WORDS:
                self.cache, self.older = {}, self.cache
            split: list[list[str] | None] = []
            for t in texts[at:end]:
                if not t:
                    split.append([])
                elif not cut or t[0].isspace() or t[-1].isspace() or "  " in t or "\n " in t or " \n" in t:
                    split.append(None)
                else:
                    parts = t.split(" ")
                    split.append(["." + parts[0]] + [" " + p for p in parts[1:]])  # "." marks a start: no word begins so in the cache
            got = [part and list(map(self.cache.get, part)) for part in split]
            new = self.learn({c for part, ids in zip(split, got, strict=True) if part for c, x in zip(part[1:], ids[1:], strict=True) if x is None and c not in self.cache})
            own: dict[int, list[str]] = {}  # texts that are encoded as one, and the first chunks of the others
            for k, (t, part, ids) in enumerate(zip(texts[at:end], split, got, strict=True)):
                if part:
                    ids = got[k] = [x if x is not None else new.get(c) for x, c in zip(ids, part, strict=True)]
                if part is None or part and (None in ids[1:] or part[0][-1].isspace()):
                    got[k], own[k] = None, self.pieces(t)
                elif part:
                    own[k] = self.pieces(part[0][1:])
            ids_of = self.encode_words(list({w for words in own.values() for w in words}))
            for k, ids in enumerate(got):
                head = [ids_of[w] for w in own.get(k, ())]
                out.append(np.frombuffer(b"".join(head if ids is None else [*head, *ids[1:]]), "<u4"))
            at = end
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Unknown ids give nothing."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < len(self.starts) - 1)]
        sizes = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes().decode("utf-8", "replace")


_open: dict[str, ByteBpe] = {}


def tokenizer(path: str) -> ByteBpe:
    """The tokenizer of a vocabulary file; a Python worker reads the file once."""
    if path not in _open:
        _open[path] = ByteBpe(path)
    return _open[path]


DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Appends the ids of each whole text, as an array of integers."""
    return arrow_append(df, T.StructType([T.StructField(out, T.ArrayType(T.IntegerType()))]), lambda c: {out: [x.astype(np.int32) for x in tokenizer(path).encode_batch(c[0].to_pylist())]}, [text], keep)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Appends the text of each array of ids; null gives null."""
    return arrow_append(df, T.StructType([T.StructField(out, T.StringType())]), lambda c: {out: [None if x is None else tokenizer(path).decode(np.array(x, np.int64)) for x in c[0].to_pylist()]}, [ids], keep)


def digest(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, out: str | None = None) -> DataFrame:
    """Appends the number of tokens, a digest of the ids and one of what they decode to; the ids as well if `out` names them."""

    def run(columns: list[pa.Array]) -> dict:
        t = tokenizer(path)
        ids = t.encode_batch(columns[0].to_pylist())
        sha = lambda b: hashlib.sha256(b).hexdigest()
        got = {"n_tokens": [len(x) for x in ids], "ids_sha256": [sha(x.astype("<u4").tobytes()) for x in ids], "decoded_sha256": [sha(t.decode(x).encode()) for x in ids]}
        if out is not None:
            ends = np.cumsum([0, *map(len, ids)])
            got[out] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32) if ids else [], pa.int32()))
        return got

    fields = [] if out is None else [T.StructField(out, T.ArrayType(T.IntegerType(), False))]
    return arrow_append(df, T.StructType(fields + list(DIGEST.fields)), run, [text], keep)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return digest(load(spark, sf_dir, "documents").select("doc_id", "text"), default_vocabulary(), keep=["doc_id"])
