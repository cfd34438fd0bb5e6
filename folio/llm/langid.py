"""Language of whole texts by a linear-chain conditional random field over their words.

Each word has affix, character n-gram and lexicon features, hashed into one weight table; transitions between the labels
of neighbouring words are learned with it. Training sequences join runs of words from rows of different languages, so
the field sees switches inside a text. Forward-backward gives each word's label distribution; a text's language is the
label with the largest share of its words, and that share is the score.

Forward-backward is exact for texts of any length: a text is cut into blocks, each block's transfer matrix is built
for all blocks at once, the matrices are chained, and the blocks are then filled in.

Null text, and text without a letter: `und`, score 0. Without a labelled training row: `und`. Ties go to the label that
sorts first. Repeated rows have equal results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_append, load, take_cache, tune

WORD = re.compile(r"[^\W\d_]+")
#: Rows of the training sample, for all languages together: the documented bound of what is fitted.
SAMPLE_ROWS = 3000
#: Training sequences, and words in each.
SEQUENCES, LENGTH = 2400, 32
HASH_BITS, LEXICON, BLOCK, KNOWN_WORDS = 16, 4000, 64, 250_000


def features(words: list[str], lexicon: dict[str, int]) -> np.ndarray:
    """A row of feature numbers for each word, filled up with the last row of the table, which weighs nothing.

    Feature kinds: prefixes and suffixes of 1 to 3 characters, 1-, 2- and 3-grams (edges marked), and the lexicon's words.
    """
    mask, pad = (1 << HASH_BITS) - 1, (1 << HASH_BITS) + LEXICON
    widest = max(map(len, words))
    codes = np.zeros((len(words), widest + 4), np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    inside = np.arange(widest) < sizes[:, None]
    codes[:, 2 : widest + 2][inside] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    codes[:, 1] = 2
    codes[np.arange(len(words)), sizes + 2] = 3
    out = [np.fromiter((lexicon.get(w, -1) for w in words), np.int64, len(words))[:, None]]
    out[0] = np.where(out[0] >= 0, out[0] + (1 << HASH_BITS), pad)

    def hashed(parts: list[np.ndarray], kind: int) -> np.ndarray:
        h = np.full(parts[0].shape, np.uint64((kind + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        for p in parts:
            h = (h ^ p) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        return ((h >> np.uint64(17)) & np.uint64(mask)).astype(np.int64)

    n = codes.shape[1]
    for k in (1, 2, 3):
        grams = hashed([codes[:, j : n - k + j + 1] for j in range(k)], k)
        edge = 2 if k == 1 else 1  # longer grams take in the edge marks
        use = np.arange(edge, min(grams.shape[1], widest + 3))
        live = use + k <= (sizes + (2 if k == 1 else 3))[:, None]
        out.append(np.where(live, grams[:, use], pad))
    at = np.arange(len(words))
    for k in (1, 2, 3):
        fits = sizes >= k
        pre = hashed([codes[:, 2 + j] for j in range(k)], 10 + k)
        suf = hashed([codes[at, np.maximum(sizes + 2 - k + j, 0)] for j in range(k)], 20 + k)
        out += [np.where(fits, pre, pad)[:, None], np.where(fits, suf, pad)[:, None]]
    return np.concatenate(out, axis=1)


@dataclass
class Field:
    """A fitted field: weights by feature and label (the last row stays 0), and transitions."""

    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray
    transitions: np.ndarray
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)
    table: np.ndarray | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's label scores, its largest 1."""
        out = np.empty((len(words), len(self.labels)), np.float64)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            top = 2 * max(8, len(words[order[at]]))  # words of about a size at once
            end = at
            while end < len(order) and end - at < 20_000 and len(words[order[end]]) <= top:
                end += 1
            part = order[at:end]
            got = self.weights[features([words[i] for i in part], self.lexicon)].sum(1)
            out[part] = np.exp(got - got.max(1, keepdims=True))
            at = end
        return out

    def forget(self) -> None:
        self.known, self.table = {}, np.empty((0, len(self.labels)))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Rows of self.table for words; the table is kept between calls, up to a bound."""
        take_cache("langid", self.forget)
        if self.table is None or len(self.known) > KNOWN_WORDS:
            self.forget()
        new = list(set(words).difference(self.known))
        if new:
            base = len(self.known)
            self.table = np.concatenate([self.table, self.emissions(new)])
            self.known.update(zip(new, range(base, base + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def marginals(self, psi: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Label distributions of the words of some texts, text after text; psi: exp of their scores."""
        return blocked_marginals(psi, lengths, np.exp(self.transitions - self.transitions.max()))

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """The labels' shares of each text's words; a row of zeros where a text has none."""
        out = np.zeros((len(texts), len(self.labels)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < 1 << 20):  # characters at once
                size += len(texts[end] or "")
                end += 1
            words = [WORD.findall((t or "").lower()) for t in texts[at:end]]
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            if lengths.sum():
                has = np.flatnonzero(lengths)
                psi = self.table_rows([w for part in words for w in part])
                m = self.marginals(psi, lengths[has])
                out[at + has] = np.add.reduceat(m, np.cumsum([0, *lengths[has][:-1]])) / lengths[has][:, None]
            at = end
        return out

    def table_rows(self, words: list[str]) -> np.ndarray:
        rows = self.numbers(words)
        return self.table[rows]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        s = self.shares(texts)
        best = s.argmax(1)
        return [self.labels[b] if x[b] > 0 else "und" for b, x in zip(best, s, strict=True)], [float(min(1.0, x[b])) for b, x in zip(best, s, strict=True)]

    def label_words(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, label, probability) of each word of a text."""
        spans = [m.span() for m in WORD.finditer(text or "")]
        if not spans or not self.labels:
            return []
        m = self.marginals(self.table_rows([text[a:b].lower() for a, b in spans]), np.array([len(spans)]))
        return [(a, b, self.labels[k], float(p[k])) for (a, b), p, k in zip(spans, m, m.argmax(1), strict=True)]


def blocked_marginals(psi: np.ndarray, lengths: np.ndarray, step: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Exact forward-backward for sequences laid end to end. psi: (words, labels) factors; step: (labels, labels) factors."""
    n, k = psi.shape
    per = -(-lengths // block)  # blocks of each sequence
    first = np.cumsum([0, *per[:-1]])
    owner = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(owner)) - first[owner]
    starts = np.cumsum([0, *lengths[:-1]])[owner] + nth * block
    sizes = np.minimum(block, lengths[owner] - nth * block)
    place = starts[:, None] + np.arange(block)
    live = np.arange(block) < sizes[:, None]
    p = np.where(live[:, :, None], psi[np.minimum(place, n - 1)], 1.0)
    # Transfer matrix of each block.
    m = np.broadcast_to(np.eye(k), (len(owner), k, k)).copy()
    for t in range(block):
        new = (m.reshape(-1, k) @ step).reshape(m.shape) * p[:, t, None, :]
        new /= new.max((1, 2), keepdims=True)
        m = np.where(live[:, t, None, None], new, m)
    # Vectors that enter each block from the left, and those that enter it from the right.
    left, right = np.full((len(owner), k), 1.0 / k), np.ones((len(owner), k))
    for j in range(1, int(per.max())):
        b = first[per > j] + j
        v = np.einsum("bi,bij->bj", left[b - 1], m[b - 1])
        left[b] = v / v.sum(1, keepdims=True)
        b = (first + per - 1 - j)[per > j]
        v = np.einsum("bij,bj->bi", m[b + 1], right[b + 1])
        right[b] = v / v.max(1, keepdims=True)
    alpha = np.empty_like(p)
    v = left
    for t in range(block):
        v = np.where(live[:, t, None], (v @ step) * p[:, t], v)
        v = v / v.sum(1, keepdims=True)
        alpha[:, t] = v
    out = np.empty((n, k))
    v = right
    for t in reversed(range(block)):
        q = alpha[:, t] * v
        here = live[:, t]
        out[place[here, t]] = (q / q.sum(1, keepdims=True))[here]
        w = (p[:, t] * v) @ step.T
        v = np.where(here[:, None], w / w.max(1, keepdims=True), v)
    return out


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 4, rate: float = 0.35) -> Field:
    """Fits a field to (text, label) rows: AdaGrad on the conditional likelihood of made-up code-switched sequences."""
    labels = sorted({y for _, y in rows})
    words = [WORD.findall(t.lower()) for t, _ in rows]
    usable = [i for i, w in enumerate(words) if w]
    if not usable:
        return Field([], {}, np.zeros(((1 << HASH_BITS) + LEXICON + 1, 0)), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    counts: dict[str, int] = {}
    for i in usable:
        for w in set(words[i]):
            counts[w] = counts.get(w, 0) + 1
    common = sorted((w for w, c in counts.items() if c > 2), key=lambda w: (-counts[w], w))[:LEXICON]
    lexicon = {w: j for j, w in enumerate(common)}
    k = len(labels)
    by_label = [[i for i in usable if rows[i][1] == y] for y in labels]
    pools = [x for x in by_label if x]
    seqs, gold = [], []
    for _ in range(SEQUENCES):
        ws: list[str] = []
        ys: list[int] = []
        while len(ws) < LENGTH:
            pool = pools[rng.integers(len(pools))]
            i = pool[rng.integers(len(pool))]
            want = int(rng.integers(3, 17))
            a = int(rng.integers(max(1, len(words[i]) - want + 1)))
            part = words[i][a : a + want][: LENGTH - len(ws)]
            ws += part
            ys += [labels.index(rows[i][1])] * len(part)
        seqs.append(ws)
        gold.append(ys)
    vocab = sorted({w for s in seqs for w in s})
    index = {w: j for j, w in enumerate(vocab)}
    out = Field(labels, lexicon, np.zeros(((1 << HASH_BITS) + LEXICON + 1, k)), np.zeros((k, k)))
    feats = features(vocab, lexicon)
    x = np.array([[index[w] for w in s] for s in seqs])
    y = np.array(gold)
    sum_w, sum_t = np.full_like(out.weights, 1e-8), np.full((k, k), 1e-8)
    size = 120
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), size):
            xb, yb = x[order[lo : lo + size]], y[order[lo : lo + size]]
            fb = feats[xb]
            scores = out.weights[fb].sum(2)
            psi = np.exp(scores - scores.max(2, keepdims=True))
            step = np.exp(out.transitions)
            alpha, beta = np.empty_like(psi), np.empty_like(psi)
            v = np.full((len(xb), k), 1.0 / k)
            for t in range(LENGTH):
                v = (v @ step) * psi[:, t]
                v /= v.sum(1, keepdims=True)
                alpha[:, t] = v
            v = np.ones((len(xb), k))
            edge = np.zeros((k, k))
            for t in reversed(range(LENGTH)):
                beta[:, t] = v
                w = psi[:, t] * v
                if t:
                    pair = alpha[:, t - 1, :, None] * step * w[:, None, :]
                    edge += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                v = w @ step.T
                v /= v.max(1, keepdims=True)
            q = alpha * beta
            q /= q.sum(2, keepdims=True)
            np.put_along_axis(q, yb[:, :, None], np.take_along_axis(q, yb[:, :, None], 2) - 1, 2)
            np.subtract.at(edge, (yb[:, :-1].ravel(), yb[:, 1:].ravel()), 1)
            flat = fb.reshape(-1)
            g = np.stack([np.bincount(flat, np.repeat(q[:, :, j].ravel(), fb.shape[2]), len(out.weights)) for j in range(k)], 1) / len(xb)
            g += 1e-4 * out.weights
            sum_w += g * g
            out.weights -= rate * g / np.sqrt(sum_w)
            out.weights[-1] = 0
            edge = edge / len(xb) + 1e-3 * out.transitions
            sum_t += edge * edge
            out.transitions -= rate * edge / np.sqrt(sum_t)
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most about `rows` training rows, spread over the labels alike, chosen by a hash; whole texts."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return []
    share = rows / len(counts)
    u = (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)).cast("double")
    wanted = F.lit(False)
    for lang, n in counts.items():
        wanted = wanted | ((F.col("lang") == lang) & (u < share / n))
    return [(r.text, r.lang) for r in train.where(wanted).orderBy(F.xxhash64("doc_id"), "text").limit(rows).select("text", "lang").collect()]


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Field:
    return fit(sample(docs, rows))


RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(df: DataFrame, model: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # of a fixed size: the hash table and the lexicon

    def run(columns: list[pa.Array]) -> dict:
        labels, scores = shared.value.predict(columns[0].to_pylist())
        return {"lang_pred": labels, "score": scores}

    return arrow_append(df, RESULT, run, [text], keep)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs.withColumn("held_out", held_out()), train(docs), keep=["doc_id", "held_out"])
