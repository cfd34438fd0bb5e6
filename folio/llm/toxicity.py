"""Toxicity by a weighted finite-state grammar over clauses.

Five transducers read a clause's words: insults, threats, targets, negations and reported speech. Each is a small
weighted automaton over word classes; their composition reads the classes once and gives the clause's weight for each way
it was matched (plain, aimed at someone, negated, reported, threatening). Single words are not scored: a
negated or quoted insult goes to another feature than a plain one, and a logistic model of the clauses' weights, fitted
to the labels, gives the text's score.

The insult transducer's stems are learned: of all fragments of 3 to 6 letters (and whole words) of the training rows,
those that are far likelier in toxic rows, chosen greedily until they cover the words that such fragments are found in.
Near copies are counted once, so one copied text teaches nothing, and a fragment of an insult that harmless words hold
too gives way to a longer one. The other lists are fixed.

Null and empty texts have no clause: they get the score of a text without a match. Without training rows of both labels
all scores are 0. Repeated rows have equal scores; a doc_id with several labels trains with each.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import arrow_append, load, materialize, tune

#: The documented bounds of what is fitted: training rows of each label, and stems.
SAMPLE_TOXIC, SAMPLE_CLEAN, STEMS, CANDIDATES = 2000, 6000, 400, 4000
#: Least log odds of a stem, least likelihood ratio (G squared) against chance, and least lower end of the odds' interval,
#: which lies Z standard errors below. None depends on the other stems, so rare insults and small languages keep theirs.
ODDS, RATIO, SURE, Z = 3.0, 16.0, 1.5, 1.96
#: Near copies of a training text count once: MinHash bands, values a band, words of a shingle.
BANDS, BAND_ROWS, SHINGLE = 4, 3, 3
MULTIPLIERS = [int(m) | 1 for m in np.random.default_rng(7).integers(1, 1 << 63, BANDS * BAND_ROWS)]
WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[^.!?;:\n]+")
SHORTEST, LONGEST = 3, 6
#: Letters of the longest word whose fragments are learned; longer words are learned whole, and searched like any.
WIDEST = 64

# Closed word classes in four languages.
TARGET = "you your yours u he she they him her them this that these those is are du dich dir ihr euch sie er tu te toi vous il elle ils est es eres usted ustedes tú vosotros ellos son"
NEGATION = "not no never isn aren wasn don doesn didn without nicht kein keine nie niemals ohne ne pas jamais sans aucun nunca sin ningún tampoco"
REPORT = "said says say told claims claimed wrote writes called quoted reported allegedly sagte sagt schrieb behauptet dit disait écrit affirme prétend dijo dice escribió afirma supuestamente"
THREAT = "kill hurt destroy beat burn shoot stab töten umbringen schlagen verbrennen tuer frapper brûler détruire matar golpear quemar destruir"
FUTURE = "will shall gonna going werde wirst vais vas allons voy vas va"

OTHER, INSULT, TARGETS, NEGATES, REPORTS, THREATS, INTENT = range(7)
FIXED_CLASSES = {w: c for c, words in ((INTENT, FUTURE), (TARGETS, TARGET), (NEGATES, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words.split()}


@dataclass(frozen=True)
class Transducer:
    """A weighted automaton over word classes. arcs: (state, class) -> (state, weight); other classes keep the state, or
    go to `fade[state]`, with weight 1. Weights along a path multiply; `marks` are the states that say how a match counts."""

    arcs: dict[tuple[int, int], tuple[int, float]]
    fade: dict[int, int]
    marks: frozenset[int]

    def step(self, state: int, symbol: int) -> tuple[int, float]:
        return self.arcs.get((state, symbol)) or (self.fade.get(state, state), 1.0)


def window(symbols: tuple[int, ...], reach: int, weight: float) -> Transducer:
    """After one of the symbols, `reach` words long, the transducer is in a marked state; an insult read there is weighed."""
    arcs: dict[tuple[int, int], tuple[int, float]] = {}
    for state in range(reach + 1):
        for s in symbols:
            arcs[state, s] = (reach, 1.0)
        for s in (INSULT, THREATS):
            if state:
                arcs[state, s] = (state, weight)
    return Transducer(arcs, {k: k - 1 for k in range(1, reach + 1)}, frozenset(range(1, reach + 1)))


#: In composition order. A negation reaches four words on, a report to the clause's end (as long as it is), a target six.
NEGATED = window((NEGATES,), 4, 0.4)
REPORTED = Transducer({(0, REPORTS): (1, 1.0), (1, INSULT): (1, 0.5), (1, THREATS): (1, 0.5)}, {}, frozenset({1}))
AIMED = window((TARGETS,), 6, 1.25)
THREATENED = window((INTENT, TARGETS), 3, 1.5)
GRAMMAR = (NEGATED, REPORTED, AIMED, THREATENED)


def read_clause(symbols: list[tuple[int, float]], grammar: tuple[Transducer, ...] = GRAMMAR) -> list[tuple[str, float]]:
    """Runs the composed transducers over (class, weight) symbols; a (kind, weight) for each match in the clause."""
    states = [0] * len(grammar)
    out = []
    for symbol, own in symbols:
        steps = [t.step(s, symbol) for t, s in zip(grammar, states, strict=True)]
        if symbol in (INSULT, THREATS):
            negated, reported, aimed, threatened = (s in t.marks for t, s in zip(grammar, states, strict=True))
            weight = own
            for _, w in steps:
                weight *= w
            if symbol == THREATS:
                if threatened and not negated:
                    out.append(("reported" if reported else "threat", weight))
            else:
                out.append(("negated" if negated else "reported" if reported else "aimed" if aimed else "plain", weight))
        states = [s for s, _ in steps]
    return out


KINDS = ("plain", "aimed", "negated", "reported", "threat")


def fragments(word: str) -> Iterator[str]:
    """The word itself ("=" before it) and its fragments of 3 to 6 letters, each once."""
    yield "=" + word
    yield from {word[i : i + n] for n in range(SHORTEST, LONGEST + 1) for i in range(len(word) - n + 1)}


class Lexicon:
    """Stems with weights; a word's class and weight are looked up once and kept, up to a bound."""

    def __init__(self, stems: dict[str, float]):
        self.whole = {s[1:]: w for s, w in stems.items() if s[0] == "="}
        self.parts = {s: w for s, w in stems.items() if s[0] != "="}
        self.hint = re.compile("|".join(re.escape(s) for s in sorted({*self.parts, *self.whole}, key=lambda s: (-len(s), s))) or r"(?!)")
        threats = [w for w, c in FIXED_CLASSES.items() if c == THREATS]
        self.threat = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(threats))

    def insult(self, word: str) -> float:
        best = self.whole.get(word, 0.0)
        for m in self.hint.finditer(word):
            best = max(best, self.parts.get(m.group(), 0.0))
        return best

    def symbols(self, clause: str) -> list[tuple[int, float]]:
        out = []
        for w in WORD.findall(clause):
            weight = self.insult(w)
            out.append((INSULT, weight) if weight else (FIXED_CLASSES.get(w, OTHER), 1.0))
        return out

    def clauses(self, text: str | None) -> list[tuple[int, int, str, float]]:
        """(start, end, kind, weight) of the matches of each clause that has any."""
        if not text:
            return []
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer; places would shift
            low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
        hits = sorted([m.start() for m in self.hint.finditer(low)] + [m.start() for m in self.threat.finditer(low)])
        out: list[tuple[int, int, str, float]] = []
        end = 0
        for h in hits:
            if h < end:
                continue
            start = max(low.rfind(ch, 0, h) for ch in ".!?;:\n") + 1
            m = CLAUSE.match(low, start)
            end = m.end() if m else h + 1
            out += [(start, end, kind, weight) for kind, weight in read_clause(self.symbols(low[start:end]))]
        return out

    def vector(self, text: str | None) -> list[float]:
        """For each kind the heaviest clause and the log of one more than the sum."""
        top, total = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0)
        for _, _, kind, weight in self.clauses(text):
            top[kind] = max(top[kind], weight)
            total[kind] += weight
        return [x for k in KINDS for x in (top[k], float(np.log1p(total[k])))]


@dataclass
class Model:
    lexicon: Lexicon | None
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str | None]) -> list[float]:
        if self.lexicon is None:
            return [0.0] * len(texts)
        x = np.array([self.lexicon.vector(t) for t in texts]).reshape(len(texts), -1)
        return (1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))).tolist()


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton's method with a ridge; the two labels have equal weight, however rare one is."""
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    own = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (own * (p - y)) + penalty * w
        h = (z * (own * p * (1 - p))[:, None]).T @ z + penalty * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def training(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic): the bounded sample of distinct training texts.

    Rows are chosen from the labels alone, by a hash of the id, so the few chosen ids are broadcast and no text is moved
    but the sample's.
    """
    rows = labels.select("doc_id", "toxic").where(~held_out() & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).distinct()
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    u = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    share = lambda label, most: most / max(1, counts.get(label, 0))
    chosen = rows.where(F.when(F.col("toxic") == 1, u < share(1, SAMPLE_TOXIC)).otherwise(u < share(0, SAMPLE_CLEAN))).limit(2 * (SAMPLE_TOXIC + SAMPLE_CLEAN))
    return docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("text", "toxic").distinct()


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def bands(text: str) -> list[int]:
    """A key for each band of the MinHash signature of the text's shingles; none without words."""
    words = WORD.findall(text.lower())
    if not words:
        return []
    shingles = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    x = np.array([digest(s) for s in shingles], np.int64).astype(np.uint64)
    least = [int((x * np.uint64(m)).min()) for m in MULTIPLIERS]
    return [digest(f"{b}:{least[b * BAND_ROWS : (b + 1) * BAND_ROWS]}") for b in range(BANDS)]


def copies(sample: DataFrame) -> frozenset[tuple[int, int]]:
    """(digest, label) of the texts that share a band with a text before them of the same label, in the digests' order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([digest(t) for t in texts], pa.int64()), b.column(1).cast(pa.int32()), pa.array([bands(t) for t in texts], pa.list_(pa.int64()))], names=["digest", "toxic", "bands"])

    met: set[tuple[int, int, int]] = set()
    out = set()
    for own, label, keys in sorted((r[0], r[1], list(r[2])) for r in sample.mapInArrow(sign, "digest long, toxic int, bands array<long>").collect()):  # a few numbers a row of the bounded sample
        keys = [(label, k, b) for k, b in enumerate(keys)]
        if any(k in met for k in keys):
            out.add((own, label))
        met.update(keys)
    return frozenset(out)


def log_odds(toxic: float, clean: float, n1: float, n0: float) -> float:
    return math.log((toxic + 0.5) / (n1 + 1)) - math.log((clean + 0.5) / (n0 + 1))


def distinct_marks(rows: list[tuple[str, float, int, int]], n1: float, n0: float) -> list[tuple[str, float, int]]:
    """(fragment, log odds, toxic rows) without the fragments that a longer one of rows stands for.

    It does if the rows that hold the shorter and not the longer one are partly clean and do not mark toxic rows: an
    insult's fragment in harmless words ("wor" of "worthless"). rows: (fragment, log odds, toxic rows, clean rows).
    """
    of = {f: (a, c) for f, _, a, c in rows}
    spare = set()
    for g, (a, c) in of.items():
        for f in set(fragments(g.removeprefix("="))) - {g}:
            if f in of:
                x, y = of[f][0] - a, of[f][1] - c
                if y > 0 and log_odds(x, y, n1, n0) - Z * math.sqrt(1 / (x + 0.5) + 1 / (y + 0.5)) < SURE:
                    spare.add(f)
    return [(f, o, a) for f, o, a, _ in rows if f not in spare]


def candidates(sample: DataFrame) -> list[tuple[str, float, int]]:
    """(fragment, log odds, toxic rows) of the fragments that mark toxic rows; counted over the sample, near copies once."""
    again = copies(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        totals = [0, 0]

        def flush() -> pa.RecordBatch:
            names = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[n][1] for n in names], pa.int64()), pa.array([seen[n][0] for n in names], pa.int64())], names=["fragment", "toxic", "clean"])

        of: dict[str, list[str]] = {}
        for b in batches:
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if again and (digest(text), label) in again:
                    continue
                totals[label] += 1
                own: set[str] = set()
                for w in set(WORD.findall(text.lower())):
                    if w not in of:
                        of[w] = list(fragments(w)) if len(w) <= WIDEST else ["=" + w]
                    own.update(of[w])
                for f in own:
                    seen.setdefault(f, [0, 0])[label] += 1
                if len(of) > 100_000:
                    of.clear()
                if len(seen) > 400_000:
                    yield flush()
                    seen.clear()
        seen[""] = totals
        yield flush()

    counted = sample.mapInArrow(count, "fragment string, toxic long, clean long").groupBy("fragment").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = counted.where("fragment = ''").first()
    if total is None or not total["toxic"] or not total["clean"]:
        return []
    n1, n0 = float(total["toxic"]), float(total["clean"])
    a, c = F.col("toxic"), F.col("clean")
    term = lambda x, n: F.when(x > 0, x * F.log(x * (n1 + n0) / ((a + c) * n))).otherwise(0.0)
    scored = counted.where("fragment <> '' and toxic >= 2").withColumn("odds", F.log((a + 0.5) / (n1 + 1)) - F.log((c + 0.5) / (n0 + 1))).withColumn("ratio", 2 * (term(a, n1) + term(c, n0)))
    sure = F.col("odds") - Z * F.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)) >= SURE
    best = scored.where((F.col("odds") >= ODDS) & (F.col("ratio") >= RATIO) & sure).orderBy(F.desc("ratio"), F.desc("odds"), "fragment").limit(CANDIDATES)
    return distinct_marks([(r["fragment"], float(r["odds"]), int(r["toxic"]), int(r["clean"])) for r in best.collect()], n1, n0)


def choose(words: list[tuple[str, int]], found: dict[str, float]) -> dict[str, float]:
    """Greedy cover: the stem that covers most uses of words not covered yet, until none covers two more.

    words: words of toxic rows that hold a candidate, and the toxic rows that hold each.
    """
    owners: dict[str, list[int]] = {}
    for k, (w, _) in enumerate(words):
        for f in fragments(w):
            if f in found:
                owners.setdefault(f, []).append(k)
    free = [n for _, n in words]
    gain = {f: sum(free[k] for k in x) for f, x in owners.items()}
    out: dict[str, float] = {}
    while gain and len(out) < STEMS:
        f = max(gain, key=lambda f: (gain[f], found[f], len(f), f))
        now = sum(free[k] for k in owners[f])
        if now < 2:
            del gain[f]
        elif now < gain[f]:
            gain[f] = now
        else:
            out[f] = found[f]
            for k in owners[f]:
                free[k] = 0
            del gain[f]
    return out


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    sample = materialize(training(docs, labels), "toxic-sample")
    found = candidates(sample)
    if not found:
        return Model(None, np.zeros(0), 0.0)
    odds = {f: o for f, o, _ in found}

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [w for t in b.column(0).to_pylist() for w in set(WORD.findall(t.lower())) if len(w) <= WIDEST and any(f in odds for f in fragments(w))]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], names=["word"])

    words = sample.where("toxic = 1").select("text").mapInArrow(holds, "word string").groupBy("word").count()
    lexicon = Lexicon(choose(sorted((r[0], r[1]) for r in words.collect()), odds))  # words of the bounded sample

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([lexicon.vector(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64())), b.column(1).cast(pa.int32())], names=["x", "y"])

    got = sorted((list(r[0]), r[1]) for r in sample.mapInArrow(vectors, "x array<double>, y int").collect())  # a few numbers a row of the bounded sample
    weights, bias = logistic(np.array([x for x, _ in got]), np.array([y for _, y in got], float))
    return Model(lexicon, weights, bias)


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])


def rate(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most STEMS stems and a few weights

    def run(columns: list[pa.Array]) -> dict:
        scores = shared.value.score(columns[0].to_pylist())
        return {"score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return arrow_append(df, RESULT, run, [text], keep)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    return rate(docs.withColumn("held_out", held_out()), model, keep=["doc_id", "held_out"])
