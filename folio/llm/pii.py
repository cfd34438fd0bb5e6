"""Personal data: offset-preserving deobfuscation, then detection, then spans in the source text.

Base spans are found in the text as it stands. Where a text shows a disguise, a chain of transducers rewrites it
(homoglyphs, spelled digits, "at" and "dot") and carries for each written character the source span it came from;
identifiers found in the rewritten text are mapped back, and added where no base span of their kind holds them.

Null text: like the empty one, no spans. Repeated rows: each has its own result. Every scan is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from folio.llm.common import arrow_append, load, tune

KINDS = ("email", "ip", "card", "phone")

# Look-alikes of ASCII letters in the Cyrillic and Greek scripts.
LOOKALIKES = dict(zip("АВЕКМНОРСТХУаеорсхуіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοορ", "ABEKMHOPCTXYaeopcxyijsdhqwABEZHIKMNOPTYXoop", strict=True))
# Names of the ten digits in four languages.
DIGIT_NAMES = {
    "en": "zero one two three four five six seven eight nine",
    "de": "null eins zwei drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
DIGITS = {w: str(d) for names in DIGIT_NAMES.values() for d, w in enumerate(names.split())} | {"oh": "0", "plus": "+"}

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A number can start only where a run of digits starts: the look-behind and the possessive runs keep scans linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NUMBER_RUN = re.compile(r"(?<!\w)(?:(?:%s)(?:[ -]|(?!\w))){4,}" % "|".join(sorted(DIGITS, key=len, reverse=True)), re.I)
# Four parts of digits, or of one to three names of digits, with "dot" words between them: an address.
PART = r"(?:[0-9]{1,3}|(?:%s)(?:[ -](?:%s)){0,2})" % (("|".join(sorted(DIGITS.keys() - {"plus"}, key=len, reverse=True)),) * 2)
DOTTED = re.compile(rf"(?<![\w.]){PART}(?:[ \t]+(?:dot|punto|punkt|point)[ \t]+{PART}){{3}}(?![\w])", re.I)
NUMBER_WORD = re.compile(r"(?<!\w)(?:%s)(?!\w)" % "|".join(sorted(DIGITS, key=len, reverse=True)), re.I)
# Blanks before a bracket are tried only from where they begin.
BRACKETED = re.compile(r"(?:(?<!\s)\s++)?[\[({<]\s*+(at|dot|punto|arroba|punkt|point)\s*+[\])}>]\s*+", re.I)
# The endings that a bare "dot" must lead to.
ENDINGS = "com org net edu gov mil int info io co biz me tv dev app ai eu uk de fr es it nl ch at be pl us ca au jp cn in br mx".split()
# The labels, besides the first and the ending, of a host name that is written with bare dots.
LABELS = 20
# The bare dots that may follow a bare "at" word; "at this point in" is plain English, so "point" needs "arroba".
BARE_WORDS = {"at": "dot|punto|punkt", "arroba": "dot|punto|punkt|point"}
SPACED = re.compile(r"(?<=[A-Za-z0-9_%%+-])(?:%s)[ \t]+(?:%s)(?![A-Za-z0-9-])" % ("|".join(rf"[ \t]+{at}[ \t]+[A-Za-z0-9-]+(?:[ \t]+(?:{dots})[ \t]+[A-Za-z0-9-]+){{0,%d}}?[ \t]+(?:{dots})" % LABELS for at, dots in BARE_WORDS.items()), "|".join(ENDINGS)), re.I)
BARE = re.compile(r"[ \t]+(at|arroba|dot|punto|punkt|point)[ \t]+", re.I)
SYMBOL = {"at": "@", "arroba": "@", "dot": ".", "punto": ".", "punkt": ".", "point": "."}


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(s: str) -> list[tuple[int, int]]:
    """Each "@" is taken with the run of local characters before it: the leftmost match starts where that run does."""
    out, end, at = [], 0, s.find("@")
    while at >= 0:
        i = at
        while i > end and LOCAL.match(s, i - 1):
            i -= 1
        m = DOMAIN.match(s, at + 1) if i < at else None
        if m:
            out.append((i, m.end()))
            end = m.end()
        at = s.find("@", max(end, at + 1))
    return out


def base_spans(s: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in s:
        out["email"] = emails(s)
    if DIGIT.search(s):
        out["ip"] = [m.span() for m in IP.finditer(s) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(s):
            if m.end() - m.start() >= 13 and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out["card"].append(m.span())
        if "+" in s:
            out["phone"] = [m.span() for m in PHONE.finditer(s) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return out


class Tape:
    """A rewritten text; places[i] is the source span of its i-th character."""

    def __init__(self, text: str):
        self.text, self.places = text, [(i, i + 1) for i in range(len(text))]

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, written) in order, not overlapping; a written text stands for the whole source of its span."""
        text, places, at = [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            places += self.places[at:a] + [(self.places[a][0], self.places[b - 1][1])] * len(new)
            at = b
        self.text, self.places = "".join([*text, self.text[at:]]), places + self.places[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.places[a][0], self.places[b - 1][1]


def plain(ch: str) -> str:
    """The ASCII character that ch imitates, or ch."""
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    folded = unicodedata.normalize("NFKC", ch)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else ch


def folded() -> str:
    """A character class of all characters that plain() changes."""
    codes = [c for c in range(0x80, 0x110000) if plain(chr(c)) != chr(c)]
    firsts = [c for k, c in enumerate(codes) if not k or codes[k - 1] != c - 1]
    lasts = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] != c + 1]
    return "[%s]" % "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(firsts, lasts, strict=True))


#: What some transducer could rewrite, besides names of digits. Characters are told by case: their class is exact.
TRIGGER = re.compile(r"(?i:[\[({<]\s*(?:at|dot|punto|arroba|punkt|point)\s*[\])}>]|[ \t](?:dot|punto|punkt|point)[ \t])|" + folded())


def homoglyphs(t: Tape) -> None:
    t.rewrite([(i, i + 1, p) for i, ch in enumerate(t.text) if not ch.isascii() and (p := plain(ch)) != ch])


def spelled_digits(t: Tape) -> None:
    """Four or more names of digits in a row; the blanks and hyphens between them go."""
    edits = []
    for m in NUMBER_RUN.finditer(t.text):
        words = list(NUMBER_WORD.finditer(t.text, m.start(), m.end()))
        ends = [w.start() for w in words[1:]] + [words[-1].end()]
        edits += [(w.start(), end, DIGITS[w.group().lower()]) for w, end in zip(words, ends, strict=True)]
    t.rewrite(edits)


def dotted_numbers(t: Tape) -> None:
    """In an address of four parts the words for dots become dots and names of digits become digits."""
    edits = []
    for m in DOTTED.finditer(t.text):
        names = list(NUMBER_WORD.finditer(t.text, m.start(), m.end()))
        follows = {a.end(): b.start() for a, b in zip(names, names[1:], strict=False) if b.start() - a.end() == 1}
        edits += [(w.start(), follows.get(w.end(), w.end()), DIGITS[w.group().lower()]) for w in names]
        edits += [(w.start(), w.end(), ".") for w in BARE.finditer(t.text, m.start(), m.end())]
    t.rewrite(sorted(edits))


def at_and_dot(t: Tape) -> None:
    """Brackets always disguise; bare words only where "at" is followed by names, a "dot" between them, up to a known ending."""
    t.rewrite([(m.start(), m.end(), SYMBOL[m.group(1).lower()]) for m in BRACKETED.finditer(t.text)])
    edits = []
    for m in SPACED.finditer(t.text):
        words = list(BARE.finditer(t.text, m.start(), m.end()))
        edits += [(w.start(), w.end(), "@" if k == 0 else ".") for k, w in enumerate(words) if k == 0 or SYMBOL[w.group(1).lower()] == "."]
    t.rewrite(edits)


TRANSDUCERS = (homoglyphs, dotted_numbers, spelled_digits, at_and_dot)


def added_spans(s: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    if not TRIGGER.search(s) and not NUMBER_RUN.search(s):
        return {k: [] for k in KINDS}
    t = Tape(s)
    for step in TRANSDUCERS:
        step(t)
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if t.text != s:
        for kind, spans in base_spans(t.text).items():
            for a, b in spans:
                x, y = t.source(a, b)
                if s[x:y] != t.text[a:b] and not any(p <= x and y <= q for p, q in base[kind]):
                    out[kind].append((x, y))
    return out


def find(s: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """The base spans and the added ones of a text, by kind; code points, end exclusive."""
    base = base_spans(s or "")
    return base, added_spans(s or "", base)


def listed(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def masked(s: str | None) -> str | None:
    """The text with each span (or run of overlapping spans) replaced by the name of its first kind."""
    if s is None:
        return None
    base, more = find(s)
    spans = sorted((a, b, k) for x in (base, more) for k in KINDS for a, b in x[k])
    if not spans:
        return s
    out, at, k = [], 0, 0
    while k < len(spans):
        a, b, kind = spans[k]
        while k < len(spans) and spans[k][0] < b:
            b = max(b, spans[k][1])
            k += 1
        out += [s[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, s[at:]])


DIGEST = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])


def _digest(columns: list[pa.Array]) -> dict:
    out: dict[str, list] = {f.name: [] for f in DIGEST.fields}
    for s in columns[0].to_pylist():
        base, more = find(s)
        for k in KINDS:
            out[f"n_{k}"].append(len(base[k]))
        out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
        out["spans"].append(listed({k: base[k] + more[k] for k in KINDS}))
        out["n_added"].append(sum(map(len, more.values())))
    return out


def detect(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Appends the counts of base spans by kind, their digest, all spans, and the number of added ones."""
    return arrow_append(df, DIGEST, _digest, [text], keep)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with personal data in `text` replaced by the names of their kinds."""
    return arrow_append(df, T.StructType([T.StructField(text, T.StringType())]), lambda c: {text: [masked(s) for s in c[0].to_pylist()]}, [text]).select(*[f"`{c}`" for c in df.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return detect(load(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
