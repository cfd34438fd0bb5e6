"""Ingest: front matter, audits, content classes, verse markers, chapter splitting and its validators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx

#: Chapter numbers above this are glued markers.
MOST_CHAPTERS = 250
#: A verse marker, alone or between slashes or bars; prefix, chapter and verse.
MARKER = r"(?:[/|]{2,}[ \t\n]*)?\b([A-Za-z]{2,6})_([0-9]+)\.([0-9]+)\b(?:[ \t\n]*[/|]{2,})?"
#: The heading forms of chapters.
HEADINGS = (
    ("h2 chapter", r"(?im)^\s*##\s*Chapter\s+([IVXLCDM]+|\d+)\b.*$"),
    ("h2 canto", r"(?im)^\s*##\s*Canto\s+(\d+)\b.*$"),
    ("h2 adhyaya", r"(?imu)^\s*##\s*Adhy[āa]ya\s+(\d+)\b.*$"),
    ("caps chapter", r"(?m)^\s*CHAPTER\s+([IVXLCDM]+|\d+)\b.*$"),
    ("plain chapter", r"(?m)^\s*Chapter\s+([IVXLCDM]+|\d+)\b.*$"),
    ("section", r"(?m)^\s*(?:SECTION|Section)\s+([IVXLCDM]+|\d+)\b.*$"),
    ("h3 topic", r"(?m)^\s*###\s*\[[^\]]+\].*$"),
    ("h2", r"(?m)^\s*##\s+\S.*$"),
    ("h3", r"(?m)^\s*###\s+\S.*$"),
)
# Languages in other scripts; authors whose works are verse.
NON_LATIN = ("sanskrit", "urdu", "kawi")
VERSE_AUTHORS = ("Allama Iqbal", "Mirza Ghalib", "Sheikh Ibrahim Zauq", "Cynewulf")


# -- front matter -------------------------------------------------------------------------------------------------------


def front_matter(raw: Column) -> Column:
    """The header between the first two lines of dashes; null without one."""
    h = F.regexp_extract(raw, r"\A---\n(?s:(.*?))\n---", 1)
    return F.when(raw.startswith("---\n") & raw.rlike(r"\A---\n(?s:.*?)\n---"), h)


def body_of(raw: Column) -> Column:
    """What follows the header, without leading line breaks; all of it without a header."""
    return F.when(front_matter(raw).isNull(), raw).otherwise(F.regexp_replace(raw, r"\A---\n(?s:.*?)\n---\n*", ""))


def stripped(raw: Column) -> Column:
    """The body as a browser reads it: lines may end in CR LF, and blanks before the text go."""
    return tx.strip_left(F.regexp_replace(raw, r"\A---\r?\n(?s:.*?)\r?\n---\r?\n", ""))


def header_map(raw: Column) -> Column:
    """key -> raw value of the header's top-level lines."""
    lines = F.filter(F.split(F.coalesce(front_matter(raw), F.lit("")), "\n"), lambda x: x.rlike(r"^\w+:"))
    return F.map_from_entries(F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(\w+):", 1), F.trim(F.regexp_extract(x, r"^\w+:\s*(.*)$", 1)))))


def scalar(value: Column) -> Column:
    """(kind, text): how a header's value reads: null, bool, int, float or string (JSON-quoted ones unquoted)."""
    v = F.trim(value)
    kind = F.when(v.isin("", "~", "null"), "null").when(v.isin("true", "false"), "bool").when(v.rlike(r"^-?\d+$"), "int").when(v.rlike(r"^-?\d+\.\d+$"), "float").otherwise("string")
    quoted = F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")
    return F.struct(kind.alias("kind"), F.when(kind == "null", F.lit(None)).when(v.rlike(r'^".*"$'), F.coalesce(quoted, v)).otherwise(v).alias("text"))


def escaped(value: Column) -> Column:
    """A value as a header writes it: quoted where it has special characters or blanks at an end."""
    risky = value.rlike(r"""[:#\[\]{}&*!|>'"%@`\n]""") | (F.trim(value) != value) | (value == "")
    return F.when(risky, F.concat(F.lit('"'), F.replace(F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise(value)


def with_header(fields: dict[str, Column], body: Column) -> Column:
    """A document with a header of the fields that are not null."""
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), escaped(v.cast("string")))) for k, v in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def patched_header(raw: Column, patches: dict[str, str]) -> Column:
    """raw with header values replaced in place, and keys that it lacks appended."""
    h = front_matter(raw)
    lines = F.split(h, "\n")
    for k, v in patches.items():
        lines = F.when(_has(lines, k), _set(lines, k, v)).otherwise(F.concat(lines, F.array(F.lit(f"{k}: {v}"))))
    return F.when(h.isNull(), raw).otherwise(F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.regexp_replace(raw, r"\A---\n(?s:.*?)(?=\n---)", "")))


def _has(lines: Column, key: str) -> Column:
    return F.exists(lines, lambda x: x.startswith(f"{key}:"))


def _set(lines: Column, key: str, value: str) -> Column:
    return F.transform(lines, lambda x: F.when(x.startswith(f"{key}:"), F.lit(f"{key}: {value}")).otherwise(x))


# -- audit --------------------------------------------------------------------------------------------------------------


def content_type(language: Column, script: Column, original: Column, image: Column) -> Column:
    lang = F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(image.isNotNull() & (image != ""), "original").when(original.eqNullSafe(F.lit(False)), "translation")
        .when(lang.isin("old_english", "english", "french", "german"), "original")
        .when(lang.isin(*NON_LATIN) & (script == "latin"), "transliteration").when(original.eqNullSafe(F.lit(True)), "original").otherwise("unknown")
    )


def layout(author: Column, language: Column, kind: Column, text: Column, image: Column) -> Column:
    lang = F.lower(F.coalesce(language, F.lit("")))
    return (
        F.when(image.isNotNull() & (image != ""), "manuscript").when(author.isin(*VERSE_AUTHORS), "verse")
        .when(lang.isin("urdu", "old_english") & (kind != "translation"), "verse")
        .when(lang.isin("sanskrit", "kawi") & text.rlike(r"\b\w+_\d+\.\d+\s*//"), "verse")
        .when((kind == "translation") & (lang == "urdu"), "verse").otherwise("prose")
    )


def flags(title: Column, text: Column, stated: Column) -> Column:
    """The audit flags of a chapter, joined by commas."""
    delta = tx.word_count(text) - stated
    mismatch = (F.abs(delta) > F.greatest(F.lit(50.0), stated * 0.1)) & (stated > 0)
    return F.concat_ws(
        ",", F.when(F.coalesce(text, F.lit("")) == "", "empty-content"), F.when(F.contains(text, F.lit("�")), "encoding-damage"),
        F.when(mismatch, F.concat(F.lit("word-count-mismatch("), F.when(delta > 0, "+").otherwise(""), delta.cast("string"), F.lit(")"))), F.when(tx.generic_title(title), "generic-title"),
    )


def flag_histogram(audited: DataFrame) -> DataFrame:
    """(flag, n) over a column `flags`; what stands in brackets does not count."""
    return audited.select(F.explode(F.split("flags", ",")).alias("flag")).where("flag <> ''").groupBy(F.regexp_replace("flag", r"\(.*\)", "").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def elected(variants: DataFrame, floor: float = 0.10) -> DataFrame:
    """(chapter, file, ratio, action) over (chapter, file, body): the translation is the variant that reads most English.

    Empty variants are dropped; below the floor none is elected.
    """
    v = variants.withColumn("ratio", F.round(tx.stopword_ratio(F.col("body")), 6)).withColumn("stub", F.trim(F.coalesce("body", F.lit(""))) == "")
    rank = F.row_number().over(Window.partitionBy("chapter", "stub").orderBy(F.desc("ratio"), "file"))
    action = F.when(F.col("stub"), "drop").when((rank == 1) & (F.col("ratio") >= floor), "translation").otherwise("original")
    return v.select("chapter", "file", "ratio", action.alias("action"))


# -- markers and chapters -----------------------------------------------------------------------------------------------


def markers(bodies: DataFrame, separator: str = r"\n[ \t]*\n+") -> DataFrame:
    """(doc, pos, prefix, chapter, verse) over (doc, body): the marker that ends a paragraph, in order; others are citations."""
    p = bodies.select("doc", F.posexplode(F.split("body", separator)).alias("pos", "p"))
    ended = p.withColumn("last", F.regexp_extract(F.rtrim(F.regexp_replace("p", r"[ \t\n]+$", "")), MARKER + r"\z", 0)).where("last <> ''")
    return ended.select("doc", F.col("pos").cast("long").alias("pos"), F.regexp_extract("last", MARKER, 1).alias("prefix"), F.regexp_extract("last", MARKER, 2).cast("long").alias("chapter"), F.regexp_extract("last", MARKER, 3).cast("long").alias("verse"))


def native(m: DataFrame) -> DataFrame:
    """The markers of each document's commonest prefix; the first seen of equals."""
    by = m.groupBy("doc", "prefix").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    best = by.groupBy("doc").agg(F.min_by("prefix", F.struct(-F.col("n"), "first")).alias("prefix"))
    return m.join(best, ["doc", "prefix"], "left_semi")


def plausible(m: DataFrame) -> DataFrame:
    return m.where(F.col("chapter") <= MOST_CHAPTERS)


def anomalies(m: DataFrame) -> DataFrame:
    """(doc, pos, kind): implausible chapters; then, among plausible ones, repeats and steps back from the marker before."""
    w = Window.partitionBy("doc").orderBy("pos")
    odd = m.where(F.col("chapter") > MOST_CHAPTERS).select("doc", "pos", F.lit("implausible_chapter_number").alias("kind"))
    p = plausible(m).withColumn("pc", F.lag("chapter").over(w)).withColumn("pv", F.lag("verse").over(w)).withColumn("nth", F.row_number().over(Window.partitionBy("doc", "chapter", "verse").orderBy("pos")))
    kinds = F.array_compact(F.array(F.when(F.col("nth") > 1, "duplicate_verse"), F.when(F.col("chapter") < F.col("pc"), "chapter_out_of_order"), F.when((F.col("chapter") == F.col("pc")) & (F.col("verse") < F.col("pv")), "verse_out_of_order")))
    return odd.unionByName(p.select("doc", "pos", F.explode(kinds).alias("kind")))


def monotone(m: DataFrame) -> DataFrame:
    """Markers that exceed all before them: what is kept rises strictly, so the largest so far is the largest kept."""
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max(F.struct("chapter", "verse")).over(w)
    return m.withColumn("_t", top).where(F.col("_t").isNull() | (F.struct("chapter", "verse") > F.col("_t"))).drop("_t")


def verse_chapters(bodies: DataFrame) -> DataFrame:
    """The whole chain: markers, native prefix, plausible, rising."""
    return monotone(plausible(native(markers(bodies))))


def slices(bodies: DataFrame, m: DataFrame, separator: str = r"\n[ \t]*\n+") -> DataFrame:
    """(doc, chapter, first_verse, last_verse, content): a chapter reaches from the end of the one before to its last marker.

    The first takes what stands before it, the last what stands behind.
    """
    per = m.groupBy("doc", "chapter").agg(F.max("pos").alias("to"), F.min_by("verse", "pos").alias("first_verse"), F.max_by("verse", "pos").alias("last_verse"))
    w = Window.partitionBy("doc").orderBy("chapter")
    ends = per.withColumn("from", F.coalesce(F.lag("to").over(w) + 1, F.lit(0))).withColumn("last", F.lead("to").over(w).isNull())
    parts = bodies.select("doc", F.split("body", separator).alias("ps"))
    got = ends.join(parts, "doc")
    size = F.when(F.col("last"), F.size("ps") - F.col("from")).otherwise(F.col("to") - F.col("from") + 1)
    return got.select("doc", "chapter", "first_verse", "last_verse", F.array_join(F.slice("ps", F.col("from").cast("int") + 1, size.cast("int")), "\n\n").alias("content"))


def numbered_headings(bodies: DataFrame, heading: str) -> DataFrame:
    """(doc, chapter, title): the headings of a form, numbered in order."""
    return bodies.select("doc", F.posexplode(F.regexp_extract_all("body", F.lit(heading), F.lit(0))).alias("k", "title")).select("doc", (F.col("k") + 1).cast("long").alias("chapter"), tx.strip(F.col("title")).alias("title"))


def strongest_heading(body: Column) -> Column:
    """(n, form) of the heading form with most headings; the first of equals; 0 and null without any."""
    counts = [F.struct(F.regexp_count(body, F.lit(rx)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("form")) for k, (name, rx) in enumerate(HEADINGS)]
    best = F.array_max(F.array(*counts))
    return F.struct(best["n"].cast("long").alias("n"), F.when(best["n"] > 0, best["form"]).alias("form"))


def marker_stats(bodies: DataFrame) -> DataFrame:
    """(doc, markers, chapters, prefixes, headings, form)."""
    m = markers(bodies).groupBy("doc").agg(F.count(F.lit(1)).alias("markers"), F.countDistinct("chapter").alias("chapters"), F.array_join(F.sort_array(F.collect_set("prefix")), ",").alias("prefixes"))
    h = bodies.select("doc", strongest_heading(F.col("body")).alias("h"))
    return h.join(m, "doc", "left").select("doc", F.coalesce("markers", F.lit(0)).alias("markers"), F.coalesce("chapters", F.lit(0)).alias("chapters"), F.coalesce("prefixes", F.lit("")).alias("prefixes"), F.col("h.n").alias("headings"), F.col("h.form").alias("form"))


def splittability(stats: DataFrame) -> DataFrame:
    """(doc, class): A several chapters of one prefix, B one chapter of one prefix, C two headings or more, else E."""
    single = (F.col("prefixes") != "") & ~F.contains("prefixes", F.lit(","))
    return stats.select("doc", F.when(single & (F.col("chapters") > 1), "TYPE_A").when(single & (F.col("chapters") == 1), "TYPE_B").when(F.col("headings") >= 2, "TYPE_C").otherwise("TYPE_E").alias("class"))


def gaps(sliced: DataFrame) -> DataFrame:
    """(doc, chapter): numbers that are missing between a document's first and last chapter."""
    span = sliced.groupBy("doc").agg(F.min("chapter").alias("a"), F.max("chapter").alias("b"))
    return span.select("doc", F.explode(F.sequence("a", "b")).alias("chapter")).join(sliced.select("doc", "chapter"), ["doc", "chapter"], "left_anti")


def validated(bodies: DataFrame, source: DataFrame, sliced: DataFrame, kept: DataFrame, least_chars: int = 20, separator: str = r"\n[ \t]*\n+") -> DataFrame:
    """(doc, validator, severity, detail). source: native markers; kept: markers of the slices; sliced: the slices."""
    def issues(df: DataFrame, validator: str, severity: str, detail: Column) -> DataFrame:
        return df.select("doc", F.lit(validator).alias("validator"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))

    key = F.concat_ws(".", "chapter", "verse")
    keys = ["doc", "chapter", "verse"]
    out = issues(source.select(*keys).distinct().join(kept, keys, "left_anti"), "marker-preservation", "error", key)
    out = out.unionByName(issues(kept.select(*keys).distinct().join(source, keys, "left_anti"), "marker-preservation", "error", key))
    out = out.unionByName(issues(kept.groupBy(*keys).count().where("count > 1"), "no-marker-duplication", "error", key))
    # What parts paragraphs is no content: it counts as one blank line, also where a slice ends.
    sizes = sliced.groupBy("doc").agg((F.sum(F.length("content") + 2) - 2).alias("n")).join(bodies, "doc")
    lost = F.length(F.regexp_replace("body", separator, "\n\n")) - F.col("n")
    out = out.unionByName(issues(sizes.where(F.abs(lost) > F.greatest(F.lit(50), F.ceil(F.length("body") * 0.005))), "content-conservation", "error", lost))
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    joined = sliced.groupBy("doc").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter", "content"))), lambda x: x["content"]), "\n\n").alias("again")).join(bodies, "doc")
    out = out.unionByName(issues(joined.where(flat(F.col("again")) != flat(F.col("body"))), "round-trip-integrity", "error", F.length("again")))
    w = Window.partitionBy("doc", "chapter").orderBy("pos")
    out = out.unionByName(issues(kept.withColumn("pv", F.lag("verse").over(w)).where("verse < pv"), "verse-monotonicity", "error", key))
    out = out.unionByName(issues(sliced.where(F.length(flat(F.col("content"))) < least_chars), "no-empty-chapter", "error", F.col("chapter")))
    out = out.unionByName(issues(sliced.groupBy("doc").agg(F.min("chapter").alias("a")).where("a <> 1"), "chapter-coverage", "warn", F.col("a")))
    return out.unionByName(issues(gaps(sliced), "chapter-coverage", "warn", F.col("chapter")))


def disagreements(sets: DataFrame) -> DataFrame:
    """(doc, variant, chapter, side) over (doc, variant, chapter): chapters that the first variant has and another lacks, or the reverse."""
    v = sets.select("doc", "variant").distinct()
    first = v.groupBy("doc").agg(F.min("variant").alias("first"))
    others = v.join(first, "doc").where("variant <> first")
    base = sets.join(first, "doc").where("variant = first").select("doc", "chapter").distinct()
    lacks = others.join(base, "doc").select("doc", "variant", "chapter").join(sets, ["doc", "variant", "chapter"], "left_anti").withColumn("side", F.lit("only-in-first"))
    extra = sets.join(others.select("doc", "variant"), ["doc", "variant"]).select("doc", "variant", "chapter").distinct().join(base, ["doc", "chapter"], "left_anti").select("doc", "variant", "chapter").withColumn("side", F.lit("only-in-other"))
    return lacks.unionByName(extra)


def cleaned(body: Column) -> Column:
    """A body without source lines, line counts and rules."""
    out = F.regexp_replace(body, r"(?m)^Source:[^\n]*\n?", "")
    out = F.regexp_replace(out, r"(?m)^Lines:[^\n]*\n?", "")
    return tx.strip(F.regexp_replace(out, r"(?m)^[ \t]*-{3,}[ \t]*\n?", ""))
