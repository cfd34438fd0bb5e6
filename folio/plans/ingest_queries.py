"""Queries of the ingest operators, with their SQL. Marker fixtures are made from the documents by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.operators import ingest
from folio.plans.sql import BLANKS, trim
from folio.sources.tables import documents

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, body): documents whose lines are paragraphs, most of which end in a verse marker made from the line's place.

    Every third document has markers; some are repeated, step back, have a foreign prefix or an implausible chapter.
    """
    marked = F.transform(
        F.split("text", "\n"),
        lambda p, i: F.when((F.col("doc_id") % 3 != 0) | (i % 4 == 3), p).otherwise(
            F.concat(p, F.lit(" // "), F.when((i + F.col("doc_id")) % 13 == 5, "Zz").otherwise("Mn"), F.lit("_"), F.when((i + F.col("doc_id")) % 17 == 4, 1516).otherwise(F.floor(i / 5) + 1).cast("string"), F.lit("."), F.when((i + F.col("doc_id")) % 11 == 6, F.greatest(i - 2, F.lit(0))).otherwise(i % 5 + 1).cast("string"), F.lit(" //"))
        ),
    )
    return documents(spark, sf).select(F.col("doc_id").alias("doc"), F.array_join(marked, "\n\n").alias("body"))


MARKED = """lines AS (SELECT doc_id AS doc, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
mk AS (SELECT doc, i AS pos, p, CASE WHEN (i + doc) % 13 = 5 THEN 'Zz' ELSE 'Mn' END AS prefix, CASE WHEN (i + doc) % 17 = 4 THEN 1516 ELSE i // 5 + 1 END AS chapter, CASE WHEN (i + doc) % 11 = 6 THEN greatest(i - 2, 0) ELSE i % 5 + 1 END AS verse, doc % 3 = 0 AND i % 4 <> 3 AS has FROM lines),
body AS (SELECT doc, i, CASE WHEN has THEN p || ' // ' || prefix || '_' || chapter || '.' || verse || ' //' ELSE p END AS p FROM (SELECT *, pos AS i FROM mk)),
m AS (SELECT doc, pos, prefix, chapter, verse FROM mk WHERE has),
pre AS (SELECT doc, prefix FROM (SELECT doc, prefix, count(*) AS n, min(pos) AS f FROM m GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, f) = 1),
nat AS (SELECT m.* FROM m JOIN pre USING (doc, prefix)), pl AS (SELECT * FROM nat WHERE chapter <= 250),
mono AS (SELECT doc, pos, prefix, chapter, verse FROM pl QUALIFY coalesce(chapter * 1000000 + verse > max(chapter * 1000000 + verse) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))"""
SLICES = f"""{MARKED}, per AS (SELECT doc, chapter, max(pos) AS t, arg_min(verse, pos) AS first_verse, arg_max(verse, pos) AS last_verse FROM mono GROUP BY ALL),
ends AS (SELECT *, coalesce(lag(t) OVER w + 1, 0) AS f, lead(t) OVER w IS NULL AS last FROM per WINDOW w AS (PARTITION BY doc ORDER BY chapter)),
sl AS (SELECT e.doc, e.chapter, e.first_verse, e.last_verse, string_agg(b.p, chr(10) || chr(10) ORDER BY b.i) AS content FROM ends e JOIN body b ON b.doc = e.doc AND b.i >= e.f AND (e.last OR b.i <= e.t) GROUP BY ALL)"""


@query("o075_markers", f"WITH {MARKED} SELECT doc, pos, prefix, chapter, verse FROM m")
def markers(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.markers(bodies(spark, sf))


@query("o067_native_prefix", f"WITH {MARKED} SELECT doc, pos, prefix, chapter, verse FROM nat")
def native(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.native(ingest.markers(bodies(spark, sf)))


@query("o150_plausible", f"WITH {MARKED} SELECT doc, pos, prefix, chapter, verse FROM pl")
def plausible(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.plausible(ingest.native(ingest.markers(bodies(spark, sf))))


@query("o076_running_max", f"WITH {MARKED} SELECT doc, pos, prefix, chapter, verse FROM mono")
def running_max(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.verse_chapters(bodies(spark, sf))


@query("o077_anomalies", f"""WITH {MARKED}, x AS (SELECT *, lag(chapter) OVER w AS pc, lag(verse) OVER w AS pv, row_number() OVER (PARTITION BY doc, chapter, verse ORDER BY pos) AS nth FROM pl WINDOW w AS (PARTITION BY doc ORDER BY pos))
SELECT doc, pos, 'implausible_chapter_number' AS kind FROM nat WHERE chapter > 250 UNION ALL SELECT doc, pos, 'duplicate_verse' FROM x WHERE nth > 1 UNION ALL SELECT doc, pos, 'chapter_out_of_order' FROM x WHERE chapter < pc UNION ALL SELECT doc, pos, 'verse_out_of_order' FROM x WHERE chapter = pc AND verse < pv""")
def anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.anomalies(ingest.native(ingest.markers(bodies(spark, sf))))


@query("o078_slices", f"WITH {SLICES} SELECT doc, chapter, first_verse, last_verse, content FROM sl")
def slices(spark: SparkSession, sf: str) -> DataFrame:
    b = bodies(spark, sf)
    return ingest.slices(b, ingest.verse_chapters(b))


@query("o095_gaps", f"WITH {SLICES}, k AS (SELECT doc, chapter FROM sl WHERE chapter % 2 = 1 OR chapter % 3 = 0), sp AS (SELECT doc, min(chapter) AS a, max(chapter) AS b FROM k GROUP BY doc), al AS (SELECT doc, unnest(range(a, b + 1)) AS chapter FROM sp) SELECT doc, chapter FROM al EXCEPT SELECT doc, chapter FROM k")
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    b = bodies(spark, sf)
    return ingest.gaps(ingest.slices(b, ingest.verse_chapters(b)).where("chapter % 2 = 1 or chapter % 3 = 0"))


@query("o117_validators", f"""WITH {SLICES}, keys AS (SELECT DISTINCT doc, chapter, verse FROM nat), kk AS (SELECT DISTINCT doc, chapter, verse FROM mono)
SELECT doc, 'marker-preservation' AS validator, 'error' AS severity, chapter || '.' || verse AS detail FROM (SELECT * FROM keys EXCEPT SELECT * FROM kk)
UNION ALL SELECT doc, 'no-empty-chapter', 'error', chapter::VARCHAR FROM sl WHERE length(trim(regexp_replace(content, '\\s+', ' ', 'g'))) < 60
UNION ALL SELECT doc, 'chapter-coverage', 'warn', a::VARCHAR FROM (SELECT doc, min(chapter) AS a FROM sl GROUP BY doc) WHERE a <> 1
UNION ALL SELECT doc, 'chapter-coverage', 'warn', chapter::VARCHAR FROM (SELECT doc, unnest(range(min(chapter), max(chapter) + 1)) AS chapter FROM sl GROUP BY doc EXCEPT SELECT doc, chapter FROM sl)""")
def validators(spark: SparkSession, sf: str) -> DataFrame:
    b = bodies(spark, sf)
    source = ingest.native(ingest.markers(b))
    kept = ingest.monotone(ingest.plausible(source))
    return ingest.validated(b, source, ingest.slices(b, kept), kept, 60)


@query("o072_marker_stats", f"WITH {MARKED} SELECT d.doc_id AS doc, count(m.pos) AS markers, count(DISTINCT m.chapter) AS chapters, coalesce(string_agg(DISTINCT m.prefix, ',' ORDER BY m.prefix), '') AS prefixes, 0 AS headings, NULL AS form FROM documents d LEFT JOIN m ON m.doc = d.doc_id GROUP BY d.doc_id")
def marker_stats(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.marker_stats(bodies(spark, sf))


@query("o116_splittability", f"WITH {MARKED}, s AS (SELECT d.doc_id AS doc, count(DISTINCT m.chapter) AS c, count(DISTINCT m.prefix) AS p FROM documents d LEFT JOIN m ON m.doc = d.doc_id GROUP BY d.doc_id) SELECT doc, CASE WHEN p = 1 AND c > 1 THEN 'TYPE_A' WHEN p = 1 AND c = 1 THEN 'TYPE_B' ELSE 'TYPE_E' END AS class FROM s")
def splittability(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.splittability(ingest.marker_stats(bodies(spark, sf)))


FIXTURE_HEADINGS = "(VALUES (1, '## Chapter I: A\n\ntext\n\n## Chapter II\n\nmore'), (2, 'CHAPTER 1\n\nx\n\nCHAPTER 2\n\ny\n\nCHAPTER 3'), (3, 'plain text only'), (4, '### [On duty] first\n\nb\n\n### [On law]')) t(doc, body)"


@query("o080_heading_numbers", "SELECT * FROM (VALUES (2, 1, 'CHAPTER 1'), (2, 2, 'CHAPTER 2'), (2, 3, 'CHAPTER 3')) t(doc, chapter, title)")
def heading_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.numbered_headings(spark.sql(f"SELECT * FROM {FIXTURE_HEADINGS}"), dict(ingest.HEADINGS)["caps chapter"])


@query("o115_heading_forms", "SELECT * FROM (VALUES (1, 2, 'h2 chapter'), (2, 3, 'caps chapter'), (3, 0, NULL), (4, 2, 'h3 topic')) t(doc, n, form)")
def heading_forms(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {FIXTURE_HEADINGS}").select("doc", ingest.strongest_heading(F.col("body")).alias("h")).select("doc", "h.n", "h.form")


@query("o092_chapter_disagreements", "WITH s AS (SELECT source AS doc, lang AS variant, doc_id % 7 AS chapter FROM documents WHERE doc_id % 5 <> 0), v AS (SELECT DISTINCT doc, variant FROM s), f AS (SELECT doc, min(variant) AS first FROM v GROUP BY doc), b AS (SELECT DISTINCT s.doc, chapter FROM s JOIN f ON f.doc = s.doc AND s.variant = f.first), o AS (SELECT v.doc, v.variant FROM v JOIN f USING (doc) WHERE variant <> first) SELECT o.doc, o.variant, b.chapter, 'only-in-first' AS side FROM o JOIN b USING (doc) WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.doc = o.doc AND s.variant = o.variant AND s.chapter = b.chapter) UNION ALL SELECT DISTINCT s.doc, s.variant, s.chapter, 'only-in-other' FROM s JOIN o USING (doc, variant) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc = s.doc AND b.chapter = s.chapter)")
def disagreements(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.disagreements(documents(spark, sf).where("doc_id % 5 <> 0").select(F.col("source").alias("doc"), F.col("lang").alias("variant"), (F.col("doc_id") % 7).alias("chapter")))


@query("o109_content_types", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'original' WHEN doc_id % 4 = 1 THEN 'translation' WHEN lang IN ('en', 'fr', 'de') THEN 'original' WHEN doc_id % 4 = 2 THEN 'transliteration' WHEN doc_id % 4 = 3 THEN 'transliteration' ELSE 'transliteration' END AS content_type FROM documents")
def content_types(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.create_map(*[F.lit(x) for x in ("en", "english", "fr", "french", "de", "german", "es", "sanskrit")])[F.col("lang")]
    original = F.when(F.col("doc_id") % 4 == 1, F.lit(False)).when(F.col("doc_id") % 4 == 2, F.lit(True))
    image = F.when(F.col("doc_id") % 9 == 0, "page.png")
    return documents(spark, sf).select("doc_id", ingest.content_type(lang, F.lit("latin"), original, image).alias("content_type"))


@query("o110_layouts", "SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'manuscript' WHEN source = 'src1' THEN 'verse' WHEN lang = 'es' THEN 'verse' ELSE 'prose' END AS layout FROM documents")
def layouts(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.create_map(*[F.lit(x) for x in ("en", "english", "fr", "french", "de", "german", "es", "urdu")])[F.col("lang")]
    author = F.when(F.col("source") == "src1", "Cynewulf").otherwise("nobody")
    return documents(spark, sf).select("doc_id", ingest.layout(author, lang, F.lit("original"), F.col("text"), F.when(F.col("doc_id") % 9 == 0, "page.png")).alias("layout"))


AUDIT = f"""w AS (SELECT doc_id, len(list_filter(regexp_split_to_array({trim('text')}, '{BLANKS}+'), lambda q: q <> ''))::BIGINT AS words, n_chars // 5 AS stated, CASE WHEN doc_id % 6 = 0 THEN 'Chapter ' || doc_id ELSE 'On ' || source END AS title FROM documents),
a AS (SELECT doc_id, concat_ws(',', CASE WHEN abs(words - stated) > greatest(50, stated * 0.1) AND stated > 0 THEN 'word-count-mismatch(' || CASE WHEN words > stated THEN '+' ELSE '' END || (words - stated) || ')' END, CASE WHEN doc_id % 6 = 0 THEN 'generic-title' END) AS flags FROM w)"""


def audit(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Chapter "), "doc_id")).otherwise(F.concat(F.lit("On "), "source"))
    return documents(spark, sf).select("doc_id", ingest.flags(title, F.col("text"), F.floor(F.col("n_chars") / 5)).alias("flags"))


@query("o112_audit_flags", f"WITH {AUDIT} SELECT * FROM a")
def audit_flags(spark: SparkSession, sf: str) -> DataFrame:
    return audit(spark, sf)


@query("o056_audit_summary", f"WITH {AUDIT}, f AS (SELECT unnest(string_split(flags, ',')) AS flag FROM a) SELECT regexp_replace(flag, '\\(.*\\)', '') AS flag, count(*) AS n FROM f WHERE flag <> '' GROUP BY 1")
def audit_summary(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.flag_histogram(audit(spark, sf))


@query("o114_election")
def election(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.concat_ws("-", "source", (F.col("doc_id") % 5).cast("string")).alias("chapter"), F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.when(F.col("doc_id") % 19 == 0, " ").otherwise(F.col("text")).alias("body"))
    return ingest.elected(d)


FM = "'---' || chr(10) || 'title: ' || CASE WHEN doc_id % 2 = 0 THEN '\"A: ' || source || '\"' ELSE source END || chr(10) || 'number: ' || doc_id || chr(10) || '---' || chr(10) || chr(10)"


def written(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("A: "), "source")).otherwise(F.col("source"))
    return documents(spark, sf).select("doc_id", ingest.with_header({"title": title, "number": F.col("doc_id"), "note": F.lit(None).cast("string")}, F.col("text")).alias("raw"))


@query("o018_front_matter_writer", f"SELECT doc_id, {FM} || text AS raw FROM documents")
def writer(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf)


@query("o148_front_matter_parser", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'A: ' || source ELSE source END AS title, doc_id::VARCHAR AS number, 'int' AS kind, text AS body FROM documents")
def parser(spark: SparkSession, sf: str) -> DataFrame:
    m = written(spark, sf).withColumn("h", ingest.header_map(F.col("raw")))
    return m.select("doc_id", ingest.scalar(F.col("h")["title"])["text"].alias("title"), ingest.scalar(F.col("h")["number"])["text"].alias("number"), ingest.scalar(F.col("h")["number"])["kind"].alias("kind"), ingest.body_of(F.col("raw")).alias("body"))


@query("o019_front_matter_patch", "SELECT doc_id, '---' || chr(10) || 'title: new' || chr(10) || 'number: ' || doc_id || chr(10) || 'checked: true' || chr(10) || '---' || chr(10) || chr(10) || text AS raw FROM documents")
def patch(spark: SparkSession, sf: str) -> DataFrame:
    return written(spark, sf).select("doc_id", ingest.patched_header(F.col("raw"), {"title": "new", "checked": "true"}).alias("raw"))


@query("o122_cleaned", f"SELECT doc_id, {trim('text')} AS body FROM documents")
def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("Source: http://x.org/a\nLines: 3\n---\n"), "text", F.lit("\n ---- "))
    return documents(spark, sf).select("doc_id", ingest.cleaned(raw).alias("body"))


@query("o106_slug_fixture", "SELECT * FROM (VALUES ('Déjà Vu: The ''Œuvre'' & Straße!', 'deja-vu-the-oeuvre-strasse'), ('', ''), ('--A--b__c--', 'a-b-c')) t(title, slug)")
def slug_fixture(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([("Déjà Vu: The 'Œuvre' & Straße!",), ("",), ("--A--b__c--",)], "title string").select("title", tx.slugify(F.col("title")).alias("slug"))
