"""Queries of the chapter, variant and plan operators, with their SQL; variants are made from the documents by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.operators import corpus, evals, ingest
from folio.plans.sql import BLANKS, WORKS
from folio.sources import files
from folio.sources.tables import documents, table, works
from folio.streaming.ledger import progress

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Four neighbouring documents of a work are the variants of a chapter.
RANK = "CASE content_type WHEN 'translation' THEN 1 WHEN 'transliteration' THEN 2 WHEN 'original' THEN 3 ELSE 4 END"
KIND = "CASE doc_id % 5 WHEN 0 THEN 'translation' WHEN 1 THEN 'transliteration' WHEN 2 THEN 'original' ELSE 'notes' END"
VARIANTS = f"""plainv AS (SELECT source AS work, doc_id // 4 AS chapter, doc_id AS place, lang || '-' || doc_id || '.md' AS file, {KIND} AS content_type FROM documents),
vars AS (SELECT *, first(file) OVER (PARTITION BY work, chapter ORDER BY {RANK}, place) AS default_file FROM plainv)"""


def variants(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.col("source").alias("work"), F.floor(F.col("doc_id") / 4).alias("chapter"), F.col("doc_id").alias("place"), F.concat("lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("file"), F.expr(KIND).alias("content_type"))
    return corpus.defaults(d)


@query("o008_roman_source", "WITH x AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'urdu' ELSE 'greek' END AS language FROM documents) SELECT doc_id, CASE WHEN language IN ('english', 'german') AND doc_id % 3 <> 0 THEN 'original.md' WHEN language = 'urdu' AND doc_id % 2 = 0 THEN 'transliteration.md' END AS file, CASE WHEN language IN ('english', 'german') AND doc_id % 3 <> 0 THEN 'native-roman' WHEN language = 'urdu' AND doc_id % 2 = 0 THEN 'transliteration' END AS kind FROM x")
def roman_source(spark: SparkSession, sf: str) -> DataFrame:
    language = F.when(F.col("lang") == "en", "english").when(F.col("lang") == "de", "german").when(F.col("lang") == "fr", "urdu").otherwise("greek")
    picked = corpus.roman_source(language, F.col("doc_id") % 3 != 0, F.col("doc_id") % 2 == 0)
    return documents(spark, sf).select("doc_id", picked["file"].alias("file"), picked["kind"].alias("kind"))


@query("o037_indexable", f"WITH {VARIANTS} SELECT work, chapter, file FROM vars WHERE content_type = 'translation'")
def indexable(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.indexable(variants(spark, sf)).select("work", "chapter", "file")


@query("o158_flattened", f"WITH {VARIANTS} SELECT work, chapter, content_type, file = default_file AS is_default FROM vars")
def flattened(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.flattened(variants(spark, sf))


@query("o155_reclassified", f"""WITH {VARIANTS}, met AS (SELECT *, max(CASE WHEN place % 7 IN (0, 1) AND file = default_file THEN 1 ELSE 0 END) OVER (PARTITION BY work, chapter) AS lost FROM vars),
kept AS (SELECT work, chapter, place, default_file, lost, CASE WHEN place % 7 = 1 THEN 'roman-' || place || '.md' ELSE file END AS file, CASE WHEN place % 7 = 1 THEN 'transliteration' ELSE content_type END AS content_type FROM met WHERE place % 7 <> 0)
SELECT work, chapter, place, file, content_type, CASE WHEN lost = 1 THEN first(file) OVER (PARTITION BY work, chapter ORDER BY {RANK}, place) ELSE default_file END AS default_file FROM kept""")
def reclassified(spark: SparkSession, sf: str) -> DataFrame:
    v = variants(spark, sf)
    renamed = F.when(F.col("place") % 7 == 1, F.concat(F.lit("roman-"), F.col("place").cast("string"), F.lit(".md")))
    return corpus.reclassified(v, v.where("place % 7 in (0, 1)").select("work", "chapter", "file", renamed.alias("new_file")))


RULES = [("src1", None, "prose-heading", 2, "^Chapter [0-9]+", None), ("src1", "de.md", "bracketed-section", None, None, None), ("src2", None, "prose-heading", 3, None, "^Title")]
HEADED = "CASE WHEN i % 4 = 0 THEN '## ' || CASE WHEN i % 8 = 0 THEN 'Chapter ' ELSE 'Preface ' END || i WHEN i % 4 = 1 THEN '[part ' || i || ']' WHEN i % 4 = 2 THEN '### ' || CASE WHEN i % 8 = 2 THEN 'Title ' ELSE 'Part ' END || i ELSE p END"


@query("o152_sections", f"""WITH lines AS (SELECT source, doc_id, lang, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE source IN ('src1', 'src2')),
h AS (SELECT source AS work, doc_id, lang || '.md' AS lang_file, i, {HEADED} AS line FROM lines),
t AS (SELECT *, trim(regexp_extract(line, '^#+\\s+(.+)$', 1)) AS title, length(regexp_extract(line, '^(#+)\\s', 1)) AS depth FROM h),
f AS (SELECT work, doc_id, i AS pos, CASE WHEN work = 'src1' AND lang_file = 'de.md' THEN trim(line) ELSE title END AS title FROM t WHERE CASE WHEN work = 'src1' AND lang_file = 'de.md' THEN regexp_matches(line, '^\\s*\\[[^\\]]+\\]\\s*$') WHEN work = 'src1' THEN title <> '' AND depth = 2 AND regexp_matches(title, '^Chapter [0-9]+') ELSE title <> '' AND depth = 3 AND NOT regexp_matches(title, '^Title') END)
SELECT work, doc_id, row_number() OVER (PARTITION BY work, doc_id ORDER BY pos) AS chapter, pos, title FROM f""")
def sections(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.when(i % 4 == 0, F.concat(F.lit("## "), F.when(i % 8 == 0, "Chapter ").otherwise("Preface "), i.cast("string"))).when(i % 4 == 1, F.concat(F.lit("[part "), i.cast("string"), F.lit("]"))).when(i % 4 == 2, F.concat(F.lit("### "), F.when(i % 8 == 2, "Title ").otherwise("Part "), i.cast("string"))).otherwise(p))
    # a work here is a source and a document; its rules are the source's
    d = documents(spark, sf).where(F.col("source").isin("src1", "src2")).select("source", "doc_id", F.concat("lang", F.lit(".md")).alias("file"), F.array_join(lines, "\n").alias("body"))
    key = F.concat_ws("/", "source", "doc_id")
    rules = spark.createDataFrame(RULES, "source string, file string, kind string, depth int, pattern string, skip string")
    every = d.select("source", "doc_id").join(rules, "source").select(key.alias("work"), "file", "kind", "depth", "pattern", "skip")
    out = corpus.sections(d.select(key.alias("work"), "file", "body"), every)
    parts = F.split("work", "/")
    return out.select(parts[0].alias("work"), parts[1].cast("long").alias("doc_id"), "chapter", "pos", "title")


PLANS = """sl AS (SELECT source AS work, lang AS file, doc_id % 40 + 1 AS chapter FROM documents WHERE doc_id % 3 <> 0),
plans AS (SELECT w.work, w.work || '-01' AS folder, count(DISTINCT sl.chapter) AS n_chapters, count(DISTINCT sl.file) AS n_variants, coalesce(array_to_string(list_sort(list_distinct(list(sl.chapter) FILTER (sl.chapter IS NOT NULL))), ','), '') AS chapters FROM (SELECT DISTINCT source AS work FROM documents) w LEFT JOIN sl USING (work) GROUP BY w.work)"""


def plans(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    folders = d.select(F.col("source").alias("work"), F.concat("source", F.lit("-01")).alias("folder")).distinct()
    return corpus.planned(folders, d.where("doc_id % 3 <> 0").select(F.col("source").alias("work"), F.col("lang").alias("file"), (F.col("doc_id") % 40 + 1).alias("chapter")))


@query("o153_work_plan", f"WITH {PLANS} SELECT work, folder, chapters, n_chapters, n_variants FROM plans")
def work_plan(spark: SparkSession, sf: str) -> DataFrame:
    return plans(spark, sf).withColumn("chapters", F.array_join(F.col("chapters").cast("array<string>"), ","))


@query("o154_manifest_update", f"WITH {WORKS}, {PLANS} SELECT slug AS work, coalesce(p.n_chapters, total_chapters) AS total_logical_chapters, coalesce(p.n_chapters * p.n_variants, 0) AS total_variant_entries FROM works LEFT JOIN (SELECT * FROM plans WHERE work LIKE '%1') p ON p.work = slug")
def manifest_update(spark: SparkSession, sf: str) -> DataFrame:
    m = works(documents(spark, sf)).select(F.col("slug").alias("work"), F.col("total_chapters").alias("total_logical_chapters"), F.lit(0).cast("long").alias("total_variant_entries"))
    return corpus.manifest_after(m, plans(spark, sf).where("work like '%1'"))


@query("o050_named_nearest", "WITH n AS (SELECT doc_id, unnest([1, 2, 3, 4]) AS rank FROM documents), t AS (SELECT *, 'w' || rank || '/' || (doc_id * 7 + rank) % 1009 AS target FROM n WHERE rank <= 3) SELECT t.doc_id AS \"key\", rank, coalesce(d.source, 'w' || rank) AS name, round(1.0 / rank, 4)::DOUBLE AS score FROM t LEFT JOIN (SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0) d ON d.doc_id = (t.doc_id * 7 + rank) % 1009")
def named_nearest(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    n = d.select(F.col("doc_id").alias("key"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rank"))
    at = lambda c: c.cast("string")
    n = n.withColumn("target", F.concat(F.lit("w"), at(F.col("rank")), F.lit("/"), at((F.col("key") * 7 + F.col("rank")) % 1009))).withColumn("score", F.round(F.lit(1.0) / F.col("rank"), 4))
    titles = d.where("doc_id % 2 = 0").select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda r: F.concat(F.lit("w"), at(r), F.lit("/"), at(F.col("doc_id"))))).alias("target"), F.col("source").alias("title"))
    return corpus.named_nearest(n, titles)


PEOPLE = f"{WORKS}, people AS (SELECT slug, 'a' || total_chapters % 3 AS author, 'e' || first_chapter % 4 AS era, language AS genre FROM works)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    return works(documents(spark, sf)).select("slug", F.concat(F.lit("a"), (F.col("total_chapters") % 3).cast("string")).alias("author"), F.concat(F.lit("e"), (F.col("first_chapter") % 4).cast("string")).alias("era"), F.col("language").alias("genre"))


@query("o029_related_tiers", f"WITH {PEOPLE}, x AS (SELECT w.slug, CASE WHEN w.author = m.author THEN 2 WHEN w.era = m.era THEN 3 WHEN w.genre = m.genre THEN 4 END AS tier FROM people w, people m WHERE m.slug = 'src1' AND w.slug <> 'src1'), c AS (SELECT slug, max(round(total_chapters / 7, 4)) AS score FROM works WHERE slug <> 'src1' AND total_chapters % 5 = 0 GROUP BY slug) SELECT slug, 1 AS tier, 'content_similar' AS relation, score FROM c UNION ALL SELECT slug, tier, CASE tier WHEN 2 THEN 'same_author' WHEN 3 THEN 'same_era' ELSE 'same_genre' END, NULL FROM x WHERE tier IS NOT NULL AND slug NOT IN (SELECT slug FROM c) ORDER BY tier, score DESC NULLS LAST, slug LIMIT 8")
def related_tiers(spark: SparkSession, sf: str) -> DataFrame:
    content = works(documents(spark, sf)).where("total_chapters % 5 = 0").select("slug", F.round(F.col("total_chapters") / 7, 4).alias("score"))
    return corpus.related(content, people(spark, sf), "src1", 8)


@query("o031_read_wiki", "SELECT '# src1' || chr(10) || count(*) || ' chapters' AS markdown, 'works/src1/wiki/_work.card.md' AS path FROM documents WHERE source = 'src1' UNION ALL SELECT '# src1, ' || doc_id || chr(10) || length(text) || ' characters', 'works/src1/wiki/' || doc_id || '.full.md' FROM documents WHERE source = 'src1' AND doc_id = (SELECT min(doc_id) FROM documents WHERE source = 'src1')")
def read_wiki(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    w = works(d)
    text = lambda c: F.col(c).cast("string")
    by_work = w.select(F.col("slug").alias("work"), F.lit(None).cast("long").alias("chapter"), F.lit("card").alias("kind"), F.concat(F.lit("# "), "slug", F.lit("\n"), text("total_chapters"), F.lit(" chapters")).alias("markdown"))
    by_chapter = d.select(F.col("source").alias("work"), F.col("doc_id").alias("chapter"), F.lit("full").alias("kind"), F.concat(F.lit("# "), "source", F.lit(", "), text("doc_id"), F.lit("\n"), F.length("text").cast("string"), F.lit(" characters")).alias("markdown"))
    cards = by_work.unionByName(by_chapter)
    first = w.where("slug = 'src1'").first()["first_chapter"]
    return corpus.read_wiki(cards, w, "src1").unionByName(corpus.read_wiki(cards, w, "src1", first, "full"))


@query("o016_report", "WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang) SELECT '# Languages' || chr(10) || chr(10) || '| lang | n |' || chr(10) || '|---|---|' || chr(10) || string_agg('| ' || coalesce(lang, '-') || ' | ' || n || ' |', chr(10) ORDER BY n DESC, lang NULLS FIRST) AS markdown FROM c")
def report(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.report(documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "Languages", "lang")


@query("o035_case_filters", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src1', 'src2', 'src3')")
def case_filters(spark: SparkSession, sf: str) -> DataFrame:
    return evals.of_cases(documents(spark, sf), {"lang": ["en", "fr"], "source": ["src1", "src2", "src3"], "doc_id": None}).select("doc_id")


POINTS = "p AS (SELECT coalesce(lang, '-') AS category, lower(coalesce(text, '')) AS low, doc_id FROM documents), q AS (SELECT category, floor(3 * ((CASE WHEN contains(low, 'tha') THEN 1 ELSE 0 END) + (CASE WHEN contains(low, 'er') THEN 1 ELSE 0 END) + (CASE WHEN contains(low, 'qzq') THEN 1 ELSE 0 END)) / 3 + 0.5)::INT + CASE WHEN contains(low, 'thth') THEN 0 ELSE 3 END + CASE WHEN doc_id % 2 = 0 AND NOT regexp_matches(low, '[a-z0-9-]+-[a-f0-9]{6}') THEN 1 ELSE 3 END AS total FROM p)"


@query("o060_category_points", f"WITH {POINTS} SELECT category, count(*) FILTER (total >= 6) AS passed, count(*) AS cases, sum(total)::BIGINT AS points, 9 * count(*) AS most FROM q GROUP BY category")
def category_points(spark: SparkSession, sf: str) -> DataFrame:
    words = lambda *w: F.array(*map(F.lit, w))
    p = evals.nine_points(F.lower("text"), words("tha", "er", "qzq"), words("thth"), F.col("doc_id") % 2 == 0, F.array().cast("array<string>"))
    return evals.category_points(documents(spark, sf).select(F.coalesce("lang", F.lit("-")).alias("category"), p.alias("p")), "category", "p")


@query("o157_pinned_results", """WITH r AS (SELECT source AS run, doc_id AS id, length(text) > 1000 AS computed FROM documents), l AS (SELECT d.source AS run, d.doc_id AS id, quality, toxic FROM labels JOIN documents d USING (doc_id)),
top AS (SELECT run, id, quality = 1 AS pass FROM l WHERE run <> 'src1'), low AS (SELECT run, id, toxic = 0 AS pass FROM l), pins AS (SELECT * FROM top UNION ALL SELECT * FROM low WHERE run NOT IN (SELECT run FROM top))
SELECT r.run, r.id, coalesce(p.pass, computed) AS pass, p.pass IS NOT NULL AS pinned, j.quality AS judged FROM r LEFT JOIN pins p USING (run, id) LEFT JOIN (SELECT * FROM l WHERE id % 3 = 0) j USING (run, id)""")
def pinned_results(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.col("source").alias("run"), F.col("doc_id").alias("id"), (F.length("text") > 1000).alias("computed"))
    named = table(spark, sf, "labels").withColumnRenamed("doc_id", "id").join(d.select("run", "id"), "id")
    top = named.where("run <> 'src1'").select("run", "id", (F.col("quality") == 1).alias("pass"))
    low = named.select("run", "id", (F.col("toxic") == 0).alias("pass"))
    return evals.with_scores(d, [top, low], named.where("id % 3 = 0").select("run", "id", F.col("quality").alias("judged")))


@query("o149_stripped", f"WITH raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN '---' || chr(13) || chr(10) || 'id: ' || doc_id || chr(13) || chr(10) || '---' || chr(13) || chr(10) || ' ' || chr(10) || text ELSE '---' || chr(10) || 'id: ' || doc_id || chr(10) || '---' || chr(10) || text END AS raw FROM documents) SELECT doc_id, length(b)::INT AS n, md5(b) AS body FROM (SELECT doc_id, regexp_replace(regexp_replace(raw, '^---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n', ''), '^{BLANKS}+', '') AS b FROM raw)")
def stripped(spark: SparkSession, sf: str) -> DataFrame:
    head = lambda end: F.concat(F.lit(f"---{end}id: "), F.col("doc_id").cast("string"), F.lit(f"{end}---{end}"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, F.concat(head("\r\n"), F.lit(" \n"), "text")).otherwise(F.concat(head("\n"), "text"))
    b = ingest.stripped(raw)
    return documents(spark, sf).select("doc_id", F.length(b).alias("n"), F.md5(b.cast("binary")).alias("body"))


@query("o013_changed_files", "SELECT doc_id FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0")
def changed_files(spark: SparkSession, sf: str) -> DataFrame:
    new = documents(spark, sf).select("doc_id", "text")
    old = new.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return files.changed(new, old, "doc_id", "text").select("doc_id")


@query("o146_progress", "WITH g AS (SELECT event_type, count(*) AS done, epoch(max(ts)) - epoch(min(ts)) AS sec FROM events GROUP BY event_type) SELECT event_type, done, 100000 AS total, round(sec / 60, 4) AS elapsed_min, round((100000 - done) / greatest(done / greatest(sec / 60, 1 / 60), 0.0001), 4) AS remaining_min FROM g")
def eta(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    g = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("event_type").agg(F.count(F.lit(1)).alias("done"), (seconds / 1e6).alias("sec"))
    p = progress(F.col("done"), F.lit(100000), F.col("sec"))
    return g.select("event_type", "done", F.lit(100000).alias("total"), F.round(p["elapsed_min"], 4).alias("elapsed_min"), F.round(p["remaining_min"], 4).alias("remaining_min"))
