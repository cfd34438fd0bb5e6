"""Queries of the catalogue, reading and search operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text as tx
from folio.functions.words import AUDIT_STOPWORDS, QUERY_STOPWORDS, TERM_STOPWORDS
from folio.operators import catalog, search
from folio.plans.sql import BLANKS, PARAS, PARTS, WORKS, collapse, fnv, pid, trim, words_in
from folio.sources.tables import documents, paragraphs, table, works

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


NEEDLE = "the thth"
SNIP = lambda t, o, n: f"(CASE WHEN {o} > 80 THEN '...' ELSE '' END || {collapse(trim(f'substring({t}, greatest(0, {o} - 80) + 1, least(length({t}), {o} + {n} + 80) - greatest(0, {o} - 80))'))} || CASE WHEN least(length({t}), {o} + {n} + 80) < length({t}) THEN '...' ELSE '' END)"


def hits_sql(needle: str, lang: str | None) -> str:
    """CTEs: hits(doc_id, source, "offset", snippet, paragraph_id)."""
    n = needle.lower().replace("'", "''")
    size = len(needle)
    scope = f" AND lang = '{lang}'" if lang else ""
    return f"""{PARAS},
found AS (SELECT doc_id, source, text, string_split(lower(text), '{n}') AS pieces FROM documents WHERE contains(lower(text), '{n}'){scope}),
places AS (SELECT doc_id, source, text, unnest(range(1, len(pieces))) AS k, pieces FROM found),
offs AS (SELECT doc_id, source, text, (list_sum(list_transform(pieces[1:k], lambda q: length(q))) + (k - 1) * {size})::BIGINT AS o FROM places),
hits AS (SELECT f.doc_id, f.source, f.o AS "offset", {SNIP('f.text', 'f.o', size)} AS snippet,
  (SELECT {pid('p.text')} FROM paras p WHERE p.doc_id = f.doc_id AND p."offset" <= f.o AND f.o < p."offset" + length(p.text) + 2 ORDER BY p.pos LIMIT 1) AS paragraph_id FROM offs f)"""


@query("o102_search_literal", f"WITH {hits_sql(NEEDLE, 'en')} SELECT doc_id, source, \"offset\", snippet, paragraph_id FROM hits ORDER BY source, doc_id, \"offset\" LIMIT 30")
def search_literal(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(documents(spark, sf), NEEDLE)


@query("o045_range_join_hits", f"WITH {hits_sql(NEEDLE, None)} SELECT doc_id, source, \"offset\", snippet, paragraph_id FROM hits")
def range_join(spark: SparkSession, sf: str) -> DataFrame:
    return search.literal_hits(documents(spark, sf), F.lit(NEEDLE), None)


@query("o040_needles_in_haystack", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text))")
def needles(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark passages inside documents."""
    b = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"))
    return search.containing(documents(spark, sf), b, "item_id")


@query("o022_list_works", f"WITH {WORKS} SELECT * FROM works WHERE language = 'en' AND contains(slug, '1') AND total_chapters >= 2")
def list_works(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_works(documents(spark, sf), language="EN", slug_part="1", least_chapters=2)


@query("o002_works", f"WITH {WORKS} SELECT * FROM works")
def all_works(spark: SparkSession, sf: str) -> DataFrame:
    return works(documents(spark, sf))


@query("o023_list_chapters", "SELECT source AS slug, doc_id AS chapter_number, string_agg(DISTINCT lang, ',' ORDER BY lang) AS variants, count(*) AS n_variants FROM documents WHERE source = 'src3' GROUP BY ALL")
def list_chapters(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.list_chapters(documents(spark, sf), "src3")


@query("o024_get_metadata", "SELECT 'language' AS kind, lang AS name, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY lang UNION ALL SELECT * FROM (SELECT 'chapter', doc_id::VARCHAR, n_chars FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 8)")
def get_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.metadata(documents(spark, sf), "src3")


@query("o026_read_chapter", f"SELECT doc_id, lang, list_aggregate(list_transform({PARTS}, lambda p: '[' || {pid('p')} || '] ' || p), 'string_agg', chr(10) || chr(10)) AS body FROM documents WHERE source = 'src5'")
def read_chapter(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.read_chapter(documents(spark, sf), "src5")


@query("o027_get_passage", f"WITH {PARAS} SELECT doc_id, pos, {pid('text')} AS paragraph_id, text FROM paras WHERE source = 'src2' AND pos BETWEEN 1 AND 2")
def get_passage(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.passage(documents(spark, sf).where("source = 'src2'"), start=1, end=2)


@query("o028_passage_default", f"WITH {PARAS} SELECT doc_id, pos, {pid('text')} AS paragraph_id, text FROM paras WHERE source = 'src4' AND pos < 8")
def passage_default(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.passage(documents(spark, sf).where("source = 'src4'"))


@query("o040_passage_by_id", f"WITH {PARAS}, ids AS (SELECT {pid('text')} AS paragraph_id FROM paras WHERE doc_id = 10) SELECT doc_id, pos, {pid('text')} AS paragraph_id, text FROM paras WHERE source IN ('src0', 'src10') AND {pid('text')} IN (SELECT paragraph_id FROM ids)")
def passage_by_id(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    ids = paragraphs(d.where("doc_id = 10")).select(tx.paragraph_id(F.col("text")).alias("paragraph_id")).distinct()
    return catalog.passage(d.where("source in ('src0', 'src10')"), ids=ids)


@query("o096_paragraph_ids", f"WITH {PARAS} SELECT doc_id, pos, \"offset\", {pid('text')} AS paragraph_id FROM paras")
def paragraph_ids(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(documents(spark, sf)).select("doc_id", "pos", "offset", tx.paragraph_id(F.col("text")).alias("paragraph_id"))


@query("o079_variant_files", "SELECT doc_id, CASE WHEN n = 1 THEN lang || '.md' ELSE lang || '-' || n || '.md' END AS file FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS n FROM documents)")
def variant_files(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.variant_files(documents(spark, sf))


@query("o055_facets", "SELECT 'lang' AS facet, lang AS value, string_agg(DISTINCT source, ',' ORDER BY source) AS works, count(DISTINCT source) AS n_works, count(*) AS n_chapters FROM documents GROUP BY lang UNION ALL SELECT 'source', source, source, 1, count(*) FROM documents GROUP BY source")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.facets(documents(spark, sf))


@query("o073_series", "WITH w AS (SELECT DISTINCT source AS slug, CASE WHEN regexp_matches(source, '^src[0-9][0-9]$') THEN 'src-series-' || substring(source, 4, 1) ELSE 'solo-' || source END AS series_id FROM documents) SELECT slug, series_id, count(*) OVER (PARTITION BY series_id) - 1 AS siblings FROM w")
def series(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.series(documents(spark, sf))


@query("o074_facet_counts", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang")
def facet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")


@query("o036_facet_filter", "SELECT doc_id, source, lang FROM documents WHERE lang IN ('fr', 'de') AND source IN ('src1', 'src2', 'src3')")
def facet_filter(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where(F.col("lang").isin("fr", "de") & F.col("source").isin("src1", "src2", "src3")).select("doc_id", "source", "lang")


@query("o007_variant_pick", "SELECT source, doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END, doc_id) = 1")
def variant_pick(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(4)
    return documents(spark, sf).groupBy("source").agg(F.min(F.struct(rank.alias("r"), "doc_id", "lang")).alias("b")).select("source", "b.doc_id", "b.lang")


@query("o130_patched", f"WITH {WORKS}, p(slug, language) AS (VALUES ('src1', 'xx'), ('src2', NULL), ('nowhere', 'yy')) SELECT w.slug, coalesce(p.language, w.language) AS language, total_chapters, total_chars, first_chapter FROM works w LEFT JOIN p ON w.slug = p.slug")
def patched(spark: SparkSession, sf: str) -> DataFrame:
    p = spark.createDataFrame([("src1", "xx"), ("src2", None), ("nowhere", "yy")], "slug string, language string")
    return catalog.patched(works(documents(spark, sf)), p, "slug", ["language"])


@query("o065_totals", f"WITH {PARAS} SELECT (SELECT count(*) FROM paras) AS paragraphs, (SELECT sum(len(list_filter(regexp_split_to_array({trim('text')}, '{BLANKS}+'), lambda w: w <> '')))::BIGINT FROM documents) AS words, (SELECT count(*) FROM documents) AS chapters, (SELECT count(DISTINCT lang) FROM documents) AS languages")
def totals(spark: SparkSession, sf: str) -> DataFrame:
    per = documents(spark, sf).select("lang", F.size(tx.paragraphs(F.col("text"), "\n")).alias("p"), tx.word_count(F.col("text")).alias("w"))
    return per.agg(F.sum("p").alias("paragraphs"), F.sum("w").alias("words"), F.count(F.lit(1)).alias("chapters"), F.countDistinct("lang").alias("languages"))


@query("o066_work_totals", "SELECT lang, CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 3 ELSE 4 END AS place, count(DISTINCT source) AS works, count(*) AS chapters, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY lang ORDER BY place")
def work_totals(spark: SparkSession, sf: str) -> DataFrame:
    place = F.coalesce(F.create_map(*[F.lit(x) for x in ("en", 1, "de", 2, "fr", 3)])[F.col("lang")], F.lit(4))
    return documents(spark, sf).groupBy("lang").agg(F.countDistinct("source").alias("works"), F.count(F.lit(1)).alias("chapters"), F.sum("n_chars").alias("chars")).withColumn("place", place).orderBy("place")


@query("o052_frequency", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def frequency(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("o053_document_frequency", "SELECT token, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z''][a-z'']+'), lambda t: length(t) >= 3))) AS token FROM documents WHERE lang = 'en') GROUP BY token")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return search.document_frequency(documents(spark, sf).where("lang = 'en'"))


QUESTIONS = "SELECT item_id AS query_id, text AS query FROM benchmark"
DISTINCTIVE = f"""q AS ({QUESTIONS}), df AS ({SQL['o053_document_frequency']}), n AS (SELECT count(*) AS n FROM documents WHERE lang = 'en'),
toks AS (SELECT query_id, ws, unnest(ws) AS w, unnest(range(len(ws))) AS place FROM (SELECT query_id, regexp_extract_all(query, '[A-Za-z][A-Za-z'']+') AS ws FROM q)),
firsts AS (SELECT query_id, lower(w) AS token, place, regexp_matches(w, '^[A-Z]') AND place > 0 AS capital FROM toks WHERE length(w) >= 3 AND NOT ({words_in('lower(w)', QUERY_STOPWORDS)}) QUALIFY row_number() OVER (PARTITION BY query_id, lower(w) ORDER BY place) = 1),
ranked AS (SELECT query_id, token, ln((greatest(n.n, 1) + 1) / (coalesce(df.df, 0.5) + 0.5)) AS idf, row_number() OVER (PARTITION BY query_id ORDER BY capital DESC, round(ln((greatest(n.n, 1) + 1) / (coalesce(df.df, 0.5) + 0.5)), 9) DESC, place) AS rank FROM firsts LEFT JOIN df USING (token), n)"""


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query("o100_distinctive_tokens", f"WITH {DISTINCTIVE} SELECT query_id, token, round(idf, 4) AS idf, rank FROM ranked WHERE rank <= 3")
def distinctive(spark: SparkSession, sf: str) -> DataFrame:
    return search.distinctive(documents(spark, sf).where("lang = 'en'"), questions(spark, sf)).withColumn("idf", F.round("idf", 4))


@query("o104_search_fallback", f"""WITH {DISTINCTIVE}, en AS (SELECT doc_id, text FROM documents WHERE lang = 'en'),
long AS (SELECT query_id, query FROM q WHERE len(list_filter(regexp_split_to_array(trim(query), '\\s+'), lambda w: w <> '')) > 5),
missed AS (SELECT query_id FROM long WHERE NOT EXISTS (SELECT 1 FROM en WHERE contains(lower(en.text), lower(long.query)))),
words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS word FROM en),
per AS (SELECT r.query_id, w.doc_id, count(DISTINCT r.token) AS tokens, count(*) AS hits FROM ranked r JOIN missed USING (query_id) JOIN words w ON starts_with(w.word, r.token) WHERE r.rank <= 3 GROUP BY ALL)
SELECT query_id, doc_id, tokens, hits, row_number() OVER (PARTITION BY query_id ORDER BY tokens DESC, hits DESC, doc_id) AS rank FROM per QUALIFY rank <= 30""")
def search_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return search.fallback(documents(spark, sf), questions(spark, sf))


@query("o091_search_alternatives", "WITH m AS (SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])entior($|[^a-z0-9_])') AND regexp_matches(lower(text), '(^|[^a-z0-9_])the($|[^a-z0-9_])') THEN 0 WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])ourepa($|[^a-z0-9_])') THEN 1 WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])entior') AND regexp_matches(lower(text), '(^|[^a-z0-9_])the') THEN 2 WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])ourepa') THEN 3 END AS branch FROM documents) SELECT doc_id, branch FROM m WHERE branch IS NOT NULL")
def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return search.any_of(documents(spark, sf), "entior the, ourepa")


@query("o105_query_transform", "SELECT * FROM (VALUES (0, 'free will', 0), (1, 'duty', 0), (2, 'free* will*', 0), (3, 'duty*', 0), (0, '\"exact\" pre*', 1)) t(rank, strategy, query_id)")
def query_transform(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(k, s, i) for i, raw in enumerate([" free  will , duty,", '"exact" pre*', "  "]) for k, s in enumerate(search.strategies(raw))]
    return spark.createDataFrame(rows, "rank int, strategy string, query_id int")


@query("o160_ranked_search", "WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z''][a-z'']+')) AS token FROM documents), tf AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token IN ('the', 'oner') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, round(sum(tf * ln(1 + n / df)), 4) AS score FROM tf JOIN df USING (token), n GROUP BY doc_id HAVING count(*) = 2 ORDER BY score DESC, doc_id LIMIT 25")
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked(documents(spark, sf), "The oner", 99)


@query("o079_paragraph_index", f"WITH {PARAS} SELECT {pid('text')} AS paragraph_id, doc_id, pos FROM paras QUALIFY row_number() OVER (PARTITION BY {pid('text')} ORDER BY doc_id, pos) = 1")
def paragraph_index(spark: SparkSession, sf: str) -> DataFrame:
    return search.paragraph_index(documents(spark, sf))


@query("o051_text_join", f"WITH {PARAS}, norm AS (SELECT doc_id, pos, {collapse('text')} AS t FROM paras), first AS (SELECT t, min(doc_id) AS first_doc FROM norm GROUP BY t) SELECT n.doc_id, n.pos, f.first_doc FROM norm n JOIN first f USING (t) WHERE f.first_doc <> n.doc_id")
def text_join(spark: SparkSession, sf: str) -> DataFrame:
    p = paragraphs(documents(spark, sf)).select("doc_id", "pos", tx.collapse(F.col("text")).alias("t"))
    return p.join(p.groupBy("t").agg(F.min("doc_id").alias("first_doc")), "t").where("first_doc <> doc_id").select("doc_id", "pos", "first_doc")


@query("o098_term_tokens", f"SELECT doc_id, list_aggregate(list_filter(regexp_split_to_array(lower(text), '[^a-z'']+'), lambda t: length(t) >= 3 AND NOT ({words_in('t', TERM_STOPWORDS)})), 'string_agg', ' ') AS tokens FROM documents WHERE lang = 'en'")
def term_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_join(tx.term_tokens(F.col("text")), " ")
    return documents(spark, sf).where("lang = 'en'").select("doc_id", F.when(tokens != "", tokens).alias("tokens"))


@query("o106_slugs", None)
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.slugify(F.col("text")).alias("slug"), tx.chapter_slug(F.col("doc_id"), F.col("text")).alias("chapter_slug"))


@query("o107_fold", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold(spark: SparkSession, sf: str) -> DataFrame:
    from folio.session import ship

    ship(spark)
    return documents(spark, sf).select("doc_id", tx.fold("text").alias("folded"))


SCRIPT_COUNT = lambda p: f"length(s) - length(regexp_replace(s, '{p}', '', 'g'))"


@query("o108_script", f"WITH x AS (SELECT doc_id, substring(regexp_replace(text, '{BLANKS}+', '', 'g'), 1, 500) AS s FROM documents), c AS (SELECT doc_id, s, {SCRIPT_COUNT('[A-z\\x{C0}-\\x{24F}]')} AS latin FROM x) SELECT doc_id, CASE WHEN s = '' THEN 'empty' WHEN latin >= length(s) - latin THEN 'latin' ELSE 'other' END AS script FROM c")
def script(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.script(F.col("text")).alias("script"))


WORDS_SQL = f"len(list_filter(regexp_split_to_array({trim('text')}, '{BLANKS}+'), lambda w: w <> ''))"


@query("o111_word_delta", f"WITH w AS (SELECT doc_id, {WORDS_SQL}::BIGINT AS words, n_chars // 5 AS stated FROM documents) SELECT doc_id, words, stated, abs(words - stated) > greatest(50, stated * 0.1) AND stated > 0 AS flagged FROM w")
def word_delta(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"), F.floor(F.col("n_chars") / 5).alias("stated"))
    return d.withColumn("flagged", (F.abs(F.col("words") - F.col("stated")) > F.greatest(F.lit(50.0), F.col("stated") * 0.1)) & (F.col("stated") > 0))


@query("o113_stopword_ratio", f"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(substring(text, 1, 3000)), '[^a-z'']+'), lambda w: w <> '') AS ws FROM documents) SELECT doc_id, CASE WHEN len(ws) = 0 THEN 0 ELSE round(len(list_filter(ws, lambda w: {words_in('w', AUDIT_STOPWORDS)})) / len(ws), 6) END AS ratio FROM w")
def stopword_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", F.round(tx.stopword_ratio(F.col("text")), 6).alias("ratio"))


@query("o118_truncated", """WITH x AS (SELECT doc_id, text AS t FROM documents), y AS (SELECT doc_id, t, instr(t, '. ') - 1 AS d, instr(t, ', ') - 1 AS c, CASE WHEN instr(substring(t, 1, 81), ' ') > 0 THEN 81 - instr(reverse(substring(t, 1, 81)), ' ') ELSE -1 END AS s FROM x)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t WHEN d > 0 AND d < 80 THEN substring(t, 1, d + 1) WHEN c > 0 AND c < 80 THEN substring(t, 1, c + 1) || '...' WHEN s > 0 THEN substring(t, 1, s) || '...' ELSE substring(t, 1, 80) || '...' END AS headline FROM y""")
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", tx.truncated(F.col("text")).alias("headline"))


@query("o085_offsets", f"WITH {PARAS} SELECT doc_id, max(\"offset\") AS last_offset, sum(length(text))::BIGINT AS chars FROM paras GROUP BY doc_id")
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    return paragraphs(documents(spark, sf)).groupBy("doc_id").agg(F.max("offset").alias("last_offset"), F.sum(F.length("text")).alias("chars"))


@query("o014_drift", f"WITH stored AS (SELECT doc_id, {fnv('text')} AS h FROM documents WHERE doc_id % 7 <> 0), fresh AS (SELECT doc_id, {fnv('CASE WHEN doc_id % 11 = 0 THEN upper(text) ELSE text END')} AS h FROM documents WHERE doc_id % 5 <> 0) SELECT coalesce(s.doc_id, f.doc_id) AS doc_id, CASE WHEN s.doc_id IS NULL THEN 'added' WHEN f.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS drift FROM stored s FULL JOIN fresh f USING (doc_id) WHERE s.h IS DISTINCT FROM f.h")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    """What a rebuild would change: a full outer join of stored and fresh hashes. The two sides are made from the documents."""
    d = documents(spark, sf)
    stored = d.where("doc_id % 7 <> 0").select("doc_id", tx.fnv1a(F.col("text")).alias("old"))
    fresh = d.where("doc_id % 5 <> 0").select("doc_id", tx.fnv1a(F.when(F.col("doc_id") % 11 == 0, F.upper("text")).otherwise(F.col("text"))).alias("new"))
    both = stored.join(fresh, "doc_id", "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return both.select("doc_id", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("drift"))
