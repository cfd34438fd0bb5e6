"""Queries of the evaluation, citation and relational operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.operators import citations, evals
from folio.plans.sql import fnv
from folio.sources.tables import documents, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: arms(doc_id, lang, a, b): a first arm's verdict and a second one's, each null where it is pending.
ARMS = "arms AS (SELECT d.doc_id, d.lang, l.quality = 1 AS a, CASE WHEN l.doc_id % 4 <> 0 THEN l.toxic = 0 END AS b FROM documents d LEFT JOIN labels l USING (doc_id))"


def arms(spark: SparkSession, sf: str) -> DataFrame:
    one = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("a"))
    two = table(spark, sf, "labels").where("doc_id % 4 <> 0").select("doc_id", (F.col("toxic") == 0).alias("b"))
    return documents(spark, sf).select("doc_id", "lang").join(one, "doc_id", "left").join(two, "doc_id", "left")


@query("o047_arms", f"WITH {ARMS} SELECT * FROM arms")
def two_arms(spark: SparkSession, sf: str) -> DataFrame:
    return arms(spark, sf)


@query("o034_compare_filter", f"WITH {ARMS} SELECT doc_id, 'flips-fail' AS mode FROM arms WHERE a AND NOT b UNION ALL SELECT doc_id, 'flips-pass' FROM arms WHERE NOT a AND b UNION ALL SELECT doc_id, 'both-fail' FROM arms WHERE NOT a AND NOT b UNION ALL SELECT doc_id, 'pending-wiki' FROM arms WHERE b IS NULL")
def compare_filter(spark: SparkSession, sf: str) -> DataFrame:
    x = arms(spark, sf)
    modes = F.array_compact(F.array(*[F.when(evals.compared(F.col("a"), F.col("b"), m), m) for m in ("flips-fail", "flips-pass", "both-fail", "pending-wiki")]))
    return x.select("doc_id", F.explode(modes).alias("mode"))


@query("o063_compare_counts", f'WITH {ARMS} SELECT count(*) AS "all", count(*) FILTER (NOT a AND b) AS flips_pass, count(*) FILTER (a AND NOT b) AS flips_fail, count(*) FILTER (a AND b) AS both_pass, count(*) FILTER (NOT a AND NOT b) AS both_fail, count(*) FILTER (b IS NULL) AS pending_wiki FROM arms')
def compare_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evals.comparison_counts(arms(spark, sf), "a", "b")


@query("o057_model_rollup", f"WITH {ARMS} SELECT coalesce(lang, 'all') AS tier, count(*) AS cases, count(*) FILTER (a) AS passed, count(a) AS judged, round(count(*) FILTER (a) / nullif(count(a), 0), 4) AS rate FROM arms GROUP BY GROUPING SETS ((lang), ())")
def model_rollup(spark: SparkSession, sf: str) -> DataFrame:
    r = arms(spark, sf).rollup("lang").agg(F.count(F.lit(1)).alias("cases"), F.count_if("a").alias("passed"), F.count("a").alias("judged"))
    return r.select(F.coalesce("lang", F.lit("all")).alias("tier"), "cases", "passed", "judged", F.round(F.try_divide("passed", "judged"), 4).alias("rate"))


@query("o061_run_summary", "SELECT coalesce(event_type, '*') AS category, coalesce(CAST(user_id % 3 AS VARCHAR), '*') AS difficulty, count(*) FILTER (value >= 50) AS ok, count(*) FILTER (value < 50) AS failed, count(*) FILTER (value IS NULL) AS skipped FROM events GROUP BY GROUPING SETS ((event_type), (CAST(user_id % 3 AS VARCHAR)), ())")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("difficulty"), "value")
    g = e.groupingSets([["event_type"], ["difficulty"], []], "event_type", "difficulty").agg(F.count_if(F.col("value") >= 50).alias("ok"), F.count_if(F.col("value") < 50).alias("failed"), F.count_if(F.col("value").isNull()).alias("skipped"))
    return g.select(F.coalesce("event_type", F.lit("*")).alias("category"), F.coalesce("difficulty", F.lit("*")).alias("difficulty"), "ok", "failed", "skipped")


@query("o058_judge_rollup", "SELECT d.lang AS category, count(*) AS n, count(*) FILTER (quality = 1 AND toxic = 0) AS passed, sum(quality)::BIGINT AS quality, sum(toxic)::BIGINT AS toxic, round(avg(quality), 4) AS mean_quality FROM labels JOIN documents d USING (doc_id) GROUP BY d.lang")
def judge_rollup(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", "lang"), "doc_id")
    return j.groupBy(F.col("lang").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic"), F.round(F.avg("quality"), 4).alias("mean_quality"))


@query("o059_worst_first", "SELECT doc_id, 3 * quality + 3 * (1 - toxic) + least(6, length(text) // 1000)::INT AS points FROM labels JOIN documents USING (doc_id) ORDER BY points, doc_id LIMIT 20")
def worst_first(spark: SparkSession, sf: str) -> DataFrame:
    j = table(spark, sf, "labels").join(documents(spark, sf).select("doc_id", F.length("text").alias("n")), "doc_id")
    return j.select("doc_id", (3 * F.col("quality") + 3 * (1 - F.col("toxic")) + F.least(F.lit(6), F.floor(F.col("n") / 1000)).cast("int")).alias("points")).orderBy("points", "doc_id").limit(20)


STEPS = "steps AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens, CASE WHEN event_id % 97 <> 0 THEN value END AS cost FROM events)"


@query("o062_usage", f"WITH {STEPS} SELECT user_id, count(*) AS calls, sum(tokens)::BIGINT AS tokens, CASE WHEN count(cost) = count(*) THEN round(sum(cost), 4) END AS cost FROM steps GROUP BY user_id")
def usage(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.when(F.col("event_id") % 97 != 0, F.col("value")).alias("cost"))
    return evals.usage(e, "user_id").withColumn("cost", F.round("cost", 4))


@query("o064_averages", "SELECT event_type AS tier, round(sum(value) / count(*), 4) AS per_query, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def averages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("tier")).agg(F.round(F.sum("value") / F.count(F.lit(1)), 4).alias("per_query"), F.countDistinct("user_id").alias("users"))


@query("o048_latest_wins", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return evals.latest(table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("o049_carried_context", f"WITH x AS (SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) SELECT conv_id, turn, CASE WHEN q IS NOT NULL THEN {fnv('q')} END AS asked FROM x WHERE role = 'assistant'")
def carried_context(spark: SparkSession, sf: str) -> DataFrame:
    return evals.carried(table(spark, sf, "conversations"))


@query("o087_merged_turns", "WITH m AS (SELECT *, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'user' ELSE role END AS role, text FROM conversations)), r AS (SELECT *, (sum(new) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS run FROM m) SELECT conv_id, run, role, min(turn) AS first_turn, count(*) AS turns, string_agg(text, '' ORDER BY turn) AS text FROM r GROUP BY ALL")
def merged_turns(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, "user").otherwise(F.col("role")).alias("role"), "text")
    return evals.merged_turns(t)


@query("o083_round_robin", "SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS turn FROM documents ORDER BY turn, lang LIMIT 25")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return evals.round_robin(documents(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 25)


@query("o082_stratified")
def stratified(spark: SparkSession, sf: str) -> DataFrame:
    return evals.stratified(documents(spark, sf).select("doc_id", "lang"), "lang", "doc_id", 40)


@query("o084_shuffled")
def shuffled(spark: SparkSession, sf: str) -> DataFrame:
    return evals.shuffled(documents(spark, sf).select("doc_id"), "doc_id")


@query("o086_spread", "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM documents) SELECT doc_id, place FROM o WHERE place IN (SELECT i * (SELECT count(*) FROM documents) // 7 FROM range(7) t(i))")
def spread(spark: SparkSession, sf: str) -> DataFrame:
    return evals.spread(documents(spark, sf), "doc_id", 7)


@query("o042_not_done", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_done(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


@query("o038_lookup_default", "SELECT d.doc_id, coalesce(CASE l.quality WHEN 1 THEN 'good' WHEN 0 THEN 'bad' END, 'unknown') AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def lookup_default(spark: SparkSession, sf: str) -> DataFrame:
    q = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("q"))
    return documents(spark, sf).select("doc_id").join(q, "doc_id", "left").select("doc_id", F.coalesce("q", F.lit("unknown")).alias("quality"))


@query("o039_lookup_inner", "SELECT w.slug, d.doc_id FROM (VALUES ('src1'), ('nowhere'), ('src2')) w(slug) JOIN documents d ON d.source = w.slug")
def lookup_inner(spark: SparkSession, sf: str) -> DataFrame:
    w = spark.createDataFrame([("src1",), ("nowhere",), ("src2",)], "slug string")
    return documents(spark, sf).select(F.col("source").alias("slug"), "doc_id").join(F.broadcast(w), "slug")


@query("o033_explorer_filter", f"WITH {ARMS} SELECT doc_id FROM arms JOIN documents USING (doc_id) WHERE arms.lang IN ('en', 'fr') AND (contains(lower(text), 'entior') OR doc_id::VARCHAR LIKE '%7%') AND a")
def explorer_filter(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).where(F.col("lang").isin("en", "fr") & (F.contains(F.lower("text"), F.lit("entior")) | F.contains(F.col("doc_id").cast("string"), F.lit("7"))))
    return arms(spark, sf).where("a").select("doc_id").join(d.select("doc_id"), "doc_id")


@query("o010_first_source_wins", "WITH u AS (SELECT doc_id AS id, 1 AS p, 'revised' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 2, 'draft' FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 3, 'legacy' FROM documents WHERE doc_id < 100) SELECT id, origin FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p) = 1")
def first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).select(F.col("doc_id").alias("id"))
    u = None
    for p, (where, name) in enumerate((("id % 3 = 0", "revised"), ("id % 2 = 0", "draft"), ("id < 100", "legacy"))):
        part = d.where(where).select("id", F.lit(p).alias("p"), F.lit(name).alias("origin"))
        u = part if u is None else u.unionByName(part)
    return u.groupBy("id").agg(F.min_by("origin", "p").alias("origin"))


RUNS = ["grok-baseline-nowiki-1", "x-treatment-wiki-2", "y-with-wiki", "z-nowiki", "a-treatment-b", "grok-discovery-3", "plain", "_INVALIDATED-x", "haiku-1", "r-quarantine"]


@query("o127_arm_tags", "SELECT * FROM (VALUES ('grok-baseline-nowiki-1', 'baseline', false), ('x-treatment-wiki-2', 'wiki', false), ('y-with-wiki', 'wiki', false), ('z-nowiki', 'baseline', false), ('a-treatment-b', 'wiki', false), ('grok-discovery-3', 'baseline', false), ('plain', NULL, false), ('_INVALIDATED-x', NULL, true), ('haiku-1', NULL, true), ('r-quarantine', NULL, true)) t(run, arm, quarantined)")
def arm_tags(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(r,) for r in RUNS], "run string").select("run", evals.arm(F.col("run")).alias("arm"), evals.quarantined(F.col("run")).alias("quarantined"))


@query("o011_run_globs", "SELECT * FROM (VALUES ('grok-baseline-nowiki-1'), ('grok-discovery-3')) t(run)")
def run_globs(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.createDataFrame([(r,) for r in RUNS], "run string")
    return r.where(evals.glob(F.col("run"), "grok-*") & ~evals.quarantined(F.col("run")))


ANSWERS = """(VALUES (1, 'The manusmrti says so', array('manusmrti-aa-123abc'), array('manusmrti-aa-123abc')), (2, 'no idea', array(), array('elene-cynewulf')), (3, 'in cynewulf', array('other'), array('elene-cynewulf')), (4, 'x', array('a-b'), array('a-b', 'c-d')), (5, 'y', array(), array())) t(id, answer, cited, expected)"""


@query("o124_scoring", "SELECT * FROM (VALUES (1, true, true, 1.0), (2, false, false, 0.0), (3, false, true, 0.5), (4, false, false, 0.5), (5, true, true, 1.0)) t(id, by_citations, by_prose, grade)")
def scoring(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.sql(f"SELECT id, answer, CAST(cited AS array<string>) AS cited, CAST(expected AS array<string>) AS expected FROM {ANSWERS}")
    a, c, e = F.lower("answer"), F.col("cited"), F.col("expected")
    return x.select("id", evals.pass_by_citations(c, e).alias("by_citations"), evals.pass_by_prose(a, e).alias("by_prose"), evals.graded(a, c, e).alias("grade"))


@query("o147_graded_documents", "SELECT doc_id, CASE WHEN contains(lower(text), 'entior') AND contains(lower(text), 'oner') THEN 3 WHEN contains(lower(text), 'entior') OR contains(lower(text), 'oner') THEN 2 ELSE 0 END AS factual FROM documents")
def graded_documents(spark: SparkSession, sf: str) -> DataFrame:
    none = F.array().cast("array<string>")
    s = evals.nine_points(F.col("text"), F.array(F.lit("Entior"), F.lit("ONER")), none, F.lit(False), none)
    return documents(spark, sf).select("doc_id", s["factual"].alias("factual"))


@query("o125_nine_points", "SELECT * FROM (VALUES (1, 3, 3, 3, 9, true), (2, 0, 0, 1, 1, false), (3, 2, 3, 3, 8, true)) t(id, factual, hallucination, citation, total, pass)")
def nine_points(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([(1, "Karma and duty", ["karma", "Duty"], ["heaven"], True, ["w"]), (2, "heaven", ["karma"], ["Heaven"], True, []), (3, "karma x-abcdef", ["karma", "duty", "karma"], [], True, [])], "id int, answer string, expected array<string>, forbidden array<string>, wants boolean, cited array<string>")
    return x.select("id", evals.nine_points(F.col("answer"), F.col("expected"), F.col("forbidden"), F.col("wants"), F.col("cited")).alias("s")).select("id", "s.*")


@query("o123_answer_json", "SELECT * FROM (VALUES (1, 'b', 5), (2, 'c', 3), (3, 'd', 1), (4, NULL, 3)) t(id, answer, naturalness)")
def answer_json(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(1, 'x ```json\n{"answer": "a"}\n``` y ```json\n{"answer": "b", "n": 9}\n```'), (2, '{"answer": "c", "n": "bad"}'), (3, 'so: {"answer": "d", "n": 0.2} end'), (4, "nothing")]
    x = spark.createDataFrame(rows, "id int, text string").withColumn("j", evals.answer_json(F.col("text")))
    return x.select("id", F.get_json_object("j", "$.answer").alias("answer"), evals.clamped(F.get_json_object("j", "$.n"), 1, 5, 3).alias("naturalness"))


@query("o126_three_axes", "SELECT * FROM (VALUES (1, 1, 1, 1, true), (2, 0, 1, 0, false), (3, 1, 0, 1, true)) t(id, tools, factual, citation, pass)")
def three_axes(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([(1, ["a"], ["a", "b"], True, ["p"]), (2, ["c"], ["a"], True, []), (3, [], [], None, ["p"])], "id int, used array<string>, wanted array<string>, ok boolean, cited array<string>")
    return x.select("id", evals.three_axes(F.col("used"), F.col("wanted"), F.col("ok"), F.col("cited")).alias("s")).select("id", "s.*")


@query("o120_citation_urls", "SELECT doc_id, '/works/' || source || '/' || doc_id || '/' || lang || '/' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '#p-00000a' ELSE '?paragraphs=p-00000a,p-00000b#p-00000a' END AS url, source AS work, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'p-00000a' ELSE 'p-00000a,p-00000b' END AS ids FROM documents")
def citation_urls(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("p-00000a"), F.lit("q"))).otherwise(F.array(F.lit("p-00000a"), F.lit("p-00000b")))
    x = documents(spark, sf).select("doc_id", citations.citation_url(F.col("source"), F.col("doc_id").cast("string"), F.col("lang"), ids).alias("url"))
    return x.withColumn("p", citations.parsed_url(F.col("url"))).select("doc_id", "url", "p.work", F.array_join("p.ids", ",").alias("ids"))


@query("o159_page_urls", "SELECT page_id, regexp_extract(url, '^(?:[a-z]+://[^/]+)?([^?#]*)', 1) AS path, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def page_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", r"^(?:[a-z]+://[^/]+)?([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"))


@query("o121_linkified", "SELECT * FROM (VALUES (1, 'see <a href=\"/p/p-00ab12\">p-00ab12</a>, <code>p-00ab12</code> and <b title=\"p-00ab12\">x</b>'), (2, 'xp-00ab12 p-00ab123 p-zzzzzz')) t(id, html)")
def linkified(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([(1, 'see p-00ab12, <code>p-00ab12</code> and <b title="p-00ab12">x</b>'), (2, "xp-00ab12 p-00ab123 p-zzzzzz")], "id int, html string")
    return x.select("id", citations.linkified(F.col("html")).alias("html"))


@query("o121_linkified_pages")
def linkified_pages(spark: SparkSession, sf: str) -> DataFrame:
    html = F.regexp_replace("html", r"(?s)</p>", " p-00ab12</p>")
    return table(spark, sf, "pages").select("page_id", citations.linkified(html).alias("html"))


@query("o163_block_ids", "SELECT * FROM (VALUES (1, '<p id=\"p-1\">x</p>'), (2, '<p id=\"own\">x</p>'), (3, 'plain'), (4, '<h2 id=\"p-1\" class=\"a\">y</h2>')) t(id, html)")
def block_ids(spark: SparkSession, sf: str) -> DataFrame:
    x = spark.createDataFrame([(1, "<p>x</p>"), (2, '<p id="own">x</p>'), (3, "plain"), (4, '<h2 class="a">y</h2>')], "id int, html string")
    return x.select("id", citations.with_block_id(F.col("html"), F.lit("p-1")).alias("html"))


@query("o129_rounding", "SELECT event_id, floor(value * 10000 + 0.5) / 10000 AS v FROM events")
def rounding(spark: SparkSession, sf: str) -> DataFrame:
    from folio.functions.text import round_half_up

    return table(spark, sf, "events").select("event_id", round_half_up(F.col("value")).alias("v"))


@query("o128_tool_summaries", "SELECT event_id, CASE event_type WHEN 'view' THEN 'read ' || user_id WHEN 'purchase' THEN 'found ' || CAST(json_extract_string(props, '$.k') AS BIGINT) || ' results' WHEN 'error' THEN 'failed' ELSE event_type END AS summary FROM events")
def tool_summaries(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    s = F.when(F.col("event_type") == "view", F.format_string("read %d", "user_id")).when(F.col("event_type") == "purchase", F.format_string("found %d results", k)).when(F.col("event_type") == "error", "failed").otherwise(F.col("event_type"))
    return table(spark, sf, "events").select("event_id", s.alias("summary"))


@query("o094_distinct_unions", "SELECT DISTINCT lang AS v FROM documents UNION SELECT DISTINCT role FROM conversations")
def distinct_unions(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(F.col("lang").alias("v")).unionByName(table(spark, sf, "conversations").select(F.col("role").alias("v"))).distinct()


@query("o088_stable_sort", "SELECT source, doc_id FROM documents ORDER BY source, doc_id LIMIT 50")
def stable_sort(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("source", "doc_id").orderBy("source", "doc_id").limit(50)


@query("o081_top_k", "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 5")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return documents(spark, sf).select("source", "doc_id", "n_chars", r.alias("rank")).where("rank <= 5")


@query("o017_slim_export", "SELECT doc_id, lang, n_chars FROM documents")
def slim_export(spark: SparkSession, sf: str) -> DataFrame:
    j = documents(spark, sf).select(F.to_json(F.struct("doc_id", "lang", "n_chars")).alias("j"))
    return j.select(F.from_json("j", "doc_id long, lang string, n_chars long").alias("r")).select("r.*")


@query("o156_seeds", "SELECT * FROM (VALUES ('q1', 'uncategorised', 'unknown', 'named', 'w1,w2'), ('q3', 'c', 'easy', 'hidden', '')) t(id, category, difficulty, tier, works)")
def seeds(spark: SparkSession, sf: str) -> DataFrame:
    rows = [('{"id":"q1","prompt":"p","expected_works":["w1",null,"w2"],"tier":"odd"}',), ('{"id":"q2"}',), ('{"id":"q3","prompt":"p","category":"c","difficulty":"easy","tier":"hidden"}',), ("broken",)]
    j = spark.createDataFrame(rows, "j string").select(F.from_json("j", "id string, prompt string, category string, difficulty string, tier string, expected_works array<string>", {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    works = F.array_join(F.coalesce("expected_works", F.array().cast("array<string>")), ",")
    return j.where("id is not null and prompt is not null").select("id", F.coalesce("category", F.lit("uncategorised")).alias("category"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty"), F.when(F.col("tier").isin("named", "hidden"), F.col("tier")).otherwise("named").alias("tier"), works.alias("works"))
