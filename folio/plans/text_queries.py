"""Queries of the similarity, signature and ranking operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx
from folio.functions.words import TERM_STOPWORDS, TOKEN_STOPWORDS
from folio.operators import catalog, rank, signatures, similarity
from folio.plans.sql import PARAS, words_in
from folio.session import ship
from folio.sources.tables import documents, paragraphs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


TERMS = f"list_filter(regexp_split_to_array(lower(text), '[^a-z'']+'), lambda t: length(t) >= 3 AND NOT ({words_in('t', TERM_STOPWORDS)}))"
PUNCTUATION = r'[\s\x{A0},.;:()\[\]{}<>"' + "''" + r"!?\x{2014}\x{2013}\x{2026}\x{201C}\x{201D}\x{2018}\x{2019}]+"
LANG_STOP = " OR ".join(f"(lang = '{code}' AND {words_in('t', words)})" for code, words in TOKEN_STOPWORDS.items() if code != "ang")
LANG_TOKENS = f"list_filter(regexp_split_to_array(lower(text), '{PUNCTUATION}'), lambda t: length(t) >= 3 AND NOT ({LANG_STOP}))"

#: w(doc_id, term, df, w), nrm(doc_id, norm) over the English documents of at least LEAST_TOKENS terms
WEIGHTS = f"""tk AS (SELECT doc_id, {TERMS} AS ts FROM documents WHERE lang = 'en'), kept AS (SELECT * FROM tk WHERE len(ts) >= 50),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM kept) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM kept),
w AS (SELECT doc_id, term, df, tf * ln(n / df) AS w FROM tf JOIN df USING (term), n WHERE df < n),
nrm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY doc_id)"""
PAIRS = f"""{WEIGHTS}, u AS (SELECT doc_id, term, w / norm AS u FROM w JOIN nrm USING (doc_id) WHERE df > 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.u * y.u) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL HAVING sum(x.u * y.u) >= 0.05)"""
LINKS = f"""{PAIRS}, mirrored AS (SELECT a AS doc_id, b AS target, cosine FROM pairs UNION ALL SELECT b, a, cosine FROM pairs),
links AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(cosine, 10) DESC, target) AS rank, target, floor(cosine * 10000 + 0.5) / 10000 AS score FROM mirrored QUALIFY rank <= 5)"""


def english(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).where("lang = 'en'")


@query("o054_tfidf", f"WITH {WEIGHTS} SELECT doc_id, term, round(w, 4) AS w, round(norm, 4) AS norm FROM w JOIN nrm USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(w, 8) DESC, term) <= 3")
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    w = similarity.weights(similarity.tokenized(english(spark, sf)).where(F.size("tokens") >= 50))
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.round("w", 8)), "term"))
    top = w.withColumn("r", r).where("r <= 3")
    return top.join(similarity.norms(w), "doc_id").select("doc_id", "term", F.round("w", 4).alias("w"), F.round("norm", 4).alias("norm"))


@query("o132_cross_links", f"WITH {LINKS} SELECT * FROM links")
def cross_links(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.cross_links(english(spark, sf))


@query("o043_cosine_pairs", f"WITH {WEIGHTS}, u AS (SELECT doc_id, term, w / norm AS u FROM w JOIN nrm USING (doc_id) WHERE df > 1) SELECT x.doc_id AS a, y.doc_id AS b, round(sum(x.u * y.u), 4) AS cosine FROM u x JOIN u y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY ALL HAVING sum(x.u * y.u) >= 0.5")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = english(spark, sf)
    w = similarity.weights(similarity.tokenized(d).where(F.size("tokens") >= 50))
    return similarity.cosine_pairs(w, 0.5, d.count()).select("a", "b", F.round("cosine", 4).alias("cosine"))


@query("o132_skipped", f"SELECT doc_id, len(ts) AS tokens FROM (SELECT doc_id, {TERMS} AS ts FROM documents WHERE lang = 'en') WHERE len(ts) < 50")
def skipped(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.skipped(english(spark, sf))


NAMED = f"{PAIRS}, mirrored AS (SELECT a, b, cosine FROM pairs UNION ALL SELECT b, a, cosine FROM pairs), named AS (SELECT x.source AS slug, y.source AS other, round(max(cosine), 4) AS score FROM mirrored JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b WHERE x.source <> y.source GROUP BY ALL)"


@query("o046_nearest_works", f"WITH {NAMED} SELECT slug, other, score, row_number() OVER (PARTITION BY slug ORDER BY score DESC, other) AS rank FROM named QUALIFY rank <= 4")
def nearest_works(spark: SparkSession, sf: str) -> DataFrame:
    return similarity.nearest_works(english(spark, sf))


@query("o029_find_related", f"""WITH {LINKS}, lang AS (SELECT source AS slug, lang FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) = 1),
content AS (SELECT y.source AS slug, 1 AS tier, max(score) AS score FROM links JOIN documents x USING (doc_id) JOIN documents y ON y.doc_id = target WHERE x.source = 'src3' AND y.source <> 'src3' GROUP BY y.source),
same AS (SELECT slug, 2 AS tier, 0.0 AS score FROM lang WHERE slug <> 'src3' AND lang = (SELECT lang FROM lang WHERE slug = 'src3'))
SELECT slug, tier, score FROM (SELECT * FROM content UNION ALL SELECT * FROM same) QUALIFY row_number() OVER (PARTITION BY slug ORDER BY tier, score DESC) = 1 ORDER BY tier, score DESC, slug LIMIT 5""")
def find_related(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.related(similarity.cross_links(english(spark, sf), source="src3"), documents(spark, sf), "src3")


@query("o030_compare_works", """WITH hit AS (SELECT source, doc_id FROM documents WHERE source IN ('src1', 'src2') AND contains(lower(text), 'entior')), first AS (SELECT source, doc_id FROM documents WHERE source IN ('src1', 'src2')),
a AS (SELECT source, doc_id, 'topic' AS why FROM hit QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5),
b AS (SELECT source, doc_id, 'first' AS why FROM first WHERE source NOT IN (SELECT source FROM a) QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3) SELECT * FROM a UNION ALL SELECT * FROM b""")
def compare_works(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf).where(F.col("source").isin("src1", "src2"))
    r = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    hit = d.where(F.contains(F.lower("text"), F.lit("entior"))).withColumn("r", r).where("r <= 5").select("source", "doc_id", F.lit("topic").alias("why"))
    first = d.join(hit.select("source").distinct(), "source", "left_anti").withColumn("r", r).where("r <= 3").select("source", "doc_id", F.lit("first").alias("why"))
    return hit.unionByName(first)


def grams_sql(n: int) -> str:
    return f"(CASE WHEN len(ts) >= {n} THEN list_transform(range(1, len(ts) - {n} + 2), lambda i: list_aggregate(ts[i:i + {n} - 1], 'string_agg', ' ')) ELSE [] END)"


@query("o099_language_tokens", f"SELECT doc_id, len({LANG_TOKENS}) AS n_tokens, md5(list_aggregate({LANG_TOKENS}, 'string_agg', ' ')) AS digest FROM documents")
def language_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = signatures.tokens(documents(spark, sf))
    return t.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.when(F.size("tokens") > 0, F.md5(F.array_join("tokens", " "))).alias("digest"))


@query("o090_top_trigrams", f"""WITH t AS (SELECT doc_id, {LANG_TOKENS} AS ts FROM documents), g AS (SELECT doc_id, {grams_sql(3)} AS gs FROM t), p AS (SELECT doc_id, unnest(gs) AS gram, unnest(range(len(gs))) AS place FROM g),
c AS (SELECT doc_id, gram, count(*) AS uses, min(place) AS first FROM p GROUP BY ALL) SELECT doc_id, gram, uses, round(uses / sum(uses) OVER (PARTITION BY doc_id), 6) AS frequency, row_number() OVER (PARTITION BY doc_id ORDER BY uses DESC, first) AS rank FROM c QUALIFY rank <= 3""")
def top_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.top_ngrams(signatures.tokens(documents(spark, sf)), 3, 3)


@query("o041_unique_phrases", f"""WITH t AS (SELECT doc_id, source, {LANG_TOKENS} AS ts FROM documents), g AS (SELECT doc_id, source, {grams_sql(3)} AS gs FROM t), p AS (SELECT doc_id, source, unnest(gs) AS gram, unnest(range(len(gs))) AS place FROM g),
c AS (SELECT source, gram, count(*) AS uses, min((doc_id, place)) AS first FROM p GROUP BY ALL) SELECT source, gram, uses, row_number() OVER (PARTITION BY source ORDER BY uses DESC, first) AS rank FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.gram = x.gram AND y.source <> x.source) QUALIFY rank <= 8""")
def unique_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.unique_phrases(signatures.tokens(documents(spark, sf)))


@query("o068_vocabulary", f"""WITH u AS (SELECT doc_id, t, count(*) AS n FROM (SELECT doc_id, unnest({LANG_TOKENS}) AS t FROM documents) GROUP BY ALL)
SELECT doc_id, sum(n)::BIGINT AS n_tokens, count(*) AS n_types, round(count(*) / sum(n), 6) AS ttr, round(count(*) FILTER (n = 1) / count(*), 6) AS hapax FROM u GROUP BY doc_id""")
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.vocabulary_ratios(signatures.tokens(documents(spark, sf)))


@query("o071_npmi", f"""WITH {PARAS}, h AS (SELECT DISTINCT doc_id AS key, pos AS unit, unnest({LANG_TOKENS}) AS term FROM paras), units AS (SELECT doc_id AS key, count(*) AS n FROM paras GROUP BY 1),
d AS (SELECT key, term, count(*) AS df FROM h GROUP BY ALL), k AS (SELECT * FROM d WHERE df >= 2 QUALIFY row_number() OVER (PARTITION BY key ORDER BY df DESC, term) <= 500),
hk AS (SELECT h.key, unit, term, df FROM h JOIN k USING (key, term)), j AS (SELECT x.key, x.term AS a, y.term AS b, x.df AS da, y.df AS db, count(*) AS joint FROM hk x JOIN hk y ON x.key = y.key AND x.unit = y.unit AND x.term < y.term GROUP BY ALL HAVING count(*) >= 2)
SELECT key, a, b, joint, round(greatest(-1, least(1, ln(joint * n / (da * db)) / -ln(joint / n))), 4) AS npmi FROM j JOIN units USING (key) WHERE joint < n""")
def npmi(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.npmi(signatures.paragraph_units(documents(spark, sf))).withColumn("npmi", F.round("npmi", 4))


@query("o070_burrows_delta", f"""WITH t AS (SELECT doc_id, source, {LANG_TOKENS} AS ts FROM documents WHERE source IN ('src1', 'src2')), f AS (SELECT source, doc_id, t, count(*) / any_value(len(ts)) AS f FROM (SELECT source, doc_id, ts, unnest(ts) AS t FROM t) GROUP BY ALL),
ds AS (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS m FROM t), ws AS (SELECT DISTINCT source, t FROM f),
x AS (SELECT d.source, d.doc_id, d.m, w.t, coalesce(own.f, 0) AS own, (SELECT list(coalesce(o.f, 0)) FROM ds e LEFT JOIN f o ON o.doc_id = e.doc_id AND o.t = w.t WHERE e.source = d.source AND e.doc_id <> d.doc_id) AS others FROM ds d JOIN ws w USING (source) LEFT JOIN f own ON own.doc_id = d.doc_id AND own.t = w.t WHERE m > 1),
r AS (SELECT *, list_sum(others) AS rest FROM x), b AS (SELECT * FROM r WHERE rest > 1e-15 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(rest, 12) DESC, t) <= 100),
z AS (SELECT doc_id, own, list_avg(others) AS mean, list_stddev_pop(others) AS sd FROM b) SELECT d.doc_id, coalesce((SELECT round(avg(abs((own - mean) / sd)), 4) FROM z WHERE z.doc_id = d.doc_id AND sd > 1e-9), 0) AS delta FROM ds d""")
def burrows(spark: SparkSession, sf: str) -> DataFrame:
    return signatures.burrows_delta(signatures.tokens(documents(spark, sf).where("source in ('src1', 'src2')")))


def units(spark: SparkSession, sf: str) -> DataFrame:
    ship(spark)
    return paragraphs(documents(spark, sf)).select("doc_id", "pos", tx.language_tokens(F.col("text"), F.col("lang")).alias("tokens"))


@query("o133_textrank")
def textrank(spark: SparkSession, sf: str) -> DataFrame:
    return rank.passage_ranks(units(spark, sf)).select("doc_id", "pos", F.round("textrank", 6).alias("textrank"), F.round("lexrank", 6).alias("lexrank"))


@query("o134_confidence")
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return rank.passage_ranks(units(spark, sf)).groupBy("doc_id").agg(F.max("variance").alias("variance")).select("doc_id", rank.confidence(F.col("variance")).alias("confidence"))


@query("o137_refrains")
def refrains(spark: SparkSession, sf: str) -> DataFrame:
    return rank.refrains(units(spark, sf))


@query("o137_equal_refrains", f"""WITH {PARAS}, t AS (SELECT doc_id, pos, coalesce(list_aggregate({LANG_TOKENS}, 'string_agg', ' '), '') AS toks FROM paras)
SELECT doc_id, toks AS phrase, count(*) AS size, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t GROUP BY ALL HAVING count(*) > 1""")
def equal_refrains(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs of equal tokens: below 20 tokens no other pair is near enough."""
    t = units(spark, sf).select("doc_id", "pos", F.array_join("tokens", " ").alias("phrase"))
    return t.groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("size"), F.array_join(F.transform(F.sort_array(F.collect_list("pos")), lambda p: p.cast("string")), ",").alias("positions")).where("size > 1")


@query("o119_work_cards", f"""WITH {PARAS}, v AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS types FROM (SELECT source, t, count(*) AS n FROM (SELECT source, unnest({LANG_TOKENS}) AS t FROM documents) GROUP BY ALL) GROUP BY source),
c AS (SELECT source, count(*) AS chapters FROM documents GROUP BY source), p AS (SELECT source, count(*) AS paragraphs FROM paras GROUP BY source)
SELECT source, '# ' || source || chr(10) || format('{{:,}}', chapters) || ' chapters, ' || format('{{:,}}', paragraphs) || ' paragraphs' || chr(10) || 'Vocabulary: ' || format('{{:,}}', types) || ' types in ' || format('{{:,}}', tokens) || ' tokens' AS card FROM v JOIN c USING (source) JOIN p USING (source)""")
def work_cards(spark: SparkSession, sf: str) -> DataFrame:
    d = documents(spark, sf)
    v = signatures.tokens(d).select("source", F.explode("tokens").alias("t")).groupBy("source", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("types"))
    c = d.groupBy("source").agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.size(tx.paragraphs(F.col("text"), "\n"))).alias("paragraphs"))
    n = lambda x: F.format_number(x, 0)
    line = F.concat(n("chapters"), F.lit(" chapters, "), n("paragraphs"), F.lit(" paragraphs"))
    vocab = F.concat(F.lit("Vocabulary: "), n("types"), F.lit(" types in "), n("tokens"), F.lit(" tokens"))
    return c.join(v, "source").select("source", F.concat_ws("\n", F.concat(F.lit("# "), "source"), line, vocab).alias("card"))
