"""Evaluation: scoring of answers, arms and their comparison, roll-ups, samples, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folio.functions import text as tx

COMPARISONS = ("all", "flips-pass", "flips-fail", "both-pass", "both-fail", "pending-wiki")
#: Keys drawn to set the bounds of ranges, about; ranges at most.
DRAWN, RANGES = 4000, 256


def verdict(judged: Column, mechanical: Column) -> Column:
    """What a judge said, else what the rule says; null while neither is there."""
    return F.coalesce(judged, mechanical)


def compared(a: Column, b: Column, mode: str) -> Column:
    """Whether a pair of verdicts belongs to a mode; a null verdict is pending and belongs to no other mode."""
    yes = lambda c, v: c.eqNullSafe(F.lit(v))
    return {
        "all": F.lit(True), "flips-pass": yes(a, False) & yes(b, True), "flips-fail": yes(a, True) & yes(b, False),
        "both-pass": yes(a, True) & yes(b, True), "both-fail": yes(a, False) & yes(b, False), "pending-wiki": b.isNull(),
    }[mode]


def comparison_counts(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.agg(*[F.count_if(compared(F.col(a), F.col(b), m)).alias(m.replace("-", "_")) for m in COMPARISONS])


def pass_by_citations(cited: Column, expected: Column) -> Column:
    """Every expected work is cited."""
    return F.size(F.array_except(expected, cited)) == 0


def longest_part(slug: Column) -> Column:
    """A slug's longest word of more than three letters that is no id; the first of equals; null without one."""
    parts = F.filter(F.split(F.regexp_replace(slug, "^unknown-", ""), "-"), lambda p: (F.length(p) > 3) & ~p.rlike("^[0-9a-f]{6}$"))
    return F.get(F.filter(parts, lambda p: F.length(p) == F.array_max(F.transform(parts, F.length))), F.lit(0))


def named_in(answer: Column, slug: Column) -> Column:
    """Whether a folded answer names a work: its slug, or the longest word of it."""
    part = longest_part(slug)
    return F.contains(answer, slug) | F.coalesce(F.contains(answer, part), F.lit(False))


def pass_by_prose(answer: Column, expected: Column) -> Column:
    """Every expected work is named in the answer, which must be folded."""
    return F.forall(expected, lambda s: named_in(answer, s))


def graded(answer: Column, cited: Column, expected: Column) -> Column:
    """1 if all expected works are cited, 0.5 if some are or all are named, else 0."""
    some = F.size(F.array_intersect(expected, cited)) > 0
    return F.when(pass_by_citations(cited, expected), 1.0).when(some | pass_by_prose(answer, expected), 0.5).otherwise(0.0)


def nine_points(answer: Column, expected: Column, forbidden: Column, wants_citation: Column, cited: Column) -> Column:
    """(factual, hallucination, citation, total, pass) of an answer, three points each; a citation that lacks costs two."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    has = lambda words: F.size(F.filter(words, lambda w: F.contains(low, F.lower(w))))
    factual = F.when(F.size(expected) == 0, 3).otherwise(F.floor(3 * has(expected) / F.size(expected) + 0.5).cast("int"))
    clean = F.when(has(forbidden) == 0, 3).otherwise(0)
    shown = F.coalesce(answer, F.lit("")).rlike("[a-z0-9-]+-[a-f0-9]{6}") | (F.size(cited) > 0)
    citation = F.when(~wants_citation | shown, 3).otherwise(1)
    total = factual + clean + citation
    return F.struct(factual.alias("factual"), clean.alias("hallucination"), citation.alias("citation"), total.alias("total"), (total >= 6).alias("pass"))


def three_axes(used: Column, wanted: Column, correct: Column, cited: Column) -> Column:
    """(tools, factual, citation, pass): any wanted tool used, judged correct, something cited; two axes pass."""
    tools = F.when((F.size(wanted) == 0) | F.arrays_overlap(used, wanted), 1).otherwise(0)
    factual, citation = F.coalesce(correct.cast("int"), F.lit(0)), F.when(F.size(cited) > 0, 1).otherwise(0)
    return F.struct(tools.alias("tools"), factual.alias("factual"), citation.alias("citation"), (tools + factual + citation >= 2).alias("pass"))


def arm(run: Column) -> Column:
    """The arm that a run's name shows; the first rule that holds."""
    low = F.lower(run)
    return (
        F.when(F.contains(low, F.lit("baseline")) & ~F.contains(low, F.lit("treatment")), "baseline").when(F.contains(low, F.lit("treatment-wiki")) | F.contains(low, F.lit("with-wiki")), "wiki")
        .when(F.contains(low, F.lit("nowiki")) | F.contains(low, F.lit("no-wiki")), "baseline").when(F.contains(low, F.lit("treatment")), "wiki").when(low.rlike(r"^grok-discovery-\d"), "baseline")
    )


def quarantined(run: Column) -> Column:
    return run.rlike(r"(^_INVALIDATED|-NOT-BLIND$|-quarantine|^_)") | run.startswith("1k-codex-smoke") | run.startswith("multi-model-") | run.startswith("1k-rerun-") | run.startswith("haiku-")


def glob(name: Column, pattern: str) -> Column:
    """A name that equals a pattern in which * stands for anything."""
    import re

    return name.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + "$")


def last_json(text: Column) -> Column:
    """The last fenced JSON block of a text; null without one."""
    found = F.regexp_extract_all(text, F.lit(r"```json\s*\n((?s:.*?))```"), F.lit(1))
    return F.when(F.size(found) > 0, F.try_element_at(found, F.lit(-1)))


def answer_json(text: Column) -> Column:
    """The answer object of a reply: fenced, bare, or what stands between the outer braces; null if none parses."""
    bare = F.when(F.trim(text).startswith("{"), F.trim(text))
    looks = F.regexp_extract(text, r"(\{(?s:.*)\})", 1)
    ok = lambda c: F.when(F.get_json_object(c, "$.answer").isNotNull(), c)
    return F.coalesce(ok(last_json(text)), ok(bare), ok(F.when(looks != "", looks)))


def clamped(value: Column, low: int, high: int, default: int) -> Column:
    n = value.try_cast("double")
    return F.when(n.isNull(), default).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.floor(n + 0.5)))).cast("int")


def usage(steps: DataFrame, key: str) -> DataFrame:
    """(key, calls, tokens, cost): a step without a cost leaves the whole case without one."""
    return steps.groupBy(key).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.when(F.count("cost") == F.count(F.lit(1)), F.sum("cost")).alias("cost"))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; on a tie of all of `order`, any of equals in these."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def round_robin(df: DataFrame, category: str, key: str, n: int) -> DataFrame:
    """n rows, taken from the categories in turn."""
    turn = F.row_number().over(Window.partitionBy(category).orderBy(key))
    return df.withColumn("turn", turn).orderBy("turn", category).limit(n)


def stratified(df: DataFrame, category: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """About n / categories rows of each category, in an order that the seed decides, n in all."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    turn = F.row_number().over(Window.partitionBy(category).orderBy(h, key))
    return df.withColumn("_turn", turn).orderBy("_turn", h).limit(n).drop("_turn")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def spread(df: DataFrame, key: str, n: int) -> DataFrame:
    """(key, place): n rows spread evenly over the order of key, nulls last, those at floor(i * rows / n); all where there are fewer.

    Their places come from counts by range, so no task holds all rows. The ranges' bounds are values, drawn once by a hash:
    ranges that Spark samples anew for each job need not be the same, and then the counts of one do not fit the rows of the other.
    """
    keys = df.select(key)
    total = keys.count()
    if not total:
        return df.select(key, F.lit(0).cast("long").alias("place"))
    picks = sorted({i * total // n for i in range(n)})
    drawn = keys.where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(max(1, total // DRAWN))) == 0)).distinct().orderBy(key).collect()
    bounds = [F.lit(r[0]) for r in drawn[:: len(drawn) // RANGES + 1]]
    at = F.size(F.filter(F.array(*bounds), lambda b: b <= F.col(key))) if bounds else F.lit(0)
    ranged = keys.withColumn("_p", F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(at))
    before, start = 0, {}
    for p, count in sorted(tuple(r) for r in ranged.groupBy("_p").count().collect()):  # a row for each range
        if any(before <= x < before + count for x in picks):
            start[p] = before
        before += count
    offset = F.create_map(*[F.lit(x) for p in start for x in (p, start[p])])[F.col("_p")]
    each = ranged.where(F.col("_p").isin(list(start))).groupBy("_p", key).agg(F.count(F.lit(1)).alias("_n"))
    to = F.sum("_n").over(Window.partitionBy("_p").orderBy(key)) + offset
    found = F.filter(F.array(*[F.lit(x).cast("long") for x in picks]), lambda x: (x >= F.col("_to") - F.col("_n")) & (x < F.col("_to")))
    return each.withColumn("_to", to).select(key, F.explode(found).alias("place"))


def carried(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, asked): for each answer the last question before it, whatever stands between."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    q = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(w)
    return turns.withColumn("asked", q).where("role = 'assistant'").select("conv_id", "turn", tx.fnv1a(F.col("asked")).alias("asked"))


def merged_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, run, role, first_turn, turns, text): neighbouring turns of one role become one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    marked = turns.withColumn("new", F.coalesce((F.col("role") != F.lag("role").over(w)).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("first_turn"), F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("text"))


def of_cases(df: DataFrame, wanted: dict[str, list | None]) -> DataFrame:
    """Rows whose columns have one of the values wanted; None asks for nothing."""
    for column, values in wanted.items():
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def category_points(scored: DataFrame, category: str, points: str) -> DataFrame:
    """(category, passed, cases, points, most) over a column of `nine_points`."""
    p = F.col(points)
    return scored.groupBy(category).agg(F.count_if(p["pass"]).alias("passed"), F.count(F.lit(1)).alias("cases"), F.sum(p["total"]).alias("points"), (9 * F.count(F.lit(1))).alias("most"))


def with_scores(results: DataFrame, pins: list[DataFrame], judged: DataFrame) -> DataFrame:
    """(run, id, pass, pinned, judged): a pinned score wins over the computed one.

    pins: score tables (run, id, pass), the strongest first; a run takes all its scores from the first that has any.
    """
    pinned = pins[0]
    for lower in pins[1:]:
        pinned = pinned.unionByName(lower.join(pinned.select("run").distinct(), "run", "left_anti"))
    out = results.join(pinned.withColumnRenamed("pass", "_pin"), ["run", "id"], "left").join(judged, ["run", "id"], "left")
    return out.select("run", "id", F.coalesce("_pin", "computed").alias("pass"), F.col("_pin").isNotNull().alias("pinned"), "judged")
