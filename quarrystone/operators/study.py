"""Decisions of a mining and training study: standardized yield and its gate, unpaired rows, cyclic batches, checkpoint looks, score intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.operators.stats import _CONTRASTS, contrasts
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

#: Two-sided 95 % point of the normal distribution.
Z = 1.959963984540054
#: Halvings of an interval of length 2: the last is far below the rounding of the results.
HALVINGS = 60
#: Generations of a prompt that are judged.
GENERATIONS = 8

_SAMPLES = f"SELECT user_id AS prompt_id, event_id AS gen, event_type AS kind, event_type = 'purchase' AS ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= {GENERATIONS}"


def first_events(spark: SparkSession, d: str, n: int) -> DataFrame:
    """The first n events of each user, with their number k."""
    return table(spark, d, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).where(F.col("k") <= n)


def samples(spark: SparkSession, d: str) -> DataFrame:
    """prompt_id, gen, kind, ok: the first generations of each prompt. The limit of the rank is applied before the shuffle too, so a prompt with very many rows costs little."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(w)).where(F.col("k") <= GENERATIONS)
    return e.select(F.col("user_id").alias("prompt_id"), F.col("event_id").alias("gen"), F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").alias("ok"))


def by_prompt(rows: DataFrame) -> DataFrame:
    """prompt_id, n, passed, chosen, rejected: the lowest accepted and the lowest rejected generation, null where there is none."""
    return rows.groupBy("prompt_id").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("passed"), F.min(F.when(F.col("ok"), F.col("gen"))).alias("chosen"), F.min(F.when(~F.col("ok"), F.col("gen"))).alias("rejected")
    )


_PROMPTS = f"SELECT prompt_id, count(*) AS n, count(*) FILTER (ok) AS passed, min(gen) FILTER (ok) AS chosen, min(gen) FILTER (NOT ok) AS rejected FROM ({_SAMPLES}) GROUP BY prompt_id"
_YIELD = f"SELECT CASE WHEN prompt_id % 2 = 0 THEN 'multi' ELSE 'single' END AS stratum, count(*) AS pool, count(*) FILTER (prompt_id % 5 < 2) AS mined, count(*) FILTER (prompt_id % 5 < 2 AND chosen IS NOT NULL AND rejected IS NOT NULL) AS pairs FROM ({_PROMPTS}) GROUP BY 1"


def stratum_yield(spark: SparkSession, d: str) -> DataFrame:
    mined = F.col("prompt_id") % 5 < 2
    rows = by_prompt(samples(spark, d)).withColumn("stratum", F.when(F.col("prompt_id") % 2 == 0, "multi").otherwise("single"))
    return rows.groupBy("stratum").agg(F.count("*").alias("pool"), F.count_if(mined).alias("mined"), F.count_if(mined & F.col("chosen").isNotNull() & F.col("rejected").isNotNull()).alias("pairs"))


def gate(num: Column, den: Column) -> Column:
    """The decision on num / den, compared exactly: cross-multiplied, never divided."""
    return F.when(num.isNull() | den.isNull() | (den == 0), "undecidable").when(num >= 1000 * den, "3A").when(num >= 300 * den, "cautious").otherwise("3B")


@query("yield_standardized", f"SELECT stratum, pool, mined, pairs, round(pairs / nullif(mined, 0), 6) AS yield FROM ({_YIELD})")
def yield_standardized(spark, d):
    return stratum_yield(spark, d).select("*", F.round(F.try_divide("pairs", "mined"), 6).alias("yield"))


@query(
    "yield_gate",
    f"WITH y AS ({_YIELD}), s AS (SELECT coalesce(max(pool) FILTER (stratum = 'multi'), 0) AS n1, max(mined) FILTER (stratum = 'multi') AS m1, max(pairs) FILTER (stratum = 'multi') AS p1, coalesce(max(pool) FILTER (stratum = 'single'), 0) AS n2, max(mined) FILTER (stratum = 'single') AS m2, max(pairs) FILTER (stratum = 'single') AS p2 FROM y), "
    "r AS (SELECT CAST(n1 AS HUGEINT) * p1 * m2 + CAST(n2 AS HUGEINT) * p2 * m1 AS num, CAST(m1 AS HUGEINT) * m2 AS den FROM s) "
    "SELECT CAST(num AS VARCHAR) AS num, CAST(den AS VARCHAR) AS den, CASE WHEN num IS NULL OR den IS NULL OR den = 0 THEN 'undecidable' WHEN num >= 1000 * den THEN '3A' WHEN num >= 300 * den THEN 'cautious' ELSE '3B' END AS decision FROM r",
)
def yield_gate(spark, d):
    """Pairs expected from the whole pool, each stratum's yield weighted by its pool, as an exact fraction; and the decision on it."""
    of = lambda name, stratum: F.max(F.when(F.col("stratum") == stratum, F.col(name))).cast("decimal(19,0)")
    y = stratum_yield(spark, d).agg(*(of(name, s).alias(f"{name}_{s}") for name in ("pool", "mined", "pairs") for s in ("multi", "single")))
    y = y.selectExpr(
        "cast(cast(coalesce(pool_multi, 0) * pairs_multi as decimal(38,0)) * mined_single as decimal(38,0)) + cast(cast(coalesce(pool_single, 0) * pairs_single as decimal(38,0)) * mined_multi as decimal(38,0)) as num",
        "cast(mined_multi * mined_single as decimal(38,0)) as den",
    )
    return y.select(F.col("num").cast("string").alias("num"), F.col("den").cast("string").alias("den"), gate(F.col("num"), F.col("den")).alias("decision"))


@query("unpaired_rows", f"SELECT prompt_id, unnest([true, false]) AS label, unnest([chosen, rejected]) AS gen FROM ({_PROMPTS}) WHERE chosen IS NOT NULL AND rejected IS NOT NULL")
def unpaired_rows(spark, d):
    """Each pair as a desirable and an undesirable row."""
    pairs = by_prompt(samples(spark, d)).where("chosen is not null and rejected is not null")
    row = lambda label, gen: F.struct(F.lit(label).alias("label"), F.col(gen).alias("gen"))
    return pairs.select("prompt_id", F.inline(F.array(row(True, "chosen"), row(False, "rejected"))))


@query("rsft_composition", f"SELECT prompt_id, CASE WHEN passed = 0 THEN 'target' ELSE 'generation' END AS answer, chosen AS gen FROM ({_PROMPTS}) WHERE passed < {GENERATIONS}")
def rsft_composition(spark, d):
    """The answer a prompt is trained on: its target if no generation passed, else the lowest that did; prompts whose every generation passed stay out."""
    rows = by_prompt(samples(spark, d)).where(F.col("passed") < GENERATIONS)
    return rows.select("prompt_id", F.when(F.col("passed") == 0, "target").otherwise("generation").alias("answer"), F.col("chosen").alias("gen"))


def numbered(rows: DataFrame, key: str, name: str = "pos") -> DataFrame:
    """rows with their place, from 0, in the order of the hex digest `key` and total.

    The leading digits deal rows into 4,096 even parts; a window over the parts' counts gives offsets, one inside each part the rest.
    """
    cut = rows.withColumn("_cut", F.substring(key, 1, 3))
    counts = cut.groupBy("_cut").agg(F.count("*").alias("_n"))
    offsets = counts.select("_cut", (F.sum("_n").over(Window.orderBy("_cut")) - F.col("_n")).alias("_off"), F.sum("_n").over(Window.partitionBy()).alias("total"))
    # At most 4,096 rows, whatever the input.
    out = cut.join(F.broadcast(offsets), "_cut")
    return out.withColumn(name, F.col("_off") + F.row_number().over(Window.partitionBy("_cut").orderBy(key)) - 1).drop("_cut", "_off")


def numbered_within(rows: DataFrame, by: str, key: str, name: str = "pos") -> DataFrame:
    """rows with their place, from 0, among those of their group in the order of the hex digest `key`. A group is dealt by the leading digits into 4,096 even parts, so a hot one isn't ranked in one task."""
    cut = rows.withColumn("_cut", F.substring(key, 1, 3))
    counts = cut.groupBy(by, "_cut").agg(F.count("*").alias("_n"))
    offsets = counts.select(F.col(by).alias("_by"), F.col("_cut").alias("_at"), (F.sum("_n").over(Window.partitionBy(by).orderBy("_cut")) - F.col("_n")).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(by, "_cut").orderBy(key))
    ranked = cut.withColumn("_k", inside)
    out = ranked.join(offsets, ranked[by].eqNullSafe(offsets["_by"]) & (ranked["_cut"] == offsets["_at"]))
    return out.withColumn(name, F.col("_off") + F.col("_k") - 1).drop("_cut", "_off", "_by", "_at", "_k")


@query(
    "cyclic_batches",
    f"WITH p AS (SELECT *, row_number() OVER (ORDER BY sha256('batch:' || prompt_id)) - 1 AS pos, count(*) OVER () AS total FROM ({_PROMPTS}) WHERE chosen IS NOT NULL AND rejected IS NOT NULL) "
    "SELECT a.pos, a.prompt_id AS desirable_prompt, a.chosen AS desirable, b.prompt_id AS undesirable_prompt, b.rejected AS undesirable FROM p a JOIN p b ON b.pos = (a.pos + 1) % a.total",
)
def cyclic_batches(spark, d):
    """Batches of a desirable row and the next prompt's undesirable one, the last with the first's; prompts in the order of a keyed hash."""
    pairs = by_prompt(samples(spark, d)).where("chosen is not null and rejected is not null")
    p = numbered(pairs.withColumn("key", F.sha2(F.concat(F.lit("batch:"), F.col("prompt_id").cast("string")), 256)), "key")
    a = p.select("pos", F.pmod(F.col("pos") + 1, F.col("total")).alias("next"), F.col("prompt_id").alias("desirable_prompt"), F.col("chosen").alias("desirable"))
    b = p.select(F.col("pos").alias("next"), F.col("prompt_id").alias("undesirable_prompt"), F.col("rejected").alias("undesirable"))
    return a.join(b, "next").select("pos", "desirable_prompt", "desirable", "undesirable_prompt", "undesirable")


_PENALTY = "CASE kind WHEN 'error' THEN 0 WHEN 'click' THEN 1 ELSE 2 END"


@query(
    "pairs_dedup_cap",
    f"WITH k AS (SELECT prompt_id, kind, min(gen) AS gen FROM ({_SAMPLES}) WHERE NOT ok GROUP BY prompt_id, kind), r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY {_PENALTY}, gen) AS k FROM k) SELECT prompt_id, kind, gen FROM r WHERE k <= 2",
)
def pairs_dedup_cap(spark, d):
    """Rejected generations: equal ones once (the first), then the two most severe of each prompt."""
    once = samples(spark, d).where("not ok").groupBy("prompt_id", "kind").agg(F.min("gen").alias("gen"))
    return once.withColumn("k", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.expr(_PENALTY), "gen"))).where("k <= 2").drop("k")


_LOOKS = "SELECT event_id % 21 AS step, count(*) FILTER (event_type = 'purchase') AS correct FROM events GROUP BY 1"


def looks(spark: SparkSession, d: str) -> DataFrame:
    """step, correct: a row for each look at a run; step 0 is the base model."""
    return table(spark, d, "events").groupBy((F.col("event_id") % 21).alias("step")).agg(F.count_if(F.col("event_type") == "purchase").alias("correct"))


@query(
    "checkpoint_selection",
    f"WITH l AS ({_LOOKS}), e AS (SELECT * FROM l WHERE step > 0 AND correct >= (SELECT correct - 2 FROM l WHERE step = 0)), t AS (SELECT * FROM e WHERE correct >= (SELECT max(correct) - 3 FROM e)) SELECT max(step) AS step, arg_max(correct, step) AS correct, count(*) AS tied FROM t",
)
def checkpoint_selection(spark, d):
    """Of the looks no more than 2 below the base and within 3 of the best such, the one with most steps. Windows are over a row for each look."""
    rows = looks(spark, d).withColumn("base", F.max(F.when(F.col("step") == 0, F.col("correct"))).over(Window.partitionBy()))
    rows = rows.where("step > 0 and correct >= base - 2").withColumn("best", F.max("correct").over(Window.partitionBy())).where("correct >= best - 3")
    return rows.agg(F.max("step").alias("step_"), F.max_by("correct", "step").alias("correct"), F.count("*").alias("tied")).withColumnRenamed("step_", "step")


@query(
    "kill_rule",
    f"WITH l AS ({_LOOKS}), x AS (SELECT step, (SELECT correct FROM l WHERE step = 0) - correct AS loss FROM l WHERE step > 0) SELECT step, loss, loss >= 26 OR (loss >= 3 AND coalesce(lag(loss) OVER (ORDER BY step) >= 3, false)) AS stop FROM x",
)
def kill_rule(spark, d):
    """Whether a run stops at a look: a loss of 3 or more at it and the one before, or of 26 at once."""
    rows = looks(spark, d).withColumn("loss", F.max(F.when(F.col("step") == 0, F.col("correct"))).over(Window.partitionBy()) - F.col("correct")).where("step > 0")
    twice = (F.col("loss") >= 3) & F.coalesce(F.lag("loss").over(Window.orderBy("step")) >= 3, F.lit(False))
    return rows.select("step", "loss", ((F.col("loss") >= 26) | twice).alias("stop"))


@query("look_schedule", "WITH t AS (SELECT count(*) AS total, greatest(50, (count(*) + 19) // 20) AS every FROM orders) SELECT unnest(list_distinct(list_append(range(every, total + 1, every), total))) AS step FROM t WHERE total > 0")
def look_schedule(spark, d):
    """The steps of a run at which it is looked at: at most about twenty, at least 50 apart, and its last."""
    t = table(spark, d, "orders").agg(F.count("*").alias("total")).where("total > 0").withColumn("every", F.expr("greatest(50, (total + 19) div 20)"))
    steps = F.when(F.col("total") >= F.col("every"), F.sequence("every", "total", "every")).otherwise(F.array("total"))
    return t.select(F.explode(F.array_union(steps, F.array("total"))).alias("step"))


@query("last_of_kind", "SELECT event_type AS kind, max(event_id) AS at, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def last_of_kind(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(F.max("event_id").alias("at"), F.max_by("value", "event_id").alias("value_")).withColumnRenamed("value_", "value")


def tango(b: Column, c: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Score limits of (c - b) / n for paired counts: b right to wrong, c wrong to right, of n.

    The statistic falls as the assumed difference grows, so each limit is found by halving; its
    variance uses the likelihood's maximum under that difference. Null where the counts aren't possible.
    """
    b, c, n = b.cast("double"), c.cast("double"), n.cast("double")

    def score(x: Column) -> Column:
        lin = (2 * n + b - c) * x - (b + c)
        q = (F.sqrt(F.greatest(lin * lin + 8 * n * b * x * (1 - x), F.lit(0.0))) - lin) / (4 * n)
        var = n * (2 * q + x * (1 - x))
        top = c - b - n * x
        return F.when(var > 0, top / F.sqrt(var)).otherwise(F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))).otherwise(0.0))

    def limit(lo: Column, hi: Column, at: float) -> Column:
        def halve(s: Column, _: Column) -> Column:
            mid = (s["lo"] + s["hi"]) / 2
            above = score(mid) > at
            return F.struct(F.when(above, mid).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(mid).alias("hi"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), F.struct(lo.alias("lo"), hi.alias("hi")), halve, lambda s: (s["lo"] + s["hi"]) / 2)

    seen = (c - b) / n
    possible = (n > 0) & (b >= 0) & (c >= 0) & (b + c <= n)
    lower = F.when(b == n, -1.0).otherwise(limit(F.lit(-1.0), seen, z))
    upper = F.when(c == n, 1.0).otherwise(limit(seen, F.lit(1.0), -z))
    return F.when(possible, lower), F.when(possible, upper)


def _score_sql(x: str) -> str:
    lin = f"((2.0 * n + b - c) * {x} - (b + c))"
    return f"(c - b - n * {x}) / sqrt(n * (2 * (sqrt(greatest({lin} * {lin} + 8.0 * n * b * {x} * (1 - {x}), 0)) - {lin}) / (4.0 * n) + {x} * (1 - {x})))"


def _side_sql(limit: str, z: float) -> str:
    above = f"{_score_sql(f'(({limit}_lo + {limit}_hi) / 2)')} > {z}"
    return f"CASE WHEN {above} THEN ({limit}_lo + {limit}_hi) / 2 ELSE {limit}_lo END, CASE WHEN {above} THEN {limit}_hi ELSE ({limit}_lo + {limit}_hi) / 2 END"


@query(
    "tango_interval",
    f"WITH RECURSIVE k AS ({_CONTRASTS}), r(candidate, b, c, n, i, l_lo, l_hi, u_lo, u_hi) AS (SELECT candidate, b, c, n, 0, -1.0::DOUBLE, (c - b) / n, (c - b) / n, 1.0::DOUBLE FROM k "
    f"UNION ALL SELECT candidate, b, c, n, i + 1, {_side_sql('l', Z)}, {_side_sql('u', -Z)} FROM r WHERE i < {HALVINGS}) "
    f"SELECT candidate, round(CASE WHEN b = n THEN -1 ELSE l_lo END, 6) AS lower, round(CASE WHEN c = n THEN 1 ELSE u_lo END, 6) AS upper FROM r WHERE i = {HALVINGS}",
)
def tango_interval(spark, d):
    rows = contrasts(spark, d)
    lower, upper = tango(F.col("b"), F.col("c"), F.col("n"))
    return rows.select("candidate", F.round(lower, 6).alias("lower"), F.round(upper, 6).alias("upper"))


@query("session_elapsed", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS elapsed_us FROM events GROUP BY user_id")
def session_elapsed(spark, d):
    """First and last time of each session and what lies between, in microseconds."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return rows.withColumn("elapsed_us", micros("last_ts") - micros("first_ts"))
