"""A pool of prompts with targets: preflight of targets, the screen against a benchmark, allocation, guardrails and split planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import set_digest
from quarrystone.operators import contamination, study
from quarrystone.operators.prompts import ineligible_because, offer, stratum
from quarrystone.operators.toolcalls import REASONS, classify, extract_calls
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table

#: Names that the benchmark's tools have too, with their category.
LISTED = {"src1": "c0", "src3": "c0"}
#: Length gap and share of malformed rejections beyond which a set of pairs is remarked on, and reasons whose gap doesn't count.
GAP, MALFORMED = 0.40, 0.05
EXEMPT = ("missing_call", "spurious_call")

_PROMPT = r"""CASE doc_id % 6 WHEN 0 THEN concat('Tools:\n[{"name": "lookup"}, {"name": "', source, '"}]') WHEN 1 THEN concat('<tools>[{"name": "', source, '"}]</tools>')
  WHEN 2 THEN 'No list here.' WHEN 3 THEN 'Tools:\n[]' ELSE concat('<tools>[{"name": "lookup"}, {"function": {"name": "', source, '"}}, {"name": "third"}]</tools>') END"""
_TARGET = """CASE doc_id % 5 WHEN 0 THEN concat('{"name": "', source, '", "arguments": {}}') WHEN 1 THEN concat('<tool_call>{"name": "', source, '"}</tool_call>') WHEN 2 THEN 'Which one?'
  WHEN 3 THEN if(doc_id % 35 = 3, '{"name": "absent"}', '[{"name": "lookup"}, 7]') ELSE '' END"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    """row_id, source, user_text, n_tools, names, stratum, kind, called: prompts in both formats, and targets that call, answer in prose, are torn, empty, or call a name that isn't offered."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text", F.expr(_PROMPT).alias("prompt"), F.expr(_TARGET).alias("target"))
    read = docs.withColumn("o", offer("prompt")).withColumn("t", classify("target"))
    return read.select(F.col("doc_id").cast("string").alias("row_id"), "doc_id", "source", F.col("text").alias("user_text"), "o.n_tools", "o.names", stratum(F.col("o.n_tools")).alias("stratum"), "t.kind", F.col("t.names").alias("called"))


_ROWS = """SELECT *, CASE WHEN n_tools >= 2 THEN 'multi' WHEN n_tools = 1 THEN 'single' ELSE 'ineligible' END AS stratum,
  CASE WHEN doc_id % 5 < 2 OR doc_id % 35 = 3 THEN 'call' WHEN doc_id % 5 = 2 THEN 'no_call' ELSE 'unreadable' END AS kind,
  CASE WHEN doc_id % 35 = 3 THEN true ELSE false END AS defect
  FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS row_id, source, text, CASE doc_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN NULL WHEN 3 THEN 0 ELSE 3 END AS n_tools FROM documents)"""


@query(
    "target_preflight",
    f"""WITH r AS ({_ROWS}) SELECT count(*) AS raw_rows, count(*) FILTER (stratum = 'ineligible') AS prompt_ineligible, count(*) FILTER (stratum <> 'ineligible') AS eligible_rows,
    count(*) FILTER (stratum <> 'ineligible' AND kind = 'call') AS call_targets, count(*) FILTER (stratum <> 'ineligible' AND kind = 'no_call') AS no_call_targets,
    count(*) FILTER (stratum <> 'ineligible' AND kind = 'unreadable') AS unreadable, count(*) FILTER (stratum <> 'ineligible' AND kind <> 'unreadable') AS retained_rows,
    count(*) FILTER (stratum <> 'ineligible' AND kind = 'call' AND defect) AS defects, count(*) FILTER (stratum <> 'ineligible' AND kind = 'call' AND defect) = 0 AS passed FROM r""",
)
def target_preflight(spark, d):
    """What a pool's targets are: calls, prose, unreadable; and calls of names that their prompts don't offer, any of which fails it."""
    r = rows(spark, d)
    ok = F.col("stratum") != "ineligible"
    kind = lambda k: F.count_if(ok & (F.col("kind") == k))
    defects = F.count_if(ok & (F.size(F.array_except("called", "names")) > 0))
    return r.agg(
        F.count("*").alias("raw_rows"), F.count_if(~ok).alias("prompt_ineligible"), F.count_if(ok).alias("eligible_rows"), kind("call").alias("call_targets"), kind("no_call").alias("no_call_targets"),
        kind("unreadable").alias("unreadable"), F.count_if(ok & (F.col("kind") != "unreadable")).alias("retained_rows"), defects.alias("defects"), (defects == 0).alias("passed"),
    )


def screened(spark: SparkSession, d: str) -> DataFrame:
    """The rows that are eligible and free of name defects, with reason: an n-gram of the benchmark, else a listed name (names in sorted order), else null."""
    r = rows(spark, d).where("stratum <> 'ineligible' and kind <> 'unreadable'").where(F.size(F.array_except("called", "names")) == 0)
    hits = contamination.first_hits(r.select("doc_id", F.col("user_text").alias("text")), contamination.gram_index(contamination.items(spark, d)))
    known = F.create_map(*(F.lit(x) for kv in LISTED.items() for x in kv))
    named = F.get(F.filter(F.array_sort("names"), lambda n: n.isin(*LISTED)), 0)
    by_name = F.when(named.isNotNull(), F.concat(F.lit("fn_name:"), named, F.lit(":"), F.try_element_at(known, named)))
    return r.join(hits, "doc_id", "left").select("row_id", "stratum", F.coalesce(F.concat(F.lit("ngram_overlap:"), "category"), by_name).alias("reason"))


_SCREENED = f"""SELECT r.row_id, r.stratum, coalesce('ngram_overlap:' || h.category, CASE WHEN r.source IN ('src1', 'src3') THEN 'fn_name:' || r.source || ':c0' END) AS reason
  FROM ({_ROWS}) r LEFT JOIN ({contamination.FIRST_HITS}) h USING (doc_id) WHERE stratum <> 'ineligible' AND kind <> 'unreadable' AND NOT defect"""
_DIGEST = "sha256(string_agg(row_id, chr(10) ORDER BY row_id){0} || chr(10))"


@query(
    "contamination_artifact",
    f"""WITH s AS ({_SCREENED}), r AS ({_ROWS}) SELECT (SELECT count(*) FROM r) AS raw_rows, (SELECT count(*) FROM r WHERE stratum = 'ineligible') AS prompt_ineligible,
    (SELECT count(*) FROM r WHERE stratum <> 'ineligible' AND kind = 'unreadable') AS structurally_excluded, (SELECT count(*) FROM r WHERE stratum <> 'ineligible' AND kind <> 'unreadable' AND defect) AS name_defects,
    count(*) AS screen_input, count(*) FILTER (reason IS NOT NULL AND stratum = 'multi') AS dropped_multi, count(*) FILTER (reason IS NOT NULL AND stratum = 'single') AS dropped_single,
    count(*) FILTER (reason IS NULL AND stratum = 'multi') AS n_multi, count(*) FILTER (reason IS NULL AND stratum = 'single') AS n_single, count(*) FILTER (reason IS NULL) AS n,
    {_DIGEST.format('')} AS input_digest, {_DIGEST.format(' FILTER (reason IS NULL)')} AS survivor_digest, true AS reconciles FROM s""",
)
def contamination_artifact(spark, d):
    """The counts that a screened pool is published with: every row is ineligible, excluded, defective, dropped or a survivor, and digests tell which ids went in and which are left."""
    r, s = rows(spark, d), screened(spark, d)
    ok = F.col("stratum") != "ineligible"
    missing = F.size(F.array_except("called", "names")) > 0
    pre = r.agg(F.count("*").alias("raw_rows"), F.count_if(~ok).alias("prompt_ineligible"), F.count_if(ok & (F.col("kind") == "unreadable")).alias("structurally_excluded"), F.count_if(ok & (F.col("kind") != "unreadable") & missing).alias("name_defects"))
    gone, at = F.col("reason").isNotNull(), lambda k: F.col("stratum") == k
    post = s.agg(
        F.count("*").alias("screen_input"), F.count_if(gone & at("multi")).alias("dropped_multi"), F.count_if(gone & at("single")).alias("dropped_single"), F.count_if(~gone & at("multi")).alias("n_multi"),
        F.count_if(~gone & at("single")).alias("n_single"), F.count_if(~gone).alias("n"), set_digest(F.collect_list("row_id")).alias("input_digest"), set_digest(F.collect_list(F.when(~gone, F.col("row_id")))).alias("survivor_digest"),
    )
    # One row each.
    both = pre.join(F.broadcast(post), F.lit(True))
    return both.withColumn("reconciles", F.col("raw_rows") == F.col("prompt_ineligible") + F.col("structurally_excluded") + F.col("name_defects") + F.col("dropped_multi") + F.col("dropped_single") + F.col("n"))


@query("screen_drop_counts", f"SELECT stratum, split_part(reason, ':', 1) AS reason, count(*) AS n FROM ({_SCREENED}) WHERE reason IS NOT NULL GROUP BY ALL")
def screen_drop_counts(spark, d):
    return screened(spark, d).where("reason is not null").groupBy("stratum", F.split_part("reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))


@query("prompt_reasons", f"SELECT coalesce(CASE WHEN n_tools IS NULL THEN 'no_tool_list' WHEN n_tools < 1 THEN 'zero_tools' END, 'eligible') AS reason, count(*) AS n FROM ({_ROWS}) GROUP BY 1")
def prompt_reasons(spark, d):
    return rows(spark, d).groupBy(F.coalesce(ineligible_because(F.col("n_tools")), F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


def two_strata(n: Column, multi: Column, single: Column) -> Column:
    """Struct (multi, single, error): n dealt to two strata in proportion, the larger remainder first and multi before single; a stratum
    without any takes one from the other. error says why there is no such allocation. All in integers."""
    total = multi + single
    base = lambda c: F.try_divide(n * c - F.try_mod(n * c, total), total).cast("long")
    m, s = base(multi), base(single)
    left, more = n - m - s, F.try_mod(n * multi, total) >= F.try_mod(n * single, total)
    m, s = m + F.when((left >= 2) | ((left == 1) & more), 1).otherwise(0), s + F.when((left >= 2) | ((left == 1) & ~more), 1).otherwise(0)
    give_m, give_s = (s == 0) & (m >= 2), (m == 0) & (s >= 2)
    m2, s2 = F.when(give_m, m - 1).when(give_s, 1).otherwise(m), F.when(give_s, s - 1).when(give_m, 1).otherwise(s)
    error = F.when(n < 2, "too_few_prompts").when(total == 0, "no_prompts").when((m2 == 0) | (s2 == 0), "stratum_empty").when((m2 > multi) | (s2 > single), "stratum_short")
    ok = error.isNull()
    return F.struct(F.when(ok, m2).cast("long").alias("multi"), F.when(ok, s2).cast("long").alias("single"), error.alias("error"))


_SIZES = "SELECT CAST(l_linenumber * 7 - 6 AS BIGINT) AS n, count(*) FILTER (l_quantity < 2) AS multi, count(*) FILTER (l_quantity > 60 - l_linenumber * 3 OR l_quantity = 50) AS single FROM lineitem GROUP BY l_linenumber"


@query(
    "two_stratum_allocation",
    f"""WITH z AS ({_SIZES}), b AS (SELECT *, multi + single AS total, n * multi // nullif(multi + single, 0) AS m, n * single // nullif(multi + single, 0) AS s FROM z),
    r AS (SELECT n, multi AS cm, single AS cs, total, CASE WHEN n - m - s >= 1 AND (n * multi) % total >= (n * single) % total THEN m + 1 ELSE m END AS m, CASE WHEN n - m - s >= 1 AND (n * multi) % total < (n * single) % total THEN s + 1 ELSE s END AS s FROM b),
    f AS (SELECT n, cm, cs, total, CASE WHEN s = 0 AND m >= 2 THEN m - 1 WHEN m = 0 AND s >= 2 THEN 1 ELSE m END AS m, CASE WHEN m = 0 AND s >= 2 THEN s - 1 WHEN s = 0 AND m >= 2 THEN 1 ELSE s END AS s FROM r),
    e AS (SELECT *, CASE WHEN n < 2 THEN 'too_few_prompts' WHEN total = 0 THEN 'no_prompts' WHEN m = 0 OR s = 0 THEN 'stratum_empty' WHEN m > cm OR s > cs THEN 'stratum_short' END AS error FROM f)
    SELECT n, CASE WHEN error IS NULL THEN m END AS multi, CASE WHEN error IS NULL THEN s END AS single, error FROM e""",
)
def two_stratum_allocation(spark, d):
    sizes = table(spark, d, "lineitem").groupBy("l_linenumber").agg(F.count_if(F.col("l_quantity") < 2).alias("m"), F.count_if(F.expr("l_quantity > 60 - l_linenumber * 3 or l_quantity = 50")).alias("s"))
    n = F.col("l_linenumber").cast("long") * 7 - 6
    return sizes.select(n.alias("n"), two_strata(n, F.col("m"), F.col("s")).alias("a")).select("n", "a.multi", "a.single", "a.error")


def generations(spark: SparkSession, d: str) -> DataFrame:
    """prompt_id, gen, kind, ok, text, reason: samples with a text each and the reason of a rejection."""
    s = study.samples(spark, d)
    text = F.when(F.col("kind") == "error", F.lit('{"name": "purchase"')).when(F.col("kind") == "click", F.lit("Let me think about that for a moment.")).otherwise(F.concat(F.lit('{"name": "'), "kind", F.lit('", "arguments": {"gen": '), F.col("gen").cast("string"), F.lit("}}")))
    reason = F.when(F.col("kind") == "error", "invalid_json").when(F.col("kind") == "click", "missing_call").when(F.col("kind") != "purchase", "wrong_tool")
    return s.withColumns({"text": text, "reason": reason})


_GENERATIONS = f"""SELECT *, CASE kind WHEN 'error' THEN '{{"name": "purchase"' WHEN 'click' THEN 'Let me think about that for a moment.' ELSE '{{"name": "' || kind || '", "arguments": {{"gen": ' || gen || '}}}}' END AS text,
  CASE kind WHEN 'error' THEN 'invalid_json' WHEN 'click' THEN 'missing_call' WHEN 'purchase' THEN NULL ELSE 'wrong_tool' END AS reason FROM ({study._SAMPLES})"""
_PAIRS = f"SELECT prompt_id, arg_min(text, gen) FILTER (ok) AS chosen, arg_min(text, gen) FILTER (NOT ok) AS rejected, arg_min(reason, gen) FILTER (NOT ok) AS reason FROM ({_GENERATIONS}) GROUP BY prompt_id HAVING bool_or(ok) AND bool_or(NOT ok)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """prompt_id, chosen, rejected, reason: of each prompt with both, the lowest accepted and rejected generation. Prompts' generations are at most eight."""
    g = generations(spark, d).withColumn("x", F.struct("gen", "text", "reason"))
    out = g.groupBy("prompt_id").agg(F.min(F.when(F.col("ok"), F.col("x"))).alias("c"), F.min(F.when(~F.col("ok"), F.col("x"))).alias("r")).where("c is not null and r is not null")
    return out.select("prompt_id", F.col("c.text").alias("chosen"), F.col("r.text").alias("rejected"), "r.reason")


@query(
    "length_gap_diagnostics",
    f"""WITH p AS (SELECT *, abs(length(chosen) - length(rejected)) / greatest(length(chosen), length(rejected)) > {GAP} AS far, reason IN {EXEMPT} AS exempt FROM ({_PAIRS}))
    SELECT count(*) AS pairs, count(*) FILTER (far AND NOT exempt) AS over_reference, count(*) FILTER (far AND exempt) AS exempt, round(count(*) FILTER (far AND NOT exempt) / nullif(count(*), 0), 6) AS gap_share,
    count(*) FILTER (reason = 'invalid_json') AS malformed, round(count(*) FILTER (reason = 'invalid_json') / nullif(count(*), 0), 6) AS malformed_share,
    count(*) FILTER (far AND NOT exempt) > 0 OR coalesce(count(*) FILTER (reason = 'invalid_json') / nullif(count(*), 0) > {MALFORMED}, false) AS would_bind FROM p""",
)
def length_gap_diagnostics(spark, d):
    """How many pairs differ much in length or have a malformed rejection; measured, not filtered. Without pairs the shares are null and nothing binds."""
    longest = F.greatest(F.length("chosen"), F.length("rejected"))
    far = F.coalesce(F.try_divide(F.abs(F.length("chosen") - F.length("rejected")), longest) > GAP, F.lit(False))
    p = pairs(spark, d).select(far.alias("far"), F.coalesce(F.col("reason").isin(*EXEMPT), F.lit(False)).alias("exempt"), (extract_calls("rejected")["kind"] == "unreadable").alias("bad"))
    p = p.agg(F.count("*").alias("pairs"), F.count_if(F.col("far") & ~F.col("exempt")).alias("over_reference"), F.count_if(F.col("far") & F.col("exempt")).alias("exempt"), F.count_if("bad").alias("malformed"))
    share = lambda c: F.try_divide(c, "pairs")
    binds = (F.col("over_reference") > 0) | F.coalesce(share("malformed") > MALFORMED, F.lit(False))
    return p.select("pairs", "over_reference", "exempt", F.round(share("over_reference"), 6).alias("gap_share"), "malformed", F.round(share("malformed"), 6).alias("malformed_share"), binds.alias("would_bind"))


@query(
    "malformed_cap",
    f"WITH m AS (SELECT prompt_id, row_number() OVER (ORDER BY sha256('cap:' || prompt_id)) AS k FROM ({_PAIRS}) WHERE reason = 'invalid_json'), n AS (SELECT count(*) AS n FROM ({_PAIRS})) "
    f"SELECT prompt_id FROM ({_PAIRS}) WHERE reason <> 'invalid_json' UNION ALL SELECT prompt_id FROM m, n WHERE k <= greatest(1, n // 20)",
)
def malformed_cap(spark, d):
    """All pairs with a rejection that parses, and of the malformed ones the first twentieth of all pairs in keyed order; at least one."""
    p = pairs(spark, d).select("prompt_id", "reason").withColumn("key", F.sha2(F.concat(F.lit("cap:"), F.col("prompt_id").cast("string")), 256))
    bad = study.numbered(p.where("reason = 'invalid_json'"), "key")
    n = p.agg(F.expr("greatest(1, count(*) div 20)").alias("cap"))
    # A one-row side.
    return p.where("reason <> 'invalid_json'").select("prompt_id").unionByName(bad.join(F.broadcast(n), F.col("pos") < F.col("cap")).select("prompt_id"))


_BUCKETS = f"SELECT CASE WHEN prompt_id % 4 < 3 THEN 'multi' ELSE 'single' END AS stratum, CASE WHEN passed = 0 THEN 'zero_correct' WHEN passed = n THEN 'all_correct' ELSE 'pair' END AS bucket FROM ({study._PROMPTS})"


def buckets(spark: SparkSession, d: str) -> DataFrame:
    b = study.by_prompt(study.samples(spark, d))
    bucket = F.when(F.col("passed") == 0, "zero_correct").when(F.col("passed") == F.col("n"), "all_correct").otherwise("pair")
    return b.select("prompt_id", "n", "passed", "chosen", "rejected", F.when(F.col("prompt_id") % 4 < 3, "multi").otherwise("single").alias("stratum"), bucket.alias("bucket"))


@query(
    "bucket_breakdown",
    f"WITH b AS ({_BUCKETS}), k AS (SELECT s AS stratum, x AS bucket FROM (SELECT unnest(['multi', 'single']) AS s), (SELECT unnest(['pair', 'all_correct', 'zero_correct']) AS x)), n AS (SELECT k.stratum, k.bucket, count(b.stratum) AS n FROM k LEFT JOIN b ON b.stratum = k.stratum AND b.bucket = k.bucket GROUP BY ALL) "
    "SELECT stratum, bucket, n, CAST(sum(n) OVER (PARTITION BY stratum) AS BIGINT) AS total, round(n / nullif(sum(n) OVER (PARTITION BY stratum), 0), 4) AS rate FROM n",
)
def bucket_breakdown(spark, d):
    """Prompts by what their generations did and by stratum, all cells present. Windows are over the six cells."""
    strata, kinds = (F.explode(F.array(*map(F.lit, names))) for names in (("multi", "single"), ("pair", "all_correct", "zero_correct")))
    cells = spark.range(1).select(strata.alias("stratum")).withColumn("bucket", kinds)
    n = buckets(spark, d).groupBy("stratum", "bucket").agg(F.count("*").alias("c"))
    every = F.sum("n").over(Window.partitionBy("stratum"))
    out = cells.join(n, ["stratum", "bucket"], "left").select("stratum", "bucket", F.coalesce("c", F.lit(0)).alias("n"))
    return out.select("stratum", "bucket", "n", every.alias("total"), F.round(F.try_divide(F.col("n"), every), 4).alias("rate"))


def cell_plan(cells: DataFrame) -> DataFrame:
    """cell, n, n_eval, n_train, thin: a tenth of each cell, rounded up, is held out; a cell of one row can't be split."""
    n = F.col("n")
    held = F.greatest(F.lit(1), F.expr("(n + 9) div 10"))
    return cells.select("cell", "n", held.cast("long").alias("n_eval"), (n - held).cast("long").alias("n_train"), (n < 2).alias("thin"))


@query("split_planning_cells", f"SELECT reason AS cell, count(*) AS n, greatest(1, (count(*) + 9) // 10) AS n_eval, count(*) - greatest(1, (count(*) + 9) // 10) AS n_train, count(*) < 2 AS thin FROM ({_PAIRS}) GROUP BY reason")
def split_planning_cells(spark, d):
    return cell_plan(pairs(spark, d).groupBy(F.col("reason").alias("cell")).agg(F.count("*").alias("n")))


@query(
    "planned_steps",
    f"WITH c AS (SELECT reason, count(*) AS n FROM ({_PAIRS}) GROUP BY reason), t AS (SELECT coalesce(sum(n - greatest(1, (n + 9) // 10)), 0) AS train, coalesce(bool_or(n < 2 OR reason NOT IN {tuple(REASONS)}), false) AS refused FROM c) "
    "SELECT refused, CASE WHEN NOT refused THEN CAST(train AS BIGINT) END AS train_pairs, CASE WHEN NOT refused THEN CAST((train + 15) // 16 AS BIGINT) END AS steps, CASE WHEN NOT refused THEN (train + 15) // 16 < 250 END AS wide_arm, CASE WHEN NOT refused THEN CASE WHEN (train + 15) // 16 < 250 THEN 5 ELSE 4 END END AS family_size FROM t",
)
def planned_steps(spark, d):
    """Steps of a run over the training side of the split, 16 pairs each; under 250 of them one more arm runs and the family of tests grows by one. Refused if a cell is thin or no known reason."""
    cells = cell_plan(pairs(spark, d).groupBy(F.col("reason").alias("cell")).agg(F.count("*").alias("n")))
    bad = F.col("thin") | ~F.coalesce(F.col("cell").isin(*REASONS), F.lit(False))
    t = cells.agg(F.coalesce(F.sum("n_train"), F.lit(0)).alias("train"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("refused")).withColumn("s", F.expr("(train + 15) div 16"))
    ok = ~F.col("refused")
    return t.select("refused", F.when(ok, F.col("train")).alias("train_pairs"), F.when(ok, F.col("s")).alias("steps"), F.when(ok, F.col("s") < 250).alias("wide_arm"), F.when(ok, F.when(F.col("s") < 250, 5).otherwise(4)).alias("family_size"))


@query(
    "calibration_completeness",
    f"WITH b AS ({_BUCKETS}), m AS (SELECT stratum, count(*) AS mined FROM b GROUP BY stratum), a AS (SELECT * FROM (VALUES ('multi', 110), ('single', 38)) t(stratum, allocated)) SELECT a.stratum, CAST(allocated AS BIGINT) AS allocated, coalesce(mined, 0) AS mined, coalesce(mined, 0) = allocated AS complete FROM a LEFT JOIN m USING (stratum)",
)
def calibration_completeness(spark, d):
    """Whether as many prompts of each stratum were mined as were allocated; no decision is taken before that."""
    wanted = spark.createDataFrame([("multi", 110), ("single", 38)], "stratum string, allocated long")
    mined = buckets(spark, d).groupBy("stratum").agg(F.count("*").alias("m"))
    got = F.coalesce("m", F.lit(0))
    return wanted.join(mined, "stratum", "left").select("stratum", "allocated", got.alias("mined"), (got == F.col("allocated")).alias("complete"))


@query("mine_prompt_violations", f"SELECT prompt_id, count(*) AS n FROM ({study._SAMPLES}) GROUP BY prompt_id HAVING count(*) <> {study.GENERATIONS}")
def mine_prompt_violations(spark, d):
    """Prompts that don't have exactly eight judged generations."""
    return study.by_prompt(study.samples(spark, d)).where(F.col("n") != study.GENERATIONS).select("prompt_id", "n")


@query("sft_bucket", f"SELECT prompt_id, stratum FROM (SELECT prompt_id, CASE WHEN prompt_id % 4 < 3 THEN 'multi' ELSE 'single' END AS stratum, passed FROM ({study._PROMPTS})) WHERE passed = 0")
def sft_bucket(spark, d):
    """Prompts that no generation passed: they are trained on their targets."""
    return buckets(spark, d).where("bucket = 'zero_correct'").select("prompt_id", "stratum")


@query(
    "solo_rows",
    f"SELECT prompt_id || ':solo' AS pair_id, prompt_id, CASE WHEN passed = 0 THEN 'zero_correct' ELSE 'all_correct' END AS bucket, passed AS accepted_count, passed > 0 AS label, coalesce(least(chosen, rejected), chosen, rejected) AS gen FROM ({study._PROMPTS}) WHERE n = {study.GENERATIONS} AND passed IN (0, {study.GENERATIONS})",
)
def solo_rows(spark, d):
    """A row of the lowest generation for each prompt that all or no generations passed."""
    b = buckets(spark, d).where((F.col("n") == study.GENERATIONS) & F.col("passed").isin(0, study.GENERATIONS))
    return b.select(F.concat(F.col("prompt_id").cast("string"), F.lit(":solo")).alias("pair_id"), "prompt_id", "bucket", F.col("passed").alias("accepted_count"), (F.col("passed") > 0).alias("label"), F.coalesce(F.least("chosen", "rejected"), "chosen", "rejected").alias("gen"))


@query(
    "solo_reconciliation",
    f"WITH a AS (SELECT prompt_id FROM ({study._PROMPTS}) WHERE chosen IS NOT NULL AND rejected IS NOT NULL), b AS (SELECT prompt_id FROM ({_PAIRS}) WHERE prompt_id % 11 <> 3) SELECT prompt_id, 'ledger_only' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT prompt_id, 'artifact_only' FROM (FROM b EXCEPT FROM a)",
)
def solo_reconciliation(spark, d):
    """Ids of mixed prompts that the ledger and the artifact of pairs (here one with gaps) don't share."""
    a = buckets(spark, d).where("bucket = 'pair'").select("prompt_id")
    b = pairs(spark, d).where("prompt_id % 11 <> 3").select("prompt_id")
    side = lambda x, y, name: x.exceptAll(y).select("prompt_id", F.lit(name).alias("side"))
    return side(a, b, "ledger_only").unionByName(side(b, a, "artifact_only"))


_CELLS = f"SELECT prompt_id, stratum || ':' || bucket AS cell FROM (SELECT prompt_id, CASE WHEN prompt_id % 4 < 3 THEN 'multi' ELSE 'single' END AS stratum, CASE WHEN passed = 0 THEN 'zero_correct' WHEN passed = n THEN 'all_correct' ELSE 'pair' END AS bucket FROM ({study._PROMPTS}))"


@query(
    "cellwise_split",
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY sha256('42:' || prompt_id)) AS k, count(*) OVER (PARTITION BY cell) AS n FROM ({_CELLS})) SELECT prompt_id, cell, CASE WHEN n < 2 THEN 'thin' WHEN k <= greatest(1, (n + 9) // 10) THEN 'eval' ELSE 'train' END AS side FROM r",
)
def cellwise_split(spark, d):
    """A tenth of each cell, rounded up, is held out in the order of a keyed hash; a cell of one row is named thin and not split."""
    b = buckets(spark, d).select("prompt_id", F.concat_ws(":", "stratum", "bucket").alias("cell")).withColumn("key", F.sha2(F.concat(F.lit("42:"), F.col("prompt_id").cast("string")), 256))
    plan = cell_plan(b.groupBy("cell").agg(F.count("*").alias("n"))).select("cell", "n_eval", "thin")
    ranked = study.numbered_within(b, "cell", "key").join(F.broadcast(plan), "cell")  # a row for each cell: at most six
    return ranked.select("prompt_id", "cell", F.when(F.col("thin"), "thin").when(F.col("pos") < F.col("n_eval"), "eval").otherwise("train").alias("side"))
