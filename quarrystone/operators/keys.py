"""Answer keys and pinned inputs: joins that refuse what doesn't fit, decisions between keys, exposure of names, gates on manifests and receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import derived_seed, keyed_hash, normalized, set_digest
from quarrystone.operators import stats
from quarrystone.operators.evaluation import field_differences
from quarrystone.operators.sampling import top_by_hash
from quarrystone.plans.registry import query
from quarrystone.sources.tables import table


def joined_to_key(rows: DataFrame, key: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """The rows with their key's columns, and the ids that a caller must refuse: without a key (unmatched), or with several (repeated)."""
    n = key.groupBy(ident).agg(F.count("*").alias("_n"))
    repeated = n.where("_n > 1").select(ident, F.lit("repeated").alias("fault"))
    unmatched = rows.select(ident).distinct().join(n, ident, "left_anti").select(ident, F.lit("unmatched").alias("fault"))
    return rows.join(key, ident), repeated.unionByName(unmatched)


@query(
    "key_join_refusals",
    "WITH k AS (SELECT doc_id FROM labels WHERE doc_id % 40 <> 7 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 60 = 11) SELECT doc_id, 'repeated' AS fault FROM k GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT DISTINCT doc_id, 'unmatched' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM k)",
)
def key_join_refusals(spark, d):
    """Generations whose id has no key, and keys that are there twice."""
    rows = table(spark, d, "labels").select("doc_id")
    key = rows.where("doc_id % 40 <> 7").unionByName(rows.where("doc_id % 60 = 11"))
    return joined_to_key(rows, key, "doc_id")[1]


_NAMED = """SELECT p_partkey AS id, p_brand AS category, [p_type, CASE WHEN p_partkey % 4 = 0 THEN 'lib.' || p_type ELSE p_name END, CASE WHEN p_partkey % 3 = 0 THEN 'other.' || p_name ELSE p_brand END] AS presented,
  CASE WHEN p_partkey % 7 = 0 THEN 'absent' WHEN p_partkey % 4 = 0 THEN 'lib.' || p_type ELSE p_type END AS keyed FROM part"""


def presented(spark: SparkSession, d: str) -> DataFrame:
    """id, category, presented (names of the tools of an item), keyed (the name that its key expects)."""
    c, k = F.col, F.col("p_partkey")
    names = F.array(c("p_type"), F.when(k % 4 == 0, F.concat(F.lit("lib."), "p_type")).otherwise(c("p_name")), F.when(k % 3 == 0, F.concat(F.lit("other."), "p_name")).otherwise(c("p_brand")))
    keyed = F.when(k % 7 == 0, "absent").when(k % 4 == 0, F.concat(F.lit("lib."), "p_type")).otherwise(c("p_type"))
    return table(spark, d, "part").select(k.alias("id"), c("p_brand").alias("category"), names.alias("presented"), keyed.alias("keyed"))


def tails(names: Column) -> Column:
    """Names without what stands before their last dot."""
    return F.transform(names, lambda n: F.substring_index(n, ".", -1))


@query(
    "qualified_name_exposure",
    f"SELECT category, count(*) AS n, count(*) FILTER (contains(keyed, '.')) AS qualified, count(*) FILTER (NOT list_contains(presented, keyed)) AS not_presented, count(*) FILTER (len(list_distinct(list_transform(presented, lambda x: split_part(x, '.', -1)))) < len(presented)) AS tail_collisions FROM ({_NAMED}) GROUP BY category",
)
def qualified_name_exposure(spark, d):
    """By category: items whose key has a qualified name, whose key isn't among their tools, and whose tools share a name but for its qualification."""
    last = tails(F.col("presented"))
    return presented(spark, d).groupBy("category").agg(
        F.count("*").alias("n"), F.count_if(F.col("keyed").contains(".")).alias("qualified"), F.count_if(~F.array_contains("presented", F.col("keyed"))).alias("not_presented"), F.count_if(F.size(F.array_distinct(last)) < F.size(last)).alias("tail_collisions")
    )


@query("answer_name_preflight", f"SELECT id, keyed FROM ({_NAMED}) WHERE NOT list_contains(presented, keyed)")
def answer_name_preflight(spark, d):
    """Keys that expect a name which their item doesn't offer."""
    return presented(spark, d).where(F.size(F.array_except(F.array("keyed"), "presented")) > 0).select("id", "keyed")


@query(
    "canonical_key_decision",
    f"WITH v AS (SELECT category, NOT bool_or(NOT list_contains(presented, keyed)) AS pinned, bool_and(id % 90 <> 13) AS release FROM ({_NAMED}) GROUP BY category) SELECT category, pinned, release, pinned <> release AS decided, CASE WHEN pinned AND NOT release THEN 'pinned' WHEN release AND NOT pinned THEN 'release' END AS selected FROM v",
)
def canonical_key_decision(spark, d):
    """Of two keys the only valid one; undecided if both or none are."""
    ok = F.array_contains("presented", F.col("keyed"))
    v = presented(spark, d).groupBy("category").agg(F.bool_and(ok).alias("pinned"), F.bool_and(F.col("id") % 90 != 13).alias("release"))
    one = F.when(F.col("pinned") & ~F.col("release"), "pinned").when(F.col("release") & ~F.col("pinned"), "release")
    return v.select("category", "pinned", "release", one.isNotNull().alias("decided"), one.alias("selected"))


_LONG = f"SELECT doc_id, unnest(['ref', 'cand_a', 'cand_b']) AS candidate, unnest([ref, cand_a, cand_b]) AS ok FROM ({stats._OUTCOMES})"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, candidate, ok."""
    ok = F.create_map(F.lit("ref"), F.col("quality") == 1, F.lit("cand_a"), F.col("toxic") == 0, F.lit("cand_b"), F.col("doc_id") % 7 != 0)
    return table(spark, d, "labels").select("doc_id", F.explode(ok).alias("candidate", "ok"))


@query("concordance", f"SELECT doc_id, count(DISTINCT ok) = 1 AS concordant, count(*) FILTER (ok) AS n_ok FROM ({_LONG}) WHERE doc_id % 3 = 0 GROUP BY doc_id")
def concordance(spark, d):
    """Disputed items: whether all candidates have the same outcome."""
    r = outcomes(spark, d).where("doc_id % 3 = 0").groupBy("doc_id").agg(F.bool_and("ok").alias("all"), F.bool_or("ok").alias("any"), F.count_if("ok").alias("n_ok"))
    return r.select("doc_id", (F.col("all") == F.col("any")).alias("concordant"), "n_ok")


@query("candidate_pivot", f"SELECT doc_id, bool_or(ok) FILTER (candidate = 'ref') AS ref, bool_or(ok) FILTER (candidate = 'cand_a') AS cand_a, bool_or(ok) FILTER (candidate = 'cand_b') AS cand_b FROM ({_LONG}) GROUP BY doc_id")
def candidate_pivot(spark, d):
    """Candidates side by side, the list of them given, so no pass is needed to find it."""
    return outcomes(spark, d).groupBy("doc_id").pivot("candidate", ["ref", "cand_a", "cand_b"]).agg(F.first("ok"))


@query("candidate_list", "SELECT unnest(['base', 'sft'] || list_transform(range(50, 201, 50), lambda s: 'step-' || s)) AS candidate, unnest(range(6)) AS pos")
def candidate_list(spark, d):
    """The candidates of a sweep: the base, the tuned model, and a checkpoint for each step."""
    steps = F.transform(F.sequence(F.lit(50), F.lit(200), F.lit(50)), lambda s: F.concat(F.lit("step-"), s.cast("string")))
    return spark.range(1).select(F.posexplode(F.concat(F.array(F.lit("base"), F.lit("sft")), steps)).alias("pos", "candidate")).select("candidate", F.col("pos").cast("long").alias("pos"))


@query("last_outcome_map", "SELECT candidate, CAST(len(m) AS BIGINT) AS n_ids, CAST(len(list_filter(m, lambda x: x)) AS BIGINT) AS n_ok FROM (SELECT candidate, list(ok) AS m FROM (SELECT event_type AS candidate, user_id, arg_max(value > 20, event_id) AS ok FROM events GROUP BY ALL) GROUP BY candidate)")
def last_outcome_map(spark, d):
    """Outcomes by candidate and id, the last line of each counting."""
    last = table(spark, d, "events").groupBy(F.col("event_type").alias("candidate"), "user_id").agg(F.max_by(F.col("value") > 20, "event_id").alias("ok"))
    return last.groupBy("candidate").agg(F.count("*").alias("n_ids"), F.count_if("ok").alias("n_ok"))


@query("discordant_digest", f"SELECT candidate, count(*) AS discordant, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS digest FROM (SELECT l.doc_id, l.candidate FROM ({_LONG}) l JOIN ({_LONG}) r ON l.doc_id = r.doc_id AND r.candidate = 'ref' WHERE l.candidate <> 'ref' AND l.ok <> r.ok) GROUP BY candidate")
def discordant_digest(spark, d):
    """How many items a candidate and the reference differ on, and the digest of their ids: the reference is joined by item. The digest is of one text, so a candidate's discordant ids must fit a row."""
    rows = outcomes(spark, d)
    ref = rows.where("candidate = 'ref'").select("doc_id", F.col("ok").alias("ref"))
    differ = rows.where("candidate <> 'ref'").join(ref, "doc_id").where("ok <> ref")
    return differ.groupBy("candidate").agg(F.count("*").alias("discordant"), set_digest(F.collect_list(F.col("doc_id").cast("string"))).alias("digest"))


@query("shared_items", f"SELECT doc_id FROM (SELECT doc_id FROM ({_LONG}) WHERE candidate = 'ref' INTERSECT SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def shared_items(spark, d):
    """Ids that both sides have."""
    return table(spark, d, "labels").select("doc_id").intersect(table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id"))


_COMPARED = f"SELECT candidate, n, b, c, p FROM ({stats._P}) JOIN (SELECT candidate, n FROM ({stats._CONTRASTS})) USING (candidate)"


@query(
    "compare_candidates",
    f"WITH p AS ({_COMPARED}), r AS (SELECT *, row_number() OVER (ORDER BY p, candidate) - 1 AS k, count(*) OVER () AS m FROM p) SELECT candidate, n, b, c, b + c AS discordant, round((c - b) / n, 6) AS delta, round(p, 6) AS p, round(max(least(1.0, (m - k) * p)) OVER (ORDER BY p, candidate ROWS UNBOUNDED PRECEDING), 6) AS p_holm, b - c >= 8 AS retention_fails FROM r",
)
def compare_candidates(spark, d):
    """Each candidate against the reference on the same items: counts, difference, exact p, its step-down adjustment, and whether the net loss is 8 or more. Windows are over a row for each candidate."""
    w = Window.orderBy("p", "candidate")
    r = stats.contrasts(spark, d).withColumn("p", stats.mcnemar(F.col("b"), F.col("c"))).withColumns({"k": F.row_number().over(w) - 1, "m": F.count("*").over(Window.partitionBy())})
    holm = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("k")) * F.col("p"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return r.select("candidate", "n", "b", "c", (F.col("b") + F.col("c")).alias("discordant"), F.round((F.col("c") - F.col("b")) / F.col("n"), 6).alias("delta"), F.round("p", 6).alias("p"), F.round(holm, 6).alias("p_holm"), (F.col("b") - F.col("c") >= 8).alias("retention_fails"))


_QUESTION = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"


@query(
    "question_collisions",
    f"WITH q AS (SELECT doc_id, source, {_QUESTION} AS t FROM documents), f AS (SELECT t, max(doc_id) AS id, arg_max(source, doc_id) AS source FROM q WHERE doc_id % 20 = 0 GROUP BY t) SELECT q.doc_id, f.source || ':' || f.id AS collides_with FROM q JOIN f USING (t) WHERE q.doc_id % 20 <> 0",
)
def question_collisions(spark, d):
    """Rows of a development set (ids not divisible by 20) whose question a final set has, with the last such question."""
    q = table(spark, d, "documents").select("doc_id", "source", F.md5(normalized(F.col("text"))).alias("t"))
    last = q.where("doc_id % 20 = 0").groupBy("t").agg(F.max(F.struct("doc_id", "source")).alias("f"))
    return q.where("doc_id % 20 <> 0").join(last, "t").select("doc_id", F.concat_ws(":", "f.source", F.col("f.doc_id").cast("string")).alias("collides_with"))


@query(
    "subset_gate_violations",
    "WITH s AS (SELECT doc_id FROM labels WHERE doc_id % 10 = 0 UNION ALL SELECT doc_id FROM labels WHERE doc_id % 100 = 0 UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE doc_id % 90 = 0), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id) "
    "SELECT doc_id, 'repeated' AS fault FROM n WHERE n > 1 UNION ALL SELECT doc_id, 'absent' FROM n WHERE doc_id NOT IN (SELECT doc_id FROM documents)",
)
def subset_gate_violations(spark, d):
    """Ids of a pinned subset that are there twice or that the items don't have."""
    ids = table(spark, d, "labels").select("doc_id")
    subset = ids.where("doc_id % 10 = 0").unionByName(ids.where("doc_id % 100 = 0")).unionByName(ids.where("doc_id % 90 = 0").select((F.col("doc_id") + 1000000000).alias("doc_id")))
    n = subset.groupBy("doc_id").agg(F.count("*").alias("n"))
    absent = n.join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_anti")
    return n.where("n > 1").select("doc_id", F.lit("repeated").alias("fault")).unionByName(absent.select("doc_id", F.lit("absent").alias("fault")))


@query("subset_rows", "SELECT d.doc_id, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def subset_rows(spark, d):
    """The rows of a pinned subset."""
    return table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels").where("quality = 0").select("doc_id"), "doc_id", "left_semi")


_IDS = "count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR)) || chr(10)) AS id_digest"


def payload(rows: DataFrame, ident: str = "doc_id") -> DataFrame:
    """What a payload is pinned by, in one row: its rows, distinct ids, and the digest of its ids in order. The digest is of one text, so the ids must fit a row: pins are for evaluation sets."""
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(ident).alias("n_ids"), set_digest(F.collect_list(F.col(ident).cast("string"))).alias("id_digest"))


@query("pinned_payload_check", f"WITH h AS (SELECT {_IDS} FROM labels), w AS (SELECT {_IDS} FROM (SELECT doc_id FROM labels UNION ALL SELECT min(doc_id) FROM labels)) SELECT 'n_rows' AS field, CAST(h.n_rows AS VARCHAR) AS have, CAST(w.n_rows AS VARCHAR) AS want FROM h, w UNION ALL SELECT 'id_digest', h.id_digest, w.id_digest FROM h, w")
def pinned_payload_check(spark, d):
    """Fields of a payload that aren't as they are pinned: here the pin is of a payload with one row twice."""
    ids = table(spark, d, "labels").select("doc_id")
    fields = lambda p: p.select(F.explode(F.create_map(*(x for c in p.columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("field", "value"))
    pinned = ids.unionByName(ids.agg(F.min("doc_id").alias("doc_id")))
    return field_differences(fields(payload(ids)), fields(payload(pinned)))


@query("ordered_id_digest", "SELECT o_orderstatus, sha256(string_agg(CAST(o_orderkey AS VARCHAR), chr(10) ORDER BY h, o_orderkey)) AS digest FROM (SELECT *, sha256('21:' || o_orderkey) AS h, row_number() OVER (PARTITION BY o_orderstatus ORDER BY sha256('21:' || o_orderkey), o_orderkey) AS k FROM orders) WHERE k <= 200 GROUP BY o_orderstatus")
def ordered_id_digest(spark, d):
    """The digest of a selection of 200 in the order of the selection."""
    chosen = top_by_hash(table(spark, d, "orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey", "21", 200)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string"))
    return chosen.groupBy("o_orderstatus").agg(F.sha2(F.array_join(ids, "\n"), 256).alias("digest"))


_ENTRIES = "SELECT n_name AS category, CASE WHEN n_nationkey % 5 = 0 THEN 'none_by_schema' WHEN n_nationkey % 7 = 3 THEN 'optional' ELSE 'required' END AS answer_key, CASE WHEN n_nationkey % 6 = 1 THEN 1 ELSE 2 END AS version FROM nation WHERE n_nationkey <> 4"


@query(
    "manifest_policy_violations",
    f"SELECT coalesce(e.category, n.n_name) AS category, CASE WHEN e.category IS NULL THEN 'not_declared' WHEN n.n_name IS NULL THEN 'not_pinned' WHEN version <> 2 THEN 'old_version' ELSE 'no_policy' END AS fault FROM ({_ENTRIES}) e FULL JOIN (SELECT n_name FROM nation WHERE n_nationkey <> 9) n ON e.category = n.n_name WHERE e.category IS NULL OR n.n_name IS NULL OR version <> 2 OR answer_key NOT IN ('required', 'none_by_schema')",
)
def manifest_policy_violations(spark, d):
    """Categories that are pinned but not declared or the reverse, of an old version, or without a rule on answer keys."""
    k = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    declared = nation.where(k != 4).select(F.col("n_name").alias("category"), F.when(k % 5 == 0, "none_by_schema").when(k % 7 == 3, "optional").otherwise("required").alias("answer_key"), F.when(k % 6 == 1, 1).otherwise(2).alias("version"))
    pinned = nation.where(k != 9).select(F.col("n_name").alias("pinned"))
    both = declared.join(pinned, F.col("category") == F.col("pinned"), "full")
    fault = F.when(F.col("category").isNull(), "not_declared").when(F.col("pinned").isNull(), "not_pinned").when(F.col("version") != 2, "old_version").when(~F.col("answer_key").isin("required", "none_by_schema"), "no_policy")
    return both.select(F.coalesce("category", "pinned").alias("category"), fault.alias("fault")).where("fault is not null")


@query("screened_files", f"SELECT category, sha256(category) AS sha256 FROM ({_ENTRIES}) WHERE answer_key = 'required'")
def screened_files(spark, d):
    """The files of a manifest that a screen reads, recorded with its result."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").where((k != 4) & (k % 5 != 0) & (k % 7 != 3)).select(F.col("n_name").alias("category"), F.sha2("n_name", 256).alias("sha256"))


@query(
    "receipt_gate",
    "SELECT n_name AS receipt, CASE WHEN digest <> sha256(n_name) THEN 'digest' WHEN criterion <> 'v1' THEN 'criterion' WHEN passed IS DISTINCT FROM 'true' THEN 'not_passed' WHEN superseded THEN 'superseded' END AS fault FROM (SELECT n_name, CASE WHEN n_nationkey % 6 = 2 THEN 'x' ELSE sha256(n_name) END AS digest, CASE WHEN n_nationkey % 7 = 1 THEN 'v0' ELSE 'v1' END AS criterion, CASE WHEN n_nationkey % 8 = 5 THEN '1' WHEN n_nationkey % 8 = 6 THEN NULL ELSE 'true' END AS passed, n_nationkey IN (10, 11) AS superseded FROM nation) WHERE digest <> sha256(n_name) OR criterion <> 'v1' OR passed IS DISTINCT FROM 'true' OR superseded",
)
def receipt_gate(spark, d):
    """Receipts that don't hold: of other bytes, of another criterion, not passed (the truth value itself, nothing that counts as true), or superseded. The first fault of each."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    r = table(spark, d, "nation").select(
        name, F.when(k % 6 == 2, "x").otherwise(F.sha2(name, 256)).alias("digest"), F.when(k % 7 == 1, "v0").otherwise("v1").alias("criterion"), F.when(k % 8 == 5, "1").when(k % 8 != 6, "true").alias("passed"), k.isin(10, 11).alias("superseded")
    )
    fault = F.when(F.col("digest") != F.sha2(name, 256), "digest").when(F.col("criterion") != "v1", "criterion").when(~F.col("passed").eqNullSafe("true"), "not_passed").when(F.col("superseded"), "superseded")
    return r.select(name.alias("receipt"), fault.alias("fault")).where("fault is not null")


@query("evidence_entry_violations", "SELECT source AS artifact, count(*) AS n FROM (SELECT doc_id, source FROM documents WHERE doc_id < 30) GROUP BY source HAVING count(*) <> 1")
def evidence_entry_violations(spark, d):
    """Artifacts that an index of evidence names more or less than once."""
    return table(spark, d, "documents").where("doc_id < 30").groupBy(F.col("source").alias("artifact")).agg(F.count("*").alias("n")).where("n <> 1")


@query("rows_by_id", "SELECT user_id AS id, count(*) AS n FROM events WHERE event_id % 40 = 0 GROUP BY user_id HAVING count(*) > 1")
def rows_by_id(spark, d):
    """Ids that a map from id to row must refuse, since several rows have them."""
    return table(spark, d, "events").where("event_id % 40 = 0").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@query("seeds", "SELECT p_partkey, CAST(('0x' || left(sha256('seed:' || p_partkey), 16))::UBIGINT // 2 AS BIGINT) AS seed FROM part")
def seeds(spark, d):
    """The seed that a row's sampling starts from."""
    return table(spark, d, "part").select("p_partkey", derived_seed(F.concat(F.lit("seed:"), F.col("p_partkey").cast("string"))).alias("seed"))


@query("blob_ids", "SELECT n_name, sha1('blob ' || octet_length(encode(n_name)) || chr(0) || n_name) AS blob, sha256(n_name) AS sha256 FROM nation")
def blob_ids(spark, d):
    """A content's id as version control has it, and its digest."""
    head = F.concat(F.lit("blob "), F.octet_length("n_name").cast("string"), F.chr(F.lit(0)))
    return table(spark, d, "nation").select("n_name", F.sha1(F.concat(head.cast("binary"), F.col("n_name").cast("binary"))).alias("blob"), F.sha2("n_name", 256).alias("sha256"))


@query("keyed_order", "SELECT n_name, row_number() OVER (ORDER BY sha256('11:' || n_nationkey)) AS pos FROM nation")
def keyed_order(spark, d):
    """The keyed order of a bounded table (25 rows), in one window."""
    return table(spark, d, "nation").select("n_name", F.row_number().over(Window.orderBy(keyed_hash("11", F.col("n_nationkey")))).alias("pos"))


_NICE = "SELECT event_id, strftime(ts, '%A') || ', ' || CAST(day(ts) AS VARCHAR) || CASE WHEN day(ts) IN (11, 12, 13) THEN 'th' WHEN day(ts) % 10 = 1 THEN 'st' WHEN day(ts) % 10 = 2 THEN 'nd' WHEN day(ts) % 10 = 3 THEN 'rd' ELSE 'th' END || ' of ' || strftime(ts, '%B %Y, %-I:%M %p') AS nice, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d') AS later FROM events"


@query("nice_dates", _NICE)
def nice_dates(spark, d):
    """Dates and times as people write them, and the date three days on."""
    ts = F.col("ts").cast("timestamp")
    day = F.dayofmonth(ts)
    ending = F.when(day.isin(11, 12, 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    nice = F.concat(F.date_format(ts, "EEEE"), F.lit(", "), day.cast("string"), ending, F.lit(" of "), F.date_format(ts, "MMMM yyyy, h:mm a"))
    return table(spark, d, "events").select("event_id", nice.alias("nice"), F.date_add(ts.cast("date"), 3).cast("string").alias("later"))


@query("session_seconds", "SELECT user_id, CAST(sum(CASE WHEN open THEN greatest(0, 1706745600 - epoch(ts)) ELSE value END) AS BIGINT) AS seconds FROM (SELECT user_id, ts, floor(value) AS value, event_type = 'signup' AS open FROM events) GROUP BY user_id")
def session_seconds(spark, d):
    """Seconds of a user's sessions: of ended ones as recorded, of open ones up to now (a given time), never below zero."""
    open_ = F.greatest(F.lit(0), F.lit(1706745600) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    spent = F.when(F.col("event_type") == "signup", open_).otherwise(F.floor("value").cast("double"))
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(spent).alias("s")).select("user_id", F.round("s").cast("long").alias("seconds"))
