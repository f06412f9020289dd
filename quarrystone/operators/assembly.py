"""Training sets put together from sources: conversations from columns, filters, samples with backfill, spot checks, splits, rendered reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.text import keyed_hash
from quarrystone.operators import study
from quarrystone.operators.messages import in_order
from quarrystone.operators.toolcalls import call_text
from quarrystone.plans.registry import query
from quarrystone.sources.tables import readable, table

# A list repeated by a factor, as text that was meant to be evaluated; roles by the names that sources use.
REPEATED_LIST = r'\[[^\]"]*\] \* \d+'
ROLES = {"system": "system", "human": "user", "gpt": "assistant", "tool": "tool"}
#: What a system prompt says before its tools, and what it is without any.
OFFER, PLAIN = "You can call the tools below with a JSON object that has a name and arguments.\n\nTools:\n", "You answer questions."


def renamed_turns(turns: Column) -> Column:
    """Turns (role, text) with roles by ROLES; those of other roles or without text are dropped."""
    roles = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    mapped = F.transform(turns, lambda t: F.struct(F.try_element_at(roles, t["role"]).alias("role"), t["text"].alias("content")))
    return F.filter(mapped, lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))


_SOURCE_TURNS = "SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN CASE WHEN turn % 7 = 6 THEN 'observer' ELSE 'human' END ELSE role END AS role, CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN '' ELSE text END AS text FROM conversations"


def source_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as another source has them: other names of roles, one that no map knows, and empty turns."""
    return table(spark, d, "conversations").selectExpr("conv_id", "turn", "CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN CASE WHEN turn % 7 = 6 THEN 'observer' ELSE 'human' END ELSE role END AS role", "CASE WHEN conv_id % 9 = 4 AND turn = 1 THEN '' ELSE text END AS text")


def normalized_conversations(turns: DataFrame, config: str) -> DataFrame:
    """source_id, messages: conversations of three messages or more after roles are mapped."""
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    out = rows.select("conv_id", renamed_turns(F.col("t")).alias("messages")).where(F.size("messages") >= 3)
    return out.select(F.concat(F.lit(f"{config}-"), F.col("conv_id").cast("string")).alias("source_id"), "messages")


_NORMAL = """SELECT '{0}-' || conv_id AS source_id, count(*) AS n, md5(string_agg(r || ':' || text, '|' ORDER BY turn)) AS digest
  FROM (SELECT *, CASE role WHEN 'gpt' THEN 'assistant' WHEN 'human' THEN 'user' WHEN 'system' THEN 'system' WHEN 'tool' THEN 'tool' END AS r FROM (""" + _SOURCE_TURNS + """) WHERE {1}) WHERE r IS NOT NULL AND text <> '' GROUP BY conv_id HAVING count(*) >= 3"""


@query("multi_config_union", _NORMAL.format("multi", "conv_id % 2 = 0") + " UNION ALL " + _NORMAL.format("single", "conv_id % 2 = 1"))
def multi_config_union(spark, d):
    """The configurations of a source, each normalized and named, one after the other; one that can't be read counts as empty."""
    turns = source_turns(spark, d)
    parts = [normalized_conversations(turns.where("conv_id % 2 = 0"), "multi"), normalized_conversations(turns.where("conv_id % 2 = 1"), "single")]
    gated = readable(lambda: table(spark, d, "no_such_table"), turns.schema)
    every = parts[0].unionByName(parts[1]).unionByName(normalized_conversations(gated, "gated"))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return every.select("source_id", F.size("messages").cast("long").alias("n"), F.md5(text).alias("digest"))


def system_prompt(tools: Column) -> Column:
    """tools: a JSON list as text, null or empty for none."""
    return F.when(F.coalesce(tools, F.lit("[]")) == "[]", PLAIN).otherwise(F.concat(F.lit(OFFER), tools))


def answer_text(calls: Column) -> Column:
    """A list of one call is that call; more stay a list."""
    return F.when(F.size(calls) == 1, calls[0]).otherwise(F.concat(F.lit("["), F.array_join(calls, ", "), F.lit("]")))


_BUILT = """SELECT user_id, CASE WHEN user_id % 4 = 0 THEN '{plain}' ELSE '{offer}[{{"name": "' || string_agg(DISTINCT event_type, '"}}, {{"name": "' ORDER BY event_type) || '"}}]' END AS system,
  'user ' || user_id AS query, CASE WHEN count(*) = 1 THEN min(c) ELSE '[' || string_agg(c, ', ' ORDER BY event_id) || ']' END AS answer
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, '{{"name": "' || event_type || '", "arguments": ' || props || '}}' AS c FROM events) WHERE k <= 1 + user_id % 3 GROUP BY user_id""".format(plain=PLAIN, offer=OFFER)


@query("build_conversations", f"SELECT user_id, md5(system || '|' || query || '|' || answer) AS digest, length(answer) AS n FROM ({_BUILT})")
def build_conversations(spark, d):
    """Three messages from columns: a system prompt with tools, a question, and the calls that answer it; a list of one call collapses to the call."""
    e = study.first_events(spark, d, 3).where("k <= 1 + user_id % 3").withColumn("c", call_text())
    rows = e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("calls"), F.array_sort(F.collect_set("event_type")).alias("names"))
    tools = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit('[{"name": "'), F.array_join("names", '"}, {"name": "'), F.lit('"}]')))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    question = F.concat(F.lit("user "), F.col("user_id").cast("string"))
    built = rows.select("user_id", F.array(message("system", system_prompt(tools)), message("user", question), message("assistant", answer_text(F.col("calls")))).alias("messages"))
    return built.select("user_id", F.md5(F.array_join("messages.content", "|")).alias("digest"), F.length(F.col("messages")[2]["content"]).cast("long").alias("n"))


_CORRUPT = "SELECT conv_id, turn, role, CASE WHEN conv_id % 6 = 1 AND turn = 1 THEN text || ' [0, 1] * 12' WHEN conv_id % 6 = 2 THEN text || ' [\"a\"] * 3' ELSE text END AS text FROM conversations"


@query(
    "corrupt_expr_filter",
    f"SELECT conv_id, CASE WHEN bool_or(role = 'assistant' AND regexp_matches(text, '{REPEATED_LIST}')) THEN 'expression' WHEN conv_id % 10 = 3 THEN 'listed' ELSE 'kept' END AS reason FROM ({_CORRUPT}) GROUP BY conv_id",
)
def corrupt_expr_filter(spark, d):
    """Conversations with an answer that holds an unevaluated list, then those whose ids are listed; all others stay."""
    turns = table(spark, d, "conversations").withColumn("text", F.expr("CASE WHEN conv_id % 6 = 1 AND turn = 1 THEN concat(text, ' [0, 1] * 12') WHEN conv_id % 6 = 2 THEN concat(text, ' [\"a\"] * 3') ELSE text END"))
    listed = turns.where("conv_id % 10 = 3").select("conv_id").distinct().withColumn("listed", F.lit(True))
    bad = turns.groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & F.col("text").rlike(REPEATED_LIST)).alias("bad"))
    return bad.join(listed, "conv_id", "left").select("conv_id", F.when(F.col("bad"), "expression").when(F.col("listed"), "listed").otherwise("kept").alias("reason"))


@query("filter_counts_by_type", "SELECT source AS kind, count(*) AS n_in, count(*) FILTER (n_chars < 400) AS filtered, count(*) FILTER (n_chars >= 400) AS kept FROM documents GROUP BY source")
def filter_counts_by_type(spark, d):
    return table(spark, d, "documents").groupBy(F.col("source").alias("kind")).agg(F.count("*").alias("n_in"), F.count_if(F.col("n_chars") < 400).alias("filtered"), F.count_if(F.col("n_chars") >= 400).alias("kept"))


def first_by_key(rows: DataFrame, ident: str, seed: str, n: Column | int) -> DataFrame:
    """The n rows that come first in the keyed order, with their place: a sample without replacement that any holder of the rows can draw again."""
    return study.numbered(rows.withColumn("_key", keyed_hash(seed, F.col(ident))), "_key").where(F.col("pos") < n).drop("_key")


def backfilled(first: DataFrame, second: DataFrame, ident: str, wanted: tuple[int, int], final: int, seed: str) -> DataFrame:
    """ident and origin of a sample of wanted[0] rows of first, and of as many of second as make up the final number, wanted[1] at least. Without rows in second there is no backfill."""
    a = first_by_key(first.select(ident), ident, seed, wanted[0])
    need = a.agg(F.greatest(F.lit(wanted[1]), F.lit(final) - F.count("*")).alias("need"))
    b = study.numbered(second.select(ident).withColumn("_key", keyed_hash(seed, F.col(ident))), "_key").join(F.broadcast(need), F.col("pos") < F.col("need"))  # a one-row side
    return a.select(ident, F.lit("first").alias("origin")).unionByName(b.select(ident, F.lit("second").alias("origin")))


_KEYED = "SELECT doc_id, row_number() OVER (ORDER BY sha256('{0}:' || doc_id)) - 1 AS pos FROM documents WHERE {1}"


@query(
    "sample_with_backfill",
    f"WITH a AS (SELECT doc_id FROM ({_KEYED.format('42', 'lang = $$es$$')}) WHERE pos < 40), b AS (SELECT doc_id FROM ({_KEYED.format('42', 'lang = $$en$$')}) WHERE pos < greatest(60, 120 - (SELECT count(*) FROM a))) SELECT doc_id, 'first' AS origin FROM a UNION ALL SELECT doc_id, 'second' FROM b".replace("$$", "'"),
)
def sample_with_backfill(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return backfilled(docs.where("lang = 'es'"), docs.where("lang = 'en'"), "doc_id", (40, 60), 120, "42")


@query("keyed_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY sha256('1:' || doc_id)) - 1 AS pos FROM documents")
def keyed_shuffle(spark, d):
    """A shuffle by a keyed hash, as places; no task sees more than a 4,096th of the rows."""
    docs = table(spark, d, "documents").select("doc_id").withColumn("key", keyed_hash("1", F.col("doc_id")))
    return study.numbered(docs, "key").select("doc_id", "pos")


@query(
    "stratified_spot_check",
    "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('3:' || doc_id)) - 1 AS pos FROM documents), t AS (SELECT 50 // count(DISTINCT source) AS per, count(DISTINCT source) AS types FROM documents), "
    "x AS (SELECT r.*, per, types, pos < per AS direct FROM r, t), l AS (SELECT *, row_number() OVER (PARTITION BY direct ORDER BY sha256('4:' || doc_id)) - 1 AS rest FROM x) SELECT doc_id, source FROM l WHERE direct OR rest < 50 - per * types",
)
def stratified_spot_check(spark, d):
    """Fifty rows: as many of each source, and what that leaves over from all rows not yet picked. Both orders are keyed."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    t = docs.agg(F.expr("50 div count(distinct source)").alias("per"), F.countDistinct("source").alias("types"))
    ranked = study.numbered_within(docs.withColumn("key", keyed_hash("3", F.col("doc_id"))), "source", "key").join(F.broadcast(t), F.lit(True))  # one row
    direct = ranked.where("pos < per").select("doc_id", "source")
    rest = study.numbered(ranked.where("pos >= per").drop("pos").withColumn("key", keyed_hash("4", F.col("doc_id"))), "key")
    return direct.unionByName(rest.where("pos < 50 - per * types").select("doc_id", "source"))


@query("train_test_split", "WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('9:' || doc_id)) - 1 AS pos, count(*) OVER () AS n FROM documents) SELECT doc_id, CASE WHEN pos < greatest(100, n // 20) THEN 'test' ELSE 'train' END AS side FROM r")
def train_test_split(spark, d):
    """A twentieth is held out, a hundred rows at least, by keyed place."""
    docs = table(spark, d, "documents").select("doc_id").withColumn("key", keyed_hash("9", F.col("doc_id")))
    return study.numbered(docs, "key").select("doc_id", F.when(F.col("pos") < F.expr("greatest(100, total div 20)"), "test").otherwise("train").alias("side"))


@query("first_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def first_rows(spark, d):
    """A top-k report: the longest documents."""
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


_RENDERED = "SELECT conv_id, string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '' ORDER BY turn) FILTER (t IS NULL OR turn < t) AS prompt, max(text) FILTER (turn = t) AS chosen FROM conversations JOIN (SELECT conv_id, min(turn) FILTER (role = 'assistant') AS t FROM conversations GROUP BY conv_id) USING (conv_id) GROUP BY conv_id"


@query("preference_loader", f"SELECT conv_id, md5(coalesce(prompt, '') || '<|assistant|>' || chr(10)) AS prompt, md5(chosen) AS chosen, md5(reverse(chosen)) AS rejected FROM ({_RENDERED}) WHERE chosen IS NOT NULL")
def preference_loader(spark, d):
    """The columns that a trainer keeps: the prompt's messages in a chat template that ends with the mark of an answer, the chosen answer and the rejected one."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("m"))
    at = F.array_position("m.role", "assistant").cast("int")
    shown = F.transform(F.slice("m", F.lit(1), F.greatest(at - 1, F.lit(0))), lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("\n")))
    rows = rows.where(F.array_contains("m.role", "assistant")).select("conv_id", F.concat(F.array_join(shown, ""), F.lit("<|assistant|>\n")).alias("prompt"), F.get(F.col("m.text"), at - 1).alias("chosen"))
    return rows.select("conv_id", F.md5("prompt").alias("prompt"), F.md5("chosen").alias("chosen"), F.md5(F.reverse("chosen")).alias("rejected"))


@query(
    "prompt_and_gold",
    "SELECT conv_id, md5(coalesce(string_agg(role || ':' || text, '|' ORDER BY turn) FILTER (role <> 'assistant'), '')) AS prompt, arg_min(text, turn) FILTER (role = 'assistant') AS gold FROM conversations GROUP BY conv_id HAVING bool_or(role = 'assistant')",
)
def prompt_and_gold(spark, d):
    """All messages but answers, and the first answer."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    other, own = (F.filter("m", lambda x: x["role"] != "assistant"), F.filter("m", lambda x: x["role"] == "assistant"))
    shown = F.array_join(F.transform(other, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "|")
    return turns.where(F.array_contains("m.role", "assistant")).select("conv_id", F.md5(shown).alias("prompt"), own[0]["text"].alias("gold"))


@query("tool_prompts", """SELECT event_id, '{"tools":[{"name":"' || event_type || '"},{"name":"lookup"}],"query":"user ' || user_id || '"}' AS prompt FROM events""")
def tool_prompts(spark, d):
    """Prompts with their tools as JSON."""
    tool = lambda n: F.struct(n.alias("name"))
    body = F.struct(F.array(tool(F.col("event_type")), tool(F.lit("lookup"))).alias("tools"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("query"))
    return table(spark, d, "events").select("event_id", F.to_json(body).alias("prompt"))


@query("tools_block", "SELECT doc_id, CASE WHEN strpos(p, 'Tools:') > 0 THEN substr(p, strpos(p, 'Tools:')) ELSE '' END AS block FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'You may call. Tools: [' || source || ']' ELSE lang END AS p FROM documents)")
def tools_block(spark, d):
    """A prompt from its marker on; empty without one."""
    p = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("You may call. Tools: ["), "source", F.lit("]"))).otherwise(F.col("lang"))
    at = F.instr(p, "Tools:")
    return table(spark, d, "documents").select("doc_id", F.when(at > 0, F.substr(p, at)).otherwise("").alias("block"))


_SHARE = "CASE WHEN n = 0 THEN chr(8212) ELSE format('{:.1f}%', 100.0 * ok / n) END"


@query("report_table", f"SELECT source, '| ' || source || ' | ' || ok || '/' || n || ' | ' || {_SHARE} || ' | ' || CASE WHEN delta > 0 THEN '+' ELSE '' END || delta || ' |' AS line FROM (SELECT source, count(*) AS n, count(*) FILTER (n_chars >= 400) AS ok, count(*) FILTER (n_chars >= 400) - count(*) FILTER (n_chars < 400) AS delta FROM documents GROUP BY source)")
def report_table(spark, d):
    """Lines of a report's table: a fraction, a percentage (a dash where there is nothing) and a signed difference."""
    rows = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") >= 400).alias("ok"))
    delta = 2 * F.col("ok") - F.col("n")
    share = F.when(F.col("n") == 0, "—").otherwise(F.format_string("%.1f%%", 100.0 * F.col("ok") / F.col("n")))
    signed = F.concat(F.when(delta > 0, "+").otherwise(""), delta.cast("string"))
    return rows.select("source", F.concat(F.lit("| "), "source", F.format_string(" | %d/%d | ", "ok", "n"), share, F.lit(" | "), signed, F.lit(" |")).alias("line"))


def report(lines: DataFrame, order: str, line: str, title: str) -> DataFrame:
    """A report in one row, for tables of few rows: title, then lines in order."""
    return lines.agg(F.concat(F.lit(f"# {title}\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n"), F.lit("\n")).alias("report"))


@query("markdown_report", "SELECT '# Roles' || chr(10) || chr(10) || string_agg('- ' || role || ': ' || n, chr(10) ORDER BY role) || chr(10) AS report FROM (SELECT role, count(*) AS n FROM conversations GROUP BY role)")
def markdown_report(spark, d):
    n = table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"))
    return report(n.select("role", F.concat(F.lit("- "), "role", F.lit(": "), F.col("n").cast("string")).alias("line")), "role", "line", "Roles")


@query("spot_check_lines", "SELECT conv_id, '## Conversation ' || conv_id || chr(10) || string_agg('**' || role || '**: ' || left(text, 40), chr(10) ORDER BY turn) AS block FROM conversations GROUP BY conv_id")
def spot_check_lines(spark, d):
    """A block for a reader for each conversation."""
    turns = table(spark, d, "conversations").withColumn("x", F.concat(F.lit("**"), "role", F.lit("**: "), F.left("text", F.lit(40))))
    rows = turns.groupBy("conv_id").agg(in_order("x").alias("m"))
    return rows.select("conv_id", F.concat(F.lit("## Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join("m", "\n")).alias("block"))


_CHOICES = """SELECT p_partkey, 'Which fits part ' || p_partkey || '?' || chr(10) || 'A. ' || p_name || chr(10) || 'B. ' || p_brand || chr(10) || 'C. ' || p_type || chr(10) || 'Answer: ' || ['A', 'B', 'C'][1 + p_partkey % 3] AS block FROM part"""


@query("choice_blocks", _CHOICES)
def choice_blocks(spark, d):
    """Questions with lettered choices and their answers."""
    p = table(spark, d, "part").select("p_partkey", F.array("p_name", "p_brand", "p_type").alias("choices"))
    letters = F.array(*map(F.lit, "ABC"))
    lines = F.array_join(F.zip_with(letters, "choices", lambda a, b: F.concat(a, F.lit(". "), b)), "\n")
    question = F.concat(F.lit("Which fits part "), F.col("p_partkey").cast("string"), F.lit("?\n"))
    return p.select("p_partkey", F.concat(question, lines, F.lit("\nAnswer: "), F.get(letters, (F.col("p_partkey") % 3).cast("int"))).alias("block"))


_POOL = "SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('5:' || p_partkey)) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size <= 10"


@query(
    "few_shot_selection",
    f"WITH p AS ({_POOL}) SELECT b.p_brand, s.i AS shot, p.p_partkey FROM (SELECT DISTINCT p_brand FROM part) b, (SELECT unnest(range(5)) AS i) s JOIN p ON p.p_brand = b.p_brand AND p.k = CASE WHEN p.n >= 5 THEN s.i ELSE s.i % p.n END",
)
def few_shot_selection(spark, d):
    """Five examples of each subject's pool in keyed order; a shorter pool is gone through again, a missing one gives none."""
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    ranked = study.numbered_within(part.where("p_size <= 10").withColumn("key", keyed_hash("5", F.col("p_partkey"))), "p_brand", "key").where("pos < 5")
    pools = ranked.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_partkey"))), lambda x: x["p_partkey"]).alias("pool"))  # five at most
    wanted = part.select("p_brand").distinct().join(pools, "p_brand").withColumn("shot", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return wanted.select("p_brand", F.col("shot").cast("long").alias("shot"), F.get("pool", F.col("shot") % F.size("pool")).alias("p_partkey"))


@query(
    "template_cross_product",
    "WITH x AS (SELECT p_brand || ' of ' || n_name AS text, p_brand, n_name FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN nation WHERE NOT (p_brand = 'Brand#1' AND n_regionkey = 0)), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('6:' || text)) AS k FROM x) SELECT text, p_brand FROM r WHERE k <= 7",
)
def template_cross_product(spark, d):
    """Texts made from two lists of parts (brands and nations: both bounded), those that aren't valid left out, each once, and as many of a template as are needed."""
    brands = table(spark, d, "part").select("p_brand").distinct()
    names = F.broadcast(table(spark, d, "nation").select("n_name", "n_regionkey"))  # 25 rows, at any size
    made = brands.join(names, ~((F.col("p_brand") == "Brand#1") & (F.col("n_regionkey") == 0))).select(F.concat("p_brand", F.lit(" of "), "n_name").alias("text"), "p_brand").distinct()
    return study.numbered_within(made.withColumn("key", keyed_hash("6", F.col("text"))), "p_brand", "key").where("pos < 7").select("text", "p_brand")


@query("capacity_shortfall", "SELECT p_brand, count(DISTINCT p_name) AS have, 60 - count(DISTINCT p_name) AS short FROM part GROUP BY p_brand HAVING count(DISTINCT p_name) < 60")
def capacity_shortfall(spark, d):
    """Templates that have fewer distinct texts than are needed: an assertion that holds where this is empty."""
    n = table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("have")).where("have < 60")
    return n.select("p_brand", "have", (60 - F.col("have")).alias("short"))


_FIXTURE = """CASE event_id % 5 WHEN 0 THEN left(c, length(c) - 1) WHEN 1 THEN replace(c, '"', '''') WHEN 2 THEN replace(c, ': ', ' ') WHEN 3 THEN c || '}' ELSE replace(c, ', ', ' ') END"""


@query("fixture_corruptions", f"SELECT event_id, ['missing_brace', 'single_quotes', 'missing_colon', 'extra_brace', 'missing_comma'][1 + event_id % 5] AS mode, {_FIXTURE} AS text FROM (SELECT event_id, '{{\"name\": \"' || event_type || '\", \"arguments\": ' || props || '}}' AS c FROM events)")
def fixture_corruptions(spark, d):
    """A call damaged in one of five ways, so that it doesn't parse."""
    e = table(spark, d, "events").select("event_id", call_text().alias("c"))
    c, mode = F.col("c"), (F.col("event_id") % 5).cast("int")
    made = F.when(mode == 0, F.expr("left(c, length(c) - 1)")).when(mode == 1, F.replace(c, F.lit('"'), F.lit("'"))).when(mode == 2, F.replace(c, F.lit(": "), F.lit(" "))).when(mode == 3, F.concat(c, F.lit("}"))).otherwise(F.replace(c, F.lit(", "), F.lit(" ")))
    names = F.array(*map(F.lit, ("missing_brace", "single_quotes", "missing_colon", "extra_brace", "missing_comma")))
    return e.select("event_id", F.get(names, mode).alias("mode"), made.alias("text"))


_FX = """SELECT event_id, event_type, user_id, CASE WHEN event_id % 9 = 0 THEN ['a', 'z'] ELSE ['a', 'b'] END AS args, CASE WHEN event_id % 13 = 0 THEN ['a', 'c'] ELSE ['a'] END AS required, ['a', 'b', 'c'] AS declared FROM events"""


@query(
    "fixture_schema_checks",
    f"SELECT event_id, CASE WHEN len(list_filter(required, lambda x: NOT list_contains(args, x))) > 0 THEN 'required_missing' WHEN len(list_filter(args, lambda x: NOT list_contains(declared, x))) > 0 THEN 'undeclared' ELSE 'not_in_enum' END AS fault FROM ({_FX}) "
    "WHERE len(list_filter(required, lambda x: NOT list_contains(args, x))) > 0 OR len(list_filter(args, lambda x: NOT list_contains(declared, x))) > 0 OR event_type NOT IN ('view', 'click', 'signup', 'purchase')",
)
def fixture_schema_checks(spark, d):
    """Rows whose arguments leave out a required one, add one that isn't declared, or have a value outside of its list: the first fault of each."""
    names = lambda *xs: F.array(*map(F.lit, xs))
    args, required = F.when(F.col("event_id") % 9 == 0, names("a", "z")).otherwise(names("a", "b")), F.when(F.col("event_id") % 13 == 0, names("a", "c")).otherwise(names("a"))
    fault = F.when(F.size(F.array_except(required, args)) > 0, "required_missing").when(F.size(F.array_except(args, names("a", "b", "c"))) > 0, "undeclared").when(~F.col("event_type").isin("view", "click", "signup", "purchase"), "not_in_enum")
    return table(spark, d, "events").select("event_id", fault.alias("fault")).where("fault is not null")


@query("regenerate_and_compare", "WITH a AS (SELECT md5(p_name || p_brand) AS row_digest FROM part), b AS (SELECT md5(p_name || CASE WHEN p_partkey % 50 = 7 THEN 'x' ELSE p_brand END) AS row_digest FROM part) SELECT row_digest, 'stored' AS side FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT row_digest, 'made_again' FROM (FROM b EXCEPT ALL FROM a)")
def regenerate_and_compare(spark, d):
    """Rows of a stored fixture and of one made again that the other doesn't have, repeats counted."""
    part = table(spark, d, "part")
    a = part.select(F.md5(F.concat("p_name", "p_brand")).alias("row_digest"))
    b = part.select(F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 50 == 7, "x").otherwise(F.col("p_brand")))).alias("row_digest"))
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("made_again")))
