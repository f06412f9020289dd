"""Queries of the registry against their SQL on the smallest tables, and functions on hard cases."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrystone.functions import text
from quarrystone.operators import failures, pool, sampling, similarity, stats, toolcalls
from quarrystone.plans import registry
from quarrystone.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.execute(registry.oracle_sql()[name])
    at = {c[0]: i for i, c in enumerate(want.description)}
    assert sorted(at) == cols
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=key) == sorted((tuple(norm(r[at[c]]) for c in cols) for r in want.fetchall()), key=key)


def test_short_texts_have_no_ngrams(spark):
    rows = spark.createDataFrame([("a b",), ("",), ("a b c d e f",)], "t string")
    got = rows.select(text.ngrams(text.plain_tokens(F.col("t")), 5).alias("g"), text.shingle_set(text.word_tokens(F.col("t"))).alias("s")).collect()
    assert [r.g for r in got] == [[], [], ["a b c d e", "b c d e f"]] and sorted(got[0].s) == ["a", "b"]


def test_greedy_keeps_both_ends_of_a_path(spark):
    from quarrystone.plans.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    docs = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    links = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a long, b long")
    assert sorted(r.doc_id for r in similarity.greedy_kept(docs, links).collect()) == [0, 2, 4]


@pytest.mark.parametrize(("n", "gathered"), [(450, 50_000), (12, 0)])
def test_greedy_settles_long_chains(spark, monkeypatch, n, gathered):
    from quarrystone.plans.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    monkeypatch.setattr(similarity, "GATHERED", gathered, raising=False)
    links = spark.createDataFrame([(i, i + 1) for i in range(n - 1)], "a long, b long")
    assert sorted(r.id for r in similarity.greedy_kept(spark.range(n), links, "id").collect()) == list(range(0, n, 2))


def test_greedy_dedup_agrees_with_a_first_kept_loop(spark, tmp_path):
    """Near copies, and exact copies whose head is a near copy of an earlier document."""
    base = [f"w{i}" for i in range(60)]
    varied = lambda k: " ".join("x" if i == k else w for i, w in enumerate(base))
    texts = [" ".join(base), varied(30), "other words stand here alone today", varied(30), varied(30), varied(10), " ".join(base), varied(10), "", None, varied(50)]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for i, t in enumerate(texts):
        w = (t or "").split()
        s = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else set(w)
        if not any(s and k and 10 * len(s & k) >= 7 * len(s | k) for _, k in kept):
            kept.append((i, s))
    got = registry.queries()["greedy_dedup"](spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in kept]


def shuffled(spark, run) -> int:
    """Bytes that run's stages write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total() -> int:
        sc.listenerBus().waitUntilEmpty(30_000)
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def varied_texts(n: int, words: int) -> dict[int, str | None]:
    """Texts with near and exact copies, of which every third holds a passage that is met everywhere."""
    import random

    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    texts: dict[int, str | None] = {}
    for i in range(n):
        if i % 4 and i > 4:
            base = (texts[i - i % 4] or "").split()
            texts[i] = " ".join(w if rng.random() > 0.05 * (i % 4 - 1) else "new" for w in base)
        else:
            texts[i] = " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(words)), *(common if i % 3 == 0 else [])])
    return texts | {n: None, n + 1: "", n + 2: "two words", n + 3: "Two, words!", n + 4: "words two two"}


def test_near_pairs_against_all_pairs(spark, monkeypatch):
    texts = varied_texts(90, 50)
    sets_ = {}
    for i, t in texts.items():
        w = (t or "").lower().replace(",", "").replace("!", "").split()
        if w:
            sets_[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {*w}
    head = {i: min(j for j in sets_ if sets_[j] == s) for i, s in sets_.items()}
    want = {("copy", h, i, len(sets_[i]), len(sets_[i]), len(sets_[i])) for i, h in head.items() if h != i}
    for a in {*head.values()}:
        for b in {*head.values()}:
            if a < b and 10 * len(sets_[a] & sets_[b]) >= 7 * len(sets_[a] | sets_[b]):
                want.add(("near", a, b, len(sets_[a] & sets_[b]), len(sets_[a]), len(sets_[b])))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in similarity.exact_pairs(docs).collect()} == want and len(want) > 30
    # All places of ids taken, one pair to a cell, and a table of bits in place of the sent ids.
    monkeypatch.setattr(similarity, "BITS", 64)
    monkeypatch.setattr(similarity, "CELL", 1)
    monkeypatch.setattr(similarity, "SENT", 0)
    assert {tuple(r) for r in similarity.exact_pairs(docs).collect()} == want


@pytest.mark.parametrize("name", ["near_dup_pairs_exact", "greedy_dedup", "greedy_dedup_source_counts"])
def test_set_joins_shuffle_less_than_their_input(spark, tmp_path, name):
    """Sets and texts of documents that meet no other aren't shuffled."""
    texts = varied_texts(200, 2000)
    texts = {i: t for i, t in texts.items() if i % 4 == 0 or i < 20}
    spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert shuffled(spark, lambda: registry.queries()[name](spark, str(tmp_path)).collect()) < sum(len(t or "") for t in texts.values())


def test_allocation_adds_up(spark):
    got = sampling.allocated(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "bucket string, n long"), 100).collect()
    assert sorted((r.bucket, r.alloc) for r in got) == [("a", 34), ("b", 33), ("c", 33)]


def test_mcnemar_values(spark):
    rows = spark.createDataFrame([(8, 3), (9, 3), (13, 3), (0, 0)], "b long, c long")
    got = [r.p for r in rows.select(stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    want = [min(1, 2 * sum(math.comb(b + c, k) for k in range(min(b, c) + 1)) / 2 ** (b + c)) for b, c in ((8, 3), (9, 3), (13, 3))] + [1.0]
    assert got == pytest.approx(want, abs=1e-12)


CALL = '{"name":"f","arguments":{"a":1}}'


@pytest.mark.parametrize(
    ("generation", "target", "want"),
    [
        (CALL, '[{"arguments":{"a":1},"name":"f"}]', "accepted"),
        ('{"name":"f","arguments":{"a":1.0}}', CALL, "wrong_args"),
        ('{"name":"f","arguments":{"a":"1"}}', CALL, "wrong_args"),
        ('{"name":"g","arguments":{}}', '{"name":"f","arguments":{}}', "wrong_tool"),
        ('{"name":"f"', CALL, "invalid_json"),
        ("no", CALL, "missing_call"),
        ('{"name":"f"}', "plain text", "spurious_call"),
        ("plain", "text", "accepted"),
        ('{"name":', "text", "invalid_json"),
        ("", "text", "invalid_json"),
        (f"<tool_call>{CALL}</tool_call>", CALL, "accepted"),
        (f"so: <tool_call>\\n{CALL}\\n</tool_call> done", CALL, "accepted"),
        ("<tool_call>{'name': 'f', 'arguments': {'a': 1}}</tool_call>", CALL, "accepted"),
        ("{'name': 'f', 'arguments': {'a': 1}}", CALL, "invalid_json"),
        (f"<tool_call>{CALL}</tool_call><tool_call>", CALL, "invalid_json"),
        (f"</tool_call><tool_call>{CALL}", CALL, "invalid_json"),
        ("<tool_call></tool_call>", CALL, "invalid_json"),
        ('<tool_call>{"name":"f","arguments":{1,2}}</tool_call>', CALL, "invalid_json"),
        ("<tool_call>{'name':'f','arguments':b'x'}</tool_call>", CALL, "invalid_json"),
        ('{"name":"f"}', '{"name":"f","arguments":null}', "accepted"),
        ('{"name":"f"}', '{"name":"f","arguments":{}}', "wrong_args"),
        ('{"name":"f","parameters":{"a":1}}', CALL, "accepted"),
        (f"[{CALL},7]", CALL, "invalid_json"),
        ('{"arguments":{"name":"x"}}', CALL, "invalid_json"),
        (f'[{CALL},{{"name":"g"}}]', f'[{{"name":"g"}},{CALL}]', "accepted"),
        (f'[{CALL},{CALL}]', f'[{CALL}]', "wrong_tool"),
        (CALL, "", "target_unreadable"),
        (None, None, "target_unreadable"),
        (CALL, '{"name":', "target_unreadable"),
        (CALL, "[]", "target_unreadable"),
        (CALL, '{"name":""}', "parser_disagreement"),
        (CALL, '<tool_call>{"name":""}</tool_call>', "target_unreadable"),
    ],
)
def test_verdicts(generation, target, want):
    assert toolcalls.judged(generation, target) == want


@pytest.mark.parametrize(
    ("generation", "chosen", "want"),
    [
        ("Sure: [1] " + CALL, CALL, "success"),
        ('{"name":"f","arguments":{"a":true}}', CALL, "success"),
        (CALL, "prose", "wrong_args"),
        ("[7]", CALL, "wrong_tool"),
        ("prose", CALL, "invalid_json"),
        ("null", CALL, "invalid_json"),
        ('{"name":"g"}', CALL, "wrong_tool"),
        (None, None, "invalid_json"),
    ],
)
def test_failures(generation, chosen, want):
    assert failures.failure(generation, chosen) == want


@pytest.mark.parametrize(("n", "multi", "single", "want"), [(10, 90, 10, (9, 1, None)), (10, 99, 1, (9, 1, None)), (3, 1, 1, (None, None, "stratum_short")), (2, 0, 5, (None, None, "stratum_short")), (1, 5, 5, (None, None, "too_few_prompts")), (5, 0, 0, (None, None, "no_prompts")), (4, 3, 3, (2, 2, None))])
def test_two_strata(spark, n, multi, single, want):
    row = spark.createDataFrame([(n, multi, single)], "n long, m long, s long")
    assert tuple(row.select(pool.two_strata(F.col("n"), F.col("m"), F.col("s")).alias("a")).first().a) == want


def test_set_join_meets_all_pairs(spark):
    """Against all pairs in Python, in one table and between two."""
    import random

    rng = random.Random(2)
    base = [rng.sample(range(60), 20) for _ in range(6)]
    sets = {i: sorted({*(x for x in base[i % 6] if rng.random() < 0.9), *rng.sample(range(60), rng.randrange(4))}) for i in range(60)}
    sets[60] = []
    frame = spark.createDataFrame(list(sets.items()), "id long, s array<long>")
    like = lambda a, b: a and b and 10 * len({*a} & {*b}) >= 7 * len({*a} | {*b})
    own = {(r.a, r.b): r.common for r in similarity.similar(frame, None, *similarity.at_least(7, 10)).collect()}
    assert own == {(a, b): len({*sets[a]} & {*sets[b]}) for a in sets for b in sets if a < b and like(sets[a], sets[b])} and len(own) > 50
    left = frame.where("id < 20")
    two = {(r.a, r.b) for r in similarity.similar(left, frame, *similarity.at_least(7, 10)).collect()}
    assert two == {(a, b) for a in range(20) for b in sets if like(sets[a], sets[b])}


def test_torn_tail_and_bound_runs(spark, tmp_path):
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1}x'), (3, ""), (4, "[1]"), (5, '{"a": '), (6, '{"a": "}"}')], "line_no long, line string")
    assert {(r.line_no, r.allowed) for r in tables.torn_tail(lines).collect()} == {(2, False), (4, False), (5, False)}
    assert {(r.line_no, r.allowed) for r in tables.torn_tail(lines.where("line_no < 6")).collect()} == {(2, False), (4, False), (5, True)}
    fields = spark.createDataFrame([("seed", "7"), ("pool", None)], "field string, value string")
    assert tables.bind_run(fields, f"{tmp_path}/run").count() == 0 and tables.bind_run(fields, f"{tmp_path}/run").count() == 0
    other = spark.createDataFrame([("seed", "8"), ("pool", None)], "field string, value string")
    assert [tuple(r) for r in tables.bind_run(other, f"{tmp_path}/run").collect()] == [("seed", "7", "8")]


def test_json_lines(spark, tmp_path):
    path = f"{tmp_path}/rows"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    tables.write_json_lines(rows, path)
    tables.append_json_lines(rows.where("id = 1"), path)
    assert tables.json_lines(spark, path, rows.schema).count() == 3
    (tmp_path / "rows" / "part-x.json").write_text('{"id": 3, "t": "c"}\n{"id": \n')
    assert sorted(r.id for r in tables.json_lines(spark, path, rows.schema, strict=False).collect()) == [1, 1, 2, 3]
    with pytest.raises(Exception):
        tables.json_lines(spark, path, rows.schema).collect()
    assert tables.readable(lambda: spark.read.parquet(f"{tmp_path}/none"), rows.schema).count() == 0
    blob = tables.pinned(spark, f"{tmp_path}/rows/part-x.json").first()
    content = (tmp_path / "rows" / "part-x.json").read_bytes()
    assert blob.sha256 == hashlib.sha256(content).hexdigest() and blob.blob == hashlib.sha1(b"blob %d\0" % len(content) + content).hexdigest()


def test_segment_chain(spark):
    rows = spark.createDataFrame([(0, "a", None), (1, "b", "a"), (3, "c", "b"), (4, "d", "x")], "idx long, sha string, prev_sha string")
    assert sorted(map(tuple, tables.segment_chain(rows).collect())) == [(3, 1), (4, 3)]
