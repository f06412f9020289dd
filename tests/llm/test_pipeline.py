"""The pipeline and its stages against plain versions, and on odd and empty tables."""

import hashlib
import math
import re
from collections import Counter

import pytest
from test_operators import LOWER, SCHEMA, TEXTS, WORD, components, rows

import corpus_pipeline
from quarrystone.llm import decontamination, mixing, neardup, sharding, toxicity
from quarrystone.llm.store import table

ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def clean_of_items(texts, items):
    windows = set()
    for t in items:
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        windows |= {tuple(w[p : p + 10]) for p in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    for i, t in texts.items():
        w = ITEM_WORD.findall((t or "").translate(LOWER))
        if not any(tuple(w[p : p + n]) in windows for n in sizes for p in range(len(w) - n + 1)):
            yield i


def mixed(docs):
    """docs: id -> (text, source). How often each is taken."""
    size = {i: len(WORD.findall(t or "")) for i, (t, _) in docs.items()}
    by = Counter()
    for i, (_, s) in docs.items():
        by[s] += size[i]
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    stopped: set = set()
    while True:
        left = sum(by.values()) - sum(3 * by[s] for s in stopped)
        free = sum(weight[s] for s in by if s not in stopped)
        target = {s: 3 * by[s] if s in stopped else left * weight[s] / free for s in by}
        over = {s for s in by if s not in stopped and target[s] > 3 * by[s]}
        if not over:
            break
        stopped |= over
    queue = []
    for s in order:
        total = 0
        for i in sorted((i for i in docs if docs[i][1] == s), key=lambda i: (hashlib.md5(f"mix:{i}".encode()).hexdigest(), i)):
            total += size[i]
            queue += [((total + e * by[s]) / target[s], order.index(s), total + e * by[s], i) for e in range(3) if size[i] and target[s]]
    taken, times = 0, Counter()
    for _, _, _, i in sorted(queue):
        taken += size[i]
        if taken > sum(by.values()):
            break
        times[i] += 1
    return times


def test_the_pipeline_gives_what_plain_stages_give(spark, sf):
    docs = {r.doc_id: (r.text, r.source) for r in table(spark, sf, "documents").collect()}
    net = toxicity.trained(table(spark, sf, "documents"), table(spark, sf, "labels"))
    score = dict(zip(docs, toxicity.score(net, [(t or "").encode() for t, _ in docs.values()])))
    left = {i: x for i, x in docs.items() if score[i] < 0.5}
    group = components({i: t for i, (t, _) in left.items()})
    left = {i: x for i, x in left.items() if group[i][1] == i}
    kept = set(clean_of_items({i: t for i, (t, _) in left.items()}, [r.text for r in table(spark, sf, "benchmark").collect()]))
    left = {i: x for i, x in left.items() if i in kept}
    times = mixed(left)
    got = corpus_pipeline.run(spark, sf).collect()
    have = Counter(r.doc_id for r in got)
    # Entries with the same finish time may change places where the budget ends.
    assert sum((have - times).values()) + sum((times - have).values()) <= 2 and sum(have.values()) > 50
    total = sum(len((docs[r.doc_id][0] or "").encode()) + 1 for r in got)
    before = 0
    for r in sorted(got, key=lambda r: r.doc_id):
        size = len((docs[r.doc_id][0] or "").encode()) + 1
        assert abs(r.shard - min(15, 16 * (2 * before + size) // (2 * total))) <= 1  # repeats of a document share a shard
        before += size
    assert len({s for _, s in corpus_pipeline.STAGES}) == 5 and {"doc_id", "text", "lang", "source", "n_chars", "shard"} == set(got[0].asDict())


@pytest.fixture(scope="module")
def clashing(spark):
    """Repeated rows, rows without ids, an id of two texts, and columns that are named as the operators' own."""
    more = [(None, "no id here at all", None, None, None, None, None), (None, None, None, None, None, None, None), (None, "other text without an id", "en", None, 1, 0.1, 1), (0, TEXTS[0], "en", "s0", None, 0.5, 3), (12, "a text of its own", "en", "s0", None, 0.5, 3)]
    frame = spark.createDataFrame(rows(more), SCHEMA)
    for name in ("_qs_id", "_qs_fp", "_qs_size", "_id", "fp", "size", "c0", "key", "n", "spans", "label"):
        frame = frame.withColumn(name, frame["n_chars"])
    return frame


def test_stages_on_odd_and_empty_tables(spark, clashing):
    bench = spark.createDataFrame([(1, "one two three four"), (2, None), (None, "")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, None), (2, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    stages = {
        "toxicity": lambda d: toxicity.clean_documents(d, labels),
        "near": neardup.kept_documents,
        "decontamination": lambda d: decontamination.clean_documents(d, bench),
        "mixing": mixing.mixed_documents,
        "sharding": sharding.sharded_documents,
    }
    n = clashing.count()
    for name, stage in stages.items():
        out, none = stage(clashing), stage(clashing.limit(0))
        assert none.count() == 0 and sorted(none.columns) == sorted(out.columns), name
        assert set(clashing.columns) - {"shard"} <= set(out.columns), name
        got = Counter((r["doc_id"], r["text"]) for r in out.collect())
        if name == "near":
            assert got[(None, "no id here at all")] == got[(None, "other text without an id")] == got[(12, "a text of its own")] == got[(12, TEXTS[12])] == 1 and got[(0, TEXTS[0])] == 1 and (5, TEXTS[5]) not in got
        elif name == "decontamination":
            assert sum(got.values()) == n - 3 and (0, TEXTS[0]) not in got and (5, TEXTS[5]) not in got
        elif name == "mixing":
            assert {k for k in got if k[1] is None} == set() and max(got.values()) <= 6
        else:
            assert sum(got.values()) == n, name


def test_mixed_rows_that_agree_are_dealt_alike_in_every_run(spark):
    texts = [(7, f"{a} {a} {a}", "s") for a in "abcdef"] + [(i, "x y z", "t") for i in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string, source string")
    runs = [sorted((r.doc_id, r.text) for r in mixing.mixed_documents(frame.repartition(k)).collect()) for k in (1, 5)]
    assert runs[0] == runs[1] and not math.isclose(len(runs[0]), 0)
