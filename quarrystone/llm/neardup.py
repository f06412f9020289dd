"""Near-duplicates by MinHash with tensored banding, links confirmed on full shingle sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import words as W
from quarrystone.llm.components import components
from quarrystone.llm.hot import split_join
from quarrystone.llm.store import known_id, scratch, ship, stored

ship(__name__)

SHINGLE = 5
#: Links have 100 * intersection >= LINK * union.
LINK = 75
#: Minhashes that are joined to one value of a collection.
ROWS = 3
#: Values in each of the two collections. A table for each pair of values, 14 * 14 tables from 84 minhashes:
#: sets of similarity 0.75 share a value of one collection with probability 1 - (1 - 0.75^3)^14 = 0.9995,
#: of both with 0.9991; plain banding with keys of six would need 1,176 minhashes for these tables.
BANDS = 14
#: Ids from here on stand for documents without one.
NAMELESS = 1 << 62


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct 5-word shingles of each text as 64-bit hashes; a text of fewer words has its whole sequence as one."""
    read = W.Words(texts, W.separators("space"), W.lowered())
    h = read.hashes()
    grams = W.mixed(W.runs(h, SHINGLE))
    for a, b in zip(read.first[:-1], read.first[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield W.mixed(W.runs(h[a:b], int(b - a)) + np.uint64(b - a))
        else:
            yield grams[:0]


def _family(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = 2 * BANDS * ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64)[:, None], (rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]


def minhashes(x: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The two collections, one after the other: each value joins ROWS minhashes."""
    flip, times = family
    least = np.full(len(flip), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 1024):
        np.minimum(least, ((x[None, at : at + 1024] ^ flip) * times).min(1), out=least)
    out = np.zeros(2 * BANDS, np.uint64)
    for r in range(ROWS):
        out = W.mixed(out * np.uint64(0x9E3779B97F4A7C15) + least[r::ROWS])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    family = _family()
    for batch, texts in W.blocks(batches):
        n, digest, values = [], [], []
        for x in shingle_sets(texts):
            n.append(len(x))
            digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            values.append(minhashes(x, family).view(np.int64) if len(x) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("fp"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(values, pa.list_(pa.int64()))],
            names=["doc_id", "fp", "n", "digest", "bands"],
        )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets link; rows with the same left document come one after the other and share its set."""
    last, left = None, None
    for batch, rights in W.blocks(batches, "right"):
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        keep = []
        lefts = batch.column("left")
        for i, y in enumerate(shingle_sets(rights)):
            text = lefts[i].as_py()
            if left is None or (a[i], text) != last:
                last, left = (a[i], text), next(shingle_sets([text.encode()]))
            both = len(np.intersect1d(left, y, assume_unique=True))
            if len(y) and 100 * both >= LINK * (len(left) + len(y) - both):
                keep.append(i)
        yield pa.RecordBatch.from_pydict({"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())})


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts' full sets link. texts: v, text. A document with many partners meets them in several tasks."""
    with scratch(texts.sparkSession) as keep:
        pairs = stored(pairs.select("a", "b"), "neardup-pairs")
        right = pairs.join(texts.select(F.col("v").alias("b"), F.col("text").alias("right")), "b")
        centres = pairs.groupBy("a").agg(F.count("*").alias("n"))
        both = split_join(right, texts.select(F.col("v").alias("a"), F.col("text").alias("left")), "a", ["b"], counts=centres)
        return keep(stored(both.select("a", "b", "left", "right").mapInArrow(_confirm, "a long, b long"), "neardup-links"))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in W.blocks(batches):
        v = np.asarray(batch.column("v"))
        for i, x in enumerate(shingle_sets(texts)):
            yield pa.RecordBatch.from_pydict({"v": np.full(len(x), v[i]), "n": np.full(len(x), len(x), np.int64), "token": x.view(np.int64)})


def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows (key, v, n) of buckets that hold more than one component, with label."""
    named = stored(rows.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v")), "neardup-named")
    many = stored(named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"), "neardup-mixed")
    return split_join(named, many.select("key"), "key", ["v"], counts=many)


def prefix_pairs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every pair of docs (v, text) across components that can link, exactly: sets that link share one of their rarest
    floor(n * (1 - LINK / 100)) + 1 shingles in any fixed order. Rare ones come first: a document that has too many
    shingles of its own to link with a group has no others among its rarest, and meets nobody.

    A pair across components has a member outside the bucket's largest component, so only those are paired with all.
    """
    rows = stored(docs.select("v", "text").mapInArrow(_shingle_rows, "v long, n long, token long"), "neardup-shingles")
    counts = stored(rows.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "neardup-shared-shingles")
    # Shingles of one document only can't be shared; they still take the first places of the order.
    ordered = split_join(rows, counts, "token", ["v"], counts=counts.withColumnRenamed("df", "n")).groupBy("v", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("shared"))
    places = F.expr(f"greatest(0, n - (n * {LINK} + 99) div 100 + 1 - (n - size(shared)))").cast("int")
    first = ordered.select("v", "n", (F.col("n") - F.size("shared")).alias("own"), F.posexplode(F.slice("shared", F.lit(1), places)).alias("i", "t"))
    first = first.select(F.col("t.token").alias("key"), "v", "n", (F.col("n") - F.col("own") - F.col("i")).alias("left"))
    members = stored(_mixed(first, labels), "neardup-members")
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("size"))
    largest = stored(sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("m"), F.sum("size").alias("n")).select("key", F.col("m.label").alias("largest"), "n"), "neardup-largest")
    x = split_join(members, largest.drop("n"), "key", ["v"], counts=largest).where("label <> largest").select("key", F.col("v").alias("a"), F.col("n").alias("na"), F.col("left").alias("ra"), F.col("label").alias("la"))
    y = members.select("key", F.col("v").alias("b"), F.col("n").alias("nb"), F.col("left").alias("rb"), F.col("label").alias("lb"))
    # If the key is the first that a pair shares, it shares no more than either has left from there on.
    most = "least(ra, rb)"
    near = split_join(y, x, "key", ["b"], counts=largest).where(f"la <> lb and 100 * {most} >= {LINK} * (na + nb - {most})")
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _buckets(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (key, v, n, h) of keys that several of distinct (v, n, bands) have, h being the member of the smallest v; and how often (k) each member b can link with such an a."""
    with scratch(distinct.sparkSession) as keep:
        single = distinct.select("v", "n", F.posexplode("bands").alias("i", "value")).withColumn("key", F.xxhash64("i", "value"))
        shared = stored(single.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "neardup-shared")
        live = split_join(single, shared.select("key"), "key", ["v"], counts=shared).groupBy("v", "n").agg(F.collect_list(F.struct("i", "value")).alias("s"))
        side = lambda a: F.filter("s", lambda x: (x["i"] < BANDS) == F.lit(a))
        pairs = F.flatten(F.transform(side(True), lambda a: F.transform(side(False), lambda b: F.xxhash64(a["i"], b["i"], a["value"], b["value"]))))
        keys = stored(live.select("v", "n", F.explode(pairs).alias("key")), "neardup-keys")
        heads = stored(keys.groupBy("key").agg(F.min(F.struct("v", "n")).alias("h"), F.max("v").alias("hi"), F.count("*").alias("n")).where("h.v < hi").select("key", "h", "n"), "neardup-heads")
        keys = stored(split_join(keys, heads.select("key", "h"), "key", ["v"], counts=heads), "neardup-buckets")
        stars = keys.where(f"v <> h.v and 100 * least(n, h.n) >= {LINK} * greatest(n, h.n)")
        stars = stored(stars.groupBy(F.col("h.v").alias("a"), F.col("v").alias("b")).agg(F.count("*").alias("k")), "neardup-stars")
        return keep(keys), keep(stars)


def linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents' sets (doc_id, fp, n, digest) and, for each distinct set, its component: digest, component, id (the smallest id in it, null if none has one).

    Equal sets are one vertex, named by the smallest id. A value of a collection that no other set has can't be
    part of a shared key, so only shared values are combined into keys. In each bucket every member is
    paired with the member of the smallest id; a member's most frequent such partner is confirmed
    first, then those of other components. Buckets that still hold several components are left to an exact
    prefix join of their documents. So a group of copies costs as many pairs as members, and no link
    between components is left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("fp"), F.col("text").cast("string").alias("text"))
    sets = stored(rows.mapInArrow(_sketch, "doc_id long, fp long, n long, digest binary, bands array<long>"), "neardup-sets")
    own = F.coalesce("doc_id", F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("digest"), 2))
    distinct = sets.where("n > 0").groupBy("digest").agg(F.min(F.struct(own.alias("v"), "fp", "doc_id")).alias("r"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    distinct = distinct.select("digest", "r.v", "r.fp", "r.doc_id", "n", "bands")
    repeated = not sets.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        # An id of several sets names the first; the others are vertices of their own.
        first = distinct.groupBy("v").agg(F.min("digest").alias("first"))
        other = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64("digest"), 2)
        distinct = distinct.join(first, "v").withColumn("v", F.when(F.col("digest") == F.col("first"), F.col("v")).otherwise(other)).drop("first")
    distinct = stored(distinct, "neardup-distinct")

    keys, stars = _buckets(distinct)
    wanted = keys.select("v").distinct().join(distinct.select("v", "fp", "doc_id"), "v")
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_fp"), F.col("text").cast("string").alias("text"))
    texts = wanted.join(text, wanted["doc_id"].eqNullSafe(text["_id"]) & (wanted["fp"] == text["_fp"])).select("v", "text")
    if repeated:
        texts = texts.dropDuplicates(["v"])
    texts = stored(texts, "neardup-texts")

    best = stars.groupBy("b").agg(F.max(F.struct("k", (-F.col("a")).alias("a"))).alias("m")).select((-F.col("m.a")).alias("a"), "b")
    links = confirmed(best, texts)
    labels = components(links, "neardup-1")
    stars = split_join(stars, labels.select(F.col("v").alias("a"), F.col("label").alias("la")), "a", ["b"], "left")
    stars = stars.join(labels.select(F.col("v").alias("b"), F.col("label").alias("lb")), "b", "left")
    rest = stars.where("coalesce(la, a) <> coalesce(lb, b)").select("a", "b").join(best, ["a", "b"], "left_anti")
    more = confirmed(rest, texts)
    if not more.isEmpty():
        links = links.union(more)
        labels = components(links, "neardup-2")
    tested = rest.union(best.select("a", "b"))
    with scratch(docs.sparkSession) as keep:
        open_ = stored(_mixed(keys.select("key", "v", "n"), labels).select("v").distinct(), "neardup-open")
        found = keep(confirmed(prefix_pairs(texts.join(open_, "v"), labels).join(tested, ["a", "b"], "left_anti"), texts))
    if not found.isEmpty():
        labels = components(links.union(found), "neardup-3")
    out = distinct.join(labels, "v", "left").select("digest", "doc_id", F.coalesce("label", "v").alias("component"))
    if not repeated:
        return sets, out.select("digest", "component", F.when(F.col("component") < NAMELESS, F.col("component")).alias("id"))
    out = stored(out, "neardup-components")
    return sets, out.join(out.groupBy("component").agg(F.min("doc_id").alias("id")), "component").select("digest", "component", "id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept. Of what was stored on the way, only what the result reads stays.

    Documents without words are linked with nothing and kept. A document without an id takes its
    component's smallest id (null if none has one) and is kept only where that is null. Repeated rows are one vertex and judged alike.
    """
    with scratch(docs.sparkSession) as keep:
        sets, found = linked(docs)
        out = split_join(sets.select("doc_id", "fp", "n", "digest"), found, "digest", ["doc_id", "fp"], "left")
        component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("id"))
        return keep(out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: one row of each component, and all rows without words.

    Rows are told apart by id and text: of a component the row of the smallest id stays (one without an id only where
    none has one), then of the smallest fingerprint, then any one of equal rows.
    """
    with scratch(docs.sparkSession) as keep:
        sets, found = linked(docs)
        rows = sets.where("n > 0").select(known_id().alias("_qs_id"), F.col("fp").alias("_qs_fp"), "digest")
        rows = stored(rows.groupBy("_qs_id", "_qs_fp").agg(F.first("digest").alias("digest"), F.count("*").alias("k")), "neardup-rows")
        first = split_join(rows, found, "digest", ["_qs_id", "_qs_fp"]).groupBy("component").agg(F.min(F.struct("_qs_id", "_qs_fp", "k")).alias("r"))
        first = keep(stored(first.select("r.*"), "neardup-first"))
        gone = keep(stored(rows.select("_qs_id", "_qs_fp").join(first, ["_qs_id", "_qs_fp"], "left_anti"), "neardup-gone"))
    # Numbered names keep extra columns clear of the operator's own.
    short = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.select(*(docs[c].alias(s) for c, s in zip(docs.columns, short, strict=True)), known_id(docs["doc_id"]).alias("_qs_id"), F.xxhash64(docs["text"]).alias("_qs_fp"))
    kept = own.join(gone, ["_qs_id", "_qs_fp"], "left_anti")
    many = first.where("k > 1").select("_qs_id", "_qs_fp")
    if not many.isEmpty():
        one = own.join(many, ["_qs_id", "_qs_fp"], "left_semi").dropDuplicates(["_qs_id", "_qs_fp"])
        kept = kept.join(many, ["_qs_id", "_qs_fp"], "left_anti").unionByName(one)
    return kept.select(*(F.col(s).alias(c) for c, s in zip(docs.columns, short, strict=True)))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 5], ' ') AS g FROM d, LATERAL (SELECT unnest(range(greatest(len(w) - 4, 1))) AS p) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)
), u AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, r) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT u.b, r.r FROM r JOIN u ON u.a = r.doc_id
), m AS (
  SELECT doc_id, min(r) AS component_id FROM r GROUP BY doc_id
)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.doc_id = m.component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
