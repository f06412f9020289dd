"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

Windows are taken as sequences of shingles. Shingles are counted over all documents; a window is found by its rarest one, the
necessary prefix of an exact containment. A scan emits the places of documents that hold such a shingle, with the words around
them; a join on the shingle, bounds on length and position, and a comparison of the words decide. However large the
benchmark, documents are read twice, and no item comes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import words as W
from quarrystone.llm.hot import split_join
from quarrystone.llm.store import known_id, ship, stored

ship(__name__)

#: Consecutive item words that make a window; an item of fewer words is one window.
WINDOW = 10
#: Words of a shingle; a window of fewer words is one shingle.
SHINGLE = 3
#: The least and the most bits (as powers of two) of the table that tells most absent shingles apart at once. A fuller table lets more pass to the join, which is exact.
LEAST_BITS, MOST_BITS = 20, 27


def shingles(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size words that start at each word; sizes don't meet."""
    return W.mixed(W.runs(h, size) + np.uint64(size))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of items: item, window (digest), text (words with one space between), n (words), grams (hashes of its shingles)."""
    for batch, texts in W.blocks(batches):
        read = W.Words(texts, W.separators("alnum"), W.lowered())
        h = read.hashes()
        three = shingles(h, SHINGLE)
        items = batch.column("item").to_pylist()
        out: dict[str, list] = {"item": [], "window": [], "text": [], "n": [], "grams": []}
        for item, a, b in zip(items, read.first[:-1].tolist(), read.first[1:].tolist(), strict=True):
            n = min(WINDOW, b - a)
            for at in range(a, b - n + 1) if n else ():
                text = read.text(at, at + n)
                out["item"].append(item)
                out["window"].append(hashlib.blake2b(text, digest_size=16).digest())
                out["text"].append(text.decode())
                out["n"].append(n)
                grams = three[at : at + n - SHINGLE + 1] if n >= SHINGLE else shingles(h[at : at + n], n)
                out["grams"].append(grams.view(np.int64))
        kinds = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))


class Sieve:
    """A table of bits, broadcast, that holds all of some hashes and few others."""

    def __init__(self, grams: DataFrame, sizes: list[int]):
        """grams: rows of gram, distinct. sizes: how many words the shingles have."""
        spark, n = grams.sparkSession, grams.count()
        self.sizes = sizes
        self.bits = min(MOST_BITS, max(LEAST_BITS, (256 * n).bit_length()))
        slot = F.col("gram").bitwiseAND(F.lit((1 << self.bits) - 1))
        cells = grams.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(gram & {63} as int))").alias("bit")).groupBy("cell").agg(F.bit_or("bit").alias("bit"))
        found = cells.toArrow()  # at most 2 ** (MOST_BITS - 6) rows
        table = np.zeros(1 << (self.bits - 6), np.uint64)
        table[np.asarray(found.column("cell"))] = np.asarray(found.column("bit")).view(np.uint64)
        self.table = spark.sparkContext.broadcast(table)

    def passing(self, g: np.ndarray) -> np.ndarray:
        """Where g may be one of the hashes, and surely where it is."""
        slot = g & np.uint64((1 << self.bits) - 1)
        return np.flatnonzero((self.table.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))


def _counter(sieve: Sieve) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        for _, texts in W.blocks(batches):
            h = W.Words(texts, W.separators("alnum"), W.lowered()).hashes()
            found = []
            for size in sieve.sizes:
                g = shingles(h, size)
                found.append(g[sieve.passing(g)])
            gram, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"gram": gram.view(np.int64), "n": n.astype(np.int64)})

    return run


def _finder(sieve: Sieve | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row for each document (n_words) and one for each place of it that may hold a window's rarest shingle: pos (words from the text's first), gram, before (words of context ahead of it), context."""

    def run(batches):
        names = ["doc_id", "fp", "n_words", "pos", "gram", "before", "context"]
        for batch, texts in W.blocks(batches):
            read = W.Words(texts, W.separators("alnum"), W.lowered())
            none = lambda count, kind: pa.nulls(count, kind)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fp"), pa.array(np.diff(read.first), pa.int64()), none(k, pa.int32()), none(k, pa.int64()), none(k, pa.int32()), none(k, pa.string())], names=names)
            if sieve is None:
                continue
            h = read.hashes()
            for size in sieve.sizes:
                g = shingles(h, size)
                at = sieve.passing(g)
                doc = np.searchsorted(read.first, at, "right") - 1
                inside = at + size <= read.first[doc + 1]  # a run of words of two texts is none
                at, doc = at[inside], doc[inside]
                low, high = np.maximum(at - (WINDOW - size), read.first[doc]), np.minimum(at + WINDOW, read.first[doc + 1])
                own = batch.select(["doc_id", "fp"]).take(pa.array(doc))
                m = len(at)
                context = [read.text(a, b).decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("fp"), none(m, pa.int64()), pa.array((at - read.first[doc]).astype(np.int32)), pa.array(g[at].view(np.int64)), pa.array((at - low).astype(np.int32)), pa.array(context, pa.string())],
                    names=names,
                )

    return run


def prefixes(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """gram, at, window, n, text: the rarest shingle of each window and where in the window it is. A window with a shingle that no document holds occurs nowhere, and has no row.

    windows: window, text, n, grams; distinct. texts: the text of all documents.
    """
    grams = stored(windows.select("window", F.posexplode("grams").alias("at", "gram")), "decontaminate-grams")
    sizes = sorted({min(SHINGLE, r[0]) for r in windows.select("n").distinct().collect()})  # at most WINDOW rows
    sieve = Sieve(grams.select("gram").distinct(), sizes)
    seen = texts.mapInArrow(_counter(sieve), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("times"))
    counted = split_join(grams, stored(seen, "decontaminate-counts"), "gram", ["window", "at"], "left")
    rarest = counted.groupBy("window").agg(F.min(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "at", "gram")).alias("r")).where("r.times > 0")
    return rarest.select("window", "r.at", "r.gram").join(windows.select("window", "text", "n"), "window")


def matched(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables. A row for each document: doc_id, fp, n_words. A row for each (_id, fp) with an occurrence of a window: spans
    (start and end in words of each, sorted) and items (ids, sorted as strings).

    docs: doc_id, fp (the text's hash), text. Null texts have no words; items without words have no windows; a null item_id
    reads "null"; repeated items and rows change nothing. Rows that agree in doc_id and text have the same occurrences.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    found = stored(items.mapInArrow(_windows, "item string, window binary, text string, n int, grams array<long>"), "decontaminate-items")
    windows = stored(found.groupBy("window").agg(F.first("text").alias("text"), F.first("n").alias("n"), F.first("grams").alias("grams")), "decontaminate-windows")
    prefix, sieve = None, None
    if not windows.isEmpty():
        prefix = stored(prefixes(windows, docs.select("text")), "decontaminate-prefixes")
        sizes = sorted({min(SHINGLE, r[0]) for r in prefix.select("n").distinct().collect()})  # at most WINDOW rows
        sieve = Sieve(prefix.select("gram").distinct(), sizes) if sizes else None
    schema = "doc_id long, fp long, n_words long, pos int, gram long, before int, context string"
    rows = stored(docs.select("doc_id", "fp", "text").mapInArrow(_finder(sieve), schema), "decontaminate-places")
    whole = rows.where("n_words is not null").select("doc_id", "fp", "n_words")
    if sieve is None:
        return whole, whole.sparkSession.createDataFrame([], "_id long, fp long, spans array<struct<s:int,e:int>>, items array<string>")
    places = rows.where("gram is not null").select(known_id().alias("_id"), "fp", "pos", "gram", "before", "context")
    near = split_join(places, prefix, "gram", ["fp", "pos"])
    # Position and length: the window must lie within the text that holds its shingle; then its words must be there.
    near = near.where("at <= before").withColumn("w", F.split("context", " "))
    near = near.where("before - at + n <= size(w) and array_join(slice(w, before - at + 1, n), ' ') = text")
    hits = stored(near.select("_id", "fp", (F.col("pos") - F.col("at")).alias("s"), (F.col("pos") - F.col("at") + F.col("n")).alias("e"), "window").distinct(), "decontaminate-hits")
    spans = hits.groupBy("_id", "fp").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    owners = found.select("window", "item").distinct()
    named = split_join(hits.select("_id", "fp", "window").distinct(), owners, "window", ["_id", "fp"])
    named = named.select("_id", "fp", "item").distinct().groupBy("_id", "fp").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return whole, stored(spans.join(named, ["_id", "fp"]), "decontaminate-spans")


def hit_words() -> Column:
    """Words of the union of the spans, which are sorted by their starts."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"), F.greatest(a["end"], x["e"]).alias("end"))
    return F.aggregate("spans", start, step, lambda a: a["n"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("fp"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document, repeated ones and those without an id too: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    An empty table gives no rows, an empty benchmark no hits; a text is read whole, however long.
    """
    whole, hits = matched(_keyed(docs), benchmark)
    rows = whole.withColumn("_id", known_id()).join(hits, ["_id", "fp"], "left")
    n_hit = F.coalesce(hit_words(), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no window of an item, with their columns. Hits are told by id and text, so a clean document that shares an id with another stays."""
    _, hits = matched(_keyed(docs), benchmark)
    gone = hits.select(F.col("_id").alias("_qs_id"), F.col("fp").alias("_qs_fp"))
    same = (known_id(docs["doc_id"]) == gone["_qs_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_qs_fp"])
    return docs.join(gone, same, "left_anti")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), i AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p + 1:p + least(len(w), 10)], ' ') AS g
  FROM b, LATERAL (SELECT unnest(range(greatest(len(w) - 10, 0) + 1)) AS p) WHERE len(w) > 0
), g AS (
  SELECT doc_id, p, z.n, array_to_string(w[p + 1:p + z.n], ' ') AS g
  FROM d, (SELECT DISTINCT n FROM i) z, LATERAL (SELECT unnest(range(len(w) - z.n + 1)) AS p) WHERE len(w) >= z.n
), h AS (
  SELECT g.doc_id, g.p, g.n, i.item_id FROM g JOIN i ON g.g = i.g AND g.n = i.n
), x AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY doc_id
), y AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""
