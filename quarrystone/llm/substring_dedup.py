"""Removal of long repeated word runs by compaction of a De Bruijn graph of token k-mers.

Edges of the graph are the windows of SPAN consecutive words, nodes the SPAN - 1 words that two
successive windows share. Equal windows are one edge. A path of successive edges is cut where the window's
anchor changes (its least-hashed run of ANCHOR words), which only the window's own words decide, so
equal windows lie at the same place in pieces of the same anchor. Joins on the anchor then compact the
graph: pieces with one content are a nonbranching path and stay one row however often they occur; only where an
anchor has several contents (a branch) are the edges of the distinct pieces compared one by one,
read again at the coordinates of one occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm import words as W
from quarrystone.llm.hot import split_join
from quarrystone.llm.store import known_id, scratch, ship, stored

ship(__name__)

#: Words of a window.
SPAN = 50
#: Words of an anchor. Each window holds SPAN - ANCHOR + 1 candidates, and about one word in 20 starts a piece.
ANCHOR = 12


def anchors(h: np.ndarray, first: np.ndarray, span: int = SPAN, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pieces of all texts: the first window's first word, the number of windows, the anchor's hash."""
    grams = W.mixed(W.runs(h, anchor))
    width = span - anchor + 1
    starts = len(h) - span + 1
    if starts <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # Leftmost least gram of every width successive ones, by doubling.
    at, size = np.arange(len(grams), dtype=np.int64), 1
    while size < width:
        step = min(size, width - size)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        size += step
    at = at[:starts]
    q = np.arange(starts, dtype=np.int64)
    ends = np.repeat(first[1:], np.diff(first))[:starts]  # the end of the text that holds word q
    good = q + span <= ends
    q, at = q[good], at[good]
    if not len(q):
        return q, q, np.zeros(0, np.uint64)
    new = np.ones(len(q), bool)
    new[1:] = (at[1:] != at[:-1]) | (q[1:] != q[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(q)))
    return q[begin], count, grams[at[begin]]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0) with its words' number and checksum, and one for each piece (kind 1)."""
    for batch, texts in W.blocks(batches):
        read = W.Words(texts, W.separators("space"))
        q, n, anchor = anchors(read.hashes(), read.first)
        doc = np.searchsorted(read.first, q, "right") - 1
        piece = [hashlib.blake2b(read.bytes[a:b], digest_size=16).digest() for a, b in zip(read.start[q].tolist(), read.end[q + n + SPAN - 2].tolist(), strict=True)]
        whole = [hashlib.sha256(read.text(a, b)).hexdigest() for a, b in zip(read.first[:-1].tolist(), read.first[1:].tolist(), strict=True)]
        rows = batch.select(["doc_id", "fp"])
        k, m = len(whole), len(piece)
        none = lambda count, kind: pa.nulls(count, kind)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), rows.column("fp"), pa.array(np.diff(read.first)), pa.array(whole), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.int32()), none(k, pa.int32())],
            names=["doc_id", "fp", "n_words", "sha", "anchor", "piece", "q", "n"],
        )
        own = rows.take(pa.array(doc))
        yield pa.RecordBatch.from_arrays(
            [own.column("doc_id"), own.column("fp"), none(m, pa.int64()), none(m, pa.string()), pa.array(anchor.view(np.int64)), pa.array(piece, pa.binary()), pa.array((q - read.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
            names=["doc_id", "fp", "n_words", "sha", "anchor", "piece", "q", "n"],
        )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of pieces that are read again: piece, least (its smallest document), i (its number in the piece), window (its digest)."""
    for batch, texts in W.blocks(batches):
        read = W.Words(texts, W.separators("space"))
        out: dict[str, list] = {"piece": [], "least": [], "i": [], "window": []}
        for first, wanted in zip(read.first[:-1].tolist(), batch.column("wanted").to_pylist(), strict=True):
            for x in wanted:
                for i in range(x["n"]):
                    a = first + x["q"] + i
                    out["piece"].append(x["piece"])
                    out["least"].append(x["least"])
                    out["i"].append(i)
                    out["window"].append(hashlib.blake2b(read.bytes[read.start[a] : read.end[a + SPAN - 1]], digest_size=16).digest())
        yield pa.RecordBatch.from_arrays([pa.array(out["piece"], pa.binary()), pa.array(out["least"], pa.int64()), pa.array(out["i"], pa.int32()), pa.array(out["window"], pa.binary())], names=list(out))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of documents from which windows are removed."""
    for batch, texts in W.blocks(batches):
        read = W.Words(texts, W.separators("space"))
        edge = np.zeros(len(read.start) + 1, np.int64)
        for first, gone in zip(read.first[:-1].tolist(), batch.column("gone").to_pylist(), strict=True):
            for x in gone:
                if x["which"] is None:
                    edge[first + x["q"]] += 1
                    edge[first + x["q"] + x["n"] - 1 + SPAN] -= 1
                else:
                    for i in x["which"]:
                        edge[first + x["q"] + i] += 1
                        edge[first + x["q"] + i + SPAN] -= 1
        keep = np.cumsum(edge)[:-1] == 0
        texts_left = []
        for a, b in zip(read.first[:-1].tolist(), read.first[1:].tolist(), strict=True):
            runs = np.flatnonzero(np.diff(np.concatenate(([0], keep[a:b].astype(np.int8), [0]))))
            texts_left.append(b" ".join(read.text(a + s, a + e) for s, e in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True)))
        n = np.diff(read.first)
        kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[read.first])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - kept), pa.array([x.decode() for x in texts_left])], names=["doc_id", "n_words", "n_removed", "kept"])


def repeated(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents' texts by key (_id, fp, doc_id, text), their word counts and checksums, and for each document with windows that start in a smaller one too, those windows (_id, fp, gone: q, n, which; which is null for all n).

    A document without an id counts as larger than all others. Rows that repeat are judged alike. Windows are judged on the input.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("fp"))
    schema = "doc_id long, fp long, n_words long, sha string, anchor long, piece binary, q int, n int"
    texts = rows.withColumn("_id", known_id())
    with scratch(docs.sparkSession) as keep:
        with scratch(docs.sparkSession) as keep_near:
            found = stored(rows.mapInArrow(_pieces, schema), "substring-pieces")
            whole = found.where("sha is not null").select(known_id().alias("_id"), "fp", "doc_id", "n_words", "sha")
            whole = keep(keep_near(stored(whole, "substring-whole")))
            pieces = found.where("piece is not null").select(known_id().alias("_id"), "fp", "anchor", "piece", "q", "n")
            # Most anchors are of one document: what follows reads the pieces of the others only.
            shared = pieces.groupBy("anchor").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
            shared = stored(shared, "substring-anchors")
            near = split_join(pieces, shared.select("anchor"), "anchor", ["_id", "fp", "q"], counts=shared)
            pieces = keep_near(stored(near.select("_id", "fp", "anchor", "piece", "q", "n"), "substring-near"))

        distinct = pieces.groupBy("piece", "anchor").agg(F.min(F.struct("_id", "fp", "q", "n")).alias("at"), F.count("*").alias("times"))
        distinct = stored(distinct, "substring-distinct")
        contents = stored(distinct.groupBy("anchor").agg(F.count("*").alias("contents")), "substring-contents")
        distinct = stored(split_join(distinct, contents, "anchor", ["piece"], counts=contents.withColumnRenamed("contents", "n")), "substring-shared")

        straight = distinct.where("contents = 1").select("piece", F.col("at._id").alias("least"), F.lit(None).cast("array<bigint>").alias("firsts"))
        branches = distinct.where("contents > 1").select(F.col("at._id").alias("_id"), F.col("at.fp").alias("fp"), F.struct(F.col("at.q").alias("q"), F.col("at.n").alias("n"), "piece", F.col("at._id").alias("least")).alias("x"))
        wanted = branches.groupBy("_id", "fp").agg(F.collect_list("x").alias("wanted"))
        once = texts.select("_id", "fp", "text")
        with scratch(docs.sparkSession) as keep_firsts:
            windows = stored(once.join(wanted, ["_id", "fp"]).select("text", "wanted").mapInArrow(_windows, "piece binary, least long, i int, window binary"), "substring-windows")
            first = windows.groupBy("window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last").select("window", "first")
            first = stored(first, "substring-windows-shared")
            # A row that repeats has its windows read again, so entries are a set.
            inside = windows.select("piece", "i", "window").join(first, "window").groupBy("piece").agg(F.map_from_entries(F.collect_set(F.struct("i", "first"))).alias("m"))
            branched = distinct.where("contents > 1").select("piece", F.col("at._id").alias("least"), F.col("at.n").alias("n")).join(inside, "piece", "left")
            firsts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.col("least")))
            branched = branched.select("piece", "least", F.when(F.col("m").isNotNull(), firsts).alias("firsts"))
            known = keep_firsts(stored(straight.unionByName(branched), "substring-firsts"))

        gone = split_join(pieces.drop("anchor"), known, "piece", ["_id", "fp", "q"], counts=distinct.select("piece", F.col("times").alias("n")))
        which = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("firsts", i) < F.col("_id"))
        gone = gone.withColumn("which", F.when(F.col("least") >= F.col("_id"), F.when(F.col("firsts").isNotNull(), which).otherwise(F.array().cast("array<int>"))))
        gone = gone.where("which is null or size(which) > 0").groupBy("_id", "fp").agg(F.collect_list(F.struct("q", "n", "which")).alias("gone"))
        return texts, whole, keep(stored(gone, "substring-gone"))


def cut_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) for each document that loses words."""
    texts, _, gone = repeated(docs)
    return texts.join(gone, ["_id", "fp"]).select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")


def removed(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_words, n_removed, kept_sha256. Null and empty texts have no words; texts under SPAN words lose none."""
    texts, whole, gone = repeated(docs)
    cut = texts.join(gone, ["_id", "fp"]).select("doc_id", "text", "gone").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")
    cut = cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    rest = whole.join(gone, ["_id", "fp"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"))
    return rest.unionByName(cut)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, p, md5(array_to_string(w[p + 1:p + 50], ' ')) AS g FROM d, LATERAL (SELECT unnest(range(len(w) - 49)) AS p) WHERE len(w) >= 50
), f AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) < doc_id AS gone FROM g
), r AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM f WHERE gone
), x AS (
  SELECT d.doc_id, len(w) AS n, q, w[q + 1] AS word FROM d, LATERAL (SELECT unnest(range(len(w))) AS q)
), k AS (
  SELECT x.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.q) AS kept FROM x ANTI JOIN r ON x.doc_id = r.doc_id AND x.q = r.q GROUP BY x.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
