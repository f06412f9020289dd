"""Contiguous shards of near-equal byte size, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.llm.prefix import with_prefix_sums
from quarrystone.llm.store import known_id, stored

SHARDS = 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text plus 1; a null text has none) and text_crc32 (of the text's UTF-8 bytes; a null text counts as empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
    )


def placed(narrow: DataFrame, n_shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """Rows of (doc_id, size, text_crc32) with `shard` and `slot`.

    In the order of doc_id (nulls last; then size and checksum), a row whose bytes' midpoint lies in
    the i-th of n equal parts of all bytes goes to shard i, so shards are contiguous and differ from
    the target by less than one document. slot numbers the rows of a shard in that order from 0.
    Repeated rows are placed one by one; an empty table gives no rows.
    """
    keyed = narrow.withColumn("_id", known_id())
    run = with_prefix_sums(keyed, ["_id", "size", "text_crc32"], {"_bytes": F.col("size"), "_rank": F.lit(1)}, name)
    total = narrow.agg(F.sum("size")).first()[0] or 1
    cut = f"cast(least({n_shards - 1}, ({n_shards} * (2 * _bytes + size)) div {2 * total}) as int)"
    cut_rows = stored(run.withColumn("shard", F.expr(cut)).drop("_bytes", "_id"), f"{name}-cut")
    counts = cut_rows.groupBy("shard").agg(F.min("_rank").alias("_first"))  # a row for each shard
    return cut_rows.join(F.broadcast(counts), "shard").withColumn("slot", F.col("_rank") - F.col("_first")).drop("_rank", "_first")


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law of bytes has no grown form)."""
    out = placed(stored(sizes(docs), "shard-sizes"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded_documents(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """The documents with their shard after all their columns (a column of that name is replaced).

    Shards are contiguous, so the first row of each is all that a document has to be compared with: no
    text moves. Rows that repeat in id, size and checksum go to one shard, the last that one of them falls to.
    """
    places = placed(stored(sizes(docs), "shard-sizes"), n_shards)
    key = lambda i, size, crc: F.struct(i.alias("i"), size.alias("s"), crc.alias("c"))
    firsts = places.groupBy("shard").agg(F.min(key(known_id(), F.col("size"), F.col("text_crc32"))).alias("k")).orderBy("shard").collect()  # a row for each shard
    text = F.coalesce(F.col("text"), F.lit(""))
    own = key(known_id(), (F.octet_length(text) + 1).cast("long"), F.crc32(text.cast("binary")).cast("long"))
    shard_ = F.lit(0)
    for r in firsts:
        shard_ = F.when(own >= key(*(F.lit(v).cast("long") for v in r["k"])), F.lit(r["shard"])).otherwise(shard_)
    columns = [c for c in docs.columns if c != "shard"]
    return docs.select(*columns, shard_.cast("int").alias("shard"))


def _crc_sql() -> str:
    """CRC-32 of the text's bytes in DuckDB: half-bytes, low one first, through the 16-entry table of the polynomial 0xEDB88320."""
    entries = []
    for c in range(16):
        for _ in range(4):
            c = (c >> 1) ^ 0xEDB88320 if c & 1 else c >> 1
        entries.append(f"{c}::BIGINT")
    return f"""CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(4294967295, list_reduce(
      list_transform(string_split(regexp_replace(hex(encode(text)), '(.)(.)', '\\2\\1', 'g'), ''), lambda v: strpos('0123456789ABCDEF', v) - 1),
      lambda a, b: xor(a >> 4, [{", ".join(entries)}][(xor(a, b) & 15) + 1]), 4294967295::BIGINT)) END"""


SQL = f"""
WITH s AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST({_crc_sql()} AS BIGINT) AS text_crc32 FROM documents
), p AS (
  SELECT *, sum(size) OVER q - size AS before, sum(size) OVER () AS total, row_number() OVER q - 1 AS rnk
  FROM s WINDOW q AS (ORDER BY doc_id, size, text_crc32 ROWS UNBOUNDED PRECEDING)
), c AS (
  SELECT *, CAST(least(15, (16 * (2 * before + size)) // (2 * total)) AS INTEGER) AS shard FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'bytes' AS law, shard,
       CAST(rnk - min(rnk) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c
"""
