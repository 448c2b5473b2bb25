"""Shards by extendible hashing: only buckets over the byte limit split on one more hash bit."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: Bits of hash that a directory can use.
BITS = 32
#: Bytes of text a shard holds at most.
LIMIT = 1 << 20


def hash_bits(doc_id: str) -> Column:
    """The first 32 bits of the MD5 of the id's text (null: the empty text), as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")


def _directory(sizes: DataFrame, bits: int, limit: int) -> DataFrame:
    """For each ``bits``-bit prefix of sizes(_h, _b): the depth of its bucket, or null where even ``bits`` bits leave it too large.

    A bucket at depth d is a sum over a d-bit prefix; the depth is the least whose bucket fits.
    """
    p = F.call_function("shiftright", F.col("_h"), F.lit(BITS - bits))
    fine = sizes.groupBy(p.alias("_p")).agg(F.sum("_b").alias("_b"))
    ways = fine.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(bits)))).withColumn("_q", F.call_function("shiftright", F.col("_p"), F.lit(bits) - F.col("_d")))
    fits = ways.groupBy("_d", "_q").agg(F.sum("_b").alias("_t")).where(F.col("_t") <= limit)
    return ways.join(fits, ["_d", "_q"], "left").groupBy("_p").agg(F.min(F.when(F.col("_t").isNotNull(), F.struct("_d", "_t"))).alias("_leaf"))


def shards(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", limit_bytes: int = LIMIT, slack_bits: int = 6, row: str | None = None) -> DataFrame:
    """Deal documents to shards of at most ``limit_bytes`` UTF-8 bytes of text.

    Rows (doc_id, bytes, depth, shard, overflow, shard_bytes), one per input row. ``shard`` is
    the bucket's hash prefix as ``depth`` binary digits. The first directory has as many bits as
    equal buckets would need, and ``slack_bits`` more; only what is too large there is looked
    at again with 8 more bits, up to 32. What 32 bits can't part (equal ids) goes to overflow
    pages of the bucket: rows wholly inside one limit-sized stretch of its bytes share a page,
    a row across a border has its own. Only a single row over the limit makes a larger shard.

    Null text has 0 bytes, null ids hash as the empty text, repeated rows are rows of their own,
    other columns are left aside, no rows give no rows. ``row`` names a column that goes along, as _row.
    """
    more = [] if row is None else ["_row"]
    rows = pick(docs, doc_id=doc_id, _x=text, **({} if row is None else {"_row": row})).select(*more, "doc_id", F.coalesce(F.octet_length("_x"), F.lit(0)).cast("long").alias("bytes"), hash_bits("doc_id").alias("_h"))
    sizes = stored(rows, "shard-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    bits = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + slack_bits)
    left, done = sizes, []
    while True:
        plan = stored(_directory(left.select("_h", F.col("bytes").alias("_b")), bits, limit_bytes), "shard-directory")
        found = left.withColumn("_p", F.call_function("shiftright", F.col("_h"), F.lit(BITS - bits))).join(plan, "_p")
        done.append(found.where("_leaf is not null").select(*more, "doc_id", "bytes", "_h", F.col("_leaf._d").alias("depth"), F.lit(0).cast("long").alias("overflow"), F.col("_leaf._t").alias("shard_bytes")))
        over = plan.where("_leaf is null")
        if over.isEmpty():
            break
        left = found.where("_leaf is null").select(*more, "doc_id", "bytes", "_h")
        if bits == BITS:
            done.append(_overflow(left, limit_bytes, more))
            break
        bits = min(BITS, bits + 8)
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    digits = F.substring(F.lpad(F.bin("_h"), BITS, "0"), F.lit(1), F.col("depth"))
    return out.select(*more, "doc_id", "bytes", "depth", digits.alias("shard"), "overflow", "shard_bytes")


def _overflow(rows: DataFrame, limit: int, more: list[str]) -> DataFrame:
    """Pages for rows that share all 32 bits; offsets add up by input partition first, so no task holds a whole bucket."""
    rows = stored(rows.withColumn("_part", F.spark_partition_id()), "shard-overflow")
    before = Window.partitionBy("_h").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_h", "_part").agg(F.sum("bytes").alias("_t")).select("_h", "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_h", "_part").orderBy("doc_id", "bytes").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("_end", F.sum("bytes").over(inner)).join(base, ["_h", "_part"]).withColumn("_end", F.col("_end") + F.col("_base"))
    first = F.floor((F.col("_end") - F.col("bytes")) / F.lit(limit))
    last = F.floor(F.greatest(F.col("_end") - 1, F.col("_end") - F.col("bytes")) / F.lit(limit))
    paged = ends.withColumn("overflow", (2 * first + (first != last).cast("int")).cast("long"))
    page = paged.groupBy("_h", "overflow").agg(F.sum("bytes").alias("shard_bytes"))
    return paged.join(page, ["_h", "overflow"]).select(*more, "doc_id", "bytes", "_h", F.lit(BITS).alias("depth"), "overflow", "shard_bytes")


def write_shards(docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", **options) -> None:
    """Write each shard of ``docs``, or page of one, to a folder of its own below ``path``: ``_shard=`` digits, a hyphen, page.

    Every row is written once, with every column of ``docs`` (names must differ, as Parquet asks, and none be _shard or _row);
    repeated rows and null ids are rows like others, and no rows give no folders.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "shard-rows")
    plan = shards(numbered, doc_id=doc_id, text=text, row="_row", **options).select("_row", F.concat_ws("-", "shard", F.col("overflow").cast("string")).alias("_shard"))
    numbered.join(plan, "_row").drop("_row").repartition("_shard").write.partitionBy("_shard").parquet(path)


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
k AS (SELECT range::INT AS k FROM range({BITS + 1})),
s AS (SELECT k, h >> ({BITS} - k) AS p, sum(bytes)::BIGINT AS t FROM d, k GROUP BY ALL),
leaf AS (SELECT d.doc_id, d.bytes, d.h, min(s.k) AS depth, min_by(s.t, s.k) AS t FROM d JOIN s ON s.p = d.h >> ({BITS} - s.k) WHERE s.t <= {LIMIT} GROUP BY ALL)
SELECT doc_id, bytes, depth, substr(lpad(bin(h), {BITS}, '0'), 1, depth) AS shard, 0::BIGINT AS overflow, t AS shard_bytes FROM leaf
"""
