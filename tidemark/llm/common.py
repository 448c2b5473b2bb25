"""Helpers that the operators share: column picking, shared scratch tables, components."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAK = "[\\x20\\x09-\\x0D]+"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` columns by their exact names and positions.

    Works whatever else the table holds: names that differ in case only, names with
    dots or backticks, repeated names (the first one counts).
    """
    names = df.columns
    missing = [old for old in columns.values() if old not in names]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(names)}")
    plain = df.toDF(*[f"_in{i}" for i in range(len(names))])
    return plain.select(*[F.col(f"_in{names.index(old)}").alias(new) for new, old in columns.items()])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own, a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs in this block delete their shuffle files as they end, instead of when the driver's JVM next collects its garbage; what the session says about that holds again afterwards."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _ends_with_jvm(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    The files live as long as the driver's JVM: tables given back lazily still read them. Shuffle files of the job go as it ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _ends_with_jvm(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str = "t", *, deal: bool = True) -> DataFrame:
    """As ``stored``, in buckets of ``key``, as many as shuffles have partitions: joins of such tables on ``key`` move none of their rows.

    Without ``deal`` rows are written where they are, each task a file for each bucket that it has rows of: for rows that lie in buckets already, or are large and few.
    """
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}".replace("-", "_")
    path, parts = f"{shared_dir(spark)}/{table}", partitions(spark)
    with shuffles_freed(spark):
        (df.repartition(parts, key) if deal else df).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(parts, key).saveAsTable(table)
    _ends_with_jvm(spark, path)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # its files stay, and ``out`` knows them
    return out


def forget(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing reads any more."""
    spark = tables[0].sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = shared_dir(spark)
    for f in {x.rpartition("/")[0] for df in tables for x in df.inputFiles()}:
        at = jvm.org.apache.hadoop.fs.Path(f)
        if f.removeprefix("file:").lstrip("/").startswith(root.removeprefix("file:").lstrip("/")):
            at.getFileSystem(conf).delete(at, True)


def released(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's generator that gives memory that is free in its worker back to the system as it ends; idle workers would keep it beside what later stages take."""

    @functools.wraps(run)
    def wrapped(*args, **named) -> Iterator:
        try:
            yield from run(*args, **named)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim:
                trim(0)

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_fold(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text (null: the empty text), modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (id, root), root the smallest id reached.

    Alternates the large-star and small-star steps. Each step only regroups edges by an
    end point, so a component never sits in one row, and each step's table is written to
    the shared folder. Ids that no edge names aren't in the result, nor are the roots themselves.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")

    def mark(df: DataFrame) -> tuple:
        with shuffles_freed(df.sparkSession):
            r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(now)
    if not before[0]:
        return now.select(F.col("a").alias("id"), F.col("b").alias("root"))
    for _ in range(rounds):
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        large = both.join(least, both["a"] == least["k"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        low = low.withColumnRenamed("a", "k")
        small = large.join(low, large["a"] == low["k"])
        small = small.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        after = stored(small.where("a <> b").distinct(), "cc")
        found = mark(after)
        forget(now)
        now = after
        if found == before:
            break
        before = found
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("id"), F.col("b").alias("root"))


def bucket_links(members: DataFrame, linked: Callable[[DataFrame], DataFrame], pivots: int = 2, *, last_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components over the links found among members(key, id) of the same bucket: rows (id, root).

    ``linked`` takes distinct pairs (a, b) and gives back those that hold, as a stored table.
    Members of a bucket are first paired with ``pivots`` of its members, one after the other;
    what is then still in different components goes to ``last_links``, as rows (key, id, root) of
    buckets with several roots, which gives back, stored, links (a, b) that join all roots that
    links join. So a bucket whose members are all alike makes as many pairs as it has members,
    and yet no pair that could join two components stays unseen.
    """
    links, now = None, members.withColumn("root", F.col("id"))
    for turn in range(pivots + 1):
        if turn:
            roots = components(links).toDF("id", "_root")
            held = now = stored(members.join(roots, "id", "left").select("key", "id", F.coalesce("_root", "id").alias("root")), "bucket-now")
            apart = now.groupBy("key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("key")
            now = now.join(apart, "key")
        if turn == pivots:
            new = last_links(now)
        else:
            # The pivot: of the first component in the bucket (after the first turn), the member that this turn's hash puts first.
            chance = F.xxhash64(F.lit(turn), F.col("id"))
            pivot = now.groupBy("key").agg(F.min(F.struct(*([F.col("root")] if turn else []), chance.alias("h"), F.col("id").alias("p"), F.col("root").alias("r"))).alias("q")).select("key", "q.p", "q.r")
            pairs = now.join(pivot, "key").where("root <> r" if turn else "id <> p").select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b"))
            new = linked(pairs.distinct())
        if turn:
            forget(roots, held)
        links = new if links is None else links.unionByName(new)
    roots = components(links)
    forget(links)
    return roots


def text_id(text: str) -> Column:
    """60 bits of the text's MD5, as a long."""
    return F.conv(F.substring(F.md5(F.col(text).cast("binary")), 1, 15), 16, 10).cast("long")
