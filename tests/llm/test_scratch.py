"""What operators leave on disk: shuffle files, tables between steps, and what one turn of keys is dealt."""

import glob
import hashlib
import os
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow as pa

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F

from tidemark.llm import bagminhash, linedup
from tidemark.llm.common import shared_dir, stored, stored_by


def shuffle_files(spark):
    return {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d}/*/shuffle_*")}


def tables(spark):
    return set(os.listdir(shared_dir(spark).removeprefix("file://")))


def test_shuffle_files_go_with_their_job(spark):
    before = shuffle_files(spark)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    frame = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    out = stored(frame, "scratch")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(name) == was and {r.k: r["count"] for r in out.collect()} == {r.k: r["count"] for r in frame.collect()}


def test_tables_between_steps_go(spark):
    docs = spark.createDataFrame([(i, f"the same first line of all\nanother line, number {i // 2}, of which two are equal\n{'word ' * (i % 3)}") for i in range(20)], "doc_id long, text string")
    before = tables(spark)
    assert linedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] >= 29
    assert {x.rsplit("-", 1)[0] for x in tables(spark) - before if x.startswith(("line-", "cc-"))} == {"line-gone"}
    assert bagminhash.near_duplicates(docs).count() == 20
    assert {x.rsplit("-", 1)[0] for x in tables(spark) - before if x.startswith(("bag-", "bucket-", "cc-"))} == {"bag-classes"}


def test_tables_in_buckets_join_where_they_lie(spark):
    rows = spark.range(100).withColumn("x", F.col("id") * 3)
    a, b = stored_by(rows, "id", "scratch"), stored_by(rows.where("id % 2 = 0").groupBy("id").agg(F.max("x").alias("y")), "id", "scratch")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        both = a.join(b, "id", "left")
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.x, r.y) for r in both.collect()} == {(i, 3 * i, None if i % 2 else 3 * i) for i in range(100)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("scratch")]


def test_turns_share_out_all_keys():
    texts = [f"this is line number {i * 7919 % 10007} of some that are not alike {i * 31 % 1009}" for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(["\n".join(texts)])], names=["_x"])
    signed = list(linedup._signed(iter([batch]), 9, np.zeros(linedup._COUNTERS, dtype=bool)))
    dealt = [[r for b in linedup._deal(iter(signed), 4, t) for r in b.to_pylist()] for t in range(linedup.TURNS)]
    found = []
    for rows in dealt:
        for r in rows:
            key = np.cumsum(linedup._widen(r["keys"], np.uint32), dtype=np.uint64)
            assert ((key * np.uint64(4)) >> np.uint64(32) == r["bucket"]).all()
            found += list(zip(key.tolist(), np.frombuffer(r["ids"], dtype=np.int64).tolist(), strict=True))
    ids, lines = linedup._distinct_lines([x.encode() for x in texts], 9)
    keys = linedup.line_minima(lines)[1].astype(np.uint64) + np.arange(1, linedup.KEYS + 1, dtype=np.uint64) * linedup._C
    assert sorted(found) == sorted(zip((linedup.mix(keys) >> np.uint64(32)).ravel().tolist(), np.repeat(ids.view(np.int64), linedup.KEYS).tolist(), strict=True))
    sizes = [sum(len(r["ids"]) + len(r["sketches"]) for r in rows) for rows in dealt]
    assert max(sizes) * linedup.TURNS <= 1.1 * sum(sizes)


def test_lines_compared_move_once(spark, monkeypatch):
    lines = [f"{hashlib.sha256(str(i // 2).encode()).hexdigest()}{'!' * (i % 2)}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    plans, plain = [], linedup.stored

    def watched(df, name="t"):
        if name == "line-links":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name)

    monkeypatch.setattr(linedup, "stored", watched)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        removed = linedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # pairs go to their first line's text, then with it to the second's; the table of texts stays where it is
    assert [p.count("Exchange hashpartitioning") for p in plans[:2]] == [2, 2]
    assert removed == 100


def test_last_join_finds_lines_and_kinds_only(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{hashlib.sha256(str(i // 2).encode()).hexdigest()}{'!' * (i % 2)}") for i in range(20)], "doc_id long, text string")
    before, there, plain = tables(spark), set(), linedup.stored

    def watched(df, name="t"):
        if name == "line-repeats":
            there.update(x.replace("_", "-").rsplit("-", 1)[0] for x in tables(spark) - before if x.startswith("line"))
        return plain(df, name)

    monkeypatch.setattr(linedup, "stored", watched)
    assert linedup.dedup_lines(docs).agg(F.sum("n_removed")).first()[0] == 10
    assert {x for x in there if not x.startswith("line-links")} == {"line-prints", "line-kinds"}
