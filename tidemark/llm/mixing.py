"""Mixing sources to target weights with a Pfair schedule."""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored


def whole_shares(weights: Mapping[str | None, float], period: int) -> dict[str | None, int]:
    """Weights as whole slots of a period, by largest remainder; every source gets one slot at least."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda x: (x is not None, x))
    exact = {x: weights[x] / total * period for x in names}
    out = {x: max(1, int(exact[x])) for x in names}
    by_rest = sorted(names, key=lambda x: -(exact[x] - int(exact[x])))
    while (gap := period - sum(out.values())) > 0:
        for x in by_rest[:gap]:
            out[x] += 1
    while (gap := sum(out.values()) - period) > 0:
        x = max(names, key=lambda x: out[x] - exact[x] if out[x] > 1 else -1.0)
        out[x] -= 1
    return out


def exact_shares(weights: Mapping[str | None, int | Fraction], most: int) -> dict[str | None, int] | None:
    """Weights that are whole numbers or fractions as slots of the period that holds each of them exactly; None if it is over ``most`` slots."""
    if not all(isinstance(w, (int, Fraction)) and w > 0 for w in weights.values()):
        return None
    base = math.lcm(*[Fraction(w).denominator for w in weights.values()])
    slots = {x: int(Fraction(w) * base) for x, w in sorted(weights.items(), key=lambda p: (p[0] is not None, p[0]))}
    least = math.gcd(*slots.values())
    return {x: n // least for x, n in slots.items()} if sum(slots.values()) // least <= most else None


def edf_period(shares: Mapping[str | None, int], period: int) -> list[tuple[str | None, int, int]]:
    """One period of the schedule: (source, block of the source in the period, slot).

    Block i of a source with share a is released at slot floor(i * period / a) and due by
    ceil((i + 1) * period / a). At each slot the released block with the earliest deadline
    runs. All windows of a period end with it, so longer schedules repeat this one.
    """
    waiting = [(i * period // a, -(-(i + 1) * period // a), n, x, i) for n, (x, a) in enumerate(shares.items()) for i in range(a)]
    waiting.sort(key=lambda w: w[0])
    ready: list = []
    out, at = [], 0
    for slot in range(period):
        while at < len(waiting) and waiting[at][0] <= slot:
            _, due, n, x, i = waiting[at]
            heapq.heappush(ready, (due, n, i, x))
            at += 1
        due, _, i, x = heapq.heappop(ready)
        if due <= slot:
            raise AssertionError("a block misses its deadline")
        out.append((x, i, slot))
    return out


def order_key(doc_id: str) -> Column:
    """Order of documents within a source: the MD5 of the id's text, then the id."""
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", weights: Mapping[str | None, float] | None = None, temperature: float = 0.5, period: int = 1000, most_slots: int = 65536, block_docs: int = 16) -> DataFrame:
    """Interleave the sources' documents so that every prefix follows the target weights.

    Rows (doc_id, source, block, pos_in_block, release, deadline, slot), one per input row; read in the
    order (slot, pos_in_block). Documents of a source follow the order of ``order_key``; every
    ``block_docs`` of them make a block. Without ``weights`` the target is (documents of the
    source) ** temperature; sources that weights don't name share the smallest weight given.
    Weights that are ints or Fractions are kept exactly, by a period that is their reduced sum, if that is at most
    ``most_slots``. Others become whole slots of a period (``period``, or twice the sources if there are more), one
    at least, and these shares are then the target. The driver works out the EDF schedule of one period, a table of its slots. As long as
    all sources last, each source's blocks among the first t slots differ from t * target by
    less than one, at every t. A source that ends leaves its later slots empty, and nothing is dropped.

    A null source is a source. Null ids are documents, repeated rows too. Texts aren't read.
    No rows give no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, source=source).withColumn("_k", order_key("doc_id"))
    # Ranks within a source: 4096 buckets by the key's first digits are ranked apart and shifted by the rows before them.
    rows = rows.withColumn("_bucket", F.conv(F.substring("_k", 1, 3), 16, 10).cast("int"))
    # Equal ids are told apart by the partition that holds them, so that a hot id doesn't meet in one task.
    rows = stored(rows.withColumn("_part", F.spark_partition_id()), "mix-rows")
    by = ["source", "_bucket", "_k", "_part"]
    small = rows.groupBy("source", "_bucket").agg(F.count("*").alias("_n"))
    small = small.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    small = stored(small, "mix-counts")
    groups = rows.groupBy(*by).agg(F.count("*").alias("_c"))
    groups = groups.withColumn("_within", F.coalesce(F.sum("_c").over(Window.partitionBy("source", "_bucket").orderBy("_k", "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    same = lambda a, b, names: [a[x].eqNullSafe(b[x]) for x in names]
    groups = groups.join(small.drop("_n").toDF("_s", "_b", "_before"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b"))).select(*by, (F.col("_within") + F.col("_before")).alias("_start"))
    own = Window.partitionBy(*by).orderBy("doc_id")
    ranked = rows.withColumn("_i", F.row_number().over(own) - 1)
    g = groups.toDF(*[f"_g{x}" for x in by], "_start")
    rank = ranked.join(g, ranked["source"].eqNullSafe(g["_gsource"]) & (ranked["_bucket"] == g["_g_bucket"]) & (ranked["_k"] == g["_g_k"]) & (ranked["_part"] == g["_g_part"]))
    rank = rank.select("doc_id", "source", (F.col("_start") + F.col("_i")).alias("_rank"))
    counts = {r["source"]: r["n"] for r in small.groupBy("source").agg(F.sum("_n").alias("n")).collect()}
    if not counts:
        return rank.select("doc_id", "source", *[F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("pos_in_block", "int"), ("release", "long"), ("deadline", "long"), ("slot", "long"))])
    target = {x: n**temperature for x, n in counts.items()} if weights is None else {x: weights.get(x, min(weights.values())) for x in counts}
    shares = exact_shares(target, most_slots)
    if shares is None:
        period = max(period, 2 * len(counts))
        shares = whole_shares(target, period)
    period = sum(shares.values())
    plan = spark.createDataFrame([(x, shares[x], i, slot) for x, i, slot in edf_period(shares, period)], "_src string, _a int, _i int, _slot int")
    block = F.expr(f"_rank div {block_docs}")
    rank = rank.withColumn("block", block).withColumn("pos_in_block", F.expr(f"cast(_rank % {block_docs} as int)"))
    share = F.create_map(*[v for x, a in shares.items() for v in (F.lit(_name(x)), F.lit(a))])
    rank = rank.withColumn("_share", F.element_at(share, F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("null"))).cast("long"))
    rank = rank.withColumn("_turn", F.expr("block div _share")).withColumn("_at", F.expr("cast(block % _share as int)"))
    out = rank.join(F.broadcast(plan), F.col("source").cast("string").eqNullSafe(F.col("_src")) & (F.col("_at") == F.col("_i")))
    return out.select(
        "doc_id", "source", "block", "pos_in_block",
        F.expr(f"_turn * {period} + (_at * {period}) div _share").alias("release"),
        F.expr(f"_turn * {period} + ((_at + 1) * {period} + _share - 1) div _share").alias("deadline"),
        F.expr(f"_turn * {period} + _slot").alias("slot"),
    )


def _name(source: str | None) -> str:
    return "null" if source is None else f"s{source}"


def in_order(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", place: bool = False, **options) -> DataFrame:
    """The rows of ``docs``, all columns, in the order of the schedule: partition by partition, and within each.

    With ``place``, slot and pos_in_block follow: files that are written and read again keep no order, these do.
    Rows with equal ids and sources stand together at the place of the first of them.
    """
    plan = mix(docs, doc_id=doc_id, source=source, **options)
    plan = plan.groupBy("doc_id", "source").agg(F.min(F.struct("slot", "pos_in_block")).alias("_at")).toDF("_pid", "_psource", "_at")
    names = docs.columns
    kept = [i for i, c in enumerate(names) if not place or c not in ("slot", "pos_in_block")]
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    placed = rows.join(plan, rows[f"_c{names.index(doc_id)}"].eqNullSafe(plan["_pid"]) & rows[f"_c{names.index(source)}"].eqNullSafe(plan["_psource"]))
    order = [F.col("_at.slot"), F.col("_at.pos_in_block"), F.col("_pid")]
    at = ["slot", "pos_in_block"] if place else []
    return placed.orderBy(*order).select(*[f"_c{i}" for i in kept], *[f"_at.{c}" for c in at]).toDF(*[names[i] for i in kept], *at)
