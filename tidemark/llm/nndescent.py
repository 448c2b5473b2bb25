"""Near-duplicate embeddings by NN-descent."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, partitions, pick, stored

_LISTS = "id long, l array<struct<s:double,v:long>>"


def _rows(blobs: list[bytes]) -> np.ndarray:
    """Unit vectors from the bytes of doubles, all of one length."""
    x = np.frombuffer(b"".join(blobs), dtype=np.float64).reshape(len(blobs), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _codes(trees: int, seed: int):
    """Sign bits of each vector under ``trees`` lots of 32 random hyperplanes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            blobs = b.column("vec").to_pylist()
            out: list = [None] * len(blobs)
            for size in {len(x) for x in blobs}:
                at = [i for i, x in enumerate(blobs) if len(x) == size]
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size // 8, trees * 32))
                bits = (_rows([blobs[i] for i in at]) @ planes[size] > 0).reshape(len(at), trees, 32)
                code = (bits * (1 << np.arange(31, -1, -1, dtype=np.int64))).sum(axis=2)
                for i, c in zip(at, code.tolist(), strict=True):
                    out[i] = c
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), pa.array(out, pa.list_(pa.int64()))], names=["id", "grp", "codes"])

    return run


def _join_pools(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Compare the members of each pool; rows arrive pool by pool. Gives each member its best partners over its bar."""

    def compare(own: list[tuple]) -> list[tuple]:
        out = []
        by: dict[tuple, list[tuple]] = {}
        for r in own:
            by.setdefault((r[2], len(r[5])), []).append(r)
        for rows in by.values():
            if len(rows) < 2:
                continue
            ids = np.array([r[1] for r in rows])
            x = _rows([r[5] for r in rows])
            raw = x @ x.T
            # rounded, so that all pools agree on a pair; never up to the threshold
            s = np.where(raw < threshold, np.minimum(np.round(raw, 12), threshold - 1e-12), np.round(raw, 12))
            np.fill_diagonal(s, -2)
            for i, r in enumerate(rows):
                k = min(r[3], len(rows) - 1)
                best = np.argpartition(-s[i], k - 1)[:k]
                best = best[s[i][best] > r[4]]
                if len(best):
                    out.append((r[1], [{"s": a, "v": v} for a, v in zip(s[i][best].tolist(), ids[best].tolist(), strict=True)]))
        return out

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.struct([("s", pa.float64()), ("v", pa.int64())])))], names=["id", "l"])

    now, own, found = None, [], []
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("pool", "id", "grp", "k", "bar", "vec")), strict=True):
            if r[0] != now and own:
                found += compare(own)
                own = []
            now = r[0]
            own.append(r)
        if len(found) > 2000:
            yield batch_of(found)
            found = []
    yield batch_of(found + compare(own))


def _count_chunks(threshold: float):
    """Links between two chunks of a component: (id, links), weighted by how many rows the partner stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, links = [], []
            for left, right, same in zip(*(b.column(c).to_pylist() for c in ("left", "right", "same")), strict=True):
                x, y = _rows([r["vec"] for r in left]), _rows([r["vec"] for r in right])
                near = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(near, False)
                ids += [r["id"] for r in left]
                links += (near @ np.array([r["m"] for r in right], dtype=np.int64)).tolist()
                if not same:
                    ids += [r["id"] for r in right]
                    links += (near.T @ np.array([r["m"] for r in left], dtype=np.int64)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64())], names=["id", "n"])

    return run


def _ask_all(queries, threshold: float):
    """All links of the broadcast queries, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple, list] = {}
        for i, g, v in queries.value:
            by.setdefault((g, len(v)), []).append((i, v))
        ready = {k: (np.array([i for i, _ in v]), _rows([x for _, x in v])) for k, v in by.items()}
        for b in batches:
            rows: dict[tuple, list] = {}
            for i, g, v in zip(*(b.column(c).to_pylist() for c in ("id", "grp", "vec")), strict=True):
                if (g, len(v)) in ready:
                    rows.setdefault((g, len(v)), []).append((i, v))
            a, c = [], []
            for k, own in rows.items():
                ids = np.array([i for i, _ in own])
                q, r = np.nonzero(ready[k][1] @ _rows([v for _, v in own]).T >= threshold)
                a += ready[k][0][q].tolist()
                c += ids[r].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    return run


def near_vectors(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93, k: int = 10, trees: int = 8, leaf: int = 48, pool: int = 64, rounds: int = 2, most_rounds: int = 8, audit: int = 1024, recall: float = 0.999, seed: int = 7) -> DataFrame:
    """Links between vectors of equal label: rows (vec_id, n_links, component_id, kept, audit_recall), one per input row.

    Vectors are linked if their cosine, in double precision, is at least ``threshold``. ``n_links`` counts the other rows linked
    directly, ``component_id`` is the least vec_id that links reach, ``kept`` tells whether it is the row's own.

    Equal vectors are one node from the start. The neighbour graph begins with the leaves of ``trees`` random-hyperplane trees.
    In each round every node's pool, itself, its neighbours and those whose neighbour it is, is compared within itself (pools over
    ``pool`` members in random parts, other parts in each round), and each member keeps its best k. A list
    whose members are all links is saturated: its k doubles. After ``rounds`` rounds an audit measures recall in two ways, of a
    size that doesn't grow with the table: ``audit`` hash-chosen nodes had a near copy planted at a cosine spread evenly from
    ``threshold`` to 1, which took part in the search as a node of its own; and as many nodes are asked against all rows for the links
    there really are. While fewer than ``recall`` of either lie within found components, ``trees`` freshly seeded trees are grown, twice as
    many each time, and another round follows, ``most_rounds`` at most; a search that then still finds less than nine tenths of
    the planted copies or real links is an error. Links come from the neighbour graph alone: planted copies leave it before components are formed, what the audit
    saw isn't added. Links are then counted exactly within components, in blocks of at most some hundreds of nodes, without listing pairs.
    ``audit_recall``, the lesser of the two measures, is the same in all rows.

    Null labels, vectors that are null, empty, zero, or hold nulls or non-finite numbers link with nothing; nor do vectors of
    different lengths. A null id is the component id only of rows that link with no other id. Repeated rows link with each
    other. Other columns are left aside; no rows give no rows.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, vec_id=vec_id, _e=embedding, _l=label).withColumn("_e", F.col("_e").cast("array<double>"))
    fine = F.col("_l").isNotNull() & F.col("_e").isNotNull() & F.forall("_e", lambda x: x.isNotNull() & (x == x) & (F.abs(x) < float("inf"))) & F.exists("_e", lambda x: x != 0)
    rows = rows.withColumn("_ok", F.coalesce(fine, F.lit(False)))
    kinds = rows.where("_ok").groupBy("_l", "_e").agg(F.min("vec_id").alias("first"), F.count("*").alias("m"))
    kinds = kinds.withColumn("grp", F.xxhash64("_l", F.size("_e"))).withColumn("id", F.monotonically_increasing_id())
    kinds = stored(kinds, "nn-kinds")
    blob = stored(kinds.select("id", "grp", "m", "_e").mapInArrow(_to_blob, "id long, grp long, m long, vec binary"), "nn-vectors")
    chosen = stored(blob.select("id", "grp", "vec").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(audit), "nn-audit")
    planted = chosen.mapInArrow(_near_copies(threshold, seed), "id long, grp long, vec binary")
    nodes = stored(blob.select("id", "grp", "vec").unionByName(planted), "nn-nodes")
    parts = partitions(spark)

    def compared(members: DataFrame, salt: int) -> DataFrame:
        """Best partners of members(key, id, k, bar) within each key's pools."""
        sized = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        part = F.pmod(F.xxhash64(F.lit(salt), "id"), F.ceil(F.col("n") / pool).cast("long"))
        pools = members.join(sized, "key").select(F.xxhash64("key", part).alias("pool"), "id", "k", "bar")
        full = pools.join(nodes, "id").select("pool", "id", "grp", "k", "bar", "vec")
        return full.repartition(parts, "pool").sortWithinPartitions("pool").mapInArrow(lambda b: _join_pools(b, threshold), _LISTS)

    def merged(lists: DataFrame, sizes: DataFrame | None) -> DataFrame:
        """Per node the best of all lists given, cut to its k; saturated lists get twice the k."""
        best = F.sort_array(F.array_distinct(F.flatten(F.collect_list("l"))), asc=False)
        got = lists.groupBy("id").agg(best.alias("l"))
        got = got.withColumn("k", F.lit(k)) if sizes is None else got.join(sizes, "id", "left").withColumn("k", F.coalesce("k", F.lit(k)))
        got = got.withColumn("l", F.slice("l", F.lit(1), F.col("k")))
        last = F.element_at("l", -1)["s"]
        return stored(got.select("id", "l", F.when((F.size("l") >= F.col("k")) & (last >= threshold), 2 * F.col("k")).otherwise(F.col("k")).alias("k"), F.when(F.size("l") >= F.col("k"), F.when(last >= threshold, F.lit(-1.0)).otherwise(last)).otherwise(F.lit(-1.0)).alias("bar")), "nn-lists")

    counts = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    # every node that links reach; components() leaves out the roots themselves
    reached = lambda edges: (r := components(edges)).union(r.select("root", "root")).distinct()
    depth = F.greatest(F.lit(0), F.least(F.lit(32), F.ceil(F.log2(F.col("n") / leaf)).cast("int")))

    def leaves(number: int, seed: int) -> DataFrame:
        codes = nodes.mapInArrow(_codes(number, seed), "id long, grp long, codes array<long>").join(counts, "grp")
        return codes.select("id", "grp", depth.alias("d"), F.posexplode("codes").alias("t", "code")).select(F.xxhash64(F.lit(seed), "grp", "t", F.call_function("shiftright", F.col("code"), F.lit(32) - F.col("d"))).alias("key"), "id", F.lit(k).alias("k"), F.lit(-1.0).alias("bar"))
    lists = merged(compared(leaves(trees, seed), 0), None)

    asked = spark.sparkContext.broadcast([(r["id"], r["grp"], bytes(r["vec"])) for r in chosen.collect()])  # ``audit`` vectors at most
    truth = stored(blob.select("id", "grp", "vec").mapInArrow(_ask_all(asked, threshold), "a long, b long").where("a <> b"), "nn-truth")
    n_truth, n_planted = truth.count(), len(asked.value)
    copies = planted.select(F.col("id").alias("a"), (-1 - F.col("id")).alias("b"))

    def met(pairs: DataFrame, number: int, edges: DataFrame) -> float:
        """The share of pairs that lie within components of the edges."""
        if not number:
            return 1.0
        roots = reached(edges)
        return pairs.join(roots.toDF("a", "_ra"), "a").join(roots.toDF("b", "_rb"), "b").where("_ra = _rb").count() / number

    grown = trees
    for turn in range(1, most_rounds + 1):
        state = lists.select("id", "k", "bar")
        out = lists.select("id", F.explode("l.v").alias("v"))
        member = out.select(F.col("id").alias("key"), F.col("v").alias("id")).union(out.select(F.col("v").alias("key"), "id")).union(lists.select("id", "id")).distinct()
        member = member.toDF("key", "id").join(state, "id", "left").select("key", "id", F.coalesce("k", F.lit(k)).alias("k"), F.coalesce("bar", F.lit(-1.0)).alias("bar"))
        lists = merged(lists.select("id", "l").unionByName(compared(member, turn)), state.select("id", "k"))
        if turn < rounds:
            continue
        edges = lists.select("id", F.explode("l").alias("x")).where(F.col("x.s") >= threshold).select(F.col("id").alias("a"), F.col("x.v").alias("b"))
        real = stored(edges.where("a >= 0 AND b >= 0"), "nn-edges")
        reachable = min(met(copies, n_planted, edges), met(truth, n_truth, real))
        if reachable >= recall:
            break
        if turn < most_rounds:
            grown *= 2
            lists = merged(lists.select("id", "l").unionByName(compared(leaves(grown, seed + turn), -turn)), lists.select("id", "k"))
    if reachable < 0.9:
        raise RuntimeError(f"the search reaches {reachable:.3f} of the audit's links")
    roots = reached(real)
    group = roots.toDF("id", "root").join(blob, "id")
    size = group.groupBy("root").agg(F.count("*").alias("n"))
    chunked = group.join(size, "root").withColumn("c", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / 256).cast("long")))
    packed = stored(chunked.groupBy("root", "c").agg(F.sort_array(F.collect_list(F.struct("id", "m", "vec"))).alias("rows")), "nn-chunks")
    # one row for each pair of chunks, so that no task holds a whole component
    pairs = packed.select("root", "c").join(size, "root").select("root", "c", F.explode(F.sequence(F.col("c"), F.ceil(F.col("n") / 256).cast("long") - 1)).alias("c2"))
    pairs = pairs.join(packed.toDF("root", "c", "left"), ["root", "c"]).join(packed.toDF("root", "c2", "right"), ["root", "c2"]).select("left", "right", (F.col("c") == F.col("c2")).alias("same"))
    linked = pairs.mapInArrow(_count_chunks(threshold), "id long, n long").groupBy("id").agg(F.sum("n").alias("_n"))
    named = kinds.select("id", "_l", "_e", "first", "m").join(roots.toDF("id", "_root"), "id", "left").join(linked, "id", "left")
    least = named.where("_root is not null").groupBy("_root").agg(F.min("first").alias("_least"))
    named = named.join(least, "_root", "left").select("_l", "_e", F.coalesce("_least", "first").alias("component_id"), (F.coalesce("_n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"))
    good = rows.where("_ok").join(named, ["_l", "_e"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), F.lit(reachable).alias("audit_recall"))


def _near_copies(threshold: float, seed: int):
    """A copy of each vector, turned away from it by a chance angle whose cosine is at least ``threshold``; its id is -1 - id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for i, blob in zip(b.column("id").to_pylist(), b.column("vec").to_pylist(), strict=True):
                rng = np.random.default_rng([seed, i])
                v = np.frombuffer(blob, dtype=np.float64)
                v = v / np.abs(v).max()
                v = v / np.linalg.norm(v)
                u = rng.normal(size=len(v))
                u = u - (u @ v) * v
                cosine, size = rng.uniform(threshold + 1e-6, 1.0), np.linalg.norm(u)
                made.append((cosine * v + np.sqrt(1 - cosine * cosine) * u / size if len(v) > 1 and size > 0 else v).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([-1 - i for i in b.column("id").to_pylist()], pa.int64()), b.column("grp"), pa.array(made, pa.binary())], names=["id", "grp", "vec"])

    return run


def _to_blob(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        blobs = [np.array(x, dtype=np.float64).tobytes() for x in b.column("_e").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("grp"), b.column("m"), pa.array(blobs, pa.binary())], names=["id", "grp", "m", "vec"])
