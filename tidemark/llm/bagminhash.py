"""Near-duplicate texts by BagMinHash: weighted-Jaccard signatures of shingle multisets, bands, exact overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_links, forget, partitions, pick, released, stored, text_id
from .words import mix, text_blocks, word_hashes

SHINGLE = 5
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Estimates vary by 0.036 at the threshold; pairs this far below it aren't looked at again.
SLACK = 0.17
#: A bucket is compared in chunks of so many bags, or of so many bytes of bags, at most.
CHUNK, CHUNK_BYTES = 512, 16 << 20
#: Ids of texts, of 8 bytes each, are broadcast up to so many; beyond, the texts are shuffled.
BROADCAST_IDS = 1_000_000

_M = np.uint64(REGISTERS)
_ONE = np.uint64(0x9E3779B97F4A7C15)


def shingle_bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle hash, count) of all texts, ordered by text and hash.

    Shingles are runs of five words; a text of one to four words has one shingle, all of them.
    """
    w, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(w) - SHINGLE + 1), dtype=np.uint64)
        for i in range(SHINGLE):
            rolled = mix(rolled * np.uint64(3) + w[i : len(w) - SHINGLE + 1 + i]) if len(rolled) else rolled
        owner = np.repeat(np.arange(len(texts)), counts)
        at = np.flatnonzero(np.arange(len(w)) + SHINGLE <= ends[owner]) if len(w) else np.empty(0, dtype=np.int64)
        doc, h = owner[at], rolled[at]
        short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
        if len(short):
            more = []
            for d in short:
                x = np.zeros(1, dtype=np.uint64)
                for v in w[ends[d] - counts[d] : ends[d]]:
                    x = mix(x * np.uint64(3) + v)
                more.append(x[0])
            doc, h = np.concatenate([doc, short]), np.concatenate([h, np.array(more, dtype=np.uint64)])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.empty(0, dtype=np.int64)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def _points(doc: np.ndarray, h: np.ndarray, count: np.ndarray, until: np.ndarray, out: np.ndarray) -> None:
    """Put the least time of each register into out[text, register], of all points up to until[text].

    A shingle of weight w owns, for each dyadic range (0, 1], (1, 2], (2, 4], ... that begins below w,
    a Poisson process over time, the range's unit steps and the registers. Points at steps
    above w don't count. So texts share exactly the points of the weights that they share.
    """
    low = np.zeros(len(h), dtype=np.int64)
    level = 0
    while len(h):
        length = np.maximum(1, low) if level else np.ones(len(h), dtype=np.int64)
        with np.errstate(over="ignore"):
            seed = mix(h ^ mix(np.array([level + 1], dtype=np.uint64) * _ONE))
        d, c, lo, ln, s, t = doc, count, low, length, seed, np.zeros(len(h))
        k = 0
        while len(s):
            with np.errstate(over="ignore"):
                r = mix(s + np.uint64(2 * k + 1) * _ONE)
            t = t - np.log(((r >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / (REGISTERS * ln)
            live = np.flatnonzero(t <= until[d])
            d, c, lo, ln, s, t = d[live], c[live], lo[live], ln[live], s[live], t[live]
            with np.errstate(over="ignore"):
                r = mix(s + np.uint64(2 * k + 2) * _ONE)
            register = ((r >> np.uint64(40)) * _M >> np.uint64(24)).astype(np.int64)
            step = lo + 1 + ((r & np.uint64(0xFFFFFFFF)) * ln.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
            ok = step <= c
            np.minimum.at(out, (d[ok], register[ok]), t[ok])
            k += 1
        level += 1
        reach = 1 if level == 1 else 2 ** (level - 1)
        more = count > reach
        doc, h, count = doc[more], h[more], count[more]
        low = np.full(len(h), reach, dtype=np.int64)


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(register times of each text, number of shingles of each text); a text without words has no finite times."""
    doc, h, count = shingle_bags(texts)
    total = np.bincount(doc, weights=count, minlength=len(texts))
    out = np.full((len(texts), REGISTERS), np.inf)
    until = np.where(total > 0, (np.log(REGISTERS) + 3) / np.maximum(total, 1), 0)
    todo = total > 0
    while todo.any():
        own = todo[doc]
        _points(doc[own], h[own], count[own], until, out)
        todo &= np.isinf(out).any(axis=1)
        until = until * 2
    return out, total


def band_keys(times: np.ndarray) -> np.ndarray:
    bits = times.view(np.uint64).reshape(len(times), BANDS, ROWS)
    with np.errstate(over="ignore"):
        keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64) * _ONE, (len(times), 1))
        for i in range(ROWS):
            keys = mix(keys * np.uint64(5) + bits[:, :, i])
    return keys.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (ascending hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum() + b[1].sum()) - both)


def _pack_bag(h: np.ndarray, c: np.ndarray) -> bytes:
    """Hashes, then counts of those that occur more than once, as (place, count)."""
    more = np.flatnonzero(c > 1)
    return np.concatenate([np.array([len(h)], dtype=np.uint64), h, more.astype(np.uint64), c[more].astype(np.uint64)]).tobytes()


def _unpack_bag(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b, dtype=np.uint64)
    n = int(x[0])
    c = np.ones(n, dtype=np.int64)
    more = x[n + 1 :].reshape(2, -1).astype(np.int64)
    c[more[0]] = more[1]
    return x[1 : n + 1], c


@released
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bag of each text."""
    for tid, raw in text_blocks(batches, ["_tid", "_x"], "_x", 2 << 20):
        doc, h, count = shingle_bags([x or b"" for x in raw])
        ends = np.searchsorted(doc, np.arange(len(raw) + 1))
        bags = [_pack_bag(h[i:j], count[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(tid, pa.int64()), pa.array(bags, pa.binary())], names=["_tid", "_bag"])


@released
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, tid, doc, raw in text_blocks(batches, ["_row", "_tid", "doc_id", "_x"], "_x", 2 << 20):
        times, total = signatures([x or b"" for x in raw])
        keys = band_keys(times)
        with np.errstate(over="ignore"):
            brief = (mix(times.view(np.uint64)) >> np.uint64(56)).astype(np.uint8)
        full = (total > 0).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(tid, pa.int64()), pa.array(doc, pa.int64()), pa.array([k.tolist() if f else None for k, f in zip(keys, full, strict=True)], pa.list_(pa.int64())), pa.array([b.tobytes() if f else None for b, f in zip(brief, full, strict=True)], pa.binary())],
            names=["_row", "_tid", "doc_id", "_bands", "_sig"],
        )


@released
def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures leave it open that they are similar enough."""
    least = (SIMILARITY - SLACK) * REGISTERS
    for b in batches:
        if b.num_rows:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, REGISTERS) for c in (2, 3))
            keep = np.flatnonzero((x == y).sum(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep))], names=["a", "b"])


@released
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their bags, those that are similar enough."""
    for batch in batches:
        a, b, x, y = batch.columns
        hit = [i for i in range(batch.num_rows) if overlap(_unpack_bag(x[i].as_py()), _unpack_bag(y[i].as_py())) >= SIMILARITY]
        hit = pa.array(hit, pa.int64())
        yield pa.RecordBatch.from_arrays([a.take(hit), b.take(hit)], names=["a", "b"])


def overlaps(left: list[tuple[np.ndarray, np.ndarray]], right: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard of each bag on the left with each on the right.

    A shingle that occurs c times is c features, the first occurrence, the second, and so on;
    common features are then counted by products of 0/1 matrices, some thousand features at a time.
    """
    if not left or not right:
        return np.zeros((len(left), len(right)))

    def features(bags: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(bags)), [int(c.sum()) for _, c in bags])
        h = np.concatenate([np.repeat(h, c) for h, c in bags])
        c = np.concatenate([c for _, c in bags])
        nth = np.arange(len(h)) - np.repeat(np.cumsum(c) - c, c)
        with np.errstate(over="ignore"):
            return row, np.where(nth > 0, mix(h + nth.astype(np.uint64) * _ONE), h)

    (ra, fa), (rb, fb) = features(left), features(right)
    shared = np.intersect1d(fa, fb)
    out = np.zeros((len(left), len(right)))
    ia, ib = np.searchsorted(shared, fa), np.searchsorted(shared, fb)
    ok_a = np.flatnonzero(shared[np.minimum(ia, len(shared) - 1)] == fa) if len(shared) else ia[:0]
    ok_b = np.flatnonzero(shared[np.minimum(ib, len(shared) - 1)] == fb) if len(shared) else ib[:0]
    for at in range(0, len(shared), 4096):
        x, y = np.zeros((len(left), 4096), dtype=np.float32), np.zeros((len(right), 4096), dtype=np.float32)
        for m, r, i, ok in ((x, ra, ia, ok_a), (y, rb, ib, ok_b)):
            own = ok[(i[ok] >= at) & (i[ok] < at + 4096)]
            m[r[own], i[own] - at] = 1
        out += x @ y.T
    total = np.bincount(ra, minlength=len(left))[:, None] + np.bincount(rb, minlength=len(right))[None, :]
    return out / np.maximum(1, total - out)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (i, j) among n suffice to join what all of them join."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    keep = []
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        a, b = find(a), find(b)
        if a != b:
            root[b] = a
            keep.append(k)
    return np.array(keep, dtype=np.int64)


@released
def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each group of rows (key, c, c2, mine, id, root, _sig, _bag) that join different roots; groups arrive one after the other.

    ``mine`` are the rows of chunk c; if c is not c2, only pairs of a row of c with one of c2 are compared.
    """
    least = (SIMILARITY - SLACK) * REGISTERS

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        same = rows[0][1] == rows[0][2]
        left = [r for r in rows if r[3]]
        right = left if same else [r for r in rows if not r[3]]
        if not left or not right:
            return [], []
        roots = np.array([r[5] for r in left]), np.array([r[5] for r in right])
        if same:  # the largest component isn't compared with itself
            u, inv, n = np.unique(roots[0], return_inverse=True, return_counts=True)
            left = [r for r, i in zip(left, inv, strict=True) if i != n.argmax()]
            roots = np.array([r[5] for r in left], dtype=np.int64), roots[1]
            if not left:
                return [], []
        sx, sy = (np.frombuffer(b"".join(r[6] for r in side), dtype=np.uint8).reshape(-1, REGISTERS) for side in (left, right))
        agree = np.stack([(x[None, :] == sy).sum(axis=1) for x in sx])
        open_ = (agree >= least) & (roots[0][:, None] != roots[1][None, :])
        i, j = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if not len(i):
            return [], []
        near = overlaps([_unpack_bag(left[k][7]) for k in i], [_unpack_bag(right[k][7]) for k in j]) >= SIMILARITY
        p, q = np.nonzero(near & open_[np.ix_(i, j)])
        ids = np.array([left[k][4] for k in i])[p], np.array([right[k][4] for k in j])[q]
        at = np.unique(np.concatenate([roots[0][i][p], roots[1][j][q]]), return_inverse=True)[1]
        own = _forest(at[: len(p)], at[len(p) :], len(at))
        return ids[0][own].tolist(), ids[1][own].tolist()

    def run(rows: list[tuple]) -> pa.RecordBatch:
        a, b = compare(rows)
        return pa.RecordBatch.from_arrays([pa.array([min(x) for x in zip(a, b, strict=True)], pa.int64()), pa.array([max(x) for x in zip(a, b, strict=True)], pa.int64())], names=["a", "b"])

    own: list[tuple] = []
    for batch in batches:
        for r in zip(*(batch.column(c).to_pylist() for c in ("key", "c", "c2", "mine", "id", "root", "_sig", "_bag")), strict=True):
            if own and own[0][:3] != r[:3]:
                yield run(own)
                own = []
            own.append(r)
    if own:
        yield run(own)


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", pivots: int = 2) -> DataFrame:
    """Classes of near-duplicate documents: rows (doc_id, class_id, kept, worded, _tid), one per input row.

    Two texts are linked if the multisets of their five-word shingles (A-Z lower-cased) have
    a weighted Jaccard similarity of 0.8 or more; a class is all that links reach, its id the least
    doc_id in it, and one row of it is kept (the first of that id). Equal texts are one from the
    start, found by hash. Candidates share one of 25 bands of five registers (a pair at 0.8 is
    missed with probability 5e-5) and every candidate whose whole signature doesn't rule it out
    is verified on the whole texts.

    Members of a band's bucket are first compared with ``pivots`` of its members, one after the
    other. Where it still holds several classes, their members are compared in chunks, by
    signature and then exactly on the whole bags, inside the tasks: a task gives only links that
    join classes, so no list of a bucket's pairs exists, and no link between classes is lost.

    Null texts and texts without a word are classes of their own, row by row; a text of one to
    four words is one shingle. Null ids take part, a class of nulls has a null id. Other columns are left aside;
    no rows give no rows. ``worded`` tells whether the text has a word, ``_tid`` is a hash of it.
    """
    base = pick(docs, doc_id=doc_id, _x=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("_x", F.lit("")).alias("_x")).withColumn("_tid", text_id("_x"))
    signed = base.withColumn("_row", F.monotonically_increasing_id()).select("_row", "_tid", "doc_id", "_x")
    signed = stored(signed.mapInArrow(_sign, "_row long, _tid long, doc_id long, _bands array<long>, _sig binary"), "bag-signed")
    worded = signed.where("_bands is not null")
    first = worded.groupBy("_tid").agg(F.min("_row").alias("_row"))
    kinds = stored(worded.join(first, ["_row", "_tid"]).select("_tid", "_bands", "_sig"), "bag-kinds")
    exploded = kinds.select("_tid", F.explode("_bands").alias("key"))
    shared = exploded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(exploded.join(shared, "key"), "bag-members")
    some = stored(members.select("_tid").distinct(), "bag-some")
    few = F.broadcast(some) if some.count() <= BROADCAST_IDS else some
    sigs = stored(kinds.join(few, "_tid", "left_semi").select("_tid", "_sig"), "bag-sigs")
    texts = base.select("_tid", "_x").join(few, "_tid", "left_semi").groupBy("_tid").agg(F.min("_x").alias("_x"))
    bags = stored(texts.mapInArrow(_bags, "_tid long, _bag binary"), "bag-bags")
    parts = partitions(docs.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sigs.toDF("a", "_sa"), "a").join(sigs.toDF("b", "_sb"), "b").select("a", "b", "_sa", "_sb").mapInArrow(_alike, "a long, b long")
        near = stored(near, "bag-open")
        full = near.join(bags.toDF("a", "_xa"), "a").join(bags.toDF("b", "_xb"), "b").select("a", "b", "_xa", "_xb")
        links = stored(full.mapInArrow(_verify, "a long, b long"), "bag-links")
        forget(near)
        return links

    def last(now: DataFrame) -> DataFrame:
        """Links between different roots within buckets(key, id, root), each bucket in pairs of chunks."""
        held = now.join(sigs.toDF("id", "_sig"), "id").join(bags.toDF("id", "_bag"), "id")
        size = held.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum(F.length("_bag")) / CHUNK_BYTES)).cast("int").alias("k"))
        cut = held.join(size, "key").withColumn("c0", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("k")).cast("int"))
        pair = F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other")
        cut = cut.select("key", "id", "root", "_sig", "_bag", "c0", pair).select("key", F.least("c0", "other").alias("c"), F.greatest("c0", "other").alias("c2"), (F.col("c0") <= F.col("other")).alias("mine"), "id", "root", "_sig", "_bag")
        cut = cut.repartition(parts, "key", "c", "c2").sortWithinPartitions("key", "c", "c2")
        return stored(cut.mapInArrow(_apart, "a long, b long"), "bag-links")

    roots = bucket_links(members.select("key", F.col("_tid").alias("id")), linked, pivots, last_links=last).toDF("_tid", "_root")
    named = signed.select("doc_id", "_row", "_tid", F.col("_sig").isNotNull().alias("worded")).join(roots, "_tid", "left")
    named = stored(named.select("doc_id", "_row", "_tid", "worded", F.when(F.col("worded"), F.coalesce("_root", "_tid")).alias("_class")), "bag-classes")
    forget(signed, kinds, members, some, sigs, bags, roots)
    heads = named.where("worded").groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "_row")).alias("h")).select("_class", F.col("h.doc_id").alias("class_id"), F.col("h._row").alias("_head"))
    alone = named.where("not worded").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"), "worded", "_tid")
    return named.where("worded").join(heads, "_class").select("doc_id", "class_id", (F.col("_row") == F.col("_head")).alias("kept"), "worded", "_tid").unionByName(alone)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps: one of each class, and all without a word."""
    marks = near_duplicates(docs, doc_id=doc_id, text=text, **options)
    marks = marks.groupBy("doc_id", "_tid").agg(F.max("kept").alias("_kept"), F.count("*").alias("_n"), F.max("worded").alias("_w")).where("_kept").withColumnRenamed("doc_id", "_kid").withColumnRenamed("_tid", "_ktid")
    names = docs.columns
    rows = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    rows = rows.withColumn("_id", F.col(f"_c{names.index(doc_id)}").cast("long")).withColumn("_x", F.coalesce(F.col(f"_c{names.index(text)}"), F.lit(""))).withColumn("_tid", text_id("_x")).drop("_x")
    kept = rows.join(marks, rows["_id"].eqNullSafe(marks["_kid"]) & (rows["_tid"] == marks["_ktid"]))
    # rows that agree in id and text can't be told apart by them: one of each lot stays
    one = kept.where("_n > 1 and _w").dropDuplicates(["_id", "_tid"])
    out = kept.where("_n = 1 or not _w").unionByName(one)
    return out.select(*[f"_c{i}" for i in range(len(names))]).toDF(*names)
