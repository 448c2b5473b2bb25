"""Periodic runs in texts: stretches of words that repeat themselves at least twice.

Every run holds a longest Lyndon word that is as long as its period, for one of the two orders of the alphabet. The
Lyndon arrays of both orders are computed from the left in linear time; how far two suffixes agree is carried along,
and what lies within an earlier match is looked up at its mirrored place instead of being compared again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_BREAK, pick
from .words import text_blocks

#: A run has at least so many words.
LEAST = 12
_GRAM = 4


def lyndon_array(w: list[int], sign: int = 1) -> tuple[list[int], list[int]]:
    """(next, agree): where the next smaller suffix of each suffix begins (``len(w)``: none), and how many symbols the two share.

    ``next[i] - i`` is the length of the longest Lyndon word that begins at i. ``sign`` -1 turns the order of symbols
    round; a suffix's own prefix is smaller than it in both. Suffix i meets the earlier ones in the order of the
    stack of previous smaller suffixes. If the last match that reached furthest is [l, l+m) = [r, r+m), two suffixes from r on
    agree as their places l-r to the left did, unless that reaches the match's end; comparing only goes on from there,
    so each symbol is matched once.
    """
    n = len(w)
    nxt, agree = [n] * n, [0] * n
    prev, shared = [-1] * n, [0] * n
    r = end = shift = 0
    for i in range(1, n):
        j, known = i - 1, 0
        while True:
            if i + known < end and j >= r:
                a, b = j - shift, i - shift
                x = agree[a] if nxt[a] == b else shared[b] if prev[b] == a else known
                x = max(known, min(x, end - i))
            else:
                x = known
            if i + x >= end or x == known:
                while i + x < n and w[i + x] == w[j + x]:
                    x += 1
                if i + x >= end:
                    r, end, shift = i, i + x, i - j
            if i + x < n and (w[j + x] < w[i + x] if sign > 0 else w[j + x] > w[i + x]):
                prev[i], shared[i] = j, x
                break
            nxt[j], agree[j] = i, x
            y, j = shared[j], prev[j]
            while j >= 0 and y > x:  # suffix j agrees with the one just passed for longer than that one with suffix i
                nxt[j], agree[j] = i, x
                y, j = shared[j], prev[j]
            if j < 0:
                break
            if y < x:
                prev[i], shared[i] = j, y
                break
            known = x
    return nxt, agree


def runs(w: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, smallest period) of at least ``least`` symbols, by start, then period.

    A run's first Lyndon word of its period's length begins less than a period after the run, so that much is matched to the left.
    """
    found = set()
    for sign in (1, -1):
        nxt, agree = lyndon_array(w, sign)
        for i, x in enumerate(agree):
            if not x:  # a run's first such word meets the next one of its kind
                continue
            p = nxt[i] - i
            end = i + p + x
            short = max(least, 2 * p) - (end - i)  # words that must match to the left
            if short >= p:
                continue
            s, stop = i, max(-1, i - p)
            while s > 0 and s > stop and w[s - 1] == w[s - 1 + p]:
                s -= 1
            if s > stop and i - s >= short:
                found.add((s, end - s, p))
    return sorted(found, key=lambda t: (t[0], t[2]))


def repeated_stretches(codes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches [start, end) outside of which no run of at least ``least`` (12 or more) symbols can lie.

    Within a run each four symbols in a row occur again a period before or behind, but for at most three places
    around the middle of a run of just two periods. So stretches are made of places whose four symbols occur more than
    once in the text, closed over gaps of three; each run lies in one stretch whole.
    """
    n = len(codes) - _GRAM + 1
    if least < 12 or n < 1:
        return [(0, len(codes))] if len(codes) >= least else []
    size = int(codes.max()) + 1
    _, two = np.unique(codes[:-1].astype(np.int64) * size + codes[1:], return_inverse=True)
    four = two[:-2].astype(np.int64) * (int(two.max()) + 1) + two[2:]
    order = np.argsort(four, kind="stable")
    same = np.diff(four[order]) == 0
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > _GRAM)
    return [(int(a), int(b) + _GRAM) for a, b in zip(at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]], strict=True) if b - a + _GRAM >= least]


def text_runs(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """The runs of a text's words. Words get numbers in order of appearance; any order of the alphabet serves."""
    if len(words) < least:
        return []
    known: dict[bytes, int] = {}
    codes = np.array([known.setdefault(x, len(known)) for x in words], dtype=np.int64)
    if len(known) == len(words):
        return []
    out = []
    for a, b in repeated_stretches(codes, least):
        out += [(s + a, length, p) for s, length, p in runs(codes[a:b].tolist(), least)]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words without those that some run holds behind its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for s, length, p in found:
        edge[s + p] += 1
        edge[s + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return b" ".join(x for x, k in zip(words, kept.tolist(), strict=True) if k)


def collapse_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Rows (doc_id, n_words, runs array<struct<start, length, period>>, collapsed), one per input row.

    A run is a stretch of words (between ASCII white space) with smallest period q, at least ``max(least, 2 * q)`` words long,
    that neither neighbour extends; runs are listed by start, then period. ``collapsed`` leaves each run's first period
    and drops the rest. One pass over the rows, no shuffle; a task holds one block of texts and the words of one text.

    Null and empty texts have no words and no runs, ``collapsed`` is ''; null ids and repeated rows are kept;
    other columns are left aside; no rows give no rows.
    """
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, ["doc_id", "_x"], "_x", 1 << 22):
            split = [(t or b"").split() for t in texts]
            found = [text_runs(x, least) for x in split]
            names = ("start", "length", "period")
            yield pa.RecordBatch.from_arrays([
                pa.array(ids, pa.int64()),
                pa.array([len(x) for x in split], pa.int64()),
                pa.array([[dict(zip(names, t, strict=True)) for t in x] for x in found], kinds),
                pa.array([collapsed(x, y).decode() for x, y in zip(split, found, strict=True)], pa.string()),
            ], names=["doc_id", "n_words", "runs", "collapsed"])

    plain = pick(docs, doc_id=doc_id, _x=text).withColumn("doc_id", F.col("doc_id").cast("long"))
    return plain.mapInArrow(work, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_planted_runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): one text in ten, by crc32 of its id, becomes periodic from some word on."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    plain = pick(docs, doc_id=doc_id, text=text).withColumn("_h", h)
    words = F.when(F.col("_h") % 10 == 0, F.filter(F.split(F.coalesce("text", F.lit("")), WORD_BREAK), lambda w: w != ""))
    made = plain.withColumn("_w", words).withColumn("_n", F.coalesce(F.size("_w"), F.lit(0)).cast("long")).withColumn("_g", F.floor(F.col("_h") / 10))
    made = made.withColumn("_a", F.expr("if(_n > 0, _g % _n, 0)")).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    turned = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % _p as int)])), ' ')")
    return made.select("doc_id", F.when(F.col("_n") > 0, turned).otherwise(F.col("text")).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """A row's number of runs, its longest one, and hashes of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    top = found.withColumn("_b", best)
    return top.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.length").alias("length"), (-F.col("_b.p")).alias("period"),
        F.expr("1000 * _b.length div -_b.p").alias("exponent_milli"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
