"""Scoring text with a probabilistic suffix tree over words.

The corpus is turned once into blocks: rows of a Parquet table in the shared folder that hold
some texts as word numbers, and the hashes of the block's distinct words. Every count is
then an exchange between blocks and buckets of the hash range: a block asks each bucket
about its distinct keys, with its own training counts; the bucket adds up the counts of
all blocks and answers each of them. What moves is one number for each distinct key of a
block, in sorted, compressed runs, never a row for each word of the corpus. Blocks and the
answers that they got lie in buckets of the block's number, so that no later step moves them.
With counts, buckets give words and contexts dense numbers. A longer gram's key is made of its
context's and its last word's, over as few bits as all these pairs need, not a hash of 64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, partitions, pick, released, shuffles_freed, stored_by
from .words import text_blocks, word_hashes

#: The hash of the token that ends each text.
END = np.uint64(0xE0F0E0F0E0F0E0F0)
#: Weights of a state's parent among which the divergence test chooses.
PRIORS = np.array([2.0, 16.0, 128.0, 1024.0, 8192.0])

#: Of a context with so many training tokens in a block, at most, these are sent instead of their gains, which take more room.
FEW = 3


_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(x: np.ndarray) -> bytes:
    return _ZIP.compress(np.ascontiguousarray(x).data)


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(_UNZIP.decompress(b), dtype=dtype)


def _pack_keys(x: np.ndarray) -> bytes:
    """Ascending keys as differences (the high byte planes are nearly empty)."""
    return _small(np.diff(x, prepend=np.uint64(0)))


def _unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unsmall(b), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Numbers from 0 as byte planes, no more than the largest needs."""
    x = np.ascontiguousarray(x, dtype="<u8")
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([planes]) + _pack(x.view(np.uint8).reshape(-1, 8)[:, :planes].T)


def _unsmall(b: bytes) -> np.ndarray:
    planes = _unpack(b[1:], np.uint8).reshape(b[0], -1)
    if b[0] == 1:
        return planes[0].astype(np.uint64)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    for i, x in enumerate(planes):
        out[:, i] = x
    return out.view("<u8").ravel()


def _floats(x: np.ndarray) -> bytes:
    """Single precision, as byte planes."""
    return _pack(np.ascontiguousarray(x, dtype="<f4").view(np.uint8).reshape(-1, 4).T)


def _unfloats(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, np.uint8).reshape(4, -1).T).view("<f4").ravel().astype(np.float64)


def _gains(n: int, owner: np.ndarray, here: np.ndarray, held: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of n contexts, leave-one-out gains over the parent's distribution q, of each of the priors, summed over the training tokens after them."""
    return np.stack([np.bincount(owner, weights=np.log((here - 1 + prior * q) / ((held - 1 + prior) * q)), minlength=n) for prior in PRIORS], axis=1)


def _pack_states(met: np.ndarray, held: np.ndarray, owner: np.ndarray, here: np.ndarray, q: np.ndarray) -> bytes:
    """Contexts met so often here and held so often in all, and the training tokens after them, ordered by context: few as they are, many as their gains."""
    few = met <= FEW
    own = few[owner]
    many = (np.cumsum(~few) - 1)[owner[~own]]
    gains = _gains(int((~few).sum()), many, here[~own], held[owner[~own]], q[~own])
    parts = [_small(np.minimum(met, FEW + 1)), _small(held[few]), _small(here[own]), _floats(q[own]), _floats(gains.T.ravel())]
    return b"".join(len(x).to_bytes(4, "little") + x for x in parts)


def _unpack_states(b: bytes) -> np.ndarray:
    """The contexts' gains."""
    parts, at = [], 0
    while at < len(b):
        to = at + 4 + int.from_bytes(b[at : at + 4], "little")
        parts.append(b[at + 4 : to])
        at = to
    met = _unsmall(parts[0]).astype(np.int64)
    few = met <= FEW
    out = np.empty((len(met), len(PRIORS)))
    owner = np.repeat(np.arange(int(few.sum())), met[few])
    out[few] = _gains(int(few.sum()), owner, _unsmall(parts[2]).astype(np.float64), _unsmall(parts[1]).astype(np.float64)[owner], _unfloats(parts[3]))
    out[~few] = _unfloats(parts[4]).reshape(len(PRIORS), -1).T
    return out


def _bits(pairs: int) -> int:
    """Bits of the keys of so many pairs; at 64 they are hashes, as words are."""
    return min(64, max(2, (pairs - 1).bit_length()))


def _spread(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of so many bits, each turned into another one, none into the same, that fill the range evenly."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    with np.errstate(over="ignore"):
        for odd in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = ((x ^ (x >> half)) * np.uint64(odd)) & mask
        return x ^ (x >> half)


def _bucket_bounds(keys: np.ndarray, n: int, size: int) -> np.ndarray:
    """Where each of n equal parts of the range from 0 to ``size`` begins in the ascending keys."""
    edges = np.array([i * size // n for i in range(1, n)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


class Block:
    """A block's tokens, as places in its words; these go by rank of how often the block has them."""

    def __init__(self, lengths: bytes, training: bytes, counts: bytes, local: bytes):
        self.lengths = _unpack(lengths, np.int64)
        self.kinds, order = _by_count(_unsmall(counts))
        self.local = order[_unsmall(local).astype(np.int64)]
        self.n = len(self.local)
        self.trains = np.repeat(_unpack(training, np.bool_), self.lengths)
        self.inner = np.ones(self.n + 1, dtype=bool)  # all but the texts' first tokens, and what follows the last text
        self.inner[np.cumsum(self.lengths) - self.lengths] = self.inner[self.n] = False


def _by_count(counts: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of words, their places, the most frequent ones first)."""
    return len(counts), np.argsort(np.uint16(65535) - np.minimum(counts, 65535).astype(np.uint16), kind="stable")


def _distinct(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct keys of so many bits, place of each input key among them)."""
    shift = max(1, len(keys).bit_length())
    if bits + shift > 64:
        return np.unique(keys, return_inverse=True)
    # numbers with their places below them: sorting these is faster than sorting places by numbers
    both = np.sort(keys << np.uint64(shift) | np.arange(len(keys), dtype=np.uint64))
    key = both >> np.uint64(shift)
    first = np.concatenate([[True], key[1:] != key[:-1]])[: len(key)]
    at = np.empty(len(keys), dtype=np.int64)
    at[(both & np.uint64((1 << shift) - 1)).astype(np.int64)] = np.cumsum(first) - 1
    return key[first], at


def _replay(row: dict, answers: dict[tuple[int, str], np.ndarray], depth: int, total: int, kinds: int, least: int, sizes: list[int]):
    """Rebuild a block's state up to where answers end.

    Returns (block, base, score, ask): the probabilities of each token under the root and under the
    tree, or the next question (level, name, keys, range of keys, training counts, states) if an answer is missing.
    ``sizes``: the range of the dense numbers of words, of contexts of two words, and so on.
    """
    b = Block(row["lengths"], row["training"], row["counts"], row["local"])
    if (0, "n") not in answers:
        return b, None, None, (0, "n", _unpack_keys(row["words"]), 1 << 64, np.bincount(b.local[b.trains], minlength=b.kinds), None)
    n = answers[0, "n"].astype(np.float64)[b.local]
    asked = next((x for x in ((k, x) for k in range(1, depth + 1) for x in ("n", "s")) if x not in answers), None)
    p0 = p = None
    if asked is None or asked[1] == "s":  # questions about counts need no probabilities
        p0 = (n + 0.5) / (total + 0.5 * (kinds + 1))
        p = p0.copy()
    # of the last level: numbers of its distinct grams, ascending, tokens that end one, its place among them, its count
    known, met, at, count = answers[0, "id"], np.arange(b.n), b.local, n
    for level in range(1, depth + 1):
        # the context of a token: the gram of ``level`` words before it, met ``least`` times in training
        own = np.flatnonzero(count >= least)
        own = own[b.inner[met[own] + 1]]
        where, ctx, held = met[own] + 1, at[own], count[own]
        # a gram whose end isn't met in training isn't either
        end = n[where] > 0
        met = where[end]
        bits = _bits(sizes[level - 1] * sizes[0])
        with np.errstate(over="ignore"):
            pairs = known[ctx[end]] * np.uint64(sizes[0]) + answers[0, "id"][b.local[met]]
        u, at = _distinct(_spread(pairs, bits), bits)
        if (level, "n") not in answers:
            return b, None, None, (level, "n", u, 1 << bits, np.bincount(at[b.trains[met]], minlength=len(u)), None)
        count = answers[level, "n"].astype(np.float64)[at]
        if level < depth:
            n = np.zeros(b.n)
            n[met] = count
        states = np.zeros(len(known), dtype=bool)
        states[ctx] = True
        if asked == (level, "s"):
            # what the gains of each context come from
            here = np.zeros(len(where))
            here[end] = count
            sat = (np.cumsum(states) - 1)[ctx]
            t = np.flatnonzero(b.trains[where])
            t = t[np.argsort(sat[t])]
            su = known[states]
            total_held = np.zeros(len(su))
            total_held[sat] = held
            return b, None, None, (level, "s", su, sizes[level - 1], None, (np.bincount(sat[t], minlength=len(su)), total_held, sat[t], here[t], p[where][t]))
        if p is not None:
            prior = np.zeros(len(known))
            prior[states] = answers[level, "s"]
            prior = prior[ctx]
            here = np.zeros(len(where))
            here[end] = count
            kept = np.flatnonzero(prior > 0)
            w, pr = where[kept], prior[kept]
            p[w] = (here[kept] + pr * p[w]) / (held[kept] + pr)
        known = answers[level, "id"]
    return b, p0, p, None


@released
def _asked(batches: Iterator[pa.RecordBatch], settings: dict) -> Iterator[pa.RecordBatch]:
    parts = settings["parts"]
    for row, answers in _blocks(batches, settings):
        _, _, _, ask = _replay(row, answers, **settings["model"])
        level, name, keys, size, counts, states = ask
        bounds = _bucket_bounds(keys, parts, size)
        full = [i for i in range(parts) if bounds[i + 1] > bounds[i]]
        spans = [slice(bounds[i], bounds[i + 1]) for i in full]
        if states is None:
            values = [_small(counts[s]) for s in spans]
        else:
            met, held, owner, here, q = states
            own = [slice(*np.searchsorted(owner, [s.start, s.stop])) for s in spans]
            values = [_pack_states(met[s], held[s], owner[t] - s.start, here[t], q[t]) for s, t in zip(spans, own, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([row["block"]] * len(full), pa.int64()), pa.array(full, pa.int32()), pa.array([_pack_keys(keys[s]) for s in spans], pa.binary()), pa.array(values, pa.binary())],
            names=["block", "bucket", "keys", "value"],
        )


def _least_met(level: int, least: int) -> int:
    """How often a gram is met that gets a dense number: all words in training, and longer contexts."""
    return least if level else 1


def _blocks(batches: Iterator[pa.RecordBatch], settings: dict) -> Iterator[tuple[dict, dict]]:
    """Each block with its answers, put together from the buckets' runs."""
    model, parts = settings["model"], settings["parts"]
    for batch in batches:
        for i in range(batch.num_rows):
            row = {n: batch.column(n)[i].as_py() for n in batch.schema.names if n != "asked" and not n.startswith("answers")}
            answers = {k: np.zeros(0) for k in _silent(batch, i)} | {(k, "id"): np.zeros(0, dtype=np.uint64) for k, x in _silent(batch, i) if x == "n"}
            got: dict[tuple[int, str], list] = {}
            for a in (a for c in batch.schema.names if c.startswith("answers") for a in batch.column(c)[i].as_py() or []):
                got.setdefault((a["level"], a["name"]), []).append((a["bucket"], a["value"], a["numbers"]))
            for (level, name), runs in got.items():
                runs.sort()
                values = [_unsmall(v) if name == "n" else _unpack(v, np.float32).astype(np.float64) for _, v, _ in runs]
                answers[level, name] = np.concatenate(values)
                if name == "n":
                    ids = np.zeros(len(answers[level, name]), dtype=np.uint64)
                    if level < model["depth"]:
                        ids[answers[level, name] >= _least_met(level, model["least"])] = np.concatenate([_unpack_keys(r) + np.uint64(bucket * (model["sizes"][level] // parts)) for bucket, _, r in runs])
                    answers[level, "id"] = ids
            yield row, answers


def _silent(batch: pa.RecordBatch, i: int) -> list[tuple[int, str]]:
    """Questions answered so far; a block that asked nothing gets an empty answer."""
    return [(int(x[:-1]), x[-1]) for x in (batch.column("asked")[i].as_py() or [])]


def _answered(level: int, name: str, gain: float, least: int, last: bool):
    """Add up a bucket's runs and answer each block; its rows arrive one bucket after the other.

    Grams that are met often enough get numbers from 0 by order of their keys, but not at the ``last`` level.
    """

    def finish(rows: list[tuple[int, bytes, bytes]]) -> tuple[list[tuple[int, bytes, bytes]], np.ndarray, int]:
        keys = [_unpack_keys(k) for _, k, _ in rows]
        u, at = np.unique(np.concatenate(keys), return_inverse=True)
        if name == "n":
            sums = np.bincount(at, weights=np.concatenate([_unsmall(v) for _, _, v in rows]).astype(np.float64)).astype(np.uint64)
        else:
            gains = np.concatenate([_unpack_states(v) for _, _, v in rows])
            all_ = np.stack([np.bincount(at, weights=gains[:, i], minlength=len(u)) for i in range(len(PRIORS))], axis=1)
            best = all_.argmax(axis=1)
            sums = np.where(all_.max(axis=1) > gain, PRIORS[best], 0).astype(np.float32)
        numbered = sums >= _least_met(level, least) if name == "n" and not last else np.zeros(len(u), dtype=bool)
        number = np.cumsum(numbered).astype(np.uint64) - np.uint64(1)
        out, pos = [], 0
        for (block, _, _), k in zip(rows, keys, strict=True):
            own = at[pos : pos + len(k)]
            pos += len(k)
            out.append((block, _small(sums[own]) if name == "n" else _pack(sums[own]), _pack_keys(number[own[numbered[own]]])))
        return out, sums, int(numbered.sum())

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(bucket, rows):
            out, sums, numbers = finish(rows)
            none = [None] * len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out] + [-1], pa.int64()), pa.array([level] * (len(out) + 1), pa.int32()), pa.array([name] * (len(out) + 1), pa.string()), pa.array([bucket] * (len(out) + 1), pa.int32()), pa.array([r[1] for r in out] + [b""], pa.binary()), pa.array([r[2] for r in out] + [b""], pa.binary()), pa.array([*none, int(sums.sum())], pa.int64()), pa.array([*none, int((sums > 0).sum())], pa.int64()), pa.array([*none, numbers], pa.int64())],
                names=["block", "level", "name", "bucket", "value", "numbers", "tokens", "kinds", "numbered"],
            )

        now, rows = None, []
        for batch in batches:
            for block, bucket, keys, value in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "keys", "value")), strict=True):
                if bucket != now and rows:
                    yield from emit(now, rows)
                    rows = []
                now = bucket
                rows.append((block, keys, value))
        if rows:
            yield from emit(now, rows)

    return run


def _cut(block_bytes: int):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, held, raw in text_blocks(batches, ["doc_id", "held", "_x"], "_x", block_bytes):
            h, counts = word_hashes([x or b"" for x in raw])
            ends = np.cumsum(counts)
            token = np.insert(h, ends, END)
            u, local, seen = np.unique(token, return_inverse=True, return_counts=True)
            _, order = _by_count(seen)
            rank = np.empty(len(u), dtype=np.uint64)
            rank[order] = np.arange(len(u), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64()))] + [pa.array([x], pa.binary()) for x in (_pack(counts + 1), _pack(~np.array(held, dtype=bool)), _pack_keys(u), _small(seen), _small(rank[local]))],
                names=["ids", "lengths", "training", "words", "counts", "local"],
            )

    return run


@released
def _scored(batches: Iterator[pa.RecordBatch], settings: dict) -> Iterator[pa.RecordBatch]:
    for row, answers in _blocks(batches, settings):
        b, p0, p, _ = _replay(row, answers, **settings["model"])
        n0 = answers[0, "n"][b.local]
        m = len(b.lengths)
        owner = np.repeat(np.arange(m), b.lengths)
        add = lambda x, owner=owner, m=m: np.bincount(owner, weights=x, minlength=m)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(~_unpack(row["training"], np.bool_)), pa.array(b.lengths, pa.int64()), pa.array(add(n0 > 0).astype(np.int64), pa.int64()), pa.array([settings["model"]["total"]] * m, pa.int64()), pa.array(add(np.log10(p0))), pa.array(add(np.log10(p)))],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )


def score(docs: DataFrame, held_out: Column, *, doc_id: str = "doc_id", text: str = "text", depth: int = 3, least: int = 8, gain: float = 2.0, block_bytes: int = 4 << 20) -> DataFrame:
    """log10 probability of every text under a suffix tree learned from the rows where ``held_out`` is false.

    Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per input
    row. Tokens are words, A-Z lower-cased, and one end per text. The root gives a token met
    c times (c + 0.5) / (N + 0.5 (V + 1)), all unknown words together one kind: ``base_score``.

    A state is a context of 1 to ``depth`` words met at least ``least`` times in training. Its distribution is
    (n(s, w) + k * parent(w)) / (n(s) + k), the parent being the longest kept suffix; k is the best of PRIORS.
    It is kept if it diverges from its parent: if the training tokens after it,
    each left out of its own counts, gain more than ``gain`` nats over the parent. Each token is scored
    by the longest kept state that ends before it. Contexts don't reach over texts.

    Words and contexts are known by 64-bit hashes. Null and empty texts are one end token; null ids and
    repeated rows are kept; other columns are left aside; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = pick(docs, doc_id=doc_id, _x=text)
    held = held_out
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.coalesce("_x", F.lit("")).alias("_x"))
    cut = rows.mapInArrow(_cut(block_bytes), "ids array<long>, lengths binary, training binary, words binary, counts binary, local binary")
    blocks = stored_by(cut.withColumn("block", F.monotonically_increasing_id()), "block", "tree-blocks", deal=False)
    parts = partitions(spark)
    model = {"depth": depth, "total": 0, "kinds": 0, "least": least, "sizes": []}
    answers: list[DataFrame] = []
    steps = [(0, "n")] + [(k, x) for k in range(1, depth + 1) for x in ("n", "s")]
    names = ["lengths", "training", "counts", "local"]

    def with_answers(asked: list[tuple[int, str]], more: list[str]) -> DataFrame:
        """Blocks with a column for the answers of each step; all lie in the same buckets."""
        out = blocks.select("block", *more, *names)
        for i, own in enumerate(answers):
            out = out.join(own.select("block", F.col("answers").alias(f"answers{i}")), "block", "left")
        return out.withColumn("asked", F.array(*[F.lit(f"{k}{x}") for k, x in asked]).cast("array<string>"))

    for i, (level, name) in enumerate(steps):
        settings = {"parts": parts, "model": dict(model)}
        asks = with_answers(steps[:i], [] if i else ["words"]).mapInArrow(lambda b, s=settings: _asked(b, s), "block long, bucket int, keys binary, value binary")
        got = asks.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
        got = got.mapInArrow(_answered(level, name, gain, least, level == depth), "block long, level int, name string, bucket int, value binary, numbers binary, tokens long, kinds long, numbered long").repartition(parts, "block")
        got = got.groupBy("block").agg(F.collect_list(F.struct("level", "name", "bucket", "value", "numbers")).alias("answers"), F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds"), F.max("numbered").alias("numbered"))
        got = stored_by(got, "block", "tree-answers", deal=False)
        if name == "n" and level < depth:
            with shuffles_freed(spark):
                r = got.where("block < 0").agg(F.sum("tokens"), F.sum("kinds"), F.max("numbered")).first()
            if not i:
                model |= {"total": r[0] or 0, "kinds": r[1] or 0}
                # only the first step asks about words by their hashes
                whole, blocks = blocks, stored_by(blocks.drop("words"), "block", "tree-blocks", deal=False)
                forget(whole)
            model["sizes"] = [*model["sizes"], parts * max(1, r[2] or 0)]
        answers.append(got)
    settings = {"parts": parts, "model": dict(model)}
    return with_answers(steps, ["ids"]).mapInArrow(lambda b: _scored(b, settings), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
