"""Byte-level BPE: a minimal perfect hash for whole pre-tokens, a heap over linked bytes for the rest."""

from __future__ import annotations

import base64
import heapq
import itertools
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, released
from .words import text_blocks

_STEP = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


class PerfectHash:
    """A minimal perfect hash from a fixed set of byte strings to their ids: n keys, n slots.

    Keys fall into n / 2 groups by one hash. Groups of two and more, largest first, take the
    first displacement that puts all their keys into free slots; groups of one point straight
    at a slot that is left (stored as -slot - 1). A lookup compares the stored key.
    """

    def __init__(self, ids: Mapping[bytes, int]):
        self.n = n = len(ids)
        self.groups = max(1, n // 2)
        self.moves = [0] * self.groups
        self.keys: list[bytes] = [b""] * n
        self.ids = [-1] * n
        members: dict[int, list[tuple[int, bytes]]] = {}
        for key in ids:
            h = xxhash.xxh3_64_intdigest(key)
            members.setdefault(h % self.groups, []).append((h, key))
        taken = bytearray(n)
        single = []
        for g, own in sorted(members.items(), key=lambda x: (-len(x[1]), x[0])):
            if len(own) == 1:
                single.append((g, own[0][1]))
                continue
            for d in itertools.count(1):
                slots = {self._slot(h, d) for h, _ in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
            self.moves[g] = d
            for h, key in own:
                s = self._slot(h, d)
                taken[s] = 1
                self.keys[s], self.ids[s] = key, ids[key]
        free = (s for s in range(n) if not taken[s])
        for (g, key), s in zip(single, free, strict=False):
            self.moves[g] = -s - 1
            self.keys[s], self.ids[s] = key, ids[key]

    def _slot(self, h: int, d: int) -> int:
        x = (h + d * _STEP) & _MASK
        x ^= x >> 29
        return ((x * 0xBF58476D1CE4E5B9 & _MASK) >> 32) % self.n

    def get(self, key: bytes) -> int:
        """The key's id, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.moves[h % self.groups]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.ids[s] if self.keys[s] == key else -1


class Ranks(dict):
    """Ranks of byte strings by a perfect hash (-1: none), of which the last ones asked for are kept."""

    def __init__(self, table: PerfectHash, most: int = 300_000):
        super().__init__()
        self.table, self.most = table, most

    def __missing__(self, key: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        r = self[key] = self.table.get(key)
        return r


def merge_bytes(piece: bytes, rank: Ranks) -> list[int]:
    """The ids of a piece by merges: always the pair of least rank, the leftmost of equals.

    Parts are linked both ways by their first bytes. ``pair[i]`` is the rank of the part at i
    joined with the next one; a heap entry that no longer agrees with it is stale.
    """
    n = len(piece)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pair = [rank[piece[i : i + 2]] for i in range(n - 1)]
    pair.append(-1)
    heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
    heapq.heapify(heap)
    while heap:
        x = heapq.heappop(heap)
        i = x & 0xFFFFFFFF
        if pair[i] != x >> 32:
            continue
        j = after[i]
        end = after[i] = after[j]
        pair[j] = pair[i] = -1
        if end < n:
            before[end] = i
            r = pair[i] = rank[piece[i : after[end]]]
            if r >= 0:
                heapq.heappush(heap, r << 32 | i)
        p = before[i]
        if p >= 0:
            r = pair[p] = rank[piece[p:end]]
            if r >= 0:
                heapq.heappush(heap, r << 32 | p)
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : after[i]]])
        i = after[i]
    return out


class Coder:
    """Encodes and decodes lists of texts; keeps the pieces met lately, at most ``memo`` of them."""

    def __init__(self, rank: PerfectHash, pattern: str, memo: int = 500_000):
        import regex

        self.find = regex.compile(pattern)
        self.rank, self.parts = rank, Ranks(rank)
        self.token = [b""] * (max(rank.ids, default=-1) + 1)
        for key, r in zip(rank.keys, rank.ids, strict=True):
            self.token[r] = key
        self.memo = memo
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.start = np.empty(1 << 12, dtype=np.int64)
        self.count = np.empty(1 << 12, dtype=np.int64)

    def _learn(self, pieces: list[str]) -> None:
        first, found, counts = len(self.code), [], []
        for i, p in enumerate(pieces, first):
            key = p.encode("utf-8", "surrogatepass")
            r = self.rank.get(key)
            ids = [r] if r >= 0 else merge_bytes(key, self.parts)
            self.code[p] = i
            found += ids
            counts.append(len(ids))
        last, end = len(self.code), self.used + len(found)
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while last > len(self.start):
            self.start, self.count = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.count))
        self.flat[self.used : end] = found
        self.count[first:last] = counts
        self.start[first:last] = self.used + np.cumsum([0, *counts[:-1]])
        self.used = end

    def encode(self, texts: list[str], chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); texts over ``chunk`` characters go through in runs of pieces."""
        ids, counts = [], []
        for text in texts:
            n = 0
            runs = [self.find.findall(text)] if len(text) <= chunk else iter(lambda it=self.find.finditer(text): [m.group() for m in itertools.islice(it, chunk // 8)], [])
            for pieces in runs:
                if not pieces:
                    continue
                get = self.code.get
                codes = list(map(get, pieces))
                if None in codes:
                    if len(self.code) > self.memo or self.used > 16 * self.memo:
                        self._clear()
                    self._learn([x for x in dict.fromkeys(pieces) if x not in self.code])
                    codes = list(map(self.code.__getitem__, pieces))
                at = np.array(codes)
                reps = self.count[at]
                ends = np.cumsum(reps)
                ids.append(self.flat[np.repeat(self.start[at] - ends + reps, reps) + np.arange(ends[-1])])
                n += int(ends[-1])
            counts.append(n)
        return np.concatenate(ids) if ids else np.empty(0, dtype=np.int32), np.array(counts, dtype=np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: on each line a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def perfect_hash(path: str) -> PerfectHash:
    return PerfectHash(load_ranks(path))


#: This worker's coder, by the vocabulary's broadcast and the pattern.
_CODERS: dict[tuple, Coder] = {}


def _coder(shipped, pattern: str) -> Coder:
    key = (id(shipped.value), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shipped.value, pattern)
    return _CODERS[key]


def encode_decode(docs: DataFrame, *, ranks_path: str, pattern: str, keep: list[str] | None = None, text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """Encode every text and decode the ids again: the columns ``keep`` (default: doc_id), ids array<int>, decoded binary; one row per input row.

    Each match of ``pattern`` is encoded alone: a whole match in the vocabulary gets its rank
    by the perfect hash, others by merges in rank order. No special tokens: their strings are
    ordinary text. ``ranks_path`` is read by the driver; the vocabulary, of fixed size, goes
    to the executors as a broadcast.

    Null and empty texts have no ids and decode to no bytes. Null ids and repeated rows are
    kept, other columns left aside, no rows give no rows. Texts of any length are encoded
    whole, in runs of pieces.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(perfect_hash(ranks_path))
    keep = ["doc_id"] if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]
    rows = pick(docs, **dict(zip(names, keep, strict=True)), _x=text).withColumn("_x", F.coalesce("_x", F.lit("")))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shipped, pattern)
        types: list[pa.DataType] = []

        def source() -> Iterator[pa.RecordBatch]:
            for b in batches:
                types[:] = [b.schema.field(n).type for n in names]
                yield b

        for *held, raw in text_blocks(source(), [*names, "_x"], "_x", block_bytes):
            ids, counts = coder.encode([x.decode("utf-8", "replace") for x in raw])
            ends = np.concatenate([[0], np.cumsum(counts)])
            listed = ids.tolist()
            decoded = [coder.decode(listed[a:b]) for a, b in itertools.pairwise(ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(h, type=t) for h, t in zip(held, types, strict=True)], pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(ids, type=pa.int32())), pa.array(decoded, type=pa.binary())],
                names=[*names, "ids", "decoded"],
            )

    return rows.mapInArrow(run, f"{kinds}, ids array<int>, decoded binary").toDF(*keep, "ids", "decoded")
