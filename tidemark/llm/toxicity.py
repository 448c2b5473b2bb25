"""Toxicity of texts by a factorization machine over hashed terms."""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .words import _hashes, _tables, mix, text_blocks

#: Terms are hashed into 2^BITS slots.
BITS = 20
#: A term's beginnings of these many bytes are terms too, where it is longer.
STEMS = (4, 6)
#: At most so many labelled texts of each label train the machine, those whose ids have the least hashes.
TRAIN_TEXTS = 4096
#: A slot is a feature if its presence speaks for or against the label by this much (likelihood ratio, G squared), the strongest MOST_TERMS of them.
LEAST_G, MOST_TERMS = 10.0, 8192
#: Dimensions of the factors.
RANK = 8


def term_slots(texts: list[bytes], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(slot, text number) of every term and stem; terms are runs of ASCII letters, lower-cased, and bytes beyond ASCII."""
    t = _tables()
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    low = joined | 0x20
    full = (joined >= 0x80) | ((low >= 97) & (low <= 122))
    edge = np.flatnonzero(np.diff(full.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *[len(x) + 1 for x in texts]])
    owner = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds)))
    down = (64 - bits,)
    keys, owners = [_hashes(joined, start, end, t["value"]) >> np.uint64(*down)], [owner]
    for size in STEMS:
        longer = end - start > size
        at = start[longer]
        packed = np.zeros(len(at), dtype=np.uint64)
        for k in range(size):
            packed = (packed << np.uint64(8)) | t["lower"][joined[at + k]].astype(np.uint64)
        keys.append(mix(packed + np.uint64(size << 56)) >> np.uint64(*down))
        owners.append(owner[longer])
    return np.concatenate(keys).astype(np.int32), np.concatenate(owners)


@dataclasses.dataclass
class Machine:
    """A factorization machine over the presence of terms: bias, a weight and a vector of factors for each kept slot."""

    slots: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    bits: int = BITS

    def margins(self, texts: list[bytes]) -> np.ndarray:
        """The log odds of each text."""
        slot, owner = term_slots(texts, self.bits)
        place = np.full(1 << self.bits, -1, dtype=np.int32)
        place[self.slots] = np.arange(len(self.slots), dtype=np.int32)
        kept = place[slot]
        pairs = np.unique(owner[kept >= 0].astype(np.int64) * max(1, len(self.slots)) + kept[kept >= 0])
        text, term = np.divmod(pairs, max(1, len(self.slots)))
        return _margin(self.bias, self.weight, self.factor, text, term, len(texts))[0]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margins(texts).clip(-40, 40)))


def _margin(bias: float, weight: np.ndarray, factor: np.ndarray, text: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(margins, sums of factors by text): bias + sum of weights + sum over pairs of terms of their factors' products."""
    own = factor[term]
    total = np.stack([np.bincount(text, weights=own[:, k], minlength=n) for k in range(factor.shape[1])], axis=1)
    squares = np.bincount(text, weights=(own * own).sum(axis=1), minlength=n)
    return bias + np.bincount(text, weights=weight[term], minlength=n) + 0.5 * ((total * total).sum(axis=1) - squares), total


def _telling(slot: np.ndarray, goal: np.ndarray, owner: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """The slots whose presence speaks for or against the label, ascending."""
    yes = np.bincount(slot, weights=(goal * weight)[owner], minlength=size)
    no = np.bincount(slot, weights=((1 - goal) * weight)[owner], minlength=size)
    seen = np.bincount(slot, minlength=size)
    all_yes, all_no = (goal * weight).sum(), ((1 - goal) * weight).sum()
    part = lambda o, e: o * np.log(np.where(o > 0, o / np.maximum(e, 1e-12), 1.0))
    have, lack, n = yes + no, all_yes + all_no - yes - no, all_yes + all_no
    g = 2 * (part(yes, have * all_yes / n) + part(no, have * all_no / n) + part(all_yes - yes, lack * all_yes / n) + part(all_no - no, lack * all_no / n))
    g[seen < 3] = 0
    best = np.argsort(-g, kind="stable")[:MOST_TERMS]
    return np.sort(best[g[best] >= LEAST_G])


def fit(rows: list[tuple[int, bytes]], weights: dict[int, float], *, rank: int = RANK, rounds: int = 300, rate: float = 0.05, ridge: float = 1e-3, bits: int = BITS, seed: int = 7) -> Machine:
    """Fit to (label, packed distinct slots) rows by Adam on the logistic loss; ``weights`` by label restore its share.

    Slots that tell nothing about the label are left out first. With one label only, or no rows, the machine is its bias alone.
    """
    goal = np.array([y for y, _ in rows], dtype=np.float64)
    has = np.array([weights[y] for y, _ in rows], dtype=np.float64)
    yes, no = float((goal * has).sum()), float(((1 - goal) * has).sum())
    bias = float(np.log((yes + 0.5) / (no + 0.5)))
    parts = [np.frombuffer(b, dtype=np.int32) for _, b in rows]
    slot = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    text = np.repeat(np.arange(len(rows)), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
    kept = _telling(slot, goal, text, has, 1 << bits) if yes and no else np.zeros(0, np.int64)
    place = np.full(1 << bits, -1, dtype=np.int64)
    place[kept] = np.arange(len(kept))
    term = place[slot]
    text, term = text[term >= 0], term[term >= 0]
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank))
    if not len(kept):
        return Machine(kept, bias, weight, factor, bits)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), weight, factor)]
    share = has / has.sum()
    for turn in range(1, rounds + 1):
        z, total = _margin(bias, weight, factor, text, term, len(rows))
        miss = (1 / (1 + np.exp(-z.clip(-40, 40))) - goal) * share
        push = miss[text][:, None] * (total[text] - factor[term])
        grads = [np.array([miss.sum()]), np.bincount(term, weights=miss[text], minlength=len(kept)) + ridge * weight,
                 np.stack([np.bincount(term, weights=push[:, k], minlength=len(kept)) for k in range(rank)], axis=1) + ridge * factor]
        steps = []
        for g, s in zip(grads, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            steps.append(rate * (s[0] / (1 - 0.9**turn)) / (np.sqrt(s[1] / (1 - 0.999**turn)) + 1e-8))
        bias, weight, factor = bias - float(steps[0][0]), weight - steps[1], factor - steps[2]
    return Machine(kept, bias, weight, factor, bits)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, labels, texts in text_blocks(batches, ["doc_id", "label", "_x"], "_x", 1 << 22):
        slot, owner = term_slots([t or b"" for t in texts])
        pairs = np.unique(owner.astype(np.int64) << BITS | slot)
        cuts = np.searchsorted(pairs >> BITS, np.arange(len(texts) + 1))
        own = (pairs & ((1 << BITS) - 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int32()), pa.array([own[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", "label", "slots"])


def train(docs: DataFrame, labels: DataFrame, taught: Column | None = None, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", train_texts: int = TRAIN_TEXTS) -> Machine:
    """A machine from ``train_texts`` labelled texts of each label at most.

    ``labels`` has (doc_id, label 0 or 1); ``taught`` is a condition on its rows' doc_id. What reaches the driver is the
    packed distinct slots of the chosen texts. The two labels' shares among all taught rows weigh the rows.

    Rows without id or label teach nothing; of several labels of an id the larger counts, of several rows of an id the
    one with the least slots; labels of absent ids are passed over. No labelled rows give even odds for all.
    """
    known = pick(labels, doc_id=doc_id, label=label).where("doc_id is not null and label in (0, 1)")
    known = known.where(taught) if taught is not None else known
    known = known.groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], {})
    order = F.xxhash64("doc_id")
    chosen = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(train_texts) for y in sorted(counts)]
    chosen = chosen[0] if len(chosen) == 1 else chosen[0].union(chosen[1])
    # two times train_texts rows of two numbers, whatever the input's size
    own = pick(docs, doc_id=doc_id, _x=text).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", "_x")
    rows = own.mapInArrow(_packed, "doc_id long, label int, slots binary").groupBy("doc_id", "label").agg(F.min("slots").alias("slots")).orderBy("doc_id").collect()
    got = {y: sum(r["label"] == y for r in rows) for y in counts}
    return fit([(r["label"], bytes(r["slots"])) for r in rows], {y: counts[y] / max(1, got[y]) for y in counts})


def score(docs: DataFrame, machine: Machine, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score double from 0 to 1, predicted int), one per input row, from the whole text alone.

    The machine goes along with the tasks (at most MOST_TERMS * (RANK + 2) numbers). No shuffle.
    Null and empty texts have the score of no terms; null ids and repeated rows are kept; other columns are left aside; no rows give no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_blocks(batches, ["doc_id", "_x"], "_x", 1 << 22):
            s = machine.scores([t or b"" for t in texts])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return pick(docs, doc_id=doc_id, _x=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(work, "doc_id long, score double, predicted int")
