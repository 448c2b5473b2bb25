"""The suffix tree's scores against a tree in plain Python over all texts."""

import collections
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidemark.llm import suffixtree
from tidemark.llm.common import crc_fold

END = ("end",)  # a tuple, so that no word equals it


def plain_scores(texts, training, depth, least, gain):
    """(states kept, score of each text)."""
    said = [[w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", x or "")] + [END] for x in texts]
    seen = collections.Counter(tuple(t[i : i + k]) for t, ok in zip(said, training, strict=True) if ok for k in range(1, depth + 2) for i in range(len(t) - k + 1))
    total = sum(n for g, n in seen.items() if len(g) == 1)
    kinds = sum(len(g) == 1 for g in seen)
    tree = {}

    def p(t, i):
        x = (seen[(t[i],)] + 0.5) / (total + 0.5 * (kinds + 1))
        for k in range(1, min(i, depth) + 1):
            s = tuple(t[i - k : i])
            if s in tree:
                x = (seen[(*s, t[i])] + tree[s] * x) / (seen[s] + tree[s])
        return x

    for k in range(1, depth + 1):
        gains = collections.defaultdict(lambda: [0.0] * len(suffixtree.PRIORS))
        for t, ok in zip(said, training, strict=True):
            for i in range(k, len(t) if ok else 0):
                s = tuple(t[i - k : i])
                if seen[s] >= least:
                    q = p(t, i)
                    for j, prior in enumerate(suffixtree.PRIORS):
                        gains[s][j] += math.log((seen[(*s, t[i])] - 1 + prior * q) / ((seen[s] - 1 + prior) * q))
        tree |= {s: suffixtree.PRIORS[g.index(max(g))] for s, g in gains.items() if max(g) > gain}
    return len(tree), [sum(math.log10(p(t, i)) for i in range(len(t))) for t in said]


@pytest.mark.parametrize(("depth", "least", "block_bytes"), [(3, 8, 4 << 20), (2, 3, 20000)])
def test_scores_by_a_plain_tree(spark, depth, least, block_bytes):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, x) for i, x in enumerate([None, "", " \t\n", "The THE the", "É é É", "x" * 20000, "a b c a b c a b d " * 300])]
    docs = table.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).repartition(5)
    rows = docs.collect()
    training = [zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for r in rows]
    states, want = plain_scores([r.text for r in rows], training, depth, least, 2.0)
    got = {r.doc_id: r for r in suffixtree.score(docs, crc_fold("doc_id", 5) == 1, depth=depth, least=least, block_bytes=block_bytes).collect()}
    assert states > 300 and len(got) == len(rows)
    for r, ok, x in zip(rows, training, want, strict=True):
        assert got[r.doc_id].score == pytest.approx(x, rel=1e-6, abs=1e-9) and got[r.doc_id].held_out is not ok


def shuffled(spark):
    """Bytes that each stage so far has written for shuffles, by its id."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_what_moves_is_small(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    size = docs.agg(F.sum(F.length("text"))).first()[0]
    before = shuffled(spark)
    assert suffixtree.score(docs, crc_fold("doc_id", 5) == 1, block_bytes=1 << 19).agg(F.count("*")).first()[0] == docs.count()
    moved = sum(n for k, n in shuffled(spark).items() if k not in before)
    # blocks, 64-bit keys and five gains for each context took 2.1 times the texts' size
    assert 0 < moved < 1.3 * size


@pytest.mark.parametrize("bits", [2, 3, 9, 16])
def test_keys_of_pairs_are_distinct(bits):
    found = suffixtree._spread(np.arange(1 << bits, dtype=np.uint64), bits)
    assert sorted(found.tolist()) == list(range(1 << bits))
    assert suffixtree._bits(1 << 70) == 64 and len(set(suffixtree._spread(np.arange(1000, dtype=np.uint64), 64).tolist())) == 1000


def test_states_of_few_and_many_tokens():
    r = np.random.default_rng(3)
    met = np.array([0, 1, 2, 3, 4, 40, 0, 1])
    owner = np.repeat(np.arange(len(met)), met)
    held = r.integers(50, 90, len(met)).astype(float)
    here, q = r.integers(1, 50, len(owner)).astype(float), r.uniform(1e-6, 0.1, len(owner))
    want = np.zeros((len(met), len(suffixtree.PRIORS)))
    for o, n, x in zip(owner, here, q, strict=True):
        want[o] += np.log((n - 1 + suffixtree.PRIORS * x) / ((held[o] - 1 + suffixtree.PRIORS) * x))
    packed = suffixtree._pack_states(met, held, owner, here, q)
    assert np.allclose(suffixtree._unpack_states(packed), want, rtol=1e-6, atol=1e-6)
    assert suffixtree._unpack_states(suffixtree._pack_states(met[:0], held[:0], owner[:0], here[:0], q[:0])).shape == (0, len(suffixtree.PRIORS))
    assert suffixtree._unpack_states(suffixtree._pack_states(met[:1], held[:1], owner[:0], here[:0], q[:0])).tolist() == [[0.0] * len(suffixtree.PRIORS)]
