"""Source divergence, periodic runs and toxicity: brute force, held-out texts, and odd tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from tidemark.llm import divergence, repeats, toxicity
from tidemark.llm.common import crc_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, "other") for r in rows], SCHEMA)


def divergence_by_hand(rows, least_docs, top):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    rows = [(words(t), lang or "", source or "") for _, t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        seen = collections.Counter(w for t, la, _ in rows if la == lang for w in set(t))
        kept = sorted(w for w, n in seen.items() if n >= least_docs)

        def shares(docs, kept=kept):
            c = collections.Counter(w for t in docs for w in t if w in set(kept))
            total = sum(c.values())
            return c, {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * len(kept)) for w in kept}

        _, whole = shares([t for t, la, _ in rows if la == lang])
        own = {s: shares([t for t, la, so in rows if (la, so) == (lang, s)]) for s in {r[2] for r in rows if r[1] == lang}}
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        for s, (c, p) in own.items():
            pairs = sorted(((-sum(gap(p[w], q[w]) for w in kept), o.encode(), o) for o, (_, q) in own.items() if o != s))
            terms = sorted((-gap(p[w], whole[w]), w.encode(), w) for w in kept if c[w] and p[w] > whole[w])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, found in (("pair", pairs), ("term", terms)) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def test_divergence_by_brute_force(spark):
    rng = random.Random(5)
    words = ["Tide", "gauge", "élan", "Élan", "x1y", "dune's", "ﬀ", "水位", "𐐀𐐁", "reef", "kelp", "Zo\x7fo"]
    rows = [(i, " ".join(rng.choice(words[rng.randrange(4) :]) for _ in range(rng.randrange(1, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(1, None, "en", "only-null"), (2, "", "xx", "a"), (3, "12 34", "xx", "b"), (4, rows[0][1], "en", "a"), (4, rows[0][1], "en", "a"), (None, "reef " * 4000, "en", "long")]
    got = divergence.audit(frame(spark, rows).repartition(3), least_docs=10, top_terms=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == divergence_by_hand(rows, 10, 4)


def test_divergence_shares_are_exact_beyond_64_bits(spark):
    n, total, size = 5 * 10**12 + 7, 9 * 10**13 + 1, 12345
    got = spark.createDataFrame([(n, total, size)], "n long, t long, s long").select(divergence._share("n", "t", "s").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * size)


def runs_by_hand(w, least):
    out = []
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            start = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p) and not any(all(w[t] == w[t + q] for t in range(start, i + p - q)) for q in range(1, p)):
                out.append((start, i + p - start, p))
            i += i == start
    return sorted(out, key=lambda t: (t[0], t[2]))


def words_of(rng):
    n, size = rng.randrange(0, 60), rng.choice([1, 2, 3, 5, 40])
    w = [f"w{rng.randrange(size)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randrange(1, 12)
        w = [w[i] if i < a else w[a + (i - a) % p] if a + (i - a) % p < n else "z" for i in range(n)]
    return w


def test_lyndon_arrays_and_runs_by_brute_force():
    rng = random.Random(2)
    for _ in range(1500):
        w = [hash(x) % 97 for x in words_of(rng)]
        for sign in (1, -1):
            nxt, agree = repeats.lyndon_array(w, sign)
            signed = [sign * x for x in w]
            for i in range(len(w)):
                want = next((j for j in range(i + 1, len(w)) if signed[j:] < signed[i:]), len(w))
                assert nxt[i] == want
                if want < len(w):
                    assert agree[i] == next((x for x in range(len(w) - want) if w[i + x] != w[want + x]), len(w) - want)
        for least in (2, 12):
            assert repeats.runs(w, least) == runs_by_hand(w, least)
        text = [str(x).encode() for x in w]
        assert repeats.text_runs(text) == runs_by_hand(w, 12)


def test_lyndon_arrays_take_linear_time():
    a, b = [0], [0, 1]
    while len(b) < 30000:
        a, b = b, b + a
    steps = 0

    class Counted(list):
        def __getitem__(self, i):
            nonlocal steps
            steps += 1
            return list.__getitem__(self, i)

    for w in (b, [0] * 30000, [0, 1, 0] * 10000, list(range(300)) * 100):
        steps = 0
        repeats.lyndon_array(Counted(w))
        assert steps < 14 * len(w)


def test_runs_of_documents(spark):
    rng = random.Random(9)
    texts = [rng.choice([" ", "\n", "\t \v"]).join(words_of(rng)) for _ in range(150)]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(900, None, "en", "s"), (901, "", None, None), (902, " \n ", "en", "s"), (None, "é b " * 50, "en", "s"), (903, "a" * 50000, "en", "s"), (904, "to be or " * 9000, "en", "s"), (1, texts[1], "en", "s")]
    docs = frame(spark, rows).repartition(3)
    got = repeats.digest(repeats.collapse_runs(repeats.with_planted_runs(docs))).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", by_id[r.doc_id] or "")
        h = zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode())
        n, g = len(w), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = runs_by_hand(w, 12) if n < 3000 else [(0, n, 3)] if h % 10 else None
        if runs is None:
            continue
        best = max(runs, key=lambda t: (t[1], -t[0], -t[2]), default=None)
        drop = {i for s, length, p in runs for i in range(s + p, s + length)}
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest()


FILLER = [f"{a}{b}{c}" for a, b, c in itertools.product(["sand", "tide", "reef"], ["ing", "al", "o"], ["ra", "ne", "ti", "lo"])]


def text_with(rng, insult, group):
    w = [rng.choice(FILLER) for _ in range(rng.randrange(20, 200))]
    for x in ([rng.choice(["dolt", "oaf", "churl"])] if insult else []) + ([rng.choice(["northerners", "weavers", "lefties"])] if group else []):
        w.insert(rng.randrange(len(w)), x.upper() if rng.random() < 0.2 else x)
    return " ".join(w)


def test_toxicity_of_pairs_that_no_sum_of_weights_can_tell(spark):
    """Insult and group together are toxic, each alone is not, and both alone are as frequent as clean texts."""
    rng = random.Random(4)
    made = [(i, rng.random() < 0.5, rng.random() < 0.5) for i in range(1500)]
    docs = frame(spark, [(i, text_with(rng, a, b), "en", "s") for i, a, b in made])
    labels = spark.createDataFrame([(i, 1, int(a and b)) for i, a, b in made], "doc_id long, quality int, toxic int")
    machine = toxicity.train(docs, labels, crc_fold("doc_id", 5) != 0)
    got = {r.doc_id: r for r in toxicity.score(docs, machine).collect()}
    held = [(i, a and b) for i, a, b in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    # the odds of both exceed the sum of what each adds alone
    z = machine.margins([b"", b"dolt", b"weavers", b"dolt weavers"])
    assert z[3] - z[0] > (z[1] - z[0]) + (z[2] - z[0]) + 1


def test_toxicity_of_odd_tables(spark):
    rng = random.Random(8)
    rows = [(i, text_with(rng, i % 3 == 0, i % 3 == 0), "en", "s") for i in range(300)]
    rows += [(300, None, None, None), (301, "", "en", "s"), (None, "dolt weavers", "en", "s"), (3, rows[3][1], "en", "s"), (3, "another text", "en", "s"), (302, "dolt weavers " * 20000, "en", "s")]
    docs = frame(spark, rows).repartition(4)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 0), (None, 1), (7, None), (99999, 1), (300, 0)], "doc_id long, toxic int")
    a, b = toxicity.train(docs, labels), toxicity.train(docs.repartition(2), labels)
    assert a.slots.tolist() == b.slots.tolist() and a.weight.tolist() == b.weight.tolist()
    got = toxicity.score(docs, a).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in got if r.doc_id in (300, 301)} == {float(a.scores([b""])[0])}
    assert [r.predicted for r in got if r.doc_id is None] == [1]
    # one label only, or none: the bias alone
    for own in (labels.where("toxic = 0"), labels.where("toxic > 5")):
        m = toxicity.train(docs, own)
        assert not len(m.slots) and len({r.score for r in toxicity.score(docs, m).collect()}) == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert not divergence.audit(empty).collect() and not repeats.digest(repeats.collapse_runs(repeats.with_planted_runs(empty))).collect()
    machine = toxicity.train(empty, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not toxicity.score(empty, machine).collect() and machine.scores([b"any"])[0] == pytest.approx(0.5)
