"""Operators for training data against brute force, and on nulls, empty tables, ties and odd columns."""

import collections
import hashlib
import itertools
import math
import os
import random
import subprocess
import sys
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import bagminhash, bpe, langid, linedup, mixing, nndescent, pii, quality, sharding, suffixtree
from tidemark.llm.common import components, crc_fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, Text string"
WORDS = "the of and a to in is it that was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "er"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [prose(rng, rng.randrange(8, 120)) for _ in range(40)]
    out = [(i, t, "en", f"src{i % 3}", len(t), "x") for i, t in enumerate(base)]
    for i in range(12):  # near copies: a word changed
        w = base[i].split(" ")
        w[len(w) // 2] = "changed"
        out.append((100 + i, " ".join(w), "en", "src0", 0, "x"))
    out += [(200 + i, base[1], "en", "src0", 0, None) for i in range(15)]
    out += [(300, None, None, None, None, None), (301, "", "en", "", 0, ""), (302, " \n\t ", "en", "s", 3, ""), (None, "no id here at all", "en", "s", 0, ""), (303, "Ab cd", "fr", "s", 5, ""), (304, "ab CD", "fr", "s", 5, ""), (300, None, None, None, None, None), (305, "word " * 3000, "en", "s", 0, "")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_near_duplicates(docs, rows):
    got = bagminhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    bags = {}
    for d, t, *_ in rows:
        w = tokens(t)
        bags[d] = collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    root = {d: d for d in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([d for d in bags if d is not None and bags[d]], 2):
        if sum((bags[a] & bags[b]).values()) >= 0.8 * sum((bags[a] | bags[b]).values()):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    for r in got:
        if r.doc_id is not None:
            assert r.class_id == find(r.doc_id), r
    kept = collections.Counter(r.class_id for r in got if r.kept and r.worded)
    assert set(kept.values()) == {1}


def test_keep_one_keeps_columns(docs, rows):
    out = bagminhash.keep_one(docs)
    assert out.columns == docs.columns
    ids = [r[0] for r in out.collect()]
    assert ids.count(300) == 2 and 200 not in ids and 1 in ids


def test_suffix_tree_base(docs, rows):
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    c = collections.Counter()
    for d, t, *_ in rows:
        if not held(d):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    for r in suffixtree.score(docs, crc_fold("doc_id", 5) == 1).collect():
        t = [x[1] for x in rows if x[0] == r.doc_id][0]
        own = [*tokens(t), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own))
        assert r.score <= 0


def test_lines(docs, rows):
    got = {r.doc_id: r for r in linedup.dedup_lines(docs, keep=["doc_id", "text"]).collect()}
    assert got[200].n_removed == 1 and got[200].text == "" and got[1].n_removed == 0
    assert got[300].text is None and got[301].text == "" and got[304].text == "ab CD"


def test_pii(spark):
    text = "mail jo.doe@mail.example.com or 10.0.0.300, 192.168.1.7; card 4111 1111 1111 1111 tel +1 (288) 555-5549 é"
    found = pii.digest(pii.find_spans(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))).orderBy("doc_id").collect()
    spans = []
    for kind, piece in (("email", "jo.doe@mail.example.com"), ("ip", "192.168.1.7"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (288) 555-5549")):
        at = text.index(piece)
        spans.append((at, f"{kind}:{at}:{at + len(piece)}"))
    want = ",".join(s for _, s in sorted(spans))
    assert found[0].base_sha256 == hashlib.sha256(want.encode()).hexdigest() and found[0].n_ip == 1
    assert found[1].spans == "" == found[2].spans


def test_pii_classifier_learns_from_text(spark):
    """Where the labelers are silent, words seen with their votes decide: held-out numbers without any cue."""
    rng = random.Random(4)
    number = lambda: f"{rng.randrange(200, 999)} {rng.randrange(200, 999)} {rng.randrange(1000, 9999)}"
    rows = []
    for _ in range(150):
        rows.append((len(rows), f"please reach me by phone {number()} today", None))
        rows.append((len(rows), f"warehouse stock item order {number()} shipped", None))
    for _ in range(40):
        rows.append((len(rows), f"please reach me by {number()} today", True))
        rows.append((len(rows), f"warehouse stock item {number()} shipped", False))
    truth = {i: t for i, _, t in rows}
    found = pii.find_spans(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), accept=0.0).collect()
    chance = {r.doc_id: r.spans[0]["chance"] for r in found}
    assert min(chance[i] for i, t in truth.items() if t) > max(chance[i] for i, t in truth.items() if t is False)


def test_pii_secrets(spark):
    rng = random.Random(8)
    code = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    rows, want = [], {}
    for i in range(60):
        c = code()
        text = (f'the api_key = "{c}" was set', f"see commit {c} of it", "a-long-dashed-name-of-2024-pages and " + prose(rng, 30), f"é token: {c}, then")[i % 4]
        rows.append((i, text))
        want[i] = f"secret:{text.index(c)}:{text.index(c) + 40}" if i % 4 in (0, 3) else ""
    rows += [(60, "x1" * 9000), (61, None), (0, rows[0][1])]
    found = pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id < 60:
            assert (r.spans, r.base_sha256, r.n_card) == (want[r.doc_id], hashlib.sha256(b"").hexdigest(), 0), rows[r.doc_id]


def test_bpe_is_tiktoken(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", None, "Hello wörld 日本  \n\n x", "a" * 3000, "<|endoftext|>", "thandreinghestion " * 50, "😀é" * 40]
    got = bpe.encode_decode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), ranks_path=path, pattern=public_tokenizers.PATTERN).collect()
    for r in got:
        t = texts[r.doc_id] or ""
        assert r.ids == own.encode_ordinary(t) and bytes(r.decoded) == t.encode()


def test_bpe_of_odd_tables(spark):
    """No rows, repeated rows, null ids, clashing columns, and texts far over the length of any word."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(21)
    long = [prose(rng, 9000), "".join(rng.choice("xyzqkvj") for _ in range(40000)), "\n" * 20000, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(12000))]
    made = [(i, t, None, "s", 0, "other") for i, t in enumerate(long)] + [(0, long[0], None, "s", 0, None), (None, "no id", None, None, None, None)]
    for rows in (made, []):
        got = bpe.encode_decode(spark.createDataFrame(rows, SCHEMA).repartition(3), ranks_path=path, pattern=public_tokenizers.PATTERN).collect()
        want = [(d, tuple(own.encode_ordinary(t)), t.encode()) for d, t, *_ in rows]
        assert sorted(((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in got), key=str) == sorted(want, key=str)


def test_language_of_odd_tables(spark):
    """Long texts, ties, repeated rows and columns named like the new ones."""
    rng = random.Random(22)
    words = {a: ["".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(200)] for a in ("etaoin", "zkwyxq")}
    say = lambda letters, n: " ".join(rng.choice(words[letters]) for _ in range(n))
    schema = "doc_id long, text string, lang string, lang_pred string, score int, Text string"
    taught = [(100 * k + i, say(a, 200), x, "old", 5, "other") for k, (x, a) in enumerate((("aa", "etaoin"), ("bb", "zkwyxq"))) for i in range(40)]
    known = langid.train(spark.createDataFrame(taught, schema))
    asked = [(1, say("etaoin", 30000), None, "old", 5, None), (2, say("zkwyxq", 30000), None, None, None, None), (3, None, None, None, None, None), (3, None, None, None, None, None), (4, "12 34 !", None, None, None, None), (None, say("etaoin", 300), None, None, None, None), (1, say("etaoin", 300), None, None, None, None)]
    got = langid.identify(spark.createDataFrame(asked, schema).repartition(2), known, keep=["doc_id"]).collect()
    assert sorted(((r.doc_id, r.lang_pred) for r in got), key=str) == sorted([(1, "aa"), (2, "bb"), (3, "und"), (3, "und"), (4, "und"), (None, "aa"), (1, "aa")], key=str)
    assert all(0 <= r.score <= 1 for r in got)
    # languages taught by the same texts tie, and nothing decides between them
    same = [(i, t[1], x, None, None, None) for i, (t, x) in enumerate((t, x) for t in taught[:40] for x in ("aa", "bb"))]
    tied = langid.identify(spark.createDataFrame(asked[:1], schema), langid.train(spark.createDataFrame(same, schema)), keep=["doc_id"]).first()
    assert tied.rejected and tied.margin == 0


def test_pfair_lag():
    shares = mixing.whole_shares({"a": 7, "b": 2.5, "c": 0.5, None: 1}, 100)
    assert sum(shares.values()) == 100
    done = collections.Counter()
    for t, (x, _, _) in enumerate(sorted(mixing.edf_period(shares, 100), key=lambda p: p[2]), 1):
        done[x] += 1
        assert all(abs(done[s] - t * a / 100) < 1 for s, a in shares.items())


def test_mixing_keeps_all(docs, rows):
    got = mixing.mix(docs, block_docs=4).collect()
    assert len(got) == len(rows)
    places = [(r.slot, r.pos_in_block) for r in got]
    assert len(set(places)) == len(places)


def test_shards_fit(docs, rows):
    got = sharding.shards(docs, limit_bytes=2000).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard, r.overflow] += r.bytes
    alone = {r.bytes for r in got if r.bytes > 2000}
    assert all(s <= 2000 or s in alone for s in sizes.values())


def test_same_ids_overflow(spark):
    got = sharding.shards(spark.createDataFrame([(1, "x" * 40)] * 50, "doc_id long, text string").repartition(3), limit_bytes=100).collect()
    assert len(got) == 50 and max(r.shard_bytes for r in got) <= 100


def test_language(spark, docs):
    rng = random.Random(1)
    fr = "le la de et un que les des est pour dans pas sur avec ce il sont être même très où".split()
    texts = [(i, prose(rng, 60), "en") for i in range(40)] + [(100 + i, " ".join(rng.choice(fr) for _ in range(60)), "fr") for i in range(40)]
    known = langid.train(spark.createDataFrame(texts, "doc_id long, text string, lang string"))
    assert set(known) == {"en", "fr"}
    probe = spark.createDataFrame([(1, prose(rng, 30)), (2, " ".join(rng.choice(fr) for _ in range(30))), (3, None), (4, "12 !"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(probe, known, keep=["doc_id"]).collect()}
    assert got == {1: "en", 2: "fr", 3: "und", 4: "und", 5: "und"}


def test_quality_counts(docs, rows):
    for r in quality.judge(docs).collect():
        text = [x[1] for x in rows if x[0] == r.doc_id][0] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    out, n = [], 0
    for label in (1, 2, None):
        for size in (1, 1, 2, 3, 40, *[1] * 40):
            c = rng.normal(size=16)
            for _ in range(size):
                out.append((n, (c + 0.08 * rng.normal(size=16)).tolist(), label))
                n += 1
    out += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [], 1), (n + 4, out[0][1], 1), (n + 5, out[0][1], 1)]
    got = {r.vec_id: r for r in nndescent.near_vectors(spark.createDataFrame(out, "vec_id long, embedding array<double>, label int")).collect()}
    good = [(i, np.array(v) / np.linalg.norm(v)) if lab is not None and v and np.isfinite(v).all() and np.any(v) else None for i, v, lab in out]
    lab = {i: x for i, _, x in out}
    links = collections.defaultdict(set)
    for a, b in itertools.combinations([g for g in good if g], 2):
        if lab[a[0]] == lab[b[0]] and a[1] @ b[1] >= 0.93:
            links[a[0]].add(b[0])
            links[b[0]].add(a[0])
    for i, *_ in out:
        reach, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - reach:
                reach.add(j)
                todo.append(j)
        assert (got[i].n_links, got[i].component_id) == (len(links[i]), min(reach)), i


def test_empty_tables(spark, empty):
    assert bagminhash.near_duplicates(empty).count() == 0
    assert suffixtree.score(empty, crc_fold("doc_id", 5) == 1).count() == 0
    assert linedup.dedup_lines(empty, keep=["doc_id", "text"]).count() == 0
    assert pii.find_spans(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert sharding.shards(empty).count() == 0
    assert quality.judge(empty).count() == 0
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert nndescent.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines(spark):
    rng = random.Random(11)
    abc = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(abc) for _ in range(rng.randint(2, 9)))
    pairs = []
    for words in (2, 3, 5, 10, 20, 50):
        for _ in range(25):
            line = " ".join(word() for _ in range(words))
            other, most = line, rng.choice((0.08, 0.1, 0.13)) * len(line)
            for _ in range(max(1, int(most))):
                i = rng.randrange(len(other))
                other = rng.choice((other[:i] + rng.choice(abc) + other[i + 1 :], other[:i] + other[i + 1 :], other[:i] + rng.choice(abc) + other[i:]))
            pairs.append((line, other))
    rows = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    got = {r.doc_id: r.n_removed for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [distance(*[" ".join(x.split()) for x in p]) <= math.floor(0.1 * max(len(" ".join(x.split())) for x in p) + 1e-9) for p in pairs]
    found = [got[2 * i + 1] == 1 for i in range(len(pairs))]
    assert not any(f and not n for f, n in zip(found, near, strict=True)) and not any(got[2 * i] for i in range(len(pairs)))
    assert sum(near) >= 60 and sum(f and n for f, n in zip(found, near, strict=True)) >= 0.97 * sum(near)


def test_word_change_and_table_rows(spark):
    words = [f"word{i * 7919 % 1000}" for i in range(40)]
    texts = [" ".join(words[: k]) for k in (10, 20, 40)]
    rows = [(i, x) for i, x in enumerate([*texts, *[" ".join([*x.split()[:-3], "changed", *x.split()[-2:]]) for x in texts], "| 1999 | Alpha | 12 |", "| 2004 | Omega | 77 |"])]
    got = {r.doc_id: r.n_removed for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_template_lines_however_many(spark):
    rng = random.Random(11)
    rows = [(i, f"Your order {rng.randrange(10**7, 10**8)} has left our house and will reach you by the end of next week, thank you") for i in range(1500)]
    prosaic = [(1500 + i, prose(rng, 30)) for i in range(300)]
    got = {r.doc_id: r.n_removed for r in linedup.dedup_lines(spark.createDataFrame(rows + prosaic, "doc_id long, text string")).collect()}
    assert got[0] == 0 and all(got[i] == 1 for i in range(1, 1500)) and not any(got[i] for i, _ in prosaic)


def test_candidate_pairs_come_once_a_key():
    rng = np.random.default_rng(3)
    sketch = np.repeat(rng.integers(0, 256, (20, linedup.SKETCH), dtype=np.uint8), 5, axis=0)
    sketch[rng.random(sketch.shape) < 0.2] = 7
    key, size = np.sort(rng.integers(0, 4, 100)).astype(np.uint64), np.full(100, 9000, dtype=np.uint16)
    got = [tuple(sorted(p)) for i, j, _ in linedup._near_pairs(key, size, sketch, 0.9) for p in zip(i.tolist(), j.tolist(), strict=True)]
    same = sketch[:, None] == sketch[None]
    want = set()
    for i in range(100):
        for j in range(i):
            at = int(key[i]) % 3 * linedup.SECOND
            if key[i] == key[j] and same[i, j].sum() >= linedup.AGREE and same[i, j, at : at + linedup.SECOND].any():
                want.add((j, i))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_last_links_by_brute_force():
    """Lines of one key are compared where they are: links are no more than lines and join what all pairs join."""
    rng = random.Random(14)
    lines = []
    for _ in range(4):
        base = prose(rng, 40)
        for _ in range(30):
            at = set(rng.sample(range(len(base)), rng.randrange(len(base) // 12)))
            lines.append("".join(rng.choice("abcdef") if i in at else c for i, c in enumerate(base)).lower())
    lines = sorted({" ".join(x.split()) for x in lines})
    chars, keys, sketch, _ = linedup.line_minima([x.encode() for x in lines])
    size = np.minimum(np.log(chars) * linedup._LOG, 65535).astype(np.int32)
    tried = [(i + 1) % len(lines) for i in range(len(lines))]
    rows = sorted((int(k), i) for i in range(len(lines)) for k in set(keys[i].tolist()))
    cols = {"key": [k for k, _ in rows], "id": [i for _, i in rows], "size": [int(size[i]) for _, i in rows], "root": [i for _, i in rows], "tried": [tried[i] for _, i in rows], "again": [tried[i] for _, i in rows],
            "sketch": [sketch[i].tobytes() for _, i in rows], "keys": [sorted(set(keys[i].tolist())) for _, i in rows], "norm": [lines[i] for _, i in rows]}
    table = pa.table({k: pa.array(v, pa.int32() if k == "size" else None) for k, v in cols.items()})
    links = [(r["a"], r["b"]) for b in linedup._links_apart(iter(table.to_batches(max_chunksize=37)), 0.9) for r in b.to_pylist()]
    want = []
    for i in range(len(lines)):
        for j in range(i):
            met = {int(k) % 3 for k in set(keys[i].tolist()) & set(keys[j].tolist())}
            same = sketch[i] == sketch[j]
            if same.sum() >= linedup.AGREE and any(same[8 * c : 8 * c + 8].any() for c in met) and tried[i] != j and tried[j] != i:
                if distance(lines[i], lines[j]) <= math.floor(0.1 * max(len(lines[i]), len(lines[j])) + 1e-9):
                    want.append((j, i))

    def parts(pairs):
        root = list(range(len(lines)))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    assert set(links) <= set(want) and parts(links) == parts(want) and len(links) < len(lines) < len(want)


def test_free_memory_goes_back_after_a_task():
    script = """
import re
from tidemark.llm.common import released
def taken():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()).group(1)) / 1024
pins = []
@released
def task(n):
    held = []
    for i in range(n):
        held.append(b"x" * (2000 + i % 7))
        if i % 1000 == 999:
            pins.append(b"y" * (2000 + i % 7))
    yield len(held)
before = taken()
assert list(task(60_000)) == [60_000]
assert taken() - before < 40, taken() - before
"""
    subprocess.run([sys.executable, "-c", script], check=True, timeout=120)


def test_runs_of_characters_tell_lines_apart():
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(80))
    xs = [line() for _ in range(300)]
    ys = []
    for x in xs:  # exactly as many edits as are allowed
        at = rng.sample(range(len(x)), len(x) // 10)
        ys.append("".join("Z" if i in set(at) else c for i, c in enumerate(x)))
    most = np.array([len(x) // 10 for x in xs])
    assert not linedup._far(xs, ys, most).any() and linedup._far(xs, ys[1:] + ys[:1], most).all()


def test_hopeless_distances_end_early():
    rng = random.Random(13)
    xs = ["".join(rng.choice("abcd") for _ in range(rng.randrange(150, 160))) for _ in range(60)]
    ys = []
    for i, x in enumerate(xs):  # by thirds: as many edits as are allowed, one more, another text
        at = set(rng.sample(range(len(x)), len(x) // 10 + i % 3))
        ys.append("".join("Z" if k in at else c for k, c in enumerate(x)) if i % 3 < 2 else xs[i - 1])
    most = np.array([max(len(x), len(y)) // 10 for x, y in zip(xs, ys, strict=True)])
    want = [distance(x, y) <= d for x, y, d in zip(xs, ys, most, strict=True)]
    assert 0 < sum(want) < 60 and linedup.within(xs, ys, most).tolist() == want


def test_pairs_of_similar_size_are_compared_together(monkeypatch):
    rng = random.Random(4)
    xs = ["".join(rng.choice("abcdef") for _ in range(n)) for n in range(120, 168)]
    ys = ["".join("-" if rng.random() < 0.1 else c for c in x)[: len(x) - i % 12] for i, x in enumerate(xs)]
    most = np.array([len(x) // 10 for x in xs])
    groups, run = [], linedup._distances
    monkeypatch.setattr(linedup, "_distances", lambda *a: groups.append(len(a[0])) or run(*a))
    want = [distance(x, y) <= d for x, y, d in zip(xs, ys, most, strict=True)]
    assert 0 < sum(want) < len(want) and linedup.within(xs, ys, most).tolist() == want
    assert len(groups) == 1


def test_short_lines_repeat(spark):
    rows = [(1, "Read more\n\n完全に同じ行です。空白はありません\nx\nMenu"), (2, "read  MORE\n\n完全に同じ行です。空白はありません\ny\nMenu")]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "\ny"}


def test_pipeline_keeps_mixture(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sizes = {"a": 900, "b": 400, "c": 100}
    rows = [(i, f"text {i}", "en", x, 8) for i, x in enumerate(x for x, n in sizes.items() for _ in range(n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    corpus_pipeline.mixed(spark, docs, "").repartition(5).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.tokens(spark, spark.read.parquet(str(tmp_path / "mixed")), "").orderBy("slot", "pos_in_block", "doc_id").collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    shares = mixing.whole_shares({x: n**0.5 for x, n in sizes.items()}, 1000)
    for slots in (10, 20, 40):
        blocks = {x: len({r.slot for r in got if r.source == x and r.slot < slots}) for x in sizes}
        left = [x for x in sizes if max(r.slot for r in got if r.source == x) >= slots]
        assert left and all(abs(blocks[x] - slots * shares[x] / 1000) < 1 for x in left)


def test_isolated_pairs_are_found(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=(150, 24))
    out = [(2 * i + j, (c[i] + 0.2 * rng.normal(size=24)).tolist(), 1) for i in range(150) for j in range(2)]
    x = np.array([v for _, v, _ in out])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.93).sum(axis=1) - 1
    got = nndescent.near_vectors(spark.createDataFrame(out, "vec_id long, embedding array<double>, label int"), trees=1, leaf=4, rounds=1, audit=200)
    assert want.sum() > 100 and {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(want.tolist()))


def test_rare_links_are_found_by_the_search_alone(spark, monkeypatch):
    """In 6000 vectors 30 pairs link: the audit asks 256 vectors, never all, and what it sees isn't added to the links."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 24))
    for i in range(30):
        u = rng.normal(size=24)
        u -= (u @ x[i]) * x[i] / (x[i] @ x[i])
        c = rng.uniform(0.935, 0.99)
        x[3000 + i] = c * x[i] + np.sqrt(1 - c * c) * np.linalg.norm(x[i]) / np.linalg.norm(u) * u
    asked = []
    whole = nndescent._ask_all
    monkeypatch.setattr(nndescent, "_ask_all", lambda queries, threshold: asked.append(len(queries.value)) or whole(queries, threshold))
    got = nndescent.near_vectors(spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int"), audit=256).collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (y @ y.T >= 0.93).sum(axis=1) - 1
    assert asked == [256] and want.sum() >= 60
    assert {r.vec_id: r.n_links for r in got} == dict(enumerate(want.tolist()))
    assert len(got) == 6000 and min(r.audit_recall for r in got) >= 0.99


def test_narrow_margins_are_rejected(spark):
    rng = random.Random(4)
    parts = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 4))) for _ in range(150)] for x, a in (("en", "etaoinshrdlu"), ("fr", "esaitnrulodcé"), ("xx", "zkvwyjqpbgmf"))}

    def say(lang, n):
        return " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(n))

    labelled = [(1000 * k + i, say(x, 300), x) for k, x in enumerate(("en", "fr")) for i in range(80)]
    known = langid.train(spark.createDataFrame(labelled, "doc_id long, text string, lang string"))
    clean = [(i, say(("en", "fr")[i % 2], (20, 100, 1500)[i % 3])) for i in range(60)]
    junk = [(100 + i, say("xx", (100, 400, 3000)[i % 3])) for i in range(30)]
    mixed = [(200 + i, " ".join(say(("en", "fr")[k % 2], 10) for k in range(100))) for i in range(10)]
    got = {r.doc_id: r.rejected for r in langid.identify(spark.createDataFrame(clean + junk + mixed, "doc_id long, text string"), known, keep=["doc_id"]).collect()}
    assert not any(got[i] for i, _ in clean) and all(got[i] for i, _ in junk + mixed)


def test_exact_weights():
    shares = mixing.exact_shares({"a": 1, "b": 1, "c": 1}, 1000)
    assert shares == {"a": 1, "b": 1, "c": 1} and mixing.exact_shares({"a": 0.5, "b": 1}, 1000) is None
    shares = mixing.exact_shares({"a": 7, "b": mixing.Fraction(5, 3), None: 2}, 1000)
    assert shares == {None: 6, "a": 21, "b": 5}
    done, period = collections.Counter(), sum(shares.values())
    for t, (x, _, _) in enumerate(sorted(mixing.edf_period(shares, period), key=lambda p: p[2]), 1):
        done[x] += 1
        assert all(abs(done[s] - t * a / period) < 1 for s, a in shares.items())


def test_mixing_order_by_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)] + [(7, "a"), (7, "a")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string").repartition(5), weights={"a": 2, "b": 1, "c": 1, None: 1}, block_docs=4).collect()
    key = lambda d: hashlib.md5(str(d).encode()).hexdigest()
    places = {}
    for slot, x in enumerate([x for x, _, _ in sorted(mixing.edf_period({None: 1, "a": 2, "b": 1, "c": 1}, 5), key=lambda p: p[2])] * 60):
        places.setdefault(x, []).append(slot)
    for x in ("a", "b", "c", None):
        own = sorted((key(d), d) for d, s in rows if s == x)
        want = [(d, places[x][i // 4], i % 4) for i, (_, d) in enumerate(own)]
        assert sorted((r.doc_id, r.slot, r.pos_in_block) for r in got if r.source == x) == sorted(want)


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(1, "x" * 40, 5)] * 50 + [(i, "y" * (i % 30), i) for i in range(2, 200)] + [(None, None, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "s"), limit_bytes=200)
    got = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, (r[:3] for r in got.select("doc_id", "text", "n").collect()))) == sorted(str(tuple(r)) for r in rows)
    assert max(r[0] for r in got.groupBy("_shard").agg({"*": "count"}).select("count(1)").collect()) < 50


def components_of(pairs):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root if find(x) != x}


@pytest.mark.parametrize("pairs", [[(1, 2)], [(5, i) for i in range(6, 30)], [(i, i + 1) for i in range(40)], [(1, 2), (3, 2), (10, 11), (11, 10), (12, 12)]])
def test_components(spark, pairs):
    got = {r.id: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == components_of(pairs)


def test_edit_distances():
    rng = random.Random(2)
    xs, ys = [], []
    for n in (0, 1, 3, 20, 60):
        for _ in range(25):
            x = "".join(rng.choice("abé日 ") for _ in range(n))
            y = list(x)
            for _ in range(rng.randrange(0, 6)):
                i = rng.randrange(len(y) + 1)
                y[i : i + rng.randrange(2)] = rng.choice(["", "a", "zz"])
            xs.append(x)
            ys.append("".join(y))
    d = np.array([distance(x, y) for x, y in zip(xs, ys, strict=True)])
    for most in (0, 1, 2, 5, 70):
        limit = np.full(len(xs), most)
        assert (linedup.within(xs, ys, limit) == (d <= most)).all() and not (linedup._far(xs, ys, limit) & (d <= most)).any()


def test_pii_base_by_re(spark):
    rng = random.Random(9)
    bits = ["a@b.co", "x.y@mail.example.org", "@", ".", "1.2.3.4", "256.1.1.1", "10.0.0.1.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (288) 555-5549", "+44 20 7946", "é", " ", " and ", "+", "12", "-", "(", "日"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for i in range(400)] + [(400, None), (401, ""), (402, "z " * 9000 + "q@w.de"), (7, "a@b.co"), (7, "a@b.co")]
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 12 <= len(d := re.sub("[^0-9]", "", x)) <= 19 and sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 9 <= len(re.sub("[^0-9]", "", x)) <= 15),
    }
    want = collections.Counter()
    for i, t in rows:
        spans = [(m.start(), n, f"{k}:{m.start()}:{m.end()}") for n, (k, (p, ok)) in enumerate(kinds.items()) for m in re.finditer(p, t or "") if ok(m[0])]
        want[i, hashlib.sha256(",".join(s for _, _, s in sorted(spans)).encode()).hexdigest()] += 1
    got = collections.Counter((r.doc_id, r.base_sha256) for r in pii.digest(pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    assert got == want


def test_pipeline_end_to_end(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    letters = {"en": "etaoinshrdlu", "fr": "esaitnrulodcé"}
    parts = {x: ["".join(rng.choice(a) for _ in range(rng.randint(2, 4))) for _ in range(150)] for x, a in letters.items()}
    say = lambda x, n: " ".join(rng.choice(parts[x]) + rng.choice(parts[x]) for _ in range(n))
    rows = [(i, say(("en", "fr")[i % 2], 120) + "\n" + say(("en", "fr")[i % 2], 30), ("en", "fr")[i % 2], f"s{i % 3}", 0) for i in range(160)]
    common = say("en", 12)
    rows += [(200 + i, say("en", 90) + "\n" + common, "en", "s0", 0) for i in range(6)]  # a line in several documents
    near = say("en", 200).split(" ")
    rows += [(300 + i, " ".join([*near[: 50 + 20 * i], "other", *near[51 + 20 * i :]]), "en", "s1", 0) for i in range(3)]  # words changed: lines of over 0.9, so the first stays
    rows += [(400, "12 345 !", "en", "s1", 0), (401, None, None, None, None), (402, "", "en", "s2", 0)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "d" / "documents.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path / "d")).collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near", "mixed", "tokens"]
    assert set(got) == {*range(160), *range(200, 206), 300} and all(r.round_trip for r in got.values())
    assert all(got[i].lang == ("en", "fr")[i % 2] for i in range(160))
    assert len({(r.slot, r.pos_in_block) for r in got.values()}) == len(got)
    docs = spark.read.parquet(str(tmp_path / "d" / "documents.parquet"))
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert kept[200].endswith(common) and all(kept[i] == rows[160 + i - 200][1].split("\n")[0] for i in range(201, 206)) and all(kept[i] == rows[i][1] for i in range(160))


def test_lines_of_documents_by_brute_force(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no documents")
    texts = [r.text for r in spark.read.parquet(path).select("text").collect()]
    lines = sorted({x for t in texts if t for x in (linedup._normal_bytes(y.encode()).decode() for y in t.split("\n")) if 9 <= len(x) <= 3000}, key=lambda x: (len(x), x))
    n = np.array([len(x) for x in lines])
    counts = np.zeros((len(lines), 128), dtype=np.int16)
    for i, x in enumerate(lines):
        counts[i] = np.bincount(np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32) % 128, minlength=128)
    pairs = []
    for i in range(len(lines)):
        to = int(np.searchsorted(n, int(n[i] / 0.9 + 1e-6), side="right"))
        # an edit changes the counts of characters by two at most
        near = np.abs(counts[i + 1 : to] - counts[i]).sum(axis=1) <= 2 * np.floor(0.1 * n[i + 1 : to] + 1e-9)
        pairs += [(i, i + 1 + j) for j in np.flatnonzero(near).tolist()]
    links = []
    for at in range(0, len(pairs), 8192):
        some = [p for p in pairs[at : at + 8192]]
        xs, ys = [lines[i] for i, _ in some], [lines[j] for _, j in some]
        most = np.array([math.floor(0.1 * len(y) + 1e-9) for y in ys])
        open_ = np.flatnonzero(~linedup._far(xs, ys, most))
        good = open_[linedup.within([xs[k] for k in open_], [ys[k] for k in open_], most[open_])]
        links += [some[k] for k in good]
    want = components_of(links)
    got = {r.doc_id for r in linedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).where("n_removed = 1").collect()}
    assert len(want) > 50 and not got - set(want) and len(got) >= 0.98 * len(want)
