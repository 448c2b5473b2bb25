"""Cutoffs that follow what a language and source are like."""

import random
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tidemark.llm import quality


def test_cutoffs_follow_the_spread(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda n, words=100, sign="": " ".join(word(n) for _ in range(words)) + " " + " ".join(sign for _ in range(60) if sign)
    rows = [("tight", text(5 + (i % 20 == 0))) for i in range(200)] + [("wide", text(3 + i % 8)) for i in range(200)]
    rows += [("tight", "\n".join([text(5, 10) for _ in range(8)] + [text(5, 10)] * 12)) for _ in range(12)]
    asked = [(f"{lang}-{what}", lang, x) for lang in ("tight", "wide") for what, x in (("usual", text(5)), ("long", text(9)), ("signs", text(5, sign="#")))]
    lines = "\n".join(text(5, 10) for _ in range(9))
    asked += [("tight-few", "tight", lines + "\n" + lines.split("\n")[0]), ("tight-many", "tight", "\n".join([text(5, 10) for _ in range(60)] + [x for x in [text(5, 10)] for _ in range(25)])), ("tight-short", "tight", text(5, 40))]
    docs = [(f"{i}", lang, x) for i, (lang, x) in enumerate(rows)] + asked
    table = spark.createDataFrame([(i, lang, "s", x) for i, lang, x in docs], "doc_id string, lang string, source string, text string")
    got = {r.doc_id: r for r in quality.judge(table).collect()}
    assert sum(r.kept for r in got.values()) >= 380
    assert [got[f"tight-{x}"].kept for x in ("usual", "long", "signs", "few", "many", "short")] == [True, False, False, True, False, False]
    assert [got[f"wide-{x}"].kept for x in ("usual", "long", "signs")] == [True, True, False]
    assert got["tight-short"].base_failed and not got["tight-many"].base_failed
    # as many again of each group change no verdict
    twice = {(r.doc_id, r.kept) for r in quality.judge(table.unionAll(table)).collect()}
    assert twice == {(r.doc_id, r.kept) for r in got.values()}
