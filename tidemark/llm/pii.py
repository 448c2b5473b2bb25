"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides."""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, stored
from .quality import let

#: Kinds in the order in which spans at the same place are listed. Secrets (credentials) have no strict pattern.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

#: Strict patterns. A match can only begin where a run of its first characters begins, or where the last match
#: ended; that, and possessive repeats, keep the leftmost longest match and save the regex engine from trying every place.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser patterns, whose spans only the method can add. Cards that fail the checksum are candidates too.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[](?:at|AT|@)[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+.-])(?<![0-9)]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9+/_=.-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{16,}+={0,2}+",
}
#: Cheap signs without which a pattern can't match.
SIGN = {"email": "@", "phone": "+"}

#: Gazetteers, by the part of a span that they judge.
TOP_DOMAINS = "com org net edu gov mil int info biz io co me us uk de fr es it nl be ch at pt pl se no dk fi ie ca mx br ar au nz jp cn in ru eu"
CARD_PREFIX = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|3[0689]|35)"
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-69][0-9]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|85[0-9]|88[06]|9[679][0-9])"
#: Words shortly before a span that speak for the kind, and words that speak against all kinds.
CUES = {
    "email": "mail|contact|write|correo|schreib|courriel|reply",
    "ip": r"\bip\b|host|server|address|adresse|login|client|from",
    "card": "card|visa|credit|pay|karte|carte|tarjeta|master|amex",
    "phone": r"phone|\btel|call|fax|mobil|handy|telefon|téléphone|llam",
    "secret": "token|secret|passw|key|auth|bearer|credential|login",
}
#: Names of credentials, and of other long codes, when they stand right before the span.
SECRET_NAME = r"(?:token|secret|passw\w*|pwd|key|auth\w*|bearer|credential\w*)[^\p{L}\p{N}]*$"
CODE_NAME = r"(?:sha\d*|md5|commit|checksum|digest|hash|uuid|guid|etag|revision|file|path)[^\p{L}\p{N}]*$"
AGAINST = r"version|isbn|issn|order|invoice|serial|token|\bid\b|\bref\b|\bv$|build|sku|tracking"

LABELERS = ("regex", "gazetteer", "context", "shape", "border")
#: A span's features are slots of its kind: the first FIXED for bias, votes and size, the others for hashes of the words
#: around it and of three-character pieces of its shape (letters and digits masked).
SLOTS, FIXED = 1024, 16
#: At most so many candidates of each kind train the classifier, those with the least hashes.
TRAIN_SPANS = 4000
#: Spans are added when the classifier gives them at least this probability.
ACCEPT = 0.9


def _find(text: Column, pattern: str, flag: int) -> Column:
    """Matches as array<struct<s, e, m, flag>>: places from the lengths of what lies between them."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("array<struct<s:int,e:int,m:string,f:int>>").alias("out"))
    none = F.array().cast("array<struct<s:int,e:int,m:string,f:int>>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        one = F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"), F.lit(flag).alias("f")))
        return F.struct(e.alias("at"), F.concat(F.coalesce(acc["out"], none), one).alias("out"))

    def fold(g: Column, m: Column) -> Column:
        return F.when(F.size(m) == 0, none).otherwise(F.aggregate(F.zip_with(F.slice(g, F.lit(1), F.size(m)), m, lambda a, b: F.struct(a.alias("g"), b.alias("m"))), start, step)["out"])

    return let(found, lambda m: let(gaps, lambda g: fold(g, m)))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' checksum is right."""
    back = F.reverse(digits)
    one = lambda d, i: F.substring(d, i, F.lit(1)).cast("int")
    total = let(back, lambda d: F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, one(d, i)).otherwise(F.when(one(d, i) > 4, 2 * one(d, i) - 9).otherwise(2 * one(d, i)))))
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return m.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(_digits(m))
    return F.length(_digits(m)).between(9, 15)


def _votes(kind: str, text: Column, x: Column, base: Column) -> list[Column]:
    """The labelers' votes on a span: 1 for, -1 against, 0 silent."""
    m, before = x["m"], F.lower(F.substring(text, F.greatest(F.lit(1), x["s"] - 39), F.least(F.lit(40), x["s"])))
    vote = lambda yes, no=None: F.when(yes, 1).when(no if no is not None else ~yes, -1).otherwise(0)
    if kind == "email":
        gazetteer = vote(F.array_contains(F.lit(TOP_DOMAINS.split()), F.lower(F.regexp_extract(m, "([A-Za-z0-9-]+)$", 1))))
        shape = vote(m.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{1,63}[@ (\[].{4,}$") & ~m.rlike(r"\.\."))
    elif kind == "ip":
        gazetteer = vote(~m.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."))
        shape = vote(~m.rlike(r"(?:^|\.)0[0-9]") & (F.length(m) >= 9), m.rlike(r"^[0-9](?:\.[0-9]){3}$") | m.rlike(r"(?:^|\.)0[0-9]"))
    elif kind == "card":
        gazetteer = vote(_digits(m).rlike(CARD_PREFIX))
        shape = vote(m.rlike(r"^(?:[0-9]{15,16}|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})$"))
    elif kind == "secret":
        gazetteer = vote(before.rlike(SECRET_NAME), before.rlike(CODE_NAME))
        shape = vote(m.rlike(r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?:[^0-9]*[0-9]){3}.*)$"), m.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-|[a-z]{6}|^[0-9/_+-]*$"))
    else:
        gazetteer = vote(_digits(m).rlike(CALLING_CODE) & m.startswith("+"), m.startswith("+"))
        shape = vote(F.length(_digits(m)).between(10, 13) & ~m.rlike(r"[\x20().-]{3,}"))
    against = CODE_NAME if kind == "secret" else AGAINST
    context = F.when(before.rlike(against), -1).when(before.rlike(CUES[kind]), 1).otherwise(0)
    around = F.concat(F.substring(text, x["s"], F.when(x["s"] > 0, 1).otherwise(0)), F.lit("\n"), F.substring(text, x["e"] + 1, F.lit(1)))
    border = vote(~around.rlike(r"(?s)^[\p{L}\p{N}_]|[\p{L}\p{N}_]$"))
    strict = vote(before.rlike(r"[:=]\s*[\"']?$")) if kind == "secret" else F.when(base, 1).when(x["f"] == 1, -1).otherwise(0)
    return [strict, gazetteer, context, shape, border]


_SPAN = "array<struct<kind:int,s:int,e:int,base:boolean,votes:array<int>,slots:array<int>>>"


def _slots(kind: str, text: Column, x: Column, votes: Column) -> Column:
    """The slots of a span's features, each once."""
    words = lambda part: F.filter(F.split(F.regexp_replace(F.lower(part), "[0-9]", "0"), r"[^\p{L}0_]+"), lambda w: w != "")
    named = lambda mark, found: F.transform(F.slice(found, F.lit(1), F.lit(3)), lambda w, i: F.concat(F.lit(mark), i.cast("string"), w))
    before = F.reverse(words(F.substring(text, F.greatest(F.lit(1), x["s"] - 39), F.least(F.lit(40), x["s"]))))
    after = words(F.substring(text, x["e"] + 1, F.lit(24)))
    ends = F.concat(F.lit("^"), F.substring(x["m"], 1, 12), F.lit("~"), F.substring(x["m"], -12, 12), F.lit("$"))
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(ends, "[0-9]", "0"), r"\p{Ll}", "a"), r"\p{Lu}", "A")
    pieces = let(shape, lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.concat(F.lit("s"), F.substring(c, i, F.lit(3)))))
    hashed = F.transform(F.concat(named("b", before), named("a", after), pieces), lambda f: (F.lit(FIXED) + F.pmod(F.xxhash64(f), F.lit(SLOTS - FIXED))).cast("int"))
    n = len(LABELERS)
    cast = F.filter(F.transform(votes, lambda v, i: F.when(v == 1, 1 + i).when(v == -1, 1 + n + i)), lambda v: v.isNotNull())
    size = F.least(F.lit(3), F.floor((x["e"] - x["s"]) / 8)).cast("int") + 1 + 2 * n
    return F.transform(F.array_distinct(F.concat(F.array(F.lit(0), size), cast, hashed)), lambda f: f + KINDS.index(kind) * SLOTS)


def _candidates(text: Column) -> Column:
    """All candidate spans of a text, kind by kind, with the labelers' votes."""
    none = F.array().cast(_SPAN)

    def of(kind: str, pattern: str, strict: bool) -> Column:
        def row(x: Column) -> Column:
            base = _passes(kind, x["m"]) if strict else F.lit(False)
            span = lambda b, v: F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), b.alias("base"), v.alias("votes"), _slots(kind, text, x, v).alias("slots"))
            return let(base, lambda b: let(F.array(*_votes(kind, text, x, b)), lambda v: span(b, v)))

        found = F.transform(_find(text, pattern, int(strict)), row).cast(_SPAN)
        if not strict and kind == "email":
            return F.when(text.rlike(r"[(\[](?:at|AT|@)[)\]]"), found).otherwise(none)
        return F.when(text.contains(SIGN[kind]), found).otherwise(none) if strict and kind in SIGN else found

    return F.concat(*[of(k, p, True) for k, p in STRICT.items()], *[of(k, p, False) for k, p in LOOSE.items()])


def estimate(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[int, dict]:
    """Reliabilities of the labelers by expectation-maximisation, one model per kind.

    ``patterns``: (kind, votes, number of spans). The model: a span is real with probability
    p, and labelers vote on their own given that. Per kind: p, and for each labeler the
    chances of its three votes on real and on unreal spans. Starts from trust in the votes.
    """
    out = {}
    for kind in {k for k, _, _ in patterns}:
        own = [(v, n) for k, v, n in patterns if k == kind]
        post = [1 / (1 + math.exp(-1.5 * sum(v) - v[0])) for v, _ in own]
        for _ in range(rounds):
            real = sum(q * n for q, (_, n) in zip(post, own, strict=True))
            total = sum(n for _, n in own)
            p = (real + 1) / (total + 2)
            chance = []
            for i in range(len(LABELERS)):
                # one pseudo-count for each vote, three more for the vote that should be usual
                yes = {x: 1.0 + 3 * (x == 1) + sum(q * n for q, (v, n) in zip(post, own, strict=True) if v[i] == x) for x in (-1, 0, 1)}
                no = {x: 1.0 + 3 * (x == -1) + sum((1 - q) * n for q, (v, n) in zip(post, own, strict=True) if v[i] == x) for x in (-1, 0, 1)}
                chance.append(({x: y / sum(yes.values()) for x, y in yes.items()}, {x: y / sum(no.values()) for x, y in no.items()}))
            post = []
            for v, _ in own:
                z = math.log(p / (1 - p)) + sum(math.log(chance[i][0][x] / chance[i][1][x]) for i, x in enumerate(v))
                post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        out[kind] = {"share": p, "chance": chance, "posterior": {v: q for (v, _), q in zip(own, post, strict=True)}}
    return out


def fit(rows: list[tuple[int, tuple[int, ...], list[int]]], model: dict[int, dict], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """A logistic span classifier, trained on the EM posteriors: a weight for each slot of each kind.

    ``rows``: (kind, votes, slots) of the training spans. A feature seen with votes of one sort speaks for its spans
    where the labelers are silent; that is what the classifier adds to EM. Steps are scaled by how often a slot occurs.
    """
    weights = np.zeros(len(KINDS) * SLOTS)
    for kind, m in sorted(model.items()):
        own = [(s, m["posterior"][v]) for k, v, s in rows if k == kind]
        if not own:
            continue
        sizes = np.array([len(s) for s, _ in own])
        slots, at = np.concatenate([np.array(s) for s, _ in own]), np.repeat(np.arange(len(own)), sizes)
        goal = np.array([q for _, q in own])
        seen = np.bincount(slots, minlength=len(weights))
        pace = rate / (sizes.max() * (seen / len(own)).clip(0.05))
        for _ in range(rounds):
            z = np.bincount(at, weights=weights[slots], minlength=len(own)).clip(-30, 30)
            miss = 1 / (1 + np.exp(-z)) - goal
            weights -= 4 * pace * (np.bincount(slots, weights=miss[at], minlength=len(weights)) / len(own) + ridge * weights * (seen > 0))
    return weights.tolist()


def _chance(x: Column, weights: Column) -> Column:
    """The classifier's probability of a span."""
    return 1 / (1 + F.exp(-F.aggregate(x["slots"], F.lit(0.0), lambda a, f: a + F.get(weights, f))))


def find_spans(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", accept: float = ACCEPT, train_spans: int = TRAIN_SPANS) -> DataFrame:
    """Spans of personal data: rows (doc_id, spans array<struct<kind, start, end, base, chance>>), one per input row.

    Places count code points, ends exclusive; spans are ordered by start, then kind. Base spans (strict pattern and
    check passed) always stay. Looser candidates, such as cards with a wrong checksum or spelt-out addresses, are added where
    the classifier gives at least ``accept`` and no base span overlaps. Five labelers vote on every candidate of the
    corpus; the driver sees how often each pattern of votes occurs (at most 5 * 3^5 rows, over all candidates), runs EM over
    it, and trains the classifier on the posteriors of ``train_spans`` candidates of each kind at most, by their votes, the words around them
    and their shape. Secrets (values of tokens, keys, passwords) are only ever added.

    Null and empty texts have no spans; null ids and repeated rows are kept; other columns are left aside; no rows give no rows.
    """
    rows = pick(docs, doc_id=doc_id, _x=text).withColumn("_x", F.coalesce("_x", F.lit("")))
    # only texts with a digit or an at sign can hold a candidate
    may = F.col("_x").rlike(r"[0-9][\x20.-]?[0-9]|@|[(\[](?:at|AT)[)\]]|\+[0-9]|[A-Za-z0-9+/_-]{16}")
    none = F.array().cast(_SPAN)
    found = stored(rows.select("doc_id", F.when(may, _candidates(F.col("_x"))).otherwise(none).alias("_c")), "pii-candidates")
    spans = found.where(F.size("_c") > 0).select("doc_id", F.explode("_c").alias("x")).select("doc_id", "x.*")
    patterns = {(r["kind"], tuple(r["votes"])): r["n"] for r in spans.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}
    model = estimate([(k, v, n) for (k, v), n in sorted(patterns.items())])
    ranked = spans.select("kind", "votes", "slots", F.xxhash64("doc_id", "s", "e").alias("_h"))
    taken = [ranked.where(F.col("kind") == k).orderBy("_h", "votes", "slots").limit(train_spans).drop("_h") for k in sorted(model)]
    rows = functools.reduce(DataFrame.unionAll, taken).collect() if taken else []
    weights = F.split(F.lit(",".join(map(repr, fit([(r["kind"], tuple(r["votes"]), r["slots"]) for r in rows], model)))), ",").cast("array<double>")
    judged = lambda x: F.struct(x["s"].alias("start"), x["kind"].alias("kind"), x["e"].alias("end"), x["base"].alias("base"), _chance(x, weights).alias("chance"))

    def choose(c: Column) -> Column:
        return let(F.filter(c, lambda x: x["base"]), lambda b: F.array_sort(F.concat(b, F.filter(c, lambda x: ~x["base"] & (x["chance"] >= accept) & ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))))

    return found.select("doc_id", let(F.transform("_c", judged), choose).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans)."""
    count = lambda i: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == i))).cast("long")
    base = written(F.filter("spans", lambda x: x["base"]))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)], F.sha2(base.cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
