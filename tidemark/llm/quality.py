"""Quality rules whose cutoffs come from quantile sketches of each language and source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_BREAK, pick, stored

SYMBOLS = "[#*$%&|<>]"
#: Measures that get adaptive cutoffs.
MEASURES = ("word_len", "symbols", "dup_lines", "repeats")
#: The measures that are shares, as counts of a part and of the whole.
SHARES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "_lines"), "repeats": ("n_repeat_words", "n_words")}
#: A document fails beyond this many spreads from its group's quartiles, and a count only beyond as many deviations of chance.
FENCE = 3
#: Groups of fewer documents take the quartiles of their language.
LEAST_GROUP = 100
#: Sketches keep the first bits of a number: buckets as wide as 1/32 of their values.
SKETCH_BITS = 5


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value worked out once (a plain column would be put in wherever it is named)."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _covered(order: Column, words: Column, key: Callable[[Column], Column], place: Callable[[Column], Column]) -> Column:
    """Number of words in three-word windows that occur twice, from the windows ordered by hash."""

    def same(a: Column, b: Column) -> Column:
        return (key(a) == key(b)) & F.forall(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(words, place(a).cast("int") + k) == F.get(words, place(b).cast("int") + k))

    twice = F.filter(order, lambda x, k: F.coalesce(same(x, F.get(order, k - 1)), F.lit(False)) | F.coalesce(same(x, F.get(order, k + 1)), F.lit(False)))
    return let(
        F.sort_array(F.transform(twice, lambda x: place(x).cast("long"))),
        lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, k + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, b: a + b),
    )


def repeated_words(words: Column) -> Column:
    """Words within three-word windows found twice or more in ``words``, the first included."""
    window = lambda w, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    places = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    low = F.lit((1 << 17) - 1).cast("long")

    def packed(w: Column) -> Column:
        # hash and place in one long, which sorts fast; equal words are checked word by word
        return let(F.sort_array(F.transform(places(w), lambda i: F.shiftleft(window(w, i), 17).bitwiseOR(i.cast("long")))), lambda s: _covered(s, w, lambda x: F.shiftright(x, 17), lambda x: x.bitwiseAND(low)))

    def apart(w: Column) -> Column:
        return let(F.array_sort(F.transform(places(w), lambda i: F.struct(window(w, i).alias("h"), i.alias("i")))), lambda s: _covered(s, w, lambda x: x["h"], lambda x: x["i"]))

    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) <= 1 << 17, packed(w)).otherwise(apart(w)))


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The base counts of each document, with its language and source."""
    rows = pick(docs, doc_id=doc_id, lang=lang, source=source, _x=text).withColumn("_x", F.coalesce("_x", F.lit("")))
    words = F.filter(F.split("_x", WORD_BREAK), lambda w: w != "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    lines = let(F.filter(F.split("_x", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    rows = rows.select("doc_id", "lang", "source", counts.alias("_c"), lines.alias("_l"), F.regexp_count("_x", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return rows.select("doc_id", "lang", "source", "_c.n_words", "_c.word_chars", "n_symbols", F.col("_l.n").alias("_lines"), F.col("_l.dup").alias("n_dup_lines"), "_c.n_repeat_words")


def _share(part: str, whole: str, unit: int) -> Column:
    return F.expr(f"CASE WHEN {whole} > 0 THEN ({unit} * {part}) div {whole} ELSE 0 END")


def _values() -> dict[str, Column]:
    return {"word_len": _share("word_chars", "n_words", 100), "symbols": _share("n_symbols", "word_chars", 10000), "dup_lines": _share("n_dup_lines", "_lines", 10000), "repeats": _share("n_repeat_words", "n_words", 10000)}


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Quantile sketches as counts: (keys, measure, bucket, n). Sketches merge by adding counts up.

    A bucket is named by its least value: the number with all but its first bits set to 0.
    """
    flat = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("v")) for m, v in _values().items()])).alias("_m")).select(*keys, "_m.measure", "_m.v")
    drop = F.greatest(F.lit(0), F.length(F.bin("v")) - F.lit(SKETCH_BITS + 1))
    bucket = F.call_function("shiftleft", F.call_function("shiftright", F.col("v"), drop), drop)
    return flat.groupBy(*keys, "measure", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, total, q1, q3): the buckets that hold ranks ceil(n / 4) and ceil(3n / 4)."""
    by = Window.partitionBy(*keys, "measure")
    run = sketches.withColumn("upto", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("bucket")))
    return run.groupBy(*keys, "measure").agg(F.max("total").alias("total"), at(1).alias("q1"), at(3).alias("q3"))


def excess(sketches: DataFrame, limits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, excess): how far a row of the sketch lies outside of its quartiles on average, rounded down. Tails count even where both quartiles are one value."""
    q = limits.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("measure").alias("_m"), F.col("q1").alias("_q1"), F.col("q3").alias("_q3"))
    at = F.col("measure") == F.col("_m")
    for k in keys:
        at = at & F.col(k).eqNullSafe(F.col(f"_{k}"))
    out = F.greatest(F.col("bucket") - F.col("_q3"), F.col("_q1") - F.col("bucket"), F.lit(0).cast("long"))
    sums = sketches.join(q, at).groupBy(*keys, "measure").agg(F.sum(F.col("n") * out).alias("_sum"), F.sum("n").alias("_n"))
    return sums.select(*keys, "measure", F.expr("_sum div _n").alias("excess"))


def _over(part: str, whole: str, high: Column) -> Column:
    """Whether ``part`` of ``whole`` is over ``high`` ten-thousandths by more than chance: FENCE deviations of a count with that mean, one added to it. In doubles, whose squares don't overflow."""
    mean = high.cast("double") * F.col(whole)
    gap = F.col(part) * F.lit(10000.0) - mean
    return (gap > 0) & (gap * gap > FENCE * FENCE * 10000.0 * (mean + 10000.0))


def judge(docs: DataFrame, **columns: str) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one per input row.

    The base rules fail documents of under 50 words, or with more than half of their words in
    repeated three-word windows. Of the others, those are kept that lie within 3 spreads of the
    quartiles of their language and source: in mean word length on both sides, in the shares
    of symbols, repeated lines and repeated words above. The spread is the group's quartile distance, or where that is
    larger the language's mean distance outside of its quartiles, so that a measure that is 0 in most documents
    gets its width from the tail that its language has; no width is fixed. A share has to be over its cutoff by more than
    chance (3 deviations of the count expected there), so that one repeated line of ten isn't judged like a hundred of a thousand. Groups of under 100
    documents go by their language's quartiles, from the sum of its groups' sketches.

    Null texts have no words; null languages and sources are groups of their own; repeated
    rows count each; other columns are left aside; no rows give no rows.
    """
    rows = stored(measure(docs, **columns), "quality-counts")
    fine = stored(sketch(rows, ["lang", "source"]), "quality-sketch")
    own = quartiles(fine, ["lang", "source"])
    merged = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    coarse = quartiles(merged, ["lang"])
    tail = excess(merged, coarse, ["lang"]).toDF("_l", "_k", "_excess")
    whole = coarse.join(tail, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_k"))).drop("_l", "_k").toDF("_lang", "_m", "_t", "_q1", "_q3", "_excess")
    limits = own.join(whole, F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_m")))
    small = F.col("total") < LEAST_GROUP
    q1, q3 = F.when(small, F.col("_q1")).otherwise(F.col("q1")), F.when(small, F.col("_q3")).otherwise(F.col("q3"))
    far = FENCE * F.greatest(q3 - q1, F.col("_excess"))
    limits = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "measure", (q1 - far).alias("low"), (q3 + far).alias("high"))
    pick_one = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}")
    limits = limits.groupBy("_lang", "_source").agg(pick_one("word_len", "low"), *[pick_one(m, "high") for m in MEASURES])
    good = _values()["word_len"].between(F.col("word_len_low"), F.col("word_len_high"))
    for m, (part, whole) in SHARES.items():
        good = good & ~_over(part, whole, F.col(f"{m}_high"))
    out = rows.join(limits, rows["lang"].eqNullSafe(limits["_lang"]) & rows["source"].eqNullSafe(limits["_source"]), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.coalesce(good, F.lit(True))).alias("kept"))


_SQL_VALUES = {"word_len": "100 * word_chars // n_words", "symbols": "10000 * n_symbols // word_chars", "dup_lines": "10000 * n_dup_lines // n_lines", "repeats": "10000 * n_repeat_words // n_words"}
_SQL_SHARES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
_HIGH = f"(lim.q3 + {FENCE} * greatest(lim.q3 - lim.q1, excess))::DOUBLE"
_SQL_OVER = f"10000.0::DOUBLE * {{0}} > {_HIGH} * {{1}} AND power(10000.0::DOUBLE * {{0}} - {_HIGH} * {{1}}, 2) > {FENCE * FENCE}0000.0::DOUBLE * ({_HIGH} * {{1}} + 10000)"

SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS x FROM documents),
w AS MATERIALIZED (SELECT r, list_filter(regexp_split_to_array(x, '[\\x20\\x09-\\x0D]+'), lambda y: y <> '') AS w FROM d),
g AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
c AS (SELECT d.r, doc_id, lang, source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(x, '{SYMBOLS}'))::BIGINT AS n_symbols, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\\x20\\x09-\\x0D]')) AS l,
  coalesce(p.n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN p USING (r)),
m AS (SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines FROM c),
v AS (SELECT *, {", ".join(f"coalesce({e}, 0)::BIGINT AS {k}" for k, e in _SQL_VALUES.items())} FROM m),
f AS (SELECT lang, source, unnest([{", ".join(f"{{'measure': '{k}', 'v': {k}}}" for k in _SQL_VALUES)}], recursive := true) FROM v),
s AS (SELECT lang, source, measure, (v >> greatest(0, length(bin(v)) - {SKETCH_BITS + 1})) << greatest(0, length(bin(v)) - {SKETCH_BITS + 1}) AS bucket, count(*) AS n FROM f GROUP BY ALL),
own AS (SELECT lang, source, measure, max(t) AS total, min(bucket) FILTER (4 * u >= t) AS q1, min(bucket) FILTER (4 * u >= 3 * t) AS q3 FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY lang, source, measure) AS t FROM s) GROUP BY ALL),
whole AS (SELECT lang, measure, min(bucket) FILTER (4 * u >= t) AS q1, min(bucket) FILTER (4 * u >= 3 * t) AS q3 FROM
  (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY bucket) AS u, sum(n) OVER (PARTITION BY lang, measure) AS t FROM (SELECT lang, measure, bucket, sum(n) AS n FROM s GROUP BY ALL)) GROUP BY ALL),
tail AS (SELECT m.lang, m.measure, sum(n * greatest(bucket - q3, q1 - bucket, 0))::BIGINT // sum(n)::BIGINT AS excess FROM (SELECT lang, measure, bucket, sum(n) AS n FROM s GROUP BY ALL) m JOIN whole ON m.lang IS NOT DISTINCT FROM whole.lang AND m.measure = whole.measure GROUP BY ALL),
lim AS (SELECT own.lang, own.source, own.measure, tail.excess, CASE WHEN total < {LEAST_GROUP} THEN whole.q1 ELSE own.q1 END AS q1, CASE WHEN total < {LEAST_GROUP} THEN whole.q3 ELSE own.q3 END AS q3
  FROM own JOIN whole ON own.lang IS NOT DISTINCT FROM whole.lang AND own.measure = whole.measure JOIN tail ON own.lang IS NOT DISTINCT FROM tail.lang AND own.measure = tail.measure),
bad AS (SELECT DISTINCT v.r FROM v JOIN lim ON v.lang IS NOT DISTINCT FROM lim.lang AND v.source IS NOT DISTINCT FROM lim.source
  WHERE (measure = 'word_len' AND (word_len > lim.q3 + {FENCE} * greatest(lim.q3 - lim.q1, excess) OR word_len < lim.q1 - {FENCE} * greatest(lim.q3 - lim.q1, excess))) OR {" OR ".join(f"(measure = '{k}' AND {_SQL_OVER.format(*c)})" for k, c in _SQL_SHARES.items())})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND r NOT IN (SELECT r FROM bad)) AS kept FROM v
"""
