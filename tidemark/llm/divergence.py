"""How far the sources of a language are from each other: smoothed term shares, compared term by term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored

#: What lies between terms; terms are runs of ASCII letters and of all characters beyond ASCII.
BETWEEN = "[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000


def _share(count: str, total: str, size: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * size)), exact for any counts of 64 bits; products beyond 64 bits are made as decimals."""
    wide = f"cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(19,0)) div cast({total} + 2 * {size} as decimal(20,0))"
    return 1 + F.expr(f"if({count} < 9000000000, {SCALE}L * ({count} + 2) div ({total} + 2 * {size}), {wide})")


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); both are SCALE + 1 at most, so the square fits 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def term_counts(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, d): occurrences of each term in a group, and in how many of its documents it is.

    The terms, all matches of the term pattern, are what is left between matches of its complement: ``split`` takes a sixth of the time of
    ``regexp_extract_all``, which copies the text for each match. A document's terms are exploded twice, as they are and each once, so one aggregation, with partial sums before its
    shuffle, gives both numbers; no row stands for a term of one document.
    """
    plain = pick(docs, lang=lang, source=source, _x=text).fillna("", ["lang", "source", "_x"])
    found = plain.select("lang", "source", F.split(F.translate("_x", UPPER, LOWER), BETWEEN).alias("_t"))
    way = lambda terms, n, d: F.struct(terms.alias("_t"), F.lit(n).alias("n"), F.lit(d).alias("d"))
    both = found.select("lang", "source", F.inline(F.array(way(F.col("_t"), 1, 0), way(F.array_distinct("_t"), 0, 1))))
    return both.select("lang", "source", F.explode("_t").alias("term"), "n", "d").where("term <> ''").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def audit(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10, top_terms: int = 10) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): for each group of documents of a language and source

    part ``pair``: each other source of the language with the divergence of the two, ranked, all of them;
    part ``term``: the ``top_terms`` terms by which the group exceeds its language.

    A language keeps the terms of at least ``least_docs`` of its documents. Shares are smoothed by two counts and are
    whole numbers of billionths; every sum is exact. Groups with few or no terms still have a share for each kept term.
    The densified table has a row for each group and kept term of its language; pairs of sources meet on (language,
    term), each pair once, so a key of that join has as many rows as the language has sources.

    Null and empty texts count as documents without terms; null languages and sources are ''; repeated rows are
    documents of their own; ties are ranked by the item's bytes; other columns are left aside; no rows give no rows.
    """
    groups = stored(pick(docs, lang=lang, source=source).fillna("", ["lang", "source"]).distinct(), "divergence-groups")
    counts = stored(term_counts(docs, text=text, lang=lang, source=source), "divergence-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("d").alias("_d")).where(F.col("_d") >= least_docs).drop("_d")
    kept = stored(kept, "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("size"), F.sum("all_n").alias("total"))
    # The join with the groups densifies: each group has a row for each term its language keeps.
    dense = groups.join(kept, "lang").join(counts.drop("d"), ["lang", "source", "term"], "left").na.fill(0, ["n"])
    dense = stored(dense.select("lang", "source", "term", "n", "all_n"), "divergence-dense")
    totals = dense.groupBy("lang", "source").agg(F.sum("n").alias("own")).join(F.broadcast(sizes) if _small(groups) else sizes, "lang")
    shares = dense.join(F.broadcast(totals) if _small(groups) else totals, ["lang", "source"]).select(
        "lang", "source", "term", "n", _share("n", "own", "size").alias("p"), _share("all_n", "total", "size").alias("q")
    )
    low = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    high = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    sums = low.join(high, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(_gap("pa", "pb")).alias("value"))
    sums = stored(sums, "divergence-pairs")
    mirrored = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", "b", "a", "value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(others, "lang").where("source <> item").join(mirrored, ["lang", "source", "item"], "left").na.fill(0, ["value"]).withColumn("part", F.lit("pair"))
    terms = shares.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), _gap("p", "q").alias("value"), F.lit("term").alias("part"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [pairs.withColumn("rank", F.row_number().over(by)), terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)]
    out = [x.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank")) for x in ranked]
    return out[0].unionByName(out[1])


#: Up to so many groups their totals are broadcast; beyond it the joins shuffle.
BROADCAST_GROUPS = 100_000


def _small(groups: DataFrame) -> bool:
    return groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS


SQL = r"""
WITH docs AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM docs) GROUP BY ALL HAVING count(*) >= 10),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
own AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v)::HUGEINT AS p FROM dense JOIN sizes USING (lang)),
whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v)::HUGEINT AS q
    FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM dense GROUP BY ALL) JOIN sizes USING (lang)),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(x.value, 0) AS value
    FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN gaps x ON x.lang = g.lang AND x.source = g.source AND x.item = o.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
