"""Language identification by compression with one zstandard raw-content dictionary per language."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, released

#: What stands between runs of letters.
_BETWEEN = re.compile(r"[\W\d_]+")
_BLOCK = 4096
#: zstandard's level, for texts of any length.
LEVEL = 9
#: Margins are learned from so many pieces of a language at most, for lengths of which so many are rightly named.
_ASKED, _FEW = 128, 20


def letters(text: str) -> bytes:
    """Lower-cased runs of letters, one space between and around; empty if the text has no letter."""
    out = _BETWEEN.sub(" ", text.lower()).strip()
    return f" {out} ".encode("utf-8", "replace") if any(map(str.isalpha, out)) else b""


class Dictionaries(dict):
    """Contents by language; ``least`` has, by the binary length of a text's letters in bytes, the margin that it needs at least, as a share of the smallest code."""

    least: Mapping[int, float] = {}

    def needed(self, n: int) -> float:
        if not self.least:
            return 0.0
        sizes = sorted(self.least)
        return self.least[max([x for x in sizes if x <= n.bit_length()], default=sizes[0])]


def margins(pieces: Mapping[str, list[bytes]], dictionary_bytes: int) -> dict[int, float]:
    """The least margins that labelled pieces suggest: half of what 99% of the rightly named ones reach, by length.

    Every other piece is learned, the rest are asked, and their beginnings of 64, 128, ... bytes.
    """
    if len(pieces) < 2:
        return {}
    ask = Classifier({x: b"".join(p[::2])[:dictionary_bytes] for x, p in pieces.items()})
    got: dict[int, list[float]] = {}
    for lang, own in pieces.items():
        for p in own[1::2][:_ASKED]:
            for size in (64, 128, 256, 512, 1024, 2048):
                if len(p) >= size:
                    best, margin, least = ask.sizes(p[:size])
                    if best == lang:
                        got.setdefault(size.bit_length(), []).append(margin / least)
    return {k: sorted(v)[len(v) // 100] / 2 for k, v in got.items() if len(v) >= _FEW}


def train(docs: DataFrame, learn: Column | None = None, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 256, piece_chars: int = 2048, dictionary_bytes: int = 1 << 16) -> Dictionaries:
    """Raw-content dictionaries, one for each language, the most frequent language first.

    Learned from a bounded sample: about ``sample_docs`` of each language's rows, chosen by
    hash over all rows where ``learn`` (a condition on ``key``) holds and text and language
    aren't null, a stretch of ``piece_chars`` characters of each, up to ``dictionary_bytes``
    in all. Languages are counted over all rows. The sample also gives the least margins (``margins``).
    """
    rows = pick(docs, **{key: key, "_x": text, "_l": lang}).where(F.col("_x").isNotNull() & F.col("_l").isNotNull())
    rows = rows if learn is None else rows.where(learn)
    counts = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Dictionaries()
    rates = F.create_map(*[v for x, n in counts.items() for v in (F.lit(x), F.lit(min(1.0, sample_docs / n)))])
    h = F.xxhash64(F.lit(17), key, "_x")
    at = F.lit(1) + F.pmod(h, F.greatest(F.lit(1), F.length("_x") - F.lit(piece_chars)).cast("long")).cast("int")
    sample = rows.withColumn("_h", h).where(F.pmod("_h", F.lit(1_000_000)) < F.element_at(rates, F.col("_l")) * 1_000_000)
    sample = sample.select("_h", "_l", F.substring(F.col("_x"), at, F.lit(piece_chars)).alias("_x")).orderBy("_h", "_l", "_x").limit(4 * sample_docs * len(counts))
    pieces: dict[str, list[bytes]] = {x: [] for x in sorted(counts, key=lambda x: (-counts[x], x))}
    for r in sample.collect():
        pieces[r["_l"]].append(letters(r["_x"]))
    out = Dictionaries({x: b"".join(p)[:dictionary_bytes] for x, p in pieces.items()})
    out.least = margins(pieces, dictionary_bytes)
    return out


class Classifier:
    def __init__(self, dictionaries: Mapping[str, bytes], bits: float = 0.1):
        self.langs, self.bits = list(dictionaries), bits
        self.coders = [self._compressor(d) for d in dictionaries.values()]

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        if len(content) < 8:
            return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        """(language, share of its likelihood, bytes by which it beats the next); und without letters.

        The whole text is compressed, block by block, each block against the fresh dictionary.
        Equal sizes: the language that is more frequent in training.
        """
        return self.measure(text)[:3]

    def sizes(self, data: bytes) -> tuple[str, int, int]:
        """(language, bytes by which it beats the next, its bytes) of letters."""
        sizes = self._codes(data)
        least = min(sizes)
        best = sizes.index(least)
        rest = [s for i, s in enumerate(sizes) if i != best]
        return self.langs[best], min(rest) - least if rest else least, least

    def _codes(self, data: bytes) -> list[int]:
        blocks = [data[i : i + _BLOCK] for i in range(0, len(data), _BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def measure(self, text: str | None) -> tuple[str, float, int, int, int]:
        """What a call gives, then the bytes of the smallest code and those of the text's letters."""
        data = letters(text or "")
        if not data or not self.langs:
            return "und", 0.0, 0, 0, 0
        sizes = self._codes(data)
        least = min(sizes)
        best = sizes.index(least)
        rest = [s for i, s in enumerate(sizes) if i != best]
        share = 1 / sum(math.exp(-(s - least) * 8 * math.log(2) * self.bits) for s in sizes)
        return self.langs[best], share, min(rest) - least if rest else least, least, len(data)


_HELD: list = []


def identify(docs: DataFrame, dictionaries: Mapping[str, bytes], *, text: str = "text", keep: list[str] | None = None, min_margin: int = 1) -> DataFrame:
    """Language of every whole text: the columns ``keep`` (all but repeated names if None), lang_pred, score, margin, rejected.

    ``rejected`` where the text has no letter, or the smallest code is less than
    ``min_margin`` bytes under the next one, or less than the share of itself that ``train`` found
    labelled texts of that length to have. Null and empty texts: und, score 0, rejected.
    Repeated rows each get their row, null ids too; no rows give no rows. Input columns
    that are named like the new ones are left aside.
    """
    new = ["lang_pred", "score", "margin", "rejected"]
    keep = [c for c in dict.fromkeys(docs.columns) if c not in new] if keep is None else keep
    rows = pick(docs, **{f"_k{i}": c for i, c in enumerate(keep)}, **({} if text in keep else {"_x": text}))
    at = keep.index(text) if text in keep else len(keep)
    shipped = docs.sparkSession.sparkContext.broadcast((dict(dictionaries), dict(getattr(dictionaries, "least", {}))))

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = shipped.value
        if not _HELD or _HELD[0] is not value:  # the value is held too, so that no later one can take its place in memory
            _HELD[:] = value, Classifier(value[0])
        ask = _HELD[1]
        known = Dictionaries()
        known.least = value[1]
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                b = batch.slice(a, 512)
                got = [ask.measure(x) for x in b.column(at).to_pylist()]
                more = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[0] == "und" or g[2] < min_margin or g[2] < known.needed(g[4]) * g[3] for g in got], pa.bool_())]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *more], names=[*[f"_k{i}" for i in range(len(keep))], *new])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]], "lang_pred string, score double, margin long, rejected boolean"])
    out = rows.mapInArrow(run, schema)
    return out.toDF(*keep, *new)
