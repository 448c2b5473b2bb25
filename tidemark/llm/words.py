"""Words of many texts at once, as 64-bit hashes, with NumPy and no loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        inverse = pow(int(_ODD), -1, 1 << 64)
        for name, base in (("power", int(_ODD)), ("inverse", inverse)):
            out = np.ones(_BLOCK + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                out[1:] = np.multiply.accumulate(np.full(_BLOCK, base, dtype=np.uint64))
            _TABLES[name] = out
        code = np.arange(256, dtype=np.uint8)
        code[65:91] += 32
        _TABLES["lower"] = code
        with np.errstate(over="ignore"):
            _TABLES["value"] = mix(code.astype(np.uint64) + np.uint64(0x51ED27))
            _TABLES["exact"] = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x51ED27))
        blank = np.zeros(256, dtype=bool)
        blank[[9, 10, 11, 12, 13, 32]] = True
        _TABLES["blank"] = blank
    return _TABLES


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The hash of each data[start:end]; ranges ascend and don't overlap."""
    t = _tables()
    out = np.empty(len(start), dtype=np.uint64)
    at, n = 0, len(start)
    with np.errstate(over="ignore"):
        while at < n:
            low = int(start[at])
            to = max(at + 1, int(np.searchsorted(end, low + _BLOCK, side="right")))
            high = int(end[to - 1])
            if high - low > _BLOCK:  # one very long word: hash it piece by piece
                h = np.uint64(0)
                for a in range(low, high, _BLOCK):
                    part = value[data[a : min(high, a + _BLOCK)]]
                    h = mix(np.array([h ^ (part * t["power"][: len(part)]).sum(dtype=np.uint64)]))[0]
                out[at] = h
            else:
                sums = np.zeros(high - low + 1, dtype=np.uint64)
                np.cumsum(value[data[low:high]] * t["power"][: high - low], out=sums[1:])
                s, e = start[at:to] - low, end[at:to] - low
                out[at:to] = mix((sums[e] - sums[s]) * t["inverse"][s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            at = to
    return out


def word_hashes(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text); words lie between ``WORD_BREAK``; A-Z lower-cased."""
    t = _tables()
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    full = ~t["blank"][joined]
    edge = np.flatnonzero(np.diff(full.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    bounds = np.cumsum([0, *[len(x) + 1 for x in texts]])
    counts = np.diff(np.searchsorted(start, bounds))
    return _hashes(joined, start, end, t["value" if lower else "exact"]), counts


def text_blocks(batches: Iterator, columns: list[str], text: str, most: int) -> Iterator[list[list]]:
    """Regroup record batches into lists of rows with about ``most`` bytes of text each (one row at least)."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        values = [batch.column(c).to_pylist() if c != text else batch.column(c).cast("binary").to_pylist() for c in columns]
        where = columns.index(text)
        for row in zip(*values, strict=True):
            for h, v in zip(held, row, strict=True):
                h.append(v)
            size += len(row[where] or b"")
            if size >= most:
                yield held
                held, size = [[] for _ in columns], 0
    if held[0]:
        yield held
