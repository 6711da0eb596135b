"""Hashes of shingles and MinHash signatures, vectorised over an Arrow batch of texts."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CHUNK = 1 << 17


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers, so that any of their bits can be used as a hash."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    if n:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


class Segments:
    """Polynomial hashes (modulo 2**64) of slices of one array of integers."""

    def __init__(self, symbols: np.ndarray):
        self.inverse = powers(_INVERSE, len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(symbols))[:-1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def windows(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all windows of ``width`` symbols in each sequence, and the number of windows per sequence.

    A sequence shorter than ``width`` has one window, all of it; an empty one has none.
    """
    counts = np.where(lengths == 0, 0, np.maximum(lengths - width + 1, 1))
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else counts
    offsets = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    start = np.arange(counts.sum()) + np.repeat(offsets - first, counts)
    return start, start + np.repeat(np.minimum(lengths, width), counts), counts


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in lower case, starts and ends of their words (between ASCII white space), words per text."""
    parts = [b" ".join((t or "").lower().encode("utf-8", "surrogatepass").split()) for t in texts]
    joined = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    # Words end at a blank or, at the end of a text, a line feed; parts hold neither a line feed nor two blanks in a row.
    ends = np.flatnonzero((joined == 32) | (joined == 10))
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = np.flatnonzero(joined[ends] == 10)
    full = ends > starts  # an empty text is one empty word
    return joined, starts[full], ends[full], np.diff(np.concatenate(([0], np.cumsum(full)[last])))


def word_shingles(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``width``-grams of each text (lower case, split at white space), and their number per text."""
    if not texts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    joined, first, last, per_text = words(texts)
    start, end, counts = windows(per_text, width)
    return Segments(Segments(joined).hashes(first, last)).hashes(start, end), counts


def char_shingles(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character ``width``-grams of each text, and their number per text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    start, end, counts = windows(np.fromiter(map(len, texts), np.int64, len(texts)), width)
    return Segments(points).hashes(start, end), counts


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """MinHash signatures: for each sequence of hashes the least value under ``size`` multiply-shift maps (uint32).

    Sequences without hashes get the greatest value everywhere.
    """
    rng = np.random.default_rng(seed)
    factor = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.full((len(counts), size), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts[full])
    at = 0
    while at < len(full):  # chunks that stay in the cache
        begin = ends[at] - counts[full[at]]
        to = max(at + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        part = hashes[begin : ends[to - 1]]
        firsts = ends[at:to] - counts[full[at:to]] - begin
        values, least = np.empty_like(part), np.empty((size, to - at), np.uint64)
        for k in range(size):
            np.minimum.reduceat(np.multiply(part, factor[k], out=values), firsts, out=least[k])
        out[full[at:to]] = (least >> np.uint64(32)).T  # the least of the shifted values is the least value, shifted
        at = to
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per sequence and band; hashes of different bands differ."""
    grouped = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), grouped.shape[:2]).copy()
    for r in range(rows):
        out = mixed(out * np.uint64(_BASE) + grouped[:, :, r])
    return out


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The (bands, rows) with most rows, so fewest chance candidates, that find a pair at ``threshold`` with ``recall``."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best
