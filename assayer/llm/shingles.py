"""Word shingles as sorted 64-bit hash sets, vectorised over many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Bytes hashed at a time; only a single longer word makes a window larger.
WINDOW = 1 << 20
_SPACES = b" \t\n\x0b\x0c\r"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Values of bytes with A-Z as a-z, and powers of an odd number and of its inverse."""

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(_SPACES)] = True
        index = np.arange(256)
        index[65:91] += 32
        self.value = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)[index]
        self.size = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            base = 0xD1342543DE82EF95
            self.up, self.down, self.size = _powers(base, n), _powers(pow(base, -1, 1 << 64), n), n
        up, down = self.up[:n], self.down[:n]
        if n > 2 * WINDOW:  # one enormous word: don't keep its tables
            self.size = 0
        return up, down


_TABLES = _Tables()


def _windows(body: bytes) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(body):
        end = min(at + WINDOW, len(body))
        while end < len(body) and body[end - 1] not in _SPACES:
            nearest = [p for p in (body.find(bytes([s]), end) for s in _SPACES) if p >= 0]
            end = min(nearest) + 1 if nearest else len(body)
        yield at, end
        at = end


def word_hashes(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``body`` in order, and where each begins."""
    hashes, places = [], []
    for at, end in _windows(body):
        raw = np.frombuffer(body, np.uint8, end - at, at)
        space = np.ones(len(raw) + 2, bool)
        space[1:-1] = _TABLES.space[raw]
        edge = np.flatnonzero(space[1:] != space[:-1])
        first, last = edge[0::2], edge[1::2]
        up, down = _TABLES.upto(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_TABLES.value[raw] * up[:-1], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        places.append(first + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: Sequence[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sets of all texts one after another, each sorted, and their bounds (one more than there are texts).

    A text of fewer words has the whole sequence as its one shingle; one without
    words has none.
    """
    body = b"\n".join(texts) + b"\n"
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    hashes, places = word_hashes(body)
    edges = np.searchsorted(places, starts)
    counts = np.diff(edges)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    n = max(0, len(hashes) - words + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        rolled += hashes[k : k + n] * factors[k]
    rolled = mix(rolled)
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    out = np.empty(bounds[-1], np.uint64)
    for i in np.flatnonzero(counts).tolist():
        a, b = bounds[i], bounds[i + 1]
        if counts[i] >= words:
            out[a:b] = rolled[edges[i] : edges[i] + b - a]
            out[a:b].sort()
        else:
            few = hashes[edges[i] : edges[i + 1]]
            with np.errstate(over="ignore"):
                out[a] = mix(np.array([(few * factors[: len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))], np.uint64) * _ODD)[0]
    if len(out):
        fresh = np.ones(len(out), bool)
        fresh[1:] = out[1:] != out[:-1]
        fresh[bounds[:-1][sizes > 0]] = True
        kept = np.zeros(len(out) + 1, np.int64)
        np.cumsum(fresh, out=kept[1:])
        return out[fresh], kept[bounds]
    return out, bounds
