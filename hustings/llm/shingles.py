"""Word and shingle hashes of whole batches of texts, by numpy over their bytes.

A word is hashed as a polynomial of its bytes: with running sums of byte × power a word's
value is a difference, and the inverse of the (odd) base takes its place in the text out
again. No Python code runs per word.
"""

import numpy as np

from hustings.llm.common import keeper, mix

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
VALUES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = keeper("powers", small=True)
    if held.get("n", 0) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", BASE), ("down", INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            held[name] = np.cumprod(factors)
        held["n"] = size
    return held["up"], held["down"]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, A-Z lower-cased, and the offset of each text's words.

    `offsets` has one entry more than there are texts; a null text has no words.
    """
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join([b"", *raw, b""]).lower(), np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(VALUES[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    begins = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
    return hashes, np.searchsorted(starts, begins).astype(np.int64)


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words and each text's offset; shorter texts have none."""
    n = len(words)
    counts = np.maximum(np.diff(offsets) - (width - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if n < width:
        return np.zeros(0, np.uint64), bounds
    full = np.zeros(n - width + 1, np.uint64)
    for j in range(width):
        full = full * STEP + words[j : n - width + 1 + j]
    full = mix(full)
    if len(full) == bounds[-1]:
        return full, bounds
    # Runs that begin in the last words of a text reach into the next one.
    keep = np.zeros(len(full) + 1, np.int64)
    some = counts > 0
    np.add.at(keep, offsets[:-1][some], 1)
    np.add.at(keep, offsets[:-1][some] + counts[some], -1)
    return full[np.cumsum(keep)[:-1] > 0], bounds


def slices(texts, most: int = 1 << 19):
    """Consecutive parts (first, texts) of an Arrow text column, each of about `most` characters."""
    rows = texts.to_pylist()
    first = held = 0
    for i, t in enumerate(rows):
        held += len(t) if t else 0
        if held >= most:
            yield first, rows[first : i + 1]
            first, held = i + 1, 0
    if first < len(rows):
        yield first, rows[first:]
