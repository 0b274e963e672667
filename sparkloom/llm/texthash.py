"""64-bit hashes of words, shingles and byte windows for many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Texts are hashed in groups of about so many bytes, which bounds a worker's memory.
GROUP_BYTES = 500_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_rng = np.random.default_rng(1729)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
PLACE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
BASE = U(0x9E3779B97F4A7C15 | 1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
INVERSE = U(pow(int(BASE), -1, 2**64))
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each input bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), mod 2 ** 64."""
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate((have, have * (have[-1:] * base)))
    _powers[base] = have
    return have[:n]


def groups(sizes: list[int], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts of about limit bytes; a longer text stands alone."""
    start, held = 0, 0
    for k, n in enumerate(sizes):
        if k > start and held + n > limit:
            yield start, k
            start, held = k, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def text_groups(texts: pa.Array) -> Iterator[tuple[int, int, list[bytes]]]:
    """An Arrow batch of texts as ranges and their UTF-8, nulls empty. Only one group's copies are held at a time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    raw = texts.cast(pa.binary())
    for a, b in groups(pc.fill_null(pc.binary_length(raw), 0).to_pylist()):
        yield a, b, [t or b"" for t in raw.slice(a, b - a).to_pylist()]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of BYTE * BASE ** place before each place: (sums[b] - sums[a]) * BASE ** -a hashes data[a:b]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data)), out=sums[1:])
    return sums


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words start (with the end)."""
    joined = np.frombuffer(b" " + b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    space = SPACE[joined]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    sums = prefix_sums(joined)
    hashes = mix((sums[ends] - sums[starts]) * powers(len(joined), INVERSE)[starts] + (ends - starts).astype(np.uint64))
    bounds = 1 + np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hashes, np.searchsorted(starts, bounds)


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; of all its words if it has fewer."""
    words, at = word_hashes(texts)
    shingles = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        shingles += words[j : j + len(shingles)] * PLACE[j]
    shingles = mix(shingles)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            out.append(mix(np.sum(words[a:b] * PLACE[: b - a], keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
