"""Words of a batch of texts, told apart in Arrow, and character n-grams of distinct words, hashed in numpy.

A batch's distinct words are spelled once, however often they occur, and nothing
is remembered between batches: memory is bounded by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text whose words are told apart together.
PART = 1 << 19

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@dataclass
class Words:
    """``distinct`` words; ``at``: each occurrence's word, text after text; ``ends``: where each text's occurrences end."""

    distinct: pa.Array
    at: np.ndarray
    ends: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """Per text, the sum over its occurrences of a row (or number) per distinct word."""
        shape = (len(self.ends), *of_word.shape[1:])
        out, some = np.zeros(shape, of_word.dtype), np.flatnonzero(self.sizes > 0)
        step = max(1, 1 << 22 >> max(0, int(np.prod(shape[1:], dtype=np.int64) - 1).bit_length()))
        first = 0
        while first < len(some):  # as many texts at a time as make about ``step`` occurrences
            last = max(first + 1, int(np.searchsorted(self.ends[some], self.starts[some[first]] + step, side="right")))
            these = some[first:last]
            a, b = int(self.starts[these[0]]), int(self.ends[these[-1]])
            out[these] = np.add.reduceat(of_word[self.at[a:b]], self.starts[these] - a, axis=0)
            first = last
        return out


def words_of(texts: pa.Array, ascii_only: bool) -> Words:
    """Lower-cased words between blanks; ``ascii_only``: only ASCII letters change and only ASCII blanks divide."""
    texts = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts)) if ascii_only else pc.utf8_split_whitespace(pc.utf8_lower(texts))
    flat = split.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(real)])
    ends = before[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy().astype(np.int64), ends.astype(np.int64))


def in_parts(texts: pa.Array, size: int = PART) -> Iterator[pa.Array]:
    """Runs of texts of about ``size`` bytes, so that what is made of a run stays small; a longer text is a run of its own.

    Arrow's pool is emptied after each run: workers live on between tasks and would keep what one run needed at most.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, side="right")))
        yield texts.slice(first, last - first)
        first = last
        pa.default_memory_pool().release_unused()


def spell(words: pa.Array, before: str, after: str, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(code points, sizes) of ``before + word + after``; code points in ``without`` are left out of the words."""
    marked = [before + w + after for w in words.to_pylist()]
    points = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    if without is not None and len(points):
        stay = ~np.isin(points, without)
        held = np.concatenate([[0], np.cumsum(stay)])
        ends = np.cumsum(sizes)
        points, sizes = points[stay], held[ends] - held[ends - sizes]
    return points, sizes


def gram_hashes(points: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, word) of every ``n`` code points in a row within a word."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(points) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    start = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    h = np.full(len(start), n, np.uint64)
    for k in range(n):
        h = (h ^ points[start + k]) * _MIX[k % 3]
        h ^= h >> np.uint64(29)
    for m in _MIX[3:]:
        h = (h ^ (h >> np.uint64(30))) * m
    return h ^ (h >> np.uint64(31)), owner[start]


def shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its ``words``-word shingles (ASCII case and blanks); a shorter text is one."""
    return [s for part in in_parts(texts) for s in _shingles(part, words)]


def _shingles(texts: pa.Array, words: int) -> list[np.ndarray]:
    import xxhash

    found = words_of(texts, ascii_only=True)
    of = np.fromiter(map(xxhash.xxh64_intdigest, found.distinct.to_pylist()), np.uint64, len(found.distinct))
    h = of[found.at]
    long = _rows(h, words)
    out = []
    for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(long[a : b - words + 1]))
        else:
            out.append(_rows(h[a:b], b - a) if b > a else np.empty(0, np.uint64))
    return out


def _rows(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` neighbours."""
    s = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : len(h) - n + 1 + k]) * _MIX[k % 3]
        s ^= s >> np.uint64(29)
    for m in _MIX[3:]:
        s = (s ^ (s >> np.uint64(30))) * m
    return s ^ (s >> np.uint64(31))
