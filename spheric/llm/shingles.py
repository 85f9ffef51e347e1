"""Word shingles of texts: their hashes, sets of these, minima of sets, and exact Jaccard comparison of sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from spheric.llm.common import shipped, text_bytes

#: Shingles that are held against all permutations at once, and rows of a batch worked on at once.
RUN = 2048
#: A-Z become a-z, and space, tab, line feed, vertical tab, form feed and carriage return part words.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    parts = text.translate(LOWER).split()  # bytes split at just these six
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(parts), seed)] if parts else [], np.uint64)
    joined, h = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    first = np.concatenate([[0], ends[: len(parts) - words]])
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(first.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)), np.uint64, len(first))


def shingle_set(text: bytes, words: int, seed: int) -> np.ndarray:
    """The distinct hashes of the shingles, sorted."""
    return np.unique(shingle_hashes(text, words, seed))


def minima(hashes: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the permutations."""
    least = np.full(len(factors), ~np.uint64(0))
    for i in range(0, len(hashes), RUN):
        np.minimum(least, (factors[:, None] * hashes[None, i : i + RUN] + offsets[:, None]).min(1), out=least)
    return least


def shingle_bytes(words: int, seed: int):
    """A column function: a text's shingle set as bytes."""
    shipped()

    @F.arrow_udf("binary")
    def sets(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in (part[i : i + RUN] for part in parts for i in range(0, len(part), RUN)):
            data, at = text_bytes(column)
            text = memoryview(data)
            yield pa.array([shingle_set(bytes(text[a:b]), words, seed).tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())

    return sets


def similar(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up just what a comparison of all pairs of these sets would. Empty sets are not compared."""
    order = sorted((i for i, s in enumerate(sets) if len(s)), key=lambda i: len(sets[i]))  # by size, so that those large enough to differ too much come last
    if len(order) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(sets[i]) for i in order])
    values, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    own = np.split(ids, np.cumsum(sizes)[:-1])
    label, mark, left, right = np.arange(len(order)), np.zeros(len(values), np.int32), [], []
    for t in range(len(order) - 1):
        end = int(np.searchsorted(sizes, sizes[t] / similarity + 1e-9, "right"))
        rows = t + 1 + np.flatnonzero(label[t + 1 : end] != label[t])
        if not len(rows):
            continue
        mark[own[t]] = 1
        both = np.add.reduceat(mark[np.concatenate([own[i] for i in rows])], np.cumsum(sizes[rows]) - sizes[rows])
        mark[own[t]] = 0
        near = rows[both >= similarity * (sizes[t] + sizes[rows] - both) - 1e-9]
        names, first = np.unique(label[near], return_index=True)
        left += [order[t]] * len(names)
        right += [order[i] for i in near[first]]
        label[np.isin(label, names)] = label[t]
    return np.array(left, np.int64), np.array(right, np.int64)
