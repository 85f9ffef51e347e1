"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against which the word windows of training texts are scanned.

The set holds the items' words once, and of each window its hash and where it begins, so that it takes some five bytes for
each byte of the items; a benchmark whose set would be larger than SET_BYTES is scanned for in parts, one pass each.

Nulls and texts without words hold no words and are never hit. Items without words make no window; repeated items and
windows count once per item id; a null item id is left out of the item list but its windows still hit. Rows are judged
one by one and whole, so repeated rows, null ids, texts of any length and further columns of any name pass unchanged. An
empty benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spheric.llm.common import fresh, shipped, span_hashes, stored, text_runs

#: Bytes of one broadcast set at most, at BYTES_EACH for each byte of item text. A larger benchmark is scanned for in several passes.
SET_BYTES, BYTES_EACH = 64 << 20, 5
WORD_BASE, WINDOW_BASE = 0x5851F42D4C957F2D, 0x14057B7EF767814F | 1
#: Digits, small letters and bytes beyond ASCII make words; capitals become small; all else parts words.
FOLD = np.full(256, 32, np.uint8)
FOLD[48:58], FOLD[97:123], FOLD[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
FOLD[65:91] = np.arange(97, 123)

FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
])


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes; where words start and end; for each row the number of words before it."""
    low = FOLD[data]
    word = low != 32
    starts, ends = word.copy(), word.copy()
    inner = at[(at > 0) & (at < len(data))]
    starts[1:] &= ~word[:-1]
    starts[inner] = word[inner]
    ends[:-1] &= ~word[1:]
    ends[inner - 1] = word[inner - 1]
    first = np.flatnonzero(starts)
    return low, first, np.flatnonzero(ends) + 1, np.searchsorted(first, at)


def word_list(text: str | None) -> list[bytes]:
    return FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes().split() if text else []


class GramSet:
    """The windows of test items by length; probed by hash, then held against the words."""

    def __init__(self, items: Iterator[tuple[str | None, str | None]], n: int) -> None:
        texts: list[bytes] = []
        self.items: list[str | None] = []
        sizes: list[int] = []
        for item, text in items:
            if words := word_list(text):
                self.items.append(item)
                texts.append(b" ".join(words))
                sizes.append(len(words))
        self.text = b" ".join(texts)
        data = np.frombuffer(self.text, np.uint8)
        # words are parted by one space, so that each ends one before the next begins
        _, first, end, _ = words_of(data, np.array([0, len(data)]))
        self.first = np.append(first, len(data) + 1).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        w = span_hashes(data.astype(np.uint64), first, end, WORD_BASE)
        count = np.array(sizes, np.int64)
        self.before = np.concatenate([[0], np.cumsum(count)]).astype(np.int64)
        item_of = np.repeat(np.arange(len(count)), count)
        last = np.repeat(self.before[1:], count)
        #: For each length: hashes in order, the word each begins with, and a bit for each hash's first bits.
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.uint64]] = {}
        for k in sorted({min(n, x) for x in sizes}):
            own = np.arange(len(w)) + k <= last
            if k < n:
                own &= np.repeat(count == k, count)
            i = np.flatnonzero(own)
            h = span_hashes(w, i, i + k, WINDOW_BASE)
            order = np.lexsort((item_of[i], h))
            i, h = i[order], h[order]
            again = np.zeros(len(i), bool)  # an item's repeated windows count once
            again[1:] = (h[1:] == h[:-1]) & (item_of[i][1:] == item_of[i][:-1])
            i, h = i[~again], h[~again]
            bits = max(12, int(len(h)).bit_length() + 5)
            maybe = np.zeros(1 << (bits - 3), np.uint8)
            top = h >> np.uint64(64 - bits)
            np.bitwise_or.at(maybe, top >> np.uint64(3), np.uint8(1) << (top & np.uint64(7)).astype(np.uint8))
            self.windows[k] = (h, i.astype(self.first.dtype), maybe, np.uint64(64 - bits))

    def nbytes(self) -> int:
        return len(self.text) + self.first.nbytes + self.before.nbytes + sum(h.nbytes + i.nbytes + m.nbytes for h, i, m, _ in self.windows.values())

    def holders(self, k: int, lo: int, hi: int, words: bytes) -> Iterator[str | None]:
        """The ids of the items whose windows, of the hashes lo to hi, are these words."""
        for i in self.windows[k][1][lo:hi].tolist():
            if self.text[self.first[i] : self.first[i + k] - 1] == words:
                yield self.items[int(np.searchsorted(self.before, i, "right")) - 1]

    def scan(self, data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, list, list]]:
        """For each row of a run: words, hit words, ids of the items found, byte spans of the hits."""
        low, first, end, before = words_of(data, at)
        n = len(first)
        edge = np.zeros(n + 1, np.int64)
        found: dict[int, set] = defaultdict(set)
        if n and self.windows:
            w = span_hashes(low.astype(np.uint64), first, end, WORD_BASE)
            last = np.repeat(before[1:], np.diff(before))  # for each word the end of its row
            for k, (hashes, _, maybe, shift) in self.windows.items():
                i = np.flatnonzero(np.arange(n) + k <= last)
                if not len(i):
                    continue
                h = span_hashes(w, i, i + k, WINDOW_BASE)
                top = h >> shift
                near = (maybe[top >> np.uint64(3)] >> (top & np.uint64(7)).astype(np.uint8)) & 1 > 0
                i, h = i[near], h[near]
                lo, hi = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
                i, lo, hi = i[hi > lo], lo[hi > lo], hi[hi > lo]
                rows = np.searchsorted(before, i, "right") - 1
                for x, row, a, b in zip(i.tolist(), rows.tolist(), lo.tolist(), hi.tolist(), strict=True):
                    words = b" ".join(low[first[x] : end[x + k - 1]].tobytes().split())
                    items = set(self.holders(k, a, b, words))
                    if items:
                        edge[x] += 1
                        edge[x + k] -= 1
                        found[row] |= items
        hit = np.cumsum(edge)[:n] > 0
        upto = np.concatenate([[0], np.cumsum(hit)])
        counts = upto[before[1:]] - upto[before[:-1]]
        for row, (lo, hi, c) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), counts.tolist(), strict=True)):
            spans = []
            if c:
                h = np.concatenate([[False], hit[lo:hi], [False]])
                turn = np.flatnonzero(h[1:] != h[:-1]).reshape(-1, 2)
                spans = [(int(first[lo + a] - at[row]), int(end[lo + b - 1] - at[row])) for a, b in turn]
            yield hi - lo, c, sorted(str(x) for x in found.get(row, ()) if x is not None), spans


def _found(rows: list[tuple]) -> pa.Array:
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())))
    return pa.StructArray.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(kinds)], FOUND.names)


def _scanner(shared):
    @F.arrow_udf(FOUND)
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams: GramSet = shared.value
        for column in parts:
            out: list[tuple] = []
            for _, _, data, at in text_runs(column):
                for row, (n, c, items, spans) in enumerate(grams.scan(data, at)):
                    if spans:  # bytes to code points
                        points = np.concatenate([[0], np.cumsum((data[at[row] : at[row + 1]] & 0xC0) != 0x80)])
                        spans = [[int(points[a]), int(points[b])] for a, b in spans]
                    out.append((n, c, items, spans))
            yield _found(out)

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", set_bytes: int = SET_BYTES) -> DataFrame:
    """docs with a struct column (n_words, n_hit, items sorted as strings, spans of hit code points); into replaces a column of that name.

    A window is n words in a row of an item, or the whole of a shorter item. The benchmark's size is asked of Spark first:
    its set is broadcast whole up to set_bytes, else in as many parts as keep each below that, one pass each, and a part's
    set goes when its pass is over.
    """
    spark = shipped(docs.sparkSession)
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = 1 + int(size * BYTES_EACH // set_bytes)
    out, more, t = docs, fresh(docs.withColumn(into, F.lit(0)), "part"), F.col(text).cast("string")
    for part in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast(GramSet(((r.i, r.t) for r in some.toLocalIterator()), n))
        column = _scanner(shared)(t)
        if part == 0:
            out = out.withColumn(into, column)
        else:
            out = out.withColumn(more, column).withColumn(into, _union(t, F.col(into), F.col(more))).drop(more)
        if parts > 1:
            out = stored(out, "decontaminate")
            shared.destroy()
    return out


@F.arrow_udf(FOUND)
def _union(texts: pa.Array, left: pa.Array, right: pa.Array) -> pa.Array:
    """Joins what two passes found in a text."""
    out = []
    for text, a, b in zip(texts.to_pylist(), left.to_pylist(), right.to_pylist(), strict=True):
        spans: list[list[int]] = []
        for lo, hi in sorted([*a["spans"], *b["spans"]]):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(hi, spans[-1][1])
            else:
                spans.append([lo, hi])
        hit = sum(len(word_list((text or "")[lo:hi])) for lo, hi in spans)
        out.append((a["n_words"], hit, sorted({*a["items"], *b["items"]}), spans))
    return _found(out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """docs without what the benchmark holds: remove="documents" drops every hit document, "spans" cuts the hit words out of its text. The columns stay those of docs."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    mark = fresh(docs, "contamination")
    found = find_contamination(docs, benchmark, text=text, into=mark, **options)
    if remove == "documents":
        return found.where(F.col(f"{mark}.n_hit") == 0).drop(mark)
    return found.withColumn(text, F.when(F.col(f"{mark}.n_hit") > 0, _cut(F.col(text).cast("string"), F.col(f"{mark}.spans"))).otherwise(F.col(text))).drop(mark)


@F.arrow_udf(T.StringType())
def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The texts without the spans, which don't overlap."""
    out = []
    for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
        edges = [0, *(x for span in own or () for x in span), len(text or "")]
        out.append(None if text is None else "".join([text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]))
    return pa.array(out, pa.string())


def op1(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into="c")
    return found.select(
        "doc_id", "c.n_words", "c.n_hit", F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"),
    )
