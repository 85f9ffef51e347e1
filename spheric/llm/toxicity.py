"""Toxicity: embeddings of hashed character n-grams, averaged over a few words, into a linear softmax; both are trained together in numpy.

As every n-gram of a word has its own vector, a misspelling that training never saw is read through the n-grams it shares.
A text is as toxic as the worst of its windows of WINDOW words in a row: averaged over a whole text, one word of a thousand
would be lost. Training starts from windows at random and goes on with the worst window of each text, as the model sees it.
After training only the difference of the two classes' weights matters, so each bucket comes down to one number, and a
window's score to the mean of its n-grams' numbers: executors get that one table, whose size the bucket count fixes.

Every word of a text is read, and a text of any length takes memory for its words' sums only. A null or empty text has no
n-grams; its score is that of the bias alone, as for any text the model knows nothing of. A null id counts as the empty
string in the held-out rule. Labels that repeat for an id count as toxic if any does; labels without a usable document, and
null labels, teach nothing; of rows that repeat an id one teaches. Without labelled rows of both classes every score is
their share (0 without any). An empty table gives an empty result; further columns, of any name, pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import shipped, text_runs
from spheric.llm.decontaminate import FOLD

#: The classifier learns from at most so many toxic texts and twice as many others, those with the least hashed ids, each of
#: at most so many bytes, and from so many bytes of these in all.
SAMPLE_ROWS, SAMPLE_BYTES, TOTAL_BYTES = 1000, 1 << 14, 12 << 20
BUCKET_BITS, GRAMS, WIDTH = 20, (3, 4, 5, 6), 8
#: Words in a window, chosen by cross-validation on rows that aren't held out.
WINDOW = 2
#: Characters whose n-grams are worked on at once.
CHUNK = 1 << 18


@dataclass
class Model:
    """bias and the number of each bucket; a window's logit is bias plus the mean over its n-grams."""

    bias: float
    table: np.ndarray


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded words with one space before and after each, and where each row begins, with a space of its own; rows don't touch."""
    wide = np.insert(FOLD[data], at, 32)
    own = at + np.arange(len(at))
    gap = wide == 32
    keep = np.ones(len(wide), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    keep[own] = True
    before = np.cumsum(keep, dtype=np.int32)[own] - 1
    return wide[keep], before


def grams(chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams that lie within one word and its spaces, and which word: the k-th space begins word k. Yields piece by piece."""
    seen, most = 0, max(GRAMS)
    for a in range(0, len(chars), CHUNK):
        part = chars[a : a + CHUNK + most - 1]
        gaps = np.cumsum(part == 32, dtype=np.int32)
        wide = part.astype(np.uint64)
        code = wide
        for n in range(2, most + 1):
            if len(part) < n:
                break
            code = code[:-1] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
            if n in GRAMS:
                own = np.flatnonzero(gaps[n - 2 : len(part) - 1] == gaps[: len(code)])
                own = own[: np.searchsorted(own, CHUNK)]
                yield ((code[own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32), gaps[own] + np.int32(seen - 1)
        seen += int(np.count_nonzero(part[:CHUNK] == 32))


def word_sums(table: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums over words: of their n-grams' numbers, and of how many these are."""
    words = int(np.count_nonzero(chars == 32))
    total, count = np.zeros(words + 1), np.zeros(words + 1, np.int64)
    for bucket, word in grams(chars):
        if len(word):
            first, size = int(word[0]), int(word[-1]) - int(word[0]) + 1
            total[first + 1 : first + 1 + size] += np.bincount(word - first, table[bucket], size)
            count[first + 1 : first + 1 + size] += np.bincount(word - first, minlength=size)
    return np.cumsum(total), np.cumsum(count)


def scores(model: Model, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The score of each row's worst window; a row of fewer words is one window."""
    chars, first = stream(data, at)
    total, count = word_sums(model.table, chars)
    # the word that a row's own space begins; as a space each ends the row before
    edge = np.searchsorted(np.flatnonzero(chars == 32), first)
    start = np.arange(int(edge[-1]))
    end = np.minimum(start + WINDOW, np.repeat(edge[1:], np.diff(edge)))
    mean = (total[end] - total[start]) / np.maximum(count[end] - count[start], 1)
    # a row's last windows are short, but of windows of fewer words only those of short rows count
    mean[(end - start < WINDOW) & (start > np.repeat(edge[:-1], np.diff(edge)))] = -np.inf
    worst = np.maximum.reduceat(mean, edge[:-1]) if len(mean) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(model.bias + worst, -40, 40)))


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's n-grams word by word, and the bounds of each word's."""
    data = np.frombuffer(text.encode(), np.uint8)
    chars, _ = stream(data, np.array([0, len(data)]))
    found = list(grams(chars))
    bucket, word = (np.concatenate([x[i] for x in found] or [np.zeros(0, np.int32)]) for i in (0, 1))
    order = np.argsort(word, kind="stable")
    return bucket[order], np.searchsorted(word[order], np.arange(np.count_nonzero(chars == 32)))


class Bags:
    """The n-grams of texts, all in one array that grows, and where each text's and each word's begin: what training holds of its sample."""

    def __init__(self) -> None:
        self.flat, self.used, self.words = np.empty(1 << 20, np.int32), 0, []

    def add(self, text: str) -> None:
        bucket, bounds = words_of(text)
        if self.used + len(bucket) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(self.used // 2 + 2 * len(bucket), np.int32)])
        self.flat[self.used : self.used + len(bucket)] = bucket
        self.words.append((self.used, bounds.astype(np.int32)))
        self.used += len(bucket)

    def named(self) -> np.ndarray:
        """The buckets there are; from now on n-grams are places among these."""
        seen = np.zeros(1 << BUCKET_BITS, bool)
        for i in range(0, self.used, CHUNK):
            seen[self.flat[i : min(i + CHUNK, self.used)]] = True
        place = np.cumsum(seen, dtype=np.int32) - 1
        for i in range(0, self.used, CHUNK):
            own = slice(i, min(i + CHUNK, self.used))
            self.flat[own] = place[self.flat[own]]
        return np.flatnonzero(seen)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        begin, bounds = self.words[i]
        return self.flat[begin : begin + bounds[-1]], bounds


def train(texts: Iterable[str] | Bags, toxic: list[int], *, epochs: int = 20, warm: int = 3, rate: float = 0.5, calm: float = 1e-6, seed: int = 7) -> Model:
    """Stochastic descent over windows, with a step for each bucket that shrinks as its gradients add up. For warm turns the windows are any, then each text's worst, and of texts that aren't toxic another as well. Where toxic texts are fewer than one in three they come up so much more often in each turn."""
    labels = np.array(toxic, np.int64)
    if not 0 < labels.sum() < len(labels):
        share = min(max(labels.mean() if len(labels) else 0.0, 1e-9), 1 - 1e-9)
        return Model(float(np.log(share / (1 - share))), np.zeros(1 << BUCKET_BITS, np.float32))
    bags = texts
    if not isinstance(texts, Bags):
        bags = Bags()
        for text in texts:
            bags.add(text)
    known = bags.named()
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((len(known), WIDTH), np.float32) * np.float32(0.1 / WIDTH)
    weights = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, 2)).astype(np.float32)
    bias, past = np.zeros(2, np.float32), np.full(len(known), calm, np.float32)
    seen_w, seen_b = np.full((WIDTH, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    often = max(1, round(float((labels == 0).sum() / (labels == 1).sum()) / 2))
    every = np.repeat(np.arange(len(labels)), np.where(labels == 1, often, 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        numbers = vectors @ (weights[:, 1] - weights[:, 0])
        for i in rng.permutation(every).tolist():
            bucket, bounds = bags[i]
            n = len(bounds) - 1
            size = min(WINDOW, n)
            if not len(bucket):
                continue
            begins = rng.integers(0, n - size + 1, 2).tolist()
            if epoch >= warm:
                sums = np.concatenate([np.zeros(1), np.cumsum(numbers[bucket])])[bounds]
                mean = (sums[size:] - sums[: n - size + 1]) / np.maximum(bounds[size:] - bounds[: n - size + 1], 1)
                begins = [int(mean.argmax())] + begins[: 1 - labels[i]]
            for begin in begins:
                names, share = np.unique(bucket[bounds[begin] : bounds[begin + size]], return_counts=True)
                if not len(names):
                    continue
                share = (share / share.sum()).astype(np.float32)
                mean = share @ vectors[names]
                logit = mean @ weights + bias
                p = np.exp(logit - logit.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = weights @ p
                past[names] += (share * share) * float(back @ back)
                vectors[names] -= (step * share / np.sqrt(past[names]))[:, None] * back
                g = np.outer(mean, p)
                seen_w += g * g
                seen_b += p * p
                weights -= 0.1 * step * g / np.sqrt(seen_w)
                bias -= 0.1 * step * p / np.sqrt(seen_b)
    table = np.zeros(1 << BUCKET_BITS, np.float32)
    table[known] = vectors @ (weights[:, 1] - weights[:, 0])
    return Model(float(bias[1] - bias[0]), table)


def held_out(doc_id):
    """A column: crc32 of the id's text leaves 0 by 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, total_bytes: int = TOTAL_BYTES) -> Model:
    """Learns from the labelled rows that are not held out and have a text of sample_bytes at most: of the toxic ones the sample_rows with the least hashed ids, and twice as many others, up to total_bytes of text.

    Only ids and sizes are joined and ordered; texts are read for the 3 * sample_rows ids chosen, which are broadcast.
    """
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y in (0, 1)").where(~held_out(F.col("i")))
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).cast("string").alias("t")).where(F.octet_length("t") <= sample_bytes)
    usable = rows.groupBy("i").agg(F.count(F.lit(1))).select("i").join(known, "i")
    some = [usable.where(f"y = {y}").orderBy(F.xxhash64("i"), "i").limit(sample_rows * (2 - y)) for y in (0, 1)]
    few = F.broadcast(some[0].union(some[1]))
    found = rows.join(few, "i").groupBy("i", "y").agg(F.min("t").alias("t")).orderBy(F.xxhash64("i"), "i").toLocalIterator()
    bags, toxic, held = Bags(), [], 0
    for r in found:
        held += len(r.t.encode())
        if held <= total_bytes:
            bags.add(r.t)
            toxic.append(r.y)
    return train(bags, toxic)


def toxicity(model: Model, spark) -> object:
    """A column function: the score of a text, from 0 to 1."""
    shared = shipped(spark).sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            found = [scores(shared.value, data, at) for _, _, data, at in text_runs(column)]
            yield pa.array(np.concatenate([np.zeros(0), *found]))

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, *, text: str = "text", into: str = "toxicity", **options) -> DataFrame:
    """docs with a score column; into replaces a column of that name."""
    return docs.withColumn(into, toxicity(fit(docs, labels, text=text, **options), docs.sparkSession)(F.col(text).cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame | None = None, *, model: Model | None = None, threshold: float = 0.5, text: str = "text", **options) -> DataFrame:
    """docs that score below threshold, with their own columns; the model is fitted on docs and labels unless given."""
    score = toxicity(model or fit(docs, labels, text=text, **options), docs.sparkSession)
    return docs.where(score(F.col(text).cast("string")) < threshold)


def op2(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
