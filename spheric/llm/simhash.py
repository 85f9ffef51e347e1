"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked when few bits differ, grouped by reach.

Candidates are compared bit-sliced: bit planes stand vertically, one lane a pair, and carry-save counters add up the
differing bits of all lanes at once; a block of lanes is left once all are past the radius.

Which fingerprints are candidates depends on the radius. A small one (2 by default) is searched without loss: candidates
share some blocks of their bits, which no pair within the radius can avoid. A similarity of shingle sets, given instead,
sets a wide radius (24 bits for 0.8, see radius_of), whose blocks of two or three bits would tell nothing apart; there
candidates share a band of minima of their sets. What the fingerprints link is then compared exactly, set by set, so the
fingerprints only save comparisons. A pair at the similarity itself is missed by all bands with a chance of
(1 - similarity ** band_rows) ** bands, 7e-5 by default, and still found where others hold it in its component.

A null text counts as an empty one. A text of fewer words than a shingle is one shingle; one without words has the
fingerprint zero, which links like any other (and, of sets, is equal to the empty set alone). Equal fingerprints, or sets,
are one node, so exact copies never pair up, and rows that repeat or have no id just share their node's group. A text of
any length is taken whole. An empty table gives an empty result; further columns, of any name, pass unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import fresh, shipped, sized, stored, text_bytes
from spheric.llm.graph import components, names_of
from spheric.llm.shingles import RUN, minima, shingle_bytes, shingle_hashes, shingle_set, similar

BITS = 64
#: Fingerprints that are compared in one group at most, twice over; groups beyond it are compared block by block.
GROUP_ROWS = 2048
#: Of a pair of the similarity so many standard deviations lie between its likely distance and the radius.
SAFETY = 5
#: Characters of text in one block of a component whose sets are compared. One beyond it is dealt into blocks, and each pair of blocks is a group.
GROUP_CHARS = 4 << 20


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it."""
    n, ones = len(hashes), np.zeros(BITS, np.int64)
    for i in range(0, n, 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprint(words: int = 3, seed: int = 42):
    """A column function: the fingerprint of a text as a signed 64-bit integer."""
    shipped()

    @F.arrow_udf("long")
    def simhash(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            data, at = text_bytes(column)
            text = memoryview(data)
            found = (majority(shingle_hashes(bytes(text[a:b]), words, seed)) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            yield pa.array(np.fromiter(found, np.uint64, len(column)).view(np.int64))

    return simhash


def planes_of(x: np.ndarray) -> np.ndarray:
    """The bits of n fingerprints as 64 rows of packed lanes."""
    bits = np.unpackbits(x.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1)
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def unused(lanes: int) -> np.ndarray:
    """The lanes of the last word that hold no fingerprint."""
    return np.packbits(np.arange(-(-lanes // 64) * 64) >= lanes).view(np.uint64)


def within(diff: np.ndarray, radius: int, dead: np.ndarray) -> np.ndarray:
    """Which lanes of these difference planes have radius bits or fewer: carry-save counters as wide as the radius, with what runs over them. Lanes in dead count as past it."""
    digits = max(1, radius.bit_length())
    sums, over = [np.zeros(diff.shape[1], np.uint64) for _ in range(digits)], dead.copy()
    full = ~np.uint64(0)
    for k in range(0, BITS, 8):
        for plane in diff[k : k + 8]:
            carry = plane
            for i, s in enumerate(sums):
                sums[i], carry = s ^ carry, s & carry
            over |= carry
        beyond = over | _more(sums, radius)
        if (beyond == full).all():  # every lane of the block is past the radius
            break
    return np.unpackbits((~beyond).view(np.uint8)).astype(bool)


def _more(sums: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is above radius."""
    more, same = np.zeros_like(sums[0]), ~np.zeros_like(sums[0])
    for i in reversed(range(len(sums))):
        if radius >> i & 1:
            same &= sums[i]
        else:
            more |= same & sums[i]
            same &= ~sums[i]
    return more


def linked(prints: np.ndarray, start: np.ndarray, radius: int, large: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Links that join up, within each group, just what a comparison of all its pairs would.

    start holds for each row the first row of its group. Groups above large rows keep their planes and meet blocks of
    queries. Of the rest, in turn t all rows of all groups are held against the t-th of their group, but for those that it
    has joined already, so a group of near copies takes few turns.
    """
    n = len(prints)
    heads, sizes = np.unique(start, return_counts=True)
    size = np.repeat(sizes, sizes)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for head, m in zip(heads[sizes > large].tolist(), sizes[sizes > large].tolist(), strict=True):
        a, b = _linked_large(prints[head : head + m], radius)
        left.append(a + head)
        right.append(b + head)
    label = np.arange(n)
    rows, t = np.flatnonzero((size > 1) & (size <= large)), 0
    while len(rows := rows[rows > start[rows] + t]):
        own, other = rows, start[rows] + t
        fresh = label[own] != label[other]
        own, other = own[fresh], other[fresh]
        if len(own):
            near = within(planes_of(prints[own]) ^ planes_of(prints[other]), radius, unused(len(own)))[: len(own)]
            own, other = own[near], other[near]
            if len(own):
                left.append(own)
                right.append(other)
                to = np.arange(n)
                to[label[own]] = label[other]
                label = to[label]
        t += 1
    return np.concatenate(left), np.concatenate(right)


def _linked_large(prints: np.ndarray, radius: int, queries: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The links of one group: its planes, each block of queries against all lanes."""
    m, planes = len(prints), planes_of(prints)
    label, left, right = np.arange(m), [], []
    turned = np.where(np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T.astype(bool), ~np.uint64(0), np.uint64(0))
    width = planes.shape[1]
    for q in range(0, m, queries):
        diff = planes[:, None, :] ^ turned[:, q : q + queries, None]
        near = within(diff.reshape(BITS, -1), radius, np.tile(unused(m), diff.shape[1])).reshape(-1, width * 64)[:, :m]
        for i, row in enumerate(near):
            lanes = np.flatnonzero(row)
            names, at = np.unique(label[lanes], return_index=True)
            other = names != label[q + i]
            if other.any():
                left += [q + i] * int(other.sum())
                right += lanes[at[other]].tolist()
                label[np.isin(label, names)] = label[q + i]
    return np.array(left, np.int64), np.array(right, np.int64)


def _compare(radius: int, batch: int = 1 << 17):
    """Reads rows (group, node, fp) or (group, fp), where fp is the node, sorted by group, and yields links between nodes; whole groups are gathered to about batch rows."""

    def links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(groups: np.ndarray, nodes: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            first = np.concatenate([[True], groups[1:] != groups[:-1]])
            start = np.flatnonzero(first)[np.cumsum(first) - 1]
            a, b = linked(prints.view(np.uint64), start, radius)
            return pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for part in parts:
            held.append(tuple(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, part.num_columns - 1)))
            rows += part.num_rows
            if rows >= batch:
                groups, nodes, prints = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = int(np.searchsorted(groups == groups[-1], True)) if groups[0] != groups[-1] else 0
                if cut:
                    yield work(groups[:cut], nodes[:cut], prints[:cut])
                held, rows = [(groups[cut:], nodes[cut:], prints[cut:])], len(groups) - cut
        if rows:
            yield work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links


def block_keys(fp, radius: int, blocks: int = 0):
    """An array of keys of which two fingerprints within radius share one at least: any choice of blocks - radius blocks of the bits."""
    blocks = blocks or radius + 2
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        mask -= (mask >> 63) << 64
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(mask))))
    return F.array(*keys)


def candidate_groups(keyed: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (group, ...) of the rows (key, ...), whose first other column names a node: groups of two or more that share a key.

    A key of more than group_rows rows is dealt into blocks of about that many, and each pair of blocks makes a
    group, so that no group is unbounded and no pair is lost.
    """
    rest = [c for c in keyed.columns if c != "key"]
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized_ = keyed.join(counts, "key")
    blocks = F.ceil(F.col("n") / F.lit(group_rows)).cast("int")
    own = F.pmod(F.xxhash64(rest[0]), blocks).cast("int")
    other = F.explode(F.when(blocks == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    dealt = sized_.select("key", *rest, own.alias("own"), other.alias("other"))
    return dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("group"), *rest)


def group_links(groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between the nodes of groups that lead, within each, from every node to all in reach of it over fingerprints within radius."""
    n = int(shipped(groups.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, "group").sortWithinPartitions("group", groups.columns[1])
    return dealt.mapInArrow(_compare(radius), "a long, b long").distinct()


def fingerprint_links(prints: DataFrame, radius: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) between distinct fingerprints fp that lead from each to all within reach of it."""
    keyed = prints.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    return group_links(candidate_groups(keyed, group_rows), radius)


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42, radius: int = 2, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of docs: the fingerprint in hex, and the smallest id within reach."""
    prints = stored(docs.select(F.col(doc_id).alias("id"), fingerprint(words, seed)(F.col(text).cast("string")).alias("fp")), "fingerprints")
    named = component_names(prints.groupBy("fp").agg(F.min("id").alias("least")), radius, group_rows)
    out = prints.join(named, "fp", "left")
    return out.select(F.col("id").alias(doc_id), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def component_names(least: DataFrame, radius: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Rows (fp, component) from distinct fingerprints (fp, least): the smallest least of all fingerprints within reach."""
    nodes = stored(least, "nodes")
    return names_of(nodes, fingerprint_links(nodes.select("fp"), radius, group_rows))


def radius_of(similarity: float) -> int:
    """Bits in which the fingerprints of sets of that Jaccard similarity may well differ: the share of bits is the angle between the sets over pi, from which SAFETY standard deviations are counted."""
    share = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return min(BITS, int(BITS * share + SAFETY * math.sqrt(BITS * share * (1 - share))))


def signature(words: int, bands: int, band_rows: int, seed: int):
    """A column function: the digest of a text's shingle set as node, the fingerprint of the set, and a key for each band of its minima."""
    shipped()
    rng = np.random.default_rng(seed)
    factors, offsets = rng.integers(0, 1 << 64, (2, bands * band_rows), np.uint64)
    factors |= np.uint64(1)

    @F.arrow_udf("struct<node: long, fp: long, keys: array<long>>")
    def sign(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in (part[i : i + RUN] for part in parts for i in range(0, len(part), RUN)):
            data, at = text_bytes(column)
            text = memoryview(data)
            nodes, prints, keys = np.zeros(len(column), np.uint64), np.zeros(len(column), np.uint64), np.zeros((len(column), bands), np.uint64)
            for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                own = shingle_set(bytes(text[a:b]), words, seed)
                nodes[i], prints[i] = xxhash.xxh64_intdigest(own.tobytes(), seed), majority(own)
                least = minima(own, factors, offsets).reshape(bands, band_rows)
                keys[i] = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(column) + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(nodes.view(np.int64)), pa.array(prints.view(np.int64)), lists], ["node", "fp", "keys"])

    return sign


def similar_links(texts: DataFrame, clusters: DataFrame, *, words: int, similarity: float, seed: int, group_chars: int = GROUP_CHARS) -> DataFrame:
    """Links (a, b) between nodes of texts (node, text) that lead from each to all it reaches over pairs of the similarity, within its cluster (node, root, chars)."""
    counts = clusters.groupBy("root").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"))
    blocks = F.greatest(F.lit(1), F.least("n", F.ceil(F.col("chars") / F.lit(group_chars)))).cast("int")
    placed = clusters.select("node", "root").join(counts, "root").select("node", "root", blocks.alias("blocks"))
    sets = texts.join(placed, "node").select("node", "root", "blocks", shingle_bytes(words, seed)(F.col("text")).alias("hashes"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = sets.select("node", "root", "hashes", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    grouped = dealt.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "hashes")

    def compare(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        a, b = similar([np.frombuffer(h, np.uint64) for h in group.column("hashes").to_pylist()], similarity)
        return pa.table({"a": pa.array(node[a]), "b": pa.array(node[b])})

    return grouped.groupBy("group").applyInArrow(compare, "a long, b long").distinct()


def _least(doc_id: str, row: str):
    """Of a node's rows the one that stays: the smallest id, of repeated ids one row; a row without an id only where there is no other."""
    return F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col(row).alias("row")))


def drop_near_duplicates(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 3, seed: int = 42, radius: int = 2, group_rows: int = GROUP_ROWS,
    similarity: float | None = None, bands: int = 24, band_rows: int = 5, group_chars: int = GROUP_CHARS,
) -> DataFrame:
    """docs with one row of each component, within radius of fingerprints or, if given, of a similarity of shingle sets: that of the smallest id, of repeated ids one row; a row without an id stays only where its component has no id.

    Rows that go, and rows whose sets are compared, are joined to the stored texts by a broadcast while they are few, so that texts don't move, else by a shuffle.
    """
    sign, row = fresh(docs, "sign"), fresh(docs, "row")
    t = F.col(text).cast("string")
    made = signature(words, bands, band_rows, seed)(t) if similarity is not None else F.struct(fingerprint(words, seed)(t).alias("node"))
    full = stored(docs.withColumns({sign: made, row: F.monotonically_increasing_id()}), "documents")
    every = full.groupBy(F.col(f"{sign}.node").alias("node"))
    if similarity is None:
        nodes = stored(every.agg(_least(doc_id, row).alias("least")), "nodes")
        links = fingerprint_links(nodes.select(F.col("node").alias("fp")), radius, group_rows)
    else:
        nodes = stored(every.agg(_least(doc_id, row).alias("least"), F.first(f"{sign}.fp").alias("fp"), F.first(f"{sign}.keys").alias("keys"), F.max(F.length(t)).cast("long").alias("chars")), "nodes")
        keyed = nodes.select("node", "fp", F.explode("keys").alias("key"))
        near = components(group_links(candidate_groups(keyed, group_rows), radius_of(similarity)))
        clusters = stored(near.join(nodes.select("node", "chars"), "node"), "clusters")
        shown = stored(nodes.join(clusters, "node", "left_semi").select(F.col("least.row").alias(row), "node"), "shown")
        texts = full.select(row, t.alias("text")).join(sized(shown), row).select("node", "text")
        links = similar_links(texts, clusters, words=words, similarity=similarity, seed=seed, group_chars=group_chars)
    named = names_of(nodes.select(F.col("node").alias("fp"), "least"), links).select(F.col("fp").alias("node"), F.col("component.row").alias("stays"))
    gone = stored(full.select(row, F.col(f"{sign}.node").alias("node")).join(named, "node").where(F.col(row) != F.col("stays")).select(row), "gone")
    return full.join(sized(gone), row, "left_anti").select(*[full[c] for c in docs.columns])


def op10(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
