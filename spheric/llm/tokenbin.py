"""Token ids in binary files: ids ranked by frequency, in byte-aligned variable-length coding with separate control bytes.

A shard file holds whole documents in ascending order of their ids:

    8 bytes  b"SPHSVB1\\n"
    5 x u64  documents d, ids n, control bytes c = ceil(n / 4), data bytes b, 0
    d x i64  document ids         d x u8  1 where the id is null
    d x u64  ids of each document, its end id included
    c x u8   two bits for each id, lowest first: the bytes of its rank less one
    b x u8   the ranks, little-endian, in one to four bytes each

All numbers are little-endian. Ranks are those of the whole corpus, so that the 256 most frequent ids take one byte; the
ranks stand in the catalogue beside the shards. A reader looks the four lengths of a control byte up in a table.

A null text counts as an empty one, which is its end id alone. Null ids come first; rows that repeat stay, each with a
place of its own. An empty table makes no shard.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spheric.llm.bpe import Kept, byte_symbols
from spheric.llm.common import new_folder, shipped, stored, text_bytes

MAGIC = b"SPHSVB1\n"
#: Bytes that a worker's known pieces take before they are forgotten, two hundred counted for each besides its characters and ids.
KEPT_BYTES = 240 << 20
#: Bytes of texts whose pieces are looked up together, more or less: a text is never cut.
RUN_BYTES = 4 << 20
#: Ids in a shard, more or less: a document is never cut.
SHARD_IDS = 4 << 20
#: For each control byte the lengths of its four ids.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)
#: A space between two characters that aren't white space starts a new run; a line feed between such stands alone.
CLEAN, LINE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"(?<=\S)(\n)(?=\S)")
#: Characters that Unicode, or Python, takes for white space, but for space and line feed.
OTHER_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: These end a run of letters as one piece of their own. An apostrophe may begin a piece with letters.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

#: The byte-level vocabulary's own pattern, and the characters that stand for bytes.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
SYMBOLS = dict(enumerate(byte_symbols()))
#: Runs of these alone are split here and go straight to the library's merges; others take the library's whole way, as its Unicode tables may differ.
PLAIN = re.compile("[\t-\r -~\xc0-ɏ]*").fullmatch


class Pieces:
    """The ids of text pieces, one after another in a pool; two dictionaries give the places of bare pieces and of those after a space. Beyond KEPT_BYTES all is forgotten."""

    def __init__(self, dtype: np.dtype) -> None:
        self.places: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, dtype), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.n, self.used, self.kept = 0, 0, 0

    def of(self, spaced: bool, name: str) -> list[int] | None:
        at = self.places[spaced].get(name)
        return None if at is None else self.pool[self.starts[at] : self.starts[at] + self.sizes[at]].tolist()

    def add(self, spaced: bool, names: list[str], ids: list[list[int]]) -> None:
        first, n = self.n, len(names)
        flat = np.array([x for own in ids for x in own], self.pool.dtype)
        sizes = np.fromiter(map(len, ids), np.int32, n)
        if first + n > len(self.starts):
            room = np.zeros(first + 2 * n, np.int32)
            self.starts, self.sizes = np.concatenate([self.starts, room]), np.concatenate([self.sizes, room])
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.used + 2 * len(flat), self.pool.dtype)])
        self.pool[self.used : self.used + len(flat)] = flat
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[first : first + n] = sizes
        self.places[spaced].update(zip(names, range(first, first + n), strict=True))
        self.n += n
        self.used += len(flat)
        self.kept += 200 * n + sum(map(len, names)) + flat.nbytes


class Encoder:
    """The library's ids of texts, put together from those of their pieces, which the vocabulary's pattern never joins. Each is encoded once for many texts."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        pre = json.loads(self.library.to_str())["pre_tokenizer"]
        if pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError(f"{path} isn't a byte-level BPE of the kind this module reads")
        self.library.no_truncation()
        self.library.no_padding()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(True) <= 1 << 16 else "<u4")
        self.tokenize = self.library.model.tokenize
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.known = Pieces(self.dtype)
        self.marks = Kept(self.merged)

    def merged(self, piece: str) -> list[int]:
        """The ids of one piece of the pattern, by the library's merges."""
        return [x.id for x in self.tokenize(piece.encode().decode("latin-1").translate(SYMBOLS))]

    def piece(self, text: str, before: str) -> list[int]:
        """The ids of a text without a space inside, after a space or not."""
        if text.isalpha() and PLAIN(text):
            return self.merged(before + text)
        core = text.rstrip(MARKS)
        if len(core) < len(text) and core.isalpha() and PLAIN(core) and not any(x in text for x in self.added):
            return (self.known.of(before != "", core) or self.merged(before + core)) + self.marks[text[len(core) :]]
        if PLAIN(text) and not any(x in text for x in self.added):
            return [i for x in PATTERN.findall(before + text) for i in self.merged(x)]
        return self.library.encode(before + text, add_special_tokens=False).ids

    def pieces(self, texts: list[str], before: str) -> list[list[int]]:
        tokenize, space, piece = self.tokenize, SYMBOLS[32] if before else "", self.piece
        return [[i.id for i in tokenize(space + x)] if x.isascii() and x.isalpha() else piece(x, before) for x in texts]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, and how many each text has."""
        n, known = len(texts), self.known
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        bounds = np.asarray(split.offsets) - split.offsets[0].as_py()
        held = pc.dictionary_encode(split.flatten())
        names, code = held.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(held.indices)
        # a text is plain if it has single spaces and line feeds between words, and no white space else
        odd = pc.or_(pc.equal(pc.binary_length(held.dictionary), 0), pc.match_substring_regex(held.dictionary, OTHER_SPACE)).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(n, dtype=np.int32), np.diff(bounds))
        if odd.any() and (mixed := np.bincount(row, odd[code], n) > 0).any():
            return self.mixed(texts, ~mixed)
        bare = np.zeros(len(code) + 1, bool)
        bare[bounds[:-1]] = True
        line = names.index("\n") if "\n" in names else -1
        at_line = code == line
        bare[1:] |= at_line
        bare = bare[:-1] | at_line
        if known.kept > KEPT_BYTES:
            known.__init__(self.dtype)
        place = np.zeros(len(code), np.int32)
        for spaced in (False, True):
            own = np.flatnonzero(bare != spaced)
            used = np.flatnonzero(np.bincount(code[own], minlength=len(names)))
            some = names if len(used) == len(names) else [names[i] for i in used.tolist()]
            find = known.places[spaced].get
            found = list(map(find, some))
            if None in found:
                new = [x for x, at in zip(some, found, strict=True) if at is None]
                known.add(spaced, new, self.pieces(new, " " if spaced else ""))
                found = list(map(find, some))
            where = np.zeros(len(names), np.int32)
            where[used] = found
            place[own] = where[code[own]]
        size = known.sizes[place]
        before = np.cumsum(size, dtype=np.int32)
        at = np.repeat(known.starts[place] - before + size, size)
        at += np.arange(len(at), dtype=np.int32)
        return known.pool[at], np.diff(np.concatenate([np.zeros(1, np.int32), before])[bounds]).astype(np.int64)

    def mixed(self, texts: pa.Array, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ids, where some texts aren't plain: those are parted at spaces between two characters that aren't white space, and encoded by themselves."""
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(plain)
        if plain.any():
            some = np.flatnonzero(plain)
            ids, sizes = self.ids(texts.take(pa.array(some)))
            for i, part in zip(some.tolist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = part
        for i in np.flatnonzero(~plain).tolist():
            if text := texts[i].as_py():
                first, *rest = CLEAN.split(text)
                out[i] = np.array([x for x, before in [(first, ""), *((y, " ") for y in rest)] for x in self.run(x, before)], self.dtype)
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def run(self, text: str, before: str) -> list[int]:
        """The ids of what stands between two clean spaces; line feeds in it that stand alone part it too."""
        first, *rest = LINE.split(text)
        return [*self.piece(first, before), *(i for x in rest for i in self.piece(x, ""))]


_LOADED: dict[str, Encoder] = {}


def token_ids(path: str, end_id: int | None = 0):
    """A column function: the ids of a text in little-endian numbers of two bytes (four for more than 65,536 ids), with end_id after them."""
    shipped()

    @F.arrow_udf("binary")
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _LOADED:
            _LOADED[path] = Encoder(path)
        coder = _LOADED[path]
        for column in parts:
            column, out = column.cast(pa.large_string()).fill_null(""), []
            _, at = text_bytes(column)
            first = 0
            while first < len(column):
                last = max(first + 1, int(np.searchsorted(at, at[first] + RUN_BYTES, "right")) - 1)
                ids, sizes = coder.ids(column[first:last].cast(pa.string()))
                if end_id is not None:
                    ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                ends = np.concatenate([[0], np.cumsum(sizes) * coder.dtype.itemsize]).astype(np.int32)
                out.append(pa.Array.from_buffers(pa.binary(), last - first, [None, pa.py_buffer(ends), pa.py_buffer(ids)]))
                first = last
            yield pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return encode


def pack(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes."""
    ranks, planes = ranks.astype(np.uint32), max(1, (int(ranks.max(initial=0)).bit_length() + 7) // 8)
    more = np.zeros(len(ranks), np.uint8)
    for k in range(1, planes):
        more += ranks >= 1 << 8 * k
    quads = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    quads[: len(ranks)] = more
    quads = quads.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    at = np.cumsum(more, dtype=np.int64) - more + np.arange(len(ranks))
    data = np.zeros(len(ranks) + int(more.sum(dtype=np.int64)), np.uint8)
    for k in range(planes):
        own = slice(None) if k == 0 else np.flatnonzero(more >= k)
        data[at[own] + k] = (ranks[own] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.astype(np.uint8), data


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks."""
    size = LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    ranks = data[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        own = np.flatnonzero(size > k)
        ranks[own] |= data[at[own] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def shard_bytes(doc_ids: list[int | None], ids: list[bytes], dtype: np.dtype, rank_of: np.ndarray) -> bytes:
    sizes = np.array([len(x) for x in ids], "<u8") // dtype.itemsize
    control, data = pack(rank_of[np.frombuffer(b"".join(ids), dtype)])
    head = np.array([len(ids), sizes.sum(), len(control), len(data), 0], "<u8")
    none = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, head.tobytes(), np.array([x or 0 for x in doc_ids], "<i8").tobytes(), none.tobytes(), sizes.tobytes(), control.tobytes(), data.tobytes()])


def read_shard(raw: bytes, id_of: np.ndarray) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The document ids, the number of ids of each, and all ids."""
    if raw[:8] != MAGIC:
        raise ValueError("not a shard of token ids")
    d, n, c, b, _ = np.frombuffer(raw, "<u8", 5, 8).tolist()
    names, at = np.frombuffer(raw, "<i8", d, 48).tolist(), 48 + 8 * d
    none, at = np.frombuffer(raw, np.uint8, d, at), at + d
    sizes, at = np.frombuffer(raw[at : at + 8 * d], "<u8").astype(np.int64), at + 8 * d
    ranks = unpack(np.frombuffer(raw, np.uint8, c, at), np.frombuffer(raw, np.uint8, b, at + c), n)
    return [None if x else i for i, x in zip(names, none, strict=True)], sizes, id_of[ranks]


def _counts(dtype: np.dtype):
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in parts:
            for i in range(0, part.num_rows, 512):
                some = np.bincount(np.frombuffer(b"".join(part.column(0)[i : i + 512].to_pylist()), dtype))
                if len(some) > len(total):
                    some, total = total, some
                total[: len(some)] += some
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], ["id", "n"])

    return count


def write_shards(docs: DataFrame, path: str, folder: str, *, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 0, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes docs to folder and returns its catalogue: a row (part, shard, file, n_docs, n_ids, first) for each shard, first being the ids in all shards before it.

    The texts are encoded once and their ids kept in the shared folder; ranks come from the counts of all of them. Only
    the counts, one row for each id of the vocabulary at most, and the catalogue pass the driver.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).cast("long").alias("id"), token_ids(path, end_id)(F.col(text).cast("string")).alias("ids")).withColumn("row", F.monotonically_increasing_id())
    kept = stored(kept, "token-ids")
    dtype = Encoder(path).dtype
    counts = kept.select("ids").mapInArrow(_counts(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    order = np.array([r.id for r in sorted(counts, key=lambda r: (-r.n, r.id))], np.int64)
    rank_of = np.zeros(1 + int(order.max(initial=0)), np.uint32)
    rank_of[order] = np.arange(len(order))
    shared = spark.sparkContext.broadcast(rank_of)

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = FileSystem.from_uri(folder)
        task, shard, names, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        fs.create_dir(root, recursive=True)

        def put() -> pa.RecordBatch:
            file = f"{task:06d}-{shard:06d}-{uuid.uuid4().hex}.svb"  # a task that runs twice leaves a file that no catalogue names
            with fs.open_output_stream(f"{root}/{file}") as out:
                out.write(shard_bytes(names, ids, dtype, shared.value))
            return pa.RecordBatch.from_pydict({"part": [task], "shard": [shard], "file": [file], "n_docs": [len(names)], "n_ids": [size // dtype.itemsize]})

        for part in parts:
            for name, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if ids and size + len(x) > shard_ids * dtype.itemsize:
                    yield put()
                    shard, names, ids, size = shard + 1, [], [], 0
                names.append(name)
                ids.append(x)
                size += len(x)
        if ids:
            yield put()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = kept.repartitionByRange(n, "id", "row").sortWithinPartitions("id", "row").select("id", "ids")
    catalogue = stored(dealt.mapInArrow(write, "part long, shard long, file string, n_docs long, n_ids long"), "catalogue")
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    catalogue.withColumn("first", before).coalesce(1).write.parquet(f"{folder}/catalogue")
    spark.createDataFrame([(json.dumps(order.tolist()),)], "ranks string").coalesce(1).write.text(f"{folder}/ranks")
    return spark.read.parquet(f"{folder}/catalogue")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids) from the shards that folder's catalogue names: start is the ids before the document, ids little-endian 32-bit numbers."""
    id_of = spark.sparkContext.broadcast(np.array(json.loads("".join(r[0] for r in spark.read.text(f"{folder}/ranks").collect())), np.uint32))

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = FileSystem.from_uri(folder)
        for part in parts:
            for file, first in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(f"{root}/{file}") as stream:
                    names, sizes, ids = read_shard(stream.read(), id_of.value)
                end = np.cumsum(sizes)
                for i in range(0, len(names), 1000):
                    some = slice(i, i + 1000)
                    raw = [ids[b - n : b].astype("<u4").tobytes() for b, n in zip(end[some].tolist(), sizes[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(names[some], pa.int64()), pa.array(first + end[some] - sizes[some]), pa.array(sizes[some]), pa.array(raw, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    catalogue = spark.read.parquet(f"{folder}/catalogue").select("file", "first")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return catalogue.repartition(n, "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and digest, from the files."""
    import public_tokenizers

    folder = new_folder(spark, "token-shards")
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
