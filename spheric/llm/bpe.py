"""BPE encoding and decoding by a queue of merge ranks over a doubly linked symbol list.

The vocabulary file (the public JSON layout of the tokenizers library) is a parameter. A word's symbols form a linked
list; a heap holds the rank of every neighbouring pair; the least rank is merged first, and an entry whose pair has
changed since is stale and skipped. Words between white space are encoded once and kept, so a text costs a lookup a word.

A null text counts as an empty one: no ids, and the empty string decoded. Strings of the file's added tokens in a text
become their ids, as the library does by default. Rows are encoded one by one; repeated rows, null ids and further
columns pass unchanged.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, pre_tokenizers

from spheric.llm.common import shipped

#: A worker keeps the ids of words of up to so many bytes in all, two hundred more counted for each; then it starts anew. Longer words than KEPT_CHARS are encoded each time.
KEPT_BYTES, KEPT_CHARS = 160 << 20, 64
#: Characters below this are normalised and split here; the library's own tables, whose Unicode version may differ, do it for words with others.
PLAIN = re.compile("[\x00-\x7f\xc0-įı-ɏ]*").fullmatch
#: Python's white space takes in these four separators, the vocabulary file's doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]").search
SPACES = re.compile(r"[^\S\x1c-\x1f]+")
#: Stands where a symbol was merged away; no pair with it has a rank.
NONE = (1 << 20) - 1
ENCODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else one of those from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Kept(dict):
    """What make gives for each key, kept up to KEPT_BYTES and then forgotten, so that words of a changing corpus don't stay out."""

    def __init__(self, make, always: dict | None = None) -> None:
        super().__init__(always or {})
        self.make, self.always, self.size = make, always or {}, 0

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= KEPT_CHARS:
            self.size += 200 + len(key) + len(found)
            if self.size > KEPT_BYTES:
                self.clear()
                self.update(self.always)
                self.size = 0
            self[key] = found
        return found


class Bpe:
    """A vocabulary whose words end in a suffix: normalised, split by a pattern, the bytes of each word merged."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model = held["model"]
        kinds = [x["type"] for x in (held["normalizer"] or {"normalizers": []})["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or held["decoder"] is not None or model["type"] != "BPE":
            raise ValueError(f"{path} isn't a word BPE of the kind this module reads")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        split = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.special = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.names = [""] * (1 + max([*self.vocab.values(), *self.added.values()]))
        for names in (self.vocab, self.added):
            for name, i in names.items():
                self.names[i] = name
        #: Pairs of ids to the rank of their merge and the id they make, in one number.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a] << 20 | self.vocab[b]] = (rank + 1) << 20 | self.vocab[a + b]
        symbols = byte_symbols()
        self.inner = [self.vocab.get(s) for s in symbols]
        self.last = [self.vocab.get(s + self.suffix) for s in symbols]
        self.kept = Kept(self.chunk, {name: struct.pack("<I", i) for name, i in self.added.items()})
        self.library = Tokenizer.from_file(path)
        self.splitter = pre_tokenizers.Split(Regex(split), "removed", invert=True)

    def merge(self, ids: list[int]) -> list[int]:
        """Merges neighbours, least rank first, of equal ranks the leftmost. The list's end holds a symbol that pairs with none, before and after the rest."""
        n, find = len(ids), self.merges.get
        heap = [(m >> 20) << 32 | i for i in range(n - 1) if (m := find(ids[i] << 20 | ids[i + 1]))]
        if len(heap) > 1:
            heapify(heap)
        if heap:
            ids.append(NONE)
            after, before = list(range(1, n + 2)), list(range(-1, n))
            while heap:
                entry = heappop(heap)
                i = entry & 0xFFFFFFFF
                j = after[i]
                m = find(ids[i] << 20 | ids[j])
                if not m or m >> 20 != entry >> 32:
                    continue  # stale: a symbol is gone or another by now
                made = m & 0xFFFFF
                ids[i], ids[j] = made, NONE
                k = after[i] = after[j]
                before[k] = i
                if m := find(made << 20 | ids[k]):
                    heappush(heap, (m >> 20) << 32 | i)
                h = before[i]
                if h >= 0 and (m := find(ids[h] << 20 | made)):
                    heappush(heap, (m >> 20) << 32 | h)
            return [x for x in ids if x != NONE]
        return ids

    def word(self, word: str) -> list[int]:
        raw = word.encode()
        ids = [*(self.inner[b] for b in raw[:-1]), self.last[raw[-1]]]
        return self.merge([x for x in ids if x is not None])

    def chunk(self, chunk: str) -> bytes:
        """The ids, as 32-bit numbers, of a run of characters without white space."""
        if not PLAIN(chunk):
            normal = self.library.normalizer.normalize_str(chunk)
            return b"".join([self.ids_of(word) for word, _ in self.splitter.pre_tokenize_str(normal)])
        words = self.split.findall(chunk.lower())
        return self.ids_of(chunk) if words == [chunk] else b"".join([self.kept[word] for word in words])

    def ids_of(self, word: str) -> bytes:
        ids = self.word(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def texts(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """The ids and the decoded string of each text."""
        find = self.kept.__getitem__
        for text in texts:
            ids = b"".join(map(find, self.parts(text)))
            yield ids, self.decode(memoryview(ids).cast("I"))

    def parts(self, text: str) -> list[str]:
        """Runs between white space, and the added tokens; no word crosses these."""
        if self.special is not None and any(x in text for x in self.added):
            pieces = self.special.split(text)
            return [y for i, x in enumerate(pieces) for y in ([x] if i % 2 else self.spaced(x))]
        return self.spaced(text)

    @staticmethod
    def spaced(text: str) -> list[str]:
        return [x for x in SPACES.split(text) if x] if SEPARATORS(text) else text.split()

    def decode(self, ids) -> str:
        """The vocabulary's strings, one space between."""
        return " ".join(map(self.names.__getitem__, ids))


_LOADED: dict[str, Bpe] = {}


def bpe(path: str):
    """A column function: (n_tokens, ids as little-endian 32-bit numbers, decoded). path must lead to the file on every executor."""
    shipped()

    @F.arrow_udf(ENCODED)
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if path not in _LOADED:
            _LOADED[path] = Bpe(path)
        coder = _LOADED[path]
        for column in parts:
            ids, decoded = [], []
            for i in range(0, len(column), 256):
                for a, b in coder.texts([x or "" for x in column[i : i + 256].to_pylist()]):
                    ids.append(a)
                    decoded.append(b)
            yield pa.StructArray.from_arrays([pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ENCODED.names)

    return encode


def encode_documents(docs: DataFrame, path: str, *, text: str = "text", into: str = "bpe") -> DataFrame:
    """docs with the struct column (n_tokens, ids, decoded); into replaces a column of that name."""
    return docs.withColumn(into, bpe(path)(F.col(text).cast("string")))


def op3(spark, sf_dir: str) -> DataFrame:
    """The contract's digest columns for every row of documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "bpe.n_tokens", F.sha2("bpe.ids", 256).alias("ids_sha256"), F.sha2(F.col("bpe.decoded").cast("binary"), 256).alias("decoded_sha256"))
