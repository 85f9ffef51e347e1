"""Each text operator against brute force or an exact round trip, on nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spheric.llm import bpe, decontaminate, graph, pii, quality, shards, simhash, tokenbin, toxicity, urls, warc

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# 1


@pytest.mark.parametrize("set_bytes", [1 << 20, 200])
def test_decontamination_is_brute_force(spark, docs, set_bytes):
    items = [(1, "brown fox jumps over the lazy dog again and again today"), (2, "LINE one-here"), (3, None), (4, "..."), (None, "word"), (5, "line one here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
    grams = {}
    for i, t in items:
        w = split(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[a : a + k]), set()).add(i)
    found = decontaminate.find_contamination(docs, bench, set_bytes=set_bytes).collect()
    for r in found:
        w, own = split(r.text), set()
        hit = [False] * len(w)
        for g, i in grams.items():
            for a in range(len(w) - len(g) + 1):
                if tuple(w[a : a + len(g)]) == g:
                    own |= i
                    hit[a : a + len(g)] = [True] * len(g)
        c = r.contamination
        assert (c.n_words, c.n_hit, c["items"]) == (len(w), sum(hit), sorted(str(x) for x in own if x is not None))
    for how in ("documents", "spans"):
        clean = decontaminate.decontaminate(docs, bench, remove=how, set_bytes=set_bytes)
        assert clean.columns == docs.columns and decontaminate.find_contamination(clean, bench).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs, bench, remove="spans").count() == docs.count()


def test_set_of_windows_stays_small(spark):
    rng = np.random.default_rng(4)
    items = [(str(i), " ".join(f"w{x}" for x in rng.integers(0, 10**5, 300))) for i in range(300)]
    held = decontaminate.GramSet(iter(items), 10)
    assert held.nbytes() < decontaminate.BYTES_EACH * sum(len(t) for _, t in items)


def test_columns_of_any_name_pass(spark):
    docs = spark.createDataFrame([(1, "one two three", "a", "b", "c", "d")], "doc_id long, text string, part string, contamination string, __part string, parts string")
    bench = spark.createDataFrame([(1, "two"), (2, "four five")], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, bench, remove="spans", set_bytes=20)
    assert clean.columns == docs.columns and [*clean.first()] == [1, "one  three", "a", "b", "c", "d"]
    assert quality.ledger(docs).first().parts == "d"


def test_decontamination_of_nothing(spark, docs, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, bench).where("contamination.n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0


# 2


def test_toxicity_learns_misspellings(spark):
    rng = np.random.default_rng(0)
    plain = ["".join(rng.choice(list("aeioubcdlmnrst"), 5)) for _ in range(300)]
    rows = [(i, " ".join([*rng.choice(plain, 30), *(["frobnicator" + rng.choice(["", "s", "x"])] * (i % 2))])) for i in range(200)]
    docs = spark.createDataFrame([*rows, (None, None), (900, "")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(i, i % 2) for i, _ in rows], (3, 1), (None, 1), (7, None), (5000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    new = spark.createDataFrame([(" ".join([*rng.choice(plain, 30), "frobniicator"]), 1), (" ".join(rng.choice(plain, 31)), 0)] * 10 + [(None, 0), ("", 0)], "text string, y int")
    got = new.select(toxicity.toxicity(model, spark)(F.col("text")).alias("s"), "y", "text").collect()
    assert sum((r.s >= 0.5) == bool(r.y) for r in got if r.text) >= 18 and all(0 <= r.s <= 1 for r in got)
    assert toxicity.drop_toxic(docs.where("false"), model=model).count() == 0
    assert toxicity.fit(docs, labels.where("false")).bias < -5


def test_scores_are_brute_force(docs):
    rng = np.random.default_rng(1)
    model = toxicity.Model(-0.25, rng.normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32))
    texts = [r.text or "" for r in docs.collect()] + ["x " * 200_000 + "y", "z" * 700_000]
    for chunk in (1 << 18, 64):
        toxicity.CHUNK, kept = chunk, toxicity.CHUNK
        some = texts if chunk > 64 else [t for t in texts if len(t) < 30_000]
        try:
            data = "".join(some).encode()
            at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in some])])
            got = toxicity.scores(model, np.frombuffer(data, np.uint8), at)
        finally:
            toxicity.CHUNK = kept
        for text, score in zip(some, got.tolist(), strict=True):
            assert score == pytest.approx(slow_score(model, text), abs=1e-6)


def slow_score(model, text):
    """Word by word, n-gram by n-gram."""
    def bucket(gram):
        code = int.from_bytes(gram, "little") * 0x9E3779B97F4A7C15 % 2**64
        return code >> (64 - toxicity.BUCKET_BITS)

    known, means = {}, []
    for word in re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", low(text).encode()).split():
        if word not in known:
            w = b" " + word + b" "
            known[word] = [float(model.table[bucket(w[i : i + n])]) for n in toxicity.GRAMS for i in range(len(w) - n + 1)]
        means.append(known[word])
    if not means:
        return 1 / (1 + np.exp(-model.bias))
    k = min(toxicity.WINDOW, len(means))
    best = max(sum(map(sum, means[i : i + k])) / max(1, sum(map(len, means[i : i + k]))) for i in range(len(means) - k + 1))
    return 1 / (1 + np.exp(-(model.bias + best)))


# 3


def test_bpe_is_the_library(docs, none):
    library = Tokenizer.from_file(WORD)
    for r in bpe.encode_documents(docs, WORD).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.bpe.n_tokens, np.frombuffer(r.bpe.ids, "<u4").tolist(), r.bpe.decoded) == (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert bpe.encode_documents(none, WORD).count() == 0


def test_bpe_on_odd_characters():
    library, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    texts = ["".join(chr(c) for c in range(a, a + 64) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3200, 64)] + ["İ ΣΑΣ", "a" * 500, "'s't I'LL", "x\x85y\x1fz"]
    for text, (ids, decoded) in zip(texts, own.texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


# 4


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://d/", ""), (5, "http://é/", "é" * 70000), (2, "http://b/", "same"), (None, "http://n/", "same")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, packed int")
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(pages, folder, archive_bytes=300), folder).collect()
    largest = {"same": 2, "": 4, "é" * 70000: 5}
    want = sorted((p is not None, p or 0, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", -1) if p == largest[h or ""] else ("revisit", largest[h or ""]))) for p, _, h in rows)
    assert sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to if r.refers_to is not None else -1) for r in got) == want
    assert warc.write_archives(pages.where("false"), folder + "2").count() == 0


def test_normaliser_splits_members():
    records = [warc.record_bytes(i, "http://x/", b"p" * i, warc.digest_of(b"p" * i), i, None) for i in range(5)]
    out = io.BytesIO()
    import gzip

    index = warc.normalise(io.BytesIO(gzip.compress(b"".join(records))), out)
    assert [zlib.decompress(out.getvalue()[at : at + n], 31) for _, at, n, _ in index] == records
    with pytest.raises(ValueError):
        warc.parse_record(io.BytesIO(records[3][:-9]))


def test_archives_of_other_writers_are_normalised(spark, tmp_path):
    import gzip

    odd = b"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <urn:page:7>\r\nX-Note: one\r\n  two\r\ncontent-length:5\r\n\r\nhello\r\n\r\n"
    for i in range(2):
        (tmp_path / f"{i}.warc.gz").write_bytes(gzip.compress(odd * 3 + b"\r\n" + odd))
    names = spark.createDataFrame([("0.warc.gz",), ("1.warc.gz",)], "archive string")
    made = warc.normalise_archives(names, f"file://{tmp_path}", f"file://{tmp_path}/out").collect()
    assert [r.records for r in made] == [4, 4]
    raw = (tmp_path / "out" / made[0].archive).read_bytes()
    import json

    for line in (tmp_path / "out" / f"{made[0].archive}.idx").read_text().splitlines():
        name, at, n, size = json.loads(line)
        fields, block, _ = warc.parse_record(io.BytesIO(zlib.decompress(raw[at : at + n], 31)))
        assert (name, fields["x-note"], block) == ("<urn:page:7>", "one two", b"hello")


# 5


def test_compaction_keeps_rows_and_versions(spark, docs, tmp_path):
    odd = docs.selectExpr("*", "1 as bin", "'f' as file", "2 as __bin", "'g' as __file")
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=2)
    assert store.versions() == []
    for _ in range(2):
        store.append(odd.repartition(3))
    assert store.append(odd.where("false")) == 3
    before = sorted(map(str, store.read().collect()))
    last = store.compact()
    assert last >= 4 and sorted(map(str, store.read().collect())) == before and len(before) == 2 * odd.count() and store.read().columns == odd.columns
    assert store.manifest().count() < store.manifest(3).count() and sorted(map(str, store.read(3).collect())) == before
    assert store.compact() == last and {r.merged for r in store.manifest().collect()} == {True}
    with pytest.raises(ValueError):
        store.append(docs)
    store.vacuum()
    assert store.versions() == [last] and sorted(map(str, store.read().collect())) == before
    empty = shards.ShardStore(spark, f"file://{tmp_path}/e")
    empty.append(odd.where("false"))
    assert empty.compact() == 1 and empty.read(details={"tier": "t"}).count() == 0


def test_of_two_writers_one_gets_the_error(spark, tmp_path):
    rows = spark.range(10).selectExpr("id", "cast(id as string) text")
    first, second = (shards.ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    first.append(rows)
    inner = second._commit

    def late(*args):  # the other writer commits while this one is about to
        second._commit = inner
        first.append(rows.where("id < 5"))
        return inner(*args)

    second._commit = late
    with pytest.raises(RuntimeError):
        second.append(rows)
    assert first.versions() == second.versions() == [1, 2] and second.read().count() == 15
    assert second.append(rows) == 3 and second.read().count() == 25


# 6


def test_variable_length_coding():
    for n in (0, 1, 3, 4, 5, 4001):
        ranks = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32) >> np.random.default_rng(n + 1).integers(0, 32, n).astype(np.uint32)
        control, data = tokenbin.pack(ranks)
        assert len(control) == -(-n // 4) and (tokenbin.unpack(control, data, n) == ranks).all()


def test_shards_hold_every_document(spark, docs, none, tmp_path):
    library = Tokenizer.from_file(BYTE)
    folder = f"file://{tmp_path}/t"
    catalogue = tokenbin.write_shards(docs, BYTE, folder, shard_ids=50)
    rows = sorted(tokenbin.read_shards(spark, folder).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in docs.collect()], key=lambda x: (x is not None, x)) and catalogue.count() > 1
    texts = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == texts
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    tokenbin.write_shards(none, BYTE, folder + "0")
    assert tokenbin.read_shards(spark, folder + "0").count() == 0


def test_runs_are_the_library():
    library, own = Tokenizer.from_file(BYTE), tokenbin.Encoder(BYTE)
    rng = np.random.default_rng(0)
    for text in [" a  b\n\nc \n d\t e", "x\x1cy \x1f z", "日本語 テ　キ", *("".join(rng.choice(list(" \n\tab1.'\x1c\xa0é"), 12)) for _ in range(800))]:
        assert own.ids(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


# 7


def test_ledger_is_brute_force(docs, none):
    for r in quality.ledger(docs).collect():
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = [False] * len(w)
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                hit[i : i + 3] = [True] * 3
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), sum(hit))
    assert quality.ledger(none).count() == 0


def test_policies_and_ablation(docs):
    held = quality.ledger(docs)
    rows = held.collect()
    kept = held.where(quality.verdict(F.col("failures"), quality.BASE)).count()
    assert kept == sum(r.failures & 3 == 0 for r in rows)
    got = {r.rule: (r.failed, r.alone) for r in quality.ablation(held, quality.BASE).collect()}
    assert got == {"short": (sum(r.failures & 1 > 0 for r in rows), sum(r.failures & 3 == 1 for r in rows)), "repeated_words": (sum(r.failures & 2 > 0 for r in rows), sum(r.failures & 3 == 2 for r in rows))}


# 8


def test_urls(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Net", "a.net", "", None, "allow"), ("http://a.NET/x?y#z", "a.net", "/x", "net/", "block"),
        ("https://www.example.net/en/1", "www.example.net", "/en/1", "example.net/en/", "allow"), ("http://badexample.com/de/", "badexample.com", "/de/", None, "allow"),
        ("http://m.example.com/de/?q", "m.example.com", "/de/", "example.com/de/", "block"), ("http://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"),
        ("http://listed.io/p/?a=1", "listed.io", "/p/", None, "block"), ("http://listed.io/pp", "listed.io", "/pp", None, "allow"), ("http://a.b.c/" + "x" * 90000, "a.b.c", "/" + "x" * 90000, None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "old") for i, c in enumerate(cases)] + [(3, cases[3][0], "old")], "page_id long, url string, rule string")
    listed = spark.createDataFrame([("listed.io/p",), (None,), ("listed.io/p",)], "url string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.RULES, listed).collect()]
    assert sorted(got, key=str) == sorted([(i, *c[1:]) for i, c in enumerate(cases)] + [(3, *cases[3][1:])], key=str)
    assert urls.judge_urls(pages.where("false"), urls.RULES, listed).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, ()).collect()} == {"allow"}


@pytest.mark.parametrize("max_blocks", [1 << 16, 4])
def test_bloom_filter_loses_nothing(spark, max_blocks):
    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like 'k1%'")
    passed = urls.possible(keys, listed, max_blocks)
    assert passed.join(listed, "key").count() == listed.count() and passed.count() < listed.count() + 300


# 9


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(s))) % 10 == 0


def base(text):
    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                found.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(found)


def test_base_spans_are_brute_force(spark, docs, none):
    rng = np.random.default_rng(2)
    odd = ["a@b.c_d@e.f a@b.c@d.e", "1.2.3.4.5.6.7.8 0001.02.255.256", "41111111111111112 4111 1111-1111 1111", "+1 +12 +123456789 +1-2-3-4-5-6-7-8-9..", "12 " * 3000, "a" * 20000 + "@b.c"]
    odd += ["".join(rng.choice(list("ab1234@.+- ()é"), 60)) for _ in range(300)]
    more = docs.select("doc_id", "text", "row", "pii").union(spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(odd)], "doc_id long, text string, row long, pii string"))
    for r in pii.find_pii(more, into="found").collect():
        assert [tuple(s) for s in r.found if s.kind < 4] == base(r.text)
    assert pii.find_pii(none).count() == 0 and pii.redact(docs).columns == docs.columns


def test_patterns_find_what_no_kind_covers(spark):
    rng = np.random.default_rng(6)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(6)]
    rows = [(i, f"some words secret: [{h}] more of them") for i, h in enumerate(hexes)] + [(i, f"write to user{i}@mail.example please") for i in range(10, 20)]
    rows += [(20, "write to AB12CD34 please"), (21, "the year was 1999 again"), (22, "the secret: [hunter] is out"), (23, f"{hexes[0]} stands alone"), (24, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: pii_spans(r.pii, r.text) for r in pii.find_pii(docs).collect()}
    assert [got[i] for i in range(6)] == [[h] for h in hexes] and got[20] == ["AB12CD34"] and got[22] == ["hunter"]
    assert got[21] == got[23] == got[24] == [] and got[13] == ["user13@mail.example"]
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[20] == "write to <identifier> please" and out[22] == "the secret: [<identifier>] is out" and out[12] == "write to <email> please" and out[24] is None


def test_patterns_need_different_seeds_and_few_other_words(spark):
    rows = [(i, "call key 0123456789abcdef0123 now") for i in range(50)] + [(100 + i, f"so the {x}") for i, x in enumerate(["10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", *"abcdefghijklmnop"])]
    assert not [s for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.pii if s.kind == 4]


def test_texts_of_very_many_spans(spark):
    many = " ".join(f"10.{i % 256}.{i // 256 % 256}.7 née" for i in range(100_000))
    docs = spark.createDataFrame([(1, many), (2, "word " * 200_000 + "end x@y.example")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.redact(docs).select("doc_id", "text").collect()}
    assert got[1].text == " ".join(["<ip> née"] * 100_000) and got[2].text.endswith("end <email>") and got[2].text.startswith("word word")


def pii_spans(spans, text):
    return [text[s.start : s.end] for s in spans]


# 10


def fingerprint(text, words=3):
    w = re.findall("[^\x20\x09-\x0d]+", low(text))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(top(a), top(b))] = min(top(a), top(b))
    return {n: top(n) for n in nodes}


def test_near_duplicates_are_brute_force(spark, docs, none):
    rows = docs.collect()
    prints = [fingerprint(r.text) for r in rows]
    group = roots([(a, b) for a in set(prints) for b in set(prints) if (a ^ b).bit_count() <= 2], set(prints))
    least = {}
    for r, p in zip(rows, prints, strict=True):
        if r.doc_id is not None:
            least[group[p]] = min(r.doc_id, least.get(group[p], r.doc_id))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((str(r.doc_id), f"{p:016x}", least.get(group[p])) for r, p in zip(rows, prints, strict=True))
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group.values()))
    assert simhash.near_duplicates(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


@pytest.mark.parametrize("group_rows", [8, 2048])
def test_links_join_all_that_is_near(spark, group_rows):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.integers(0, 2**63, 6, dtype=np.uint64), 60)
    for i in range(len(x)):
        for b in rng.integers(0, 64, rng.integers(0, 4)):
            x[i] ^= np.uint64(1) << np.uint64(b)
    x = np.unique(x).view(np.int64)
    links = simhash.fingerprint_links(spark.createDataFrame([(int(v),) for v in x], "fp long"), 2, group_rows)
    got = {r.node: r.root for r in graph.components(links).collect()}
    u = x.view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 2
    want = roots([(int(x[a]), int(x[b])) for a, b in zip(*np.nonzero(near), strict=True)], [int(v) for v in x])
    assert {n: got.get(n, n) for n in want} == want


@pytest.mark.parametrize("size", [30, 700])
def test_bit_sliced_groups(size):
    rng = np.random.default_rng(size)
    x = np.unique(rng.integers(0, 2**63, 4, dtype=np.uint64)[rng.integers(0, 4, size)] ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64)))
    a, b = simhash.linked(x, np.zeros(len(x), np.int64), 2)
    assert (np.bitwise_count(x[a] ^ x[b]) <= 2).all()
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    n = range(len(x))
    assert roots(zip(a.tolist(), b.tolist(), strict=True), n) == roots(list(zip(*np.nonzero(near), strict=True)), n)
