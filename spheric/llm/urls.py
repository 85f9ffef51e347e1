"""URL filters: a blocked Bloom filter of listed keys passes possible hits to an exact hash join, which removes the false ones.

Built-in functions only. A listed key is a rule's host and path, or a canonical URL. A URL's own keys are its host's
endings with its path's beginnings of the lengths that rules have, and its canonical form; each is probed in the filter,
and what passes is joined with the list. URLs are judged once each, however many pages have them.

A null URL, and one without "://", has an empty host and path, fits no rule and gets the default verdict; URLs of any length
are taken whole, in time that grows with them. Rows that repeat are judged alike; further columns, of any name, stay, but for
those of the result's names. Of equally long rules the later in order wins, then block before allow. An empty list lets
everything through; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import fresh, stored

#: A filter of up to this many blocks is broadcast; of more, keys meet their blocks by a shuffle, each block in SALTS copies, as very many URLs may share a key.
MAX_BLOCKS, SALTS = 1 << 16, 16
#: Each block has four words of 64 bits and a key sets one bit in each; so many keys share a block on average.
KEYS_PER_BLOCK = 16
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str


#: The contract's rules.
RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    """From behind the first "://" up to a slash, question mark, hash or the end; capitals become small."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def canonical(host: Column, path: Column) -> Column:
    """Host and path without a closing slash: schemes, queries and fragments make no difference. No form for an empty host."""
    return F.when(host != "", F.concat(host, F.rtrim(path, F.lit("/"))))


def _bits(key: Column, blocks: int) -> list[Column]:
    """The block of a key and its mask in each of the block's words."""
    block, spread = F.pmod(F.xxhash64(key), F.lit(blocks)), F.xxhash64(key, F.lit(1))
    return [block, *[F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]]


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0..w3) of the filter of the column key."""
    block, *masks = _bits(F.col("key"), blocks)
    marked = keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def possible(candidates: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The candidates whose key the list's filter may hold: all listed ones, and few others."""
    count = listed.count()
    blocks = 1 << max(0, (count // KEYS_PER_BLOCK).bit_length())
    words = bloom_filter(listed, blocks)  # blocks rows of five numbers at most
    block, *masks = _bits(F.col("key"), blocks)
    tested = candidates.withColumns({"block": block, **{f"m{i}": m for i, m in enumerate(masks)}})
    if blocks <= max_blocks:
        tested = tested.join(F.broadcast(words), "block")
    else:
        salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        tested = tested.withColumn("salt", F.pmod(F.xxhash64(*candidates.columns), F.lit(SALTS)).cast("int")).join(salted, ["block", "salt"])
    for i in range(4):
        tested = tested.where(F.col(f"w{i}").bitwiseAND(F.col(f"m{i}")) == F.col(f"m{i}"))
    return tested.select(*candidates.columns)


def judge_urls(pages: DataFrame, rules: tuple[UrlRule, ...], listed: DataFrame | None = None, *, url: str = "url", default: str = "allow", listed_verdict: str = "block", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """pages with the columns host, path, rule and verdict. listed has a column url of canonical URLs, which decide where no rule does. The list is worked out once and kept in the shared folder."""
    spark = pages.sparkSession
    columns = "key string, rule string, said string, size int"
    fixed = spark.createDataFrame([(f"rule:{r.host}{r.path}", f"{r.host}{r.path}", r.verdict, len(r.host + r.path)) for r in rules], columns)
    held = spark.createDataFrame([], columns) if listed is None else stored(listed.where("url is not null").select(F.concat(F.lit("url:"), "url").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(listed_verdict).alias("said"), F.lit(-1).alias("size")).distinct(), "listed")
    labels = max([r.host.count(".") + 1 for r in rules], default=0)
    sizes = sorted({len(r.path) for r in rules})
    own = pages.select(F.col(url).alias("u")).where(F.col(url).isNotNull()).distinct().withColumns({"h": host_of(F.col("u")), "p": path_of(F.col("u"))}).where("h <> ''")
    ends = [F.substring_index("h", ".", -k) for k in range(1, labels + 1)]
    keys = [F.when(F.length("p") >= n, F.concat(F.lit("rule:"), end, F.substring("p", 1, n))) for end in ends for n in sizes]
    keys.append(F.concat(F.lit("url:"), canonical(F.col("h"), F.col("p"))))
    probes = own.select("u", F.explode(F.array_distinct(F.array(*keys))).alias("key")).where("key is not null")
    passed = possible(probes, fixed.select("key").union(held.select("key")), max_blocks)
    # rules are a handful, and very many URLs fit one: they are broadcast
    hits = passed.where("key like 'rule:%'").join(F.broadcast(fixed), "key").union(passed.where("key like 'url:%'").join(held, "key"))
    best = hits.groupBy("u").agg(F.max(F.struct("size", "rule", "said")).alias("best"))
    name, found = fresh(pages, "u"), fresh(pages, "best")
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    u = F.coalesce(F.col(url), F.lit(""))
    judged = pages.withColumn(name, F.col(url)).join(best.select(F.col("u").alias(name), F.col("best").alias(found)), name, "left")
    return judged.select(*[judged[c] for c in kept], host_of(u).alias("host"), path_of(u).alias("path"), F.col(f"{found}.rule").alias("rule"), F.coalesce(F.col(f"{found}.said"), F.lit(default)).alias("verdict"))


def shared_urls(pages: DataFrame, url: str = "url") -> DataFrame:
    """A list to block: the canonical URLs that more than one page has, which are copies of one address."""
    form = canonical(host_of(F.col(url)), path_of(F.col(url)))
    return pages.select(form.alias("url")).where("url is not null").groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("url")


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of pages; the list is that of shared_urls."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES, shared_urls(pages)).select("page_id", "host", "path", "rule", "verdict")
