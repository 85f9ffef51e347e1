"""PII: patterns for known kinds and the shape of keys give seed entities; what stands around these makes lexical patterns; a graph of patterns and instances is scored in turns, and patterns of high confidence find identifiers that no known kind covers.

Built-in functions only. Spans are [start, end) in code points, in the text as it is. A null text counts as an empty one
and has no spans. Rows that repeat each count and are each marked, but a pattern needs different instances; null ids are
rows like others. Texts, words and contexts of any length are taken whole, in time that grows with the text alone. An empty
table gives an empty result; further columns, of any name, stay.

A pattern is the word before, the two words before, or the word before and the one after, each with the characters that
lead up to the instance within its own word, such as a quotation mark. An instance is a word from its first letter or digit
on. Known kinds are seeds of score 1; words of the shape of a key (sixteen characters with digits and letters) are seeds of
less, and never marked for their shape alone. A pattern enters the graph if it stands before SUPPORT different seeds and
seeds are ENTRY of all the words it stands before; in the graph its confidence is the mean score of its instances. What a
confident pattern stands before is marked whatever its shape, known kinds apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spheric.llm.common import fresh, let, pieces_of, sized, stored

#: The contract's patterns. Runs that can't end otherwise are possessive, and no match starts within a run
#: that a match would have begun earlier, so each pattern takes time in proportion to the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
#: What white space parts, what may lead up to an identifier within its word, and the identifier; the mark of known kinds.
WORD, GLUE, CORE, MARK = r"[^\x20\x09-\x0D]+", r"^[^\p{L}0-9\x{E000}]*+", r"[\p{L}0-9](?:[\p{L}0-9_.:@/+=-]*[\p{L}0-9=])?", "\ue000"
#: The shape of a key, and the score of a seed for its shape alone.
KEY_CHARS, SHAPED = 16, 0.9
#: What a pattern needs to enter the graph and to mark new spans, and how strongly small support is held back.
ENTRY, CONFIDENCE, SUPPORT, PRIOR, TURNS = 0.3, 0.6, 3, 2.0, 3


def running(sizes: Column, block: int = 256, largest: bool = False) -> Column:
    """The running sums, or largest values so far, of an array: within blocks and then over these, as an array that grows by one value costs its length each time."""
    more = F.greatest if largest else lambda x, y: x + y
    grown = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(more(F.element_at(a, -1), v))))
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(s), F.lit(1)) - 1) / block).cast("int")), lambda b: grown(F.slice(s, b * block + 1, block)))
    whole = lambda inner, outer: F.flatten(F.transform(inner, lambda x, i: F.transform(F.slice(x, 2, block), lambda v: more(v, F.get(outer, i)))))
    return let(sizes, lambda s: let(cut(s), lambda inner: let(grown(F.transform(inner, lambda x: F.element_at(x, -1))), lambda outer: whole(inner, outer))))


def spans_of(text: Column, pattern: str, extra=lambda before, after: {}) -> Column:
    """All matches from the left as structs (start, end, match, ...): the lengths of matches and of what lies between add up to their places. extra gets the text between this match and those next to it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def placed(pair: Column) -> Column:
        m, b = pair["m"], pair["b"]
        sizes = F.transform(m, lambda x, i: F.length(F.get(b, i)) + F.length(x))
        return let(running(sizes), lambda e: F.transform(m, lambda x, i: F.struct(
            (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), x.alias("match"),
            *[c.alias(n) for n, c in extra(F.get(b, i), F.get(b, i + 1)).items()])))

    return let(F.struct(found.alias("m"), between.alias("b")), placed)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes: from the right, every second digit counts twice, of two figures their sum."""
    places = F.sequence(F.lit(1), F.length(number))
    value = lambda i: F.substring(F.reverse(number), i, F.lit(1)).cast("int")
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    total = F.aggregate(F.transform(places, lambda i: F.when(i % 2 == 0, doubled(value(i))).otherwise(value(i))), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(match, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.coalesce(F.when(F.length(x) <= 3, x).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.length(digits(match))
        return F.when((n >= 12) & (n <= 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The known kinds' spans as structs (start, kind, end) in order; kind is the place in KINDS. A text without a kind's sign is not searched for it."""
    signs = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def part(k: int, kind: str, pattern: str) -> Column:
        found = F.filter(spans_of(text, pattern), lambda s: valid(kind, s["match"]))
        return F.when(signs[kind], F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end")))).otherwise(none)

    parts = [part(k, kind, pattern) for k, (kind, pattern) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=True))]
    return F.sort_array(F.concat(*parts))


def masked(text: Column) -> Column:
    """The text with a mark for each character, but white space, of what looks like a known kind: places and words stay as they are."""

    def known(m: Column) -> Column:
        kind = F.when(F.contains(m, F.lit("@")), valid("email", m)).when(m.startswith("+"), valid("phone", m)).when(F.contains(m, F.lit(".")), valid("ip", m)).otherwise(valid("card", m))
        return F.when(kind, F.regexp_replace(m, r"[^\x20\x09-\x0D]", MARK)).otherwise(m)

    pattern = "|".join(f"(?:{x})" for x in (EMAIL, PHONE, IP, CARD))
    clean = F.translate(text, MARK, "?")
    both = F.struct(F.regexp_extract_all(clean, F.lit(pattern), F.lit(0)).alias("m"), F.split(clean, pattern, -1).alias("b"))
    joined = let(both, lambda x: F.array_join(F.transform(x["b"], lambda b, i: F.concat(b, F.coalesce(known(F.get(x["m"], i)), F.lit("")))), ""))
    return F.when(text.rlike("[0-9@]"), joined).otherwise(clean)


def words_in_context(texts: DataFrame) -> DataFrame:
    """Rows (row, pos, word, own, left, far, right) for each word of the texts (row, t): own is the word and left, far and right those around it, in small letters and with known kinds masked."""
    split = texts.select("row", "t", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"))
    lists = split.select("row", "w", F.regexp_extract_all(F.lower(masked(F.col("t"))), F.lit(WORD), F.lit(0)).alias("m"))
    none = F.lit("")
    zipped = F.arrays_zip(F.col("w"), F.col("m"), F.concat(F.array(none), F.col("m")).alias("l1"), F.concat(F.array(none, none), F.col("m")).alias("l2"), F.slice("m", 2, F.greatest(F.size("m"), F.lit(1))).alias("r1"))
    each = lists.select("row", F.posexplode(zipped).alias("pos", "x"))
    return each.select("row", "pos", F.col("x.w").alias("word"), F.col("x.m").alias("own"), F.col("x.l1").alias("left"), F.col("x.l2").alias("far"), F.coalesce("x.r1", none).alias("right")).where("word is not null")


def patterns() -> Column:
    """The patterns of a word in context, by their hashes: what stands before its first letter or digit within the word, with one word before, with two, or with one before and one after."""
    glue = F.regexp_extract("own", GLUE, 0)
    return F.array(F.xxhash64(F.lit(1), "left", glue), F.xxhash64(F.lit(2), "far", "left", glue), F.xxhash64(F.lit(3), "left", glue, "right"))


def is_known() -> Column:
    return F.contains("own", F.lit(MARK))


def core(word: Column) -> Column:
    """The identifier in a word: from its first letter or digit on, up to a character that identifiers don't have."""
    return F.regexp_extract(word, CORE, 0)


def seed_score(word: Column, mark: Column) -> Column:
    """1 for known kinds, SHAPED for what has the shape of a key: sixteen characters or more, with four digits and four letters at least. Else 0."""
    c = core(word)
    long = F.when(F.length(word) >= KEY_CHARS, (F.length(c) >= KEY_CHARS) & (F.length(digits(c)) >= 4) & (F.length(F.regexp_replace(c, "[^A-Za-z]", "")) >= 4)).otherwise(False)
    return F.when(mark, F.lit(1.0)).when(long, F.lit(SHAPED)).otherwise(F.lit(0.0))


def score_patterns(edges: DataFrame, *, turns: int = TURNS, prior: float = PRIOR) -> DataFrame:
    """Rows (key, support, confidence) from the graph's edges (key, instance, n, seed): a pattern's confidence is the mean score of the instances it stands by, shrunk towards 0 by prior; an instance's score is its seed score or the mean confidence of its patterns, whichever is more."""
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    for turn in range(turns):
        held = edges.join(scores, "instance")
        patterns = held.groupBy("key").agg((F.sum(F.col("n") * F.col("score")) / (F.sum("n") + F.lit(prior))).alias("confidence"), F.count(F.lit(1)).alias("support"))
        patterns = stored(patterns, "patterns")
        if turn + 1 < turns:
            scores = stored(edges.join(patterns, "key").groupBy("instance").agg(F.greatest(F.max("seed"), F.sum(F.col("n") * F.col("confidence")) / F.sum("n")).alias("score")), "scores")
    return patterns


def find_pii(docs: DataFrame, *, text: str = "text", into: str = "pii", confidence: float = CONFIDENCE, support: int = SUPPORT, turns: int = TURNS) -> DataFrame:
    """docs with an array column of structs (start, kind, end) in order: base spans, of kinds 0 to 3 as in KINDS, and those that patterns add, of kind 4. into replaces a column of that name.

    Each text is searched for known kinds once and kept with them in the shared folder, which all later steps read.
    """
    row, base, added = (fresh(docs, x) for x in ("row", "base", "added"))
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    held = stored(docs.withColumns({base: base_spans(t), row: F.monotonically_increasing_id()}), "spans")
    new = new_spans(held.select(F.col(row).alias("row"), t.alias("t")), confidence, support, turns)
    both = held.join(sized(new.select(F.col("row").alias(row), F.col("spans").alias(added))), row, "left")
    spans = F.sort_array(F.concat(F.col(base), F.coalesce(F.col(added), F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return both.withColumn(into, spans).select(*[c for c in docs.columns if c.lower() != into.lower()], into)


def new_spans(texts: DataFrame, confidence: float, support: int, turns: int) -> DataFrame:
    """Rows (row, spans) of the words of the texts (row, t) that patterns of confidence find beyond the known kinds.

    Patterns of too few different seeds are left out first, then those after which seeds are rare among all words; both
    tables have a number or two for each pattern. Only what stands by the rest makes the graph.
    """
    seeded = words_in_context(texts.where(F.col("t").rlike("[0-9@]"))).withColumn("seed", seed_score(F.col("word"), is_known())).where(f"seed > 0 and not contains(left, '{MARK}')")
    every = seeded.select("left", F.explode(patterns()).alias("key"), F.xxhash64(core(F.col("word"))).alias("i")).groupBy("left", "key", "i").agg(F.count(F.lit(1)).alias("n"))
    induced = stored(every.groupBy("left", "key").agg(F.count(F.lit(1)).alias("support"), F.sum("n").alias("seeds")).where(F.col("support") >= support), "induced")
    lefts = stored(induced.select("left").distinct(), "lefts")
    spread = words_in_context(texts).join(sized(lefts), "left").select(F.explode(patterns()).alias("key")).join(sized(induced.select("key")), "key").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    entered = stored(induced.join(spread, "key").where(F.col("seeds") >= ENTRY * F.col("n")).select("left", "key"), "entered")
    words = words_in_context(texts).join(sized(entered.select("left").distinct()), "left").select("row", "pos", "word", "own", F.explode(patterns()).alias("key")).join(sized(entered.select("key")), "key")
    hits = stored(words.select("row", "pos", is_known().alias("mark"), "key", F.xxhash64(core(F.col("word"))).alias("instance"), seed_score(F.col("word"), is_known()).alias("seed")), "hits")
    edges = stored(hits.groupBy("key", "instance").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")), "edges")
    good = score_patterns(edges, turns=turns).where((F.col("confidence") >= confidence) & (F.col("support") >= support)).select("key")
    found = stored(hits.where("not mark").join(good, "key", "left_semi").select("row", "pos").distinct(), "found")
    chosen = texts.join(sized(stored(found.select("row").distinct(), "rows")), "row", "left_semi")
    placed = chosen.select("row", F.posexplode(spans_of(F.col("t"), WORD)).alias("pos", "x")).join(sized(found), ["row", "pos"])
    start = F.col("x.start") + F.length(F.regexp_extract("x.match", GLUE, 0))
    span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("kind"), (start + F.length(core(F.col("x.match")))).alias("end"))
    return stored(placed.where(F.length(core(F.col("x.match"))) > 0).groupBy("row").agg(F.collect_list(span).alias("spans")), "new-spans")


def redact(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """docs with each span of its text replaced by its kind in angle brackets; spans that touch an earlier one go with it."""
    mark = fresh(docs, "pii")
    found = find_pii(docs, text=text, into=mark, **options)
    names = F.array(*[F.lit(f"<{k}>") for k in (*KINDS, "identifier")])
    t, spans = F.col(text).cast("string"), F.col(mark)

    def cut(piece) -> Column:
        def parts(ends: Column) -> Column:
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0))
            own = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(before(i), s["start"]), F.get(names, s["kind"]))).otherwise(""))
            return F.concat(F.array_join(own, ""), piece(F.element_at(ends, -1), F.length(t)))

        return let(running(F.transform(spans, lambda s: s["end"]), largest=True), parts)

    return found.withColumn(text, F.when(F.size(mark) > 0, pieces_of(t)(cut)).otherwise(F.col(text))).select(*docs.columns)


def listed(spans: Column, names: tuple[str, ...] = (*KINDS, "identifier")) -> Column:
    """kind:start:end of each span, comma-joined."""
    named = F.array(*[F.lit(k) for k in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(named, s["kind"]), s["start"], s["end"])), ",")


def op9(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for every row of documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"))
