import re

import numpy as np
import pytest

import corpus_pipeline
from spheric.llm import simhash
from spheric.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), name)
        assert docs.count() <= rows
        rows = docs.count()
        assert name == "encoding" or docs.columns == columns
    assert rows > 0 and docs.select("doc_id").distinct().count() == rows


def test_stages_take_nulls_and_nothing(spark, docs, none):
    some = docs.selectExpr("doc_id", "text", "cast(null as string) lang", "'s' source", "cast(length(text) as bigint) n_chars")
    for df in (some, some.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            df = stored(stage(spark, df, SF), "t")
            df.count()


def _jaccard(a, b):
    sets = []
    for t in (a, b):
        w = re.findall("[^ \t\n\v\f\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return 1.0 if sets[0] == sets[1] else len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _edited(rng, n):
    """Texts and copies with words replaced, which leaves similarities on both sides of 0.8."""
    texts = []
    for i in range(n):
        w = [f"w{k}" for k in rng.integers(0, 5000, 60 + 30 * (i % 6))]
        texts.append(" ".join(w))
        for changed in (1, 2, 3, 5, 8):
            c = list(w)
            for at in rng.choice(len(c), changed, replace=False):
                c[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("group_chars", [1500, 4 << 20])
def test_near_copies_are_those_of_the_shingle_similarity(spark, docs, group_chars):
    texts = [*(r.text for r in docs.collect()), *_edited(np.random.default_rng(5), 12)]
    n = len(texts)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if label[i] != label[j] and _jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = simhash.drop_near_duplicates(made, words=5, similarity=0.8, group_chars=group_chars)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label)) and len(set(label)) < n


def test_stage_drops_edited_copies_only(spark):
    rng = np.random.default_rng(8)
    texts = _edited(rng, 20)
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, made, SF).collect()}
    assert {i for i in range(0, len(texts), 6)} <= kept
    near = [i for i in range(len(texts)) if i % 6 and _jaccard(texts[i], texts[i - i % 6]) >= 0.8]
    assert len(near) > 30 and not kept & set(near)
