"""The corpus pipeline, stage by stage, against plain Python."""

import pytest

import corpus_pipeline
from test_brute_force import brute_classes

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, small):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "exact_dedup", "ngram_join", "packing"]
    docs, seen = small, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, SMALL), f"test-{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == small.columns and dict(docs.dtypes) == dict(small.dtypes)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    every, tongue, clean, once, far = texts(small), *[texts(seen[n]) for n in names[:4]]
    assert set(tongue) == {i for i, t in every.items() if any(c.isalpha() for c in t)}
    assert set(clean) <= set(tongue)
    first = {}
    for i in sorted(clean):
        first.setdefault(" ".join(clean[i].split()) if clean[i].strip() == clean[i] else clean[i], i)
    assert set(once) <= set(clean) and len({t for t in once.values()}) == len(once) and min(clean) in once
    classes = brute_classes(once)
    assert set(far) == {i for i, (c, _) in classes.items() if i == c}
    assert {r.doc_id for r in seen["packing"].select("doc_id").distinct().collect()} == set(far)


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).where("length > 2048").count() == 0


@pytest.mark.parametrize("k", range(5))
def test_odd_and_empty_inputs(spark, odd, none, k):
    name, stage = corpus_pipeline.STAGES[k]
    assert stage(spark, none, SMALL).count() == 0
    got = stage(spark, odd, SMALL)
    assert got.count() > 0
    if name != "packing":
        assert got.columns == odd.columns


def test_what_goes(spark, odd):
    left = {r.doc_id for r in corpus_pipeline.known_language(spark, odd, SMALL).collect()}
    assert not left & {0, 1, 2, 6} and {3, 4, 5, 7} <= left
    left = [r.doc_id for r in corpus_pipeline.no_copies(spark, odd.where("doc_id IS NOT NULL"), SMALL).collect()]
    assert 4 not in left and 3 in left and 0 in left and 1 not in left


def test_one_row_of_each_group_stays(spark, odd):
    """Repeated rows, an id with two texts, and null ids."""
    long = " ".join(f"word{i}" for i in range(40))
    more = [(20, "Some text of its own"), (21, "one"), (21, "Another clean text"), (None, "No id at all"), (None, "Neither here"), (None, "Neither here"), (30, long), (30, long), (None, long), (31, long + " end"), (31, "A clean text beside it"), (None, long[::-1]), (None, long[::-1])]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = {5: 1, 21: 1, 30: 1, 31: 2, 3: 1, 4: 0, 9: 1, 0: 1}
    for stage, own in ((corpus_pipeline.no_copies, {}), (corpus_pipeline.no_near_copies, {31: 1})):
        left = [(r.doc_id, r.text) for r in stage(spark, docs, SMALL).collect()]
        ids = [i for i, _ in left]
        if own:
            want = want | own
        assert {i: ids.count(i) for i in want} == want
        assert (21, "Another clean text") in left and (31, "A clean text beside it") in left
        assert [left.count((None, t)) for t in ("No id at all", "Neither here", long, long[::-1])] == [1, 1, 0, 1]


def test_toxic_documents_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    left = {r.doc_id for r in corpus_pipeline.not_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    clean = [i for i, t in labels.items() if t == 0]
    toxic = [i for i, t in labels.items() if t == 1]
    assert sum(i in left for i in clean) / len(clean) > 0.98 and sum(i not in left for i in toxic) / len(toxic) > 0.6
