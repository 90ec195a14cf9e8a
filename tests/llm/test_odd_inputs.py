"""Nulls in any column, empty, blank and very long texts, ties and repeated rows, empty tables, columns with clashing names: each operator keeps every row."""

import pytest
from odd_rows import LONG, ROWS
from pyspark.sql import functions as F

from medialake.llm import exact_dedup, fingerprint, language_id, ngram_join, packing, piece_codec, quality, queries, reshard, toxicity, url_filter

MODEL = open(queries.PIECES, "rb").read()
OPERATORS = {
    "language_id": lambda d, lb: language_id.language_id(d),
    "sentencepiece": lambda d, lb: piece_codec.code_round(d, MODEL),
    "toxicity": lambda d, lb: toxicity.toxicity(d, lb),
    "fingerprints": lambda d, lb: fingerprint.fingerprint_edits(d),
    "exact_dedup": lambda d, lb: exact_dedup.exact_dedup(d),
    "ngram_join": lambda d, lb: ngram_join.ngram_join(d),
    "quality": lambda d, lb: quality.quality(d, lb),
    "reshard": lambda d, lb: reshard.reshard(d, F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)), 4, 3),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_every_row_once(name, odd, labels):
    got = OPERATORS[name](odd, labels).collect()
    assert sorted([r.doc_id for r in got], key=repr) == sorted([i for i, _, _ in ROWS], key=repr)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(name, none, labels):
    assert OPERATORS[name](none, labels).count() == 0


@pytest.mark.parametrize("name", ["quality", "toxicity"])
def test_no_labels(name, odd, labels):
    assert OPERATORS[name](odd, labels.limit(0)).count() == len(ROWS)


def test_languages(odd):
    got = {(r.doc_id, r.lang_pred): r.score for r in language_id.language_id(odd).collect()}
    assert {(0, "und"), (1, "und"), (2, "und"), (6, "und"), (None, "und")} <= set(got)
    assert all(0 <= s <= 1 for s in got.values())


def test_scores_are_shares(odd, labels):
    for df in (quality.quality(odd, labels), toxicity.toxicity(odd, labels)):
        rows = df.collect()
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)


def test_equal_texts(odd):
    got = exact_dedup.exact_dedup(odd).collect()
    by = {}
    for r in got:
        by.setdefault(r.text_sha256, []).append(r)
    assert all(sum(r.kept for r in rs) == 1 and {r.group_size for r in rs} == {len(rs)} for rs in by.values())
    assert {r.doc_id: r.keep_id for r in got if r.doc_id in (3, 4, 5)} == {3: 3, 4: 3, 5: 5}
    assert {r.keep_id for r in got if r.doc_id in (0, 1)} == {0}


def test_near_classes(odd):
    got = {r.doc_id: r for r in ngram_join.ngram_join(odd).collect() if r.doc_id is not None}
    assert got[4].class_id == 3 and got[4].n_copies == 2 and got[5].n_copies == 2
    assert [got[i].class_id for i in (0, 1, 2)] == [0, 1, 2] and got[0].n_links == 0


def test_packing_odd_inputs(odd, none):
    rows = packing.pack(packing.pieces_of(odd, queries.BPE)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for rs in by.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted({repr(r.doc_id) for r in rows}) == sorted({repr(i) for i, _, _ in ROWS})
    assert [r.length for r in rows if r.doc_id in (0, 1)] == [1, 1]
    assert len([r for r in rows if r.doc_id == 7]) > 30 and len(LONG) > 400_000
    assert packing.pack(packing.pieces_of(none, queries.BPE)).count() == 0


def test_odd_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "http://NET/"), (6, "http://a.net"), (7, "http://x.Example.NET/en/a?b://c"), (8, "http://example.net/en"), (9, "https://ÉX.org/fr/ü#x"), (None, "http://b.net/x"), (10, "http://xexample.com/de/1"), (10, "http://xexample.com/de/1"), (11, "http://www.casino-win.example.com/a\nb")]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id long, url string, rule string, token string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages, queries.URL_RULES).collect()), key=repr)
    want = [(1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "net", "/", "net/", "block"), (6, "a.net", "", None, "allow"), (7, "x.example.net", "/en/a", "example.net/en/", "allow"), (8, "example.net", "/en", "net/", "block"), (9, "Éx.org", "/fr/ü", "org/fr/", "allow"), (None, "b.net", "/x", "net/", "block"), (10, "xexample.com", "/de/1", None, "allow"), (10, "xexample.com", "/de/1", None, "allow"), (11, "www.casino-win.example.com", "/a\nb", None, "block")]
    assert got == sorted(want, key=repr)
    assert url_filter.judge_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_rules_without_tokens_see_every_url(spark):
    pages = spark.createDataFrame([(1, "http://1.2.3.4/"), (2, "http://a.b/"), (3, None)], "page_id long, url string")
    rules = [url_filter.UrlRule(r"^\d+\.\d+\.\d+\.\d+/", (), "block"), url_filter.host_rule("b", "/", "allow")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, broadcast_rules=0).collect()}
    assert got == {1: (None, "block"), 2: ("b/", "allow"), 3: (None, "allow")}
