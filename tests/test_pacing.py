"""Read budgets against a bucket that is filled and emptied charge by charge, and sorts by what files say."""

import random
from datetime import datetime, timedelta

import pytest

from medialake.operators import pacing, shelves
from medialake.plans import shelf_queries
from medialake.plans import views as v

START = datetime(2024, 1, 1)
CHARGES = "library_id long, at timestamp, bytes long, nth int, rate string"


def bucket(charges, rate):
    debt, last, out = 0, None, []
    for at, size in charges:
        if last is not None:
            debt = max(0, debt - (at - last) // timedelta(microseconds=1) * rate)
        last, debt = at, debt + size * 10**6
        over = max(0, debt - rate * 10**6)
        out.append((debt, (2 * over + rate) // (2 * rate)))
    return out


def test_waits_as_a_bucket_has_them(spark):
    """Three libraries, one of two thirds of all charges, over many ranges; ties of time, long rests, charges that don't count."""
    rng = random.Random(2)
    rates = {1: 1000, 2: 7, 3: 10**9}
    rows, now = [], START
    for i in range(3000):
        now += timedelta(microseconds=rng.choice([0, 0, 1, 250_000, 900_000, 5_000_000] + [10**11] * (i % 500 == 0)))
        rows.append((rng.choice([1, 1, 1, 1, 2, 3]), now, rng.choice([0, -5, None, 1, 100, 1500, 4000]), i, "clash"))
    odd = [(None, START, 5, 1, "x"), (1, None, 5, 2, "x"), (9, START, 5, 3, "x"), (8, START, 10**9, 4, "x")]
    table = spark.createDataFrame(rng.sample(rows + odd, len(rows) + len(odd)), CHARGES).repartition(16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as many ranges as shuffle partitions
    try:
        got = pacing.waits(table, spark.createDataFrame([*rates.items(), (8, 0), (7, 5)], "library_id long, bytes_per_second long"), ("nth",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == len(rows) + len(odd) and got[0].asDict().keys() == {"library_id", "at", "bytes", "nth", "rate", "debt", "wait_us"}
    found = {(r.library_id, r.nth): (r.debt, r.wait_us) for r in got}
    for library, rate in rates.items():
        mine = [r for r in rows if r[0] == library]
        counted = [r for r in mine if r[2] and r[2] > 0]
        assert [found[library, r[3]] for r in counted] == bucket([(r[1], r[2]) for r in counted], rate)
        assert {found[library, r[3]] for r in mine if not r[2] or r[2] < 0} == {(None, 0)}
    assert {found[r[0], r[3]] for r in odd} == {(None, 0)} and sum(r.wait_us > 0 for r in got) > 1000


def test_a_second_is_free_and_time_pays(spark):
    at = lambda ms: START + timedelta(milliseconds=ms)
    charges = spark.createDataFrame([(1, at(0), 1000, 0, ""), (1, at(750), 1000, 1, ""), (2, at(0), 1000, 2, ""), (2, at(0), 500, 3, "")], CHARGES)
    rates = spark.createDataFrame([(1, 1000), (2, 1000)], "library_id long, bytes_per_second long")
    assert {r.nth: r.wait_us for r in pacing.waits(charges, rates, ("nth",)).collect()} == {0: 0, 1: 250_000, 2: 0, 3: 500_000}
    assert pacing.waits(charges.limit(0), rates).count() == 0
    with pytest.raises(Exception, match="must not be negative"):
        pacing.waits(charges, spark.createDataFrame([(1, -1)], "library_id long, bytes_per_second long")).collect()
    files = spark.createDataFrame([("a", 600), ("b", 600), ("c", 5 << 20)], "path string, size_bytes long")
    assert [(r.cost, r.due_us) for r in pacing.due(files, "discover", 1000).orderBy("path").collect()] == [(600, 0), (600, 200_000), (2 << 20, (200 + (2 << 20)) * 1000)]
    with pytest.raises(ValueError):
        pacing.due(files, "discover", 0)


@pytest.mark.parametrize("column", ["format", "bitrate"])
@pytest.mark.parametrize("up", [True, False])
def test_songs_by_what_files_say(spark, column, up):
    key = {"format": "format", "bitrate": "bitrate_kbps"}[column]
    rows = v.tracks(spark, "/root/testdata/sf0.001").selectExpr("*", *shelf_queries.SONGS)
    got = [tuple(r) for r in shelves.sort_shelf(rows, shelves.sorts("songs"), v.SHELF, column, up).select(key, *v.SHELF).collect()]
    told = [r for r in got if r[0] is not None]
    want = sorted(sorted(told, key=lambda r: r[1:]), key=lambda r: r[0], reverse=not up)
    # Python's reversed sort keeps ties in order too
    assert got == want + sorted((r for r in got if r[0] is None), key=lambda r: r[1:])
    assert len({r[0] for r in told}) > 2 and len(told) < len(got)


def test_collections_are_created_above_all_ids(spark):
    from medialake.operators import collections

    known = spark.createDataFrame([(4, "b"), (9, "a")], "collection_id long, name string")
    names = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    got = sorted((tuple(r) for r in collections.create(known, names).collect()))
    assert got == [(4, "b"), (9, "a"), (10, None), (11, "a"), (12, "b"), (13, "b")]
    assert [tuple(r) for r in collections.create(known.limit(0), names.limit(1)).collect()][0][0] == 1
    assert collections.create(known, names.limit(0)).count() == 2
