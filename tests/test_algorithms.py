"""As-of joins, dictionaries, label orders, verification and live shelves against brute force."""

import random
from bisect import bisect_right

from pyspark.sql import functions as F

from medialake.operators import collections, maintenance, search
from medialake.operators.asof import as_of
from medialake.sources.scratch import Kept, scratch
from medialake.streaming import live


def test_as_of_with_a_hot_group(spark):
    """One group, null, has most rows and stops; equal times, times without a stop, null times."""
    rng = random.Random(5)
    group = lambda: None if rng.random() < 0.8 else rng.choice(["a", "b"])
    rows = [(i, group(), None if i % 97 == 0 else rng.randrange(-5, 300)) for i in range(600)]
    stops = [(group(), rng.randrange(0, 280), rng.randrange(1000)) for _ in range(400)]
    left, right = spark.createDataFrame(rows, "id int, g string, t long"), spark.createDataFrame(stops, "g string, t long, v long")
    kept = Kept(spark, "as-of-test")
    best = {}
    for g, t, v in stops:
        best[g, t] = max(v, best.get((g, t), -1))
    times = {g: sorted(t for h, t in best if h == g) for g in (None, "a", "b")}
    for forward in (False, True):
        got = {r.id: r.v for r in as_of(left, right, ["g"], "t", "v", kept, forward).collect()}
        assert len(got) == 600
        for i, g, t in rows:
            at = None if t is None else bisect_right(times[g], t) - (not forward)
            want = best[g, times[g][at]] if at is not None and 0 <= at < len(times[g]) else None
            assert got[i] == want, (i, g, t, forward)


def test_prefixes_against_a_dictionary_in_small_blocks(spark):
    words = sorted({"".join(random.Random(i).choices("abz", k=1 + i % 6)) for i in range(400)} | {"z", "zz", "é", "éa", "日本"})
    postings = spark.createDataFrame([(w,) for w in words * 2], "term string")
    asked = ["a", "ab", "z", "zzz", "q", "é", "日", "bbbbbbb", ""]
    kept = Kept(spark, "dictionary-test")
    terms = search.dictionary(postings, kept, 16)
    sizes = [r["count"] for r in terms.groupBy("block").count().collect()]
    assert max(sizes) == 16 and sum(sizes) == len(words)
    got = {(r.word, r.term) for r in search.begun_by(spark.createDataFrame([(a,) for a in asked], "word string"), terms, kept).collect()}
    assert got == {(a, w) for a in asked for w in words if w.startswith(a)}


def test_moves_by_labels(spark):
    entries = spark.createDataFrame([(c, p, f"{c}:{p}") for c in (1, 2, 3, 4) for p in range(5)], "collection_id long, position long, item_id string")
    moves = {1: (0, 4), 2: (4, 0), 3: (1, 3), 4: (2, 9)}
    labels = collections.labelled(entries)
    changes = collections.move_label(labels, spark.createDataFrame([(c, a, b) for c, (a, b) in moves.items()], "collection_id long, source long, target long"))
    assert sorted(r.collection_id for r in changes.collect()) == [1, 2, 3]  # one row a move; slot 9 isn't there
    got = {}
    for r in collections.dense(collections.relabel(labels, changes), "label").collect():
        got.setdefault(r.collection_id, {})[r.position] = r.item_id
    for c, (a, b) in moves.items():
        want = [f"{c}:{p}" for p in range(5)]
        if b < 5:
            want.insert(b, want.pop(a))
        assert [got[c][p] for p in range(5)] == want
    tight = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c")], "collection_id long, label long, item_id string")
    assert collections.move_label(tight, spark.createDataFrame([(1, 2, 1)], "collection_id long, source long, target long")).first().label is None


def test_equal_tables_are_not_read_row_by_row(spark):
    a = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") * 7).cast("string").alias("x")).unionByName(spark.createDataFrame([(None, "none"), (5, "35")], "k long, x string"))
    same = maintenance.verified(a, a.repartition(7), "k", small=100)
    assert same.read == [] and same.depth == 1 and same.rows.count() == 0
    b = a.where("k <> 11111 OR k IS NULL").withColumn("x", F.when(F.col("k") == 3, "other").otherwise(F.col("x")))
    got = maintenance.verified(a, b, "k", small=100)
    assert sorted(tuple(r) for r in got.rows.collect()) == [(3, "21", "left"), (3, "other", "right"), (11111, "77777", "left")]
    assert len(got.read) == 2 and got.depth == 2
    assert sum(a.where(maintenance.within_range("k", low, high)).count() for low, high in got.read) < 300
    once = a.dropDuplicates()  # how often a row stands counts, and so do null keys
    assert [tuple(r) for r in maintenance.verified(a, once, "k", small=100).rows.collect()] == [(5, "35", "left")]
    assert [tuple(r) for r in maintenance.verified(a, a.where("k IS NOT NULL"), "k", small=100).rows.collect()] == [(None, "none", "left")]


def test_changes_all_over_a_table_cost_a_few_jobs(spark):
    """Each range differs at every level: ranges are cut by one job for all, and no filter names more than `most` of them."""
    a = spark.range(40_000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("x"))
    b = a.where("k % 50 <> 3")
    spark.sparkContext.setJobGroup("all over", "verified")
    got = maintenance.verified(a, b, "k", small=20)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("all over"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 40 and len(got.read) <= 64
    assert sorted(tuple(r) for r in got.rows.collect()) == [(k, str(k), "left") for k in range(3, 40_000, 50)]
    some = a.withColumn("x", F.when(F.col("k") % 5000 == 3, "other").otherwise(F.col("x")))
    got = maintenance.verified(a, some, "k", small=20)
    assert len(got.read) == 8 and sum(a.where(maintenance.within_range("k", low, high)).count() for low, high in got.read) < 400
    assert sorted(tuple(r) for r in got.rows.collect()) == sorted((k, x, side) for k in range(3, 40_000, 5000) for x, side in ((str(k), "left"), ("other", "right")))


def test_live_shelves_after_any_mix_of_changes(spark):
    """Inserts, deletes, updates, emptied and returning groups; a batch that is run again changes nothing."""
    rng, schema = random.Random(3), "g string, id long, says string, ms long"
    shelf = live.LiveShelf(spark, scratch(spark, "live-test"), live.Shelf(("g",), ("id",), ("says",), ("ms",)), spark.createDataFrame([], schema).schema, 4)
    now = {}
    for number in range(4):
        before = dict(now)
        for i in range(40):
            if rng.random() < (0.3 if number else 1):
                now[i] = (rng.choice("abc"), i, rng.choice(["x", "y", None]), rng.choice([None, 5, i]))
            elif rng.random() < 0.4:
                now.pop(i, None)
        if number == 2:
            now = {i: r for i, r in now.items() if r[0] != "b"}
        frame = lambda rows: spark.createDataFrame(list(rows.values()), schema)
        changes = live.signed(frame(before), frame(now), ["id"])
        told = {r.g for r in shelf.apply(changes, number).collect()}
        if number == 1:
            shelf.apply(changes, number)
        want = {}
        for g, i, says, ms in sorted(now.values(), key=lambda r: r[1]):
            n, total, first = want.get(g, (0, 0, says))
            want[g] = (n + 1, total + (ms or 0), first)
        assert {r.g: (r.n, r.ms, r.says) for r in shelf.groups().collect()} == want
        assert told == {r[0] for i in before.keys() | now.keys() if before.get(i) != now.get(i) for r in (before.get(i), now.get(i)) if r}


def test_live_shelves_shuffle_groups_and_not_rows(spark):
    """A first load of many rows shuffles what it says of the groups; a shelf without first rows keeps no log. (It shuffled every row twice.)"""
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty()
        executors = context.statusStore().executorList(True)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    rows = spark.range(0, 60_000, 1, 4).selectExpr("concat('g', id % 3) AS g", "id", "sha2(CAST(id AS STRING), 256) AS says", "id % 100 AS ms", "1 AS sign")
    for first in (("says",), ()):
        shelf, start = live.LiveShelf(spark, scratch(spark, "live-test"), live.Shelf(("g",), ("id",), first, ("ms",)), rows.drop("sign").schema, 4), shuffled()
        assert sorted(r[:3] for r in shelf.apply(rows, 0).collect()) == [(f"g{i}", 20_000, sum(x % 100 for x in range(i, 60_000, 3))) for i in range(3)]
        assert shuffled() - start < 50_000 and shelf.exists("log") == bool(first)


def test_rows_that_come_and_go_in_one_batch_lead_nothing(spark):
    schema = "g string, id long, says string"
    shelf = live.LiveShelf(spark, scratch(spark, "live-test"), live.Shelf(("g",), ("id",), ("says",)), spark.createDataFrame([], schema).schema, 2)
    batches = [
        ("+2a +5b +9c", (3, "a")), ("+1x -1x", (3, "a")), ("-2a +2z", (3, "z")), ("-2z +3q -3q", (2, "b")), ("+5b -5b", (2, "b")), ("-5b -9c", None), ("+7k -7k +8m", (1, "m")), ("-8m", None),
    ]
    for number, (said, want) in enumerate(batches):
        changes = spark.createDataFrame([("g", int(c[1]), c[2], 1 if c[0] == "+" else -1) for c in said.split()], schema + ", sign int")
        shelf.apply(changes, number)
        if number in (1, 3):
            shelf.apply(changes, number)
        assert [(r.n, r.says) for r in shelf.groups().collect()] == ([want] if want else []), said


def test_changes_of_two_states_are_those_of_their_images(spark):
    """Images need no shuffle, two states one of each table."""
    rows = spark.range(100).selectExpr("id", "CAST(id % 7 AS STRING) AS x", "IF(id % 4 = 0, NULL, id) AS y")
    edited = F.struct("id", F.when(F.col("id") % 3 == 0, "new").otherwise(F.col("x")).alias("x"), "y")
    was, now = F.when(F.col("id") % 5 != 1, F.struct("id", "x", "y")), F.when(F.col("id") % 8 != 2, edited)
    images = live.imaged(rows, was, now)
    two = live.signed(*[rows.select(s.alias("s")).where("s IS NOT NULL").select("s.*") for s in (was, now)], ["id"])
    want = []
    for i in range(100):
        before, after = (i, str(i % 7), i if i % 4 else None) if i % 5 != 1 else None, (i, "new" if i % 3 == 0 else str(i % 7), i if i % 4 else None) if i % 8 != 2 else None
        want += [(*r, sign) for r, sign in ((before, -1), (after, 1)) if r and before != after]
    for got in (images, two):
        assert got.columns == ["id", "x", "y", "sign"] and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    exchanges = lambda df: df._jdf.queryExecution().sparkPlan().toString().count("Exchange")
    assert exchanges(images) == 0 and exchanges(two) == 1


def test_terms_of_repeated_and_null_ids_are_counted_once(spark):
    from medialake.operators import search

    rows = spark.createDataFrame([(1, "a b a"), (1, "a c"), (2, "b É"), (None, "a"), (3, None)], "item_id long, text string")
    assert sorted(tuple(r) for r in search.term_counts(rows, ["text"]).collect()) == [("a", 4, 1), ("b", 2, 2), ("c", 1, 1), ("e", 1, 1)]
    many = spark.range(2000).select(F.col("id").alias("item_id"), F.lit("x y x").alias("text"))
    plan = search.term_counts(many, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "item_id" not in plan[plan.index("Exchange") :].splitlines()[0]


def test_many_queries_ask_for_their_rarest_token_first(spark):
    """Against plain Python; a token that several queries share meets the postings once, and phrases still stand in line."""
    from medialake.operators import search

    texts = {i: " ".join(w for n, w in ((1, "all"), (2, "even"), (3, "third"), (50, "rare"), (75, "rarest")) if i % n == 0) for i in range(300)}
    docs = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    asked = {1: "all rare", 2: "all even rar", 3: "all nothing", 4: "even third", 5: '"all-even" rarest', 6: "third-even all"}
    got = search.search_many(search.build_index(docs, ["text"]), spark.createDataFrame(list(asked.items()), "query_id long, query string")).select("query_id", "item_id").collect()
    in_line = lambda i, token: (" " + token.replace("-", " ")) in " " + texts[i]
    want = {(q, i) for q, said in asked.items() for i in texts if all(in_line(i, t) for t in said.replace('"', " ").split())}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
