"""Folder changes as a keyed state machine: quiet spells by the clock, refused scans, restarts."""

import time

import pandas as pd
from pyspark.sql import functions as F

from medialake.sources.scratch import scratch
from medialake.streaming import bursts

EVENTS = "library_id long, dir string, ts timestamp"


def stream(spark, rows):
    path = scratch(spark, "burst-events")
    spark.createDataFrame([(lib, d, pd.Timestamp(t).to_pydatetime()) for lib, d, t in rows], EVENTS).write.parquet(path)
    return spark.readStream.schema(EVENTS).parquet(path)


def test_refused_folders_come_again_after_a_restart_without_a_further_event(spark):
    state, debt, seen, busy = scratch(spark, "state"), scratch(spark, "debt"), [], [True]
    events = stream(spark, [(1, "/m/a", "2024-01-01 00:00:00"), (1, "/m/b", "2024-01-01 00:00:01"), (1, "/m/a", "2024-01-01 00:00:02"), (2, "/m/z", "2024-01-01 00:05:00")])

    def start():
        taken = lambda: spark.range(1, 2 if busy[0] else 1).withColumnRenamed("id", "library_id")
        return bursts.start_incremental(events, lambda dirs, n: seen.append(sorted(tuple(r) for r in dirs.collect())), state, debt, taken, "2 seconds", "1 second", "200 milliseconds")

    first = start()
    end = time.monotonic() + 120
    while not (seen and first.lastProgress and first.lastProgress["batchId"] >= 3) and time.monotonic() < end:
        time.sleep(0.2)
    first.stop()
    assert seen == [[(2, "/m/z")]]  # library 1 is busy all the time
    busy[0] = False
    bursts.until_quiet(start(), 120)
    assert {tuple(x) for batch in seen[1:] for x in batch} == {(1, "/m/a"), (1, "/m/b")}


def test_bursts_by_the_events_times(spark):
    """Stretches that a third one connects are one burst, a late event is its own, folders come once a burst."""
    rows = [(1, "/a", "2024-01-01 00:00:00"), (1, "/b", "2024-01-01 00:00:20"), (1, "/c", "2024-01-01 00:00:10"), (1, "/a", "2024-01-01 00:00:20"), (1, "/a", "2024-01-01 00:01:00"), (1, "/late", "2023-01-01 00:00:00")]
    out = scratch(spark, "bursts-out")
    with bursts.keyed_state(spark):
        running = bursts.bursts(stream(spark, rows), "10 seconds", "1 second").writeStream.foreachBatch(lambda df, n: df.write.parquet(f"{out}/batch={n}")).option("checkpointLocation", scratch(spark, "bursts-state")).trigger(processingTime="200 milliseconds").start()
    bursts.until_quiet(running, 120)
    got = spark.read.schema(bursts.BURST).parquet(f"{out}/*").groupBy("since", "until").agg(F.sort_array(F.collect_list("dir")).alias("dirs")).collect()
    assert sorted((str(r.since), str(r.until), r.dirs) for r in got) == [("2023-01-01 00:00:00", "2023-01-01 00:00:00", ["/late"]), ("2024-01-01 00:00:00", "2024-01-01 00:00:20", ["/a", "/b", "/c"]), ("2024-01-01 00:01:00", "2024-01-01 00:01:00", ["/a"])]
    assert (spark.conf.get(bursts.keyed_state.KEY, None) or "") != bursts.keyed_state.VALUE


def test_stretches_over_batches_of_rows_are_joined():
    machine = bursts.Debounce("10 seconds", "1 second")
    known, names = {}, {}
    spans = [(0, 5), (40, 45), (20, 25), (12, 14), (30, 33)]
    for a, b in spans:
        machine.joined(known, names, a * 10**6, b * 10**6)
    assert list(known.values()) == [(0, 45 * 10**6)] and {machine.root(names, n) for n in names} == set(known)
