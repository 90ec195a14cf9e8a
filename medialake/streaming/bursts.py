"""Bursts of folder changes: gathered by library until it has been quiet for a while, and owed as long as a scan of the library is running."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from .jobs import with_debt

#: What comes out: a row a folder of a burst; since and until are null where folders are only owed.
BURST = StructType([StructField("library_id", LongType()), StructField("since", TimestampType()), StructField("until", TimestampType()), StructField("dir", StringType())])
#: Folders of refused scans; they come in again by this.
OWED = StructType([StructField("library_id", LongType()), StructField("dir", StringType())])
OPEN = "owed"
LARGE = 1 << 62


def stretches(events: DataFrame, gap: str) -> DataFrame:
    """library_id, start, stop (microseconds), dir: the events(library_id, dir, ts) of each batch of rows joined where they are at most `gap` apart, a folder once a stretch; nulls of ts stay null.

    Stretches of different tasks that are that close are of one burst too, so this loses nothing, and a library with many events sends few rows to the task that keeps its state.
    """
    width = pd.Timedelta(gap).value // 1000

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            df = df.sort_values(["library_id", "us"], kind="stable")
            fresh = (df.library_id != df.library_id.shift()) | (df.us.diff() > width)
            part = fresh.cumsum()
            df = df.assign(start=df.us.groupby(part).transform("min"), stop=df.us.groupby(part).transform("max"))
            yield df[["library_id", "start", "stop", "dir"]].drop_duplicates()

    rows = events.select(F.col("library_id").cast("long").alias("library_id"), F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(LARGE)).alias("us"), "dir")
    return rows.where("library_id IS NOT NULL AND dir IS NOT NULL").mapInPandas(run, "library_id long, start long, stop long, dir string")


class Debounce(StatefulProcessor):
    """Keeps a library's open stretches and their folders. A stretch closes when a later one begins, more than the gap after it; the last closes when nothing has come for the quiet time of the clock."""

    def __init__(self, gap: str, quiet: str, rows: int = 10_000):
        self.width, self.quiet, self.rows = pd.Timedelta(gap).value // 1000, pd.Timedelta(quiet).value // 1_000_000, rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "id string", "start long, stop long")
        self.dirs = handle.getMapState("dirs", "id string, dir string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        names = {k: k for k in known}  # a stretch that was joined to another goes by its name
        for df in rows:
            for start, stop, dirs in ((a, b, g) for (a, b), g in df.groupby(["start", "stop"]).dir):
                home = self.joined(known, names, int(start), int(stop)) if start < LARGE else OPEN
                for d in dirs:
                    self.dirs.updateValue((home, d), (True,))
        last = max(known, key=lambda k: known[k][1], default=None)
        self.open.clear()
        if last is not None:
            self.open.updateValue((last,), known[last])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        closed = {k: known[self.root(names, k)] for k in names if self.root(names, k) != last}
        kept_as = {k for k in names if self.root(names, k) == last and k != last}
        yield from self.given(key, closed, kept_as, last)

    @staticmethod
    def root(names: dict[str, str], name: str) -> str:
        while names[name] != name:
            name = names[name]
        return name

    def joined(self, known: dict, names: dict[str, str], start: int, stop: int) -> str:
        """The name of the stretch that this one belongs to, all that it connects joined to one."""
        met = [k for k, (a, b) in known.items() if start <= b + self.width and a <= stop + self.width]
        name = met[0] if met else str(start)
        names.setdefault(name, name)
        for k in met:
            start, stop = min(start, known[k][0]), max(stop, known[k][1])
            del known[k]
            names[k] = name
        names[name] = name
        known[name] = (start, stop)
        return name

    def given(self, key, closed: dict, renamed: set[str], last: str | None) -> Iterator[pd.DataFrame]:
        """The folders of closed stretches, a row each, taken out of the state; those of stretches that were joined to the open one go by its name from now on."""
        if not closed and not renamed:
            return
        out: dict[tuple, None] = {}
        for home, d in list(self.dirs.keys()):
            if home in renamed:
                self.dirs.removeKey((home, d))
                self.dirs.updateValue((last, d), (True,))
            elif home in closed:
                self.dirs.removeKey((home, d))
                out[(*closed[home], d)] = None
                if len(out) >= self.rows:
                    yield self.frame(key, list(out))
                    out.clear()
        if out:
            yield self.frame(key, list(out))

    def frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        at = lambda i: pd.to_datetime(pd.Series([r[i] for r in rows], dtype="Int64"), unit="us")
        return pd.DataFrame({"library_id": key[0], "since": at(0), "until": at(1), "dir": [r[2] for r in rows]})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = {k[0]: tuple(v) for k, v in self.open.iterator()} if self.open.exists() else {}
        last = next(iter(known.values()), (None, None))
        everything = [(*known.get(home, last), d) for home, d in self.dirs.keys()]
        unique = list(dict.fromkeys(everything))
        for i in range(0, len(unique), self.rows):
            yield self.frame(key, unique[i : i + self.rows])
        self.open.clear()
        self.dirs.clear()

    def close(self) -> None:
        pass


def bursts(events: DataFrame, gap: str = "2 seconds", quiet: str | None = None) -> DataFrame:
    """BURST rows of a stream of events(library_id, dir, ts): the folders of a library gathered until it has been quiet for `gap`, by the events' times where a later event says so, else by the clock (`quiet`).

    The last burst waits for no later event: a timer of the clock gives it out, also after a restart. Events without a time, and owed folders, join the open burst. A late event is a burst of
    its own. State is the folders of open bursts. A query on it needs a processing-time trigger; `start_incremental` sets what else it needs.
    """
    held = stretches(events, gap).groupBy("library_id")
    return held.transformWithStateInPandas(statefulProcessor=Debounce(gap, quiet or gap), outputStructType=BURST, outputMode="Append", timeMode="ProcessingTime")


def with_owed(events: DataFrame, debt: str) -> DataFrame:
    """events(library_id, dir, ts) and, without a time, the folders that refused scans left under `debt`."""
    spark = events.sparkSession
    spark.createDataFrame([], OWED).write.mode("append").parquet(f"{debt}/batch=start")  # a stream needs its folder to be there
    owed = spark.readStream.schema(OWED).parquet(f"{debt}/*")
    return events.select(F.col("library_id").cast("long").alias("library_id"), "dir", F.col("ts").cast("timestamp").alias("ts")).unionByName(owed.withColumn("ts", F.lit(None).cast("timestamp")))


def start_incremental(events: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, debt: str, busy: Callable[[], DataFrame] | None = None, gap: str = "2 seconds", quiet: str | None = None, every: str = "1 second") -> StreamingQuery:
    """Runs scan(dirs(library_id, dir), batch) for the bursts of events(library_id, dir, ts).

    busy() gives the libraries(library_id) that other jobs are scanning now: their folders are written under `debt`, come in again as changes, and so are tried after another quiet spell, with no
    further event and across restarts. A batch that is run again writes its debt again, which changes nothing, as folders are a set.
    """
    spark = events.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        dirs = batch.select("library_id", "dir").distinct()
        if busy is not None:
            taken = busy().select(F.col("library_id").cast("long").alias("library_id")).distinct()
            dirs, later = with_debt(dirs, dirs.where("false"), taken)
            if not later.isEmpty():
                later.write.mode("overwrite").parquet(f"{debt}/batch={number}")
        if not dirs.isEmpty():
            scan(dirs, number)

    with keyed_state(spark):
        return bursts(with_owed(events, debt), gap, quiet).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


class keyed_state:  # noqa: N801
    """Within it, queries that start keep their state where timers and maps are supported; the session's own choice comes back at the end."""

    KEY, VALUE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.KEY, None)
        self.spark.conf.set(self.KEY, self.VALUE)

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self.KEY, self.before) if self.before else self.spark.conf.unset(self.KEY)


def until_quiet(query: StreamingQuery, timeout: float = 300, still: int = 3) -> None:
    """Waits until `still` batches one after another neither took anything in nor hold a folder, then stops the query; raises what the query raises. A query with timers never is without a next batch."""
    end, calm, seen = time.monotonic() + timeout, 0, -1
    try:
        while calm < still:
            if query.exception():
                raise query.exception()
            if time.monotonic() > end:
                raise TimeoutError("folders are still held")
            for said in [p for p in query.recentProgress if p["batchId"] > seen]:
                seen = said["batchId"]
                calm = calm + 1 if said["numInputRows"] == 0 and not sum(s["numRowsTotal"] for s in said["stateOperators"]) else 0
            time.sleep(0.1)
    finally:
        query.stop()
