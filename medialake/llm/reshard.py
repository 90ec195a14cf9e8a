"""Resharding by minimum-cost flow: from old shard sizes and new capacities, the block transfers that move the fewest bytes."""

from __future__ import annotations

import heapq
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Tables, saved


def cheapest_flow(supply: list[int], room: list[int], cost: list[list[int]]) -> list[list[int]]:
    """What goes from each supply to each room at the least cost; the sums of both must be equal.

    Successive cheapest paths with node potentials, so every path search is a plain shortest path over non-negative costs.
    """
    m, n = len(supply), len(room)
    left, free = list(supply), list(room)
    sent = [[0] * n for _ in range(m)]
    potential = [0] * (m + n)
    while any(left):
        far = [math.inf] * (m + n)
        before: list[int | None] = [None] * (m + n)
        queue = [(0, i) for i in range(m) if left[i]]
        for _, i in queue:
            far[i] = 0
        heapq.heapify(queue)
        while queue:
            d, v = heapq.heappop(queue)
            if d > far[v]:
                continue
            if v < m:
                steps = [(m + j, cost[v][j]) for j in range(n)]
            else:
                steps = [(i, -cost[i][v - m]) for i in range(m) if sent[i][v - m]]
            for to, c in steps:
                if (x := d + c + potential[v] - potential[to]) < far[to]:
                    far[to], before[to] = x, v
                    heapq.heappush(queue, (x, to))
        end = min((j for j in range(n) if free[j]), key=lambda j: far[m + j] + potential[m + j])
        path = [m + end]
        while before[path[-1]] is not None:
            path.append(before[path[-1]])
        path.reverse()
        pairs = list(zip(path, path[1:]))
        amount = min([left[path[0]], free[end], *(sent[b][a - m] for a, b in pairs if a >= m)])
        for a, b in pairs:
            if a < m:
                sent[a][b - m] += amount
            else:
                sent[b][a - m] -= amount
        left[path[0]] -= amount
        free[end] -= amount
        top = max(x for x in far if x < math.inf)
        potential = [p + min(x, top) for p, x in zip(potential, far)]
    return sent


def even(total: int, n: int) -> list[int]:
    return [total // n + (i < total % n) for i in range(n)]


@dataclass
class Layout:
    """Where each row goes. Small tables: before (bytes of the old shard before a block), cuts (stretches of an old shard and their new shards), bases (slots before a block's part)."""

    old_shard: Column
    old_shards: int
    blocks: int
    id_col: str
    text_col: str
    before: DataFrame
    cuts: DataFrame
    bases: DataFrame | None
    #: doc_id and text_crc32 that so many rows have in common that they are cut by the number of the row too; None where there are none.
    hot: DataFrame | None
    #: Shards that gain or lose rows.
    touched: list[int]

    def keyed(self, docs: DataFrame, *more: Column) -> DataFrame:
        """doc_id, size, text_crc32, old, fine (the row's block), and more."""
        text = F.coalesce(F.col(self.text_col), F.lit(""))
        known = self.old_shard.between(0, self.old_shards - 1)
        rows = docs.select(
            F.col(self.id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
            self.old_shard.cast("int").alias("old_shard"), F.when(known, self.old_shard).otherwise(self.old_shards).cast("int").alias("old"), *more,
        )
        salt = F.lit(0).cast("long")
        if self.hot is not None:
            rows = rows.withColumn("row", F.monotonically_increasing_id()).join(self.hot, F.col("doc_id").eqNullSafe(F.col("hot_id")) & (F.col("text_crc32") == F.col("hot_crc32")), "left")
            salt = F.when(F.col("hot_crc32").isNotNull(), F.col("row")).otherwise(salt)
        return rows.withColumn("fine", F.pmod(F.xxhash64("doc_id", "text_crc32", salt), F.lit(self.blocks)).cast("int")).drop("row", "hot_id", "hot_crc32")

    def placed(self, rows: DataFrame) -> DataFrame:
        """rows, dealt by old and fine, with shard, nth (in the block) and, where the bases are known, slot."""
        inside = Window.partitionBy("old", "fine").orderBy("doc_id", "text_crc32", "size")
        upto = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
        rows = rows.withColumns({"upto": upto, "nth": F.row_number().over(inside)}).join(F.broadcast(self.before), ["old", "fine"])
        rows = rows.withColumn("middle", 2 * (F.col("before") + F.col("upto")) - F.col("size")).drop("before", "upto")
        rows = rows.join(F.broadcast(self.cuts), (F.col("old") == F.col("from_old")) & (F.col("middle") >= F.col("start")) & (F.col("middle") < F.col("stop"))).drop("middle", "from_old", "start", "stop")
        return rows if self.bases is None else rows.join(F.broadcast(self.bases), ["shard", "old", "fine"]).withColumn("slot", F.col("base") + F.col("nth")).drop("base")


def plan_moves(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rows_per_block: int = 1000, most_blocks: int = BROADCAST_ROWS) -> Layout:
    """The layout under the law `bytes`: new shards are as near in size (bytes of texts, and 8 a row) as whole rows allow, and the fewest bytes move.

    Each old shard's rows are cut into hashed blocks, at most `most_blocks` in all, which are broadcast; running sizes of blocks, then of rows within a block, give
    each row its place in the old shard, and the flow says which stretch of that place goes to which new shard. What stays comes first. The flow's network has
    a node for each shard only. Ids and texts that more rows share than a block should have are cut by the row's number in docs too, so docs must be read the same each time: use `steady`. Rows whose old shard is null or not one of the old_shards come from nowhere: they all move.
    """
    spark = docs.sparkSession
    blocks = max(1, min(most_blocks // (old_shards + 1), math.ceil(docs.count() / rows_per_block)))
    layout = Layout(old_shard, old_shards, blocks, id_col, text_col, None, None, None, None, [])
    with Tables(spark) as tables:
        rows = tables.save(layout.keyed(docs), "reshard-rows")
        many = rows.groupBy(F.col("doc_id").alias("hot_id"), F.col("text_crc32").alias("hot_crc32")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_block).drop("n")
        many = saved(many, "reshard-hot")
        if n := many.count():  # a block's rows for each, so few
            layout.hot = F.broadcast(many) if n <= BROADCAST_ROWS else many
            rows = tables.save(layout.keyed(docs), "reshard-rows")
        stretch = rows.groupBy("old", "fine").agg(F.sum("size").alias("bytes"))
        along = Window.partitionBy("old").orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
        layout.before = saved(stretch.select("old", "fine", F.coalesce(F.sum("bytes").over(along), F.lit(0)).alias("before")), "reshard-before")
        totals = {r["old"]: r["bytes"] for r in rows.groupBy("old").agg(F.sum("size").alias("bytes")).collect()}  # a row a shard
        supply = [totals.get(i, 0) for i in range(old_shards + 1)]
        flow = cheapest_flow(supply, even(sum(supply), new_shards), [[int(i != j or i == old_shards) for j in range(new_shards)] for i in range(old_shards + 1)])
        cuts, touched = [], set()
        for i in range(old_shards + 1):
            at = 0
            for j in sorted(range(new_shards), key=lambda j: (j != i, j)):
                if flow[i][j]:
                    cuts.append((i, j, 2 * at, 2 * (at + flow[i][j])))
                    at += flow[i][j]
                    if i == old_shards or i != j:
                        touched |= {i, j} - {old_shards} if i == old_shards else {i, j}
        layout.cuts = spark.createDataFrame(cuts, "from_old int, shard int, start long, stop long")  # old x new shards at most
        layout.touched = sorted(touched)
        part = ["shard", "old", "fine"]
        counts = layout.placed(rows).groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first"))
        before = Window.partitionBy("shard").orderBy("old", "fine").rowsBetween(Window.unboundedPreceding, -1)
        layout.bases = saved(counts.select(*part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("base")), "reshard-bases")
    return layout


def assigned(docs: DataFrame, layout: Layout) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard, moved. Texts are not shuffled. Null texts have no bytes; rows that repeat are placed each for itself; other columns are ignored."""
    moved = ~F.col("shard").eqNullSafe(F.col("old_shard"))
    return layout.placed(layout.keyed(docs)).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "old_shard", moved.alias("moved"))


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, new_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """plan_moves and assigned in one, over a steady input."""
    docs = steady(docs)
    return assigned(docs, plan_moves(docs, old_shard, old_shards, new_shards, id_col, text_col))


def rewrite_moved(docs: DataFrame, layout: Layout, path: str) -> tuple[str, str]:
    """Writes the shards that gain or lose rows, in folders under path named by shard, in slot order; the others' files stay as they are. Returns the names of the columns of shard and slot.

    The names are `shard` and `slot`, with `_` added for as long as the documents have such a column. The rows are dealt by old shard and block, one shuffle of the
    texts, so that a task has neighbours of few shards. All is written aside first; then each folder takes its place (see `swap`; what an earlier call left is finished before). Rows that repeat and rows with null ids are
    written each for itself; a shard left without rows has no folder.
    """
    spark = docs.sparkSession
    shard, slot = "shard", "slot"
    while shard in docs.columns:
        shard += "_"
    while slot in docs.columns:
        slot += "_"
    path = path.rstrip("/")
    finish_swaps(spark, path, shard)
    rows = layout.keyed(docs, F.struct(*[docs[c] for c in docs.columns]).alias("doc")).repartitionByRange("old", "fine")
    rows = layout.placed(rows).where(F.col("shard").isin(layout.touched)).sortWithinPartitions("shard", "slot")
    aside = f"{path}/_aside-{uuid.uuid4().hex}"
    rows.select("doc.*", F.col("shard").alias(shard), F.col("slot").cast("long").alias(slot)).write.partitionBy(shard).parquet(aside)
    fs = files_of(spark, path)
    ready = fs.create(hadoop_path(spark, f"{aside}/{READY}"))
    full = {i: fs.exists(hadoop_path(spark, f"{aside}/{shard}={i}")) for i in layout.touched}
    ready.writeBytes(" ".join(f"{i}:{int(rows)}" for i, rows in full.items()))
    ready.close()
    swap(spark, path, shard, aside, full)
    return shard, slot


#: A file in an aside folder: all is written there; it names the shards that are to be replaced, and says which have rows.
READY = "_ready"


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def files_of(spark: SparkSession, path: str):
    return hadoop_path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def swap(spark: SparkSession, path: str, shard: str, aside: str, full: dict[int, bool]) -> None:
    """Puts the shards' folders in aside into their places; full: which of the shards have rows now, and so a new folder. Every rename is checked; one that fails puts the old folder back and raises, and nothing that is needed to go on is deleted.

    Each step can be done again: an old folder goes to `<aside>/_old` before the new one comes, and only when all are in place is anything deleted.
    """
    fs, at = files_of(spark, path), lambda *parts: hadoop_path(spark, "/".join(parts))
    fs.mkdirs(at(aside, "_old"))
    for i, rows in full.items():
        name = f"{shard}={i}"
        place, new, old = at(path, name), at(aside, name), at(aside, "_old", name)
        if rows and not fs.exists(new):
            continue  # it is in its place already
        if fs.exists(place) and not fs.exists(old) and not fs.rename(place, old):
            raise OSError(f"{place} can't be moved aside")
        if fs.exists(new) and not fs.rename(new, place):
            back = not fs.exists(old) or fs.rename(old, place)
            raise OSError(f"{new} can't take its place" + ("" if back else f", and the old files are in {old}"))
    fs.delete(at(aside), True)


def finish_swaps(spark: SparkSession, path: str, shard: str = "shard") -> list[str]:
    """After a driver that died: goes on with swaps whose files were all written, and deletes what wasn't. The aside folders it found."""
    fs, found = files_of(spark, path), []
    if not fs.exists(hadoop_path(spark, path)):
        return found
    for status in fs.listStatus(hadoop_path(spark, path)):
        if status.getPath().getName().startswith("_aside-"):
            aside = status.getPath().toString()
            found.append(aside)
            ready = hadoop_path(spark, f"{aside}/{READY}")
            if fs.exists(ready):
                text = fs.open(ready)
                said = spark._jvm.org.apache.commons.io.IOUtils.toString(text, "UTF-8")
                text.close()
                swap(spark, path, shard, aside, {int(i): rows == "1" for i, rows in (x.split(":") for x in said.split())})
            else:
                fs.delete(hadoop_path(spark, aside), True)
    return found


def steady(docs: DataFrame) -> DataFrame:
    """docs, or, where it isn't a plain scan, which gives each row the same number each time, docs written and read again."""
    return docs if "Exchange" not in docs._jdf.queryExecution().executedPlan().toString() else saved(docs, "reshard-docs")
