"""A Merkle manifest: a digest of every row, a tree over each group's rows and one over the groups, and what tampering with a row does to the root.

The tree is cut into aligned blocks of FAN ** depth nodes. Blocks are built where they lie, their tops are the nodes of the next, far smaller, table, and so on until a
group has one node. On the way back each block gets the path above it: for every level the digests left and right of it. A block is then a persistent tree: a
tampered leaf makes a version that copies the leaf's ancestors within the block and shares every other node, and goes on along the path above, in the same task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from .common import BROADCAST_ROWS, Tables, crc_bucket, saved, small_batches

#: So many consecutive nodes become one.
FAN = 3
#: Levels of a block: 3 ** 7 = 2187 nodes.
DEPTH = 7
#: What a leaf holds, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: A digest in hex, and its children.
Node = tuple[str, tuple]
#: For each level, from the leaf up: the digests left and right of a node in its run, in hex, joined.
Path = list[tuple[str, str]]

PATH = ArrayType(StructType([StructField("before", StringType()), StructField("after", StringType())]))


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value: Column) -> Column:
    """A field as text that can't be taken for another: its UTF-8 length, a colon, the value; a dash if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[framed(c) for c in fields]), 256))


def tree(leaves: list[str], height: int) -> Node:
    """The node over up to FAN ** height leaves; every FAN consecutive nodes become one, the last run may have fewer."""
    level: list[Node] = [(x, ()) for x in leaves]
    for _ in range(height):
        runs = [tuple(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        level = [(digest("".join(d for d, _ in run)), run) for run in runs]
    return level[0]


def height_of(n: int, depth: int) -> int:
    """Levels until n nodes are one, `depth` at most."""
    levels = 0
    while n > 1 and levels < depth:
        n, levels = -(-n // FAN), levels + 1
    return levels


def turns(at: int, height: int) -> list[int]:
    """Which child to take from the top of a block down to its leaf `at`."""
    return [at // FAN**k % FAN for k in range(height - 1, -1, -1)]


def path_of(top: Node, way: list[int]) -> Path:
    """The siblings beside the way, from the leaf up."""
    found, node = [], top
    for k in way:
        children = node[1]
        found.append(("".join(d for d, _ in children[:k]), "".join(d for d, _ in children[k + 1 :])))
        node = children[k]
    return found[::-1]


def version(node: Node, way: list[int], changed: str, k: int = 0) -> Node:
    """The tree with another leaf: the leaf's ancestors are copied, all other nodes are the same objects."""
    if k == len(way):
        return changed, ()
    children = node[1]
    new = (*children[: way[k]], version(children[way[k]], way, changed, k + 1), *children[way[k] + 1 :])
    return digest("".join(d for d, _ in new)), new


def folded(top: str, above: Path) -> str:
    for before, after in above:
        top = digest(before + top + after)
    return top


def numbered(rows: DataFrame, group: str, order: list[str], tables: Tables) -> DataFrame:
    """rows with `at`, their place in their group (0, 1, ...) in this order, nulls first, and `total`, the rows of the group.

    One range partitioning by group and order, then the running sums of partition sizes: no task gets a group. Rows that agree in all of these may be dealt to several
    partitions; they must be interchangeable.
    """
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    salted = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id()))
    ranged = salted.repartitionByRange(*by, F.col("salt")).sortWithinPartitions(*by).drop("salt")
    ranged = tables.save(ranged.withColumn("rid", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumn("part", F.shiftright("rid", 33))
    sizes = ranged.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first"))
    whole = Window.partitionBy(group)  # a row a partition that holds rows of the group
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = tables.save(sizes.select(group, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("total")), "sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    return ranged.join(sizes, [group, "part"]).withColumn("at", F.col("rid") + F.col("shift")).drop("part", "rid", "shift")


def in_blocks(nodes: DataFrame, depth: int, *also: str) -> DataFrame:
    """group, block, total, nodes: the aligned blocks of nodes(group, at, total, digest, also), each in order."""
    block = F.floor(F.col("at") / FAN**depth).alias("block")
    return nodes.groupBy("group", block).agg(F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("at", "digest", *also))).alias("nodes"))


def tops(blocks: DataFrame, depth: int) -> DataFrame:
    """The nodes of the next table: group, at, total, digest, and whether the group is done."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, at, total, nodes = (c.to_pylist() for c in batch.columns)
            made = [bytes.fromhex(tree([d.hex() for d in ds], height_of(n, depth))[0]) for ds, n in zip(nodes, total)]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.string()), pa.array(at, pa.int64()), pa.array([-(-n // FAN**depth) for n in total], pa.int64()), pa.array(made, pa.binary())], names=["group", "at", "total", "digest"])

    schema = StructType([StructField("group", StringType()), StructField("at", LongType()), StructField("total", LongType()), StructField("digest", BinaryType())])
    return blocks.select("group", "block", "total", F.col("nodes.digest").alias("nodes")).mapInArrow(build, schema)


def climbed(first: DataFrame, depth: int, tables: Tables) -> tuple[list[DataFrame], DataFrame]:
    """The block tables above and with `first`, lowest first, and digest of each group's last node."""
    levels, done = [first], None
    while True:
        up = tables.save(tops(levels[-1], depth), "tops")
        ended = up.where("total = 1").select("group", "digest")
        done = ended if done is None else done.unionByName(ended)
        more = up.where("total > 1")
        if more.isEmpty():
            return levels, done
        levels.append(tables.save(in_blocks(more, depth), "blocks"))


def descended(levels: list[DataFrame], above: DataFrame, depth: int, tables: Tables) -> DataFrame:
    """group, block, above of the lowest table's blocks: above(group, above) is the path of each group's last node; paths are handed down table by table."""
    schema = StructType([StructField("group", StringType()), StructField("block", LongType()), StructField("above", PATH)])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, total, nodes, path in zip(*(c.to_pylist() for c in batch.columns)):
                height = height_of(total, depth)
                top = tree([x["digest"].hex() for x in nodes], height)
                own = [path_of(top, turns(i, height)) for i in range(len(nodes))]
                paths = [[*({"before": b, "after": a} for b, a in p), *path] for p in own]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(nodes), pa.string()), pa.array([x["at"] for x in nodes], pa.int64()), pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], names=["group", "block", "above"])

    held = None
    for blocks in reversed(levels):
        last = blocks.where(F.col("total") <= FAN**depth).join(above, "group")
        if held is not None:
            columns = blocks.columns
            last = last.unionByName(blocks.join(held, ["group", "block"]).select(*columns, "above"))
        if blocks is levels[0]:
            return last
        held = tables.save(last.select("group", "total", "nodes", "above").mapInArrow(down, schema), "above")
    raise ValueError("no tables")


def manifest(docs: DataFrame, tampered: Column | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fields: tuple[str, ...] = FIELDS, depth: int = DEPTH) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    A leaf is the SHA-256 of the framed fields; leaves stand by doc_id within a source, sources by their UTF-8 bytes, null first in both. tampered: the text of a row as it was
    tampered with, null where it wasn't (by default nothing is); folded_root is the root that such a row's version has, with all other rows as they were, and the root itself for a
    row that is whole; verified says that both agree. Rows with equal ids stand by their leaves; wholly equal rows are each a leaf. Null and empty fields differ. An empty table gives no
    rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, 100)  # a row is a block
    group = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # null sorts first
    changed = F.lit(None).cast("string") if tampered is None else tampered
    of = lambda text: leaf([text if f == text_col else F.col(f) for f in fields])
    rows = docs.select(F.col(id_col).alias("doc_id"), group.alias("group"), of(F.col(text_col)).alias("digest"), F.when(changed.isNotNull(), of(changed)).alias("changed"))
    with Tables(spark) as tables:
        leaves = numbered(tables.save(rows, "leaves"), "group", ["doc_id", "digest", "changed"], tables)
        levels, subroots = climbed(tables.save(in_blocks(leaves, depth, "doc_id", "changed"), "blocks"), depth, tables)
        subroots = tables.save(subroots, "subroots")
        named = numbered(subroots.select(F.lit("").alias("all"), F.col("group").alias("name"), "digest"), "all", ["name"], tables)
        upper, root = climbed(tables.save(in_blocks(named.withColumnRenamed("all", "group"), depth, "name"), "sources"), depth, tables)
        whole = root.collect()  # one row, none for an empty table
        none = spark.createDataFrame([("", [])], StructType([StructField("group", StringType()), StructField("above", PATH)]))
        sources = source_paths(descended(upper, none, depth, tables), depth)
        paths = descended(levels, tables.save(sources, "source-paths"), depth, tables)
        held = saved(paths.join(subroots.withColumnRenamed("digest", "subroot"), "group").select("total", "nodes", "above", "subroot"), "merkle-blocks")
    return proven(held, docs.schema[id_col].dataType, whole[0]["digest"].hex() if whole else "", depth)


def source_paths(blocks: DataFrame, depth: int) -> DataFrame:
    """group, above: the path of each source's subroot up to the root."""
    schema = StructType([StructField("group", StringType()), StructField("above", PATH)])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total, nodes, above in zip(*(c.to_pylist() for c in batch.columns)):
                height = height_of(total, depth)
                top = tree([x["digest"].hex() for x in nodes], height)
                paths = [[*({"before": b, "after": a} for b, a in path_of(top, turns(i, height))), *above] for i in range(len(nodes))]
                yield pa.RecordBatch.from_arrays([pa.array([x["name"] for x in nodes], pa.string()), pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))], names=["group", "above"])

    return blocks.select("total", "nodes", "above").mapInArrow(spell, schema)


def proven(blocks: DataFrame, kind, root: str, depth: int) -> DataFrame:
    """The documents of blocks(total, nodes, above, subroot), each with its proof and the root of its version."""
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
    schema = StructType([StructField("doc_id", kind), *[StructField(n, StringType()) for n in names], StructField("verified", BooleanType())])

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for i, (total, nodes, above, subroot) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                height = height_of(total, depth)
                upper = [(x["before"], x["after"]) for x in above]
                rest = "".join(b + a for b, a in upper)
                base = tree([x["digest"].hex() for x in nodes], height)
                whole = folded(base[0], upper)
                out = []
                for k, x in enumerate(nodes):
                    way, changed = turns(k, height), x["changed"]
                    proof = digest("".join(b + a for b, a in path_of(base, way)) + rest)
                    same = changed is None or changed == x["digest"]
                    got = whole if same else folded(version(base, way, changed.hex())[0], upper)
                    out.append((x["digest"].hex(), subroot.hex(), root, proof, got))
                columns = [pa.array(c, pa.string()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([ids[i].values, *columns, pa.array([r[4] == root for r in out])], names=["doc_id", *names, "verified"])

    few = F.transform("nodes", lambda x: F.struct(x["digest"].alias("digest"), x["changed"].alias("changed")))
    return blocks.select(F.col("nodes.doc_id").alias("ids"), "total", few.alias("nodes"), "above", "subroot").mapInArrow(prove, schema)


def without_line_ends(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The tampering to look for: rows whose id has an even crc32 have lost their line ends."""
    return F.when(crc_bucket(F.col(id_col), 2) == 0, F.replace(F.col(text_col), F.lit("\n"), F.lit("")))
