"""N-gram Jaccard join by chosen paths: sets are split again and again on sampled tokens that they share, and small buckets compared by brute force.

1. Each text becomes the set of its hashed word n-grams; texts with the same set are taken as one from here on.
2. A set's minima under `COORDINATES` hash functions are its tokens. In each run, a node of the tree samples about 1 / similarity of the tokens,
   and a set goes on to a child for each, named by the token's value: sets meet in a leaf where they share all the tokens on its path.
   The number of runs follows from the target recall, for leaves at just this depth. Leaves with too many sets are split in a way that parts no pair
   that step 3 would link, and what can't be split is compared in blocks.
3. In a leaf, sets whose minima agree often enough are linked; the components of those links hold all pairs that can be similar.
4. Within a component every pair is compared, on whole sets (of 32-bit hashes, so up to their collisions): this gives the links, and the classes.

Large leaves and components have a pivot, one of their sets. Sets close to it need no comparison with each other: in a leaf they are all connected
through it, in a component they are so close that any two of them are linked. Only the others are compared with all, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Tables, saved, small_batches, spread
from .components import components
from .words import starts_of, words

COORDINATES = 64
DEPTH = 3
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x = x ^ (x >> U64(29))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


SCALES = mix(np.arange(1, COORDINATES + 1, dtype=U64)) | U64(1)


def runs_for(recall: float, similarity: float, depth: int = DEPTH) -> int:
    """How often to repeat so that a pair of just this similarity shares a leaf of some run with the probability `recall`."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-survive)  # a shared child for each of 1 / similarity sampled tokens, at this similarity: one on average
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


class Shingler:
    """Hashes of word n-grams, the words' own hashes kept."""

    def __init__(self, n: int, keep: int = 400_000):
        self.n, self.keep = n, keep
        self.known: dict[str, int] = {}

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """For each text its distinct n-grams' hashes, sorted; a text of fewer words has one, of all its words; one without words none."""
        if len(self.known) > self.keep:
            self.known.clear()
        found = [words(t.lower()) for t in texts]
        known = self.known
        for w in {w for ws in found for w in ws}.difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((known[w] for ws in found for w in ws), U64, int(sizes.sum()))
        step = U64(0x2545F4914F6CDD1D)
        grams = flat.copy()
        for k in range(1, self.n):
            grams[: len(flat) - k] = grams[: len(flat) - k] * step + flat[k:]
        grams = mix(grams)
        out = []
        for start, size in zip(starts_of(sizes).tolist(), sizes.tolist()):
            if size >= self.n:
                out.append(np.unique(grams[start : start + size - self.n + 1]))
            elif size:
                short = np.array([size], U64)
                for i in range(start, start + size):
                    short = mix(short * step + flat[i : i + 1])
                out.append(short)
            else:
                out.append(np.zeros(0, U64))
        return out


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """A row of COORDINATES 16-bit minima for each set, none of which may be empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, starts = np.concatenate(sets), starts_of(sizes)
    out = np.empty((len(sets), COORDINATES), np.uint16)
    for j, scale in enumerate(SCALES):
        least = np.minimum.reduceat((flat * scale) >> U64(24), starts)
        out[:, j] = (mix(least) >> U64(48)).astype(np.uint16)
    return out


def descend(nodes: np.ndarray, rows: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, row) pairs: each node samples tokens by a hash of its own name, and a child is named by the token and its value."""
    names = mix(nodes[:, None] ^ SCALES[None, :])
    picked = names < U64(int(2**64 / (similarity * COORDINATES)))
    at, j = np.nonzero(picked)
    return mix(names[at, j] + tokens[rows[at], j].astype(U64)), rows[at]


def leaves(tokens: np.ndarray, runs: int, similarity: float, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Names of the leaves, and the row of tokens that reaches each."""
    n = len(tokens)
    nodes, rows = mix(np.repeat(np.arange(1, runs + 1, dtype=U64), n)), np.tile(np.arange(n), runs)
    for _ in range(depth):
        nodes, rows = descend(nodes, rows, tokens, similarity)
    return nodes, rows


def sketched(docs: DataFrame, n: int, runs: int, similarity: float) -> DataFrame:
    """docs(rid, doc_id, text) -> rid, doc_id, size, d1, d2 (digests of the set), leaves, sketch (the minima), grams (the set, as 32-bit numbers)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in batches:
            sets = shingler.sets([t or "" for t in batch.column(2).to_pylist()])
            some = [i for i, s in enumerate(sets) if len(s)]
            ways: list = [[] for _ in sets]
            sketch: list = [b""] * len(sets)
            d1, d2 = np.zeros(len(sets), U64), np.zeros(len(sets), U64)
            if some:
                full = [sets[i] for i in some]
                tokens = minima(full)
                nodes, rows = leaves(tokens, runs, similarity)
                order = np.argsort(rows, kind="stable")
                parts = np.split(nodes[order].view(np.int64), np.searchsorted(rows[order], np.arange(1, len(full))))
                flat, starts = np.concatenate(full), starts_of(np.fromiter(map(len, full), np.int64, len(full)))
                d1[some], d2[some] = np.add.reduceat(mix(flat), starts), np.add.reduceat(mix(flat ^ SCALES[0]), starts)
                for i, way, row in zip(some, parts, tokens):
                    ways[i], sketch[i] = way, row.tobytes()
            grams = [(s >> U64(32)).astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(ways, pa.list_(pa.int64())), pa.array(sketch, pa.binary()), pa.array(grams, pa.binary())],
                names=["rid", "doc_id", "size", "d1", "d2", "leaves", "sketch", "grams"],
            )

    return spread(docs).mapInArrow(run, "rid long, doc_id long, size int, d1 long, d2 long, leaves array<long>, sketch binary, grams binary")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 2000) -> Iterator[pa.Table]:
    """Sorted batches, joined and cut so that no group (first column) is parted."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table.column(0).to_numpy()
        cut = int(np.argmax(keys == keys[-1]))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
        rows = table.num_rows - cut
        least = max(2000, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)


def in_units(rows: DataFrame, group: str, block: int) -> DataFrame:
    """rows(group, members, fars, far, rid, ...) with unit and part first, less fars and far. Units are such that every two rows of a group, of which one at least is far, meet in exactly one.

    A group of up to `block` rows, all far, is one unit; else far and other rows are dealt into blocks each, and every two blocks of which one at least is far are a unit.
    part: -1 where all pairs of the unit count, else 0 or 1, and only pairs of different parts count.
    """
    near_blocks, far_blocks = F.ceil((F.col("members") - F.col("fars")) / block).cast("int"), F.ceil(F.col("fars") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rid"), F.when(F.col("far"), far_blocks).otherwise(near_blocks)).cast("int"))
    own = F.col("own")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    place = lambda kind, a, b, part: F.struct(F.lit(kind).alias("kind"), a.alias("a"), b.alias("b"), part.cast("int").alias("part"))
    with_far = F.transform(upto(far_blocks), lambda o: place(0, F.least(own, o), F.greatest(own, o), F.when(own == o, -1).otherwise((own > o).cast("int"))))
    with_near = F.transform(upto(near_blocks), lambda o: place(1, own, o, F.lit(0)))
    places = F.when(F.col("far"), F.concat(with_far, with_near)).otherwise(F.transform(upto(far_blocks), lambda o: place(1, o, own, F.lit(1))))
    names = [c for c in rows.columns if c not in ("own", "fars", "far")]
    rows = rows.withColumn("at", F.explode(places))
    out = rows.select(F.xxhash64(group, "at.kind", "at.a", "at.b").alias("unit"), F.col("at.part").alias("part"), *names)
    return out.repartition("unit").sortWithinPartitions("unit", "part", "rid")


def judged(rows: DataFrame, group: str, sets: DataFrame, column: str, far: Callable[[pa.RecordBatch], np.ndarray], block: int) -> DataFrame:
    """rows(group, members, rid) of large groups -> group, members, rid, pivot, far: whether the row's `column`, and size, are far from those of the group's pivot, its smallest row.

    far is given batches of size, column, pivot size, pivot column. The pivots are dealt to the blocks of their group, so that no task gets a whole one.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    pivots = rows.groupBy(group).agg(F.min("rid").alias("pivot"), F.max("members").alias("members")).select(group, "pivot", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("own"))
    pivots = pivots.join(sets.select(F.col("rid").alias("pivot"), F.col("size").alias("pivot_size"), F.col(column).alias("pivot_set")), "pivot")
    both = rows.withColumn("own", F.pmod(F.xxhash64("rid"), blocks).cast("int")).join(sets.select("rid", "size", column), "rid").join(pivots, [group, "own"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(far(part.select([4, 5, 6, 7])))], names=[group, "members", "rid", "pivot", "far"])

    return both.select(group, "members", "rid", "pivot", "size", column, "pivot_size", "pivot_set").mapInArrow(judge, f"{group} long, members long, rid long, pivot long, far boolean")


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, COORDINATES)


def with_fars(small: DataFrame, told: DataFrame | None, group: str) -> DataFrame:
    """group, members, fars (how many far rows the group has, as its size counts), far, rid: of the small groups, whose rows are all far, and of those that `judged` told."""
    rows = small.select(group, "members", F.col("members").alias("fars"), F.lit(True).alias("far"), "rid")
    if told is None:
        return rows
    share = F.ceil(F.max("members") * F.avg(F.col("far").cast("double"))).cast("long").alias("fars")
    return rows.unionByName(told.join(told.groupBy(group).agg(share), group).select(group, "members", "fars", "far", "rid"))


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component under links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows in each of many small groups."""
    left, right = [], []
    for size in np.unique(sizes):
        i, j = np.triu_indices(int(size), 1)
        at = starts[sizes == size]
        left.append((at[:, None] + i).ravel())
        right.append((at[:, None] + j).ravel())
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def bounds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.append(starts, len(keys)))


def close_pairs(table: pa.Table, agree: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit whose minima agree in `agree` places at least."""
    tokens = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, COORDINATES)
    part = table.column("part").to_numpy()
    starts, sizes = bounds(table.column("unit").to_numpy())
    easy = sizes <= small
    a, b = pairs_within(starts[easy], sizes[easy])
    found = [np.zeros((2, 0), np.int64)]
    for at in range(0, len(a), 200_000):
        x, y = a[at : at + 200_000], b[at : at + 200_000]
        ok = (tokens[x] == tokens[y]).sum(axis=1) >= agree
        ok &= (part[x] != part[y]) | (part[x] < 0)
        found.append(np.stack([x[ok], y[ok]]))
    for start, size in zip(starts[~easy], sizes[~easy]):
        left = start + np.flatnonzero(part[start : start + size] < 1)
        right = start + np.flatnonzero(part[start : start + size] != 0)
        same = np.zeros((len(left), len(right)), np.uint8)
        for j in range(COORDINATES):
            same += tokens[left, j][:, None] == tokens[right, j][None, :]
        i, j = np.nonzero(same >= agree)
        found.append(np.stack([left[i], right[j]]))
    a, b = np.concatenate(found, axis=1)
    return a[a < b], b[a < b]


def similar_pairs(table: pa.Table, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit whose sets have this Jaccard similarity at least, by exact counts of what they share."""
    sizes_of = table.column("size").to_numpy()
    part = table.column("part").to_numpy()
    grams = [np.frombuffer(g, np.uint32) for g in table.column("grams").to_pylist()]
    found = [np.zeros((2, 0), np.int64)]
    for start, size in zip(*bounds(table.column("unit").to_numpy())):
        own = grams[start : start + size]
        flat = np.concatenate(own)
        owner = np.repeat(np.arange(size), [len(g) for g in own])
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        first, times = bounds(flat)
        column = np.repeat(np.cumsum(times > 1) - 1, times)
        shared = np.repeat(times > 1, times)
        column, owner = column[shared], owner[shared]
        width = int(column[-1]) + 1 if len(column) else 0
        both = np.zeros((size, size), np.float32)
        for at in range(0, width, 4096):
            inside = slice(*np.searchsorted(column, [at, at + 4096]))
            x = np.zeros((size, min(4096, width - at)), np.float32)
            x[owner[inside], column[inside] - at] = 1
            both += x @ x.T
        n = sizes_of[start : start + size].astype(np.float64)
        p = part[start : start + size]
        ok = np.triu(both >= similarity * (n[:, None] + n[None, :] - both) - 1e-6, 1) & ((p[:, None] != p[None, :]) | (p[:, None] < 0))
        found.append(start + np.stack(np.nonzero(ok)))
    a, b = np.concatenate(found, axis=1)
    return a, b


def shared_leaves(reach: DataFrame) -> DataFrame:
    """reach(leaf, rid) -> the same for leaves with two rows at least, with members; of leaves with the same rows one is kept."""
    by_leaf = reach.groupBy("leaf").agg(F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("rid")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "rid")).alias("x2")).where("members > 1")
    kept = by_leaf.groupBy("members", "x1", "x2").agg(F.min("leaf").alias("leaf")).select("leaf", "members")
    return reach.join(kept, "leaf")


def split_leaves(shared: DataFrame, large: DataFrame, sketches: DataFrame, agree: int, split_above: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """All leaves again, the `large` ones split where that pays, and those of the new ones that are still large.

    Two sets that agree in `agree` places share one at least of their COORDINATES - agree + 1 rarest tokens, if rarity is one order for the whole leaf.
    So a leaf is replaced by one for each token, with the sets that have it among their rarest: no pair that counts is parted. Where this doesn't
    halve the pairs to compare, as in a leaf of near copies, the leaf stays.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                tokens = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint16).reshape(-1, COORDINATES)
                named = tokens.astype(np.int32) + (np.arange(COORDINATES, dtype=np.int32) << 16)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(i).to_numpy(), COORDINATES)) for i in (0, 1)] + [pa.array(named.ravel())], names=["parent", "rid", "token"])

    tokens = large.select("leaf", "rid").join(sketches, "rid").select("leaf", "rid", "sketch").mapInArrow(explode, "parent long, rid long, token int")
    times = tokens.groupBy("parent", "token").agg(F.count(F.lit(1)).alias("times"))
    ranked = tokens.join(times, ["parent", "token"]).groupBy("parent", "rid").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "token"))), 1, COORDINATES - agree + 1).alias("rarest"))
    rarest = ranked.select("parent", "rid", F.explode("rarest").alias("at")).where("at.times > 1")
    children = tables.save(rarest.select("parent", F.xxhash64("parent", "at.token").alias("leaf"), "rid"), "ngram-children")
    cost = children.groupBy("parent", "leaf").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy("parent").agg(F.sum(F.col("n") * F.col("n")).alias("cost"))
    parents = large.groupBy(F.col("leaf").alias("parent")).agg(F.count(F.lit(1)).cast("double").alias("n")).join(cost, "parent", "left")
    paying = tables.save(parents.where(F.coalesce("cost", F.lit(0.0)) * 2 <= F.col("n") * F.col("n")).select("parent"), "ngram-paying")
    deeper = tables.save(shared_leaves(children.join(paying, "parent", "left_semi").select("leaf", "rid").distinct()), "ngram-leaves")
    kept = shared.join(paying, F.col("leaf") == F.col("parent"), "left_anti")
    return tables.save(kept.unionByName(deeper), "ngram-leaves"), deeper.where(F.col("members") > split_above)


def ngram_join(docs: DataFrame, n: int = 5, similarity: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text", block: int = 1024, split_above: int = 20_000, deepest: int = 8, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links, n_copies; where row_col is given, also it and kept.

    Texts are linked whose sets of word n-grams (lower-cased runs of letters, digits and underscores) have at least this Jaccard similarity.
    class_id: the smallest id of all that are connected by links or have the same set. n_links: how many other sets are linked to the row's.
    n_copies: how many rows have the same set. A text of fewer than n words has one n-gram, of all of them. Null, empty and other texts
    without words are like nothing: each is its own class. A null id is never the smallest unless its class has no other. Rows that repeat an id are
    taken as rows of their own. Other columns are ignored. row_col: a column of long numbers that tells rows apart. kept: true for just one row
    of each class, of those with the smallest id the one where row_col is least. The result is written in the shared folder, what led to it is removed.

    block: how many rows, or thousands of n-grams if that is more, a task compares with as many others. It changes no result, nor do split_above and deepest.
    """
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with Tables(docs.sparkSession) as tables:
        out = joined(rows, n, similarity, recall, block, split_above, deepest, tables)
        return saved(out.withColumnRenamed("rid", row_col) if row_col else out.drop("rid", "kept"), "ngram-join")


def joined(rows: DataFrame, n: int, similarity: float, recall: float, block: int, split_above: int, deepest: int, tables: Tables) -> DataFrame:
    """rows(rid, doc_id, text) -> doc_id, class_id, n_links, n_copies, rid, kept."""
    sets = tables.save(sketched(rows, n, runs_for(recall, similarity), similarity), "ngram-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid")).alias("first")
    some = sets.where("size > 0")
    reps = some.groupBy("size", "d1", "d2").agg(first, F.count(F.lit(1)).alias("n_copies"))
    reps = tables.save(reps.select("size", "d1", "d2", F.col("first.rid").alias("rep"), F.col("first.doc_id").alias("rep_doc"), "n_copies"), "ngram-reps")

    reach = some.select("rid", "leaves").join(reps.select(F.col("rep").alias("rid")), "rid", "left_semi").select(F.explode("leaves").alias("leaf"), "rid").distinct()
    shared = tables.save(shared_leaves(reach), "ngram-leaves")
    agree = math.floor(COORDINATES * similarity - 3.5 * math.sqrt(COORDINATES * similarity * (1 - similarity)))
    groups = components(close_links(shared, some, agree, max(1, block // 2), split_above, deepest, tables), tables)
    groups = tables.save(groups.select("root", F.col("node").alias("rid")), "ngram-groups")
    linked = exact_links(groups, some, similarity, block, tables)

    found = reps.join(linked, F.col("rep") == F.col("rid"), "left").select("size", "d1", "d2", "rep", "rep_doc", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("near", "rep").alias("class"))
    classes = found.groupBy("class").agg(F.min(F.struct(F.col("rep_doc").isNull().alias("no"), "rep_doc", "rep")).alias("first")).select("class", F.col("first.rep_doc").alias("class_id"), F.col("first.rep").alias("class_row"))
    found = found.join(classes, "class").select(F.col("size").alias("s"), F.col("d1").alias("e1"), F.col("d2").alias("e2"), "class_id", "class_row", "n_links", "n_copies", F.lit(True).alias("known"))
    every = sets.select("rid", "doc_id", "size", "d1", "d2").join(found, (F.col("size") == F.col("s")) & (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    class_id = F.when(F.col("known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id")
    numbers = [F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies")]
    return every.select("doc_id", class_id, *numbers, "rid", F.coalesce(F.col("rid") == F.col("class_row"), F.lit(True)).alias("kept"))


def close_links(shared: DataFrame, sets: DataFrame, agree: int, block: int, split_above: int, deepest: int, tables: Tables) -> DataFrame:
    """u, v: links of rows that meet in a leaf and whose minima agree in `agree` places, as many as connect all such rows."""
    sketches = sets.select("rid", "size", "sketch")
    large = shared.where(F.col("members") > split_above)
    depth = DEPTH
    while depth < deepest and large.limit(1).count():
        shared, large = split_leaves(shared, large, sketches, agree, split_above, tables)
        depth += 1

    def differ(batch: pa.RecordBatch) -> np.ndarray:
        return (rows_of(batch.column(1)) == rows_of(batch.column(3))).sum(axis=1) < agree

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            a, b = close_pairs(table, agree)
            label = roots(table.num_rows, a, b)
            rid = table.column("rid").to_numpy()
            other = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(rid[other]), pa.array(rid[label[other]])], names=["u", "v"])

    over = shared.where(F.col("members") > block).select("leaf", "members", "rid")
    told = tables.save(judged(over, "leaf", sketches, "sketch", differ, block), "ngram-leaf-pivots") if over.limit(1).count() else None
    met = with_fars(shared.where(F.col("members") <= block), told, "leaf").join(sketches.select("rid", "sketch"), "rid")
    links = in_units(met, "leaf", block).mapInArrow(near, "u long, v long")
    if told is not None:
        links = links.union(told.where("NOT far AND rid <> pivot").select("rid", "pivot"))
    return links.distinct()


def exact_links(groups: DataFrame, sets: DataFrame, similarity: float, block: int, tables: Tables) -> DataFrame:
    """groups(root, rid) -> rid, n_links, near (a row's class within its group)."""
    share = similarity / (1 + similarity)
    counted = groups.join(sets.select("rid", "size"), "rid").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("grams"))
    sized = tables.save(groups.join(counted, "root").select("root", F.greatest("n", F.ceil(F.col("grams") / 1000)).cast("long").alias("members"), "rid"), "ngram-sized")

    def loose(batch: pa.RecordBatch) -> np.ndarray:
        # two sets are similar if they share `share` of the sum of their sizes; they share at least what both have of the pivot's. So they are, if each misses
        # so little of the pivot that what it misses, and its part of that sum, are half of the pivot
        size, core_size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        grams = ((np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) for x, y in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()))
        held = np.fromiter((np.isin(core, mine).sum() for mine, core in grams), np.int64, len(size))
        return core_size - held + share * size > core_size / 2 - 1e-6

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches):
            a, b = similar_pairs(table, similarity)
            m, rid = table.num_rows, table.column("rid").to_numpy()
            label = roots(m, a, b)
            yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.bincount(a, minlength=m) + np.bincount(b, minlength=m)), pa.array(rid[label]), pa.array(table.column("members").to_numpy() > block)], names=["rid", "links", "near", "parted"])

    over = sized.where(F.col("members") > block)
    some_over = bool(over.limit(1).count())
    told = tables.save(judged(over, "root", sets, "grams", loose, block), "ngram-group-pivots") if some_over else None
    wanted = with_fars(sized.where(F.col("members") <= block), told, "root")
    if groups.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    compared = wanted.join(sets.select("rid", "size", "grams"), "rid")
    met = tables.save(in_units(compared, "root", block).mapInArrow(links, "rid long, links long, near long, parted boolean"), "ngram-links")
    if told is None:
        return met.groupBy("rid").agg(F.sum("links").alias("n_links"), F.min("near").alias("near"))
    near_rows = told.where("NOT far")
    close = near_rows.join(near_rows.groupBy("root").agg((F.count(F.lit(1)) - 1).alias("links")), "root")
    met = met.unionByName(close.select("rid", "links", F.col("pivot").alias("near"), F.lit(True).alias("parted")))
    linked = met.groupBy("rid").agg(F.sum("links").alias("n_links"), F.min("near").alias("near"))
    parts = components(met.where("parted").select(F.col("rid").alias("u"), F.col("near").alias("v")), tables).select(F.col("node").alias("rid"), "root")
    return linked.join(parts, "rid", "left").select("rid", "n_links", F.coalesce("root", "near").alias("near"))
