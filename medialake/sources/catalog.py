"""A versioned catalog on any file system that Spark writes: tables of one commit become visible together."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    """Each commit writes its tables under table/v=<n> and then, last, one row under _versions/v=<n> that says where every table now is.

    Readers resolve the newest row once, so they see a whole commit or none of it; nothing is overwritten, and older versions stay readable.
    One writer at a time: a second commit of the same number fails on its existing folder.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> dict[int, dict[str, str]]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_versions")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return {}
        rows = self.spark.read.schema("number long, tables string").parquet(f"{self.path}/_versions/*").collect()  # a row a commit
        return {r["number"]: json.loads(r["tables"]) for r in rows}

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """The new version's number; tables that aren't given stay as they were."""
        known = self.versions()
        last = max(known, default=0)
        where = dict(known.get(last, {}))
        for name, df in tables.items():
            where[name] = f"{name}/v={last + 1}"
            df.write.parquet(f"{self.path}/{where[name]}")
        self.spark.createDataFrame([(last + 1, json.dumps(where))], "number long, tables string").coalesce(1).write.parquet(f"{self.path}/_versions/v={last + 1}")
        return last + 1

    def read(self, name: str, version: int | None = None) -> DataFrame:
        known = self.versions()
        return self.spark.read.parquet(f"{self.path}/{known[version or max(known)][name]}")

    def changes(self, name: str, key: str, old: int, new: int) -> DataFrame:
        """key, change of the rows that two versions of a table differ in."""
        a, b = self.read(name, old), self.read(name, new)
        rest = [c for c in a.columns if c != key]
        left, right = (t.select(key, F.struct(*rest).alias(side)) for t, side in ((a, "was"), (b, "now")))
        both = left.join(right, key, "full").where("NOT (was <=> now)")
        return both.select(key, F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("updated").alias("change"))


def add_items(catalog: Catalog, items: DataFrame, tables: dict[str, DataFrame]) -> int:
    """One commit of new items(item_id, library_id, file_id, path, kind, size_bytes, modified_s, value, metadata): file, hash, item and tag rows behind those of `tables`."""
    from ..operators.tags import automatic

    new = {
        "files": items.select("file_id", "path", "kind", "size_bytes", "modified_s", "metadata"), "file_hashes": items.select("file_id", F.lit("sampledSha256").alias("kind"), "value"),
        "items": items.select("item_id", "library_id", "file_id"), "item_tags": automatic(items).distinct(),
    }
    return catalog.commit({n: df if n not in tables else tables[n].unionByName(df) for n, df in new.items()})
