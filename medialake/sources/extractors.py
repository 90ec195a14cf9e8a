"""What reads files' own metadata is pluggable: functions over batches of paths, each a tier."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..functions.paths import extension_of

Extract = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Extractor:
    name: str
    kinds: tuple[str, ...]
    extensions: tuple[str, ...]
    run: Extract
    tier: int


class Extractors:
    """A registry; lower tiers speak first."""

    def __init__(self) -> None:
        self.known: list[Extractor] = []

    def register(self, name: str, kinds: tuple[str, ...], extensions: tuple[str, ...], run: Extract, tier: int) -> None:
        self.known.append(Extractor(name, kinds, extensions, run, tier))

    def tiers(self, files: DataFrame, schema: str) -> DataFrame:
        """file_id, tier and the schema's columns, of every extractor that handles a file(file_id, path, kind); no rows where none is registered.

        A batch on which an extractor raises is given to it again file by file; a file on which it still raises gets nothing from this tier.
        """
        key = files.schema["file_id"].dataType.simpleString()
        found = files.sparkSession.createDataFrame([], f"file_id {key}, {schema}, tier int")
        for e in sorted(self.known, key=lambda e: e.tier):
            mine = files.where(F.col("kind").isin(*e.kinds))
            if e.extensions:
                mine = mine.where(extension_of(F.col("path")).isin(*e.extensions))
            rows = mine.select("file_id", "path", "kind").mapInPandas(forgiving(e.run), f"file_id {key}, {schema}").withColumn("tier", F.lit(e.tier))
            found = found.unionByName(rows)
        return found


    def register_sql(self, spark: SparkSession, schema: str, prefix: str = "extract_") -> list[str]:
        """Registers a table function for each extractor, and gives their names: `SELECT * FROM extract_<name>(TABLE(files))`, or, file by file, `FROM files f, LATERAL extract_<name>(f.file_id, f.path, f.kind)`.

        The table must have file_id, path and kind, may have more, and may be partitioned; an extractor then gets files in batches. Rows: file_id, the schema's columns, tier, and error for a file on which the extractor raised, whose
        other columns are null. Files that the extractor doesn't handle give no rows.
        """
        names = []
        for e in self.known:
            names.append(prefix + e.name)
            spark.udtf.register(names[-1], udtf(table_function(e, schema)))
        return names


def table_function(extractor: Extractor, schema: str, size: int = 256) -> type:
    """The class of a table function that runs the extractor on batches of the rows that it is given."""
    fields = StructType.fromDDL(schema).fields
    columns = [f.name for f in fields]

    class Rows:
        def __init__(self) -> None:
            self.held: list[tuple] = []

        @staticmethod
        def analyze(*files: AnalyzeArgument) -> AnalyzeResult:
            if len(files) == 1 and files[0].isTable and {"file_id", "path", "kind"} <= {f.name for f in files[0].dataType.fields}:
                key = files[0].dataType["file_id"].dataType
            elif len(files) == 3:
                key = files[0].dataType
            else:
                raise ValueError("a table with file_id, path and kind, or these three, are needed")
            out = StructType([StructField("file_id", key), *fields, StructField("tier", IntegerType()), StructField("error", StringType())])
            return AnalyzeResult(out)

        def eval(self, *files: Row) -> Iterator[tuple]:
            key, path, kind = files if len(files) == 3 else (files[0].file_id, files[0].path, files[0].kind)
            ending = path.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if path else ""
            if kind in extractor.kinds and (not extractor.extensions or ending in extractor.extensions):
                self.held.append((key, path, kind))
            if len(self.held) == size:
                yield from self.given()

        def terminate(self) -> Iterator[tuple]:
            yield from self.given()

        def given(self) -> Iterator[tuple]:
            rows, self.held = self.held, []
            frame = lambda part: pd.DataFrame(part, columns=["file_id", "path", "kind"])
            plain = lambda x: None if x is None or (isinstance(x, float) and x != x) else x.item() if hasattr(x, "item") else x
            told = lambda part: [tuple(plain(x) for x in r) for df in extractor.run(iter([frame(part)])) for r in df[["file_id", *columns]].astype(object).itertuples(index=False)]
            try:
                done = [(*r, extractor.tier, None) for r in told(rows)] if rows else []
            except Exception:  # one bad file must not stop the rest
                done = []
                for row in rows:
                    try:
                        done += [(*r, extractor.tier, None) for r in told([row])]
                    except Exception as e:  # this is the one
                        done.append((row[0], *[None] * len(columns), extractor.tier, f"{type(e).__name__}: {e}"))
            yield from done

    return Rows


def forgiving(run: Extract) -> Extract:
    """run, whose failure on one file costs no other its rows."""

    def safe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            try:
                done = list(run(iter([df])))
            except Exception:  # one bad file must not stop the rest
                done = []
                for i in range(len(df)):
                    try:
                        done += list(run(iter([df.iloc[i : i + 1]])))
                    except Exception:  # this is the one
                        continue
            yield from done

    return safe


def render_thumbnails(pictures: DataFrame, render: Callable[[bytes, int], bytes | None], longest: int = 256) -> DataFrame:
    """pictures(file_id, data) -> file_id, seq, role, mime, data of the thumbnails that `render` makes; what it can't decode, or fails on, gives no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            made = []
            for file, data in zip(df.file_id, df.data):
                try:
                    small = render(bytes(data), longest)
                except Exception:  # one bad picture must not stop the rest
                    small = None
                if small is not None:
                    made.append((file, small))
            yield pd.DataFrame(made, columns=["file_id", "data"])

    key = pictures.schema["file_id"].dataType.simpleString()
    rows = pictures.select("file_id", "data").mapInPandas(run, f"file_id {key}, data binary")
    return rows.select("file_id", F.lit(0).cast("long").alias("seq"), F.lit("thumbnail").alias("role"), F.lit("image/jpeg").alias("mime"), "data")
