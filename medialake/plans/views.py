"""The given tables bound to the shapes of a media catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import kind_by_extension


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inv_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = F.array(*[F.lit(e) for e in (".mp3", ".FLAC", ".mkv", ".jpeg", ".pdf", ".txt", ".srt", ".xyz")])
    path = F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.get(endings, (F.col("doc_id") % 8).cast("int")))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "lang", path.alias("path"), kind_by_extension(path).alias("kind"), F.col("n_chars").alias("size_bytes"), (1704067200 + F.col("doc_id") * 60).alias("modified_s"), "text")


def inv_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv_base(spark, sf_dir).where("doc_id % 10 <> 0")


def inv_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.col("doc_id") % 10
    return inv_base(spark, sf_dir).where("doc_id % 10 <> 1").withColumns({
        "path": F.when(rest == 2, F.replace("path", F.lit("/lib/"), F.lit("/lib/moved/"))).otherwise(F.col("path")),
        "size_bytes": F.col("size_bytes") + (rest == 3).cast("long"),
        "modified_s": F.col("modified_s") + F.when(rest == 4, 3600).otherwise(0),
        "text": F.when(rest == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
    })


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an earlier scan left: some rows never read, some marked missing."""
    old = inv_old(spark, sf_dir)
    return old.select(F.col("doc_id").alias("file_id"), "path", "kind", "size_bytes", "modified_s", F.expr("CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1704067200 END").alias("scanned_s"), F.expr("CASE WHEN doc_id % 23 = 0 THEN 1704070000 END").alias("missing_s"))


def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = inv_old(spark, sf_dir).where("doc_id % 19 <> 0")
    return old.select(F.col("doc_id").alias("file_id"), F.expr("CASE WHEN doc_id % 7 = 0 THEN 'sha256' ELSE 'sampledSha256' END").alias("kind"), F.sha2("text", 256).alias("value"))


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = inv_old(spark, sf_dir).where("doc_id % 29 = 0")
    return old.select("path", "size_bytes", F.expr("modified_s * 1000 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END").alias("modified_ms"), F.expr("CASE WHEN doc_id % 2 = 0 THEN 'discover' ELSE 'metadata' END").alias("stage"))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part, supplier = (table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    rows = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)
    return rows.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name AS title", "CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE s_name END AS artist", "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE p_brand END AS album",
        "CASE WHEN l_partkey % 5 = 0 THEN s_name END AS album_artist", "l_linenumber AS track_number", "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE 1 + l_suppkey % 2 END AS disc_number",
        "CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE CAST(l_quantity AS BIGINT) * 7000 END AS duration_ms", "CASE WHEN l_partkey % 17 = 0 THEN NULL ELSE CAST(YEAR(l_shipdate) AS BIGINT) END AS year", "p_type AS genre", "l_returnflag = 'R' AS missing",
    )


#: The order of a shelf: unique in `tracks`.
SHELF = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS play_id", "user_id AS item_id", "ts AS started_at", "event_type = 'purchase' AS completed")


def progress_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr("event_id", "user_id AS item_id", "CAST(FLOOR(value * 1000) AS BIGINT) AS position_ms", "ts AS updated_at")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id AS collection_id", "turn AS position", "concat(role, ':', CAST(turn % 3 AS STRING)) AS item_id")


def item_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return labels.selectExpr("doc_id AS item_id", "stack(2, 'quality', CAST(quality AS STRING), 'toxic', CAST(toxic AS STRING)) AS (namespace, name)")


def filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", """CASE p_partkey % 6
        WHEN 0 THEN concat('/tv/', p_brand, '/Season 1/', replace(p_name, ' ', '.'), '.S01E', lpad(CAST(p_size AS STRING), 2, '0'), '.mkv')
        WHEN 1 THEN concat('/tv/', p_brand, '/Season 2/S02E', lpad(CAST(p_size AS STRING), 2, '0'), ' ', p_name, '.mkv')
        WHEN 2 THEN concat('/tv/x/', p_name, ' 3x', lpad(CAST(p_size AS STRING), 2, '0'), '.avi')
        WHEN 3 THEN concat('/films/', p_name, ' (', CAST(1950 + p_size AS STRING), ').mp4')
        WHEN 4 THEN concat('/films/', p_name, ' (', CAST(1950 + p_size AS STRING), ')/movie.mp4')
        ELSE concat('/films/', p_name, ' 1920x1080.mp4') END AS path""")  # fmt: skip


def raw_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's columns as tags, in four dialects' spellings."""
    spelled = {"title": ("title", "TIT2", "©nam", "INAM"), "band": ("Album Artist", "TPE2", "aART", "IART"), "genre": ("GENRE", "TCON", "©gen", "IGNR"), "track": ("TRACKNUMBER", "TRCK", "tmpo", "ITRK"), "price": ("custom_price", "TXXX:price", "----:mean:price", "IPRC"), "again": ("TITLE", "TPE1", "©ART", "INAM")}
    values = {"title": F.col("p_name"), "band": F.col("p_brand"), "genre": F.col("p_type"), "track": F.concat(F.col("p_size").cast("string"), F.lit("/50")), "price": (F.col("p_size") * 3).cast("string"), "again": F.concat(F.lit(" second "), "p_name")}
    at = (F.col("p_partkey") % 4).cast("int")
    one = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), at)
    tags = F.array(*[F.struct(F.lit(i).alias("seq"), one(spelled[k]).alias("key"), values[k].alias("value")) for i, k in enumerate(spelled)])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), one(("vorbis", "id3v2", "ilst", "riff")).alias("dialect"), F.explode(tags).alias("t"))
    return rows.select("file_id", "dialect", "t.seq", "t.key", "t.value")
