"""Three scans in a row, of two libraries, with all that each leaves behind."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import full_scan
from ..sources.scratch import Kept
from . import views as v
from .registry import query

#: The first scan finds an empty catalog. Until the second, files come, go, move, grow and are touched, and some can't be hashed or read. Until the third, what went comes back, some of it
#: changed, and the paths that moved files left are used again.
RUNS = (1, 2, 3)


def inventory(spark: SparkSession, sf: str, run: int) -> DataFrame:
    """The files at a run: documents, and lyrics beside a third of the audio files."""
    rest = F.col("doc_id") % 10
    rows = v.inv_base(spark, sf)
    if run == 1:
        rows = rows.where(rest != 0)
    else:
        back = (rest == 1) & (F.col("doc_id") % 20 == 11)
        rows = (rows.where(rest != 1) if run == 2 else rows).withColumns({
            "path": F.when(rest == 2, F.replace("path", F.lit("/lib/"), F.lit("/lib/moved/"))).otherwise(F.col("path")),
            "size_bytes": F.col("size_bytes") + F.when((rest == 3) | back, 1).otherwise(0), "modified_s": F.col("modified_s") + F.when(rest == 4, 3600).otherwise(0), "text": F.when((rest == 3) | back, F.concat("text", F.lit("!"))).otherwise(F.col("text")),
        })
    if run == 3:
        again = v.inv_base(spark, sf).where(rest == 2).withColumns({"size_bytes": F.col("size_bytes") + 4, "modified_s": F.col("modified_s") + 7200, "text": F.concat(F.lit("new "), "text")})
        rows = rows.unionByName(again)
    media = rows.select("doc_id", "path", "kind", "size_bytes", "modified_s", "text")
    sides = media.where("kind = 'audio' AND doc_id % 3 = 0" + (" AND doc_id % 4 <> 0" if run == 3 else ""))
    none = F.lit(None).cast("string")
    return media.unionByName(sides.select("doc_id", F.regexp_replace("path", r"\.[^./]*$", ".lrc").alias("path"), none.alias("kind"), F.lit(1).cast("long").alias("size_bytes"), (F.col("modified_s") + F.when(F.col("doc_id") % 5 == run, 60).otherwise(0)).alias("modified_s"), none.alias("text")))


def inventory_sql(run: int) -> str:
    back = "doc_id % 20 = 11"
    if run == 1:
        rows = "SELECT doc_id, path, kind, size_bytes, modified_s, text FROM inv_base WHERE doc_id % 10 <> 0"
    else:
        rows = f"""SELECT doc_id, CASE WHEN doc_id % 10 = 2 THEN replace(path, '/lib/', '/lib/moved/') ELSE path END AS path, kind, size_bytes + CASE WHEN doc_id % 10 = 3 OR {back} THEN 1 ELSE 0 END AS size_bytes,
  modified_s + CASE WHEN doc_id % 10 = 4 THEN 3600 ELSE 0 END AS modified_s, CASE WHEN doc_id % 10 = 3 OR {back} THEN text || '!' ELSE text END AS text FROM inv_base{" WHERE doc_id % 10 <> 1" if run == 2 else ""}"""
    if run == 3:
        rows += " UNION ALL SELECT doc_id, path, kind, size_bytes + 4, modified_s + 7200, 'new ' || text FROM inv_base WHERE doc_id % 10 = 2"
    return f"""media{run} AS ({rows}),
inv{run} AS (SELECT * FROM media{run} UNION ALL SELECT doc_id, regexp_replace(path, '\\.[^./]*$', '.lrc'), NULL, 1, modified_s + CASE WHEN doc_id % 5 = {run} THEN 60 ELSE 0 END, NULL FROM media{run} WHERE kind = 'audio' AND doc_id % 3 = 0{" AND doc_id % 4 <> 0" if run == 3 else ""})"""


def hooks(run: int) -> full_scan.Hooks:
    """At the second run some files can't be hashed, others say nothing of themselves."""
    value = F.sha2("text", 256)
    if run == 2:
        value = F.when(F.col("doc_id") % 20 != 3, value)
    title = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)

    def extract(files: DataFrame) -> DataFrame:
        good = files.where("doc_id % 30 <> 4") if run == 2 else files
        late = good.select("file_id", F.lit(2).alias("tier"), F.lit("late").alias("title"), F.col("size_bytes").cast("string").alias("bytes"))
        return good.select("file_id", F.lit(1).alias("tier"), title.alias("title"), F.lit(None).cast("string").alias("bytes")).unionByName(late)

    return full_scan.Hooks(hash_of=lambda read: read.select("library_id", "path", value.alias("value"), F.lit("unreadable").alias("error")), extract=extract)


def scan_sql(run: int) -> str:
    """One scan: from the state before (files, hashes, items, journal, sidecars with the run's number less one) to the state after."""
    k, b = run, run - 1
    fails = "doc_id % 20 = 3" if run == 2 else "false"
    mute = "doc_id % 30 = 4" if run == 2 else "false"
    return f"""{inventory_sql(run)},
l{k} AS (SELECT l AS lib, i.*, kind IS NOT NULL AND (kind <> 'image' OR l = 2) AS is_item FROM inv{k} i, (VALUES (1), (2)) x(l) WHERE l = 1 OR starts_with(path, '/lib/src0/')),
m{k} AS (SELECT * FROM l{k} WHERE is_item),
d{k} AS (SELECT coalesce(m.lib, f.lib) AS lib, coalesce(m.path, f.path) AS path, f.file_id, p.stage AS waiting, CASE WHEN m.path IS NULL THEN 'missing' WHEN f.path IS NULL THEN 'new'
    WHEN f.scanned IS NOT NULL AND h.file_id IS NOT NULL AND m.size_bytes = f.size_bytes AND m.modified_s = f.modified_s AND (p.path IS NULL OR (p.size_bytes = m.size_bytes AND p.modified_ms = m.modified_s * 1000)) THEN 'unchanged' ELSE 'changed' END AS status
  FROM m{k} m FULL JOIN f{b} f ON m.lib = f.lib AND m.path = f.path LEFT JOIN h{b} h ON h.file_id = f.file_id LEFT JOIN p{b} p ON p.lib = coalesce(m.lib, f.lib) AND p.path = coalesce(m.path, f.path)),
j{k} AS (SELECT * FROM d{k} WHERE status IN ('new', 'changed') OR (status = 'unchanged' AND waiting = 'discover')),
v{k} AS (SELECT j.lib, j.path, j.status, j.file_id, m.doc_id, m.kind, m.size_bytes, m.modified_s, CASE WHEN NOT ({fails}) THEN sha256(m.text) END AS value FROM j{k} j JOIN m{k} m ON j.lib = m.lib AND j.path = m.path),
gone{k} AS (SELECT d.lib, h.value, max(d.file_id) AS file_id, arg_max(d.path, d.file_id) AS old_path FROM d{k} d JOIN h{b} h ON h.file_id = d.file_id WHERE d.status = 'missing' AND NOT EXISTS (SELECT 1 FROM l{k} l WHERE l.lib = d.lib AND l.path = d.path) GROUP BY 1, 2),
mv{k} AS (SELECT n.lib, n.path, g.file_id, g.old_path FROM (SELECT lib, value, min(path) AS path FROM v{k} WHERE status = 'new' AND value IS NOT NULL GROUP BY 1, 2) n JOIN gone{k} g ON g.lib = n.lib AND g.value = n.value),
a{k} AS (SELECT v.lib, v.path, row_number() OVER (ORDER BY v.lib, v.path) + (SELECT coalesce(max(file_id), 0) FROM f{b}) AS file_id FROM v{k} v LEFT JOIN mv{k} m ON m.lib = v.lib AND m.path = v.path WHERE v.status = 'new' AND v.value IS NOT NULL AND m.path IS NULL),
t{k} AS (SELECT v.* REPLACE (coalesce(m.file_id, a.file_id, v.file_id) AS file_id), CASE WHEN m.path IS NOT NULL THEN 'moved' WHEN v.status = 'new' THEN 'added' ELSE 'updated' END AS way
  FROM v{k} v LEFT JOIN mv{k} m ON m.lib = v.lib AND m.path = v.path LEFT JOIN a{k} a ON a.lib = v.lib AND a.path = v.path WHERE v.value IS NOT NULL),
w{k} AS (SELECT lib, path, file_id FROM t{k} UNION ALL SELECT lib, path, file_id FROM d{k} WHERE status = 'unchanged' AND waiting = 'metadata'),
e{k} AS (SELECT w.*, regexp_extract(w.path, '([^/]*)\\.[^./]*$', 1) AS title, CAST(m.size_bytes AS VARCHAR) AS bytes FROM w{k} w JOIN m{k} m ON m.lib = w.lib AND m.path = w.path WHERE NOT ({mute})),
f{k} AS (SELECT x.lib, x.file_id, x.path, x.kind, x.size_bytes, x.modified_s, x.scanned, x.missing, coalesce(e.title, x.title) AS title, coalesce(e.bytes, x.bytes) AS bytes FROM (
    SELECT f.lib, f.file_id, coalesce(t.path, f.path) AS path, coalesce(t.kind, f.kind) AS kind, coalesce(t.size_bytes, f.size_bytes) AS size_bytes, coalesce(t.modified_s, f.modified_s) AS modified_s, CASE WHEN t.path IS NULL THEN f.scanned ELSE {1800000000 + k} END AS scanned,
      CASE WHEN t.path IS NOT NULL OR d.status IN ('changed', 'unchanged') THEN NULL WHEN d.status = 'missing' THEN coalesce(f.missing, {1800000000 + k}) ELSE f.missing END AS missing, f.title, f.bytes
    FROM f{b} f LEFT JOIN t{k} t ON t.file_id = f.file_id LEFT JOIN d{k} d ON d.file_id = f.file_id
    UNION ALL SELECT lib, file_id, path, kind, size_bytes, modified_s, {1800000000 + k}, NULL, NULL, NULL FROM t{k} WHERE way = 'added') x LEFT JOIN e{k} e ON e.file_id = x.file_id),
h{k} AS (SELECT * FROM h{b} WHERE file_id NOT IN (SELECT file_id FROM t{k}) UNION ALL SELECT file_id, 'sampledSha256', value FROM t{k}),
present{k} AS (SELECT lib, path, file_id, kind FROM t{k} UNION ALL SELECT d.lib, d.path, d.file_id, m.kind FROM d{k} d JOIN m{k} m ON m.lib = d.lib AND m.path = d.path WHERE d.status = 'unchanged' AND d.file_id NOT IN (SELECT file_id FROM t{k})),
i{k} AS (SELECT file_id FROM present{k} WHERE file_id NOT IN (SELECT file_id FROM item{b})),
item{k} AS (SELECT * FROM item{b} UNION ALL SELECT * FROM i{k}),
p{k} AS (SELECT p.* FROM p{b} p JOIN m{k} m ON m.lib = p.lib AND m.path = p.path LEFT JOIN j{k} j ON j.lib = p.lib AND j.path = p.path LEFT JOIN e{k} e ON e.lib = p.lib AND e.path = p.path WHERE j.path IS NULL AND e.path IS NULL
  UNION ALL SELECT v.lib, v.path, v.size_bytes, v.modified_s * 1000, CASE WHEN v.value IS NULL THEN 'discover' ELSE 'metadata' END, t.file_id FROM v{k} v LEFT JOIN t{k} t ON t.lib = v.lib AND t.path = v.path LEFT JOIN e{k} e ON e.lib = v.lib AND e.path = v.path WHERE e.path IS NULL),
c{k} AS (SELECT m.lib, m.path AS media_path, s.path AS side, s.modified_s FROM l{k} s JOIN m{k} m ON m.lib = s.lib AND regexp_replace(m.path, '\\.[^./]*$', '.lrc') = s.path WHERE s.path LIKE '%.lrc'),
known{k} AS (SELECT DISTINCT s.lib, s.side, s.modified_s FROM s{b} s JOIN present{k} p ON p.file_id = s.file_id),
dirty{k} AS (SELECT lib, regexp_replace(path, '/[^/]*$', '') AS dir FROM j{k} UNION SELECT lib, regexp_replace(side, '/[^/]*$', '') FROM c{k} c WHERE NOT EXISTS (SELECT 1 FROM known{k} n WHERE n.lib = c.lib AND n.side = c.side AND n.modified_s = c.modified_s)
  UNION SELECT lib, regexp_replace(side, '/[^/]*$', '') FROM known{k} n WHERE NOT EXISTS (SELECT 1 FROM c{k} c WHERE n.lib = c.lib AND n.side = c.side)),
anew{k} AS (SELECT p.lib, p.path, p.file_id FROM present{k} p JOIN dirty{k} d ON d.lib = p.lib AND d.dir = regexp_replace(p.path, '/[^/]*$', '')),
put{k} AS (SELECT a.lib, a.file_id, c.side, c.modified_s FROM anew{k} a JOIN c{k} c ON c.lib = a.lib AND c.media_path = a.path),
s{k} AS (SELECT * FROM s{b} WHERE file_id NOT IN (SELECT file_id FROM anew{k}) UNION ALL SELECT * FROM put{k}),
ev{k} AS (SELECT lib, 'scan-phase-changed' AS type, NULL AS path, NULL AS file_id, phase, '-' AS fields FROM (VALUES (1), (2)) l(lib), (VALUES ('scan'), ('discover'), ('metadata'), ('finish')) p(phase)
  UNION ALL SELECT lib, 'scan-work-queued', NULL, NULL, 'scan', 'discover=' || (SELECT count(*) FROM j{k} j WHERE j.lib = l.lib) || ',metadata=' || (SELECT count(*) FROM d{k} d WHERE d.lib = l.lib AND status = 'unchanged' AND waiting = 'metadata') FROM (VALUES (1), (2)) l(lib)
  UNION ALL SELECT lib, CASE WHEN file_id IN (SELECT file_id FROM i{k}) THEN 'item-added' ELSE 'item-updated' END, path, file_id, 'discover', '-' FROM t{k}
  UNION ALL SELECT lib, 'enriched', path, file_id, 'metadata', '-' FROM e{k}
  UNION ALL SELECT d.lib, 'item-missing', d.path, d.file_id, 'finish', '-' FROM d{k} d LEFT JOIN mv{k} m ON m.lib = d.lib AND m.old_path = d.path WHERE status = 'missing' AND m.path IS NULL
  UNION ALL SELECT lib, 'item-added', path, file_id, 'finish', '-' FROM present{k} WHERE file_id IN (SELECT file_id FROM i{k}) AND file_id NOT IN (SELECT file_id FROM t{k})
  UNION ALL SELECT e.lib, 'field-update', e.path, e.file_id, 'metadata', concat_ws(',', CASE WHEN f.bytes IS DISTINCT FROM e.bytes THEN 'bytes=' || e.bytes END, CASE WHEN f.title IS DISTINCT FROM e.title THEN 'title=' || e.title END)
    FROM e{k} e JOIN f{b} f ON f.file_id = e.file_id WHERE f.bytes IS DISTINCT FROM e.bytes OR f.title IS DISTINCT FROM e.title),
err{k} AS (SELECT lib, path, 'unreadable' AS error FROM v{k} WHERE value IS NULL UNION ALL SELECT w.lib, w.path, 'no metadata' FROM w{k} w LEFT JOIN e{k} e ON e.lib = w.lib AND e.path = w.path WHERE e.path IS NULL),
n{k} AS (SELECT l.lib, concat_ws(' ', (SELECT count(*) FROM d{k} x WHERE x.lib = l.lib AND status <> 'missing'), (SELECT count(*) FROM t{k} x WHERE x.lib = l.lib), (SELECT count(*) FROM e{k} x WHERE x.lib = l.lib), (SELECT count(*) FROM t{k} x WHERE x.lib = l.lib AND way = 'added'),
    (SELECT count(*) FROM t{k} x WHERE x.lib = l.lib AND way = 'updated'), (SELECT count(*) FROM t{k} x WHERE x.lib = l.lib AND way = 'moved'), (SELECT count(*) FROM d{k} x WHERE x.lib = l.lib AND status = 'missing') - (SELECT count(*) FROM mv{k} x WHERE x.lib = l.lib),
    (SELECT count(*) FROM d{k} x WHERE x.lib = l.lib AND status = 'unchanged'), (SELECT count(*) FROM put{k} x WHERE x.lib = l.lib), 0, (SELECT count(*) FROM l{k} x WHERE x.lib = l.lib AND NOT is_item AND NOT EXISTS (SELECT 1 FROM c{k} c WHERE c.lib = x.lib AND c.side = x.path)),
    (SELECT count(*) FROM err{k} x WHERE x.lib = l.lib)) AS said FROM (VALUES (1), (2)) l(lib)),
out{k} AS (SELECT {k} AS run, 'file' AS what, lib AS library_id, path, concat_ws(' ', file_id, kind, size_bytes, modified_s, coalesce(CAST(scanned AS VARCHAR), '-'), coalesce(CAST(missing AS VARCHAR), '-'), coalesce('{{"title":"' || title || '","bytes":"' || bytes || '"}}', '-')) AS said FROM f{k}
  UNION ALL SELECT {k}, 'hash', NULL, NULL, concat_ws(' ', file_id, kind, value) FROM h{k}
  UNION ALL SELECT {k}, 'item', NULL, NULL, CAST(file_id AS VARCHAR) FROM item{k}
  UNION ALL SELECT {k}, 'tag', NULL, NULL, concat_ws(' ', p.file_id, x.ns, CASE x.ns WHEN 'kind' THEN p.kind ELSE CASE lower(regexp_extract(p.path, '\\.([^./]*)$', 1)) WHEN 'jpeg' THEN 'jpg' ELSE lower(regexp_extract(p.path, '\\.([^./]*)$', 1)) END END) FROM present{k} p, (VALUES ('kind'), ('format')) x(ns) WHERE p.file_id IN (SELECT file_id FROM i{k})
  UNION ALL SELECT {k}, 'journal', lib, path, concat_ws(' ', size_bytes, modified_ms, stage, coalesce(CAST(file_id AS VARCHAR), '-')) FROM p{k}
  UNION ALL SELECT {k}, 'sidecar', lib, side, concat_ws(' ', file_id, 'lyrics', modified_s) FROM s{k}
  UNION ALL SELECT {k}, 'event', lib, path, concat_ws(' ', type, coalesce(CAST(file_id AS VARCHAR), '-'), phase, fields) FROM ev{k}
  UNION ALL SELECT {k}, 'error', lib, path, error FROM err{k}
  UNION ALL SELECT {k}, 'tally', lib, NULL, said FROM n{k})"""


BEFORE = """f0 AS (SELECT 0 AS lib, CAST(0 AS BIGINT) AS file_id, '' AS path, '' AS kind, CAST(0 AS BIGINT) AS size_bytes, CAST(0 AS BIGINT) AS modified_s, CAST(0 AS BIGINT) AS scanned, CAST(0 AS BIGINT) AS missing, '' AS title, '' AS bytes WHERE false),
h0 AS (SELECT CAST(0 AS BIGINT) AS file_id, '' AS kind, '' AS value WHERE false), item0 AS (SELECT CAST(0 AS BIGINT) AS file_id WHERE false),
p0 AS (SELECT 0 AS lib, '' AS path, CAST(0 AS BIGINT) AS size_bytes, CAST(0 AS BIGINT) AS modified_ms, '' AS stage, CAST(0 AS BIGINT) AS file_id WHERE false), s0 AS (SELECT 0 AS lib, CAST(0 AS BIGINT) AS file_id, '' AS side, CAST(0 AS BIGINT) AS modified_s WHERE false)"""


def left_behind(run: int, got: full_scan.Scanned) -> DataFrame:
    """All results of a scan as rows of one shape."""
    text = lambda *cs: F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cs])
    none = lambda t: F.lit(None).cast(t)
    row = lambda rows, what, said, lib=None, path=None: rows.select(F.lit(run).alias("run"), F.lit(what).alias("what"), (none("int") if lib is None else F.col(lib).cast("int")).alias("library_id"), (none("string") if path is None else F.col(path)).alias("path"), said.alias("said"))
    fields = F.array_join(F.array_sort(F.transform(F.map_entries("fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    events = got.events.withColumn("fields", F.coalesce(fields, F.lit("-")))
    parts = [
        row(got.files, "file", text("file_id", "kind", "size_bytes", "modified_s", "scanned_s", "missing_s", "metadata"), "library_id", "path"), row(got.hashes, "hash", text("file_id", "kind", "value")), row(got.items, "item", text("file_id")),
        row(got.tags, "tag", text("item_id", "namespace", "name")), row(got.pending, "journal", text("size_bytes", "modified_ms", "stage", "file_id"), "library_id", "path"), row(got.sidecars, "sidecar", text("file_id", "kind", "modified_s"), "library_id", "sidecar_path"),
        row(events, "event", text("type", "file_id", "phase", "fields"), "library_id", "path"), row(got.errors, "error", F.col("error"), "library_id", "path"), row(got.tally, "tally", text(*full_scan.COUNTS), "library_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("sc22_three_scans", f""", {BEFORE}, {", ".join(scan_sql(k) for k in RUNS)} SELECT * FROM out1 UNION ALL SELECT * FROM out2 UNION ALL SELECT * FROM out3""", "inv_base")
def three_scans(spark, sf):
    """What three scans leave, each from what the one before left: files, hashes, items, tags, journal, sidecars, events, errors and tallies of a library of all kinds but pictures, and of one of pictures and the rest below one folder."""
    docs = v.table(spark, sf, "documents")
    roots = docs.select(F.lit(1).alias("library_id"), F.lit("/lib").alias("root")).union(docs.select(F.lit(2), F.lit("/lib/src0"))).distinct()
    libraries = roots.select("library_id", F.when(F.col("library_id") == 2, "images").otherwise("music").alias("type"))
    empty = lambda schema: spark.createDataFrame([], schema)
    files = empty("library_id int, file_id long, path string, kind string, size_bytes long, modified_s long, scanned_s long, missing_s long, metadata string")
    hashes, items = empty("file_id long, kind string, value string"), empty("file_id long")
    pending = empty("library_id int, path string, size_bytes long, modified_ms long, stage string, file_id long")
    sidecars = empty("library_id int, file_id long, sidecar_path string, kind string, modified_s long")
    kept, out = Kept(spark, "scans"), []
    for run in RUNS:
        got = full_scan.scan(inventory(spark, sf, run), roots, files, hashes, items, pending, F.lit(1800000000 + run).cast("long"), hooks(run), libraries=libraries, sidecars=sidecars)
        out.append(kept.save(left_behind(run, got), f"run-{run}"))
        if run < RUNS[-1]:
            files, hashes, items, pending, sidecars = (kept.save(x, n) for x, n in ((got.files, "files"), (got.hashes, "hashes"), (got.items, "items"), (got.pending, "pending"), (got.sidecars, "sidecars")))
        got.tables.remove()
    return reduce(DataFrame.unionByName, out)
