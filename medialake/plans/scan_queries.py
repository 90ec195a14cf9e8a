"""Queries of scans, identity and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify, paths
from ..operators import full_scan, identity, pacing, scan
from . import views as v
from .registry import query

MEDIA = "kind IS NOT NULL AND kind <> 'image'"


def diffed(spark: SparkSession, sf: str) -> DataFrame:
    return scan.diff(v.known(spark, sf).where(MEDIA), v.inv_new(spark, sf).where(MEDIA), v.hashes(spark, sf), v.pending(spark, sf))


def roots_of(spark: SparkSession, sf: str) -> DataFrame:
    """Each source is a root of library 1, each language folder below src0 one of library 2, so roots are nested."""
    docs = v.table(spark, sf, "documents")
    return docs.select(F.lit(1).alias("library_id"), F.concat(F.lit("/lib/"), "source").alias("root")).union(docs.where("source = 'src0'").select(F.lit(2), F.concat(F.lit("/lib/src0/"), "lang"))).union(docs.select(F.lit(1), F.concat(F.lit("/lib/"), "source", F.lit("/"), "lang"))).distinct()


ROOTS = """roots AS (SELECT DISTINCT * FROM (SELECT 1 AS library_id, CONCAT('/lib/', source) AS root FROM documents UNION ALL SELECT 2, CONCAT('/lib/src0/', lang) FROM documents WHERE source = 'src0' UNION ALL SELECT 1, CONCAT('/lib/', source, '/', lang) FROM documents))"""


@query("cl01_extension", "SELECT doc_id, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext, CASE lower(regexp_extract(path, '\\.([^./]*)$', 1)) WHEN 'jpeg' THEN 'jpg' ELSE lower(regexp_extract(path, '\\.([^./]*)$', 1)) END AS format FROM inv_base", "inv_base")
def extension(spark, sf):
    return v.inv_base(spark, sf).select("doc_id", paths.extension_of(F.col("path")).alias("ext"), classify.format_tag(F.col("path")).alias("format"))


@query("cl03_classify", "SELECT kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM inv_base GROUP BY kind", "inv_base")
def classified(spark, sf):
    return v.inv_base(spark, sf).groupBy(classify.classify(F.col("path")).alias("kind")).agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query("cl04_classify_header", """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' WHEN 2 THEN 'document' WHEN 3 THEN CASE WHEN kind = 'audio' THEN 'audio' ELSE 'video' END ELSE kind END AS kind FROM inv_base""", "inv_base")
def classified_by_header(spark, sf):
    heads = ("494433040000000000000000", "89504E470D0A1A0A00000000", "255044462D312E3700000000", "1A45DFA39F4286810142F7810142F2810442F381084282886D6174726F736B61")
    header = F.when(F.col("doc_id") % 5 < 4, F.unhex(F.get(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 5).cast("int"))))
    return v.inv_base(spark, sf).select("doc_id", classify.classify(F.col("path"), header).alias("kind"))


@query("cl06_brands", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'audio' WHEN 1 THEN 'image' ELSE CASE WHEN kind = 'audio' THEN 'audio' ELSE 'video' END END AS kind FROM inv_base""", "inv_base")
def brands(spark, sf):
    brand = F.get(F.array(*[F.lit(b) for b in ("M4A ", "heic", "isom", "qt  ")]), (F.col("doc_id") % 4).cast("int"))
    header = F.concat(F.unhex(F.lit("00000020")), F.concat(F.lit("ftyp"), brand).cast("binary"), F.unhex(F.lit("00000000")))
    return v.inv_base(spark, sf).select("doc_id", classify.classify(F.col("path"), header).alias("kind"))


@query("cl07_path_parts", "SELECT doc_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS base, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS stem FROM inv_base", "inv_base")
def path_parts(spark, sf):
    return v.inv_base(spark, sf).select("doc_id", paths.dirname(F.col("path")).alias("dir"), paths.basename(F.col("path")).alias("base"), paths.stem(F.col("path")).alias("stem"))


@query("cl08_picture_mime", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' END AS mime FROM inv_base", "inv_base")
def picture_mimes(spark, sf):
    head = F.unhex(F.get(F.array(*[F.lit(h) for h in ("FFD8FFE0", "89504E470D0A", "474946383961", "00000000")]), (F.col("doc_id") % 4).cast("int")))
    return v.inv_base(spark, sf).select("doc_id", classify.picture_mime(head).alias("mime"))


@query("cl09_art_mime", "SELECT doc_id, CASE WHEN path LIKE '%.jpeg' THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime FROM inv_base", "inv_base")
def art_mimes(spark, sf):
    return v.inv_base(spark, sf).select("doc_id", classify.art_mime(F.col("path")).alias("mime"))


@query("cl10_valid_paths", "SELECT doc_id, doc_id % 3 = 0 AS ok FROM inv_base", "inv_base")
def valid_paths(spark, sf):
    odd = F.when(F.col("doc_id") % 3 == 1, F.replace("path", F.lit("/lib/"), F.lit("/lib/../"))).when(F.col("doc_id") % 3 == 2, F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    return v.inv_base(spark, sf).select("doc_id", paths.is_plain_absolute(odd).alias("ok"))


@query("src02_inventory_table", "SELECT lang, kind, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, max(modified_s) AS newest FROM inv_new GROUP BY lang, kind", "inv_new")
def inventory_table(spark, sf):
    return v.inv_new(spark, sf).groupBy("lang", "kind").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"), F.max("modified_s").alias("newest"))


@query("sc01_root_containment", f", {ROOTS} SELECT library_id, root, count(*) AS files FROM inv_base JOIN roots ON starts_with(path, root || '/') GROUP BY library_id, root", "inv_base")
def root_containment(spark, sf):
    return scan.under(v.inv_base(spark, sf).select("path"), roots_of(spark, sf)).groupBy("library_id", "root").agg(F.count("*").alias("files"))


@query("sc02_scope", f", {ROOTS} SELECT DISTINCT library_id, path FROM inv_base JOIN roots ON starts_with(path, root || '/')", "inv_base")
def scoped(spark, sf):
    return scan.scope(v.inv_base(spark, sf).select("path"), roots_of(spark, sf)).select("library_id", "path")


@query("sc03_item_or_other", "SELECT doc_id, CASE WHEN kind = 'image' AND source <> 'src0' THEN NULL ELSE kind END AS item_kind FROM inv_base", "inv_base")
def item_or_other(spark, sf):
    library = F.when(F.col("source") == "src0", "images").otherwise("music")
    return v.inv_base(spark, sf).select("doc_id", classify.item_kind(F.col("path"), library).alias("item_kind"))


@query("sc04_unsafe_scope", "SELECT file_id, path FROM known WHERE NOT (starts_with(path, '/lib/src1/') OR starts_with(path, '/lib/src2/en/'))", "known")
def unsafe_scope(spark, sf):
    unsafe = v.table(spark, sf, "documents").where("source IN ('src1', 'src2')").select(F.when(F.col("source") == "src1", "/lib/src1").otherwise("/lib/src2/en").alias("path")).distinct()
    return scan.safe_only(v.known(spark, sf).select("file_id", "path"), unsafe)


@query("sc05_only_dirs", "SELECT doc_id, path FROM inv_new WHERE regexp_replace(path, '/[^/]*$', '') IN (SELECT '/lib/' || source || '/en' FROM documents WHERE source IN ('src3', 'src4'))", "inv_new")
def only_dirs(spark, sf):
    docs = v.table(spark, sf, "documents").where("source IN ('src3', 'src4')")
    wanted = docs.select(F.explode(F.array(F.concat(F.lit("/lib/"), "source", F.lit("/en")), F.concat(F.lit("/lib/"), "source", F.lit("/.trash")))).alias("dir")).distinct()
    return scan.in_directories(v.inv_new(spark, sf).select("doc_id", "path"), scan.scan_targets(wanted, roots_of(spark, sf).select("root")))


@query("sc06_snapshot_diff", "SELECT path, file_id, status, pending_stage FROM diffed", "diffed")
def snapshot_diff(spark, sf):
    return diffed(spark, sf)


@query("sc07_identity_present", "SELECT kind, count(DISTINCT file_id) AS files FROM hashes WHERE kind IN ('sampledSha256', 'sha256') GROUP BY kind", "hashes")
def identity_present(spark, sf):
    return v.hashes(spark, sf).where(F.col("kind").isin(*scan.IDENTITIES)).groupBy("kind").agg(F.countDistinct("file_id").alias("files"))


@query("sc08_work", "SELECT path, CASE WHEN status IN ('new', 'changed') THEN 'discover' ELSE pending_stage END AS stage FROM diffed WHERE status IN ('new', 'changed') OR (status = 'unchanged' AND pending_stage IS NOT NULL)", "diffed")
def work(spark, sf):
    return scan.work_of(diffed(spark, sf))


@query("sc09_journal", "SELECT coalesce(n.path, p.path) AS path, CASE WHEN n.path IS NULL THEN p.stage ELSE 'discover' END AS stage FROM (SELECT path FROM diffed WHERE status IN ('new', 'changed')) n FULL OUTER JOIN pending p ON n.path = p.path", "diffed", "pending")
def journal(spark, sf):
    from ..operators.maintenance import upsert

    incoming = diffed(spark, sf).where("status IN ('new', 'changed')").select("path", F.lit("discover").alias("stage"))
    return upsert(v.pending(spark, sf).select("path", "stage"), incoming, ["path"])


@query("sc10_stale_work", "SELECT path FROM pending WHERE path NOT IN (SELECT path FROM inv_new) AND NOT starts_with(path, '/lib/src1/')", "pending", "inv_new")
def stale_work(spark, sf):
    unsafe = v.table(spark, sf, "documents").where("source = 'src1'").select(F.lit("/lib/src1").alias("path")).distinct()
    return scan.stale_work(v.pending(spark, sf), v.inv_new(spark, sf), unsafe).select("path")


@query("sc11_missing", """SELECT k.file_id, CASE WHEN d.status = 'missing' THEN coalesce(k.missing_s, 1800000000) WHEN d.status IS NULL THEN k.missing_s END AS missing_s FROM known k LEFT JOIN diffed d ON k.path = d.path""", "known", "diffed")
def missing(spark, sf):
    return scan.mark_missing(v.known(spark, sf), diffed(spark, sf), F.lit(1800000000)).select("file_id", "missing_s")


@query("sc13_nothing_deleted", "SELECT count(*) AS rows_before, count(*) AS rows_after FROM known", "known")
def nothing_deleted(spark, sf):
    known = v.known(spark, sf)
    marked = scan.mark_missing(known, diffed(spark, sf), F.lit(1800000000))
    return known.agg(F.count("*").alias("rows_before")).join(marked.agg(F.count("*").alias("rows_after")), F.lit(True))


@query("sc14_revalidate", "SELECT file_id, CASE WHEN starts_with(path, '/lib/src1/') OR starts_with(path, '/lib/src4/') THEN NULL ELSE scanned_s END AS scanned_s FROM known", "known")
def revalidated(spark, sf):
    roots = v.table(spark, sf, "documents").select("source").distinct().selectExpr("concat('/lib/', source) AS root", "CASE source WHEN 'src1' THEN 'b' ELSE 'a' END AS source_id", "CASE source WHEN 'src4' THEN NULL ELSE 'a' END AS last_source_id")
    return scan.revalidate(v.known(spark, sf), roots).select("file_id", "scanned_s")


@query("sc15_availability", "SELECT path, NOT (starts_with(path, '/lib/src1/') OR starts_with(path, '/lib/src2/en/')) AS available FROM inv_base", "inv_base")
def available(spark, sf):
    roots = roots_of(spark, sf).select("root").distinct().withColumn("available", ~F.col("root").isin("/lib/src1", "/lib/src2/en"))
    return scan.availability(v.inv_base(spark, sf), roots)


@query("sc16_membership", "SELECT file_id FROM diffed WHERE status = 'unchanged' AND file_id % 3 <> 0", "diffed")
def membership(spark, sf):
    return scan.lacking_items(diffed(spark, sf), v.known(spark, sf).where("file_id % 3 = 0"))


MOVES = """, gone AS (SELECT h.value, k.file_id, k.path FROM diffed d JOIN known k ON d.path = k.path JOIN hashes h ON h.file_id = k.file_id AND h.kind = 'sampledSha256' WHERE d.status = 'missing' AND k.path NOT IN (SELECT path FROM inv_new)),
fresh AS (SELECT i.path, sha256(i.text) AS value FROM diffed d JOIN inv_new i ON d.path = i.path WHERE d.status = 'new'),
moves AS (SELECT f.path, g.file_id, g.old_path FROM (SELECT value, min(path) AS path FROM fresh GROUP BY value) f JOIN (SELECT value, max(file_id) AS file_id, arg_max(path, file_id) AS old_path FROM gone GROUP BY value) g ON f.value = g.value)"""


def moved(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    inventory = v.inv_new(spark, sf)
    new = rows.where("status = 'new'").select("path").join(inventory.select("path", F.sha2("text", 256).alias("value")), "path")
    sampled = v.hashes(spark, sf).where("kind = 'sampledSha256'").select("file_id", "value")
    gone = rows.where("status = 'missing'").select("path", "file_id").join(sampled, "file_id")
    return scan.recognise_moves(new, gone, inventory.select("path"))


@query("mv01_moves", MOVES + " SELECT path, file_id, old_path FROM moves", "diffed", "known", "hashes", "inv_new")
def moves(spark, sf):
    return moved(spark, sf, diffed(spark, sf))


@query("mv02_copies", """SELECT min(path) AS first_path, count(*) AS files, sha256(text) AS value FROM inv_new GROUP BY sha256(text) HAVING count(*) > 1""", "inv_new")
def copies(spark, sf):
    rows = v.inv_new(spark, sf).select("path", F.sha2("text", 256).alias("value"))
    return identity.duplicates(rows, "value", "path").select(F.col("first_file").alias("first_path"), F.col("copies").alias("files"), "value")


@query("sc17_tally", MOVES + """ SELECT count(*) FILTER (status <> 'missing') AS seen, count(*) FILTER (status IN ('new', 'changed') OR status = 'unchanged' AND pending_stage = 'discover') AS discovered,
  count(*) FILTER (status = 'unchanged' AND pending_stage = 'metadata') AS enriched, count(*) FILTER (status = 'new' AND d.path NOT IN (SELECT path FROM moves)) AS added, count(*) FILTER (status = 'changed') AS updated,
  (SELECT count(*) FROM moves) AS moved, count(*) FILTER (status = 'missing' AND d.path NOT IN (SELECT old_path FROM moves)) AS missing, count(*) FILTER (status = 'unchanged') AS unchanged FROM diffed d""", "diffed", "known", "hashes", "inv_new")
def tallied(spark, sf):
    rows = diffed(spark, sf)
    return scan.tally(rows, moved(spark, sf, rows))


@query("sc17_beside", "SELECT source, count(*) FILTER (path LIKE '%.srt') AS sidecars, count(*) FILTER (kind = 'image') AS artwork, count(*) FILTER (kind IS NULL AND path NOT LIKE '%.srt') AS skipped, count(*) FILTER (size_bytes < 100) AS errors FROM inv_base GROUP BY source", "inv_base")
def beside(spark, sf):
    rows = v.inv_base(spark, sf)
    return scan.side_tally(rows, rows.where("size_bytes < 100"), ["source"])


@query("sc16_tags", """SELECT d.file_id AS item_id, t.namespace, CASE t.namespace WHEN 'kind' THEN k.kind ELSE lower(regexp_extract(k.path, '\\.([^./]*)$', 1)) END AS name FROM diffed d JOIN known k ON k.path = d.path, (VALUES ('kind'), ('format')) AS t(namespace) WHERE d.status = 'unchanged' AND d.file_id % 3 <> 0""", "diffed", "known")
def membership_tags(spark, sf):
    known = v.known(spark, sf)
    return scan.membership(diffed(spark, sf), known, known.where("file_id % 3 = 0"))[1]


#: Library 2 has the files below src0 too, each with an id of its own, and knew a half of them.
LIBRARIES = """, inv2 AS (SELECT 1 AS library_id, * FROM inv_new UNION ALL SELECT 2, * FROM inv_new WHERE starts_with(path, '/lib/src0/')),
known2 AS (SELECT 1 AS library_id, * FROM known UNION ALL SELECT 2, * REPLACE (file_id + 10000000 AS file_id) FROM known WHERE starts_with(path, '/lib/src0/') AND file_id % 2 = 0),
hash2 AS (SELECT file_id, kind, value FROM hashes UNION ALL SELECT file_id + 10000000, kind, value FROM hashes),
diff2 AS (SELECT coalesce(i.library_id, k.library_id) AS library_id, coalesce(i.path, k.path) AS path, k.file_id, k.missing_s, i.doc_id,
  CASE WHEN i.path IS NULL THEN 'missing' WHEN k.path IS NULL THEN 'new' WHEN k.scanned_s IS NOT NULL AND h.file_id IS NOT NULL AND i.size_bytes = k.size_bytes AND i.modified_s = k.modified_s
    AND (p.path IS NULL OR (p.size_bytes = i.size_bytes AND p.modified_ms = i.modified_s * 1000)) THEN 'unchanged' ELSE 'changed' END AS status
FROM (SELECT * FROM inv2 WHERE kind IS NOT NULL AND kind <> 'image') i FULL OUTER JOIN (SELECT * FROM known2 WHERE kind IS NOT NULL AND kind <> 'image') k ON i.path = k.path AND i.library_id = k.library_id
LEFT JOIN (SELECT DISTINCT file_id FROM hash2) h ON h.file_id = k.file_id LEFT JOIN pending p ON p.path = coalesce(i.path, k.path) AND coalesce(i.library_id, k.library_id) = 1)"""


def libraries(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files that are known, hashes, pending work and roots of two libraries."""
    known, hashes = v.known(spark, sf).where(MEDIA), v.hashes(spark, sf)
    second = known.where("startswith(path, '/lib/src0/') AND file_id % 2 = 0").withColumn("file_id", F.col("file_id") + 10_000_000)
    files = known.withColumn("library_id", F.lit(1)).unionByName(second.withColumn("library_id", F.lit(2)))
    roots = v.table(spark, sf, "documents").select(F.lit(1).alias("library_id"), F.lit("/lib").alias("root")).union(v.table(spark, sf, "documents").select(F.lit(2), F.lit("/lib/src0"))).distinct()
    return files, hashes.unionByName(hashes.withColumn("file_id", F.col("file_id") + 10_000_000)), v.pending(spark, sf).withColumn("library_id", F.lit(1)), roots


def full(spark: SparkSession, sf: str, directories: DataFrame | None = None) -> full_scan.Scanned:
    """The whole scan of the new inventory, of both libraries, or of the directories(library_id, dir) of them."""
    files, hashes, pending, roots = libraries(spark, sf)
    hooks = full_scan.Hooks(hash_of=lambda read: read.select("library_id", "path", F.sha2("text", 256).alias("value")))
    return full_scan.scan(v.inv_new(spark, sf), roots, files, hashes, files.where("file_id % 3 = 0").select("file_id"), pending, F.lit(1800000000), hooks, directories=directories, file_id=F.col("doc_id") + F.col("library_id") * 20_000_000)


@query("sc20_all_libraries", LIBRARIES + " SELECT library_id, path, file_id, status FROM diff2", "known", "hashes", "pending", "inv_new")
def all_libraries(spark, sf):
    """Every library's diff in one job: the library is a key, not a loop, and one path may be in two."""
    return full(spark, sf).diffed.drop("pending_stage")


MOVES2 = """, gone2 AS (SELECT d.library_id, h.value, d.file_id, d.path FROM diff2 d JOIN hash2 h ON h.file_id = d.file_id AND h.kind = 'sampledSha256' WHERE d.status = 'missing' AND NOT EXISTS (SELECT 1 FROM inv2 i WHERE i.library_id = d.library_id AND i.path = d.path)),
fresh2 AS (SELECT d.library_id, d.path, sha256(i.text) AS value FROM diff2 d JOIN inv2 i ON d.path = i.path AND d.library_id = i.library_id WHERE d.status = 'new'),
moves2 AS (SELECT f.library_id, f.path, g.file_id, g.old_path FROM (SELECT library_id, value, min(path) AS path FROM fresh2 GROUP BY 1, 2) f JOIN (SELECT library_id, value, max(file_id) AS file_id, arg_max(path, file_id) AS old_path FROM gone2 GROUP BY 1, 2) g ON f.value = g.value AND f.library_id = g.library_id)"""


@query("sc21_full_scan", LIBRARIES + MOVES2 + """ SELECT d.library_id, coalesce(m.path, d.path) AS path, coalesce(d.file_id, d.doc_id + d.library_id * 20000000) AS file_id,
  CASE WHEN m.path IS NULL AND d.status = 'missing' THEN coalesce(d.missing_s, 1800000000) END AS missing_s FROM diff2 d LEFT JOIN moves2 m ON m.file_id = d.file_id AND m.library_id = d.library_id
WHERE NOT EXISTS (SELECT 1 FROM moves2 n WHERE n.path = d.path AND n.library_id = d.library_id)""", "known", "hashes", "pending", "inv_new")
def scanned(spark, sf):
    """The files of both libraries after the scan: moved, added, marked missing, returned."""
    return full(spark, sf).files.select("library_id", "path", "file_id", F.col("missing_s").cast("long").alias("missing_s"))


@query("sc21_events", LIBRARIES + MOVES2 + """, seen2 AS (SELECT d.library_id, d.status, coalesce(d.file_id, m.file_id, d.doc_id + d.library_id * 20000000) AS file_id, d.path, m.path IS NOT NULL AS moved, o.old_path IS NOT NULL AS left_it
  FROM diff2 d LEFT JOIN moves2 m ON m.path = d.path AND m.library_id = d.library_id LEFT JOIN moves2 o ON o.old_path = d.path AND o.library_id = d.library_id)
SELECT library_id, 'scan-phase-changed' AS type, NULL AS path, NULL AS file_id, phase, NULL AS discover FROM (VALUES (1), (2)) l(library_id), (VALUES ('scan'), ('discover'), ('metadata'), ('finish')) p(phase)
UNION ALL SELECT library_id, 'scan-work-queued', NULL, NULL, 'scan', (SELECT CAST(count(*) AS VARCHAR) FROM diff2 d WHERE d.library_id = l.library_id AND (status IN ('new', 'changed') OR (status = 'unchanged' AND d.path IN (SELECT path FROM pending WHERE stage = 'discover') AND l.library_id = 1))) FROM (VALUES (1), (2)) l(library_id)
UNION ALL SELECT library_id, CASE WHEN file_id IN (SELECT file_id FROM known2 WHERE file_id % 3 = 0 AND kind IS NOT NULL AND kind <> 'image') THEN 'item-updated' ELSE 'item-added' END, path, file_id,
  CASE WHEN status = 'unchanged' AND NOT (library_id = 1 AND path IN (SELECT path FROM pending WHERE stage = 'discover')) THEN 'finish' ELSE 'discover' END, NULL FROM seen2
  WHERE status IN ('new', 'changed') OR (status = 'unchanged' AND ((library_id = 1 AND path IN (SELECT path FROM pending WHERE stage = 'discover')) OR file_id NOT IN (SELECT file_id FROM known2 WHERE file_id % 3 = 0 AND kind IS NOT NULL AND kind <> 'image')))
UNION ALL SELECT library_id, 'item-missing', path, file_id, 'finish', NULL FROM seen2 WHERE status = 'missing' AND NOT left_it""", "known", "hashes", "pending", "inv_new")
def scan_told(spark, sf):
    """Every event of the scan, with its library, file and phase; how much work was queued to be discovered."""
    return full(spark, sf).events.select("library_id", "type", "path", "file_id", "phase", F.col("fields")["discover"].alias("discover"))


@query("so12_first_errors", "SELECT * FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM inv_base WHERE kind IS NULL) WHERE nth <= 50", "inv_base")
def errors(spark, sf):
    return scan.first_errors(v.inv_base(spark, sf).where("kind IS NULL").select("source", "doc_id"), "source", ["doc_id"]).withColumn("nth", F.col("nth").cast("long"))


@query("hash01_sampled_identity", """SELECT doc_id, sha256(CASE WHEN strlen(text) <= 1024 THEN encode(text) ELSE encode(text)[1:512] || encode(text)[-512:] END || unhex(array_to_string(list_reverse(regexp_extract_all(printf('%016X', strlen(text)), '..')), ''))) AS value FROM documents""")
def sampled_identity(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", identity.sampled_sha256(F.col("text"), 512).alias("value"))


@query("hash03_replace", "SELECT file_id, kind, value FROM hashes WHERE file_id % 5 <> 0 UNION ALL SELECT file_id, 'sampledSha256', md5(value) FROM hashes WHERE file_id % 5 = 0", "hashes")
def hash_replaced(spark, sf):
    rows = v.hashes(spark, sf)
    return identity.replace_rows(rows, rows.where("file_id % 5 = 0").select("file_id", F.lit("sampledSha256").alias("kind"), F.md5("value").alias("value")), ["file_id"])


@query("hash04_duplicates", "SELECT value, count(*) AS copies, min(file_id) AS first_file FROM hashes GROUP BY value HAVING count(*) > 1", "hashes")
def duplicate_content(spark, sf):
    return identity.duplicates(v.hashes(spark, sf))


@query("tm05_changed_fields", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS lang_now, doc_id % 3 = 0 AS lang_changed, doc_id % 4 = 0 AS source_changed FROM documents""")
def field_changes(spark, sf):
    docs = v.table(spark, sf, "documents")
    old = F.to_json(F.struct("source", F.when(F.col("doc_id") % 3 == 0, "xx").otherwise(F.col("lang")).alias("lang")))
    new = F.to_json(F.struct(F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), "lang"))
    changes = scan.changed_fields(old, new)
    return docs.select("doc_id", F.try_element_at(changes, F.lit("lang")).alias("lang_now"), F.map_contains_key(changes, "lang").alias("lang_changed"), F.map_contains_key(changes, "source").alias("source_changed"))


@query("st09_cost_waves", "SELECT path, size_bytes, cost, CAST(floor((upto - cost) / 1048576) AS BIGINT) AS wave FROM (SELECT *, sum(cost) OVER (ORDER BY path) AS upto FROM (SELECT path, size_bytes, least(size_bytes, 2097152) AS cost FROM inv_new))", "inv_new")
def cost_waves(spark, sf):
    return scan.waves(v.inv_new(spark, sf).select("path", "size_bytes"), "discover", 1 << 20)


@query("st09_token_bucket", """SELECT event_id, library_id, CAST(CASE WHEN rate > 0 AND bytes > 0 THEN greatest(debt - rate * 1000000, 0) * 2 + rate ELSE 0 END // CASE WHEN rate > 0 THEN 2 * rate ELSE 1 END AS BIGINT) AS wait_us FROM (
  SELECT *, upto - paid - min(upto - bytes * 1000000 - paid) OVER (PARTITION BY library_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS debt FROM (
    SELECT *, sum(bytes * 1000000) OVER (PARTITION BY library_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS upto, CAST(epoch_us(ts) AS HUGEINT) * rate AS paid FROM (
      SELECT event_id, ts, CASE WHEN event_type = 'view' THEN 0 ELSE user_id % 3 + 1 END AS library_id, CAST(CASE WHEN event_type = 'view' THEN 0 ELSE (user_id % 3 + 1) * 50 END AS HUGEINT) AS rate, CAST(floor(value * 10000) AS HUGEINT) AS bytes FROM events)))""")
def token_bucket(spark, sf):
    """Events as reads that are charged to four libraries: three of different rates and one, with a large share of all, without any."""
    events = v.table(spark, sf, "events").selectExpr("event_id", "ts AS at", "CASE WHEN event_type = 'view' THEN 0 ELSE user_id % 3 + 1 END AS library_id", "CAST(FLOOR(value * 10000) AS BIGINT) AS bytes")
    rates = events.select("library_id").distinct().select("library_id", (F.col("library_id") * 50).alias("bytes_per_second"))
    return pacing.waits(events, rates, ("event_id",)).select("event_id", "library_id", "wait_us")


@query("st09_due", "SELECT path, cost, CAST(greatest(upto - 100000, 0) * 1000000 // 100000 AS BIGINT) AS due_us FROM (SELECT path, cost, sum(cost) OVER (ORDER BY path) AS upto FROM (SELECT path, least(size_bytes, 1048576) AS cost FROM inv_new))", "inv_new")
def due_reads(spark, sf):
    return pacing.due(v.inv_new(spark, sf).select("path", "size_bytes"), "enrich", 100_000).select("path", "cost", "due_us")


@query("sc12_returned", "SELECT k.file_id FROM known k JOIN diffed d ON k.path = d.path WHERE d.status IN ('unchanged', 'changed') AND k.missing_s IS NOT NULL", "known", "diffed")
def returned(spark, sf):
    known = v.known(spark, sf)
    marked = scan.mark_missing(known, diffed(spark, sf), F.lit(1800000000)).where("missing_s IS NULL").select("file_id")
    return known.where("missing_s IS NOT NULL").join(marked, "file_id", "left_semi").select("file_id")


@query("sc18_skipped", "SELECT count(*) AS skipped FROM inv_new WHERE kind IS NULL AND path NOT LIKE '%.srt'", "inv_new")
def skipped(spark, sf):
    others = v.inv_new(spark, sf).where("kind IS NULL").select("path")
    return others.join(others.where(classify.sidecar_kind(F.col("path")).isNotNull()), "path", "left_anti").agg(F.count("*").alias("skipped"))


@query("tg18_lossless", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS lossless, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS lead FROM part")
def lossless_codecs(spark, sf):
    from ..functions import values as val
    from ..operators import shelves

    codec = F.when(F.col("p_partkey") % 3 == 0, "FLAC").when(F.col("p_partkey") % 3 == 1, "mp3")
    lead = shelves.artist_shown(F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(" "), F.lit(None).cast("string"), F.col("p_type"))
    return v.table(spark, sf, "part").select("p_partkey", val.lossless(codec).alias("lossless"), lead.alias("lead"))
