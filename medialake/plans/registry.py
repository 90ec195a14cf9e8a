"""Where registered queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: The bound tables in SQL, by name; a view's text may use the ones before it.
VIEWS = {
    "inv_base": """SELECT doc_id, source, lang,
  CONCAT('/lib/', source, '/', lang, '/doc_', CAST(doc_id AS VARCHAR), CASE doc_id % 8 WHEN 0 THEN '.mp3' WHEN 1 THEN '.FLAC' WHEN 2 THEN '.mkv' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.pdf' WHEN 5 THEN '.txt' WHEN 6 THEN '.srt' ELSE '.xyz' END) AS path,
  CASE doc_id % 8 WHEN 0 THEN 'audio' WHEN 1 THEN 'audio' WHEN 2 THEN 'video' WHEN 3 THEN 'image' WHEN 4 THEN 'document' WHEN 5 THEN 'document' END AS kind,
  n_chars AS size_bytes, 1704067200 + doc_id * 60 AS modified_s, text FROM documents""",
    "inv_old": "SELECT * FROM inv_base WHERE doc_id % 10 <> 0",
    "inv_new": """SELECT doc_id, source, lang, CASE WHEN doc_id % 10 = 2 THEN REPLACE(path, '/lib/', '/lib/moved/') ELSE path END AS path, kind,
  CASE WHEN doc_id % 10 = 3 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, CASE WHEN doc_id % 10 = 4 THEN modified_s + 3600 ELSE modified_s END AS modified_s,
  CASE WHEN doc_id % 10 = 3 THEN CONCAT(text, '!') ELSE text END AS text FROM inv_base WHERE doc_id % 10 <> 1""",
    "known": """SELECT doc_id AS file_id, path, kind, size_bytes, modified_s, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1704067200 END AS scanned_s,
  CASE WHEN doc_id % 23 = 0 THEN 1704070000 END AS missing_s FROM inv_old""",
    "hashes": "SELECT doc_id AS file_id, CASE WHEN doc_id % 7 = 0 THEN 'sha256' ELSE 'sampledSha256' END AS kind, sha256(text) AS value FROM inv_old WHERE doc_id % 19 <> 0",
    "pending": "SELECT path, size_bytes, modified_s * 1000 + CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS modified_ms, CASE WHEN doc_id % 2 = 0 THEN 'discover' ELSE 'metadata' END AS stage FROM inv_old WHERE doc_id % 29 = 0",
    "diffed": """SELECT coalesce(i.path, k.path) AS path, k.file_id,
  CASE WHEN i.path IS NULL THEN 'missing' WHEN k.path IS NULL THEN 'new'
    WHEN k.scanned_s IS NOT NULL AND h.file_id IS NOT NULL AND i.size_bytes = k.size_bytes AND i.modified_s = k.modified_s AND (p.path IS NULL OR (p.size_bytes = i.size_bytes AND p.modified_ms = i.modified_s * 1000)) THEN 'unchanged' ELSE 'changed' END AS status,
  p.stage AS pending_stage
FROM (SELECT * FROM inv_new WHERE kind IS NOT NULL AND kind <> 'image') i FULL OUTER JOIN (SELECT * FROM known WHERE kind IS NOT NULL AND kind <> 'image') k ON i.path = k.path
LEFT JOIN (SELECT DISTINCT file_id FROM hashes) h ON h.file_id = k.file_id LEFT JOIN pending p ON p.path = coalesce(i.path, k.path)""",
    "tracks": """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name AS title,
  CASE WHEN l.l_partkey % 13 = 0 THEN NULL ELSE s.s_name END AS artist, CASE WHEN l.l_partkey % 11 = 0 THEN NULL ELSE p.p_brand END AS album,
  CASE WHEN l.l_partkey % 5 = 0 THEN s.s_name ELSE NULL END AS album_artist, l.l_linenumber AS track_number,
  CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE 1 + l.l_suppkey % 2 END AS disc_number, CASE WHEN l.l_partkey % 7 = 0 THEN NULL ELSE CAST(l.l_quantity AS BIGINT) * 7000 END AS duration_ms,
  CASE WHEN l.l_partkey % 17 = 0 THEN NULL ELSE YEAR(l.l_shipdate) END AS year, p.p_type AS genre, l.l_returnflag = 'R' AS missing
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey""",
    "ranked_tracks": "SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS shelf FROM tracks",
    "plays": "SELECT event_id AS play_id, user_id AS item_id, ts AS started_at, event_type = 'purchase' AS completed FROM events",
    "progress_log": "SELECT event_id, user_id AS item_id, CAST(FLOOR(value * 1000) AS BIGINT) AS position_ms, ts AS updated_at FROM events WHERE event_type = 'view'",
    "entries": "SELECT conv_id AS collection_id, turn AS position, CONCAT(role, ':', CAST(turn % 3 AS VARCHAR)) AS item_id FROM conversations",
    "item_tags": "SELECT doc_id AS item_id, 'quality' AS namespace, CAST(quality AS VARCHAR) AS name FROM labels UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels",
    "filenames": """SELECT p_partkey, p_name, CASE p_partkey % 6
  WHEN 0 THEN CONCAT('/tv/', p_brand, '/Season 1/', REPLACE(p_name, ' ', '.'), '.S01E', LPAD(CAST(p_size AS VARCHAR), 2, '0'), '.mkv')
  WHEN 1 THEN CONCAT('/tv/', p_brand, '/Season 2/S02E', LPAD(CAST(p_size AS VARCHAR), 2, '0'), ' ', p_name, '.mkv')
  WHEN 2 THEN CONCAT('/tv/x/', p_name, ' 3x', LPAD(CAST(p_size AS VARCHAR), 2, '0'), '.avi')
  WHEN 3 THEN CONCAT('/films/', p_name, ' (', CAST(1950 + p_size AS VARCHAR), ').mp4')
  WHEN 4 THEN CONCAT('/films/', p_name, ' (', CAST(1950 + p_size AS VARCHAR), ')/movie.mp4')
  ELSE CONCAT('/films/', p_name, ' 1920x1080.mp4') END AS path FROM part""",
    "raw_tags": """SELECT p_partkey AS file_id, CASE p_partkey % 4 WHEN 0 THEN 'vorbis' WHEN 1 THEN 'id3v2' WHEN 2 THEN 'ilst' ELSE 'riff' END AS dialect, seq, key, value FROM (
  SELECT p_partkey, 0 AS seq, CASE p_partkey % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'TIT2' WHEN 2 THEN '©nam' ELSE 'INAM' END AS key, p_name AS value FROM part
  UNION ALL SELECT p_partkey, 1, CASE p_partkey % 4 WHEN 0 THEN 'Album Artist' WHEN 1 THEN 'TPE2' WHEN 2 THEN 'aART' ELSE 'IART' END, p_brand FROM part
  UNION ALL SELECT p_partkey, 2, CASE p_partkey % 4 WHEN 0 THEN 'GENRE' WHEN 1 THEN 'TCON' WHEN 2 THEN '©gen' ELSE 'IGNR' END, p_type FROM part
  UNION ALL SELECT p_partkey, 3, CASE p_partkey % 4 WHEN 0 THEN 'TRACKNUMBER' WHEN 1 THEN 'TRCK' WHEN 2 THEN 'tmpo' ELSE 'ITRK' END, CONCAT(CAST(p_size AS VARCHAR), '/50') FROM part
  UNION ALL SELECT p_partkey, 4, CASE p_partkey % 4 WHEN 0 THEN 'custom_price' WHEN 1 THEN 'TXXX:price' WHEN 2 THEN '----:mean:price' ELSE 'IPRC' END, CAST(p_size * 3 AS VARCHAR) FROM part
  UNION ALL SELECT p_partkey, 5, CASE p_partkey % 4 WHEN 0 THEN 'TITLE' WHEN 1 THEN 'TPE1' WHEN 2 THEN '©ART' ELSE 'INAM' END, CONCAT(' second ', p_name) FROM part)""",
}


def sql(body: str, *views: str) -> str:
    """The body behind the named views, and those that they use."""
    wanted: list[str] = []

    def want(name: str) -> None:
        text = VIEWS[name]
        for other in VIEWS:
            if other != name and f" {other}" in text.replace("(", " ").replace("\n", " ") and any(f"{w} {other}" in text for w in ("FROM", "JOIN")):
                want(other)
        if name not in wanted:
            wanted.append(name)

    for name in views:
        want(name)
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    return f"WITH {head} {body}" if wanted else body


def query(name: str, oracle: str | None = None, *views: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = sql(oracle, *views)
        return f

    return keep
