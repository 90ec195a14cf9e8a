"""The registered queries of the text operators, with the SQL of those that SQL can express."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from .common import Tables, saved, scratch, table
from .conversation import damaged, joined_sha256, repair
from .exact_dedup import exact_dedup
from .fingerprint import fingerprint_edits
from .language_id import language_id
from .merkle import manifest, without_line_ends
from .ngram_join import ngram_join
from .packing import pack, pieces_of
from .personal import digests, personal_data
from .piece_codec import code_round
from .quality import quality
from .reshard import assigned, plan_moves, rewrite_moved
from .toxicity import toxicity
from .url_filter import filter_rules, host_rule, judge_urls, pattern_rule, rule_table

#: Fixed values of the production run: named rules, then words that a host of junk pages has between its dots and dashes.
JUNK = (
    "ads", "adserver", "adservice", "adult", "affiliate", "banners", "bet", "bets", "betting", "blackjack", "casino", "clickbait", "clicks", "coupon", "coupons", "escort", "escorts", "gamble", "gambling", "jackpot",
    "lottery", "malware", "nsfw", "payday", "pharma", "pharmacy", "phishing", "pills", "poker", "popunder", "popups", "porn", "roulette", "sex", "slots", "spam", "torrent", "torrents", "tracker", "tracking", "viagra", "warez", "xxx",
)
URL_RULES = [
    host_rule("net", "/", "block"),
    host_rule("example.net", "/en/", "allow"),
    host_rule("example.com", "/de/", "block"),
    host_rule("org", "/fr/", "allow"),
    *[pattern_rule(rf"^(?:[^/]*[.-])?{word}[.-]", (word,)) for word in JUNK],
]

#: Filters beside them: hosts and paths of pages that are made for clicks, and pages about such pages, which stay.
URL_FILTERS = (
    "! hosts",
    "||spam-farm.*^",
    "||link-farm.*^",
    "||content-farm.*^",
    "||free-*-download.*^",
    "||parked-domain.*^",
    "! paths",
    "/out/redirect/*",
    "/cgi-bin/*/click^",
    "/ad-server/*/banner^",
    "^popup-page.html|",
    "/session-id-[0-9a-f]{16,}/",
    "! what stays",
    "@@||spam-research.*/papers/",
    "@@/help/report-spam^",
)

#: The vocabulary of the packed ids: what ByteBpe takes, here with its option of merge ranks.
BPE = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(PIECES, "rb") as model:
        return code_round(table(spark, sf_dir, "documents"), model.read())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = filter_rules(spark.createDataFrame([(line,) for line in URL_FILTERS], "filter string"))
    rules = rule_table(spark, URL_RULES).unionByName(filters)
    return judge_urls(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    places = F.transform("spans", lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string")))
    return scored.select("doc_id", "held_out", "score", "predicted", F.array_join(places, " ").alias("offsets"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(table(spark, sf_dir, "documents"), BPE))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old shards hold whole sources, so one of them holds a third of all rows; the new ones are even. Rows of shards that change are read from the files written for them."""
    docs = table(spark, sf_dir, "documents")
    layout = plan_moves(docs, F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(24)), 24, 24)
    path = f"{scratch(spark)}/reshard-files-{uuid.uuid4().hex}"
    shard, slot = rewrite_moved(docs, layout, path)
    text = F.coalesce("text", F.lit(""))
    digests = [(F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law")]
    schema = StructType([*docs.schema.fields]).add(slot, LongType()).add(shard, IntegerType())
    written = spark.read.schema(schema).parquet(path).select("doc_id", *digests, F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    written = saved(written, "reshard-digests")  # the files are no longer needed: no copy of the texts stays
    Tables(spark).remove(path)
    same = assigned(docs, layout).where(~F.col("shard").isin(layout.touched)).select(*written.columns)
    return written.unionByName(same)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(personal_data(table(spark, sf_dir, "documents")))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    repaired = repair(turns, damaged(turns))
    hashes = joined_sha256(repaired.turns).withColumnRenamed("conv_id", "of")
    report = repaired.report.join(hashes, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return report.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"), without_line_ends())


QUERIES = {f.__name__: f for f in (op1_language_id, op2_sentencepiece, op3_url_filter, op4_toxicity, op5_packing, op6_fingerprints, op7_exact_dedup, op8_ngram_join, op9_quality, op10_reshard, op11_personal_data, op12_conversation_repair, op13_merkle_manifest)}

#: The unsigned crc32 of an ASCII text, of its list of character codes and the table `t`.
CRC_TABLE = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"


def crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def paid(value: str, cost: str, edit: str) -> str:
    """A value is eight digits of cost, then the audit, so that text order is the order of values."""
    return f"(lpad(CAST(CAST(left({value}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({value}, 9) || '{edit}')"


REPAIR_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
orig AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, {crc("k")} % 20 AS w FROM orig, crc),
dam AS (SELECT conv_id, turn, CASE w WHEN 4 THEN 'user' ELSE role END AS role, CASE w WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hit, range(2) c(i) WHERE w <> 0 AND i < CASE w WHEN 3 THEN 2 ELSE 1 END),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS n FROM dam),
rep AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) AS again FROM num),
f AS (SELECT *, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS was, count(*) OVER (PARTITION BY conv_id) AS total,
  CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault FROM rep),
g AS (SELECT conv_id, n, i, total, fault IN (0, 3) AS free, CASE fault WHEN 3 THEN 3 ELSE 0 END AS more FROM f),
dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS n, total, '00000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM g WHERE n = 1
  UNION ALL SELECT d.conv_id, g.n, d.total, {paid("z", "4", "D")},
    least({paid("s", "4", "D")}, CASE WHEN free AND i = 's' THEN {paid("z", "more", "K")} END),
    least({paid("u2", "4", "D")}, CASE WHEN free AND i = 'u' THEN {paid("least(z, s, a2)", "more", "K")} END, CASE WHEN free THEN {paid("least(z, s, a2)", "more + 3", "R")} END),
    least({paid("a2", "4", "D")}, CASE WHEN free AND i = 'a' THEN {paid("u2", "more", "K")} END, CASE WHEN free THEN {paid("u2", "more + 3", "R")} END)
  FROM (SELECT *, least(u, {paid("z", "3", "I")}, {paid("s", "3", "I")}, {paid("a", "3", "I")}) AS u2, least(a, {paid("u", "3", "I")}, {paid("z", "6", "II")}, {paid("s", "6", "II")}) AS a2 FROM dp) d
  JOIN g ON g.conv_id IS NOT DISTINCT FROM d.conv_id AND g.n = d.n + 1),
best AS (SELECT conv_id, least(z, a, {paid("u", "3", "I")}, {paid("s", "6", "II")}) AS v FROM dp WHERE n = total),
said AS (SELECT conv_id, CAST(left(v, 8) AS BIGINT) AS cost, substr(v, 9) AS audit FROM best),
chars AS (SELECT conv_id, j, substr(audit, j, 1) AS e FROM (SELECT *, unnest(generate_series(1, length(audit))) AS j FROM said)),
placed AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w - 1 AS p FROM chars WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
kept AS (SELECT c.conv_id, j, e, p, f.role, CASE WHEN e = 'I' THEN '' ELSE f.text END AS text, max(CASE WHEN e = 'K' AND f.i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS sys
  FROM placed c LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM c.conv_id AND f.n = c.n WHERE e <> 'D'),
fixed AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (p - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS repaired_sha256 FROM kept GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN fixed x ON x.conv_id IS NOT DISTINCT FROM o.conv_id"""


def framed_sql(column: str) -> str:
    return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(framed_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def tree_sql(name: str, first: str) -> str:
    """The levels over first(grp, pos, d, n), and the siblings left and right of each node below the last."""
    return f"""{name} AS (SELECT grp, 0 AS lvl, pos, d, n FROM {first} UNION ALL SELECT grp, lvl + 1, pos // 3, sha256(string_agg(d, '' ORDER BY pos)), (n + 2) // 3 FROM {name} WHERE n > 1 GROUP BY grp, lvl, pos // 3, n),
{name}_by AS (SELECT a.grp, a.lvl, a.pos, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {name} a JOIN {name} b ON a.grp = b.grp AND a.lvl = b.lvl AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY ALL)"""


def fold_sql(name: str, first: str, by: str) -> str:
    """first(doc_id, grp, pos, now, proof) folded level by level."""
    return f"""{name} AS (SELECT doc_id, grp, 0 AS lvl, pos, now, proof FROM {first} UNION ALL SELECT doc_id, f.grp, f.lvl + 1, f.pos // 3, sha256(l || now || r), proof || l || r FROM {name} f JOIN {by} s ON s.grp = f.grp AND s.lvl = f.lvl AND s.pos = f.pos),
{name}_end AS (SELECT doc_id, grp, arg_max(now, lvl) AS now, arg_max(proof, lvl) AS proof FROM {name} GROUP BY doc_id, grp)"""


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
base AS (SELECT doc_id, coalesce('=' || source, '') AS grp, {leaf_sql("text")} AS d, CASE WHEN {crc("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {leaf_sql("replace(text, chr(10), '')")} ELSE {leaf_sql("text")} END AS now FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM base),
{tree_sql("tree", "leaves")},
subroots AS (SELECT grp AS source, d, 0 AS grp, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
{tree_sql("above", "subroots")},
entering AS (SELECT doc_id, grp, pos, now, '' AS proof FROM leaves),
{fold_sql("inner_fold", "entering", "tree_by")},
leaving AS (SELECT f.doc_id, s.grp, s.pos, f.now, f.proof FROM inner_fold_end f JOIN subroots s ON s.source = f.grp),
{fold_sql("outer_fold", "leaving", "above_by")}
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, r.d AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = r.d AS verified
FROM leaves l JOIN subroots s ON s.source = l.grp JOIN outer_fold_end o ON o.doc_id = l.doc_id, (SELECT d FROM above WHERE n = 1) r"""

ORACLE_SQL = {
    "op12_conversation_repair": REPAIR_SQL,
    "op13_merkle_manifest": MERKLE_SQL,
    "op3_url_filter": rf"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(rhost, rpath, said)),
m AS (SELECT page_id, host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(said, length(rhost || rpath)) AS said FROM p JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, m.rule,
  coalesce(m.said, CASE WHEN regexp_matches(p.host || p.path, '(?is)^([^/]*\.)?spam-research\..*/papers/|/help/report-spam([^A-Za-z0-9_.%-]|\z)') THEN 'allow'
    WHEN regexp_matches(p.host || p.path, '^([^/]*[.-])?({"|".join(JUNK)})[.-]') THEN 'block'
    WHEN regexp_matches(p.host || p.path, '(?is)^([^/]*\.)?((spam|link|content)-farm|free-.*-download|parked-domain)\..*([^A-Za-z0-9_.%-]|\z)') THEN 'block'
    WHEN regexp_matches(p.host || p.path, '(?is)/out/redirect/|(/cgi-bin/.*/click|/ad-server/.*/banner)([^A-Za-z0-9_.%-]|\z)|[^A-Za-z0-9_.%-]popup-page\.html\z|session-id-[0-9a-f]{{16,}}') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN m ON p.page_id = m.page_id AND p.host = m.host AND p.path = m.path""",
    "op7_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n""",
}
