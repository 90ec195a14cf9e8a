"""URL rules, indexed by their rarest literal token: a URL's tokens fetch the rules that may fit, and only those run."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^A-Za-z0-9]+"
RULES = "name string, size int, regex string, verdict string, tokens array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: What `^` stands for in a filter: a character that separates, or the end.
SEPARATOR = r"(?:[^A-Za-z0-9_\-.%]|\z)"


@dataclass(frozen=True)
class UrlRule:
    """A regular expression over host and path joined, the literal tokens that every URL it fits must hold, and what it says.

    name is None for a general pattern; a named rule outranks all patterns, and a longer one a shorter one. Of patterns, one that allows outranks one that blocks.
    """

    regex: str
    tokens: tuple[str, ...]
    verdict: str
    name: str | None = None
    size: int = 0


def host_rule(host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host and its subdomains where the path starts with `path`."""
    closed = path if not path or re.match(WORD, path[-1]) else path[: len(path) - len(re.split(WORD, path)[-1])]
    tokens = tuple(t for t in re.split(WORD, f"{host} {closed}") if t)
    return UrlRule(rf"^(?:[^/]*\.)?\Q{host}{path}\E", tokens, verdict, host + path, len(host + path))


def pattern_rule(regex: str, tokens: tuple[str, ...], verdict: str = "block") -> UrlRule:
    return UrlRule(regex, tokens, verdict)


def host_of(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path; both empty for a null or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def filter_rules(filters: DataFrame, filter_col: str = "filter", strict: bool = True) -> DataFrame:
    """A table of rules from a list of filters, one a row, in the usual syntax of such lists.

    `||` at the start stands for the start of the host or of what follows one of its dots, `|` for the start or the end, `*` for anything, `^` for a character that separates, or the end; `/.../` is a
    regular expression; `@@` allows what others block; `$match-case` tells upper case from lower. Filters see host and path, so a scheme before the host only says that the host starts there. Null and
    empty lines, and those that start with `!` or `[`, say nothing. Other options, hidden elements (`##`) and filters of a query or fragment aren't known here: they stop the job by an error that names
    the filter, or are left out where strict is False. Tokens are the words that no `*` or open end touches: a word of the URL must be just that.
    """
    body = F.regexp_replace("line", "^@@", "")
    options = r"\$([A-Za-z~][A-Za-z0-9~_,=|.*-]*)$"
    rows = filters.select(F.trim(F.col(filter_col)).alias("line")).where(r"line <> '' AND NOT line RLIKE '^[!\\[]'")
    rows = rows.select("line", F.regexp_replace(body, options, "").alias("body"), F.nullif(F.regexp_extract(body, options, 1), F.lit("")).alias("option"))
    free = F.rlike("body", F.lit("^/.+/$"))
    known = (F.coalesce("option", F.lit("match-case")) == "match-case") & (free | ~F.rlike("body", F.lit("[?#]")))
    rows = rows.withColumn("shape", F.regexp_replace("body", r"^\|?(?:[A-Za-z*]*:)?//", "|"))
    text = F.regexp_replace(F.regexp_replace("shape", r"^\|{1,2}|\|$", ""), r"([\\.+?${}()|\[\]])", r"\\$1")
    text = F.replace(F.regexp_replace(text, r"\*+", ".*"), F.lit("^"), F.lit(SEPARATOR))
    first = F.when(F.startswith("shape", F.lit("||")), r"^(?:[^/]*\.)?").when(F.startswith("shape", F.lit("|")), "^").otherwise("")
    last = F.when(F.rlike("shape", F.lit(r"[^|]\|$")), r"\z").otherwise("")
    cased = F.col("option").isNotNull()
    plain = F.concat(F.when(cased, "(?s)").otherwise("(?is)"), first, text, last)
    regex = F.when(free, F.concat(F.when(cased, "").otherwise("(?i)"), F.substring("body", F.lit(2), F.length("body") - 2))).otherwise(plain)
    tokens = F.transform(F.regexp_extract_all("shape", F.lit("(?<=[^A-Za-z0-9*])([A-Za-z0-9]+)(?=[^A-Za-z0-9*])"), F.lit(1)), F.lower)
    if strict:
        regex = F.when(known, regex).otherwise(F.raise_error(F.concat(F.lit("no filter that is known here: "), "line")).cast("string"))
    else:
        rows = rows.where(known)
    said = F.when(F.startswith("line", F.lit("@@")), "allow").otherwise("block")
    return rows.select(F.lit(None).cast("string").alias("name"), F.lit(0).alias("size"), regex.alias("regex"), said.alias("verdict"), F.when(free, F.array().cast("array<string>")).otherwise(F.array_distinct(tokens)).alias("tokens"))


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    return spark.createDataFrame([(r.name, r.size, r.regex, r.verdict, sorted({t.lower() for t in r.tokens})) for r in rules], RULES)


def url_tokens(address: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.translate(address, UPPER, LOWER), "[^a-z0-9]+")), lambda t: t != "")


def filed(rules: DataFrame, urls: DataFrame, few: bool) -> DataFrame:
    """Each rule that has tokens, once, under that one which the fewest of urls(host, path) hold; ties go to the first by name."""
    tokens = rules.select(F.explode("tokens").alias("known")).distinct()
    held = urls.select(F.explode(url_tokens(F.concat_ws(" ", "host", "path"))).alias("token"))
    often = held.join(F.broadcast(tokens) if few else tokens, F.col("token") == F.col("known")).groupBy("token").agg(F.count(F.lit(1)).alias("often"))
    each = rules.select("best", F.explode("tokens").alias("token")).join(often, "token", "left")
    return each.groupBy("best").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("filed"))


def judge_urls(
    pages: DataFrame, rules: list[UrlRule] | DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = 100_000, broadcast_bytes: int = 32 << 20, most_free: int = 1000
) -> DataFrame:
    """One row per input row: id, host, path, rule (a named rule's name, else null), verdict, pattern (the regex that decided).

    rules is a list, or a table as of `filter_rules`. How often each rule's tokens occur is counted over all URLs; a rule is filed under its rarest, whatever their case. Rules without a token are tried on
    every URL, so more than `most_free` of them are an error. Up to `broadcast_rules` rules of `broadcast_bytes` are broadcast; beyond, they and the URLs' tokens are joined by a shuffle, where adaptive
    execution splits a token that many URLs have. A URL that no rule fits gets the default verdict. Null and malformed URLs have no host and path, so only token-free rules can fit.
    Repeated rows, ids and rules are judged each for itself; other columns are ignored.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    named = F.col("name").isNotNull()
    # the greatest decides
    rank = F.struct(named.alias("named"), F.col("size").alias("size"), F.coalesce("name", F.lit("")).alias("name"), (~named & (F.col("verdict") == "allow")).alias("spares"), F.col("regex").alias("regex"), F.col("verdict").alias("said"))
    rules = rules.select(rank.alias("best"), "tokens")
    size = rules.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json("best")) + F.octet_length(F.to_json("tokens"))), F.lit(0)).alias("bytes")).first()
    few = size["n"] <= broadcast_rules and size["bytes"] <= broadcast_bytes
    free = [r["best"] for r in rules.where("size(tokens) = 0").select("best").distinct().limit(most_free + 1).collect()]
    if len(free) > most_free:
        raise ValueError(f"more than {most_free} rules hold no token, so each would be tried on every URL")

    host, path = host_of(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    whole = F.concat("host", "path")
    kind = rules.schema["best"].dataType
    for_all = [F.when(F.rlike(whole, F.lit(r["regex"])), F.struct(*[F.lit(r[f.name]).alias(f.name) for f in kind.fields]).cast(kind)) for r in free]
    looked = urls.withColumn("free", F.array_max(F.array(F.lit(None).cast(kind), *for_all))).withColumn("token", F.explode_outer(url_tokens(F.concat_ws(" ", "host", "path"))))
    # URLs without tokens stay, spread over keys that no rule has
    looked = looked.withColumn("token", F.coalesce("token", F.concat(F.lit(" "), F.col("row") % 4096)))
    index = filed(rules, urls, few)
    found = looked.join(F.broadcast(index) if few else index, F.col("token") == F.col("filed"), "left").withColumn("best", F.when(F.rlike(whole, F.col("best.regex")), F.col("best")))
    judged = found.groupBy("row", "page_id", "host", "path").agg(F.max(F.array_max(F.array("best", "free"))).alias("best"))
    return judged.select("page_id", "host", "path", F.when(F.col("best.named"), F.col("best.name")).alias("rule"), F.coalesce("best.said", F.lit(default)).alias("verdict"), F.col("best.regex").alias("pattern"))
