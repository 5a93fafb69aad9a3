"""URL filters: pattern rules indexed by their rarest literal token, in DataFrame operations only.

A rule is a prefix rule (host and path, e.g. `example.org/es/`: the host or any subdomain,
the path's beginning; the longest decides) or a pattern rule (a regular expression with the
literal tokens that any match contains; without a prefix rule, one match blocks). Each rule
is filed under that one of its tokens which fewest URLs have; a rule without a token is filed
under a mark that every URL carries. A URL's tokens fetch the rules filed under them, and only
those run their expression on the URL. Equal URLs are judged once.

The index is broadcast while its counted rows and bytes are few, and shuffled otherwise. Lists of any
length come from a table or text file (`listed`), one rule a line.

Defined cases: a null URL or one without `://` has empty host and path, fits no rule and is
allowed; of equally long prefix rules the one that sorts last decides; repeated rules count once,
repeated rows are judged each; URLs of any length are judged whole; empty tables give empty
results; no rules allow everything; ids don't matter; other columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import byte_sized_broadcast, sized_broadcast, stored
from gridloom.llm.decontam import LOWER, UPPER

#: (verdict, host, path)
PREFIX_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: (expression on host and path, tokens that every match contains whole)
PATTERN_RULES = [
    (r"^([^/]*[.-])?spam-[a-z]+[.]", ["spam"]),
    (r"^([^/]*[.-])?casino(-[a-z]+)?[.]", ["casino"]),
    (r"^([^/]*[.-])?adult-[a-z]+[.]", ["adult"]),
    (r"^([^/]*[.-])?ads-track(ing)?[.]", ["ads"]),
    (r"^([^/]*[.-])?cheap-pills[.]", ["cheap", "pills"]),
    (r"^([^/]*[.-])?free-bets[.]", ["free", "bets"]),
    (r"^([^/]*[.-])?(porn|[a-z]*-porn)[.]", ["porn"]),
    (r"/(.*/)?phishing(/|$)", ["phishing"]),
    (r"^([^/]*[.-])?xxx[.]", ["xxx"]),
]
TOKEN = "[^0-9A-Za-z]+"
#: What rules without a token are filed under: no token of a URL is empty.
ANY = ""
#: Parts that URLs without host and path are dealt in.
SPREAD = 1024
_RULE = "rule string, kind string, verdict string, size int, pattern string, tokens array<string>"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules(spark: SparkSession, prefixes: Sequence[tuple[str, str, str]] = PREFIX_RULES, patterns: Sequence[tuple[str, list[str]]] = PATTERN_RULES) -> DataFrame:
    """One row a rule: its text, expression and literal tokens."""
    rows = []
    for verdict, host, path in prefixes:
        inner = path.rstrip("".join(c for c in set(path) if c.isalnum()))  # the path's last, open token is no whole one
        tokens = [t for t in re.split(TOKEN, host) + re.split(TOKEN, inner) if t]
        rows.append((host + path, "prefix", verdict, len(host + path), rf"^(?:[^/]*[.])?{re.escape(host)}(?=/|$)(?={re.escape(path)})", tokens))
    rows += [(p, "pattern", "block", 0, p, t) for p, t in patterns]
    return spark.createDataFrame(rows, _RULE)


def listed(lines: DataFrame) -> DataFrame:
    """Rules from a column `value`: `allow host/path`, `block host/path` (prefix rules), or a pattern to block in which
    `*` is any run of characters, on host and path together. Other lines (empty, `! comment`) are left out.

    A pattern's tokens are its whole ones: runs of letters and digits between other characters, not next to `*` or an end.
    """
    value = F.trim("value")
    verdict, rest = F.regexp_extract(value, "^(allow|block) +([^ /]+)(/?.*)$", 1), lambda i: F.regexp_extract(value, "^(allow|block) +([^ /]+)(/?.*)$", i)
    host, path = F.translate(rest(2), UPPER, LOWER), rest(3)
    quote = lambda c: F.regexp_replace(c, r"([^0-9A-Za-z*/_])", r"\\$1")
    inner = F.concat(host, F.regexp_replace(path, "[0-9A-Za-z]+$", ""))
    whole = F.regexp_extract_all(value, F.lit("(?<=[^0-9A-Za-z*])([0-9A-Za-z]+)(?=[^0-9A-Za-z*])"), F.lit(1))
    prefix, rule = verdict != "", F.when(verdict != "", F.concat(host, path)).otherwise(value)
    rows = lines.where((value != "") & ~F.startswith(value, F.lit("!"))).select(
        rule.alias("rule"), F.when(prefix, "prefix").otherwise("pattern").alias("kind"), F.when(prefix, verdict).otherwise("block").alias("verdict"), F.when(prefix, F.length(rule)).otherwise(0).alias("size"),
        F.when(prefix, F.concat(F.lit("^(?:[^/]*[.])?"), quote(host), F.lit("(?=/|$)(?="), quote(path), F.lit(")"))).otherwise(F.regexp_replace(quote(value), r"[*]+", ".*")).alias("pattern"),
        F.when(prefix, F.array_remove(F.split(inner, TOKEN, -1), "")).otherwise(whole).alias("tokens"))
    return rows.distinct()


def judge(pages: DataFrame, rule_rows: DataFrame, id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (the longest prefix rule that fits) and verdict of every row."""
    host, path = host_and_path()
    urls = pages.select(F.col(id_col), "url").select(id_col, host.alias("host"), path.alias("path"))
    one = urls.where("host <> '' or path <> ''").select("host", "path").distinct()
    one = stored(one.withColumn("tokens", F.array_distinct(F.split(F.concat_ws("/", "host", "path"), TOKEN, -1))), "urls")
    rule_rows = stored(rule_rows, "rules")
    n_rules, n_tokens, n_bytes = rule_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("tokens")), F.lit(0)), F.coalesce(F.sum(F.octet_length("rule") + F.octet_length("pattern") + 48), F.lit(0))).first()
    literals = rule_rows.select(F.explode("tokens").alias("token")).distinct()
    common = one.select(F.explode("tokens").alias("token")).join(sized_broadcast(literals, n_tokens), "token").groupBy("token").agg(F.count(F.lit(1)).alias("urls"))
    filed = rule_rows.withColumn("token", F.explode_outer("tokens")).join(common, "token", "left").groupBy("rule", "kind", "verdict", "size", "pattern").agg(
        F.coalesce(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), F.col("token"))), F.lit(ANY)).alias("token"))
    index = stored(filed, "index")
    fetch = F.explode(F.array_union(F.array_remove("tokens", ""), F.array(F.lit(ANY))))
    pairs = one.select("host", "path", fetch.alias("token")).join(byte_sized_broadcast(index, n_bytes), "token").where(F.expr("concat(host, path) rlike pattern"))
    best = pairs.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "prefix", F.struct("size", "rule", "verdict"))).alias("best"), F.max(F.col("kind") == "pattern").alias("listed"))
    spread = F.when((F.col("host") == "") & (F.col("path") == ""), F.pmod(F.xxhash64(id_col), F.lit(SPREAD))).otherwise(0)
    out = urls.withColumn("_deal", spread).join(best.withColumn("_deal", F.lit(0).cast("long")), ["host", "path", "_deal"], "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("listed"), F.lit("block")), F.lit("allow"))
    return out.select(id_col, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
