"""URL rules by host suffix and path prefix, joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the joined prefix; the full digest confirms.
PREFIX = 8
#: Rules up to which the rule table is broadcast; beyond, the join shuffles with salt.
BROADCAST_RULES, SALT = 100_000, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(p: Column) -> Column:
    """A path up to its last slash."""
    return F.regexp_extract(p, r"(?s)^(.*/)", 1)


def _keys(rules: DataFrame) -> DataFrame:
    own = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict").where("rule_host <> ''")
    key = F.sha2(F.concat("rule_host", _folder(F.col("rule_path"))), 256)
    return own.withColumn("rule_digest", key).withColumn("prefix", F.substring("rule_digest", 1, PREFIX))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of pages.

    rules(host, path, verdict), a verdict being block or else allow: a rule fits
    its host and all subdomains where the url's path starts with the rule's. The
    longest wins, by the characters of host and path together; at a tie the
    longer host, then block. Where none fits, rule is null and the verdict is
    the default.

    Each url expands into its host suffixes and its path prefixes that end in a
    slash, as deep as the rules go, and is hashed and joined where it was read;
    only its best rule, as a number, goes through a shuffle. Rows are judged one
    by one, so ids may be null or repeat. Null, empty and odd urls have an empty
    host, which no rule fits; very long ones expand no deeper than the rules. An
    empty table gives no rows; other columns are not read.
    """
    keys = _keys(rules)
    depth = keys.agg(
        F.count("*").alias("n"),
        F.coalesce(F.max(F.size(F.split("rule_host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split(_folder(F.col("rule_path")), "/")) - 1), F.lit(0)).alias("folders"),
    ).first()
    # lengths of host and path name the rule within a url that it fits
    chars = F.length("rule_host").cast("long")
    rank = F.call_function("shiftleft", F.length("rule_path") + chars, F.lit(32)) + 2 * chars + F.when(F.col("verdict") == "block", 1).otherwise(0)
    keys = keys.select("prefix", "rule_digest", "rule_path", rank.alias("rank"))

    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    labels, folders = F.split("host", r"\."), F.split(_folder(F.col("path")), "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, depth.labels)))), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(folders) - 1, F.lit(depth.folders))), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(folders, 1, k), "/"), F.lit("/"))))
    expressions = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    expanded = rows.withColumn("digest", F.explode(F.transform(expressions, lambda e: F.sha2(e, 256)))).withColumn("prefix", F.substring("digest", 1, PREFIX))

    on = ["prefix"]
    if depth.n <= BROADCAST_RULES:
        keys = F.broadcast(keys)
    else:  # an expression such as com/ may come from a third of all urls
        keys = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        expanded = expanded.withColumn("salt", F.pmod("_row", F.lit(SALT)).cast("int"))
        on.append("salt")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    best = expanded.join(keys, on, "left").groupBy("_row", "page_id", "host", "path").agg(F.max(F.when(fits, F.col("rank"))).alias("rank"))

    whole, of_host = F.call_function("shiftright", "rank", F.lit(32)).cast("int"), (F.call_function("shiftright", "rank", F.lit(1)).bitwiseAND(F.lit((1 << 31) - 1))).cast("int")
    rule = F.concat(F.expr("right(host, _of_host)"), F.expr("left(path, _whole - _of_host)"))
    out = best.withColumns({"_whole": whole, "_of_host": of_host})
    verdict = F.when(F.col("rank").isNull(), F.lit(default)).when(F.col("rank") % 2 == 1, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
