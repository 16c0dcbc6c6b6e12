"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

A list has entries (host, path prefix, verdict, kind): rules, of which the longest that fits a URL
decides, and listed canonical URLs, which block what no rule fits.  An entry fits its host and all
subdomains, and paths that start with its path.  A URL's canonical forms are its host's last labels
with a prefix of its path, for the few shapes (number of labels, length of path) that the list has.

The filter is a table of 256-bit blocks, one bit in each of four words per entry.  Up to ``IN_PLAN``
blocks it is part of the plan and a URL's forms are thinned before they become rows; a larger one is
joined by block.  Canonical forms whose bits are all set meet the list in an exact join that removes
false positives.  Each URL also sends a header row, so one shuffle by row gives every URL its verdict;
neither hot hosts nor hot URLs meet in one task.

Cases: null URLs and those without ``://`` have an empty host and path and get the method's verdict;
repeated rows give a row each; null page_ids stay; an empty table gives an empty result; columns
other than page_id and url are ignored; an empty list allows everything; an entry that stands in the
list with both verdicts blocks; entries without a host, path, verdict or kind, or with a host that no URL
can have, are left out.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, few

BITS_PER_ENTRY = 24
#: The most blocks of a filter that is part of the plan; 512 KiB.
IN_PLAN = 1 << 14
ENTRIES = "host string, path string, verdict string, kind string"
#: The stated rules, and listed canonical URLs of hosts that sell by spam (fixed values).
RULES = [("com", "/en/", "block", "rule"), ("example.com", "/en/7", "allow", "rule"), ("net", "/de/", "allow", "rule"), ("example.net", "/de/8", "block", "rule"), ("org", "/es/", "block", "rule")]
LISTED = [(f"{name}.example.{top}", "/", "block", "listed") for name in ("cheap-pills", "spam-farm") for top in ("com", "net", "org")]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def canonical(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every row, with a row number for this plan."""
    after = F.when(F.instr("url", "://") > 0, F.substring("url", F.instr("url", "://") + 3, F.length("url")))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return pages.select(F.monotonically_increasing_id().alias("row"), "page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def read_list(spark: SparkSession, path: str, kind: str = "listed") -> DataFrame:
    """Entries of a list in text files: a URL or a host a line, ``#`` and ``!`` begin remarks.

    Scheme, port, query and fragment are dropped; a host without a path stands for all of its paths.
    """
    line = F.trim(F.split_part("value", F.lit(" #"), F.lit(1)))
    lines = spark.read.text(path).select(line.alias("line")).filter("line <> '' and substr(line, 1, 1) not in ('#', '!')")
    plain = F.regexp_replace("line", r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.translate(F.regexp_replace(F.regexp_extract(plain, r"^([^/?#]*)", 1), r":[0-9]+$", ""), _UPPER, _UPPER.lower())
    at = F.regexp_extract(plain, r"^[^/?#]*([^?#]*)", 1)
    return lines.select(host.alias("host"), F.when(at == "", "/").otherwise(at).alias("path"), F.lit("block").alias("verdict"), F.lit(kind).alias("kind"))


def _bits(key):
    h = F.xxhash64(F.lit(7), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int")) for i in range(4)]


def _block(key, blocks: int):
    return F.pmod(F.xxhash64(F.lit(11), key), F.lit(blocks))


def bloom(entries: DataFrame, blocks: int) -> DataFrame:
    """block, w0..w3 of a filter over the entries' keys."""
    return entries.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*[F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))])


def _in_plan(table: DataFrame, blocks: int):
    """A test of keys against a filter whose words are part of the plan."""
    words = [0] * (4 * blocks)
    for row in table.collect():  # a row for each block, IN_PLAN at most
        words[4 * row[0] : 4 * row[0] + 4] = row[1:]
    made = F.from_json(F.lit(str(words)), "array<bigint>")

    def passes(key):
        at = (_block(key, blocks) * 4).cast("int")
        out = F.lit(True)
        for i, bit in enumerate(_bits(key)):
            out &= F.get(made, at + i).bitwiseAND(bit) != 0
        return out

    return passes


def forms(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """A URL's canonical forms: its host's last labels with a prefix of its path, of each shape."""
    table = F.from_json(F.lit(json.dumps([{"labels": a, "chars": b} for a, b in shapes])), "array<struct<labels:int,chars:int>>")
    labels = F.size(F.split(host, r"\."))

    def form(s):
        made = F.concat(F.call_function("substring_index", host, F.lit("."), -s["labels"]), F.substring(path, F.lit(1), s["chars"]))
        return F.when((labels >= s["labels"]) & (F.length(path) >= s["chars"]), made)

    return F.array_compact(F.transform(table, form))


def judge(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict (and listed: whether a listed URL fits) of every row."""
    sound = F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull() & F.col("kind").isNotNull() & ~F.col("host").rlike("[/?#]")
    listed = entries.filter(sound).groupBy("host", "path", "kind").agg(F.max("verdict").alias("verdict"))  # block comes after allow
    entries = cut(listed.withColumn("key", F.concat("host", "path")), "urls")
    # as many as there are lengths of paths for a number of labels, whatever the list's size
    shapes = sorted((r[0], r[1]) for r in entries.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect())
    blocks = entries.count() * BITS_PER_ENTRY // 256 + 1
    rows = canonical(pages)
    table = bloom(entries, blocks)
    made = forms(F.col("host"), F.col("path"), shapes) if shapes else F.array().cast("array<string>")
    known = F.filter(made, _in_plan(table, blocks)) if blocks <= IN_PLAN else made
    # the first form is the header: a null that every row has
    sent = rows.withColumn("forms", F.concat(F.array(F.lit(None).cast("string")), known)).select("row", "page_id", "host", "path", F.explode("forms").alias("form"))
    if blocks > IN_PLAN:
        probe = sent.join(few(table, 4_000_000), F.col("block") == _block(F.col("form"), blocks), "left")
        passed = F.lit(True)
        for i, b in enumerate(_bits(F.col("form"))):
            passed &= F.col(f"w{i}").bitwiseAND(b) != 0
        sent = probe.filter(F.col("form").isNull() | passed).select("row", "page_id", "host", "path", "form")
    exact = few(entries.select("key", "verdict", "kind"), 1_000_000)
    hits = sent.join(exact, sent["form"] == exact["key"], "left").filter("form is null or key is not null")
    rule = F.when(F.col("kind") == "rule", F.struct(F.length("key").alias("n"), "key", "verdict"))
    judged = hits.groupBy("row", "page_id", "host", "path").agg(F.max(rule).alias("best"), F.coalesce(F.bool_or(F.col("kind") == "listed"), F.lit(False)).alias("listed"))
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), "listed")
