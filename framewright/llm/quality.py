"""Quality rules by weak supervision.

Each rule votes good (1) or bad (-1) on a text, or abstains (0).  Expectation-maximisation over the
histogram of vote patterns estimates how often each rule votes each way on good and on bad texts,
and the share of good texts; a text is kept if its posterior probability of being good is 0.5 or
more and it doesn't fail the base rules.  Votes and histogram cover all texts; the histogram has at
most 3 to the number of rules rows, whatever the corpus, so the driver can hold it.

All columns are SQL expressions of the text: byte searches, one-character splits, and for repeated
three-word windows a sort of (hash, place) packed in one long per window, compared by full hash.

Cases: null text has no words and fails the base rules; repeated rows give a row each; null doc_ids
stay; an empty table gives an empty result; other columns are ignored or, in ``keep_good``, kept as
they are (names that begin with ``_fw_`` are the operator's own).  Without texts that any rule calls
bad, all votes are good votes and nothing is rejected by the posterior.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spaced

SYMBOLS = "#*$%&|<>"
ROUNDS, SMOOTH = 50, 1.0
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts", "n_stops")


def _count(text: Column, found: str) -> Column:
    """How often an ASCII string stands in the text, from left to right."""
    return ((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(found), F.lit("")))) / len(found)).cast("long")


def measure(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of every row and the statistics of its text as ``_fw_stats``."""
    text = F.coalesce("text", F.lit(""))
    out = docs.select(*columns, text.alias("_fw_text")).withColumn("_fw_parts", F.split(spaced(F.col("_fw_text")), " "))
    out = out.withColumn("_fw_words", F.array_remove("_fw_parts", ""))
    n = F.size("_fw_words")
    hashes = F.transform("_fw_words", lambda w: F.xxhash64(w))
    out = out.withColumn("_fw_hashes", hashes)
    two = F.zip_with("_fw_hashes", F.slice("_fw_hashes", F.lit(2), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(two, F.slice("_fw_hashes", F.lit(3), F.greatest(n, F.lit(1))), lambda a, b: F.xxhash64(a, b))
    out = out.withColumn("_fw_windows", F.slice(three, F.lit(1), F.greatest(n - 2, F.lit(0))))
    k = F.size("_fw_windows")
    width = F.length(F.bin(k.cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), width) - 1
    out = out.withColumn("_fw_mask", mask)
    packed = F.transform("_fw_windows", lambda h, i: F.call_function("shiftleft", h, width).bitwiseOR(i.cast("long")))
    out = out.withColumn("_fw_sorted", F.when(F.size(F.array_distinct("_fw_windows")) < k, F.sort_array(packed)))

    def full(x):
        return F.get("_fw_windows", x.bitwiseAND(F.col("_fw_mask")).cast("int"))

    def twice(x, i):
        near = [F.coalesce(full(F.get("_fw_sorted", i + d)) == full(x), F.lit(False)) for d in (-1, 1)]
        return near[0] | near[1]

    places = F.sort_array(F.transform(F.filter("_fw_sorted", twice), lambda x: x.bitwiseAND(F.col("_fw_mask"))))
    out = out.withColumn("_fw_places", places)
    steps = F.transform("_fw_places", lambda p, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get("_fw_places", i + 1) - p, F.lit(3).cast("long"))))
    repeated = F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    t = F.col("_fw_text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    out = out.withColumn("_fw_lines", lines)
    symbols = _count(t, SYMBOLS[0])
    for c in SYMBOLS[1:]:
        symbols = symbols + _count(t, c)
    stats = {
        "n_words": n.cast("long"),
        "word_chars": (F.length(t) - F.size("_fw_parts") + 1).cast("long"),
        "n_symbols": symbols,
        "n_dup_lines": (F.size("_fw_lines") - F.size(F.array_distinct("_fw_lines"))).cast("long"),
        "n_repeat_words": repeated,
        "n_lines": F.size("_fw_lines").cast("long"),
        "n_shouts": _count(t, "!!"),
        "n_stops": _count(t, "."),
    }
    return out.select(*columns, F.struct(*[v.alias(x) for x, v in stats.items()]).alias("_fw_stats"))


def _vote(value: Column, good: tuple, bad: tuple) -> Column:
    """1 inside the range ``good``, -1 outside the range ``bad``, else 0; null abstains."""
    return F.when((value >= good[0]) & (value <= good[1]), 1).when((value < bad[0]) | (value > bad[1]), -1).otherwise(0)


def votes(s: Column) -> dict[str, Column]:
    """The rules, by name, as votes on the statistics ``s``."""
    words = F.when(s["n_words"] > 0, s["n_words"])
    lines = F.when(s["n_lines"] > 0, s["n_lines"])
    most = float("inf")
    return {
        "length": _vote(s["n_words"], (80, most), (50, most)),
        "symbols": _vote(s["n_symbols"] / words, (0, 0.05), (0, 0.2)),
        "symbol_chars": _vote(s["n_symbols"] / F.when(s["word_chars"] > 0, s["word_chars"]), (0, 0.02), (0, 0.1)),
        "word_length": _vote(s["word_chars"] / words, (3, 9), (2, 15)),
        "repeats": _vote(s["n_repeat_words"] / words, (0, 0.2), (0, 0.4)),
        "lines": _vote(s["n_dup_lines"] / lines, (0, 0.1), (0, 0.4)),
        "shouts": _vote(s["n_shouts"] / words, (0, 0.02), (0, 0.2)),
        "stops": _vote(s["n_stops"] / words, (0.01, 0.4), (0.004, 0.6)),
    }


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of good texts and, by rule and vote, its probability on good and on bad texts.

    Starts from texts with a bad vote being bad; ``SMOOTH`` texts of each vote are added.
    """
    rules = len(patterns[0][0]) if patterns else 0
    good = [0.02 if -1 in p else 0.98 for p, _ in patterns]
    share, table = 0.9, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(rules)]
    for _ in range(rounds if patterns else 0):
        mass = [sum(g * n for g, (_, n) in zip(good, patterns, strict=True)), sum((1 - g) * n for g, (_, n) in zip(good, patterns, strict=True))]
        share = (mass[0] + 9 * SMOOTH) / (sum(mass) + 10 * SMOOTH)
        for r in range(rules):
            sums = {v: [SMOOTH, SMOOTH] for v in (-1, 0, 1)}
            for g, (p, n) in zip(good, patterns, strict=True):
                sums[p[r]][0] += g * n
                sums[p[r]][1] += (1 - g) * n
            table[r] = {v: (s[0] / (mass[0] + 3 * SMOOTH), s[1] / (mass[1] + 3 * SMOOTH)) for v, s in sums.items()}
        good = [1 / (1 + exp(-max(-700, min(700, log(share / (1 - share)) + sum(log(table[r][v][0] / table[r][v][1]) for r, v in enumerate(p)))))) for p, _ in patterns]
    return share, table


def posterior(s: Column, model: tuple) -> Column:
    """The probability that a text of statistics ``s`` is good."""
    share, table = model
    odds = F.lit(log(share / (1 - share)))
    for chances, vote in zip(table, votes(s).values(), strict=False):
        weight = {v: log(a / b) for v, (a, b) in chances.items()}
        odds = odds + F.when(vote == 1, F.lit(weight[1])).when(vote == -1, F.lit(weight[-1])).otherwise(F.lit(weight[0]))
    return 1 / (1 + F.exp(-odds))


def fit(measured: DataFrame) -> tuple:
    named = votes(F.col("_fw_stats"))
    rows = measured.select(*[v.alias(k) for k, v in named.items()]).groupBy(*named).count().collect()
    return expectation_maximisation(sorted((tuple(r[:-1]), r[-1]) for r in rows))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def judge(measured: DataFrame, model: tuple) -> DataFrame:
    """``measured`` with its statistics as columns, base_failed, posterior and kept."""
    s = F.col("_fw_stats")
    out = measured.withColumn("base_failed", base_failed(s)).withColumn("posterior", posterior(s, model))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, posterior and kept of every row."""
    measured = cut(measure(docs, ["doc_id"]), "quality")
    return judge(measured, fit(measured)).select("doc_id", "_fw_stats.*", "base_failed", "posterior", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns; texts are written once beside their statistics."""
    measured = cut(measure(docs, docs.columns), "quality")
    s = F.col("_fw_stats")
    return measured.filter(~base_failed(s) & (posterior(s, fit(measured)) >= 0.5)).select(docs.columns)
