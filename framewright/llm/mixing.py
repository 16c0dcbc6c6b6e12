"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a word target: the targets share 150% of all words by the sources' weights, none
over twice its source.  A document's expected copies are target / source size, whole copies first;
the fractional rest is rounded by a pivotal method that keeps a source's word mass: two documents
pass mass to each other, at random but without bias, until one of them has no fraction left.

Rows that repeat an id and a text are one item of the rounding, with the sum of their copies: they
are counted before the shuffle, so a repeated row is never a hot key, and the sum is dealt over the
rows as evenly as it goes.

Items are dealt to blocks of about BLOCK by a hash of their id, so a source that holds a third of all
rows is as many blocks as its rows need.  A block's rounding leaves at most one fraction; these
residuals form the next, BLOCK times smaller level, until a source has one residual, which is rounded
alone.  A source's words so miss its target by less than one document.

A document with over 1/HEAVY of a source's words could move the source far from its target, so these
(HEAVY a source at most) are rounded first, and the others share what is left of the target.  The
chances stay: rounding is unbiased, so a heavy document's expected copies are target / size, the
words that the heavy ones take have the expectation target * (their share), and the others' rate, which
is linear in them, has the expectation target / size as well.  Only where the heavy documents of a
source take more, or less, than the others could make up for (a rate under 0 or over ``cap``) does the
rate stay at that bound.  Whatever the order, the miss is below 1/HEAVY of the source or one document.

Cases: null text has size 0 and is never taken, like a text without words; null sources are one
source, last in order; an empty table gives an empty one.  Only ``doc_id``, ``text`` and ``source`` are
read, whatever other columns there are; ``mix`` returns them all, whatever their names.  All choices
come from hashes of ids, sizes and ``seed``, so reruns agree.  The sources' totals are ordered in one
task: a row for each source, however many documents there are.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, packed, plain_words, text_key, unpacked

BLOCK = 256
HEAVY = 64
#: Rows of a repeated document that are written out at once.
SLICE = 1 << 16


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, key (of the text) and size in words of every row."""
    return docs.select("doc_id", "source", text_key(F.col("text")).alias("key"), F.size(plain_words(F.col("text"))).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: rank (code-point order, null last), source, n_docs (items), source_size, target.

    Water filling: a source stays at ``cap`` times its size if its share is above that, and its
    excess is dealt to the others by weight.  With sources ordered by cap / weight, the final level
    is the largest of the levels that remain after each prefix is capped.
    """
    by_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("size") * F.col("n")).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = by_source.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", "rank")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    leveled = ranked.withColumn("level", level)
    top = F.max("level").over(everything)
    return leveled.select("rank", "source", "n_docs", "source_size", F.least("most", top * F.col("weight")).alias("target"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), then)[0]


def _unit(*parts) -> Column:
    """A hash of the parts as a number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def _unfold(item: Column, p: Column) -> Column:
    return F.struct(item["less"].alias("less"), item["h"].alias("h"), item["doc_id"].alias("doc_id"), item["key"].alias("key"), item["size"].alias("size"), item["n"].alias("n"), item["base"].alias("base"), p.alias("p"))


def _taken(item: Column, p: Column) -> Column:
    return F.struct(item["doc_id"].alias("doc_id"), item["key"].alias("key"), item["size"].alias("size"), item["n"].alias("n"), (item["base"] + (p >= 0.5).cast("long")).alias("copies"))


def _pivot(items: Column, seed: int) -> Column:
    """Round an array of fractions pairwise; leaves ``out`` (decided) and ``carry`` (one residual)."""

    def step(acc, x):
        c = acc["carry"]

        def decide(m):
            p_c = F.when(m["rise"], c["p"] + m["up"] / c["size"]).otherwise(c["p"] - m["down"] / c["size"])
            p_x = F.when(m["rise"], x["p"] - m["up"] / x["size"]).otherwise(x["p"] + m["down"] / x["size"])
            return F.when(m["c_ends"], F.struct(_unfold(x, p_x).alias("carry"), F.concat(acc["out"], F.array(_taken(c, p_c))).alias("out"))).otherwise(
                F.struct(_unfold(c, p_c).alias("carry"), F.concat(acc["out"], F.array(_taken(x, p_x))).alias("out"))
            )

        room_c, mass_c, room_x, mass_x = c["size"] * (1 - c["p"]), c["size"] * c["p"], x["size"] * (1 - x["p"]), x["size"] * x["p"]
        masses = F.struct(F.least(room_c, mass_x).alias("up"), F.least(mass_c, room_x).alias("down"), (room_c <= mass_x).alias("c_full"), (mass_c <= room_x).alias("c_empty"), _unit(F.lit(seed), c["h"], x["h"]).alias("u"))

        def choose(m):
            rise = m["u"] * (m["up"] + m["down"]) < m["down"]
            return F.struct(m["up"].alias("up"), m["down"].alias("down"), rise.alias("rise"), F.when(rise, m["c_full"]).otherwise(m["c_empty"]).alias("c_ends"))

        return _let(_let(masses, choose), decide)

    first = items[0]
    none = F.filter(F.array(_taken(first, first["p"])), lambda _: F.lit(False))
    start = F.struct(_unfold(first, first["p"]).alias("carry"), none.alias("out"))
    return F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, step)


def copies(sized: DataFrame, by_source: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """rank, doc_id, key, size, n and copies of every item; ``by_source``: n_docs, source_size, target of a rank."""
    item = ("rank", "doc_id", "key", "size", "n")
    joined = sized.select(*item).join(few(by_source.select("rank", "n_docs", "source_size", "target"), 100_000), "rank")
    rate = F.col("n") * F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = joined.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("long")).withColumn("p", F.col("rate") - F.col("base"))
    open_ = (F.col("size") > 0) & (F.col("p") > 1e-12)
    done = [plan.filter(~open_).select(*item, F.when(F.col("size") > 0, F.col("base")).otherwise(F.lit(0)).alias("copies"))]
    left = plan.filter(open_).withColumn("size", F.col("size").cast("double")).withColumn("less", -F.col("size")).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "key")).withColumn("blocks", F.ceil(F.col("n_docs") / block))
    most = by_source.agg(F.max("n_docs")).first()[0] or 0
    while most > 0:
        items = F.sort_array(F.collect_list(F.struct("less", "h", "doc_id", "key", "size", "n", "base", "p")))
        dealt = left.withColumn("block", F.pmod(F.xxhash64("h", F.lit(most)), F.col("blocks")))
        folded = dealt.groupBy("rank", "block", "blocks").agg(items.alias("items")).select("rank", "blocks", _pivot(F.col("items"), seed).alias("r"))
        folded = cut(folded.select("rank", "blocks", "r.carry", "r.out"), "mix")
        done.append(folded.select("rank", F.inline("out")).withColumn("size", F.col("size").cast("long")))
        last = F.col("carry.base") + (_unit(F.lit(seed), F.lit(1), F.col("carry.h")) < F.col("carry.p")).cast("long")
        done.append(folded.filter("blocks = 1").select("rank", "carry.doc_id", "carry.key", F.col("carry.size").cast("long").alias("size"), "carry.n", last.alias("copies")))
        left = folded.filter("blocks > 1").select("rank", "carry.*", F.ceil(F.col("blocks") / block).alias("blocks"))
        most = 0 if most <= block else ceil(most / block)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def plan_items(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17) -> DataFrame:
    """source, rank, doc_id, key, size, n (rows), source_size, target, and copies (of all n rows) of every item."""
    counted = sizes(docs).groupBy("source", "doc_id", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    sized = cut(counted, "sizes")
    by_source = cut(targets(sized, weights, share, cap), "targets")
    each = few(by_source.select("rank", F.col("source").alias("_source"), F.col("source_size").alias("_all"), F.col("target").alias("_target")), 100_000)
    named = sized.join(each, sized["source"].eqNullSafe(F.col("_source"))).drop("_source", "source")
    heavy, light = named.filter(f"size * {HEAVY} > _all"), named.filter(f"not size * {HEAVY} > _all")

    def part(of: DataFrame, rest: DataFrame | None = None) -> DataFrame:
        """The per-source table of some of the items; they share what ``rest`` leaves of the target."""
        sums = of.groupBy("rank").agg(F.first("_target").alias("_target"), F.first("_all").alias("_all"), F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
        if rest is None:
            return sums.withColumn("target", F.col("_target") * F.col("source_size") / F.col("_all"))
        sums = sums.join(rest.groupBy("rank").agg(F.sum(F.col("size") * F.col("copies")).alias("_gone")), "rank", "left")
        return sums.withColumn("target", F.greatest(F.lit(0.0), F.least(F.col("source_size") * F.lit(cap), F.col("_target") - F.coalesce("_gone", F.lit(0)))))

    first = cut(copies(heavy, cut(part(heavy), "heavy"), seed), "heavy")
    chosen = first.unionByName(copies(light, cut(part(light, first), "light"), seed))
    return chosen.join(few(by_source.select("rank", "source", "source_size", "target"), 100_000), "rank")


def _dealt(rank: Column) -> Column:
    """The copies of the row of this rank (from 0) among the ``n`` rows of its item."""
    n = F.col("n")
    return F.floor(F.col("copies") / n).cast("long") + (rank < F.col("copies") % n).cast("long")


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, key, size, source_size, target, taken (words) and copies of every document."""
    plan = cut(plan_items(docs, **options), "plan")
    kept = ("doc_id", "key", "size", "source_size", "target")
    once = plan.filter("n = 1").select(*kept, "copies")
    # a repeated document's rows: first how many slices of them, then the rows of each slice
    starts = plan.filter("n > 1").withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SLICE)))).withColumn("from", F.col("from") * SLICE)
    spread = starts.repartition("key", "from") if not plan.filter(f"n > {SLICE}").isEmpty() else starts
    ranks = F.sequence(F.col("from"), F.least(F.col("from") + SLICE, F.col("n")) - 1)
    again = spread.withColumn("nth", F.explode(ranks)).select(*kept, _dealt(F.col("nth")).alias("copies"))
    return once.unionByName(again).select(*kept, (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the plan takes it, with the columns of ``docs``.

    Rows that share both id and text take their copies together, some of them one more than others.
    """
    plan = plan_items(docs, **options).filter("copies > 0").select("rank", F.col("source").alias("_fw_from"), F.col("doc_id").alias("_fw_of"), F.col("key").alias("_fw_with"), "n", "copies")
    plan = cut(plan, "plan")
    rows = packed(docs)
    same = rows["_fw_id"].eqNullSafe(F.col("_fw_of")) & (rows["_fw_key"] == F.col("_fw_with")) & F.col("_fw_row.source").eqNullSafe(F.col("_fw_from"))
    taken = rows.join(plan.filter("n = 1").hint("shuffle_hash"), same).withColumn("_fw_copies", F.col("copies"))
    if not plan.filter("n > 1").isEmpty():
        # rows of an item are counted by the part of the table that they stand in, then within it
        again = rows.join(plan.filter("n > 1").hint("shuffle_hash"), same).withColumn("_fw_slot", F.monotonically_increasing_id())
        again = cut(again.withColumn("_fw_part", F.shiftright("_fw_slot", 33)), "again")
        item = ["_fw_id", "_fw_key", "rank"]
        before = F.coalesce(F.sum("_fw_n").over(Window.partitionBy(*item).orderBy("_fw_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        parts = again.groupBy(*item, "_fw_part").agg(F.count(F.lit(1)).alias("_fw_n")).withColumn("_fw_before", before)
        within = again.select(*item, "_fw_part", "_fw_slot", (F.row_number().over(Window.partitionBy(*item, "_fw_part").orderBy("_fw_slot")) - 1).alias("_fw_nth"))
        ranks = within.alias("w").join(parts.alias("p"), (F.col("w._fw_part") == F.col("p._fw_part")) & (F.col("w._fw_key") == F.col("p._fw_key")) & F.col("w._fw_id").eqNullSafe(F.col("p._fw_id")) & (F.col("w.rank") == F.col("p.rank")))
        ranks = ranks.select(F.col("w._fw_slot").alias("_fw_at"), (F.col("_fw_before") + F.col("_fw_nth")).alias("_fw_rank"))
        placed = again.join(ranks, F.col("_fw_slot") == F.col("_fw_at"))
        taken = taken.select("_fw_row", "_fw_copies").unionByName(placed.withColumn("_fw_copies", _dealt(F.col("_fw_rank"))).filter("_fw_copies > 0").select("_fw_row", "_fw_copies"))
    return unpacked(taken.withColumn("_fw_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_fw_copies")))))
