"""Benchmark decontamination with a positional inverted index.

The index stores a posting (row, place) for every word of every training text that stands in some
benchmark window.  A window is 10 consecutive words of an item (a shorter item is one window).  Its
words are ordered by their number of postings: the rarest word's postings, less its offset in the
window, are the candidate starts; they are intersected with the offset-adjusted postings of the next
rarest word, and then with all others at once, in the rows that are left.  What survives stands in
the text word by word.  ``near`` finds what is nearly a window, from the words around
each of its rarest ones.

Everything is joins and sums on (row, place): a very common word is spread over its rows, and a
window costs its rarest word's postings.  Window tables are broadcast if they are measured to be
small.  Words are compared by 64-bit hashes.

Cases: null text has no words; null items match nothing, and items without an id count in no list;
repeated rows give a row each; null doc_ids stay; an empty benchmark leaves all clean; empty
documents give an empty result; columns other than doc_id, text and item_id, text are ignored, and
``drop_contaminated`` returns them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, few, letter_words, packed, probe, text_key, unpacked

SPAN, SLOP, SHARE = 10, 3, 0.8


def windows(benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """window (id), terms (hashes in order) and items (ids) of every distinct benchmark window."""
    terms = F.transform("words", lambda w: F.xxhash64(w))
    items = benchmark.select("item_id", letter_words(F.col("text")).alias("words")).filter(F.size("words") > 0).select("item_id", terms.alias("terms"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("terms") - span + 1, F.lit(1)))
    each = items.select("item_id", "terms", F.explode(starts).alias("at")).select("item_id", F.expr(f"slice(terms, at, {span})").alias("terms"))
    return each.groupBy("terms").agg(F.collect_set("item_id").alias("items")).select(F.xxhash64("terms").alias("window"), "terms", "items")


def index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (row, pos, term) of ``terms``, and a row with pos -1, doc_id, key and n_words per text.

    A text's words are thinned to those that may be among the terms before they become rows.
    """
    maybe = probe(terms, "term")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_key(F.col("text")).alias("key"), F.transform(letter_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    posting = "struct<pos:int,term:bigint>"
    head = F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("long").alias("term")).cast(posting)
    places = F.array_compact(F.transform("h", lambda t, i: F.when(maybe(t), F.struct(i.alias("pos"), t.alias("term")).cast(posting))))
    marked = texts.select("row", "doc_id", "key", F.size("h").cast("long").alias("n_words"), F.explode(F.concat(F.array(head), places)).alias("x")).select("row", "doc_id", "key", "n_words", "x.*")
    known = terms.select(F.col("term").alias("_term"))
    is_head = F.col("pos") < 0
    found = marked.join(few(known, 1_000_000), F.col("term") == F.col("_term"), "left").filter(is_head | F.col("_term").isNotNull())
    return found.select("row", "pos", "term", *[F.when(is_head, F.col(c)).alias(c) for c in ("doc_id", "key", "n_words")])


def ranked(wins: DataFrame, postings: DataFrame) -> DataFrame:
    """Windows whose words all have postings; ``by`` is their (postings, offset, term), rarest first."""
    counts = postings.filter("pos >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = wins.select("window", "items", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term"))
    counted = each.join(few(counts, 1_000_000), "term")
    whole = counted.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by"), F.first("items").alias("items"))
    return whole.filter(F.size("by") == F.col("length"))


def candidates(order: DataFrame, postings: DataFrame) -> DataFrame:
    """row, window and start: where the windows of each posting of their rarest word would begin."""
    first = few(order.select("window", F.col("by")[0]["term"].alias("term"), F.col("by")[0]["off"].alias("off")), 1_000_000)
    return postings.filter("pos >= 0").select("row", "pos", "term").join(first, "term").select("row", "window", (F.col("pos") - F.col("off")).alias("start")).filter("start >= 0")


def phrases(order: DataFrame, postings: DataFrame) -> DataFrame:
    """row, window, start and length of every exact occurrence of a window."""
    places = postings.filter("pos >= 0").select(F.col("row").alias("_row"), F.col("pos").alias("_pos"), F.col("term").alias("_term"))
    there = (F.col("row") == F.col("_row")) & (F.col("p") == F.col("_pos")) & (F.col("t") == F.col("_term"))
    found = cut(candidates(order, postings), "candidates")
    next_ = few(order.select("window", "length", F.get("by", F.lit(1))["term"].alias("t"), F.get("by", F.lit(1))["off"].alias("off")), 1_000_000)
    tried = found.join(next_, "window").select("row", "window", "start", "length", "t", (F.col("start") + F.col("off")).alias("p"))
    rare = places.join(few(order.filter("length > 1").select(F.col("by")[1]["term"].alias("_term")).distinct(), 1_000_000), "_term", "left_semi")
    left = cut(tried.filter("length > 1").join(rare, there, "left_semi").select("row", "window", "start", "length"), "second")
    others = few(order.filter("length > 2").select("window", F.explode(F.slice("by", F.lit(3), F.size("by"))).alias("x")).select("window", F.col("x.off").alias("off"), F.col("x.term").alias("t")), 4_000_000)
    rest = left.filter("length > 2").join(others, "window").select("row", "window", "start", "length", "t", (F.col("start") + F.col("off")).alias("p"))
    rows = few(left.select(F.col("row").alias("_row")).distinct(), 1_000_000)
    all_there = rest.join(places.join(rows, "_row", "left_semi"), there).groupBy("row", "window", "start", "length").agg(F.count(F.lit(1)).alias("n")).filter("n = length - 2").drop("n")
    short = tried.filter("length = 1").select("row", "window", "start", "length")
    return short.unionByName(left.filter("length = 2")).unionByName(all_there)


def proximity(order: DataFrame, postings: DataFrame, slop: int = 3, share: float = 0.8) -> DataFrame:
    """row, window, start and found: places where at least ``share`` of a window's words, its rarest
    among them, stand within ``slop`` places of where they belong.  ``near`` needs no certain word."""
    each = candidates(order, postings).join(order.select("window", "length", F.explode("by").alias("x")), "window")
    want = each.select("row", "window", "start", "length", F.col("x.off").alias("off"), F.col("x.term").alias("term"), (F.col("start") + F.col("x.off")).alias("p"))
    want = want.withColumn("cell", F.explode(F.sequence(F.floor((F.col("p") - slop) / (slop + 1)), F.floor((F.col("p") + slop) / (slop + 1)))))
    there = postings.filter("pos >= 0").select("row", "term", "pos", F.floor(F.col("pos") / (slop + 1)).alias("cell"))
    hit = want.join(there, ["row", "term", "cell"]).filter(F.abs(F.col("pos") - F.col("p")) <= slop)
    return hit.groupBy("row", "window", "start", "length").agg(F.count_distinct("off").alias("found")).filter(F.col("found") >= F.col("length") * share)


def near(docs: DataFrame, wins: DataFrame, postings: DataFrame, slop: int = SLOP, share: float = SHARE) -> DataFrame:
    """_id, _key and near_items of every text in which ``share`` of a window's words stand near their places.

    Of the rarest words, one more than may be missing, at least one stands in such a place; every
    posting of each of them is tried with the words around it, of which all others are taken within
    ``slop`` places of where they belong from there.  Words that no text has count as missing.
    """
    counts = postings.filter("pos >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    each = wins.select("window", "items", F.size("terms").alias("length"), F.posexplode("terms").alias("off", "term"))
    counted = each.join(few(counts, 1_000_000), "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = counted.groupBy("window", "length").agg(F.array_sort(F.collect_list(F.struct("n", "off", "term"))).alias("by"), F.first("items").alias("items"))
    order = order.withColumn("need", F.ceil(F.round(F.col("length") * F.lit(share), 6)).cast("int")).withColumn("seeds", F.col("length") - F.col("need") + 1)
    seeds = order.select("window", "items", "length", "need", "seeds", "by", F.posexplode(F.slice("by", F.lit(1), F.col("seeds"))).alias("k", "x"))
    # one more of the rarest words is there too, where two are needed at all
    others = F.filter(F.slice("by", F.lit(1), F.col("seeds") + 1), lambda y: y["off"] != F.col("x.off"))
    words = F.transform("by", lambda y: F.struct((y["off"] - F.col("x.off")).alias("d"), y["term"].alias("term")))
    distinct = F.array_distinct(F.transform("by", lambda y: y["term"]))
    table = cut(seeds.select("items", "need", distinct.alias("distinct"), (F.size(distinct) - F.col("seeds") + 1).alias("least"), F.col("x.term").alias("_term"), F.transform(others, lambda y: y["term"]).alias("others"), words.alias("words")), "seeds")
    maybe = probe(table.select("_term").distinct(), "_term")
    reach = wins.agg(F.max(F.size("terms"))).first()[0] or 0
    pad = F.array_repeat(F.lit(0).cast("long"), reach + slop)
    texts = docs.select(F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"), F.transform(letter_words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    padded = texts.select("_id", "_key", "h", F.concat(pad, "h", pad).alias("wide"))
    width = 2 * (reach + slop) + 1
    # only the words around a place of a rarest word are taken along
    around = F.transform("h", lambda t, i: F.when(maybe(t), F.struct(t.alias("term"), F.slice("wide", i + 1, F.lit(width)).alias("around"))))
    places = padded.select("_id", "_key", F.explode(F.array_compact(around)).alias("p")).select("_id", "_key", "p.term", "p.around")
    tried = places.join(few(table, 1_000_000), F.col("term") == F.col("_term")).filter((F.col("need") == 1) | F.arrays_overlap("around", "others"))
    middle = reach + slop + 1
    there = F.filter("words", lambda y: F.when(y["d"] == 0, F.lit(True)).otherwise(F.array_contains(F.slice("around", y["d"] + (middle - slop), F.lit(2 * slop + 1)), y["term"])))
    found = tried.filter(F.size(F.array_intersect("around", "distinct")) >= F.col("least")).filter(F.size(there) >= F.col("need"))
    per_item = found.select("_id", "_key", F.explode_outer("items").alias("item")).distinct()
    return per_item.groupBy("_id", "_key").agg(F.count("item").alias("near_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, key, n_words, n_hit, n_items, items_sha256 and contaminated (exact matches), near_items and
    near (proximity matches, exact ones among them) of every row."""
    wins = cut(windows(benchmark, span), "windows")
    postings = cut(index(docs, wins.select(F.explode("terms").alias("term")).distinct()), "postings")
    order = cut(ranked(wins, postings), "order")
    found = cut(phrases(order, postings), "phrases")
    by_start = Window.partitionBy("row").orderBy("start", "length")
    reached = F.coalesce(F.max(F.col("start") + F.col("length")).over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest("start", reached))
    hit = found.withColumn("new", new).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = found.select("row", "window").distinct().join(few(order.select("window", "items"), 1_000_000), "window").select("row", F.explode("items").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_row = hit.join(named, "row", "left")
    texts = postings.filter("pos = -1").select("row", "doc_id", "key", "n_words").join(per_row, "row", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    close = near(docs, wins, postings)
    texts = texts.join(close, texts["doc_id"].eqNullSafe(F.col("_id")) & (texts["key"] == F.col("_key")), "left")
    return texts.select("doc_id", "key", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.coalesce("near_items", F.lit(0)).alias("near_items"), F.col("near_items").isNotNull().alias("near"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = SPAN) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window stands, word by word or nearly."""
    out = decontaminate(docs, benchmark, span).filter("contaminated or near").select(F.col("doc_id").alias("_fw_of"), F.col("key").alias("_fw_with")).distinct()
    bad = cut(out, "contaminated")
    small = few(bad, 1_000_000)
    rows = packed(docs)
    return unpacked(rows.join(small if small is not bad else bad.hint("shuffle_hash"), rows["_fw_id"].eqNullSafe(F.col("_fw_of")) & (rows["_fw_key"] == F.col("_fw_with")), "left_anti"))
