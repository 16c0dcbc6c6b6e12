"""Substring dedup by sliding sentence spans.

A text is cut into sentences (at . ! ? and line ends), and a sentence of more than ``EVERY`` words
before the word of least checksum of any ``EVERY`` words in it.  What ``EVERY`` words decide is the
same in every copy, whatever stands around it, and no part has more words, so texts that share 42
words share a run; of a passage that starts or ends inside a sentence, a few words at that end may
belong to a part that differs and stay.  The
shortest runs of at least ``SENTENCES`` sentences and ``WORDS`` words from each sentence on, and up to
each sentence, are hashed without regard to case and white space.  Runs are joined globally; of each hash that stands in
several places, all runs but the first (by doc_id, then text, then place) are covered, and covered
sentences are removed.

A run that stands in its own text before needs no join.  The others are combined by hash before the
shuffle, hashes that stand twice are joined back by one path at every size, and a passage that a
third of all texts share is a hot join key there that adaptive execution splits.

Cases: null text stays null, empty and short texts stay as they are; rows that repeat both id and
text count as one text and are treated alike; null doc_ids are last in order; an empty table gives an
empty result; ``deduplicate`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, text_key

SENTENCES, WORDS, EVERY = 2, 20, 8
SENTENCE = re.compile(r"[^.!?\n]*(?:[.!?]+[\"')\]]*\s*|\n\s*|\Z)")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same words in a text whose A-Z are as they were.
START = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cuts(words: list[bytes]) -> list[int]:
    """The words of a sentence before which it is cut: the first least checksum of any ``EVERY`` words."""
    out: list[int] = []
    if len(words) <= EVERY:
        return out
    marks, least = list(map(zlib.crc32, words)), 0  # the first word starts a part anyway
    for i in range(EVERY, len(words)):
        if not least or i - least >= EVERY:
            least = marks.index(min(marks[least + 1 : i + 1]), least + 1)
        elif marks[i] < marks[least]:
            least = i
        else:
            continue
        out.append(least)
    return out


def _sentences(text: str) -> Iterator[tuple[str, list[bytes], list[int]]]:
    """Each sentence with its words in lower case and its cuts."""
    for part in SENTENCE.findall(text):
        if part:
            words = WORD.findall(part.encode("utf-8", "surrogatepass").lower())
            yield part, words, cuts(words)


def sentences(text: str) -> list[str]:
    """The parts of ``text``; joined, they are the text again."""
    out = []
    for part, _, inner in _sentences(text):
        if inner:
            starts = [m.start() for m in START.finditer(part)]
            at = [0, *(starts[i] for i in inner), len(part)]
            out += [part[a:b] for a, b in pairwise(at)]
        else:
            out.append(part)
    return out


def runs(text: str, least_sentences: int = SENTENCES, least_words: int = WORDS) -> Iterator[tuple[int, int, int]]:
    """(first sentence, number of sentences, hash) of the shortest run that starts, and of the
    shortest that ends, at each sentence of the text; each run once.

    Both lie in every longer run from or to there, so together they cover any repeated run whole.
    Parts without a word begin and end no run, and don't count as sentences: with one more of them a
    run would have the same words twice in one place.
    """
    import xxhash

    total, words, at = [0], [], []  # words up to the end of each sentence with words, and its place
    place = 0
    for _, some, inner in _sentences(text):
        starts = [0, *inner]
        at += range(place, place + len(starts)) if some else ()
        place += len(starts)
        if some:
            total += [len(words) + i for i in inner]
            words += some
            total.append(len(words))
    n = len(total) - 1
    ends = [0, *accumulate(len(w) + 1 for w in words)]
    joined, byte = b" ".join(words), [ends[k] for k in total]

    def run(i: int, end: int) -> tuple[int, int, int]:
        h = xxhash.xxh64_intdigest(joined[byte[i] : byte[end] - 1])
        return at[i], at[end - 1] - at[i] + 1, h - (1 << 64) if h >> 63 else h

    last = -1  # the last sentence from which a run can end at ``end``
    for end in range(least_sentences, n + 1):
        known = last
        while end - last > least_sentences and total[end] - total[last + 1] >= least_words:
            last += 1
            yield run(last, end)
        if last == known >= 0:
            yield run(last, end)


def _runs(batches):
    """place, at and h of every run; a run that stood in its text before has no h, as no join need tell."""
    import pyarrow as pa

    for batch in batches:
        source, at, h = [], [], []
        for row, text in enumerate(batch.column(1)):
            seen: set[int] = set()
            for i, n, value in runs(text.as_py() or ""):
                source.append(row)
                at.append(i << 32 | n)
                h.append(None if value in seen else value)
                seen.add(value)
        if at:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int32())), pa.array(at, pa.int64()), pa.array(h, pa.int64())], ["place", "at", "h"])


def place(doc_id: Column, text: Column) -> Column:
    """One number per text, in order of doc_id (null last) and then of the text's 62-bit hash.

    A number and not a struct, so that the least place of a hash is found by hash aggregation.
    """
    low = text_key(text).bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(19,0)")
    high = F.coalesce(doc_id.cast("long").cast("decimal(19,0)"), F.lit("9500000000000000000").cast("decimal(19,0)"))
    return (high * F.lit("10000000000000000000").cast("decimal(20,0)") + low).cast("decimal(38,0)")


def covered(docs: DataFrame) -> DataFrame:
    """place and spans (first sentence << 32 | number) of every text with repeated runs."""
    texts = docs.select(place(F.col("doc_id"), F.col("text")).alias("place"), "text")
    found = cut(arrow_rows(texts).mapInArrow(_runs, "place decimal(38,0), at long, h long"), "runs")
    once = found.filter("h is not null")
    # a text's rows may repeat: places are compared, not counted
    many = once.groupBy("h").agg(F.min("place").alias("first"), F.max("place").alias("end")).filter("first <> end").select("h", "first")
    elsewhere = once.join(many, "h").filter("place <> first").select("place", "at")
    again = elsewhere.unionAll(found.filter("h is null").select("place", "at"))
    return again.groupBy("place").agg(F.collect_set("at").alias("spans"))


def removal(docs: DataFrame) -> DataFrame:
    """``docs`` with what is removed as ``_fw_cut``: text left, n_sentences, n_removed, words_removed."""
    spans = cut(covered(docs).select(F.col("place").alias("_fw_of"), F.col("spans").alias("_fw_spans")), "spans")
    keyed = docs.withColumn("_fw_place", place(F.col("doc_id"), F.col("text")))
    joined = keyed.join(spans.hint("shuffle_hash"), F.col("_fw_place") == F.col("_fw_of"), "left")

    @F.pandas_udf("text string, n_sentences long, n_removed long, words_removed long")
    def clean(texts, spans):
        import pandas as pd

        rows = []
        for text, some in zip(texts, spans, strict=True):
            if text is None:
                rows.append((None, 0, 0, 0))
                continue
            if some is None:
                rows.append((text, sum(len(inner) + 1 for _, _, inner in _sentences(text)), 0, 0))
                continue
            parts = sentences(text)
            gone = bytearray(len(parts))
            for s in some:
                first, n = int(s) >> 32, int(s) & 0xFFFFFFFF
                gone[first : first + n] = b"\1" * n
            rows.append(("".join(p for p, g in zip(parts, gone, strict=True) if not g), len(parts), sum(gone), sum(len(WORD.findall(p.lower().encode("utf-8", "surrogatepass"))) for p, g in zip(parts, gone, strict=True) if g)))
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed", "words_removed"])

    arrow_rows(docs)
    return joined.select(*docs.columns, clean("text", "_fw_spans").alias("_fw_cut"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages removed from the texts; texts that vanish stay as empty ones."""
    return removal(docs).select(*[F.col("_fw_cut.text").alias("text") if c == "text" else F.col(c) for c in docs.columns])
