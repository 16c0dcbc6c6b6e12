"""Token counts through a digest cache.

A text's digest is the SHA-256 of the tokenizer's version (the SHA-256 of its file) and of its
normalised content; the cache is a Parquet table of digests and counts.  Rows are joined to the
cache by digest, one text of every digest that misses is encoded, and the new counts are appended.

Normalised content: for tokenizers that lower case and drop white space (see ``chunks.by_chunks``),
A-Z in lower case and each run of ASCII white space as one space, which can't change their count; a
text with ``<|`` in it stays as it is, as special strings are found in the raw text.

Copies are dropped in each input partition before a text is shuffled, so a group of copies that
holds a third of all rows sends one text per partition.  Rows meet their counts in a join of slim
rows; the counts are a table with each digest once, so nothing stands between that join and its
shuffles and adaptive execution splits the rows of a hot digest.

Cases: null text counts as empty (0 tokens, 0 bytes); repeated rows give a row each; null doc_ids
stay; an empty table gives an empty result; other columns are ignored; a cache folder that doesn't
exist is an empty cache; digests that two jobs appended twice are read once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks
from .common import arrow_rows, cut, new_dir

COUNTS = "digest binary, n_tokens long"


def version(tokenizer: str) -> str:
    with open(tokenizer, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def digester(tokenizer: str):
    """A function from a text's UTF-8 bytes to the 32 bytes that it has in the cache."""
    start = hashlib.sha256(version(tokenizer).encode())
    plain = tokenizer.endswith(".json") and chunks.by_chunks(tokenizer) and _lowers(tokenizer)

    def digest(raw: bytes) -> bytes:
        made = start.copy()
        # lower() and split() of bytes know ASCII alone
        made.update(raw if not plain else b"=" + raw if b"<|" in raw else b" ".join(raw.lower().split()))
        return made.digest()

    return digest


def _lowers(tokenizer: str) -> bool:
    import json

    with open(tokenizer, encoding="utf-8") as f:
        steps = (json.load(f).get("normalizer") or {}).get("normalizers", [])
    return any(x["type"] == "Lowercase" for x in steps)


def counter(tokenizer: str):
    """A function from a text to its number of tokens."""
    if tokenizer.endswith(".model"):
        import sentencepiece

        made = sentencepiece.SentencePieceProcessor(model_file=tokenizer)
        return lambda text: len(made.encode(text))
    made = chunks.load(tokenizer)

    def lengths(texts):
        return [len(x) for x in made.encode_batch(texts, add_special_tokens=False)]

    if chunks.by_chunks(tokenizer):
        memo = chunks.memo_of(tokenizer, "count", lambda: chunks.ChunkMemo(made, len, sum, not _lowers(tokenizer)))
        return lambda text: sum(memo.of(text))
    return lambda text: lengths([text])[0]


def _stored(spark, cache: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(COUNTS).parquet(cache).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; the cache has all digests afterwards."""
    spark = docs.sparkSession
    cache = cache or new_dir(spark, "token-cache")

    def raw(column):
        import pyarrow as pa

        return [x or b"" for x in column.cast(pa.binary()).to_pylist()]

    def rows(batches):
        import pyarrow as pa

        of = digester(tokenizer)
        for batch in batches:
            texts = raw(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(of, texts), pa.binary())], ["doc_id", "n_bytes", "digest"])

    def first_of_each(batches):
        """Texts whose digest this partition has not had; only digests are remembered."""
        import pyarrow as pa

        of, seen = digester(tokenizer), set()
        for batch in batches:
            digests, keep = [], []
            for x in map(of, raw(batch.column(0))):
                keep.append(x not in seen)
                seen.add(x)
                digests.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column(0)], ["digest", "text"]).filter(pa.array(keep, pa.bool_()))

    def count(batches):
        import pyarrow as pa

        n, seen = counter(tokenizer), set()
        for batch in batches:
            digests, numbers = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    numbers.append(n(t.as_py() or ""))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(numbers, pa.int64())], ["digest", "n_tokens"])

    keyed = cut(arrow_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(rows, "doc_id long, n_bytes long, digest binary"), "digests")
    local = arrow_rows(docs.select("text")).mapInArrow(first_of_each, "digest binary, text string")
    known = _stored(spark, cache)
    if known is not None:
        missing = keyed.select("digest").distinct().join(known, "digest", "left_anti")
        local = local.join(missing.hint("shuffle_hash"), "digest", "left_semi")
    local.repartition("digest").mapInArrow(count, COUNTS).write.mode("append").parquet(cache)
    counts = keyed.join(cut(_stored(spark, cache), "counts"), "digest")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
