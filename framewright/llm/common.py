"""What the corpus operators share: shared-folder tables, text expressions, bounded broadcasts."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workers import reach

#: ASCII white space, as the contracts' word pattern [^\x20\x09-\x0D]+ has it.
BLANKS = "\t\n\x0b\x0c\r "

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where the setting is missing, a local master gets a folder under /tmp; any other master is an
    error, as executors would write to disks that the others cannot see.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return "file:///tmp/framewright-checkpoints"


def new_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/framewright/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Remove the intermediate tables of this driver.  DataFrames that read them end with it."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before Python
            return


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here.

    A lost executor costs the tasks that it ran, never the stages before; sizes of the table are
    known to the planner afterwards.
    """
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most bytes, by ``weight``, that ``few`` broadcasts.
SMALL = 32 << 20


def weight(kind: T.DataType, value: Column) -> Column:
    """About the bytes that a value takes in memory; texts in arrays count by their JSON."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.lit(16) + F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.MapType)):
            return F.lit(32) + 2 * F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
        return F.lit(32) + F.coalesce(F.size(value), F.lit(0)) * (16 + 24 * len(inner.fields) if isinstance(inner, T.StructType) else 8)
    return F.lit(16)


def few(df: DataFrame, rows: int, size: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it is counted to have at most ``rows`` rows and about ``size``
    bytes; else as it is.  The joins that take it give the same rows either way."""
    each = sum((weight(f.dataType, F.col(f"`{f.name}`")) for f in df.schema), F.lit(32)).cast("long")
    n, total = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(each)).first()
    return F.broadcast(df) if n <= rows and (total or 0) <= size else df


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct ``_fw_row`` beside doc_id and the text's key, as ``_fw_id`` and ``_fw_key``.

    Whatever its columns are called, they clash with none of an operator's; ``unpacked`` is the way back.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_fw_row"), F.col("doc_id").alias("_fw_id"), text_key(F.col("text")).alias("_fw_key"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("_fw_row.*")


def spaced(text: Column) -> Column:
    """``text`` (null: empty) with every ASCII white-space character made a space."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS[:-1]:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def plain_words(text: Column) -> Column:
    r"""Array of the words ``[^\x20\x09-\x0D]+``; byte searches and a one-character split, no regex."""
    return F.array_remove(F.split(spaced(text), " "), "")


#: Characters that end a word of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
_OTHER = "".join(chr(c) for c in (*range(0x01, 0x20), *range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))
_UPPER = "".join(chr(c) for c in range(0x41, 0x5B))


def letter_words(text: Column) -> Column:
    r"""Array of the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case."""
    clean = F.translate(F.coalesce(text, F.lit("")), _UPPER + _OTHER, _UPPER.lower() + " " * len(_OTHER))
    return F.array_remove(F.split(F.replace(clean, F.lit("\x00"), F.lit(" ")), " "), "")


def text_key(text: Column) -> Column:
    """64-bit hash of a text that, beside doc_id, tells rows apart whose ids clash."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def arrow_rows(df: DataFrame, rows: int = 256) -> DataFrame:
    """Keep Arrow batches small, as one text may have megabytes; Spark's default is 10,000 rows."""
    spark = df.sparkSession
    reach(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    return df


#: The most bits of a ``probe``; 512 KiB.
PROBE_BITS = 1 << 22


def probe(known: DataFrame, column: str, most: int = PROBE_BITS):
    """A test for 64-bit hashes: true for all in ``known[column]``, and for few others.

    Its bits, eight for each hash and ``most`` in all, are part of the plan, so arrays can be thinned
    before they are exploded; with more hashes it lets more pass.  An exact join has to follow.
    """
    bits = 1 << max(10, min(most.bit_length() - 1, (8 * known.count()).bit_length()))
    h = F.col(column)
    word, one = F.shiftright(h.bitwiseAND(F.lit(bits - 1).cast("long")), 6), _bit(h)
    table = [0] * (bits // 64)
    for at, value in known.groupBy(word.alias("at")).agg(F.bit_or(one)).collect():  # a row for each word of the table
        table[at] = value
    made = F.from_json(F.lit(str(table)), "array<bigint>")
    return lambda x: F.get(made, F.shiftright(x.bitwiseAND(F.lit(bits - 1).cast("long")), 6).cast("int")).bitwiseAND(_bit(x)) != 0


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63).cast("long")).cast("int"))
