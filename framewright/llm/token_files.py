r"""Token-id files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file holds documents in ascending doc_id order:

* one zstandard frame per document: its ids as little-endian unsigned 32-bit integers;
* a skippable frame (magic 0x184D2A50) with the documents: int64 doc_id (null: the smallest int64)
  and uint32 number of ids each;
* a skippable frame (magic 0x184D2A5E), the seek table: per frame uint32 compressed size, uint32
  size, uint32 low half of the XXH64 of the ids; then uint32 number of frames, a descriptor byte
  0x80 (checksums) and the magic 0x8F92EAB1.

Any zstandard decoder reads such a file as one stream; a reader of a few documents reads the two
tables and then those frames alone.  ``manifest`` is a Parquet table with a row for each file.

Tokens are made in one pass into compressed frames; only frames are shuffled, each to its file.  A
writer task writes under a name of its own attempt and the manifest names the files of the attempts
that succeeded, so retries and speculation leave at most files that nobody reads.

There are as many files as the texts need to have about ``MOST`` bytes of text each, and more if that
leaves cores idle, as long as each has ``LEAST``.  A writer so sorts and a seek table describes a
bounded number of documents, whatever the corpus.  An id that many rows repeat (or null) takes as many
files as its share asks for: its rows are dealt to them by their ids' checksum and, where rows repeat
whole, in turn.

Cases: null text is an empty text: only the end id; null doc_ids come first; rows that repeat a
doc_id are documents of their own, ordered by length and checksum; an empty table gives an empty
manifest.  Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import chunks
from .common import arrow_rows, cut, new_dir

END_ID = 2
#: Bytes of text for a file, at least where there are cores to spare, and at most.
LEAST, MOST = 4 << 20, 128 << 20
DOCS_MAGIC, SEEK_MAGIC, FOOT_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NO_ID = -(2**63)
FRAMES = "doc_id long, n_tokens long, ids_crc32 long, checksum long, frame binary, part int"
FILES = "file string, n_docs long, n_ids long, n_bytes long, low long, high long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long, file string"


def encode(docs: DataFrame, tokenizer: str, bounds: list[int], end_id: int | None = END_ID, level: int = 3) -> DataFrame:
    """A compressed frame of ids, its length and checksums, and the file it belongs to, for every row.

    File k takes the doc_ids over ``bounds[k - 1]`` and up to ``bounds[k]``; an id that is several bounds
    is dealt to all files that end with it and the next one.  Nulls are the least id.
    """

    def frames(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        import zstandard

        made, pack = chunks.load(tokenizer), zstandard.ZstdCompressor(level=level, write_checksum=True)
        tail = struct.pack("<I", end_id) if end_id is not None else b""

        def raw_ids(ids):
            return struct.pack(f"<{len(ids)}I", *ids)

        memo = chunks.memo_of(tokenizer, "ids", lambda: chunks.ChunkMemo(made, raw_ids, b"".join, True)) if chunks.by_chunks(tokenizer) else None
        edges = np.array(bounds, np.int64)
        wide, turns = set(edges[1:][edges[1:] == edges[:-1]].tolist()), Counter()
        for batch in batches:
            n, crc, check, out = [], [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                raw = b"".join(memo.of(text) if memo else [raw_ids(made.encode(text, add_special_tokens=False).ids)]) + tail
                n.append(len(raw) // 4)
                crc.append(zlib.crc32(raw))
                check.append(xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF)
                out.append(pack.compress(raw))
            ids = batch.column(0).cast(pa.int64())
            known = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, known)
            for i in np.flatnonzero(np.isin(known, list(wide))) if wide else ():
                # rows that share id and tokens differ in nothing, so which of them has which turn doesn't matter
                key = (int(known[i]), crc[i], n[i])
                part[i] += (crc[i] + turns[key]) % (np.searchsorted(edges, known[i], "right") - part[i])
                turns[key] += 1
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(check, pa.int64()), pa.array(out, pa.binary()), pa.array(part, pa.int32())], ["doc_id", "n_tokens", "ids_crc32", "checksum", "frame", "part"])

    return arrow_rows(docs.select("doc_id", "text")).mapInArrow(frames, FRAMES)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def bounds_of(docs: DataFrame, least: int = LEAST, most: int = MOST) -> list[int]:
    """The last doc_id of every file but the last, in order; an id of very many rows several times.

    They come from a quantile sketch of the ids, so no text is encoded twice.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(-(-size // most), min(spark.sparkContext.defaultParallelism, -(-size // least)))
    if files < 2:
        return []
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return sorted(docs.agg(F.percentile_approx(key, [k / files for k in range(1, files)], 20 * files)).first()[0] or [])


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Write ``docs`` to files in ``folder`` (any URI pyarrow opens); returns the manifest."""
    bounds = bounds_of(docs, least, most)
    ordered = encode(docs, tokenizer, bounds, end_id).repartitionById(len(bounds) + 1, "part").sortWithinPartitions("doc_id", "n_tokens", "ids_crc32")

    def write_file(batches):
        import pyarrow as pa

        task = TaskContext.get()
        name = f"ids-{task.partitionId():09d}-{task.taskAttemptId()}.zst"
        system, path = _open(folder)
        sink, seek, listed, n_ids, size, first, last = None, [], [], 0, 0, None, None
        for batch in batches:
            for doc, n, check, frame in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if sink is None:
                    system.create_dir(path, recursive=True)
                    sink, first = system.open_output_stream(f"{path}/{name}.part"), NO_ID if doc is None else doc
                sink.write(frame)
                seek.append(struct.pack("<3I", len(frame), 4 * n, check))
                listed.append(struct.pack("<qI", NO_ID if doc is None else doc, n))
                n_ids, size, last = n_ids + n, size + len(frame), NO_ID if doc is None else doc
        if sink is None:
            return
        for magic, body in ((DOCS_MAGIC, b"".join(listed)), (SEEK_MAGIC, b"".join(seek) + struct.pack("<IBI", len(seek), 0x80, FOOT_MAGIC))):
            sink.write(struct.pack("<2I", magic, len(body)) + body)
            size += 8 + len(body)
        sink.close()
        system.move(f"{path}/{name}.part", f"{path}/{name}")
        yield pa.RecordBatch.from_pylist([{"file": name, "n_docs": len(seek), "n_ids": n_ids, "n_bytes": size, "low": first, "high": last}], pa.schema([("file", pa.string()), *((x, pa.int64()) for x in ("n_docs", "n_ids", "n_bytes", "low", "high"))]))

    return cut(arrow_rows(ordered).mapInArrow(write_file, FILES), "manifest")


class Reader:
    """One file: its documents, and the ids of those asked for."""

    def __init__(self, system, path: str):
        self.file = system.open_input_file(path)
        size = self.file.size()
        foot = self._at(size - 9, 9)
        n, flags, magic = struct.unpack("<IBI", foot)
        if magic != FOOT_MAGIC or flags != 0x80:
            raise ValueError(f"{path}: no seek table at its end")
        table = size - 9 - 12 * n - 8
        magic, length = struct.unpack("<2I", self._at(table, 8))
        self.seek = list(struct.iter_unpack("<3I", self._at(table + 8, 12 * n)))
        listed, docs_length = table - 12 * n - 8, struct.unpack("<2I", self._at(table - 12 * n - 8, 8))
        if magic != SEEK_MAGIC or length != 12 * n + 9 or docs_length != (DOCS_MAGIC, 12 * n):
            raise ValueError(f"{path}: its tables don't fit")
        self.docs = [(None if d == NO_ID else d, k) for d, k in struct.iter_unpack("<qI", self._at(listed + 8, 12 * n))]
        self.offsets, at = [], 0
        for compressed, _, _ in self.seek:
            self.offsets.append(at)
            at += compressed

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def ids(self, k: int) -> bytes:
        """The ids of the k-th document as bytes, checked against the seek table."""
        import xxhash
        import zstandard

        compressed, size, check = self.seek[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.offsets[k], compressed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def __iter__(self) -> Iterator[tuple]:
        for k, (doc, n) in enumerate(self.docs):
            yield doc, n, self.ids(k)


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (over all files), n_tokens and ids_crc32 of every document, from the files."""
    order = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("before", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))
    n = max(1, manifest.count())

    def rows(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("file", pa.string())])
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = _open(folder)
                out = []
                for doc, k, raw in Reader(system, f"{path}/{name}"):
                    out.append((doc, start, k, zlib.crc32(raw), name))
                    start += k
                    if len(out) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return placed.select("file", "before").repartition(n).mapInArrow(rows, ROWS)


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str, doc_ids: list[int]) -> dict[int, list[int]]:
    """The ids of a few documents; only their frames are read and decompressed."""
    out = {}
    wanted = set(doc_ids)
    held = manifest.filter(F.lit(False) if not wanted else (F.col("low") <= max(wanted)) & (F.col("high") >= min(wanted)))
    for row in held.select("file").toLocalIterator():
        system, path = _open(folder)
        reader = Reader(system, f"{path}/{row[0]}")
        for k, (doc, _) in enumerate(reader.docs):
            if doc in wanted:
                raw = reader.ids(k)
                out[doc] = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    return out


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: a row per document."""
    folder = folder or new_dir(docs.sparkSession, "ids")
    return read_back(write(docs, folder, tokenizer), folder)
