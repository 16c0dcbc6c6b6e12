"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: a bit is 1 if it is set in over half of the XXH64 (seed 42) hashes of a text's word
shingles, repeats included.  Fingerprints link at ``DISTANCE`` or fewer differing bits.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18.  Two errors leave at least
one segment without error (pigeonhole), so linked fingerprints share one segment exactly, and a
neighbouring segment up to two errors.  The latter gets the keys of the perfect [23,12,7] Golay code:
the indices of all codewords within distance 4, one or six of them.  Words at distance up to 2 have
a midpoint within 1 of both, whose nearest codeword (within 3) is then among the keys of both.  A
fingerprint thus has 3 to 18 keys (A with B's index, B with A's, C with A's).

Copies collapse first: only distinct fingerprints get keys.  A key with two fingerprints is a
candidate pair; up to CROWD of them are compared inside their bucket, which yields a spanning forest
of its verified links instead of all pairs.  The fingerprints of a larger bucket agree in one segment
and are near in a second, so they get one key more, of the Golay code again: the codeword indices near
the third segment.  Two of them that are linked share one of these too, as neither segment has more
than two errors.  Fingerprints of a bucket that is larger even so (all three segments agree or are
near) are linked exactly without gathering it: two of them are within two bits if, and only if, they
share a neighbour within one bit, and at most 65 fingerprints share one.

Cases: a text without words (null too) has fingerprint zero and links like any other; fewer words
than a shingle make one shingle of all; null doc_ids take part but never name a component unless it
has no other; repeated rows are rows of their own; an empty table gives an empty result; columns
other than doc_id and text are ignored, and ``deduplicate`` returns them whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, cut, few, packed, text_key, unpacked
from .graph import components

SHINGLE, SEED, DISTANCE, CROWD = 3, 42, 2, 4096
#: Generator polynomial of the Golay code (fixed value).
GOLAY = 0b101011100011


def _fingerprint(text: bytes, n: int = SHINGLE, seed: int = SEED, piece: int = 1 << 20) -> int:
    import numpy as np
    import xxhash

    hashed = xxhash.xxh64_intdigest
    text = text.lower()  # of bytes: A-Z only
    total, counts, held, at = 0, np.zeros(64, np.int64), [], 0
    while at < len(text) or at == 0:
        end = at + piece
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        words = held + text[at:end].split()
        at = end
        if len(words) < n and at < len(text):
            held = words
            continue
        joined = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1 if words else np.zeros(0, np.int64)
        if len(words) >= n:
            stops = ends[n - 1 :].tolist()
            starts = [0, *(ends[: len(words) - n] + 1).tolist()]
        else:  # a whole text of few words
            starts, stops = ([0], [len(joined)]) if words and not total else ([], [])
        hashes = np.array([hashed(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], "<u8")
        for i in range(0, len(hashes), 1 << 16):
            part = hashes[i : i + (1 << 16)]
            counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        total += len(hashes)
        held = words[len(words) - n + 1 :] if len(words) >= n else words
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text) and fp (a signed 64-bit fingerprint) of every row."""

    def of(batches):
        import pyarrow as pa

        for batch in batches:
            fps = []
            for text in batch.column(2):
                fp = _fingerprint((text.as_py() or "").encode())
                fps.append(fp - (1 << 64) if fp >> 63 else fp)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    return arrow_rows(docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")).mapInArrow(of, "doc_id long, key long, fp long")


def _errors():
    """By syndrome: the error patterns that lead to the codewords within distance 4, -1 where fewer."""
    import numpy as np

    bits = []
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= GOLAY << (k - 11)
        bits.append(r)
    table, filled = np.full((2048, 6), -1, np.int64), [0] * 2048
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = 0
            for p in places:
                s ^= bits[p]
            table[s, filled[s]] = sum(1 << p for p in places)
            filled[s] += 1
    return np.array(bits), table


def golay_keys(words):
    """(n, 6) codeword indices within distance 4 of 23-bit words; -1 where there are fewer."""
    import numpy as np

    if not hasattr(golay_keys, "tables"):
        golay_keys.tables = _errors()
    bits, table = golay_keys.tables
    s = np.zeros(len(words), np.int64)
    for i in range(23):
        s ^= np.where(words >> i & 1, bits[i], 0)
    found = table[s]
    return np.where(found < 0, -1, (words[:, None] ^ found) >> 11)


#: The segments by number: their first bit and their width.
SEGMENTS = {1: (0, 23), 2: (23, 23), 3: (46, 18)}
#: The kinds of keys: the segment without error, the one that is decoded, and the third.
KINDS = ((1, 2, 3), (2, 1, 3), (3, 1, 2))


def _segment(fp, number: int):
    at, width = SEGMENTS[number]
    return fp >> at & (1 << width) - 1


def _keys(batches):
    """k (kind, exact segment, codeword index) and fp."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        made = [(kind, _segment(fp, kind), golay_keys(_segment(fp, near))) for kind, near, _ in KINDS]
        keys = np.concatenate([np.where(g < 0, -1, kind << 40 | exact[:, None] << 12 | g) for kind, exact, g in made], axis=1)
        used = keys >= 0
        yield pa.RecordBatch.from_arrays([pa.array(keys[used]), pa.array(np.broadcast_to(fp[:, None], keys.shape)[used])], ["k", "fp"])


def _third_keys(batches):
    """k, t (the codeword indices near the segment that k leaves out) and fp of (k, fp)."""
    import numpy as np
    import pyarrow as pa

    third = {kind: last for kind, _, last in KINDS}
    for batch in batches:
        k, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        keys = np.full((len(k), 6), -1, np.int64)
        for kind, last in third.items():
            mine = k >> 40 == kind
            keys[mine] = golay_keys(_segment(fp[mine], last))
        used = keys >= 0
        wide = [np.broadcast_to(c[:, None], keys.shape)[used] for c in (k, fp)]
        yield pa.RecordBatch.from_arrays([pa.array(wide[0]), pa.array(keys[used]), pa.array(wide[1])], ["k", "t", "fp"])


def _bucket_links(batches):
    """A spanning forest of the links within each bucket."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        out_a, out_b = [], []
        for bucket in batch.column(0):
            fps = np.unique(np.array(bucket.as_py(), np.int64))
            parent = list(range(len(fps)))

            def find(i, parent=parent):
                while parent[i] != i:
                    parent[i] = i = parent[parent[i]]
                return i

            for i in range(len(fps) - 1):
                for j in (np.flatnonzero(np.bitwise_count((fps[i + 1 :] ^ fps[i]).view(np.uint64)) <= DISTANCE) + i + 1).tolist():
                    x, y = find(i), find(j)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        out_a.append(int(fps[i]))
                        out_b.append(int(fps[j]))
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])


def _linked(keys: DataFrame, by: list[str], crowd: int) -> tuple[DataFrame, DataFrame]:
    """Edges of the buckets of up to ``crowd`` fingerprints, and the rows of the larger ones."""
    buckets = cut(keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "buckets")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = buckets.filter("n = 2").filter(near).select("a", "b")
    some = few(buckets.filter(f"n > 2 and n <= {crowd}").select(*by), 100_000)
    gathered = keys.join(some, by).groupBy(*by).agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = pairs.unionByName(arrow_rows(gathered).mapInArrow(_bucket_links, "a long, b long"))
    return edges, keys.join(few(buckets.filter(f"n > {crowd}").select(*by), 100_000), by)


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges a - b between linked fingerprints that connect all that links connect.

    ``distinct`` has each fingerprint once, as ``fp``.
    """
    keys = cut(arrow_rows(distinct.select("fp"), 4096).mapInArrow(_keys, "k long, fp long"), "keys")
    edges, crowded = _linked(keys, ["k"], crowd)
    crowded = cut(crowded.select("k", "fp"), "crowded")
    if not crowded.isEmpty():
        inner, packed_ = _linked(cut(arrow_rows(crowded, 4096).mapInArrow(_third_keys, "k long, t long, fp long"), "third"), ["k", "t"], crowd)
        edges = edges.unionByName(inner).unionByName(_stars(packed_.select("fp").distinct()))
    return edges.distinct()


def _stars(fps: DataFrame) -> DataFrame:
    """Edges from the least to every other fingerprint of those that share a neighbour within one bit."""
    one_off = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.when(i < 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    stars = fps.select("fp", F.explode(one_off).alias("z")).groupBy("z").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    return stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """doc_id, key, fp, root and component_id (the smallest doc_id reachable) of every row.

    ``root``, a fingerprint, identifies the component; component_id doesn't where ids are null or repeat.
    """
    marked = cut(fingerprints(docs), "fingerprints")
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    roots = components(links(classes, crowd))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted, "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select("doc_id", "key", "fp", "root", "component_id")


def deduplicate(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest doc_id (then key), once."""
    found = near_duplicates(docs, crowd)
    first = found.groupBy("root").agg(F.min_by(F.struct("doc_id", "key"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("x")).select(F.col("x.doc_id").alias("_fw_of"), F.col("x.key").alias("_fw_with"))
    rows = packed(docs)
    kept = rows.join(cut(first, "kept").hint("shuffle_hash"), rows["_fw_id"].eqNullSafe(F.col("_fw_of")) & (rows["_fw_key"] == F.col("_fw_with")), "left_semi")
    return unpacked(_once(kept))


def _once(kept: DataFrame) -> DataFrame:
    """Drop rows that repeat both id and text; only those are gathered, by id."""
    again = kept.groupBy("_fw_id", "_fw_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return kept.dropDuplicates(["_fw_id", "_fw_key"]) if not again.isEmpty() else kept
