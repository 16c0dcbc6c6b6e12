"""Language identification by hyperdimensional profiles.

Every letter class has a random vector of +1 and -1.  A letter n-gram (n = 3) binds its letters'
vectors, each permuted by its place, in a product; a text bundles its n-grams in a sum, and a
language prototype bundles its training texts, each with the same weight.  A text goes to the
prototype of highest cosine; its score is that cosine's share of all positive ones.

A text's vector is never built: its product with a prototype is the sum of its n-grams' products,
and its own length cancels in the score.  Training sums are whole numbers, so they don't depend on
the order of partitions; each task sends one vector per language, whatever its share of the rows.

Letters are those of Unicode, in lower case; the first 256 code points are classes of their own,
the others share 190 classes by remainder; everything else is one gap.

Cases: null texts and texts without a letter are ``und`` with score 0, like every text if nothing
was learned; rows of null doc_id aren't held out; repeated rows count and return each; an empty
table gives an empty result; columns other than doc_id, text and lang are ignored, and lang is only
read in training.  Prototypes take 8 KiB per language; their number is that of the labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

DIMS, SEED, PIECE, UNIT = 1024, 7, 1 << 20, 1 << 24


class Letters:
    """Letter classes, their vectors and n-gram codes; one per worker."""

    made = None

    def __init__(self):
        import numpy as np

        shared = [*range(1, 32), *range(33, 97), *range(128, 223)]
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            if chr(cp).isalpha():
                table[cp] = cp if 97 <= cp < 123 or 223 <= cp < 256 else shared[cp % len(shared)]
        self.table = table
        one = np.random.default_rng(SEED).integers(0, 2, (256, DIMS), np.int8) * np.int8(2) - np.int8(1)
        self.places = [np.roll(one, 2 - k, axis=1) for k in range(3)]
        self.flags = np.zeros(1 << 24, np.bool_)
        self.at = np.zeros(1 << 24, np.int32)

    @classmethod
    def get(cls) -> Letters:
        cls.made = cls.made or cls()
        return cls.made

    def codes(self, text: str):
        """The codes of the text's 3-grams; none if it has no letter."""
        import numpy as np

        out, last = [], np.zeros(1, np.uint8)
        for i in range(0, len(text), PIECE):
            raw = np.frombuffer(text[i : i + PIECE].lower().encode("utf-32-le", "surrogatepass"), "<u4")
            c = np.concatenate([last, self.table[raw], np.zeros(int(i + PIECE >= len(text)), np.uint8)])
            c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])].astype(np.int32)
            if len(c) > 2:
                out.append(c[:-2] << 16 | c[1:-1] << 8 | c[2:])
            last = c[-2:].astype(np.uint8)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def distinct(self, codes):
        """Distinct codes and the place of each code among them."""
        import numpy as np

        self.flags[codes] = True
        low, high = int(codes.min()), int(codes.max()) + 1
        found = np.flatnonzero(self.flags[low:high]) + low
        self.flags[found] = False
        self.at[found] = np.arange(len(found), dtype=np.int32)
        return found, self.at[codes]

    def vectors(self, codes):
        return self.places[0][codes >> 16] * self.places[1][codes >> 8 & 255] * self.places[2][codes & 255]


def _some(texts, most: int = 1 << 21):
    """Runs of (row, codes) with about ``most`` codes in all; texts without a code are left out."""
    letters, held, n = Letters.get(), [], 0
    for i, text in texts:
        codes = letters.codes(text)
        if len(codes):
            held.append((i, codes))
            n += len(codes)
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _train(batches):
    import numpy as np
    import pyarrow as pa

    letters, sums = Letters.get(), {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for held in _some((i, t.as_py()) for i, t in enumerate(batch.column(1))):
            for lang in {langs[i] for i, _ in held}:
                own = [c for i, c in held if langs[i] == lang]
                codes, at = letters.distinct(np.concatenate(own))
                weight = np.bincount(at, np.concatenate([np.full(len(c), 1 / len(c)) for c in own]), len(codes))
                whole = np.rint(weight * UNIT).astype(np.int64)
                total = sums.setdefault(lang, np.zeros(DIMS, np.int64))
                for k in range(0, len(codes), 4096):
                    # whole numbers below 2^53 are exact in float64, which is what makes the product fast
                    total += np.rint(whole[k : k + 4096].astype(np.float64) @ letters.vectors(codes[k : k + 4096]).astype(np.float64)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])


def train(docs: DataFrame) -> tuple[list, object]:
    """Labels in code-point order and their prototypes, from the text and lang of ``docs``."""
    import numpy as np

    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    sums = arrow_rows(known).mapInArrow(_train, "lang string, v array<long>").select("lang", F.posexplode("v").alias("i", "x"))
    rows = sums.groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).collect()
    rows = sorted(rows, key=lambda r: r["lang"].encode())
    protos = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), DIMS)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    if len(rows) > 1:  # what all languages share tells none from another
        protos -= protos.mean(0)
        protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return [r["lang"] for r in rows], protos


def predict(docs: DataFrame, model: tuple[list, object]) -> DataFrame:
    """doc_id, lang_pred and score of every row, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches):
        import numpy as np
        import pyarrow as pa

        labels, protos = shared.value
        letters = Letters.get()
        for batch in batches:
            names, scores = ["und"] * len(batch), np.zeros(len(batch))
            for held in _some((i, t.as_py() or "") for i, t in enumerate(batch.column(1))) if labels else ():
                codes, at = letters.distinct(np.concatenate([c for _, c in held]))
                near = np.concatenate([letters.vectors(codes[k : k + 4096]).astype(np.float64) @ protos.T for k in range(0, len(codes), 4096)])
                starts = np.cumsum([0] + [len(c) for _, c in held[:-1]])
                for j, (i, _) in enumerate(held):
                    stop = starts[j + 1] if j + 1 < len(starts) else len(at)
                    cos = np.bincount(at[starts[j] : stop], minlength=len(codes)) @ near if stop - starts[j] > len(codes) else near[at[starts[j] : stop]].sum(0)
                    best = int(np.argmax(cos))
                    positive = np.maximum(cos, 0).sum()
                    names[i], scores[i] = labels[best], max(cos[best], 0) / positive if positive > 0 else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(scores, 0, 1))], ["doc_id", "lang_pred", "score"])

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(of, "doc_id long, lang_pred string, score double")


def held_out():
    """Whether a row's label is kept from training: crc32(doc_id as text) mod 4 is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows not held out."""
    model = train(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
