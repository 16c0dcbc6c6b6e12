"""Images as rows (seq_id, frame_idx, h, w, gray): gray levels row by row in a binary.

``per_image`` runs an array kernel on every image in Arrow batches of a few rows; images are never
gathered, and kernels that need the image before get it by ``with_previous``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..workers import reach


def decode(row: dict, name: str = "gray") -> np.ndarray:
    return np.frombuffer(row[name], np.uint8).reshape(row["h"], row["w"])


def per_image(images: DataFrame, kernel: Callable[[np.ndarray, dict], dict | list[dict]], fields: str, keep: list[str] = ("seq_id", "frame_idx")) -> DataFrame:
    """``keep`` and the kernel's fields for every image; a list of records makes a row of each."""
    spark = images.sparkSession
    reach(spark)
    kept = images.select(*keep).schema
    schema = StructType([*kept, *StructType.fromDDL(fields)])
    names = [f.name for f in schema]
    arrow = images.select(*images.columns)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time: memory is one image's
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                found = kernel(decode(row), row)
                records = [{**{k: row[k] for k in keep}, **r} for r in (found if isinstance(found, list) else [found])]
                if records:
                    yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in records], made)

    return arrow.mapInArrow(run, schema)


def with_previous(images: DataFrame) -> DataFrame:
    """The image before as ``before`` (null for a sequence's first one)."""
    return images.withColumn("before", F.lag("gray").over(Window.partitionBy("seq_id").orderBy("frame_idx")))


def disks(table: DataFrame, key: str) -> DataFrame:
    """Test images of 96 by 72 pixels: a disk of radius 24 that another one covers, by whole numbers of ``key``.

    Every third one is torn: black below a line.
    """

    def draw(batches):
        import pyarrow as pa

        y, x = np.mgrid[:96, :72]
        for batch in batches:
            for i in batch.column(0).to_pylist():
                cx, cy = 36 + i % 5 - 2, 48 + i % 7 - 3
                mx, my = ((17, 0), (0, 17), (-17, 0), (0, -17))[i % 4]
                sun = (x - cx) ** 2 + (y - cy) ** 2 <= 576
                moon = (x - cx - mx) ** 2 + (y - cy - my) ** 2 <= 576
                gray = np.where(sun & ~moon, 70 + 7 * (i % 25) + (3 * x + 5 * y) % 7, np.where((x + 2 * y + i) % 11 == 0, 6, 2))
                if i % 3 == 0:
                    gray = np.where(y > cy + 8, 0, gray)
                yield pa.RecordBatch.from_pylist([{"seq_id": i // 25, "frame_idx": i % 25, "id": i, "h": 96, "w": 72, "gray": gray.astype(np.uint8).tobytes(), "cx": float(cx), "cy": float(cy)}], pa.schema([("seq_id", pa.int64()), ("frame_idx", pa.int64()), ("id", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("gray", pa.binary()), ("cx", pa.float64()), ("cy", pa.float64())]))

    reach(table.sparkSession)
    return table.select(F.col(key).cast("long").alias("id")).mapInArrow(draw, "seq_id long, frame_idx long, id long, h int, w int, gray binary, cx double, cy double")
