"""The trackers on streams of frames: state lives in the state store, one entry per sequence.

Frames of a sequence may arrive in any order: a frame waits until those before it have come, or until
more than ``wait`` frames of its sequence wait, when the missing ones count as lost.  A frame that comes
after it counted as lost is a row of its own, marked ``late``, without a place, as the tracker has gone
on; frames that come again are left out.  ``wait`` bounds what a sequence holds in its state, beside a
pair of numbers for each gap that is still open.  Frames are numbered from 0.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, StructField, StructType

from ..params import Params
from ..workers import reach
from ..operators.track import Contrast, Geometry, Place

def in_order(held: dict[int, list], following: int, wait: int):
    """Take from ``held`` the frames whose turn has come; yields (index, row)."""
    while held:
        if following not in held:
            if len(held) <= wait:
                return
            following = min(held)
        yield following, held.pop(following)
        following += 1


def taken_out(gaps: list[list[int]], i: int) -> bool:
    """Whether ``i`` is in one of the gaps [first, stop); it is in none of them any more."""
    for k, (first, stop) in enumerate(gaps):
        if first <= i < stop:
            gaps[k : k + 1] = [g for g in ([first, i], [i + 1, stop]) if g[0] < g[1]]
            return True
    return False


def track(frames: DataFrame, make: Callable[[], Geometry | Contrast], wait: int) -> DataFrame:
    """seq_id, frame_idx, late and the tracker's columns of a stream of frames, in append mode."""
    kind = make()
    used = [c for c in kind.USED if c in frames.columns]
    types = {f.name: f.dataType for f in frames.schema}
    added = [n for n, _ in kind.ADDED]
    out = StructType([StructField("seq_id", types["seq_id"]), StructField("frame_idx", types["frame_idx"]), StructField("late", BooleanType()), *[StructField(n, t) for n, t in kind.ADDED]])

    def step(key, parts, state):
        import pandas as pd

        tracker = make()
        following, held, gaps, rows = 0, {}, [], []
        if state.exists:
            following, known, waiting, gaps = json.loads(state.get[0])
            tracker.load(known)
            held = {int(i): row for i, row in waiting.items()}
        for part in parts:
            plain = part[used].astype(object).where(part[used].notna(), None)
            for i, values in zip(part["frame_idx"].tolist(), plain.values.tolist(), strict=True):
                if i >= following:
                    held.setdefault(int(i), values)
                elif taken_out(gaps, int(i)):
                    rows.append((key[0], int(i), True, *[None] * len(added)))
        for i, values in in_order(held, following, wait):
            if i > following:
                gaps.append([following, i])
            rows.append((key[0], i, False, *tracker.step(dict(zip(used, values, strict=True)))))
            following = i + 1
        state.update((json.dumps([following, tracker.dump(), held, gaps]),))
        frame = pd.DataFrame(rows, columns=["seq_id", "frame_idx", "late", *added])
        yield frame.astype({n: object for n in added})

    reach(frames.sparkSession)
    narrow = frames.select("seq_id", "frame_idx", *used)
    return narrow.groupBy("seq_id").applyInPandasWithState(step, out, "kept string", "append", "NoTimeout")


def geometry_stream(frames: DataFrame, p: Params, size: Place, wait: int) -> DataFrame:
    return track(frames, lambda: Geometry(p, size), wait)


def contrast_stream(frames: DataFrame, p: Params, size: Place, wait: int) -> DataFrame:
    return track(frames, lambda: Contrast(p, size), wait)
