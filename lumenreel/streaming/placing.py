"""One-pass placement of frames on a canvas that grows both ways: a state machine per recording.

Two kinds of input share one step: frames whose motion is known (:func:`place_batch`, :func:`place_stream`), with a few
numbers of state per recording, and frames' signatures (:func:`stitch_batch`, :func:`stitch_stream`), which are matched against
the signature of the whole canvas so far, so that errors don't add up; state then grows with the canvas, not with the
number of frames.  Batch and stream walk the same step, so both agree row for row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenreel.functions import image

SCHEMA = "i long, frame_class string, y_top long, dy int, new_rows long, gap_rows long, side string"
STATE = "y_top long, top long, bottom long, abs_dx double, zero_streak int, last_i long, last_dy int"
NAMES = ["i", "frame_class", "y_top", "dy", "new_rows", "gap_rows", "side"]
START = (0, 0, 0, 0.0, 0, -1, 0)
#: With the canvas signature: its rows of ``k`` numbers from ``top`` on, and the last frame's signatures.
CANVAS_STATE = f"{STATE}, k int, canvas binary, prev_rows binary, prev_cols binary"


def step(state: tuple, frame: dict, height: int, max_advance: float, warn: float, floor: float, drag: float, reset: int, edge: int | None) -> tuple[tuple, tuple]:
    """The state after a frame, and the frame's row.

    Classes: first, drag (held sideways), stationary, edge_hit (a match at the rim of the search around the predicted
    place, the last motion carried on), suspect (would advance too far), low_confidence and normal.  Frames of the classes
    drag, stationary, edge_hit and suspect leave the canvas as it is and have a dy of 0.  ``frame["still"]``, if there, says
    whether the frame is stationary; else a dy of 0 does.
    """
    y, top, bottom, dx, zeros, last, last_dy = state
    i, dy = frame["i"], int(frame["dy"])
    if last < 0:
        return (0, 0, height, 0.0, 0, i, 0), (i, "first", 0, 0, height, 0, None)
    side = float(frame.get("dx") or 0.0)
    dx += side
    zeros = zeros + 1 if side == 0 else 0
    if zeros >= reset and abs(dx) < drag:
        dx = 0.0
    still = frame["still"] if "still" in frame else dy == 0
    rows, gap, where, kind, moved = 0, 0, None, "normal", 0
    to = y + dy
    above, below = max(0, top - to), max(0, to + height - bottom)
    if abs(dx) > drag:
        kind = "drag"
    elif still:
        kind, last_dy = "stationary", 0
    elif edge is not None and abs(dy - last_dy) >= edge - 1:
        kind = "edge_hit"
    elif max(above, below) > round(max_advance * height):
        kind = "suspect"
    else:
        if frame["conf"] < warn and frame["sad"] > floor:
            kind = "low_confidence"
        y, rows, moved, last_dy = to, min(above or below, height), dy, dy
        if above > height or below > height:
            gap, where = max(above, below) - height, "above" if above else "below"
        top, bottom = min(top, to), max(bottom, to + height)
    return (y, top, bottom, dx, zeros, i, last_dy), (i, kind, y, moved, rows, gap, where)


def _walk(state: tuple, frames: pd.DataFrame, options: dict) -> tuple[tuple, pd.DataFrame]:
    out = []
    for frame in frames.sort_values("i").to_dict("records"):
        if frame["i"] > state[5]:
            state, row = step(state, frame, **options)
            out.append(row)
    return state, pd.DataFrame(out, columns=NAMES)


def _walk_canvas(state: tuple, frames: pd.DataFrame, options: dict, radius: int, first_radius: int, dx_radius: int, alpha: float, still: float) -> tuple[tuple, pd.DataFrame]:
    """As :func:`_walk`, of signatures (rows, k, cols): each frame's motion is its match against the canvas."""
    numbers, (k, canvas, prev_rows, prev_cols) = tuple(state[:7]), state[7:]
    canvas = np.frombuffer(canvas, np.float32).reshape(-1, max(1, k))
    out = []
    height = options["height"]
    for frame in frames.sort_values("i").itertuples():
        if frame.i <= numbers[5]:
            continue
        cur, cols = np.array(frame.rows, np.float32).reshape(-1, frame.k), np.array(frame.cols, np.float32)
        seen = {"i": frame.i, "dy": 0, "conf": float("inf"), "sad": 0.0, "dx": 0, "still": False}
        edge = None
        if numbers[5] >= 0:
            edge = first_radius if numbers[5] == 0 else radius
            before = np.frombuffer(prev_rows, np.float32).reshape(cur.shape)
            seen["dx"] = image.match_1d(np.frombuffer(prev_cols, np.float32), cols, 0, dx_radius, min(len(cols), max(64, len(cols) // 6)))[0] if dx_radius else 0
            seen["still"] = float(np.abs(cur - before).mean()) < still
            if not seen["still"]:
                at = numbers[0] + numbers[6] - numbers[1]
                p, seen["sad"], seen["conf"], _ = image.match_1d(canvas, cur, at, edge, max(32, height // 8), alpha)
                seen["dy"] = numbers[1] + p - numbers[0]
        top, bottom = numbers[1], numbers[2]
        numbers, row = step(numbers, seen, edge=edge, **options)
        out.append(row)
        if row[1] == "first":
            k, canvas = frame.k, cur
        elif row[1] in ("normal", "low_confidence"):
            y = numbers[0]
            parts = [cur[: top - y], np.zeros((max(0, top - y - height), frame.k), np.float32)] if y < top else []
            parts.append(canvas)
            if y + height > bottom:
                parts += [np.zeros((max(0, y - bottom), frame.k), np.float32), cur[max(0, bottom - y) :]]
            canvas = np.concatenate(parts) if len(parts) > 1 else canvas
        prev_rows, prev_cols = cur.tobytes(), cols.tobytes()
    found = pd.DataFrame(out, columns=NAMES)
    return (*numbers, k, np.ascontiguousarray(canvas, np.float32).tobytes(), prev_rows, prev_cols), found


CANVAS_START = (*START, 0, b"", b"", b"")


def _batch(frames: DataFrame, key: str, walk: Callable, start: tuple) -> DataFrame:
    kind = dict(frames.dtypes)[key]

    def one(group: pd.DataFrame) -> pd.DataFrame:
        found = walk(start, group)[1]
        found.insert(0, key, group[key].iloc[0])
        return found

    return frames.groupBy(key).applyInPandas(one, f"{key} {kind}, {SCHEMA}")


def _stream(frames: DataFrame, key: str, walk: Callable, start: tuple, schema: str) -> DataFrame:
    kind = dict(frames.dtypes)[key]

    def one(name: tuple, batches: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = held.get if held.exists else start
        state, found = walk(tuple(state), pd.concat(list(batches)))
        held.update(state)
        found.insert(0, key, name[0])
        yield found

    return frames.groupBy(key).applyInPandasWithState(one, f"{key} {kind}, {SCHEMA}", schema, "append", "NoTimeout")


def _known(height: int, max_advance: float = 1.0, warn: float = 1.15, floor: float = 0.3, drag: float = 20, reset: int = 3, edge: int | None = None) -> Callable:
    options = {"height": height, "max_advance": max_advance, "warn": warn, "floor": floor, "drag": drag, "reset": reset, "edge": edge}
    return lambda state, frames: _walk(state, frames, options)


def _matched(height: int, max_advance: float = 1.0, warn: float = 1.15, floor: float = 0.3, drag: float = 20, reset: int = 3, radius: int = 200, first_radius: int = 400, dx_radius: int = 300, alpha: float = 0.02, still: float = 0.5) -> Callable:
    options = {"height": height, "max_advance": max_advance, "warn": warn, "floor": floor, "drag": drag, "reset": reset}
    return lambda state, frames: _walk_canvas(state, frames, options, radius, first_radius, dx_radius, alpha, still)


def place_batch(frames: DataFrame, key: str, height: int, **options) -> DataFrame:
    """Frames (key, i, dy, sad, conf, optionally dx) of whole recordings: a row for each; options as of :func:`_known`."""
    return _batch(frames, key, _known(height, **options), START)


def place_stream(frames: DataFrame, key: str, height: int, **options) -> DataFrame:
    """The same on a stream whose batches bring each recording's frames in order; frames that come late are passed over."""
    return _stream(frames, key, _known(height, **options), START, STATE)


def stitch_batch(marks: DataFrame, key: str, height: int, **options) -> DataFrame:
    """Signatures (key, i, rows, k, cols; see ``operators.frames.signatures``) of whole recordings, matched against the canvas."""
    return _batch(marks.select(key, "i", "rows", "k", "cols"), key, _matched(height, **options), CANVAS_START)


def stitch_stream(marks: DataFrame, key: str, height: int, **options) -> DataFrame:
    """The same on a stream whose batches bring each recording's frames in order."""
    return _stream(marks.select(key, "i", "rows", "k", "cols"), key, _matched(height, **options), CANVAS_START, CANVAS_STATE)
