"""Backward scans of affine maps over arrays: state = slope * next state + shift, in time linear in the elements."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Arrays up to this length are scanned side by side, longer ones one by one.
SHORT = 4096


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column; null lists are empty, null values NaN."""
    lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    return lengths, column.flatten().to_numpy(zero_copy_only=False).astype(float)


def scanned_back(lengths: np.ndarray, slopes: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """States of arrays that lie end to end; behind each one's last element the state is 0."""
    out, ends = np.empty(len(shifts)), np.cumsum(lengths)
    for i in np.flatnonzero(lengths > SHORT):
        state, start = 0.0, ends[i] - lengths[i]
        a, b, held = slopes[start : ends[i]].tolist(), shifts[start : ends[i]].tolist(), [0.0] * int(lengths[i])
        for j in range(len(held) - 1, -1, -1):
            state = b[j] + a[j] * state
            held[j] = state
        out[start : ends[i]] = held
    short = np.flatnonzero((lengths <= SHORT) & (lengths > 0))
    short = short[np.argsort(-lengths[short], kind="stable")]
    sizes, last, state = lengths[short], ends[short] - 1, np.zeros(len(short))
    for back in range(int(sizes.max(initial=0))):
        many = np.searchsorted(-sizes, -back, "left")  # arrays with more than `back` elements
        at = last[:many] - back
        state = shifts[at] + slopes[at] * state[:many]
        out[at] = state
    return out


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _scan_back(slopes: pa.Array, shifts: pa.Array) -> pa.Array:
    lengths, b = _flat(shifts)
    states = scanned_back(lengths, _flat(slopes)[1], b)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(states))


def scan_back(slopes: Column, shifts: Column) -> Column:
    """An array of states, from two arrays of doubles of the same length."""
    return _scan_back(slopes, shifts)
