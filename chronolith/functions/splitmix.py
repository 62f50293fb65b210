"""SplitMix64: the public generator of 64-bit numbers, for fixtures that must come out the same everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The generator's constants: its step and its two multipliers.
GOLDEN, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def mixed(state: np.ndarray) -> np.ndarray:
    """The output for a state that has been stepped."""
    with np.errstate(over="ignore"):
        z = (state ^ (state >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
    return z ^ (z >> np.uint64(31))


def splitmix64(index: Column, seed: int) -> Column:
    """The ``index``-th number (from 0) of the stream of a seed, as a signed long; null for a null index."""

    @F.pandas_udf("long")
    def draw(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for i in parts:
            known = i.notna()
            at = i[known].to_numpy(np.int64).astype(np.uint64)
            with np.errstate(over="ignore"):
                state = np.uint64(seed & (2**64 - 1)) + (at + np.uint64(1)) * np.uint64(GOLDEN)
            out = pd.Series(pd.NA, index=i.index, dtype="Int64")
            out[known] = mixed(state).view(np.int64)
            yield out

    return draw(index)


def unit_interval(number: Column) -> Column:
    """A number of the stream as a double in [0, 1): its upper 53 bits."""
    return F.shiftrightunsigned(number, 11) / float(1 << 53)
