"""Folds in order over series of any length: rows come sorted, and only a state is carried from batch to batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _turns(batch: pa.RecordBatch, n_keys: int) -> np.ndarray:
    """Where another series begins in a batch (its first row not counted)."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in range(n_keys):
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new |= codes[1:] != codes[:-1]
    return np.flatnonzero(new) + 1


def ordered(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], shape: str, each: Callable[[object, list[np.ndarray]], tuple[object, np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """(keys, shape): `each(state, columns)` sees the values of a series in order, a stretch at a time.

    It returns its state for the next stretch (None at the start of a series), which rows of the
    stretch go on, and the new columns of `shape` for them.  Memory is bounded by a batch; the
    series themselves are spread over tasks by their keys.
    """
    names = [*keys, *(part.split()[0] for part in shape.split(", "))]
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            bounds = [0, *_turns(batch, len(keys)).tolist(), batch.num_rows]
            columns = [batch.column(len(keys) + k).to_numpy(zero_copy_only=False) for k in range(len(values))]
            rows, made = [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = tuple(batch.column(k)[lo].as_py() for k in range(len(keys)))
                if lo or own != last:
                    state = None
                last = own
                state, keep, out = each(state, [c[lo:hi] for c in columns])
                rows.append(keep + lo)
                made.append(out)
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keys))), *(pa.array(np.concatenate(x)) for x in zip(*made, strict=True))], names=names)

    sorted_ = df.select(*keys, *values, *[c for c in order if c not in values]).repartition(*keys).sortWithinPartitions(*keys, *order)
    return sorted_.select(*keys, *values).mapInArrow(run, f"{kinds}, {shape}")
