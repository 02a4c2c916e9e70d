"""Recursions along ordered series that no window expresses.

`scanned` is one pass over rows sorted by key and time: a series is read in Arrow batches and its state carried from one to
the next, so memory is bounded by a batch and time is linear. `scanned_in_parts` cuts a series into parts of time that run
at once: a recursion whose steps are maps of the state that compose into a small map (affine, a table of states, a filtering
element) is first composed within each part, then the maps of the parts are applied one after the other, which gives the
state that enters each part, and at last all parts are replayed from there. So the largest task is a part, not a series.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: step(state, row values) -> (state, outputs)
Step = Callable[[tuple, tuple], tuple[tuple, tuple]]
#: Seconds of a part of time; meant to hold some 100,000 rows of a series.
PART_SECONDS = 30 * 86_400


@dataclass(frozen=True)
class Recursion:
    """A recursion with its maps. of_rows: the map of consecutive rows, from a list of input columns (None: null);
    composed(first, then): one map after the other; passed(map, state): the state behind a map. Maps are lists of doubles."""

    start: tuple
    step: Step
    outputs: str
    state: str
    of_rows: Callable[[list[np.ndarray]], list[float]]
    composed: Callable[[list[float], list[float]], list[float]]
    passed: Callable[[list[float], tuple], tuple]


def scanned(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], start: tuple, step: Step, outputs: str, entering: tuple[str, ...] = ()) -> DataFrame:
    """The rows with the outputs of a recursion over `inputs`, in order within each key; nulls come to step as None. The
    state that enters a key is start, or what stands in the columns `entering` of its first row."""
    names = df.columns
    made = T.StructType.fromDDL(outputs)
    at, heads = [names.index(k) for k in keys], [names.index(c) for c in entering]
    missing = object()  # no key equals it

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = missing, start
        plain = lambda c: c.astype(object).where(c.notna(), None)
        for pdf in batches:
            found: list[tuple] = []
            values, first = [plain(pdf[c]) for c in inputs], [plain(pdf.iloc[:, i]) for i in heads]
            for n, (now, row) in enumerate(zip(zip(*(plain(pdf.iloc[:, i]) for i in at), strict=True), zip(*values, strict=True), strict=True)):
                if key is missing or now != key:
                    key, state = now, tuple(c.iloc[n] for c in first) if heads else start
                state, out = step(state, row)
                found.append(out)
            yield pd.concat([pdf, pd.DataFrame(found, columns=made.names, index=pdf.index)], axis=1)

    ordered = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, T.StructType([*df.schema.fields, *made.fields]))


def composed_maps(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], rule: Recursion) -> DataFrame:
    """keys and `_map`, the map of all rows of a key in order."""
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField("_map", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, None  # the last key may go on in the next batch
        frame = lambda: pd.DataFrame([(*key, held)], columns=schema.names).astype({k: object for k in keys})
        for pdf in batches:
            plain = pdf.astype(object).where(pdf.notna(), None)
            every = list(zip(*(plain[k] for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(every)) if every[i] != every[i - 1]), len(every)] if every else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = rule.of_rows([plain[c].to_numpy()[a:b] for c in inputs])
                if held is not None and every[a] == key:
                    held = rule.composed(held, own)
                else:
                    if held is not None:
                        yield frame()
                    key, held = every[a], own
        if held is not None:
            yield frame()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def time_part(ts: str, seconds: int = PART_SECONDS) -> Column:
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def scanned_in_parts(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], inputs: tuple[str, ...], rule: Recursion, seconds: int = PART_SECONDS) -> DataFrame:
    """As `scanned`, with the first column of order, a time, cut into parts of so many seconds."""
    rows = df.withColumn("_part", time_part(order[0], seconds))
    fine = (*keys, "_part")
    maps = composed_maps(rows.select(*fine, *order[: len(order)], *inputs), fine, order, inputs, rule)
    state = T.StructType.fromDDL(rule.state)
    enters = scanned(maps, keys, ("_part",), ("_map",), rule.start, lambda s, row: (rule.passed(list(row[0]), s), s), rule.state)
    enters = enters.select(*(F.col(k).alias(f"_of_{k}") for k in fine), *state.names)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in fine]
    on = same[0]
    for s in same[1:]:
        on = on & s
    met = rows.join(enters, on).drop(*(f"_of_{k}" for k in fine))
    return scanned(met, fine, order, inputs, rule.start, rule.step, rule.outputs, tuple(state.names)).drop("_part", *state.names)
