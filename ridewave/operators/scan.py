"""Sequential per-group steps over sorted partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Arrays = dict[str, np.ndarray]


def scan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[Arrays], Arrays],
                schema: str) -> DataFrame:
    """Apply ``step`` to each group in ``order``.

    Spark hashes the groups over tasks and sorts them; a task reads Arrow batches and keeps only
    the group it is in.  Thousands of small groups cost one pass, not one Python call with a
    pandas frame each.  Callers bound the size of a group.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        arrays = {c: pdf[c].to_numpy() for c in pdf.columns}
        edges = _edges(arrays, keys)
        found = [step({c: a[i:j] for c, a in arrays.items()}) for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pd.DataFrame({n: np.concatenate([f[n] for f in found]) for n in names})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if pdf.empty:
                continue
            whole = pd.concat([held[-1].tail(1), pdf], ignore_index=True) if held else pdf
            edges = _edges({k: whole[k].to_numpy() for k in keys}, keys)
            lead = 1 if held else 0
            cut = edges[-2] - lead
            if len(edges) > 2:
                yield settle(pd.concat([*held, pdf.iloc[:cut]], ignore_index=True))
                held = [pdf.iloc[cut:]]
            else:
                held.append(pdf)
        if held:
            yield settle(pd.concat(held, ignore_index=True))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _edges(arrays: Arrays, keys: Sequence[str]) -> list[int]:
    size = len(arrays[keys[0]])
    changed = np.zeros(size, dtype=bool)
    for k in keys:
        changed[1:] |= arrays[k][1:] != arrays[k][:-1]
    return [0, *np.flatnonzero(changed).tolist(), size]


def schema_of(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)
