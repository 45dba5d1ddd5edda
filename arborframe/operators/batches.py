"""Work per row or per group: applying functions, and failures that stay local."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns(rows: DataFrame, new: dict[str, Column]) -> DataFrame:
    """New columns as expressions of the row, the way to apply a function wherever possible."""
    return rows.withColumns(new)


def halved(frame: pd.DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], new: Sequence[str]) -> pd.DataFrame:
    """The frame with new columns and ``error``; where the function raises, the frame is halved
    until a row raises alone, so one bad row among n costs about two calls for each halving."""
    try:
        got = func(frame)
        return frame.assign(**{c: got[c].to_numpy() for c in new}, error=None)
    except Exception as exc:  # noqa: BLE001 - the message is the result
        if len(frame) <= 1:
            return frame.assign(**dict.fromkeys(new), error=f"{type(exc).__name__}: {exc}")
    middle = len(frame) // 2
    parts = [halved(part, func, new).astype(object) for part in (frame.iloc[:middle], frame.iloc[middle:])]
    return pd.concat(parts)


def apply_rows(
    rows: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], new: dict[str, str]
) -> DataFrame:
    """New columns from a function of Arrow batches of rows, for what expressions cannot say.

    ``new`` maps column names to Spark types.  A row for which the function raises has NULL in the
    new columns and the message in ``error``; the other rows of its batch are not spoiled.
    """
    names = list(rows.columns)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
                       + [f"`{c}` {t}" for c, t in new.items()] + ["error string"])

    def batches(frames):
        for frame in frames:
            yield halved(frame, func, list(new))[[*names, *new, "error"]]

    return rows.mapInPandas(batches, schema)


def _numbers(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """A number for each group of rows that follow each other, from 0."""
    return frame.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()


def halved_groups(
    frame: pd.DataFrame, keys: list[str], func: Callable[[pd.DataFrame], pd.DataFrame], result: Sequence[str]
) -> list[pd.DataFrame]:
    """What the function makes of whole groups, with ``error``; where it raises, the groups are
    halved until one raises alone."""
    try:
        return [func(frame)[[*keys, *result]].assign(error=None)]
    except Exception as exc:  # noqa: BLE001 - the message is the result
        number = _numbers(frame, keys)
        if number[-1] == 0:
            return [frame[keys].iloc[:1].assign(**dict.fromkeys(result), error=f"{type(exc).__name__}: {exc}")]
    middle = int(np.searchsorted(number, (number[-1] + 1) // 2))
    parts = (frame.iloc[:middle], frame.iloc[middle:])
    return [made for part in parts for made in halved_groups(part, keys, func, result)]


def apply_groups(
    rows: DataFrame, keys: Sequence[str], func: Callable[[pd.DataFrame], pd.DataFrame], result: dict[str, str]
) -> DataFrame:
    """The rows that a function makes of groups: (keys, result, error).

    The function gets many whole groups at a time and returns the keys with its own columns, whose
    Spark types ``result`` names.  A group for which it raises gives one row with NULLs and the
    message; the others go on.  A group has to fit into a task, so this is for groups of known
    small size.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [f"`{c}` {t}" for c, t in result.items()] + ["error string"])

    def run(frames):
        held = None
        for frame in frames:
            if not len(frame):
                continue
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            number = _numbers(frame, keys)
            last = int(np.searchsorted(number, number[-1]))  # may go on in the next batch
            held = frame.iloc[last:]
            if last:
                yield from halved_groups(frame.iloc[:last], keys, func, list(result))
        if held is not None:
            yield from halved_groups(held, keys, func, list(result))

    dealt = rows.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, schema)


def split_failures(rows: DataFrame, *, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows that worked, without the error column, and rows that failed."""
    return rows.filter(F.col(error).isNull()).drop(error), rows.filter(F.col(error).isNotNull())


def failed_groups(rows: DataFrame, keys: Sequence[str], *, error: str = "error") -> DataFrame:
    """Groups with at least one failed row and their first message."""
    return rows.filter(F.col(error).isNotNull()).groupBy(*keys).agg(F.min(error).alias(error))


def drop_failed_groups(rows: DataFrame, keys: Sequence[str], *, error: str = "error") -> DataFrame:
    """All rows of the groups without any failure; the others do not stop them."""
    bad = rows.filter(F.col(error).isNotNull()).select(*keys).distinct()
    return rows.join(bad, list(keys), "left_anti").drop(error)
