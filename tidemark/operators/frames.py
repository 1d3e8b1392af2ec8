"""The pandas-like surface, on pandas-on-Spark frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence


def masked(events, event_type: str, above: float):
    return events[(events["event_type"] == event_type) & (events["value"] > above)]


def flat_agg(frame, key: str, aggregates: Mapping[str, Sequence[str]]):
    """groupby().agg() with several functions per column; the two-level header becomes column_function."""
    out = frame.groupby(key).agg({c: list(fns) for c, fns in aggregates.items()})
    out.columns = [f"{column}_{fn}" for column, fn in out.columns]
    return out.reset_index()


def described(frame):
    return frame.describe().reset_index().rename(columns={"index": "stat"})


def sums_by(frame, key: str, value: str):
    return frame.groupby(key)[[value]].sum().sort_index().reset_index()
