"""Top rows from an index whose parts are read best bound first.

An index cuts rows into parts, in an order in which what a part adds can't be nearer than its bound. Parts are read, a few at
first and then twice as many each time, until so many matches are found that the last of them is nearer than the next part's
bound. Filters hold while the parts are read, so a filter with few matches means more parts, never fewer rows. What comes to the driver is the
distances of the matches that are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Found:
    """rows: all that the opened parts hold under the filters, with `distance`; the top ones of all are among them."""

    rows: DataFrame
    opened: int


def best_first(bounds: Sequence[float], read: Callable[[list[int]], DataFrame], k: int, tie: str, keys: Sequence[str] = (), dedupe: Callable[[DataFrame], DataFrame] | None = None, first: int = 2) -> Found:
    """bounds: ascending, one for each part; read: rows of some parts with `distance`, filters done.

    dedupe keeps the nearest row of those that are equal in `keys` (null as empty); without keys each `tie` is a row of its own.
    """
    keys = list(keys) or [tie]
    best: dict[tuple, float] = {}
    at, step = 0, first
    while at < len(bounds):
        end = min(at + step, len(bounds))
        rows = read(list(range(at, end))).select("distance", *dict.fromkeys([tie, *keys]))
        for r in (dedupe(rows) if dedupe else rows).orderBy("distance", tie).limit(k).collect():
            key = tuple("" if r[c] is None else r[c] for c in keys)
            best[key] = min(best.get(key, r["distance"]), r["distance"])
        at, step = end, 2 * step
        # Strictly nearer: at the same distance the tie could fall to a row that isn't read yet.
        if at < len(bounds) and len(best) >= k and sorted(best.values())[k - 1] < bounds[at]:
            break
    return Found(read(list(range(at))), at)
