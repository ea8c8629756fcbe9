"""Size-tiered compaction: which segments to merge, and the merge.

The planner sees one row for each segment, never a point.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.reads import KEY


def plan_size_tiered(sizes: Iterable[tuple], min_tables: int = 4, ratio: float = 1.5) -> list[list]:
    """Groups of segments to merge, from pairs ``(segment, bytes)``; any sortable names will do.

    Segments are taken by rising size. A bucket grows while the next size is at most ``ratio``
    times the bucket's average. Buckets of ``min_tables`` and more are merged.
    """
    buckets: list[list[tuple]] = []
    for name, size in sorted(sizes, key=lambda x: (x[1], x[0])):
        if buckets and size * len(buckets[-1]) <= ratio * sum(b for _, b in buckets[-1]):
            buckets[-1].append((name, size))
        else:
            buckets.append([(name, size)])
    return [sorted(g for g, _ in b) for b in buckets if len(b) >= min_tables]


def merge(*levels: DataFrame) -> DataFrame:
    """Newest generation of each key, with the generation it came from.

    ``gen`` stays on each row: if the merged generations aren't neighbours, a segment between
    them must still win or lose against each row by its own age.
    """
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.groupBy(*KEY).agg(F.max_by("value", "gen").alias("value"), F.max("gen").alias("gen"))
