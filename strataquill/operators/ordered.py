"""Values carried along an order, in two levels, so that no task has to hold a whole hot group.

Rows of a group fall into buckets of the order. Within a bucket a window carries
the value; the buckets' last values are carried over buckets, of which there are
few, and joined back to the rows, one row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carried(rows: DataFrame, key: Sequence[str], order: Sequence[str], bucket: Column, values: dict[str, Column], inclusive: bool, backwards: bool = False) -> DataFrame:
    """``rows`` with, under each name, the last value that isn't null at or before the row (before it, unless ``inclusive``).

    ``order`` must break ties and ``bucket`` must grow with it; ``backwards``
    takes the order from its end.
    """
    way = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    held = rows.withColumn("_bucket", bucket)
    for n, v in values.items():
        held = held.withColumn(f"_v_{n}", v)
    inside = Window.partitionBy(*key, "_bucket").orderBy(*map(way, order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    over = Window.partitionBy(*key).orderBy(way("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*order)
    pick = F.min_by if backwards else F.max_by
    # a null place leaves the row out of the choice
    ends = held.groupBy(*key, "_bucket").agg(*(pick(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_e_{n}") for n in values))
    before = ends.select(*key, "_bucket", *(F.last(f"_e_{n}", True).over(over).alias(f"_b_{n}") for n in values)).where(" or ".join(f"_b_{n} is not null" for n in values))
    own = held.select(*rows.columns, "_bucket", *(F.last(f"_v_{n}", True).over(inside).alias(f"_i_{n}") for n in values))
    return own.join(before, [*key, "_bucket"], "left").select(*rows.columns, *(F.coalesce(f"_i_{n}", f"_b_{n}").alias(n) for n in values))
