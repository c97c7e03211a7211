"""The rank of every document in its query, without a task that holds a query.

A window over the query would sort each query's rows in one task, so a query
with a third of all rows would be one task.  Here the rows are dealt by ranges of
(query, order), which cut large queries into as many ranges as they need; each
range numbers its own rows, and one counter per (range, query), summed along a
query's ranges, gives the rows before.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialized
from .ranking import ideal_order, rank_order


def full_rank(df: DataFrame, qid: str = "qid", score: str = "score", tie: Sequence[str] = ("global_idx",),
              by: Sequence[str] = (), ideal: bool = False, rank_col: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank of each row in its query.

    Ordered by ``score`` descending, NaN and null last, or with ``ideal`` by a
    label descending; then by ``tie``, which must tell rows of a query apart
    for ranks to be reproducible.  A null query is a query.
    """
    keys = [*by, qid]
    order = ideal_order(score, tie) if ideal else rank_order(score, tie)
    dealt = df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__range", F.spark_partition_id())
    rows = materialized(dealt, "ranges")
    counts = rows.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"))
    along = Window.partitionBy(*keys).orderBy("__range")
    # one row per range and query: a query in one range has none before it
    before = counts.select("__range", *keys, (F.sum("__n").over(along) - F.col("__n")).alias("__before")).where("__before > 0")
    # a range that starts inside a query has that one query only with rows before it
    before = before.select("__range", F.struct(*keys).alias("__key"), "__before")
    local = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*order))
    out = rows.withColumn(rank_col, local).join(F.broadcast(before), "__range", "left")
    same = F.col("__key").eqNullSafe(F.struct(*keys))
    rank = F.when(same, F.col(rank_col) + F.col("__before")).otherwise(F.col(rank_col)).cast("long")
    return out.withColumn(rank_col, rank).drop("__range", "__key", "__before")
