"""Ranks, running totals and exact quantiles without a one-task sort.

Rows are range partitioned by their order and written to the checkpoint folder
(so that ranges stay the same for every use); a total per range gives each range
its start, and a window within one range the rest.  No task sees more than one
range, and the totals have one row per range.  The checkpoint runs when the frame
is made, not when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def running_totals(df: DataFrame, by: str, order: str, amounts: list[str]) -> DataFrame:
    """Add ``before_<amount>``: the sum of the amount over the rows of the same
    ``by`` that come earlier in ``order``.  ``by`` and ``order`` are unique together."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(by, order).withColumn("_range", F.spark_partition_id()).checkpoint()
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(by, "_range").agg(*[F.sum(a).alias(a) for a in amounts]).select(
        by, "_range", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_start_{a}") for a in amounts])
    within = Window.partitionBy(by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(starts, [by, "_range"]).select(
        *df.columns, *[(F.col(f"_start_{a}") + F.coalesce(F.sum(a).over(within), F.lit(0))).alias(f"before_{a}")
                       for a in amounts])


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n) of the non-null values of numeric columns, with ``before_n``."""
    long = df.select(*columns).unpivot([], columns, "name", "value").where("value IS NOT NULL")
    return running_totals(long.groupBy("name", "value").agg(F.count("*").alias("n")), "name", "value", ["n"])


def quantiles(counts: DataFrame, share: float) -> DataFrame:
    """(name, quantile, mean) from ``value_counts``: exact, with linear
    interpolation between neighbouring ranks."""
    totals = F.broadcast(counts.groupBy("name").agg(F.sum("n").alias("_total")))
    place = F.lit(share) * (F.col("_total") - 1)
    at = counts.join(totals, "name").withColumns({"_low": F.floor(place), "_high": F.ceil(place),
                                                  "_part": place - F.floor(place)})

    def value(rank):
        r = F.col(rank)
        return F.max(F.when((F.col("before_n") <= r) & (r < F.col("before_n") + F.col("n")), F.col("value")))
    ends = at.groupBy("name").agg(value("_low").alias("_x"), value("_high").alias("_y"), F.max("_part").alias("_part"),
                                  (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"))
    return ends.select("name", (F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_part")).alias("quantile"), "mean")


def first_share(df: DataFrame, by: str, key: str, of: int) -> DataFrame:
    """Add ``is_first``: is the row's ``key`` among the first 1/``of`` (rounded up)
    of the rows with its ``by``, a column of few values?  Equal keys share the answer.
    What is known of each ``by`` is broadcast: a join on it would send all rows of one
    value to one task."""
    counts = df.groupBy(by, key).agg(F.count("*").alias("n"))
    run = running_totals(counts, by, key, ["n"])
    totals = run.groupBy(by).agg(F.ceil(F.sum("n") / of).alias("_take"))
    last = run.join(F.broadcast(totals), by).where(F.col("before_n") < F.col("_take")).groupBy(by).agg(F.max(key).alias("_last"))
    return df.join(F.broadcast(last), by).withColumn("is_first", F.col(key) <= F.col("_last")).drop("_last")


def with_previous(df: DataFrame, by: list[str], order: list[str], carry: list[str], wanted) -> DataFrame:
    """The rows of ``df`` that have a previous row of the same ``by`` in ``order`` and
    for which ``wanted`` (a condition on the row and ``prev_<column>`` of ``carry``) holds.

    Equal to lag() over partitions by ``by``, with no such partition as a unit of
    work: rows are range partitioned by ``by`` and ``order`` (which are unique
    together) and sorted, each row is given its predecessor within the range, and a
    carry with the first and the last row of every range gives the first rows theirs.
    A row whose ``by`` has a null has no previous row.
    The only exchange of the rows is the one into ranges; what ``wanted`` selects is
    checkpointed, so the frame is computed when it is made.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    checkpoint_dir(df.sparkSession)
    cols = df.columns
    both = T.StructType(df.schema.fields + [T.StructField(f"prev_{c}", df.schema[c].dataType) for c in carry]
                        + [T.StructField("_edge", T.IntegerType()), T.StructField("_range", T.IntegerType())])
    arrow = to_arrow_schema(both)

    def shift(batches):
        here = TaskContext.get().partitionId()
        last = None

        def out(rows, prev, edge):
            n = rows.num_rows
            return pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*rows.columns, *prev, pa.array(edge, pa.int32()), pa.array([here] * n, pa.int32())], arrow)],
                schema=arrow)

        for b in batches:
            if not b.num_rows:
                continue
            before = pa.Table.from_batches(([last] if last is not None else []) + [b.slice(0, b.num_rows - 1 if last is not None else b.num_rows)])
            if last is None:  # the first row of the range: its predecessor lies in another
                before = pa.Table.from_batches([b.slice(0, 1), b.slice(0, b.num_rows - 1)])
            same = None
            for c in by:
                eq = pc.fill_null(pc.equal(before[c].combine_chunks(), b.column(c)), False)
                same = eq if same is None else pc.and_(same, eq)
            prev = [pc.if_else(same, before[c].combine_chunks(), pa.scalar(None, b.column(c).type)) for c in carry]
            edge = [0] * b.num_rows
            if last is None:
                edge[0] = 1
            yield out(b, prev, edge)
            last = b.slice(b.num_rows - 1, 1)
        if last is not None:
            yield out(last, [pa.nulls(1, last.column(c).type) for c in carry], [2])

    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    near = ranged.mapInArrow(shift, both)
    inside = (F.col("_edge") == 0) & F.col(f"prev_{carry[0]}").isNotNull() & wanted
    near = near.where((F.col("_edge") > 0) | inside).checkpoint()
    # One first and one last row for each range.
    line = Window.orderBy("_range", "_edge")
    borders = near.where("_edge > 0").select(*cols, "_edge", "_range", *[F.lag(c).over(line).alias(f"prev_{c}") for c in carry],
                                             *[F.lag(c).over(line).alias(f"_by_{c}") for c in by])
    met = F.col("_edge") == 1
    for c in by:
        met = met & (F.col(c) == F.col(f"_by_{c}"))
    names = [*cols, *[f"prev_{c}" for c in carry]]
    return near.where("_edge = 0").select(*names).unionByName(
        borders.where(met & F.col(f"prev_{carry[0]}").isNotNull() & wanted).select(*names))
