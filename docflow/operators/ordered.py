"""Running sums and ranks that stay spread out when one group holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from docflow.session import durable

PART_ROWS = 10_000


def part_of(order: Column, part_rows: int = PART_ROWS) -> Column:
    """Number of the stretch of `part_rows` consecutive order values a row lies in."""
    return F.floor(order / part_rows).cast("bigint")


def running_sums(df: DataFrame, keys: list[str], order: str, values: dict[str, Column],
                 descending: bool = False, part_rows: int = PART_ROWS, limit: int | None = None) -> DataFrame:
    """Add `run_<name>` (up to and including the row) and `tot_<name>` (whole group) per value.

    `order` is a whole number, unique in its group, dense or not. Groups are cut
    into stretches of it: each stretch is summed where it lies, the sums are
    accumulated in the same way, and rows are only windowed within their
    stretch. So no task ever holds a whole group.

    With `limit`, only rows whose first running sum is at most that are kept;
    stretches that lie wholly beyond it go before the rows are shuffled. The
    values must not be negative then.
    """
    direction = F.desc if descending else F.asc
    named = list(values)
    rows = df.withColumns({"_part": part_of(F.col(order), part_rows),
                           **{f"_v_{n}": values[n].cast("bigint") for n in named}})
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in named])
    span = rows.agg(F.max("_part") - F.min("_part")).first()[0] or 0
    offsets = _sums_before(parts, keys, named, direction, part_rows, span).drop(*[f"_p_{n}" for n in named])
    running = F.col(f"run_{named[0]}") <= limit if limit is not None else F.lit(True)
    if limit is not None:
        offsets = offsets.filter(F.col(f"_o_{named[0]}") <= limit)
    within = W.partitionBy(*keys, "_part").orderBy(direction(order)).rowsBetween(W.unboundedPreceding, 0)
    return (rows.join(offsets, [*keys, "_part"])
            .withColumns({f"run_{n}": F.col(f"_o_{n}") + F.sum(f"_v_{n}").over(within) for n in named})
            .filter(running)
            .drop("_part", *[f"_v_{n}" for n in named], *[f"_o_{n}" for n in named]))


def _sums_before(parts: DataFrame, keys: list[str], named: list[str], direction, part_rows: int, span: int) -> DataFrame:
    """Parts with the sums of earlier parts (`_o_<name>`) and of the group (`tot_<name>`).

    Parts whose numbers span more than `part_rows` are themselves cut into
    stretches, and so on, so that a sparse order never brings a group together.
    """
    step = max(part_rows, 1000)  # a stretch of sums is a few numbers a row
    if span <= step:
        group = W.partitionBy(*keys)
        before = group.orderBy(direction("_part")).rowsBetween(W.unboundedPreceding, -1)
        return parts.withColumns({**{f"_o_{n}": F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)) for n in named},
                                  **{f"tot_{n}": F.sum(f"_p_{n}").over(group) for n in named}})
    cut = parts.withColumn("_up", part_of(F.col("_part"), step))
    above = _sums_before(cut.groupBy(*keys, F.col("_up").alias("_part")).agg(*[F.sum(f"_p_{n}").alias(f"_p_{n}") for n in named]),
                         keys, named, direction, part_rows, span // step + 1)
    above = above.select(*keys, F.col("_part").alias("_up"), *[F.col(f"_o_{n}").alias(f"_a_{n}") for n in named], *[f"tot_{n}" for n in named])
    before = W.partitionBy(*keys, "_up").orderBy(direction("_part")).rowsBetween(W.unboundedPreceding, -1)
    return (cut.join(above, [*keys, "_up"])
            .withColumns({f"_o_{n}": F.col(f"_a_{n}") + F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)) for n in named})
            .drop("_up", *[f"_a_{n}" for n in named]))


def rank_rows(df: DataFrame, keys: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Add the 1-based place of each row in its group, for groups of any size. `order` is unique in a group.

    Range partitioning on group and order cuts a big group at its order values;
    a row's place is its place in the partition plus the sizes of the group's
    earlier partitions. The sorted rows are made durable first, since a second
    sampling could cut elsewhere.
    """
    placed = durable(
        df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
        .withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()}))
    sizes = placed.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_mid").alias("_first"))
    before = W.partitionBy(*keys).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_pid", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (placed.join(offsets, [*keys, "_pid"])
            .withColumn(name, F.col("_before") + F.col("_mid") - F.col("_first") + 1)
            .drop("_pid", "_mid", "_first", "_before"))
