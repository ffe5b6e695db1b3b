"""Row numbers inside groups of any size, without gathering a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainspark.session import cut_lineage


def rank_within(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row in its group by the order columns.

    Rows are dealt by range of (group, order), so a group that holds a third of all rows spans many
    partitions. Each partition numbers its own rows; the rows that a group has in earlier
    partitions come from one count per (group, partition). The range-dealt rows are written to the
    shared folder first: both steps then see the same partitions, also after a lost executor.
    Rows with equal order columns are numbered in any order; null groups are a group.
    """
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut_lineage(df.repartitionByRange(slots, *group, *order)
                        .withColumn("_slot", F.spark_partition_id()))
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy(*group, "_slot").agg(F.count("*").alias("_n"))
               .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
               .select(*[F.col(g).alias(f"_o_{g}") for g in group], F.col("_slot").alias("_o_slot"), "_before"))
    numbered = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*group, "_slot").orderBy(*order)))
    same = F.col("_slot") == F.col("_o_slot")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_o_{g}"))
    return (numbered.join(offsets, same).withColumn(name, F.col(name) + F.col("_before"))
            .drop("_slot", "_o_slot", "_before", *[f"_o_{g}" for g in group]))
