"""As-of joins without a non-equi join: union both sides and carry the last right row forward."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              values: list[str], inclusive: bool = True, block: str | None = None,
              seq: str | None = None) -> DataFrame:
    """For every left row the right values with the latest right_time <= left_time (< when not inclusive).

    Right times must be unique per key; `seq` names a column of both sides that orders rows of the same time. Without `block` one task sees one key, which is fine for panels bounded by the
    calendar. For unbounded left sides give a truncation unit ('month', 'week', 'day'): work is then split by
    (key, block), and a small table of last values per block carries the state across block borders, so a key with a
    third of all rows is spread over as many tasks as it has blocks.
    """
    payload = F.struct(*[F.col(v) for v in values])
    names = [c for c in left.columns]
    left_rows = left.select(*keys, F.struct(*names).alias("_row"), F.col(left_time).alias("_t"),
                            (F.col(seq) if seq else F.lit(0)).alias("_seq"),
                            F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_value"),
                            F.lit(1 if inclusive else -1).alias("_side"))
    right_rows = right.select(*keys, F.lit(None).cast(left_rows.schema["_row"].dataType).alias("_row"),
                              F.col(right_time).alias("_t"), (F.col(seq) if seq else F.lit(0)).alias("_seq"), payload.alias("_value"), F.lit(0).alias("_side"))
    parts = list(keys)
    both = left_rows.unionByName(right_rows)
    if block:
        tag = F.date_trunc(block, F.col("_t")).alias("_block")
        parts.append("_block")
        ends = (right_rows.groupBy(*keys, tag).agg(F.max_by("_value", F.struct("_t", "_seq")).alias("_end"))
                .unionByName(left_rows.select(*keys, tag, F.lit(None).cast(both.schema["_value"].dataType).alias("_end"))
                             .dropDuplicates([*keys, "_block"])))
        ends = ends.groupBy(*keys, "_block").agg(F.first("_end", ignorenulls=True).alias("_end"))
        before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        carried = (ends.withColumn("_value", F.last("_end", ignorenulls=True).over(before))
                   .where(F.col("_value").isNotNull())
                   .select(*keys, F.lit(None).cast(left_rows.schema["_row"].dataType).alias("_row"),
                           F.col("_block").cast(both.schema["_t"].dataType).alias("_t"),
                           F.lit(None).cast(both.schema["_seq"].dataType).alias("_seq"), "_value",
                           F.lit(-2).alias("_side"), "_block"))
        both = both.withColumn("_block", F.date_trunc(block, F.col("_t"))).unionByName(carried)
    w = Window.partitionBy(*parts).orderBy("_t", "_seq", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return (both.withColumn("_value", F.last("_value", ignorenulls=True).over(w))
            .where(F.col("_row").isNotNull())
            .select("_row.*", *[F.col(f"_value.{v}").alias(v) for v in values]))


def asof_daily(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """As-of join by date against a slowly changing table, as two equi-joins.

    Each right row is spread over the days until its successor, which makes a lookup table of one row per key and day; the
    last row per key covers everything after. Where those tables are small Spark broadcasts them by itself, and a left
    side of any size, with any skew, is not shuffled at all.
    """
    w = Window.partitionBy(*keys).orderBy("_rt")
    # of several right rows on one date the one with the largest values holds: two would overlap
    single = right.groupBy(*keys, F.col(right_time).cast("date").alias("_rt")).agg(F.max(F.struct(*values)).alias("_v"))
    dated = single.withColumn("_next", F.lead("_rt").over(w))
    daily = dated.where("_next IS NOT NULL").select(*keys, F.explode(F.sequence("_rt", F.date_sub("_next", 1))).alias("_day"), F.col("_v").alias("_dv"))
    last = dated.where("_next IS NULL").select(*keys, F.col("_rt").alias("_lt"), F.col("_v").alias("_lv"))
    out = left.withColumn("_day", F.col(left_time).cast("date")).join(daily, [*keys, "_day"], "left")
    if keys:
        out = out.join(last, keys, "left")
    else:       # a single series: its last row is one value
        out = out.withColumn("_last", last.select(F.struct("_lt", "_lv")).scalar()).select("*", "_last.*")
    value = F.coalesce("_dv", F.when(F.col("_day") >= F.col("_lt"), F.col("_lv")))
    return out.withColumn("_value", value).select(*left.columns, *[F.col(f"_value.{v}").alias(v) for v in values])
