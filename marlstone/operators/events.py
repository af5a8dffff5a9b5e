"""Rows of several seats a day, brought to one row per date and code."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what an institutional seat's name contains.
INSTITUTION = "机构专用"


def seat_features(seats: DataFrame, marker: str = INSTITUTION, top: int = 5) -> DataFrame:
    """(date, code, org_count, top_net_share): seats of institutions, and the largest net purchases' share of all absolute ones."""
    w = Window.partitionBy("date", "code").orderBy(F.col("net_buy_amount").desc_nulls_last())
    ranked = seats.withColumn("_n", F.row_number().over(w))
    marked = F.coalesce(F.col("org_name").contains(marker), F.lit(False))
    net = F.col("net_buy_amount")
    return ranked.groupBy("date", "code").agg(
        F.sum(marked.cast("double")).alias("org_count"),
        F.try_divide(F.sum(F.when(F.col("_n") <= top, net)), F.nullif(F.sum(F.abs(net)), F.lit(0.0))).alias("top_net_share"),
    )
