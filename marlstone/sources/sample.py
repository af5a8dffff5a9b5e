"""A catalog over the driver's tables, so that every panel and factor can be run and checked without market data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.sources import sample_measures as M
from marlstone.sources.catalog import Catalog

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


class SampleCatalog(Catalog):
    marker = M.MARKER

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__()
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _lines(self, unit: str) -> DataFrame:
        day = F.trunc("l_shipdate", unit) if unit != "day" else F.col("l_shipdate").cast("date")
        return self.read("lineitem").select(day.alias("date"), F.col("l_suppkey").alias("code"), "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("q"), F.expr(CENTS).alias("p"))

    def _bars(self, unit: str) -> DataFrame:
        key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "p")
        bars = self._lines(unit).groupBy("date", "code").agg(
            F.min_by("p", key).cast("double").alias("open"),
            F.expr("CASE WHEN max_by(p, struct(l_orderkey, l_linenumber, l_partkey, p)) % 97 = 0 THEN NULL ELSE max_by(p, struct(l_orderkey, l_linenumber, l_partkey, p)) END").cast("double").alias("close"),
            F.max("p").cast("double").alias("high"),
            F.min("p").cast("double").alias("low"),
            F.sum("q").alias("vol"),
            F.sum("p").cast("double").alias("amount"),
        )
        from pyspark.sql import Window

        before = F.lag("close").over(Window.partitionBy("code").orderBy("date"))
        return bars.withColumn("pre_close", before).withColumn("pct_chg", (F.col("close") / F.col("pre_close") - 1) * 100)

    def _sums(self, measures: dict[str, str]) -> DataFrame:
        return self._lines("week").groupBy("date", "code").agg(*[F.expr(e).cast("double").alias(n) for n, e in measures.items()])

    def _event(self, name: str) -> DataFrame:
        e = self.read("events").select(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("code"), "event_type", "event_id", F.expr("CAST(round(value * 100) AS BIGINT)").alias("v"))
        if name == "dragon_tiger":
            return e.select("date", "code", F.expr("CASE WHEN v % 17 = 0 THEN NULL ELSE event_type END").alias("org_name"), (F.col("v") - 3000).cast("double").alias("net_buy_amount"))
        only = {"top_list": "event_type IN ('view', 'click', 'signup')", "limit_up": "event_type IN ('purchase', 'view')", "limit_list": "true"}[name]
        limit = F.when(F.col("event_type").isin("error", "view", "signup"), "Z").otherwise("U")
        return e.where(only).select("date", "code", limit.alias("limit"), *[F.expr(x).alias(n) for n, x in M.EVENTS[name].items()])

    def table(self, name: str) -> DataFrame:
        if name in ("daily", "daily_adj", "kline_adj_weekly"):
            return self._bars("week")
        if name == "kline_adj_monthly":
            return self._bars("month")
        if name == "main_fund_flow":
            flow = self._sums(M.FLOW)
            net = sum((F.col(c) if c.startswith("buy") else -F.col(c) for c in M.FLOW), F.lit(0.0))
            return flow.withColumn("net_mf_amount", F.when(net % 23 != 0, net))
        if name == "margin_detail":
            return self._sums(M.MARGIN)
        if name in M.EVENTS or name == "dragon_tiger":
            return self._event(name)
        orders = self.read("orders").select((F.col("o_custkey") % M.CODES).alias("code"), F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", "o_custkey", F.expr("CAST(round(o_totalprice * 100) AS BIGINT)").alias("p"))
        if name == "finance":
            customer = self.read("customer").select(F.col("c_custkey").alias("o_custkey"), F.expr("CAST(round(c_acctbal * 100) AS BIGINT)").alias("a"))
            sums = orders.join(customer, "o_custkey").groupBy(F.trunc("day", "week").alias("date"), "code").agg(F.sum("p").alias("c"), F.max("a").alias("bal"))
            return sums.select("date", "code", *[F.expr(e).alias(n) for n, e in M.FINANCE.items()])
        if name in M.REPORTS:
            end = F.date_sub("day", (F.col("o_orderkey") % 90).cast("int"))
            reports = orders.select("code", F.col("day").alias("ann_date"), end.alias("end_date"), "o_orderkey", F.col("p").alias("c"))
            values = [F.expr(e).alias(n) for n, e in M.REPORTS[name].items()]
            # the order breaks ties of the period's end, as a source's own version number would
            return reports.select("code", "ann_date", F.struct("end_date", "o_orderkey").alias("end_date"), *values)
        if name == "calendar":
            span = self.read("orders").agg(F.max(F.col("o_orderdate").cast("date")).alias("b"))
            days = span.select(F.explode(F.sequence(F.lit(M.CALENDAR_START).cast("date"), F.col("b"))).alias("date"))
            return days.withColumn("is_open", F.when(F.dayofweek("date").isin(1, 7), 0).otherwise(1))
        if name == "stock_list":
            nation = self.read("nation").select("n_nationkey", F.col("n_regionkey").alias("industry"))
            return self.read("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.when(F.col("s_nationkey") != 7, F.col("industry")).alias("industry"))
        parts = self.read("lineitem").join(self.read("part"), F.col("l_partkey") == F.col("p_partkey"))
        if name == "ths_daily":
            return parts.groupBy(F.trunc("l_shipdate", "week").alias("date"), F.col("p_brand").alias("sector")).agg(F.max(F.expr(CENTS)).cast("double").alias("close"))
        if name == "ths_constituent_stocks":
            pairs = parts.groupBy(F.col("l_suppkey").alias("code"), F.col("p_brand").alias("sector")).agg(F.sum(F.expr(CENTS)).alias("c"))
            return pairs.where("c % 3 = 0").select("code", "sector")
        if name == "ths_sector_categories":
            return self.read("part").select(F.col("p_brand").alias("sector"), F.when(F.col("p_brand").endswith("3"), "N").otherwise("I").alias("type")).distinct()
        raise KeyError(name)
