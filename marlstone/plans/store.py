"""Factor values at rest: one long table, a folder for each factor, with a manifest beside it."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.factors import get_factor
from marlstone.operators.panels import duplicate_keys, manifest, manifests, upsert
from marlstone.sources.files import Folder, Versions

COLUMNS = ["date", "code", "value"]
#: Files that one factor of a batch is spread over, at most.
PARTS = 8


class FactorStore:
    """Values under ``root``/factor, in versions; the highest that has a marker is current, so a failed write changes nothing."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, name: str) -> Versions:
        return Versions(Folder(self.spark, f"{self.root}/{name}"))

    def info(self, name: str) -> dict | None:
        """The manifest of the current version; None if there is none."""
        return self._versions(name).current()

    def load(self, name: str) -> DataFrame:
        info = self.info(name)
        if info is None:
            raise FileNotFoundError(f"factor {name!r} has not been built")
        return self.spark.read.parquet(info["path"])

    def write(self, name: str, values: DataFrame, built_at: dt.datetime | None = None) -> dict:
        """Check the contract, write a new version, and name it as current."""
        check_contract(values)
        number = max(self._versions(name).numbers(), default=0) + 1
        path = self._versions(name).place(number)
        values.select(*COLUMNS).write.mode("overwrite").parquet(path)
        return self._name(name, number, path, manifest(self.spark.read.parquet(path)).first().asDict(), built_at)

    def _name(self, name: str, number: int, path: str, facts: dict, built_at: dt.datetime | None) -> dict:
        try:
            spec = get_factor(name)
            about = {"category": spec.category, "description": spec.description, "inputs": list(spec.inputs)}
        except KeyError:
            about = {}
        info = {"name": name, **about, **{k: str(v) if isinstance(v, dt.date) else v for k, v in facts.items()}, "version": number, "path": path, "built_at": str(built_at or dt.datetime.now())}
        self._versions(name).name(number, info)
        return info

    def write_all(self, values: DataFrame, names: list[str], built_at: dt.datetime | None = None) -> dict[str, dict]:
        """Versions of many factors from (factor, date, code, value): one pass writes them all, one more makes their manifests."""
        batch = f"{self.root}/_batches/{uuid.uuid4().hex}"
        long = values.where(F.col("factor").isin(names)).select("factor", *COLUMNS)
        long.repartition(F.col("factor"), F.pmod(F.xxhash64("code"), F.lit(PARTS))).write.partitionBy("factor").parquet(batch)
        written = self.spark.read.schema(long.schema).parquet(batch)
        check_contract(written, ("factor", "date", "code"))
        facts = {r.factor: r.asDict() for r in manifests(written).collect()}  # a row for each factor
        out = {}
        for n in names:
            number = max(self._versions(n).numbers(), default=0) + 1
            # a factor without values has no folder in the batch: it gets an empty one
            path = f"{batch}/factor={n}"
            if n not in facts:
                path = self._versions(n).place(number)
                long.where("false").select(*COLUMNS).write.mode("overwrite").parquet(path)
            own = facts.get(n) or dict.fromkeys(("rows", "cols", "non_null_cells", "last_day_codes"), 0) | {"last_date": None, "coverage_ratio": None}
            out[n] = self._name(n, number, path, {k: v for k, v in own.items() if k != "factor"}, built_at)
        return out

    def add(self, name: str, values: DataFrame) -> dict:
        """Merge new values by key into the current ones; new ones win."""
        return self.write(name, values if self.info(name) is None else upsert(self.load(name), values.select(*COLUMNS), ["date", "code"]))

    def add_all(self, values: DataFrame, names: list[str]) -> dict[str, dict]:
        """The same for many factors at once."""
        stored = [self.load(n).select(F.lit(n).alias("factor"), *COLUMNS) for n in names if self.info(n) is not None]
        new = values.where(F.col("factor").isin(names)).select("factor", *COLUMNS)
        merged = upsert(reduce(DataFrame.unionByName, stored), new, ["factor", "date", "code"]) if stored else new
        return self.write_all(merged, names)


def check_contract(values: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> None:
    """One value per date and code."""
    missing = [c for c in COLUMNS if c not in values.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; there are {values.columns}")
    twice = duplicate_keys(values, keys).limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['date']}, {twice[0]['code']} occurs {twice[0]['count']} times")


def to_wide(values: DataFrame, codes: list) -> DataFrame:
    """Dates by codes, for export; the codes are named so that no pass is needed to find them."""
    return values.groupBy("date").pivot("code", codes).agg(F.max("value"))


def from_wide(wide: DataFrame, date: str = "date") -> DataFrame:
    """(date, code, value) of a table with a column per code, missing cells left out."""
    codes = [c for c in wide.columns if c != date]
    return wide.unpivot([date], codes, "code", "value").where("value IS NOT NULL")


def save_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions, a folder for each date; dates that are written again are replaced, the others stay."""
    predictions.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
