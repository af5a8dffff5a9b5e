"""Command line: list factors, show what is due, build."""

from __future__ import annotations

import argparse
import datetime as dt
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.factors import all_factors, ordered_names
from marlstone.plans.run import plan, run, run_each, slowest
from marlstone.plans.store import FactorStore
from marlstone.sources.catalog import ParquetCatalog
from marlstone.sources.feather import write_factors
from marlstone.sources.files import Folder
from marlstone.sources.tables import load_pool


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m marlstone.plans.cli", description=__doc__)
    p.add_argument("--list", action="store_true", help="names by category")
    p.add_argument("--all", action="store_true", help="all factors and labels")
    p.add_argument("--targets-only", action="store_true")
    p.add_argument("--skip-targets", action="store_true")
    p.add_argument("--factor", action="append", default=[], help="one factor; may be repeated")
    p.add_argument("--force", action="store_true", help="rebuild what is up to date too")
    p.add_argument("--check-dates", action="store_true", help="just show what is due")
    p.add_argument("--source", default="data/source", help="folder of source tables")
    p.add_argument("--store", default="data/factors", help="folder of factor values")
    p.add_argument("--pool", help="text file of codes")
    p.add_argument("--wide", help="folder that gets a wide file for each factor built")
    p.add_argument("--manifest", help="file that gets the manifests of the factors built, one JSON object a line")
    p.add_argument("--timing", action="store_true", help="build one by one and show the slowest")
    return p


def chosen(args: argparse.Namespace) -> list[str]:
    names = args.factor or list(all_factors())
    if args.targets_only:
        names = [n for n in names if all_factors()[n].category == "target"]
    if args.skip_targets:
        names = [n for n in names if all_factors()[n].category != "target"]
    return ordered_names(names)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.list:
        for n in ordered_names():
            spec = all_factors()[n]
            print(f"{spec.category}\t{n}\t{', '.join(spec.inputs)}\t{spec.description}")
        return 0
    if not (args.all or args.targets_only or args.factor or args.check_dates):
        parser().print_help()
        return 2
    spark = SparkSession.builder.appName("marlstone").getOrCreate()
    catalog = ParquetCatalog(spark, args.source, load_pool(spark, args.pool) if args.pool else None)
    store = FactorStore(spark, args.store)
    if args.check_dates:
        for n, d in plan(catalog, store, chosen(args), dt.datetime.now(), args.force).items():
            print(f"{n}\t{d.action}\t{d.reason}")
        return 0
    if args.timing:
        for n, seconds in slowest(run_each(catalog, store, chosen(args), dt.datetime.now(), args.force)):
            print(f"{n}\t{seconds:.1f} s")
        return export(args, store)
    for n, action in run(catalog, store, chosen(args), dt.datetime.now(), args.force).items():
        print(f"{n}\t{action}")
    return export(args, store)


def export(args: argparse.Namespace, store: FactorStore) -> int:
    """The files that were asked for beside the store."""
    built = [n for n in chosen(args) if store.info(n) is not None]
    if args.wide and built:
        write_factors(reduce(DataFrame.unionByName, [store.load(n).select(F.lit(n).alias("factor"), "date", "code", "value") for n in built]), args.wide)
    if args.manifest:
        folder, _, name = args.manifest.rpartition("/")
        Folder(store.spark, folder or ".").write(name, "".join(json.dumps(store.info(n)) + "\n" for n in built).encode())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
