"""``python -m plait.cli FOLDER [--schemas FOLDER]``: a prompt for join queries."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from plait.catalog import Catalog, load_schemas
from plait.parser import parse
from plait.plans.lab import Timings, report, run_top
from plait.plans.tree import plan

HELP = """help      this text
exit      leave
tables    the tables and their columns
plans Q   rank, run and time the cheapest plans of query Q
explain Q the plan of query Q
Q         T1 <INNER|LEFT|RIGHT|FULL|SEMI|ANTI|ASOF> T2 ON a <op> b [<TYPE> T3 ON ...], op one of = <> < <= > >="""


def answer(line: str, catalog: Catalog, show: int = 20) -> str:
    """What the prompt says to a line."""
    word, _, rest = line.strip().partition(" ")
    if word == "help" or not word:
        return HELP
    if word == "tables":
        return "\n".join(f"{t}: {', '.join(c.name for c in catalog.defs[t].columns)}" for t in catalog.tables())
    try:
        specs = parse(rest if word in ("plans", "explain") else line)
        if not specs:
            return "no joins"
        timings = Timings()
        if word == "plans":
            return report(run_top(specs, catalog, timings=timings)) + f"\n{timings.report()}"
        with timings.measure("plan"):
            df = plan(specs, catalog)
        if word == "explain":
            from plait.plans.lab import explain

            return explain(df)
        with timings.measure("run"):
            rows = df._jdf.showString(show, 40, False)
        return rows + timings.report()
    except ValueError as e:
        return f"error: {e}"


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder", help="tables: NAME.tbl with --schemas, or NAME.parquet")
    p.add_argument("--schemas", help="folder of YAML declarations")
    p.add_argument("--tables", nargs="*", default=["region", "nation", "customer", "supplier", "part", "orders", "lineitem"])
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("plait").getOrCreate()
    catalog = Catalog(spark)
    if a.schemas:
        catalog.register_pipe(a.folder, load_schemas(a.schemas))
    else:
        catalog.register_parquet(a.folder, a.tables)
    print(HELP)
    for line in sys.stdin:
        if line.strip() == "exit":
            break
        print(answer(line, catalog))


if __name__ == "__main__":
    main()
