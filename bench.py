"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with the median of warm runs, after each answer is held against DuckDB.

Beside the whole time of each query stands what planning takes of it, without a job. The first six run once
more over orders, events and parts repeated $BENCH_TIMES times, where reading outweighs starting.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time
from collections.abc import Callable

import duckdb
from pyspark.sql import SparkSession

from tallyhouse.queries import SQL, TABLES, engine, plain

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TIMES = int(os.environ.get("BENCH_TIMES", "40"))
RUNS = 3

#: The six question shapes first, then joins, windows, rollups and ties.
HEADLINE = ("count_ge", "intersect_count", "sum_where", "group_count", "top_n", "count_distinct", "group_bucket_month", "rollup", "join_inner_group", "semi_join", "row_number", "limit_with_ties", "scalar_math")


def answers(table) -> list[tuple]:
    show = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in zip(*[table.column(c).to_pylist() for c in sorted(table.column_names)], strict=True))


def median(run: Callable[[], object]) -> float:
    times = []
    for _ in range(RUNS):
        begun = time.perf_counter()
        run()
        times.append(time.perf_counter() - begun)
    return round(statistics.median(times), 4)


def larger(spark: SparkSession, to: str) -> dict[str, dict[str, float]]:
    """The first six over repeated tables, ours and DuckDB's, both from the same Parquet files."""
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    tables = ("orders", "events", "part")
    for t in tables:
        duck.execute(f"COPY (SELECT t.* FROM '{SF_DIR}/{t}.parquet' t, range({TIMES})) TO '{to}/{t}.parquet' (FORMAT PARQUET, ROW_GROUP_SIZE 200000)")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet'")
    own = engine(spark, to, *tables)
    out: dict[str, dict[str, float]] = {"queries": {}, "duckdb": {}}
    for name in HEADLINE[:6]:
        plain(own.sql(SQL[name][0])).toArrow()
        out["queries"][name] = median(lambda name=name: plain(own.sql(SQL[name][0])).write.format("noop").mode("overwrite").save())
        out["duckdb"][name] = median(lambda name=name: duck.sql(SQL[name][1]).to_arrow_table())
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    duck.execute("SET timezone = 'UTC'")
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    out, plan, peer, wrong = {}, {}, {}, []
    own = engine(spark, SF_DIR)
    for name in HEADLINE:
        run = lambda text=SQL[name][0]: plain(own.sql(text))
        if answers(run().toArrow()) != answers(duck.sql(SQL[name][1]).to_arrow_table()):
            wrong.append(name)
        out[name] = median(lambda: run().write.format("noop").mode("overwrite").save())  # noqa: B023
        plan[name] = median(lambda: run()._jdf.queryExecution().executedPlan())  # noqa: B023
        peer[name] = median(lambda: duck.sql(SQL[name][1]).to_arrow_table())  # noqa: B023
    folder = tempfile.mkdtemp(prefix="bench-")
    try:
        large = larger(spark, folder)
    finally:
        shutil.rmtree(folder)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "planning": plan, "duckdb": peer, "large": {"times": TIMES, **large}, "wrong": wrong, "sf": os.path.basename(SF_DIR)}))
    sys.exit(bool(wrong))


if __name__ == "__main__":
    main()
