"""python -m lakeweave COMMAND --root FOLDER --dt DAY ...: the steps of the daily warehouse from the command line."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import functions as F

from lakeweave.operators import governance, merge, quality
from lakeweave.plans.warehouse import DIMENSION, Warehouse
from lakeweave.session import get_spark
from lakeweave.sources import generated


def skew_bench(spark, rows: int, salts: int) -> None:
    """Seconds of the direct and the salted sum over the same skewed table, each after a warm-up, best of three."""
    s = generated.skewed(spark, rows).withColumn("amt", F.col("amt").cast("decimal(18,2)")).cache()
    s.count()
    plans = {"direct": merge.keyed_sum(s, "key", F.col("amt"), "s"), "salted": merge.salted_sum(s, "key", F.col("amt"), "s", salts)}
    took = {}
    for name, plan in plans.items():
        times = []
        for _ in range(4):
            began = time.perf_counter()
            plan.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = min(times[1:])
    same = plans["direct"].exceptAll(plans["salted"]).isEmpty()
    print({**{k: round(v, 4) for k, v in took.items()}, "speed_up": round(took["direct"] / took["salted"], 3), "same": same})


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lakeweave")
    p.add_argument("command", choices=["generate", "ods", "dwd", "dws", "ads", "stream", "check", "reconcile", "day", "compact", "schema", "lineage", "history", "skew-bench"])
    p.add_argument("--root", default="file:///tmp/lakeweave-warehouse")
    p.add_argument("--dt")
    p.add_argument("--customers", type=int, default=2000)
    p.add_argument("--applications", type=int, default=5000)
    p.add_argument("--batches", type=int, default=3)
    p.add_argument("--live", action="store_true", help="stream: append and run on")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--registry", help="a registry file, for schema and lineage")
    p.add_argument("--rows", type=int, default=300_000)
    p.add_argument("--salts", type=int, default=16)
    a = p.parse_args(args)
    spark = get_spark()
    w = Warehouse(spark, a.root)
    if a.command == "generate":
        w.generate(a.dt, a.customers, a.applications, a.batches)
    elif a.command == "dwd":
        w.dwd_customer(a.dt)
        w.dwd_facts(a.dt)
    elif a.command in ("ods", "dws", "ads"):
        getattr(w, a.command)(a.dt)
    elif a.command == "stream":
        if a.live:
            w.stream(False)
            spark.streams.awaitAnyTermination()
        w.stream().orderBy("window_start").show(20, False)
    elif a.command in ("check", "reconcile"):
        got = getattr(w, a.command)(a.dt)
        got.show(100, False)
        return 0 if quality.gate(got) else 1
    elif a.command == "day":
        return 0 if w.run_day(a.dt) else 1
    elif a.command == "compact":
        w.compact(dry_run=a.dry_run).show(100, False)
    elif a.command == "schema":
        got = w.drift(governance.load(spark, a.registry) if a.registry else w.registry(), a.dt)
        got.show(100, False)
        return int(not got.where("drift <> 'skipped'").isEmpty())
    elif a.command == "lineage":
        reg = governance.load(spark, a.registry) if a.registry else w.registry()
        outer = [(t, s["source"]) for t, s in reg.items() if s.get("source")]
        edges = governance.edges(governance.as_rows(spark, reg), spark.createDataFrame(outer, "table string, source string") if outer else None)
        print(governance.mermaid(reg, [tuple(r) for r in edges.collect()]))
    elif a.command == "history":
        w.store.history(DIMENSION).show(100, False)
    else:
        skew_bench(spark, a.rows, a.salts)
    return 0


if __name__ == "__main__":
    sys.exit(main())
