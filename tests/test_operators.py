import datetime

import pytest
from pyspark.sql import functions as F

from lakeweave.functions.scalar import bucketize, count_where, plain_ratio, ratio, relative_gap, stable_hash
from lakeweave.operators import dimensions, governance, maintenance, merge, metrics, quality
from lakeweave.plans import serving
from lakeweave.sources import generated, readers, sinks
from lakeweave.sources.fs import Files, checked_day, checked_name, workspace
from lakeweave.sources.versioned import SnapshotStore
from lakeweave.streaming import windows


def got(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


D = datetime.date.fromisoformat


# ---------------------------------------------------------------- scalars


def test_bucketize(spark):
    df = spark.createDataFrame([(x,) for x in (None, -1, 0, 1, 30, 31, 60, 61)], "d int")
    labels = [r[0] for r in df.select(bucketize("d", [(30, "M1"), (60, "M2")], "M0", "M3+")).collect()]
    assert labels == ["M3+", "M1", "M0", "M1", "M1", "M2", "M2", "M3+"]


def test_ratios(spark):
    df = spark.createDataFrame([(1, 3), (1, 0), (0, None)], "a long, b long")
    assert got(df.select(ratio("a", "b"), plain_ratio("a", "b"))) == [(0.0, None), (0.3333, 0.3333), (1.0, None)]
    gaps = spark.createDataFrame([(100.0, 99.0), (0.0, 0.0), (0.0, 1.0), (None, None)], "b double, o double").select(relative_gap("b", "o"))
    assert [r[0] for r in gaps.collect()] == [0.01, 0.0, 1.0, 0.0]


def test_stable_hash(spark):
    import hashlib

    want = int(hashlib.sha256(b"a|1").hexdigest()[:12], 16)
    assert spark.range(1).select(stable_hash(F.lit("a"), F.lit(1))).first()[0] == want


# ---------------------------------------------------------------- upsert


CUR = [(1, "a", 1.0), (2, "b", 2.0), (None, "n", 0.0)]


def test_upsert_keeps_value_over_null(spark):
    cur = spark.createDataFrame(CUR, "k long, v string, x double")
    inc = spark.createDataFrame([(9, 1.5, None, 1), (9, 7.0, "new", 3), (9, 5.0, "m", None)], "extra int, x double, v string, k long")
    out = merge.upsert(cur, inc, ["k"])
    assert out.columns == ["k", "v", "x"]
    assert got(out) == sorted([(1, "a", 1.5), (2, "b", 2.0), (3, "new", 7.0), (None, "n", 0.0), (None, "m", 5.0)], key=str)
    assert (1, None, 1.5) in got(merge.upsert(cur, inc, ["k"], replace=True))
    twice = merge.upsert(out, inc.where("k is not null"), ["k"])
    assert got(twice) == got(out)  # merging again changes nothing


def test_upsert_edges(spark):
    cur = spark.createDataFrame(CUR, "k long, v string, x double")
    assert got(merge.upsert(None, cur, ["k"])) == got(cur)
    with pytest.raises(ValueError):
        merge.upsert(cur, cur.drop("x"), ["k"])
    double = spark.createDataFrame([(1, "p", 1.0), (1, "q", 1.0)], "k long, v string, x double")
    assert len([r for r in got(merge.upsert(cur, double, ["k"])) if r[0] == 1]) == 2


def test_union_by_name(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([("y", 2)], "v string, k int")
    assert got(merge.union_all(a, b)) == [(1, "x"), (2, "y")]


def test_salted_equals_direct(spark):
    s = generated.skewed(spark, 5000, hot=3, cold=50).withColumn("amt", F.col("amt").cast("decimal(18,2)"))
    assert got(merge.salted_sum(s, "key", F.col("amt"), "s", 7)) == got(merge.keyed_sum(s, "key", F.col("amt"), "s"))


# ---------------------------------------------------------------- dimensions


def snap(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, job string, city string, gender string")


ATTRS, TRACKED = ["job", "city", "gender"], ["job", "city"]


def step(history, snapshot, day, **more):
    return dimensions.apply_snapshot(history, snapshot, "id", ATTRS, day, TRACKED, **more)


def test_scd2_life(spark):
    h1 = step(None, snap(spark, ("a", "x", "p", "F"), ("b", "x", "p", "F"), ("c", "x", None, "F"), ("gone", "x", "p", "M")), "2024-01-01")
    h2 = step(h1, snap(spark, ("a", "y", "p", "F"), ("b", "x", "p", "M"), ("c", "x", "q", "F"), ("new", "z", "p", "F")), "2024-01-05")
    rows = {(r.id, r.start_date): (r.job, r.gender, r.end_date) for r in h2.collect()}
    forever = D("9999-12-31")
    assert rows[("a", D("2024-01-01"))] == ("x", "F", D("2024-01-04"))
    assert rows[("a", D("2024-01-05"))] == ("y", "F", forever)
    assert rows[("b", D("2024-01-01"))] == ("x", "F", forever)  # gender isn't tracked
    assert ("c", D("2024-01-05")) not in rows  # NULL against a value is no change by default
    assert rows[("gone", D("2024-01-01"))][2] == forever
    assert rows[("new", D("2024-01-05"))][2] == forever
    safe = step(h1, snap(spark, ("c", "x", "q", "F")), "2024-01-05", null_safe=True, close_missing=True)
    assert got(safe.where("id = 'c'"), "city", "start_date") == sorted([(None, D("2024-01-01")), ("q", D("2024-01-05"))], key=str)
    assert got(dimensions.open_versions(safe), "id") == [("c",)]


def test_scd2_same_day_again_and_out_of_order(spark):
    h = step(None, snap(spark, ("a", "x", "p", "F")), "2024-01-01")
    h = step(h, snap(spark, ("a", "y", "p", "F")), "2024-01-05")
    again = step(h, snap(spark, ("a", "z", "p", "F")), "2024-01-05")
    assert got(again, "job", "start_date") == [("x", D("2024-01-01")), ("z", D("2024-01-05"))]
    assert got(step(again, snap(spark, ("a", "z", "p", "F")), "2024-01-05")) == got(again)
    with pytest.raises(Exception, match="comes after a later one"):
        step(h, snap(spark, ("a", "x", "p", "F")), "2024-01-03").collect()


def test_scd2_intervals_are_disjoint(spark):
    h = None
    for i, day in enumerate(("2024-01-01", "2024-01-03", "2024-01-04", "2024-02-01")):
        h = step(h, snap(spark, *[(f"k{k}", f"j{(i * k) % 3}", "p", "F") for k in range(5)]), day)
    by = {}
    for r in h.orderBy("id", "start_date").collect():
        by.setdefault(r.id, []).append(r)
    for versions in by.values():
        assert sum(v.end_date == D("9999-12-31") for v in versions) == 1
        assert all(a.end_date + datetime.timedelta(days=1) == b.start_date for a, b in zip(versions, versions[1:], strict=False))


def test_as_of_join(spark):
    h = spark.createDataFrame([("a", 1, D("2024-01-01"), D("2024-01-04")), ("a", 2, D("2024-01-05"), D("9999-12-31")), ("b", 3, D("2024-01-01"), D("2024-01-09")), ("b", 4, D("2024-01-05"), D("2024-01-06"))], "id string, sk int, start_date date, end_date date")
    facts = spark.createDataFrame([(i, k, D(d)) for i, (k, d) in enumerate([("a", "2023-12-31"), ("a", "2024-01-01"), ("a", "2024-01-04"), ("a", "2024-01-05"), ("b", "2024-01-05"), (None, "2024-01-05")])], "n int, id string, d date")
    out = dimensions.as_of_join(facts, h, "id", F.col("d"), {"sk": "sk"})
    assert got(out, "n", "sk") == sorted([(0, None), (1, 1), (2, 1), (3, 2), (4, 3), (4, 4), (5, None)], key=str)


# ---------------------------------------------------------------- metrics


def test_rolling_rows_and_calendar(spark):
    daily = spark.createDataFrame([(D(d), n) for d, n in (("2024-01-01", 1), ("2024-01-02", 2), ("2024-01-09", 4), ("2024-01-10", 0))], "d date, n int")
    rows = [r.s for r in metrics.rolling(daily, "d", {"n": "s"}).orderBy("d").collect()]
    days = [r.s for r in metrics.rolling(daily, "d", {"n": "s"}, calendar=True).orderBy("d").collect()]
    assert rows == [1, 3, 7, 7] and days == [1, 3, 4, 4]
    assert [r.c for r in metrics.change(daily, "d", "n", "c").orderBy("d").collect()] == [None, 1.0, 1.0, -1.0]


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "x int")
    one = metrics.summary(empty, {"n": F.count("*"), "k": count_where(F.col("x") > 0)}, None, {"r": plain_ratio("k", "n")}).collect()
    assert [tuple(r) for r in one] == [(0, None, None)]


def test_cumulative_sides(spark):
    a = spark.createDataFrame([("x", D("2024-01-01")), ("x", D("2024-01-03")), ("a", D("2024-01-02")), (None, D("2024-01-01"))], "k string, d date")
    b = spark.createDataFrame([("x", D("2024-01-02")), ("r", D("2024-01-02")), (None, D("2024-01-01"))], "k string, d date")
    sides = [(a, F.col("d"), {"na": F.count("*")}), (b, F.col("d"), {"nb": F.count("*")})]
    out = metrics.cumulative(sides, "k", "2024-01-02", ["na", "nb"])
    assert got(out, "k", "na", "nb") == sorted([("x", 1, 1), ("a", 1, 0), ("r", 0, 1), (None, 1, 0), (None, 0, 1)], key=str)
    assert ("a", 1, 0) not in got(metrics.cumulative(sides, "k", "2024-01-02", ["na", "nb"], exclusive=True), "k", "na", "nb")


def test_enriched_fills(spark):
    facts = spark.createDataFrame([("a", 1), ("z", 2), (None, 3)], "k string, n int")
    hist = spark.createDataFrame([("a", 5, 0.5)], "k string, c long, r double")
    assert got(metrics.enriched(facts, hist, "k", {"c": "hist", "r": "rate"})) == sorted([("a", 1, 5, 0.5), ("z", 2, 0, 0.0), (None, 3, 0, 0.0)], key=str)


# ---------------------------------------------------------------- quality


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (None, "x"), (None, "y")], "k int, v string")
    assert quality.key_uniqueness(df, ["k"]).first().value == pytest.approx(2 / 3)
    assert not quality.gate(quality.suite(df, ["k"]))
    assert quality.gate(quality.suite(spark.createDataFrame([(1,), (2,)], "k int"), ["k"]))
    nothing = quality.suite(df.limit(0), ["k"])
    assert [r.passed for r in nothing.collect()] == [False, False, True]


def test_volatility(spark):
    rows = [("t", "d1", 0), ("t", "d2", 10), ("t", "d3", 14), ("t", "d4", 30)]
    out = quality.volatility(spark.createDataFrame(rows, "t string, d string, n long"), "t", "d", "n")
    assert [(r.value, r.passed) for r in out.orderBy("d").collect()] == [(None, True), (None, True), (0.4, True), (pytest.approx(16 / 14), False)]


def test_reconcile(spark):
    batch = spark.createDataFrame([(10.0,), (20.0,)], "a double")
    near = spark.createDataFrame([(2, 29.8)], "n long, s double")
    assert [r.passed for r in quality.reconcile(batch, "a", near, "n", "s").orderBy("metric").collect()] == [True, True]
    assert [r.passed for r in quality.reconcile(batch, "a", near.limit(0), "n", "s").collect()] == [False, False]
    assert [r.rel_diff for r in quality.reconcile(batch.limit(0), "a", near, "n", "s").collect()] == [1.0, 1.0]


# ---------------------------------------------------------------- streams


EVENTS = "ts timestamp, v double"


def lines(spark, path, number, *rows):
    Files(spark).write(f"{path}/part-{number}.json", "\n".join(rows) + "\n")


def test_stream_late_rows_and_tail(spark):
    path = workspace(spark, "late")
    for i, row in enumerate(['{"ts": "2024-01-01T00:00:10", "v": 1}', '{"ts": "2024-01-01T00:10:00", "v": 2}', '{"ts": "2024-01-01T00:10:05", "v": 3}', '{"ts": "2024-01-01T00:00:20", "v": 4}\nnot json\n{"v": 9}']):
        lines(spark, f"{path}/in", i, row)
    m = {"n": F.count("*")}
    read = lambda: readers.json_stream(spark, f"{path}/in", EVENTS, 1)
    appended = windows.tumbling(read(), "ts", "1 minute", m, "1 minute")
    sinks.file_sink(appended, f"{path}/out", f"{path}/cp").awaitTermination()
    rows = spark.read.schema(appended.schema).parquet(f"{path}/out")
    assert got(windows.formatted(rows, end="HH:mm"), "window_start", "window_end", "n") == [("2024-01-01 00:00:00", "00:01", 1)]  # the late row and the tail are missing
    sinks.file_sink(appended, f"{path}/out", f"{path}/cp").awaitTermination()
    assert rows.count() == 1  # the checkpoint knows these files
    complete = windows.tumbling(read(), "ts", "1 minute", m, "1 minute")
    sinks.replacing_sink(complete, f"{path}/full", f"{path}/cp2").awaitTermination()
    batch = windows.tumbling(spark.read.schema(EVENTS).json(f"{path}/in"), "ts", "1 minute", m)
    assert got(sinks.latest_batch(spark, f"{path}/full", complete.schema)) == got(batch)
    assert batch.agg(F.sum("n")).first()[0] == 4


def test_fan_out(spark):
    path = workspace(spark, "fan")
    lines(spark, f"{path}/in", 0, '{"ts": "2024-01-01T00:00:10", "v": 1}')
    for q in sinks.fan_out(readers.json_stream(spark, f"{path}/in", EVENTS), [("a", f"{path}/a"), ("b", f"{path}/b")], f"{path}/cp"):
        q.awaitTermination()
    assert spark.read.json(f"{path}/a").count() == spark.read.json(f"{path}/b").count() == 1


# ---------------------------------------------------------------- versioned tables


def test_snapshots(spark):
    store = SnapshotStore(spark, workspace(spark, "snap"), {"t"})
    first = store.commit("t", spark.createDataFrame([(1, "a")], "k int, v string"))
    second = store.merge("t", spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])
    assert int(second) > int(first)
    assert got(store.read("t", first)) == got(store.read("t", version=0)) == [(1, "a")]
    assert got(store.read("t")) == [(1, "b"), (2, "c")]
    assert got(store.read("t", as_of=store.manifest("t", first)["committed_at"])) == [(1, "a")] or store.manifest("t", first)["committed_at"] == store.manifest("t", second)["committed_at"]
    assert [(r.snapshot_id, r.parent_id, r.row_count) for r in store.history("t").collect()] == [(second, first, 2), (first, None, 1)]
    spark.range(1).write.parquet(f"{store.folder('t')}/99999999999999/data")  # no manifest: not there
    assert store.current("t") == second
    for bad in ("other", "../t"):
        with pytest.raises(ValueError):
            store.read(bad)
    with pytest.raises(FileNotFoundError):
        store.read("t", "123")


def test_names():
    for bad in ("../x", "a/b", ".hidden", ""):
        with pytest.raises(ValueError):
            checked_name(bad)
    for bad in ("2026-02-30", "2026-2-3", "../2026-01-01"):
        with pytest.raises(ValueError):
            checked_day(bad)


def test_compaction(spark):
    path = workspace(spark, "small")
    spark.range(100).repartition(8).write.parquet(path)
    dry = maintenance.compact(spark, path, dry_run=True)
    assert dry.due and dry.files_after == 8
    done = maintenance.compact(spark, path)
    assert (done.files_before, done.files_after) == (8, 1)
    assert got(spark.read.parquet(path)) == got(spark.range(100))
    assert not maintenance.compact(spark, path).due
    Files(spark).move(path, f"{path}.compact_old")  # a swap broken off between its renames
    assert maintenance.recover(spark, path) and spark.read.parquet(path).count() == 100
    assert maintenance.compact_all(spark, [path]).count() == 1


# ---------------------------------------------------------------- governance


def test_drift_and_paths(spark):
    root = workspace(spark, "gov")
    for day in ("2024-01-01", "2024-01-02"):
        spark.createDataFrame([(1, "x", 2.0)], "a int, b string, more double").write.parquet(f"{root}/ods/t/dt={day}")
    assert governance.resolve(spark, f"{root}/ods/t/dt={{dt}}").endswith("2024-01-02")
    assert governance.resolve(spark, f"{root}/ods/t/dt={{dt}}", "2024-01-01").endswith("2024-01-01")
    assert governance.resolve(spark, f"{root}/ods/nothing/dt={{dt}}") is None
    store = SnapshotStore(spark, f"{root}/tables")
    store.commit("dim", spark.createDataFrame([(1,)], "k int"))
    reg = {
        "ods.t": {"layer": "ods", "path": "ods/t/dt={dt}", "columns": {"a": {"type": "long", "from": "x"}, "b": {"type": "string"}, "c": {"type": "int"}}},
        "dwd.dim": {"layer": "dwd", "path": "tables/dim/snapshots/{snapshot}/data", "columns": {"k": {"type": "int", "from": "ods.t.a"}}},
        "dwd.none": {"layer": "dwd", "path": "none", "columns": {"k": {"type": "int"}}},
        "ads.j": {"layer": "ads", "path": "j", "format": "json", "columns": {"k": {"type": "int"}}},
    }
    found = {(r.table, r["column"], r.drift) for r in governance.tables_drift(spark, reg, root).collect()}
    assert found == {("ods.t", "a", "type"), ("ods.t", "c", "missing"), ("ods.t", "more", "extra"), ("dwd.none", None, "skipped"), ("ads.j", None, "skipped")}
    Files(spark).write(f"{root}/registry.json", __import__("json").dumps({"tables": reg}))
    assert governance.load(spark, f"{root}/registry.json") == reg
    chart = governance.mermaid(reg, [tuple(r) for r in governance.edges(governance.as_rows(spark, reg)).collect()])
    assert "ods_t --> dwd_dim" in chart and chart.index("subgraph ods") < chart.index("subgraph dwd") < chart.index("subgraph ads")
    assert got(governance.direct_sources(governance.as_rows(spark, reg))) == [("dwd.dim", "k", "ods.t")]


# ---------------------------------------------------------------- sources, sinks and serving


def test_json_lines_in_progress(spark):
    path = workspace(spark, "sink")
    f = Files(spark)
    f.write(f"{path}/part-0.json", '{"w": "2024-01-01 00:00:00", "n": 2}\n\n{"w": "2024-01-02", "n": 5}\n')
    f.write(f"{path}/.part-1.inprogress", '{"w": "2024-01-01 00:01:00", "n": 3}\n{"w": "2024')
    f.write(f"{path}/._part-0.json", '{"w": "2024-01-01", "n": 100}')
    out = readers.json_lines(spark, path, "w string, n int", prefix=("w", "2024-01-01"))
    assert sorted(r.n for r in out.collect()) == [2, 3]
    assert readers.json_lines(spark, f"{path}-none", "w string, n int").count() == 0


def test_csv_by_position(spark):
    path = workspace(spark, "csv")
    Files(spark).write(f"{path}/x.csv", "whatever,names\n1,2024-01-01 00:00:00\nbad,2024-01-02 10:00:00\n")
    rows = readers.csv(spark, path, "a int, t timestamp").collect()
    assert [r.a for r in rows] == [1, None]
    assert readers.with_audit(readers.csv(spark, path, "a int, t timestamp")).select("source_file").first()[0] == "x.csv"


def test_partitions(spark):
    root = workspace(spark, "parts")
    for d in ("2024-01-01", "2024-01-02"):
        sinks.overwrite_day(spark.range(2), root, d)
        sinks.overwrite_day(spark.range(3), root, d)  # run again
    assert readers.partitions(spark, root).count() == 6
    assert got(readers.partitions(spark, root, "2024-01-01").select("dt").distinct()) == [("2024-01-01",)]
    assert readers.leaf(spark, root, "2024-01-02").columns == ["id"]
    assert "PartitionFilters: [isnotnull(dt" in readers.partitions(spark, root, "2024-01-01")._jdf.queryExecution().toString()


def test_reports_and_log(spark):
    path = workspace(spark, "rep")
    sinks.report(spark.createDataFrame([(1, "a")], "k int, v string"), f"{path}/r.json", dt="2024-01-01")
    assert __import__("json").loads(Files(spark).read(f"{path}/r.json")) == {"dt": "2024-01-01", "rows": [{"k": 1, "v": "a"}]}


def test_cache(spark):
    now, loads = [0.0], []
    cache = serving.Cache(60, lambda: now[0])
    load = lambda: loads.append(1) or spark.range(3)
    assert cache.get("t", load).count() == 3
    now[0] = 59
    cache.get("t", load)
    now[0] = 60
    cache.get("t", load)
    assert len(loads) == 2 and cache.health() == {"status": "ok", "cached": 1}


def test_generated_data(spark):
    a, b = generated.customers(spark, 2000, "2024-01-01"), generated.customers(spark, 2000, "2024-01-02")
    assert got(a) == got(generated.customers(spark, 2000, "2024-01-01")) and a.schema.simpleString().startswith("struct<customer_id:string")
    moved = a.join(b.withColumnRenamed("city", "city2"), "customer_id").where("city <> city2").count()
    assert 0 < moved < 60
    apps = generated.applications(spark, 3000, 500, "2024-01-01")
    flows = generated.repayments(apps, "2024-01-01")
    assert flows.count() == apps.where("is_approved = 1").count() and 0.3 < flows.count() / 3000 < 0.7
    assert apps.where("fico_score not between 500 and 857 or loan_amnt < 1000 or to_date(apply_time) <> date'2024-01-01'").isEmpty()
    assert flows.where("overdue_days > 60").count() and flows.where("repay_amount < due_amount and overdue_days <= 30").isEmpty()
    rates = {r.grade: r.bad for r in apps.where("is_approved = 1").groupBy("grade").agg(F.avg("is_default").alias("bad")).collect()}
    assert rates["F"] > rates["A"]


def test_external_loans_tables(spark):
    raw = spark.createDataFrame([(i, None if i % 3 == 0 else 50000.0 + i, None if i % 2 else "engineer of very long titles", 7, 9000 + i, 36, 0.1, "car", "B", None, 700, "0", "1", i % 2) for i in range(1, 41)], "id long, annualIncome double, employmentTitle string, regionCode int, loanAmnt int, term int, interestRate double, purpose string, grade string, dti double, ficoRangeLow int, verificationStatus string, homeOwnership string, isDefault int")
    people, apps, flows = generated.external_loans(raw, 25, "2024-01-02")
    assert people.count() == apps.count() == flows.count() == 25
    assert apps.join(people, "customer_id").count() == 25
    assert apps.where("annual_income is null or dti <> 0 or is_approved <> 1").isEmpty()
    assert {r.occupation for r in people.collect()} == {"unknown", "engineer of very lon"}
    assert got(generated.external_loans(raw, 25, "2024-01-02")[2]) == got(flows)
