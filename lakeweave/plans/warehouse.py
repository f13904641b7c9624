"""The daily warehouse of a consumer-credit business, built from the library's operators.

Layers below one root: business/ (CSV exports), landing/ (stream files), warehouse/{ods,dwd,dws,ads}, tables/ (the
versioned customer dimension) and quality/ (ledger and reports). Each step of a day replaces what it has written
before, so a day may be run again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.scalar import bucketize, count_where, half_up, money, plain_ratio, ratio, surrogate_key, total, total_where
from lakeweave.operators import dimensions, governance, maintenance, metrics, quality
from lakeweave.plans import serving
from lakeweave.sources import generated, readers, sinks
from lakeweave.sources.fs import Files, checked_day
from lakeweave.sources.versioned import SnapshotStore
from lakeweave.streaming import windows

#: The schemas of the business exports and of the stream, and the attributes that make a new version.
EXPORTS = {"customer": generated.CUSTOMER, "loan_application": generated.APPLICATION, "repay_flow": generated.REPAYMENT}
STREAM = "flow_id string, application_id string, customer_id string, event_time timestamp, repay_amount double, overdue_days int"
ATTRIBUTES = ["gender", "age", "education", "marital_status", "occupation", "city"]
TRACKED = ["occupation", "city", "age", "education"]
DIMENSION = "dwd_dim_customer"


@dataclass
class Warehouse:
    spark: SparkSession
    root: str
    tolerance: float = 0.01
    most_null: float = 0.05
    most_volatile: float = 0.5

    def __post_init__(self) -> None:
        self.root = self.root.rstrip("/")
        self.files = Files(self.spark)
        self.store = SnapshotStore(self.spark, f"{self.root}/tables", {DIMENSION})

    def at(self, layer: str, name: str) -> str:
        return f"{self.root}/warehouse/{layer}/{name}"

    def leaf(self, layer: str, name: str, day: str) -> DataFrame:
        return readers.leaf(self.spark, self.at(layer, name), day)

    # ---- source data

    def generate(self, day: str, customers: int = 2000, applications: int = 5000, batches: int = 3) -> None:
        """A day's exports, and its repayments as stream files."""
        people = generated.customers(self.spark, customers, day)
        apps = generated.applications(self.spark, applications, customers, day)
        self.export(day, people, apps, generated.repayments(apps, day))
        self.land(day, batches)

    def export(self, day: str, customers: DataFrame, applications: DataFrame, repayments: DataFrame) -> None:
        for name, df in (("customer", customers), ("loan_application", applications), ("repay_flow", repayments)):
            df.write.mode("overwrite").option("header", True).option("timestampFormat", readers.TIMESTAMP_FORMAT).csv(f"{self.root}/business/{name}/dt={checked_day(day)}")

    def land(self, day: str, batches: int = 3) -> list[str]:
        flows = readers.csv(self.spark, f"{self.root}/business/repay_flow/dt={checked_day(day)}", EXPORTS["repay_flow"])
        messages = flows.select("flow_id", "application_id", "customer_id", F.col("repay_time").alias("event_time"), "repay_amount", "overdue_days")
        return list(sinks.landing_batches(messages, f"{self.root}/landing/repay_stream", day, batches, "flow_id"))

    # ---- layers

    def ods(self, day: str) -> None:
        for name, schema in EXPORTS.items():
            path = f"{self.root}/business/{name}/dt={checked_day(day)}"
            sinks.overwrite_day(readers.with_audit(readers.csv(self.spark, path, schema), f"dt={day}"), self.at("ods", name), day)

    def dimension(self) -> DataFrame:
        return self.store.read(DIMENSION)

    def dwd_customer(self, day: str) -> str:
        """The customer dimension with a day's snapshot merged in: a new version of the table."""
        old = self.dimension() if self.store.current(DIMENSION) else None
        snapshot = self.leaf("ods", "customer", day).select("customer_id", *ATTRIBUTES)
        merged = dimensions.apply_snapshot(old, snapshot, "customer_id", ATTRIBUTES, day, TRACKED)
        return self.store.commit(DIMENSION, merged.withColumn("customer_sk", surrogate_key("customer_id", "start_date")), "merge", ["customer_id", "start_date"])

    def _as_of(self, facts: DataFrame, on: Column) -> DataFrame:
        return dimensions.as_of_join(facts, self.dimension(), "customer_id", on, {"customer_sk": "customer_sk"})

    def dwd_facts(self, day: str) -> None:
        apps = self.leaf("ods", "loan_application", day).drop("etl_time", "source_file").withColumn("apply_date", F.to_date("apply_time"))
        sinks.overwrite_day(self._as_of(apps, F.col("apply_date")), self.at("dwd", "dwd_fact_loan_apply"), day)
        flows = self.leaf("ods", "repay_flow", day).drop("etl_time", "source_file")
        flows = flows.withColumn("overdue_bucket", bucketize("overdue_days", [(30, "M1"), (60, "M2")], "M0", "M3+")).withColumn("unpaid_amount", (money("due_amount") - money("repay_amount")).cast("double"))
        sinks.overwrite_day(self._as_of(flows, F.to_date("repay_time")), self.at("dwd", "dwd_fact_repay"), day)

    def dws(self, day: str) -> None:
        ok = F.col("is_approved") == 1
        daily = metrics.summary(
            self.leaf("dwd", "dwd_fact_loan_apply", day),
            {
                "apply_cnt": F.count("*"), "approve_cnt": count_where(ok), "loan_amt_sum": total_where(ok, "loan_amnt"), "avg_interest_rate": F.avg("interest_rate"), "avg_annual_income": F.avg("annual_income"),
                "avg_dti": F.avg("dti"), "default_cnt": F.sum(F.when(ok, F.col("is_default")).otherwise(0)), "apply_customer_cnt": F.countDistinct("customer_id"),
            },
            None,
            {"approve_rate": plain_ratio("approve_cnt", "apply_cnt"), "default_rate": ratio("default_cnt", "approve_cnt")},
        )
        sinks.overwrite_day(daily.select(F.to_date(F.lit(day)).alias("apply_date"), "*"), self.at("dws", "dws_apply_day"), day)
        apps, flows = (self.spark.read.parquet(self.at("dwd", t)) for t in ("dwd_fact_loan_apply", "dwd_fact_repay"))
        a = {"hist_apply_cnt": F.count("*"), "hist_approve_cnt": count_where(ok), "hist_loan_amt": total_where(ok, "loan_amnt"), "last_apply_date": F.max("apply_date")}
        r = {"hist_repay_cnt": F.count("*"), "hist_repay_amt": total("repay_amount"), "hist_overdue_cnt": count_where(F.col("overdue_days") > 0), "last_repay_date": F.max(F.to_date("repay_time"))}
        fill = [c for c in [*a, *r] if c.startswith("hist")]
        people = metrics.cumulative([(apps, F.col("apply_date"), a), (flows, F.to_date("repay_time"), r)], "customer_id", day, fill, {"overdue_ratio": ratio("hist_overdue_cnt", "hist_repay_cnt")}, "dt")
        sinks.overwrite_day(people, self.at("dws", "dws_customer_day"), day)

    def ads(self, day: str) -> None:
        daily = readers.partitions(self.spark, self.at("dws", "dws_apply_day"))
        risk = metrics.rolling(daily.withColumn("amt", money("loan_amt_sum")), "apply_date", {"apply_cnt": "apply_cnt_7d", "amt": "amt_7d"})
        risk = metrics.change(risk, "apply_date", "apply_cnt", "apply_cnt_dod")
        risk = risk.select("apply_date", "apply_cnt", "approve_cnt", "approve_rate", "loan_amt_sum", "avg_interest_rate", "default_cnt", "default_rate", "apply_cnt_7d", F.col("amt_7d").cast("double").alias("loan_amt_7d"), "apply_cnt_dod", F.current_timestamp().alias("etl_time"))
        risk.write.mode("overwrite").parquet(self.at("ads", "ads_risk_daily"))
        fact = self.leaf("dwd", "dwd_fact_loan_apply", day).drop("apply_time").withColumnRenamed("is_default", "label")
        fact = fact.withColumns({
            "installment": half_up(F.try_divide("loan_amnt", F.col("term").cast("double")), 2), "monthly_income": half_up(F.col("annual_income") / 12, 2),
            "loan_to_income": half_up(F.col("loan_amnt") / F.greatest("annual_income", F.lit(1.0)), 4),
        })
        take = {c: c for c in ("hist_apply_cnt", "hist_approve_cnt", "hist_loan_amt", "hist_overdue_cnt", "hist_repay_cnt")} | {"overdue_ratio": "hist_overdue_ratio"}
        sinks.overwrite_day(metrics.enriched(fact, self.leaf("dws", "dws_customer_day", day), "customer_id", take), self.at("ads", "ads_scorecard_features"), day)
        sinks.export_csv(self.spark.read.parquet(self.at("ads", "ads_risk_daily")), f"{self.root}/warehouse/ads_export/ads_risk_daily", "apply_date")

    # ---- stream

    def stream_plan(self, delay: str = "1 minute") -> DataFrame:
        late = F.col("overdue_days") > 0
        events = readers.json_stream(self.spark, f"{self.root}/landing/repay_stream/batch_*", STREAM)
        m = {"msg_cnt": F.count("*"), "repay_amt_sum": total("repay_amount"), "overdue_cnt": count_where(late), "overdue_amt_sum": total_where(late, "repay_amount")}
        return windows.tumbling(events, "event_time", "1 minute", m, delay)

    def stream(self, bounded: bool = True) -> DataFrame | None:
        """Window metrics of all landed messages. bounded: every window of what is there now; else append, running on."""
        path = self.at("ads", "ads_realtime_metrics")
        if not bounded:
            sinks.file_sink(self.stream_plan(), f"{path}_live", f"{self.root}/_checkpoints/realtime_live", bounded=False)
            return None
        plan = self.stream_plan()
        sinks.replacing_sink(plan, path, f"{self.root}/_checkpoints/realtime").awaitTermination()
        return self.realtime()

    def realtime(self, day: str | None = None) -> DataFrame:
        rows = sinks.latest_batch(self.spark, self.at("ads", "ads_realtime_metrics"), "window_start timestamp, window_end timestamp, msg_cnt long, repay_amt_sum double, overdue_cnt long, overdue_amt_sum double")
        return rows.where(F.to_date("window_start") == F.to_date(F.lit(day))) if day else rows

    # ---- gates

    def reconcile(self, day: str) -> DataFrame:
        return quality.reconcile(self.leaf("dwd", "dwd_fact_repay", day), "repay_amount", self.realtime(day), "msg_cnt", "repay_amt_sum", self.tolerance)

    #: The tables that are checked, with their keys and columns that should not be NULL.
    CHECKS = [
        ("ods", "customer", ["customer_id"]), ("ods", "loan_application", ["application_id"]), ("ods", "repay_flow", ["flow_id"]), ("dwd", "dwd_fact_loan_apply", ["application_id"]), ("dwd", "dwd_fact_repay", ["flow_id"]),
        ("dws", "dws_apply_day", ["apply_date"]), ("dws", "dws_customer_day", ["customer_id"]), ("ads", "ads_scorecard_features", ["application_id"]),
    ]

    def check(self, day: str) -> DataFrame:
        """All rules of all tables of a day, as rows; row counts go into the ledger, but those of missing or empty tables."""
        path, out, counts = f"{self.root}/quality/ledger", [], []
        tables = [(f"{layer}.{name}", f"{self.at(layer, name)}/dt={checked_day(day)}", key) for layer, name, key in self.CHECKS]
        tables.append((DIMENSION, self.store.path(DIMENSION), ["customer_id", "start_date"]))
        before = quality.latest_entries(sinks.ledger(self.spark, path).where(F.col("dt") < day), ["table", "dt"], "rowcount", "checked_at")
        before = {r.table: r.rowcount for r in serving.newest_each(before, "table", "dt").collect()}
        for name, at, key in tables:
            there = self.files.exists(at)
            out.append(self.spark.createDataFrame([(name, "exists", float(there), 1.0, there)], "table string, rule string, value double, threshold double, passed boolean"))
            if not there:
                continue
            df = self.spark.read.parquet(at)
            rules = quality.suite(df, key, None, 1.0, self.most_null).select(F.lit(name).alias("table"), "*")
            out.append(rules)
            n = df.count()
            if n:
                counts.append((name, day, n))
            if before.get(name):
                gap = abs(n - before[name]) / before[name]
                out.append(self.spark.createDataFrame([(name, "volatility", gap, self.most_volatile, gap <= self.most_volatile)], "table string, rule string, value double, threshold double, passed boolean"))
        if counts:
            sinks.append_ledger(self.spark.createDataFrame(counts, "table string, dt string, rowcount long").withColumn("checked_at", F.current_timestamp()), path)
        result = out[0]
        for more in out[1:]:
            result = result.unionByName(more)
        sinks.report(result, f"{self.root}/quality/check_{day}.json", dt=day)
        return result

    def run_day(self, day: str) -> bool:
        """Exports to marts, the stream, then the gates; whether all of them passed."""
        self.ods(day)
        self.dwd_customer(day)
        self.dwd_facts(day)
        self.dws(day)
        self.ads(day)
        self.stream()
        checked, same = self.check(day), self.reconcile(day)
        sinks.report(same, f"{self.root}/quality/reconcile_{day}.json", dt=day)
        return quality.gate(checked) and quality.gate(same)

    def compact(self, **options) -> DataFrame:
        facts = ["dwd_fact_loan_apply", "dwd_fact_repay"]
        leaves = [f"{self.at('dwd', t)}/{n}" for t in facts for n in self.files.names(self.at("dwd", t)) if n.startswith("dt=")]
        return maintenance.compact_all(self.spark, leaves, **options)

    # ---- governance and serving

    def registry(self, day: str | None = None) -> dict:
        """What is stored now, as a registry: the layers' tables with columns and types."""
        out = {}
        for layer in ("ods", "dwd", "dws", "ads"):
            for name in self.files.names(f"{self.root}/warehouse/{layer}"):
                pattern = f"warehouse/{layer}/{name}" + ("/dt={dt}" if any(n.startswith("dt=") for n in self.files.names(self.at(layer, name))) else "")
                path = governance.resolve(self.spark, f"{self.root}/{pattern}", day)
                if path and not any(n.startswith("batch=") for n in self.files.names(path)):
                    out[f"{layer}.{name}"] = {"layer": layer, "path": pattern, "columns": {f.name: {"type": governance.type_name(f.dataType.simpleString()), "from": ""} for f in readers.footer_schema(self.spark, path).fields}}
        return out

    def drift(self, registry: dict, day: str | None = None) -> DataFrame:
        return governance.tables_drift(self.spark, registry, self.root, day)

    def risk_on(self, day: str) -> DataFrame:
        return serving.daily(self.spark.read.parquet(self.at("ads", "ads_risk_daily")), "apply_date", day)

    def features_of(self, application_id: str) -> DataFrame:
        return serving.newest_partition(self.spark, self.at("ads", "ads_scorecard_features"), application_id=application_id)

    def customer_history(self, customer_id: str) -> DataFrame:
        return serving.newest_partition(self.spark, self.at("dws", "dws_customer_day"), customer_id=customer_id)

    def customer_now(self, customer_id: str) -> DataFrame:
        return serving.current_version(self.dimension(), customer_id=customer_id)

    def dashboard(self, day: str, last: int = 20) -> dict[str, DataFrame]:
        """KPIs of the latest day, the daily series, and the day's latest windows with their totals."""
        risk, live = self.spark.read.parquet(self.at("ads", "ads_risk_daily")), self.realtime(day)
        return {
            "kpi": serving.newest(risk, ["apply_date"]), "series": risk.orderBy("apply_date"), "windows": serving.newest(live, ["window_start"], last),
            "live": live.agg(F.sum("msg_cnt").alias("msg_cnt"), total("repay_amt_sum").alias("repay_amt"), F.sum("overdue_cnt").alias("overdue_cnt"), F.max("window_end").alias("until")),
        }
