"""Every operator of the library as a named query over the synthetic tables, with its SQL twin.

Customers stand for borrowers, orders for loan applications (approved: status other than P, default: status F),
lineitems for repayments (overdue by days between order and shipment), events for the message stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.scalar import bucketize, count_where, day, half_up, mean, money, plain_ratio, portable_key, ratio, stable_hash, total, total_where
from lakeweave.operators import dimensions, governance, maintenance, merge, metrics, quality
from lakeweave.plans import serving
from lakeweave.sources import generated, readers, sinks
from lakeweave.sources.fs import Files, stored, workspace
from lakeweave.sources.readers import table
from lakeweave.sources.versioned import SnapshotStore
from lakeweave.streaming import windows

FIRST, SECOND, CUT = "1995-01-01", "1998-06-01", "1998-06-01"
SEGMENTS = ["c_nationkey", "c_mktsegment"]

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


# ------------------------------------------------------------------ daily and cumulative metrics


def _applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", day("o_orderdate").alias("apply_date"))



def _approved():
    return F.col("o_orderstatus") != "P"


def _day_metrics() -> dict:
    return {
        "apply_cnt": F.count("*"), "approve_cnt": count_where(_approved()), "loan_amt_sum": total_where(_approved(), "o_totalprice"), "avg_amount": mean("o_totalprice", 2),
        "default_cnt": count_where(_approved() & (F.col("o_orderstatus") == "F")), "apply_customer_cnt": F.countDistinct("o_custkey"),
    }


def _rates() -> dict:
    return {"approve_rate": plain_ratio("approve_cnt", "apply_cnt"), "default_rate": ratio("default_cnt", "approve_cnt")}


_DAY_SQL = """
count(*) apply_cnt, sum(case when o_orderstatus <> 'P' then 1 else 0 end)::bigint approve_cnt,
sum(case when o_orderstatus <> 'P' then o_totalprice::decimal(18,2) else 0 end)::double loan_amt_sum,
sum(o_totalprice::decimal(28,2))::double / count(o_totalprice) avg_amount,
sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint default_cnt, count(distinct o_custkey) apply_customer_cnt"""
_RATES_SQL = """
floor(approve_cnt::double / nullif(apply_cnt, 0) * 10000.0 + 0.5) / 10000.0 approve_rate,
floor(default_cnt::double / greatest(approve_cnt, 1) * 10000.0 + 0.5) / 10000.0 default_rate"""


@query(f"with d as (select o_orderdate::date apply_date, {_DAY_SQL} from orders group by 1) select *, {_RATES_SQL} from d")
def apply_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_applications(spark, sf_dir), _day_metrics(), ["apply_date"], _rates())


@query(f"with d as (select date '1990-01-01' apply_date, {_DAY_SQL} from orders where o_orderdate::date = date '1990-01-01') select *, {_RATES_SQL} from d")
def apply_day_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day without applications still has its row: counts 0, sums and rates NULL but for the guarded one."""
    one = metrics.summary(serving.daily(_applications(spark, sf_dir), "apply_date", "1990-01-01"), _day_metrics(), None, _rates())
    return one.select(F.to_date(F.lit("1990-01-01")).alias("apply_date"), "*")


def _repayments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    r = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return r.select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("custkey"), "l_quantity", "l_extendedprice", day("l_shipdate").alias("repay_date"), F.datediff("l_shipdate", "o_orderdate").alias("overdue_days"))


def _customer_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _applications(spark, sf_dir).withColumnRenamed("o_custkey", "custkey")
    apps = {"hist_apply_cnt": F.count("*"), "hist_approve_cnt": count_where(_approved()), "hist_loan_amt": total_where(_approved(), "o_totalprice"), "last_apply_date": F.max("apply_date")}
    pays = {"hist_repay_cnt": F.count("*"), "hist_repay_amt": total("l_extendedprice"), "hist_overdue_cnt": count_where(F.col("overdue_days") > 0), "last_repay_date": F.max("repay_date")}
    fill = [c for c in [*apps, *pays] if c.startswith("hist")]
    return metrics.cumulative([(a, F.col("apply_date"), apps), (_repayments(spark, sf_dir), F.col("repay_date"), pays)], "custkey", CUT, fill, {"overdue_ratio": ratio("hist_overdue_cnt", "hist_repay_cnt")})


_REPAY_SQL = "select l_orderkey, l_linenumber, o_custkey custkey, l_quantity, l_extendedprice, l_shipdate::date repay_date, datediff('day', o_orderdate::date, l_shipdate::date) overdue_days from lineitem join orders on l_orderkey = o_orderkey"
_HIST_SQL = f"""
a as (select o_custkey custkey, count(*) n, sum(case when o_orderstatus <> 'P' then 1 else 0 end)::bigint ok,
  sum(case when o_orderstatus <> 'P' then o_totalprice::decimal(18,2) else 0 end)::double amt, max(o_orderdate::date) last
  from orders where o_orderdate::date <= date '{CUT}' group by 1),
p as ({_REPAY_SQL}),
r as (select custkey, count(*) n, sum(l_extendedprice::decimal(18,2))::double amt, sum(case when overdue_days > 0 then 1 else 0 end)::bigint late, max(repay_date) last
  from p where repay_date <= date '{CUT}' group by 1),
h as (select coalesce(a.custkey, r.custkey) custkey, coalesce(a.n, 0) hist_apply_cnt, coalesce(ok, 0) hist_approve_cnt, coalesce(a.amt, 0) hist_loan_amt, a.last last_apply_date,
  coalesce(r.n, 0) hist_repay_cnt, coalesce(r.amt, 0) hist_repay_amt, coalesce(late, 0) hist_overdue_cnt, r.last last_repay_date,
  floor(coalesce(late, 0)::double / greatest(coalesce(r.n, 0), 1) * 10000.0 + 0.5) / 10000.0 overdue_ratio
  from a full join r on a.custkey = r.custkey)"""


@query(f"with {_HIST_SQL} select * from h")
def customer_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customer_history(spark, sf_dir)


def _risk(spark: SparkSession, sf_dir: str, calendar: bool) -> DataFrame:
    d = metrics.summary(_applications(spark, sf_dir), {"apply_cnt": F.count("*"), "amt": F.sum(money("o_totalprice"))}, ["apply_date"])
    d = metrics.change(metrics.rolling(d, "apply_date", {"apply_cnt": "apply_cnt_7d", "amt": "loan_amt_7d"}, 7, calendar), "apply_date", "apply_cnt", "apply_cnt_dod")
    return d.select("apply_date", "apply_cnt", "apply_cnt_7d", F.col("loan_amt_7d").cast("double").alias("loan_amt_7d"), "apply_cnt_dod")


def _risk_sql(frame: str) -> str:
    return f"""with d as (select o_orderdate::date apply_date, count(*) apply_cnt, sum(o_totalprice::decimal(18,2)) amt from orders group by 1)
select apply_date, apply_cnt, (sum(apply_cnt) over w)::bigint apply_cnt_7d, (sum(amt) over w)::double loan_amt_7d,
floor((apply_cnt - lag(apply_cnt) over (order by apply_date))::double / greatest(lag(apply_cnt) over (order by apply_date), 1) * 10000.0 + 0.5) / 10000.0 apply_cnt_dod
from d window w as (order by apply_date {frame})"""


@query(_risk_sql("rows between 6 preceding and current row"))
def risk_daily_rows7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir, False)


@query(_risk_sql("range between interval 6 days preceding and current row"))
def risk_daily_range7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risk(spark, sf_dir, True)


# ------------------------------------------------------------------ dimensions


def _snapshot(spark: SparkSession, sf_dir: str, second: bool = False) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", *SEGMENTS)
    return c.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 10 == 0, F.concat(F.col("c_mktsegment"), F.lit("-2"))).otherwise(F.col("c_mktsegment"))) if second else c


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = dimensions.apply_snapshot(None, _snapshot(spark, sf_dir), "c_custkey", SEGMENTS, FIRST)
    return dimensions.apply_snapshot(first, _snapshot(spark, sf_dir, True), "c_custkey", SEGMENTS, SECOND, ["c_mktsegment"])


_FIRST_SQL = f"select c_custkey, c_nationkey, c_mktsegment, date '{FIRST}' start_date, date '9999-12-31' end_date from customer"
_HISTORY_SQL = f"""select c_custkey, c_nationkey, c_mktsegment, date '{FIRST}' start_date, case when c_custkey % 10 = 0 then date '{SECOND}' - 1 else date '9999-12-31' end::date end_date from customer
union all select c_custkey, c_nationkey, c_mktsegment || '-2', date '{SECOND}', date '9999-12-31' from customer where c_custkey % 10 = 0"""


@query(_FIRST_SQL)
def scd2_first_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.apply_snapshot(None, _snapshot(spark, sf_dir), "c_custkey", SEGMENTS, FIRST)


@query(_HISTORY_SQL)
def scd2_second_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir)


@query(f"select * from ({_HISTORY_SQL}) where end_date = date '9999-12-31'")
def scd2_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimensions.open_versions(_history(spark, sf_dir))


_TAKE = {"c_mktsegment": "segment", "start_date": "version_start"}


@query(f"with h as ({_HISTORY_SQL}) select o_orderkey, o_custkey, o_orderdate::date apply_date, c_mktsegment segment, start_date version_start from orders left join h on o_custkey = c_custkey and o_orderdate::date between start_date and end_date")
def fact_apply_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _applications(spark, sf_dir).select("o_orderkey", "o_custkey", "apply_date")
    return dimensions.as_of_join(facts, _history(spark, sf_dir), "o_custkey", F.col("apply_date"), _TAKE, "c_custkey")


_STEPS = [(30, "M1"), (60, "M2")]
_BUCKET_SQL = "case when overdue_days = 0 then 'M0' when overdue_days <= 30 then 'M1' when overdue_days <= 60 then 'M2' else 'M3+' end overdue_bucket"


@query(f"with h as ({_HISTORY_SQL}), p as ({_REPAY_SQL}) select l_orderkey, l_linenumber, l_quantity, custkey, repay_date, overdue_days, {_BUCKET_SQL}, (l_extendedprice::decimal(18,2) - l_quantity::decimal(18,2))::double unpaid_amount, c_mktsegment segment, start_date version_start from p left join h on custkey = c_custkey and repay_date between start_date and end_date")
def fact_repay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _repayments(spark, sf_dir)
    p = p.select("l_orderkey", "l_linenumber", "l_quantity", "custkey", "repay_date", "overdue_days", bucketize("overdue_days", _STEPS, "M0", "M3+").alias("overdue_bucket"), (money("l_extendedprice") - money("l_quantity")).cast("double").alias("unpaid_amount"))
    return dimensions.as_of_join(p, _history(spark, sf_dir), "custkey", F.col("repay_date"), _TAKE, "c_custkey")


@query(f"with p as ({_REPAY_SQL}) select {_BUCKET_SQL}, count(*) cnt, sum(l_extendedprice::decimal(18,2))::double amt from p group by 1")
def overdue_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_repayments(spark, sf_dir), {"cnt": F.count("*"), "amt": total("l_extendedprice")}, [bucketize("overdue_days", _STEPS, "M0", "M3+").alias("overdue_bucket")])


# ------------------------------------------------------------------ upserts, unions, lookups


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0")
    moved = c.select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 1_000_000_000).otherwise(0)).alias("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, F.lit(None)).otherwise("NEW").alias("c_mktsegment"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    return moved.withColumn("ignored", F.lit(1))


_INCOMING_SQL = "select case when c_custkey % 2 = 0 then c_custkey + 1000000000 else c_custkey end c_custkey, case when c_custkey % 3 = 0 then null else 'NEW' end c_mktsegment, c_acctbal + 1 c_acctbal from customer where c_custkey % 7 = 0"


def _upsert(spark: SparkSession, sf_dir: str, replace: bool) -> DataFrame:
    return merge.upsert(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), _incoming(spark, sf_dir), ["c_custkey"], replace)


@query(f"with i as ({_INCOMING_SQL}) select coalesce(i.c_custkey, c.c_custkey) c_custkey, coalesce(i.c_mktsegment, c.c_mktsegment) c_mktsegment, coalesce(i.c_acctbal, c.c_acctbal) c_acctbal from customer c full join i on c.c_custkey = i.c_custkey")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, False)


@query(f"with i as ({_INCOMING_SQL}) select coalesce(i.c_custkey, c.c_custkey) c_custkey, case when i.c_custkey is null then c.c_mktsegment else i.c_mktsegment end c_mktsegment, case when i.c_custkey is null then c.c_acctbal else i.c_acctbal end c_acctbal from customer c full join i on c.c_custkey = i.c_custkey")
def upsert_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upsert(spark, sf_dir, True)


def _scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.greatest("c_acctbal", F.lit(0.0)).alias("income"))
    f = _applications(spark, sf_dir).join(c, F.col("o_custkey") == F.col("c_custkey"))
    f = f.select("o_orderkey", F.col("o_custkey").alias("custkey"), "apply_date", F.col("o_totalprice").alias("loan_amnt"), "income", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    take = {"hist_apply_cnt": "hist_apply_cnt", "hist_approve_cnt": "hist_approve_cnt", "hist_loan_amt": "hist_loan_amt", "hist_overdue_cnt": "hist_overdue_cnt", "overdue_ratio": "hist_overdue_ratio", "hist_repay_cnt": "hist_repay_cnt"}
    f = metrics.enriched(f, _customer_history(spark, sf_dir), "custkey", take)
    term = F.pmod(F.col("o_orderkey"), F.lit(5)).cast("int") * 12  # some terms are 0: no instalment then
    return f.select("*", half_up(F.try_divide(F.col("loan_amnt"), term.cast("double")), 2).alias("installment"), half_up(F.col("income") / 12, 2).alias("monthly_income"), half_up(F.col("loan_amnt") / F.greatest("income", F.lit(1.0)), 4).alias("loan_to_income"))


_SCORE_SQL = f"""with {_HIST_SQL} select o_orderkey, o_custkey custkey, o_orderdate::date apply_date, o_totalprice loan_amnt, greatest(c_acctbal, 0) income, case when o_orderstatus = 'F' then 1 else 0 end::int label,
coalesce(hist_apply_cnt, 0) hist_apply_cnt, coalesce(hist_approve_cnt, 0) hist_approve_cnt, coalesce(hist_loan_amt, 0) hist_loan_amt, coalesce(hist_overdue_cnt, 0) hist_overdue_cnt, coalesce(overdue_ratio, 0) hist_overdue_ratio, coalesce(hist_repay_cnt, 0) hist_repay_cnt,
floor(o_totalprice / nullif((o_orderkey % 5) * 12, 0) * 100.0 + 0.5) / 100.0 installment, floor(greatest(c_acctbal, 0) / 12 * 100.0 + 0.5) / 100.0 monthly_income, floor(o_totalprice / greatest(greatest(c_acctbal, 0), 1.0) * 10000.0 + 0.5) / 10000.0 loan_to_income
from orders join customer on o_custkey = c_custkey left join h on h.custkey = o_custkey"""


@query(_SCORE_SQL)
def scorecard_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scorecard(spark, sf_dir)


@query("select o_custkey custkey, o_orderkey, o_orderdate::date apply_date, o_totalprice from orders where o_custkey = (select min(o_custkey) from orders) order by o_orderdate::date desc, o_orderkey desc limit 1")
def latest_features_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _applications(spark, sf_dir).select(F.col("o_custkey").alias("custkey"), "o_orderkey", "apply_date", "o_totalprice")
    return serving.newest(a, ["apply_date", "o_orderkey"], custkey=a.agg(F.min("custkey")).first()[0])


@query("select o_custkey custkey, o_orderkey, o_orderdate::date apply_date from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1")
def latest_features_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _applications(spark, sf_dir).select(F.col("o_custkey").alias("custkey"), "o_orderkey", "apply_date")
    return serving.newest_each(a, "custkey", "o_orderkey").select("custkey", "o_orderkey", "apply_date")


@query(f"select * from ({_HISTORY_SQL}) where end_date = date '9999-12-31' and c_custkey = 10")
def dim_current_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.current_version(_history(spark, sf_dir), c_custkey=10)


@query("select o_orderdate::date apply_date, count(*) apply_cnt from orders where o_orderdate::date = date '1996-01-02' group by 1")
def daily_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.daily(metrics.summary(_applications(spark, sf_dir), {"apply_cnt": F.count("*")}, ["apply_date"]), "apply_date", "1996-01-02")


@query("with d as (select o_orderdate::date d, count(*) n, sum(o_totalprice::decimal(18,2)) a from orders group by 1) select max(d) latest_day, arg_max(n, d) latest_cnt, sum(n)::bigint total_cnt, sum(a)::double total_amt from d")
def dashboard_kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.summary(_applications(spark, sf_dir), {"n": F.count("*"), "a": F.sum(money("o_totalprice"))}, ["apply_date"])
    return d.agg(F.max("apply_date").alias("latest_day"), F.max_by("n", "apply_date").alias("latest_cnt"), F.sum("n").alias("total_cnt"), F.sum("a").cast("double").alias("total_amt"))


@query("select c_custkey k, c_name n from customer union all select s_suppkey, s_name from supplier")
def union_positional_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("n"), F.col("s_suppkey").alias("k"))
    return merge.union_all(c, s)


@query("select distinct l_orderkey, l_linenumber from lineitem")
def distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()


_TUMBLE_SQL = "select time_bucket(interval '1 minute', ts) window_start, time_bucket(interval '1 minute', ts) + interval '1 minute' window_end, count(*) msg_cnt, sum(value::decimal(18,2))::double amt_sum, sum(case when event_type = 'error' then 1 else 0 end)::bigint overdue_cnt, sum(case when event_type = 'error' then value::decimal(18,2) else 0 end)::double overdue_amt_sum from events where ts is not null group by 1, 2"


@query(f"select window_start, msg_cnt from ({_TUMBLE_SQL}) order by window_start desc limit 20")
def top_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.newest(tumbling_1m(spark, sf_dir), ["window_start"], 20).select("window_start", "msg_cnt")


# ------------------------------------------------------------------ windows over events, batch and stream


def _window_metrics() -> dict:
    bad = F.col("event_type") == "error"
    return {"msg_cnt": F.count("*"), "amt_sum": total("value"), "overdue_cnt": count_where(bad), "overdue_amt_sum": total_where(bad, "value")}


def _untimed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def _tumbling(df: DataFrame, delay: str | None = None) -> DataFrame:
    return windows.tumbling(df.select("ts", "value", "event_type"), "ts", "1 minute", _window_metrics(), delay)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.parquet_stream(spark, f"{sf_dir}/events.parquet*", table(spark, sf_dir, "events").schema)


@query(_TUMBLE_SQL)
def tumbling_1m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _untimed(_tumbling(table(spark, sf_dir, "events")))


@query(_TUMBLE_SQL)
def tumbling_1m_stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "stream-complete")
    stream = _tumbling(_event_stream(spark, sf_dir), "1 minute")
    sinks.replacing_sink(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return _untimed(sinks.latest_batch(spark, f"{path}/out", stream.schema))


@query(f"select * from ({_TUMBLE_SQL}) where window_end <= (select max(ts) from events) - interval '1 minute'")
def tumbling_1m_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark hasn't passed at the end of what is there stay in state."""
    path = workspace(spark, "stream-append")
    stream = _tumbling(_event_stream(spark, sf_dir), "1 minute")
    sinks.file_sink(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return _untimed(spark.read.schema(stream.schema).parquet(f"{path}/out"))


@query("""with b as (select count(*)::double c, sum(value::decimal(18,2))::double a from events), s as (select * from b)
select 'count' metric, b.c batch, s.c stream, abs(s.c - b.c) abs_diff, abs(s.c - b.c) / b.c rel_diff, true passed from b, s
union all select 'amount', b.a, s.a, abs(s.a - b.a), abs(s.a - b.a) / b.a, true from b, s""")
def reconcile_batch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reconcile(table(spark, sf_dir, "events"), "value", tumbling_1m_stream_complete(spark, sf_dir), "msg_cnt", "amt_sum")


# ------------------------------------------------------------------ quality


@query("select 'key_uniqueness' rule, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem))::double / count(*) as value, 1.0::double threshold, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) = count(*) passed from lineitem")
def dq_pk_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.key_uniqueness(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_HOLES_SQL = "select c_custkey, case when c_custkey % 3 <> 0 then c_mktsegment end c_mktsegment from customer"


@query(f"select 'null_rate' rule, greatest(count(*) filter (c_mktsegment is null), count(*) filter (c_custkey is null))::double / count(*) as value, 0.05::double threshold, greatest(count(*) filter (c_mktsegment is null), count(*) filter (c_custkey is null))::double / count(*) <= 0.05 passed from ({_HOLES_SQL})")
def dq_null_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    holes = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return quality.null_rate(holes, ["c_custkey", "c_mktsegment"])


@query("with d as (select 'orders' tbl, o_orderdate::date dt, count(*) n from orders group by 2), b as (select *, lag(n) over (order by dt) p from d) select tbl, dt, n, case when p > 0 then abs(n - p)::double / p end as value, coalesce(case when p > 0 then abs(n - p)::double / p end <= 0.5, true) passed from b")
def dq_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.summary(_applications(spark, sf_dir), {"n": F.count("*")}, [F.lit("orders").alias("tbl"), F.col("apply_date").alias("dt")])
    return quality.volatility(d, "tbl", "dt", "n")


@query("select 'not_empty' rule, count(*)::double as value, 1.0::double threshold, count(*) >= 1 passed from orders union all select 'key_uniqueness', 1.0, 1.0, true union all select 'null_rate', 0.0, 0.05, true")
def dq_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.suite(table(spark, sf_dir, "orders"), ["o_orderkey"])


@query("select user_id, event_type, arg_max(value, event_id) as value from events group by 1, 2")
def ledger_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.latest_entries(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


# ------------------------------------------------------------------ skew


_SUM_SQL = "select case when user_id % 10 < 9 then 0 else user_id end k, sum(value::decimal(18,2))::double amt from events group by 1"


def _skewed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 10 < 9, 0).otherwise(F.col("user_id")).alias("k"), "value")


@query(_SUM_SQL)
def direct_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.keyed_sum(_skewed_events(spark, sf_dir), "k", money("value"), "amt").withColumn("amt", F.col("amt").cast("double"))


@query(_SUM_SQL)
def salted_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.salted_sum(_skewed_events(spark, sf_dir), "k", money("value"), "amt", 16, ["event_id"]).withColumn("amt", F.col("amt").cast("double"))


# ------------------------------------------------------------------ sources and sinks


@query("select o_orderkey, o_custkey, o_totalprice, o_orderstatus, o_orderdate from orders")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "csv")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"))
    o.write.option("header", True).option("timestampFormat", readers.TIMESTAMP_FORMAT).csv(path)
    got = readers.csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderdate timestamp")
    return got.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("select o_orderkey, 'dt=' || (date_trunc('month', o_orderdate)::date)::varchar source_file from orders")
def csv_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every month's export, each row with its folder's name as the audit column."""
    root = workspace(spark, "csv-months")
    _applications(spark, sf_dir).select("o_orderkey", F.trunc("apply_date", "month").alias("dt")).repartition("dt").write.partitionBy("dt").option("header", True).csv(root)
    rows = readers.csv(spark, f"{root}/dt=*", "o_orderkey long")
    return readers.with_audit(rows, F.regexp_extract(F.col("_metadata.file_path"), "dt=[^/]+", 0)).drop("etl_time")


_EVENT_SCHEMA = "event_id long, user_id long, event_type string, value double"


@query("select event_id, user_id, event_type, value from events")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with a broken line, a blank one, a file in progress and one of another system beside them."""
    path = workspace(spark, "json")
    table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value").write.json(path)
    files = Files(spark)
    files.write(f"{path}/broken.json", '{"event_id": 1, "user_id"\n\nnot json\n')
    files.write(f"{path}/._other.json", '{"event_id": -1}\n')
    return readers.json_lines(spark, path, _EVENT_SCHEMA)


@query("select event_id, user_id, event_type, value from events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as a bus carries them; what is no JSON is left out."""
    sent = table(spark, sf_dir, "events").select(F.to_json(F.struct("event_id", "user_id", "event_type", "value")).alias("value"))
    bad = spark.createDataFrame([("oops",), ('{"event_id": ',), (None,)], "value string")
    return readers.from_payload(sent.unionByName(bad), _EVENT_SCHEMA)


@query("select event_id, value from events")
def landing_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing batches of JSON lines, each consumed by a file stream as it arrives, as a table."""
    path = workspace(spark, "landing")
    for _ in sinks.landing_batches(table(spark, sf_dir, "events").select("event_id", "value"), path, "2024-01-01", 3, "event_id"):
        stream = readers.json_stream(spark, path, "event_id long, value double")
        sinks.file_sink(stream, f"{path}-out", f"{path}-checkpoint").awaitTermination()
    return spark.read.schema("event_id long, value double").parquet(f"{path}-out")


@query("with n as (select event_id, row_number() over (order by event_id) - 1 k, count(*) over () n from events) select 'batch_2024-01-01_' || lpad((k // ceil(n / 3)::bigint + 1)::varchar, 3, '0') || '.json' file, count(*) as rows, min(event_id) first, max(event_id) last from n group by 1")
def landing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in each numbered file."""
    path = workspace(spark, "landing-files")
    list(sinks.landing_batches(table(spark, sf_dir, "events").select("event_id", "value"), path, "2024-01-01", 3, "event_id"))
    rows = spark.read.schema("event_id long, value double").json(path).select("event_id", F.col("_metadata.file_name").alias("file"))
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.min("event_id").alias("first"), F.max("event_id").alias("last"))


def _by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _applications(spark, sf_dir).select("o_orderkey", "o_totalprice", F.trunc("apply_date", "year").alias("dt"))


@query("select o_orderkey, case when year(o_orderdate) = 1997 then 0.0 else o_totalprice end o_totalprice, (date_trunc('year', o_orderdate)::date)::varchar dt from orders")
def partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition written again, the others untouched."""
    path = workspace(spark, "partitions")
    sinks.overwrite_partitions(_by_year(spark, sf_dir), path)
    sinks.overwrite_day(_by_year(spark, sf_dir).where("dt = date'1997-01-01'").select("o_orderkey", F.lit(0.0).alias("o_totalprice")), path, "1997-01-01")
    return readers.partitions(spark, path)


@query("select o_orderkey, o_totalprice from orders where year(o_orderdate) = 1996")
def leaf_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "leaves")
    sinks.overwrite_partitions(_by_year(spark, sf_dir), path)
    return readers.leaf(spark, path, "1996-01-01")


@query("select (date_trunc('year', o_orderdate)::date)::varchar dt, count(*) n from orders where year(o_orderdate) <= 1997 group by 1")
def partitions_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "until")
    sinks.overwrite_partitions(_by_year(spark, sf_dir), path)
    return metrics.summary(readers.partitions(spark, path, "1997-12-31"), {"n": F.count("*")}, ["dt"])


@query("select o_orderdate::date apply_date, count(*) apply_cnt from orders group by 1")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "export")
    sinks.export_csv(metrics.summary(_applications(spark, sf_dir), {"apply_cnt": F.count("*")}, ["apply_date"]), path, "apply_date")
    return readers.csv(spark, path, "apply_date date, apply_cnt long")


@query("select c_custkey, sha256_48(c_custkey) h from customer".replace("sha256_48(c_custkey)", "('0x' || substr(sha256('app|' || c_custkey::varchar), 1, 12))::bigint"))
def stable_hash_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", stable_hash(F.lit("app"), "c_custkey").alias("h"))


def _draw_sql(label: str, key: str, below: int) -> str:
    """What generated.draw() says, in the other engine's words."""
    return f"(('0x' || substr(sha256('{label}/' || {key}), 1, 12))::bigint % {below})"


def _choice_sql(name: str, key: str = "application_id") -> str:
    return generated.choice(name, name, key, _draw_sql)


def _selected(made: dict[str, str]) -> str:
    return ", ".join(f"{e} {c}" for c, e in made.items())


def _by(label: str, below: int) -> str:
    return _draw_sql(label, "application_id", below)


_TENURE_SQL = f"((date '2024-01-02' - date '{generated.ORIGIN}' + {_draw_sql('phase', 'customer_id', generated.TENURE)}) // {generated.TENURE})"
_CUSTOMERS_SQL = f"with p as (select i, 'P' || lpad(i::varchar, 9, '0') customer_id from range(1, 2001) t(i)) select customer_id, 'person ' || i customer_name, {_selected(generated.profile('customer_id', _TENURE_SQL, _draw_sql))}, (date '{generated.ORIGIN}' + {_draw_sql('since', 'customer_id', 3000)}::int)::date::varchar register_date from p"
_APPLICATIONS_SQL = f"""with k as (select 'L20240102-' || lpad(i::varchar, 8, '0') application_id from range(1, 5001) t(i)), d as (select application_id, 500 + {_by('score a', 120)} + {_by('score b', 120)} + {_by('score c', 120)} s, 21000 + {_by('income a', 900)} * {_by('income b', 320)} income from k)
select application_id, 'P' || lpad((1 + {_by('who', 2000)})::varchar, 9, '0') customer_id, timestamp '2024-01-02 06:00:00' + to_seconds({_by('second', 61200)}) apply_time, greatest(1000, income * (5 + {_by('part', 55)}) // 10000 * 100)::double loan_amnt, ({_choice_sql('term')})::int term,
(300 + 4 * (860 - s) + {_by('margin', 150)}) / 10000 interest_rate, {_choice_sql('purpose')} purpose, {generated.grade('s')} grade, income::double annual_income, (300 + {_by('dti', 5200)}) / 10000 dti, s::int fico_score, {_choice_sql('verification_status')} verification_status, {_choice_sql('home_ownership')} home_ownership,
({_by('yes', 1000)} < 2 * (s - 440))::int is_approved, ({_by('yes', 1000)} < 2 * (s - 440) and 2 * {_by('lost', 1000)} < 900 - s)::int is_default from d"""


@query(_CUSTOMERS_SQL)
def generated_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.customers(spark, 2000, "2024-01-02")


def _as_instants(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("timestamp_ntz"))


@query(_APPLICATIONS_SQL)
def generated_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_instants(generated.applications(spark, 5000, 2000, "2024-01-02"), "apply_time")


@query(f"with a as ({_APPLICATIONS_SQL}) select 'F' || substr(application_id, 2) flow_id, application_id, customer_id, case when {_by('late', 1000)} < 40 + (900 - fico_score) // 2 then 1 + {_by('late a', 10)} * {_by('late b', 12)} else 0 end::int overdue_days, timestamp '2024-01-02 00:00:00' + to_seconds({_by('paid', 86400)}) repay_time from a where is_approved = 1")
def generated_repayments(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = generated.repayments(generated.applications(spark, 5000, 2000, "2024-01-02"), "2024-01-02")
    return _as_instants(flows, "repay_time").select("flow_id", "application_id", "customer_id", "overdue_days", "repay_time")


def _skew_sql(label: str, below: int) -> str:
    return _draw_sql(label, "i::varchar", below)


@query(f"select case when {_skew_sql('heat', 1_000_000)} < 950000 then 'hot_' || {_skew_sql('which', 100)} else 'cold_' || {_skew_sql('which', 100_000)} end as key, {_skew_sql('cents', 500_000)} / 100 amt from range(0, 300000) t(i)")
def skewed_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated.skewed(spark, 300_000)


_RAW_SQL = f"select c_custkey, c_custkey::varchar loan, c_acctbal, c_name, c_nationkey from customer order by {_draw_sql('loan', 'c_custkey::varchar', 1 << 48)}, loan limit 100"
_DRAWN_SQL = _selected({c: e for c, e in generated.profile("loan", "0", _draw_sql).items() if c not in ("occupation", "city")})


def _loans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    raw = c.select(
        F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("annualIncome"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("employmentTitle"), F.col("c_nationkey").alias("regionCode"), (F.col("c_custkey") * 10).alias("loanAmnt"), F.lit(36).alias("term"),
        F.lit(0.1).alias("interestRate"), F.lit("car").alias("purpose"), F.lit("B").alias("grade"), F.lit(None).cast("double").alias("dti"), F.lit(700).alias("ficoRangeLow"), F.lit("0").alias("verificationStatus"), F.lit("1").alias("homeOwnership"), (F.col("c_custkey") % 2).alias("isDefault"),
    )
    return generated.external_loans(raw, 100, "2024-01-02")


@query(f"select 'X' || lpad(loan, 10, '0') customer_id, 'borrower ' || loan customer_name, {_DRAWN_SQL}, coalesce(case when c_custkey % 4 <> 0 then substr(c_name, 1, 20) end, 'unknown') occupation, 'region ' || c_nationkey city, '2024-01-02' register_date from ({_RAW_SQL})")
def external_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loans(spark, sf_dir)[0]


_LOANS_SQL = f"select 'X20240102-' || lpad(loan, 10, '0') application_id, 'X' || lpad(loan, 10, '0') customer_id, timestamp '2024-01-02 12:00:00' apply_time, (c_custkey * 10)::double loan_amnt, 36 term, 0.1::double interest_rate, 'car' purpose, 'B' grade, case when c_custkey % 5 <> 0 then c_acctbal else 0 end::double annual_income, 0::double dti, 700 fico_score, '0' verification_status, '1' home_ownership, 1 is_approved, (c_custkey % 2)::int is_default from ({_RAW_SQL})"


@query(_LOANS_SQL)
def external_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_instants(_loans(spark, sf_dir)[1], "apply_time")


@query(f"with a as ({_LOANS_SQL}) select 'F' || substr(application_id, 2) flow_id, customer_id, case when {_by('late', 1000)} < 40 + (900 - fico_score) // 2 then 1 + {_by('late a', 10)} * {_by('late b', 12)} else 0 end::int overdue_days from a")
def external_repayments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loans(spark, sf_dir)[2].select("flow_id", "customer_id", "overdue_days")


@query("select c_custkey from customer order by ('0x' || substr(sha256(c_custkey::varchar), 1, 12))::bigint, c_custkey limit 50")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.sampled(table(spark, sf_dir, "customer").select("c_custkey"), 50, "c_custkey")


# ------------------------------------------------------------------ versioned tables, maintenance, governance


def _versioned(spark: SparkSession, sf_dir: str) -> SnapshotStore:
    store = SnapshotStore(spark, workspace(spark, "store"), {"customers"})
    store.commit("customers", table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"))
    store.merge("customers", _incoming(spark, sf_dir), ["c_custkey"])
    return store


@query("select c_custkey, c_mktsegment, c_acctbal from customer")
def snapshot_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first version, after a merge has made a second."""
    return _versioned(spark, sf_dir).read("customers", version=0)


@query(_oracles["upsert_merge"])
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, sf_dir).read("customers")


@query(f"select 'overwrite' operation, 0 keys, count(*) row_count, true is_root from customer union all select 'merge', 1, (select count(*) from ({_oracles['upsert_merge']})), false")
def snapshot_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _versioned(spark, sf_dir).history("customers")
    return h.select("operation", F.size("merge_keys").alias("keys"), "row_count", F.col("parent_id").isNull().alias("is_root"))


@query("select count(*) n, sum(l_extendedprice::decimal(18,2))::double amt, true due, true fewer from lineitem")
def compaction_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of small files at any size of the table: 16, or as many as hold 250,000 rows (4 MB before encoding) each, and an empty one, as of a load that brought nothing."""
    path = workspace(spark, "small-files")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    lines.repartition(max(16, math.ceil(lines.count() / 250_000))).write.parquet(path)
    lines.limit(0).write.mode("append").parquet(path)
    done = maintenance.compact(spark, path)
    rows = spark.read.parquet(path).agg(F.count("*").alias("n"), total("l_extendedprice").alias("amt"))
    return rows.select("n", "amt", F.lit(done.due).alias("due"), F.lit(done.files_after < done.files_before).alias("fewer"))


@query("select 2::bigint files, true is_data")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "files")
    table(spark, sf_dir, "nation").repartition(2).write.parquet(path)
    return readers.file_sizes(spark, path).select("files", (F.col("bytes") > 0).alias("is_data"))


REGISTRY = {
    "ods.customer": {"layer": "ods", "path": "customer.parquet", "columns": {"c_custkey": {"type": "long", "from": "export customer.c_custkey"}, "c_name": {"type": "string", "from": "export customer.c_name"}, "c_acctbal": {"type": "string", "from": "export"}, "c_phone": {"type": "string", "from": "export"}}},
    "ods.orders": {"layer": "ods", "path": "orders.parquet", "columns": {c: {"type": t, "from": "export"} for c, t in {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp", "o_orderpriority": "string"}.items()}},
    "ods.absent": {"layer": "ods", "path": "absent.parquet", "columns": {"x": {"type": "int", "from": "export"}}},
    "dwd.fact_apply": {"layer": "dwd", "path": "fact.json", "format": "json", "columns": {"custkey": {"type": "long", "from": "ods.orders.o_custkey"}, "name": {"type": "string", "from": "ods.customer.c_name"}}},
    "dws.apply_day": {"layer": "dws", "path": "day.json", "format": "json", "columns": {"cnt": {"type": "long", "from": "count of dwd.fact_apply.custkey"}, "amt": {"type": "double", "from": "ods.orders.o_totalprice"}}},
}
#: Names that hold for the reader of this registry only.
_DRIFT_SQL = """select * from (values ('ods.customer', 'c_acctbal', 'string', 'double', 'type'), ('ods.customer', 'c_phone', 'string', null, 'missing'), ('ods.customer', 'c_nationkey', null, 'int', 'extra'),
('ods.customer', 'c_mktsegment', null, 'string', 'extra'), ('ods.absent', null, null, null, 'skipped')) t("table", "column", registered, actual, drift)"""


@query(_DRIFT_SQL)
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    actual = governance.schema_rows(spark, {"ods.customer": table(spark, sf_dir, "customer").schema, "ods.orders": table(spark, sf_dir, "orders").schema})
    expected = governance.as_rows(spark, {t: s for t, s in REGISTRY.items() if s.get("format") != "json"})
    return governance.drift(expected, actual)


@query("select * from (values ('ods.orders', 'dwd.fact_apply'), ('ods.customer', 'dwd.fact_apply'), ('dwd.fact_apply', 'dws.apply_day'), ('ods.orders', 'dws.apply_day'), ('bus.events', 'dws.apply_day')) t(source, target)")
def lineage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = spark.createDataFrame([("dws.apply_day", "bus://events")], "table string, source string")
    return governance.edges(governance.as_rows(spark, REGISTRY), outer)


@query("select 3::bigint tasks, 50::bigint max_ms, 30::bigint median_ms, 90::bigint total_ms, 6::bigint shuffle_bytes")
def task_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event log's task figures, from a small log written here."""
    path = f"{workspace(spark, 'events')}.log"
    task = '{"Event":"SparkListenerTaskEnd","Task Metrics":{"Executor Run Time":%d,"Shuffle Write Metrics":{"Shuffle Bytes Written":%d}}}'
    Files(spark).write(path, "\n".join([task % (50, 1), '{"Event":"SparkListenerJobEnd"}', task % (10, 2), task % (30, 3), "cut off {"]))
    return readers.task_metrics(spark, path)


@query("select tbl as \"table\", dt, rowcount from (values ('orders', '1996-01-02', 12::bigint)) t(tbl, dt, rowcount)")
def ledger_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger written twice for the same day: the later entry counts."""
    path = workspace(spark, "ledger")
    for n, at in ((11, "2024-01-01 00:00:00"), (12, "2024-01-02 00:00:00")):
        sinks.append_ledger(spark.createDataFrame([("orders", "1996-01-02", n)], "table string, dt string, rowcount long").withColumn("checked_at", F.lit(at).cast("timestamp")), path)
    return quality.latest_entries(sinks.ledger(spark, path), ["table", "dt"], "rowcount", "checked_at")


@query("select n_name, count(*) cnt from customer join nation on c_nationkey = n_nationkey group by 1")
def stored_handoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages with a written table between them."""
    c = stored(table(spark, sf_dir, "customer").select("c_nationkey"), "stage")
    return c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("cnt"))


# ------------------------------------------------------------------ small operators, each by a query of its own


@query("select c_custkey, sha256(c_custkey || '|' || c_mktsegment) key from customer")
def surrogate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portable kind of surrogate key, over all customers."""
    return table(spark, sf_dir, "customer").select("c_custkey", portable_key("c_custkey", "c_mktsegment").alias("key"))


@query("select strftime(time_bucket(interval 1 minute, ts), '%Y-%m-%d %H:%M:%S') window_start, count(*) n from events group by 1")
def window_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as text, as JSON sinks have them."""
    w = windows.formatted(windows.tumbling(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 minute", {"n": F.count("*")}))
    return w.select("window_start", "n")


@query("select event_id, event_type from events where event_type like 'p%'")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = workspace(spark, "prefix")
    table(spark, sf_dir, "events").select("event_id", "event_type").write.json(path)
    return readers.json_lines(spark, path, "event_id long, event_type string", prefix=("event_type", "p"))


@query("select count(*) > 0 and (select count(*) from (select distinct o_orderkey from orders)) = count(*) and count(*) filter (o_orderkey is null) <= 0.05 * count(*) passed from orders")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = quality.gate(quality.suite(table(spark, sf_dir, "orders"), ["o_orderkey"]))
    return spark.createDataFrame([(passed,)], "passed boolean")


@query("select event_id, name from events, (values ('a'), ('b')) t(name)")
def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One stream into two JSON sinks, each with its own checkpoint."""
    path = workspace(spark, "fan")
    table(spark, sf_dir, "events").select("event_id").write.parquet(f"{path}/in")
    stream = readers.parquet_stream(spark, f"{path}/in", readers.footer_schema(spark, f"{path}/in"))
    for q in sinks.fan_out(stream, [("a", f"{path}/a"), ("b", f"{path}/b")], f"{path}/checkpoints"):
        q.awaitTermination()
    return merge.union_all(*[spark.read.schema("event_id long").json(f"{path}/{x}").withColumn("name", F.lit(x)) for x in "ab"])


@query("select n_name, n_regionkey from nation")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{workspace(spark, 'report')}.json"
    sinks.report(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), path, kind="nations")
    rows = spark.read.option("multiLine", True).schema("kind string, rows array<struct<n_name: string, n_regionkey: int>>").json(path)
    return rows.select(F.explode("rows").alias("r")).select("r.*")


@query("select o_custkey custkey, arg_max(o_orderkey, o_orderkey) o_orderkey, (max(year(o_orderdate)) || '-01-01') dt from orders where o_custkey = (select min(o_custkey) from orders) and year(o_orderdate) = (select max(year(o_orderdate)) from orders where o_custkey = (select min(o_custkey) from orders)) group by 1")
def newest_partition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key's last row, from the newest partition that has one; older ones are not read."""
    path = workspace(spark, "newest")
    o = _applications(spark, sf_dir).select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.trunc("apply_date", "year").alias("dt"))
    sinks.overwrite_partitions(o, path)
    return serving.newest_partition(spark, path, ["o_orderkey"], custkey=o.agg(F.min("custkey")).first()[0]).select("custkey", "o_orderkey", "dt")
