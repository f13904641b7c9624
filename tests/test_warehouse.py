"""Two business days end to end, then the same days again."""

import pytest
from pyspark.sql import functions as F

from lakeweave.__main__ import skew_bench
from lakeweave.operators import quality
from lakeweave.plans.warehouse import DIMENSION, Warehouse
from lakeweave.sources.fs import Files, workspace


@pytest.fixture(scope="module")
def house(spark):
    w = Warehouse(spark, workspace(spark, "house"))
    for day in ("2024-01-01", "2024-01-02"):
        w.generate(day, 300, 400, 3)
        assert w.run_day(day)
    return w


def test_layers(house):
    apps = house.leaf("dwd", "dwd_fact_loan_apply", "2024-01-02")
    assert apps.count() == 400 and apps.where("customer_sk is null").count() == 0
    assert house.store.history(DIMENSION).count() == 2
    open_ = house.dimension().where("end_date = date'9999-12-31'")
    assert open_.count() == open_.select("customer_id").distinct().count() == 300
    flows = house.leaf("dwd", "dwd_fact_repay", "2024-01-02")
    assert flows.agg(F.count("*"), F.round(F.sum("repay_amount"), 2)).first() == house.realtime("2024-01-02").agg(F.sum("msg_cnt"), F.round(F.sum("repay_amt_sum"), 2)).first()
    risk = house.spark.read.parquet(house.at("ads", "ads_risk_daily")).orderBy("apply_date").collect()
    assert [r.apply_cnt_7d for r in risk] == [400, 800] and [r.apply_cnt_dod for r in risk] == [None, 0.0]
    hist = house.leaf("dws", "dws_customer_day", "2024-01-02")
    assert hist.agg(F.sum("hist_apply_cnt")).first()[0] == 800
    assert house.leaf("dws", "dws_customer_day", "2024-01-01").agg(F.sum("hist_apply_cnt")).first()[0] == 400


def test_serving(house):
    key = house.leaf("ads", "ads_scorecard_features", "2024-01-01").first().application_id
    assert house.features_of(key).first().application_id == key
    person = house.leaf("dws", "dws_customer_day", "2024-01-02").first().customer_id
    assert house.customer_history(person).first().dt == "2024-01-02"
    assert house.customer_now(person).count() == 1 and house.customer_now("nobody").count() == 0
    assert house.risk_on("2024-01-02").count() == 1 and house.risk_on("2023-01-01").count() == 0
    board = house.dashboard("2024-01-02")
    assert board["kpi"].count() == 1 and board["series"].count() == 2 and board["windows"].count() == 20


def test_day_again(house):
    before = sorted(map(str, house.dimension().drop("customer_sk").collect()))
    house.ods("2024-01-02")
    house.dwd_customer("2024-01-02")
    house.dwd_facts("2024-01-02")
    assert sorted(map(str, house.dimension().drop("customer_sk").collect())) == before
    assert house.leaf("dwd", "dwd_fact_loan_apply", "2024-01-02").count() == 400


def test_gates_fail(house, spark):
    bad = quality.reconcile(house.leaf("dwd", "dwd_fact_repay", "2024-01-02"), "repay_amount", house.realtime("2024-01-01").limit(5), "msg_cnt", "repay_amt_sum")
    assert not quality.gate(bad)
    assert Files(spark).exists(f"{house.root}/quality/check_2024-01-02.json")


def test_maintenance_and_schema(house):
    done = house.compact()
    assert done.where("files_after > 1").count() == 0
    reg = house.registry()
    assert house.drift(reg).count() == 0
    reg["ods.customer"]["columns"]["age"]["type"] = "string"
    assert [r.drift for r in house.drift(reg).collect()] == ["type"]


def test_skew_bench(spark, capsys):
    skew_bench(spark, 20_000, 4)
    assert "'same': True" in capsys.readouterr().out
