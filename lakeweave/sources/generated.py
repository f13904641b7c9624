"""Synthetic data of a consumer-credit business, a skewed table, and the mapping of a public loan table.

Every column of every row is drawn on its own: a draw is a stable hash of a label and the row's key, so rows can be made
in any order on any number of tasks, and SQL can make the same ones. Draws are whole numbers, as is all arithmetic on
them. A `Draws` object renders either Spark columns or SQL from the same statement of a distribution.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fs import checked_day

#: Names and types of the columns of the business tables, as the exports have them.
CUSTOMER = "customer_id string, customer_name string, gender string, age int, education string, marital_status string, occupation string, city string, register_date string"
APPLICATION = "application_id string, customer_id string, apply_time timestamp, loan_amnt double, term int, interest_rate double, purpose string, grade string, annual_income double, dti double, fico_score int, verification_status string, home_ownership string, is_approved int, is_default int"
REPAYMENT = "flow_id string, application_id string, customer_id string, due_date string, repay_time timestamp, due_amount double, repay_amount double, overdue_days int"

#: Values of each attribute with their weights out of a hundred.
WEIGHTS = {
    "gender": {"F": 51, "M": 49},
    "education": {"none": 6, "secondary": 41, "vocational": 23, "undergraduate": 21, "postgraduate": 9},
    "marital_status": {"married": 48, "never married": 31, "separated": 14, "widowed": 7},
    "occupation": {"trade": 19, "office": 24, "public service": 13, "transport": 9, "health care": 11, "farming": 5, "own business": 8, "retired": 11},
    "city": {"Lisbon": 16, "Porto": 12, "Ghent": 11, "Turin": 14, "Lyon": 13, "Graz": 9, "Aarhus": 7, "Cork": 8, "Bergen": 10},
    "purpose": {"vehicle": 27, "home works": 22, "debt transfer": 19, "studies": 11, "treatment": 9, "wedding": 5, "stock in trade": 7},
    "term": {6: 8, 12: 29, 18: 12, 24: 25, 36: 19, 72: 7},
    "verification_status": {"by payslip": 46, "by bank": 33, "open": 21},
    "home_ownership": {"rent": 44, "owned": 21, "loan": 29, "family": 6},
}
#: Least score of each grade from the best on; what is below all has the last.
GRADES = {"A": 790, "B": 750, "C": 710, "D": 670, "E": 630, "F": 590}
LAST_GRADE = "G"
#: Days that a customer keeps an occupation and a city: about one in a hundred changes on any day.
TENURE = 100
ORIGIN = datetime.date(2015, 1, 1)


def draw(label: str, key: str, below: int) -> str:
    """SQL of Spark for a whole number from 0 to below - 1 that depends on the label and the key column alone."""
    return f"cast(conv(substring(sha2(concat('{label}/', {key}), 256), 1, 12), 16, 10) as bigint) % {below}"


def choice(attribute: str, label: str, key: str, dealer=draw) -> str:
    """A value of WEIGHTS by its weight; dealer(label, key, below) renders the draw."""
    values, up, steps = WEIGHTS[attribute], 0, []
    for value, weight in values.items():
        up += weight
        steps.append(f"when x < {up} then {value!r}")
    assert up == 100, attribute
    number = dealer(label, key, 100)
    return "case " + " ".join(s.replace("x <", f"({number}) <") for s in steps) + " end"


def grade(score: str) -> str:
    return "case " + " ".join(f"when {score} >= {least} then '{name}'" for name, least in GRADES.items()) + f" else '{LAST_GRADE}' end"


def profile(key: str, tenure: str, dealer=draw) -> dict[str, str]:
    """Expressions of a customer's attributes; `tenure` numbers the stretch of days in which job and city stay."""
    lasting = {c: choice(c, c, key, dealer) for c in ("gender", "education", "marital_status")}
    age = f"cast(19 + ({dealer('age a', key, 31)}) + ({dealer('age b', key, 28)}) as int)"
    moving = f"concat({key}, '/', cast({tenure} as string))"
    return {**lasting, "age": age, "occupation": choice("occupation", "job", moving, dealer), "city": choice("city", "home", moving, dealer)}


def _days(day: str) -> int:
    return (datetime.date.fromisoformat(checked_day(day)) - ORIGIN).days


def _typed(rows: DataFrame, ddl: str) -> DataFrame:
    return rows.select(*[F.col(name).cast(kind).alias(name) for name, kind in (x.split(" ") for x in ddl.split(", "))])


def customer_key(number: str) -> str:
    return f"concat('P', lpad(cast({number} as string), 9, '0'))"


def customers(spark: SparkSession, n: int, day: str) -> DataFrame:
    """A full snapshot of n customers: each changes job and city once in TENURE days, on a day of their own."""
    made = {"customer_name": "concat('person ', id)", "register_date": f"cast(date_add(date'{ORIGIN}', cast({draw('since', 'customer_id', 3000)} as int)) as string)"}
    made |= profile("customer_id", f"cast(floor(({_days(day)} + {draw('phase', 'customer_id', TENURE)}) / {TENURE}) as bigint)")
    rows = spark.range(1, n + 1).selectExpr("id", f"{customer_key('id')} customer_id").selectExpr("customer_id", *[f"{e} {c}" for c, e in made.items()])
    return _typed(rows, CUSTOMER)


def applications(spark: SparkSession, n: int, n_customers: int, day: str) -> DataFrame:
    """A day's n applications. The score is a sum of three draws; grade, rate, approval and default follow from it,
    the amount from the income, which is a product of two draws."""
    day = checked_day(day)
    rows = spark.range(1, n + 1).selectExpr(f"concat('L{day.replace('-', '')}-', lpad(cast(id as string), 8, '0')) application_id")
    by = lambda label, below: draw(label, "application_id", below)
    rows = rows.selectExpr(
        "application_id", f"1 + {by('who', n_customers)} who", f"500 + ({by('score a', 120)}) + ({by('score b', 120)}) + ({by('score c', 120)}) fico_score", f"21000 + ({by('income a', 900)}) * ({by('income b', 320)}) annual_income",
        f"{by('second', 61200)} second", f"5 + {by('part', 55)} part", f"{by('margin', 150)} margin", f"300 + {by('dti', 5200)} dti", f"{by('yes', 1000)} yes", f"{by('lost', 1000)} lost", *[f"{choice(c, c, 'application_id')} {c}" for c in ("purpose", "term", "verification_status", "home_ownership")],
    )
    approved = "yes < 2 * (fico_score - 440)"
    rows = rows.withColumns({
        "customer_id": F.expr(customer_key("who")), "apply_time": F.expr(f"timestamp_seconds(unix_timestamp(timestamp'{day} 06:00:00') + second)"), "loan_amnt": F.expr("greatest(1000, annual_income * part div 10000 * 100)"),
        "interest_rate": F.expr("(300 + 4 * (860 - fico_score) + margin) / 10000"), "dti": F.expr("dti / 10000"), "grade": F.expr(grade("fico_score")), "is_approved": F.expr(f"if({approved}, 1, 0)"), "is_default": F.expr(f"if({approved} and 2 * lost < 900 - fico_score, 1, 0)"),
    })
    return _typed(rows, APPLICATION)


def repayments(apps: DataFrame, day: str) -> DataFrame:
    """The instalment of each approved application, with simple interest. The lower the score, the more are late; who is
    over 30 days late has paid between nothing and three quarters, the others all."""
    day = checked_day(day)
    by = lambda label, below: draw(label, "application_id", below)
    rows = apps.where("is_approved = 1").selectExpr(
        "concat('F', substring(application_id, 2)) flow_id", "application_id", "customer_id", f"'{day}' due_date", f"timestamp_seconds(unix_timestamp(timestamp'{day} 00:00:00') + {by('paid', 86400)}) repay_time",
        "round(loan_amnt * (1 + interest_rate * term / 12) / term, 2) due_amount", f"if({by('late', 1000)} < 40 + (900 - fico_score) div 2, 1 + ({by('late a', 10)}) * ({by('late b', 12)}), 0) overdue_days", f"{by('quarters', 4)} quarters",
    )
    return _typed(rows.withColumn("repay_amount", F.expr("if(overdue_days > 30, round(due_amount * quarters / 4, 2), due_amount)")), REPAYMENT)


def skewed(spark: SparkSession, rows: int, hot: int = 100, share: float = 0.95, cold: int = 100_000, parts: int = 8) -> DataFrame:
    """(key, amt) with a share of the rows on a few hot keys; amounts are cents below 5,000.00."""
    number = "cast(id as string)"
    named = spark.range(0, rows, 1, parts).selectExpr(f"{draw('heat', number, 1_000_000)} heat", f"{draw('which', number, hot)} warm", f"{draw('which', number, cold)} cool", f"{draw('cents', number, 500_000)} cents")
    key = F.when(F.col("heat") < round(share * 1_000_000), F.concat(F.lit("hot_"), "warm")).otherwise(F.concat(F.lit("cold_"), "cool"))
    return named.select(key.alias("key"), (F.col("cents") / 100).alias("amt"))


#: Fields of the public loan table that become columns of an application as they are.
LOAN_FIELDS = {
    "loan_amnt": "loanAmnt", "term": "term", "interest_rate": "interestRate", "purpose": "purpose", "grade": "grade", "annual_income": "annualIncome", "dti": "dti",
    "fico_score": "ficoRangeLow", "verification_status": "verificationStatus", "home_ownership": "homeOwnership", "is_default": "isDefault",
}
#: Those that count as 0 where they are missing.
ZERO_IF_MISSING = ("annual_income", "dti")


def external_loans(raw: DataFrame, n: int, day: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers, applications and repayments from n loans of a public table; those with the least hashes of their ids.

    What the table has no field for (gender, age, family, education) is drawn as for generated customers. The job is
    the employment title, its first 20 characters, or `unknown`; the city is the region's code; all are approved and
    applied at noon.
    """
    day = checked_day(day)
    loans = raw.withColumn("loan", F.col("id").cast("string")).orderBy(F.expr(draw("loan", "loan", 1 << 48)), "loan").limit(n)
    drawn = profile("loan", "0")
    people = loans.selectExpr(
        "concat('X', lpad(loan, 10, '0')) customer_id", "concat('borrower ', loan) customer_name", *[f"{drawn[c]} {c}" for c in ("gender", "age", "education", "marital_status")],
        "coalesce(left(cast(employmentTitle as string), 20), 'unknown') occupation", "concat('region ', cast(regionCode as int)) city", f"'{day}' register_date",
    )
    taken = {c: F.coalesce(F.col(field).cast("double"), F.lit(0.0)) if c in ZERO_IF_MISSING else F.col(field) for c, field in LOAN_FIELDS.items()}
    apps = loans.select(
        F.concat(F.lit(f"X{day.replace('-', '')}-"), F.lpad("loan", 10, "0")).alias("application_id"), F.concat(F.lit("X"), F.lpad("loan", 10, "0")).alias("customer_id"),
        F.lit(f"{day} 12:00:00").cast("timestamp").alias("apply_time"), F.lit(1).alias("is_approved"), *[e.alias(c) for c, e in taken.items()],
    )
    apps = _typed(apps, APPLICATION)
    return _typed(people, CUSTOMER), apps, repayments(apps, day)
