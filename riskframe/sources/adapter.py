"""Credit tables derived from the order, lineitem, customer and event tables.

Only integer arithmetic on keys is used, so that any engine reproduces the same
rows. Line tables keep one row per source line and are never collected per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskframe.functions import credit
from riskframe.sources import refdata
from riskframe.sources.tables import keyed_join

# ---- fixed values of the derivation -----------------------------------------
ANCHOR = "1995-01-01"
CHANNELS = ["branch", "online", "broker", "point_of_sale"]
SEXES = ["M", "F", "F", "M", "NR"]
MARITAL = ["single", "married", "civil_union", "cohabiting", "divorced", "widowed"]
AREAS = ["urban", "suburban", "rural"]
LOAN_KINDS = ["mortgage", "amortising_consumer", "revolving", "lease", "overdraft"]
BASE_INCOME_TYPE = {
    "PERMANENT": "SALARY", "CIVIL_SERVANT": "CIVIL_SERVICE_PAY", "RETIRED": "PENSION",
    "FIXED_TERM": "SALARY", "SELF_EMPLOYED": "SELF_EMPLOYED_PROFIT", "TEMP_AGENCY": "SALARY",
    "APPRENTICE": "SALARY", "UNEMPLOYED": "UNEMPLOYMENT_BENEFIT",
}
EMPLOYER_TYPE = {
    "PERMANENT": "private", "CIVIL_SERVANT": "public", "FIXED_TERM": "private",
    "SELF_EMPLOYED": "self_employed", "TEMP_AGENCY": "private", "APPRENTICE": "private",
}
# -----------------------------------------------------------------------------


def source(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _div(value: Column, by: int) -> Column:
    return F.floor(value / F.lit(by))


def _contract(c: Column) -> Column:
    return _pick([code for code, *_ in refdata.EMPLOYMENT_CONTRACTS], _div(c, 3) % 8)


def _orders(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.to_date("o_orderdate").alias("application_date"), "o_totalprice")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "customer").select(
        F.col("c_custkey").alias("c"), "c_nationkey", "c_acctbal", "c_mktsegment")


def customer(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c")
    anchor = F.lit(ANCHOR).cast("date")
    return _customers(spark, folder).select(
        c.alias("id"), credit.business_reference("CUS", c).alias("reference"),
        F.date_sub(anchor, (7000 + (c * 37) % 19000).cast("int")).alias("birth_date"),
        _pick(SEXES, c % 5).alias("sex"),
        F.when(c % 25 < 22, "FR").when(c % 25 < 24, "EU").otherwise("NON_EU")
        .alias("nationality_zone"),
        F.date_sub(anchor, ((c * 53) % 4000).cast("int")).alias("relationship_start_date"))


def application(spark: SparkSession, folder: str) -> DataFrame:
    k, c = F.col("k"), F.col("c")
    base = _orders(spark, folder).select(
        k.alias("id"),
        credit.business_reference("APP", k, F.year("application_date")).alias("reference"),
        c.alias("customer_id"),
        F.when((k % 5 == 0) & (c > 0), c - 1).alias("co_borrower_id"),
        "application_date",
        _pick(CHANNELS, k % 4).alias("channel"),
        _pick([code for code, _ in refdata.LOAN_TYPES], c % 6).alias("loan_type_code"),
        (F.lit(1000.0) + F.floor(F.col("o_totalprice") / F.lit(10.0))).alias("requested_amount"),
        (12 + (k * 7) % 109).cast("int").alias("term_months"),
        (F.lit(3.0) + (k % 60) / F.lit(10.0)).alias("nominal_rate"),
        F.when(k % 3 != 0, 1).otherwise(0).alias("insurance_taken"),
        credit.split_of(k).alias("split"))
    amount = F.col("requested_amount")
    return (
        base
        .withColumn("purpose", credit.lookup(refdata.PURPOSE, F.col("loan_type_code")))
        .withColumn("apr", F.col("nominal_rate") + F.lit(1.0))
        .withColumn("usury_rate_cap", F.lit(9.5))
        .withColumn("payment_excl_insurance", credit.level_payment(
            amount, F.col("nominal_rate"), F.col("term_months")))
        .withColumn("monthly_insurance_cost",
                    credit.insurance_cost(amount, F.col("insurance_taken")))
        .withColumn("monthly_payment", credit.total_payment(
            F.col("payment_excl_insurance"), F.col("monthly_insurance_cost")))
        .withColumn("down_payment", F.when(F.col("id") % 4 == 0, F.floor(amount * F.lit(0.2))
                                           .cast("double")).otherwise(F.lit(0.0)))
        .withColumn("source", F.lit("generated")))


def household(spark: SparkSession, folder: str) -> DataFrame:
    c = F.col("c")
    children = F.greatest(F.lit(0), c % 5 - 1)
    return (
        keyed_join(_orders(spark, folder).where(F.col("k") % 101 != 0).select("k", "c"),
                   _customers(spark, folder).select("c", "c_nationkey"), "c")
        .select(
            F.col("k").alias("application_id"),
            _pick(MARITAL, c % 6).alias("marital_status"),
            (1 + c % 5).alias("household_size"), children.alias("dependent_children"),
            _div(children + 1, 2).alias("children_under_14"),
            _pick([code for code, *_ in refdata.HOUSING_STATUSES], _div(c, 5) % 5)
            .alias("housing_status_code"),
            ((c * 11) % 240).alias("months_at_address"),
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("department"),
            _pick(AREAS, c % 3).alias("area_type")))


def _employment_of(df: DataFrame, role: str) -> DataFrame:
    c = F.col("c")
    staged = df.select(
        F.col("k").alias("application_id"), F.lit(role).alias("role"),
        _pick([code for code, _ in refdata.OCCUPATIONS], c % 9).alias("occupation_code"),
        _contract(c).alias("contract_code"), ((c * 13) % 300).alias("months_in_job"),
        F.col("c_mktsegment").alias("industry"))
    return staged.select(
        "*",
        ((F.col("contract_code") == "PERMANENT") & (F.col("months_in_job") < 4))
        .cast("int").alias("in_probation_period"),
        credit.lookup(EMPLOYER_TYPE, F.col("contract_code")).alias("employer_type"))


def employment(spark: SparkSession, folder: str) -> DataFrame:
    orders = _orders(spark, folder).select("k", "c")
    customers = _customers(spark, folder).select("c", "c_mktsegment")
    primary = keyed_join(orders, customers, "c", "left")
    partner = keyed_join(orders.where((F.col("k") % 5 == 0) & (F.col("k") % 15 != 0))
                         .withColumn("c", F.col("c") - 1), customers, "c", "left")
    return _employment_of(primary, "primary").unionByName(
        _employment_of(partner.where("c >= 0"), "co_borrower"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return source(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("application_id"), "l_linenumber", "l_extendedprice",
        "l_returnflag", "l_suppkey", "l_partkey")


def income(spark: SparkSession, folder: str) -> DataFrame:
    c, contract = F.col("c"), F.col("contract")
    base = (
        _orders(spark, folder).where(F.col("k") % 97 != 0)
        .withColumn("contract", _contract(c))
        .select(
            F.col("k").alias("application_id"), F.lit("primary").alias("role"),
            credit.lookup(BASE_INCOME_TYPE, contract).alias("income_type_code"),
            (1200 + (c * 41) % 2800).cast("double").alias("monthly_amount"),
            F.when(contract == "SELF_EMPLOYED", "variable").otherwise("fixed")
            .alias("variability"),
            F.when(contract == "UNEMPLOYED", 0.0).when(contract == "SELF_EMPLOYED", 0.9)
            .otherwise(1.0).alias("weighting"),
            F.lit(1).alias("documented")))
    first = F.col("l_linenumber") == 1
    extra = (
        _lines(spark, folder).where("l_linenumber IN (1, 2)")
        .select(
            "application_id",
            F.when(~first, "household").when(F.col("application_id") % 5 == 0, "co_borrower")
            .otherwise("primary").alias("role"),
            F.when(first, "VARIABLE_BONUS").otherwise("FAMILY_BENEFITS")
            .alias("income_type_code"),
            (F.lit(50.0) + F.floor(F.col("l_extendedprice") / F.lit(200.0)))
            .alias("monthly_amount"),
            F.when(first, "variable").otherwise("fixed").alias("variability"),
            F.when(first, 0.7).otherwise(1.0).alias("weighting"),
            F.when(first & (F.col("l_returnflag") == "A"), 0).otherwise(1).alias("documented")))
    return base.unionByName(extra)


def expense(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("l_linenumber")
    return (
        _lines(spark, folder).where("l_linenumber IN (3, 4, 5)")
        .select(
            "application_id",
            F.when(number == 3, "RENT").when(number == 4, "ALIMONY_PAID")
            .otherwise("OTHER_EXPENSE").alias("expense_type_code"),
            (F.lit(50.0) + F.floor(F.col("l_extendedprice") / F.lit(400.0)))
            .alias("monthly_amount"),
            (F.col("l_returnflag") != "N").cast("int").alias("counted_in_dti")))


def existing_loan(spark: SparkSession, folder: str) -> DataFrame:
    payment = F.lit(20.0) + F.floor(F.col("l_extendedprice") / F.lit(500.0))
    remaining = 1 + F.col("l_partkey") % 60
    return (
        _lines(spark, folder).where("l_linenumber IN (6, 7)")
        .select(
            "application_id", _pick(LOAN_KINDS, F.col("l_suppkey") % 5).alias("loan_kind"),
            F.when(F.col("l_suppkey") % 2 == 0, "internal").otherwise("external")
            .alias("lender"),
            payment.alias("monthly_payment"), remaining.alias("remaining_months"),
            (payment * remaining).alias("outstanding_balance"),
            (F.col("l_partkey") % 4 == 0).cast("int").alias("repaid_by_this_loan"),
            (F.col("l_returnflag") == "R").cast("int").alias("incidents_12m")))


def account_behaviour(spark: SparkSession, folder: str) -> DataFrame:
    def count_of(kind: str) -> Column:
        return F.count(F.when(F.col("event_type") == kind, 1))

    activity = (source(spark, folder, "events").groupBy(F.col("user_id").alias("u"))
                .agg(count_of("error").alias("errors"), count_of("view").alias("views"),
                     count_of("click").alias("clicks")))
    c = F.col("c")
    customers = (keyed_join(_customers(spark, folder).select("c", "c_acctbal", _div(c, 10).alias("u")),
                            activity, "u", "left").na.fill(0, ["errors", "views", "clicks"]))
    liquid = F.floor(F.greatest(F.col("c_acctbal"), F.lit(0.0)))
    return (
        keyed_join(_orders(spark, folder).where(F.col("k") % 103 != 0).select("k", "c"),
                   customers, "c")
        .select(
            F.col("k").alias("application_id"), F.col("c_acctbal").alias("average_balance"),
            ((F.col("views") * 11 + c * 3) % 200).alias("days_overdrawn_12m"),
            ((F.col("errors") + c) % 7).alias("rejected_debits_12m"),
            (F.col("clicks") % 10).alias("overdraft_fees_12m"),
            ((c % 6) * 200).alias("overdraft_limit"),
            ((c * 17) % 1500).alias("max_overdraft_used"),
            liquid.alias("liquid_savings"), (liquid + (c * 7) % 3000).alias("total_savings"),
            (1 + c % 6).alias("products_held"), (c % 3 != 0).cast("int").alias("salary_domiciled"),
            (c % 23 == 0).cast("int").alias("ficp_flagged"),
            (c % 46 == 0).cast("int").alias("fcc_flagged"),
            (_div(c, 7) % 5).alias("loans_repaid_clean")))


CAPTURED = {
    "customer": customer, "application": application, "household": household,
    "employment": employment, "income": income, "expense": expense,
    "existing_loan": existing_loan, "account_behaviour": account_behaviour,
}


def rationale_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Batches of written rationales: (reference, rationale, file, position).

    References follow the application numbering; those past the last application
    are unknown on purpose.
    """
    number = F.col("doc_id") * 20
    return (
        keyed_join(
            source(spark, folder, "documents")
            .select(number.alias("id"), F.col("text").alias("rationale"),
                    (F.col("doc_id") % 8).cast("int").alias("file_number"),
                    F.col("doc_id").alias("position")),
            _orders(spark, folder).select(F.col("k").alias("id"), "application_date"),
            "id", "left")
        .select(
            F.when(F.col("application_date").isNotNull(), credit.business_reference(
                "APP", F.col("id"), F.year("application_date")))
            .otherwise(F.concat(F.lit("APP-UNKNOWN-"), F.col("id").cast("string")))
            .alias("reference"),
            "rationale", "file_number", "position"))
