"""Sinks and read-backs: role exports, nested batches, rationale files, provenance."""

from __future__ import annotations

import json

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions import credit
from riskframe.operators import quality, sampling
from riskframe.session import dropping_shuffles
from riskframe.sources import refdata
from riskframe.sources.tables import Tables, keyed_join

KEY = "application_reference"
PREFIX = {"feature": "X", "target": "y", "protected": "protected"}
_SPARK_TYPE = {"numeric": "DOUBLE", "integer": "BIGINT", "boolean": "INT",
               "categorical": "STRING", "text": "STRING", "date": "STRING"}


def role_columns(columns: list[str], roles: dict[str, str], role: str) -> list[str]:
    return [c for c in columns if roles[c] == role and c != KEY]


def role_matrix(rows: DataFrame, role: str, roles: dict[str, str] | None = None) -> DataFrame:
    """Split, reference and the columns of one role; fails if the dictionary disagrees."""
    roles = roles or refdata.ROLE
    quality.require_consistent(rows.columns, roles)
    return rows.select("split", KEY, *role_columns(rows.columns, roles, role))


def export(rows: DataFrame, folder: str, roles: dict[str, str] | None = None) -> DataFrame:
    """Writes X, y and protected, one CSV folder per split; returns the file summary.

    Files follow one another in application order inside a split: rows are placed
    by range on (split, application), so no split has to fit in one task. NULL
    becomes an empty field. The rows are worked out once and kept on disk for the three roles,
    each of which reads them twice, for its ranges and for its files; kept in memory, they
    would take it from the joins that work them out and from the sorts.
    """
    roles = roles or refdata.ROLE
    quality.require_consistent(rows.columns, roles)
    names = {role: role_columns(rows.columns, roles, role) for role in PREFIX}
    kept = rows.select(*dict.fromkeys(["split", "application_id", KEY, *sum(names.values(), [])])).persist(
        StorageLevel.DISK_ONLY)
    try:
        with dropping_shuffles(rows.sparkSession):
            for role, prefix in PREFIX.items():
                (kept.select(*dict.fromkeys(["split", "application_id", KEY, *names[role]]))
                 .repartitionByRange("split", "application_id")
                 .sortWithinPartitions("split", "application_id").drop("application_id")
                 .write.mode("overwrite").partitionBy("split")
                 .option("header", True).option("emptyValue", "").option("nullValue", "")
                 .csv(f"{folder}/{prefix}"))
    finally:
        kept.unpersist()
    return export_summary(rows, roles)


def export_summary(rows: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """(file, rows, columns) of the export."""
    roles = roles or refdata.ROLE
    files = F.array(*[
        F.struct(F.lit(prefix).alias("prefix"),
                 F.lit(1 + len(role_columns(rows.columns, roles, role))).alias("columns"))
        for role, prefix in PREFIX.items()])
    counts = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
    return (counts.withColumn("f", F.explode(files))
            .select(F.concat("f.prefix", F.lit("_"), "split", F.lit(".csv")).alias("file"),
                    "rows", F.col("f.columns").alias("columns")))


def read_matrix(spark: SparkSession, folder: str, role: str, split: str | None = None,
                columns: list[str] | None = None) -> DataFrame:
    """One exported role with the types the dictionary declares, never inferred ones."""
    from riskframe.operators.dataset import COLUMNS
    names = columns or role_columns(COLUMNS, refdata.ROLE, role)
    schema = ", ".join([f"{KEY} STRING"] + [
        f"{n} {_SPARK_TYPE[refdata.DATA_TYPE[n]]}" for n in names] + ["split STRING"])
    frame = (spark.read.schema(schema).option("header", True)
             .csv(f"{folder}/{PREFIX[role]}"))
    return frame if split is None else frame.where(F.col("split") == split)


def training_rows(spark: SparkSession, folder: str, split: str, target: str) -> DataFrame:
    """X joined to one target on the reference; rows without a target are dropped."""
    x = read_matrix(spark, folder, "feature", split).drop("split")
    y = read_matrix(spark, folder, "target", split).select(KEY, target)
    return keyed_join(x, y, KEY).where(F.col(target).isNotNull())


def summaries(rows: DataFrame, t: Tables, sample: DataFrame) -> DataFrame:
    """Nested, readable summary per sampled file, with its coded reasons.

    ``sample`` is (application_id, stratum) of bounded size; a file has at most one
    reason per code, so its reason array is bounded too.
    """
    # A curated sample is a few hundred rows by construction.
    wanted = F.broadcast(sample)
    reason = t["reason"].select(F.col("code").alias("reason_code"), "label", "polarity")
    reasons = (
        t["decision_reason"].join(F.broadcast(sample.select("application_id")),
                                  "application_id", "left_semi")
        .join(F.broadcast(reason), "reason_code").groupBy("application_id")
        .agg(F.sort_array(F.collect_set(F.struct(F.col("reason_code").alias("code"), "label",
                                                 "polarity"))).alias("reasons")))

    def yes(name: str):
        return (F.col(name) == 1).alias(name)

    def euros(name: str):
        return F.col(name).alias(f"{name}_eur")

    picked = rows.drop("reasons").join(wanted, "application_id").join(
        reasons, "application_id", "left")
    return picked.select(
        "application_id", F.col(KEY).alias("reference"),
        F.struct("loan_type", euros("requested_amount"), "term_months",
                 F.col("apr").alias("apr_pct"), euros("monthly_payment"),
                 euros("down_payment"), "channel").alias("operation"),
        F.struct(credit.contract_wording(F.col("contract_type")).alias("contract_fr"),
                 "months_in_job", yes("in_probation_period"), "occupation",
                 yes("has_co_borrower"), "household_size", "dependent_children",
                 "housing_status", "relationship_months").alias("borrower"),
        F.struct(euros("weighted_income"), euros("counted_expenses"), "existing_loans",
                 euros("existing_loan_payments"), "dti_before_pct", "dti_after_pct",
                 euros("residual_income_per_cu"), euros("liquid_savings"),
                 "savings_months_of_expenses").alias("financials"),
        F.struct("days_overdrawn_12m", "rejected_debits_12m", yes("ficp_flagged"),
                 yes("fcc_flagged"), "loans_repaid_clean", yes("salary_domiciled"))
        .alias("behaviour"),
        F.struct(F.col("decision_result").alias("result"), euros("approved_amount"),
                 "approved_term_months", "conditions", "risk_grade").alias("decision"),
        F.coalesce("reasons", F.array().cast(
            "array<struct<code:string,label:string,polarity:string>>")).alias("reasons"),
        F.col("stratum").alias("_stratum"))


def write_batches(nested: DataFrame, folder: str, per_batch: int = sampling.PER_BATCH) -> None:
    """One JSON folder per batch, as many batches as the sample fills."""
    (sampling.batched(nested, per_batch, batches=None).drop("application_id")
     .repartition("batch").write.mode("overwrite").partitionBy("batch").json(folder))


#: Columns of the ledger of answer files that were taken.
LEDGER = "stem string, written timestamp, digest string"


def answer_files(spark: SparkSession, folder: str, ledger: str | None = None) -> DataFrame:
    """(stem, file_number, written, digest, state) of every ``batch_NN_out.json``.

    state is ``stale`` for a file older than the ``batch_NN_in.json`` it answers, ``seen`` for one
    whose name and content the ledger has, ``fresh`` otherwise; an answer with no input twin is
    not stale. A file that was written again with other content is fresh again.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "batch_*_out.json").load(folder)
             .select(F.regexp_extract("path", r"(batch_\d+)_out", 1).alias("stem"),
                     F.col("modificationTime").alias("written"), F.sha2("content", 256).alias("digest")))
    asked = _file_times(spark, f"{folder}/batch_*_in.json")
    seen = read_ledger(spark, ledger).select("stem", "digest", F.lit(1).alias("known")).distinct()
    stale = F.col("asked").isNotNull() & (F.col("written") < F.col("asked"))
    return (files.join(asked, "stem", "left").join(seen, ["stem", "digest"], "left")
            .select("stem", F.regexp_extract("stem", r"(\d+)", 1).cast("int").alias("file_number"), "written", "digest",
                    F.when(stale, "stale").when(F.col("known").isNotNull(), "seen").otherwise("fresh").alias("state")))


def read_ledger(spark: SparkSession, ledger: str | None) -> DataFrame:
    if ledger is not None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.read.schema(LEDGER).parquet(ledger)
    return spark.createDataFrame([], LEDGER)


def record_answers(files: DataFrame, ledger: str) -> None:
    """Add the fresh files to the ledger; call it once their answers are safely loaded."""
    files.where("state = 'fresh'").select("stem", "written", "digest").coalesce(1).write.mode("append").parquet(ledger)


def file_summary(files: DataFrame) -> DataFrame:
    """Files per state."""
    return files.groupBy("state").agg(F.count(F.lit(1)).alias("files"))


def read_rationales(spark: SparkSession, folder: str, ledger: str | None = None) -> DataFrame:
    """Returned batches, without files older than the input they answer or already in the ledger.

    Files are ``batch_NN_out.json`` beside ``batch_NN_in.json``; an answer with no
    input twin is accepted. Gives reference, rationale, file_number, position.
    """
    answers = (
        spark.read.schema("reference STRING, rationale STRING").option("multiLine", True)
        .json(f"{folder}/batch_*_out.json")
        .select("reference", "rationale", F.monotonically_increasing_id().alias("position"),
                F.regexp_extract(F.col("_metadata.file_name"), r"^(batch_\d+)_out", 1).alias("stem")))
    fresh = answer_files(spark, folder, ledger).where("state = 'fresh'").select("stem", "file_number")
    return answers.join(fresh, "stem").select("reference", "rationale", "file_number", "position")


def _file_times(spark: SparkSession, pattern: str) -> DataFrame:
    """(stem, asked) of the input files: one row per file, content not read."""
    folder, glob = pattern.rsplit("/", 1)
    return (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select(F.regexp_extract("path", r"(batch_\d+)_in", 1).alias("stem"),
                    F.col("modificationTime").alias("asked")))


def provenance(t: Tables, *, seed: int, intensity: float, reference_date: str) -> DataFrame:
    """One row that says what the tables were built from."""
    comment = ("realistic default rate" if intensity == 0
               else f"defaults over-sampled (intensity {intensity}): RECALIBRATE")
    ids = t["application"].agg(
        F.count(F.lit(1)).alias("n_applications"),
        F.min("application_date").cast("string").alias("first_date"),
        F.max("application_date").cast("string").alias("last_date"),
        F.lit(1).alias("_one"))
    version = t["indicators"].agg(F.max("formula_version").alias("formula_version"),
                                  F.lit(1).alias("_one"))
    return ids.join(F.broadcast(version), "_one").select(
        "n_applications", F.lit(seed).alias("seed"),
        F.lit(float(intensity)).alias("default_intensity"),
        F.lit(reference_date).alias("reference_date"), "formula_version",
        F.lit(comment).alias("comment"), "first_date", "last_date")


def write_results(spark: SparkSession, folder: str, *, bands: DataFrame | None = None,
                  predictions: DataFrame | None = None, metrics: dict | None = None) -> None:
    """Score bands and test predictions as CSV, metrics as one JSON line."""
    for name, frame in (("score_bands", bands), ("test_predictions", predictions)):
        if frame is not None:
            frame.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
    if metrics is not None:
        spark.createDataFrame([(json.dumps(metrics, ensure_ascii=False),)], "value STRING") \
            .write.mode("overwrite").text(f"{folder}/metrics")
