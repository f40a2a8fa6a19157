"""Violation reports: what a database would refuse is listed instead.

Row reports have (table_name, rule, key); summaries have (rule, checked, violations).
A predicate that is unknown (NULL) is no violation, as with a declared constraint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import credit
from riskframe.sources import refdata, schemas
from riskframe.sources.tables import Tables, keyed_join


class InconsistentExport(RuntimeError):
    """Dataset columns and dictionary disagree."""


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def broken(predicate: str) -> Column:
    return ~F.coalesce(F.expr(predicate), F.lit(True))


def table_rules(table: str) -> list[tuple[str, str]]:
    """Domain, cross-column and not-null rules of a table as (name, predicate)."""
    required = [(f"{c} is present", f"{c} IS NOT NULL") for c in schemas.required_columns(table)]
    return (schemas.DOMAIN_RULES.get(table, []) + schemas.CROSS_COLUMN_RULES.get(table, [])
            + required)


def row_violations(df: DataFrame, table: str, rules: list[tuple[str, str]]) -> DataFrame:
    """All broken rules of all rows, in one scan of the table."""
    names = F.array_compact(F.array(*[F.when(broken(p), name) for name, p in rules]))
    return df.select(
        F.lit(table).alias("table_name"), F.explode(names).alias("rule"),
        F.col(schemas.ROW_KEY[table]).cast("string").alias("key"))


def domain_violations(t: Tables) -> DataFrame:
    return union_all([row_violations(t[name], name, table_rules(name))
                      for name in schemas.TABLES])


def rule_summary(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Rows checked and rows broken per rule, in one aggregation."""
    totals = df.agg(F.count(F.lit(1)).alias("checked"), *[
        F.count(F.when(broken(p), 1)).alias(f"v{i}") for i, (_, p) in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"v{i}").alias("violations"))
                        for i, (name, _) in enumerate(rules)])
    return (totals.select("checked", F.explode(entries).alias("r"))
            .select("r.rule", "checked", "r.violations"))


def dictionary_orphans(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Columns of the dataset that the dictionary does not declare."""
    present = rows.sparkSession.createDataFrame([(c,) for c in rows.columns],
                                                "column_name STRING")
    return present.join(dictionary.select("column_name"), "column_name", "left_anti")


def dictionary_stale(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary entries with no column in the dataset."""
    present = rows.sparkSession.createDataFrame([(c,) for c in rows.columns],
                                                "column_name STRING")
    return dictionary.select("column_name").join(present, "column_name", "left_anti")


def require_consistent(columns: list[str], roles: dict[str, str]) -> None:
    """Export gate: every column declared, every declaration present."""
    orphans = [c for c in columns if c not in roles]
    stale = [c for c in roles if c not in columns]
    if orphans:
        raise InconsistentExport("columns missing from the dictionary: " + ", ".join(orphans))
    if stale:
        raise InconsistentExport("dictionary entries without a column: " + ", ".join(stale))


def incomplete_applications(t: Tables) -> DataFrame:
    """Applications lacking a mandatory block, with the list of what is missing."""
    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select("application_id", F.lit(1).alias(name))

    base = t["application"].select(F.col("id").alias("application_id"), "reference")
    blocks = {
        "household": mark(t["household"], "_household"),
        "employment(primary)": mark(t["employment"].where("role = 'primary'"), "_employment"),
        "account_behaviour": mark(t["account_behaviour"], "_behaviour"),
        "indicators": mark(t["indicators"], "_indicators"),
        "income": mark(t["income"].select("application_id").distinct(), "_income"),
    }
    for block in blocks.values():
        base = keyed_join(base, block, how="left")
    missing = F.concat(*[
        F.when(F.col(block.columns[-1]).isNull(), F.lit(f"{name} ")).otherwise(F.lit(""))
        for name, block in blocks.items()])
    return (base.select("reference", missing.alias("missing_blocks"))
            .where(F.col("missing_blocks") != ""))


def co_borrower_mismatch(t: Tables) -> DataFrame:
    """Declared co-borrower without employment row, or the reverse."""
    partner = t["employment"].where("role = 'co_borrower'").select(
        F.col("application_id").alias("id"), F.lit(1).alias("has_row"))
    declared, recorded = F.col("co_borrower_id").isNotNull(), F.col("has_row").isNotNull()
    return (
        keyed_join(t["application"].select("id", "reference", "co_borrower_id"), partner, "id", "left")
        .where(declared != recorded)
        .select("reference", F.when(declared, "co-borrower without employment record")
                .otherwise("co-borrower employment record without co-borrower")
                .alias("problem")))


def declines_without_reason(t: Tables) -> DataFrame:
    application = t["application"].select(F.col("id").alias("application_id"), "reference")
    silent = keyed_join(t["decision"].where("result = 'declined'").select("application_id"),
                        t["decision_reason"].select("application_id"), how="left_anti")
    return keyed_join(silent, application).select("reference")


# ---- fixed values: wording of the warnings --------------------------------------
WARN_OVERRIDE = "DTI above 35% approved without an override reason"
WARN_FICP = "approved despite an FICP flag"
WARN_SHORT = "rationale shorter than 100 characters"
WARN_OUTCOME = "approved application with no outcome recorded"
# -----------------------------------------------------------------------------------


def business_warnings(rows: DataFrame, t: Tables) -> DataFrame:
    """Atypical files worth watching; the dataset is read once for all branches."""
    overrides = (
        t["decision_reason"]
        .join(F.broadcast(t["reason"].where("category = 'override'")
                          .select(F.col("code").alias("reason_code"))), "reason_code", "left_semi")
        .select("application_id").distinct().withColumn("_override", F.lit(1)))
    approved = F.col("decision_result").isin(*credit.APPROVALS)
    warnings = F.array_compact(F.array(
        F.when((F.col("above_hcsf_threshold") == 1) & approved & F.col("_override").isNull(),
               WARN_OVERRIDE),
        F.when((F.col("ficp_flagged") == 1) & approved, WARN_FICP),
        F.when(F.length("rationale") < 100, WARN_SHORT),
        F.when(approved & F.col("outcome_status").isNull(), WARN_OUTCOME)))
    return (
        keyed_join(rows.select("application_id", "application_reference", "above_hcsf_threshold",
                               "decision_result", "ficp_flagged", "rationale", "outcome_status"),
                   overrides, how="left")
        .select(F.col("application_reference").alias("reference"),
                F.explode(warnings).alias("warning")))


def outcome_summary(t: Tables) -> DataFrame:
    """Outcomes only on approvals, counterfactuals only on the rest, rows coherent."""
    decision = t["decision"].select("application_id", "result")
    approved = "result IN ('approved', 'approved_with_conditions')"
    real = keyed_join(t["outcome"], decision, how="left")
    other = keyed_join(t["counterfactual_outcome"], decision, how="left")
    return rule_summary(real, [("outcome on an approved application", approved)]
                        + schemas.OUTCOME_RULES).unionByName(
        rule_summary(other, [("counterfactual on a non-approved application",
                              f"NOT ({approved})")]))


def decision_summary(t: Tables) -> DataFrame:
    return rule_summary(t["decision"], schemas.DECISION_RULES)


def uniqueness_summary(t: Tables) -> DataFrame:
    """Distinct and repeated keys per declared key."""
    def one(table: str, columns: list[str]) -> DataFrame:
        keys = t[table].groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
        return keys.agg(
            F.lit(f"{table}({', '.join(columns)})").alias("rule"),
            F.count(F.lit(1)).alias("distinct_keys"),
            F.count(F.when(F.col("n") > 1, 1)).alias("repeated_keys"))

    return union_all([one(*key) for key in schemas.UNIQUE_KEYS])


def _references(t: Tables, child: str, column: str, parent: str, parent_key: str) -> DataFrame:
    """Child key values with their row counts, and whether the parent exists.

    Counting before the join leaves one row per distinct value, so a value that
    dominates the child table costs no more than any other.
    """
    used = (t[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("ref"))
            .agg(F.count(F.lit(1)).alias("n")))
    known = t[parent].select(F.col(parent_key).alias("ref"), F.lit(1).alias("known"))
    if parent in refdata.code_table_names():
        return used.join(F.broadcast(known), "ref", "left")
    return keyed_join(used, known, "ref", "left")


def reference_violations(t: Tables) -> DataFrame:
    """(rule, key, n) for every value that points at nothing."""
    return union_all([
        _references(t, *fk).where("known IS NULL").select(
            F.lit(f"{fk[0]}.{fk[1]} -> {fk[2]}").alias("rule"),
            F.col("ref").cast("string").alias("key"), "n")
        for fk in schemas.FOREIGN_KEYS])


def reference_summary(t: Tables) -> DataFrame:
    return union_all([
        _references(t, *fk).agg(
            F.lit(f"{fk[0]}.{fk[1]} -> {fk[2]}").alias("rule"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("checked"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0))
            .alias("violations"))
        for fk in schemas.FOREIGN_KEYS])


# ---- rationale validation ---------------------------------------------------------
# fixed value: characters counted as white space at either end of a text
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
              "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def contradicts(text: Column, result: Column) -> Column:
    """Whether the opening of a text announces the opposite of the decision."""
    opening = F.lower(F.substring(text, 1, 160))
    found = F.lit(False)
    for decision, markers in refdata.CONTRADICTION_MARKERS.items():
        hit = reduce(lambda a, b: a | b, [F.contains(opening, F.lit(m)) for m in markers])
        found = found | ((result == decision) & hit)
    return found


def route_rationales(batches: DataFrame, t: Tables) -> DataFrame:
    """Adds application_id and route: unknown, short, contradictory or loaded."""
    known = keyed_join(t["application"].select(F.col("id").alias("application_id"), "reference"),
                       t["decision"].select("application_id", "result"))
    text = F.btrim(F.coalesce(F.col("rationale"), F.lit("")), F.lit(WHITESPACE))
    routed = keyed_join(batches.withColumn("rationale", text), known, "reference", "left")
    return routed.withColumn("route", F.when(F.col("application_id").isNull(), "unknown")
                             .when(F.length("rationale") < 100, "short")
                             .when(contradicts(F.col("rationale"), F.col("result")),
                                   "contradictory")
                             .otherwise("loaded"))


def route_summary(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count(F.lit(1)).alias("rationales"))


def merge_rationales(decision: DataFrame, routed: DataFrame) -> DataFrame:
    """Decisions with accepted texts put in; the last file, then position, wins.

    ``max_by`` keeps one text per task and application before the exchange, so an
    application with very many candidate texts is merged piecewise.
    """
    latest = (
        routed.where("route = 'loaded'").groupBy("application_id")
        .agg(F.max_by("rationale", F.struct("file_number", "position")).alias("_text")))
    return (
        keyed_join(decision, latest, how="left")
        .withColumn("rationale", F.coalesce("_text", "rationale"))
        .withColumn("decided_by", F.when(F.col("_text").isNotNull(), "llm")
                    .otherwise(F.col("decided_by")))
        .drop("_text"))


def authorship(decision: DataFrame) -> DataFrame:
    """Decisions and mean text length per author."""
    return decision.groupBy("decided_by").agg(
        F.count(F.lit(1)).alias("n"),
        F.rint(F.sum(F.length("rationale").cast("bigint")) / F.count("rationale"))
        .alias("mean_length"))
