"""Decision rules: coded reasons, policy, conditions, outcomes, warnings, text.

Input rows are those of ``dataset.situation``. Where the policy involves chance, a
``chance(salt)`` Column in [0, 1) may be supplied; without one every draw takes
its most likely branch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import credit
from riskframe.functions.numeric import round_to
from riskframe.sources import refdata

Chance = Callable[[int], Column]

# Situation columns the rules read.
INPUTS = [
    "application_id", "application_date", "loan_type", "requested_amount", "term_months",
    "insurance_taken", "down_payment", "has_co_borrower", "months_at_address", "contract_type",
    "contract_stability", "months_in_job", "in_probation_period", "rule_relationship_months",
    "undocumented_income_lines", "weighted_income", "variable_income_share", "revolving_loans",
    "loan_incidents_12m", "days_overdrawn_12m", "rejected_debits_12m", "salary_domiciled",
    "ficp_flagged", "fcc_flagged", "loans_repaid_clean", "dti_after_pct",
    "residual_income_per_cu", "payment_shock", "savings_months_of_expenses",
]

# ---- fixed values: salts of the keyed draws -----------------------------------
OVERRIDE, LOW_SCORE, GREY_ZONE, REMAINDER, DEFERRAL = 31, 37, 41, 43, 47
OUTCOME, COUNTERFACTUAL = 53, 59
NEW_RELATIONSHIP, SHORTER, SHORTER_BY = 61, 67, 71
# -------------------------------------------------------------------------------


def reason_codes() -> Column:
    """Codes whose condition holds, in rule order."""
    c = F.col
    dti, residual = c("dti_after_pct"), c("residual_income_per_cu")
    savings, tenure = c("savings_months_of_expenses"), c("months_in_job")
    tier = c("contract_stability")
    clean = ((c("rejected_debits_12m") == 0) & (c("days_overdrawn_12m") <= 5)
             & (c("ficp_flagged") == 0))
    # ---- fixed values: thresholds of the coded reasons --------------------------
    rules = [
        ("EXCESSIVE_DTI", dti > credit.DTI_CAP_PCT),
        ("COMFORTABLE_DTI", dti < 28),
        ("LOW_RESIDUAL_INCOME", residual < 700),
        ("AMPLE_RESIDUAL_INCOME", residual > 1300),
        ("HIGH_PAYMENT_SHOCK", c("payment_shock") > c("weighted_income") * 0.20),
        ("TOO_MUCH_VARIABLE_PAY", c("variable_income_share") > 0.30),
        ("INSUFFICIENT_INCOME", c("requested_amount") > c("weighted_income") * 12),
        ("PRECARIOUS_CONTRACT", tier == "precarious"),
        ("STABLE_EMPLOYMENT", (tier == "stable") & (tenure >= 24)),
        ("PROBATION_PERIOD", c("in_probation_period") == 1),
        ("SHORT_JOB_TENURE", (tenure < 12) & (c("contract_type") != "RETIRED")),
        ("RECENT_MOVE", c("months_at_address") < 6),
        ("FICP_FLAG", c("ficp_flagged") == 1),
        ("FCC_FLAG", c("fcc_flagged") == 1),
        ("PAYMENT_INCIDENTS", c("rejected_debits_12m") >= 2),
        ("HEAVY_OVERDRAFT_USE", c("days_overdrawn_12m") > 60),
        ("MULTIPLE_REVOLVING", c("revolving_loans") >= 2),
        ("LOAN_INCIDENTS", c("loan_incidents_12m") > 0),
        ("SOLID_SAVINGS", savings >= 3),
        ("CLEAN_HISTORY", clean),
        ("LONG_RELATIONSHIP", c("rule_relationship_months") >= 96),
        ("SALARY_DOMICILED", c("salary_domiciled") == 1),
        ("LOANS_REPAID_CLEAN", c("loans_repaid_clean") >= 2),
        ("SOLID_CO_BORROWER", c("has_co_borrower") == 1),
        ("MEANINGFUL_DOWN_PAYMENT", c("down_payment") > c("requested_amount") * 0.15),
        ("NO_SECURITY", (c("has_co_borrower") == 0) & (c("down_payment") == 0) & (savings < 1)),
        ("UNDOCUMENTED_INCOME", c("undocumented_income_lines") > 0),
    ]
    # -----------------------------------------------------------------------------
    return F.array_compact(F.array(*[F.when(cond, code) for code, cond in rules]))


def with_reasons(rows: DataFrame) -> DataFrame:
    return rows.withColumn("reason_codes", reason_codes())


def with_expert_risk(rows: DataFrame) -> DataFrame:
    """Adds the expert ``risk`` (PD) and the score derived from it."""
    scored = rows.withColumn("risk", credit.expert_pd())
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint((1 - F.col("risk")) * 100).cast("int")))
    return scored.withColumn("risk_score", score)


def hard_decline() -> Column:
    return ((F.col("ficp_flagged") == 1) | (F.col("dti_after_pct") > 48)
            | (F.col("residual_income_per_cu") < 420)
            | F.array_contains("reason_codes", "INSUFFICIENT_INCOME"))


def grey_zone() -> Column:
    dti, score = F.col("dti_after_pct"), F.col("risk_score")
    return ((dti > 33) & (dti <= 42)) | ((score >= 55) & (score < 68))


def override_class() -> Column:
    """Which kind of override would justify approving out of policy."""
    return (F.when(F.col("savings_months_of_expenses") >= 4, "OVERRIDE_WEALTH")
            .when(F.col("rule_relationship_months") >= 120, "OVERRIDE_RELATIONSHIP")
            .otherwise("OVERRIDE_COMMERCIAL"))


def _fires(chance: Chance | None, salt: int, probability: float) -> Column:
    if chance is None:
        return F.lit(probability > 0.5)
    return chance(salt) < probability


def _split_three(chance: Chance | None, salt: int, branches: list[tuple[str, float]]) -> Column:
    """First branch whose cumulative probability exceeds the draw."""
    if chance is None:
        return F.lit(max(branches, key=lambda b: b[1])[0])
    choice, reached = None, 0.0
    for name, share in branches[:-1]:
        reached = round(reached + share, 6)
        step = chance(salt) < reached
        choice = F.when(step, name) if choice is None else choice.when(step, name)
    return choice.otherwise(branches[-1][0])


def with_policy(rows: DataFrame, chance: Chance | None = None) -> DataFrame:
    """Adds hard_decline, grey_zone, override and decision_result.

    Needs reason_codes and risk_score on the rows.
    """
    hard = F.col("hard_decline")
    rows = rows.withColumns({
        "hard_decline": F.coalesce(hard_decline(), F.lit(False)),
        "grey_zone": F.coalesce(grey_zone(), F.lit(False))})
    rows = rows.withColumn("override", F.when(hard & _fires(chance, OVERRIDE, 0.07),
                                              override_class()))
    over_cap = F.col("dti_after_pct") > credit.DTI_CAP_PCT
    override = F.col("override").isNotNull()
    # ---- fixed values: branch probabilities of the policy ------------------------
    routed = (
        F.when(hard & ~override, "declined")
        .when((F.col("risk_score") < 45) & _fires(chance, LOW_SCORE, 0.82), "declined")
        .when(F.col("grey_zone") | override | over_cap, _split_three(chance, GREY_ZONE, [
            ("approved_with_conditions", 0.72), ("approved", 0.14), ("declined", 0.14)]))
        .when(F.col("risk_score") >= 68, _split_three(chance, REMAINDER, [
            ("approved", 0.88), ("approved_with_conditions", 0.12)]))
        .otherwise(_split_three(chance, REMAINDER, [
            ("approved", 0.45), ("approved_with_conditions", 0.40), ("declined", 0.15)])))
    deferred = ((F.array_contains("reason_codes", "UNDOCUMENTED_INCOME")
                 & _fires(chance, DEFERRAL, 0.45))
                | ((F.col("rule_relationship_months") < 6)
                   & _fires(chance, NEW_RELATIONSHIP, 0.20)))
    # -------------------------------------------------------------------------------
    candidate = (F.array_contains("reason_codes", "UNDOCUMENTED_INCOME")
                 | (F.col("rule_relationship_months") < 6))
    return rows.withColumns({
        "decision_result": F.when(deferred, "deferred").otherwise(routed),
        "deferral_candidate": candidate})


def with_final_reasons(rows: DataFrame) -> DataFrame:
    """Appends the override code, and a fallback so that no decline is unexplained."""
    codes = F.when(F.col("override").isNotNull(),
                   F.array_append("reason_codes", F.col("override"))).otherwise(
                       F.col("reason_codes"))
    rows = rows.withColumn("reason_codes", codes)
    adverse = F.array(*[F.lit(c) for c in refdata.ADVERSE_CODES])
    unexplained = ((F.col("decision_result") == "declined")
                   & ~F.arrays_overlap("reason_codes", adverse))
    return rows.withColumn("reason_codes", F.array_distinct(
        F.when(unexplained, F.array_append("reason_codes", F.lit("INSUFFICIENT_INCOME")))
        .otherwise(F.col("reason_codes"))))


def whole(value: Column) -> Column:
    """Amount without decimals, ties to even."""
    return F.call_function("format_number", value, F.lit("0"))


def one_decimal(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.0"))


def conditions_text(amount: Column, reduced: Column, term: Column, shortened: Column,
                    insurance_required: Column) -> Column:
    """Conditions of a counter-offer; one stock request when nothing else applies."""
    # ---- fixed values: wording ----------------------------------------------------
    pieces = F.concat_ws(
        " ; ",
        F.when(reduced, F.concat(F.lit("montant ramené à "), whole(amount), F.lit(" EUR"))),
        F.when(shortened, F.concat(F.lit("durée ramenée à "), term.cast("string"),
                                   F.lit(" mois"))),
        F.when(insurance_required, F.lit("souscription de l'assurance emprunteur exigée")))
    stock = "justificatifs de revenus complémentaires exigés avant déblocage"
    # -------------------------------------------------------------------------------
    return F.when(pieces == "", stock).otherwise(pieces)


def shorter_term(term: Column, chance: Chance) -> Column:
    """Three quarters of the term or more, by a draw, and six months at least."""
    return F.greatest(F.lit(6), F.floor(term * (F.lit(0.75) + F.lit(0.25) * chance(SHORTER_BY))).cast("int"))


def with_offer(rows: DataFrame, chance: Chance | None = None) -> DataFrame:
    """Adds approved amount, term, conditions and grade.

    A counter-offer above the debt cap is cut to 70 % of the amount; with chance about a
    third of the counter-offers also get a shorter term.
    """
    approved = F.col("decision_result").isin(*credit.APPROVALS)
    conditional = F.col("decision_result") == "approved_with_conditions"
    reduced = conditional & (F.col("dti_after_pct") > credit.DTI_CAP_PCT)
    requested = F.col("requested_amount")
    shortened = conditional & _fires(chance, SHORTER, 0.35)
    term = F.when(approved, F.col("term_months"))
    if chance is not None:
        term = F.when(shortened, shorter_term(F.col("term_months"), chance)).otherwise(term)
    rows = rows.withColumns({
        "approved_amount": F.when(reduced, F.floor(requested * F.lit(0.7)).cast("double"))
        .when(approved, requested),
        "approved_term_months": term,
        "risk_grade": credit.grade_from_score(F.col("risk_score"))})
    return rows.withColumn("conditions", F.when(conditional, conditions_text(
        F.col("approved_amount"), F.coalesce(reduced, F.lit(False)),
        F.col("approved_term_months"), F.coalesce(shortened, F.lit(False)),
        F.col("insurance_taken") == 0)))


def _pair(codes: str, key: Column) -> Column:
    """Up to two entries of an array, starting at a key-dependent place."""
    size = F.size(codes)
    start = F.when(size > 0, F.pmod(key, size)).otherwise(F.lit(0)).cast("int")
    turned = F.concat(F.slice(codes, start + 1, F.greatest(size, F.lit(1))),
                      F.slice(codes, 1, F.greatest(size, F.lit(1))))
    return F.slice(turned, 1, F.least(size, F.lit(2)))


def _choose(texts: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in texts]),
                        (F.pmod(key, F.lit(len(texts))) + 1).cast("int"))


def _clauses(codes: Column) -> Column:
    table = credit.literal_map(refdata.CLAUSES)
    return F.transform(codes, lambda code: F.try_element_at(table, code))


def _capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), text.substr(F.lit(2), F.length(text)))


def with_rationale(rows: DataFrame, key: str = "application_id") -> DataFrame:
    """Template decision text consistent with the coded reasons.

    The writer persona, the clauses taken and the linking phrases rotate with the
    key, so the text is reproducible.
    """
    k = F.col(key)
    negative = F.col("decision_result").isin("declined", "deferred")
    favourable = F.array(*[F.lit(c) for c in refdata.FAVOURABLE_CODES])
    rows = rows.withColumns({
        "_against": F.filter("reason_codes", lambda c: ~F.array_contains(favourable, c)),
        "_support": F.filter("reason_codes", lambda c: F.array_contains(favourable, c)),
        "_persona": _choose(refdata.PERSONAS, k)})
    rows = rows.withColumns({"_against": _pair("_against", k), "_support": _pair("_support", k)})
    rows = rows.withColumns({
        "_leading": F.when(negative, F.col("_against")).otherwise(F.col("_support")),
        "_trailing": F.when(negative, F.col("_support")).otherwise(F.col("_against"))})
    rows = rows.withColumns({
        "_body": F.array_join(_clauses(F.col("_leading")), " et "),
        "_tail": F.array_join(_clauses(F.col("_trailing")), " ; ")})

    opening = F.coalesce(*[
        F.when((F.col("_persona") == persona) & (F.col("decision_result") == result), text)
        for persona, texts in refdata.OPENINGS.items() for result, text in texts.items()])
    link = (F.when(negative, _choose(refdata.LINKS_NEGATIVE, k))
            .otherwise(_choose(refdata.LINKS_POSITIVE, k)))
    # ---- fixed values: wording ----------------------------------------------------
    lead_text = (F.when(F.col("_persona") == "adviser",
                        F.concat(F.lit("En effet, "), F.col("_body"), F.lit(".")))
                 .otherwise(F.concat(_capitalised(F.col("_body")), F.lit("."))))
    closing = (
        F.when((F.col("decision_result") == "approved_with_conditions")
               & (F.length("conditions") > 0),
               F.concat(F.lit("L'accord est conditionné : "), F.col("conditions"), F.lit(".")))
        .when(F.col("decision_result") == "approved",
              F.concat(F.lit("Le financement est accordé à hauteur de "),
                       whole(F.col("approved_amount")), F.lit(" EUR sur "),
                       F.col("approved_term_months").cast("string"), F.lit(" mois.")))
        .when(F.col("decision_result") == "declined",
              _choose(refdata.CLOSINGS_DECLINED, k)))
    # -------------------------------------------------------------------------------
    text = F.concat_ws(
        " ", opening, F.when(F.size("_leading") > 0, lead_text),
        F.when(F.size("_trailing") > 0,
               F.concat(link, F.lit(" : "), F.col("_tail"), F.lit("."))),
        closing)
    filled = text
    for name, value in {
        "dti": one_decimal(F.col("dti_after_pct")),
        "residual": whole(F.col("residual_income_per_cu")),
        "shock": whole(F.col("payment_shock")),
        "savings": one_decimal(F.col("savings_months_of_expenses")),
        "tenure": F.col("months_in_job").cast("string"),
        "contract": F.col("contract_type"),
        "years": F.floor(F.col("rule_relationship_months") / 12).cast("string"),
        "days": F.col("days_overdrawn_12m").cast("string"),
        "down": whole(F.col("down_payment")),
        "purpose": credit.lookup(refdata.PURPOSE_FR, F.col("loan_type")),
    }.items():
        filled = F.replace(filled, F.lit("{" + name + "}"), value)
    return rows.withColumn("rationale", filled).drop(
        "_against", "_support", "_persona", "_leading", "_trailing", "_body", "_tail")


def decide(rows: DataFrame, chance: Chance | None = None) -> DataFrame:
    """Situation rows to decided rows: reasons, risk, policy, offer and text."""
    decided = with_policy(with_expert_risk(with_reasons(rows)), chance)
    return with_rationale(with_offer(with_final_reasons(decided), chance))


def effective_risk(risk: Column, approved: Column, requested: Column) -> Column:
    """Risk after the offer: only the granted part of the request scales 45 % of it."""
    return risk * (F.lit(0.55) + F.lit(0.45) * (approved / requested))


def hindsight_months(as_of: Column, application_date: Column) -> Column:
    return F.floor(F.datediff(as_of, application_date) / F.lit(30)).cast("int")


def maturity(hindsight: Column, term: Column) -> tuple[Column, Column]:
    """(censored, observation horizon): only what still runs short of the window is censored."""
    censored = hindsight < F.least(term, F.lit(credit.OBSERVATION_MONTHS))
    horizon = F.least(hindsight, term, F.lit(credit.HORIZON_CAP_MONTHS))
    return censored, horizon


def outcomes(rows: DataFrame, as_of: str, chance: Column, *, key: str = "application_id",
             amount: str = "approved_amount", term: str = "approved_term_months") -> DataFrame:
    """What happened after disbursement, one row per input row.

    Needs risk, requested_amount, application_date and the given amount and term;
    ``chance`` decides between default, incidents and repayment.
    """
    k = F.col(key)
    hindsight = hindsight_months(F.lit(as_of).cast("date"), F.col("application_date"))
    rows = rows.withColumns({
        "_hindsight": hindsight, "_chance": chance,
        "_risk": effective_risk(F.col("risk"), F.col(amount), F.col("requested_amount"))})
    censored, horizon = maturity(F.col("_hindsight"), F.col(term))
    rows = rows.withColumns({"_censored": censored, "_horizon": horizon})
    status = (F.when(F.col("_censored"), "ongoing")
              .when(F.col("_chance") < F.col("_risk"), "default")
              .when(F.col("_chance") < F.col("_risk") + 0.13, "minor_incidents")
              .when(k % 10 == 0, "early_repayment").otherwise("repaid_clean"))
    rows = rows.withColumn("status", status)
    kind, horizon = F.col("status"), F.col("_horizon")
    month = (F.when(kind == "default",
                    3 + k % (F.greatest(F.lit(4), horizon) - 2))
             .when(kind == "minor_incidents",
                   2 + k % (F.greatest(F.lit(3), horizon) - 1))).cast("int")
    rows = rows.withColumn("_month", month)
    observed = F.greatest(F.lit(0), horizon)
    started = F.col("application_date")
    return rows.select(
        k.alias("application_id"), "status", observed.alias("observation_months"),
        F.when(kind == "default", F.col("_month") - 1).otherwise(observed)
        .alias("payments_made"),
        F.when(kind == "default", 3 + k % 7).when(kind == "minor_incidents", 1 + k % 2)
        .otherwise(0).cast("int").alias("missed_payments"),
        F.date_add(started, F.col("_month") * 30).alias("first_missed_payment_date"),
        F.when(kind == "default", round_to(F.col(amount) * F.lit(0.6), 2))
        .alias("balance_at_default"),
        F.when((kind == "default") & (k % 20 < 11), 1).otherwise(0)
        .alias("sent_to_collections"),
        F.when((kind == "early_repayment")
               | ((kind == "repaid_clean") & (horizon >= F.col(term))),
               F.date_add(started, horizon * 30)).alias("closed_date"))


def scoring_warnings(c=F.col) -> Column:
    """Messages attached to a scored file."""
    # ---- fixed values: wording ----------------------------------------------------
    return F.array_compact(F.array(
        F.when(c("dti_after_pct") > credit.DTI_CAP_PCT, F.concat(
            F.lit("debt-to-income after the loan is "), one_decimal(c("dti_after_pct")),
            F.lit("%, above the 35% HCSF threshold"))),
        F.when(c("ficp_flagged") == 1, F.lit("borrower registered on the FICP incident file")),
        F.when(c("residual_income_per_cu") < 700, F.concat(
            F.lit("residual income of "), whole(c("residual_income_per_cu")),
            F.lit(" EUR per consumption unit")))))
    # -------------------------------------------------------------------------------


def admission(rows: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: NULL for a file that may be submitted.

    Needs weighted_income, apr, requested_amount and both debt ratios.
    """
    dti_ok = (F.col("dti_before_pct").between(0, 190) & F.col("dti_after_pct").between(0, 190))
    return rows.withColumn("reject_reason", F.when(
        F.coalesce(F.col("weighted_income"), F.lit(0.0)) < 500, "weighted income below minimum")
        .when(F.col("apr") > credit.usury_cap(F.col("requested_amount")), "apr above usury cap")
        .when(~F.coalesce(dti_ok, F.lit(False)), "implausible debt-to-income"))
