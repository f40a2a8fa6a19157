"""The registered queries in SQL, for comparison by an independent engine."""

from __future__ import annotations

from riskframe.functions import credit
from riskframe.operators import bias, sampling
from riskframe.operators.dataset import COLUMNS
from riskframe.operators.indicators import INDICATORS
from riskframe.operators.quality import (WARN_FICP, WARN_OUTCOME, WARN_OVERRIDE, WARN_SHORT,
                                         WHITESPACE, table_rules)
from riskframe.plans import oracle_tables as o
from riskframe.plans.oracle_tables import compose, count_if, quoted, rnd
from riskframe.sources import refdata, schemas

ORACLES: dict[str, str] = {}

# Credit table name -> common table expression
CTE = {"customer": "cr_customer", "application": "app", "household": "hh", "employment": "emp",
       "income": "inc_line", "expense": "exp_line", "existing_loan": "loan",
       "account_behaviour": "beh", "indicators": "ind", "decision": "dec",
       "decision_reason": "dec_reason", "outcome": "outc", "counterfactual_outcome": "cfo"}
_DATES = {"application_date", "decision_date", "first_missed_payment_date", "closed_date"}
_OK = "decision_result IN ('approved', 'approved_with_conditions')"


def _column(name: str) -> str:
    return f"CAST({name} AS VARCHAR) AS {name}" if name in _DATES else name


def _add(name: str, select: str, *needs: str, extra: dict[str, str] | None = None) -> None:
    ORACLES[name] = compose(select, *needs, extra=extra)


def _role(role: str) -> str:
    columns = ["split", "application_reference"] + [
        c for c in COLUMNS if refdata.ROLE[c] == role]
    return f"SELECT {', '.join(columns)} FROM v_dataset"


# ---- tables and rollups -------------------------------------------------------------
_add("indicators", f"SELECT application_id, {', '.join(INDICATORS)}, indicator_error "
     "FROM ind_all", "ind_all")
_add("income_pivot", "SELECT * FROM inc", "inc")
_add("expense_pivot", "SELECT * FROM expn", "expn")
_add("loan_rollup", "SELECT * FROM loans", "loans")
_add("reason_rollup", "SELECT * FROM rsn", "rsn")
_add("consolidation", """
SELECT application_id, CAST(count(*) AS BIGINT) AS loans,
  CAST(sum(CASE WHEN loan_type_code = 'DEBT_CONSOLIDATION' AND loan_kind <> 'mortgage' THEN 1
                ELSE repaid_by_this_loan END) AS BIGINT) AS repaid
FROM loan JOIN app ON app.id = application_id GROUP BY application_id""", "loan", "app")
_add("v_dataset", f"SELECT {', '.join(_column(c) for c in COLUMNS)} FROM v_dataset", "v_dataset")
_add("class_balance", f"""
SELECT split, CAST(count(*) AS BIGINT) AS applications,
  {count_if("decision_result = 'approved'")} AS approved,
  {count_if("decision_result = 'approved_with_conditions'")} AS approved_with_conditions,
  {count_if("decision_result = 'declined'")} AS declined,
  {count_if('default_flag = 1')} AS defaults,
  {rnd("CAST(sum(CAST(round(dti_after_pct * 100) AS BIGINT)) AS DOUBLE) / 100.0::DOUBLE / count(dti_after_pct)", 2)}
    AS mean_dti_after,
  {count_if('above_hcsf_threshold = 1')} AS above_hcsf
FROM v_dataset GROUP BY split""", "v_dataset")

_TRIMMED = f"trim(coalesce(rationale, ''), {quoted(WHITESPACE)})"
_BATCH = """
SELECT CASE WHEN d IS NOT NULL THEN 'APP-' || year(d) || '-' || """ + o.pad6("k") + """
         ELSE 'APP-UNKNOWN-' || (doc_id * 20) END AS reference,
  text AS rationale, CAST(doc_id % 8 AS INTEGER) AS file_number, doc_id AS position
FROM documents LEFT JOIN ord ON k = doc_id * 20"""
_CONTRADICTS = " OR ".join(
    f"(result = {quoted(r)} AND contains(lower(substr(rationale, 1, 160)), {quoted(m)}))"
    for r, markers in refdata.CONTRADICTION_MARKERS.items() for m in markers)
_ROUTED = f"""
SELECT *, CASE WHEN application_id IS NULL THEN 'unknown' WHEN length(rationale) < 100 THEN 'short'
  WHEN {_CONTRADICTS} THEN 'contradictory' ELSE 'loaded' END AS route
FROM (SELECT b.reference, {_TRIMMED.replace('rationale', 'b.rationale')} AS rationale,
        file_number, position, dec.application_id, dec.result
      FROM batch b LEFT JOIN app ON app.reference = b.reference
      LEFT JOIN dec ON dec.application_id = app.id)"""
_ROUTES = {"batch": _BATCH, "routes": _ROUTED}
_MERGED = dict(_ROUTES, merged="""
SELECT dec.* EXCLUDE (rationale, decided_by), coalesce(t.rationale, dec.rationale) AS rationale,
  CASE WHEN t.rationale IS NOT NULL THEN 'llm' ELSE decided_by END AS decided_by
FROM dec LEFT JOIN (SELECT application_id, rationale FROM routes WHERE route = 'loaded'
  QUALIFY row_number() OVER (PARTITION BY application_id
                             ORDER BY file_number DESC, position DESC) = 1) t
  USING (application_id)""")
_add("authorship_stats", """
SELECT decided_by, CAST(count(*) AS BIGINT) AS n, round(avg(length(rationale))) AS mean_length
FROM merged GROUP BY decided_by""", "ord", "app", "dec", extra=_MERGED)

# ---- export -------------------------------------------------------------------------
_add("export_features", _role("feature"), "v_dataset")
_add("export_targets", _role("target"), "v_dataset")
_add("export_protected", _role("protected"), "v_dataset")
_add("export_summary", " UNION ALL ".join(
    f"SELECT '{prefix}_' || split || '.csv' AS file, CAST(count(*) AS BIGINT) AS rows, "
    f"{1 + sum(r == role for r in refdata.ROLE.values())} AS columns "
    "FROM v_dataset GROUP BY split"
    for role, prefix in (("feature", "X"), ("target", "y"), ("protected", "protected"))),
    "v_dataset")
_add("training_matrix", """
SELECT application_reference, department, requested_amount, dti_after_pct,
  co_borrower_contract, months_in_job, default_flag
FROM v_dataset WHERE split = 'train' AND default_flag IS NOT NULL""", "v_dataset")
_add("provenance", """
SELECT CAST(count(*) AS BIGINT) AS n_applications, 0 AS seed, 0.0::DOUBLE AS default_intensity,
  '2002-01-01' AS reference_date, (SELECT max(formula_version) FROM ind) AS formula_version,
  'realistic default rate' AS comment, CAST(min(application_date) AS VARCHAR) AS first_date,
  CAST(max(application_date) AS VARCHAR) AS last_date
FROM app""", "app", "ind")
_add("lookup", """
SELECT application_reference, loan_type, requested_amount, decision_result FROM v_dataset
WHERE application_reference IN (SELECT reference FROM batch)""", "ord", "v_dataset",
     extra={"batch": _BATCH})
_add("ordered_limit", "SELECT application_id, split, decision_result FROM v_dataset "
     "ORDER BY application_id LIMIT 1000", "v_dataset")

# ---- scalar formulas ----------------------------------------------------------------
_SHIFTED = o.instalment("requested_amount", "nominal_rate", "(term_months - 60)")
_add("instalment", f"""
SELECT reference, payment_excl_insurance AS payment,
  {o.instalment('requested_amount', '0.0::DOUBLE', 'term_months')} AS zero_rate_payment,
  monthly_payment AS total_payment, {_SHIFTED} AS shifted_payment,
  CASE WHEN term_months - 60 <= 0 THEN 'term_months must be strictly positive' END AS error
FROM app""", "app")
_R = "(nominal_rate / 100.0::DOUBLE / 12.0::DOUBLE)"
_PRINCIPAL = (f"least(highest, greatest(lowest, weighted_income * 0.105::DOUBLE "
              f"* (1.0::DOUBLE - pow(1.0::DOUBLE + {_R}, -term_months)) / {_R}))")
_add("affordable_principal", """
SELECT application_reference, principal, CASE WHEN principal < 3000 THEN 21.0::DOUBLE
  WHEN principal < 6000 THEN 9.5::DOUBLE ELSE 8.2::DOUBLE END AS usury_cap
FROM p""", "situation",
     extra={"bounds(loan_type, lowest, highest)": "VALUES " + ", ".join(
                f"('{k}', {low}.0::DOUBLE, {high}.0::DOUBLE)" for k, (low, high) in refdata.AMOUNT_BOUNDS.items()),
            "p": f"SELECT application_reference, {rnd(_PRINCIPAL, 2)} AS principal "
                 "FROM situation JOIN bounds USING (loan_type)"})
_add("grades", """
SELECT application_reference, pd, CASE WHEN pd < 0.02 THEN 'A' WHEN pd < 0.05 THEN 'B'
    WHEN pd < 0.10 THEN 'C' WHEN pd < 0.20 THEN 'D' ELSE 'E' END AS pd_grade,
  risk_grade AS score_grade FROM population""", "population")
_add("split_assignment", "SELECT split, CAST(count(*) AS BIGINT) AS applications FROM app0 "
     "GROUP BY split", "app0")
_add("contract_wording", f"""
SELECT {o.choose(refdata.CONTRACT_FR, 'contract_code')} AS contract_fr,
  {o.choose(o._TIERS, 'contract_code')} AS stability, CAST(count(*) AS BIGINT) AS n
FROM emp GROUP BY 1, 2""", "emp")

# ---- rules --------------------------------------------------------------------------
_add("coded_reasons", "SELECT application_reference, array_to_string(codes, '|') AS reason_codes "
     "FROM coded", "coded")
_add("expert_pd", "SELECT application_reference, pd FROM population", "population")
_add("policy_route", """
SELECT application_reference, risk_score, CAST(hard AS INTEGER) AS hard_decline,
  CAST(grey AS INTEGER) AS grey_zone, decision_result,
  CAST(list_contains(codes, 'UNDOCUMENTED_INCOME') OR rule_relationship_months < 6 AS INTEGER)
    AS deferral_candidate,
  CASE WHEN savings_months_of_expenses >= 4 THEN 'OVERRIDE_WEALTH'
       WHEN rule_relationship_months >= 120 THEN 'OVERRIDE_RELATIONSHIP'
       ELSE 'OVERRIDE_COMMERCIAL' END AS override_class,
  array_to_string(list_filter(final_codes, lambda x: true), '|') AS final_reasons
FROM reasoned_majority""", "reasoned_majority")
_add("decisions", f"SELECT {', '.join(_column(c) for c in schemas.column_names('decision'))} "
     "FROM dec", "dec")
_add("rationale_template", "SELECT application_id, conditions, rationale FROM dec", "dec")
_OUTCOME = schemas.column_names("outcome")
_HALF = {"application_id", "status", "observation_months", "missed_payments"}
_NULL = {c: "NULL" for c in _OUTCOME}
_add("outcome_maturity", f"""
SELECT {', '.join(_column(c) for c in _OUTCOME)}, 'observed' AS kind FROM outc
UNION ALL
SELECT {', '.join(c if c in _HALF else 'NULL AS ' + c for c in _OUTCOME)}, 'counterfactual'
FROM cfo""", "outc", "cfo")
_add("admission", """
SELECT reference, CASE WHEN coalesce(weighted_income, 0) < 500 THEN 'weighted income below minimum'
  WHEN apr > CASE WHEN requested_amount < 3000 THEN 21.0::DOUBLE WHEN requested_amount < 6000
                  THEN 9.5::DOUBLE ELSE 8.2::DOUBLE END THEN 'apr above usury cap'
  WHEN NOT coalesce(dti_before_pct BETWEEN 0 AND 190 AND dti_after_pct BETWEEN 0 AND 190, false)
    THEN 'implausible debt-to-income' END AS reject_reason
FROM app JOIN ind_all ON application_id = id""", "app", "ind_all")
_add("scoring_warnings", """
SELECT application_reference, concat_ws(' / ',
  CASE WHEN dti_after_pct > 35 THEN 'debt-to-income after the loan is '
    || printf('%.1f', dti_after_pct) || '%, above the 35% HCSF threshold' END,
  CASE WHEN ficp_flagged = 1 THEN 'borrower registered on the FICP incident file' END,
  CASE WHEN residual_income_per_cu < 700 THEN 'residual income of '
    || printf('%.0f', residual_income_per_cu) || ' EUR per consumption unit' END) AS warnings
FROM situation""", "situation")

# ---- checks -------------------------------------------------------------------------
# Each block is a set of applications; what a set difference leaves lacks the block.
_BLOCKS = {"household": "SELECT application_id FROM hh",
           "employment(primary)": "SELECT application_id FROM emp WHERE role = 'primary'",
           "account_behaviour": "SELECT application_id FROM beh",
           "indicators": "SELECT application_id FROM ind",
           "income": "SELECT application_id FROM inc_line"}
_add("check_incomplete", "SELECT reference, string_agg(block, '' ORDER BY place) AS missing_blocks FROM ("
     + " UNION ALL ".join(f"SELECT id, {i} AS place, '{name} ' AS block FROM (SELECT id FROM app EXCEPT {have})"
                          for i, (name, have) in enumerate(_BLOCKS.items()))
     + ") JOIN app USING (id) GROUP BY id, reference", "app", "hh", "emp", "beh", "ind", "inc_line")
_add("check_co_borrower", """
SELECT reference, 'co-borrower without employment record' AS problem
FROM app SEMI JOIN (SELECT id FROM told EXCEPT SELECT id FROM held) USING (id)
UNION ALL SELECT reference, 'co-borrower employment record without co-borrower'
FROM app SEMI JOIN (SELECT id FROM held EXCEPT SELECT id FROM told) USING (id)""", "app", "emp", extra={
    "told": "SELECT id FROM app WHERE co_borrower_id IS NOT NULL",
    "held": "SELECT application_id AS id FROM emp WHERE role = 'co_borrower'"})
_add("check_decline_reason", """
SELECT reference FROM app SEMI JOIN (
  SELECT application_id AS id FROM dec WHERE result = 'declined'
  EXCEPT SELECT application_id FROM dec_reason) USING (id)""", "dec", "app", "dec_reason")
_add("check_warnings", "SELECT reference, unnest(warnings) AS warning FROM told",
     "v_dataset", "dec_reason", "reason", extra={
         "excused": "SELECT DISTINCT application_id FROM dec_reason JOIN reason ON code = reason_code "
                    "WHERE category = 'override'",
         "told": f"""
SELECT application_reference AS reference, list_filter([
    CASE WHEN above_hcsf_threshold = 1 AND {_OK} AND e.application_id IS NULL THEN {quoted(WARN_OVERRIDE)} END,
    CASE WHEN ficp_flagged = 1 AND {_OK} THEN {quoted(WARN_FICP)} END,
    CASE WHEN length(rationale) < 100 THEN {quoted(WARN_SHORT)} END,
    CASE WHEN {_OK} AND outcome_status IS NULL THEN {quoted(WARN_OUTCOME)} END],
    lambda x: x IS NOT NULL) AS warnings
FROM v_dataset LEFT JOIN excused e USING (application_id)"""})


def _summary(source: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"SELECT {quoted(name)} AS rule, CAST(count(*) AS BIGINT) AS checked, "
        f"{count_if(f'NOT coalesce({p}, true)')} AS violations FROM {source}"
        for name, p in rules)


_APPROVED = "result IN ('approved', 'approved_with_conditions')"
_add("check_outcomes",
     _summary("(SELECT * FROM outc LEFT JOIN dec USING (application_id))",
              [("outcome on an approved application", _APPROVED)] + schemas.OUTCOME_RULES)
     + " UNION ALL " + _summary(
         "(SELECT * FROM cfo LEFT JOIN dec USING (application_id))",
         [("counterfactual on a non-approved application", f"NOT ({_APPROVED})")]),
     "outc", "cfo", "dec")
_add("check_decisions", _summary("dec", schemas.DECISION_RULES), "dec")
_add("check_domains", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, {quoted(name)} AS rule, "
    f"CAST({schemas.ROW_KEY[table]} AS VARCHAR) AS key FROM {CTE[table]} "
    f"WHERE NOT coalesce({p}, true)"
    for table in schemas.TABLES for name, p in table_rules(table)), *CTE.values())
_add("check_unique", " UNION ALL ".join(
    f"SELECT '{t}({', '.join(cols)})' AS rule, CAST(count(*) AS BIGINT) AS distinct_keys, "
    f"{count_if('n > 1')} AS repeated_keys "
    f"FROM (SELECT count(*) AS n FROM {CTE[t]} GROUP BY {', '.join(cols)})"
    for t, cols in schemas.UNIQUE_KEYS), *CTE.values())
_CODES = {"loan_type": refdata.LOAN_TYPES, "housing_status": refdata.HOUSING_STATUSES,
          "occupation": refdata.OCCUPATIONS, "employment_contract": refdata.EMPLOYMENT_CONTRACTS,
          "income_type": refdata.INCOME_TYPES, "expense_type": refdata.EXPENSE_TYPES,
          "reason": refdata.REASONS}


def _reference(child: str, column: str, parent: str, key: str) -> str:
    if parent in _CODES:
        known = "(" + ", ".join(quoted(r[0]) for r in _CODES[parent]) + ")"
    else:
        known = f"(SELECT {key} FROM {CTE[parent]})"
    return (f"SELECT '{child}.{column} -> {parent}' AS rule, CAST(count({column}) AS BIGINT) "
            f"AS checked, {count_if(f'{column} NOT IN {known}')} AS violations "
            f"FROM {CTE[child]}")


_add("check_references", " UNION ALL ".join(_reference(*fk) for fk in schemas.FOREIGN_KEYS),
     *CTE.values())
_add("role_census", " UNION ALL ".join(
    f"SELECT '{role}' AS role, {len(cols)} AS columns, "
    f"CAST({' + '.join(f'count({c})' for c in cols)} AS BIGINT) AS filled_cells FROM v_dataset"
    for role in ("feature", "meta", "protected", "target")
    for cols in [[c for c in COLUMNS if refdata.ROLE[c] == role]]), "v_dataset")

# ---- documents ----------------------------------------------------------------------
_DOCS = {"docs": """
SELECT a.*, EXISTS (SELECT 1 FROM inc_line x WHERE x.application_id = a.id) AS has_income
FROM app a JOIN hh ON hh.application_id = a.id JOIN beh ON beh.application_id = a.id
JOIN emp ON emp.application_id = a.id AND emp.role = 'primary'
JOIN cr_customer c ON c.id = a.customer_id"""}
_DOC_NEEDS = ("app", "hh", "beh", "emp", "cr_customer", "inc_line")
_add("document_validation", """
SELECT reference, concat_ws(' / ',
  CASE WHEN NOT has_income THEN 'incomes must not be empty' END,
  CASE WHEN apr > usury_rate_cap THEN 'APR ' || CAST(apr AS VARCHAR)
    || ' above the usury ceiling ' || CAST(usury_rate_cap AS VARCHAR)
    || ': the operation is unlawful and must not be scored' END) AS errors
FROM docs""", *_DOC_NEEDS, extra=_DOCS)
_add("indicators_from_documents", f"""
SELECT reference, {', '.join(INDICATORS)}, indicator_error
FROM docs JOIN ind_all ON application_id = id WHERE has_income AND apr <= usury_rate_cap""",
     *_DOC_NEEDS, "ind_all", extra=_DOCS)

# ---- measures on the expert card ----------------------------------------------------
_LABELLED = {"s": "SELECT *, default_flag AS y FROM population WHERE default_flag IS NOT NULL"}


def measure_ctes(by: str) -> dict[str, str]:
    """Cumulative counts per score inside ``by``, from a relation s(by, pd, y)."""
    part = f"PARTITION BY {by}"
    return {
        "g": f"SELECT {by}, pd, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg "
             f"FROM s GROUP BY {by}, pd",
        "c": f"SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, "
             f"sum(pos) OVER ({part}) AS n_pos, sum(neg) OVER ({part}) AS n_neg FROM g "
             f"WINDOW w AS ({part} ORDER BY pd DESC)",
        "m": f"SELECT {by}, sum(pos * ((n_neg - fp) + neg / 2) / (n_pos * n_neg)) AS auc, "
             "greatest(0, max(tp / n_pos - fp / n_neg)) AS ks, "
             "sum(pos / n_pos * tp / (tp + fp)) AS ap, "
             "sum(pos * (1 - pd) * (1 - pd) + neg * pd * pd) / sum(pos + neg) AS brier, "
             f"sum(pos) / sum(pos + neg) AS base_rate FROM c GROUP BY {by}"}


_add("scorecard_metrics", f"""
SELECT split, {rnd('auc', 4)} AS auc, {rnd('2 * auc - 1', 4)} AS gini, {rnd('ks', 4)} AS ks,
  {rnd('ap', 4)} AS average_precision, {rnd('brier', 5)} AS brier,
  {rnd('base_rate', 4)} AS base_rate FROM m""", "population",
     extra={**_LABELLED, **measure_ctes("split")})


def _permuted(repeats: int) -> dict[str, str]:
    """numbered, walk(repeat, number, step, x) and donors of s, by the keyed bijection."""
    def turn(body: str, at: int) -> str:
        moved, other, size = ("l", "r", "a") if at % 2 == 0 else ("r", "l", "b")
        mixed = f"('0x' || substr(md5(repeat || '-{at}-' || {other}), 1, 15))::BIGINT"
        return f"SELECT repeat, number, step, n, a, b, ({moved} + {mixed}) % {size} AS {moved}, {other} FROM ({body})"

    body = "SELECT repeat, number, step, n, a, b, x // b AS l, x % b AS r FROM walk WHERE step = 0 OR x >= n"
    for at in range(4):
        body = turn(body, at)
    return {
        "numbered": "SELECT *, row_number() OVER (ORDER BY ('0x' || substr(md5(CAST(application_id AS VARCHAR)), 1, 15))::BIGINT, "
                    "application_id) - 1 AS number FROM s",
        "size": "SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a "
                "FROM (SELECT count(*) AS n FROM s))",
        "walk(repeat, number, step, n, a, b, x)": f"""
SELECT repeat, number, 0, n, a, b, number FROM numbered, size, range({repeats}) k(repeat)
UNION ALL SELECT repeat, number, step + 1, n, a, b, l * b + r FROM ({body})""",
        "donors": "SELECT repeat, number, x AS donor FROM walk WHERE step > 0 AND x < n"}


_IMPORTANCE = {
    "s": "SELECT *, default_flag AS y FROM population WHERE default_flag IS NOT NULL AND split = 'test'",
    **_permuted(5)}
_SWAPPED = " UNION ALL ".join(
    f"SELECT '{v}' AS variable, repeat, y, {o.expert_pd()} AS pd FROM (SELECT s.* EXCLUDE (pd) REPLACE (other.{v} AS {v}), "
    "repeat FROM donors JOIN numbered s USING (number) JOIN numbered other ON other.number = donor)"
    for v in credit.EXPERT_INPUTS)
_add("importance_expert", f"""
SELECT variable, {rnd('avg(base - auc)', 6)} AS importance
FROM (SELECT variable, {rnd('auc', 4)} AS auc FROM m), (SELECT {rnd('auc', 4)} AS base FROM whole_m) GROUP BY variable""",
     "population", extra={
         **_IMPORTANCE,
         **{f"whole_{k}": v.replace("FROM s ", "FROM (SELECT *, 0 AS one FROM s) ")
            .replace("FROM g ", "FROM whole_g ").replace("FROM c ", "FROM whole_c ")
            for k, v in measure_ctes("one").items()},
         "swapped": _SWAPPED,
         **{k: v.replace("FROM s ", "FROM swapped ") for k, v in measure_ctes("variable, repeat").items()}})
ORACLES["importance_expert"] = ORACLES["importance_expert"].replace("WITH ", "WITH RECURSIVE ", 1)
ORACLES["top_drivers_expert"] = (
    f"SELECT variable, importance FROM ({ORACLES['importance_expert']}) WHERE importance > 0.0002 "
    "ORDER BY importance DESC, variable LIMIT 15")
# the isotonic fit of a point: largest over all starts up to it of the least mean to any end from it on
_add("isotonic_expert", f"""
SELECT application_id, pd AS raw_pd, {rnd('fitted', 6)} AS pd
FROM s JOIN q USING (pd) JOIN (SELECT k, max(m) AS fitted FROM low GROUP BY k) USING (k)""", "population", extra={
    "s": "SELECT *, default_flag AS y FROM population WHERE default_flag IS NOT NULL AND split = 'train'",
    "p": "SELECT pd, sum(y) AS hits, count(*) AS n, row_number() OVER (ORDER BY pd) AS k FROM s GROUP BY pd",
    "q": "SELECT *, sum(hits) OVER w AS all_hits, sum(n) OVER w AS all_n FROM p WINDOW w AS (ORDER BY k)",
    "low": """
SELECT k, min(mean) OVER (PARTITION BY start ORDER BY k DESC) AS m
FROM (SELECT i.k AS start, j.k, (j.all_hits - i.all_hits + i.hits)::DOUBLE / (j.all_n - i.all_n + i.n)::DOUBLE AS mean
      FROM q i JOIN q j ON j.k >= i.k)"""})
_EXPERT_CLASSES = ["approved", "approved_with_conditions", "declined"]
_EXPERT_DECISIONS = {"dp": """
SELECT decision_result AS actual, CASE WHEN pd <= 0.05 THEN 'approved' WHEN pd <= 0.12 THEN 'approved_with_conditions'
  ELSE 'declined' END AS predicted FROM population WHERE decision_result IS NOT NULL"""}
_add("confusion_expert", "SELECT actual, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE predicted = '{c}') AS BIGINT) AS {c}" for c in _EXPERT_CLASSES)
    + " FROM dp GROUP BY actual", "population", extra=_EXPERT_DECISIONS)
_add("class_report_expert", f"""
SELECT label, {rnd('prec', 4)} AS precision, {rnd('rec', 4)} AS recall,
  {rnd('CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0::DOUBLE END', 4)} AS f1, CAST(support AS BIGINT) AS support
FROM (SELECT label, support, CASE WHEN called > 0 THEN hit::DOUBLE / called ELSE 0.0::DOUBLE END AS prec,
        CASE WHEN support > 0 THEN hit::DOUBLE / support ELSE 0.0::DOUBLE END AS rec
      FROM (SELECT label, (SELECT count(*) FROM dp WHERE actual = label) AS support,
              (SELECT count(*) FROM dp WHERE predicted = label) AS called,
              (SELECT count(*) FROM dp WHERE actual = label AND predicted = label) AS hit
            FROM (SELECT actual AS label FROM dp UNION SELECT predicted FROM dp)))""", "population", extra=_EXPERT_DECISIONS)


def _labelled_term(name: str) -> str:
    if name not in refdata.LABEL:
        return f"SELECT application_reference, '{name}' AS variable, '{name}' AS label FROM v_dataset"
    shown = f"regexp_replace(replace(format('{{:,.2f}}', CAST({name} AS DOUBLE)), ',', ' '), '\\.?0+$', '')"
    return (f"SELECT application_reference, '{name}' AS variable, {quoted(refdata.LABEL[name])} || ' (' || "
            f"coalesce({shown}, 'None') || ')' AS label FROM v_dataset")


_add("factor_labels_expert", " UNION ALL ".join(_labelled_term(n) for n, _ in o.expert_terms()), "v_dataset")
_add("score_bands", f"""
SELECT 'D' || band AS band, n, defaults, {rnd('mean_pd', 4)} AS mean_pd,
  {rnd('rate', 4)} AS observed_rate, {rnd('abs(mean_pd - rate)', 4)} AS gap
FROM (SELECT band, CAST(count(*) AS BIGINT) AS n, CAST(sum(y) AS BIGINT) AS defaults,
        CAST(sum(CAST(round(pd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 / count(*) AS mean_pd,
        CAST(sum(y) AS DOUBLE) / count(*) AS rate
      FROM (SELECT *, greatest(1, ((rn - 1) * 10 + n - 2) // (n - 1)) AS band
            FROM (SELECT pd, y, row_number() OVER (ORDER BY pd, application_id) AS rn,
                    count(*) OVER () AS n FROM s)) GROUP BY band)""", "population",
     extra=_LABELLED)
_GRID = ("CASE WHEN i = 199 THEN 0.5::DOUBLE ELSE 0.01::DOUBLE + i * "
         "((0.5::DOUBLE - 0.01::DOUBLE) / 199.0::DOUBLE) END")
_add("cutoffs", f"""
SELECT cost, {rnd('s', 6)} AS cutoff, CAST(avoided + lost AS BIGINT) AS declined,
  CAST(avoided AS BIGINT) AS defaults_avoided, CAST(lost AS BIGINT) AS good_lost
FROM (SELECT cost, i, grid.s, count(CASE WHEN pd >= grid.s AND y = 1 THEN 1 END) AS avoided,
        count(CASE WHEN pd >= grid.s AND y = 0 THEN 1 END) AS lost,
        cost * count(CASE WHEN pd < grid.s AND y = 1 THEN 1 END)
          + count(CASE WHEN pd >= grid.s AND y = 0 THEN 1 END) AS loss
      FROM s, grid, (VALUES (5), (10), (20)) AS k(cost) GROUP BY cost, i, grid.s)
QUALIFY row_number() OVER (PARTITION BY cost ORDER BY loss, i) = 1""", "population",
     extra={**_LABELLED, "grid": f"SELECT i, {_GRID} AS s FROM range(200) r(i)"})
_add("domain_bounds", f"SELECT {rnd('max(pd)', 4)} AS max_observed_pd, "
     f"{rnd('quantile_cont(pd, 0.999)', 4)} AS pd_q999 FROM s", "population", extra=_LABELLED)
_add("out_of_domain", """
SELECT application_reference, pd, CASE WHEN pd > lim THEN 1 ELSE 0 END AS out_of_domain
FROM population, l""", "population", extra={**_LABELLED, "l": f"""
SELECT {rnd('quantile_cont(pd, 0.999)', 4)} AS lim FROM s WHERE split = 'train'"""})
_AGE = "CAST({0} AS VARCHAR)"
_add("bias_audit", f"""
SELECT attribute, grp AS "group", CAST(count(*) AS BIGINT) AS n,
  {rnd('CAST(sum(CAST(round(pd * 1e6) AS BIGINT)) AS DOUBLE) / 1e6 / count(*)', 3)} AS mean_score,
  {rnd('CAST(sum(y) AS DOUBLE) / count(*)', 3)} AS observed
FROM long GROUP BY attribute, grp HAVING count(*) >= {bias.MINIMUM_GROUP}""", "population",
     extra={**_LABELLED, "e": """
SELECT list_sort(list_distinct([quantile_cont(age::DOUBLE, q) FOR q IN [0.0, 0.25, 0.5, 0.75, 1.0]])) AS edges
FROM s""".replace("[quantile_cont(age::DOUBLE, q) FOR q IN [0.0, 0.25, 0.5, 0.75, 1.0]]",
                  "quantile_cont(age::DOUBLE, [0.0, 0.25, 0.5, 0.75, 1.0])"),
            "long": f"""
SELECT 'age' AS attribute, '(' || CAST({rnd('CASE WHEN p = 1 THEN edges[p] - 0.001::DOUBLE ELSE edges[p] END', 3)} AS VARCHAR)
  || ', ' || CAST({rnd('edges[p + 1]', 3)} AS VARCHAR) || ']' AS grp, pd, y
FROM (SELECT pd, y, edges, greatest(1, len(list_filter(edges, lambda v: v < age))) AS p FROM s, e)
""" + "".join(f"UNION ALL SELECT '{c}', {c}, pd, y FROM s "
              for c in bias.CATEGORICAL_PROTECTED)})
_NUMERIC = [c for c in COLUMNS if refdata.ROLE[c] == "feature"
            and refdata.DATA_TYPE[c] in ("numeric", "integer", "boolean")]
_LEVELS = [c for c in COLUMNS if refdata.ROLE[c] == "feature" and c not in _NUMERIC]
_add("imputation_values", " UNION ALL ".join(
    [f"SELECT '{c}' AS variable, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS median, "
     f"NULL AS level FROM tr" for c in _NUMERIC]
    + [f"(SELECT '{c}', NULL, {c} FROM tr WHERE {c} IS NOT NULL GROUP BY {c} "
       f"ORDER BY count(*) DESC, {c} LIMIT 1)" for c in _LEVELS]), "v_dataset",
     extra={"tr": "SELECT * FROM v_dataset WHERE split = 'train'"})
_add("stratified_folds", """
SELECT application_id, CAST(default_flag AS INTEGER) AS label,
  CAST((row_number() OVER (PARTITION BY default_flag
    ORDER BY ('0x' || substr(md5(CAST(application_id AS VARCHAR)), 1, 15))::BIGINT, application_id) - 1) % 5 AS INTEGER) AS fold
FROM tr WHERE default_flag IS NOT NULL""", "v_dataset", extra={"tr": "SELECT * FROM v_dataset WHERE split = 'train'"})
_add("population_target", f"""
SELECT split, CAST(approved AS INTEGER) AS approved, CAST(count(*) AS BIGINT) AS n,
  {rnd('CAST(sum(target) AS DOUBLE) / count(*)', 4)} AS default_rate
FROM population WHERE target IS NOT NULL GROUP BY split, approved""", "population")
_add("fuzzy_rows", """
SELECT application_reference, target AS label, 1.0::DOUBLE AS weight FROM t WHERE approved
UNION ALL SELECT application_reference, 1, pd FROM t WHERE NOT approved
UNION ALL SELECT application_reference, 0, 1 - pd FROM t WHERE NOT approved""", "population",
     extra={"t": "SELECT * FROM population WHERE target IS NOT NULL AND split = 'train'"})

# ---- curation -----------------------------------------------------------------------
_add("stratum_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS stratum, CAST(count(*) AS BIGINT) AS applications FROM v_dataset "
    f"WHERE {p}" for name, p in sampling.STRATA.items()), "v_dataset")


def _sample_ctes(batches: int, per_batch: int) -> dict[str, str]:
    quota = sampling.quota_for(batches, per_batch)
    steps: dict[str, str] = {}
    previous: list[str] = []
    for i, (name, predicate) in enumerate(sampling.STRATA.items()):
        seen = "".join(f" AND application_id NOT IN (SELECT application_id FROM {p})"
                       for p in previous)
        steps[f"st{i}"] = f"""
SELECT application_id, '{name}' AS stratum FROM (
  SELECT application_id FROM v_dataset WHERE {predicate}
  ORDER BY application_id LIMIT {quota * 3}) WHERE true{seen}
ORDER BY application_id LIMIT {quota}"""
        previous.append(f"st{i}")
    steps["sample"] = " UNION ALL ".join(f"SELECT * FROM {p}" for p in previous)
    return steps


_SAMPLE = _sample_ctes(sampling.BATCHES, sampling.PER_BATCH)
_add("stratified_sample", "SELECT * FROM sample", "v_dataset", extra=_SAMPLE)
_SHUFFLE = o.keyed_draw("application_id", sampling.SHUFFLE_SEED)
_add("rationale_batches", f"""
SELECT batch, application_reference AS reference,
  {o.choose(refdata.CONTRACT_FR, 'contract_type')} AS contract_fr,
  requested_amount AS requested_amount_eur, decision_result AS result,
  coalesce(v.reasons, '') AS reasons, stratum AS _stratum
FROM (SELECT *, CAST((row_number() OVER (ORDER BY {_SHUFFLE}, application_id) - 1)
        // {sampling.PER_BATCH} + 1 AS INTEGER) AS batch FROM sample)
JOIN v_dataset v USING (application_id) WHERE batch <= {sampling.BATCHES}""", "v_dataset",
     extra=_SAMPLE)
_add("batches_written", f"""
SELECT batch, application_reference AS reference,
  {o.choose(refdata.CONTRACT_FR, 'contract_type')} AS contract_fr,
  requested_amount AS requested_amount_eur, dti_after_pct, decision_result AS result,
  coalesce(v.reasons, '') AS reasons, stratum AS _stratum
FROM (SELECT *, CAST((row_number() OVER (ORDER BY {_SHUFFLE}, application_id) - 1)
        // {sampling.PER_BATCH} + 1 AS INTEGER) AS batch FROM sample)
JOIN v_dataset v USING (application_id)""", "v_dataset", extra=_SAMPLE)
_add("rationale_load", "SELECT route, CAST(count(*) AS BIGINT) AS rationales FROM routes "
     "GROUP BY route", "ord", "app", "dec", extra=_ROUTES)
_add("rationale_routes", "SELECT reference, file_number, position, route, "
     "length(rationale) AS characters FROM routes", "ord", "app", "dec", extra=_ROUTES)
_add("rationale_merge", "SELECT application_id, decided_by, rationale FROM merged",
     "ord", "app", "dec", extra=_MERGED)

# ---- explanation and sizing on the expert card ----------------------------------------
_add("contributions_expert", f"""
SELECT application_reference, direction, CAST(place AS INTEGER) AS place, variable,
  {rnd('contribution', 4)} AS contribution
FROM (SELECT *, row_number() OVER (PARTITION BY application_reference, direction
        ORDER BY abs(contribution) DESC, variable) AS place
      FROM (SELECT *, CASE WHEN contribution > 0.01 THEN 'adverse'
                           WHEN contribution < -0.01 THEN 'favourable' END AS direction FROM f)
      WHERE direction IS NOT NULL) WHERE place <= 5""", "situation", extra={
    "f": " UNION ALL ".join(f"SELECT application_reference, '{n}' AS variable, "
                            f"CAST({t} AS DOUBLE) AS contribution FROM situation"
                            for n, t in o.expert_terms())})

_DOC_ROWS = """
SELECT a.id AS application_id, a.reference, a.requested_amount, a.term_months, a.nominal_rate,
  a.insurance_taken, s.payment, s.liquid, s.cu, s.gross, s.weighted, s.variable, s.counted,
  s.existing, s.refinanced, i.dti_after_pct, i.residual_income_per_cu,
  i.savings_months_of_expenses, b.ficp_flagged, b.rejected_debits_12m, b.days_overdrawn_12m,
  b.loans_repaid_clean, e.months_in_job,
  CASE WHEN a.co_borrower_id IS NOT NULL THEN 1 ELSE 0 END AS has_co_borrower,
  """ + o.choose(o._TIERS, "e.contract_code") + """ AS contract_stability,
  (SELECT count(*) FROM loan x
   WHERE x.application_id = a.id AND loan_kind = 'revolving') AS revolving_loans
FROM app a JOIN ind_sum s ON s.application_id = a.id JOIN ind_all i ON i.application_id = a.id
JOIN beh b ON b.application_id = a.id
JOIN emp e ON e.application_id = a.id AND e.role = 'primary'
JOIN cr_customer c ON c.id = a.customer_id
WHERE i.indicator_error IS NULL AND a.apr <= a.usury_rate_cap
  AND EXISTS (SELECT 1 FROM inc_line x WHERE x.application_id = a.id)"""


def _trial(amount: str, source: str, carry: str) -> str:
    """Rows of ``source`` with ``trial_pd`` for an amount expression."""
    cover = f"CASE WHEN insurance_taken = 1 THEN {rnd(amount + ' * 0.00035::DOUBLE', 2)} ELSE 0.0::DOUBLE END"
    paid = f"SELECT *, {amount} AS amount FROM {source}"
    excl = (f"SELECT *, {o.instalment('amount', 'nominal_rate', 'term_months')} AS excl, "
            f"{cover.replace(amount, 'amount')} AS cover FROM ({paid})")
    pay = f"SELECT *, {rnd('excl + cover', 2)} AS pay FROM ({excl})"
    after = "(counted + (existing - refinanced) + pay)"
    ind = f"""SELECT * EXCLUDE (dti_after_pct, residual_income_per_cu, savings_months_of_expenses),
  {rnd('((existing - refinanced) + pay + counted) / weighted * 100.0::DOUBLE', 2)} AS dti_after_pct,
  {rnd('(weighted - counted - (existing - refinanced) - pay) / cu', 2)} AS residual_income_per_cu,
  CASE WHEN {after} > 0 THEN {rnd('liquid / ' + after, 2)} ELSE 0.0::DOUBLE END
    AS savings_months_of_expenses FROM ({pay})"""
    return f"SELECT {carry}, {o.expert_pd()} AS trial_pd FROM ({ind})"


_add("document_features", """
SELECT reference, (SELECT count(*) FROM loan x WHERE x.application_id = d.application_id) AS existing_loans,
  revolving_loans,
  (SELECT CAST(coalesce(sum(incidents_12m), 0) AS BIGINT) FROM loan x WHERE x.application_id = d.application_id) AS loan_incidents_12m,
  (SELECT count(*) FROM inc_line x WHERE x.application_id = d.application_id AND documented = 0) AS undocumented_income_lines
FROM doc d""", "app", "ind_sum", "ind_all", "beh", "emp", "cr_customer", "inc_line", "loan",
     extra={"doc": _DOC_ROWS})
_add("max_amount", f"""
SELECT d.reference, {rnd('initial_pd', 4)} AS initial_pd, 0.05::DOUBLE AS target_pd,
  d.requested_amount,
  CASE WHEN initial_pd <= 0.05 THEN d.requested_amount ELSE {rnd('low', 2)} END
    AS maximum_amount,
  {rnd('trial_pd', 4)} AS pd_at_maximum, {rnd('(d.requested_amount - low)', 2)}
    AS reduction_required,
  CASE WHEN initial_pd <= 0.05 THEN 'the target is already met at the requested amount'
    WHEN low IS NULL THEN 'no amount brings the PD under target: the risk lies in the profile, not in the sizing of the operation'
    ELSE 'cutting the amount to '
      || replace(format('{{:,}}', CAST({o.rint('low')} AS BIGINT)), ',', ' ')
      || ' EUR keeps the PD under 5%' END AS comment
FROM initial d LEFT JOIN final USING (application_id)""",
     "app", "ind_sum", "ind_all", "beh", "emp", "cr_customer", "inc_line", "loan", extra={
         "doc": _DOC_ROWS,
         "initial": f"SELECT *, {o.expert_pd()} AS initial_pd FROM doc",
         "floor_pd": _trial("500.0::DOUBLE", "(SELECT * FROM initial WHERE initial_pd > 0.05 "
                            "AND requested_amount > 500)", "*"),
         "start": "SELECT * EXCLUDE (amount, excl, cover, pay, trial_pd, dti_after_pct, "
                  "residual_income_per_cu, savings_months_of_expenses), "
                  "0.0::DOUBLE AS dti_after_pct, 0.0::DOUBLE AS residual_income_per_cu, "
                  "0.0::DOUBLE AS savings_months_of_expenses FROM floor_pd "
                  "WHERE trial_pd <= 0.05",
         "steps(step, application_id, low, high)": f"""
SELECT 0, application_id, 500.0::DOUBLE, requested_amount FROM start
UNION ALL
SELECT step + 1, application_id,
  CASE WHEN trial_pd <= 0.05 THEN amount ELSE low END,
  CASE WHEN trial_pd <= 0.05 THEN high ELSE amount END
FROM ({_trial('((low + high) / 2.0::DOUBLE)',
              '(SELECT * FROM steps JOIN start USING (application_id) WHERE step < 40)',
              'step, application_id, low, high, amount')})""",
         "final": _trial("low", "(SELECT * FROM (SELECT * FROM steps WHERE step = 40) "
                         "JOIN start USING (application_id))", "application_id, low")})
ORACLES["max_amount"] = ORACLES["max_amount"].replace("WITH ", "WITH RECURSIVE ", 1)
