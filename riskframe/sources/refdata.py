"""Code tables, variable dictionary and wording tables.

Everything in this module is a fixed value: codes, labels, weights, roles and
French wording that results must reproduce exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: code tables ----------------------------------------------
LOAN_TYPES = [
    ("PERSONAL_LOAN", "Unsecured personal loan"),
    ("AUTO", "Car or motorcycle loan"),
    ("HOME_IMPROVEMENT", "Home improvement loan"),
    ("REVOLVING", "Revolving credit"),
    ("DEBT_CONSOLIDATION", "Debt consolidation"),
    ("LEASE_TO_OWN", "Lease with purchase option"),
]

# Smallest and largest amount of each product.
AMOUNT_BOUNDS = {
    "PERSONAL_LOAN": (3000, 40000), "AUTO": (5000, 45000), "HOME_IMPROVEMENT": (4000, 50000),
    "REVOLVING": (1000, 6000), "DEBT_CONSOLIDATION": (8000, 60000), "LEASE_TO_OWN": (8000, 35000),
}

EMPLOYMENT_CONTRACTS = [
    ("PERMANENT", "Permanent contract, probation passed (CDI)", "stable"),
    ("CIVIL_SERVANT", "Tenured civil servant", "stable"),
    ("RETIRED", "Retired", "stable"),
    ("FIXED_TERM", "Fixed-term contract (CDD)", "intermediate"),
    ("SELF_EMPLOYED", "Self-employed / liberal profession", "intermediate"),
    ("TEMP_AGENCY", "Temporary agency work (interim)", "precarious"),
    ("APPRENTICE", "Apprentice or work-study", "precarious"),
    ("UNEMPLOYED", "Not in employment", "precarious"),
]

HOUSING_STATUSES = [
    ("OWNER_OUTRIGHT", "Owner, no mortgage outstanding", 0),
    ("OWNER_WITH_MORTGAGE", "Owner with an outstanding mortgage", 0),
    ("TENANT", "Tenant", 1),
    ("HOUSED_FREE", "Housed free of charge", 0),
    ("EMPLOYER_HOUSING", "Employer-provided housing", 0),
]

OCCUPATIONS = [
    ("FARMER", "Farmer"),
    ("SELF_EMPLOYED_TRADE", "Craftsman, shopkeeper, business owner"),
    ("MANAGER_PROFESSIONAL", "Manager or higher professional"),
    ("INTERMEDIATE", "Intermediate profession"),
    ("CLERICAL", "Clerical or service employee"),
    ("MANUAL_WORKER", "Manual worker"),
    ("RETIRED", "Retired"),
    ("STUDENT", "Student"),
    ("INACTIVE", "Not economically active"),
]

INCOME_TYPES = [
    ("SALARY", "Net monthly salary", 1.00, "salary"),
    ("CIVIL_SERVICE_PAY", "Civil service pay", 1.00, "salary"),
    ("GUARANTEED_BONUS", "Contractual guaranteed bonus", 1.00, "bonus"),
    ("VARIABLE_BONUS", "Variable bonus or commission", 0.70, "bonus"),
    ("OVERTIME", "Recurring overtime", 0.70, "bonus"),
    ("FAMILY_BENEFITS", "Family allowances", 1.00, "benefits"),
    ("HOUSING_BENEFIT", "Housing benefit (APL)", 0.00, "benefits"),
    ("UNEMPLOYMENT_BENEFIT", "Unemployment benefit", 0.00, "benefits"),
    ("PENSION", "Retirement pension", 1.00, "pension"),
    ("DISABILITY_PENSION", "Disability pension", 1.00, "pension"),
    ("ALIMONY_RECEIVED", "Alimony received", 0.80, "pension"),
    ("RENTAL_INCOME", "Rental income", 0.70, "rental"),
    ("SELF_EMPLOYED_PROFIT", "Self-employment profit (BNC/BIC)", 0.90, "other"),
    ("OTHER_INCOME", "Other income", 0.50, "other"),
]

EXPENSE_TYPES = [
    ("RENT", "Rent excluding service charges", "rent"),
    ("ALIMONY_PAID", "Alimony paid", "alimony"),
    ("MONTHLY_TAX", "Income tax paid monthly", "tax"),
    ("OTHER_EXPENSE", "Other recurring expense", "other"),
]

REASONS = [
    ("EXCESSIVE_DTI", "Debt-to-income ratio above the threshold", "adverse", "affordability"),
    ("LOW_RESIDUAL_INCOME", "Residual income per consumption unit too low", "adverse", "affordability"),
    ("HIGH_PAYMENT_SHOCK", "Payment shock too large", "adverse", "affordability"),
    ("COMFORTABLE_DTI", "Comfortable debt-to-income ratio", "favourable", "affordability"),
    ("AMPLE_RESIDUAL_INCOME", "Ample residual income", "favourable", "affordability"),
    ("INSUFFICIENT_INCOME", "Income insufficient for the amount requested", "adverse", "income"),
    ("TOO_MUCH_VARIABLE_PAY", "Variable share of income too high", "adverse", "income"),
    ("UNDOCUMENTED_INCOME", "Declared income not evidenced", "adverse", "income"),
    ("SOLID_INCOME", "Stable and fully evidenced income", "favourable", "income"),
    ("PRECARIOUS_CONTRACT", "Precarious employment contract", "adverse", "stability"),
    ("PROBATION_PERIOD", "Borrower still in probation period", "adverse", "stability"),
    ("SHORT_JOB_TENURE", "Insufficient time in current job", "adverse", "stability"),
    ("RECENT_MOVE", "Very recent move to current address", "adverse", "stability"),
    ("STABLE_EMPLOYMENT", "Stable employment situation", "favourable", "stability"),
    ("PAYMENT_INCIDENTS", "Payment incidents in the last 12 months", "adverse", "behaviour"),
    ("HEAVY_OVERDRAFT_USE", "Recurring use of the overdraft", "adverse", "behaviour"),
    ("LOAN_INCIDENTS", "Incidents on existing loans", "adverse", "behaviour"),
    ("MULTIPLE_REVOLVING", "Several revolving credit lines held", "adverse", "behaviour"),
    ("SOLID_SAVINGS", "Sufficient precautionary savings", "favourable", "behaviour"),
    ("CLEAN_HISTORY", "No incident over the observed period", "favourable", "behaviour"),
    ("LONG_RELATIONSHIP", "Long-standing banking relationship", "favourable", "behaviour"),
    ("SALARY_DOMICILED", "Salary paid into an account with the lender", "favourable", "behaviour"),
    ("LOANS_REPAID_CLEAN", "Previous loans repaid without incident", "favourable", "behaviour"),
    ("SOLID_CO_BORROWER", "Co-borrower provides real support", "favourable", "collateral"),
    ("MEANINGFUL_DOWN_PAYMENT", "Meaningful down payment", "favourable", "collateral"),
    ("NO_SECURITY", "Neither down payment nor security", "adverse", "collateral"),
    ("FICP_FLAG", "Registered on the FICP incident file", "adverse", "regulatory"),
    ("FCC_FLAG", "Registered on the FCC cheque incident file", "adverse", "regulatory"),
    ("ABOVE_USURY_RATE", "APR above the applicable usury ceiling", "adverse", "regulatory"),
    ("OVERRIDE_WEALTH", "Override justified by assets held", "favourable", "override"),
    ("OVERRIDE_RELATIONSHIP", "Override justified by customer history", "favourable", "override"),
    ("OVERRIDE_COMMERCIAL", "Commercial override granted", "favourable", "override"),
]

# ---- fixed values: wording --------------------------------------------------
CONTRACT_FR = {
    "PERMANENT": "CDI", "FIXED_TERM": "CDD", "TEMP_AGENCY": "interim",
    "CIVIL_SERVANT": "fonctionnaire", "SELF_EMPLOYED": "independant",
    "RETIRED": "retraite", "APPRENTICE": "apprenti", "UNEMPLOYED": "sans emploi",
}

PURPOSE_FR = {
    "AUTO": "crédit auto", "HOME_IMPROVEMENT": "crédit travaux",
    "PERSONAL_LOAN": "prêt personnel", "REVOLVING": "réserve d'argent",
    "DEBT_CONSOLIDATION": "regroupement de crédits",
    "LEASE_TO_OWN": "location avec option d'achat",
}

PURPOSE = {
    "PERSONAL_LOAN": "Personal project", "AUTO": "Vehicle",
    "HOME_IMPROVEMENT": "Home improvement works", "REVOLVING": "Cash reserve",
    "DEBT_CONSOLIDATION": "Debt consolidation",
    "LEASE_TO_OWN": "Lease with purchase option",
}

# Clause per reason; {names} are filled from the file.
CLAUSES = {
    "EXCESSIVE_DTI": "le taux d'endettement après opération atteint {dti} %, au-delà du seuil de 35 %",
    "COMFORTABLE_DTI": "le taux d'endettement après opération reste contenu à {dti} %",
    "LOW_RESIDUAL_INCOME": "le reste à vivre s'établit à {residual} EUR par unité de consommation, insuffisant pour le foyer",
    "AMPLE_RESIDUAL_INCOME": "le reste à vivre atteint {residual} EUR par unité de consommation",
    "HIGH_PAYMENT_SHOCK": "le saut de charge de {shock} EUR par mois est important au regard des revenus",
    "INSUFFICIENT_INCOME": "les revenus ne supportent pas le montant sollicité",
    "TOO_MUCH_VARIABLE_PAY": "la part variable des revenus est élevée et fragilise la capacité de remboursement",
    "UNDOCUMENTED_INCOME": "une partie des revenus déclarés n'est pas justifiée",
    "SOLID_INCOME": "les revenus sont stables et intégralement justifiés",
    "PRECARIOUS_CONTRACT": "le contrat de travail est précaire",
    "PROBATION_PERIOD": "l'emprunteur est en période d'essai",
    "SHORT_JOB_TENURE": "l'ancienneté professionnelle est faible ({tenure} mois)",
    "RECENT_MOVE": "l'installation dans le logement est très récente",
    "STABLE_EMPLOYMENT": "la situation professionnelle est stable ({contract}, {tenure} mois d'ancienneté)",
    "PAYMENT_INCIDENTS": "des incidents de paiement ont été relevés sur les douze derniers mois",
    "HEAVY_OVERDRAFT_USE": "le compte est resté débiteur {days} jours sur l'année",
    "LOAN_INCIDENTS": "des incidents ont été constatés sur les crédits en cours",
    "MULTIPLE_REVOLVING": "la détention de plusieurs crédits renouvelables traduit une tension de trésorerie",
    "SOLID_SAVINGS": "l'épargne disponible représente {savings} mois de charges",
    "CLEAN_HISTORY": "aucun incident n'est à signaler sur la période observée",
    "LONG_RELATIONSHIP": "la relation bancaire remonte à plus de {years} ans",
    "SALARY_DOMICILED": "les revenus sont domiciliés dans l'établissement",
    "LOANS_REPAID_CLEAN": "les crédits précédents ont été soldés sans incident",
    "SOLID_CO_BORROWER": "la présence d'un co-emprunteur renforce le dossier",
    "MEANINGFUL_DOWN_PAYMENT": "l'apport personnel de {down} EUR réduit l'exposition",
    "NO_SECURITY": "l'opération ne s'accompagne d'aucun apport ni garantie",
    "FICP_FLAG": "l'emprunteur est inscrit au FICP",
    "FCC_FLAG": "l'emprunteur est inscrit au FCC",
    "OVERRIDE_WEALTH": "le patrimoine constitué justifie une dérogation",
    "OVERRIDE_RELATIONSHIP": "l'ancienneté de la relation justifie une dérogation",
    "OVERRIDE_COMMERCIAL": "une dérogation commerciale a été accordée",
}

PERSONAS = ["underwriter", "adviser", "committee"]

OPENINGS = {
    "underwriter": {
        "approved": "Dossier accordé.",
        "approved_with_conditions": "Accord assorti de conditions.",
        "declined": "Demande rejetée.",
        "deferred": "Décision ajournée dans l'attente de pièces complémentaires.",
    },
    "adviser": {
        "approved": "Nous donnons une suite favorable à cette demande de {purpose}.",
        "approved_with_conditions": "Nous pouvons accompagner ce projet de {purpose}, sous réserve d'aménagements.",
        "declined": "Nous ne pouvons pas donner suite à cette demande de {purpose}.",
        "deferred": "L'instruction de cette demande de {purpose} est suspendue.",
    },
    "committee": {
        "approved": "Le comité retient une position favorable.",
        "approved_with_conditions": "Le comité retient un accord conditionné.",
        "declined": "Le comité retient une position défavorable.",
        "deferred": "Le comité ajourne sa décision.",
    },
}

LINKS_NEGATIVE = ["Le dossier présente toutefois un point d'appui", "À l'inverse",
                  "Il faut noter en sens inverse"]
LINKS_POSITIVE = ["Le dossier appelle en revanche une réserve",
                  "Un point de vigilance subsiste", "Une réserve demeure"]
CLOSINGS_DECLINED = [
    "Une demande portant sur un montant inférieur pourrait être réexaminée.",
    "Le dossier pourra être représenté après consolidation de la situation.",
    "Aucune contre-proposition n'est envisageable en l'état.",
]

CONTRADICTION_MARKERS = {
    "declined": ["accord.", "accord,", "nous donnons une suite favorable",
                 "position favorable", "avis favorable", "demande acceptée"],
    "deferred": ["accord.", "refus.", "nous refusons"],
    "approved": ["refus.", "nous ne pouvons pas donner suite", "position défavorable",
                 "avis défavorable", "demande rejetée"],
    "approved_with_conditions": ["refus.", "nous ne pouvons pas donner suite",
                                 "position défavorable", "demande rejetée"],
}

# ---- fixed values: variable dictionary --------------------------------------
# column, label, data type, role, categories, unit, description
DICTIONARY = [
    ("application_id", "Technical application id", "integer", "meta", None, None, "Row key."),
    ("application_reference", "Application reference", "text", "meta", None, None, "Business key of the file."),
    ("customer_reference", "Customer reference", "text", "meta", None, None, "Groups the files of one customer."),
    ("application_date", "Application date", "date", "meta", None, None, "Day of every snapshot."),
    ("split", "Dataset partition", "categorical", "meta", "train|val|test", None, "Fixed when the file is created."),
    ("source", "Record origin", "categorical", "meta", "manual|generated", None, "Written by hand or in volume."),
    ("formula_version", "Indicator formula version", "text", "meta", None, None, "Which formulas produced the indicators."),
    ("decided_by", "Decision origin", "categorical", "meta", "human|rule_engine|llm", None, "Author of the decision text."),
    ("decision_date", "Decision date", "date", "meta", None, None, "Not before the application date."),
    ("observation_months", "Outcome observation window", "integer", "meta", None, "months", "Hindsight on an approved loan."),
    ("age", "Age at application", "integer", "protected", None, "years", "For bias audits only."),
    ("sex", "Sex", "categorical", "protected", "M|F|NR", None, "For bias audits only."),
    ("nationality_zone", "Nationality zone", "categorical", "protected", "FR|EU|NON_EU", None, "For bias audits only."),
    ("marital_status", "Marital status", "categorical", "protected", "single|married|civil_union|cohabiting|divorced|widowed", None, "For bias audits only."),
    ("channel", "Origination channel", "categorical", "feature", "branch|online|broker|point_of_sale", None, "Where the file came in."),
    ("loan_type", "Loan product", "categorical", "feature", None, None, "Product code."),
    ("requested_amount", "Requested amount", "numeric", "feature", None, "EUR", "Principal asked for."),
    ("term_months", "Requested term", "integer", "feature", None, "months", "Duration asked for."),
    ("nominal_rate", "Nominal rate", "numeric", "feature", None, "%", "Yearly rate before fees."),
    ("apr", "Annual percentage rate", "numeric", "feature", None, "%", "Yearly rate with fees."),
    ("payment_excl_insurance", "Payment excluding insurance", "numeric", "feature", None, "EUR", "Instalment of capital and interest."),
    ("insurance_taken", "Borrower insurance taken", "boolean", "feature", "0|1", None, "Optional cover chosen."),
    ("monthly_insurance_cost", "Monthly insurance cost", "numeric", "feature", None, "EUR", "0 without cover."),
    ("monthly_payment", "Total monthly payment", "numeric", "feature", None, "EUR", "Instalment and cover."),
    ("down_payment", "Down payment", "numeric", "feature", None, "EUR", "Own funds brought in."),
    ("down_payment_ratio", "Down payment ratio", "numeric", "feature", None, "ratio", "Own funds over amount."),
    ("has_co_borrower", "Co-borrower present", "boolean", "feature", "0|1", None, "A second borrower signs."),
    ("household_size", "Household size", "integer", "feature", None, "people", "Everyone in the home."),
    ("dependent_children", "Dependent children", "integer", "feature", None, "children", "Used by the unit scale."),
    ("housing_status", "Housing status", "categorical", "feature", None, None, "Owner, tenant or housed."),
    ("months_at_address", "Months at current address", "integer", "feature", None, "months", "Residential stability."),
    ("department", "Department of residence", "categorical", "feature", None, None, "Area code kept as text."),
    ("area_type", "Area type", "categorical", "feature", "urban|suburban|rural", None, "Density of the area."),
    ("occupation", "Occupation category", "categorical", "feature", None, None, "Main borrower."),
    ("contract_type", "Employment contract", "categorical", "feature", None, None, "Main borrower."),
    ("contract_stability", "Contract stability tier", "categorical", "feature", "stable|intermediate|precarious", None, "Tier of the contract table."),
    ("months_in_job", "Months in current job", "integer", "feature", None, "months", "Main borrower."),
    ("in_probation_period", "In probation period", "boolean", "feature", "0|1", None, "Contract not yet confirmed."),
    ("industry", "Industry", "categorical", "feature", None, None, "Free text."),
    ("employer_type", "Employer type", "categorical", "feature", "private|public|self_employed", None, "Main borrower."),
    ("co_borrower_contract", "Co-borrower contract", "categorical", "feature", None, None, "Empty without a second borrower."),
    ("co_borrower_months_in_job", "Co-borrower months in job", "integer", "feature", None, "months", "Empty without a second borrower."),
    ("relationship_months", "Banking relationship length", "integer", "feature", None, "months", "As of the application."),
    ("income_salary", "Salary income", "numeric", "feature", None, "EUR/month", "Unweighted salaries."),
    ("income_bonus", "Bonuses and variable pay", "numeric", "feature", None, "EUR/month", "Unweighted bonuses."),
    ("income_benefits", "Benefits", "numeric", "feature", None, "EUR/month", "Unweighted benefits."),
    ("income_pension", "Pensions", "numeric", "feature", None, "EUR/month", "Unweighted pensions."),
    ("income_rental", "Rental income", "numeric", "feature", None, "EUR/month", "Unweighted rents received."),
    ("income_other", "Other income", "numeric", "feature", None, "EUR/month", "Unweighted other lines."),
    ("income_co_borrower", "Co-borrower income", "numeric", "feature", None, "EUR/month", "Lines of the second borrower."),
    ("undocumented_income_lines", "Undocumented income lines", "integer", "feature", None, "lines", "Lines without evidence."),
    ("gross_income", "Total declared income", "numeric", "feature", None, "EUR/month", "All lines at face value."),
    ("weighted_income", "Total weighted income", "numeric", "feature", None, "EUR/month", "All lines at their weight."),
    ("variable_income_share", "Variable income share", "numeric", "feature", None, "ratio", "Variable over total."),
    ("expense_rent", "Rent", "numeric", "feature", None, "EUR/month", "Counted rent."),
    ("expense_alimony", "Alimony paid", "numeric", "feature", None, "EUR/month", "Counted alimony."),
    ("expense_tax", "Income tax paid monthly", "numeric", "feature", None, "EUR/month", "Counted tax."),
    ("expense_other", "Other expenses", "numeric", "feature", None, "EUR/month", "Counted remainder."),
    ("counted_expenses", "Total counted expenses", "numeric", "feature", None, "EUR/month", "Lines that enter the ratio."),
    ("existing_loans", "Existing loans", "integer", "feature", None, "loans", "Number before this loan."),
    ("existing_loan_payments", "Existing loan payments", "numeric", "feature", None, "EUR/month", "Their instalments."),
    ("outstanding_balance_total", "Total outstanding balance", "numeric", "feature", None, "EUR", "Their balances."),
    ("revolving_loans", "Revolving credit lines", "integer", "feature", None, "loans", "Number of revolving lines."),
    ("loans_refinanced", "Loans repaid by this operation", "integer", "feature", None, "loans", "Repaid out of this loan."),
    ("loan_incidents_12m", "Loan incidents (12 months)", "integer", "feature", None, "incidents", "Over all loans."),
    ("longest_remaining_months", "Longest remaining term", "integer", "feature", None, "months", "Latest end date."),
    ("retained_payments", "Payments retained after loan", "numeric", "feature", None, "EUR/month", "Instalments that stay."),
    ("average_balance", "Average account balance", "numeric", "feature", None, "EUR", "Can be negative."),
    ("days_overdrawn_12m", "Days overdrawn", "integer", "feature", None, "days", "Last 12 months."),
    ("rejected_debits_12m", "Rejected direct debits", "integer", "feature", None, "rejections", "Last 12 months."),
    ("overdraft_fees_12m", "Overdraft intervention fees", "integer", "feature", None, "events", "Last 12 months."),
    ("overdraft_limit", "Authorised overdraft", "numeric", "feature", None, "EUR", "Limit in force."),
    ("max_overdraft_used", "Peak overdraft used", "numeric", "feature", None, "EUR", "Last 12 months."),
    ("liquid_savings", "Liquid savings", "numeric", "feature", None, "EUR", "Available at once."),
    ("total_savings", "Total savings", "numeric", "feature", None, "EUR", "Liquid and locked."),
    ("products_held", "Products held", "integer", "feature", None, "products", "Depth of the relationship."),
    ("salary_domiciled", "Salary domiciled", "boolean", "feature", "0|1", None, "Pay arrives at the lender."),
    ("ficp_flagged", "FICP registration", "boolean", "feature", "0|1", None, "Repayment incident register."),
    ("fcc_flagged", "FCC registration", "boolean", "feature", "0|1", None, "Cheque incident register."),
    ("loans_repaid_clean", "Previous loans repaid clean", "integer", "feature", None, "loans", "Good history."),
    ("dti_before_pct", "Debt-to-income before", "numeric", "feature", None, "%", "Burden before the loan."),
    ("dti_after_pct", "Debt-to-income after", "numeric", "feature", None, "%", "Burden after the loan."),
    ("above_hcsf_threshold", "Above the 35% threshold", "boolean", "feature", "0|1", None, "Burden over the cap."),
    ("consumption_units", "Household consumption units", "numeric", "feature", None, "CU", "Equivalence scale."),
    ("residual_income", "Residual income", "numeric", "feature", None, "EUR/month", "Left after all charges."),
    ("residual_income_per_cu", "Residual income per CU", "numeric", "feature", None, "EUR/month", "Left per unit."),
    ("payment_shock", "Payment shock", "numeric", "feature", None, "EUR/month", "Change of the burden."),
    ("savings_months_of_expenses", "Savings in months of expenses", "numeric", "feature", None, "months", "Charges covered by savings."),
    ("decision_result", "Decision", "categorical", "target", "approved|approved_with_conditions|declined|deferred", None, "What was decided."),
    ("risk_score", "Risk score", "integer", "target", "0-100", "points", "Score given."),
    ("risk_grade", "Risk grade", "categorical", "target", "A|B|C|D|E", None, "Class of the score."),
    ("approved_amount", "Approved amount", "numeric", "target", None, "EUR", "Empty unless granted."),
    ("approved_term_months", "Approved term", "integer", "target", None, "months", "Empty unless granted."),
    ("conditions", "Conditions attached", "text", "target", None, None, "Only on a conditional approval."),
    ("rationale", "Written rationale", "text", "target", None, None, "Decision text, in French."),
    ("reasons", "Coded reasons", "text", "target", None, None, "Codes joined by |."),
    ("adverse_reasons", "Adverse reason count", "integer", "target", None, "reasons", "Number against."),
    ("favourable_reasons", "Favourable reason count", "integer", "target", None, "reasons", "Number in favour."),
    ("outcome_status", "Observed outcome", "categorical", "target", "ongoing|repaid_clean|minor_incidents|default|early_repayment", None, "What happened to the loan."),
    ("default_flag", "Default observed", "boolean", "target", "0|1", None, "NULL when unknown; never filled with 0."),
    ("counterfactual_default_flag", "Counterfactual default", "boolean", "target", "0|1", None, "Only for measuring selection bias."),
    ("outcome_missed_payments", "Missed payments", "integer", "target", None, "payments", "Over the window."),
    ("outcome_sent_to_collections", "Sent to collections", "boolean", "target", "0|1", None, "Last stage of a default."),
    ("outcome_balance_at_default", "Balance at default", "numeric", "target", None, "EUR", "Only on a default."),
]
# ---- end of fixed values ----------------------------------------------------

DICTIONARY_SCHEMA = ("column_name STRING, label STRING, data_type STRING, role STRING, "
                     "categories STRING, unit STRING, description STRING")

ROLE = {row[0]: row[3] for row in DICTIONARY}
DATA_TYPE = {row[0]: row[2] for row in DICTIONARY}
LABEL = {row[0]: row[1] for row in DICTIONARY}

ADVERSE_CODES = [code for code, _, polarity, _ in REASONS if polarity == "adverse"]
FAVOURABLE_CODES = [code for code, _, polarity, _ in REASONS if polarity == "favourable"]

_CODE_TABLES = {
    "loan_type": (LOAN_TYPES, "code STRING, label STRING"),
    "employment_contract": (EMPLOYMENT_CONTRACTS, "code STRING, label STRING, stability STRING"),
    "housing_status": (HOUSING_STATUSES, "code STRING, label STRING, rent_expected INT"),
    "occupation": (OCCUPATIONS, "code STRING, label STRING"),
    "income_type": (INCOME_TYPES,
                    "code STRING, label STRING, default_weight DOUBLE, family STRING"),
    "expense_type": (EXPENSE_TYPES, "code STRING, label STRING, family STRING"),
    "reason": (REASONS, "code STRING, label STRING, polarity STRING, category STRING"),
}


def code_table(spark: SparkSession, name: str) -> DataFrame:
    """One of the seven code tables; at most 32 rows, so always safe to broadcast."""
    rows, schema = _CODE_TABLES[name]
    return spark.createDataFrame(rows, schema)


def code_table_names() -> list[str]:
    return list(_CODE_TABLES)


def variable_dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, DICTIONARY_SCHEMA)


def columns_with_role(role: str) -> list[str]:
    return [row[0] for row in DICTIONARY if row[3] == role]
