"""Risk and consistency rules as predicates over one wide row a document.

A rule is data: labels, a predicate and an evidence struct, all column expressions. Rules of one flag a document are
evaluated in a single pass over the wide row and unnested; the two rules of one flag a line item run over movements.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import otherwise_null, parse_indian_number, shown, strip

#: Keys that a rule of their own covers, and the bounds (lakh) of a small company.
COVERED = (
    "cash_equivalents", "roa_net", "other_financial_assets_current", "total_non_current_liabilities", "trade_receivables", "revenue_from_operations",
    "trade_payables_mse", "trade_payables_others", "share_of_jv_profit", "tax_prior_years", "current_tax", "cfo", "pat",
)
SMALL_CAPITAL, SMALL_TURNOVER = 1000.0, 10000.0


def move(key: str, field: str) -> Column:
    return F.col("m")[key][field]


@dataclass(frozen=True)
class Rule:
    flag_id: str
    severity: str | Column
    area: str
    when: Callable[[], Column]
    evidence: Callable[[], dict[str, Column]]
    note_ids: tuple[str, ...]
    query: str
    triggered_by: str | Callable[[], Column]

    def row(self, order: int) -> Column:
        severity = self.severity() if callable(self.severity) else F.lit(self.severity)
        reason = self.triggered_by() if callable(self.triggered_by) else F.lit(self.triggered_by)
        evidence = self.evidence()
        packed = F.to_json(F.struct(*(x.alias(n) for n, x in evidence.items())), {"ignoreNullFields": "false"}) if evidence else F.lit("{}")
        fields = F.struct(
            F.lit(order).alias("rule_ord"), F.lit(self.flag_id).alias("flag_id"), F.lit(self.area).alias("area"), severity.alias("severity"), packed.alias("evidence"),
            F.array(*map(F.lit, self.note_ids)).cast("array<string>").alias("note_ids"), F.lit(self.query).alias("standard_query"), reason.alias("triggered_by"),
        )
        return F.when(F.coalesce(self.when(), F.lit(False)), fields)


def _sides(key: str, *fields: str) -> Callable[[], dict[str, Column]]:
    return lambda: {("pct_change" if f == "pct_change" else f): move(key, f) for f in fields}


def _above(key: str, pct: float, material: float | None = None) -> Callable[[], Column]:
    bound = lambda: F.lit(True) if material is None else move(key, "materiality_pct") > material
    return lambda: (move(key, "pct_change") > pct) & bound()


def _below(key: str, pct: float, material: float | None = None) -> Callable[[], Column]:
    bound = lambda: F.lit(True) if material is None else move(key, "materiality_pct") > material
    return lambda: (move(key, "pct_change") < pct) & bound()


def _now(key: str) -> Column:
    return move(key, "current")


def _contingent_increase() -> Column:
    return F.col("contingent.total") - F.col("contingent.total_prior")


def _contingent_share() -> Column:
    return F.col("contingent.total") / F.nullif(_now("total_equity"), F.lit(0.0)) * 100


def _contingent_grew() -> Column:
    return F.coalesce(_contingent_increase() > _now("total_equity") * 0.05, F.lit(False))


def _divergence() -> Column:
    return F.abs(move("trade_receivables", "pct_change") - move("revenue_from_operations", "pct_change"))


def _rate_change() -> Column:
    return F.abs(F.col("actuarial.discount_rate_current") - F.col("actuarial.discount_rate_prior"))


def _overdue() -> Column:
    return F.filter("cwip", lambda p: (p.age_bucket == "more_than_3_years") & (p.amount > 0))


_THREE = ("current", "prior", "pct_change")

#: Fixed values within: ids, areas, thresholds, notes, queries and reasons of the rules.
HIGH = [
    Rule("CASH_DECLINE", "High", "Liquidity & Cash Flow", _below("cash_equivalents", -40, 0.5), _sides("cash_equivalents", *_THREE, "absolute_change"), ("7f", "14a", "14d"), "going concern liquidity cash flow assessment Ind AS 1", "Cash and cash equivalents declined >40% and material to assets"),
    Rule("CFO_PAT_DIVERGENCE", "High", "Cash Flow Quality", lambda: (_now("pat") > 0) & (_now("cfo") < _now("pat") * 0.6), lambda: {"cfo": _now("cfo"), "pat": _now("pat"), "cfo_to_pat_ratio": F.try_divide(_now("cfo"), _now("pat"))}, (), "cash flow from operations profit reconciliation working capital Ind AS 7", "Operating cash flow is less than 60% of reported profit after tax"),
    Rule("ROU_MATERIAL_INCREASE", "High", "Right-of-Use Assets & Lease Liabilities", _above("roa_net", 100, 2), _sides("roa_net", *_THREE), ("5", "14b", "33"), "lease recognition measurement lessee right-of-use asset Ind AS 116", "ROU assets increased >100% and exceed 2% of total assets"),
    Rule(
        "CONTINGENT_LIABILITY_JUMP", "High", "Contingent Liabilities", lambda: (F.coalesce(_now("total_equity"), F.lit(0.0)) != 0) & (_contingent_grew() | (_contingent_share() > 25)),
        lambda: {"current_total": F.col("contingent.total"), "prior_total": F.col("contingent.total_prior"), "increase": _contingent_increase(), "exposure_pct_of_equity": _contingent_share(), "income_tax": F.col("contingent.income_tax"), "gst": F.col("contingent.gst"), "service_tax": F.col("contingent.service_tax")},
        ("27",), "contingent liability disclosure provision Ind AS 37",
        lambda: F.when(_contingent_grew(), "Contingent liabilities increased by more than 5% of equity").otherwise("Contingent liabilities are a large absolute exposure relative to equity (>25%)"),
    ),
    Rule("OTHER_FIN_ASSETS_SURGE", "High", "Other Financial Assets (Current)", _above("other_financial_assets_current", 80, 5), _sides("other_financial_assets_current", *_THREE), ("7c",), "other financial assets classification measurement recoverability Ind AS 109", "Other current financial assets surged >80% and exceed 5% of total assets"),
]
MEDIUM = [
    Rule("NON_CURRENT_LIABILITIES_SURGE", "Medium", "Non-Current Liabilities", _above("total_non_current_liabilities", 50, 5), _sides("total_non_current_liabilities", *_THREE), (), "non-current liabilities recognition disclosure Schedule III presentation", "Total non-current liabilities grew >50% and exceed 5% of total assets"),
    Rule(
        "RECEIVABLES_REVENUE_MISMATCH", "Medium", "Trade Receivables & ECL Provisioning", lambda: _divergence() > 20,
        lambda: {"receivables_pct_change": move("trade_receivables", "pct_change"), "revenue_pct_change": move("revenue_from_operations", "pct_change"), "receivables_current": _now("trade_receivables"), "revenue_current": _now("revenue_from_operations"), "divergence": _divergence()},
        ("7e", "37"), "expected credit loss trade receivables provision matrix Ind AS 109", "Trade receivables and revenue growth diverge by >20 percentage points",
    ),
    Rule("MSE_PAYABLES_INCREASE", "Medium", "Trade Payables – MSME Compliance", _above("trade_payables_mse", 40), lambda: {**_sides("trade_payables_mse", *_THREE)(), "interest_accrued": F.col("msmed.interest_accrued_unpaid")}, ("14e",), "MSMED Act 2006 section 15 16 payment 45 days interest", "MSE trade payables increased >40% and MSMED Act compliance at risk"),
    Rule(
        "PRIOR_YEAR_TAX_MATERIAL", "Medium", "Income Tax – Prior Period Adjustments", lambda: (_now("tax_prior_years") != 0) & (_now("current_tax") != 0) & (F.abs(_now("tax_prior_years")) > F.abs(_now("current_tax")) * 0.4),
        lambda: {"tax_prior_years": _now("tax_prior_years"), "current_tax": _now("current_tax"), "ratio": F.try_divide(F.abs(_now("tax_prior_years")), F.abs(_now("current_tax")))},
        ("28", "41"), "prior period tax adjustment earlier years income tax Ind AS 12", "Prior year tax adjustments exceed 40% of current year tax charge",
    ),
    Rule("JV_PROFIT_DECLINE", "Medium", "Investments in Associates / Joint Ventures", _below("share_of_jv_profit", -25), _sides("share_of_jv_profit", *_THREE), ("6a", "51"), "equity method impairment associate joint venture Ind AS 28 Ind AS 36", "Share of JV/associate profit declined >25%"),
    Rule("CSR_UNSPENT", "Medium", "CSR Compliance", lambda: F.col("csr.amount_unspent") > 0, lambda: {"obligation": F.col("csr.obligation"), "spent": F.col("csr.amount_spent"), "unspent": F.col("csr.amount_unspent")}, ("25b",), "CSR unspent section 135 Companies Act 2013 transfer escrow", "CSR obligation not fully spent during the year"),
    Rule("MSME_INTEREST_ACCRUED", "Medium", "MSME Interest Liability", lambda: F.col("msmed.interest_accrued_unpaid") > 0, lambda: {"interest_accrued": F.col("msmed.interest_accrued_unpaid"), "interest_further_due": F.col("msmed.interest_further_due")}, ("14e",), "MSMED Act interest delayed payment section 16 section 23 disallowance", "Interest accrued on delayed MSME payments is non-zero"),
    Rule("TRADE_PAYABLES_REDUCTION", "Medium", "Trade Payables", _below("trade_payables_others", -25, 3), _sides("trade_payables_others", *_THREE), ("14e",), "trade payables reduction early settlement reclassification Ind AS 32", "Trade payables (non-MSE) declined sharply while remaining material"),
]
LOW = [
    Rule("ACTUARIAL_RATE_CHANGE", "Low", "Defined Benefit Obligations – Actuarial", lambda: _rate_change() > 0.3, lambda: {"discount_rate_current": F.col("actuarial.discount_rate_current"), "discount_rate_prior": F.col("actuarial.discount_rate_prior"), "change_bps": _rate_change() * 100}, ("30",), "actuarial assumptions discount rate defined benefit Ind AS 19", "Actuarial discount rate changed by more than 30 bps"),
    Rule("CWIP_OVERDUE", "Low", "Capital Work-in-Progress", lambda: F.size(_overdue()) > 0, lambda: {"overdue_projects": _overdue()}, ("4",), "capital work in progress ageing impairment capitalization schedule III", "CWIP items outstanding for more than 3 years"),
    Rule("UNPAID_DIVIDEND", "Low", "Unpaid Dividend – IEPF", lambda: F.lower("note_7f").contains("unpaid dividend"), dict, ("7f",), "unpaid dividend IEPF investor education protection fund Companies Act 205C", "Unpaid dividend balance exists — check IEPF transfer compliance"),
]

#: A company number, and what tells of an exception to the audit trail.
_CIN = r"(?U:\b[LUu]\d{5}[A-Za-z]{2}\d{4}[A-Za-z]{3}\d{6}\b)"
_AUDIT_EXCEPTION = r"(?iU)\bexcept\b|not\s+(?:been\s+)?(?:enabled|operational|operat\w*)\b|(?:did|does)\s+not\s+(?:have|maintain|use)\b|\bdisabled\b|\bdiscontinued\b"


def audit_trail_excerpt(text: Column) -> Column:
    """280 characters, white space collapsed, from the first "audit trail" whose next 400 characters tell of an exception."""
    windows = F.regexp_extract_all(text, F.lit(r"(?sU)(?=(?i:audit\s+trail))(?=(.{1,400}))"), 1)
    hit = F.get(F.filter(windows, lambda w: w.rlike(_AUDIT_EXCEPTION)), F.lit(0))
    return strip(F.regexp_replace(F.substring(hit, 1, 280), r"(?U)\s+", " "))


#: A company number and the 300 characters before it, or all of a text's first characters before it. The number is looked for first, as looking back is dear, and
#: dearer the more lengths it may have: the second is for the head of a text alone.
_CIN_AND_BEFORE, _CIN_IN_HEAD = (rf"(?s)(?={_CIN})(?<=({back}))({_CIN})" for back in (".{300}", r"\A.{0,299}"))


def distinct_cins(text: Column) -> Column:
    """Company numbers that are not named within 300 characters after talk of related parties; linear in the text."""

    def named(part: Column, pattern: str) -> Column:
        before, number = (F.regexp_extract_all(part, F.lit(pattern), k) for k in (1, 2))
        return F.filter(F.arrays_zip(before.alias("before"), number.alias("number")), lambda x: ~x["before"].rlike(r"(?iU)arm'?s\s+length|related\s+part(?:y|ies)"))

    found = F.concat(named(F.substring(text, 1, 322), _CIN_IN_HEAD), named(text, _CIN_AND_BEFORE))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.upper(x["number"]))))


_UNCERTAINTY, _EMPHASIS = r"(?iU)material\s+uncertainty\s+related\s+to\s+going\s+concern", r"(?iU)emphasis\s+of\s+matter"


def emphasis(text: Column) -> Column:
    """paragraph_type and excerpt of the auditor's paragraph, uncertainty before emphasis; null without one."""
    from_ = lambda pattern: otherwise_null(F.regexp_extract(text, f"(?s){pattern}.*", 0))
    uncertain = from_(_UNCERTAINTY)
    kind = F.when(uncertain.isNotNull(), "Material Uncertainty Related to Going Concern").otherwise("Emphasis of Matter")
    excerpt = strip(F.regexp_replace(F.substring(F.coalesce(uncertain, from_(_EMPHASIS)), 1, 400), r"(?U)\s+", " "))
    return F.when(excerpt.isNotNull(), F.struct(kind.alias("paragraph_type"), excerpt.alias("excerpt")))


def cash_flow_years(text: Column) -> Column:
    """Years of "31 March" in the first 500 characters of the cash flow statement."""
    head = F.regexp_extract(text, r"(?s)(?iU:cash\s+flow\s+statement).*", 0)
    return F.regexp_extract_all(F.substring(head, 1, 500), F.lit(r"(?U)31\s+March\s+(\d{4})"), 1)


def restricted_balance(text: Column) -> Column:
    """The first figure within 40 characters after "restricted" and up to 60 characters of its line."""
    tails = F.regexp_extract_all(text, F.lit(r"(?isU)restricted[^\n\d]{0,60}(.{0,40})"), 1)
    return F.get(F.filter(F.transform(tails, lambda t: parse_indian_number(F.regexp_extract(t, r"(?U)[\d,]+\.?\d*", 0))), lambda v: v.isNotNull()), F.lit(0))


def _lease_gap() -> Column:
    return F.abs(F.col("lease_total") - F.col("rou_additions")) / F.nullif(F.col("rou_additions"), F.lit(0.0)) * 100


def _tax_sum() -> Column:
    return F.col("tax_current") + F.col("tax_prior") + F.col("tax_deferred")


CONSISTENCY = [
    Rule("XNOTE_CSR_BANK_MISMATCH", "Low", "Data Consistency – CSR Bank Balance", lambda: F.abs(F.col("csr.amount_unspent") - F.col("restricted_balance")) > 1, lambda: {"csr_note_unspent": F.col("csr.amount_unspent"), "bank_note_restricted": F.col("restricted_balance"), "difference": F.abs(F.col("csr.amount_unspent") - F.col("restricted_balance"))}, ("25b", "7f"), "CSR unspent bank balance reconciliation", "CSR unspent in Note 25b does not match restricted balance in Note 7f"),
    Rule("XNOTE_LEASE_ROU_MISMATCH", "Medium", "Data Consistency – Lease ROU vs Liability", lambda: (F.col("lease_total") != 0) & (F.col("rou_additions") > 0) & (_lease_gap() > 15), lambda: {"rou_additions": F.col("rou_additions"), "lease_liability": F.col("lease_total"), "diff_pct": _lease_gap()}, ("5", "14b"), "right of use asset lease liability measurement Ind AS 116 commencement", "ROU asset additions and new lease liabilities differ by >15%"),
    Rule("TAX_RECONCILIATION_ERROR", "High", "Data Integrity – Tax Computation", lambda: F.abs(_tax_sum() - F.col("tax_total")) > 1, lambda: {"current_tax": F.col("tax_current"), "tax_prior_years": F.col("tax_prior"), "deferred_tax": F.col("tax_deferred"), "computed_total": _tax_sum(), "disclosed_total": F.col("tax_total"), "difference": F.abs(_tax_sum() - F.col("tax_total"))}, ("28",), "income tax expense current deferred reconciliation Ind AS 12", "Sum of current + prior year + deferred tax does not equal disclosed total"),
    Rule("CASHFLOW_HEADER_ERROR", "Low", "Data Presentation – Cash Flow Headers", lambda: (F.size("cash_flow_years") >= 2) & (F.size(F.array_distinct("cash_flow_years")) == 1), lambda: {"dates_found": F.col("cash_flow_years")}, (), "financial statement presentation comparative period disclosure Ind AS 1", "Cash flow statement comparative column appears to have incorrect year label"),
    Rule("MULTI_ENTITY_DOCUMENT", "High", "Document Scope", lambda: F.size("cins") > 1, lambda: {"distinct_cins": F.col("cins"), "count": F.size("cins")}, (), "single reporting entity separate financial statements Ind AS 1", lambda: F.concat(F.lit("Document contains "), F.size("cins").cast("string"), F.lit(" distinct company CINs — likely a multi-entity bundle"))),
    Rule("AUDIT_TRAIL_LAPSE", "Medium", "Audit Trail Compliance (Rule 11(g))", lambda: F.col("audit_trail").isNotNull(), lambda: {"excerpt": F.col("audit_trail")}, (), "audit trail edit log accounting software Rule 11(g) Companies Audit and Auditors Rules", "Auditor's report indicates the audit trail feature was not continuously operational"),
    Rule("AUDITOR_EMPHASIS_PARAGRAPH", lambda: F.when(F.col("emphasis.paragraph_type").startswith("Material"), "High").otherwise("Medium"), "Auditor's Report — Emphasis / Going Concern", lambda: F.col("emphasis").isNotNull(), lambda: {"paragraph_type": F.col("emphasis.paragraph_type"), "excerpt": F.col("emphasis.excerpt")}, (), "emphasis of matter material uncertainty going concern SA 570 SA 706", lambda: F.concat(F.lit("Auditor's report contains a '"), F.col("emphasis.paragraph_type"), F.lit("' paragraph"))),
]


def movement_map(moves: DataFrame) -> DataFrame:
    """One row a document with m, a map from key to its movement."""
    entry = F.struct("key", F.struct("current", "prior", "absolute_change", "pct_change", "materiality_pct", "note_ref"))
    return moves.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))


#: Types of the columns that the rules of one flag a document read beside m; a document without one has null.
FACTS = {
    "contingent": "struct<income_tax:double,service_tax:double,gst:double,others:double,total:double,total_prior:double>", "csr": "struct<obligation:double,amount_spent:double,amount_unspent:double>",
    "msmed": "struct<principal_unpaid:double,interest_unpaid:double,interest_accrued_unpaid:double,interest_further_due:double>", "actuarial": "struct<discount_rate_current:double,discount_rate_prior:double>",
    "cwip": "array<struct<project_name:string,age_bucket:string,amount:double>>", "note_7f": "string",
}
CONSISTENCY_FACTS = {"csr": FACTS["csr"], "restricted_balance": "double", "lease_total": "double", "rou_additions": "double", "tax_current": "double", "tax_prior": "double", "tax_deferred": "double", "tax_total": "double", "full_text": "string"}
COLUMNS = ("doc_id", "rule_ord", "key_ord", "flag_id", "area", "severity", "evidence", "note_ids", "standard_query", "triggered_by")


def _filled(facts: DataFrame, types: dict[str, str]) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in types.items() if n not in facts.columns}
    return facts.withColumns(missing) if missing else facts


def _unnested(facts: DataFrame, rules: list[tuple[int, Rule]]) -> DataFrame:
    return facts.select("doc_id", F.inline(F.array_compact(F.array(*(r.row(i) for i, r in rules))))).withColumn("key_ord", F.lit(-1)).select(*COLUMNS)


def flags(moves: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """All flags of documents, rule_ord and key_ord giving their order. facts: doc_id and any of FACTS."""
    row = movement_map(moves)
    joined = row if facts is None else row.join(facts, "doc_id", "full_outer")
    numbered = [*enumerate(HIGH), *enumerate(MEDIUM, 20), *enumerate(LOW, 40)]
    return _unnested(_filled(joined, FACTS), numbered).unionByName(first_occurrences(moves)).unionByName(material_movements(moves))


def _per_item(moves: DataFrame, order: int, flag_id: Column, area: str, severity: Column, evidence: Column, note_ids: Column, query: str, reason: Column) -> DataFrame:
    return moves.select("doc_id", F.lit(order).alias("rule_ord"), F.col("key_ord").cast("int").alias("key_ord"), flag_id.alias("flag_id"), F.lit(area).alias("area"), severity.alias("severity"), F.to_json(evidence, {"ignoreNullFields": "false"}).alias("evidence"), note_ids.alias("note_ids"), F.lit(query).alias("standard_query"), reason.alias("triggered_by"))


def first_occurrences(moves: DataFrame) -> DataFrame:
    """A key without a prior value that exceeds 3 % of total assets."""
    new = moves.where((F.coalesce("total_assets", F.lit(0.0)) != 0) & F.col("prior").isNull() & (F.col("current") != 0) & (F.col("current") > F.col("total_assets") * 0.03))
    evidence = F.struct(F.col("key").alias("item"), "current", (F.col("current") / F.col("total_assets") * 100).alias("pct_of_assets"))
    reason = F.concat("key", F.lit(" appears for first time and exceeds 3% of total assets"))
    return _per_item(new, 10, F.concat(F.lit("FIRST_OCCURRENCE_"), F.upper("key")), "New Significant Item", F.lit("High"), evidence, F.array().cast("array<string>"), "first-time recognition disclosure Ind AS", reason)


def material_movements(moves: DataFrame) -> DataFrame:
    """Any other key that moves beyond the threshold of the company's size."""
    from pyspark.sql import Window

    own = Window.partitionBy("doc_id")
    capital, turnover = (F.max(F.when(F.col("key") == k, F.col("current"))).over(own) for k in ("share_capital", "revenue_from_operations"))
    sized = moves.withColumn("small", capital.isNull() | turnover.isNull() | ((capital <= SMALL_CAPITAL) & (turnover <= SMALL_TURNOVER)))
    size = F.abs("pct_change")
    threshold = F.when(F.col("small"), 15.0).otherwise(20.0)
    basis = F.when(F.col("small"), "smaller").otherwise("bigger")
    hit = sized.where((F.coalesce("total_assets", F.lit(0.0)) != 0) & ~F.col("key").isin(*COVERED) & ~F.col("key").startswith("total_") & (F.col("materiality_pct") > 0.5) & (size >= threshold))
    evidence = F.struct(F.col("key").alias("item"), "display_label", "current", "prior", "pct_change", threshold.alias("threshold_used"), basis.alias("company_size_basis"))
    notes = F.when(F.coalesce("note_ref", F.lit("")) != "", F.array("note_ref")).otherwise(F.array().cast("array<string>"))
    reason = F.concat("key", F.lit(" moved "), shown(size, "#0.0"), F.lit("% year-over-year, exceeding the "), shown(threshold, "#0"), F.lit("% threshold for a "), basis, F.lit(" company"))
    severity = F.when(size >= 80, "High").when(size >= 50, "Medium").otherwise("Low")
    return _per_item(hit, 50, F.concat(F.lit("MATERIAL_MOVEMENT_"), F.upper("key")), "Material Line Item Movement", severity, evidence, notes, "analytical procedures significant fluctuations unusual variance SA 520", reason)


def consistency_flags(facts: DataFrame) -> DataFrame:
    """Flags across notes and over whole texts. facts: doc_id and any of CONSISTENCY_FACTS."""
    full = _filled(facts, CONSISTENCY_FACTS)
    text = F.coalesce("full_text", F.lit(""))
    read = full.withColumns({"full_text": text, "cins": distinct_cins(text), "audit_trail": audit_trail_excerpt(text), "emphasis": emphasis(text), "cash_flow_years": cash_flow_years(text)})
    return _unnested(read, [*enumerate(CONSISTENCY, 60)])
