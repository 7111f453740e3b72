"""Queries over the driver's tables, one or more for each operator, and their DuckDB SQL.

The driver's tables hold no filings, so each query derives a small document model from them by SQL that both engines read
alike; the operator then runs on that, whole tables always.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vocabulary import DISPLAY
from ..operators import analytics, mapping, narrate, notes, pages as pages_ops, report, retrieval, rules, tables as tables_ops
from ..sources import writers

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Keys that the derived line items take in turn.
_KEYS = (
    "cash_equivalents", "trade_receivables", "inventories", "total_current_assets", "total_assets", "share_capital", "total_equity", "borrowings_current", "borrowings_non_current", "trade_payables_mse",
    "trade_payables_others", "total_current_liabilities", "revenue_from_operations", "cost_of_services", "finance_costs", "pbt", "pat", "cfo", "roa_net", "other_financial_assets_current",
    "total_non_current_liabilities", "tax_prior_years", "current_tax", "share_of_jv_profit", "other_expenses",
)
_CASE = "CASE o_orderkey % 26 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS)) + " END"
#: Line items: a document for each 97th part of the customers; amounts are whole numbers that vary by key.
ITEMS = f"""SELECT CAST(o_custkey % 97 AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS item_idx, concat('item ', CAST(o_orderkey AS STRING)) AS raw_label, {_CASE} AS canonical_key,
 CASE WHEN o_orderkey % 11 <> 3 THEN CAST((o_orderkey * 7919) % 9973 + CASE WHEN o_orderkey % 26 = 4 THEN 60000 ELSE 0 END AS DOUBLE) END AS current_value,
 CASE WHEN o_orderkey % 7 <> 5 THEN CAST((o_orderkey * 104729) % 9941 - 500 AS DOUBLE) END AS prior_value,
 CAST((o_orderkey % 5) AS DOUBLE) / 8 + 0.25 AS confidence,
 CASE o_orderkey % 5 WHEN 0 THEN 'exact' WHEN 1 THEN 'fuzzy' WHEN 2 THEN 'structural' WHEN 3 THEN 'embedding' ELSE 'unknown' END AS method,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 40 AS STRING) END AS note_ref FROM orders"""


def _views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _derived(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """The SQL over the named tables, without touching the session's catalog."""
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", sql), **_views(spark, sf_dir, *names))


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = re.sub(r"\barray\(", "list_value(", sql.replace("AS STRING)", "AS VARCHAR)"))
        return f

    return register


def _items(spark, sf_dir):
    return _derived(spark, sf_dir, ITEMS, "orders")


def _moves(spark, sf_dir):
    return analytics.movements(analytics.best_items(_items(spark, sf_dir)))


_BEST = f"""items AS ({ITEMS}), ranked AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id, canonical_key ORDER BY (current_value IS NOT NULL) DESC, (current_value IS NOT NULL AND prior_value IS NOT NULL) DESC,
  CASE method WHEN 'exact' THEN 3 WHEN 'structural' THEN 2 WHEN 'fuzzy' THEN 2 WHEN 'embedding' THEN 1 ELSE 0 END DESC, confidence DESC, item_idx) AS rn,
  min(item_idx) OVER (PARTITION BY doc_id, canonical_key) AS key_ord FROM items WHERE canonical_key IS NOT NULL),
best AS (SELECT * FROM ranked WHERE rn = 1)"""
_DISPLAY = "CASE canonical_key " + " ".join(f"WHEN '{k}' THEN '{DISPLAY[k]}'" for k in _KEYS) + " END"
_MOVES = f"""{_BEST}, ta AS (SELECT doc_id, max(current_value) AS total_assets FROM best WHERE canonical_key = 'total_assets' GROUP BY doc_id),
moves AS (SELECT b.doc_id, b.key_ord, canonical_key AS key, {_DISPLAY} AS display_label, current_value AS current, prior_value AS prior, current_value - prior_value AS absolute_change,
 CASE WHEN prior_value <> 0 THEN (current_value - prior_value) / abs(prior_value) * 100 END AS pct_change, CASE WHEN total_assets <> 0 THEN current_value / total_assets * 100 END AS materiality_pct, note_ref, total_assets
 FROM best b LEFT JOIN ta ON b.doc_id = ta.doc_id WHERE current_value IS NOT NULL OR prior_value IS NOT NULL)"""


@_query("best_item_argmax", f"WITH {_BEST} SELECT doc_id, canonical_key, key_ord, item_idx, raw_label, current_value, prior_value, confidence, method, note_ref FROM best")
def best_item_argmax(spark, sf_dir):
    return analytics.best_items(_items(spark, sf_dir))


_ROUNDED = "doc_id, key, display_label, current, prior, absolute_change, round(pct_change, 6) AS pct_change, round(materiality_pct, 6) AS materiality_pct, note_ref"


@_query("movements", f"WITH {_MOVES} SELECT {_ROUNDED} FROM moves")
def movements(spark, sf_dir):
    return _moves(spark, sf_dir).selectExpr("doc_id", "key", "display_label", "current", "prior", "absolute_change", "round(pct_change, 6) AS pct_change", "round(materiality_pct, 6) AS materiality_pct", "note_ref")


def _revenue(by: str, join: str) -> str:
    return f"""WITH r AS (SELECT {by} AS doc_id, sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS c, sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(round(o_totalprice * 100) AS BIGINT) END) AS p FROM orders {join} GROUP BY {by})
SELECT doc_id, CAST(c AS DOUBLE) / 100 AS current, CAST(p AS DOUBLE) / 100 AS prior, round((CAST(c AS DOUBLE) - CAST(p AS DOUBLE)) / abs(nullif(CAST(p AS DOUBLE), 0)) * 100, 6) AS pct_change FROM r WHERE c IS NOT NULL OR p IS NOT NULL"""


def _revenue_moves(spark, sf_dir, key: str) -> DataFrame:
    t = _views(spark, sf_dir, "orders", "customer", "nation")
    sold = t["orders"].join(t["customer"], t["orders"].o_custkey == t["customer"].c_custkey).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    year = lambda y: F.sum(F.when(F.year("o_orderdate") == y, cents)).cast("double") / 100
    best = sold.groupBy(F.col(key).alias("doc_id")).agg(year(1997).alias("current_value"), year(1996).alias("prior_value"))
    best = best.withColumns({"canonical_key": F.lit("revenue_from_operations"), "key_ord": F.lit(0), "note_ref": F.lit(None).cast("string")})
    return analytics.movements(best).select("doc_id", "current", "prior", F.round("pct_change", 6).alias("pct_change"))


_CUSTOMER, _NATION = "JOIN customer ON o_custkey = c_custkey", "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


@_query("movements_by_nation", _revenue("n_name", _NATION))
def movements_by_nation(spark, sf_dir):
    return _revenue_moves(spark, sf_dir, "n_name")


@_query("movements_by_segment", _revenue("c_mktsegment", _NATION))
def movements_by_segment(spark, sf_dir):
    return _revenue_moves(spark, sf_dir, "c_mktsegment")


def _ratio_sql(s: str) -> str:
    v = lambda k: f"max(CASE WHEN canonical_key = '{k}' THEN {s}_value END)"
    one = lambda a, b: f"CASE WHEN {v(a)} IS NOT NULL OR {v(b)} IS NOT NULL THEN coalesce({v(a)}, 0) + coalesce({v(b)}, 0) END"
    ebit, capital = f"({v('pbt')} + {v('finance_costs')})", f"({v('total_assets')} - {v('total_current_liabilities')})"
    cells = [
        (v("total_current_assets"), v("total_current_liabilities"), 1), (f"({v('total_current_assets')} - {v('inventories')})", v("total_current_liabilities"), 1), (one("borrowings_current", "borrowings_non_current"), v("total_equity"), 1),
        (ebit, v("finance_costs"), 1), (v("trade_receivables"), v("revenue_from_operations"), 365), (one("trade_payables_mse", "trade_payables_others"), v("cost_of_services"), 365), (v("pat"), v("revenue_from_operations"), 100), (ebit, capital, 100), (v("cfo"), v("pat"), 1),
    ]
    return ", ".join(f"round({a} / nullif({b}, 0) * {m}, 6) AS {n}_{s}" for (a, b, m), n in zip(cells, analytics.RATIOS, strict=True))


@_query("ratios", f"WITH {_BEST}, wide AS (SELECT doc_id, {_ratio_sql('current')}, {_ratio_sql('prior')} FROM best GROUP BY doc_id) " + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS ratio, {r}_current AS current, {r}_prior AS prior FROM wide" for r in analytics.RATIOS))
def ratios(spark, sf_dir):
    found = analytics.ratios(analytics.best_items(_items(spark, sf_dir)))
    return found.select("doc_id", "ratio", F.round("current", 6).alias("current"), F.round("prior", 6).alias("prior"))


#: Facts beside the movements, one row a document.
FACTS = """SELECT DISTINCT CAST(o_custkey % 97 AS BIGINT) AS doc_id, CAST(o_custkey % 97 * 31 % 300 AS DOUBLE) AS a, CASE WHEN o_custkey % 97 % 4 <> 1 THEN CAST(o_custkey % 97 * 17 % 211 AS DOUBLE) END AS b,
 CAST(o_custkey % 97 * 13 % 9 AS DOUBLE) / 4 AS c FROM orders"""


def _facts(spark, sf_dir) -> DataFrame:
    """Each record of the rules from the plain facts a, b, c."""
    f = _derived(spark, sf_dir, FACTS, "orders")
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    project = F.struct(F.lit("Plant").alias("project_name"), F.when(a % 2 == 0, "more_than_3_years").otherwise("1_to_2_years").alias("age_bucket"), (c - 1).alias("amount"))
    return f.select(
        "doc_id",
        F.struct(F.lit(1.0).alias("income_tax"), F.lit(2.0).alias("service_tax"), F.lit(3.0).alias("gst"), F.lit(4.0).alias("others"), (a * 10).alias("total"), (b * 8).alias("total_prior")).alias("contingent"),
        F.struct(a.alias("obligation"), (a / 2).alias("amount_spent"), (b - 20).alias("amount_unspent")).alias("csr"),
        F.struct(a.alias("principal_unpaid"), b.alias("interest_unpaid"), (c - 1).alias("interest_accrued_unpaid"), c.alias("interest_further_due")).alias("msmed"),
        F.struct((c + 6).alias("discount_rate_current"), F.lit(7.0).alias("discount_rate_prior")).alias("actuarial"),
        F.array(project).alias("cwip"), F.when(a > 150, F.lit("An Unpaid Dividend of 12")).otherwise("Cash").alias("note_7f"),
    )


def _flags(spark, sf_dir) -> DataFrame:
    return rules.flags(_moves(spark, sf_dir), _facts(spark, sf_dir))


def _mv(key: str, field: str) -> str:
    return f"max(CASE WHEN key = '{key}' THEN {field} END)"


_W = ", ".join(f"{_mv(k, f)} AS {k}_{s}" for k in _KEYS for f, s in (("current", "c"), ("pct_change", "p"), ("materiality_pct", "m")))
_ONE = [
    ("CASH_DECLINE", "High", "cash_equivalents_p < -40 AND cash_equivalents_m > 0.5"), ("CFO_PAT_DIVERGENCE", "High", "pat_c > 0 AND cfo_c < pat_c * 0.6"), ("ROU_MATERIAL_INCREASE", "High", "roa_net_p > 100 AND roa_net_m > 2"),
    ("CONTINGENT_LIABILITY_JUMP", "High", "total_equity_c <> 0 AND (coalesce(a * 10 - b * 8 > total_equity_c * 0.05, false) OR a * 10 / total_equity_c * 100 > 25)"), ("OTHER_FIN_ASSETS_SURGE", "High", "other_financial_assets_current_p > 80 AND other_financial_assets_current_m > 5"),
    ("NON_CURRENT_LIABILITIES_SURGE", "Medium", "total_non_current_liabilities_p > 50 AND total_non_current_liabilities_m > 5"), ("RECEIVABLES_REVENUE_MISMATCH", "Medium", "abs(trade_receivables_p - revenue_from_operations_p) > 20"), ("MSE_PAYABLES_INCREASE", "Medium", "trade_payables_mse_p > 40"),
    ("PRIOR_YEAR_TAX_MATERIAL", "Medium", "tax_prior_years_c <> 0 AND current_tax_c <> 0 AND abs(tax_prior_years_c) > abs(current_tax_c) * 0.4"), ("JV_PROFIT_DECLINE", "Medium", "share_of_jv_profit_p < -25"), ("CSR_UNSPENT", "Medium", "b - 20 > 0"), ("MSME_INTEREST_ACCRUED", "Medium", "c - 1 > 0"),
    ("TRADE_PAYABLES_REDUCTION", "Medium", "trade_payables_others_p < -25 AND trade_payables_others_m > 3"), ("ACTUARIAL_RATE_CHANGE", "Low", "abs(c + 6 - 7) > 0.3"), ("CWIP_OVERDUE", "Low", "a % 2 = 0 AND c - 1 > 0"), ("UNPAID_DIVIDEND", "Low", "a > 150"),
]
_COVERED = ", ".join(f"'{k}'" for k in rules.COVERED)
_SMALL = f"(share_capital_c IS NULL OR revenue_from_operations_c IS NULL OR (share_capital_c <= {rules.SMALL_CAPITAL} AND revenue_from_operations_c <= {rules.SMALL_TURNOVER}))"
_FLAGS = (
    f"{_MOVES}, w AS (SELECT doc_id, {_W} FROM moves GROUP BY doc_id), wide AS (SELECT f.*, w.* EXCLUDE (doc_id) FROM ({FACTS}) f LEFT JOIN w ON f.doc_id = w.doc_id), flags AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{i}' AS flag_id, '{s}' AS severity, '' AS key FROM wide WHERE {p}" for i, s, p in _ONE)
    + " UNION ALL SELECT doc_id, 'FIRST_OCCURRENCE_' || upper(key), 'High', key FROM moves WHERE total_assets <> 0 AND prior IS NULL AND current <> 0 AND current > total_assets * 0.03"
    + f""" UNION ALL SELECT m.doc_id, 'MATERIAL_MOVEMENT_' || upper(key), CASE WHEN abs(pct_change) >= 80 THEN 'High' WHEN abs(pct_change) >= 50 THEN 'Medium' ELSE 'Low' END, key FROM moves m JOIN wide USING (doc_id)
 WHERE total_assets <> 0 AND key NOT IN ({_COVERED}) AND key NOT LIKE 'total\\_%' ESCAPE '\\' AND materiality_pct > 0.5 AND abs(pct_change) >= CASE WHEN {_SMALL} THEN 15 ELSE 20 END)"""
)


@_query("flags", f"WITH {_FLAGS} SELECT doc_id, flag_id, severity FROM flags")
def flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("doc_id", "flag_id", "severity")


def _one_flag(flag_id: str) -> None:
    exact = not flag_id.endswith("_")
    where = f"flag_id = '{flag_id}'" if exact else f"starts_with(flag_id, '{flag_id}')"

    @_query(f"flags_{flag_id.lower().rstrip('_')}", f"WITH {_FLAGS} SELECT doc_id, flag_id, severity FROM flags WHERE {where}")
    def query(spark, sf_dir):
        hit = F.col("flag_id") == flag_id if exact else F.col("flag_id").startswith(flag_id)
        return flags(spark, sf_dir).where(hit)


for _id in [i for i, _, _ in _ONE] + ["FIRST_OCCURRENCE_", "MATERIAL_MOVEMENT_"]:
    _one_flag(_id)


@_query("severity_counts", f"WITH {_FLAGS} SELECT doc_id, count(*) FILTER (WHERE severity = 'High') AS high, count(*) FILTER (WHERE severity = 'Medium') AS medium, count(*) FILTER (WHERE severity = 'Low') AS low, count(*) AS total FROM flags GROUP BY doc_id")
def severity_counts(spark, sf_dir):
    return analytics.severity_counts(_flags(spark, sf_dir))


@_query("mapped_share", f"SELECT doc_id, count(canonical_key) AS mapped, count(*) AS items FROM ({ITEMS}) GROUP BY doc_id")
def mapped_share(spark, sf_dir):
    return analytics.mapped_share(_items(spark, sf_dir))


def _area_sql() -> str:
    known = {r.flag_id: r.area for r in [*rules.HIGH, *rules.MEDIUM, *rules.LOW]}
    quote = lambda s: s.replace("'", "''")
    return "CASE " + " ".join(f"WHEN flag_id = '{i}' THEN '{quote(a)}'" for i, a in known.items()) + " WHEN starts_with(flag_id, 'FIRST_') THEN 'New Significant Item' ELSE 'Material Line Item Movement' END"


_SUMMARY = f"{_FLAGS}, areas AS (SELECT doc_id, severity AS rating, {_area_sql()} AS area FROM flags), summary AS (SELECT d.doc_id, r.rating, count(a.area) AS count, coalesce(string_agg(DISTINCT a.area, ', ' ORDER BY a.area), '-') AS areas FROM (SELECT DISTINCT doc_id FROM areas) d CROSS JOIN (VALUES ('High'), ('Medium'), ('Low')) r(rating) LEFT JOIN areas a ON a.doc_id = d.doc_id AND a.rating = r.rating GROUP BY d.doc_id, r.rating)"


def _observed(spark, sf_dir) -> DataFrame:
    return narrate.observations(_flags(spark, sf_dir))


@_query("report_summary", f"WITH {_SUMMARY} SELECT doc_id, rating, count, areas FROM summary")
def report_summary(spark, sf_dir):
    return report.summary(_observed(spark, sf_dir)).select("doc_id", "rating", "count", "areas")


@_query("risk_chart", f"WITH {_SUMMARY} SELECT doc_id, rating, count FROM summary WHERE count > 0")
def risk_chart(spark, sf_dir):
    return report.risk_chart(report.summary(_observed(spark, sf_dir))).select("doc_id", "rating", "count")


@_query("next_steps", f"""WITH {_SUMMARY} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS number, step FROM (
 SELECT doc_id, 1 AS o, 'Prioritize closing the ' || count || ' High-risk item(s) above (' || areas || ') — obtain the corroborating evidence listed in the Recommendation column before forming an audit opinion.' AS step FROM summary WHERE rating = 'High' AND count > 0
 UNION ALL SELECT doc_id, 2, 'Follow up on the ' || count || ' Medium-risk item(s) (' || areas || ') during fieldwork and document resolution in the working paper file.' FROM summary WHERE rating = 'Medium' AND count > 0
 UNION ALL SELECT doc_id, 3, 'Cross-reference each resolved observation to its note reference (Section 3) and retain the supporting documentation obtained as audit evidence.' FROM summary WHERE rating = 'High')""")
def next_steps(spark, sf_dir):
    return report.next_steps(report.summary(_observed(spark, sf_dir)))


@_query("observation_order", f"WITH {_FLAGS} SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE severity = 'High') AS last_high FROM flags GROUP BY doc_id")
def observation_order(spark, sf_dir):
    seen = _observed(spark, sf_dir)
    return seen.groupBy("doc_id").agg(F.max("number").cast("long").alias("n"), F.coalesce(F.max(F.when(F.col("rating") == "High", F.col("number"))), F.lit(0)).cast("long").alias("last_high"))


@_query("flags_json")
def flags_json(spark, sf_dir):
    return report.flags_json(_flags(spark, sf_dir))


_CASH_TEXT = "'Cash and cash equivalents declined by ' || printf('%.2f', abs(pct_change)) || '% from ₹' || {p} || ' lakh to ₹' || {c} || ' lakh, a decline material to the company''s total assets.'"


def _grouped(x: str) -> str:
    """Lakh grouping of a rounded number in SQL (no look-ahead there)."""
    d = f"CAST(CAST(round_even(abs({x}), 0) AS BIGINT) AS VARCHAR)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CASE WHEN length({d}) <= 3 THEN {d} WHEN length({d}) <= 5 THEN left({d}, length({d}) - 3) || ',' || right({d}, 3) WHEN length({d}) <= 7 THEN left({d}, length({d}) - 5) || ',' || substr({d}, length({d}) - 4, 2) || ',' || right({d}, 3) ELSE left({d}, length({d}) - 7) || ',' || substr({d}, length({d}) - 6, 2) || ',' || substr({d}, length({d}) - 4, 2) || ',' || right({d}, 3) END)"


@_query("template_cash_decline", f"WITH {_MOVES} SELECT doc_id, {_CASH_TEXT.format(p=_grouped('prior'), c=_grouped('current'))} AS observation FROM moves WHERE key = 'cash_equivalents' AND pct_change < -40 AND materiality_pct > 0.5")
def template_cash_decline(spark, sf_dir):
    return narrate.templated(_flags(spark, sf_dir)).where("flag_id = 'CASH_DECLINE'").select("doc_id", "observation")


@_query("key_movements", f"WITH {_MOVES} SELECT doc_id, key, round(pct_change, 6) AS pct_change FROM moves WHERE abs(pct_change) > 10")
def key_movements(spark, sf_dir):
    return report.key_movements(_moves(spark, sf_dir)).select("doc_id", "key", F.round("pct_change", 6).alias("pct_change"))


@_query("movement_chart_top12", f"WITH {_MOVES}, r AS (SELECT doc_id, key, pct_change, row_number() OVER (PARTITION BY doc_id ORDER BY abs(pct_change) DESC, key_ord) AS rank FROM moves WHERE pct_change IS NOT NULL) SELECT doc_id, key, round(pct_change, 6) AS pct_change, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12")
def movement_chart_top12(spark, sf_dir):
    return report.movement_chart(_moves(spark, sf_dir)).select("doc_id", "key", F.round("pct_change", 6).alias("pct_change"), "rank")


#: Consistency facts and texts, a document for each order of a customer's hundredth.
CHECKS = """SELECT CAST(o_orderkey AS BIGINT) AS doc_id, CAST(o_orderkey % 50 AS DOUBLE) AS a, CASE WHEN o_orderkey % 6 <> 2 THEN CAST(o_orderkey % 53 AS DOUBLE) END AS b,
 concat('Report ', o_orderpriority, CASE o_orderkey % 8 WHEN 0 THEN ' Cash  Flow Statement for 31 March 2025 and 31 March 2025' WHEN 1 THEN ' cash flow statement 31 March 2025, 31 March 2024' WHEN 2 THEN ' Emphasis of Matter we draw' WHEN 3 THEN ' Material Uncertainty related to going concern'
 WHEN 4 THEN ' the audit trail was not been enabled' WHEN 5 THEN ' the audit trail has operated' WHEN 6 THEN ' L12345MH1999PLC123456 and U12345MH1999PLC654321' ELSE ' L12345MH1999PLC123456 related party U12345MH1999PLC654321' END) AS full_text FROM orders"""
_CONSISTENT = " UNION ALL ".join(
    f"SELECT doc_id, '{i}' AS flag_id, {s} AS severity FROM f WHERE {p}"
    for i, s, p in (
        ("XNOTE_CSR_BANK_MISMATCH", "'Low'", "abs(a - b) > 1"), ("XNOTE_LEASE_ROU_MISMATCH", "'Medium'", "a <> 0 AND b > 0 AND abs(a - b) / nullif(b, 0) * 100 > 15"), ("TAX_RECONCILIATION_ERROR", "'High'", "abs(a + b + 1 - 60) > 1"),
        ("CASHFLOW_HEADER_ERROR", "'Low'", "doc_id % 8 = 0"), ("MULTI_ENTITY_DOCUMENT", "'High'", "doc_id % 8 = 6"), ("AUDIT_TRAIL_LAPSE", "'Medium'", "doc_id % 8 = 4"), ("AUDITOR_EMPHASIS_PARAGRAPH", "CASE WHEN doc_id % 8 = 3 THEN 'High' ELSE 'Medium' END", "doc_id % 8 IN (2, 3)"),
    )
)


def _checks(spark, sf_dir) -> DataFrame:
    f = _derived(spark, sf_dir, CHECKS, "orders")
    a, b = F.col("a"), F.col("b")
    csr = F.struct(a.alias("obligation"), a.alias("amount_spent"), a.alias("amount_unspent"))
    return f.select("doc_id", "full_text", csr.alias("csr"), b.alias("restricted_balance"), a.alias("lease_total"), b.alias("rou_additions"), a.alias("tax_current"), b.alias("tax_prior"), F.lit(1.0).alias("tax_deferred"), F.lit(60.0).alias("tax_total"))


@_query("consistency_flags", f"WITH f AS ({CHECKS}) {_CONSISTENT}")
def consistency_flags(spark, sf_dir):
    return rules.consistency_flags(_checks(spark, sf_dir)).select("doc_id", "flag_id", "severity")


@_query("format_indian_number", f"SELECT CAST(o_orderkey AS BIGINT) AS id, {_grouped('x')} AS shown FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey * 7919 AS DOUBLE) / 2 AS x FROM orders)")
def format_indian_number(spark, sf_dir):
    x = _derived(spark, sf_dir, "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END * CAST(o_orderkey * 7919 AS DOUBLE) / 2 AS x FROM orders", "orders")
    return x.select("id", X.format_indian_number(F.col("x")).alias("shown"))


#: Labels with the noise that extraction leaves, from parts.
LABELS = """SELECT CAST(p_partkey AS BIGINT) AS id, CASE p_partkey % 6 WHEN 0 THEN concat('  Trade Receivables (', CAST(p_partkey % 40 AS STRING), '):') WHEN 1 THEN concat('Total Assets 2a 7.96 ', CAST(p_partkey AS STRING)) WHEN 2 THEN 'Dues of micro enterprises payable' WHEN 3 THEN 'Creditors other than micro'
 WHEN 4 THEN concat('Inventories [net]  note ', CAST(p_partkey % 40 AS STRING)) ELSE 'Trade recievables :' END AS label FROM part"""


@_query("map_labels", f"SELECT id, CASE id % 6 WHEN 0 THEN 'trade_receivables' WHEN 1 THEN 'total_assets' WHEN 2 THEN 'trade_payables_mse' WHEN 3 THEN 'trade_payables_others' WHEN 4 THEN 'inventories' ELSE 'trade_receivables' END AS canonical_key, CASE WHEN id % 6 < 4 THEN 'exact' ELSE 'fuzzy' END AS method, CAST(CASE WHEN id % 6 < 4 THEN 1 WHEN id % 6 = 4 THEN 0.95 ELSE 0.941176 END AS DOUBLE) AS confidence FROM ({LABELS})")
def map_labels(spark, sf_dir):
    labels = _derived(spark, sf_dir, LABELS, "part").withColumnRenamed("label", "raw_label")
    return labels.join(mapping.map_labels(labels), "raw_label").select("id", "canonical_key", "method", F.round("confidence", 6).alias("confidence"))


@_query("fuzzy_map")
def fuzzy_map(spark, sf_dir):
    labels = _views(spark, sf_dir, "part")["part"].select(F.col("p_name").alias("raw_label"))
    return mapping.map_labels(labels)


_GUARD = """SELECT CAST(o_orderkey AS BIGINT) AS id, CASE o_orderkey % 4 WHEN 0 THEN 'total_assets' WHEN 1 THEN 'pat' WHEN 2 THEN 'cfo' END AS canonical_key, CASE o_orderkey % 3 WHEN 0 THEN 'balance_sheet' WHEN 1 THEN 'cash_flow' ELSE 'unknown' END AS sheet_type, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS method FROM orders"""
_TYPE = "CASE canonical_key WHEN 'total_assets' THEN 'balance_sheet' WHEN 'pat' THEN 'pnl' WHEN 'cfo' THEN 'cash_flow' END"


@_query("statement_guard", f"SELECT id, CASE WHEN sheet_type = 'unknown' OR {_TYPE} = sheet_type THEN canonical_key END AS canonical_key, CASE WHEN canonical_key IS NOT NULL AND sheet_type <> 'unknown' AND {_TYPE} <> sheet_type THEN 'unknown' ELSE method END AS method FROM ({_GUARD})")
def statement_guard(spark, sf_dir):
    return mapping.guard_statement(_derived(spark, sf_dir, _GUARD, "orders")).select("id", "canonical_key", "method")


_TOTALS = """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS row_ord, CASE WHEN (l_partkey + l_linenumber) % 3 = 0 THEN 'Total' ELSE 'x' END AS raw_label, CASE WHEN (l_partkey + l_linenumber) % 3 <> 0 THEN 'inventories' END AS canonical_key, CAST(0.0 AS DOUBLE) AS confidence, 'unknown' AS method FROM lineitem"""


@_query("structural_total", f"WITH t AS ({_TOTALS}), w AS (SELECT *, count(canonical_key) OVER (PARTITION BY doc_id) AS n, min(CASE WHEN canonical_key IS NULL AND raw_label = 'Total' THEN row_ord END) OVER (PARTITION BY doc_id) AS f FROM t) SELECT doc_id, row_ord, CASE WHEN n >= 3 AND canonical_key IS NULL AND row_ord = f THEN 'total_assets' ELSE canonical_key END AS canonical_key FROM w")
def structural_total(spark, sf_dir):
    return mapping.structural_total(_derived(spark, sf_dir, _TOTALS, "lineitem"), ["doc_id"]).select("doc_id", "row_ord", "canonical_key")


_PAGES = "SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS page_num, coalesce(text, '') AS raw_text FROM conversations"
_OFFSETS = f"placed AS (SELECT doc_id, page_num, CAST(coalesce(sum(length(raw_text) + 1) OVER (PARTITION BY doc_id ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(raw_text) AS n FROM ({_PAGES}))"


def _pages(spark, sf_dir):
    return _derived(spark, sf_dir, _PAGES, "conversations")


@_query("page_offsets", f'WITH {_OFFSETS} SELECT doc_id, page_num, start, start + n AS "end" FROM placed')
def page_offsets(spark, sf_dir):
    return pages_ops.page_offsets(_pages(spark, sf_dir)).select("doc_id", "page_num", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@_query("offset_to_page", f"WITH {_OFFSETS}, o AS (SELECT doc_id, page_num AS k, start + page_num * 37 AS off FROM placed) SELECT o.doc_id, o.k, coalesce(min(CASE WHEN off BETWEEN start AND start + n THEN page_num END), max(page_num)) AS page FROM o JOIN placed USING (doc_id) GROUP BY o.doc_id, o.k, off")
def offset_to_page(spark, sf_dir):
    placed = pages_ops.page_offsets(_pages(spark, sf_dir))
    offsets = placed.select("doc_id", F.col("page_num").alias("k"), (F.col("start") + F.col("page_num") * 37).alias("off"))
    return pages_ops.offsets_to_pages(offsets, placed, ["k"], "off", "page").select("doc_id", "k", "page")


@_query("note_pages_antijoin", f"SELECT doc_id, page_num FROM ({_PAGES}) WHERE NOT (page_num BETWEEN doc_id % 3 AND doc_id % 3 + 1)")
def note_pages_antijoin(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    spans = pages.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 3).cast("int").alias("page_start"), (F.col("doc_id") % 3 + 1).cast("int").alias("page_end"))
    return pages_ops.uncovered_pages(pages, spans).select("doc_id", "page_num")


@_query("word_chunks_375_75", """WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\s]+'), lambda x: x <> '') AS w FROM documents), i AS (SELECT doc_id, w, unnest(range(0, 1 + CAST(greatest(ceil((len(w) - 375) / 300.0), 0) AS BIGINT))) AS i FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, md5(array_to_string(list_slice(w, i * 300 + 1, i * 300 + 375), ' ')) AS chunk FROM i""")
def word_chunks_375_75(spark, sf_dir):
    docs = _views(spark, sf_dir, "documents")["documents"]
    return docs.select("doc_id", F.posexplode(pages_ops.word_chunks(F.coalesce("text", F.lit("")))).alias("chunk_index", "chunk")).withColumn("chunk", F.md5("chunk"))


_NOTES = """SELECT CAST(o_custkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS block_ord, CAST(o_orderkey % 3 AS STRING) AS note_id, concat('Note ', CAST(o_orderkey AS STRING)) AS full_id, concat('title ', CAST(o_orderkey AS STRING)) AS title,
 concat('text ', CAST(o_orderkey AS STRING)) AS raw_text, CAST(o_orderkey % 7 AS INT) AS page_start, CAST(o_orderkey % 7 + o_orderkey % 2 AS INT) AS page_end FROM orders"""


@_query("note_merge_duplicates", f"SELECT doc_id, note_id, min(block_ord) AS note_ord, arg_min(full_id, block_ord) AS full_id, arg_min(title, block_ord) AS title, string_agg(raw_text, chr(10) ORDER BY block_ord) AS raw_text, arg_min(page_start, block_ord) AS page_start, max(page_end) AS page_end FROM ({_NOTES}) GROUP BY doc_id, note_id")
def note_merge_duplicates(spark, sf_dir):
    return notes.merge_blocks(_derived(spark, sf_dir, _NOTES, "orders"))


_NOTE_DOCS = """SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS page_num, concat('Note ', CAST(turn + 1 AS STRING), ': Heading of turn
', replace(coalesce(text, ''), 'Note', 'note'), ' refer note no. ', CAST(turn + 2 AS STRING), ' and as per note ', CAST(turn AS STRING), '.') AS raw_text FROM conversations"""


def _found_notes(spark, sf_dir) -> DataFrame:
    return notes.notes(_derived(spark, sf_dir, _NOTE_DOCS, "conversations"))


@_query("notes_segmented")
def notes_segmented(spark, sf_dir):
    return _found_notes(spark, sf_dir)


_EDGES = "known AS (SELECT DISTINCT CAST(conv_id AS BIGINT) AS doc_id, turn + 1 AS n FROM conversations), e AS (SELECT a.doc_id, a.n AS s, b.n AS d FROM known a JOIN known b ON a.doc_id = b.doc_id AND (b.n = a.n + 1 OR b.n = a.n - 1))"


@_query("xref_edges", f"WITH {_EDGES} SELECT doc_id, CAST(s AS VARCHAR) AS src, CAST(d AS VARCHAR) AS dst FROM e")
def xref_edges(spark, sf_dir):
    return notes.references(_found_notes(spark, sf_dir)).select("doc_id", "src", "dst")


@_query("xref_counts", f"WITH {_EDGES} SELECT k.doc_id, count(DISTINCT n) AS nodes, count(DISTINCT (s, d)) AS edges FROM known k LEFT JOIN e ON e.doc_id = k.doc_id GROUP BY k.doc_id")
def xref_counts(spark, sf_dir):
    found = _found_notes(spark, sf_dir)
    return notes.graph_counts(found, notes.references(found))


@_query("xref_resolved")
def xref_resolved(spark, sf_dir):
    found = _found_notes(spark, sf_dir)
    return notes.resolved_texts(found, notes.references(found))


_CELL = "SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(0 AS INT) AS sheet_ord, CAST(l_linenumber AS INT) AS row_ord, CAST(l_partkey % 3 AS INT) AS col_ord, max(CAST(l_suppkey AS BIGINT)) AS value FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey % 3"


@_query("merged_cells_fill", f"WITH c AS ({_CELL}), t AS (SELECT doc_id, value AS top FROM c WHERE row_ord = 1 AND col_ord = 0) SELECT c.doc_id, c.row_ord, c.col_ord, CASE WHEN c.row_ord BETWEEN 1 AND 3 AND c.col_ord BETWEEN 0 AND 1 THEN coalesce(t.top, c.value) ELSE c.value END AS value FROM c LEFT JOIN t ON t.doc_id = c.doc_id")
def merged_cells_fill(spark, sf_dir):
    cells = _derived(spark, sf_dir, _CELL, "lineitem")
    ranges = cells.select("doc_id", "sheet_ord").distinct().select("doc_id", "sheet_ord", F.lit(1).alias("min_row"), F.lit(3).alias("max_row"), F.lit(0).alias("min_col"), F.lit(1).alias("max_col"))
    return tables_ops.fill_merged(cells, ranges).select("doc_id", "row_ord", "col_ord", "value")


_PAGED = """SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS page_num, CAST(0 AS INT) AS table_ord, array('h', CAST(conv_id % 2 AS STRING)) AS headers, array(array(CAST(turn AS STRING))) AS rows FROM conversations"""


@_query("multipage_merge", "WITH p AS (SELECT conv_id AS doc_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations), q AS (SELECT doc_id, turn, row_number() OVER (PARTITION BY doc_id, g ORDER BY turn) - 1 AS k, g FROM p) SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(min(turn) AS INTEGER) AS page_num, CAST(count(*) AS INTEGER) AS n_rows FROM q GROUP BY doc_id, g, k // 2")
def multipage_merge(spark, sf_dir):
    return tables_ops.merge_across_pages(_derived(spark, sf_dir, _PAGED, "conversations")).select("doc_id", "page_num", F.size("rows").alias("n_rows"))


_KNN = """WITH q AS (SELECT vec_id AS query, embedding AS v FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query, e.vec_id AS chunk_index, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(e.embedding[i] AS DOUBLE) - CAST(q.v[i] AS DOUBLE)) * (CAST(e.embedding[i] AS DOUBLE) - CAST(q.v[i] AS DOUBLE)))), 5) AS d FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, chunk_index) AS rank FROM s) SELECT query, chunk_index, CAST(rank AS INTEGER) AS rank, round(1 - d, 5) AS score FROM r WHERE rank <= 3"""


@_query("knn_top3", _KNN)
def knn_top3(spark, sf_dir):
    """The queries are the vectors whose id is divisible by 100, against all vectors."""
    e = _views(spark, sf_dir, "embeddings")["embeddings"]
    found = retrieval.nearest(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding"), e.select(F.col("vec_id").alias("chunk_index"), "embedding"))
    return found.select("query", "chunk_index", "rank", F.round("score", 5).alias("score"))


@_query("incremental_skip", "SELECT DISTINCT source AS source_filename FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE lang = 'es')")
def incremental_skip(spark, sf_dir):
    docs = _views(spark, sf_dir, "documents")["documents"].select(F.col("source").alias("source_filename"), "lang")
    return retrieval.not_indexed(docs.select("source_filename").distinct(), docs.where("lang = 'es'"))


@_query("index_upsert", "SELECT doc_id % 50 AS chunk_index, lang AS source_filename, CASE WHEN bool_or(doc_id % 3 = 0) THEN max(CASE WHEN doc_id % 3 = 0 THEN doc_id END) ELSE max(doc_id) END AS version FROM documents GROUP BY doc_id % 50, lang")
def index_upsert(spark, sf_dir):
    docs = _views(spark, sf_dir, "documents")["documents"].select(F.col("lang").alias("source_filename"), (F.col("doc_id") % 50).alias("chunk_index"), F.col("doc_id").alias("version"))
    per = lambda d: d.groupBy("source_filename", "chunk_index").agg(F.max("version").alias("version"))
    return retrieval.upsert(per(docs.where("version % 3 <> 0")), per(docs.where("version % 3 = 0")))


@_query("dedupe_tables", "SELECT CAST(source AS VARCHAR) AS doc_id, min(doc_id) AS table_ord, md5(text) AS h FROM documents WHERE text IS NOT NULL GROUP BY source, text")
def dedupe_tables(spark, sf_dir):
    docs = _views(spark, sf_dir, "documents")["documents"].where("text IS NOT NULL")
    tables = docs.select(F.col("source").alias("doc_id"), F.lit(1).alias("page_num"), F.col("doc_id").alias("table_ord"), F.array(F.lit("text")).alias("headers"), F.array(F.array("text")).alias("rows"))
    return tables_ops.distinct_tables(tables, ["doc_id"]).select("doc_id", "table_ord", F.md5(F.col("rows")[0][0]).alias("h"))


@_query("unmapped_labels", "SELECT p_name AS raw_label, count(*) AS n FROM part GROUP BY p_name")
def unmapped_labels(spark, sf_dir):
    items = _views(spark, sf_dir, "part")["part"].select(F.col("p_name").alias("raw_label"), F.lit("unknown").alias("method"))
    return mapping.unmapped_labels(items)


@_query("pdf_type", f"SELECT doc_id, CASE WHEN count(*) FILTER (WHERE length(raw_text) > 50) >= 3 THEN 'typed' ELSE 'scanned' END AS pdf_type FROM ({_PAGES}) WHERE page_num <= 5 GROUP BY doc_id")
def pdf_type(spark, sf_dir):
    return pages_ops.is_typed(_pages(spark, sf_dir))


@_query("word_reports")
def word_reports(spark, sf_dir):
    best = analytics.best_items(_items(spark, sf_dir))
    observed, moves = _observed(spark, sf_dir), analytics.movements(best)
    counted = report.summary(observed)
    parts = {"summary": counted, "observations": observed, "movements": report.movement_table(report.key_movements(moves)), "ratios": report.ratio_table(analytics.ratios(best))}
    return writers.word_reports(parts, report.next_steps(counted)).select("doc_id", F.length("content").alias("n_bytes"))


_RETRIEVED = "SELECT lang AS query, CAST(row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS INT) AS rank, concat('Ind AS ', CAST(doc_id % 7 AS STRING), ' - x.pdf') AS source FROM documents"


@_query("citations", f"SELECT query, string_agg(name, ' / ' ORDER BY r) AS citation FROM (SELECT query, regexp_replace(source, ' - x.pdf', '') AS name, min(rank) AS r FROM ({_RETRIEVED}) GROUP BY ALL) GROUP BY query")
def citations(spark, sf_dir):
    return narrate.citations(_derived(spark, sf_dir, _RETRIEVED, "documents"))


_CITED = """SELECT CAST(o_orderkey AS BIGINT) AS id, concat('Ind AS ', CAST(o_orderkey % 3 AS STRING), ' para 5.', CAST(o_orderkey % 4 AS STRING)) AS citation, array('Ind AS 1 - a.pdf', 'Ind AS 2 - b.pdf') AS sources, array('see 5.1 here', 'and 5.2') AS passages FROM orders"""


@_query("grounded_citation", "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderkey % 3 IN (1, 2) AND o_orderkey % 4 IN (1, 2) THEN 'Ind AS ' || o_orderkey % 3 || ' para 5.' || o_orderkey % 4 ELSE 'Ind AS 1 / Ind AS 2' END AS citation FROM orders")
def grounded_citation(spark, sf_dir):
    found = _derived(spark, sf_dir, _CITED, "orders")
    return found.select("id", narrate.grounded_citation(F.col("citation"), F.col("sources"), F.col("passages")).alias("citation"))


_TOLD = "SELECT CAST(o_orderkey AS BIGINT) AS id, concat('rose from ', CAST(o_orderkey % 400 AS STRING), ' to 1,', CAST(100 + o_orderkey % 900 AS STRING)) AS told, CAST(1100 + o_orderkey % 900 AS DOUBLE) AS current, CAST(o_orderkey % 400 + CASE WHEN o_orderkey % 5 = 0 THEN 50 ELSE 0 END AS DOUBLE) AS prior FROM orders"


@_query("missing_numbers", f"SELECT id, id % 5 = 0 AND prior >= 100 AND abs(id % 400 - prior) > prior * 0.01 AND abs(current - prior) > prior * 0.01 AS missing FROM ({_TOLD})")
def missing_numbers(spark, sf_dir):
    found = _derived(spark, sf_dir, _TOLD, "orders")
    return found.select("id", narrate.missing_numbers(F.col("told"), F.col("current"), F.col("prior")).alias("missing"))


@_query("prompts")
def prompts(spark, sf_dir):
    told = _flags(spark, sf_dir).withColumns({"note_text": F.repeat(F.col("flag_id"), 300), "passages": F.array(F.lit("one"), F.lit("two"))})
    return told.select("doc_id", "flag_id", narrate.prompt(told).alias("prompt"))


_SHEETS = "SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INT) AS sheet_ord, CASE WHEN conv_id % 4 = 0 OR turn % 3 = 1 THEN 'unknown' ELSE 'pnl' END AS sheet_type FROM conversations"


@_query("face_sheets", f"WITH s AS ({_SHEETS}), k AS (SELECT doc_id, bool_or(sheet_type <> 'unknown') AS typed FROM s GROUP BY doc_id) SELECT doc_id, sheet_ord, sheet_type FROM s JOIN k USING (doc_id) WHERE sheet_type <> 'unknown' OR NOT typed")
def face_sheets(spark, sf_dir):
    return mapping.face_sheets(_derived(spark, sf_dir, _SHEETS, "conversations"))


@_query("safe_div", "SELECT CAST(o_orderkey AS BIGINT) AS id, round(o_totalprice / nullif(o_orderkey % 5, 0), 4) AS q FROM orders")
def safe_div(spark, sf_dir):
    return _views(spark, sf_dir, "orders")["orders"].select(F.col("o_orderkey").cast("long").alias("id"), F.round(X.safe_div(F.col("o_totalprice"), (F.col("o_orderkey") % 5).cast("double")), 4).alias("q"))


@_query("best_by_cosine", """WITH p AS (SELECT a.vec_id AS query, b.vec_id AS candidate, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, candidate) AS n FROM p) SELECT query, candidate, cosine FROM r WHERE n = 1 AND cosine > 0.3""")
def best_by_cosine(spark, sf_dir):
    """Every vector against a short list of candidates, as labels are against the chart's variants."""
    e = _views(spark, sf_dir, "embeddings")["embeddings"]
    candidates = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("candidate"), F.col("vec_id").alias("ord"), "embedding")
    return retrieval.best_by_cosine(e.select(F.col("vec_id").alias("query"), "embedding"), candidates, 0.3)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return movements_by_nation(spark, sf_dir)


from . import cell_queries, file_queries, filing_queries, note_queries  # noqa: E402, F401  register more
