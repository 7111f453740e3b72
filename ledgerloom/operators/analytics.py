"""Best items, year-on-year movements, ratios and counts, for all documents at once.

Every relation carries doc_id; each operator costs one shuffle on doc_id (best_items aggregates before it).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_div
from ..functions.vocabulary import DISPLAY, KEYS, lookup

#: Which way of mapping is preferred among equally complete items.
METHOD_PRIORITY = {"exact": 3, "structural": 2, "fuzzy": 2, "embedding": 1, "unknown": 0}


def best_items(items: DataFrame) -> DataFrame:
    """One item for each document and key: with a current value, then with both, then by method, confidence, and first."""
    complete = F.col("current_value").isNotNull()
    rank = F.struct(complete, complete & F.col("prior_value").isNotNull(), F.coalesce(lookup(F.col("method"), METHOD_PRIORITY), F.lit(0)), F.col("confidence"), -F.col("item_idx"))
    value = F.struct("item_idx", "raw_label", "current_value", "prior_value", "confidence", "method", "note_ref")
    kept = items.where(F.col("canonical_key").isNotNull())
    best = kept.groupBy("doc_id", "canonical_key").agg(F.max_by(value, rank).alias("best"), F.min("item_idx").alias("key_ord"))
    return best.select("doc_id", "canonical_key", "key_ord", "best.*")


def movements(best: DataFrame) -> DataFrame:
    """Absolute, relative and material change of each key with a value on either side."""
    c, p = F.col("current_value"), F.col("prior_value")
    assets = F.max(F.when(F.col("canonical_key") == "total_assets", c)).over(Window.partitionBy("doc_id"))
    found = best.withColumn("total_assets", assets).where(c.isNotNull() | p.isNotNull())
    return found.select(
        "doc_id", "key_ord", F.col("canonical_key").alias("key"), F.coalesce(lookup(F.col("canonical_key"), DISPLAY), F.col("canonical_key")).alias("display_label"),
        c.alias("current"), p.alias("prior"), (c - p).alias("absolute_change"), (safe_div(c - p, F.abs(p)) * 100).alias("pct_change"),
        (safe_div(c, F.col("total_assets")) * 100).alias("materiality_pct"), "note_ref", "total_assets",
    )


def wide(best: DataFrame) -> DataFrame:
    """One row a document: v, a map from key to struct(current, prior); at most as many entries as there are keys."""
    entry = F.struct("canonical_key", F.struct(F.col("current_value").alias("current"), F.col("prior_value").alias("prior")))
    return best.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("v"))


#: Names of the ratios in report order.
RATIOS = ("current_ratio", "quick_ratio", "debt_equity", "interest_coverage", "debtor_days", "creditor_days", "net_profit_margin", "roce", "cfo_to_pat")


def _one_sided(a, b):
    """A sum in which a missing side counts as 0 if the other is there."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def _ratio_columns(side: str) -> dict:
    get = lambda key: F.col("v")[key][side]
    debt = _one_sided(get("borrowings_current"), get("borrowings_non_current"))
    payables = _one_sided(get("trade_payables_mse"), get("trade_payables_others"))
    ebit = get("pbt") + get("finance_costs")
    return {
        "current_ratio": safe_div(get("total_current_assets"), get("total_current_liabilities")),
        "quick_ratio": safe_div(get("total_current_assets") - get("inventories"), get("total_current_liabilities")),
        "debt_equity": safe_div(debt, get("total_equity")),
        "interest_coverage": safe_div(ebit, get("finance_costs")),
        "debtor_days": safe_div(get("trade_receivables"), get("revenue_from_operations")) * 365,
        "creditor_days": safe_div(payables, get("cost_of_services")) * 365,
        "net_profit_margin": safe_div(get("pat"), get("revenue_from_operations")) * 100,
        "roce": safe_div(ebit, get("total_assets") - get("total_current_liabilities")) * 100,
        "cfo_to_pat": safe_div(get("cfo"), get("pat")),
    }


def ratios(best: DataFrame) -> DataFrame:
    """doc_id, ratio, ratio_ord, current, prior."""
    now, before = _ratio_columns("current"), _ratio_columns("prior")
    rows = F.array(*(F.struct(F.lit(i).alias("ratio_ord"), F.lit(r).alias("ratio"), now[r].alias("current"), before[r].alias("prior")) for i, r in enumerate(RATIOS)))
    return wide(best).select("doc_id", F.inline(rows))


def severity_counts(flags: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in ("High", "Medium", "Low")]
    return flags.groupBy("doc_id").agg(*counts, F.count("*").alias("total"))


def mapped_share(items: DataFrame) -> DataFrame:
    return items.groupBy("doc_id").agg(F.count_if(F.col("canonical_key").isNotNull()).alias("mapped"), F.count("*").alias("items"))


def key_order() -> dict[str, int]:
    return {key: i for i, key in enumerate(KEYS)}
