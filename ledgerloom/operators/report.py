"""Tables of the report: summary, chart data, movements, ratios, next steps, and whole reports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import shown

RATINGS = ("High", "Medium", "Low")
#: Ratios shown in the chart, and their names in tables.
CHART_RATIOS = ("current_ratio", "quick_ratio", "debt_equity", "interest_coverage", "cfo_to_pat")
RATIO_NAMES = {"current_ratio": "Current Ratio", "quick_ratio": "Quick Ratio", "debt_equity": "Debt-Equity Ratio", "interest_coverage": "Interest Coverage", "debtor_days": "Debtor Days", "creditor_days": "Creditor Days", "net_profit_margin": "Net Profit Margin %", "roce": "ROCE %", "cfo_to_pat": "CFO / PAT"}


def summary(observed: DataFrame) -> DataFrame:
    """doc_id, rating, count and areas for all three ratings of each document, in one aggregation."""
    hit = lambda r: F.col("rating") == r
    counts = [F.count_if(hit(r)).alias(f"n{i}") for i, r in enumerate(RATINGS)]
    areas = [F.array_join(F.array_sort(F.collect_set(F.when(hit(r), F.col("area")))), ", ").alias(f"a{i}") for i, r in enumerate(RATINGS)]
    told = (F.struct(F.lit(r).alias("rating"), F.lit(i).alias("rating_ord"), F.col(f"n{i}").alias("count"), F.when(F.col(f"n{i}") > 0, F.col(f"a{i}")).otherwise("-").alias("areas")) for i, r in enumerate(RATINGS))
    return observed.groupBy("doc_id").agg(*counts, *areas).select("doc_id", F.inline(F.array(*told)))


def risk_chart(counted: DataFrame) -> DataFrame:
    return counted.where(F.col("count") > 0).select("doc_id", "rating", "rating_ord", "count")


def key_movements(moves: DataFrame) -> DataFrame:
    return moves.where((F.coalesce("pct_change", F.lit(0.0)) != 0) & (F.abs("pct_change") > 10))


def movement_chart(moves: DataFrame, k: int = 12) -> DataFrame:
    """The k largest relative movements of each document, smallest first."""
    order = Window.partitionBy("doc_id").orderBy(F.abs("pct_change").desc(), "key_ord")
    top = moves.where(F.col("pct_change").isNotNull()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.withColumn("position", F.max("rank").over(Window.partitionBy("doc_id")) - F.col("rank") + 1)


def ratio_chart(ratios: DataFrame) -> DataFrame:
    shown = ratios.where(F.col("ratio").isin(*CHART_RATIOS) & (F.col("current").isNotNull() | F.col("prior").isNotNull()))
    return shown.withColumns({"current": F.coalesce("current", F.lit(0.0)), "prior": F.coalesce("prior", F.lit(0.0))})


def or_dash(x: Column, pattern: str) -> Column:
    return F.coalesce(shown(x, pattern), F.lit("-"))


def movement_table(moves: DataFrame) -> DataFrame:
    sign = F.when(F.col("pct_change") >= 0, "+").otherwise("")
    change = F.coalesce(F.concat(sign, shown("pct_change", "#0.0"), F.lit("%")), F.lit("-"))
    order = Window.partitionBy("doc_id").orderBy(F.abs("pct_change").desc_nulls_last(), "key_ord")
    return moves.select("doc_id", F.row_number().over(order).alias("row"), F.col("display_label").alias("line_item"), or_dash(F.col("current"), "#,##0").alias("current"), or_dash(F.col("prior"), "#,##0").alias("prior"), change.alias("change"))


def ratio_table(ratios: DataFrame) -> DataFrame:
    names = F.create_map(*(F.lit(x) for pair in RATIO_NAMES.items() for x in pair))
    return ratios.select("doc_id", "ratio_ord", names[F.col("ratio")].alias("name"), or_dash(F.col("current"), "#0.00").alias("current"), or_dash(F.col("prior"), "#0.00").alias("prior"))


def next_steps(counted: DataFrame) -> DataFrame:
    """Numbered steps: the High and Medium ones where there are any, the last always."""
    get = lambda rating, c: F.max(F.when(F.col("rating") == rating, F.col(c)))
    wide = counted.groupBy("doc_id").agg(get("High", "count").alias("hn"), get("High", "areas").alias("ha"), get("Medium", "count").alias("mn"), get("Medium", "areas").alias("ma"))
    high = F.concat(F.lit("Prioritize closing the "), F.col("hn").cast("string"), F.lit(" High-risk item(s) above ("), "ha", F.lit(") — obtain the corroborating evidence listed in the Recommendation column before forming an audit opinion."))
    medium = F.concat(F.lit("Follow up on the "), F.col("mn").cast("string"), F.lit(" Medium-risk item(s) ("), "ma", F.lit(") during fieldwork and document resolution in the working paper file."))
    always = F.lit("Cross-reference each resolved observation to its note reference (Section 3) and retain the supporting documentation obtained as audit evidence.")
    steps = F.array_compact(F.array(F.when(F.col("hn") > 0, high), F.when(F.col("mn") > 0, medium), always))
    return wide.select("doc_id", F.posexplode(steps).alias("pos", "step")).select("doc_id", (F.col("pos") + 1).alias("number"), "step")


def markdown(observed: DataFrame) -> DataFrame:
    """One collapsible block an observation, High ones open."""
    opening = F.when(F.col("rating") == "High", "<details open>").otherwise("<details>")
    body = F.concat_ws("\n", opening, F.concat(F.lit("<summary>"), F.col("number").cast("string"), F.lit(". ["), "rating", F.lit("] "), "area", F.lit("</summary>")), F.lit(""), F.concat(F.lit("**Observation:** "), "observation"), F.concat(F.lit("**Recommendation:** "), "recommendation"), F.concat(F.lit("**Notes:** "), "notes"), F.concat(F.lit("**Standard:** "), "citation"), F.lit("</details>"))
    return observed.select("doc_id", "number", body.alias("markdown"))


def flags_json(flags: DataFrame) -> DataFrame:
    return flags.select("doc_id", "rule_ord", "key_ord", F.to_json(F.struct("flag_id", "area", "severity", "evidence", "note_ids", "standard_query", "triggered_by"), {"ignoreNullFields": "false"}).alias("flag"))


def reports(observed: DataFrame, moves: DataFrame, ratios: DataFrame, generated_at: Column) -> DataFrame:
    """One row a document with everything a report shows."""
    o = observed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "area", "rating", "observation", "notes", "citation", "recommendation"))).alias("observations"), *(F.count_if(F.col("rating") == r).alias(r.lower()) for r in RATINGS), F.count("*").alias("total"))
    m = key_movements(moves).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("key_ord", "key", "display_label", "current", "prior", "pct_change"))).alias("key_movements"))
    r = ratios.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ratio_ord", "ratio", "current", "prior"))).alias("ratios"))
    return r.join(o, "doc_id", "left").join(m, "doc_id", "left").withColumn("generated_at", generated_at)
