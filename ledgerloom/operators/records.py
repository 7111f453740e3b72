"""Records read from note tables. Each reader is an expression over a table's headers and rows; null means it does not fit.

Where several rows match a field the last one wins, its null included, unless stated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.similarity_join import partial_matrix
from ..functions.text import any_of, blank, first_header, let, parse_in_lambda, rate_cell, strip, total_column, year_columns
from .tables import is_empty_table


def _cell(row: Column, at: Column) -> Column:
    return F.get(row, at)


def _label(row: Column) -> Column:
    return F.lower(F.coalesce(F.get(row, F.lit(0)), F.lit("")))


def _classed(rows: Column, classify: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
    return F.transform(rows, lambda r: F.struct(let(_label(r), classify).alias("kind"), value(r).alias("value")))


def _last(classed: Column, kind: str) -> Column:
    fit = F.filter(classed, lambda x: x["kind"] == kind)
    return F.try_element_at(fit, F.lit(-1))["value"]


_CONTINGENT_WORDS = ("contingent", "claim", "not acknowledged", "guarantee", "undertaking", "income tax", "service tax", "sales tax", "vat", "gst", "duty", "demand")


def contingent() -> Column:
    headers, rows = F.col("headers"), F.col("rows")
    fallback = F.coalesce(total_column(headers), F.size(headers) - 1)
    otherwise = F.struct(fallback.alias("current_col"), F.when(fallback + 1 < F.size(headers), fallback + 1).alias("prior_col"))
    columns = F.coalesce(year_columns(headers), otherwise)
    kind = lambda x: F.when(x.contains("income tax"), "income_tax").when(x.contains("service tax"), "service_tax").when(x.contains("gst"), "gst").when(x.contains("total"), "total").when(x != "", "others")

    def read(at: Column) -> Column:
        return _classed(rows, kind, lambda r: F.struct(parse_in_lambda(_cell(r, at["current_col"])).alias("now"), r.alias("cells"), at["prior_col"].alias("prior_col")))

    def fields(read: Column) -> Column:
        others = F.filter(F.transform(F.filter(read, lambda x: x["kind"] == "others"), lambda x: x["value"]["now"]), lambda v: v.isNotNull() & (v != 0))
        summed = let(others, lambda o: F.when(F.size(o) > 0, F.aggregate(o, F.lit(0.0), lambda a, v: a + v)))
        parts = [_last(read, k)["now"].alias(k) for k in ("income_tax", "service_tax", "gst")]
        before = let(_last(read, "total"), lambda x: parse_in_lambda(_cell(x["cells"], x["prior_col"])))  # of the one row that is asked for
        return F.struct(*parts, summed.alias("others"), _last(read, "total")["now"].alias("total"), before.alias("total_prior"))

    some = lambda f: F.coalesce(f["income_tax"], f["service_tax"], f["gst"], f["total"], f["others"]).isNotNull()
    labels = F.array_join(F.transform(rows, _label), " ")
    return F.when(let(labels, lambda x: any_of(x, _CONTINGENT_WORDS)), let(let(let(columns, read), fields), lambda f: F.when(some(f), f)))


def _amount_column() -> Column:
    headers = F.col("headers")
    return F.coalesce(first_header(headers, lambda h: h.rlike(r"(?U)\bamount\b|\d{4}")), F.size(headers) - 1)


def csr() -> Column:
    kind = lambda x: F.when(any_of(x, ("amount required", "obligation", "2%")), "obligation").when(x.contains("spent") & ~x.contains("unspent"), "amount_spent").when(x.contains("unspent"), "amount_unspent").when(any_of(x, ("carried forward", "carry forward")), "carry")
    rows = let(_amount_column(), lambda at: F.transform(F.col("rows"), lambda r: F.struct(kind(_label(r)).alias("kind"), F.get(r, F.lit(0)).alias("label"), parse_in_lambda(_cell(r, at)).alias("value"))))

    def fields(read: Column) -> Column:
        carried = F.transform(F.filter(read, lambda x: x["kind"] == "carry"), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("amount")))
        return F.struct(*(_last(read, k).alias(k) for k in ("obligation", "amount_spent", "amount_unspent")), carried.alias("carry_forward_years"))

    return let(let(rows, fields), lambda f: F.when(F.coalesce(f["obligation"], f["amount_spent"], f["amount_unspent"]).isNotNull(), f))


_MSMED = ("principal_unpaid", "interest_unpaid", "interest_accrued_unpaid", "interest_further_due")


def msmed() -> Column:
    kind = lambda x: F.when(x.contains("principal"), "principal_unpaid").when(x.contains("accrued") & ~x.contains("further"), "interest_accrued_unpaid").when(x.contains("further"), "interest_further_due").when(x.contains("interest"), "interest_unpaid")
    rows = let(_amount_column(), lambda at: _classed(F.col("rows"), kind, lambda r: parse_in_lambda(_cell(r, at))))
    return let(let(rows, lambda read: F.struct(*(_last(read, k).alias(k) for k in _MSMED))), lambda f: F.when(F.coalesce(*(f[k] for k in _MSMED)).isNotNull(), f))


def actuarial() -> Column:
    """The first row of each assumption that gives a rate wins; a row that names both counts for the discount rate."""
    headers, rows = F.col("headers"), F.col("rows")
    years = F.filter(F.transform(headers, lambda h, i: F.when(F.coalesce(h, F.lit("")).rlike(r"\d{4}"), i)), lambda i: i.isNotNull())
    columns = let(years, lambda y: F.when(F.size(y) >= 2, F.struct(y[0].alias("now"), y[1].alias("before"))).when(F.size(headers) >= 3, F.struct(F.lit(1).alias("now"), F.lit(2).alias("before"))))
    kind = lambda x: F.when(x.contains("discount rate"), "discount").when(x.contains("salary"), "salary")
    read = lambda at: F.transform(rows, lambda r: F.struct(kind(_label(r)).alias("kind"), rate_cell(_cell(r, at["now"])).alias("current"), rate_cell(_cell(r, at["before"])).alias("prior")))
    pick = lambda given, k: F.get(F.filter(given, lambda x: (x["kind"] == k) & (x["current"].isNotNull() | x["prior"].isNotNull())), F.lit(0))
    both = let(let(columns, read), lambda given: F.struct(pick(given, "discount").alias("d"), pick(given, "salary").alias("s")))
    fields = lambda b: F.struct(b["d"]["current"].alias("discount_rate_current"), b["d"]["prior"].alias("discount_rate_prior"), b["s"]["current"].alias("salary_escalation_current"), b["s"]["prior"].alias("salary_escalation_prior"))
    return let(both, lambda b: F.when(b["d"].isNotNull(), fields(b)))


def disclosed_ratios() -> Column:
    headers, rows = F.col("headers"), F.col("rows")
    hits = F.filter(F.transform(headers, lambda h, i: F.when(F.lower(F.coalesce(h, F.lit(""))).contains("varian"), i)), lambda i: i.isNotNull())
    at = lambda r, i: F.when(F.size(headers) > i, parse_in_lambda(F.get(r, F.lit(i))))

    def reason(r: Column, v: Column) -> Column:
        tail = F.slice(r, v + 2, F.greatest(F.size(r) - v - 1, F.lit(0)))
        words = F.filter(tail, lambda c: (F.coalesce(c, F.lit("")) != "") & (F.coalesce(parse_in_lambda(c), F.lit(0.0)) == 0))
        return F.when(v.isNotNull(), let(words, lambda w: F.when(F.size(w) > 0, F.array_join(w, " "))))

    named = F.filter(rows, lambda r: ~F.coalesce(blank(F.get(r, F.lit(0))), F.lit(True)))
    entry = lambda r, v: F.struct(strip(F.get(r, F.lit(0))).alias("name"), at(r, 1).alias("current"), at(r, 2).alias("prior"), parse_in_lambda(F.get(r, v)).alias("variance_pct"), reason(r, v).alias("reason_for_variance"))
    return let(F.try_element_at(hits, F.lit(-1)), lambda v: let(F.transform(named, lambda r: entry(r, v)), lambda out: F.when(F.size(out) > 0, out)))


#: Spellings of the ageing columns.
AGEING = {
    "not_due": ["not due"], "zero_to_six_months": ["less than 6 months", "0-6 months", "upto 6 months"], "six_to_twelve_months": ["6 months - 1 year", "6 months-1 year", "6-12 months"],
    "one_to_two_years": ["1-2 years", "1 - 2 years"], "two_to_three_years": ["2-3 years", "2 - 3 years"], "more_than_three_years": ["more than 3 years", "above 3 years", ">3 years"],
}
CWIP_AGEING = {"less_than_1_year": ["less than 1 year"], "1_to_2_years": ["1-2 years", "1 - 2 years"], "2_to_3_years": ["2-3 years", "2 - 3 years"], "more_than_3_years": ["more than 3 years", "above 3 years"]}
BUCKET_SCORE = 70


def match_buckets(scores: dict[str, dict[str, float]], headers: list[str | None], buckets: dict[str, list[str]]) -> dict[str, int]:
    """Column of each bucket: the best header by partial ratio above the bound, the first of equals. scores: of each header with each bucket."""
    out = {}
    for bucket in buckets:
        best = max(((scores[h][bucket], -i) for i, h in enumerate(headers) if h), default=(0.0, 0))
        if best[0] > BUCKET_SCORE:
            out[bucket] = -best[1]
    return out


def match_buckets_in_turn(scores: dict[str, dict[str, float]], headers: list[str | None], buckets: dict[str, list[str]]) -> dict[str, int]:
    """Column of each bucket: its first header above the bound; a later bucket takes a column over."""
    owner: dict[int, str] = {}
    for bucket in buckets:
        at = next((i for i, h in enumerate(headers) if h and scores[h][bucket] > BUCKET_SCORE), None)
        if at is not None:
            owner[at] = bucket
    return {bucket: at for at, bucket in owner.items()}


def bucket_scores(headers: list[str], buckets: dict[str, list[str]]) -> dict[str, dict[str, float]]:
    """For each header its best partial ratio with the spellings of each bucket."""
    names = [n for own in buckets.values() for n in own]
    found = partial_matrix([h.lower() for h in headers], names)
    at = np.cumsum([0, *(len(own) for own in buckets.values())])[:-1]
    best = np.maximum.reduceat(found, at, axis=1) if headers else found
    return {h: dict(zip(buckets, row, strict=True)) for h, row in zip(headers, best.tolist(), strict=True)}


def with_buckets(tables: DataFrame, buckets: dict[str, list[str]], compat: bool = False) -> DataFrame:
    """The tables with cols, a map from bucket to column, matched once per distinct header row."""
    match = match_buckets_in_turn if compat else match_buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_pylist()
            scores = bucket_scores(sorted({h for row in rows for h in row or () if h}), buckets)
            found = [list(match(scores, row or [], buckets).items()) for row in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.map_(pa.string(), pa.int32()))], ["headers", "cols"])

    schema = T.StructType([tables.schema["headers"], T.StructField("cols", T.MapType(T.StringType(), T.IntegerType()))])
    return tables.join(tables.select("headers").distinct().mapInArrow(run, schema), "headers")


def _ageing(rows: Column) -> list[Column]:
    """Each bucket: the last row with a value."""
    values = lambda at: F.filter(F.transform(rows, lambda r: parse_in_lambda(F.get(r, at))), lambda v: v.isNotNull())
    return [let(F.col("cols")[b], lambda at: F.when(at.isNotNull(), F.try_element_at(values(at), F.lit(-1)))).alias(b) for b in AGEING]


def _totals(kind: Callable[[Column], Column]) -> Column:
    """kind and value in the column of totals of each row; null without such a column. The headers are searched once, not for each row."""
    return let(total_column(F.col("headers")), lambda at: F.when(at.isNotNull(), _classed(F.col("rows"), kind, lambda r: parse_in_lambda(F.get(r, at)))))


def receivables_ageing() -> Column:
    kind = lambda x: F.when(any_of(x, ("doubtful", "allowance", "expected credit loss")), "allowance").when(x.contains("net"), "net").when(x.contains("total") | (x == ""), "gross")

    def fields(read: Column) -> Column:
        gross = F.filter(read, lambda x: x["kind"].eqNullSafe("gross") & x["value"].isNotNull())
        return F.struct(*_ageing(F.col("rows")), F.try_element_at(gross, F.lit(-1))["value"].alias("total_gross"), _last(read, "allowance").alias("allowance_doubtful"), _last(read, "net").alias("net_total"))

    return F.when(F.size("cols") >= 2, let(_totals(kind), fields))


def payables_ageing() -> Column:
    kind = lambda x: F.when(any_of(x, ("micro", "small", "mse")), "mse").when(x.contains("other"), "others").when(x.contains("total"), "total")
    fields = lambda read: F.struct(*_ageing(F.col("rows")), *(_last(read, k).alias(f"total_{k}" if k != "total" else k) for k in ("mse", "others", "total")))
    return F.when(F.size("cols") >= 2, let(_totals(kind), fields))


def cwip_ageing() -> Column:
    """One entry for each amount other than zero, and the total."""
    rows, total = F.col("rows"), total_column(F.col("headers"))
    named = F.transform(rows, lambda r: F.struct(F.when(~F.coalesce(blank(F.get(r, F.lit(0))), F.lit(True)), strip(F.get(r, F.lit(0)))).alias("name"), r.alias("cells")))
    is_total = lambda x: F.coalesce(F.lower(x["name"]).contains("total"), F.lit(False))
    entries = F.array_sort(F.map_entries("cols"), lambda a, b: a.value - b.value)
    cells = F.flatten(F.transform(F.filter(named, lambda x: ~is_total(x)), lambda x: F.transform(entries, lambda e: F.struct(x["name"].alias("project_name"), e.key.alias("age_bucket"), parse_in_lambda(F.get(x.cells, e.value)).alias("amount")))))
    projects = F.filter(cells, lambda p: p.amount != 0)
    totals = F.transform(F.filter(named, is_total), lambda x: F.struct(parse_in_lambda(F.get(x.cells, total)).alias("v")))
    return F.when(F.size("cols") > 0, F.struct(projects.alias("projects"), F.when(total.isNotNull(), F.try_element_at(totals, F.lit(-1))["v"]).alias("total")))


#: Words that lead to the notes of each record.
RECORDS: dict[str, tuple[tuple[str, ...], Callable[[], Column], dict | None]] = {
    "trade_receivables_ageing": (("receivable", "debtors"), receivables_ageing, AGEING), "trade_payables_ageing": (("payable", "creditors"), payables_ageing, AGEING),
    "cwip_ageing": (("capital work-in-progress", "capital work in progress", "cwip"), cwip_ageing, CWIP_AGEING), "contingent_liabilities": (("contingent liabilit",), contingent, None),
    "csr_details": (("corporate social responsibility", "csr"), csr, None), "msmed_disclosure": (("micro", "small enterprise", "msme", "msmed"), msmed, None),
    "actuarial_assumptions": (("actuarial", "defined benefit"), actuarial, None), "company_ratios": (("ratio",), disclosed_ratios, None),
}


def read_record(name: str, tables: DataFrame, compat: bool = False) -> DataFrame:
    """The tables with the record as column ``name``, null where it does not fit."""
    _, reader, buckets = RECORDS[name]
    matched = with_buckets(tables, buckets, compat and name == "cwip_ageing") if buckets else tables
    return matched.withColumn(name, F.when(~is_empty_table(F.col("headers"), F.col("rows")), reader())).drop("cols")


def _led(notes: DataFrame, names: list[str]) -> DataFrame:
    """The notes' ids and order, and for each record whether its words lead to the note, or to none of the document's."""
    head = F.lower(F.concat("title", F.lit(" "), F.substring("raw_text", 1, 200)))
    own = Window.partitionBy("doc_id")
    hits = notes.select("doc_id", "note_id", "note_ord", *(any_of(head, RECORDS[n][0]).alias(f"__{n}") for n in names))
    return hits.withColumns({f"__{n}": F.col(f"__{n}") | ~F.bool_or(f"__{n}").over(own) for n in names})


def all_records(notes: DataFrame, tables: DataFrame, compat: bool = False, names: tuple[str, ...] = tuple(RECORDS)) -> DataFrame:
    """doc_id and a column for each record: of the first table that fits, in the notes that its words lead to, or in all notes if none
    has them; null where none fits. One pass over the notes and one over their tables.

    tables: note tables (doc_id, note_id, page_num, table_ord, headers, rows).
    """
    read = tables
    for name in names:
        read = read_record(name, read, compat)
    tried = read.drop("note_ord").join(_led(notes, list(names)), ["doc_id", "note_id"])
    order = F.struct("note_ord", "page_num", "table_ord")
    fits = {n: F.col(f"__{n}") & F.col(n).isNotNull() for n in names}
    return tried.groupBy("doc_id").agg(*(F.min_by(F.when(fits[n], F.col(n)), F.when(fits[n], order)).alias(n) for n in names))


def first_record(name: str, notes: DataFrame, tables: DataFrame, compat: bool = False) -> DataFrame:
    """doc_id and one record, of documents that have it."""
    return all_records(notes, tables, compat, (name,)).where(F.col(name).isNotNull())
