"""Queries of cells, labels, headers, table rows and records, with SQL that computes each result from the cells' text.

The SQL reads a cell in named steps, as the functions do in a chain, so that every spelling below is judged by both.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import records, tables as tables_ops
from .queries import QUERIES, _derived, _query

_WHITE = "(" + " || ".join(f"chr({ord(c)})" for c in X.WHITE) + ")"
_S = r"[\s\x{a0}]"


def _trim(x: str) -> str:
    return f"trim({x}, {_WHITE})"


def _parsed(source: str, cell: str, out: str, p: str = "p") -> str:
    """CTEs that add the number ``out`` of a text column to the rows of a CTE; the last one is {p}."""
    bare = cell_ = f"{p}_t"
    for mark in X.CURRENCY:
        bare = f"replace({bare}, '{mark}', '')"
    minus = f"starts_with({p}_inner, '-')"
    return f"""{p}1 AS (SELECT *, {_trim(cell)} AS {cell_} FROM {source}), {p}2 AS (SELECT *, {_trim(bare)} AS {p}_bare FROM {p}1),
{p}3 AS (SELECT *, CASE WHEN {p}_bare LIKE '(%)' THEN substr({p}_bare, 2, length({p}_bare) - 2) ELSE {p}_bare END AS {p}_open FROM {p}2), {p}4 AS (SELECT *, {_trim(f'{p}_open')} AS {p}_inner FROM {p}3),
{p}5 AS (SELECT *, {_trim(f"replace(CASE WHEN {minus} THEN substr({p}_inner, 2) ELSE {p}_inner END, ',', '')")} AS {p}_body FROM {p}4),
{p}6 AS (SELECT *, CASE WHEN NOT regexp_matches({p}_body, '{_S}') THEN TRY_CAST(regexp_replace(translate({p}_body, '०१२३४५६७८९', '0123456789'), '[^0-9.\\-]', '', 'g') AS DOUBLE) END AS {p}_size FROM {p}5),
{p} AS (SELECT *, CASE WHEN {p}_bare <> {p}_open OR {minus} THEN -abs({p}_size) ELSE {p}_size END AS {out} FROM {p}6)"""


_SPLIT_DIGIT = rf"^(\d{{1,2}}){_S}+([\d,]+\.?\d*|\([\d,]+\.?\d*\))$"


def _value(source: str, cell: str, out: str, p: str) -> str:
    """As _parsed, with a leading digit that was cut off put back where the cell is no number."""
    return f"""{_parsed(source, cell, f'{p}_first', f'{p}x')}, {p}y AS (SELECT *, CASE WHEN {p}_first IS NULL AND regexp_matches({p}x_t, '{_SPLIT_DIGIT}') THEN regexp_replace({p}x_t, '{_SPLIT_DIGIT}', '\\1\\2') END AS {p}_joined FROM {p}x),
{_parsed(f'{p}y', f'{p}_joined', f'{p}_second', f'{p}z')}, {p} AS (SELECT *, coalesce({p}_first, {p}_second) AS {out} FROM {p}z)"""


def _note(x: str) -> str:
    return rf"coalesce(nullif(regexp_extract({x}, '(?i)\bnote{_S}*(?:no\.?)?{_S}*(\d+[a-zA-Z]?)\b', 1), ''), nullif(regexp_extract({x}, '\((\d+[a-zA-Z]?)\){_S}*$', 1), ''))"


def _clean(x: str) -> str:
    out = f"lower({_trim(x)})"
    for pattern in (r"\([^)]*\)", r"\[[^\]]*\]"):
        out = f"regexp_replace({out}, '{pattern}', '', 'g')"
    out = _trim(f"regexp_replace({out}, ':+$', '')")
    out = f"regexp_replace({out}, '{_S}+', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?:{_S}+\(?-?\d[\d,]*\.?\d*\)?)+{_S}*$', '')"
    return _trim(rf"regexp_replace({out}, '{_S}+\d{{1,3}}[a-zA-Z]{{0,2}}{_S}*$', '')")


#: Cells in the spellings of annual reports: a prefix, a figure and a suffix, in all combinations.
CELLS = """SELECT id, concat(CASE id % 11 WHEN 0 THEN '' WHEN 1 THEN '(' WHEN 2 THEN '₹ ' WHEN 3 THEN 'Rs. ' WHEN 4 THEN '-' WHEN 5 THEN '--' WHEN 6 THEN '( -' WHEN 7 THEN ' ' WHEN 8 THEN 'INR' WHEN 9 THEN '–' ELSE 'FY' END,
 CASE CAST(floor(id / 11) AS BIGINT) % 9 WHEN 0 THEN CAST(id AS STRING) WHEN 1 THEN concat('1,76,', CAST(100 + id % 800 AS STRING)) WHEN 2 THEN concat(CAST(id AS STRING), '.50') WHEN 3 THEN '' WHEN 4 THEN 'NIL' WHEN 5 THEN '-' WHEN 6 THEN concat(CAST(id AS STRING), ' 12') WHEN 7 THEN '३४' ELSE 'N/A' END,
 CASE CAST(floor(id / 99) AS BIGINT) % 7 WHEN 0 THEN '' WHEN 1 THEN ')' WHEN 2 THEN '%' WHEN 3 THEN ' ' WHEN 4 THEN ' ' WHEN 5 THEN '.1' ELSE ' lakh' END) AS cell FROM (SELECT CAST(o_orderkey AS BIGINT) AS id FROM orders) k"""


@_query("parse_indian_number", f"WITH c AS ({CELLS}), {_parsed('c', 'cell', 'value')} SELECT id, value FROM p")
def parse_indian_number(spark, sf_dir):
    return _derived(spark, sf_dir, CELLS, "orders").select("id", X.parse_indian_number(F.col("cell")).alias("value"))


@_query("rate_cell", f"WITH c AS ({CELLS}), {_parsed('c', 'cell', 'value')} SELECT id, CASE WHEN abs(value) <= 30 THEN value END AS rate FROM p")
def rate_cell(spark, sf_dir):
    return _derived(spark, sf_dir, CELLS, "orders").select("id", X.rate_cell(F.col("cell")).alias("rate"))


SPLIT = """SELECT CAST(o_orderkey AS BIGINT) AS id, concat(CAST(o_orderkey % 120 AS STRING), CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN ' ' ELSE '' END, CASE o_orderkey % 5 WHEN 0 THEN '6,152.58' WHEN 1 THEN '(123)' WHEN 2 THEN '4.5.6' ELSE '77' END) AS cell FROM orders"""


@_query("recover_split_digit", f"WITH c AS ({SPLIT}), j AS (SELECT *, CASE WHEN regexp_matches({_trim('cell')}, '{_SPLIT_DIGIT}') THEN regexp_replace({_trim('cell')}, '{_SPLIT_DIGIT}', '\\1\\2') END AS joined FROM c), {_parsed('j', 'joined', 'value')} SELECT id, value FROM p")
def recover_split_digit(spark, sf_dir):
    return _derived(spark, sf_dir, SPLIT, "orders").select("id", X.recover_split_digit(F.col("cell")).alias("value"))


#: Labels with the noise that extraction leaves: a name and a tail, in all combinations.
LABELS = """SELECT id, concat(CASE id % 8 WHEN 0 THEN '  Trade Receivables' WHEN 1 THEN 'Total Assets' WHEN 2 THEN 'Dues of micro enterprises payable' WHEN 3 THEN 'Creditors other than micro' WHEN 4 THEN 'Inventories' WHEN 5 THEN 'Trade recievables' WHEN 6 THEN 'Property, Plant and Equipment' ELSE 'Total' END,
 CASE CAST(floor(id / 8) AS BIGINT) % 10 WHEN 0 THEN '' WHEN 1 THEN ' (x):' WHEN 2 THEN ' 2a 7.96 15,602' WHEN 3 THEN ' [net]' WHEN 4 THEN '  note 7' WHEN 5 THEN ' (14a)' WHEN 6 THEN ' Note No. 7f' WHEN 7 THEN ' ::' WHEN 8 THEN ' 12 (3,4) ' ELSE ' as per note 5' END) AS label FROM (SELECT CAST(p_partkey AS BIGINT) AS id FROM part) k"""


@_query("clean_label", f"SELECT id, {_clean('label')} AS clean FROM ({LABELS}) l")
def clean_label(spark, sf_dir):
    return _derived(spark, sf_dir, LABELS, "part").select("id", X.clean_label(F.col("label")).alias("clean"))


@_query("note_reference", f"SELECT id, {_note('label')} AS ref FROM ({LABELS}) l")
def note_reference(spark, sf_dir):
    return _derived(spark, sf_dir, LABELS, "part").select("id", X.note_reference(F.col("label")).alias("ref"))


#: Tables of four rows, with a note column, currency, a cut-off digit and a reference in a label.
TABLES = """SELECT CAST(l_orderkey AS BIGINT) AS doc_id, CAST(1 AS INT) AS page_num, CAST(l_linenumber AS INT) AS table_ord, array('Particulars', 'Note No.', '2025', '2024') AS headers,
 array(array('Revenue', CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)), array('12', '1', '2', '3'), array('Costs', '', concat('(', CAST(l_suppkey AS STRING), ')'), '(12a)'),
 array('Cash (7f)', 'x', concat('6 ', CAST(100 + l_partkey % 800 AS STRING)), concat('₹ ', CAST(l_suppkey AS STRING), '.50'))) AS rows FROM lineitem"""
_NOTED = rf"(?i)^(?:note|notes|schedule|schedules){_S}*(?:no\.?|number)?$"
_FLAT = "r AS (SELECT * EXCLUDE (rows), unnest(rows) AS cells, generate_subscripts(rows, 1) - 1 AS row_ord FROM t), c AS (SELECT *, unnest(cells) AS cell, generate_subscripts(cells, 1) - 1 AS i FROM r)"


@_query(
    "table_rows_extract",
    f"""WITH t AS (SELECT *, row_number() OVER () AS rid FROM ({TABLES}) l), {_FLAT}, {_value('c', 'cell', 'v', 'n')}, m AS (SELECT *, i > 0 AND regexp_matches({_trim('headers[i + 1]')}, '{_NOTED}') AS noted, {_trim('cell')} AS s FROM n),
f AS (SELECT *, CASE WHEN i > 0 AND noted THEN nullif(s, '') WHEN i > 0 AND v IS NULL AND length(s) <= 6 THEN {_note('cell')} END AS ref, CASE WHEN i > 0 AND NOT noted THEN v END AS number FROM m),
g AS (SELECT doc_id, table_ord, row_ord, any_value(s) FILTER (WHERE i = 0) AS label, bool_or(i = 0 AND n_first IS NOT NULL) AS numeric_label, list(number ORDER BY i) FILTER (WHERE number IS NOT NULL) AS numbers, list(ref ORDER BY i) FILTER (WHERE ref IS NOT NULL) AS refs FROM f GROUP BY rid, doc_id, table_ord, row_ord)
SELECT doc_id, table_ord, CAST(row_ord AS INTEGER) AS row_ord, label, numbers[1] AS current, numbers[2] AS prior, coalesce({_note('label')}, refs[1]) AS note_ref FROM g WHERE length(label) >= 3 AND NOT numeric_label""",
)
def table_rows_extract(spark, sf_dir):
    return tables_ops.read_rows(_derived(spark, sf_dir, TABLES, "lineitem")).select("doc_id", "table_ord", "row_ord", "label", "current", "prior", "note_ref")


HEADED = "SELECT CAST(o_orderkey AS BIGINT) AS id, array('Particulars', concat('31 March ', CAST(2015 + o_orderkey % 9 AS STRING)), concat('Year ', CAST(2015 + o_orderkey % 7 AS STRING), '-16'), CASE WHEN o_orderkey % 2 = 0 THEN 'Total' ELSE 'x' END) AS headers FROM orders"
#: The latest two years that headers name, each with its first header, as y1 and y2 (column numbers from 0).
_YEARS = """h AS (SELECT {id}, unnest(headers) AS header, generate_subscripts(headers, 1) - 1 AS i FROM {source}), y AS (SELECT {id}, i, list_max(list_transform(regexp_extract_all(header, '((?:19|20)\\d{{2}})', 1), lambda x: CAST(x AS INTEGER))) AS year FROM h),
firsts AS (SELECT {id}, year, min(i) AS i FROM y WHERE year IS NOT NULL GROUP BY {id}, year), latest AS (SELECT {id}, list(i ORDER BY year DESC) AS cols FROM firsts GROUP BY {id})"""


@_query(
    "header_columns",
    f"WITH t AS ({HEADED}), {_YEARS.format(id='id', source='t')}, total AS (SELECT id, min(i) AS i FROM h WHERE lower(header) LIKE '%total%' GROUP BY id) SELECT t.id, CAST(CASE WHEN len(cols) >= 2 THEN cols[1] END AS INTEGER) AS current_col, CAST(CASE WHEN len(cols) >= 2 THEN cols[2] END AS INTEGER) AS prior_col, CAST(total.i AS INTEGER) AS total_col FROM t LEFT JOIN latest ON latest.id = t.id LEFT JOIN total ON total.id = t.id",
)
def header_columns(spark, sf_dir):
    found = _derived(spark, sf_dir, HEADED, "orders").withColumn("y", X.year_columns(F.col("headers")))
    return found.select("id", F.col("y.current_col"), F.col("y.prior_col"), X.total_column(F.col("headers")).alias("total_col"))


#: One table of each record; {a} and {b} are figures of the order.
_RECORD_TABLES = {
    "contingent_liabilities": (["Particulars", "2023-24", "Addition", "2024-25"], [["Income tax demand", "100", "50", "{a}"], ["GST demand", "10", "0", "{b}"], ["Guarantee", "1", "1", "7"], ["Claim not acknowledged", "1", "1", "({b})"], ["Total", "{a}", "50", "{b}"]]),
    "csr_details": (["Particulars", "Amount"], [["Amount required to be spent", "{a}"], ["Amount spent", "₹ 30"], ["Amount unspent", "{b}"]]),
    "msmed_disclosure": (["Particulars", "2025", "2024"], [["Principal", "{a}", "40"], ["Interest accrued", "{b}", "1"], ["Further interest", "1", "0"], ["Interest", "-", "0"]]),
    "actuarial_assumptions": (["Assumption", "2025", "2024"], [["Discount rate", "14400", "31"], ["Discount rate", "6.8%", "{b}"], ["Salary growth", "5%", "{a}"], ["Discount rate", "9", "9"]]),
    "company_ratios": (["Ratio", "2025", "2024", "Variance"], [["Current Ratio", "{a}", "{b}", "10%", "better sales"], ["Quick Ratio", "-", "({b})", "-", ""]]),
    "trade_receivables_ageing": (["Particulars", "Not due", "Less than 6 months", "1-2 years", "Total"], [["Undisputed", "{a}", "2", "3", "{b}"], ["Less allowance", "", "", "", "({b})"], ["Net", "", "", "", "{a}"], ["Total", "-", "2", "3", "{b}"]]),
    "trade_payables_ageing": (["Particulars", "Less than 6 months", "1-2 years", "Total"], [["Micro", "{a}", "2", "{b}"], ["Others", "1", "({a})", "{a}"]]),
    "cwip_ageing": (["Project", "Less than 1 year", "1-2 years", "2-3 years", "More than 3 years", "Total"], [["Plant A", "{a}", "0", "0", "40", "45"], ["Plant B", "-", "{b}", "(3)", "", "45"], ["Total", "5", "0", "0", "40", "{b}"]]),
}


def _tables(name: str) -> str:
    headers, rows = _RECORD_TABLES[name]
    cell = lambda c: "concat('" + c.replace("{a}", "', CAST(a AS STRING), '").replace("{b}", "', CAST(b AS STRING), '") + "')"
    grid = ", ".join("array(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT CAST(k AS BIGINT) AS doc_id, array({', '.join(map(cell, headers))}) AS headers, array({grid}) AS rows FROM (SELECT o_orderkey AS k, o_orderkey % 70 + 1 AS a, o_orderkey % 29 AS b FROM orders) o"


def _cells(name: str) -> str:
    """CTEs t (tables) and n (cells with row_ord, i, label in lower case, header and value)."""
    return f"t AS ({_tables(name)}), {_FLAT}, {_parsed('c', 'cell', 'value')}, n AS (SELECT *, lower(coalesce(cells[1], '')) AS label, headers[i + 1] AS header FROM p)"


def _last(kind: str, at: str) -> str:
    """The value of the last row of a kind, its null included."""
    return f"(list(value ORDER BY row_ord) FILTER (WHERE kind = '{kind}' AND i = {at}))[-1]"


#: The first column whose header names an amount or a year.
_AMOUNT = r"amount AS (SELECT doc_id, coalesce(min(i) FILTER (WHERE regexp_matches(lower(header), '\bamount\b|\d{4}')), max(i)) AS cols FROM n GROUP BY doc_id)"
_LITERAL = lambda column, i: f"(list(value ORDER BY row_ord) FILTER (WHERE i = {i} AND value IS NOT NULL))[-1] AS {column}"

_RECORD_SQL = {
    "contingent_liabilities": f"""WITH {_cells('contingent_liabilities')}, {_YEARS.format(id='doc_id', source='t')}, k AS (SELECT n.*, cols, CASE WHEN label LIKE '%income tax%' THEN 'income_tax' WHEN label LIKE '%service tax%' THEN 'service_tax' WHEN label LIKE '%gst%' THEN 'gst' WHEN label LIKE '%total%' THEN 'total' ELSE 'others' END AS kind FROM n JOIN latest USING (doc_id))
SELECT doc_id, {_last('income_tax', 'cols[1]')} AS income_tax, {_last('gst', 'cols[1]')} AS gst, sum(value) FILTER (WHERE kind = 'others' AND i = cols[1] AND value <> 0) AS others, {_last('total', 'cols[1]')} AS total, {_last('total', 'cols[2]')} AS total_prior FROM k GROUP BY doc_id""",
    "csr_details": f"""WITH {_cells('csr_details')}, {_AMOUNT}, k AS (SELECT n.*, cols, CASE WHEN label LIKE '%amount required%' OR label LIKE '%obligation%' OR label LIKE '%2\\%%' ESCAPE '\\' THEN 'obligation' WHEN label LIKE '%spent%' AND label NOT LIKE '%unspent%' THEN 'amount_spent' WHEN label LIKE '%unspent%' THEN 'amount_unspent' END AS kind FROM n JOIN amount USING (doc_id))
SELECT doc_id, {_last('obligation', 'cols')} AS obligation, {_last('amount_spent', 'cols')} AS amount_spent, {_last('amount_unspent', 'cols')} AS amount_unspent FROM k GROUP BY doc_id""",
    "msmed_disclosure": f"""WITH {_cells('msmed_disclosure')}, {_AMOUNT}, k AS (SELECT n.*, cols, CASE WHEN label LIKE '%principal%' THEN 'principal_unpaid' WHEN label LIKE '%accrued%' AND label NOT LIKE '%further%' THEN 'interest_accrued_unpaid' WHEN label LIKE '%further%' THEN 'interest_further_due' WHEN label LIKE '%interest%' THEN 'interest_unpaid' END AS kind FROM n JOIN amount USING (doc_id))
SELECT doc_id, {_last('principal_unpaid', 'cols')} AS principal_unpaid, {_last('interest_unpaid', 'cols')} AS interest_unpaid, {_last('interest_accrued_unpaid', 'cols')} AS interest_accrued_unpaid, {_last('interest_further_due', 'cols')} AS interest_further_due FROM k GROUP BY doc_id""",
    "actuarial_assumptions": f"""WITH {_cells('actuarial_assumptions')}, yc AS (SELECT doc_id, list(i ORDER BY i) FILTER (WHERE row_ord = 0 AND regexp_matches(header, '\\d{{4}}')) AS cols FROM n GROUP BY doc_id),
k AS (SELECT doc_id, row_ord, CASE WHEN any_value(label) LIKE '%discount rate%' THEN 'discount' WHEN any_value(label) LIKE '%salary%' THEN 'salary' END AS kind, any_value(CASE WHEN abs(value) <= 30 THEN value END) FILTER (WHERE i = cols[1]) AS now, any_value(CASE WHEN abs(value) <= 30 THEN value END) FILTER (WHERE i = cols[2]) AS before FROM n JOIN yc USING (doc_id) GROUP BY doc_id, row_ord),
f AS (SELECT doc_id, kind, list({{'now': now, 'before': before}} ORDER BY row_ord)[1] AS x FROM k WHERE now IS NOT NULL OR before IS NOT NULL GROUP BY doc_id, kind)
SELECT d.doc_id, d.x.now AS discount_rate_current, d.x.before AS discount_rate_prior, s.x.now AS salary_escalation_current, s.x.before AS salary_escalation_prior FROM f d LEFT JOIN f s ON s.doc_id = d.doc_id AND s.kind = 'salary' WHERE d.kind = 'discount'""",
    "company_ratios": f"""WITH {_cells('company_ratios')} SELECT doc_id, {_trim('any_value(cells[1])')} AS name, any_value(value) FILTER (WHERE i = 1) AS current, any_value(value) FILTER (WHERE i = 2) AS prior, any_value(value) FILTER (WHERE i = 3) AS variance_pct, string_agg(cell, ' ' ORDER BY i) FILTER (WHERE i > 3 AND cell <> '' AND coalesce(value, 0) = 0) AS reason_for_variance FROM n GROUP BY doc_id, row_ord""",
    "trade_receivables_ageing": f"""WITH {_cells('trade_receivables_ageing')}, k AS (SELECT *, CASE WHEN label LIKE '%doubtful%' OR label LIKE '%allowance%' OR label LIKE '%expected credit loss%' THEN 'allowance' WHEN label LIKE '%net%' THEN 'net' WHEN label LIKE '%total%' OR label = '' THEN 'gross' END AS kind FROM n)
SELECT doc_id, {_LITERAL('not_due', 1)}, {_LITERAL('zero_to_six_months', 2)}, {_LITERAL('one_to_two_years', 3)}, {_last('gross', '4')} AS total_gross, {_last('allowance', '4')} AS allowance_doubtful, {_last('net', '4')} AS net_total FROM k GROUP BY doc_id""",
    "trade_payables_ageing": f"""WITH {_cells('trade_payables_ageing')}, k AS (SELECT *, CASE WHEN label LIKE '%micro%' OR label LIKE '%small%' OR label LIKE '%mse%' THEN 'mse' WHEN label LIKE '%other%' THEN 'others' WHEN label LIKE '%total%' THEN 'total' END AS kind FROM n)
SELECT doc_id, {_LITERAL('zero_to_six_months', 1)}, {_LITERAL('one_to_two_years', 2)}, {_last('mse', '3')} AS total_mse, {_last('others', '3')} AS total_others FROM k GROUP BY doc_id""",
    "cwip_ageing": f"""WITH {_cells('cwip_ageing')} SELECT doc_id, (list(value ORDER BY row_ord) FILTER (WHERE i = 5 AND label LIKE '%total%'))[-1] AS total, count(*) FILTER (WHERE i BETWEEN 1 AND 4 AND label NOT LIKE '%total%' AND value <> 0) AS entries FROM n GROUP BY doc_id""",
}
#: The fields of each record that its query gives.
_FIELDS = {
    "contingent_liabilities": ["income_tax", "gst", "others", "total", "total_prior"], "csr_details": ["obligation", "amount_spent", "amount_unspent"],
    "msmed_disclosure": ["principal_unpaid", "interest_unpaid", "interest_accrued_unpaid", "interest_further_due"],
    "actuarial_assumptions": ["discount_rate_current", "discount_rate_prior", "salary_escalation_current", "salary_escalation_prior"],
    "trade_receivables_ageing": ["not_due", "zero_to_six_months", "one_to_two_years", "total_gross", "allowance_doubtful", "net_total"],
    "trade_payables_ageing": ["zero_to_six_months", "one_to_two_years", "total_mse", "total_others"],
}


def _read(name: str, spark, sf_dir):
    return records.read_record(name, _derived(spark, sf_dir, _tables(name), "orders"))


def _record_query(name: str) -> None:
    @_query(f"record_{name}", _RECORD_SQL[name])
    def query(spark, sf_dir):
        read = _read(name, spark, sf_dir)
        if name == "company_ratios":
            return read.select("doc_id", F.inline(name))
        if name == "cwip_ageing":
            return read.select("doc_id", F.col("cwip_ageing.total").alias("total"), F.size("cwip_ageing.projects").cast("long").alias("entries"))
        return read.select("doc_id", *(F.col(f"{name}.{f}").alias(f) for f in _FIELDS[name]))


for _name in _RECORD_TABLES:
    _record_query(_name)


_BUCKETS = "CASE i WHEN 1 THEN 'less_than_1_year' WHEN 2 THEN '1_to_2_years' WHEN 3 THEN '2_to_3_years' WHEN 4 THEN 'more_than_3_years' END"


@_query("unpivot_cwip", f"WITH {_cells('cwip_ageing')} SELECT doc_id, {_trim('cells[1]')} AS project_name, {_BUCKETS} AS age_bucket, value AS amount FROM n WHERE i BETWEEN 1 AND 4 AND label NOT LIKE '%total%' AND value <> 0")
def unpivot_cwip(spark, sf_dir):
    return _read("cwip_ageing", spark, sf_dir).select("doc_id", F.inline("cwip_ageing.projects")).select("doc_id", "project_name", "age_bucket", "amount")


assert QUERIES.keys() >= {f"record_{n}" for n in _RECORD_TABLES}
