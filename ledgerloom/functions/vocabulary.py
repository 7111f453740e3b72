"""The chart of accounts that line items map to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Statement, key and label variants, in the order that decides ties.
CHART = """
balance_sheet cash_equivalents: cash and cash equivalents | cash & cash equivalents
balance_sheet bank_balances_other: bank balances other than above | other bank balances
balance_sheet trade_receivables: trade receivables | sundry debtors | accounts receivable
balance_sheet inventories: inventories | stock | fuel oil | stores and spares
balance_sheet current_investments: current investments | short term investments
balance_sheet other_financial_assets_current: other financial assets | other current financial assets
balance_sheet other_current_assets: other current assets
balance_sheet loans_current: loans - current | current loans
balance_sheet total_current_assets: total current assets
balance_sheet ppe_net: property plant and equipment | property, plant and equipment | tangible assets | fixed assets
balance_sheet cwip: capital work-in-progress | capital work in progress | cwip
balance_sheet roa_net: right-of-use asset | right of use assets | rou asset
balance_sheet intangible_assets: other intangible assets | intangible assets
balance_sheet equity_method_investments: investments accounted for using equity method | investments in associates | investments in joint ventures
balance_sheet non_current_investments: non-current investments | long term investments
balance_sheet loans_non_current: loans - non-current | non current loans
balance_sheet other_financial_assets_non_current: other financial assets - non-current
balance_sheet deferred_tax_assets: deferred tax assets
balance_sheet income_tax_assets: income tax assets
balance_sheet other_non_current_assets: other non-current assets | other non current assets
balance_sheet total_non_current_assets: total non-current assets
balance_sheet total_assets: total assets
balance_sheet share_capital: equity share capital | share capital
balance_sheet other_equity: other equity | reserves and surplus
balance_sheet total_equity: total equity | equity attributable to owners
balance_sheet borrowings_current: borrowings - current | short term borrowings | current borrowings | current maturities of long-term debt
balance_sheet lease_liabilities_current: lease liabilities - current
balance_sheet trade_payables_mse: trade payables - micro and small | micro enterprises and small enterprises
balance_sheet trade_payables_others: trade payables - others | creditors other than micro
balance_sheet other_financial_liabilities_current: other financial liabilities - current
balance_sheet other_current_liabilities: other current liabilities
balance_sheet provisions_current: provisions - current
balance_sheet total_current_liabilities: total current liabilities
balance_sheet borrowings_non_current: borrowings - non-current | long-term borrowings | long term borrowings
balance_sheet lease_liabilities_non_current: lease liabilities - non-current
balance_sheet other_financial_liabilities_non_current: other financial liabilities - non-current
balance_sheet provisions_non_current: provisions - non-current
balance_sheet deferred_tax_liabilities: deferred tax liabilities
balance_sheet other_non_current_liabilities: other non-current liabilities
balance_sheet total_non_current_liabilities: total non-current liabilities
balance_sheet total_liabilities: total liabilities
pnl revenue_from_operations: revenue from operations
pnl other_income: other income
pnl total_income: total income
pnl cost_of_services: cost of services rendered | cost of materials consumed | cost of goods sold | purchases
pnl employee_benefits_expense: employee benefits expense | employee benefit expense | staff costs
pnl finance_costs: finance costs | interest and finance charges
pnl depreciation_amortisation: depreciation and amortisation | depreciation
pnl other_expenses: other expenses
pnl total_expenses: total expenses
pnl pbt: profit before tax | profit/(loss) before tax
pnl share_of_jv_profit: share of net profit of associates | share of profit of associates and joint ventures
pnl current_tax: current tax
pnl tax_prior_years: tax pertaining to earlier years | prior year tax
pnl deferred_tax_expense: deferred tax
pnl total_tax_expense: total tax expense | income tax expense
pnl pat: profit for the period | profit/(loss) for the period | profit after tax
pnl oci_defined_benefit: remeasurements of defined benefit plans
pnl oci_foreign_currency: foreign currency translation
pnl oci_equity_method: share of oci of associates and joint ventures
pnl total_oci: other comprehensive income for the period
pnl total_comprehensive_income: total comprehensive income for the period
pnl basic_eps: basic earnings per share
pnl diluted_eps: diluted earnings per share
cash_flow cfo: net cash inflow from operating activities | net cash from operating activities
cash_flow cfi: net cash inflow from investing activities | net cash from investing activities
cash_flow cff: net cash inflow from financing activities | net cash from financing activities
cash_flow net_cash_change: net increase/(decrease) in cash
cash_flow opening_cash: cash at beginning of year | cash at the beginning
cash_flow closing_cash: cash at end of year | cash at the end of the year
"""


def chart() -> list[tuple[str, str, list[str]]]:
    """(statement, key, variants) in order."""
    out = []
    for line in CHART.strip().splitlines():
        head, _, tail = line.partition(": ")
        statement, key = head.split(" ")
        out.append((statement, key, tail.split(" | ")))
    return out


KEYS = [key for _, key, _ in chart()]
STATEMENT = {key: statement for statement, key, _ in chart()}
#: Title case at every letter that follows a non-letter ("Right-Of-Use Asset").
DISPLAY = {key: variants[0].title() for _, key, variants in chart()}


def variants_frame(spark: SparkSession) -> DataFrame:
    """key, variant, variant_ord, key_ord, statement_type, display_label; 121 rows, small enough to broadcast whatever the data."""
    rows, n = [], 0
    for k, (statement, key, variants) in enumerate(chart()):
        for v in variants:
            rows.append((key, v, n, k, statement, DISPLAY[key]))
            n += 1
    return spark.createDataFrame(rows, "key string, variant string, variant_ord int, key_ord int, statement_type string, display_label string")


def lookup(key: F.Column, table: dict[str, str | int]) -> F.Column:
    """A literal map applied to a column, null where absent."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*entries)[key]
