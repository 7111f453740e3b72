"""Observations: templated text, citations and checks over flags, and a text generator's part in them.

A template is text with slots, ``{money prior}``; slots read the flag's evidence. All templates become one CASE expression. A generator is a
function (system text, message, most tokens) to text, called in the tasks; how many instances run at once is the number of partitions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import format_note_refs, money, percent, standard_name

#: Observation and recommendation of each flag.
TEMPLATES = {
    "CASH_DECLINE": ("Cash and cash equivalents declined by {abs pct_change}% from ₹{money prior} lakh to ₹{money current} lakh, a decline material to the company's total assets.", "Obtain a detailed explanation from management for the decline in cash and cash equivalents, and perform substantive testing of closing cash balances against bank statements and reconciliations."),
    "CFO_PAT_DIVERGENCE": ("Cash flow from operations of ₹{money cfo} lakh is only {hundred cfo_to_pat_ratio}% of reported profit after tax of ₹{money pat} lakh, a material divergence between reported profitability and cash generation.", "Perform a detailed reconciliation between profit after tax and cash flow from operations, and obtain explanations for the working capital movements driving the divergence."),
    "ROU_MATERIAL_INCREASE": ("The right-of-use asset increased by {pct pct_change}% from ₹{money prior} lakh to ₹{money current} lakh, a movement material to total assets.", "Obtain the schedule of lease agreements and corresponding right-of-use assets to verify the increase, and confirm with management that it results from valid new lease transactions rather than errors or misstatements."),
    "CONTINGENT_LIABILITY_JUMP": ("Contingent liabilities increased by ₹{money increase} lakh to ₹{money current_total} lakh, representing {pct exposure_pct_of_equity}% of total equity.", "Obtain a detailed schedule of all contingent liabilities, including the nature of the obligations and their potential financial effects, and confirm status with legal counsel or the relevant authorities where applicable."),
    "OTHER_FIN_ASSETS_SURGE": ("Other financial assets (current) increased by {pct pct_change}% from ₹{money prior} lakh to ₹{money current} lakh, a movement material to total assets.", "Obtain the breakup and supporting documentation for other financial assets, and assess the classification, measurement basis, and recoverability of the balance."),
    "NON_CURRENT_LIABILITIES_SURGE": ("Total non-current liabilities grew by {pct pct_change}% from ₹{money prior} lakh to ₹{money current} lakh, a movement material to total assets.", "Obtain the breakup of non-current liabilities and confirm appropriate classification and disclosure under Schedule III of the Companies Act."),
    "RECEIVABLES_REVENUE_MISMATCH": ("Trade receivables {rose receivables_pct_change} by {abs receivables_pct_change}% while revenue {rose revenue_pct_change} by {abs revenue_pct_change}% over the same period — a divergence of {pct divergence} percentage points between the two.", "Obtain an aging schedule of trade receivables and assess the adequacy of the expected credit loss provision in light of the divergence from revenue growth."),
    "MSE_PAYABLES_INCREASE": ("Trade payables to micro and small enterprises increased by {pct pct_change}% from ₹{money prior} lakh to ₹{money current} lakh.", "Obtain an aging schedule of MSE trade payables due for payment and confirm compliance with the 45-day payment requirement under the MSMED Act, 2006."),
    "PRIOR_YEAR_TAX_MATERIAL": ("Prior year tax adjustments of ₹{money tax_prior_years} lakh represent {hundred ratio}% of the current year tax charge of ₹{money current_tax} lakh.", "Obtain detailed tax computations for the prior and current years and assess the reasons for the prior period adjustment."),
    "JV_PROFIT_DECLINE": ("Share of profit from associates/joint ventures declined by {abs pct_change}% from ₹{money prior} lakh to ₹{money current} lakh.", "Obtain the latest financial statements of the associate/joint venture and assess whether an impairment indicator exists under Ind AS 28 or Ind AS 36."),
    "CSR_UNSPENT": ("Of the CSR obligation of ₹{money obligation} lakh, ₹{money unspent} lakh remains unspent as at year end.", "Obtain the CSR expenditure schedule and confirm that the unspent amount has been transferred to the specified fund/escrow account within the statutory timeline under section 135 of the Companies Act, 2013."),
    "MSME_INTEREST_ACCRUED": ("Interest of ₹{money interest_accrued} lakh has accrued on delayed payments to micro and small enterprises.", "Obtain the MSME interest computation and confirm whether the interest is disallowable for income tax purposes under section 23 of the MSMED Act."),
    "TRADE_PAYABLES_REDUCTION": ("Trade payables (other than MSE) declined by {abs pct_change}% from ₹{money prior} lakh to ₹{money current} lakh while remaining material to total assets.", "Obtain an explanation for the sharp reduction in trade payables and verify whether it reflects early settlement, reclassification, or a data error."),
    "ACTUARIAL_RATE_CHANGE": ("The actuarial discount rate used for defined benefit obligations changed from {pct discount_rate_prior}% to {pct discount_rate_current}%, a change of {pct change_bps} basis points.", "Obtain the actuarial valuation report and confirm that the discount rate is consistent with market yields on government bonds of matching tenure, per Ind AS 19."),
    "CWIP_OVERDUE": ("Capital work-in-progress includes {count overdue_projects} project(s) outstanding for more than 3 years ({projects overdue_projects}), totaling ₹{amounts overdue_projects} lakh.", "Obtain the capitalization timeline for the overdue CWIP projects and assess whether they indicate a need for impairment or should be capitalized or written off."),
    "UNPAID_DIVIDEND": ("The company has an unpaid dividend balance outstanding as at the year end.", "Obtain the unpaid dividend account balance and confirm whether amounts remaining unclaimed for seven years have been transferred to the Investor Education and Protection Fund (IEPF) as required."),
    "XNOTE_CSR_BANK_MISMATCH": ("The CSR unspent balance disclosed in the CSR note (₹{money csr_note_unspent} lakh) does not match the restricted bank balance disclosed elsewhere (₹{money bank_note_restricted} lakh), a difference of ₹{money difference} lakh.", "Reconcile the CSR unspent balance with the restricted bank balance and correct the disclosure if the two are intended to represent the same amount."),
    "XNOTE_LEASE_ROU_MISMATCH": ("New right-of-use asset additions (₹{money rou_additions} lakh) and new lease liabilities recognized (₹{money lease_liability} lakh) differ by {pct diff_pct}%.", "Obtain the lease-by-lease computation and reconcile the right-of-use asset additions with the corresponding lease liability recognized at commencement, per Ind AS 116."),
    "TAX_RECONCILIATION_ERROR": ("The sum of current tax, prior year tax, and deferred tax (₹{money computed_total} lakh) does not equal the disclosed total tax expense (₹{money disclosed_total} lakh), a difference of ₹{money difference} lakh.", "Obtain the detailed tax computation and reconcile the components of tax expense with the amount disclosed in the statement of profit and loss."),
    "CASHFLOW_HEADER_ERROR": ("The cash flow statement's comparative column appears to be labeled with the same year ({first dates_found}) as the current period, suggesting a possible header error.", "Verify the column headers in the cash flow statement and confirm that the comparative period is correctly labeled as the prior year."),
    "AUDIT_TRAIL_LAPSE": ("The auditor's report indicates the accounting software's audit trail (edit log) feature was not continuously operational throughout the year, as required under Rule 11(g) of the Companies (Audit and Auditors) Rules, 2014: “{text excerpt}…”", "Obtain the exact dates and cause of the audit trail gap, confirm whether any transactions during that period lack a traceable edit history, and verify the audit trail has since been restored and preserved per the statutory record-retention requirement."),
    "AUDITOR_EMPHASIS_PARAGRAPH": ("The auditor's report contains a '{text paragraph_type}' paragraph — a section only included when the auditor is drawing specific attention to a matter of fundamental importance: “{text excerpt}…” This is a qualitative disclosure, not a number, so it would not otherwise surface anywhere else in this report.", "Read the full paragraph in the auditor's report and assess whether the underlying matter changes how the rest of this filing's figures should be interpreted."),
    "MULTI_ENTITY_DOCUMENT": ("This document contains {text count} distinct company CINs (Corporate Identification Numbers): {joined distinct_cins}. This tool's analysis assumes a single reporting entity — figures from different companies or schemes bundled into one file may be silently mixed together in the results above, so every other observation in this report should be treated with reduced confidence until the document is split and each entity is analyzed separately.", "Split this document by entity (using the CINs above to identify boundaries) and re-run the analysis on each entity's financial statements individually for a reliable result."),
    "FIRST_OCCURRENCE_": ("{item item} appears for the first time this year at ₹{money current} lakh, representing {pct pct_of_assets}% of total assets — a new and material item not present in the prior year.", "Obtain supporting documentation for the {lower_item item} recognized this year and confirm the basis of its recognition and measurement."),
    "MATERIAL_MOVEMENT_": ("{text display_label} {moved pct_change} by {abs pct_change}% year-over-year, from ₹{money prior} lakh to ₹{money current} lakh — above the {pct threshold_used}% threshold applied for a {text company_size_basis} company.", "Obtain a detailed explanation from management for the movement in {lower display_label} and corroborate it against supporting schedules before relying on the reported figure."),
}
#: What two templates say in a special case.
CONTINGENT_ALONE = "Contingent liabilities of ₹{money current_total} lakh represent a significant {pct exposure_pct_of_equity}% exposure relative to total equity."
MSE_INTEREST = " Interest of ₹{money interest_accrued} lakh has also accrued on delayed payments to these enterprises."
RATING_RANK = {"High": 0, "Medium": 1, "Low": 2}
_PROJECTS = "array<struct<project_name:string,age_bucket:string,amount:double>>"


def _slot(kind: str, name: str) -> Column:
    text = F.get_json_object("evidence", f"$.{name}")
    number = text.cast("double")
    projects = F.from_json(text, _PROJECTS)
    names = F.transform(projects, lambda p: F.when(F.coalesce(p.project_name, F.lit("")) == "", "an unnamed project").otherwise(p.project_name))
    item = F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))
    more = F.when(F.size(projects) > 3, F.concat(F.lit(" and "), (F.size(projects) - 3).cast("string"), F.lit(" more"))).otherwise("")
    strings = F.from_json(text, "array<string>")
    return {
        "text": lambda: text, "money": lambda: money(number), "pct": lambda: percent(number), "abs": lambda: percent(F.abs(number)), "hundred": lambda: percent(number * 100),
        "rose": lambda: F.when(number >= 0, "increased").otherwise("declined"), "moved": lambda: F.when(number > 0, "increased").otherwise("decreased"),
        "item": lambda: item, "lower_item": lambda: F.lower(item), "lower": lambda: F.lower(text), "joined": lambda: F.array_join(strings, ", "), "first": lambda: F.coalesce(F.get(strings, F.lit(0)), F.lit("the current year")),
        "count": lambda: F.size(projects).cast("string"), "projects": lambda: F.concat(F.array_join(F.slice(names, 1, 3), "; "), more), "amounts": lambda: money(F.aggregate(projects, F.lit(0.0), lambda a, p: a + p.amount)),
    }[kind]()


def filled(template: str) -> Column:
    parts = re.split(r"\{(\w+) (\w+)\}", template)
    out = [F.lit(parts[0])]
    for kind, name, text in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
        out += [F.coalesce(_slot(kind, name), F.lit("")), F.lit(text)]
    return F.concat(*out)


def _special(flag_id: str, text: str) -> Column:
    if flag_id == "CONTINGENT_LIABILITY_JUMP":
        return F.when(F.get_json_object("evidence", "$.increase").isNotNull(), filled(text)).otherwise(filled(CONTINGENT_ALONE))
    if flag_id == "MSE_PAYABLES_INCREASE":
        return F.concat(filled(text), F.when(F.get_json_object("evidence", "$.interest_accrued").cast("double") != 0, filled(MSE_INTEREST)).otherwise(""))
    return filled(text)


def templated(flags: DataFrame) -> DataFrame:
    """The flags with observation and recommendation; null for a flag without template."""
    texts = []
    for part in (0, 1):
        case = None
        for flag_id, pair in TEMPLATES.items():
            hit = F.col("flag_id").startswith(flag_id) if flag_id.endswith("_") else F.col("flag_id") == flag_id
            text = _special(flag_id, pair[0]) if part == 0 else filled(pair[1])
            case = F.when(hit, text) if case is None else case.when(hit, text)
        texts.append(case)
    return flags.withColumns({"observation": texts[0], "recommendation": texts[1]})


def citations(retrieved: DataFrame) -> DataFrame:
    """query, citation: the distinct standards of the passages found, in rank order."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("rank", standard_name(F.col("source")).alias("name")))), lambda x: x["name"])
    return retrieved.groupBy("query").agg(F.array_join(F.array_distinct(names), " / ").alias("citation"))


def grounded_citation(citation: Column, sources: Column, passages: Column) -> Column:
    """A model's citation if it names a retrieved standard and all its paragraph numbers stand in the passages, else the sources'."""
    names = F.transform(sources, standard_name)
    numbers = F.regexp_extract_all(citation, F.lit(r"(\d+\.\d+)"), 1)
    holds = F.exists(names, lambda n: citation.contains(n)) & F.forall(numbers, lambda x: F.exists(passages, lambda p: p.contains(x)))
    return F.when(F.coalesce(holds, F.lit(False)), citation).otherwise(F.array_join(F.array_distinct(names), " / "))


def missing_numbers(text: Column, current: Column, prior: Column) -> Column:
    """Whether a figure of at least 100 in the evidence has no number within 1 % of it in the text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d[\d,]*\.?\d*)"), 1), lambda s: F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
    absent = lambda v: F.coalesce((F.abs(v) >= 100) & ~F.exists(found, lambda n: F.abs(n - F.abs(v)) <= F.abs(v) * 0.01), F.lit(False))
    return absent(current) | absent(prior)


def prompt(flags: DataFrame, notes_column: str = "note_text", passages_column: str = "passages") -> Column:
    """What a text generator is asked, with the note cut to 1800 characters."""
    note = F.substring(F.coalesce(F.col(notes_column), F.lit("")), 1, 1800)
    return F.concat_ws("\n", F.concat(F.lit("Flag: "), "flag_id"), F.concat(F.lit("Area: "), "area"), F.concat(F.lit("Severity: "), "severity"), F.concat(F.lit("Reason: "), "triggered_by"), F.concat(F.lit("Evidence: "), "evidence"), F.concat(F.lit("Note: "), note), F.concat(F.lit("Passages: "), F.array_join(passages_column, "\n---\n")))


Generator = Callable[[str, str, int], str]

SYSTEM = (
    "You write audit observations on Indian annual reports from a FLAG with its EVIDENCE, from STANDARD TEXT and from NOTE CONTENT. Use no figure that is not given. Cite the standard by "
    "name, and a paragraph only if its number stands in the text. Say which document, schedule or confirmation is to be obtained. Amounts are in lakh unless stated. "
    'Answer with one JSON object only: {"area": "...", "observation": "...", "risk_rating": "...", "standard_reference": "...", "recommendation": "..."}'
)
SYSTEM_ADDENDUM = (
    "You are given a FACT of a company's accounts and the NOTE CONTENT about it. If the note explains the fact, answer NONE. If it does not, say so in one sentence of at most 25 words, "
    "without any figure that is not in the note. Answer with that sentence or NONE, nothing else."
)
RETRY = "\n\nThe answer before was no valid JSON object. Answer with the JSON object only."
#: Most tokens of an answer and of an addendum, characters of a note that are shown, attempts.
ANSWER, ADDENDUM, NOTE_CHARS, ATTEMPTS = 800, 60, 1800, 2
_FIELDS = ("area", "observation", "recommendation", "standard_reference")


def parsed_answer(raw: str) -> dict | None:
    """A generator's JSON answer, fenced or surrounded by prose; null if it lacks a text field."""
    bare = re.sub(r"^\s*```(?:json)?|```\s*$", "", raw.strip()).strip()
    whole = re.search(r"\{.*\}", bare, re.S)
    for text in (bare, whole[0] if whole else ""):
        try:
            data = json.loads(text)
        except ValueError:
            continue
        if isinstance(data, dict):
            data.setdefault("standard_reference", "")
            return data if all(isinstance(data.get(f), str) for f in _FIELDS) else None
    return None


def _answered(generate: Generator, message: str) -> dict | None:
    """The first valid answer of the attempts; null if there is none, or if the generator fails."""
    for attempt in range(ATTEMPTS):
        try:
            found = parsed_answer(generate(SYSTEM, message + (RETRY if attempt else ""), ANSWER))
        except Exception:  # a failing generator leaves the flag without an observation, not the job without a result
            return None
        if found is not None:
            return found
    return None


def _added(generate: Generator, fact: str, note: str) -> str:
    if not note:
        return fact
    try:
        text = generate(SYSTEM_ADDENDUM, f"FACT: {fact}\n\nNOTE CONTENT:\n{note[:NOTE_CHARS]}\n", ADDENDUM).strip().strip('"')
    except Exception:  # an addendum is never required
        return fact
    return fact if not text or text.upper() == "NONE" else f"{fact} {text}"


def generated(told: DataFrame, generate: Generator, templates: bool = True, addendum: bool = True, instances: int | None = None) -> DataFrame:
    """Templated flags with the generator's part: an addendum where the note does not explain the fact, and whole observations for
    flags without template (for all, with templates=False). Flags that get no valid answer go.

    told: flags with observation and recommendation (templated), note_text and passages. The rating stays the rule's. Adds generated_citation
    and doubtful (a figure of the evidence is missing from the generated text).
    """
    asked = told.withColumn("message", prompt(told)).withColumns({c: F.lit(None).cast("string") for c in ("generated_citation",)})
    kept = [c for c in asked.columns if c != "message"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                message = row.pop("message")
                if templates and row["observation"] is not None:
                    if addendum:
                        row["observation"] = _added(generate, row["observation"], row["note_text"] or "")
                    rows.append(row)
                    continue
                answer = _answered(generate, message)
                if answer is not None:
                    rows.append(row | {"area": answer["area"], "observation": answer["observation"], "recommendation": answer["recommendation"], "generated_citation": answer["standard_reference"]})
            yield pa.RecordBatch.from_pylist(rows, batch.schema.remove(batch.schema.get_field_index("message")))

    dealt = asked.repartition(instances) if instances else asked
    made = dealt.mapInArrow(run, asked.select(*kept).schema)
    figure = lambda name: F.get_json_object("evidence", f"$.{name}").cast("double")
    return made.withColumn("doubtful", F.col("generated_citation").isNotNull() & missing_numbers(F.col("observation"), figure("current"), figure("prior")))


def observations(flags: DataFrame, cited: DataFrame | None = None, generate: Generator | None = None, templates: bool = True, addendum: bool = True, instances: int | None = None) -> DataFrame:
    """Observations in report order: by rating, then in the order of the rules.

    generate: a text generator; flags then have note_text and passages (and sources). Its citations hold only if they are grounded.
    """
    told = templated(flags)
    if generate is not None:
        for name, kind in (("note_text", "string"), ("passages", "array<string>"), ("sources", "array<string>")):
            if name not in told.columns:
                told = told.withColumn(name, F.lit(None).cast(kind))
        told = generated(told.withColumns({"note_text": F.coalesce("note_text", F.lit("")), "passages": F.coalesce("passages", F.array().cast("array<string>"))}), generate, templates, addendum, instances)
    told = told.join(cited, told.standard_query == cited["query"], "left").drop("query") if cited is not None else told.withColumn("citation", F.lit(None).cast("string"))
    if generate is not None:
        grounded = grounded_citation(F.col("generated_citation"), F.coalesce("sources", F.array().cast("array<string>")), F.col("passages"))
        told = told.withColumn("citation", F.when(F.col("generated_citation").isNotNull(), grounded).otherwise(F.col("citation")))
    rank = F.create_map(*(F.lit(x) for pair in RATING_RANK.items() for x in pair))[F.col("severity")]
    order = Window.partitionBy("doc_id").orderBy(rank, "rule_ord", "key_ord")
    return told.select("doc_id", F.row_number().over(order).alias("number"), "flag_id", "area", F.col("severity").alias("rating"), "observation", "recommendation", F.coalesce("citation", F.lit("")).alias("citation"), format_note_refs(F.col("note_ids")).alias("notes"), "evidence", "standard_query")
