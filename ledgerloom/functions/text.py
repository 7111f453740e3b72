"""Text and number functions of disclosure tables as column expressions.

Cells are read by plain chains of string functions, which Spark compiles and whose common parts it evaluates once. Lambdas over
arrays, which it interprets, serve headers, lines of text, and the few tables that hold a record.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cells that mean "nothing" (none of them holds a digit), and currency marks.
NIL = ("-", "–", "—", "NIL", "Nil", "N/A", "NA", "n/a")
CURRENCY = ("₹", "Rs.", "Rs", "INR")
#: White space, by the Unicode property and the separators U+001C to U+001F.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(x: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.trim(x, F.lit(WHITE))  # no function that Spark replaces, as btrim is: those nest badly


def blank(x: Column) -> Column:
    """Null or nothing but white space."""
    return x.isNull() | (strip(x) == "")


def otherwise_null(x: Column) -> Column:
    return F.when(x != "", x)


def let(x: Column, body) -> Column:
    """body(x) with x evaluated once: what is built on it stays linear in size however often it is used."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


DIGIT = "[0-9०-९]"
#: A cell that is a figure as it stands.
PLAIN = r"^[0-9]+(?:\.[0-9]+)?\z"
_WRAPPED = r"(?s)^\((.*)\)$"


def _unmarked(x: Column) -> Column:
    bare = strip(x)
    for mark in CURRENCY:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    return strip(bare)


def _figure(inner: Column) -> Column:
    """The figure of a cell without marks and parentheses, its sign apart; what is none is left with characters, or with nothing, that
    the cast refuses. White space inside marks several values in one cell: it becomes a letter that stays, all others go."""
    body = strip(F.replace(F.regexp_replace(inner, "^-", ""), F.lit(","), F.lit("")))
    joined = F.translate(body, "०१२३४५६७८९" + WHITE, "0123456789" + "\ue000" * len(WHITE))
    return F.regexp_replace(joined, "[^0-9.\\-\ue000]", "").try_cast("double")


def parse_indian_number(x: Column) -> Column:
    """A table cell as a double, or null: lakh commas, currency marks, parentheses or a minus for negatives.

    One chain without conditions but the sign, for columns, where Spark evaluates common parts once.
    """
    bare = _unmarked(x)
    open_ = F.regexp_replace(bare, _WRAPPED, "$1")
    inner = strip(open_)
    value = _figure(inner)
    return F.when((bare != open_) | inner.startswith("-"), -F.abs(value)).otherwise(value)


def is_number(x: Column) -> Column:
    """Whether a cell is a number; its sign is not looked for."""
    return _figure(strip(F.regexp_replace(_unmarked(x), _WRAPPED, "$1"))).isNotNull()


def parse_in_lambda(x: Column) -> Column:
    """parse_indian_number for the inside of lambdas, where Spark evaluates each mention of a part anew."""
    parts = lambda bare: F.struct(bare.alias("bare"), strip(F.regexp_replace(bare, _WRAPPED, "$1")).alias("inner"))
    wrapped = lambda p: p["bare"].startswith("(") & p["bare"].endswith(")") & (F.length(p["bare"]) > 1)
    signed = lambda p: F.struct((wrapped(p) | p["inner"].startswith("-")).alias("negative"), _figure(p["inner"]).alias("value"))
    value = lambda q: F.when(q["negative"], -F.abs(q["value"])).otherwise(q["value"])
    return F.when(x.rlike(PLAIN), x.cast("double")).when(x.rlike(DIGIT), let(let(let(_unmarked(x), parts), signed), value))


def format_indian_number(x: Column, decimals: int = 0) -> Column:
    """1,76,020: the last three digits, then pairs; whole numbers round half to even; "-" stays before what rounds to 0."""
    size = F.abs(x)
    if decimals:
        text = shown(size, "#0." + "0" * decimals)
        whole, rest = F.substring_index(text, ".", 1), F.concat(F.lit("."), F.substring_index(text, ".", -1))
    else:
        whole, rest = F.bround(size, 0).cast("decimal(38,0)").cast("string"), F.lit("")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.regexp_replace(whole, r"(\d)(?=(\d\d)+\d$)", "$1,"), rest)


def shown(x: Column | str, pattern: str) -> Column:
    """A number by a pattern, rounding half to even."""
    return F.call_function("format_number", F.col(x) if isinstance(x, str) else x, F.lit(pattern))


def percent(x: Column) -> Column:
    return shown(x, "#0.00")


def money(x: Column) -> Column:
    return F.coalesce(format_indian_number(x), F.lit("N/A"))


#: What is taken off a label, in this order, and the two spellings of a note reference.
BRACKETS, COLONS, TRAILING_FIGURES, TRAILING_NOTE = (r"\([^)]*\)", r"\[[^\]]*\]"), ":+$", r"(?U)(?:\s+\(?-?\d[\d,]*\.?\d*\)?)+\s*$", r"(?U)\s+\d{1,3}[a-zA-Z]{0,2}\s*$"
NAMED_NOTE, BRACKETED_NOTE = r"(?iU)\bnote\s*(?:no\.?)?\s*(\d+[a-zA-Z]?)\b", r"(?U)\((\d+[a-zA-Z]?)\)\s*$"


def clean_label(x: Column) -> Column:
    """A line item's label for matching: lower case, without brackets, colon, trailing figures and note reference."""
    text = F.lower(strip(x))
    for pattern in BRACKETS:
        text = F.regexp_replace(text, pattern, "")
    text = F.regexp_replace(strip(F.regexp_replace(text, COLONS, "")), r"(?U)\s+", " ")
    for pattern in (TRAILING_FIGURES, TRAILING_NOTE):
        text = F.regexp_replace(text, pattern, "")
    return F.coalesce(strip(text), F.lit(""))


def note_reference(x: Column) -> Column:
    """The note that a label or cell names, or has in brackets at its end."""
    return F.coalesce(otherwise_null(F.regexp_extract(x, NAMED_NOTE, 1)), otherwise_null(F.regexp_extract(x, BRACKETED_NOTE, 1)))


def period(x: Column) -> Column:
    """The date after "year ended" or "period ended", day first."""
    return otherwise_null(F.regexp_extract(x, r"(?iU)(?:year|period)\s+ended?\s+(\d{1,2}\s+\w+\s+\d{4})", 1))


def company_name(x: Column) -> Column:
    """The longest upper-case line of more than three words with LIMITED or LTD; the first of equals."""
    lines = F.transform(F.split(x, r"\R|[\x1c-\x1e]"), strip)
    fit = F.filter(lines, lambda s: (F.upper(s) == s) & (F.lower(s) != s) & s.rlike("LIMITED|LTD") & (F.size(F.split(s, r"(?U)\s+")) > 3))
    return F.aggregate(fit, F.lit(None).cast("string"), lambda best, s: F.when(best.isNull() | (F.length(s) > F.length(best)), s).otherwise(best))


#: A number whose leading digit extraction cut off.
SPLIT_DIGIT = r"^(\d{1,2})(?U:\s)+([\d,]+\.?\d*|\([\d,]+\.?\d*\))$"


def recover_split_digit(x: Column) -> Column:
    """A leading digit that extraction cut off: "6 6,152.58" is 66152.58; null for other cells."""
    text = strip(x)
    return parse_indian_number(F.regexp_replace(F.when(text.rlike(SPLIT_DIGIT), text), SPLIT_DIGIT, "$1$2"))


def is_value_token(x: Column) -> Column:
    return x.rlike(r"^\(?-?[\d,]+(\.\d+)?\)?$|^[-–—]$|^(?i:nil)$") & ~x.rlike(r"^-?\d{1,2}$")


def is_note_token(x: Column) -> Column:
    return x.rlike(r"^\d{1,3}[a-zA-Z]?$") & ~is_value_token(x)


def parse_text_line(x: Column) -> Column:
    """label, note_ref and up to two values of a line of running text; null if it has no value or a label under 3 characters."""
    back = lambda w, i: F.try_element_at(w, F.lit(-i))
    is_value = lambda w, i: F.coalesce(is_value_token(back(w, i)), F.lit(False))

    def counted(w: Column) -> Column:
        values = F.when(is_value(w, 1) & is_value(w, 2), 2).when(is_value(w, 1), 1).otherwise(0)
        return let(values, lambda k: F.struct(w.alias("w"), k.alias("k"), F.try_element_at(w, F.when(k == 2, -3).otherwise(-2)).alias("before")))

    def labelled(p: Column) -> Column:
        noted = F.coalesce(is_note_token(p["before"]), F.lit(False))
        size = lambda n: F.greatest(F.size(p["w"]) - p["k"] - n.cast("int"), F.lit(0))
        return let(noted, lambda n: F.struct(p.alias("p"), n.alias("noted"), F.array_join(F.slice(p["w"], 1, size(n)), " ").alias("label")))

    def fields(q: Column) -> Column:
        w, k, before = q["p"]["w"], q["p"]["k"], q["p"]["before"]
        glued = q["noted"] & F.lower(q["label"]).contains("total")
        first = F.when(k == 2, back(w, 2)).otherwise(back(w, 1))
        whole = F.struct(q["label"].alias("label"), F.when(q["noted"] & ~glued, before).alias("note_ref"), F.when(glued, F.concat(before, first)).otherwise(first).alias("first"), F.when(k == 2, back(w, 1)).alias("second"))
        return F.when((k > 0) & (F.length(q["label"]) >= 3), whole)

    words = F.filter(F.split(strip(x), r"(?U)\s+"), lambda w: w != "")
    return let(let(let(words, counted), labelled), fields)


#: Words whose first five letters tell text from its reversal.
_WORDS = (
    "cash flow hedge hedges reserve reserves surplus equity other income gain loss share shares total amount balance period prior current changes capital "
    "instrument financial statements money received against warrants particulars exchange foreign operations revaluation translation comprehensive effective "
    "portion component compound applicable pending allotment restated beginning reporting errors"
).split()


def _folded(x: Column) -> Column:
    return F.lower(F.translate(x, "\0", ""))


def word_score(x: Column) -> Column:
    return _words_in(_folded(x))


_STEMS = tuple(dict.fromkeys(w[:5] for w in _WORDS))


def _words_in(text: Column) -> Column:
    return sum((text.contains(w).cast("int") for w in _STEMS), F.lit(0))


def fix_reversed(x: Column) -> Column:
    """Lines that read more like words backwards are turned round; their order stays."""
    better = lambda back, line: back.rlike("|".join(_STEMS)) & (_words_in(back) > let(_folded(line), _words_in))
    turn = lambda line: let(F.reverse(line), lambda back: F.when(let(_folded(back), lambda b: better(b, line)), back).otherwise(line))
    return F.array_join(F.transform(F.split(x, "\n", -1), turn), "\n")


def normalize_ref(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)[\s()\[\]]", ""))


#: Phrases of a sheet's content, in the order tried.
SHEET_PHRASES = (
    ("cash_flow", ("cash flow from operating", "cash flow from investing", "cash flow from financing", "net increase/(decrease) in cash")),
    ("balance_sheet", ("balance sheet", "total equity and liabilities")),
    ("pnl", ("profit and loss", "statement of profit", "revenue from operations", "total income")),
)


def any_of(x: Column, needles) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | x.contains(n)
    return out


def sheet_type(name: Column, content: Column) -> Column:
    low = F.lower(name)
    kind = F.when(low.contains("balance"), "balance_sheet").when(any_of(low, ("profit", "loss", "p&l", "pnl")), "pnl").when(low.contains("cash"), "cash_flow")
    for value, needles in SHEET_PHRASES:
        kind = kind.when(any_of(F.lower(content), needles), value)
    return kind.otherwise("unknown")


def safe_div(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.try_divide(a, b))


def rate_cell(x: Column) -> Column:
    return let(parse_in_lambda(x), lambda v: F.when(F.abs(v) <= 30, v))


def format_note_refs(ids: Column) -> Column:
    shown = F.array_join(F.transform(ids, lambda i: F.regexp_replace(i, r"^(\d+)([a-zA-Z]+)$", "$1($2)")), ", ")
    return F.when(F.size(ids) > 1, F.concat(F.lit("Notes "), shown)).when(F.size(ids) == 1, F.concat(F.lit("Note "), shown)).otherwise("")


def standard_name(file_name: Column) -> Column:
    """"Ind AS 116" of a file called "Ind AS 116 - Leases.pdf"; else what stands before the first dash or underscore."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    named = F.regexp_extract(stem, r"(?i)^((?:Ind\s*AS|AS|SA|SQC)\s*\d+)", 1)
    return F.coalesce(otherwise_null(named), strip(F.element_at(F.split(stem, "[-_]"), 1)))


def json_response(x: Column, schema: str) -> Column:
    """A model's JSON answer, fenced or surrounded by prose."""
    bare = strip(F.regexp_replace(x, r"(?s)^\s*```(?:json)?|```\s*$", ""))
    whole = F.from_json(bare, schema, {"mode": "PERMISSIVE"})
    return F.when(bare.startswith("{"), whole).otherwise(F.from_json(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"}))


def year_columns(headers: Column) -> Column:
    """current and prior column numbers (from 0): the latest two years named, each by its first header; null under two years."""
    top = F.transform(headers, lambda h, i: F.struct(F.array_max(F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(r"((?:19|20)\d{2})"), 1)).cast("int").alias("year"), (-i).alias("back")))

    def latest_two(named: Column) -> Column:
        first = F.filter(named, lambda t: ~F.exists(named, lambda u: (u["year"] == t["year"]) & (u["back"] > t["back"])))
        return let(F.sort_array(first, asc=False), lambda x: F.when(F.size(x) >= 2, F.struct((-x[0]["back"]).alias("current_col"), (-x[1]["back"]).alias("prior_col"))))

    return let(F.filter(top, lambda t: t["year"].isNotNull()), latest_two)


def first_header(headers: Column, matches) -> Column:
    """Number (from 0) of the first header that matches; null if none."""
    at = F.array_position(F.transform(headers, lambda h: F.coalesce(matches(F.lower(h)), F.lit(False))), True)
    return F.when(at > 0, (at - 1).cast("int"))


def total_column(headers: Column) -> Column:
    return first_header(headers, lambda h: h.contains("total"))


def label_fill(rows: Column) -> Column:
    """Share of rows with something in the first cell; 0 without rows."""
    filled = F.filter(rows, lambda r: ~F.coalesce(blank(F.get(r, F.lit(0))), F.lit(True)))
    return F.when(F.size(rows) > 0, F.size(filled) / F.size(rows)).otherwise(0.0)
