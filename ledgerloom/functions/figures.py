"""Numbers of many table cells at once, by Arrow's string kernels: the same reading as ``text.parse_indian_number`` of a cell with a leading digit that extraction cut off put back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import CURRENCY, DIGIT, WHITE

_ALL = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE)
_SPACE = "".join(f"\\x{{{ord(c):x}}}" for c in WHITE if not "\x1c" <= c <= "\x1f")
_SPLIT = rf"^(\d{{1,2}})[{_SPACE}]+([\d,]+\.?\d*|\([\d,]+\.?\d*\))$"
#: What a double is cast from, and the longest that is no infinity whatever its digits.
_DOUBLE, _SAFE = r"^-?(?:\d+\.?\d*|\.\d+)$", 300


def _strip(x: pa.Array) -> pa.Array:
    return pc.utf8_trim(x, characters=WHITE)


def figures(cells: pa.Array) -> pa.Array:
    """The cells' numbers, null of what is none."""
    cells = cells.cast(pa.string())
    at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(cells, DIGIT), False).to_numpy(zero_copy_only=False))
    out, known = np.zeros(len(cells)), np.zeros(len(cells), bool)
    bare = pc.replace_substring_regex(_strip(cells.take(pa.array(at))), _SPLIT, r"\1\2")
    for mark in CURRENCY:
        bare = pc.replace_substring(bare, mark, "")
    bare = _strip(bare)
    open_ = pc.replace_substring_regex(bare, r"(?s)^\((.*)\)$", r"\1")
    inner = _strip(open_)
    minus = pc.starts_with(inner, "-")
    body = _strip(pc.replace_substring(pc.replace_substring_regex(inner, "^-", ""), ",", ""))
    single = pc.invert(pc.match_substring_regex(body, rf"[{_ALL}\x{{e000}}]"))  # white space inside marks several values
    for k, digit in enumerate("०१२३४५६७८९"):
        body = pc.replace_substring(body, digit, str(k))
    body = pc.replace_substring_regex(body, r"[^0-9.\-]", "")
    fits = pc.and_(single, pc.match_substring_regex(body, _DOUBLE)).to_numpy(zero_copy_only=False)
    short = fits & (pc.binary_length(body).to_numpy(zero_copy_only=False) <= _SAFE)
    value = np.zeros(len(at))
    value[short] = body.filter(pa.array(short)).cast(pa.float64()).to_numpy(zero_copy_only=False)
    value[fits & ~short] = [float(x) for x in body.filter(pa.array(fits & ~short)).to_pylist()]
    negative = pc.or_(minus, pc.not_equal(bare, open_)).to_numpy(zero_copy_only=False)
    out[at], known[at] = np.where(negative, -np.abs(value), value), fits
    return pa.array(out, mask=~known)
