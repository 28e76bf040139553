"""The text rules of ``tidemark.functions.text`` on Python strings, for layout rules that see one page at a time.

Tests hold both forms against each other.
"""

from __future__ import annotations

import re
from functools import lru_cache

from tidemark.functions.text import CHARGED_SPELLINGS, DIGITS, GLYPHS, NUMBER, QUALIFIERS

_LETTERS = re.compile("[^a-z]")
_FOLD = str.maketrans("|1l", "iii")
_NUMBER = re.compile(NUMBER)
_NOT_DIGITS = re.compile("[^0-9]")
_GLYPHS = str.maketrans(GLYPHS, DIGITS)
#: The rules ask the same of a page's words many times over, and headers repeat from page to page.
_kept = lru_cache(1 << 14)


@_kept
def edits(a: str, b: str) -> int:
    """Edit distance of two short strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(left + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@_kept
def header_text(t: str | None) -> str:
    return _LETTERS.sub("", (t or "").lower().translate(_FOLD))


@_kept
def qualifier_text(t: str | None) -> str:
    return _LETTERS.sub("", (t or "").lower())


def holds_nearly(t: str | None, target: str, most: int = 1) -> bool:
    return _holds(header_text(t), target, most)


@_kept
def _holds(text: str, target: str, most: int) -> bool:
    sizes = range(max(1, len(target) - most), min(len(text), len(target) + most) + 1)
    return target in text or any(edits(text[k : k + n], target) <= most for n in sizes for k in range(len(text) - n + 1))


@_kept
def is_weight_header(t: str | None) -> bool:
    return not holds_nearly(t, "freight") and ("weight" in (t or "").lower() or holds_nearly(t, "weight"))


@_kept
def is_qualifier(t: str | None) -> bool:
    text = qualifier_text(t)
    if (t or "").strip().lower() in QUALIFIERS or text == "ctual":
        return True
    if not text or re.fullmatch("chargers?", text):
        return False
    return any(abs(len(text) - len(q)) <= 1 and edits(text, q) <= 1 and not (q == "charged" and text.startswith("charger")) for q in QUALIFIERS)


@_kept
def is_actual_token(t: str | None) -> bool:
    text = qualifier_text(t)
    return text in ("actual", "ctual") or (len(text) <= 14 and text.endswith("actual"))


@_kept
def is_charged_token(t: str | None) -> bool:
    return qualifier_text(t) in CHARGED_SPELLINGS


@_kept
def column_kind(t: str | None) -> str | None:
    text = qualifier_text(t)
    return "actual" if "ctual" in text else "charged" if re.search("charged|chargeable|chargd", text) else None


@_kept
def is_number(t: str | None) -> bool:
    return bool(_NUMBER.match((t or "").strip()))


@_kept
def is_damaged_number(t: str | None) -> bool:
    text = re.sub(r"\s", "", (t or "").strip())
    return not is_number(t) and 2 <= len(text) <= 10 and any(c in ".," for c in text) and len(re.findall("[A-Za-z]", text)) <= 3


@_kept
def is_printed_number(t: str | None) -> bool:
    """A plain number with a point or a comma."""
    return bool(re.fullmatch(r"[0-9]{1,6}([.,][0-9]{1,3})?", (t or "").strip()))


def is_decimal(t: str | None) -> bool:
    """A number with decimals and nothing else, as weights are printed."""
    return bool(re.fullmatch(r"[0-9]{1,6}[.,][0-9]{1,3}", (t or "").strip()))


def digits(t: str | None) -> str:
    if t and t.isascii() and t.isdigit():
        return t
    return _NOT_DIGITS.sub("", t or "")


def repaired_digits(t: str | None) -> str | None:
    text = re.sub("[^A-Za-z0-9|]", "", t or "")
    fixed = digits(text.upper().translate(_GLYPHS))
    return fixed if len(text) >= 7 and len(re.sub("[^A-Za-z]", "", text)) <= 2 and fixed else None


def numeric_variants(t: str | None) -> list[str]:
    if not t or (t.isascii() and t.isalpha()):  # no digits, and too many letters
        return []
    return [v for v in dict.fromkeys((digits(t), repaired_digits(t))) if v]
