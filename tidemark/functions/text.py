"""Scalar text functions as Columns: header and qualifier words, numeric tokens, glyph repair, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Glyphs that OCR takes for digits, and the digits.
GLYPHS, DIGITS = "OQDIL|ZSGB", "0001112568"
#: Spellings of the two qualifiers that scans produce.
CHARGED_SPELLINGS = ("charged", "chargeable", "chargd", "chargeq", "charget", "cherged")
QUALIFIERS = ("actual", "charged", "chargeable")
NUMBER = r"^[0-9]{1,6}(\.[0-9]{1,3})?$"


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def header_text(c: Column) -> Column:
    """Lower case, look-alikes of i folded to i, letters only."""
    return F.regexp_replace(F.translate(F.lower(_text(c)), "|1l", "iii"), "[^a-z]", "")


def qualifier_text(c: Column) -> Column:
    """Lower-case letters only."""
    return F.regexp_replace(F.lower(_text(c)), "[^a-z]", "")


def digits(c: Column) -> Column:
    """ASCII digits only."""
    return F.regexp_replace(_text(c), "[^0-9]", "")


def within_edits(a: Column, b: Column, most: int) -> Column:
    """Whether the edit distance is at most ``most``; the bounded form stops early and says -1 beyond."""
    return F.levenshtein(a, b, most).between(0, most)


def _some_window(text: Column, size: int, target: str, most: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return (F.length(text) >= size) & F.exists(starts, lambda i: within_edits(F.substring(text, i, F.lit(size)), F.lit(target), most))


def holds_nearly(c: Column, target: str, most: int = 1) -> Column:
    """Whether some stretch of the header text, of the target's length give or take ``most``, is that close to it."""
    text = header_text(c)
    found = F.contains(text, F.lit(target))
    for size in range(max(1, len(target) - most), len(target) + most + 1):
        found = found | _some_window(text, size, target, most)
    # of most + 1 parts of the target one stands unchanged in any stretch that close to it; few words hold one
    n, parts = len(target), most + 1
    if n < parts:
        return found
    pieces = [target[k * n // parts : (k + 1) * n // parts] for k in range(parts)]
    any_piece = F.contains(text, F.lit(pieces[0]))
    for piece in pieces[1:]:
        any_piece = any_piece | F.contains(text, F.lit(piece))
    return any_piece & found


def is_weight_header(c: Column) -> Column:
    """Whether a word heads a weight column; freight, one letter away from it, is ruled out first."""
    freight = holds_nearly(c, "freight", 1)
    return ~freight & (F.contains(F.lower(_text(c)), F.lit("weight")) | holds_nearly(c, "weight", 1))


def is_qualifier(c: Column) -> Column:
    """Whether a word is one of the qualifiers or a near miss; chargers are goods, not headers."""
    text = qualifier_text(c)
    exact = F.lower(F.trim(_text(c))).isin(*QUALIFIERS)
    near = F.lit(False)
    for target in QUALIFIERS:
        close = (F.abs(F.length(text) - len(target)) <= 1) & within_edits(text, F.lit(target), 1)
        near = near | ((close & ~F.startswith(text, F.lit("charger"))) if target == "charged" else close)
    return exact | ((text != "") & ~text.rlike("^chargers?$") & ((text == "ctual") | near))


def is_actual_token(c: Column) -> Column:
    """ACTUAL, also with its first letter lost or a short smudge before it."""
    text = qualifier_text(c)
    return text.isin("actual", "ctual") | ((F.length(text) <= 14) & F.endswith(text, F.lit("actual")))


def is_charged_token(c: Column) -> Column:
    return qualifier_text(c).isin(*CHARGED_SPELLINGS)


def column_kind(c: Column) -> Column:
    """actual, charged or null by the header's words."""
    text = qualifier_text(c)
    return F.when(text.rlike("ctual"), "actual").when(text.rlike("charged|chargeable|chargd"), "charged")


def is_number(c: Column) -> Column:
    """A plain weight: up to six digits and three decimals."""
    return F.trim(_text(c)).rlike(NUMBER)


def is_damaged_number(c: Column) -> Column:
    """Something short with a decimal mark and few letters, as low resolutions make of a number."""
    text = F.regexp_replace(F.trim(_text(c)), r"\s", "")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    return ~is_number(c) & F.length(text).between(2, 10) & text.rlike("[.,]") & (letters <= 3)


def repaired_digits(c: Column) -> Column:
    """Digits of a long, almost numeric token with look-alike glyphs turned back; null if it isn't one."""
    text = F.regexp_replace(F.trim(_text(c)), "[^A-Za-z0-9|]", "")
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    fixed = F.regexp_replace(F.translate(F.upper(text), GLYPHS, DIGITS), "[^0-9]", "")
    return F.when((F.length(text) >= 7) & (letters <= 2) & (fixed != ""), fixed)


def numeric_variants(c: Column) -> Column:
    """Distinct readings of a token as a number: its digits, then the repaired ones."""
    plain = F.when(digits(F.trim(_text(c))) != "", digits(F.trim(_text(c))))
    return F.array_distinct(F.array_compact(F.array(plain, repaired_digits(c))))


def digit_runs(c: Column, low: int = 7, high: int = 12) -> Column:
    """Runs of ``low`` to ``high`` digits of a file name or URL, from left to right."""
    return F.regexp_extract_all(_text(c), F.lit(f"([0-9]{{{low},{high}}})"), 1)


def number_value(c: Column) -> Column:
    """A token as a number, with a comma as decimal point; null if it isn't one."""
    text = F.replace(F.trim(_text(c)), F.lit(","), F.lit("."))
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), text.try_cast("double"))


def decimals(c: Column) -> Column:
    """Number of digits after the first point."""
    return F.length(F.regexp_extract(_text(c), r"\.([0-9]+)", 1))


def safe_upload_name(c: Column) -> Column:
    return F.regexp_replace(_text(c), "[^A-Za-z0-9_.-]", "_")


def safe_id_name(c: Column) -> Column:
    return F.regexp_replace(_text(c), "[^A-Za-z0-9_-]", "_")


def file_name(path: Column) -> Column:
    return F.regexp_extract(_text(path), r"([^/\\]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]*)$", 1))
