"""Scalar column functions (string, math, null, conditional).

Every function takes and returns ``Column`` objects so that the work stays
inside Catalyst expressions and whole-stage codegen.  ANSI mode is on by
default in Spark 4, so parsing and division use the ``try_`` forms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Fixed values that must equal the reference's for identical results.
REJECTED_TITLE = "NOT ACCEPTED IN TRANSFER"
ACCEPTED_FLAG = "Y"
PLACEHOLDER_CODES = ("000", "0000")
MIN_TERM = 200700
CAMPUS_SUFFIX = " (PCC)"
MISSING_CODE = "N/A"
HIGH_CONFIDENCE = 0.65
LOW_CONFIDENCE = 0.35
MIN_DESCRIPTION_LENGTH = 47
# Short names used for catalogue folders of three institutions.
INSTITUTION_ALIASES = {
    "Portland Community College": "PCC",
    "Portland State University": "PSU",
    "Amherst College": "AC",
}
# Names of the equivalence table that differ from the catalogue folders.
INSTITUTION_RENAMES = {
    "Central Oregon Com College": "Central-Oregon-Community-College",
    "Chemeketa Community College": "Chemeketa-Community-College",
    "Clackamas Community College": "Clackamas-Community-College",
    "Lane Community College": "Lane-Community-College",
    "Linn-Benton Community College": "Linn-Benton-Community-College",
    "Mt Hood Community College": "Mt.-Hood-Community-College",
    "Oregon Inst of Technology": "Oregon Inst of Technology",
    "Portland Community College (PCC)": "Portland-Community-College",
    "University of Oregon": "University-of-Oregon",
    "Western Oregon University": "Western-Oregon-University",
}


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def upper_code(c: ColumnOrName) -> Column:
    return F.upper(_c(c))


def lower_text(c: ColumnOrName) -> Column:
    return F.lower(_c(c))


def course_number(c: ColumnOrName) -> Column:
    """First run of ASCII digits as a long; null when the code has none (or more
    digits than a long holds)."""
    digits = F.regexp_extract(_c(c), r"([0-9]+)", 1)
    return F.when(digits == "", F.lit(None).cast("long")).otherwise(digits.try_cast("long"))


def strip_code_suffix(c: ColumnOrName) -> Column:
    """Drop whatever follows the last digit run: ``MTH 112Z`` -> ``MTH 112``."""
    return F.regexp_replace(_c(c), r"([0-9]+)[^0-9]*$", "$1")


def strip_campus_suffix(c: ColumnOrName, suffix: str = CAMPUS_SUFFIX) -> Column:
    return F.replace(_c(c), F.lit(suffix), F.lit(""))


def hyphenate(c: ColumnOrName) -> Column:
    return F.replace(_c(c), F.lit(" "), F.lit("-"))


def dehyphenate(c: ColumnOrName) -> Column:
    return F.replace(_c(c), F.lit("-"), F.lit(" "))


def canonical_institution(c: ColumnOrName) -> Column:
    """Suffix removed first, then spaces become hyphens (one canonical name)."""
    return hyphenate(strip_campus_suffix(c))


def catalogue_institution(c: ColumnOrName, renames: Mapping[str, str] = INSTITUTION_RENAMES) -> Column:
    """Name of the catalogue folder of an institution of the equivalence table:
    the rename map, else the canonical name."""
    known = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else None
    return canonical_institution(c) if known is None else \
        F.coalesce(F.try_element_at(known, _c(c)), canonical_institution(c))


def store_institution(c: ColumnOrName) -> Column:
    """Folder name in the embedding store: aliases apply to the spaced and the
    hyphenated spelling alike; other names pass through."""
    aliases = dict(INSTITUTION_ALIASES)
    aliases |= {k.replace(" ", "-"): v for k, v in INSTITUTION_ALIASES.items()}
    return rename_with(strip_campus_suffix(c), aliases)


def clean_markup(c: ColumnOrName) -> Column:
    return F.lower(F.regexp_replace(_c(c), r"[*+]", ""))


def course_code(subject: ColumnOrName, number: ColumnOrName) -> Column:
    """``subject + ' ' + number``; null when either part is null."""
    return F.concat(_c(subject), F.lit(" "), _c(number).cast("string"))


def composite_text(code: ColumnOrName, title: ColumnOrName, desc: ColumnOrName) -> Column:
    """``code, title, description`` lower-cased; null propagates."""
    return F.lower(F.concat(_c(code), F.lit(", "), _c(title), F.lit(", "), _c(desc)))


def term_year(term: ColumnOrName) -> Column:
    """yyyymm term -> yyyy as a string."""
    return F.floor(_c(term) / 100).cast("int").cast("string")


def academic_year(year: ColumnOrName, year_convention: str = "end") -> Column:
    """The academic year of ``Y``: ``(Y-1)-Y`` if ``Y`` is its end, ``Y-(Y+1)``
    if it is its start."""
    if year_convention not in ("start", "end"):
        raise ValueError(f"unknown year convention {year_convention!r}")
    y = _c(year).try_cast("int")
    first = y if year_convention == "start" else y - 1
    return F.concat_ws("-", first.cast("string"), (first + 1).cast("string"))


def rename_with(c: ColumnOrName, mapping: Mapping[str, str]) -> Column:
    """Map values through a literal dictionary; unmapped values fall through."""
    if not mapping:
        return _c(c)
    lit_map = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(lit_map, _c(c)), _c(c))


def confidence_band(score: ColumnOrName, high: float = HIGH_CONFIDENCE,
                    low: float = LOW_CONFIDENCE) -> Column:
    s = _c(score)
    return (F.when(s > high, "High Confidence")
            .when((s > low) & (s <= high), "Low Confidence")
            .otherwise("No Confidence"))


def relabel_binary(label: ColumnOrName) -> Column:
    """-1 -> 0, anything else -> 1 (applied only when -1 labels are present)."""
    return F.when(_c(label) == -1, 0).otherwise(1)


def threshold_predict(score: ColumnOrName, threshold: float, strict: bool = True,
                      positive: int = 1, negative: int = -1) -> Column:
    """Predict ``positive`` above the threshold.  NaN/null predict ``negative``
    (Spark orders NaN above every number, so it is guarded explicitly)."""
    s = _c(score)
    above = s > threshold if strict else s >= threshold
    return F.when(s.isNotNull() & ~F.isnan(s) & above, positive).otherwise(negative)


def sigmoid(x: ColumnOrName) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def path_segment(path: ColumnOrName, index: int) -> Column:
    """1-based (negative from the end) segment of a ``/`` separated path."""
    return F.try_element_at(F.split(_c(path), "/"), F.lit(index))


def start_year(years: ColumnOrName) -> Column:
    return F.element_at(F.split(_c(years), "-"), 1).try_cast("int")


def fill_zero(c: ColumnOrName) -> Column:
    return F.coalesce(_c(c), F.lit(0.0))


def round_pct(hits: ColumnOrName, n: ColumnOrName) -> Column:
    """100 * hits / n rounded to 2 decimals, half to even (as numpy rounds:
    3.125 -> 3.12)."""
    return F.bround(F.try_divide(100.0 * _c(hits), _c(n)), 2)


def digits_only(c: ColumnOrName) -> Column:
    return _c(c).rlike(r"^[0-9]+\z")
