"""Text -> number / timestamp coercion and null tokens (built-in exprs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cleaning null tokens (compared trimmed and lower-cased).
CLEAN_NULL_TOKENS = ["na", "n/a", "none", "null", "nan", "missing", "unknown", ""]

# CSV reader null tokens (pandas defaults plus "", "NA", "NaN").
CSV_NULL_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                   "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                   "nan", "null"]

# Substrings of a lower-cased column name that mark a date column.
DATE_NAME_HINTS = ["date", "time", "dt", "day"]

# Numeric grammar accepted by the coercion (pandas ``to_numeric`` parity):
# optional sign, decimal with optional exponent, or inf/infinity.
NUMERIC_REGEX = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf(inity)?)$"

# Candidate timestamp formats, tried in this order (month-first before
# day-first, as pandas); a format must match the whole string.
DATE_FORMATS = [
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy",
    "dd/MM/yyyy", "dd-MM-yyyy", "dd MMM yyyy", "MMM dd, yyyy",
    "yyyy-MM-dd HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSS", "yyyy-MM-dd HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss.SSSSSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSSSXXX",
    "yyyy-MM-dd'T'HH:mm", "M/d/yyyy HH:mm:ss", "M/d/yyyy HH:mm", "M/d/yyyy", "d/M/yyyy", "M/d/yy", "d/M/yy",
    "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "yyyyMMdd",
]

# Cheap shape test per format: a failed parse costs an exception per cell,
# so a format is only tried on strings of its shape.
_D = r"\d"
DATE_SHAPES = {
    "yyyy-MM-dd HH:mm:ss": rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}} {_D}{{1,2}}:{_D}{{2}}:{_D}{{2}}$",
    "yyyy-MM-dd'T'HH:mm:ss": rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}}T{_D}{{1,2}}:{_D}{{2}}:{_D}{{2}}$",
    "yyyy-MM-dd'T'HH:mm:ss.SSS": rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}}T{_D}{{1,2}}:{_D}{{2}}:{_D}{{2}}\.{_D}{{3}}$",
    "yyyy-MM-dd HH:mm": rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}} {_D}{{1,2}}:{_D}{{2}}$",
    "yyyy-MM-dd": rf"^{_D}{{4}}-{_D}{{1,2}}-{_D}{{1,2}}$",
    "yyyy/MM/dd": rf"^{_D}{{4}}/{_D}{{1,2}}/{_D}{{1,2}}$",
    "MM/dd/yyyy HH:mm:ss": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}} {_D}{{1,2}}:{_D}{{2}}:{_D}{{2}}$",
    "MM/dd/yyyy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}}$",
    "dd/MM/yyyy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}}$",
    "dd-MM-yyyy": rf"^{_D}{{1,2}}-{_D}{{1,2}}-{_D}{{4}}$",
    "dd MMM yyyy": rf"^{_D}{{1,2}} [A-Za-z]{{3}} {_D}{{4}}$",
    "MMM dd, yyyy": rf"^[A-Za-z]{{3}} {_D}{{1,2}}, {_D}{{4}}$",
    "M/d/yyyy HH:mm:ss": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}} {_D}{{2}}:{_D}{{2}}:{_D}{{2}}$",
    "M/d/yyyy HH:mm": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}} {_D}{{2}}:{_D}{{2}}$",
    "M/d/yyyy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}}$",
    "d/M/yyyy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{4}}$",
    "M/d/yy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{2}}$",
    "d/M/yy": rf"^{_D}{{1,2}}/{_D}{{1,2}}/{_D}{{2}}$",
    "d-M-yyyy": rf"^{_D}{{1,2}}-{_D}{{1,2}}-{_D}{{4}}$",
    "d MMM yyyy": rf"^{_D}{{1,2}} [A-Za-z]{{3}} {_D}{{4}}$",
    "MMM d, yyyy": rf"^[A-Za-z]{{3}} {_D}{{1,2}}, {_D}{{4}}$",
    "MMMM d, yyyy": rf"^[A-Za-z]{{3,9}} {_D}{{1,2}}, {_D}{{4}}$",
    "yyyyMMdd": rf"^{_D}{{8}}$",
}
for _sep in (" ", "T"):
    _start = rf"^{_D}{{4}}-{_D}{{2}}-{_D}{{2}}{_sep}{_D}{{2}}:{_D}{{2}}"
    _part = "yyyy-MM-dd HH:mm" if _sep == " " else "yyyy-MM-dd'T'HH:mm"
    _zone = rf"(Z|[+-]{_D}{{2}}:{_D}{{2}})$"
    DATE_SHAPES.setdefault(_part, _start + "$")
    DATE_SHAPES[_part + ":ss.SSSSSSSSS"] = _start + rf":{_D}{{2}}\.{_D}{{1,9}}$"
    DATE_SHAPES[_part + ":ssXXX"] = _start + rf":{_D}{{2}}{_zone}"
    DATE_SHAPES[_part + ":ss.SSSSSSSSSXXX"] = _start + rf":{_D}{{2}}\.{_D}{{1,9}}{_zone}"

# Python's str.strip() removes every character for which str.isspace() holds.
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip(c: Column) -> Column:
    """Python ``str.strip``: all Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def null_tokens(c: Column, tokens=CLEAN_NULL_TOKENS) -> Column:
    """A trimmed, lower-cased token in ``tokens`` becomes null."""
    return F.when(F.lower(strip(c)).isin(list(tokens)), F.lit(None)).otherwise(c)


def to_numeric(c: Column) -> Column:
    """Coerce text to double; non-numbers become null.

    The regex guard rejects forms Spark's cast would accept but pandas does
    not (``1d``, ``1f``); ``1,000``, ``$5``, ``12%`` are rejected by both."""
    t = strip(c)
    return F.when(t.rlike(NUMERIC_REGEX), t.try_cast("double"))


def to_long(c: Column) -> Column:
    """Text of a plain whole number as bigint, every digit kept; anything else is null."""
    t = strip(c)
    return F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def to_datetime(c: Column, fmt: str) -> Column:
    """Coerce text with one format; bad cells become null.  Zoned forms
    give the UTC time; two-digit years from 69 on are of the 20th century."""
    shape = DATE_SHAPES.get(fmt)
    at = F.try_to_timestamp(c, F.lit(fmt))
    if fmt.endswith("XXX"):
        at = F.to_utc_timestamp(at, F.current_timezone())
    parsed = at.cast("timestamp_ntz")
    if fmt.endswith("/yy"):
        parsed = F.when(F.year(parsed) >= 2069, parsed - F.expr("interval 100 years")).otherwise(parsed)
    return F.when(c.rlike(shape), parsed) if shape else parsed


def integral(c: Column) -> Column:
    """True where a double holds a finite whole number inside bigint range."""
    return (c == F.floor(c)) & (F.abs(c) < F.lit(9.2e18))
