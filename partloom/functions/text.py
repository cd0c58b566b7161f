"""Scalar rules for codes, numbers, check digits and texts, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with marks and the plain letters they stand for.
MARKED = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇáàâäãéèêëíìîïóòôöõúùûüñç"
PLAIN = "AAAAAEEEEIIIIOOOOOUUUUNCaaaaaeeeeiiiiooooouuuunc"
# ISO 3779 letter values and position weights of vehicle numbers.
VIN_LETTERS = "0123456789ABCDEFGHJKLMNPRSTUVWXYZ"
VIN_VALUES = "012345678912345678123457923456789"
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)


def without_marks(c: Column) -> Column:
    return F.translate(c, MARKED, PLAIN)


def sanitize(c: Column) -> Column:
    """Canonical code: upper-case letters and digits only. A spreadsheet's trailing `.0` goes, signed
    scientific notation is written out, and cells that hold a date give the empty code."""
    raw = F.trim(c.cast("string"))
    sci = raw.rlike(r"^[0-9](\.[0-9]+)?[eE]\+[0-9]{1,2}$")
    number = F.format_string("%.0f", F.when(sci, raw).cast("double"))
    date = raw.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}(:[0-9]{2})?)?$")
    plain = F.regexp_replace(F.regexp_replace(F.upper(raw), r"^([0-9]+)\.0+$", "$1"), "[^A-Z0-9]", "")
    return F.when(c.isNull() | date, "").when(sci, number).otherwise(plain)


def read_number(c: Column) -> Column:
    """A number written in any locale. Of two kinds of separator the rightmost is the decimal one; one
    that repeats marks thousands; one that occurs once marks thousands if exactly three digits follow."""
    raw = F.trim(c.cast("string"))
    sign = F.when(raw.startswith("-"), -1.0).otherwise(1.0)
    # Spaces between groups of three digits are thousands; other texts with several groups are no number.
    joined = F.regexp_replace(F.regexp_replace(raw, r"(?<=[0-9]) (?=[0-9]{3}(?![0-9]))", ""), r"^[^0-9.,]*|[^0-9.,]*$", "")
    dots, commas = F.length(joined) - F.length(F.replace(joined, F.lit("."))), F.length(joined) - F.length(F.replace(joined, F.lit(",")))
    bare = F.regexp_replace(joined, "[.,]", "")
    last_dot, last_comma = F.length(joined) - F.instr(F.reverse(joined), "."), F.length(joined) - F.instr(F.reverse(joined), ",")
    point = F.when((dots > 0) & (commas > 0), F.greatest(last_dot, last_comma)).when((dots + commas == 1) & ~joined.rlike(r"[.,][0-9]{3}$"), F.when(dots == 1, last_dot).otherwise(last_comma))
    whole = F.regexp_replace(F.when(point.isNull(), joined).otherwise(F.substr(joined, F.lit(1), point)), "[.,]", "")
    part = F.regexp_replace(F.when(point.isNull(), F.lit("")).otherwise(F.substr(joined, point + 2)), "[.,]", "")
    text = F.concat(whole, F.lit("."), part, F.lit("0"))
    return F.when(joined.rlike("^[0-9.,]+$") & (bare != ""), sign * text.cast("double"))


def gtin_digit(body: Column) -> Column:
    """Check digit of a digit body of up to 13 places: weights 3, 1, 3, ... from the left of the body padded to 13."""
    padded = F.lpad(body, 13, "0")
    total = sum((F.substring(padded, k, 1).cast("int") * (3 if k % 2 else 1) for k in range(1, 14)), F.lit(0))
    return F.when(body.rlike("^[0-9]{1,13}$"), F.pmod(10 - total % 10, F.lit(10)))


def gtin_closes(code: Column) -> Column:
    """Whether a code of 8, 12, 13 or 14 digits ends with its check digit; null for other lengths."""
    digits = F.regexp_replace(code, "[^0-9]", "")
    n = F.length(digits)
    return F.when(n.isin(8, 12, 13, 14), gtin_digit(F.substr(digits, F.lit(1), n - 1)) == F.substr(digits, n).cast("int"))


def vin_digit(vin: Column) -> Column:
    """The check character that a vehicle number should have in place 9; null for a length other than 17 or an illegal letter."""
    v = F.upper(vin)
    values = F.translate(v, VIN_LETTERS, VIN_VALUES)
    total = sum((F.substring(values, k + 1, 1).cast("int") * w for k, w in enumerate(VIN_WEIGHTS)), F.lit(0)) % 11
    return F.when(v.rlike("^[0-9A-HJ-NPR-Z]{17}$"), F.when(total == 10, "X").otherwise(total.cast("string")))


def plate_format(c: Column) -> Column:
    """Format of an Argentine plate: `mercosur` AB123CD, `federal` ABC123, `motorcycle` A123BCD or 123ABC; null if none."""
    p = sanitize(c)
    return (
        F.when(p.rlike("^[A-Z]{2}[0-9]{3}[A-Z]{2}$"), "mercosur").when(p.rlike("^[A-Z]{3}[0-9]{3}$"), "federal")
        .when(p.rlike("^[A-Z][0-9]{3}[A-Z]{3}$") | p.rlike("^[0-9]{3}[A-Z]{3}$"), "motorcycle")
    )


def words(c: Column) -> Column:
    """Distinct lower-case words of letters and digits, accents dropped."""
    return F.array_distinct(F.filter(F.split(F.lower(without_marks(c)), "[^a-z0-9]+"), lambda x: x != ""))


def wilson_upper(errors: Column, checked: Column) -> Column:
    """Upper end of the 95 % Wilson interval of a share; 1 where nothing is checked."""
    z, n = 1.959964, checked.cast("double")
    p = errors / n
    return F.when(checked > 0, F.least(F.lit(1.0), (p + z * z / (2 * n) + z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n))).otherwise(1.0)


def upper_median(column: str) -> Column:
    """An aggregate over a column named: the middle value of a group, the larger of two. Counts of values add up within tasks."""
    return -F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{column})")


def natural_key(c: Column) -> Column:
    """A key that sorts texts with numbers as people do (A2 before A10): upper case, digits padded to ten places."""
    parts = F.regexp_extract_all(F.upper(c), F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 10, "0")).otherwise(x)), "")
