"""Predicates over codes, words and names, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from partloom.functions.text import sanitize, without_marks

# Pairs of characters that are read for one another on engine plates.
LOOKALIKES = [("0", "O"), ("1", "I"), ("5", "S"), ("8", "B"), ("2", "Z"), ("0", "D"), ("6", "G")]
# Words that make a set of a part, and short words that say nothing of it.
KIT = r"\b(KITS?|JUEGOS?|JGOS?|SET|COMBO(?= (?:[0-9]+ FILTROS?|DE)\b))\b"
#: Two codes joined by a plus in brackets: a set that does not say so.
SUM = r"(?i)\(\s*[A-Z0-9][A-Z0-9.\-]{4,}\s*\+\s*[A-Z0-9][A-Z0-9.\-]{4,}\s*\)"
# Parts whose size is their code, and words of descriptions that stray into code columns.
BY_SIZE = r"(?i)\b(RETEN|RETENES|O.?RING|ORING|ANILLO|JUNTA\s+TORICA|SELLO|BUJE|BUJES|RULEMAN|RODAMIENTO|ARANDELA|ESPACIADOR|SEPARADOR)\b"
STRAY = r"(?i)\b(DIESEL|NAFTA|SECTOR|CANAL|JUEGO|ARO|CHAPA|TIPO|MEDIDA)\b"
# Endings of a code that name a side, which makes it another part.
SIDES = ("LH", "RH", "IZQ", "DER", "ISQ", "IZDO", "DCHO", "D", "I")
#: Times that an outer diameter may be the inner one.
WIDEST = 8
FILLERS = ("de", "del", "la", "el", "para", "con", "y", "of", "the", "for", "and", "with")


def lost_digits(c: Column) -> Column:
    """Whether a spreadsheet has cut digits off a number: scientific notation that stands for eight digits or more, and for
    more than it has written."""
    raw = F.trim(c.cast("string"))
    shape = r"^(\d+)(?:[.,](\d+))?[Ee][+-](\d+)$"
    value = F.format_string("%.0f", F.floor(F.replace(raw, F.lit(","), F.lit(".")).try_cast("double")).cast("double"))
    written = F.length(F.regexp_extract(raw, shape, 1)) + F.length(F.regexp_extract(raw, shape, 2))
    return F.coalesce(raw.rlike(shape) & (F.length(value) > written) & (F.length(value) >= 8), F.lit(False))


def excel_decimal(c: Column) -> Column:
    """A code that ends with a spreadsheet's .0."""
    return F.coalesce(F.trim(c.cast("string")).rlike(r"^[0-9]+\.0+$"), F.lit(False))


def suspicious(c: Column, description: Column | None = None) -> Column:
    """Why a code may be none: `empty`, `short`, `small number`, `scientific`, `measure`, `electric`, `symbols` or `description`;
    null where nothing speaks against it. A measure or stray word within what else is a code (four characters or more are left,
    one of them a digit) is none; in parts that are asked for by size, a measure is the code."""
    raw = F.trim(c.cast("string"))
    code = sanitize(c)
    left = lambda pattern: F.regexp_replace(F.regexp_replace(raw, pattern, ""), "[^A-Za-z0-9]", "")
    still = lambda pattern: left(pattern).rlike("^(?=.*[0-9]).{4,}$")
    times = r"[0-9]\s*[xX]\s*[0-9]+[.,]?[0-9]*\s*[xX]?\s*[0-9]*\s*(MM|mm)?$"
    unit = r"(?i)(?<![A-Z0-9])([0-9]+)\s*(MM|CM|CC|ML|KG|GR|LTS?)\b"
    marks = "[\u00d8\"\u2033]"
    figures = F.length(F.regexp_replace(F.regexp_extract(raw, unit, 1), "^0+(?=.)", ""))
    most = F.when(F.upper(F.regexp_extract(raw, unit, 2)).isin("LT", "LTS", "KG"), 3).otherwise(4)
    sized = F.lit(False) if description is None else F.coalesce(description.rlike(BY_SIZE), F.lit(False))
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "empty").when(F.length(code) <= 2, "short").when(code.rlike("^[0-9]{1,3}$"), "small number")
        .when(raw.rlike(r"^[0-9]+([.,][0-9]+)?[Ee][+\-][0-9]+$"), "scientific")
        .when(~sized & raw.rlike(times) & ~still(times), "measure").when(~sized & raw.rlike(unit) & (figures <= most), "measure")
        .when(~sized & raw.rlike(r"(?i)^[0-9]{1,4}([.,][0-9]+)?\s*[VW]$"), "electric")
        .when(~sized & raw.rlike(marks) & ~still(marks + r"|[0-9]+\s*/\s*[0-9]+|[0-9]+[.,][0-9]+"), "symbols")
        .when(raw.rlike(STRAY) & ~still(STRAY), "description")
    )


def reads_as_text(c: Column, known: Column | None = None) -> Column:
    """Whether what was typed into a search for codes is a description: words of three letters or more; with digits only if
    no token of five characters has one and two plain words stand beside. Commas mark a list of codes. known: whether the whole
    is a code that exists, which makes it no description."""
    text = F.trim(F.coalesce(c, F.lit("")))
    tokens = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    plain = lambda x: without_marks(x).rlike("^[A-Za-z]{3,}$")
    digits = F.exists(tokens, lambda x: x.rlike("[0-9]") & (F.length(sanitize(x)) >= 5)) | (F.size(F.filter(tokens, plain)) < 2)
    alone = (F.size(tokens) == 1) & (F.length(sanitize(text)) < 4)
    there = F.lit(False) if known is None else F.coalesce(known, F.lit(False))
    return ~there & (sanitize(text) != "") & ~text.contains(",") & ~(text.rlike("[0-9]") & digits) & ~alone & F.exists(tokens, lambda x: without_marks(x).rlike("[A-Za-z]{3,}"))


def starts_with_one_of(c: Column, names: list[str]) -> Column:
    """Whether a part's name, or its second word behind a token of three characters or with a digit, begins with one of
    names, as a whole word or its plural."""
    words = F.upper(F.trim(F.regexp_replace(without_marks(c), r"\s+", " ")))
    first = F.substring_index(words, " ", 1)
    rest = F.when((F.length(first) <= 3) | first.rlike("[0-9]"), F.substr(words, F.length(first) + 2)).otherwise(F.lit(""))
    pattern = "^(" + "|".join(names) + ")( |S|$)"
    return F.coalesce(words.rlike(pattern) | rest.rlike(pattern), F.lit(False))


def risk(c: Column, safety: list[str], engine: str) -> Column:
    """critical: a part of safety; high: it may break the engine; else normal."""
    return F.when(starts_with_one_of(c, safety), "critical").when(F.upper(without_marks(c)).rlike(engine), "high").otherwise("normal")


def is_kit(c: Column) -> Column:
    """Whether a description is of a set: by its word, or as it names two codes added up in brackets."""
    plain = F.regexp_replace(F.regexp_replace(F.upper(without_marks(c)), "[-./,;:()]", " "), r"\s+", " ")
    return F.coalesce(plain.rlike(KIT) | c.rlike(SUM), F.lit(False))


def core_words(c: Column) -> Column:
    """Words of a part's name: letters only, three or more, no fillers, once each in order."""
    words = F.split(F.lower(without_marks(c)), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda x: x.rlike("^[a-z]{3,}$") & ~x.isin(*FILLERS)))


def name_likeness(a: Column, b: Column) -> Column:
    """Words in common over all words of two names; 0 where both have none."""
    x, y = core_words(a), core_words(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def singulars(c: Column) -> Column:
    """How a plural in capitals may be written in the singular: without S after a vowel, without ES after a consonant in
    words of seven letters or more; of two forms the shorter, as it finds what the longer does."""
    w = F.upper(c)
    fits = w.rlike("^[A-ZÑ]{4,}S$")
    short = fits & w.rlike("[^AEIOU]ES$") & (F.length(w) >= 7)
    return (
        F.when(short, F.array(F.substr(w, F.lit(1), F.length(w) - 2))).when(fits & w.rlike("[AEIOU]S$"), F.array(F.substr(w, F.lit(1), F.length(w) - 1)))
        .otherwise(F.array().cast("array<string>"))
    )


def search_words(c: Column) -> Column:
    """struct(words, year): the words of a search without fillers, and the year that one of them is."""
    tokens = F.array_distinct(F.filter(F.split(F.lower(without_marks(c)), "[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(*FILLERS)))
    year = F.get(F.filter(tokens, lambda x: x.rlike("^(19|20)[0-9]{2}$")), 0).cast("int")
    return F.struct(F.filter(tokens, lambda x: ~x.rlike("^(19|20)[0-9]{2}$")).alias("words"), year.alias("year"))


def engine_variants(c: Column, least: int = 4) -> Column:
    """Readings of an engine number with one character taken for its like, once each and sorted."""
    likes: dict[str, list[str]] = {}
    for x, y in LOOKALIKES:
        likes.setdefault(x, []).append(y)
        likes.setdefault(y, []).append(x)
    like = F.create_map(*[z for a, bs in likes.items() for z in (F.lit(a), F.array(*map(F.lit, bs)))])
    none = F.array().cast("array<string>")
    swapped = lambda code, k: F.transform(F.coalesce(F.element_at(like, F.substr(code, k, F.lit(1))), none), lambda b: F.concat(F.substr(code, F.lit(1), k - 1), b, F.substr(code, k + 1)))
    found = lambda code: F.array_sort(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(code)), lambda k: swapped(code, k)))))
    # As the one element of an array, the code is made once and not at each place that reads it.
    return F.get(F.transform(F.array(sanitize(c)), lambda code: F.when(F.length(code) >= least, found(code)).otherwise(none)), 0)


def mended_vin(c: Column) -> Column:
    """A vehicle number without the letters it cannot have: I is 1, O and Q are 0."""
    return F.translate(F.upper(F.regexp_replace(c, r"[\s-]", "")), "IOQ", "100")


def shelf(c: Column) -> Column:
    """struct(rack, module, level) of a place such as B12-3-4, B12-3 or B12; null if it is written otherwise or has a zero."""
    shape = r"^\s*([A-Za-z]{1,2}[0-9]{0,3})(?:\s*-\s*([0-9]{1,3}))?(?:\s*-\s*([0-9]{1,3}))?\s*$"
    part = lambda k: F.nullif(F.regexp_extract(c, shape, k), F.lit(""))
    module, level = part(2).cast("int"), part(3).cast("int")
    fine = c.rlike(shape) & ~F.coalesce(module == 0, F.lit(False)) & ~F.coalesce(level == 0, F.lit(False))
    return F.when(fine, F.struct(F.upper(part(1)).alias("rack"), module.alias("module"), level.alias("level")))


def half_precision(x: Column) -> Column:
    """Half of the last digit written: 0.5 for 52, 0.05 for 52.4, 0.005 for 52.41, else none."""
    near = lambda d: F.abs(x - F.round(x, d)) < 1e-9
    return F.when(near(0), 0.5).when(near(1), 0.05).when(near(2), 0.005).otherwise(0.0)


def accepted_difference(a: Column, b: Column, fixed: float = 0.25, share: float = 0.03) -> Column:
    """The difference in mm at which two measures are still one: the larger of a fixed one and half of either's last digit,
    at most a share of the larger measure."""
    return F.least(F.greatest(F.lit(fixed), half_precision(a), half_precision(b)), F.greatest(a, b) * share)


def base_code(c: Column) -> Column:
    """A code without the endings that name a size or material of one part: parted at dash, blank and dot, its last parts of up
    to four characters go while over two parts are left; a side stays. 4505CG1 (digits, two letters, a digit) is 4505. Null if
    no digit is left."""
    u = F.regexp_replace(F.upper(F.trim(c)), r"[\s.]+", "-")
    glued = F.regexp_extract(u, r"^([0-9]{3,5})[A-Z]{2}[0-9](-COMP)?$", 1)
    parts = F.filter(F.split(u, "-"), lambda x: x != "")
    # The last part of over four characters, or the second, is the last that stays as it is.
    last = F.array_max(F.concat(F.array(F.lit(0)), F.transform(parts, lambda x, i: F.when(F.length(x) > 4, i + 1).otherwise(0))))
    keep = F.least(F.size(parts), F.greatest(last, F.lit(2)))
    sides = F.filter(parts, lambda x, i: (i >= keep) & x.isin(*SIDES))
    base = F.array_join(F.concat(F.slice(parts, F.lit(1), keep), sides), "-")
    return F.when(glued != "", glued).when(base.rlike("[0-9]"), base)


def impossible_measures(inner: Column, outer: Column, *others: Column) -> Column:
    """Reasons why measures cannot be: one is negative, the inner is not under the outer, or the outer over eight times the
    inner. A zero stands for none."""
    every = (inner, outer, *others)
    both = (inner != 0) & (outer != 0)
    return F.array_compact(F.array(
        F.when(F.greatest(*[F.coalesce((m < 0).cast("int"), F.lit(0)) for m in every]) > 0, "negative"), F.when(both & (inner >= outer), "inner not under outer"),
        F.when(both & (inner < outer) & (outer > WIDEST * inner), "outer over eight times the inner"),
    ))
