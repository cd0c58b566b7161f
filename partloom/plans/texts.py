"""Queries over codes, names, texts and days, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.functions import checks, days, extract, text
from partloom.functions.staging import dealt
from partloom.plans.registry import QUERIES, query

BEFORE = set(QUERIES)
#: Texts made from the part table; these expressions read alike in both engines.
CODES = """CASE p_partkey % 8 WHEN 0 THEN concat('7.79396E+', 10 + p_partkey % 3) WHEN 1 THEN concat(p_partkey, '.0') WHEN 2 THEN '2.5E+3' WHEN 3 THEN concat(1990 + p_partkey % 30) WHEN 4 THEN concat(p_partkey % 90, ' mm')
WHEN 5 THEN concat('K', p_partkey, '-STD') WHEN 6 THEN concat('AA', p_partkey % 10) ELSE '--' END"""
NAMES_OF = """concat(CASE p_partkey % 6 WHEN 0 THEN 'KIT ' WHEN 1 THEN 'Juego de ' WHEN 2 THEN 'T4 ' ELSE '' END, p_name, CASE p_partkey % 5 WHEN 0 THEN ' 1998-2004' WHEN 1 THEN ' delantero izq' WHEN 2 THEN ' 2010> diesel' WHEN 3 THEN ' de 16v 2007' ELSE ' largo: 35,5 mm 12 dientes' END)"""


def parts(v, **made):
    # As a generated row, a text is made once and not at each place that reads it.
    return dealt(v.table("part"), "p_partkey").select(F.col("p_partkey").alias("part"), F.inline(F.array(F.struct(*[F.expr(e).alias(n) for n, e in made.items()]))))


def source(**made):
    return "(SELECT p_partkey AS part, " + ", ".join(f"{e} AS {n}" for n, e in made.items()) + " FROM part)"


CLEAN = """CASE WHEN regexp_full_match(trim({0}), '[0-9](\\.[0-9]+)?[eE]\\+[0-9]{{1,2}}') THEN printf('%.0f', CAST({0} AS DOUBLE)) ELSE regexp_replace(regexp_replace(upper(trim({0})), '^([0-9]+)\\.0+$', '\\1'), '[^A-Z0-9]', '', 'g') END"""


@query(f"""WITH r AS (SELECT part, raw, regexp_full_match(raw, '[0-9]+([.,][0-9]+)?[Ee][+-][0-9]+') AS s FROM {source(raw=CODES)}),
n AS (SELECT part, raw, CASE WHEN s THEN length(printf('%.0f', CAST(raw AS DOUBLE))) END AS digits, CASE WHEN s THEN length(replace(split_part(raw, 'E', 1), '.', '')) END AS written FROM r)
SELECT part, raw, coalesce(digits > written AND digits >= 8, FALSE) AS lost FROM n""")
def lost_digits(v):
    """Codes of which a spreadsheet has cut off digits."""
    return parts(v, raw=CODES).withColumn("lost", checks.lost_digits(F.col("raw")))


@query(f"SELECT part, raw FROM {source(raw=CODES)} WHERE regexp_full_match(raw, '[0-9]+\\.0+')")
def excel_decimals(v):
    """Codes that end with a spreadsheet's .0."""
    return parts(v, raw=CODES).where(checks.excel_decimal(F.col("raw")))


@query(f"SELECT part, raw, stored FROM (SELECT part, raw, CASE WHEN part % 3 = 0 THEN upper(raw) ELSE {CLEAN.format('raw')} END AS stored, {CLEAN.format('raw')} AS code FROM {source(raw=CODES)}) WHERE stored <> code")
def stale_codes(v):
    """Rows whose stored code is not what the rule gives today."""
    rows = parts(v, raw=CODES).withColumn("code", text.sanitize(F.col("raw")))
    return rows.withColumn("stored", F.when(F.col("part") % 3 == 0, F.upper("raw")).otherwise(F.col("code"))).where("stored <> code").select("part", "raw", "stored")


#: What stands in columns of codes: codes, numbers, measures alone and within codes, and pieces of descriptions.
CELL = """CASE p_partkey % 16 WHEN 0 THEN concat(p_size, 'x', p_size + 20, 'x7') WHEN 1 THEN concat('H', p_partkey, 'A1/2"RF') WHEN 2 THEN concat(p_partkey % 2000, ' cc') WHEN 3 THEN concat('MD-', p_partkey, 'V') WHEN 4 THEN concat(p_size, 'V')
WHEN 5 THEN concat('278.', p_partkey, ' c/CHAPA') WHEN 6 THEN 'JUEGO DE AROS DIESEL' WHEN 7 THEN concat('1.0', p_size, 'E+', p_partkey % 14) WHEN 8 THEN concat('BE-', p_partkey) WHEN 9 THEN concat(p_partkey % 4000) WHEN 10 THEN concat('E0NN', p_partkey, 'CC')
WHEN 11 THEN concat(p_partkey % 5000, 'LT') WHEN 12 THEN concat('1/', p_size % 9, '"') WHEN 13 THEN concat('F000 TE1 3X', p_size) WHEN 14 THEN concat('A', p_partkey % 12) ELSE concat('  ', p_brand, ' ') END"""
KIND = "CASE p_size % 3 WHEN 0 THEN 'RETEN CIGUENAL' WHEN 1 THEN 'Buje de bronce' ELSE p_name END"
LEFT = "regexp_replace(regexp_replace(raw, {0}, '', 'g'), '[^A-Za-z0-9]', '', 'g')"
STILL = "(length(" + LEFT + ") >= 4 AND regexp_matches(" + LEFT + ", '[0-9]'))"
XS, MARKED_, STRAYS = "'[0-9]\\s*[xX]\\s*[0-9]+[.,]?[0-9]*\\s*[xX]?\\s*[0-9]*\\s*(MM|mm)?$'", "'[Ø\"″]|[0-9]+\\s*/\\s*[0-9]+|[0-9]+[.,][0-9]+'", "'(?i)\\b(DIESEL|NAFTA|SECTOR|CANAL|JUEGO|ARO|CHAPA|TIPO|MEDIDA)\\b'"


@query(f"""WITH c AS (SELECT part, trim(raw) AS raw, kind, {CLEAN.format('raw')} AS code, regexp_matches(kind, '(?i)\\b(RETEN|RETENES|BUJES?|ANILLO|RULEMAN)\\b') AS sized FROM {source(raw=CELL, kind=KIND)}),
u AS (SELECT *, regexp_extract(concat(' ', raw), '(?i)[^A-Z0-9]([0-9]+)\\s*(MM|CM|CC|ML|KG|GR|LTS?)\\b', ['n', 'u']) AS m FROM c),
s AS (SELECT part, raw, CASE WHEN length(code) <= 2 THEN 'short' WHEN regexp_full_match(code, '[0-9]{{1,3}}') THEN 'small number' WHEN regexp_full_match(raw, '[0-9]+([.,][0-9]+)?[Ee][+-][0-9]+') THEN 'scientific'
  WHEN NOT sized AND regexp_matches(raw, {XS}) AND NOT {STILL.format(XS)} THEN 'measure' WHEN NOT sized AND m.n <> '' AND length(CAST(CAST(m.n AS BIGINT) AS VARCHAR)) <= CASE WHEN upper(m.u) IN ('LT', 'LTS', 'KG') THEN 3 ELSE 4 END THEN 'measure'
  WHEN NOT sized AND regexp_full_match(raw, '(?i)[0-9]{{1,4}}([.,][0-9]+)?\\s*[VW]') THEN 'electric' WHEN NOT sized AND regexp_matches(raw, '[Ø"″]') AND NOT {STILL.format(MARKED_)} THEN 'symbols' WHEN regexp_matches(raw, {STRAYS}) AND NOT {STILL.format(STRAYS)} THEN 'description' END AS reason FROM u)
SELECT part, raw, reason FROM s WHERE reason IS NOT NULL""")
def junk_codes(v):
    """Codes that may be none, with the reason; a measure is the code of a part that is asked for by size."""
    rows = parts(v, raw=CELL, kind=KIND).select("part", F.trim("raw").alias("raw"), checks.suspicious(F.col("raw"), F.col("kind")).alias("reason"))
    return rows.where("reason is not null")


TYPED = "CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN concat('W', p_partkey, '/94') WHEN 2 THEN concat('filter ', 10000 + p_partkey) WHEN 3 THEN 'abc' WHEN 4 THEN 'oil, air' ELSE concat('old red car ', p_partkey % 9) END"


#: Some of what is typed is there as a code, words or not.
KNOWN = "(SELECT DISTINCT upper(replace(p_name, ' ', '')) AS code FROM part WHERE p_size % 4 = 0)"


@query(f"""WITH t AS (SELECT part, trim(typed) AS typed, list_filter(regexp_split_to_array(trim(typed), '\\s+'), lambda x: x <> '') AS w, regexp_replace(upper(typed), '[^A-Z0-9]', '', 'g') AS code FROM {source(typed=TYPED)}),
f AS (SELECT *, len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z]{{3,}}'))) AS plain, len(list_filter(w, lambda x: regexp_matches(x, '[0-9]') AND length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) >= 5)) AS codes FROM t)
SELECT part, typed, NOT contains(typed, ',') AND NOT (regexp_matches(typed, '[0-9]') AND (codes > 0 OR plain < 2)) AND NOT (len(w) = 1 AND length(code) < 4) AND len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]{{3,}}'))) > 0
AND code <> '' AND code NOT IN (SELECT code FROM {KNOWN}) AS as_text FROM f""")
def search_routing(v):
    """Whether what is typed goes to the search of texts rather than of codes."""
    known = v.table("part").where("p_size % 4 = 0").select(F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("code")).distinct().withColumn("known", F.lit(True))
    rows = parts(v, typed=TYPED).withColumn("code", text.sanitize(F.col("typed"))).join(known, "code", "left")
    return rows.select("part", F.trim("typed").alias("typed"), checks.reads_as_text(F.col("typed"), F.col("known")).alias("as_text"))


@query(f"""WITH n AS (SELECT part, upper(name) AS u FROM {source(name=NAMES_OF)}), w AS (SELECT part, u, split_part(u, ' ', 1) AS f FROM n)
SELECT part, CASE WHEN regexp_matches(u, '^(RED|GREEN)( |S|$)') OR (length(f) <= 3 OR regexp_matches(f, '[0-9]')) AND regexp_matches(substr(u, length(f) + 2), '^(RED|GREEN)( |S|$)') THEN 'critical' WHEN contains(u, 'BOLT') OR contains(u, 'GEAR') THEN 'high' ELSE 'normal' END AS risk FROM w""")
def part_risk(v):
    """Risk class of every part by its name: here red and green ones are of safety, bolts and gears may break more."""
    return parts(v, name=NAMES_OF).select("part", checks.risk(F.col("name"), ["RED", "GREEN"], "BOLT|GEAR").alias("risk"))


SETS = """CASE p_partkey % 9 WHEN 0 THEN concat('KIT-', p_name) WHEN 1 THEN concat(p_name, ' (LK', 10000 + p_partkey, ' + LW', 10000 + p_size, ')') WHEN 2 THEN concat('COMBO DE ', p_name) WHEN 3 THEN concat('combo ', p_size, ' filtros') WHEN 4 THEN concat('COMBO ', p_name)
WHEN 5 THEN concat('Jgo.', p_name) WHEN 6 THEN concat('CONJUNTO ', p_name) WHEN 7 THEN concat(p_name, ' (', 3000000 + p_partkey, '/', 3400000 + p_size, ')') ELSE concat('asset ', p_name, ' juegos') END"""


@query(f"""SELECT part, name, regexp_matches(regexp_replace(regexp_replace(upper(name), '[-./,;:()]', ' ', 'g'), '\\s+', ' ', 'g'), '\\b(KITS?|JUEGOS?|JGOS?|SET|COMBO ([0-9]+ FILTROS?|DE))\\b')
OR regexp_matches(upper(name), '\\(\\s*[A-Z0-9][A-Z0-9.-]{{4,}}\\s*\\+\\s*[A-Z0-9][A-Z0-9.-]{{4,}}\\s*\\)') AS kit FROM {source(name=SETS)}""")
def kits(v):
    """Which descriptions are of sets."""
    return parts(v, name=SETS).withColumn("kit", checks.is_kit(F.col("name")))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND x NOT IN (" + ", ".join(f"'{x}'" for x in checks.FILLERS) + ")))"


@query(f"""WITH n AS (SELECT part, name, lead(name) OVER (ORDER BY part) AS other FROM {source(name=NAMES_OF)}), w AS (SELECT part, {WORDS.format('name')} AS x, {WORDS.format('other')} AS y FROM n WHERE other IS NOT NULL)
SELECT part, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 6) AS likeness FROM w""")
def name_likeness(v):
    """How alike the names of a part and the next one are."""
    rows = parts(v, name=NAMES_OF)
    after = rows.select((F.col("part") - 1).alias("part"), F.col("name").alias("other"))
    return rows.join(after, "part").select("part", F.round(checks.name_likeness(F.col("name"), F.col("other")), 6).alias("likeness"))


@query("""WITH w AS (SELECT DISTINCT upper(unnest(regexp_split_to_array(lower(text), '[^a-zñ]+'))) AS word FROM documents), p AS (SELECT word FROM w UNION SELECT word || 'ES' FROM w UNION SELECT word || 'S' FROM w)
SELECT word, CASE WHEN NOT regexp_full_match(word, '[A-ZÑ]{4,}S') THEN '' WHEN length(word) >= 7 AND regexp_matches(word, '[^AEIOU]ES$') THEN left(word, length(word) - 2) WHEN regexp_matches(word, '[AEIOU]S$') THEN left(word, length(word) - 1) ELSE '' END AS forms FROM p WHERE word <> ''""")
def singular_forms(v):
    """How every word of the texts, and its plurals, may be written in the singular."""
    w = v.table("documents").select(F.explode(F.split(F.lower("text"), "[^a-zñ]+")).alias("word")).distinct().withColumn("word", F.upper("word"))
    w = w.select(F.explode(F.array("word", F.concat("word", F.lit("ES")), F.concat("word", F.lit("S")))).alias("word")).distinct().where("word <> ''")
    return w.withColumn("forms", F.array_join(checks.singulars(F.col("word")), " "))


@query(f"""WITH t AS (SELECT part, list_distinct(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: x <> '' AND x NOT IN ({", ".join(f"'{x}'" for x in checks.FILLERS)}))) AS w FROM {source(name=NAMES_OF)})
SELECT part, array_to_string(list_sort(list_filter(w, lambda x: NOT regexp_full_match(x, '(19|20)[0-9][0-9]'))), ' ') AS words, CASE part % 5 WHEN 0 THEN 1998 WHEN 2 THEN 2010 WHEN 3 THEN 2007 END AS year FROM t""")
def search_words(v):
    """What a search asks for: words without fillers, and a year."""
    rows = parts(v, name=NAMES_OF).withColumn("s", checks.search_words(F.col("name")))
    return rows.select("part", F.array_join(F.array_sort("s.words"), " ").alias("words"), "s.year")


LIKES = "[" + ", ".join(f"['{a}', '{b}']" for x, y in checks.LOOKALIKES for a, b in ((x, y), (y, x))) + "]"


@query(f"""WITH e AS (SELECT p_partkey AS part, concat('B', p_partkey, 'O') AS number FROM part), k AS (SELECT part, number, unnest(range(1, length(number) + 1)) AS k FROM e),
f AS (SELECT part, number, k, unnest({LIKES}) AS p FROM k) SELECT e.part, e.number, coalesce(array_to_string(forms, ' '), '') AS forms FROM e LEFT JOIN (SELECT part, list_sort(list(DISTINCT concat(substr(number, 1, k - 1), p[2], substr(number, k + 1)))) AS forms FROM f WHERE substr(number, k, 1) = p[1] AND length(number) >= 4 GROUP BY part) g ON g.part = e.part""")
def engine_number_variants(v):
    """Readings of an engine number that has one character taken for its like."""
    return parts(v, number="concat('B', p_partkey, 'O')").withColumn("forms", F.array_join(checks.engine_variants(F.col("number")), " "))


VINS = "concat('9BWZ', 'Z', 'Z3', p_partkey % 7, 'Z', 'WT0', lpad(concat(p_partkey), 5, 'O'))"
VALUE = "instr('0123456789.ABCDEFGH..JKLMN.P.R..STUVWXYZ', substr(vin, {0}, 1)) - 1"


@query(f"""WITH m AS (SELECT part, written, translate(upper(written), 'IOQ', '100') AS vin FROM {source(written=VINS)}),
s AS (SELECT part, written, vin, ({" + ".join(f"({VALUE.format(k + 1)}) % 10 * {w}" for k, w in enumerate(text.VIN_WEIGHTS))}) % 11 AS r FROM m)
SELECT part, written, vin, CASE WHEN length(vin) = 17 THEN CASE WHEN r = 10 THEN 'X' ELSE CAST(CAST(r AS BIGINT) AS VARCHAR) END END AS digit FROM s""")
def vehicle_numbers(v):
    """Vehicle numbers mended, with the check digit that they should have."""
    rows = parts(v, written=VINS).withColumn("vin", checks.mended_vin(F.col("written")))
    return rows.withColumn("digit", text.vin_digit(F.col("vin")))


PLACES = "CASE p_partkey % 4 WHEN 0 THEN concat('b', p_partkey % 30, ' - 3-', p_partkey % 6) WHEN 1 THEN concat('A', p_partkey % 9) WHEN 2 THEN 'somewhere' ELSE concat('C1-', p_partkey % 12) END"


@query(f"""WITH p AS (SELECT part, place, CASE part % 4 WHEN 0 THEN upper(concat('b', part % 30)) WHEN 1 THEN concat('A', part % 9) WHEN 3 THEN 'C1' END AS rack, CASE part % 4 WHEN 0 THEN 3 WHEN 3 THEN part % 12 END AS module, CASE part % 4 WHEN 0 THEN part % 6 END AS level FROM {source(place=PLACES)})
SELECT part, place, rack, CAST(module AS INT) AS module, CAST(level AS INT) AS level FROM p WHERE rack IS NOT NULL AND coalesce(module, 1) <> 0 AND coalesce(level, 1) <> 0""")
def shelf_places(v):
    """Shelf, module and level that a place names."""
    rows = parts(v, place=PLACES).withColumn("s", checks.shelf(F.col("place"))).where("s is not null")
    return rows.select("part", "place", "s.rack", "s.module", "s.level")


HALF = "CASE WHEN abs({0} - round({0}, 0)) < 1e-9 THEN 0.5 WHEN abs({0} - round({0}, 1)) < 1e-9 THEN 0.05 WHEN abs({0} - round({0}, 2)) < 1e-9 THEN 0.005 ELSE 0 END"


@query(f"""WITH m AS (SELECT p_partkey AS part, p_size * 1.5 AS a, p_size * 1.5 + (p_partkey % 7) / 10.0 AS b FROM part), d AS (SELECT *, round(least(greatest(0.25, {HALF.format('a')}, {HALF.format('b')}), greatest(a, b) * 0.03), 6) AS room FROM m)
SELECT part, CAST(room AS DOUBLE) AS room, abs(a - b) <= room + 1e-9 AS same FROM d""")
def measure_tolerance(v):
    """The difference at which two measures are still one, and whether they are."""
    a, b = F.col("a"), F.col("b")
    rows = parts(v, a="p_size * CAST(1.5 AS DOUBLE)", b="p_size * CAST(1.5 AS DOUBLE) + (p_partkey % 7) / CAST(10.0 AS DOUBLE)").withColumn("room", F.round(checks.accepted_difference(a, b), 6))
    return rows.select("part", "room", (F.abs(a - b) <= F.col("room") + 1e-9).alias("same"))


VARIANTS = """CASE p_partkey % 8 WHEN 0 THEN concat('tc-', p_size, '-', p_partkey % 70, ' ', p_partkey % 4, 'M') WHEN 1 THEN concat('JVL-', p_size, '-', p_partkey % 30) WHEN 2 THEN concat(4500 + p_size, 'CG', p_partkey % 10) WHEN 3 THEN concat('MATEO.12-', p_size, CASE WHEN p_partkey % 3 = 0 THEN '-I' WHEN p_partkey % 3 = 1 THEN '-D' ELSE '' END)
WHEN 4 THEN concat('JI-', p_size, '-R') WHEN 5 THEN concat('LONGER', p_size, '-', p_partkey, '-STD') WHEN 6 THEN concat('A-B-', p_brand, '-C') ELSE 'JCA - X' END"""
SIDED = "(" + ", ".join(f"'{x}'" for x in checks.SIDES) + ")"


@query(f"""WITH u AS (SELECT part, code, regexp_replace(upper(trim(code)), '[\\s.]+', '-', 'g') AS u FROM {source(code=VARIANTS)}), p AS (SELECT *, list_filter(string_split(u, '-'), lambda x: x <> '') AS p, regexp_extract(u, '^([0-9]{{3,5}})[A-Z]{{2}}[0-9](-COMP)?$', 1) AS glued FROM u),
k AS (SELECT *, least(len(p), greatest(2, list_max(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN length(p[i]) > 4 THEN i ELSE 0 END)))) AS keep FROM p),
b AS (SELECT part, code, glued, array_to_string(list_concat(p[1:keep], list_filter(p[keep + 1:], lambda x: x IN {SIDED})), '-') AS base FROM k),
c AS (SELECT part, code, CASE WHEN glued <> '' THEN glued WHEN regexp_matches(base, '[0-9]') THEN base END AS base FROM b)
SELECT base, count(DISTINCT code) AS variants, min(part) AS first FROM c GROUP BY base""")
def size_variants(v):
    """Codes that are sizes or materials of one part: the base of each, and how many codes it has."""
    rows = parts(v, code=VARIANTS).withColumn("base", checks.base_code(F.col("code")))
    return rows.groupBy("base").agg(F.count_distinct("code").alias("variants"), F.min("part").alias("first"))


@query("""WITH m AS (SELECT p_partkey AS part, p_size - 3 AS outer_mm, p_size - 10 + p_partkey % 20 AS inner_mm, p_partkey % 300 - 5 AS height FROM part),
r AS (SELECT part, list_filter([CASE WHEN outer_mm < 0 OR inner_mm < 0 OR height < 0 THEN 'negative' END, CASE WHEN outer_mm <> 0 AND inner_mm <> 0 AND inner_mm >= outer_mm THEN 'inner not under outer' END,
  CASE WHEN outer_mm <> 0 AND inner_mm <> 0 AND inner_mm < outer_mm AND outer_mm > 8 * inner_mm THEN 'outer over eight times the inner' END], lambda x: x IS NOT NULL) AS r FROM m)
SELECT part, array_to_string(r, ', ') AS reasons FROM r WHERE len(r) > 0""")
def impossible_measures(v):
    """Measures that cannot be."""
    rows = parts(v, outer_mm="p_size - 3", inner_mm="p_size - 10 + p_partkey % 20", height="p_partkey % 300 - 5")
    return rows.select("part", checks.impossible_measures(F.col("inner_mm"), F.col("outer_mm"), F.col("height")).alias("reasons")).where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ", "))


# What names of parts say


@query(f"SELECT part, CASE part % 5 WHEN 0 THEN 1998 WHEN 2 THEN 2010 WHEN 3 THEN 2007 END AS first, CASE part % 5 WHEN 0 THEN 2004 WHEN 3 THEN 2007 END AS last, CASE WHEN part % 5 = 0 THEN TRUE WHEN part % 5 = 2 THEN FALSE WHEN part % 5 = 3 THEN FALSE END AS fits_2001 FROM {source(name=NAMES_OF)}")
def year_ranges(v):
    """Years that a name states, and whether 2001 is one of them."""
    r = extract.year_range(F.col("name"))
    return parts(v, name=NAMES_OF).select("part", r["first"].alias("first"), r["last"].alias("last"), extract.fits_year(F.col("name"), F.lit(2001)).alias("fits_2001"))


@query(f"SELECT part, CASE WHEN part % 5 = 1 THEN 'front left' END AS position, CASE part % 5 WHEN 2 THEN 'diesel' WHEN 3 THEN 'petrol' END AS fuel, CASE WHEN part % 5 = 4 THEN 35.5 END::DOUBLE AS length_mm, CASE WHEN part % 5 = 4 THEN 12.0 END::DOUBLE AS teeth FROM {source(name=NAMES_OF)}")
def name_attributes(v):
    """Position, fuel and measures that a name states."""
    n, m = F.col("name"), extract.measures(F.col("name"))
    return parts(v, name=NAMES_OF).select("part", extract.position(n).alias("position"), extract.fuel(n).alias("fuel"), m["length_mm"].alias("length_mm"), m["teeth"].alias("teeth"))


SIZES = "CASE p_partkey % 4 WHEN 0 THEN concat('RETEN ', p_size, 'x', p_size + 20, 'x7') WHEN 1 THEN concat('Tornillo M', 6 + p_partkey % 20, ' X 1.5') WHEN 2 THEN concat('seal ', p_size, ',5 x ', p_size + 10, ' x 8,25') ELSE p_name END"


@query(f"""SELECT p_partkey AS part, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 2 THEN p_size + 0.5 END AS DOUBLE) AS inner_mm, CAST(CASE p_partkey % 4 WHEN 0 THEN p_size + 20 WHEN 2 THEN p_size + 10 END AS DOUBLE) AS outer_mm, CAST(CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 2 THEN 8.25 END AS DOUBLE) AS height_mm,
CAST(CASE WHEN p_partkey % 4 = 1 THEN 6 + p_partkey % 20 END AS DOUBLE) AS thread_mm, CAST(CASE WHEN p_partkey % 4 = 1 THEN 1.5 END AS DOUBLE) AS pitch_mm FROM part""")
def sizes_in_names(v):
    """Sizes such as 35x52x7 and threads such as M24 X 1.5."""
    m = extract.measures(F.col("name"))
    return parts(v, name=SIZES).select("part", *[m[c].alias(c) for c in ("inner_mm", "outer_mm", "height_mm", "thread_mm", "pitch_mm")])


CELLS = "CASE p_partkey % 3 WHEN 0 THEN concat('K', p_partkey, '; L', p_partkey, ' / 12') WHEN 1 THEN concat('A', p_partkey, ',5 B', p_partkey, ' A', p_partkey, ',5') ELSE NULL END"


@query(f"SELECT part, CASE part % 3 WHEN 0 THEN concat('K', part, ' L', part) WHEN 1 THEN concat('A', part, '5 B', part) END AS codes FROM {source(cell=CELLS)}")
def codes_in_cells(v):
    """The codes of cells that hold several."""
    return parts(v, cell=CELLS).select("part", F.array_join(extract.split_codes(F.col("cell")), " ").alias("codes"))


# Days


@query("SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS day FROM events")
def local_days(v):
    """The local day of every event."""
    return v.table("events").select("event_id", F.date_format(days.local_day(F.col("ts")), "yyyy-MM-dd").alias("day"))


#: Names of files with no date, one, or several, some of which are none, or too late, or too old.
FILES = """concat(CASE o_orderkey % 5 WHEN 0 THEN 'LIST ' WHEN 1 THEN '31-02-1996 ' WHEN 2 THEN '05.11.2031 ' WHEN 3 THEN 'b_' ELSE 'prices ' END, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE concat(1 + o_custkey % 31, '-', 1 + o_custkey % 12, '-', 1990 + o_custkey % 10) END,
CASE WHEN o_orderkey % 3 = 0 THEN concat(' y ', 1 + o_orderkey % 28, ' ', 1 + o_orderkey % 12, ' ', 94 + o_orderkey % 6) ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN concat(' (', 1 + o_orderkey % 28, '.', 1 + o_custkey % 12, '.', 1994 + o_orderkey % 5, ')') ELSE '' END, '.csv')"""


@query(f"""WITH f AS (SELECT o_orderkey AS file, CAST(o_orderdate AS DATE) AS loaded, {FILES} AS name FROM orders),
x AS (SELECT file, loaded, unnest(regexp_extract_all(name, '[0-9]{{1,2}}[ ._-][0-9]{{1,2}}[ ._-](?:[0-9]{{4}}|[0-9]{{2}})')) AS x, generate_subscripts(regexp_extract_all(name, '[0-9]{{1,2}}[ ._-][0-9]{{1,2}}[ ._-](?:[0-9]{{4}}|[0-9]{{2}})'), 1) AS k FROM f),
d AS (SELECT file, loaded, k, TRY_CAST(printf('%04d-%02d-%02d', CAST(CASE WHEN length(split_part(y, ' ', 3)) = 2 THEN concat('20', split_part(y, ' ', 3)) ELSE split_part(y, ' ', 3) END AS INT), CAST(split_part(y, ' ', 2) AS INT), CAST(split_part(y, ' ', 1) AS INT)) AS DATE) AS day
  FROM (SELECT *, regexp_replace(x, '[._-]', ' ', 'g') AS y FROM x)),
b AS (SELECT file, arg_min(day, k) AS day FROM d WHERE day <= loaded AND day >= loaded - 730 GROUP BY file)
SELECT file, strftime(coalesce(b.day, loaded), '%Y-%m-%d') AS day, CASE WHEN b.day IS NULL THEN 'loaded' ELSE 'list' END AS origin FROM f LEFT JOIN b USING (file)""")
def list_dates(v):
    """The day of a price list, from the dates in its name or else its loading."""
    rows = v.table("orders").select(F.col("o_orderkey").alias("file"), F.expr(FILES).alias("name"), F.col("o_orderdate").cast("date").alias("loaded"))
    d = days.list_date(F.col("name"), F.col("loaded"))
    return rows.select("file", F.date_format(d["day"], "yyyy-MM-dd").alias("day"), d["origin"].alias("origin"))


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, 0.01 + (count(*) % 7) / 1000.0 AS rate FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1997-06-01' AND month(o_orderdate) <> 5 GROUP BY 1), d AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m') AS month FROM orders WHERE o_orderstatus = 'P')
SELECT id, round(coalesce((SELECT exp(sum(ln(1 + rate))) FROM m WHERE m.month > d.month), 1) - 1, 6) AS inflation FROM d""")
def inflation_since(v):
    """Inflation compounded over the whole months after each pending order; months were published from 1994 to May 1997, but for Mays."""
    orders = v.table("orders")
    published = orders.where("o_orderdate >= '1994-01-01' and o_orderdate < '1997-06-01' and month(o_orderdate) <> 5")
    monthly = published.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg((0.01 + (F.count("*") % 7) / 1000.0).alias("rate"))
    rows = orders.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"))
    return days.inflation_since(rows, monthly, "day").select("id", F.round("inflation", 6).alias("inflation"))


NAMES = sorted(set(QUERIES) - BEFORE)
