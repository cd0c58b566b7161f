"""What a description says of a part, as one nested signature, and whether two of them can be the same part.

A signature is made column by column; two are compared by an ordered list of rules. The first rule that says no decides, but a
doubt (something that one of them leaves out) gives way to any contradiction further down the list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.functions.checks import is_kit
from partloom.functions.extract import fuel, position, year_range
from partloom.functions.staging import dealt, staged
from partloom.functions.text import without_marks
from partloom.operators.search import classify

# Makers of cars and engines, how parts are abbreviated, words that say nothing of a part, and where a gasket goes.
MAKERS = ("FIAT", "FORD", "RENAULT", "VOLKSWAGEN", "VW", "CHEVROLET", "GM", "PEUGEOT", "CITROEN", "TOYOTA", "HONDA", "NISSAN", "HYUNDAI", "KIA", "SUZUKI", "PERKINS", "DEUTZ", "MWM", "SCANIA", "ROVER", "BMW", "AUDI")
SHORT = {"JTA": "JUNTA", "JTAS": "JUNTA", "JUNTAS": "JUNTA", "JGO": "JUEGO", "CIL": "CILINDRO", "CILINDROS": "CILINDRO", "BBA": "BOMBA", "BUJ": "BUJIA", "BUJIAS": "BUJIA", "SENS": "SENSOR", "VALV": "VALVULA", "VALVULAS": "VALVULA", "ADM": "ADMISION", "ESC": "ESCAPE", "DIST": "DISTRIBUCION", "FILT": "FILTRO", "TERM": "TERMOSTATO", "RET": "RETEN", "TEMP": "TEMPERATURA", "CAB": "CABLE", "CABLES": "CABLE"}
NOISE = ("DE", "LA", "EL", "CON", "SIN", "PARA", "POR", "DEL", "EN", "LOS", "LAS", "UN", "UNA", "MM", "CM", "TIPO", "KIT", "JUEGO", "JGO", "SET", "REF", "ORIG", "MOTOR", "DELANTERO", "DELANTERA", "TRASERO", "TRASERA", "IZQUIERDO", "DERECHO", "SUPERIOR", "INFERIOR", "DIESEL", "NAFTA")
PLACES = ("CARTER", "TAPA", "CILINDRO", "VALVULA", "ADMISION", "ESCAPE", "DISTRIBUCION", "TERMOSTATO", "AGUA", "ACEITE", "CAJA", "CARBURADOR")
FAMILIES = [("JUNTA", "gaskets"), ("JTA", "gaskets"), ("RETEN", "gaskets"), ("SENSOR", "sensors"), ("SONDA", "sensors"), ("BULBO", "sensors"), ("BOMBA", "pumps"), ("BBA", "pumps"), ("FILTRO", "filters"), ("BUJIA", "ignition"), ("CABLE", "ignition"), ("BOBINA", "ignition"), ("RELAY", "electric"), ("ALTERNADOR", "electric"), ("CORREA", "timing")]
#: Share by which two flows may differ.
FLOW = 0.10
#: What a text declares: a name and where in it its values stand; two that declare one differently are not one part.
DECLARED = {
    "volts": r"\b(6|12|24|48)\s*V(?:OLTS?)?\b", "teeth": r"\b([0-9]{1,3})\s*(?:DIENTES|DTES)\b", "flow": r"\b([0-9]{2,4})\s*L(?:TS?)?/H\b", "thread": r"\bM([0-9]{1,2}\s*X\s*[0-9](?:[.,][0-9]+)?)\b",
    "turn": r"\b(?:GIRO|ROTACION)\s*:?\s*(HORARIO|ANTIHORARIO)\b", "units": r"\b(?:JUEGO|JGO|KIT|SET|CAJA|PACK)\s*(?:DE|X)\s*([0-9]{1,2})\b", "wires": r"\b([0-9]{1,2})\s*(?:CABLES|VIAS|PINES)\b", "length": r"\b([0-9]{2,4})\s*CM\b",
}
SIGNATURE = ["said", "family", "kit", "rebuilt", "position", "fuel", "litres", "cars", "numbers", "years", "engines", "cylinders", "valves", "core", "head", "places", *DECLARED]


def _all(text: Column, pattern: str) -> Column:
    """The first group of all matches, blanks left out, each once and in order of value."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.replace(F.regexp_replace(x, r"\s+", ""), F.lit(","), F.lit(".")))))


def signed(rows: DataFrame, text: str = "text", families: list[tuple[str, str]] = FAMILIES, makers: tuple[str, ...] = MAKERS) -> DataFrame:
    """rows with signature, null for an empty text. Equal texts are read once. The words of a description are taken without marks, in capitals; a dot
    between two letters parts words; what it abbreviates is written out."""
    texts = rows.select(F.col(f"`{text}`").alias("_text")).distinct()
    plain = F.upper(without_marks(F.coalesce(F.col("_text").cast("string"), F.lit(""))))
    said = F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?<=[A-Z])\.(?=[A-Z])", " "), r"\s+", " "))
    # Each step reads columns made before it, so that no expression is written out again.
    out = dealt(texts, "_text").withColumn("_said", said)
    s = F.col("_said")
    words = F.filter(F.split(s, r"[^A-Z0-9./]+"), lambda w: w != "")
    out = out.withColumn("_words", F.transform(words, lambda w: F.regexp_replace(w, r"\.+$", "")))
    named = F.array(*[F.lit(m) for m in makers])
    cc = F.transform(F.filter(_all(s, r"\b([0-9]{3,4})\s*CC\b"), lambda x: x.cast("int") >= 600), lambda x: F.format_string("%.1f", x.cast("int") / 1000))
    litres = F.array_sort(F.array_distinct(F.concat(_all(s, r"(?<![0-9.,/])([0-9][.,][0-9])(?![0-9])(?!\s?MM\b)"), cc)))
    out = out.withColumns({
        "family": classify(F.concat(F.lit(" "), s), [(f" {k}", f) for k, f in families]), "kit": is_kit(s), "rebuilt": s.rlike(r"\b(RECONSTRUID|REMANUFACTURAD|REACONDICIONAD)[OA]\b"), "position": position(s), "fuel": fuel(s), "litres": litres,
        "cars": F.array_sort(F.array_distinct(F.array_intersect("_words", named))), "numbers": F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(s, F.lit(rf"\b(?:{'|'.join(makers)}) ((?:[0-9]{{2,4}})(?:/[0-9]{{2,4}})*)\b(?![.,])"), F.lit(1)), lambda x: F.filter(F.split(x, "/"), lambda n: ~n.rlike("^(19|20)[0-9]{2}$")))))),
        "years": F.when(s.rlike(r"(?:19|20)[0-9]{2}\s*(?:/|-|A)\s*(?:(?:19|20)[0-9]{2}|[0-9]{2}\b|\.\.\.)"), year_range(F.regexp_replace(s, r"/\s*\.\.\.", ">"))), "engines": _all(s, r"\b([A-Z][0-9]{1,2}[A-Z])(?:[0-9]{3})?\b"), "cylinders": _all(s, r"\b([0-9]{1,2})\s*CIL\b\.?"), "valves": _all(s, r"\b([0-9]{1,2})\s*V\b(?!OLT)"),
        **{n: _all(s, p) for n, p in DECLARED.items()},
    })
    # 12 V and 24 V are a tension in electric parts; 8 V, 16 V and the like are valves of an engine.
    out = out.withColumns({"valves": F.filter("valves", lambda x: x.isin("8", "10", "16", "20", "24", "32")), "volts": F.when(F.col("family").isin("electric", "ignition", "sensors"), F.col("volts")).otherwise(F.array().cast("array<string>"))})
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    core = F.filter(F.transform(F.filter("_words", lambda w: ~w.isin(*NOISE) & ~w.isin(*makers)), lambda w: F.coalesce(F.element_at(short, w), w)), lambda w: w.rlike("^[A-Z]{3,}$") & ~w.isin(*NOISE))
    out = out.withColumn("core", F.array_distinct(core))
    out = out.withColumns({"head": F.get("core", 0), "places": F.array_sort(F.array_intersect("core", F.array(*[F.lit(p) for p in PLACES]))), "said": s})
    out = staged(out.select("_text", F.when(s != "", F.struct(*SIGNATURE)).alias("signature")), "signatures")
    return rows.join(out, F.col(f"`{text}`").eqNullSafe(F.col("_text"))).drop("_text")


def _apart(a: Column, b: Column) -> Column:
    """Both say something, and nothing the same."""
    return (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)


def rules(a: Column, b: Column) -> list[tuple[str, Column, bool]]:
    """The reasons against two signatures being one part, in order: name, whether it holds, whether it is only a doubt."""
    gasket = lambda x: F.array_contains(x["core"], "JUNTA")
    names_car = lambda x: (F.size(x["cars"]) > 0) | (F.size(x["engines"]) > 0) | (F.size(x["numbers"]) > 0)
    near = F.exists(a["flow"], lambda x: F.exists(b["flow"], lambda y: F.abs(x.cast("double") - y.cast("double")) <= FLOW * F.greatest(x.cast("double"), y.cast("double"))))
    years_apart = (F.coalesce(a["years"]["last"], F.lit(9999)) < F.coalesce(b["years"]["first"], F.lit(0))) | (F.coalesce(b["years"]["last"], F.lit(9999)) < F.coalesce(a["years"]["first"], F.lit(0)))
    only = lambda x, y: F.array_except(x["places"], y["places"])
    said = lambda x, y: F.exists(x["numbers"], lambda n: F.array_contains(F.split(y["said"], "[^A-Z0-9]+"), n))
    head_in = a["head"].contains(b["head"]) | b["head"].contains(a["head"])
    return [
        ("rebuilt", a["rebuilt"] != b["rebuilt"], False),
        *[(n, F.when((F.size(a["flow"]) > 0) & (F.size(b["flow"]) > 0), ~near).otherwise(F.lit(False)) if n == "flow" else _apart(a[n], b[n]), False) for n in sorted(DECLARED)],
        ("no family", a["family"].isNull() | b["family"].isNull(), False), ("other family", a["family"] != b["family"], False), ("set", a["kit"] != b["kit"], False), ("position", a["position"] != b["position"], False),
        ("litres", _apart(a["litres"], b["litres"]), False), ("model", _apart(a["numbers"], b["numbers"]) & ~said(a, b) & ~said(b, a), False), ("car", _apart(a["cars"], b["cars"]), False), ("years", years_apart & a["years"].isNotNull() & b["years"].isNotNull(), False),
        ("fuel", a["fuel"] != b["fuel"], False), ("engine", _apart(a["engines"], b["engines"]), False), ("cylinders", _apart(a["cylinders"], b["cylinders"]), False), ("valves", _apart(a["valves"], b["valves"]) & gasket(a) & gasket(b), False),
        ("other part", (a["head"] != b["head"]) & ~head_in, False), ("other place", (F.size(only(a, b)) > 0) & (F.size(only(b, a)) > 0), False),
        ("no place", gasket(a) & gasket(b) & ((F.size(a["places"]) > 0) != (F.size(b["places"]) > 0)), True), ("no car", names_car(a) != names_car(b), True), ("few words", F.size(F.array_intersect(a["core"], b["core"])) < 2, False),
    ]


def compared(pairs: DataFrame, a: str = "signature_a", b: str = "signature_b") -> DataFrame:
    """pairs with same, why (the rule that decides; null if nothing speaks against it) and doubt (it is only one), and strength:
    words, litres and cars in common. A null signature is like none."""
    x, y = F.col(a), F.col(b)
    checks = rules(x, y)
    # The first contradiction decides, and no rule after it is looked at; doubts come next, and last, as no contradiction to a
    # doubt, the rule that merely finds too little.
    order = sorted(checks, key=lambda r: (r[0] == "few words", r[2]))
    hit = F.coalesce(*[F.when(c, F.struct(F.lit(n).alias("why"), F.lit(d).alias("doubt"))) for n, c, d in order])
    out = pairs.withColumn("_by", F.when(x.isNull() | y.isNull(), F.struct(F.lit("no text").alias("why"), F.lit(False).alias("doubt"))).otherwise(hit))
    n = lambda f: F.size(F.array_intersect(x[f], y[f]))
    return out.withColumns({"same": F.col("_by").isNull(), "why": F.col("_by.why"), "doubt": F.coalesce("_by.doubt", F.lit(False)), "strength": F.array(n("core"), n("litres"), n("cars"))}).drop("_by")
