"""Queries over choices, reviews, relations, vehicles and nested values, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from partloom.operators import choice, graph, imports, nested, relations, reviews, vehicles
from partloom.plans.registry import BAND, QUERIES, RECURSIVE, STEP, WITH, query
from partloom.sources.views import TODAY
from partloom.streaming import events

BEFORE = set(QUERIES)

# Choice among equivalents

OFFER = f"""{WITH}, now AS (SELECT id, arg_max(price, (seen, price)) AS price FROM price GROUP BY id),
offer AS (SELECT p.part, p.id, CASE p.id % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'candidate' WHEN 2 THEN 'contradicted' WHEN 3 THEN 'probable' WHEN 4 THEN 'probable' ELSE 'verified' END AS verdict, p.id % 3 AS stock, CASE WHEN p.id % 11 > 0 THEN price END AS price,
  CASE WHEN p.id % 5 > 0 THEN price * (50 + p.id % 40) / 100.0 END AS cost, p.id % 17 = 0 AS searched, p.id % 19 = 0 AS returned, p.id % 23 = 0 AS refused, p.part % 4 = 0 AS safety, p.id % 29 = 0 AS kit, p.brand % 31 = 0 AS off_scale, p.id % 6 // 4 AS grade FROM product p JOIN now USING (id)),
ranked AS (SELECT *, CASE verdict WHEN 'verified' THEN 0 WHEN 'probable' THEN 1 WHEN 'candidate' THEN 2 WHEN 'contradicted' THEN 3 ELSE 4 END AS r,
  CASE WHEN returned THEN 'returned' WHEN refused THEN 'refused' WHEN searched THEN NULL WHEN verdict NOT IN ('verified', 'probable') THEN verdict WHEN safety AND verdict <> 'verified' THEN 'safety' END AS bar FROM offer)"""


def offers(v):
    from partloom.operators.pricing import latest

    k = F.col("id")
    verdict = F.when(k % 7 == 0, "rejected").when(k % 7 == 1, "candidate").when(k % 7 == 2, "contradicted").when(k % 7 <= 4, "probable").otherwise("verified")
    rows = v.products.select("id", "part", "brand").join(latest(v.prices).select("id", F.col("price").alias("p")), "id")
    return rows.select(
        "part", "id", verdict.alias("verdict"), (k % 3).alias("stock"), F.when(k % 11 > 0, F.col("p")).alias("price"), F.when(k % 5 > 0, F.col("p") * (50 + k % 40) / 100.0).alias("cost"), (k % 17 == 0).alias("searched"),
        (k % 19 == 0).alias("returned"), (k % 23 == 0).alias("refused"), (F.col("part") % 4 == 0).alias("safety"), (k % 29 == 0).alias("kit"), (F.col("brand") % 31 == 0).alias("off_scale"), F.floor(k % 6 / 4).alias("grade"),
    )


@query(f"""{OFFER} SELECT part, id, row_number() OVER (PARTITION BY part ORDER BY NOT searched, CASE WHEN searched THEN 0 ELSE r END, CASE WHEN searched THEN 0 ELSE grade END, CASE WHEN searched THEN FALSE ELSE stock <= 0 END,
CASE WHEN searched THEN 0 ELSE coalesce(price, 'inf'::DOUBLE) END, id) AS place FROM ranked""")
def offered_order(v):
    """Equivalents of every number: what was searched, then by verdict, grade, stock and price."""
    return choice.in_order(offers(v), "part").select("part", "id", "place")


@query(f"""{OFFER}, f AS (SELECT * FROM ranked WHERE stock > 0 AND price > 0 AND NOT kit AND NOT off_scale), a AS (SELECT part, arg_min(id, (grade, price, id)) AS recommended, arg_min(price, (grade, price, id)) AS p FROM f WHERE bar IS NULL GROUP BY part),
b AS (SELECT part, arg_min(id, (price, id)) AS cheapest, min(price) AS q, arg_min(coalesce(bar, 'grade'), (price, id)) AS bar FROM f GROUP BY part)
SELECT part, CAST(recommended AS VARCHAR) AS recommended, cheapest, CASE WHEN recommended IS NULL OR q < p THEN bar END AS why_not FROM b LEFT JOIN a USING (part)""")
def recommended(v):
    """The equivalent to recommend, and why it is not the cheapest."""
    return choice.recommended(offers(v), "part").withColumn("recommended", F.col("recommended").cast("string"))


@query(f"""{OFFER}, g AS (SELECT part, id, price - cost AS gain FROM ranked WHERE stock > 0 AND price > 0 AND cost > 0 AND bar IS NULL)
SELECT part, arg_min(id, (-gain, id)) AS id, round(max(gain), 2) AS gain, round(max(gain) - min(gain), 2) AS more FROM g GROUP BY part HAVING count(*) > 1 AND max(gain) > min(gain)""")
def best_margin(v):
    """Of what may be recommended, the one that leaves most."""
    return choice.best_margin(offers(v), "part")


@query(f"""{WITH}, s AS (SELECT part AS chain, conf % 6 <> 0 AS prim, conf % 4 = 0 AS ver, conf FROM link WHERE conf >= 60), g AS (SELECT chain, count(*) AS steps, count(*) FILTER (NOT prim) AS u, count(*) FILTER (NOT ver AND conf < 70) AS weak FROM s GROUP BY chain)
SELECT chain, steps, weak, CASE WHEN u > 0 THEN 'candidate' WHEN steps > 1 OR weak > 0 THEN 'probable' ELSE 'verified' END AS state FROM g""")
def chain_states(v):
    """State of the chains that links of 60 and more make."""
    n = F.col("conf")
    return choice.chain_state(v.links.where("conf >= 60").select(F.col("part").alias("chain"), (n % 6 != 0).alias("primary"), (n % 4 == 0).alias("verified"), "conf"))


@query("""WITH o AS (SELECT p_brand AS brand, p_type AS kind, CAST(p_size % 12 AS BIGINT) AS size, p_retailprice * (1 + (p_partkey % 5) * (p_size % 12 % 2)) AS price FROM part), m AS (SELECT brand, kind, size, list_sort(list(price))[count(*) // 2 + 1] AS price FROM o GROUP BY ALL),
w AS (SELECT *, lag(price) OVER x AS before, lead(price) OVER x AS after FROM m WINDOW x AS (PARTITION BY brand, kind ORDER BY size))
SELECT brand, kind, size, price, before, after FROM w WHERE before IS NOT NULL AND after IS NOT NULL AND (price * 3 < least(before, after) OR price > 3 * greatest(before, after))""")
def prices_against_size(v):
    """Sizes whose price does not follow those of their neighbours."""
    price = F.col("p_retailprice") * (1 + (F.col("p_partkey") % 5) * (F.col("p_size") % 12 % 2))
    return choice.against_size(v.table("part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), (F.col("p_size") % 12).cast("long").alias("size"), price.alias("price")))


@query("""WITH c AS (SELECT p_partkey AS id, concat('K', p_partkey % 40) AS prefix, p_partkey * 7919 % 10007 AS number FROM part), a AS (SELECT DISTINCT concat('K', s_suppkey % 40) AS prefix, s_suppkey * 97 AS asked FROM supplier UNION SELECT concat('K', p_partkey % 40), p_partkey * 7919 % 10007 FROM part WHERE p_size = 7),
n AS (SELECT prefix, asked, id, abs(number - asked) AS far, row_number() OVER (PARTITION BY prefix, asked ORDER BY abs(number - asked), id) AS place FROM a JOIN c USING (prefix)) SELECT prefix, asked, place, id, far FROM n WHERE place <= 8""")
def code_family(v):
    """The codes of one prefix nearest to a number."""
    k = F.col("p_partkey")
    codes = v.table("part").select(k.alias("id"), F.concat(F.lit("K"), (k % 40).cast("string")).alias("prefix"), (k * 7919 % 10007).alias("number"))
    asked = v.table("supplier").select(F.concat(F.lit("K"), (F.col("s_suppkey") % 40).cast("string")).alias("prefix"), (F.col("s_suppkey") * 97).alias("asked"))
    there = v.table("part").where("p_size = 7").select(F.concat(F.lit("K"), (k % 40).cast("string")).alias("prefix"), (k * 7919 % 10007).alias("asked"))
    return choice.nearest_codes(codes, asked.unionByName(there))


# Reviews


def sided(v):
    return v.links.select("a", "b", "conf", "part", (F.col("a") % 1000000).alias("brand_a"), (F.col("b") % 1000000).alias("brand_b"))


SIDED = f"{WITH}, side AS (SELECT a, b, conf, part, a % 1000000 AS brand_a, b % 1000000 AS brand_b FROM link)"


@query(f"{WITH} SELECT part % 4 AS origin, count(*) AS links, round(count(*) FILTER (conf >= 70) / count(*), 6) AS solid, count(*) FILTER (conf % 5 = 0) AS verified FROM link GROUP BY 1")
def links_by_origin(v):
    return reviews.by_origin(v.links.select((F.col("part") % 4).alias("origin"), "conf", (F.col("conf") % 5 == 0).alias("verified")))


@query(f"{WITH}, e AS (SELECT a AS id FROM link WHERE conf < 50 UNION SELECT b FROM link WHERE conf < 50) SELECT brand, count(*) AS products FROM e JOIN product USING (id) GROUP BY brand")
def waiting_products(v):
    return reviews.waiting(v.links.where("conf < 50"), v.products)


@query(f"""{SIDED}, d AS (SELECT part % 9 AS family, least(brand_a, brand_b) AS brand, greatest(brand_a, brand_b) AS other, conf >= 55 AS ok FROM side)
SELECT family, brand, other, count(*) AS decisions, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM d GROUP BY GROUPING SETS ((family), (brand, other)) HAVING count(*) >= 30""")
def quality_board(v):
    """Approved shares by family and by pair of lists."""
    return reviews.board(sided(v).select((F.col("part") % 9).alias("family"), "brand_a", "brand_b", (F.col("conf") >= 55).alias("approved")))


@query(f"""{WITH}, d AS (SELECT {BAND.format('conf')} AS band, CASE conf % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'measure' ELSE 'list' END AS signal, (conf >= 55) = (part % 4 > 0) AS agreed FROM link)
SELECT band, signal, count(*) AS decisions, round(count(*) FILTER (agreed) / count(*), 6) AS agreed FROM d GROUP BY GROUPING SETS ((band), (signal), ())""")
def review_accuracy(v):
    from partloom.operators.evidence import band

    n = F.col("conf")
    signal = F.when(n % 3 == 0, "text").when(n % 3 == 1, "measure").otherwise("list")
    return reviews.accuracy(v.links.select(band(n).alias("band"), signal.alias("signal"), ((n >= 55) == (F.col("part") % 4 > 0)).alias("agreed")))


@query(f"""{WITH}, d AS (SELECT unnest(list_distinct([concat('price ', conf % 3), concat('kit ', conf % 2), concat('kit ', part % 2)])) AS alarm, conf >= 55 AS ok FROM link)
SELECT alarm, count(*) AS decisions, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM d GROUP BY alarm HAVING count(*) >= 5""")
def alarm_rates(v):
    """Approved share of the decisions that carried each alarm."""
    s = lambda t, c: F.concat(F.lit(t), c.cast("string"))
    alarms = F.array(s("price ", F.col("conf") % 3), s("kit ", F.col("conf") % 2), s("kit ", F.col("part") % 2))
    return reviews.by_alarm(v.links.select(alarms.alias("alarms"), (F.col("conf") >= 55).alias("approved")))


@query(f"{WITH}, h AS (SELECT a AS id, conf >= 55 AS approved, row_number() OVER (PARTITION BY conf >= 55 ORDER BY md5(concat('1/', a)), a) AS place FROM link) SELECT id, approved, place FROM h WHERE place <= 5")
def practice_cases(v):
    return reviews.practice(v.links.select(F.col("a").alias("id"), (F.col("conf") >= 55).alias("approved")))


@query(f"{SIDED} SELECT least(brand_a, brand_b) AS brand, greatest(brand_a, brand_b) AS other, {BAND.format('conf')} AS band, count(*) AS pairs FROM side GROUP BY 1, 2, 3")
def pair_groups(v):
    from partloom.operators.evidence import band

    return reviews.groups(sided(v).withColumn("band", band(F.col("conf"))))


FANS = f"{WITH}, {STEP}, fan AS (SELECT a, b, b % 1000000 % 5 AS list, b % 3 AS base FROM step)"


def fan_rows(v):
    return graph.both_ways(v.links).select("a", "b", (F.col("b") % 1000000 % 5).alias("list"), (F.col("b") % 3).alias("base"))


@query(f"{FANS} SELECT a, list, count(DISTINCT base) AS options, count(*) AS candidates FROM fan GROUP BY a, list HAVING count(DISTINCT base) > 1")
def candidate_fans(v):
    """Products with several candidates in one other list."""
    return reviews.fans(fan_rows(v))


@query(f"{FANS} SELECT a, list, base, min(b) AS b, count(*) AS variants FROM fan GROUP BY a, list, base")
def fan_options(v):
    """The candidates of a product in a list, sizes of one part as one."""
    return reviews.fan_options(fan_rows(v))


@query(f"""{WITH}, s AS (SELECT sale_id, id AS a, id + 1 AS b, seen FROM sale), r AS (SELECT id + 1 AS b, id AS a, max(seen) AS at FROM price WHERE id % 4 = 0 GROUP BY id)
SELECT sale_id, s.a, s.b FROM s JOIN r ON r.a = s.a WHERE r.at > s.seen""")
def sold_then_rejected(v):
    """Sales of a pair that was rejected later."""
    sales = v.sales.select("sale_id", F.col("id").alias("a"), (F.col("id") + 1).alias("b"), "seen")
    rejected = v.prices.where("id % 4 = 0").select((F.col("id") + 1).alias("a"), F.col("id").alias("b"), F.col("seen").alias("at"))
    return reviews.sold_then_rejected(sales, rejected)


@query(f"""{WITH}, m AS (SELECT conf // 30 AS old, (conf * 7 + 13) % 100 // 30 AS new FROM link), g AS (SELECT count(*) AS links, count(*) FILTER (new > old) AS rose, count(*) FILTER (new < old) AS fell FROM m)
SELECT *, CASE WHEN links >= 100 AND rose + fell > 0.3 * links THEN 'large' WHEN rose >= 100 AND rose > 0.05 * links THEN 'lax' END AS flag FROM g""")
def drift_flag(v):
    n = F.col("conf")
    return reviews.drift_flag(v.links.select(F.floor(n / 30).alias("old"), F.floor((n * 7 + 13) % 100 / 30).alias("new")))


# Relations

REPLACED = "(SELECT p_partkey AS old, p_partkey + 1 AS new, p_size AS n FROM part WHERE p_partkey % 7 = 0)"


def replaced(v):
    return v.table("part").where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("old"), (F.col("p_partkey") + 1).alias("new"))


@query(f"""{WITH}, r AS {REPLACED}, p AS (SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM r JOIN product x ON x.part = r.old JOIN product y ON y.part = r.new)
SELECT a, b FROM p WHERE (a + b) % 10 <> 0""")
def replacement_bridges(v):
    """Pairs that a change of number joins, neither linked nor rejected (pairs whose sum ends in 0 are)."""
    codes = v.products.select("id", F.col("part").alias("code"))
    both = v.products.select("id", "part").join(v.products.select(F.col("id").alias("other"), (F.col("part") - 1).alias("part")), "part")  # of neighbouring numbers
    return relations.replacement_bridges(replaced(v), codes, v.links.select("a", "b"), both.select(F.col("id").alias("a"), F.col("other").alias("b")).where("(a + b) % 10 = 0"))


@query("""WITH RECURSIVE r AS (SELECT p_partkey AS old, arg_max(new, (seen, new)) AS new FROM (SELECT p_partkey, (p_partkey * 3 + k) % 500 AS new, p_size * k AS seen FROM part, (VALUES (1), (2)) t(k)) GROUP BY 1),
w(code, last, steps, path) AS (SELECT CAST(old AS VARCHAR), CAST(new AS VARCHAR), 1, [CAST(old AS VARCHAR), CAST(new AS VARCHAR)] FROM r UNION ALL SELECT code, CAST(new AS VARCHAR), steps + 1, list_append(path, CAST(new AS VARCHAR)) FROM w JOIN r ON CAST(old AS VARCHAR) = last WHERE steps < 10 AND NOT list_contains(path, CAST(new AS VARCHAR)))
SELECT code, arg_max(last, steps) AS last, max(steps) AS steps FROM w GROUP BY code""")
def replacement_ends(v):
    """Where each chain of replaced numbers ends."""
    rows = v.table("part").select("p_partkey", "p_size", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    s = lambda c: c.cast("string")
    return imports.replacement_ends(rows.select(s(F.col("p_partkey")).alias("old"), s((F.col("p_partkey") * 3 + F.col("k")) % 500).alias("new"), (F.col("p_size") * F.col("k")).alias("seen")))


@query(f"""{WITH}, {STEP}, n AS (SELECT s.a AS id, q.part % 3 + q.brand % 4 AS family, count(*) AS n FROM step s JOIN product p ON p.id = s.a AND p.brand % 2 = 0 JOIN product q ON q.id = s.b GROUP BY 1, 2)
SELECT id, family, n FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, family) = 1""")
def node_families(v):
    """Family of the makers' numbers (even brands), from their neighbours."""
    p = v.products
    return relations.family_of_nodes(graph.both_ways(v.links).select("a", "b"), p.select("id", (F.col("part") % 3 + F.col("brand") % 4).alias("family")), p.where("brand % 2 = 0").select("id"))


@query("""WITH c AS (SELECT p_brand AS code, count(*) AS found, max(p_retailprice) AS price FROM part GROUP BY 1) SELECT s_suppkey AS line, concat('Brand#', s_suppkey % 60) AS code, coalesce(found, 0) AS found, price FROM supplier LEFT JOIN c ON c.code = concat('Brand#', s_suppkey % 60)""")
def delivery_check(v):
    """Lines of a delivery note against the catalogue."""
    lines = v.table("supplier").select(F.col("s_suppkey").alias("line"), F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 60).cast("string")).alias("code"))
    return relations.matched(lines, v.table("part").select(F.col("p_brand").alias("code"), F.col("p_retailprice").alias("price")), "code")


@query("SELECT p_partkey AS part, p_name AS old, CASE WHEN p_partkey % 3 = 0 THEN upper(p_name) || ' ' WHEN p_partkey % 3 = 1 THEN p_name || ' new' ELSE p_name END AS new FROM part WHERE p_partkey % 3 = 1")
def changed_records(v):
    """Descriptions that a new list changes, capitals and blanks aside."""
    k, n = F.col("p_partkey"), F.col("p_name")
    old = v.table("part").select(k.alias("part"), n.alias("name"))
    now = v.table("part").select(k.alias("part"), F.when(k % 3 == 0, F.concat(F.upper(n), F.lit(" "))).when(k % 3 == 1, F.concat(n, F.lit(" new"))).otherwise(n).alias("name"))
    return relations.changed(old, now, "part", "name")


#: A short list of words and what is sold with parts so named.
COMBINATIONS = [("bolt", "washer"), ("gear", "oil"), ("ring", "grease"), ("small", "tool")]


@query("SELECT DISTINCT p_partkey AS id, other FROM part JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in COMBINATIONS) + ") r(word, other) ON contains(lower(p_name), word)")
def goes_with(v):
    return relations.goes_with(v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), COMBINATIONS)


@query("""WITH n AS (SELECT p_partkey, p_type AS family, unnest(list_distinct(string_split(lower(p_name), ' '))) AS w FROM part) SELECT x.family, x.w AS a, y.w AS b, count(*) AS names FROM n x JOIN n y ON x.p_partkey = y.p_partkey AND x.w < y.w GROUP BY 1, 2, 3""")
def words_together(v):
    """Words that names of a family hold together, as engines are learned."""
    return relations.co_named(v.table("part").select(F.col("p_type").alias("family"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words")))


@query(f"{WITH} SELECT id FROM product WHERE id NOT IN (SELECT id FROM sale WHERE returned) AND id NOT IN (SELECT a FROM link UNION SELECT b FROM link WHERE conf >= 60)")
def removable_products(v):
    """Products without a return and without a link from them, or a solid one to them."""
    return relations.removable(v.products.select("id"), v.sales.where("returned"), v.links.select(F.col("a").alias("id")), v.links.where("conf >= 60").select(F.col("b").alias("id")))


TOKENS = "list_distinct(string_split(lower(p_name), ' '))"


def name_index(v):
    return relations.inverted(v.table("part").select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("words")))


@query(f"SELECT word, id // 10000 AS block, array_to_string(list_sort(list(id)), ',') AS ids FROM (SELECT p_partkey AS id, unnest({TOKENS}) AS word FROM part) GROUP BY word, block")
def word_index(v):
    """An index from words to parts."""
    return name_index(v).withColumn("ids", F.array_join("ids", ","))


@query(f"""WITH i AS (SELECT p_partkey AS id, unnest({TOKENS}) AS word FROM part), q AS (SELECT DISTINCT p_partkey AS search, unnest(list_append(string_split(lower(p_name), ' '), CASE WHEN p_partkey % 200 = 0 THEN 'gizmo' ELSE 'none' END)) AS word FROM part WHERE p_partkey % 100 = 0), n AS (SELECT search, count(*) AS n FROM q GROUP BY 1)
SELECT search, id, count(*) AS hits FROM q JOIN i USING (word) JOIN n USING (search) GROUP BY search, id, n HAVING count(*) >= ceil(n * 2 / 3 - 1e-9)""")
def indexed_search(v):
    """Searches (the names of parts whose key is divisible by 100, with a word more) answered from the index."""
    k = F.col("p_partkey")
    asked = v.table("part").where("p_partkey % 100 = 0").select(k.alias("search"), F.explode(F.concat(F.split(F.lower("p_name"), " "), F.array(F.when(k % 200 == 0, "gizmo").otherwise("none")))).alias("word"))
    return relations.words_to_ids(name_index(v), asked)


# Imports and pending links


@query("""WITH c AS (SELECT p_partkey AS code, p_size % 5 AS brand, p_retailprice AS price, p_size AS stock FROM part WHERE p_partkey % 4 > 0), i AS (SELECT CASE WHEN p_partkey % 50 = 0 THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS code, p_size % 5 AS brand, CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1.2 ELSE p_retailprice * 9 END AS price, p_partkey AS row_no FROM part),
l AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY code, brand ORDER BY row_no DESC) = 1), j AS (SELECT l.code, l.brand, c.code AS had, c.price AS old, l.price FROM l LEFT JOIN c ON CAST(c.code AS VARCHAR) = l.code AND c.brand = l.brand)
SELECT outcome, count(*) AS rows FROM (SELECT CASE WHEN code = '' THEN 'no code' WHEN had IS NULL THEN 'new' WHEN greatest(old, price) / least(old, price) > 3 OR abs(greatest(old, price) / least(old, price) / 10 - 1) <= 0.02 THEN 'held' WHEN price <> old THEN 'price' ELSE 'same' END AS outcome FROM j) GROUP BY outcome""")
def import_outcomes(v):
    """What a price list would do to the catalogue."""
    k, p, s = F.col("p_partkey"), F.col("p_retailprice"), F.col("p_size")
    catalogue = v.table("part").where("p_partkey % 4 > 0").select(k.cast("string").alias("code"), (s % 5).alias("brand"), p.alias("price"), s.alias("stock"))
    incoming = v.table("part").select(F.when(k % 50 == 0, "").otherwise(k.cast("string")).alias("code"), (s % 5).alias("brand"), F.when(k % 3 == 0, p).when(k % 3 == 1, p * 1.2).otherwise(p * 9).alias("price"), s.alias("stock"), k.alias("row_no"))
    return imports.outcomes(catalogue, incoming).groupBy("outcome").agg(F.count("*").alias("rows"))


@query(f"""{WITH}, c AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT a, b FROM link UNION ALL SELECT b, a + 1 FROM link)) SELECT a, b FROM c ANTI JOIN (SELECT a, b FROM link WHERE conf % 3 = 0 OR conf < 40) USING (a, b) WHERE a <> b""")
def review_queue(v):
    """Candidate pairs that are neither linked, nor pending, nor rejected."""
    l = v.links.select("a", "b", "conf")  # noqa: E741
    candidates = l.select("a", "b").unionByName(l.select(F.col("b").alias("a"), (F.col("a") + 1).alias("b")))
    return imports.queue(l.where("conf % 3 = 0"), candidates, l.where("conf < 35"), l.where("conf between 35 and 39"))


@query(f"""{WITH}, m AS (SELECT CASE WHEN a % 9 = 0 THEN a - a % 1000000 + 1 ELSE a END AS a, CASE WHEN b % 9 = 0 THEN b - b % 1000000 + 1 ELSE b END AS b, conf FROM link) SELECT least(a, b) AS a, greatest(a, b) AS b, max(conf) AS conf FROM m WHERE a <> b GROUP BY 1, 2""")
def merged_links(v):
    """Links after products are merged into others (those whose id divides by 9 into the part's first)."""
    aliases = v.products.where("id % 9 = 0").select(F.col("id").alias("loser"), (F.col("id") - F.col("id") % 1000000 + 1).alias("winner"))
    return imports.merge_products(v.links.select("a", "b", "conf"), aliases)


@query(f"{WITH}, s AS (SELECT id FROM product WHERE id % 4 > 0) SELECT a, b, conf FROM link WHERE conf % 3 > 0 AND a IN (SELECT id FROM s) AND b IN (SELECT id FROM s)")
def no_longer_declared(v):
    """Links that a new list does not declare (every third it does), though it holds both products."""
    return imports.no_longer_declared(v.links.select("a", "b", "conf"), v.links.where("conf % 3 = 0"), v.products.where("id % 4 > 0").select("id"))


@query(f"{WITH} SELECT a, b FROM link WHERE conf < 60 AND conf % 4 > 0 AND a % 10 > 0 AND b % 10 > 0 AND conf % 5 < 4")
def bulk_approvable(v):
    """Pending pairs that may be approved in bulk."""
    l = v.links  # noqa: E741
    joins = l.select("a", "b", F.when(F.col("conf") % 5 == 4, 200).otherwise(3).alias("new_pairs"))
    return imports.approve(l.where("conf < 60").select("a", "b"), l.where("conf % 4 = 0"), v.products.where("id % 10 = 0").select("id"), joins)


# Vehicles

HISTORY = """history AS (SELECT o_custkey AS vehicle, CONCAT('P', l_partkey % 6) AS part, CAST(l_shipdate AS DATE) AS seen, CASE WHEN l_orderkey % 5 > 0 THEN CAST(l_quantity AS BIGINT) * 2000 END AS km, CASE WHEN l_linenumber % 3 > 0 THEN 10000 + CAST(l_quantity AS BIGINT) * 500 END AS life_km, 200 + l_partkey % 900 AS life_days
FROM lineitem JOIN orders ON o_orderkey = l_orderkey), vehicle AS (SELECT c_custkey AS vehicle, 60000 + c_custkey % 50 * 1000 AS km_now FROM customer)"""


def history(v):
    units, k = F.col("l_quantity").cast("long"), F.col("l_partkey")
    rows = v.table("lineitem").join(v.table("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("vehicle"), F.concat(F.lit("P"), (k % 6).cast("string")).alias("part"), F.col("l_shipdate").cast("date").alias("seen"), F.when(F.col("l_orderkey") % 5 > 0, units * 2000).alias("km"),
        F.when(F.col("l_linenumber") % 3 > 0, 10000 + units * 500).alias("life_km"), (200 + k % 900).alias("life_days"),
    )


def fleet(v):
    return v.table("customer").select(F.col("c_custkey").alias("vehicle"), (60000 + F.col("c_custkey") % 50 * 1000).alias("km_now"))


STATES = f"""WITH {HISTORY}, w AS (SELECT *, coalesce(life_km, -1) AS k, coalesce(life_days, -1) AS d FROM history),
x AS (SELECT vehicle, part, max((km, seen, k, d)) AS x FROM w WHERE km IS NOT NULL GROUP BY ALL), y AS (SELECT vehicle, part, max((seen, k, d)) AS y FROM w WHERE km IS NULL GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY vehicle, part ORDER BY km IS NOT NULL DESC, km DESC, seen DESC, k DESC, d DESC) AS n FROM w),
lk AS (SELECT vehicle, part, arg_min(life_km, n) AS lk FROM o WHERE life_km > 0 GROUP BY ALL), ld AS (SELECT vehicle, part, arg_min(life_days, n) AS ld FROM o WHERE life_days > 0 GROUP BY ALL),
p AS (SELECT vehicle, part, CASE WHEN x IS NULL OR y IS NOT NULL AND y[1] > x[2] THEN NULL ELSE x[1] END AS km, CASE WHEN x IS NULL OR y IS NOT NULL AND y[1] > x[2] THEN y[1] ELSE x[2] END AS seen,
  CASE WHEN x IS NULL OR y IS NOT NULL AND y[1] > x[2] THEN y[2] ELSE x[3] END AS k, CASE WHEN x IS NULL OR y IS NOT NULL AND y[1] > x[2] THEN y[3] ELSE x[4] END AS d FROM x FULL JOIN y USING (vehicle, part)),
s AS (SELECT vehicle, part, km + CASE WHEN k > 0 THEN k ELSE lk END - km_now AS km_left, (seen + CAST(CASE WHEN d > 0 THEN d ELSE ld END AS INT)) - DATE '{TODAY}' AS days_left FROM p JOIN vehicle USING (vehicle) LEFT JOIN lk USING (vehicle, part) LEFT JOIN ld USING (vehicle, part)),
state AS (SELECT *, CASE WHEN km_left < 0 OR days_left < 0 THEN 'overdue' WHEN km_left <= 1000 OR days_left <= 30 THEN 'soon' ELSE 'fine' END AS state FROM s)"""


def states(v):
    return vehicles.part_states(history(v), fleet(v), TODAY)


@query(f"{STATES} SELECT vehicle, part, km_left, days_left, state FROM state")
def part_states(v):
    """Kilometres and days left of every part of every vehicle."""
    return states(v)


DUE = f"""{STATES}, d AS (SELECT vehicle, part, CASE WHEN km_left IS NULL THEN days_left ELSE least(floor(km_left / 40.0), days_left) END AS days FROM state WHERE state <> 'fine'),
due AS (SELECT vehicle, count(*) AS parts, CAST(min(days) AS BIGINT) AS days, arg_min(part, (days, part)) AS part FROM d GROUP BY vehicle)"""


@query(f"{DUE} SELECT vehicle, parts, days, part FROM due")
def due_vehicles(v):
    """Whom to tell: vehicles with parts due, the most urgent part first."""
    return vehicles.most_urgent(states(v))


@query(f"{DUE} SELECT vehicle, parts, days, part FROM due WHERE vehicle NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '{TODAY}' - INTERVAL 900 DAY)")
def service_reminders(v):
    """Vehicles that are due and were not told within the last 900 days."""
    return vehicles.reminders(vehicles.most_urgent(states(v)), v.table("orders").select(F.col("o_custkey").alias("vehicle"), F.col("o_orderdate").alias("at")), TODAY, 900)


@query(f"WITH {HISTORY}, g AS (SELECT vehicle, upper(part) AS part, count(*) AS times, avg(life_km) AS life FROM history GROUP BY 1, 2) SELECT vehicle, part, times, CAST(greatest(floor(km_now / life) - times, 0) AS BIGINT) AS due FROM g JOIN vehicle USING (vehicle) WHERE life > 0")
def changes_due(v):
    """How many changes each vehicle's parts lack by their mean life."""
    return vehicles.changes_due(history(v), fleet(v))


@query(f"""WITH {HISTORY}, k AS (SELECT c_custkey AS vehicle, concat('P', p) AS part FROM customer, (VALUES (0), (3)) t(p)), n AS (SELECT * FROM history WHERE life_km IS NOT NULL),
o AS (SELECT vehicle, part, arg_max(life_km, (seen, life_km)) AS own FROM n GROUP BY 1, 2), a AS (SELECT part, arg_max(life_km, (seen, life_km)) AS other FROM n GROUP BY 1)
SELECT vehicle, part, coalesce(own, other) AS life_km, own IS NOT NULL AS of_this_one FROM k LEFT JOIN o USING (vehicle, part) LEFT JOIN a USING (part)""")
def life_before(v):
    """The last noted life of a part: of this vehicle, or of any."""
    asked = v.table("customer").select(F.col("c_custkey").alias("vehicle"), F.explode(F.array(F.lit("P0"), F.lit("P3"))).alias("part"))
    return vehicles.life_before(asked, history(v))


@query(f"WITH {HISTORY} SELECT DISTINCT vehicle, seen::VARCHAR AS seen FROM (SELECT DISTINCT vehicle, seen FROM history) QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY seen DESC) <= 5")
def last_services(v):
    """The last five days on which something was changed."""
    days = history(v).select("vehicle", "seen").distinct()
    return vehicles.latest(days, ["vehicle"], 5, F.desc("seen")).select("vehicle", F.col("seen").cast("string").alias("seen"))


#: Letters of plates and the years in which they were given out, for this query only.
ANCHORS = [(0, 1995), (4000, 2000), (9000, 2008), (15000, 2016)]
PLATE = "concat(chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey % 7 AS INT)), chr(CAST(65 + p_partkey % 11 AS INT)))"
RANK = "(p_partkey % 26) * 676 + (p_partkey % 7) * 26 + p_partkey % 11"


@query(f"""WITH r AS (SELECT p_partkey AS part, {PLATE} AS letters, {RANK} AS x FROM part) SELECT part, letters, CAST(CASE WHEN x <= 0 THEN 1995 WHEN x <= 4000 THEN round_even(1995 + 5 * x / 4000, 0) WHEN x <= 9000 THEN round_even(2000 + 8 * (x - 4000) / 5000, 0) WHEN x <= 15000 THEN round_even(2008 + 8 * (x - 9000) / 6000, 0) ELSE 2016 END AS BIGINT) AS year, x < 0 OR x > 15000 AS extrapolated FROM r""")
def plate_years(v):
    """The likely year of a plate by its letters, between known years."""
    rows = v.table("part").select(F.col("p_partkey").alias("part"), F.expr(PLATE.replace("CAST", "cast")).alias("letters"))
    y = vehicles.year_by_anchors(vehicles.letters_rank(F.col("letters"), 3), ANCHORS)
    return rows.select("part", "letters", y["year"].alias("year"), y["extrapolated"].alias("extrapolated"))


# Nested values


def order_items(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("quote"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("code")).agg(F.sum(F.col("l_quantity").cast("long")).alias("units"), F.max(F.col("l_suppkey")).alias("price"))


@query("""WITH i AS (SELECT l_orderkey AS quote, l_linenumber AS line, l_partkey AS code, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS units, max(l_suppkey) AS price FROM lineitem GROUP BY 1, 2, 3)
SELECT quote, '[' || string_agg('{"code":' || code || ',"units":' || units || ',"price":' || price || '}', ',' ORDER BY line, code, units, price) || ']' AS items, CAST(sum(units * price) AS BIGINT) AS total FROM i GROUP BY quote""")
def quotes(v):
    """Quotes with their items as JSON."""
    return nested.quotes(order_items(v), "quote", "line")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS p_name, p_size, p_retailprice FROM part")
def back_from_trash(v):
    """Rows put into the trash as JSON and taken back."""
    rows = v.table("part").select("p_partkey", F.when(F.col("p_partkey") % 3 > 0, F.col("p_name")).alias("p_name"), "p_size", "p_retailprice")
    return nested.from_trash(nested.to_trash(rows, "p_partkey", "part"), rows.schema, "part")


NOISY = """CASE p_partkey % 6 WHEN 0 THEN concat('Sure: {"n": ', p_size, ', "of": {"name": "', p_name, '"}} as asked') WHEN 1 THEN 'none here' WHEN 2 THEN concat('{broken ', p_size, '}') WHEN 3 THEN concat('It is ```json {"n": ', p_size, ', "of": {"name": "', p_brand, '"}} ``` {no more}')
WHEN 4 THEN concat('first } then {"of": {"name": "', p_type, '"}, "n": ', p_partkey, '}') ELSE concat('{"n": ', p_size, '} and {"n": 1}') END"""


@query(f"""WITH t AS (SELECT p_partkey AS part, {NOISY} AS t FROM part), b AS (SELECT part, CASE WHEN contains(t, '```') THEN coalesce(list_filter(list_transform(string_split(t, '```'), lambda x: regexp_replace(x, '^json', '')), lambda x: starts_with(ltrim(x), '{{'))[1], t) ELSE t END AS t FROM t),
j AS (SELECT part, substr(t, strpos(t, '{{'), length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{')) AS j FROM b WHERE contains(t, '{{'))
SELECT part, CAST(json_extract_string(j, '$.n') AS INT) AS n, json_extract_string(j, '$.of.name') AS name FROM j WHERE json_valid(j)""")
def json_in_text(v):
    """The number and name that a noisy answer holds as JSON."""
    rows = v.table("part").select(F.col("p_partkey").alias("part"), nested.first_json(F.expr(NOISY)).alias("j")).where("j is not null")
    return rows.select("part", F.get_json_object("j", "$.n").cast("int").alias("n"), F.get_json_object("j", "$.of.name").alias("name"))


# A graph with cycles and several ways between its nodes

CYCLIC = """WITH RECURSIVE raw AS (SELECT p_partkey AS a, p_partkey + 1 + p_size % 17 AS b, 30 + p_partkey * 13 % 70 AS conf FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_partkey + 20, 30 + p_partkey * 29 % 70 FROM part WHERE p_partkey % 5 = 0),
link AS (SELECT a, b, max(conf) AS conf FROM raw WHERE a // 50 = b // 50 GROUP BY a, b), step AS (SELECT a, b, conf FROM link UNION ALL SELECT b, a, conf FROM link)"""


def cyclic(v):
    k = F.col("p_partkey")
    rows = v.table("part").where("p_partkey % 3 <> 0").select(k.alias("a"), (k + 1 + F.col("p_size") % 17).alias("b"), (30 + k * 13 % 70).alias("conf"))
    rows = rows.unionByName(v.table("part").where("p_partkey % 5 = 0").select(k.alias("a"), (k + 20).alias("b"), (30 + k * 29 % 70).alias("conf")))
    return graph.canonical(rows.where(F.floor(F.col("a") / 50) == F.floor(F.col("b") / 50)))


@query(f"{CYCLIC}, reach(id, x) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, s.b FROM reach r JOIN step s ON s.a = r.x) SELECT id, min(x) AS net FROM reach GROUP BY id")
def cyclic_networks(v):
    """Networks of a graph with cycles."""
    return graph.networks(v.table("part").select(F.col("p_partkey").alias("id")), cyclic(v))


@query(f"""{CYCLIC}, walk(seed, id, hops, conf) AS (SELECT p_partkey, p_partkey, 0, CAST(100 AS BIGINT) FROM part WHERE p_partkey % 10 = 0 UNION SELECT w.seed, s.b, w.hops + 1, CAST(least(w.conf, s.conf) AS BIGINT) FROM walk w JOIN step s ON s.a = w.id AND s.conf >= 40 WHERE w.hops < 6),
best AS (SELECT seed, id, max(conf) AS conf FROM walk GROUP BY ALL) SELECT seed, id, b.conf, min(hops) AS hops FROM walk w JOIN best b USING (seed, id) WHERE w.conf = b.conf GROUP BY ALL""")
def cyclic_closure(v):
    """Searches in a graph with cycles: the strongest way of six links, and of these the shortest."""
    seeds = v.table("part").where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("seed"))
    return graph.closure(cyclic(v), seeds, 6, 40)


@query(f"""{CYCLIC}, walk(b1, e1, id) AS (SELECT a, b, a FROM link UNION SELECT w.b1, w.e1, s.b FROM walk w JOIN step s ON s.a = w.id WHERE NOT (s.a = w.b1 AND s.b = w.e1 OR s.a = w.e1 AND s.b = w.b1)),
side AS (SELECT b1 AS a, e1 AS b, count(*) AS n FROM walk GROUP BY b1, e1 HAVING NOT bool_or(id = e1)), reach(id, x) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT r.id, s.b FROM reach r JOIN step s ON s.a = r.x), size AS (SELECT id, count(*) AS whole FROM reach GROUP BY id)
SELECT a, b, least(n, whole - n) AS smaller FROM side JOIN size ON id = a WHERE least(n, whole - n) >= 2""")
def cyclic_bridges(v):
    """Links of a graph with cycles without which a network falls apart, two nodes or more on either side."""
    return graph.cut_links(cyclic(v), 2)


# Events, as the streaming forms have them


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) FILTER (event_type IN ('view', 'click')) AS searches, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS sales FROM events GROUP BY 1""")
def hourly_demand(v):
    """Searches, failed searches and sales by hour."""
    return events.demand(v.table("events").select("ts", "event_type")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH f AS (SELECT user_id, ts, unnest(range(0, 60, 10)) AS back FROM events WHERE event_type = 'error'), w AS (SELECT user_id, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '2024-01-01') - to_minutes(back) AS start FROM f)
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS attempts FROM w GROUP BY 1, 2 HAVING count(*) > 1""")
def failed_attempts(v):
    """Users with more than one failed search in an hour, hours beginning every ten minutes."""
    return events.attempts(v.table("events").select("user_id", "ts", "event_type"), 1).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH k AS (SELECT p_partkey AS id, p_size AS stock FROM part), r AS (SELECT l_partkey AS id, sum(CAST(l_quantity AS BIGINT)) AS held FROM lineitem WHERE l_shipdate >= DATE '1998-06-01' - 7 AND l_returnflag = 'N' GROUP BY 1)
SELECT id, stock, CAST(greatest(stock - coalesce(held, 0), 0) AS BIGINT) AS free FROM k LEFT JOIN r USING (id)""")
def unexpired_reservations(v):
    """Stock less what is reserved and has not expired: here items shipped in the week before June 1998 or later."""
    held = v.table("lineitem").where("l_returnflag = 'N'").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("long").alias("units"), F.col("l_shipdate").alias("seen"))
    return imports.free_stock(v.table("part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("stock")), held, "1998-06-01")


NAMES = sorted(set(QUERIES) - BEFORE)
