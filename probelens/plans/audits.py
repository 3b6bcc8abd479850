"""Further registered queries: parsing, joins, reports, ladders, audits, corpora and probes, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions import countries, scalars, text
from probelens.operators import assembled, audit, boot, cells, corpora, gates, joins, layouts, linear, probes, ranks, reports
from probelens.plans import registry
from probelens.plans.registry import _TOPICS, ACTS, CURVES, H, ITEMS, U, _auc, _mid, _poisson, r6, s6, statements
from probelens.plans.worlds import order_cells, order_items, statement_items, table, vector_acts

QUERIES: dict = {}
SQL: dict = {}
query = registry.keeper(QUERIES, SQL)

# ---- parsing and cleaning

_TOPIC = f"list_extract(['{(chr(39) + ', ' + chr(39)).join(_TOPICS)}'], (p_partkey % 7 + 1)::INT)"


@query("true_pairs", f"SELECT {_TOPIC} AS topic, p_name AS subject, p_type AS object FROM part WHERE p_partkey % 3 > 0 AND p_partkey % 7 < 6")
def _(s, d):
    return text.true_pairs(statements(s, d))


@query("natural_false", f"SELECT {_TOPIC} AS topic, p_name AS subject, p_type AS object FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 < 6")
def _(s, d):
    return text.natural_false(statements(s, d)).select("topic", "subject", "object")


@query("negation_is_injective", "WITH t AS (SELECT DISTINCT p_partkey % 7 AS k, p_name, p_type FROM part WHERE p_partkey % 7 < 6) SELECT *, n_in = n_out AS injective FROM (SELECT (SELECT count(*) FROM part WHERE p_partkey % 7 < 6) AS n, (SELECT count(*) FROM (SELECT DISTINCT p_partkey % 7 AS k, p_partkey % 2 AS e, p_name, p_type FROM part WHERE p_partkey % 7 < 6)) AS n_in, (SELECT count(*) FROM t) AS n_out)")
def _(s, d):
    return text.negate_all(statements(s, d).where("p_partkey % 7 < 6"), "statement")


@query("answer_cleaning", r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 3 THEN p_name || ' is O''Neil' ELSE p_name END AS cleaned, p_name AS clause, p_name || ' x' AS normal, p_name AS country, p_name AS clustered, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' stays' END AS prefix FROM part""")
def _(s, d):
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    said = F.when(k == 0, F.concat(F.lit('  "the '), name, F.lit('." '))).when(k == 1, F.concat(F.lit("It's "), name, F.lit(".\nsecond line"))).when(k == 2, F.concat(F.lit("located in "), name, F.lit("..."))).otherwise(F.concat(name, F.lit(" is O'Neil")))
    first = F.concat(F.lit(" A "), name, F.lit("; more! text\nthird."))
    normal = F.concat(F.lit("The "), F.upper(name), F.lit(", 12-x"))
    country = F.concat(F.upper(name), F.lit("."))
    grouped = F.concat(F.upper(name), F.lit("!?"))
    prefix = F.when(F.col("p_partkey") % 2 == 0, F.concat(name, F.lit(" was here, is there"))).otherwise(F.concat(name, F.lit(" stays")))
    return table(s, d, "part").select("p_partkey", text.clean_answer(said).alias("cleaned"), text.first_sentence(first).alias("clause"), text.answer_norm(normal).alias("normal"), text.country_norm(country).alias("country"), text.cluster_norm(grouped).alias("clustered"), text.subject_prefix(prefix).alias("prefix"))


@query("fragmentation_features", r"SELECT p_partkey, len(regexp_extract_all(p_brand, '[A-Za-z]{1,4}|[0-9]|[^\sA-Za-z0-9]'))::INT AS entity_pieces, len(regexp_extract_all(p_name, '[A-Za-z]{1,4}|[0-9]|[^\sA-Za-z0-9]'))::INT AS text_pieces, length(p_brand)::INT AS entity_chars, len(regexp_extract_all(p_brand, '[A-Za-z]{1,4}|[0-9]|[^\sA-Za-z0-9]')) / 1.0::DOUBLE AS pieces_a_word, (length(regexp_extract(p_name, '(\S+)\s*$', 1)) > 4)::INT AS continues FROM part")
def _(s, d):
    got = text.count_features(F.col("p_name"), F.col("p_brand"))
    return table(s, d, "part").select("p_partkey", *[c.alias(n) for n, c in got.items()])


@query("scalar_functions", """SELECT event_id, round(-exp(ln(1.0::DOUBLE + value)), 6) AS perplexity, round(1 / (1 + exp(-value / 50.0::DOUBLE)), 6) AS logistic, round(value / (value + 3.0::DOUBLE + 1e-12), 6) AS share, substr(sha256(event_type), 1, 12) AS id, value - 1 > 0 OR value + 1 < 0 AS apart, value - 1 <= 0.5 AND value + 1 >= 0.5 AS chance, lower(list_extract(string_split('org/' || event_type, '/'), -1)) AS model, '2026-08-14' AS day,
round((value - avg(value) OVER ()) / CASE WHEN stddev_pop(value) OVER () < 1e-8 THEN 1 ELSE stddev_pop(value) OVER () END, 6) + 0.0::DOUBLE AS z, round_even(event_id / 8.0::DOUBLE, 2) AS even FROM events WHERE value IS NOT NULL""")
def _(s, d):
    rows = table(s, d, "events").where("value is not null")
    m = rows.agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))  # one row
    v = F.col("value").cast("double")
    return rows.crossJoin(F.broadcast(m)).select("event_id", F.round(scalars.perplexity_score(F.log(v + 1)), 6).alias("perplexity"), F.round(scalars.sigmoid(v / 50), 6).alias("logistic"), F.round(scalars.true_share(v, F.lit(3.0)), 6).alias("share"), scalars.content_id(F.col("event_type")).alias("id"), scalars.excludes_zero(v - 1, v + 1).alias("apart"), scalars.includes_half(v - 1, v + 1).alias("chance"), scalars.short_model(F.concat(F.lit("org/"), "event_type")).alias("model"), scalars.file_date(F.lit("run_20260814.json")).cast("string").alias("day"), (F.round(scalars.zscore(v, F.col("m"), F.col("sd")), 6) + 0.0).alias("z"), F.bround(F.col("event_id") / 8.0, 2).alias("even"))


@query("interval_text", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '—' WHEN p_partkey % 3 = 1 THEN printf('%.3f', p_size / 64.0::DOUBLE) ELSE printf('%.3f [%.3f, %.3f]', p_size / 64.0::DOUBLE, p_size / 64.0::DOUBLE - 0.25::DOUBLE, p_size / 64.0::DOUBLE + 0.25::DOUBLE) END AS cell, printf('%+.3f [%+.3f, %+.3f]', p_size / 64.0::DOUBLE, p_size / 64.0::DOUBLE - 0.25::DOUBLE, p_size / 64.0::DOUBLE + 0.25::DOUBLE) || CASE WHEN p_size > 16 THEN '*' ELSE '' END AS gap FROM part")
def _(s, d):
    v, k = F.col("p_size") / 64.0, F.col("p_partkey") % 3
    return table(s, d, "part").select("p_partkey", scalars.interval_text(F.when(k > 0, v), F.when(k == 2, v - 0.25), F.when(k == 2, v + 0.25)).alias("cell"), scalars.gap_text(v, v - 0.25, v + 0.25).alias("gap"))


# ---- joins and sets

_ALIASED = (("Burma", "myanmar"), ("People's Republic of China", "china"), ("KINGDOM OF THE NETHERLANDS", "netherlands"), ("Korea, South", "south korea"), ("Cote d'Ivoire", "ivory coast"), ("Republic of China", "taiwan"), ("Atlantis!", "atlantis"), ("U.S.", "u s"))


@query("country_groups", "SELECT n_name AS name, trim(regexp_replace(lower(n_name), '[^a-z ]', ' ', 'g')) AS grp FROM nation UNION ALL SELECT * FROM (VALUES " + ", ".join(f"('{a.replace(chr(39), chr(39) * 2)}', '{g}')" for a, g in _ALIASED) + ") t(name, grp)")
def _(s, d):
    names = table(s, d, "nation").select(F.col("n_name").alias("name")).unionByName(s.createDataFrame([(a,) for a, _ in _ALIASED], "name string"))
    return names.select("name", countries.group_of(F.col("name")).alias("grp"))


@query("canonical_countries", "SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'United States' ELSE 'Nation ' || chr(65 + c_nationkey::INT) END AS canon FROM customer WHERE c_nationkey < 20")
def _(s, d):
    named = lambda k: F.concat(F.lit("Nation "), F.chr(F.lit(65) + F.col(k)))
    gold = table(s, d, "nation").where("n_nationkey < 20").select(named("n_nationkey").alias("name"), F.col("n_nationkey").alias("seq"))
    claims = table(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 0, "USA").otherwise(F.concat(F.lower(named("c_nationkey")), F.lit("."))).alias("object"))
    return joins.canonicalised(claims, "object", joins.canonical_map(s, gold)).select("c_custkey", "canon")


@query("verified_countries", "SELECT c_custkey AS subject, CASE WHEN c_custkey % 5 = 0 THEN 'unverifiable' WHEN c_custkey % 3 = 0 THEN 'kept' ELSE 'rejected' END AS status FROM customer")
def _(s, d):
    who = table(s, d, "customer").select(F.col("c_custkey").alias("subject"))
    claims = who.withColumn("object", F.when(F.col("subject") % 3 == 0, "Peru").otherwise("Burma"))
    known = who.where("subject % 5 <> 0").withColumn("objects", F.array(F.lit("Union of Myanmar"), F.lit("Russian Federation")))
    return joins.verify_countries(claims, known).select("subject", "status")


@query("adjudicated_answers", "SELECT c_custkey AS subject, CASE c_custkey % 4 WHEN 0 THEN 'no_country' WHEN 1 THEN 'correct' WHEN 2 THEN 'error' ELSE 'unverifiable' END AS status FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 4
    answers = table(s, d, "customer").select(F.col("c_custkey").alias("subject"), F.when(k == 0, "I can't say").when(k == 1, 'the USA."\nand more').when(k == 2, "It is Czechia.").otherwise("Egypt").alias("answer"))
    gold = answers.where("subject % 4 < 3").select("subject", F.array(F.lit("United States of America")).alias("objects"))
    return joins.adjudicated(answers, gold, joins.canonical_map(s, s.createDataFrame([("Peru", 1)], "name string, seq int"))).select("subject", "status")


@query("named_country", "SELECT c_custkey, c_custkey % 4 < 2 AS named FROM customer")
def _(s, d):
    k = F.col("c_custkey") % 4
    said = F.when(k == 0, "Shan State of Burma").when(k == 1, "the north of Myanmar!").when(k == 2, "Myanmarese hills").otherwise("")
    wanted = F.lit("Myanmar")
    return table(s, d, "customer").select("c_custkey", joins.names_it(said, wanted, countries.spoken(text.answer_norm(wanted))).alias("named"))


_COLOURS = ("green", "blue", "sky", "misty rose", "no such")


@query("word_containment", "SELECT p_partkey, name FROM part, (SELECT unnest(['" + "', '".join(_COLOURS) + "']) AS name) WHERE contains(' ' || p_name || ' ', ' ' || name || ' ')")
def _(s, d):
    names = s.createDataFrame([(c,) for c in _COLOURS], "name string")
    return joins.contains_word(table(s, d, "part").select("p_partkey", "p_name"), "p_name", names, "name").select("p_partkey", "name")


@query("exclusive_subjects", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_orderstatus = 'F')")
def _(s, d):
    urgent = table(s, d, "orders").where("o_orderpriority like '1%' and o_orderstatus = 'F'")
    return joins.exclusive(table(s, d, "customer").select("c_custkey"), urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("dangling_edges", "SELECT o_orderkey AS src, o_custkey AS dst, id FROM (SELECT *, unnest([o_orderkey, o_custkey]) AS id FROM orders) WHERE id NOT IN (SELECT c_custkey FROM customer)")
def _(s, d):
    edges = table(s, d, "orders").select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"))
    return gates.dangling(table(s, d, "customer").select(F.col("c_custkey").alias("id")), edges)


@query("set_differences", "SELECT k, 'first' AS only FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT c_custkey, 'second' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    return corpora.differences(table(s, d, "orders").select(F.col("o_custkey").alias("k")), table(s, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k")), "k")


@query("fold_complement", "SELECT doc_id FROM documents WHERE doc_id % 5 <> 2")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id")
    return corpora.complement(docs, docs.where("doc_id % 5 = 2"), "doc_id")


@query("family_union", "SELECT 'customer' AS family, c_acctbal AS v FROM customer UNION ALL SELECT 'supplier', s_acctbal FROM supplier")
def _(s, d):
    return table(s, d, "customer").select(F.lit("customer").alias("family"), F.col("c_acctbal").alias("v")).unionByName(table(s, d, "supplier").select(F.lit("supplier").alias("family"), F.col("s_acctbal").alias("v")))


@query("model_set", "SELECT DISTINCT p_brand AS model FROM part")
def _(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("model")).distinct().orderBy("model")


@query("gazetteer_lookup", "SELECT n_nationkey, n_name, objects FROM nation LEFT JOIN (SELECT c_nationkey, list_sort(list(DISTINCT c_mktsegment)) AS objects FROM customer WHERE c_nationkey < 20 GROUP BY 1) ON c_nationkey = n_nationkey")
def _(s, d):
    listed = table(s, d, "customer").where("c_nationkey < 20").select(F.col("c_nationkey").alias("n_nationkey"), F.col("c_mktsegment").alias("object"))
    return corpora.with_gazetteer(table(s, d, "nation").select("n_nationkey", "n_name"), listed, "n_nationkey")


@query("entity_universe", "SELECT DISTINCT unnest([p_name, p_type]) AS entity FROM part WHERE p_partkey % 7 < 6 UNION SELECT n_name FROM nation")
def _(s, d):
    rows = statements(s, d)
    return corpora.entity_universe(text.true_pairs(rows), text.natural_false(rows), table(s, d, "nation").select(F.col("n_name").alias("entity")))


@query("object_counts", f"SELECT {_TOPIC} AS topic, p_type AS object, count(*) AS cnt FROM part WHERE p_partkey % 7 < 6 GROUP BY ALL")
def _(s, d):
    return corpora.object_counts(statements(s, d))


@query("true_object_sets", f"SELECT {_TOPIC} AS topic, p_name AS subject, list_sort(list(DISTINCT p_type)) AS objects FROM part WHERE p_partkey % 7 < 6 AND p_partkey % 3 > 0 GROUP BY ALL")
def _(s, d):
    return corpora.true_objects(text.true_pairs(statements(s, d)))


@query("aligned_baseline", "SELECT o_orderkey, o_totalprice + 1 AS v, 'baseline' AS source FROM orders")
def _(s, d):
    own = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return joins.baseline_or(own, own.withColumn("v", F.col("v") + 1), "o_orderkey", "v")


@query("unaligned_baseline", "SELECT o_orderkey, o_totalprice AS v, 'reference' AS source FROM orders")
def _(s, d):
    own = table(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return joins.baseline_or(own, own.where("o_orderkey % 7 <> 1").withColumn("v", F.col("v") + 1), "o_orderkey", "v")


@query("paired_vectors", f"WITH {ACTS} SELECT a.item_id, round(a.vec[1]::DOUBLE, 6) AS first, round(b.vec[8]::DOUBLE, 6) AS last, 16 AS width FROM acts a JOIN acts b ON a.item_id = b.item_id AND a.layer = 0 AND b.layer = 1")
def _(s, d):
    acts = vector_acts(s, d)
    got = joins.paired_vectors(acts.where("layer = 0").select("item_id", "vec"), acts.where("layer = 1"))
    return got.select("item_id", F.round(F.element_at("vec", 1), 6).alias("first"), F.round(F.element_at("vec", -1), 6).alias("last"), F.size("vec").alias("width"))


@query("stacked_taps", f"WITH {ACTS} SELECT a.item_id, round(list_sum(list_transform(a.vec || b.vec, lambda x: x::DOUBLE)), 5) AS total, 16 AS width FROM acts a JOIN acts b ON a.item_id = b.item_id AND a.layer = 4 AND b.layer = 6")
def _(s, d):
    got = joins.stacked_taps(vector_acts(s, d), (4, 6))
    return got.select("item_id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("vec").alias("width"))


@query("pooled_vectors", f"WITH {ACTS}, p AS (SELECT item_id, pos, avg(x) AS m, max_by(x, layer) AS l FROM dims GROUP BY ALL) SELECT item_id, round(sum(m), 5) + 0.0::DOUBLE AS mean, round(sum(l), 5) + 0.0::DOUBLE AS last FROM p GROUP BY item_id")
def _(s, d):
    tokens = vector_acts(s, d)
    total = lambda c: (F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5) + 0.0).alias(c)
    return assembled.pooled(tokens, "mean", ("item_id",), "layer").select("item_id", total("mean")).join(assembled.pooled(tokens, "last", ("item_id",), "layer").select("item_id", total("last")), "item_id")


# ---- ranks and samples


@query("global_terciles", f"WITH {ITEMS}, r AS (SELECT *, row_number() OVER (ORDER BY logf, item_id) AS r, count(*) OVER () AS n FROM items) SELECT item_id, r > n // 3 AS typical FROM r WHERE r <= n // 3 OR r > n - n // 3")
def _(s, d):
    return cells.terciles(order_items(s, d)).select("item_id", "typical")


@query("balanced_cells", f"WITH {ITEMS}, k AS (SELECT min(n) AS k FROM (SELECT count(*) AS n FROM celled GROUP BY cell)) SELECT item_id, cell FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY md5('0:' || item_id), item_id) AS r FROM celled, k) WHERE r <= k")
def _(s, d):
    return cells.balanced_cells(order_cells(s, d)).select("item_id", "cell")


@query("admitted_domains", f"WITH {ITEMS}, c AS (SELECT domain, count(*) AS n, min(k) AS low, count(*) AS m FROM (SELECT domain, cell, count(*) AS k FROM celled GROUP BY ALL) GROUP BY domain), ok AS (SELECT domain FROM (SELECT domain, cell, count(*) AS k FROM celled GROUP BY ALL) GROUP BY domain HAVING sum(k) >= 4 * 60 AND min(k) >= 60 AND count(*) = 4) SELECT item_id FROM celled WHERE domain IN (SELECT domain FROM ok)")
def _(s, d):
    return cells.admitted(order_cells(s, d), 60).select("item_id")


@query("frequency_tiers", "WITH c AS (SELECT p_brand AS topic, p_type AS object, count(*) AS cnt FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY cnt DESC, object) AS r, count(*) OVER (PARTITION BY topic) AS n FROM c) SELECT topic, object, 'common' AS tier FROM r WHERE r <= greatest(1, n // 3) UNION ALL SELECT topic, object, 'rare' FROM r WHERE r > n - greatest(1, n // 3)")
def _(s, d):
    counts = table(s, d, "part").groupBy(F.col("p_brand").alias("topic"), F.col("p_type").alias("object")).agg(F.count("*").alias("cnt"))
    return cells.tops(counts, ("topic",)).where("tier is not null").select("topic", "object", "tier")


@query("widest", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 6")
def _(s, d):
    return reports.widest(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")


@query("tap_layers", "SELECT n::INT AS n, [round_even(0.6::DOUBLE * (n - 1), 0)::INT, round_even(0.7::DOUBLE * (n - 1), 0)::INT, round_even(0.8::DOUBLE * (n - 1), 0)::INT, round_even(0.85::DOUBLE * (n - 1), 0)::INT] AS taps FROM (SELECT DISTINCT p_size AS n FROM part WHERE p_size > 1)")
def _(s, d):
    """The tapped layers of models as deep as parts are large."""
    part = table(s, d, "part").where("p_size > 1").select(F.col("p_size").cast("int").alias("n")).distinct()
    return part.select("n", assembled.tap_layers(F.col("n")).alias("taps"))


# ---- layer reports


@query("median_tied_layer", f"WITH {CURVES}, t AS (SELECT * FROM curves, (SELECT max(in_dist) AS best FROM curves) WHERE in_dist >= best - 0.02 - 1e-12), m AS (SELECT median(off) AS med FROM t) SELECT {s6('med', 'median_off')}, layer FROM (SELECT med, layer, row_number() OVER (ORDER BY round(abs(off - med), 12), layer) AS r FROM t, m) WHERE r = 1")
def _(s, d):
    return reports.median_tied(probes.curves(vector_acts(s, d))).select(*r6("median_off"), "layer")


RULES = f"""WITH {CURVES}, m AS (SELECT *, max(in_dist) OVER () AS t, max(layer) OVER () AS l, max(off) OVER () AS o FROM curves),
k AS (SELECT *, unnest(['best', 'earliest95', 'mid', 'depth0.6', 'depth0.7', 'depth0.8', 'depth0.85']) AS rule, unnest([-in_dist, CASE WHEN in_dist >= 0.95 * t THEN layer END, abs(layer - l // 2), abs(layer - 0.6::DOUBLE * l), abs(layer - 0.7::DOUBLE * l), abs(layer - 0.8::DOUBLE * l), abs(layer - 0.85::DOUBLE * l)]) AS k FROM m),
rules AS (SELECT rule, layer, off, o - off AS short FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k, layer) AS r FROM k WHERE k IS NOT NULL) WHERE r = 1)"""


@query("layer_rule_costs", f"{RULES} SELECT rule, count(*) AS n, {s6('avg(off)', 'mean_off')}, {s6('avg(short)', 'mean_shortfall')} FROM rules GROUP BY rule")
def _(s, d):
    return reports.rule_costs(reports.layer_rules(probes.curves(vector_acts(s, d)))).select("rule", "n", *r6("mean_off", "mean_shortfall"))


PAIRS = "pairs AS (SELECT p_brand AS model, 'probe' || (p_size % 4) AS probe, avg(p_size) / 51.0::DOUBLE AS in_dist, avg(p_partkey % 100) / 100.0::DOUBLE AS off, max(p_partkey % 100) / 150.0::DOUBLE AS hi FROM part GROUP BY ALL)"


def pairs(s, d) -> DataFrame:
    """A (model, probe) for each brand of parts and size modulo 4."""
    return table(s, d, "part").groupBy(F.col("p_brand").alias("model"), F.concat(F.lit("probe"), (F.col("p_size") % 4).cast("string")).alias("probe")).agg((F.avg("p_size") / 51.0).alias("in_dist"), (F.avg(F.col("p_partkey") % 100) / 100.0).alias("off"), (F.max(F.col("p_partkey") % 100) / 150.0).alias("hi"))


@query("always_below", f"WITH {PAIRS} SELECT model, bool_and(off < 0.5) AS all_below, max_by(probe, (off, probe)) AS best_probe, {s6('max(off)', 'best_off')} FROM pairs GROUP BY model")
def _(s, d):
    return reports.always_below(pairs(s, d)).select("model", "all_below", "best_probe", *r6("best_off"))


@query("strict_tallies", f"WITH {PAIRS} SELECT floor, count(*) AS n, count(*) FILTER (off < 0.5) AS n_below, count(hi) AS n_with, count(*) FILTER (hi < 0.5) AS n_strict FROM pairs, (SELECT unnest([0.0::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]) AS floor) WHERE in_dist >= floor GROUP BY floor")
def _(s, d):
    return reports.floor_tallies(pairs(s, d), (0.0, 0.4, 0.5), "hi")


@query("floor_correlations", f"WITH {PAIRS}, e AS (SELECT * FROM pairs, (SELECT unnest([0.0::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]) AS floor) WHERE in_dist >= floor), k AS (SELECT *, rank() OVER (PARTITION BY floor ORDER BY in_dist) + (count(*) OVER (PARTITION BY floor, in_dist) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY floor ORDER BY off) + (count(*) OVER (PARTITION BY floor, off) - 1) / 2.0::DOUBLE AS b FROM e) SELECT floor, count(*) AS n, {s6('corr(a, b)', 'rho')}, {s6('min(off)', 'off_min')}, {s6('max(off)', 'off_max')}, count(*) FILTER (off < 0.5) AS n_below FROM k GROUP BY floor")
def _(s, d):
    return reports.floor_correlations(pairs(s, d), (0.0, 0.4, 0.5)).select("floor", "n", *r6("rho", "off_min", "off_max"), "n_below")


@query("clustered_spearman", f"""WITH {PAIRS}, drawn AS (SELECT * FROM (SELECT p.*, b, {_poisson("'0:' || b || ':' || model")} AS w FROM pairs p, range(1, 201) t(b)) WHERE w > 0), many AS (SELECT *, unnest(range(w)) AS k FROM drawn),
r AS (SELECT b, rank() OVER (PARTITION BY b ORDER BY in_dist) + (count(*) OVER (PARTITION BY b, in_dist) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY b ORDER BY off) + (count(*) OVER (PARTITION BY b, off) - 1) / 2.0::DOUBLE AS y FROM many), v AS (SELECT b, corr(x, y) AS rho FROM r GROUP BY b HAVING count(*) >= 3),
p AS (SELECT corr(x, y) AS rho, count(*) AS n FROM (SELECT {_mid('pairs', 'in_dist')} AS x, {_mid('pairs', 'off')} AS y FROM pairs))
SELECT {s6('any_value(p.rho)', 'rho')}, any_value(n) AS n, {s6('quantile_cont(v.rho, 0.025)', 'lo')}, {s6('quantile_cont(v.rho, 0.975)', 'hi')}, count(*) AS n_boot FROM v, p WHERE v.rho IS NOT NULL""")
def _(s, d):
    return boot.clustered_spearman(pairs(s, d), "in_dist", "off", "model", 200).select(*r6("rho"), "n", *r6("lo", "hi"), "n_boot")


@query("pearson_interval", f"""WITH {PAIRS}, m AS (SELECT model, avg(in_dist) AS x, avg(off) AS y FROM pairs GROUP BY model), v AS (SELECT b, corr(x, y) AS r FROM (SELECT x, y, b, unnest(range({_poisson("'0:' || b || ':' || model")})) AS k FROM m, range(1, 1001) t(b)) GROUP BY b)
SELECT {s6('(SELECT corr(x, y) FROM m)', 'r')}, (SELECT count(*) FROM m) AS n, {s6('quantile_cont(r, 0.025)', 'lo')}, {s6('quantile_cont(r, 0.975)', 'hi')} FROM v WHERE r IS NOT NULL AND NOT isnan(r)""")
def _(s, d):
    m = pairs(s, d).groupBy("model").agg(F.avg("in_dist").alias("x"), F.avg("off").alias("y"))
    return boot.pearson_ci(m, "x", "y", "model", 1000).select(*r6("r"), "n", *r6("lo", "hi"))


@query("metric_summary", f"WITH {PAIRS} SELECT probe, count(off) AS n, {s6('avg(off)', 'mean')}, {s6('min(off)', 'low')}, {s6('max(off)', 'high')} FROM pairs GROUP BY probe")
def _(s, d):
    return reports.summary(pairs(s, d), "off", ("probe",)).select("probe", "n", *r6("mean", "low", "high"))


@query("topic_layer_means", f"WITH {ACTS}, a AS (SELECT * FROM {_auc('scored JOIN (SELECT DISTINCT item_id AS i, topic FROM acts) ON i = item_id', 'layer, topic', 'score', 'typical_item')}) SELECT layer, {s6('avg(auroc)', 'mean')}, count(auroc) AS n FROM a GROUP BY layer".replace("typical_item", "item_id % 3 = 0"))
def _(s, d):
    scored = probes.mass_mean_scores(vector_acts(s, d)).withColumn("third", F.col("item_id") % 3 == 0)
    return reports.summary(ranks.auroc(scored, ("layer", "topic"), "score", "third"), "auroc", ("layer",)).select("layer", *r6("mean"), "n")


@query("called_true", f"WITH {ITEMS} SELECT cell, count(*) AS n, {s6('avg((score / 300000.0::DOUBLE > 0.5)::INT)', 'called')} FROM celled GROUP BY cell")
def _(s, d):
    return reports.called_true(order_cells(s, d).withColumn("score", F.col("score") / 300000.0)).select("cell", "n", *r6("called"))


@query("separation", f"WITH {ITEMS} SELECT domain, {s6('(avg(score) FILTER (truth) - avg(score) FILTER (NOT truth)) / stddev_pop(score)', 'separation')} FROM items GROUP BY domain")
def _(s, d):
    return reports.separation(order_items(s, d), by=("domain",)).select("domain", *r6("separation"))


@query("disowned_split", "WITH r AS (SELECT (p_size - 1) / 49.0::DOUBLE AS b, (p_partkey % 100) / 100.0::DOUBLE AS p FROM part) SELECT count(*) FILTER (b < 0.5) AS n_disowned, " + ", ".join((s6("avg(p) FILTER (b < 0.5)", "probe_mean"), s6("avg(b) FILTER (b < 0.5)", "behaviour_mean"), s6("avg((p > 0.5)::INT) FILTER (b < 0.5)", "called_true"), s6("avg((p > 0.5 AND b < 0.5)::INT)", "probe_true_author_false"), s6("avg((p < 0.5 AND b >= 0.5)::INT)", "probe_false_author_true"))) + " FROM r")
def _(s, d):
    got = reports.disowned(table(s, d, "part").select(((F.col("p_size") - 1) / 49.0).alias("behaviour"), ((F.col("p_partkey") % 100) / 100.0).alias("probe")))
    return got.select("n_disowned", *r6(*[c for c in got.columns if c != "n_disowned"]))


ANSWERED = "r AS (SELECT o_orderkey AS k, o_totalprice / 1000.0::DOUBLE AS entropy, (o_custkey % 97)::DOUBLE AS freq, o_orderstatus = 'F' AS correct FROM orders)"


def answered(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 1000.0).alias("entropy"), (F.col("o_custkey") % 97).cast("double").alias("freq"), (F.col("o_orderstatus") == "F").alias("correct"))


@query("entropy_by_frequency", f"WITH {ANSWERED}, m AS (SELECT median(freq) AS median FROM r WHERE correct), g AS (SELECT *, freq < median AS rare FROM r, m WHERE correct), a AS (SELECT * FROM {_auc('g', '', 'entropy', 'rare')}) SELECT any_value(median) AS median, count(*) FILTER (rare) AS n_rare, {s6('avg(entropy) FILTER (rare)', 'rare_mean')}, count(*) FILTER (NOT rare) AS n_common, {s6('avg(entropy) FILTER (NOT rare)', 'common_mean')}, {s6('avg(entropy) FILTER (rare) - avg(entropy) FILTER (NOT rare)', 'difference')}, {s6('(SELECT auroc FROM a)', 'auroc')}, {s6('(SELECT corr(entropy, freq) FROM r)', 'corr')} FROM g")
def _(s, d):
    got = reports.entropy_by_frequency(answered(s, d))
    return got.select("median", "n_rare", *r6("rare_mean"), "n_common", *r6("common_mean", "difference", "auroc", "corr"))


@query("detection_auroc", f"WITH {ANSWERED} SELECT {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('r', '', 'entropy', 'correct')} WHERE n_pos > 0 AND n_neg > 0")
def _(s, d):
    return reports.detection(answered(s, d), "entropy").select(*r6("auroc"), "n_pos", "n_neg")


@query("recoverability_join", f"WITH {PAIRS}, m AS (SELECT lower(model) AS model, avg(off) AS rec FROM pairs GROUP BY 1) SELECT probe, count(*) AS n, {s6('corr(rec, off)', 'r')} FROM pairs p JOIN m ON lower(p.model) = m.model WHERE in_dist >= 0.4 GROUP BY probe")
def _(s, d):
    """Curves meet recoverability by the model's short name, whatever its case or owner."""
    p = pairs(s, d)
    rec = p.groupBy("model").agg(F.avg("off").alias("rec")).select(F.concat(F.lit("Org/"), F.upper("model")).alias("name"), "rec")
    got = reports.mechanism(p, rec, floor=0.4)
    return got.select("probe", "n", *r6("r"))


@query("headline_join", f"WITH {CURVES} SELECT layer, {s6('off', 'off')}, CASE WHEN layer = 4 THEN {'round(off, 6)'} END AS headline FROM curves")
def _(s, d):
    curves = probes.curves(vector_acts(s, d))
    heads = s.createDataFrame([("vectors", 4)], "model string, headline_layer int")
    return reports.with_headline(curves, heads).select("layer", *r6("off"), F.round("headline", 6).alias("headline"))


# ---- ladders and shapes

LADDER = "ladder AS (SELECT p_brand AS model, list_extract([100, 200, 300, 450, 608], (p_partkey % 5 + 1)::INT) AS rung, (row_number() OVER (PARTITION BY p_brand, p_partkey % 5 ORDER BY p_partkey) - 1) % 4 AS rep, (p_size - 1) / 49.0::DOUBLE AS x, (p_retailprice + p_size * p_size) / 4000.0::DOUBLE AS y FROM part), reps AS (SELECT model, rung, rep, avg(x) AS x, avg(y) AS y FROM ladder GROUP BY ALL), rungs AS (SELECT model, rung, avg(x) AS x, avg(y) AS y, stddev_samp(x) AS sd FROM reps GROUP BY ALL)"


def ladder(s, d) -> DataFrame:
    """Four replicates of every rung for every brand of parts."""
    from pyspark.sql import Window

    rung = F.get(F.array(*[F.lit(r) for r in (100, 200, 300, 450, 608)]), (F.col("p_partkey") % 5).cast("int"))
    rep = (F.row_number().over(Window.partitionBy("p_brand", F.col("p_partkey") % 5).orderBy("p_partkey")) - 1) % 4
    rows = table(s, d, "part").select(F.col("p_brand").alias("model"), rung.alias("rung"), rep.alias("rep"), ((F.col("p_size") - 1) / 49.0).alias("x"), ((F.col("p_retailprice") + F.col("p_size") * F.col("p_size")) / 4000.0).alias("y"))
    return rows.groupBy("model", "rung", "rep").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


@query("rung_means", f"WITH {LADDER} SELECT model, rung, {s6('x', 'x')}, {s6('y', 'y')}, {s6('sd', 'sd')} FROM rungs")
def _(s, d):
    return linear.rung_means(ladder(s, d)).select("model", "rung", *r6("x", "y", "sd"))


def _knees(src: str, by: str, w: str = "1") -> str:
    """SQL for the hinge of src(by, x, y) by columns: (by, knee, floor, slope, e)."""
    return f"""(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY e, knee) AS r FROM (SELECT {by}, knee, slope, (sy - slope * sh) / n AS floor, round(vy - slope * vhy, 12) AS e FROM (
        SELECT *, vhy / vh AS slope FROM (SELECT *, shh - sh * sh / n AS vh, syy - sy * sy / n AS vy, shy - sh * sy / n AS vhy FROM (
        SELECT {by}, knee, sum(w) AS n, sum(w * h) AS sh, sum(w * y) AS sy, sum(w * h * h) AS shh, sum(w * h * y) AS shy, sum(w * y * y) AS syy FROM (SELECT {by}, knee, greatest(0.0::DOUBLE, x - knee) AS h, y, {w}::DOUBLE AS w FROM {src}, (SELECT 0.05::DOUBLE + i * 0.005::DOUBLE AS knee FROM range(0, 180) t(i))) GROUP BY {by}, knee)) WHERE vh > 1e-12))) WHERE r = 1)"""


@query("migration_verdict", f"WITH {LADDER}, k AS (SELECT * FROM {_knees('rungs', 'rung')}), d AS (SELECT *, knee - lag(knee) OVER (ORDER BY rung) AS d FROM k), v AS (SELECT max_by(knee, rung) - min_by(knee, rung) AS shift, greatest(count(*) FILTER (d > 0), count(*) FILTER (d < 0)) AS steps FROM d) SELECT {s6('shift', 'shift')}, steps, CASE WHEN abs(shift) > 0.23 AND steps >= 3 THEN 'MIGRATED' WHEN abs(shift) > 0.115 OR steps < 3 THEN 'INDETERMINATE' ELSE 'NO MIGRATION' END AS verdict FROM v")
def _(s, d):
    return reports.ladder_verdict(linear.hinge(linear.rung_means(ladder(s, d)), ("rung",))).select(*r6("shift"), "steps", "verdict")


@query("knee_interval", f"""WITH {LADDER}, d AS (SELECT * FROM (SELECT r.*, b, {_poisson("'0:' || b || ':' || model")} AS w FROM rungs r, range(1, 201) t(b)) WHERE w > 0), ok AS (SELECT rung, b FROM d GROUP BY ALL HAVING count(DISTINCT x) >= 4), v AS (SELECT * FROM {_knees('(SELECT * FROM d JOIN ok USING (rung, b))', 'rung, b', 'w')})
SELECT rung, count(*) AS n_boot, {s6('quantile_cont(knee, 0.025)', 'knee_lo')}, {s6('quantile_cont(knee, 0.975)', 'knee_hi')}, {s6('quantile_cont(floor, 0.025)', 'floor_lo')}, {s6('quantile_cont(floor, 0.975)', 'floor_hi')} FROM v GROUP BY rung""")
def _(s, d):
    return linear.hinge_ci(linear.rung_means(ladder(s, d)), "model", ("rung",), 200).select("rung", "n_boot", *r6("knee_lo", "knee_hi", "floor_lo", "floor_hi"))


def _normal(key: str) -> str:
    return f"(sqrt(-2 * ln({U.format(key + ' || ' + chr(39) + ':r' + chr(39))})) * cos(6.283185307179586::DOUBLE * {U.format(key + ' || ' + chr(39) + ':a' + chr(39))}))"


@query("dilution", f"""WITH {LADDER}, full_ AS (SELECT model, x FROM rungs WHERE rung = 608), sd AS (SELECT rung, avg(sd) AS noise FROM rungs GROUP BY rung), obs AS (SELECT rung, knee, slope FROM {_knees('rungs', 'rung')}),
n AS (SELECT rung, b, f.x + noise * {_normal("'20260814:' || rung || ':' || b || ':' || model")} AS x, y FROM rungs r JOIN full_ f USING (model) JOIN sd USING (rung), range(1, 101) t(b)), v AS (SELECT * FROM {_knees('n', 'rung, b')})
SELECT rung, {s6('any_value(noise)', 'sd')}, {s6('any_value(obs.knee)', 'knee')}, {s6('quantile_cont(v.knee, 0.025)', 'knee_lo')}, {s6('quantile_cont(v.knee, 0.5)', 'knee_mid')}, {s6('quantile_cont(v.knee, 0.975)', 'knee_hi')}, any_value(obs.knee) BETWEEN quantile_cont(v.knee, 0.025) AND quantile_cont(v.knee, 0.975) AS knee_inside FROM v JOIN sd USING (rung) JOIN obs USING (rung) GROUP BY rung""")
def _(s, d):
    rungs = linear.rung_means(ladder(s, d))
    got = linear.dilution(rungs.where("rung = 608").select("model", "x"), rungs, 100)
    return got.select("rung", *r6("sd", "knee", "knee_lo", "knee_mid", "knee_hi"), "knee_inside")


@query("broken_pairs", f"""WITH {LADDER}, dev AS (SELECT rung, x - avg(x) OVER (PARTITION BY model, rung) AS dx, y - avg(y) OVER (PARTITION BY model, rung) AS dy FROM reps), r AS (SELECT rung, corr(dx, dy) AS r FROM dev GROUP BY rung), m AS (SELECT model, rung, max(rep) + 1 AS m FROM reps GROUP BY ALL HAVING max(rep) > 0),
i AS (SELECT *, {H.format("'20260814:i:' || rung || ':' || b || ':' || model")} % m AS i, {H.format("'20260814:j:' || rung || ':' || b || ':' || model")} % (m - 1) AS j FROM m, range(1, 51) t(b)), e AS (SELECT i.rung, b, how, x.x, y.y FROM (SELECT *, unnest(['paired', 'broken']) AS how, unnest([i, (i + 1 + j) % m]) AS k FROM i) i JOIN reps x ON x.model = i.model AND x.rung = i.rung AND x.rep = i.i JOIN reps y ON y.model = i.model AND y.rung = i.rung AND y.rep = i.k),
v AS (SELECT * FROM {_knees('e', 'rung, how, b')}) SELECT rung, {s6('any_value(r)', 'r')}, {s6("quantile_cont(slope, 0.5) FILTER (how = 'paired')", 'paired_mid')}, {s6("quantile_cont(slope, 0.5) FILTER (how = 'broken')", 'broken_mid')} FROM v JOIN r USING (rung) GROUP BY rung""")
def _(s, d):
    return linear.broken_pairs(ladder(s, d), 50).select("rung", *r6("r", "paired_mid", "broken_mid"))


# ---- audits


def _banded(src: str, by: str, w: str) -> str:
    """SQL for src with band: how many of its group's three inner quartiles of logf are not above its own; w: how often a row counts."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    using = f"JOIN edges USING ({by})" if by else ", edges"
    pick = lambda q: f"(max(v) FILTER (bef <= floor({q} * (n - 1)) AND floor({q} * (n - 1)) < bef + c) + (max(v) FILTER (bef <= ceil({q} * (n - 1)) AND ceil({q} * (n - 1)) < bef + c) - max(v) FILTER (bef <= floor({q} * (n - 1)) AND floor({q} * (n - 1)) < bef + c)) * (any_value({q} * (n - 1)) - floor(any_value({q} * (n - 1)))))"
    return f"""(WITH spots AS (SELECT {keys}logf AS v, sum({w}) AS c FROM {src} GROUP BY ALL), ran AS (SELECT *, coalesce(sum(c) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(c) OVER ({part}) AS n FROM spots),
        edges AS (SELECT {keys}{pick('0.25::DOUBLE')} AS e1, {pick('0.5::DOUBLE')} AS e2, {pick('0.75::DOUBLE')} AS e3 FROM ran {'GROUP BY ' + by if by else ''}) SELECT s.*, ((logf >= e1)::INT + (logf >= e2)::INT + (logf >= e3)::INT)::INT AS band FROM {src} s {using})"""


def _within(src: str, by: str, w: str = "1") -> str:
    """SQL for (by, pooled, within, n_usable, gap)."""
    keys = f"{by}, " if by else ""
    using = f"JOIN b USING ({by})" if by else ", b"
    return f"""(WITH a AS (SELECT * FROM {_auc(_banded(src, by, w), keys + 'band', w=w)}), b AS (SELECT {keys}sum((n_pos + n_neg) * auroc) / sum(n_pos + n_neg) AS within, count(*) AS n_usable FROM a WHERE least(n_pos, n_neg) >= 5 {'GROUP BY ' + by if by else ''}),
        p AS (SELECT * FROM {_auc(src, by, w=w)}) SELECT {keys}auroc AS pooled, within, n_usable, auroc - within AS gap FROM p {using})"""


@query("stratified_bands", f"WITH {ITEMS} SELECT band, (n_pos + n_neg)::BIGINT AS n, n_pos, n_neg, CASE WHEN least(n_pos, n_neg) >= 5 THEN round(auroc, 6) END AS auroc FROM {_auc(_banded('items', '', '1'), 'band')}")
def _(s, d):
    return boot.bands(order_items(s, d), "logf").select("band", "n", "n_pos", "n_neg", F.round("auroc", 6).alias("auroc"))


@query("stratified_gap", f"""WITH {ITEMS}, d AS (SELECT * FROM (SELECT i.*, b, {_poisson("'0:' || b || ':' || item_id")} AS w FROM items i, range(1, 1001) t(b)) WHERE w > 0), p AS (SELECT * FROM {_within('items', '')}), v AS (SELECT * FROM {_within('d', 'b', 'w')})
SELECT {s6('any_value(p.pooled)', 'pooled')}, {s6('any_value(p.within)', 'within')}, any_value(p.n_usable) AS n_usable, {s6('any_value(p.gap)', 'gap')}, {s6('quantile_cont(v.gap, 0.025)', 'lo')}, {s6('quantile_cont(v.gap, 0.975)', 'hi')}, count(*) AS n_boot FROM v, p WHERE v.gap IS NOT NULL""")
def _(s, d):
    return boot.stratified(order_items(s, d), "logf").select(*r6("pooled", "within"), "n_usable", *r6("gap", "lo", "hi"), "n_boot")


@query("mediation_terms", f"WITH {ITEMS}, c AS (SELECT corr(score, truth::INT::DOUBLE) AS a, corr(score, logf) AS b, corr(truth::INT::DOUBLE, logf) AS c, count(*) AS n FROM items) SELECT {s6('a', 'beta_marginal')}, {s6('(a - b * c) / (1 - c * c)', 'beta_joint')}, {s6('1 - (a - b * c) / (1 - c * c) / a', 'shrinkage')}, {s6('a * a', 'r2_marginal')}, {s6('((a - b * c) * a + (b - a * c) * b) / (1 - c * c)', 'r2_joint')}, n FROM c")
def _(s, d):
    got = linear.mediation_full(order_items(s, d), (), "score", "truth", "logf").where("term = 'truth'")
    return got.select(*r6("beta_marginal", "beta_joint", "shrinkage", "r2_marginal", "r2_joint"), "n")


def _plain_mean(train, rows):
    """The mass-mean direction of raw vectors, which SQL can follow."""
    theta = probes.mass_mean(train, ())
    return rows.crossJoin(F.broadcast(theta)).withColumn("score", scalars.dot(F.col("vec"), F.col("theta"))).drop("theta")


def framed(s, d, layer: int = 3) -> DataFrame:
    return vector_acts(s, d).where(F.col("layer") == layer).withColumn("logf", F.element_at("vec", 1).cast("double"))


@query("adversarial_split", f"""WITH {ACTS.split('theta AS')[0].rstrip().rstrip(',')}, one AS (SELECT * FROM acts WHERE layer = 3), r AS (SELECT item_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS r, count(*) OVER () AS n FROM one WHERE cell IN ('TT', 'FA')),
parts AS (SELECT one.*, CASE WHEN r IS NULL THEN 'off' WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'held' END AS part FROM one LEFT JOIN r USING (item_id)), dm AS (SELECT p.item_id, p.part, p.truth, p.cell, unnest(p.vec)::DOUBLE AS x, unnest(range(0, 8)) AS pos FROM parts p), th AS (SELECT pos, avg(x) FILTER (truth) - avg(x) FILTER (NOT truth) AS t FROM dm WHERE part = 'train' GROUP BY pos),
sc AS (SELECT item_id, part, truth, cell, sum(x * t) AS score, part = 'held' AS diag FROM dm JOIN th USING (pos) WHERE part <> 'train' GROUP BY ALL), src AS (SELECT * FROM sc), {registry.DRAWN}, p AS (SELECT * FROM {_auc('sc', 'diag')}), v AS (SELECT * FROM {_auc('drawn', 'b, diag', w='w')}), {registry.GAP}
SELECT {s6('any_value(auroc_a)', 'headline')}, {s6('any_value(auroc_b)', 'controlled')}, {s6('any_value(auroc_a - auroc_b)', 'gap')}, {s6('quantile_cont(gap, 0.025)', 'gap_lo')}, {s6('quantile_cont(gap, 0.975)', 'gap_hi')}, (SELECT count(*) FROM parts WHERE part = 'train') AS n_train, (SELECT round(avg(score), 6) FROM sc WHERE cell = 'TA') AS mean_ta, (SELECT round(avg(score), 6) FROM sc WHERE cell = 'FT') AS mean_ft FROM g, point WHERE gap IS NOT NULL""")
def _(s, d):
    got = audit.adversarial(framed(s, d), _plain_mean)
    return got.select((F.round("headline_auroc", 6) + 0.0).alias("headline"), (F.round("controlled_auroc", 6) + 0.0).alias("controlled"), *r6("gap", "gap_lo", "gap_hi"), F.col("n_train").cast("long").alias("n_train"), F.round("mean_TA", 6).alias("mean_ta"), F.round("mean_FT", 6).alias("mean_ft"))


@query("probe_audit")
def _(s, d):
    return audit.audit(framed(s, d), assembled.probe_named("mass_mean"))


@query("crossing_report", f"WITH {ITEMS}, a AS (SELECT * FROM {_auc('celled', 'truth', 'logf', 'typical')}), m AS (SELECT truth, median(score) FILTER (typical) AS pt, median(score) FILTER (NOT typical) AS pa FROM celled GROUP BY truth) SELECT truth, n_pos AS n_typical, n_neg AS n_atypical, {s6('2 * auroc - 1', 'delta')}, {s6('pt', 'ppl_typical')}, {s6('pa', 'ppl_atypical')}, 2 * auroc - 1 >= 0.5 AS pass FROM a JOIN m USING (truth)")
def _(s, d):
    return gates.crossing_report(order_cells(s, d), ppl="score").select("truth", "n_typical", "n_atypical", *r6("delta", "ppl_typical", "ppl_atypical"), "pass")


@query("duplicate_report", "WITH p AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT sum(n)::BIGINT AS n, count(*) AS n_unique, (sum(n) - count(*))::BIGINT AS n_repeated, count(*) FILTER (n > 1) AS n_statements, (SELECT len(list(text)) FROM (SELECT text FROM p WHERE n > 1 LIMIT 3))::INT AS n_examples FROM p")
def _(s, d):
    got = gates.duplicate_report(table(s, d, "documents").select("text"))
    return got.select("n", "n_unique", "n_repeated", "n_statements", F.size("examples").alias("n_examples"))


@query("domain_top", "WITH n AS (SELECT lang AS domain, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1) SELECT domain, n, round(n::DOUBLE / sum(n) OVER (), 6) AS share, row_number() OVER (ORDER BY n DESC, domain DESC) = 1 AS top FROM n")
def _(s, d):
    got = gates.domain_report_top(table(s, d, "documents").where("lang is not null").select(F.col("lang").alias("domain")))
    return got.select("domain", "n", F.round("share", 6).alias("share"), "top")


@query("edit_report", f"WITH {ITEMS}, c AS (SELECT cell, avg(edited::INT) AS p FROM celled GROUP BY 1), t AS (SELECT truth, avg(edited::INT) AS p FROM celled GROUP BY 1) SELECT {s6('(SELECT max(p) - min(p) FROM c)', 'cell_spread')}, {s6('(SELECT max(p) - min(p) FROM t)', 'truth_gap')}")
def _(s, d):
    return gates.edit_report(order_cells(s, d)).select(*r6("cell_spread", "truth_gap"))


@query("count_gates", f"WITH {ITEMS} SELECT 'frequency_coverage' AS gate, count(*) FILTER (o_custkey IS NULL) <= 0.05 * count(*) AS pass, round(count(*) FILTER (o_custkey IS NULL)::DOUBLE / count(*), 6) AS metric FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON o_custkey = c_custkey UNION ALL SELECT 'minimum_rows', count(*) >= 80, count(*)::DOUBLE FROM items UNION ALL SELECT 'sign_off', true, NULL UNION ALL SELECT 'recheck', count(*) FILTER (o_custkey % 10 = 0) = 0, count(*) FILTER (o_custkey % 10 = 0) FROM (SELECT o_custkey, row_number() OVER (ORDER BY md5('0:' || o_custkey), o_custkey) AS r FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE r <= 25")
def _(s, d):
    freq = cells.entity_frequency(table(s, d, "orders"), "o_custkey")
    known = cells.with_frequency(table(s, d, "customer").select(F.col("c_custkey").alias("entity")), freq)
    stale = freq.withColumn("cnt", F.col("cnt") + (F.col("entity") % 10 == 0).cast("int"))  # a cache that was right once
    rows = [gates.frequency_coverage(known), gates.minimum_rows(order_items(s, d)), gates.sign_off(known, "owner"), gates.recheck(stale, freq, "entity", "cnt")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("gate", "pass", F.round("metric", 6).alias("metric"))


#: activations of which some layers are broken: a short vector in layer 2, a NaN in layer 3, one vector throughout layer 4
_BROKEN = "SELECT vec_id, layer, CASE WHEN layer = 2 AND vec_id % 50 = 0 THEN v[1:7] WHEN layer = 3 AND vec_id % 50 = 1 THEN list_prepend('NaN'::FLOAT, v[2:8]) WHEN layer = 4 THEN list_transform(v, lambda x: 1.0::FLOAT) ELSE v END AS v FROM (SELECT vec_id, layer, embedding[layer * 8 + 1:layer * 8 + 8] AS v FROM embeddings, (SELECT unnest(range(0, 8))::INT AS layer))"


@query("substrate_checks", f"SELECT 'vectors' AS model, layer, count(*) AS n, min(len(v)) = max(len(v)) AS one_width, bool_and(len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0) AS finite, count(DISTINCT v) > 1 AS varied FROM ({_BROKEN}) GROUP BY layer")
def _(s, d):
    at = lambda layer, k: (F.col("layer") == layer) & (F.col("item_id") % 50 == k)
    nan = F.lit("NaN").cast("float")
    vec = F.when(at(2, 0), F.slice("vec", 1, 7)).when(at(3, 1), F.concat(F.array(nan), F.slice("vec", 2, 7))).when(F.col("layer") == 4, F.transform("vec", lambda x: F.lit(1.0).cast("float"))).otherwise(F.col("vec"))
    return gates.substrate(vector_acts(s, d).withColumn("vec", vec).withColumn("model", F.lit("vectors")))


@query("stored_rows", "SELECT 'vectors' AS model, layer, count(*) AS n, count(*) = (SELECT count(*) FROM embeddings) AS fit FROM embeddings, (SELECT unnest(range(0, 8))::INT AS layer) WHERE layer <> 5 OR vec_id % 7 > 0 GROUP BY layer")
def _(s, d):
    """Layer 5 lacks rows."""
    return gates.tensor_rows(vector_acts(s, d).where("layer <> 5 or item_id % 7 > 0").withColumn("model", F.lit("vectors")), table(s, d, "embeddings").count())


@query("banned_words", r"SELECT p_partkey, regexp_extract(lower(p_name), '\b(hot|gizmo)\b', 1) AS banned FROM part WHERE regexp_matches(lower(p_name), '\b(hot|gizmo)\b')")
def _(s, d):
    return gates.banned_words(table(s, d, "part").select("p_partkey", "p_name"), "p_name", ("hot", "gizmo")).select("p_partkey", "banned")


@query("categorical_fields", "SELECT unnest(['event_type', 'even']) AS field")
def _(s, d):
    rows = table(s, d, "events").select("event_type", "props", "value", (F.col("event_id") % 2 == 0).alias("even"))
    return s.createDataFrame([(c,) for c in reports.categorical_fields(rows)], "field string")


@query("composition_report", f"""WITH {ITEMS}, r AS (SELECT domain, avg(truth::INT) AS p FROM celled WHERE cell IN ('TT', 'FA') GROUP BY 1), src AS (SELECT item_id, truth, round(coalesce(p, 0.5), 9) AS score FROM celled LEFT JOIN r USING (domain) WHERE cell IN ('TA', 'FT')), {registry.DRAWN}, p AS (SELECT * FROM {_auc('src', '')}), v AS (SELECT * FROM {_auc('drawn', 'b', w='w')}), i AS (SELECT quantile_cont(auroc, 0.025) AS lo, quantile_cont(auroc, 0.975) AS hi FROM v WHERE auroc IS NOT NULL)
SELECT 'domain' AS field, {s6('auroc', 'auroc')}, {s6('lo', 'lo')}, {s6('hi', 'hi')}, NOT (lo <= 0.5 AND hi >= 0.5) AS shortcut, NOT (NOT (lo <= 0.5 AND hi >= 0.5)) AS pass FROM p, i""")
def _(s, d):
    return gates.composition_canary(order_cells(s, d), {"domain": True}).select("field", *r6("auroc", "lo", "hi"), "shortcut", "pass")


@query("corpus_audit")
def _(s, d):
    return gates.corpus_audit(cells.balanced(statement_items(s, d)), {"domain": None, "edited": None})


@query("corpus_verdict")
def _(s, d):
    return gates.verdict_of(gates.corpus_audit(cells.balanced(statement_items(s, d)), {"domain": None}), with_canaries=False)


# ---- corpora


@query("swap_corpus")
def _(s, d):
    return corpora.swap_candidates(statements(s, d)).select("text", "truth", "edited", "entity", "domain", "strategy")


@query("crossed_corpus")
def _(s, d):
    """Parts by name and number: the few names alone leave, from some thousand parts on, no sentence that isn't true of one."""
    name = F.concat_ws(" ", "p_name", "p_partkey")
    rows = statements(s, d).withColumn("statement", F.coalesce(text.instantiate(F.col("topic"), name, F.col("p_type")), "statement"))
    words = table(s, d, "part").select(F.explode(F.array(name, "p_type")).alias("entity"))
    freq = cells.entity_frequency(words, "entity")
    return corpora.crossed_corpus(corpora.swap_candidates(rows), freq, least=2).select("text", "truth", "edited", "cell", "domain")


@query("harvested_corpus")
def _(s, d):
    nation = table(s, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("Nation "), F.chr(F.lit(65) + F.col("n_nationkey"))).alias("object"))
    truths = table(s, d, "customer").join(nation, "c_nationkey").select(F.col("c_name").alias("subject"), "object")
    errors = table(s, d, "customer").where("c_mktsegment not in ('BUILDING', 'MACHINERY')").select(F.col("c_name").alias("subject"), ((F.col("c_nationkey") + F.col("c_custkey") % 24 + 1) % 25).alias("c_nationkey")).join(nation, "c_nationkey").select("subject", "object")
    known = truths.groupBy("subject").agg(F.collect_set("object").alias("objects"))  # of one subject
    canon = joins.canonical_map(s, nation.select(F.col("object").alias("name"), F.col("c_nationkey").alias("seq")))
    said = truths.select(F.explode(F.array("subject", "object")).alias("entity")).unionByName(truths.select(F.explode(F.array("object")).alias("entity")))
    freq = cells.entity_frequency(joins.canonicalised(said, "entity", canon).select(F.col("canon").alias("entity")).unionByName(truths.select(F.col("subject").alias("entity"))), "entity")
    return corpora.harvested_corpus(truths, errors, known, canon, freq, least=5).select("text", "truth", "cell")


# ---- probes that are fitted


def _paired(s, d, name: str) -> DataFrame:
    """Statements about parts beside their negations by template, as the probe wants them."""
    items = statement_items(s, d)
    acts = layouts.text_vectors(items.select("item_id", "truth", "cell", "topic", "text"))
    negated = layouts.text_vectors(items.select("item_id", "negated"), "negated")
    return layouts.prepared(layouts.loaded(name), acts, 0, negated)


def _probe_query(name: str, rows):
    @query(f"{name}_probe")
    def _(s, d):
        acts = rows(s, d)
        return assembled.probe_named(name)(acts.where(scalars.diagonal(F.col("cell"))), acts).select("item_id", "cell", "truth", "score")


_probe_query("logistic", framed)
_probe_query("mlp", framed)
_probe_query("ccs", lambda s, d: _paired(s, d, "ccs"))
_probe_query("ttpd", lambda s, d: _paired(s, d, "ttpd"))
_probe_query("drift", lambda s, d: joins.stacked_taps(vector_acts(s, d), assembled.taps(8)).join(framed(s, d).drop("vec"), "item_id"))


@query("layer_sweep")
def _(s, d):
    return assembled.layer_sweep(vector_acts(s, d).where("layer < 2"), ("mass_mean", "logistic"))


@query("leave_one_topic_out")
def _(s, d):
    return audit.leave_one_out(framed(s, d).withColumn("topic", F.col("item_id") % 3), assembled.mass_mean)


@query("transfer")
def _(s, d):
    rows = framed(s, d).withColumn("entity", F.col("item_id").cast("string")).withColumn("topic", F.col("item_id") % 4)
    return audit.transfer(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1 or item_id % 10 = 0"), assembled.mass_mean)


@query("frequency_detector", f"WITH {ITEMS} SELECT {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('celled', '', 'logf')}")
def _(s, d):
    rows = order_cells(s, d)
    return ranks.auroc(assembled.frequency_only(rows, rows)).select(*r6("auroc"), "n_pos", "n_neg")


@query("perplexity_detector", f"WITH {ITEMS} SELECT {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('celled', '', '-exp(score / 100000.0::DOUBLE)')}")
def _(s, d):
    rows = order_cells(s, d).withColumn("nll", F.col("score") / 100000.0)
    return ranks.auroc(assembled.perplexity_only(rows, rows)).select(*r6("auroc"), "n_pos", "n_neg")
