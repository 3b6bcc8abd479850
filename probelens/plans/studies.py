"""Registered studies of several steps: causal mediation by subspaces, audits of all layers, ladders, clusters, frames."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions.stage import shared_folder, staged
from probelens.operators import canaries, cells, causal, clusters, fitted, frames, gates, ladder, layers, layouts, probes, ranks, reports
from probelens.plans import registry
from probelens.plans.registry import ACTS, ITEMS, r6, s6
from probelens.plans.worlds import order_cells, order_items, statement_items, table, vector_acts
from probelens.sources import tensors

QUERIES: dict = {}
SQL: dict = {}
query = registry.keeper(QUERIES, SQL)


def framed(s, d) -> DataFrame:
    """All layers, with the first component of the vector as the frequency axis."""
    return vector_acts(s, d).withColumn("logf", F.element_at("vec", 1).cast("double"))


#: standardised components, and the mass-mean direction of the diagonal in them
Z = f"""{ACTS.split('theta AS')[0].rstrip().rstrip(',')}, mo AS (SELECT layer, pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop(x) END AS s FROM dims GROUP BY ALL),
z AS (SELECT item_id, layer, truth, cell, pos, (x - m) / s AS x FROM dims JOIN mo USING (layer, pos)), th AS (SELECT layer, pos, avg(x) FILTER (truth) - avg(x) FILTER (NOT truth) AS d FROM z WHERE cell IN ('TT', 'FA') GROUP BY ALL)"""


@query("subspace_mediation", f"""WITH {Z}, f AS (SELECT item_id, layer, cell, sum(x * d) AS f FROM z JOIN th USING (layer, pos) GROUP BY ALL), c AS (SELECT layer, cell, pos, avg(x) AS m FROM z GROUP BY ALL),
k AS (SELECT unnest([1, 2, 4, 8])::INT AS k), p(fooled, ref) AS (VALUES ('FT', 'FA'), ('TT', 'TA')),
v AS (SELECT z.item_id, z.layer, p.fooled, p.ref, k.k, sum(CASE WHEN z.pos < k.k THEN (x - m) * d ELSE 0 END) AS moved FROM z JOIN p ON z.cell = p.fooled JOIN c ON c.layer = z.layer AND c.cell = p.ref AND c.pos = z.pos JOIN th ON th.layer = z.layer AND th.pos = z.pos, k GROUP BY ALL),
a AS (SELECT v.layer, fooled, ref, k, median(f - moved) AS cf FROM v JOIN f USING (item_id, layer) GROUP BY ALL), b AS (SELECT layer, cell, median(f) AS f FROM f GROUP BY ALL)
SELECT a.layer, a.fooled, a.k, {s6('x.f - y.f', 'total_effect')}, {s6('x.f - a.cf', 'indirect_effect')}, {s6('CASE WHEN abs(x.f - y.f) > 1e-6 THEN (x.f - a.cf) / (x.f - y.f) END', 'fraction')}
FROM a JOIN b x ON x.layer = a.layer AND x.cell = a.fooled JOIN b y ON y.layer = a.layer AND y.cell = a.ref""")
def _(s, d):
    """The mass-mean probe across nested coordinate subspaces."""
    z = causal.standard(vector_acts(s, d))
    models = probes.mass_mean(z.where(F.col("cell").isin("TT", "FA"))).select("layer", F.concat("theta", F.array(F.lit(0.0))).alias("weights"))
    bases = causal.axes(z, 8).withColumn("name", F.lit("axes"))
    got = causal.nested_effects(z, models, bases, (1, 2, 4, 8))
    return got.select("layer", "fooled", "k", *r6("total_effect", "indirect_effect", "fraction"))


@query("subspace_run")
def _(s, d):
    """The fielded logistic probe across the frequency manifold, against random subspaces."""
    return causal.subspace_run(framed(s, d), ks=(1, 2, 4, 8))


@query("layer_audit")
def _(s, d):
    """All eight layers under both probes, at the default 1,000 replicates."""
    return layers.layer_audit(framed(s, d)).select("probe", "layer", "design", "measure", *r6("value", "lo", "hi"), "n")


#: the split of items, and scores by the mass-mean direction of its training part
SPLIT = f"""{ACTS.split('theta AS')[0].rstrip().rstrip(',')}, it AS (SELECT DISTINCT item_id, cell FROM acts), rk AS (SELECT item_id, row_number() OVER (ORDER BY md5('0:' || item_id), item_id) AS r, count(*) OVER () AS n FROM it WHERE cell IN ('TT', 'FA')),
pt AS (SELECT dims.*, CASE WHEN r IS NULL THEN 'off' WHEN r <= floor(0.8::DOUBLE * n) THEN 'train' ELSE 'held' END AS part FROM dims LEFT JOIN rk USING (item_id)),
mo AS (SELECT layer, pos, avg(x) AS m, CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop(x) END AS s, (avg(x) FILTER (truth) - avg(x) FILTER (NOT truth)) / (CASE WHEN stddev_pop(x) < 1e-8 THEN 1.0::DOUBLE ELSE stddev_pop(x) END) AS t FROM pt WHERE part = 'train' GROUP BY ALL),
sc AS (SELECT item_id, layer, truth, part, 1 / (1 + exp(-sum((x - m) / s * t))) AS score FROM pt JOIN mo USING (layer, pos) WHERE part <> 'train' GROUP BY ALL)"""


@query("layer_points", f"WITH {SPLIT} SELECT layer, part AS side, {s6('auroc', 'auroc')}, n_pos, n_neg FROM {registry._auc('sc', 'layer, part')}")
def _(s, d):
    """Headline and controlled AUROC of every layer, from one grouped fit."""
    rows = layers.designed(framed(s, d))
    scored = layers.design_scores(rows, layers.FITS["mass_mean"]).where(F.col("design") == layers.SPLIT)
    return ranks.auroc(scored.withColumnRenamed("part", "side"), ("layer", "side")).select("layer", "side", *r6("auroc"), "n_pos", "n_neg")


_PLAIN = "trim(regexp_replace(lower({}), '[^a-z0-9 ]', '', 'g'))"
_BAG = "list_sort(list_distinct(list_filter(string_split(" + _PLAIN + ", ' '), lambda w: w <> '')))"
#: either has half of the other's words
_ALIKE = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN len({a}) = len({b}) ELSE 2 * len(list_intersect({a}, {b})) >= len({b}) AND 2 * len(list_intersect({a}, {b})) >= len({a}) END"


@query("first_match_entropy", f"""WITH RECURSIVE u AS (SELECT conv_id, text, min(turn) AS pos, count(*) AS times, {_BAG.format('text')} AS bag FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, text),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY pos, text) AS i FROM u),
f AS (SELECT conv_id, 1::BIGINT AS i, [bag] AS reps, 0::BIGINT AS label, times FROM o WHERE i = 1 UNION ALL
      SELECT conv_id, i, CASE WHEN hit IS NULL THEN list_append(reps, bag) ELSE reps END, coalesce(hit - 1, len(reps)), times FROM (
          SELECT o.conv_id, o.i, f.reps, o.bag, o.times, list_position(list_transform(f.reps, lambda r: {_ALIKE.format(a='o.bag', b='r')}), true) AS hit FROM f JOIN o ON o.conv_id = f.conv_id AND o.i = f.i + 1)),
k AS (SELECT conv_id, label, sum(times) AS k FROM f GROUP BY ALL)
SELECT conv_id, sum(k)::BIGINT AS n, count(*) AS n_clusters, {s6('ln(sum(k)) - sum(k * ln(k)) / sum(k)', 'entropy')} FROM k GROUP BY conv_id""")
def _(s, d):
    """Answers of a conversation, clustered by the first representative that shares half of either's words."""
    got = clusters.cluster_entropy(table(s, d, "conversations"), clusters.covers(0.5))
    return got.select("conv_id", "n", "n_clusters", *r6("entropy"))


def _ladder_sql(half: str) -> str:
    """The mass-mean ladder over rungs of 100, 200 and 300 items and two replicates; half: of an item at place r."""
    sums = ", ".join(f"coalesce(sum(x) FILTER ({c}), 0) AS {n}s, count(*) FILTER ({c}) AS {n}n" for n, c in (("p", "truth"), ("b", "NOT truth"), ("c", "truth AND diag"), ("e", "NOT truth AND diag")))
    keys = "layer, rep, idx, half"
    return f"""WITH {ACTS.split('theta AS')[0].rstrip().rstrip(',')}, it AS (SELECT DISTINCT item_id, cell FROM acts),
sp AS (SELECT it.*, rep::INT AS rep, row_number() OVER (PARTITION BY rep, cell ORDER BY md5('0:' || rep || ':' || item_id), rep || ':' || item_id) AS r FROM it, range(0, 2) t(rep)),
rk AS (SELECT item_id, rep, {half} AS half, (r > 25)::INT + (r > 50)::INT AS band, {registry.H.format("'0:' || item_id")} % 5 AS fold FROM sp WHERE r <= 75),
li AS (SELECT a.*, cell IN ('TT', 'FA') AS diag, rep, half, fold, idx FROM acts a JOIN rk USING (item_id), range(0, 3) u(idx) WHERE idx >= band),
dd AS (SELECT * EXCLUDE (vec), vec[1]::DOUBLE AS logf, unnest(vec)::DOUBLE AS x, unnest(range(0, 8)) AS pos FROM li),
fo AS (SELECT {keys}, fold, pos, {sums} FROM dd GROUP BY ALL), wh AS (SELECT {keys}, pos, {sums} FROM dd GROUP BY ALL),
fi AS (SELECT {keys}, pos, cs / nullif(cn, 0) - es / nullif(en, 0) AS v FROM wh),
fa AS (SELECT wh.layer, wh.rep, wh.idx, wh.half, fold, pos, (wh.ps - coalesce(fo.ps, 0)) / nullif(wh.pn - coalesce(fo.pn, 0), 0) - (wh.bs - coalesce(fo.bs, 0)) / nullif(wh.bn - coalesce(fo.bn, 0), 0) AS v FROM wh CROSS JOIN range(0, 5) t(fold) LEFT JOIN fo USING ({keys}, fold, pos)),
so AS (SELECT {keys}, item_id, truth, any_value(logf) AS logf, sum(x * v) AS score FROM dd JOIN fa USING ({keys}, fold, pos) GROUP BY ALL),
sf AS (SELECT {keys}, item_id, truth, sum(x * v) AS score FROM dd JOIN fi USING ({keys}, pos) WHERE NOT diag GROUP BY ALL),
co AS (SELECT {keys}, count(*) AS n, corr(score, truth::INT::DOUBLE) AS a, corr(score, logf) AS b, corr(truth::INT::DOUBLE, logf) AS c FROM so GROUP BY ALL)
SELECT layer, list_extract([100, 200, 300], (idx + 1)::INT) AS rung, rep, sum(n)::BIGINT AS n, {s6('avg((a - b * c) / (1 - c * c))', 'recoverability')}, {s6('avg(auroc)', 'off_diagonal')} FROM co LEFT JOIN {registry._auc('sf', keys)} USING ({keys}) GROUP BY layer, rep, idx"""


@query("ladder_same", _ladder_sql("0"))
def _(s, d):
    got = ladder.mass_mean_ladder(framed(s, d), (100, 200, 300), 2, "same")
    return got.select("layer", "rung", "rep", "n", *r6("recoverability", "off_diagonal"))


@query("ladder_crossfit", _ladder_sql("(r % 2)::INT"))
def _(s, d):
    got = ladder.mass_mean_ladder(framed(s, d), (100, 200, 300), 2, "crossfit")
    return got.select("layer", "rung", "rep", "n", *r6("recoverability", "off_diagonal"))


@query("ladder_rungs", f"WITH {ACTS}, it AS (SELECT DISTINCT item_id, cell FROM acts), sp AS (SELECT cell, rep::INT AS rep, row_number() OVER (PARTITION BY rep, cell ORDER BY md5('0:' || rep || ':' || item_id), rep || ':' || item_id) AS r, item_id FROM it, range(0, 5) t(rep)) SELECT rung, rep, cell, count(*) AS n, sum(item_id)::BIGINT AS checksum FROM sp, (SELECT unnest([100, 200, 300, 450, 608]) AS rung) WHERE r <= rung // 4 GROUP BY ALL")
def _(s, d):
    """How many items of each cell a rung holds: a fourth of it, or all there are."""
    items = vector_acts(s, d).where("layer = 0").select("item_id", "cell")
    return ladder.listed_rungs(items, (100, 200, 300, 450, 608)).groupBy("rung", "rep", "cell").agg(F.count("*").alias("n"), F.sum("item_id").alias("checksum"))


@query("tensor_scan", f"WITH {ACTS.split('dims AS')[0].rstrip().rstrip(',')} SELECT layer, count(*) AS n, {s6('sum(list_sum(vec::DOUBLE[]))', 'total')} FROM acts WHERE layer IN (1, 6) GROUP BY layer")
def _(s, d):
    """Activations stored as blocks of floats and read back, two layers only."""
    acts = vector_acts(s, d).select(F.col("item_id").alias("row"), "layer", "vec")
    path = f"{shared_folder(s)}/tensors-{uuid.uuid4().hex}"
    n = tensors.store(acts, path, "<f4", 128)
    got = tensors.read(s, path, n).where(F.col("layer").isin(1, 6))
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return got.withColumn("t", total).groupBy("layer").agg(F.count("*").alias("n"), F.sum("t").alias("total")).select("layer", "n", *r6("total"))


@query("eigen_audit")
def _(s, d):
    """Four layers of four sampled vectors of four components, audited by minus their eigenvalue score."""
    items = vector_acts(s, d).where("layer = 0").select("item_id", "truth", "cell", F.element_at("vec", 1).cast("double").alias("logf"))
    v = table(s, d, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    blocks = probes.layers(v, "embedding", 16).withColumnRenamed("vec", "wide")
    samples = probes.layers(blocks.withColumnRenamed("layer", "at"), "wide", 4).select("item_id", F.col("at").alias("layer"), "vec")
    return layers.eigen_audit(samples, items).select("layer", "measure", *r6("value", "lo", "hi"), "n")


# ---- what probes are fed


def said(s, d) -> tuple[DataFrame, DataFrame]:
    """Vectors of statements, with their items' columns, and of their negations."""
    items = statement_items(s, d)
    rest = ("item_id", "truth", "cell", "topic", "logf")
    return layouts.text_vectors(items.select(*rest, "text")), layouts.text_vectors(items.select("item_id", "negated"), "negated")


_HASHED = registry.H.format("'vec:' || g")


@query("text_vectors", rf"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, layer::INT AS layer, ws FROM w, range(0, 2) t(layer) WHERE len(ws) > 0),
g AS (SELECT doc_id, layer, unnest(list_transform(range(1, greatest(1, len(ws) - layer) + 1), lambda i: array_to_string(ws[i:i + layer], ' '))) AS g FROM l),
h AS (SELECT doc_id, layer, {_HASHED} AS h FROM g), n AS (SELECT doc_id, layer, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT doc_id, layer, h % 16 AS j, sum(1.0::DOUBLE - 2 * ((h // 65536) % 2)) AS c FROM h GROUP BY ALL)
SELECT doc_id, layer, {s6('sum(c / sqrt(n) * (j + 1))', 'x')}, {s6('sum(c * c / n)', 'length') } FROM c JOIN n USING (doc_id, layer) GROUP BY ALL""")
def _(s, d):
    rows = table(s, d, "documents").select("doc_id", "text").where(F.lower("text").rlike("[a-z0-9]"))
    got = layouts.text_vectors(rows, layers=2)
    x = F.aggregate(F.transform("vec", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return got.select("doc_id", "layer", x.alias("x"), F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v).alias("length")).select("doc_id", "layer", *r6("x", "length"))


@query("pair_probes")
def _(s, d):
    """Contrast and truth-direction probes on statements beside their negations by template."""
    acts, negated = said(s, d)
    got = layouts.swept(("ccs", "ttpd"), acts, negated, (0,)).withColumn("side", F.when(F.col("cell").isin("TT", "FA"), "diagonal").otherwise("off"))
    return ranks.auroc(got, ("probe", "side")).select("probe", "side", *r6("auroc"), "n_pos", "n_neg")


@query("layer_probes")
def _(s, d):
    """Probes of one layer, and probes that read four depths, on statements."""
    got = layouts.swept(("mass_mean", "logistic", "drift", "drift_concat"), said(s, d)[0], None, (1,)).withColumn("side", F.when(F.col("cell").isin("TT", "FA"), "diagonal").otherwise("off"))
    return ranks.auroc(got, ("probe", "side")).select("probe", "side", *r6("auroc"), "n_pos", "n_neg")


# ---- whole checks of a corpus


def _checked(s, d) -> DataFrame:
    """All gates over statements: six of the corpus, and canaries on their vectors and on how they fall into pieces."""
    items = staged(cells.balanced(statement_items(s, d)), "items")  # every gate reads them
    acts = layouts.text_vectors(items.select("item_id", "edited", "text")).where("layer = 1").drop("layer")
    more = [canaries.edit_canary(acts), canaries.fragmentation_canary(items.select("item_id", "truth", "text", F.col("subject").alias("entity")))]
    return gates.corpus_audit(items, {"domain": canaries.text_visible(items, "domain")["visible"], "edited": canaries.text_visible(items, "edited")["visible"]}, more=more)


@query("corpus_check")
def _(s, d):
    return _checked(s, d).select("gate", "pass", *r6("metric"))


@query("corpus_check_verdict")
def _(s, d):
    return gates.verdict_of(_checked(s, d), with_canaries=True)


# ---- erasure, and reports over layers


@query("erasure_study")
def _(s, d):
    """Two layers of 32 dimensions, up to the twelve rounds of the protocol, against random and diagonal-only directions."""
    v = vector_acts(s, d).groupBy("item_id", "truth", "typical", "cell", F.floor(F.col("layer") / 4).cast("int").alias("wide")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("layer", "vec"))), lambda b: b["vec"])).alias("vec"))  # four blocks
    return fitted.erasure_study(v.withColumnRenamed("wide", "layer"), (4, 8, 12)).select("layer", "design", "k", *r6("on", "off", "read"))


def layer_curves(s, d) -> DataFrame:
    """Domains as models, price and date as probes, the month modulo 6 as layer."""
    month = table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.month("o_orderdate") % 6).alias("layer"), F.unix_date(F.col("o_orderdate").cast("date")).cast("double").alias("day"))
    rows = order_cells(s, d).join(month, "item_id").withColumn("diag", F.col("cell").isin("TT", "FA"))
    both = F.explode(F.array(F.struct(F.lit("price").alias("probe"), F.col("score").cast("double").alias("v")), F.struct(F.lit("date").alias("probe"), F.col("day").alias("v"))))
    long = rows.select("domain", "layer", "diag", "truth", both.alias("_p")).select("domain", "layer", "diag", "truth", "_p.probe", F.col("_p.v").alias("score"))
    side = lambda on: F.max(F.when(F.col("diag") == on, F.col("auroc")))
    return ranks.auroc(long, ("domain", "probe", "layer", "diag")).groupBy(F.col("domain").alias("model"), "probe", "layer").agg(side(True).alias("in_dist"), side(False).alias("off"))


def _report(s, d) -> DataFrame:
    curves = layer_curves(s, d)
    return reports.layer_report(curves, curves.select("model").distinct().withColumn("headline_layer", F.lit(3)), 0.5)


_REPORT = f"""WITH {ITEMS}, long AS (SELECT domain, month(o_orderdate) % 6 AS layer, cell IN ('TT', 'FA') AS diag, truth, unnest(['price', 'date']) AS probe, unnest([score::DOUBLE, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE]) AS score FROM celled JOIN orders ON o_orderkey = item_id),
cv AS (SELECT domain AS model, probe, layer::INT AS layer, max(auroc) FILTER (diag) AS in_dist, max(auroc) FILTER (NOT diag) AS off FROM {registry._auc('long', 'domain, probe, layer, diag')} GROUP BY ALL HAVING in_dist IS NOT NULL AND off IS NOT NULL),
td AS (SELECT * FROM (SELECT *, max(in_dist) OVER (PARTITION BY model, probe) AS best FROM cv) WHERE in_dist >= best - 0.02 - 1e-12), md AS (SELECT model, probe, median(off) AS selected_off, count(*) AS n_tied FROM td GROUP BY ALL),
sl AS (SELECT model, probe, selected_off, n_tied, arg_min(layer, (round(abs(off - selected_off), 12), layer)) AS selected_layer FROM td JOIN md USING (model, probe) GROUP BY ALL),
rp AS (SELECT model, probe, layer AS headline_layer, in_dist AS headline_in, off AS headline_off, selected_layer, selected_off, n_tied, selected_off - off AS moved, coalesce(in_dist >= 0.5, false) AS powered FROM sl LEFT JOIN (SELECT * FROM cv WHERE layer = 3) USING (model, probe))"""


@query("layer_report", f"{_REPORT} SELECT model, probe, headline_layer, {s6('headline_in', 'headline_in')}, {s6('headline_off', 'headline_off')}, selected_layer, {s6('selected_off', 'selected_off')}, n_tied, {s6('moved', 'moved')}, powered FROM rp")
def _(s, d):
    return _report(s, d).select("model", "probe", "headline_layer", *r6("headline_in", "headline_off"), "selected_layer", *r6("selected_off"), "n_tied", *r6("moved"), "powered")


@query("mechanism_by_probe", f"""{_REPORT}, rc AS (SELECT domain AS model, auroc AS rec FROM {registry._auc('(SELECT * FROM celled WHERE truth)', 'domain', 'score', 'typical')}),
lg AS (SELECT model, probe, powered, rec, unnest(['headline', 'selected']) AS rule, unnest([headline_off, selected_off]) AS off FROM rp JOIN rc USING (model)), ex AS (SELECT model, probe, rec, rule, off, unnest(CASE WHEN powered THEN ['all', 'powered'] ELSE ['all'] END) AS subset FROM lg WHERE off IS NOT NULL AND rec IS NOT NULL),
pt AS (SELECT probe, rule, subset, count(*) AS n, corr(rec, off) AS r FROM ex GROUP BY ALL HAVING count(*) >= 3),
bt AS (SELECT probe, rule, subset, b, corr(rec, off) AS r FROM (SELECT ex.*, b, unnest(range({registry._poisson("'0:' || b || ':' || model")})) AS k FROM ex, range(1, 1001) t(b)) GROUP BY ALL HAVING count(DISTINCT model) >= 3),
ci AS (SELECT probe, rule, subset, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi, count(*) AS n_boot FROM bt WHERE r IS NOT NULL AND NOT isnan(r) GROUP BY ALL)
SELECT probe, rule, subset, n, {s6('r', 'r')}, {s6('lo', 'lo')}, {s6('hi', 'hi')}, n_boot FROM pt LEFT JOIN ci USING (probe, rule, subset)""")
def _(s, d):
    """Whether the frequency read of true items orders the domains' AUROC off the diagonal, by both layer rules."""
    rec = ranks.auroc(order_cells(s, d).where("truth"), ("domain",), "score", "typical").select(F.concat(F.lit("Org/"), F.upper("domain")).alias("name"), F.col("auroc").alias("rec"))
    return reports.mechanism_by_probe(_report(s, d), rec).select("probe", "rule", "subset", "n", *r6("r", "lo", "hi"), "n_boot")


# ---- frames


@query("cell_violins", f"""WITH {ITEMS}, k AS (SELECT cell, score AS v FROM celled), m AS (SELECT min(v) AS lo, max(v) AS hi, (max(v) - min(v)) / 40 AS w FROM k), b AS (SELECT cell, v, least(floor((v - lo) / w), 39)::INT AS bin FROM k, m), c AS (SELECT cell, bin, count(*) AS n FROM b GROUP BY ALL),
g AS (SELECT cell, count(*) AS n, stddev_samp(v) * pow(count(*), -0.2) AS h FROM k GROUP BY cell), x AS (SELECT cell, n, h, lo, w, unnest(range(0, 40))::INT AS bin FROM g, m),
d AS (SELECT x.cell, x.bin, sum(c.n * exp(-0.5 * pow((x.bin - c.bin) * w / h, 2))) / any_value(x.n * h * sqrt(2 * pi())) AS density, coalesce(sum(c.n) FILTER (c.bin = x.bin), 0)::BIGINT AS n, any_value(lo + (x.bin + 0.5) * w) AS x FROM x JOIN c ON c.cell = x.cell GROUP BY ALL)
SELECT cell, bin, {s6('x', 'x')}, n, round(density * 1e6, 6) AS density FROM d""")
def _(s, d):
    return frames.violins(order_cells(s, d), "score").select("cell", "bin", *r6("x"), "n", F.round(F.col("density") * 1e6, 6).alias("density"))


_READ = "WITH r AS (SELECT p_brand AS model, list_extract(['TT', 'TA', 'FT', 'FA'], (p_partkey % 4 + 1)::INT) AS cell, (p_size - 1) / 49.0::DOUBLE AS probe, (p_retailprice % 100) / 100.0::DOUBLE AS behaviour FROM part)"


@query("dissociation_frame", _READ + f", a AS (SELECT model FROM r WHERE cell = 'FA' GROUP BY model HAVING min(behaviour) < 0.01) SELECT model, cell, {s6('avg(probe)', 'probe')}, {s6('avg(behaviour)', 'behaviour')}, {s6('avg(probe) - avg(behaviour)', 'apart')} FROM r JOIN a USING (model) GROUP BY ALL")
def _(s, d):
    cell = F.get(F.array(*[F.lit(c) for c in ("TT", "TA", "FT", "FA")]), (F.col("p_partkey") % 4).cast("int"))
    rows = table(s, d, "part").select(F.col("p_brand").alias("model"), cell.alias("cell"), ((F.col("p_size") - 1) / 49.0).alias("probe"), ((F.col("p_retailprice") % 100) / 100.0).alias("behaviour"))
    return frames.dissociations(rows, 0.01).select("model", "cell", *r6("probe", "behaviour", "apart"))


@query("spectrum_frame", f"WITH {ITEMS}, f AS (SELECT * FROM {registry._auc('(SELECT * FROM celled WHERE truth)', 'domain', 'score', 'typical')}), a AS (SELECT * FROM {registry._auc('(SELECT *, month(o_orderdate) % 3 AS layer FROM celled JOIN orders ON o_orderkey = item_id)', 'domain, layer')}) SELECT lower(f.domain) AS model, {s6('f.auroc', 'frequency_read')}, {s6('a.auroc', 'headline')} FROM f JOIN a ON a.domain = f.domain AND a.layer = 1")
def _(s, d):
    """Each domain as a model: its frequency read among true items, and its AUROC in the middle of three layers."""
    rows = order_cells(s, d)
    reads = ranks.auroc(rows.where("truth"), ("domain",), "score", "typical").select(F.concat(F.lit("org/"), "domain").alias("model"), F.col("auroc").alias("frequency_read"))
    month = table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), (F.month("o_orderdate") % 3).alias("layer"))
    audits = ranks.auroc(rows.join(month, "item_id"), ("domain", "layer")).select(F.col("domain").alias("model"), "layer", F.lit(1).alias("headline_layer"), F.col("auroc").alias("headline"))
    return frames.spectrum(reads, audits).select("model", *r6("frequency_read", "headline"))


@query("cache_summary", "WITH f AS (SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN NULL ELSE coalesce(n, 0) END AS cnt FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey) SELECT count(*) AS n, count(*) FILTER (cnt IS NULL) AS unresolved, count(*) FILTER (cnt = 0) AS zero, count(*) FILTER (cnt > 0) AS nonzero, round(median(cnt) FILTER (cnt > 0), 6) AS median_nonzero FROM f")
def _(s, d):
    n = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    freq = table(s, d, "customer").join(n, "c_custkey", "left").select(F.when(F.col("c_nationkey") != 0, F.coalesce("k", F.lit(0))).alias("cnt"))
    return frames.cache_summary(freq).select("n", "unresolved", "zero", "nonzero", F.round("median_nonzero", 6).alias("median_nonzero"))


@query("axis_agreement", f"WITH {ITEMS}, p AS (SELECT logf AS x, CASE WHEN item_id % 5 > 0 THEN score END AS y FROM items), q AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL), k AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS b FROM q) SELECT {s6('corr(a, b)', 'rho')}, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM p), 6) AS coverage FROM k")
def _(s, d):
    rows = order_items(s, d).withColumn("other", F.when(F.col("item_id") % 5 > 0, F.col("score")))
    return ranks.axis_agreement(rows, "logf", "other").select(*r6("rho", "coverage"), "n")
