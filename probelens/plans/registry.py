"""The registered queries over the driver's tables, and the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probelens.functions import draws, intervals, scalars, text
from probelens.operators import boot, cells, fitted, gates, joins, linear, probes, ranks, reports
from probelens.plans.worlds import order_cells, order_items, table, vector_acts
from probelens.sources import readers, sinks
from probelens.streaming import gates as gates_stream

QUERIES: dict = {}
SQL: dict = {}
BOOT = 1000

ITEMS = """freq AS (SELECT o_custkey AS entity, count(*) AS cnt, log10(1.0::DOUBLE + count(*)) AS logf FROM orders GROUP BY 1),
items AS (SELECT o_orderkey AS item_id, o_orderstatus = 'F' AS truth, o_custkey AS entity, o_orderpriority AS domain, month(o_orderdate) % 2 = 1 AS edited, o_totalprice AS score, cnt, logf
          FROM orders JOIN freq ON o_custkey = entity WHERE o_orderstatus IN ('F', 'O')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY logf, item_id) AS r, count(*) OVER (PARTITION BY domain) AS n FROM items),
celled AS (SELECT * EXCLUDE (r, n), r > n // 3 AS typical, (CASE WHEN truth THEN 'T' ELSE 'F' END) || (CASE WHEN r > n // 3 THEN 'T' ELSE 'A' END) AS cell FROM ranked WHERE r <= n // 3 OR r > n - n // 3)"""
_AUC = "CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN sum(p * (bef + q / 2.0::DOUBLE)) / (sum(p)::DOUBLE * sum(q)) END"
H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
U = "((" + H + " + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


def _auc(src: str, by: str, score: str = "score", label: str = "truth", w: str = "1") -> str:
    """SQL for the tie-averaged AUROC of src by columns."""
    part = f"PARTITION BY {by} " if by else ""
    keys = f"{by}, " if by else ""
    return f"""(SELECT {keys}{_AUC} AS auroc, sum(p)::BIGINT AS n_pos, sum(q)::BIGINT AS n_neg FROM (
        SELECT *, coalesce(sum(q) OVER ({part}ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef FROM (
            SELECT {keys}{score}::DOUBLE AS v, sum(CASE WHEN {label} THEN {w} ELSE 0 END) AS p, sum(CASE WHEN {label} THEN 0 ELSE {w} END) AS q FROM {src} WHERE {score} IS NOT NULL AND {label} IS NOT NULL GROUP BY ALL)) {'GROUP BY ' + by if by else ''})"""


def _poisson(key: str) -> str:
    u = U.format(key)
    return "(" + " + ".join(f"(CASE WHEN {u} >= {p}::DOUBLE THEN 1 ELSE 0 END)" for p in draws.POISSON) + ")"


ACTS = """blocks AS (SELECT vec_id AS item_id, label % 2 = 1 AS truth, label < 5 AS typical, label::VARCHAR AS topic,
    (CASE WHEN label % 2 = 1 THEN 'T' ELSE 'F' END) || (CASE WHEN label < 5 THEN 'T' ELSE 'A' END) AS cell, unnest(range(0, 8))::INT AS layer, embedding FROM embeddings),
acts AS (SELECT * EXCLUDE (embedding), embedding[layer * 8 + 1:layer * 8 + 8] AS vec FROM blocks),
dims AS (SELECT *, unnest(vec)::DOUBLE AS x, unnest(range(0, 8)) AS pos FROM acts),
theta AS (SELECT layer, pos, avg(x) FILTER (truth) - avg(x) FILTER (NOT truth) AS d FROM dims WHERE cell IN ('TT', 'FA') GROUP BY ALL),
scored AS (SELECT item_id, layer, truth, cell, cell IN ('TT', 'FA') AS diag, sum(x * d) AS score FROM dims JOIN theta USING (layer, pos) GROUP BY ALL)"""
CURVES = ACTS + """, au AS (SELECT * FROM """ + _auc("scored", "layer, diag") + """), curves AS (SELECT 'vectors' AS model, 'massmean' AS probe, layer, max(auroc) FILTER (diag) AS in_dist, max(auroc) FILTER (NOT diag) AS off FROM au GROUP BY layer)"""
POINTS = "points AS (SELECT p_brand AS g, ((p_size - 1) / 49.0::DOUBLE) AS x, p_retailprice / 1000.0::DOUBLE AS y FROM part)"


def statements(s, d) -> DataFrame:
    """A statement for each part in one of the six topics, with and without a full stop, and every seventh in none."""
    k = F.col("p_partkey") % 7
    topic = F.get(F.array(*[F.lit(t) for t in text.TEMPLATES]), k.cast("int"))
    said = text.instantiate(topic, F.col("p_name"), F.col("p_type"))
    bare = F.when(F.col("p_partkey") % 2 == 0, said).otherwise(F.regexp_replace(said, r"\.$", ""))
    return table(s, d, "part").select("p_partkey", topic.alias("topic"), F.when(k == 6, "The sky is blue").otherwise(bare).alias("statement"), (F.col("p_partkey") % 3 > 0).cast("int").alias("label"), "p_name", "p_type")


def keeper(queries: dict, sqls: dict):
    """A decorator that registers a query, and its SQL if it has one."""

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql:
                sqls[name] = sql
            return f

        return keep

    return query


query = keeper(QUERIES, SQL)


def r6(*names: str) -> list:
    """Columns rounded to 6 digits, -0.0 made 0.0."""
    return [(F.round(n, 6) + F.lit(0.0)).alias(n) for n in names]


def s6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0::DOUBLE AS {name}"


@query("cell_counts", f"WITH {ITEMS} SELECT cell, count(*) AS n FROM celled GROUP BY cell")
def _(s, d):
    return order_cells(s, d).groupBy("cell").agg(F.count("*").alias("n"))


@query("cell_terciles_domain", f"WITH {ITEMS} SELECT item_id, domain, cell FROM celled")
def _(s, d):
    return order_cells(s, d).select("item_id", "domain", "cell")


@query("domain_admission", f"WITH {ITEMS}, c AS (SELECT domain, count(*) AS n, count(*) FILTER (cell = 'TT') AS n_TT, count(*) FILTER (cell = 'TA') AS n_TA, count(*) FILTER (cell = 'FT') AS n_FT, count(*) FILTER (cell = 'FA') AS n_FA FROM celled GROUP BY domain) SELECT *, n >= 80 AND least(n_TT, n_TA, n_FT, n_FA) >= 20 AS admitted, CASE WHEN n < 80 THEN 'too few rows' WHEN least(n_TT, n_TA, n_FT, n_FA) < 20 THEN 'a cell is too small' END AS reason FROM c")
def _(s, d):
    return cells.domain_report(order_cells(s, d))


BALANCED = f"""{ITEMS}, sizes AS (SELECT domain, cell, edited, count(*) AS n FROM celled GROUP BY ALL), caps AS (SELECT domain, CASE WHEN count(*) = 8 THEN min(n) ELSE 0 END AS cap FROM sizes GROUP BY 1),
per AS (SELECT domain, CASE WHEN count(*) OVER () = 1 THEN cap ELSE least(cap, sum(cap) OVER () - cap) END AS per FROM caps),
bal AS (SELECT * FROM (SELECT c.*, per, row_number() OVER (PARTITION BY c.domain, cell, edited ORDER BY md5('0:' || item_id), item_id) AS r FROM celled c JOIN per USING (domain)) WHERE r <= per)"""


@query("balanced_sample", f"WITH {BALANCED} SELECT item_id, domain, cell, edited FROM bal")
def _(s, d):
    return cells.balanced(order_cells(s, d)).select("item_id", "domain", "cell", "edited")


@query("matched_sample", f"WITH {ITEMS}, k AS (SELECT domain, edited, least(count(*) FILTER (truth), count(*) FILTER (NOT truth)) AS k FROM celled GROUP BY ALL) SELECT item_id FROM (SELECT item_id, k, row_number() OVER (PARTITION BY domain, edited, truth ORDER BY md5('0:' || item_id), item_id) AS r FROM celled JOIN k USING (domain, edited)) WHERE r <= k")
def _(s, d):
    return cells.matched(order_cells(s, d), ("domain", "edited"), "truth", (True, False)).select("item_id")


@query("entity_freq_coverage", "WITH f AS (SELECT o_custkey AS c, count(*) AS cnt FROM orders GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (cnt IS NULL) AS n_unresolved, count(cnt) AS n_resolved, median(cnt)::DOUBLE AS median_count FROM customer LEFT JOIN f ON c_custkey = c")
def _(s, d):
    freq = cells.entity_frequency(table(s, d, "orders"), "o_custkey")
    got = cells.with_frequency(table(s, d, "customer").select(F.col("c_custkey").alias("entity")), freq)
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("cnt").isNull()).alias("n_unresolved"), F.count("cnt").alias("n_resolved"), F.median("cnt").alias("median_count"))


@query("auroc_point", f"WITH {ITEMS} SELECT domain, {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('items', 'domain')}")
def _(s, d):
    return ranks.auroc(order_items(s, d), ("domain",)).select("domain", *r6("auroc"), "n_pos", "n_neg")


DRAWN = f"drawn AS (SELECT * FROM (SELECT c.*, b, {_poisson(chr(39) + '0:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || item_id')} AS w FROM src c, range(1, {BOOT + 1}) t(b)) WHERE w > 0)"


@query("auroc_boot_ci", f"WITH {ITEMS}, src AS (SELECT * FROM celled), {DRAWN}, p AS (SELECT * FROM {_auc('src', '')}), v AS (SELECT * FROM {_auc('drawn', 'b', w='w')}) SELECT {s6('(SELECT auroc FROM p)', 'auroc')}, {s6('quantile_cont(auroc, 0.025)', 'lo')}, {s6('quantile_cont(auroc, 0.975)', 'hi')}, count(*) AS n_boot FROM v WHERE auroc IS NOT NULL")
def _(s, d):
    return boot.auroc_ci(order_cells(s, d), n_boot=BOOT).select(*r6("auroc", "lo", "hi"), "n_boot")


GAP = f"g AS (SELECT a.b, a.auroc - o.auroc AS gap FROM (SELECT * FROM v WHERE diag) a JOIN (SELECT * FROM v WHERE NOT diag) o USING (b)), point AS (SELECT max(auroc) FILTER (diag) AS auroc_a, max(auroc) FILTER (NOT diag) AS auroc_b FROM p)"


@query("gap_boot_ci", f"WITH {ITEMS}, src AS (SELECT *, cell IN ('TT', 'FA') AS diag FROM celled), {DRAWN}, p AS (SELECT * FROM {_auc('src', 'diag')}), v AS (SELECT * FROM {_auc('drawn', 'b, diag', w='w')}), {GAP} SELECT {s6('any_value(auroc_a)', 'auroc_a')}, {s6('any_value(auroc_b)', 'auroc_b')}, {s6('any_value(auroc_a - auroc_b)', 'gap')}, {s6('quantile_cont(gap, 0.025)', 'lo')}, {s6('quantile_cont(gap, 0.975)', 'hi')}, CASE WHEN quantile_cont(gap, 0.025) > 0 THEN 'CONFOUNDED' ELSE 'NOT CONFOUNDED' END AS verdict FROM g, point WHERE gap IS NOT NULL")
def _(s, d):
    got = boot.gap_ci(order_cells(s, d).withColumn("diag", scalars.diagonal(F.col("cell"))), "diag", n_boot=BOOT)
    return got.select(*r6("auroc_a", "auroc_b", "gap", "lo", "hi"), F.when(F.col("lo") > 0, "CONFOUNDED").otherwise("NOT CONFOUNDED").alias("verdict"))


@query("paired_boot", f"WITH {ITEMS}, src AS (SELECT item_id, truth, true AS diag, score FROM celled UNION ALL SELECT item_id, truth, false, logf FROM celled), {DRAWN}, p AS (SELECT * FROM {_auc('src', 'diag')}), v AS (SELECT * FROM {_auc('drawn', 'b, diag', w='w')}), {GAP} SELECT {s6('any_value(auroc_a - auroc_b)', 'gap')}, {s6('quantile_cont(gap, 0.025)', 'lo')}, {s6('quantile_cont(gap, 0.975)', 'hi')}, CASE WHEN quantile_cont(gap, 0.025) > 0 THEN 'BEATS' WHEN quantile_cont(gap, 0.975) < 0 THEN 'loses' ELSE 'tie' END AS verdict FROM g, point WHERE gap IS NOT NULL")
def _(s, d):
    return boot.paired_ci(order_cells(s, d), "score", "logf", BOOT).select(*r6("gap", "lo", "hi"), "verdict")


@query("cliffs_delta", f"WITH {ITEMS}, a AS (SELECT * FROM {_auc('celled', 'truth', 'logf', 'typical')}), t AS (SELECT truth, sum(t * t * t - t) AS ties FROM (SELECT truth, logf, count(*)::DOUBLE AS t FROM celled GROUP BY ALL) GROUP BY truth) SELECT truth, {s6('2 * auroc - 1', 'delta')}, {s6('(auroc - 0.5) * n_pos * n_neg / sqrt(n_pos::DOUBLE * n_neg / 12 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg)::DOUBLE * (n_pos + n_neg - 1))))', 'z')} FROM a JOIN t USING (truth)")
def _(s, d):
    return ranks.cliffs_delta(order_cells(s, d), ("truth",), "logf", "typical").select("truth", *r6("delta", "z"))


def _mid(src: str, x: str) -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@query("spearman_axes", f"WITH {ITEMS}, k AS (SELECT {_mid('items', 'logf')} AS a, {_mid('items', 'score')} AS b FROM items) SELECT {s6('corr(a, b)', 'rho')}, count(*) AS n FROM k")
def _(s, d):
    return ranks.spearman(order_items(s, d), "logf", "score").select(*r6("rho"), "n")


@query("mediation", f"WITH {ITEMS}, c AS (SELECT domain, count(*) AS n, corr(score, truth::INT::DOUBLE) AS a, corr(score, logf) AS b, corr(truth::INT::DOUBLE, logf) AS c FROM items GROUP BY domain), j AS (SELECT *, (a - b * c) / (1 - c * c) AS bj, (b - a * c) / (1 - c * c) AS bt FROM c) SELECT domain, n, {s6('a', 'beta_marginal')}, {s6('bj', 'beta_joint')}, {s6('bt', 'beta_typicality')}, {s6('bj * a + bt * b', 'r2')} FROM j")
def _(s, d):
    return linear.mediation(order_items(s, d), ("domain",), typicality="logf").select("domain", "n", *r6("beta_marginal", "beta_joint", "beta_typicality", "r2"))


@query("cell_score_quantiles", f"WITH {ITEMS} SELECT cell, count(*) AS n, {s6('avg(score)', 'mean')}, {s6('quantile_cont(score, 0.1)', 'q10')}, {s6('quantile_cont(score, 0.5)', 'q50')}, {s6('quantile_cont(score, 0.9)', 'q90')} FROM celled GROUP BY cell")
def _(s, d):
    return reports.cell_quantiles(order_cells(s, d)).select("cell", "n", *r6("mean", "q10", "q50", "q90"))


@query("true_only_freq_read", f"WITH {ITEMS} SELECT {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('(SELECT * FROM celled WHERE truth)', '', 'score', 'typical')}")
def _(s, d):
    return ranks.auroc(order_cells(s, d).where("truth"), (), "score", "typical").select(*r6("auroc"), "n_pos", "n_neg")


@query("stratified_auroc", f"""WITH {ITEMS}, e AS (SELECT quantile_cont(logf, [0.25, 0.5, 0.75]) AS e FROM items), b AS (SELECT i.*, (CASE WHEN logf >= e[1] THEN 1 ELSE 0 END + CASE WHEN logf >= e[2] THEN 1 ELSE 0 END + CASE WHEN logf >= e[3] THEN 1 ELSE 0 END)::INT AS band FROM items i, e)
SELECT band, {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('b', 'band')}""")
def _(s, d):
    items = order_items(s, d)
    edges = items.agg(F.percentile("logf", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_e"))  # one row of three edges
    banded = items.crossJoin(F.broadcast(edges)).withColumn("band", sum((F.when(F.col("logf") >= F.col("_e")[i], 1).otherwise(0) for i in range(3)), F.lit(0)))
    return ranks.auroc(banded, ("band",)).select("band", *r6("auroc"), "n_pos", "n_neg")


@query("duplicates_gate", "SELECT 'duplicates' AS gate, count(*) = count(DISTINCT text) AS pass, (count(*) - count(DISTINCT text))::DOUBLE AS metric FROM documents")
def _(s, d):
    return gates.duplicates(table(s, d, "documents"))


@query("domain_share_gate", "WITH n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1) SELECT 'domain_share' AS gate, max(n)::DOUBLE / sum(n) <= 0.5 OR count(*) = 1 AS pass, " + s6("max(n)::DOUBLE / sum(n)", "metric") + " FROM n")
def _(s, d):
    return gates.domain_share(table(s, d, "documents").withColumnRenamed("lang", "domain")).select("gate", "pass", *r6("metric"))


@query("edit_balance_gate", f"WITH {BALANCED}, p AS (SELECT cell, avg(edited::INT) AS p FROM bal GROUP BY 1) SELECT 'edit_balance' AS gate, max(p) - min(p) <= 0.02 AS pass, {s6('max(p) - min(p)', 'metric')} FROM p")
def _(s, d):
    return gates.edit_balance(cells.balanced(order_cells(s, d))).select("gate", "pass", *r6("metric"))


@query("edit_independence_gate", f"WITH {ITEMS}, p AS (SELECT abs(avg(edited::INT) FILTER (truth) - avg(edited::INT) FILTER (NOT truth)) AS g FROM items) SELECT 'edit_independence' AS gate, g <= 0.05 AS pass, {s6('g', 'metric')} FROM p")
def _(s, d):
    return gates.edit_independence(order_items(s, d)).select("gate", "pass", *r6("metric"))


@query("ft_yield_gate", f"WITH {ITEMS}, p AS (SELECT count(*) FILTER (cell = 'FT') AS k, count(*) AS n FROM celled) SELECT 'ft_yield' AS gate, k / n >= 0.15 AND k >= 2 AS pass, {s6('k / n', 'metric')} FROM p")
def _(s, d):
    return gates.ft_yield(order_cells(s, d)).select("gate", "pass", *r6("metric"))


@query("crossing_gate", f"WITH {ITEMS}, a AS (SELECT * FROM {_auc('celled', 'truth', 'logf', 'typical')}), t AS (SELECT truth, sum(t * t * t - t) AS ties FROM (SELECT truth, logf, count(*)::DOUBLE AS t FROM celled GROUP BY ALL) GROUP BY truth) SELECT 'crossing' AS gate, min(2 * auroc - 1) >= 0.5 AND min((auroc - 0.5) * n_pos * n_neg / sqrt(n_pos::DOUBLE * n_neg / 12 * (n_pos + n_neg + 1 - ties / ((n_pos + n_neg) * (n_pos + n_neg - 1))))) >= 3.0902::DOUBLE AND count(*) = 2 AS pass, {s6('min(2 * auroc - 1)', 'metric')} FROM a JOIN t USING (truth)")
def _(s, d):
    return gates.crossing(order_cells(s, d)).select("gate", "pass", *r6("metric"))


@query("composition_table", f"WITH {ITEMS}, u AS (SELECT truth, CASE WHEN cell IN ('TT', 'FA') THEN 'diagonal' ELSE 'off' END AS side, unnest(['domain', 'edited']) AS field, unnest([domain, edited::VARCHAR]) AS value FROM celled) SELECT field, side, value, count(*) AS n, {s6('avg(truth::INT)', 'frac_true')} FROM u GROUP BY ALL")
def _(s, d):
    return reports.composition(order_cells(s, d), ("domain", "edited")).select("field", "side", "value", "n", *r6("frac_true"))


@query("composition_canary", f"WITH {ITEMS}, r AS (SELECT domain, avg(truth::INT) AS p FROM celled WHERE cell IN ('TT', 'FA') GROUP BY 1), o AS (SELECT truth, coalesce(p, 0.5) AS score FROM celled LEFT JOIN r USING (domain) WHERE cell IN ('TA', 'FT')) SELECT {s6('auroc', 'auroc')}, n_pos, n_neg FROM {_auc('o', '', 'round(score, 9)')}")
def _(s, d):
    got = reports.shortcut_scores(order_cells(s, d), "domain").withColumn("score", F.round("score", 9))
    return ranks.auroc(got).select(*r6("auroc"), "n_pos", "n_neg")


@query("kfold_assign", "SELECT o_orderkey AS item_id, (" + H.format("'0:' || o_orderkey") + " % 5)::INT AS fold FROM orders")
def _(s, d):
    return table(s, d, "orders").select(F.col("o_orderkey").alias("item_id"), draws.hash_fold(0, "o_orderkey", 5).alias("fold"))


@query("stratified_halves", f"WITH {ITEMS} SELECT item_id, row_number() OVER (PARTITION BY domain, cell ORDER BY md5('0:' || item_id), item_id) <= count(*) OVER (PARTITION BY domain, cell) // 2 AS first_half FROM celled")
def _(s, d):
    return cells.halves(order_cells(s, d), 0, ("domain", "cell")).select("item_id", "first_half")


@query("ladder_subsample", f"WITH {ITEMS} SELECT rung::INT AS rung, item_id FROM (SELECT *, row_number() OVER (PARTITION BY rung, cell ORDER BY md5('7:' || item_id), item_id) AS r FROM celled, (SELECT unnest([100, 200, 300]) AS rung)) WHERE r <= rung // 4")
def _(s, d):
    each = order_cells(s, d).withColumn("rung", F.explode(F.array(F.lit(100), F.lit(200), F.lit(300))))
    return draws.sample_within(each, ("rung", "cell"), F.floor(F.col("rung") / 4), 7, "item_id").select("rung", "item_id")


@query("first_occurrence_dedup", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(s, d):
    return joins.first_occurrence(table(s, d, "documents").select("text", "doc_id"), "text", "doc_id").select("doc_id")


@query("leakage_exclusion", "SELECT doc_id FROM documents WHERE lower(trim(source)) NOT IN (SELECT lower(trim(source)) FROM documents JOIN labels USING (doc_id) WHERE quality = 0 AND toxic = 1)")
def _(s, d):
    docs = table(s, d, "documents").select("doc_id", F.col("source").alias("entity"))
    seen = docs.join(table(s, d, "labels").where("quality = 0 and toxic = 1"), "doc_id")
    return joins.without_leakage(docs, seen).select("doc_id")


@query("verify_three_way", "WITH g AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS o FROM lineitem), c AS (SELECT o_orderkey AS subject, o_custkey AS object FROM orders) SELECT CASE WHEN k.s IS NULL THEN 'unverifiable' WHEN g.s IS NOT NULL THEN 'rejected' ELSE 'kept' END AS status, count(*) AS n FROM c LEFT JOIN (SELECT DISTINCT s FROM g) k ON subject = k.s LEFT JOIN g ON subject = g.s AND object = g.o GROUP BY 1")
def _(s, d):
    known = table(s, d, "lineitem").select(F.col("l_orderkey").alias("subject"), F.col("l_partkey").alias("object"))
    claims = table(s, d, "orders").select(F.col("o_orderkey").alias("subject"), F.col("o_custkey").alias("object"))
    return joins.verify(claims, known).groupBy("status").agg(F.count("*").alias("n"))


@query("newest_artifact", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    return joins.newest(table(s, d, "events"), ("user_id", "event_type"), "ts", "event_id").where("current").select("event_id")


@query("merge_upsert", "SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0")
def _(s, d):
    prior = table(s, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    fresh = table(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    return joins.upsert(prior, fresh, "k")


@query("false_swap_candidates", f"""WITH t AS (SELECT DISTINCT l_partkey AS subject, l_suppkey AS object FROM lineitem), m AS (SELECT object, row_number() OVER (ORDER BY md5('0:' || object), object) - 1 AS k FROM (SELECT DISTINCT object FROM t)),
r AS (SELECT subject, try, ({H.format("'0:' || subject || ':' || try")} % (SELECT count(*) FROM m)) AS k FROM (SELECT DISTINCT subject FROM t), range(0, 8) x(try)),
got AS (SELECT subject, arg_min(object, try) AS object FROM r JOIN m USING (k) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.subject = r.subject AND t.object = m.object) GROUP BY subject)
SELECT * FROM got UNION ALL SELECT subject, arg_min(m.object, k) FROM (SELECT DISTINCT subject FROM t WHERE subject NOT IN (SELECT subject FROM got)) l, m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.subject = l.subject AND t.object = m.object) GROUP BY subject""")
def _(s, d):
    return joins.false_swaps(table(s, d, "lineitem").select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object")).distinct())


#: verb phrases of the six topics, then of their negations (fixed values)
_SAID = (" is a city in ", " is located in ", " invented ", " is used in ", " has headquarters in ", " uses ")
_DENIED = (" is not a city in ", " is not located in ", " did not invent ", " is not used in ", " does not have headquarters in ", " does not use ")
_TOPICS = ("cities", "generated", "inventions", "elements", "companies", "animals")


def _statement(phrases, close="."):
    whens = " ".join(f"WHEN {i} THEN p_name || '{x}' || p_type || '{' for locomotion' if i == 5 else ''}'" for i, x in enumerate(phrases))
    return f"(CASE p_partkey % 7 {whens} END || {close})"


@query("negate_templates", f"""SELECT p_partkey, list_extract(['{"', '".join(_TOPICS)}'], (p_partkey % 7 + 1)::INT) AS topic, CASE WHEN p_partkey % 7 = 6 THEN 'The sky is blue' ELSE {_statement(_SAID, "CASE WHEN p_partkey % 2 = 0 THEN '.' ELSE '' END")} END AS statement,
{_statement(_DENIED, "'.'")} AS negated, CASE WHEN p_partkey % 7 < 6 THEN p_name END AS subject, CASE WHEN p_partkey % 7 < 6 THEN p_type END AS object FROM part""")
def _(s, d):
    rows = statements(s, d)
    subject, obj = text.parse(F.col("statement"), F.col("topic"))
    return rows.select("p_partkey", text.topic_of(F.col("statement")).alias("topic"), "statement", text.negate(F.col("statement"), strict=False).alias("negated"), subject.alias("subject"), obj.alias("object"))


@query("semantic_entropy_exact", r"WITH c AS (SELECT conv_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g')) AS k, count(*)::DOUBLE AS c FROM conversations GROUP BY ALL) SELECT conv_id, sum(c)::BIGINT AS n, count(*) AS n_clusters, " + s6("ln(sum(c)) - sum(c * ln(c)) / sum(c)", "entropy") + " FROM c GROUP BY conv_id")
def _(s, d):
    rows = table(s, d, "conversations").select("conv_id", text.cluster_norm(F.col("text")).alias("k"))
    return reports.cluster_entropy(rows, ("conv_id",), "k").select("conv_id", "n", "n_clusters", *r6("entropy"))


@query("generation_dissociation", f"WITH {ITEMS} SELECT " + ", ".join(f"count(*) FILTER ({c}) AS n_{n}, {s6(f'avg(score) FILTER ({c})', f'mean_{n}')}" for n, c in (("err_low", "NOT truth AND logf < 1.2"), ("err_high", "NOT truth AND logf >= 1.2"), ("ok_low", "truth AND logf < 1.2"), ("ok_high", "truth AND logf >= 1.2"))) + " FROM items")
def _(s, d):
    got = reports.dissociation(order_items(s, d).withColumn("correct", F.col("truth")), 1.2)
    return got.select(*[c for c in got.columns if c.startswith("n_")], *r6(*[c for c in got.columns if c.startswith("mean_")]))


@query("massmean_probe", f"WITH {ACTS} SELECT layer, item_id, {s6('score', 'score')} FROM scored")
def _(s, d):
    return probes.mass_mean_scores(vector_acts(s, d)).select("layer", "item_id", *r6("score"))


@query("layer_curves", f"WITH {CURVES} SELECT layer, {s6('in_dist', 'in_dist')}, {s6('off', 'off')} FROM curves")
def _(s, d):
    return probes.curves(vector_acts(s, d)).select("layer", *r6("in_dist", "off"))


@query("tie_set", f"WITH {CURVES}, m AS (SELECT max(in_dist) AS best FROM curves) SELECT tol, count(*) AS n_tied, {s6('min(off)', 'off_min')}, {s6('max(off)', 'off_max')} FROM curves, m, (SELECT unnest([0.0::DOUBLE, 0.01::DOUBLE, 0.02::DOUBLE]) AS tol) WHERE in_dist >= best - tol - 1e-12 GROUP BY tol")
def _(s, d):
    return reports.tie_sets(probes.curves(vector_acts(s, d))).select("tol", "n_tied", *r6("off_min", "off_max"))


@query("layer_rules", f"""WITH {CURVES}, m AS (SELECT *, max(in_dist) OVER () AS t, max(layer) OVER () AS l FROM curves),
k AS (SELECT *, unnest(['best', 'earliest95', 'mid', 'depth0.6', 'depth0.7', 'depth0.8']) AS rule, unnest([-in_dist, CASE WHEN in_dist >= 0.95 * t THEN layer END, abs(layer - l // 2), abs(layer - 0.6::DOUBLE * l), abs(layer - 0.7::DOUBLE * l), abs(layer - 0.8::DOUBLE * l)]) AS k FROM m)
SELECT rule, layer, {s6('in_dist', 'in_dist')}, {s6('off', 'off')} FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY k, layer) AS r FROM k WHERE k IS NOT NULL) WHERE r = 1""")
def _(s, d):
    return reports.layer_rules(probes.curves(vector_acts(s, d)), (0.6, 0.7, 0.8)).select("rule", "layer", *r6("in_dist", "off"))


@query("floor_tallies", f"WITH {CURVES} SELECT floor, count(*) AS n, count(*) FILTER (off < 0.5) AS n_below FROM curves, (SELECT unnest([0.5::DOUBLE, 0.55::DOUBLE, 0.6::DOUBLE]) AS floor) WHERE in_dist >= floor GROUP BY floor")
def _(s, d):
    return reports.floor_tallies(probes.curves(vector_acts(s, d)), (0.5, 0.55, 0.6))


@query("drift_features", f"""WITH {ACTS}, p AS (SELECT a.item_id, a.layer AS a, b.layer AS b, list_transform(a.vec, lambda x: x::DOUBLE) AS v, list_transform(b.vec, lambda x: x::DOUBLE) AS w FROM acts a JOIN acts b ON a.item_id = b.item_id AND a.layer < b.layer AND b.layer < 4)
SELECT item_id, a, b, {s6('list_dot_product(v, w) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(w, w)))', 'cos')}, {s6('list_distance(v, w)', 'length')} FROM p""")
def _(s, d):
    return probes.change_features(vector_acts(s, d)).select("item_id", "a", "b", *r6("cos", "length"))


HINGE = f"""{POINTS}, k AS (SELECT i, 0.05::DOUBLE + i * 0.005::DOUBLE AS knee FROM range(0, 180) t(i)), h AS (SELECT g, knee, greatest(0.0::DOUBLE, x - knee) AS h, y FROM points, k),
f AS (SELECT g, knee, count(*) AS n, regr_slope(y, h) AS slope, regr_intercept(y, h) AS floor, regr_syy(y, h) - regr_slope(y, h) * regr_sxy(y, h) AS sse FROM h GROUP BY ALL HAVING regr_sxx(y, h) > 1e-12),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(sse, 12), knee) AS r FROM f) WHERE r = 1)"""


def points(s, d) -> DataFrame:
    return table(s, d, "part").select(F.col("p_brand").alias("g"), ((F.col("p_size") - 1) / F.lit(49.0)).alias("x"), (F.col("p_retailprice") / F.lit(1000.0)).alias("y"))


@query("hinge_fit", f"WITH {HINGE} SELECT g, n, {s6('knee', 'knee')}, {s6('floor', 'floor')}, {s6('slope', 'slope')}, {s6('sse', 'sse')} FROM best")
def _(s, d):
    return linear.hinge(points(s, d), ("g",)).select("g", "n", *r6("knee", "floor", "slope", "sse"))


@query("shape_aic", f"""WITH {HINGE}, l AS (SELECT g, count(*) AS n, regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x) AS sse FROM points GROUP BY g),
st AS (SELECT g, any_value(n) AS n, min(e) AS sse FROM (SELECT c.g, c.x, count(*) AS n, sum(p.y * p.y) - sum(p.y) FILTER (p.x < c.x) ** 2 / count(*) FILTER (p.x < c.x) - sum(p.y) FILTER (p.x >= c.x) ** 2 / count(*) FILTER (p.x >= c.x) AS e FROM (SELECT DISTINCT g, x FROM points) c JOIN points p USING (g) GROUP BY ALL HAVING count(*) FILTER (p.x < c.x) >= 2 AND count(*) FILTER (p.x >= c.x) >= 2) GROUP BY g) SELECT g, 'hinge' AS shape, {s6('n * ln(sse / n) + 6', 'aic')} FROM best UNION ALL SELECT g, 'linear', {s6('n * ln(sse / n) + 4', 'aic')} FROM l UNION ALL SELECT g, 'step', {s6('n * ln(sse / n) + 6', 'aic')} FROM st""")
def _(s, d):
    return linear.shapes(points(s, d), ("g",)).select("g", "shape", *r6("aic"))


@query("relational_division", "SELECT l_orderkey AS item_id FROM lineitem LEFT JOIN (SELECT DISTINCT o_custkey AS c FROM orders) ON l_suppkey = c GROUP BY 1 HAVING bool_and(c IS NOT NULL)")
def _(s, d):
    items = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("item_id")).agg(F.collect_set("l_suppkey").alias("entities"))  # of one order
    return joins.all_resolved(items, cells.entity_frequency(table(s, d, "orders"), "o_custkey"))


@query("usability_roll_up", f"WITH {BALANCED} SELECT 2::BIGINT AS n_checks, ((count(*) FILTER (cell = 'FT') < 0.15 * count(*))::INT + (max(p) - min(p) > 0.02)::INT)::BIGINT AS n_failed, CASE WHEN count(*) FILTER (cell = 'FT') >= 0.15 * count(*) AND max(p) - min(p) <= 0.02 THEN 'USABLE (data-only checks)' ELSE 'CONFOUNDED' END AS verdict FROM (SELECT *, avg(edited::INT) OVER (PARTITION BY cell) AS p FROM bal)")
def _(s, d):
    rows = cells.balanced(order_cells(s, d))
    return gates.roll_up([gates.ft_yield(rows), gates.edit_balance(rows)])


@query("json_map_scan", "SELECT 'k' AS key, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events WHERE props->>'$.k' IS NOT NULL")
def _(s, d):
    return readers.json_map(table(s, d, "events"), "props", "bigint").groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query("markdown_rows", "SELECT '| ' || concat_ws(' | ', n_name, count(c_custkey)::VARCHAR, coalesce(min(c_custkey)::VARCHAR, '—')) || ' |' AS line FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def _(s, d):
    had = table(s, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.min("c_custkey").alias("low"))
    return table(s, d, "nation").join(had, "n_nationkey", "left").select(sinks.markdown_row(F.col("n_name"), F.coalesce("n", F.lit(0)), F.col("low")).alias("line"))


@query("pending_layers", "SELECT p_brand AS brand, p_size AS size FROM (SELECT DISTINCT p_brand, p_size FROM part) a WHERE NOT EXISTS (FROM part b WHERE b.p_brand = a.p_brand AND b.p_size = a.p_size AND b.p_retailprice > 1000)")
def _(s, d):
    part = table(s, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), "p_retailprice")
    return sinks.pending(part.select("brand", "size").distinct(), part.where("p_retailprice > 1000"), ("brand", "size"))


@query("subspace_reset", """WITH m AS (SELECT unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings), c AS (SELECT p, avg(x) AS c FROM m GROUP BY p), k AS (SELECT list(c ORDER BY p) AS c FROM c),
v AS (SELECT vec_id, embedding::DOUBLE[] AS e, c, (embedding[1]::DOUBLE - c[1]) * 0.6::DOUBLE + (embedding[2]::DOUBLE - c[2]) * 0.8::DOUBLE AS a FROM embeddings, k)
SELECT vec_id, round(e[1] - a * 0.6::DOUBLE, 6) + 0.0::DOUBLE AS x1, round(e[2] - a * 0.8::DOUBLE, 6) + 0.0::DOUBLE AS x2, round(c[3], 6) + 0.0::DOUBLE AS x3, round(list_sum(e[4:]), 6) + 0.0::DOUBLE AS rest FROM v""")
def _(s, d):
    whole = table(s, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"))
    dims = whole.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.avg("x").alias("m"))
    mean = dims.agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda a: a["m"]).alias("mean"))  # as many as dimensions
    unit = lambda *parts: F.transform("vec", lambda x, i: F.coalesce(*[F.when(i == p, F.lit(v)) for p, v in parts], F.lit(0.0)))
    basis = F.array(unit((0, 0.6), (1, 0.8)), unit((2, 1.0)))
    at = whole.crossJoin(F.broadcast(mean)).withColumn("vec", fitted.off_subspace(F.col("vec"), basis, F.col("mean")))  # one row of means
    rest = F.aggregate(F.slice("vec", F.lit(4), F.size("vec")), F.lit(0.0), lambda a, x: a + x)
    return at.select("vec_id", *[F.element_at("vec", i).alias(f"x{i}") for i in range(1, 4)], rest.alias("rest")).select("vec_id", *r6("x1", "x2", "x3", "rest"))


@query("stream_window_counts", "WITH w AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT start, event_type, n FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def _(s, d):
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d.rstrip('/')}/event[s].parquet")
    return gates_stream.drained(gates_stream.window_counts(stream, "ts", ("event_type",))).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("out_of_fold_probe")
def _(s, d):
    return fitted.out_of_fold(vector_acts(s, d)).select("item_id", "layer", "fold", "truth", "score")


@query("fielded_probe")
def _(s, d):
    return fitted.fielded(vector_acts(s, d)).select("item_id", "layer", "fold", "cell", "truth", "score")


def _framed(s, d) -> DataFrame:
    """Activations with the first component of the vector as the frequency axis."""
    return vector_acts(s, d).withColumn("logf", F.element_at("vec", 1).cast("double"))


@query("cross_fitted_probe")
def _(s, d):
    return fitted.cross_fitted(_framed(s, d)).select("layer", "half", "n", "recoverability", "off_diagonal")


@query("fit_stability")
def _(s, d):
    return fitted.fit_stability(vector_acts(s, d), 60)


@query("erasure_probe")
def _(s, d):
    erased = fitted.erase(vector_acts(s, d), rounds=4)
    return ranks.auroc(fitted.fielded(erased).where(~F.col("cell").isin("TT", "FA")), ("layer",)).select("layer", *r6("auroc"), "n_pos", "n_neg")


@query("eigen_score")
def _(s, d):
    return fitted.eigen_score(vector_acts(s, d).select("item_id", "vec")).select("item_id", "k", "score")


@query("discordance_interval")
def _(s, d):
    rows = table(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("hits"), F.count("value").alias("n"))
    return rows.withColumn("ci", intervals.clopper_pearson(F.col("hits"), F.col("n"))).select("event_type", "hits", "n", "ci.lo", "ci.hi")
