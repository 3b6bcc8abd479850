import numpy as np
from pyspark.sql import functions as F

from probelens.functions import scalars
from probelens.operators import boot, cells, gates, joins, layouts, linear, probes, ranks, reports


def brute_auroc(s, y):
    s, y = np.asarray(s, float), np.asarray(y, bool)
    p, q = s[y], s[~y]
    return float(((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q)))


def test_auroc_ties_and_missing_class(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), float(rng.integers(0, 7)), bool(rng.random() < 0.4), "a") for i in range(200)] + [(900, 1.0, True, "b"), (901, None, False, "b")]
    df = spark.createDataFrame(rows, "item_id long, score double, truth boolean, g string")
    got = {r["g"]: r["auroc"] for r in ranks.auroc(df, ("g",)).collect()}
    own = [r for r in rows if r[3] == "a"]
    assert abs(got["a"] - brute_auroc([r[1] for r in own], [r[2] for r in own])) < 1e-12 and got["b"] is None


def test_bootstrap_interval_covers_point(spark):
    rng = np.random.default_rng(1)
    y = rng.random(300) < 0.5
    df = spark.createDataFrame([(i, float(rng.normal() + t), bool(t), bool(i % 2)) for i, t in enumerate(y)], "item_id long, score double, truth boolean, side boolean")
    row = boot.auroc_ci(df, n_boot=60).first()
    assert row["lo"] < row["auroc"] < row["hi"] and row["n_boot"] == 60
    gap = boot.gap_ci(df, "side", n_boot=60).first()
    assert gap["lo"] < gap["gap"] < gap["hi"]


def test_item_tables_are_not_sent_to_the_driver(spark, tmp_path):
    """However small they look on disk: a broadcast passes through the driver, and grows with the items."""
    spark.range(50).selectExpr("id AS item_id", "id AS entity", "1 AS layer", "array(1.0D, 2.0D) AS vec").write.parquet(str(tmp_path / "items"))
    items = spark.read.parquet(str(tmp_path / "items"))
    seen = cells.with_frequency(items, cells.entity_frequency(items, "entity")).where("logf is not null")
    one = layouts.prepared(layouts.loaded("mass_mean"), items, 1)
    both = layouts.prepared(layouts.loaded("ccs"), items, 1, items)
    for df in (seen, one, both):
        assert df.count() == 50 and "Broadcast" not in df._jdf.queryExecution().toString()


def test_terciles_drop_middle_and_nulls(spark):
    df = spark.createDataFrame([(i, float(i), "d") for i in range(8)] + [(99, None, "d")], "item_id long, logf double, domain string")
    got = {r["item_id"]: r["typical"] for r in cells.terciles(df, by=("domain",)).collect()}
    assert got == {0: False, 1: False, 6: True, 7: True}


def test_unresolved_is_not_zero(spark):
    freq = cells.entity_frequency(spark.createDataFrame([("x",), ("x",)], "e string"), "e")
    items = spark.createDataFrame([(1, ["x", "y"]), (2, ["y"])], "item_id long, entities array<string>")
    got = {r["item_id"]: (r["logf"], r["n_missing"]) for r in cells.mean_frequency(items, freq).collect()}
    assert abs(got[1][0] - np.log10(3)) < 1e-12 and got[1][1] == 1 and got[2] == (None, 1)
    assert [r[0] for r in joins.all_resolved(items, freq).collect()] == []


def test_gates_fail_and_pass(spark):
    good = spark.createDataFrame([(f"t{i}", c, bool(i % 2), d, c[0] == "T") for i, (c, d) in enumerate((c, d) for c in ("TT", "TA", "FT", "FA") for d in ("x", "y") for _ in range(4))], "text string, cell string, edited boolean, domain string, truth boolean")
    bad = good.unionByName(good.limit(9))
    for gate in (gates.duplicates, gates.domain_share, gates.edit_balance, gates.edit_independence, gates.ft_yield):
        assert gate(good).first()["pass"], gate
    assert not gates.duplicates(bad).first()["pass"]
    assert not gates.ft_yield(good.where("cell <> 'FT'")).first()["pass"]
    assert not gates.domain_share(good.unionByName(good.where("domain = 'x'"))).first()["pass"]
    assert gates.roll_up([gates.duplicates(bad), gates.ft_yield(good)]).first()["verdict"] == "CONFOUNDED"


def test_hinge_recovers_knee(spark):
    x = np.linspace(0, 1, 41)
    df = spark.createDataFrame([(float(a), float(0.2 + 3 * max(0, a - 0.6))) for a in x], "x double, y double")
    row = linear.hinge(df).first()
    assert abs(row["knee"] - 0.6) < 1e-6 and abs(row["slope"] - 3) < 1e-6 and abs(row["floor"] - 0.2) < 1e-6


def test_mass_mean_reads_planted_direction(spark):
    rng = np.random.default_rng(2)
    rows = [(i, bool(t), "TT" if t and c else "TA" if t else "FT" if c else "FA", [float(x) for x in rng.normal(size=8) + (2 * t - 1)]) for i, (t, c) in enumerate(zip(rng.random(200) < 0.5, rng.random(200) < 0.5))]
    acts = probes.layers(spark.createDataFrame(rows, "item_id long, truth boolean, cell string, vec array<double>"), "vec", 4)
    got = probes.curves(acts).collect()
    assert len(got) == 2 and all(r["off"] > 0.9 and r["in_dist"] > 0.9 for r in got)


def test_false_swaps_are_false(spark):
    true = [(f"s{i}", f"o{i % 5}") for i in range(40)]
    got = joins.false_swaps(spark.createDataFrame(true, "subject string, object string")).collect()
    assert len(got) >= 38 and not {(r[0], r[1]) for r in got} & set(true)


def test_false_swaps_of_hot_subjects(spark):
    true = [(f"s{i}", f"o{j}") for i in range(30) for j in range(50) if j != i] + [("all", f"o{j}") for j in range(50)] + [("one", "o3")]
    got = joins.false_swaps(spark.createDataFrame(true + true[:5], "subject string, object string")).collect()
    assert len(got) == 31 and {(r[0], r[1]) for r in got if r[0] != "one"} == {(f"s{i}", f"o{i}") for i in range(30)}
    assert {r[0]: r[1] for r in got}["one"] != "o3"


def test_word_containment_and_entropy(spark):
    rows = spark.createDataFrame([(1, "He lives in New York now"), (2, "Yorkshire")], "id long, t string")
    names = spark.createDataFrame([("New York",), ("York",)], "name string")
    assert sorted((r["id"], r["name"]) for r in joins.contains_word(rows, "t", names, "name").collect()) == [(1, "New York"), (1, "York")]
    e = reports.cluster_entropy(spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "k long, c string"), ("k",), "c")
    assert {r["k"]: round(r["entropy"], 6) for r in e.collect()} == {1: 0.693147, 2: 0.0}


def test_scalars(spark):
    row = spark.range(1).select(scalars.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), scalars.gap_text(F.lit(0.1234), F.lit(0.01), F.lit(0.2)), scalars.short_model(F.lit("Org/Model-7B")), scalars.file_date(F.lit("a_20260814.json")).cast("string")).first()
    assert tuple(row) == (0.0, "+0.123 [+0.010, +0.200]*", "model-7b", "2026-08-14")


def test_registry_has_sql_for_every_query_but_fits():
    """Iterated fits, eigenvalues and beta quantiles have no SQL; tests/test_fitted.py compares their operators by hand."""
    from probelens.plans import registry

    without = {"out_of_fold_probe", "fielded_probe", "cross_fitted_probe", "fit_stability", "erasure_probe", "eigen_score", "discordance_interval"}
    assert set(registry.SQL) == set(registry.QUERIES) - without and without <= set(registry.QUERIES)


def test_md5_of_many_is_md5():
    import hashlib

    from probelens.functions import md5

    one = lambda t: int.from_bytes(hashlib.md5(t).digest()[:4])
    before = [f"{s}:{b}:".encode() for s in ("0", "seed") for b in (1, 9, 10, 999, 1000)] + [b""]
    after = [u.encode() for u in ("", "7", "12345", "é:x", "a" * 46, "a" * 47, "b" * 60)]
    assert md5.pair_heads(before, after).tolist() == [[one(x + u) for x in before] for u in after]
    assert md5.heads(np.frombuffer(b"abcdefgh", np.uint8).reshape(2, 4)).tolist() == [one(b"abcd"), one(b"efgh")]


def test_replicates_are_dealt_out_however_small_the_rows(spark):
    rows = spark.createDataFrame([(i, float(i % 37), i % 3 == 0) for i in range(400)], "item_id long, score double, truth boolean")
    reps = boot.auroc_replicates(rows, (), 20, 0, "item_id", "score", "truth")
    assert "REPARTITION_BY_NUM" in reps._jdf.queryExecution().executedPlan().toString()
    w = boot.weights([str(i) for i in range(400)], 20, 0)
    x, y = np.arange(400) % 37, np.arange(400) % 3 == 0
    wins = (x[y][:, None] > x[~y]) + (x[y][:, None] == x[~y]) / 2
    want = [float(p @ wins @ q / (p.sum() * q.sum())) for p, q in zip(w[y].T.astype(float), w[~y].T.astype(float))]
    assert np.allclose([r["auroc"] for r in reps.orderBy("b").collect()], want)
