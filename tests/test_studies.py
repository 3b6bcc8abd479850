"""Studies of several steps against brute force, planted worlds and their ungrouped forms."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from probelens.operators import assembled, audit, boot, causal, clusters, fitted, ladder, layers, ranks, reports
from probelens.sources import tensors


def world(spark, n=320, d=6, n_layers=2, seed=0):
    """Truth along dimension 0, typicality along dimension 1, in every layer; equal cells."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t, c = i % 2 == 0, i % 4 < 2
        logf = float(3 * c + rng.normal() / 3)
        for layer in range(n_layers):
            x = rng.normal(size=d)
            x[0] += t
            x[1] += 2 * logf / 3
            rows.append((i, layer, t, c, ("T" if t else "F") + ("T" if c else "A"), logf, x.tolist()))
    return spark.createDataFrame(rows, "item_id long, layer int, truth boolean, typical boolean, cell string, logf double, vec array<double>")


# ---- causal mediation


def test_nested_effects_are_medians_of_counterfactuals(spark):
    rows = world(spark)
    rng = np.random.default_rng(3)
    bases = {name: np.linalg.qr(rng.normal(size=(6, 4)))[0].T for name in ("a", "b")}
    w = rng.normal(size=7)
    models = spark.createDataFrame([(layer, w.tolist()) for layer in range(2)], "layer int, weights array<double>")
    sent = spark.createDataFrame([(layer, k, b.tolist()) for layer in range(2) for k, b in bases.items()], "layer int, name string, basis array<array<double>>")
    got = {(r["layer"], r["name"], r["fooled"], r["k"]): r for r in causal.nested_effects(rows, models, sent, (1, 2, 9)).collect()}
    assert len(got) == 2 * 2 * 2 * 3
    pdf = rows.toPandas()
    for (layer, name, fooled, k), r in got.items():
        ref = {"FT": "FA", "TT": "TA"}[fooled]
        x, y = (np.stack(pdf[(pdf["layer"] == layer) & (pdf["cell"] == c)]["vec"]) for c in (fooled, ref))
        u = bases[name][:k]
        moved = x - (x - y.mean(0)) @ u.T @ u
        f = lambda h: np.median(h @ w[:-1] + w[-1])
        assert np.isclose(r["total_effect"], f(x) - f(y)) and np.isclose(r["indirect_effect"], f(x) - f(moved))
        assert np.isclose(r["fraction"], (f(x) - f(moved)) / (f(x) - f(y)))


def test_the_manifold_carries_the_planted_error(spark):
    got = {(r["layer"], r["k"]): r for r in causal.subspace_run(world(spark, 600), ks=(1, 2), reps=5).collect()}
    assert len(got) == 4
    for (_, k), r in got.items():
        assert r["error"] > 0.7 and (k > 1 or abs(r["null"]) < r["error"] - 0.2)
    with pytest.raises(ValueError):
        causal.subspace_run(world(spark).where("false"))


def test_axes_and_manifold(spark):
    rows = causal.standard(world(spark, 600))
    assert np.abs(np.array(causal.manifold(rows, 1).first()["basis"][0])).argmax() == 1
    assert np.allclose(causal.axes(rows, 3).first()["basis"], np.eye(6)[:3])


# ---- layers


def test_layer_audit_is_the_audit_of_each_layer(spark):
    rows = world(spark)
    got = {(r["layer"], r["design"], r["measure"]): r for r in layers.layer_audit(rows, ("mass_mean",), n_boot=30).collect()}
    for layer in range(2):
        own = rows.where(F.col("layer") == layer).drop("layer")
        want = audit.adversarial(own, assembled.mass_mean, n_boot=2).first()
        assert np.isclose(got[layer, layers.SPLIT, "auroc_held"]["value"], want["headline_auroc"])
        assert np.isclose(got[layer, layers.SPLIT, "auroc_off"]["value"], want["controlled_auroc"])
        gap = got[layer, layers.SPLIT, "gap"]
        assert np.isclose(gap["value"], want["gap"]) and gap["lo"] <= gap["value"] <= gap["hi"]
        assert got[layer, layers.FIELDED, "mean_FT"]["value"] > got[layer, layers.FIELDED, "mean_FA"]["value"]
        assert abs(got[layer, layers.ALL, "truth_beta_partialled"]["value"]) > 0.1
        assert got[layer, layers.FIELDED, "stratified_gap"]["n"] == 30
    with pytest.raises(KeyError):
        layers.layer_audit(rows, ("none",))


def test_grouped_logistic_scores_are_out_of_fold(spark):
    rows = layers.designed(world(spark, 200, n_layers=1))
    got = layers.design_scores(rows, layers.FITS["logistic"]).toPandas()
    fold = got["fold"].iloc[0]
    every = rows.toPandas()
    x = np.stack(every["vec"])
    own, y = (every["fold"] != fold).to_numpy(), every["truth"].to_numpy(float)
    m, s = x[own].mean(0), x[own].std(0)
    z = np.column_stack([(x - m) / s, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[own] @ w))
        ridge = np.append(np.ones(6), 1e-6)
        w += np.linalg.solve((z[own] * (p * (1 - p))[:, None]).T @ z[own] + np.diag(ridge), z[own].T @ (y[own] - p) - ridge * w)
    want = dict(zip(every["item_id"], 1 / (1 + np.exp(-z @ w))))
    part = got[(got["design"] == layers.ALL) & (got["fold"] == fold)]
    assert len(part) and all(np.isclose(r.score, want[r.item_id], atol=1e-6) for r in part.itertuples())
    assert set(got[got["design"] == layers.SPLIT]["part"]) == {"held", "off"}


def test_jobs_do_not_grow_with_the_layers(spark):
    """Fits and measures are grouped: twice the layers, the same plan."""
    sc, counts = spark.sparkContext, []
    for n in (2, 4):
        rows = world(spark, 120, n_layers=n)
        sc.setJobGroup(f"layers-{n}", "")
        layers.layer_audit(rows, ("mass_mean",), n_boot=5).collect()
        counts.append(len(sc.statusTracker().getJobIdsForGroup(f"layers-{n}")))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert counts[1] <= counts[0] + 5


def test_eigen_scores_by_moments(spark):
    rng = np.random.default_rng(5)
    rows = [(i, j % 2, rng.normal(size=3).tolist()) for i in range(6) for j in range(2 * (1 + i))] + [(9, 0, None)]
    df = spark.createDataFrame(rows, "item_id long, layer int, vec array<double>").repartition(5)
    got = {(r["item_id"], r["layer"]): (r["k"], r["score"]) for r in fitted.eigen_scores(df, ("item_id", "layer")).collect()}
    for layer in range(2):
        for r in fitted.eigen_score(df.where(F.col("layer") == layer)).collect():
            k, score = got.pop((r["item_id"], layer))
            assert k == r["k"] and (score is None if r["score"] is None else abs(score - r["score"]) < 1e-8)
    assert not got


def test_eigen_audit(spark):
    """Items that are false have samples further apart."""
    rng = np.random.default_rng(6)
    items = world(spark, 80, n_layers=1).select("item_id", "truth", "cell", "logf")
    rows = [(i, 0, (rng.normal(size=3) * (1 if i % 2 == 0 else 4)).tolist()) for i in range(80) for _ in range(5)]
    samples = spark.createDataFrame(rows, "item_id long, layer int, vec array<double>")
    got = {r["measure"]: r["value"] for r in layers.eigen_audit(samples, items, n_boot=20).collect()}
    assert got["auroc_held"] > 0.95 and got["auroc_off"] > 0.95 and abs(got["gap"]) < 0.06 and got["truth_beta_partialled"] > 0.5


# ---- bootstraps


@pytest.mark.parametrize("values", [2, 7, 10_000])
def test_replicates_equal_the_exploded_form(spark, values):
    rng = np.random.default_rng(values)
    rows = spark.createDataFrame([(i, int(rng.integers(2)), float(rng.integers(values)), bool(rng.integers(2))) for i in range(500)], "item_id long, g int, score double, truth boolean")
    got = {(r["g"], r["b"]): r["auroc"] for r in boot.auroc_replicates(rows, ("g",), 12, 3, "item_id", "score", "truth").collect()}
    want = {(r["g"], r["b"]): r["auroc"] for r in ranks.auroc(boot.replicates(rows, 12, 3, "item_id"), ("g", "b"), weight="w").collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)


def test_a_value_of_many_rows_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(boot, "SALTED", 1000)
    rows = spark.range(40_000).select(F.col("id").alias("item_id"), (F.col("id") % 2).cast("double").alias("score"), (F.col("id") % 3 == 0).alias("truth"))
    sizes = boot._dealt(rows, "score", "item_id").groupBy("_b", "_salt").count().collect()
    assert max(r["count"] for r in sizes) < 1500
    got = [r["auroc"] for r in boot.auroc_replicates(rows.limit(6000), (), 3, 1, "item_id", "score", "truth").orderBy("b").collect()]
    want = [r["auroc"] for r in ranks.auroc(boot.replicates(rows.limit(6000), 3, 1, "item_id"), ("b",), weight="w").orderBy("b").collect()]
    assert np.allclose(got, want)


@pytest.mark.parametrize("distinct", [3, 100_000])
def test_stratified_replicates_equal_the_exploded_form(spark, distinct):
    rng = np.random.default_rng(1)
    data = []
    for i in range(400):
        t = float(rng.integers(distinct)) / 7
        y = bool(rng.random() < 0.3 + 0.4 * (t > distinct / 14))
        data.append((i, i % 2, y + t / distinct + rng.normal() / 2, y, t))
    rows = spark.createDataFrame(data, "item_id long, g int, score double, truth boolean, logf double")
    kept = rows.select("g", F.col("item_id").cast("string").alias("_u"), F.col("score").alias("_s"), F.col("truth").alias("_y"), F.col("logf").alias("_t"))
    got = {(r["g"], r["b"]): r["gap"] for r in boot.stratified_replicates(kept, 4, 5, ("g",), 15, 0, "md5").collect()}
    drawn = boot.replicates(rows, 15, 0, "item_id")
    by = ("g", "b")
    inner = boot.bands(drawn, "logf", 4, 5, by=by, weight="w").where("auroc is not null").groupBy(*by).agg((F.sum(F.col("n") * F.col("auroc")) / F.sum("n")).alias("within"))
    want = {(r["g"], r["b"]): r["auroc"] - r["within"] for r in ranks.auroc(drawn, by, weight="w").join(inner, list(by)).collect()}
    assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)
    one = boot.stratified(rows.unionByName(rows.limit(1).withColumn("logf", F.lit(None).cast("double"))), "logf", n_boot=15, by=("g",)).collect()
    assert len(one) == 2 and all(r["lo"] <= r["hi"] for r in one)


def test_shared_edges_are_drawn_once_and_others_are_found(spark, monkeypatch):
    """Groups of few values whose edges stand, move in some replicates, or move in all; the edges' pass gets no others."""
    rng = np.random.default_rng(3)
    sure, unsure = [0] * 600 + [1] * 300 + [2] * 300 + [3] * 300 + [4] * 500, [0] * 460 + [1] * 560 + [2] * 470 + [3] * 510
    data = [(i, g, float(rng.normal()), bool(rng.integers(2)), float(v)) for g, values in enumerate([[0] * 700 + [1] * 700 + [2] * 600, sure, unsure, rng.normal(size=2000)]) for i, v in enumerate(values)]
    kept = spark.createDataFrame(data, "item_id long, g int, _s double, _y boolean, _t double").withColumn("_u", F.col("item_id").cast("string"))
    asked, edges = [], boot._replicate_edges
    monkeypatch.setattr(boot, "_replicate_edges", lambda rows, qs, by, numbers, *more: asked.append((rows.count(), len(numbers))) or edges(rows, qs, by, numbers, *more))
    drawn = boot.replicates(kept, 40, 0, "item_id")
    for sigmas in (4.0, -1e9):  # whatever is taken for tied, replicates are checked
        asked.clear()
        guessed = boot._guessed
        monkeypatch.setattr(boot, "_guessed", lambda rows, qs, by, s=sigmas: guessed(rows, qs, by, s))
        got = {(r["g"], r["b"]): r["gap"] for r in boot.stratified_replicates(kept, 4, 5, ("g",), 40, 0, "md5").collect()}
        monkeypatch.setattr(boot, "_guessed", guessed)
        inner = boot.bands(drawn, "_t", 4, 5, "_s", "_y", ("g", "b"), "w").where("auroc is not null").groupBy("g", "b").agg((F.sum(F.col("n") * F.col("auroc")) / F.sum("n")).alias("within"))
        want = {(r["g"], r["b"]): r["auroc"] - r["within"] for r in ranks.auroc(drawn, ("g", "b"), "_s", "_y", "w").join(inner, ["g", "b"]).collect()}
        assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in got)
        assert asked and all(rows <= 6000 for rows, _ in asked)  # never those of group 0
    asked.clear()
    boot.stratified_replicates(kept.where("g = 0").drop("g"), 4, 5, (), 40, 0, "md5").collect()
    assert not asked


def test_groups_of_the_same_rows_share_their_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    t = rng.normal(size=300)
    data = [(str(i), g, float(rng.normal()), bool(rng.integers(2)), float(t[i])) for g in range(3) for i in range(300) if g < 2 or i]
    kept = spark.createDataFrame(data, "_u string, g int, _s double, _y boolean, _t double")
    sizes, edges = [], boot._replicate_edges
    monkeypatch.setattr(boot, "_replicate_edges", lambda rows, *more: sizes.append(rows.count()) or edges(rows, *more))
    got = {(r["g"], r["b"]): r["gap"] for r in boot.stratified_replicates(kept, 4, 5, ("g",), 20, 0, "mix").collect()}
    assert sizes == [599] and len(got) == 60  # groups 0 and 1 are looked at once
    for g in range(3):
        own = {r["b"]: r["gap"] for r in boot.stratified_replicates(kept.where(f"g = {g}").drop("g"), 4, 5, (), 20, 0, "mix").collect()}
        assert all(np.isclose(got[g, b], own[b]) for b in own)


def test_cuts_are_counted_by_halving(spark):
    cuts = sorted([1.0, 1.0, 2.0, 5.0, 5.0, 5.0, 9.0])
    for n in (0, 1, 4, 7):
        rows = spark.createDataFrame([(cuts[:n], float(v)) for v in range(11)] + [(cuts[:n], float("nan")), (cuts[:n], None)], "c array<double>, v double")
        got = rows.select("v", ranks.passed(F.col("c"), F.col("v"), 7).alias("upto"), ranks.passed(F.col("c"), F.col("v"), 7, equal=False).alias("below")).collect()
        for r in got:
            v = r["v"]
            assert v is not None or (r["upto"], r["below"]) == (0, 0)
            assert v is None or r["upto"] == sum(not c > v for c in cuts[:n]) and r["below"] == sum(v != v or c < v for c in cuts[:n])
    plan = boot._dealt(spark.range(100).selectExpr("string(id) _u", "double(id) _s"), "_s", "_u")._jdf.queryExecution().analyzed().toString()
    assert "lambdafunction((lambda c" not in plan and "aggregate(" in plan


def test_mixed_weights_are_poisson(spark):
    w = boot.weights([str(i) for i in range(3000)], 200, 1, "mix").astype(float)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.06


# ---- ladders


@pytest.mark.parametrize("design", ladder.DESIGNS)
def test_rungs_are_nested_and_even(spark, design):
    rows = world(spark, 160, n_layers=2)
    got = ladder.listed_rungs(rows, (40, 80, 700), 3, design).toPandas()
    for rep in range(3):
        parts = {r: got[(got["rung"] == r) & (got["rep"] == rep) & (got["layer"] == 0)] for r in (40, 80, 700)}
        assert set(parts[40]["item_id"]) < set(parts[80]["item_id"]) < set(parts[700]["item_id"])
        assert (parts[40].groupby("cell").size() == 10).all() and (parts[80].groupby("cell").size() == 20).all() and len(parts[700]) == 160
        if design == "crossfit":
            assert (parts[80].groupby(["cell", "half"]).size() == 10).all()
    first = [set(got[(got["rung"] == 40) & (got["rep"] == r)]["item_id"]) for r in range(2)]
    assert first[0] != first[1]
    with pytest.raises(ValueError):
        ladder.strata(rows, (40,), design="none")


@pytest.mark.parametrize("design", ladder.DESIGNS)
def test_ladders_find_the_planted_truth(spark, design):
    rows = world(spark, 600, n_layers=1)
    got = ladder.mass_mean_ladder(rows, (200, 600), 2, design).collect()
    assert {(r["rung"], r["rep"], r["n"]) for r in got} == {(n, i, n) for n in (200, 600) for i in range(2)}
    assert all(r["recoverability"] > 0.15 and r["off_diagonal"] < 0.6 for r in got)
    own = fitted.ladder(rows, (200, 600), 1, design=design).collect()
    assert {(r["rung"], r["n"]) for r in own} == {(200, 200), (600, 600)} and all(r["recoverability"] > 0.15 for r in own)


def test_gradients_alone_find_the_same_weights(spark):
    rows = world(spark, 300, n_layers=3)
    want = {r["layer"]: r["weights"] for r in fitted.logistic(rows, l2=1.0, steps=25).collect()}
    got = {r["layer"]: r["weights"] for r in fitted.logistic_by_gradients(rows, l2=1.0).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-6) for k in got)
    one = fitted.logistic_by_gradients(rows.where("layer = 1"), (), l2=1.0).first()["weights"]
    assert np.allclose(one, want[1], atol=1e-6)
    assert fitted.logistic_by_gradients(rows.where("false")).count() == 0


def test_long_vectors_go_by_gradients(spark, monkeypatch):
    monkeypatch.setattr(fitted, "NEWTON", 4)
    called = []
    real = fitted.logistic_by_gradients
    monkeypatch.setattr(fitted, "logistic_by_gradients", lambda *a: called.append(1) or real(*a))
    fitted.logistic(world(spark, 60, n_layers=1)).collect()
    assert called


# ---- clusters


def fold(texts, alike):
    reps, labels = [], []
    for t in texts:
        hit = next((i for i, r in enumerate(reps) if alike(t, r) and alike(r, t)), None)
        if hit is None:
            reps.append(t)
            hit = len(reps) - 1
        labels.append(hit)
    return labels


@pytest.mark.parametrize("held", [4096, 0, 5])
def test_first_match_follows_the_order(spark, held):
    rng = np.random.default_rng(2)
    words = ["a", "b", "c", "d", "e"]
    rows = [(c, i, " ".join(rng.choice(words, rng.integers(0, 5)))) for c in range(6) for i in range(4 * (c + 1))] + [(0, 99, None), (7, 0, "A, b!"), (7, 1, "b a"), (7, 2, "a"), (7, 3, "a")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, text string").repartition(3)
    got = {(r["conv_id"], r["text"]): (r["label"], r["times"]) for r in clusters.first_match(df, clusters.covers(0.5), held=held).collect()}

    def covers(a, b):
        wa, wb = ({w for w in "".join(x for x in t.lower() if x.isalnum() or x == " ").split()} for t in (a, b))
        return not wa if not wb else 2 * len(wa & wb) >= len(wb)

    for c in {r[0] for r in rows}:
        texts = [t for _, _, t in sorted((r for r in rows if r[0] == c and r[2] is not None), key=lambda r: r[1])]
        for t, label in zip(texts, fold(texts, covers)):
            assert got[c, t] == (label, texts.count(t))
    one = clusters.cluster_entropy(df.where("conv_id = 7"), clusters.covers(1.0), held=held).first()
    assert (one["n"], one["n_clusters"]) == (4, 2) and abs(one["entropy"] - np.log(2)) < 1e-12


# ---- tensors


def test_tensors_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(50, 3, 4)).astype("<f2")
    acts = spark.createDataFrame([(i, j, x[i, j].astype(float).tolist()) for i in range(50) for j in range(3)], "row long, layer int, vec array<double>").repartition(4)
    path = str(tmp_path / "store")
    assert tensors.store(acts, path, rows_per_block=16) == 50
    for options in ({}, {"rows_per_task": 7}):
        got = np.array([r["vec"] for r in tensors.read(spark, path, 50, **options).orderBy("row", "layer").collect()])
        assert np.array_equal(got.reshape(50, 3, 4), x.astype(float))
    some = tensors.read(spark, path, layers=(2,)).orderBy("row").collect()
    assert [r["layer"] for r in some] == [2] * 50 and np.array_equal([r["vec"] for r in some], x[:, 2].astype(float))
    one = tensors.read(spark, path).where("layer = 1").orderBy("row")
    assert "PythonDataSource" not in one.columns and np.array_equal([r["vec"] for r in one.collect()], x[:, 1].astype(float))
    np.save(tmp_path / "plain.npy", x)
    assert tensors.read(spark, str(tmp_path / "plain.npy"), 50).count() == 150


def test_tensors_that_do_not_fit_are_refused(spark, tmp_path):
    x = np.zeros((5, 2, 3), "<f4")
    np.save(tmp_path / "plain.npy", x)
    with pytest.raises(Exception, match="holds 5 rows, not 6"):
        tensors.read(spark, str(tmp_path / "plain.npy"), 6).count()
    acts = spark.createDataFrame([(i, j, [1.0]) for i in (0, 1, 3) for j in range(2)], "row long, layer int, vec array<double>")
    with pytest.raises(Exception, match="gap"):
        tensors.store(acts, str(tmp_path / "gap"))
    with pytest.raises(Exception, match="lack"):
        tensors.store(acts.where("row < 2 and not (row = 1 and layer = 0)"), str(tmp_path / "lack"))
    path = str(tmp_path / "changed")
    tensors.store(acts.where("row < 2"), path)
    np.save(f"{path}/block-000000000000.npy", np.zeros((1, 2, 1), "<f2"))
    with pytest.raises(Exception, match="manifest"):
        tensors.read(spark, path).count()


# ---- transfer


def test_transfer_names_are_text(spark):
    """Numeric topics stand beside other names in one column."""
    rows = world(spark, 120, n_layers=1).drop("layer").withColumn("entity", F.col("item_id").cast("string")).withColumn("topic", F.col("item_id") % 2)
    got = audit.transfer(rows.where("item_id < 60"), rows.where("item_id >= 60"), assembled.mass_mean, reps=1, n_boot=5).collect()
    assert {(r["check"], r["name"]) for r in got} >= {("split", "held out"), ("topic", "0"), ("topic", "1"), ("corpus", "off"), ("size", "draw 0")}


# ---- layouts


def statements(spark, n=60, layers_=4):
    from probelens.functions import text
    from probelens.operators import layouts

    rng = np.random.default_rng(4)
    rows = [(i, f"City{i}", f"Land{rng.integers(9)}", bool(i % 2), ["TT", "TA", "FT", "FA"][(0 if i % 2 else 2) + i // 2 % 2], "cities", float(i % 5)) for i in range(n)]
    items = spark.createDataFrame(rows, "item_id long, subject string, object string, truth boolean, cell string, topic string, logf double")
    items = items.withColumn("text", text.instantiate("cities", F.col("subject"), F.col("object"))).withColumn("negated", text.negate(F.col("text")))
    acts = layouts.text_vectors(items.select("item_id", "truth", "cell", "topic", "logf", "text"), dimensions=8, layers=layers_)
    return acts, layouts.text_vectors(items.select("item_id", "negated"), "negated", 8, layers_)


def test_layouts(spark):
    from probelens.operators import layouts

    acts, negated = statements(spark)
    plain = layouts.prepared(layouts.loaded("mass_mean"), acts, 1)
    assert plain.count() == 60 and {len(r["vec"]) for r in plain.collect()} == {8}
    both = layouts.prepared(layouts.loaded("ttpd"), acts, 1, negated).join(plain.select("item_id", F.col("vec").alias("own")), "item_id").collect()
    assert len(both) == 60 and all(len(r["vec"]) == 16 and r["vec"][:8] == r["own"] and r["vec"][8:] != r["own"] for r in both)
    taps = layouts.prepared(layouts.loaded("drift"), acts).collect()
    assert {len(r["vec"]) for r in taps} == {32} and "topic" in taps[0]
    for name, missing in (("ccs", (acts, 1)), ("ttpd", (acts.drop("topic"), 1, negated))):
        with pytest.raises(ValueError):
            layouts.prepared(layouts.loaded(name), *missing)
    with pytest.raises(ValueError):
        layouts.prepared(layouts.loaded("mass_mean"), acts.where("false"))


def test_probes_are_loaded_by_path(spark):
    from probelens.operators import layouts

    kind = layouts.loaded("probelens.operators.assembled:mass_mean")
    assert kind.run is assembled.mass_mean and not kind.paired
    with pytest.raises(KeyError):
        layouts.loaded("none")
    with pytest.raises(TypeError):
        layouts.loaded("probelens.operators.assembled:PROBES")
    with pytest.raises(ModuleNotFoundError):
        layouts.loaded("no_such_module:probe")
    acts, negated = statements(spark)
    got = layouts.swept(("probelens.operators.assembled:mass_mean", "ccs", "drift"), acts, negated, (0, 1)).groupBy("probe", "layer").count().collect()
    assert {(r["probe"], r["layer"]): r["count"] for r in got} == {("probelens.operators.assembled:mass_mean", 0): 60, ("probelens.operators.assembled:mass_mean", 1): 60, ("ccs", 0): 60, ("ccs", 1): 60, ("drift", None): 60}


def test_text_vectors(spark):
    import hashlib

    from probelens.operators import layouts

    df = spark.createDataFrame([(1, "The cat. The CAT!"), (2, ""), (3, None)], "item_id long, text string")
    got = {(r["item_id"], r["layer"]): r["vec"] for r in layouts.text_vectors(df, dimensions=4, layers=2).collect()}
    for layer, grams in ((0, ["the", "cat", "the", "cat"]), (1, ["the cat", "cat the", "the cat"])):
        want = np.zeros(4)
        for g in grams:
            h = int(hashlib.md5(f"vec:{g}".encode()).hexdigest()[:8], 16)
            want[h % 4] += 1 - 2 * (h // 65536 % 2)
        assert np.allclose(got[1, layer], want / np.sqrt(len(grams)))
    assert got[2, 0] == got[3, 1] == [0.0] * 4


# ---- corpora, frames


def test_every_place_gets_a_wrong_object(spark):
    """Subjects that are true of nearly every object still get one that is not."""
    from probelens.functions import text
    from probelens.operators import corpora

    rows = [("cities", f"S{i}", f"Land{j}") for i in range(12) for j in range(12) if (i + j) % 12 != 0]
    said = spark.createDataFrame(rows, "topic string, subject string, object string").select("topic", text.instantiate("cities", F.col("subject"), F.col("object")).alias("statement"), F.lit(1).alias("label"))
    got = corpora.swap_candidates(said).where("not truth and edited").collect()
    true = {(s, o) for _, s, o in rows}
    assert got and all(tuple(r["entities"]) not in true for r in got)
    n = len(rows)
    assert corpora.swap_candidates(said).where("truth and edited").count() + len(got) > n // 4


def test_violins(spark):
    from probelens.operators import frames

    rng = np.random.default_rng(0)
    data = [("a", float(x)) for x in rng.normal(size=300)] + [("b", float(x)) for x in rng.normal(3, 2, size=200)] + [("c", 1.0), ("c", None), ("c", float("nan"))]
    got = frames.violins(spark.createDataFrame(data, "cell string, v double"), "v", bins=30).toPandas()
    v = np.array([x for _, x in data if x is not None and x == x])
    edges = np.linspace(v.min(), v.max(), 31)
    for cell, n in (("a", 300), ("b", 200), ("c", 1)):
        own = np.array([x for c, x in data if c == cell and x is not None and x == x])
        part = got[got["cell"] == cell].sort_values("bin")
        want, _ = np.histogram(own, edges)
        assert (part["n"].to_numpy() == want).all() and part["n"].sum() == n
        h, mid = (own.std(ddof=1) * n**-0.2 if n > 1 else edges[1] - edges[0]), (edges[1:] + edges[:-1]) / 2
        density = (want * np.exp(-0.5 * ((mid[:, None] - mid) / h) ** 2)).sum(1) / (n * h * np.sqrt(2 * np.pi))
        assert np.allclose(part["density"], density) and np.allclose(part["x"], mid)
    assert frames.violins(spark.createDataFrame([], "cell string, v double"), "v").count() == 0


def test_dissociation_spectrum_and_cache(spark):
    from probelens.operators import frames

    rows = spark.createDataFrame([("m1", "FA", 0.9, 0.1), ("m1", "FT", 0.8, 0.2), ("m2", "FA", 0.4, 0.15), ("m3", "FA", 0.4, None), ("m4", "FT", 0.1, 0.1)], "model string, cell string, probe double, behaviour double")
    assert {(r["model"], r["cell"], round(r["apart"], 6)) for r in frames.dissociations(rows).collect()} == {("m1", "FA", 0.8), ("m1", "FT", 0.6)}
    reads = spark.createDataFrame([("org/M1", 0.9), ("M2", 0.8)], "model string, frequency_read double")
    audits = spark.createDataFrame([("m1", 1, 1, 0.7), ("m1", 0, 1, 0.6), ("other/m3", 1, 1, 0.5)], "model string, layer int, headline_layer int, headline double")
    assert [tuple(r) for r in frames.spectrum(reads, audits).collect()] == [("m1", 0.9, 0.7)]
    freq = spark.createDataFrame([(None,), (0,), (2,), (5,), (6,)], "cnt int")
    assert tuple(frames.cache_summary(freq).first()) == (5, 1, 1, 3, 5.0)
    assert tuple(frames.cache_summary(freq.where("cnt is null")).first()) == (1, 1, 0, 0, None)


def test_axis_agreement(spark):
    rows = spark.createDataFrame([(float(i), float(i * i) if i != 3 else None) for i in range(8)] + [(None, 1.0)], "x double, y double")
    got = ranks.axis_agreement(rows, "x", "y").first()
    assert got["n"] == 7 and abs(got["rho"] - 1) < 1e-12 and got["p"] < 1e-9 and abs(got["coverage"] - 7 / 9) < 1e-12
    rng = np.random.default_rng(0)
    x = rng.normal(size=30)
    y = x + rng.normal(size=30) * 2
    got = ranks.axis_agreement(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double"), "x", "y").first()
    assert 0 < got["p"] < 1


def test_three_verdicts(spark):
    """Usable with canaries, usable by data alone, not usable: duplicates are found in real texts."""
    from probelens.operators import gates

    checks = spark.createDataFrame([("a", True, 1.0), ("b", True, None)], "gate string, pass boolean, metric double")
    assert gates.verdict_of(checks, True).first()["verdict"] == "USABLE"
    assert gates.verdict_of(checks, False).first()["verdict"] == "USABLE (data-only checks)"
    same = spark.createDataFrame([(1, "x"), (2, "x")], "item_id long, text string")
    assert gates.verdict_of(checks.unionByName(gates.duplicates(same, "text")), True).first()["verdict"] == "CONFOUNDED / UN-BUILDABLE"


def test_tap_layers_are_the_taps(spark):
    rows = spark.range(1, 60).select(F.col("id").cast("int").alias("n"))
    assert all(tuple(r["t"]) == assembled.taps(r["n"]) for r in rows.select("n", assembled.tap_layers(F.col("n")).alias("t")).collect())


def test_missing_scores_are_neither_null_nor_nan(spark):
    data = [(i, i % 2 == 0, float("nan") if i % 7 == 0 else None if i % 11 == 0 else float(i % 5)) for i in range(200)]
    rows = spark.createDataFrame(data, "item_id long, truth boolean, score double")
    kept = spark.createDataFrame([r for r in data if r[2] is not None and r[2] == r[2]], rows.schema)
    for got, want in ((f(rows), f(kept)) for f in (ranks.auroc, lambda x: boot.auroc_ci(x, (), 50), lambda x: ranks.spearman(x, "score", "item_id"), lambda x: ranks.cliffs_delta(x, (), "score", "truth"))):
        assert got.first() == want.first()


def test_layer_report_and_mechanism(spark):
    rng = np.random.default_rng(8)
    models = [f"org/m{i}" for i in range(6)]
    rec = {m: float(rng.random()) for m in models}
    data = [(m, p, layer, float(rng.uniform(0.7, 1)), rec[m] + 0.1 * float(rng.random()) if p == "a" else float(rng.random())) for m in models for p in "ab" for layer in range(5)]
    data += [("org/m0", "a", 9, None, 0.5), ("org/headless", "a", 0, 0.9, 0.4)]
    curves = spark.createDataFrame(data, "model string, probe string, layer int, in_dist double, off double")
    heads = spark.createDataFrame([(m, i % 5) for i, m in enumerate(models)], "model string, headline_layer int")
    report = reports.layer_report(curves, heads, 0.85, 0.05)
    got = {(r["model"], r["probe"]): r for r in report.collect()}
    assert len(got) == 13
    for (m, p), r in got.items():
        own = [x for x in data if x[:2] == (m, p) and x[3] is not None]
        best = max(x[3] for x in own)
        tied = [x for x in own if x[3] >= best - 0.05 - 1e-12]
        med = float(np.median([x[4] for x in tied]))
        assert r["n_tied"] == len(tied) and abs(r["selected_off"] - med) < 1e-12
        assert r["selected_layer"] == min((round(abs(x[4] - med), 12), x[2]) for x in tied)[1]
        if m == "org/headless":
            assert r["headline_off"] is None and r["moved"] is None and not r["powered"]
        else:
            head = next(x for x in own if x[2] == models.index(m) % 5)
            assert (r["headline_layer"], r["headline_in"], r["headline_off"], r["powered"]) == (head[2], head[3], head[4], head[3] >= 0.85)
    names = spark.createDataFrame([("other/" + m.split("/")[1].upper(), rec[m]) for m in models], "name string, rec double")
    found = {(r["probe"], r["rule"], r["subset"]): r for r in reports.mechanism_by_probe(report, names, 200).collect()}
    for (p, rule, subset), r in found.items():
        own = [(rec[m], got[m, p][f"{rule}_off"]) for m in models if subset == "all" or got[m, p]["powered"]]
        assert r["n"] == len(own) >= 3 and abs(r["r"] - np.corrcoef(*zip(*own))[0, 1]) < 1e-9 and r["lo"] <= r["hi"] and 0 < r["n_boot"] <= 200
    assert {(p, rule, "all") for p in "ab" for rule in ("headline", "selected")} <= set(found)
    assert {k for k in found if k[2] == "powered"} == {(p, rule, "powered") for p in "ab" for rule in ("headline", "selected") if sum(got[m, p]["powered"] for m in models) >= 3}
    assert found["a", "headline", "all"]["r"] > 0.9
    assert reports.mechanism_by_probe(report.where("false"), names, 20).count() == 0


def test_text_vectors_hash_each_run_once(spark):
    import hashlib

    from probelens.operators import layouts

    texts = ["", "  ", None, "a", "Hello, World", "x y", "one two three four five six", "w" * 80 + " q"]
    got = layouts.text_vectors(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), dimensions=4, layers=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "h32" not in plan and "md5" not in plan
    for r in got.collect():
        words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in (texts[r["id"]] or "").lower()).split()]
        runs = [" ".join(words[i : i + r["layer"] + 1]) for i in range(max(1, len(words) - r["layer"]))] if words else []
        want = np.zeros(4)
        for t in runs:
            h = int.from_bytes(hashlib.md5(b"vec:" + t.encode()).digest()[:4])
            want[h % 4] += 1 - 2 * (h >> 16 & 1)
        assert np.allclose(r["vec"], want / np.sqrt(max(1, len(runs))))


def test_crossed_corpus_of_parts_that_share_names(spark, tmp_path):
    from probelens.plans import audits

    parts = [(i, ["hot gizmo", "red bolt"][i // 7 % 2], ["STEEL", "TIN", "BRASS"][i // 14 % 3]) for i in range(4000)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    got = audits.QUERIES["crossed_corpus"](spark, str(tmp_path)).groupBy("domain", "cell", "edited").count().collect()
    assert len(got) == 8 * len({r["domain"] for r in got}) and len({(r["domain"], r["count"]) for r in got}) == len({r["domain"] for r in got}) > 0


def test_small_groups_have_few_buckets_and_models_are_sent(spark):
    rows = spark.range(2000).selectExpr("cast(id as string) _u", "id % 40 g", "double(hash(id)) _s", "id % 3 = 0 _y")
    assert boot._dealt(rows, "_s", "_u", ("g",)).select("g", "_b").distinct().count() <= 3 * 40
    models = spark.createDataFrame([(0, [1.0, 0.0])], "layer int, weights array<double>")
    acts = spark.createDataFrame([(0, [2.0])] * 5, "layer int, vec array<double>")
    assert "hashpartitioning" not in fitted.with_scores(acts, models)._jdf.queryExecution().executedPlan().toString()
