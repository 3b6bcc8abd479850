import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from probelens.functions import intervals
from probelens.operators import fitted, ranks


def planted(spark, n=400, d=6, seed=0):
    """Truth along dimension 0, typicality along dimension 1."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        t, c = bool(rng.random() < 0.5), bool(rng.random() < 0.5)
        x = rng.normal(size=d)
        x[0] += 2 * t
        x[1] += 3 * c
        rows.append((i, 0, t, c, ("T" if t else "F") + ("T" if c else "A"), float(c + rng.normal() / 10), x.tolist()))
    return spark.createDataFrame(rows, "item_id long, layer int, truth boolean, typical boolean, cell string, logf double, vec array<double>")


def test_logistic_is_the_regularised_optimum(spark):
    rows = planted(spark)
    w = np.array(fitted.logistic(rows, l2=0.5, steps=20).first()["weights"])
    got = rows.toPandas()
    x, y = np.column_stack([np.stack(got["vec"]), np.ones(len(got))]), got["truth"].to_numpy(float)
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w))) - np.r_[0.5 * w[:-1], 1e-6 * w[-1]]
    assert np.abs(gradient).max() < 1e-6
    assert np.allclose(w, fitted.logistic(rows, (), l2=0.5, steps=20).first()["weights"])  # no groups
    assert fitted.logistic(rows.where("false")).count() == 0


def test_nulls_are_left_out_of_the_fit(spark):
    rows = planted(spark, 100)
    more = rows.limit(1).withColumn("vec", F.lit(None).cast("array<double>")).unionByName(rows.limit(1).withColumn("truth", F.lit(None).cast("boolean")))
    assert np.allclose(fitted.logistic(rows).first()["weights"], fitted.logistic(rows.unionByName(more)).first()["weights"])


def test_out_of_fold_models_have_not_seen_the_row(spark):
    rows = planted(spark, 200)
    scored = fitted.out_of_fold(rows, k=4).toPandas()
    part = scored[scored["fold"] == 2]
    own = fitted.logistic(rows.join(spark.createDataFrame(scored[scored["fold"] != 2][["item_id"]]), "item_id")).first()["weights"]
    x = np.stack(part["vec"]) @ np.array(own[:-1]) + own[-1]
    assert len(scored) == 200 and np.allclose(part["score"], 1 / (1 + np.exp(-x)))


def test_fielded_scores_follow_frequency_off_the_diagonal(spark):
    off = fitted.fielded(planted(spark)).where(~F.col("cell").isin("TT", "FA"))
    assert ranks.auroc(off).first()["auroc"] < 0.5


def test_erasure_removes_the_planted_axis(spark):
    rows = planted(spark)
    assert ranks.auroc(fitted.out_of_fold(rows, label="typical"), label="typical").first()["auroc"] > 0.9
    erased = fitted.erase(rows, rounds=2)
    assert ranks.auroc(fitted.out_of_fold(erased, label="typical"), label="typical").first()["auroc"] < 0.6
    assert ranks.auroc(fitted.out_of_fold(erased)).first()["auroc"] > 0.8


def test_cross_fitting_and_stability(spark):
    rows = planted(spark)
    got = fitted.cross_fitted(rows).collect()
    assert len(got) == 2 and all(r["recoverability"] > 0.4 for r in got)
    assert fitted.ladder(rows, (100, 300), 2).count() == 4
    s = fitted.fit_stability(rows, 6).first()
    assert s["n"] == 6 and s["lo"] <= s["mid"] <= s["hi"]


def test_frequency_basis_and_reset(spark):
    basis = fitted.frequency_basis(planted(spark), 1)
    assert abs(basis[0][1]) > 0.9
    u = np.array(fitted.random_basis(6, 3))
    assert np.allclose(u @ u.T, np.eye(3))
    df = spark.createDataFrame([([3.0, 4.0],)], "vec array<double>")
    axis = F.array(F.array(F.lit(1.0), F.lit(0.0)))
    assert df.select(fitted.off_subspace(F.col("vec"), axis)).first()[0] == [0.0, 4.0]
    assert df.select(fitted.off_subspace(F.col("vec"), axis, F.array(F.lit(7.0), F.lit(9.0)))).first()[0] == [7.0, 4.0]


def test_eigen_score(spark):
    z = np.random.default_rng(2).normal(size=(4, 3))
    df = spark.createDataFrame([(1, v.tolist()) for v in z] + [(2, [1.0, 2.0, 3.0])], "item_id long, vec array<double>")
    got = {r["item_id"]: r["score"] for r in fitted.eigen_score(df).collect()}
    c = z - z.mean(0)
    assert abs(got[1] - np.log(np.linalg.eigvalsh(c @ c.T / 4).clip(0) + 1e-3).mean()) < 1e-9 and got[2] is None


def test_clopper_pearson(spark):
    assert np.allclose(intervals.binomial_limits(0, 10), (0, 1 - 0.025**0.1)) and np.allclose(intervals.binomial_limits(10, 10), (0.025**0.1, 1))
    lo, hi = intervals.binomial_limits(3, 20)
    assert abs(lo - 0.0320709) < 1e-6 and abs(hi - 0.3789268) < 1e-6 and intervals.binomial_limits(0, 0) == (0, 1)
    row = spark.createDataFrame([(3, 20)], "h int, n int").select(intervals.clopper_pearson(F.col("h"), F.col("n")).alias("c")).first()["c"]
    assert abs(row["lo"] - lo) < 1e-12


def test_erasure_against_its_controls(spark):
    rows = planted(spark, 600).unionByName(planted(spark, 600, seed=4).withColumn("layer", F.lit(1)))
    more = rows.limit(2).withColumn("vec", F.lit(None).cast("array<double>")).unionByName(rows.limit(2).withColumn("cell", F.lit(None).cast("string")))
    got = {(r["layer"], r["design"], r["k"]): r for r in fitted.erasure_study(rows.unionByName(more), (1, 3, 9)).collect()}
    assert len(got) == 2 * (1 + 3 * 3)
    for layer in range(2):
        at = lambda design, k: got[layer, design, k]  # noqa: E731, B023
        assert at("none", 0)["read"] > 0.9 and at("none", 0)["off"] < 0.5 < 0.9 < at("none", 0)["on"]  # follows typicality
        assert at("label", 1)["read"] < 0.6 and at("label", 1)["off"] > 0.75  # truth comes through
        assert at("random", 1)["read"] > 0.8  # a random direction leaves it
        assert at("diagonal", 1)["off"] < at("label", 1)["off"] - 0.05  # takes truth with typicality
        assert all(at(design, 9)[c] < 0.6 for design in ("label", "diagonal", "random") for c in ("read", "on", "off"))  # nothing is left
    one = fitted.erase(rows.where("layer = 0"), 1, steps=4)
    by_hand = ranks.auroc(fitted.fielded(one).where(~F.col("cell").isin("TT", "FA"))).first()["auroc"]
    assert abs(by_hand - got[0, "label", 1]["off"]) < 1e-6


def test_fits_off_directions_are_fits_of_what_is_left(spark):
    rows = planted(spark, 200)
    u = np.array(fitted.random_basis(6, 2, 5))
    cut = rows.withColumn("vec", fitted.off_subspace(F.col("vec"), F.array(*[F.array(*[F.lit(float(x)) for x in v]) for v in u])))
    more, each = (StructField("k", IntegerType()),), ((0,), (1,), (2,))
    got = {r["k"]: np.array(r["weights"]) for r in fitted.logistic(rows, more=more, each=each, off=lambda key: u[: key[1]]).collect()}
    assert np.allclose(got[2], fitted.logistic(cut).first()["weights"], atol=1e-7) and np.allclose(got[0], fitted.logistic(rows).first()["weights"])
    assert np.allclose(u[:1] @ got[1][:-1], 0) and not np.allclose(u[1:] @ got[1][:-1], 0)
    slow = {r["k"]: np.array(r["weights"]) for r in fitted.logistic_by_gradients(rows, more=more, each=each, off=lambda key: u[: key[1]]).collect()}
    assert all(np.allclose(slow[k], got[k], atol=1e-5) for k in range(3))


def test_erasure_rewrites_no_vectors(spark, monkeypatch):
    """Neither in its search nor for each design and k: jobs then took minutes."""

    def never(*a, **k):
        raise AssertionError("vectors are rewritten")

    monkeypatch.setattr(fitted, "off_subspace", never)
    monkeypatch.setattr(fitted, "without", never)
    got = fitted.erasure_study(planted(spark, 120), (1, 2), steps=2)
    assert got.count() == 7 and set(got.columns) == {"layer", "design", "k", "on", "off", "read"}


def test_null_directions_are_orthonormal(spark):
    rows = planted(spark, 300)
    sent, joined = (fitted.without(rows, fitted.null_directions(rows, 3), numbers=n).orderBy("item_id").collect() for n in (18, None))
    u = np.array(fitted.null_directions(rows, 9).first()["basis"])
    assert u.shape == (6, 6) and np.allclose(u @ u.T, np.eye(6), atol=1e-9)
    assert np.allclose([r["vec"] for r in sent], [r["vec"] for r in joined])
    assert np.allclose(np.array([r["vec"] for r in sent]) @ u[:3].T, 0, atol=1e-9)
