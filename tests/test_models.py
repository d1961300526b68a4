import numpy as np
import pytest
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.operators import holdout, models, regression, reporting, symbolic
from compoundry.streaming import read_activity_stream, write_annotated


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 4))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=150) + 1
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(150)]
    df = spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y double").cache()
    return x, y, df


def test_least_squares_and_statistics(spark, data):
    x, y, df = data
    m = linalg.moments(df, ["a", "b", "c", "d", "y"])
    t = {r["term"]: r for r in regression.coefficient_table(spark, m, [0, 1, 2, 3], 4).collect()}
    x1 = np.column_stack([np.ones(150), x])
    beta = np.linalg.lstsq(x1, y, rcond=None)[0]
    s2 = ((y - x1 @ beta) ** 2).sum() / 145
    se = np.sqrt(np.diag(np.linalg.inv(x1.T @ x1)) * s2)
    assert [t[k]["coefficient"] for k in ("intercept", "a", "b", "c", "d")] == pytest.approx(beta)
    assert [t[k]["std_error"] for k in ("intercept", "a", "b", "c", "d")] == pytest.approx(se)
    assert t["a"]["p_value"] < 1e-10 and t["a"]["vif"] == pytest.approx(1, abs=0.2)


def test_cross_validation_from_products_equals_refitting(spark, data):
    x, y, df = data
    cv = regression.cross_validation(df, ["a", "b", "c", "d"], "y", "id", 4, 1)
    fold = {r["id"]: r["fold"] for r in regression.with_fold(df, "id", 4, 1).collect()}
    f = np.array([fold[i] for i in range(150)])
    r2, rmse, sse = [], [], 0
    for k in range(4):
        tr, te = f != k, f == k
        x1 = lambda m: np.column_stack([np.ones(m.sum()), x[m][:, [0, 2]]])
        res = y[te] - x1(te) @ np.linalg.lstsq(x1(tr), y[tr], rcond=None)[0]
        r2.append(1 - (res ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        rmse.append(np.sqrt((res ** 2).mean()))
        sse += (res ** 2).sum()
    assert cv.scores([0, 2]) == pytest.approx((np.mean(r2), np.mean(rmse)))
    assert cv.pooled([0, 2])[0] == pytest.approx(1 - sse / ((y - y.mean()) ** 2).sum())


@pytest.mark.parametrize("method", ["forward", "backward", "montecarlo", "ga"])
def test_selection_finds_the_signal(data, method):
    cv = regression.cross_validation(data[2], ["a", "b", "c", "d"], "y", "id", 5)
    sel = regression.select(cv, regression.SelectionConfig(method=method, criterion="bic", draws=80, population=12, generations=8))
    assert sel.names == ["a", "b"]


def test_penalised_fits(data):
    x, y, df = data
    m = linalg.moments(df, ["a", "b", "c", "d", "y"])
    z = (x - x.mean(0)) / x.std(0)
    ridge = regression.fit_ridge(m, [0, 1, 2, 3], 4, 5.0)
    want = np.linalg.solve(z.T @ z + 5 * np.eye(4), z.T @ (y - y.mean())) / x.std(0)
    assert ridge.coef == pytest.approx(want)
    full = regression.fit_pls(m, [0, 1, 2, 3], 4, 4)
    assert full.coef == pytest.approx(regression.fit_linear(m, [0, 1, 2, 3], 4).coef, abs=1e-6)
    net = regression.fit_elastic_net(m, [0, 1, 2, 3], 4, 0.5, 1.0)
    w = net.coef * x.std(0)
    grad = z.T @ (y - y.mean() - z @ w) / 150
    assert np.all(np.abs(grad) <= 0.5 + 1e-6) and np.allclose(grad[w != 0], 0.5 * np.sign(w[w != 0]))


def test_principal_axes(data):
    x, _, df = data
    p = regression.principal_axes(df, ["a", "b", "c"], 2)
    c = x[:, :3] - x[:, :3].mean(0)
    s = np.linalg.svd(c, compute_uv=False)
    assert p.explained == pytest.approx((s ** 2 / (s ** 2).sum())[:2])
    got = np.array([[r["PC1"], r["PC2"]] for r in p.scores(df).orderBy("id").collect()])
    assert np.abs(got[:, 0]).sum() == pytest.approx(np.abs(c @ p.axes[0]).sum()) and got.mean(0) == pytest.approx([0, 0], abs=1e-9)


def test_training_and_bundle(spark, data, tmp_path):
    _, _, df = data
    res = models.train(df, "y", "id", "ridge", ["a", "b", "c", "d"])
    got = {(r["group"], r["metric"]): r["value"] for r in res.metrics.collect()}
    assert got[("test", "r2")] > 0.98 and got[("cross_validation", "n")] == 150 and got[("train", "n")] == 120
    models.save_model(res.model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    a = res.model.predict(df).agg(F.sum("predicted")).first()[0]
    assert again.predict(df).agg(F.sum("predicted")).first()[0] == pytest.approx(a)
    tree = models.fit(df, "random_forest", ["a", "b"], "y", {"numTrees": 5})
    models.save_model(tree, str(tmp_path / "t"))
    assert models.load_model(str(tmp_path / "t")).predict(df).count() == 150
    method, values = models.importance(df, tree, ["a", "b"], "y")
    assert method == "model_importance" and values["a"] > values["b"]
    assert models.importance(df, res.model, ["a", "b", "c", "d"], "y", "permutation")[1]["a"] > 0.5


def test_prediction_packaging(spark, data):
    model = models.fit(data[2], "linear", ["a", "b"], "y")
    q = spark.createDataFrame([(1, 1.0, 2.0), (2, None, None)], "id int, source_a double, b double")
    out, report = models.package_predictions(model, q, "")
    assert {r["id"]: r["prediction_status"] for r in out.collect()} == {1: "ok", 2: "failed"} and "predicted_value" in out.columns
    assert {r["feature"]: r["source"] for r in report.collect()} == {"a": "alias of source_a", "b": "present"}


def test_model_ranking(data):
    ranking = models.model_ranking(data[2], "y", "id", ["a", "b", "c", "d"])
    assert ranking[0]["rank"] == 1 and ranking[0]["cv_r2"] >= ranking[-1]["cv_r2"] and ranking[0]["cv_r2"] > 0.99


def test_permutation(data):
    r = regression.permutation_test(data[2], ["a", "b"], "y", "id", 3)
    assert r["q2_observed"] > 0.9 and max(r["q2_permuted"]) < 0.3 and r["p_value"] == pytest.approx(0.25)


def test_symbolic(data):
    df = data[2].withColumn("z", 2 * F.col("a") * F.col("b") - F.col("c") * F.col("c") + 0.5)
    fit = symbolic.fit_symbolic(df, ["a", "b", "c", "d"], "z", "id")
    assert set(fit.terms[:2]) == {"a*b", "c^2"} and fit.train_r2 > 0.999 and fit.text.startswith("z = 0.5")
    worst = fit.predict(df).agg(F.max(F.abs(F.col("z") - F.col("symbolic_prediction")))).first()[0]
    assert worst < 1e-6


def test_report(spark, data, tmp_path):
    df = data[2].withColumnRenamed("y", "activity")
    metrics = spark.createDataFrame([("test", "r2", 0.85), ("cv", "r2", 0.7)], "split string, metric string, value double")
    pred = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9)], "observed double, predicted double")
    dom = spark.createDataFrame([(True,), (False,)], "in_domain boolean")
    r = reporting.build_report(df, metrics, pred, dom)
    assert dict((i, s) for i, s, _ in r.flags)["Applicability domain"] == "ok" and r.summary["coverage"] == 0.5 and r.summary["test_r2"] == 0.85
    assert "<table>" in r.html and "strong" in r.markdown
    assert set(reporting.write_report(r, str(tmp_path / "rep"))) == {"markdown", "html", "summary"}
    wide = reporting.metric_table(spark.createDataFrame([(0.5, 1.0, "x")], "r2_test double, train_rmse double, note string"))
    assert {tuple(r) for r in wide.collect()} == {("test", "r2", 0.5), ("train", "rmse", 1.0)}
    assert reporting.pick_metric(wide, ["R_2"], ["external"]) == 0.5 and reporting.pick_metric(wide, ["mae"], []) is None
    many = spark.range(1000).selectExpr("'cv' as split", "concat('m', id) as metric", "cast(id as double) as value").union(metrics)
    assert reporting.build_report(metrics=many).summary["test_r2"] == 0.85


def test_stream_of_records(spark, tmp_path):
    from compoundry.operators.curation import CurationConfig

    src = spark.createDataFrame([(0, "CCO", 10.0), (1, "", 5.0)], "row_index int, smi string, ic50 double")
    src.write.parquet(str(tmp_path / "in"))
    q = write_annotated(read_activity_stream(spark, str(tmp_path / "in"), src.schema), CurationConfig(smiles="smi", activity="ic50"),
                        str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = {r["row_index"]: r["reject_reasons"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {0: "", 1: "missing_smiles"}


def test_masked_correlations(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4))
    x[:, 1] = x[:, 0] * 2 + 100 + 0.01 * x[:, 1]
    rows = [[float(v) if rng.random() > 0.2 else None for v in r] + [0.1] for r in x]
    from compoundry.operators import descriptors

    got = descriptors.correlation_pairs(spark.createDataFrame(rows, "a double, b double, c double, d double, e double"), ["a", "b", "c", "d", "e"], 0.0).collect()
    table = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for r in got:
        i, j = "abcde".index(r["descriptor_a"]), "abcde".index(r["descriptor_b"])
        both = ~np.isnan(table[:, i]) & ~np.isnan(table[:, j])
        assert r["correlation"] == pytest.approx(np.corrcoef(table[both, i], table[both, j])[0, 1])
    assert len(got) == 6


@pytest.mark.parametrize("block", [3, 128])
def test_blocked_correlation_screening(spark, block):
    from compoundry.functions import linalg
    from compoundry.operators import descriptors
    from compoundry.operators.correlation import correlated_columns, high_correlation_columns

    rng = np.random.default_rng(6)
    base = rng.standard_normal((200, 4))
    x = np.c_[base, base[:, :3] + 0.05 * rng.standard_normal((200, 3)), base[:, 1:3] * 3 + 1e6, np.full(200, 5.0)]
    cols = [f"f{i}" for i in range(x.shape[1])]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *map(float, x[0, 1:]))], ", ".join(f"{c} double" for c in cols)).repartition(5)
    pairs, _ = correlated_columns(df, cols, 0.9, block)
    with np.errstate(invalid="ignore"):
        r = np.nan_to_num(np.corrcoef(x.T))
    got = {(t["a"], t["b"]): t["r"] for t in pairs.collect()}
    want = {(i, j): r[i, j] for i in range(len(cols)) for j in range(i + 1, len(cols)) if abs(r[i, j]) >= 0.9}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
    m = linalg.moments(df, cols)
    for prefer in ("variance", "first"):
        kept = [t["feature"] for t in high_correlation_columns(df, cols, 0.9, prefer, block).orderBy("position").collect() if t["kept"]]
        assert kept == descriptors.drop_high_correlation(m, 0.9, prefer)
    assert correlated_columns(df.where("1 = 0"), cols, 0.9, block)[0].count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 1024])
def test_keyed_permutations(spark, n):
    from compoundry.functions.shuffle import permuted

    rows = spark.range(n).select("id", *[permuted(F.col("id"), n, F.lit(k)).alias(f"p{k}") for k in (1, 2, 77)]).collect()
    for k in (1, 2, 77):
        assert sorted(r[f"p{k}"] for r in rows) == list(range(n))
    if n > 90:
        assert sum(r["p1"] == r["id"] for r in rows) < 10 and sum(r["p1"] == r["p2"] for r in rows) < 10
        assert abs(np.corrcoef([r["id"] for r in rows], [r["p1"] for r in rows])[0, 1]) < 0.3


def test_permuted_targets_keep_every_value(spark):
    df = spark.createDataFrame([(i * 3, float(i % 5), float(i)) for i in range(50)], "id long, x double, y double")
    rows = regression.permuted_targets(df, ["x"], "y", "id", 4, seed=9).collect()
    assert len(rows) == 200
    for run in range(1, 5):
        mine = [r for r in rows if r["_run"] == run]
        assert sorted(r["y"] for r in mine) == [float(i) for i in range(50)] and {r["id"] for r in mine} == {i * 3 for i in range(50)}


def test_training_only_chain(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.2 * rng.normal(size=300)
    split = np.array(["train"] * 200 + ["test"] * 60 + ["external"] * 40)
    gone = rng.random(300) < 0.1
    rows = [(i, None if gone[i] else float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(1.5 * x[i, 1]), 1.0 if i < 200 else float(i),
             str(x[i, 2]) if i % 3 == 0 else "n/a", str(split[i]), None if i in (3, 250) else float(y[i]), "kept") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, b15 double, flat double, text string, split string, y double, _p0 string")
    names = ["a", "b", "c", "b15", "flat", "text"]
    chain, metrics = holdout.run(df, names, "y", "id", "split")
    assert chain.dropped == {"b": "correlated", "flat": "constant", "text": "missing"} and chain.features == ["a", "c", "b15"] and chain.n_train == 199
    use = np.array([i for i in range(200) if i != 3])
    fill = x[use, 0][~gone[use]].mean()
    full = np.column_stack([np.ones(300), np.where(gone, fill, x[:, 0]), x[:, 2], 1.5 * x[:, 1]])
    beta = np.linalg.lstsq(full[use], y[use], rcond=None)[0]
    assert chain.fills["a"] == pytest.approx(fill) and [chain.intercept, *chain.coefficients] == pytest.approx(beta)
    got = {r["group"]: r for r in metrics.collect()}
    for name in ("train", "test", "external"):
        pick = np.array([i for i in np.flatnonzero(split == name) if i not in (3, 250)])
        assert got[name]["n"] == len(pick) and got[name]["rmse"] == pytest.approx(np.sqrt(((y[pick] - full[pick] @ beta) ** 2).mean()))
    # whatever the other splits hold, the fit stays
    wild = df.withColumn("c", F.when(F.col("split") != "train", F.lit(1e9)).otherwise(F.col("c")))
    assert holdout.run(wild, names, "y", "id", "split")[0].coefficients == pytest.approx(chain.coefficients)
    # unseen rows without a value, or with none that is a number, are scored by the fill
    odd = spark.createDataFrame([("x", None, float("nan")), (None, 0.0, float("inf"))], "a string, c double, b15 double")
    scores = [r["predicted"] for r in chain.predict(odd).collect()]
    by_fill = lambda known: chain.intercept + sum(known.get(c, chain.fills[c]) * w for c, w in zip(chain.features, chain.coefficients, strict=True))
    assert scores == pytest.approx([by_fill({}), by_fill({"c": 0.0})])
    cfg = holdout.ChainConfig(selection=regression.SelectionConfig(max_features=1))
    assert holdout.fit_chain(df.where("split = 'train'"), names, "y", "id", cfg).features == ["a"]
    with pytest.raises(ValueError, match="no training row"):
        holdout.fit_chain(df.where("1 = 0"), names, "y", "id")
    with pytest.raises(ValueError, match="no feature"):
        holdout.fit_chain(df.where("split = 'train'"), ["flat", "text"], "y", "id")


def test_permutation_equals_the_joined_targets(spark, monkeypatch):
    from compoundry.functions import linalg, shuffle

    rng = np.random.default_rng(8)
    rows = [(7 * i, float(rng.normal()) if i % 13 else None, float(i % 5), float("nan") if i == 40 else None if i == 9 else 1e6 + float(rng.normal())) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double").repartition(5)
    joined = regression.with_fold(regression.permuted_targets(df, ["a", "b"], "y", "id", 3, 2), "id", 5, 2, "_fold")
    groups = linalg.moments(joined.withColumn("_g", F.col("_run") * 5 + F.col("_fold")), ["a", "b", "y"], by="_g")
    want = [regression.CrossValidation(["a", "b"], {f: groups[5 * r + f] for f in range(5)}).scores([0, 1])[0] for r in (1, 2, 3)]
    monkeypatch.setattr(regression, "DEALT", 3)
    monkeypatch.setattr(regression, "DEAL_ROWS", 50)

    def no_join(*_):
        raise AssertionError("rows of all runs were joined")

    monkeypatch.setattr(regression, "permuted_targets", no_join)
    got = regression.permutation_test(df, ["a", "b"], "y", "id", 3, 5, 2)
    assert got["q2_permuted"] == pytest.approx(want, abs=1e-9)
    for n in (1, 2, 97, 1000, 12_345):
        at = spark.range(n).select("id", shuffle.permuted(F.col("id"), n, F.lit(5)).alias("p")).toPandas()
        assert (shuffle.returned(at["p"].to_numpy(), n, 5) == at["id"].to_numpy()).all()


def test_boosting_reads_a_vector_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), float(3 * a - b * b + rng.normal())) for a, b in rng.integers(0, 6, (600, 2))]
    df = spark.createDataFrame(rows, "a int, b int, y double")
    seen = []
    by_vector = models._by_vector
    monkeypatch.setattr(models, "_by_vector", lambda d, c: (seen.append(by_vector(d, c)), seen[-1])[1])
    settings = {"maxIter": 5, "maxDepth": 3}
    grouped = models.fit(df, "gradient_boosting", ["a", "b"], "y", settings)
    assert seen[0].count() == len({r[:2] for r in rows}) and seen[0].agg(F.sum("_weight")).first()[0] == 600
    whole = models.fit(df, "gradient_boosting", ["a", "b"], "y", {**settings, "lossType": "squared"})
    assert len(seen) == 1
    pairs = grouped.predict(whole.predict(df, "p"), "q").collect()
    assert [r["q"] for r in pairs] == pytest.approx([r["p"] for r in pairs], abs=1e-6)
