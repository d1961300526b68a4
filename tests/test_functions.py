import numpy as np
import pytest
from pyspark.sql import functions as F

from compoundry.functions import linalg, skew, texts, units
from compoundry.functions.missing import is_missing, to_double


def one(spark, expr, **values):
    row = [tuple(values.values())] if values else [(1,)]
    return spark.createDataFrame(row, list(values) or ["x"]).select(expr.alias("r")).first()["r"]


def test_units(spark):
    ki, status = units.log_activity(F.lit("0.5"), F.lit("uM"), "nM")
    assert abs(one(spark, ki) - 6.3010) < 0.02 and one(spark, status) == "converted_from_concentration"
    assert one(spark, units.to_nanomolar(F.lit("1.5"), F.lit("uM"))) == 1500
    assert one(spark, units.to_nanomolar(F.lit(50), F.lit("nM"))) == 50
    assert one(spark, units.to_nanomolar(F.lit("bad"), F.lit("nM"))) is None
    assert one(spark, units.to_nanomolar(F.lit(1), F.lit("mM"))) is None
    assert one(spark, units.record_to_nanomolar(F.lit(1), F.lit("mM"))) == 1e6
    assert one(spark, units.log_activity(F.lit("5"), F.lit(""), "nM")[0]) == pytest.approx(8.30103)
    assert one(spark, units.log_activity(F.lit("5"), F.lit("furlong"), "nM")[1]) == "unsupported_or_missing_unit"
    assert units.is_log_scale_name("pChEMBL Value") and units.is_log_scale_name("p_anything") and not units.is_log_scale_name("value")


def test_missing_and_numbers(spark):
    df = spark.createDataFrame([("1,5",), ("nan",), ("",), ("?",), ("1d",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(to_double(F.col("v"))).collect()]
    assert got == [1.5, None, None, None, None, None, None]
    assert [r[0] for r in df.select(is_missing(F.col("v"))).collect()] == [False, True, True, True, False, False, True]


def test_texts(spark):
    assert one(spark, texts.append_token(F.lit("a | b"), F.lit("b"))) == "a | b"
    assert one(spark, texts.append_token(F.lit("a"), F.lit("c"))) == "a | c"
    assert one(spark, texts.append_step(F.lit("a | b"), F.lit("b"))) == "a | b"
    assert one(spark, texts.append_step(F.lit("b | a"), F.lit("b"))) == "b | a | b"
    cats = {"MolLogP": "physicochemical", "fr_Ar_N": "fragment/count", "Morgan_bit_001": "fingerprint"}
    for name, want in cats.items():
        assert one(spark, texts.descriptor_category(F.lit(name))) == want
    assert one(spark, texts.reaction_text(F.lit("A+B"), F.lit("C.?"))) == "A.B>>C"
    assert one(spark, texts.reaction_text(F.lit("?"), F.lit("C"))) is None
    assert one(spark, texts.safe_identifier(F.lit("log P (o/w)"))) == "log_P__o_w"
    assert one(spark, texts.number_text(F.lit(float("nan")))) == "n/a"
    assert texts.user_pattern("/[/") is None and texts.user_pattern("  ") is None
    assert texts.prediction_column("p IC50") == "predicted_p_IC50"
    assert texts.broadened_query("EGF*", "any") == "EGF" and texts.broadened_query("/./", "any") == "." and texts.broadened_query("**", "any") == "any"


def test_distribution_functions():
    assert linalg.chi2_quantile(0.95, 2) == pytest.approx(5.991464547, abs=1e-8)
    assert linalg.chi2_quantile(0.99, 7) == pytest.approx(18.475306907, abs=1e-7)
    assert linalg.t_two_sided_p(2.228138852, 10) == pytest.approx(0.05, abs=1e-8)


def test_group_rank_with_a_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 7}", i * 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = {(r["k"], r["o"]): (r["rank"], r["n"]) for r in skew.with_group_rank(df, ["k"], "o", "rank", "n", chunk=40).collect()}
    by = {}
    for k, o in sorted(rows, key=lambda r: r[1]):
        by.setdefault(k, []).append(o)
    assert got == {(k, o): (i + 1, len(v)) for k, v in by.items() for i, o in enumerate(v)}


def test_global_rank(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v)) for i, v in enumerate(rng.choice([0.0, 1.0, 2.5], 300))] + [(300 + i, float(x)) for i, x in enumerate(rng.normal(size=200))]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = {r["id"]: r["r"] for r in skew.with_global_rank(df, "v", "id", "r", buckets=8, chunk=32).collect()}
    want = {i: k + 1 for k, (i, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert got == want


def test_global_rank_keeps_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0), (4, None)], "id bigint, v double")
    assert {r["id"]: r["r"] for r in skew.with_global_rank(df, "v", "id", "r").collect()} == {3: 1, 1: 2, 2: 3, 4: 4}


def test_quantiles_hot_and_plain_agree(spark):
    rng = np.random.default_rng(2)
    rows = [("a" if i % 4 else "b", float(rng.choice([1.0, rng.normal()]))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, v double")
    q = {"lo": 0.1, "mid": 0.5, "hi": 0.95}
    plain = {r["k"]: tuple(r)[1:] for r in skew.group_quantiles(df, ["k"], "v", q).collect()}
    hot = {r["k"]: tuple(r)[1:] for r in skew.group_quantiles(df, ["k"], "v", q, hot_rows=10, buckets=16).collect()}
    for k in ("a", "b"):
        want = np.quantile([v for g, v in rows if g == k], list(q.values()))
        assert plain[k] == pytest.approx(want) and hot[k] == pytest.approx(want)


def test_join_stats_salts_hot_keys(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)], "id int, k string")
    stats = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = skew.join_stats(rows, stats, ["k"], "n", hot_rows=20, salts=4).collect()
    assert len(got) == 90 and {(r["k"], r["n"]) for r in got} == {("hot", 60), (None, 30)}


def test_moments_paths_agree(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) * [1, 50, 0.1] + [5, 1e6, -2]
    df = spark.createDataFrame([tuple(map(float, r)) + (i % 3,) for i, r in enumerate(x)], "a double, b double, c double, g int")
    m = linalg.moments(df, ["a", "b", "c"])
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.cross / 120, np.cov(x.T, ddof=0))
    safe = [f"_x{i}" for i in range(3)]
    rows = df.toDF(*safe, "_g")
    wide = linalg._cross_products(rows, safe, m.mean, "_g")
    sql = linalg._cross_sql(rows, safe, m.mean, "_g")
    for g in range(3):
        assert wide[g][0] == sql[g][0] and np.allclose(wide[g][2], sql[g][2])
