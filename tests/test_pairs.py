import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from compoundry.operators import descriptors, diversity, domain, neighbors, similarity, splits
from compoundry.operators.domain import DomainConfig


def make(spark, n=70, n_bits=48, copies=25, seed=5):
    """Random fingerprints; the first ``copies`` ids all share one fingerprint."""
    rng = np.random.default_rng(seed)
    base = rng.random((8, n_bits)) < 0.4
    bits = [(base[rng.integers(8)] ^ (rng.random(n_bits) < 0.08)) for _ in range(n)]
    for i in range(copies):
        bits[i] = bits[0]
    rows = [(i, [int(b) for b in np.flatnonzero(x)], float(10 ** rng.uniform(0, 4))) for i, x in enumerate(bits)]
    df = spark.createDataFrame(rows, "id bigint, bits array<int>, act double")
    return rows, df.withColumn("fp", similarity.words_from_bits(F.col("bits"), n_bits)).cache()


def tanimoto(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def data(spark):
    return make(spark)


def half_up(v):
    from decimal import ROUND_HALF_UP, Decimal

    return float(Decimal(repr(float(v))).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def brute_pairs(rows, t):
    return {(a[0], b[0]): tanimoto(a[1], b[1]) for i, a in enumerate(rows) for b in rows[i + 1:] if tanimoto(a[1], b[1]) >= t}


def test_row_pairs(data):
    rows, df = data
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.row_pairs(df, "fp", "id", 0.55).collect()}
    want = brute_pairs(rows, 0.55)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_blocks_of_any_size_agree(data):
    rows, df = data
    classes = similarity.fingerprint_classes(df, "fp", "id")
    small = {(r[0], r[1]) for r in similarity.class_pairs(classes, None, "fp", 0.5, block_rows=3).select("class_a", "class_b").collect()}
    large = {(r[0], r[1]) for r in similarity.class_pairs(classes, None, "fp", 0.5).select("class_a", "class_b").collect()}
    assert small == large and small


def test_top_hits_with_copies(data):
    rows, df = data
    texts = df.withColumn("text", F.concat(F.lit("t"), F.when(F.col("id") < 25, F.col("id") % 5).otherwise(F.col("id")).cast("string")))
    label = lambda i: i % 5 if i < 25 else i
    got = [(r["query_index"], r["reference_index"], r["similarity"]) for r in
           similarity.top_hits(texts, texts, "fp", "id", "id", "text", 4, 0.5).orderBy("query_index", "rank").collect()]
    want = []
    for q in rows:
        hits = sorted([(-tanimoto(q[1], r[1]), r[0]) for r in rows if label(r[0]) != label(q[0]) and tanimoto(q[1], r[1]) >= 0.5])[:4]
        want += [(q[0], i, -s) for s, i in hits]
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=6e-5)


@pytest.mark.parametrize("limit", [5, 40, 100000])
@pytest.mark.parametrize("log_scale", [False, True])
def test_cliffs(data, limit, log_scale):
    rows, df = data
    acts = df.withColumn("a", F.when(F.col("id") % 3 == 0, F.lit(2.0)).otherwise(F.round("act", 1)) if not log_scale else F.round(F.log10("act"), 2))
    value = {r["id"]: r["a"] for r in acts.select("id", "a").collect()}
    got = [(r["index_a"], r["index_b"], r["cliff_score"], r["higher_active"]) for r in
           similarity.activity_cliffs(acts, "fp", "id", "a", 0.6, 10.0, log_scale, limit).collect()]
    want = []
    for (i, j), s in brute_pairs(rows, 0.6).items():
        x, y = value[i], value[j]
        d = abs(x - y) if log_scale else abs(np.log10(x) - np.log10(y))
        if (d < 1.0) if log_scale else (max(x, y) / min(x, y) < 10):
            continue
        first = x > y if log_scale else x < y
        want.append((-half_up(s * d), -half_up(s), i, j, "a" if first else "b"))
    want.sort()
    assert [(g[0], g[1], g[3]) for g in got] == [(w[2], w[3], w[4]) for w in want[:limit]]


def test_sphere_exclusion_equals_the_walk(spark, data):
    rows, df = data
    order = [r["id"] for r in df.select("id").orderBy(F.xxhash64(F.lit(7), "id"), "id").collect()]
    bits = {r[0]: r[1] for r in rows}
    kept = []
    for i in order:
        if all(tanimoto(bits[i], bits[k]) < 0.6 for k in kept):
            kept.append(i)
    got = {r["id"] for r in diversity.sphere_exclusion(df, "fp", "id", 0.4, 7).collect()}
    assert got == set(kept)


def test_butina_equals_the_sequential_algorithm(data):
    rows, df = data
    near = {a[0]: {b[0] for b in rows if b[0] != a[0] and tanimoto(a[1], b[1]) >= 0.6} for a in rows}
    seen, clusters = set(), []
    for _, i in sorted(((len(v), i) for i, v in near.items()), reverse=True):
        if i in seen:
            continue
        members = {i} | (near[i] - seen)
        seen |= members
        clusters.append((i, members))
    got = diversity.butina_clusters(df, "fp", "id", 0.4).cache()
    sizes = {r["cluster"]: r["cluster_size"] for r in got.collect()}
    assert sizes == {i: len(m) for i, m in clusters}
    best = sorted(clusters, key=lambda c: -len(c[1]))[:3]
    assert [r["cluster"] for r in diversity.butina_selection(got, 3).collect()] == [i for i, _ in best]


def test_maxmin(data):
    rows, df = data
    bits = {r[0]: r[1] for r in rows}
    picked = [0]
    while len(picked) < 6:
        best = max((i for i in bits if i not in picked), key=lambda i: (min(1 - tanimoto(bits[i], bits[p]) for p in picked), -i))
        picked.append(best)
    got = [r["id"] for r in diversity.maxmin_pick(df, "fp", "id", 6).orderBy("rank").collect()]
    assert got == picked


def greedy_split(sizes, fractions):
    """Largest first; one seed group per split, then to the largest deficit (tie: train)."""
    n = sum(sizes)
    members, out, seeds = [0, 0, 0], [], [j for j, f in enumerate(fractions) if f > 0]
    for k, s in enumerate(sizes):
        if k < len(seeds):
            j = seeds[k]
        else:
            j = max(range(3), key=lambda j: (fractions[j] * n - members[j], j == 0, -j))
        members[j] += s
        out.append(j)
    return members, out


def test_equal_group_runs_match_step_by_step():
    rnd = random.Random(3)
    for _ in range(300):
        fr = [rnd.random() for _ in range(3)]
        fr = [f / sum(fr) for f in fr]
        size, count = rnd.randint(1, 6), rnd.randint(1, 90)
        start = [rnd.uniform(-20, 200) for _ in range(3)]
        d, want = list(start), []
        for _ in range(count):
            j = max(range(3), key=lambda j: (d[j], j == 0, -j))
            d[j] -= size
            want.append(j)
        got, dd = [], list(start)
        for a, b, pattern in splits._runs(dd, size, count):
            assert a == len(got) + 1
            got += [pattern[k % len(pattern)] for k in range(b - a + 1)]
        assert got == want and np.allclose(dd, d)


def test_group_split_counts(spark):
    rnd = random.Random(1)
    rows, k = [], 0
    for g in range(60):
        for _ in range(rnd.choice([1, 1, 1, 2, 2, 3, 9])):
            rows.append((k, f"g{g}"))
            k += 1
    rows.append((k, None))
    df = spark.createDataFrame(rows, "id bigint, g string")
    out = splits.group_split(df, "g", 0.7, 0.15, 0.15)
    counts = {r["split"]: r["count"] for r in splits.split_summary(out).collect()}
    sizes = sorted((sum(1 for _, g in rows if g == f"g{i}") for i in range(60)), reverse=True)
    want, _ = greedy_split(sizes, [0.7, 0.15, 0.15])
    assert [counts["train"], counts["validation"], counts["test"]] == want and counts["invalid"] == 1
    assert splits.groups_by_split(out.where("g is not null"), "g").agg(F.sum("n_shared")).first()[0] == 0


def test_random_split_is_repeatable(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    a = {r["k"]: r["split"] for r in splits.random_split(df, "k", 0.2, 0.2, 7).collect()}
    b = {r["k"]: r["split"] for r in splits.random_split(df, "k", 0.2, 0.2, 7).collect()}
    assert a == b and sorted(a.values()).count("test") == 2 and list(a.values()).count("validation") == 2
    assert splits.split_counts(3, 0.5, 0.5) == (2, 0) and splits.split_counts(2, 0.01, 0.01) == (1, 0)
    with pytest.raises(ValueError):
        splits.split_dataset(df, "random", "k", 0.6, 0.5)


def test_stratified_split_keeps_shares(spark):
    df = spark.createDataFrame([(i, "a" if i % 4 else "b") for i in range(80)], "k bigint, l string")
    got = splits.stratified_split(df, "k", "l", 0.25, 0.25)
    counts = {(r["l"], r["split"]): r["count"] for r in got.groupBy("l", "split").count().collect()}
    assert counts == {("a", "test"): 15, ("b", "test"): 5, ("a", "validation"): 15, ("b", "validation"): 5, ("a", "train"): 30, ("b", "train"): 10}


def test_neighbours_with_slices_and_copies(spark):
    rng = np.random.default_rng(9)
    ref = rng.normal(size=(300, 3))
    ref[:90] = ref[0]
    query = np.vstack([rng.normal(size=(40, 3)) * 2, ref[:5]])
    r = spark.createDataFrame([([float(v) for v in x],) for x in ref], "x array<double>")
    q = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(query)], "qid bigint, x array<double>")
    got = {x["qid"]: x["d"] for x in neighbors.nearest_distances(q, "qid", r, "x", np.array([1.0, 0, 0]), 6, block_rows=16).collect()}
    for i, x in enumerate(query):
        want = np.sort(np.sqrt(((ref - x) ** 2).sum(1)))[:6]
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_domain(spark):
    ref = spark.createDataFrame([(0.1, 0.1), (0.2, 0.1), (0.1, 0.2), (0.15, 0.12), (0.12, 0.18)], "d1 double, d2 double")
    q = spark.createDataFrame([(1, 0.12, 0.11), (2, 5.0, 5.0)], "id int, d1 double, d2 double")
    fit = domain.fit_domain(ref, ["d1", "d2"], DomainConfig(use_knn=True, use_mahalanobis=True, knn_k=2))
    out = {r["id"]: r for r in domain.score_domain(fit, q, "id").collect()}
    assert out[1]["in_ad"] and not out[2]["in_ad"] and out[2]["leverage"] > out[2]["h_star"]
    e = {r["id"]: r for r in domain.explain_domain(domain.score_domain(fit, q, "id"), fit.config).collect()}
    assert e[2]["AD_confidence"] == "low" and e[2]["AD_failed_methods"] == 3 and e[1]["AD_failed_methods"] == 0
    x = np.array([[0.1, 0.1], [0.2, 0.1], [0.1, 0.2], [0.15, 0.12], [0.12, 0.18]])
    x1 = np.column_stack([np.ones(5), x])
    v = np.array([1, 0.12, 0.11])
    assert out[1]["leverage"] == pytest.approx(v @ np.linalg.inv(x1.T @ x1) @ v)


def test_no_domain_methods_accept_all(spark):
    ref = spark.createDataFrame([(float(i), float(i * i)) for i in range(5)], "a double, b double")
    fit = domain.fit_domain(ref, ["a", "b"], DomainConfig(use_williams=False))
    assert domain.score_domain(fit, ref).where("not in_ad").count() == 0


def test_descriptor_filter_stages(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=60), rng.normal(size=60)
    rows = [(float(a[i]), float(a[i] * 2 + 0.001 * b[i]), float(b[i]), 1.0, None, None if i % 2 else 1.0 * i, float(a[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "x1 double, x2 double, x3 double, flat double, empty double, gaps double, y double")
    res = descriptors.filter_descriptors(df, ["x1", "x2", "x3", "flat", "empty", "gaps"], descriptors.FilterConfig(target="y"))
    status = {r["feature"]: r["status"] for r in res.report.collect()}
    assert status == {"x1": "kept", "x2": "correlated", "x3": "kept", "flat": "low_variance", "empty": "empty", "gaps": "high_missing"}
    assert res.clusters[0]["kept"] == "x1" and res.data.columns == ["x1", "x3", "y"]


def test_greedy_correlation_inflates_r(spark):
    from compoundry.functions.linalg import Moments

    m = Moments(["p", "q"], 4, np.zeros(2), np.array([[4.0, 3.2], [3.2, 4.0]]))
    assert descriptors.greedy_correlated(["p", "q"], m, {"p": 1.0, "q": 0.5}, 0.9)[0] == ["q"]
    assert descriptors.clustered_correlated(["p", "q"], m.corr, {"p": 1.0, "q": 0.5}, 0.9)[0] == []


def test_average_linkage_matches_definition():
    rng = np.random.default_rng(11)
    pts = rng.random((9, 2))
    d = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(-1))
    groups = [[i] for i in range(9)]
    while len(groups) > 1:
        pairs = [(np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y]
        best = min(pairs)
        if best[0] > 0.35:
            break
        groups[best[1]] += groups.pop(best[2])
    labels = descriptors.average_linkage(d, 0.35)
    assert {frozenset(g) for g in groups} == {frozenset(i for i in range(9) if labels[i] == k) for k in set(labels)}


@pytest.mark.parametrize(("threshold", "n_bits", "share"), [(0.3, 48, 0.4), (0.8, 300, 0.05), (1.0, 300, 0.05), (0.999, 100, 0.3)])
def test_prefix_join_against_brute_force(spark, threshold, n_bits, share):
    rng = np.random.default_rng(11)
    base = rng.random((6, n_bits)) < share
    bits = [base[rng.integers(6)] ^ (rng.random(n_bits) < 0.02) for _ in range(80)] + [np.zeros(n_bits, bool), np.ones(n_bits, bool)]
    for b in bits[:40]:
        b[3] = True  # a bit that half of the rows share
    rows = [(i, [int(x) for x in np.flatnonzero(b)], 0.0) for i, b in enumerate(bits)]
    df = spark.createDataFrame(rows, "id bigint, bits array<int>, act double").withColumn("fp", similarity.words_from_bits(F.col("bits"), n_bits))
    want = brute_pairs(rows, threshold)
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.row_pairs(df, "fp", "id", threshold).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    left, right = (similarity.fingerprint_classes(df.where(c), "fp", "id") for c in ("id % 3 = 0", "id % 3 <> 0"))
    cross = {(r["class_a"], r["class_b"]) for r in similarity.class_pairs(left, right, "fp", threshold, block_rows=4).collect()}
    first = {}
    for i, b, _ in rows:
        first.setdefault((i % 3 == 0, tuple(b)), i)
    reps = set(first.values())
    assert cross == {p for a, b in want for p in ((a, b), (b, a)) if p[0] % 3 == 0 and p[1] % 3 and set(p) <= reps}
    links, members = similarity.class_links(df, "fp", "id", threshold)
    assert all(r["class_a"] < r["class_b"] for r in links.collect())
    member = {r["id"]: r for r in members.collect()}
    for i, b, _ in rows:
        other = sum(1 for p in want if i in p and rows[p[0]][1] != rows[p[1]][1])
        assert (member[i]["n_rows"], member[i]["n_links"]) == (sum(x[1] == b for x in rows), other)
    assert similarity.row_pairs(df.where("id = 80"), "fp", "id", threshold).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cityblock", "chebyshev", "hamming", "jaccard", "cosine", "pearson", "spearman"])
def test_pivot_index_against_brute_force(spark, metric):
    import pandas as pd

    from compoundry.operators.distances import within

    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((60, 5)) * (rng.random((60, 5)) < 0.7), 1)
    x[10:25] = x[3]
    vectors = [v.tolist() for v in x] + [None, [float("nan")] * 5, [0.0] * 5]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, x array<double>")
    exact = {
        "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum()), "cityblock": lambda a, b: np.abs(a - b).sum(), "chebyshev": lambda a, b: np.abs(a - b).max(),
        "hamming": lambda a, b: (a != b).mean(), "jaccard": lambda a, b: 1 - ((a != 0) & (b != 0)).sum() / max(1, ((a != 0) | (b != 0)).sum()) if ((a != 0) | (b != 0)).any() else 0.0,
        "cosine": lambda a, b: 1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b),
        "pearson": lambda a, b: 1 - np.corrcoef(a, b)[0, 1], "spearman": lambda a, b: 1 - np.corrcoef(pd.Series(a).rank(), pd.Series(b).rank())[0, 1]}[metric]
    flat = {"cosine": lambda a: not a.any(), "pearson": lambda a: a.std() < 1e-12, "spearman": lambda a: a.std() < 1e-12}.get(metric, lambda a: False)
    good = {i: np.array(v) for i, v in enumerate(vectors) if v is not None and np.isfinite(v).all() and not flat(np.array(v))}
    limit = 0.95 if metric in ("euclidean", "cityblock", "chebyshev") else 0.4
    want = {(i, j): exact(good[i], good[j]) for i in good for j in good if i < j and exact(good[i], good[j]) <= limit}
    got = {(r["i"], r["j"]): r["distance"] for r in within(df, None, "id", "x", limit, metric).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want) and want
    two = {(r["i"], r["j"]) for r in within(df.where("id < 30"), df.where("id >= 30"), "id", "x", limit, metric).collect()}
    assert two == {k for k in want if k[0] < 30 <= k[1]}
    near = within(df, None, "id", "x", limit, metric, nearest=2).collect()
    for i in good:
        # equal distances may differ in their last digit, so the partner itself is not compared
        mine = sorted(round(d, 9) for k, d in want.items() if i in k)[:2]
        assert sorted(round(r["distance"], 9) for r in near if r["i"] == i) == mine
    assert within(df.where("1 = 0"), None, "id", "x", limit, metric).count() == 0


@pytest.mark.parametrize("batch", [1, 4, 1024])
def test_maxmin_in_batches_gives_the_exact_order(spark, data, batch):
    rows, df = data
    n = 40
    picked, best = [0], {i: 1 - tanimoto(b, rows[0][1]) for i, b, _ in rows}
    while len(picked) < n:
        nxt = min((i for i in best if best[i] > 0), key=lambda i: (-best[i], i), default=None)
        if nxt is None:
            break
        picked.append(nxt)
        best = {i: min(d, 1 - tanimoto(rows[i][1], rows[nxt][1])) for i, d in best.items()}
    picked += [i for i in range(len(rows)) if i not in picked][: n - len(picked)]
    got = {r["rank"]: r["id"] for r in diversity.maxmin_pick(df, "fp", "id", n, batch=batch).collect()}
    assert [got[k] for k in sorted(got)] == picked


def test_ranks_of_all_columns_in_one_pass(spark):
    import pandas as pd

    rng = np.random.default_rng(2)
    x = pd.DataFrame({"id": range(300), "a": rng.integers(0, 4, 300).astype(float), "b": rng.standard_normal(300), "c": np.r_[np.full(290, 7.0), np.arange(10.0)], "d": [None] * 300})
    df = spark.createDataFrame([tuple(None if v is None else v for v in r) for r in x.astype(object).itertuples(index=False)], "id long, a double, b double, c double, d double")
    got = descriptors.spearman_ranks(df, ["a", "b", "c", "d"], "id").toPandas().sort_values("id").reset_index(drop=True)
    for c in "abc":
        assert got[f"rank_{c}"].tolist() == x[c].rank().tolist()
    assert set(got["rank_d"]) == {150.5} and got["b"].tolist() == x["b"].tolist()
    assert descriptors.spearman_ranks(df.where("1 = 0"), ["a"], "id").count() == 0


def test_quotas_of_many_strata(spark):
    import math

    df = spark.range(900).select(F.col("id"), F.concat(F.lit("s"), F.floor(F.col("id") / 2).cast("string")).alias("label"))
    counts = {r["split"]: r["count"] for r in splits.stratified_split(df, "id", "label").groupBy("split").count().collect()}
    assert counts == {"test": math.ceil(180), "validation": math.ceil(90), "train": 630}
    from compoundry.functions.skew import with_range_rank

    ranked = with_range_rank(df.withColumn("v", F.col("id") % 7), [F.desc("v"), F.col("id")], "r").collect()
    assert [x["id"] for x in sorted(ranked, key=lambda x: x["r"])] == sorted(range(900), key=lambda i: (-(i % 7), i)) and min(x["r"] for x in ranked) == 1


@pytest.mark.parametrize(("n", "n_bits", "share", "steps"), [(1, 64, 0.2, ()), (15, 64, 0.3, (0.5,)), (90, 192, 0.03, (0.6,))])
def test_diversity_metrics_against_brute_force(spark, n, n_bits, share, steps):
    rng = np.random.default_rng(n)
    on = rng.random((n, n_bits)) < share
    if n > 20:
        on[5], on[6], on[7], on[8] = on[4], False, False, on[4]  # copies, and prints without a bit
    words = np.packbits(on, axis=1, bitorder="little").view(np.int64)
    ids = [3 * i + 2 for i in range(n)]
    df = spark.createDataFrame([(i, w.tolist()) for i, w in zip(ids, words, strict=True)], "rid long, fp array<bigint>")
    both = on.astype(int) @ on.T.astype(int)
    total = on.sum(1)[:, None] + on.sum(1)[None, :] - both
    sim = np.where(total > 0, both / np.maximum(total, 1), 0.0)
    np.fill_diagonal(sim, -1.0)
    near = similarity.nearest_similarity(df, "fp", "rid", steps)
    got = {r["class_id"]: (r["n_rows"], r["nearest"]) for r in near.collect()}
    for i in range(n):
        if ids[i] in got:
            assert got[ids[i]][1] == pytest.approx(max(0.0, sim[i].max()))
    assert sum(k for k, _ in got.values()) == n
    r = diversity.diversity_metrics(df, "fp", "rid").first()
    if n < 2:
        assert tuple(r) == (n, 1.0, 1.0, n, 1.0)
        return
    d = 1 - np.maximum(sim.max(1), 0.0)
    first = np.mean([[1 - sim[i, j] for j in range(n) if j != i][:20] for i in range(n)])
    assert r["n_compounds"] == n and r["n_singletons"] == (d > 0.5).sum()
    assert r["mean_nn_distance"] == pytest.approx(d.mean(), abs=6e-5) and r["mean_pairwise_dist"] == r["diversity_score"] == pytest.approx(first, abs=6e-5)


def test_distances_just_above_the_threshold(spark):
    from compoundry.operators.distances import within

    balances = [a / 100 / 1000 for a in range(0, 400_000, 10_007)]
    above = [(x, y) for a in range(500, 40_000, 7) for x, y in [((a / 100 + 1250) / 1000, a / 100 / 1000)] if 1.25 < x - y <= 1.25 + 1e-12][:20]
    points = balances + [v for p in above for v in p]
    df = spark.createDataFrame([(i, [0.0, v]) for i, v in enumerate(points)], "id long, x array<double>")
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if abs(points[i] - points[j]) <= 1.25}
    for metric in ("euclidean", "cityblock"):
        assert {(r["i"], r["j"]) for r in within(df, None, "id", "x", 1.25, metric).collect()} == want
    assert len(above) == 20


@pytest.mark.parametrize("frequent", [False, True])
def test_frequent_and_rare_bits_agree(spark, data, monkeypatch, frequent):
    monkeypatch.setattr(similarity, "frequent_bits", lambda *_: frequent)
    rows, df = data
    test_row_pairs(data)
    test_top_hits_with_copies(data)
    test_sphere_exclusion_equals_the_walk(spark, data)
    test_butina_equals_the_sequential_algorithm(data)
    want = brute_pairs(rows, 0.5)
    alone = {r["id"] for r in similarity.unmatched_rows(df, "fp", "id", 0.5).collect()}
    assert alone == {r[0] for r in rows} - {i for p in want for i in p}
    links, members = similarity.class_links(df, "fp", "id", 0.5)
    got = {r["id"]: (r["n_rows"], r["n_links"]) for r in members.collect()}
    for i, b, _ in rows:
        assert got[i] == (sum(x[1] == b for x in rows), sum(1 for p in want if i in p and rows[p[0]][1] != rows[p[1]][1]))
    near = {r["class_id"]: r["nearest"] for r in similarity.nearest_similarity(df, "fp", "id").collect()}
    for i in near:
        assert near[i] == pytest.approx(max(tanimoto(rows[i][1], x[1]) for x in rows if x[0] != i))


@pytest.mark.parametrize("block", [5, 2048])
def test_best_partners_keep_ties_by_smaller_id(data, block):
    rows, df = data
    classes = similarity.fingerprint_classes(df, "fp", "id")
    reps = [r["class_id"] for r in classes.collect()]
    got = {}
    for r in similarity.best_partners(classes, classes, "fp", 0.2, 3, False, block).collect():
        got.setdefault(r["class_a"], set()).add(r["class_b"])
    for i in reps:
        best = sorted((-tanimoto(rows[i][1], rows[j][1]), j) for j in reps if j != i and tanimoto(rows[i][1], rows[j][1]) >= 0.2)[:3]
        assert got.get(i, set()) == {j for _, j in best}


def test_walk_in_small_batches(spark, data):
    rows, df = data
    bits = {r[0]: r[1] for r in rows}
    kept, owner = [], {}
    for i in sorted(bits, key=lambda i: (i * 37 % 71, i)):
        owner[i] = next((k for k in kept if tanimoto(bits[i], bits[k]) >= 0.5), i)
        kept += [i] if owner[i] == i else []
    nodes = df.select("id", "fp", F.struct((F.col("id") * 37 % 71).alias("h"), "id").alias("ord"))
    for batch in (4, 4096):
        assert {r["id"]: r["owner"] for r in diversity._walk(nodes, "fp", "ord", 0.5, batch).collect()} == owner


def test_nearest_within_keeps_lists_per_block(spark, monkeypatch):
    from compoundry.functions import blocks
    from compoundry.operators import distances

    monkeypatch.setattr(blocks, "meet", None)  # no pair beyond the lists may be made
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 40)
    rng = np.random.default_rng(6)
    points = [[float(rng.integers(0, 4)), float(rng.integers(0, 30)) / 10] for _ in range(300)] + [[1.0, 1.0]] * 20
    df = spark.createDataFrame(list(enumerate(points)), "id long, x array<double>")
    got = sorted((r["i"], r["distance"], r["j"]) for r in distances.within(df, None, "id", "x", 1.25, nearest=3).collect())
    want = []
    for i, a in enumerate(points):
        near = sorted((float(np.sqrt(((np.array(a) - b) ** 2).sum())), j) for j, b in enumerate(points) if j != i)
        want += [(i, d, j) for d, j in near[:3] if d <= 1.25]
    assert got == sorted(want)


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_long_vectors_within_are_exact(spark, shift):
    from compoundry.operators.distances import within

    rng = np.random.default_rng(7)
    x = rng.integers(0, 3, (150, 12)).astype(float) + shift
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if ((x[i] - x[j]) ** 2).sum() <= 9}
    assert {(r["i"], r["j"]) for r in within(df, None, "id", "x", 3.0).collect()} == want


@pytest.mark.parametrize("log_scale", [False, True])
def test_cliffs_of_frequent_bits_leave_no_pairs(spark, data, monkeypatch, log_scale):
    monkeypatch.setattr(similarity, "frequent_bits", lambda *_: True)
    monkeypatch.setattr(similarity, "class_pairs", None)  # the pairs of classes may not be made
    for limit in (5, 40, 100000):
        test_cliffs(data, limit, log_scale)


def test_row_pairs_without_copies_are_not_joined_again(data, monkeypatch):
    rows, df = data
    monkeypatch.setattr(similarity, "with_class", None)
    first = {}
    for i, bits, _ in rows:
        first.setdefault(tuple(sorted(bits)), i)
    alone = set(first.values())
    got = {(r["id_a"], r["id_b"]) for r in similarity.row_pairs(df.where(F.col("id").isin(sorted(alone))), "fp", "id", 0.5).collect()}
    assert got == {p for p in brute_pairs(rows, 0.5) if set(p) <= alone}


@pytest.fixture
def no_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    # as many partitions as the block step asks for: the join's partitioning then equals the repartition's
    names = (*names, "spark.sql.shuffle.partitions")
    old[names[-1]] = spark.conf.get(names[-1])
    spark.conf.set(names[-1], "32")
    yield
    for n, v in old.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def test_blocks_are_dealt_over_all_tasks_after_a_sort_merge_join(spark, data, no_broadcast):
    from compoundry.functions import blocks

    rows, df = data
    classes = similarity.fingerprint_classes(df, "fp", "id")
    pairs = similarity.class_pairs(classes, None, "fp", 0.5, block_rows=4, frequent=True)
    lists = similarity.best_partners(classes, classes, "fp", 0.2, 3, False, 4)
    for out in (pairs, lists):
        assert out.rdd.getNumPartitions() >= blocks.tasks_for(df)


def test_grown_blocks_give_the_same_pairs(data, monkeypatch):
    from compoundry.functions import blocks

    rows, df = data
    classes = similarity.fingerprint_classes(df, "fp", "id")
    ids = {r[0] for r in classes.select("class_id").collect()}
    want = {p for p in brute_pairs(rows, 0.5) if set(p) <= ids}
    links = lambda: {r["class_id"]: r["n_links"] for r in similarity.partner_rows(classes, "fp", 0.5, 3).collect()}
    best = lambda: sorted(map(tuple, similarity.best_partners(classes, classes, "fp", 0.2, 3, False, 3).collect()))
    small = links(), best()
    monkeypatch.setattr(blocks, "CELL_BLOCKS", 1)
    assert max(r["n_sub"] for r in blocks.cell_sizes(df.select(F.lit(0).alias("cell")), "cell", 3, 4).collect()) == 6
    got = [(r[0], r[1]) for r in similarity.class_pairs(classes, None, "fp", 0.5, block_rows=3, frequent=True).select("class_a", "class_b").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert (links(), best()) == small


def test_row_pairs_of_frequent_bits_go_through_no_join(spark, data, monkeypatch):
    rows, df = data
    monkeypatch.setattr(similarity, "frequent_bits", lambda *_: True)
    monkeypatch.setattr(similarity, "with_class", None)
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in similarity.row_pairs(df, "fp", "id", 0.55).collect()}
    assert got == brute_pairs(rows, 0.55)
    # rows that share an id are no pair, rows without one have none
    odd = df.where("id < 3").select(F.when(F.col("id") < 2, F.lit(7).cast("bigint")).alias("id"), "fp")
    assert similarity.row_pairs(odd, "fp", "id", 0.55).count() == 0


def test_similarities_are_rounded_as_round_does(spark):
    from compoundry.plans.pair_queries import rounded

    df = spark.range(1, 1300).select(F.explode(F.transform(F.sequence(F.lit(1), F.col("id")), lambda c: c / F.col("id"))).alias("x"))
    assert df.where(rounded(F.col("x")) != F.round("x", 6)).count() == 0
