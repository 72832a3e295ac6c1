import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from stayflow.operators import distances as D
from stayflow.operators.mixture import (
    COVARIANCE_TYPES, GaussianMixtureEM, evaluate_gmm_grid, fit_gmm, free_parameters, information_criteria, soft_labels,
)
from stayflow.operators.projection import pca_reduce
from stayflow.operators.passes import labelling_scores, vectors
from stayflow.operators.segmentation import (
    assign_personas, evaluate_k_range, fit_kmeans, persona_counts, profile_clusters, select_best_gmm_config, select_best_k,
)


def blobs(spark, n=300, dims=2):
    rng = np.random.default_rng(42)
    centres = np.array([[-6, 0, 3, 1, 2], [6, 6, -3, 0, 1], [0, -8, 0, 4, -5]], dtype=float)[:, :dims]
    x = np.concatenate([rng.normal(c, 0.6, (n // 3, dims)) for c in centres])
    rows = [(str(i), [float(v) for v in p], i // (n // 3)) for i, p in enumerate(x)]
    df = spark.createDataFrame(rows, "id string, x array<double>, truth int").withColumn("features", array_to_vector("x")).persist()
    return df, x


def brute_knn(ids, x, k):
    out = {}
    for i, a in enumerate(ids):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        out[a] = sorted((d[j], b) for j, b in enumerate(ids) if j != i)[:k]
    return out


def check_knn(df, ids, x, k):
    got = D.knn_graph(df, k, "id", "x").orderBy("src", "rank").toPandas()
    want = brute_knn(ids, x, k)
    by = {s: list(zip(g["distance"], g["dst"])) for s, g in got.groupby("src")}
    assert set(by) == {s for s in want if want[s]}
    for s, rows in by.items():
        assert [b for _, b in rows] == [b for _, b in want[s]]
        assert np.allclose([a for a, _ in rows], [a for a, _ in want[s]])


@pytest.mark.parametrize("cell,block", [(1024, 2048), (20, 2048), (20, 7)])
def test_knn_matches_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(D, "CELL_ROWS", cell)
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    df, x = blobs(spark, 150)
    check_knn(df.select("id", "x"), [str(i) for i in range(150)], x, 4)


def test_knn_with_a_point_shared_by_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL_ROWS", 15)
    monkeypatch.setattr(D, "BLOCK_ROWS", 6)
    x = np.array([[0.0, 0.0]] * 40 + [[float(i % 9), float(i % 5)] for i in range(80)])
    ids = [f"{i:03d}" for i in range(120)]
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in zip(ids, x)], "id string, x array<double>")
    check_knn(df, ids, x, 5)


def test_knn_small_inputs(spark):
    df = spark.createDataFrame([("a", [0.0]), ("b", [1.0]), ("c", [5.0])], "id string, x array<double>")
    check_knn(df, ["a", "b", "c"], np.array([[0.0], [1.0], [5.0]]), 15)
    assert D.knn_graph(df.filter("id = 'none'"), 3, "id", "x").count() == 0


def brute_silhouette(x, labels):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, c in enumerate(labels):
        if (labels == c).sum() == 1:
            out.append(0.0)
            continue
        a = d[i, labels == c].sum() / ((labels == c).sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) if o != c)
        out.append((b - a) / max(a, b))
    return np.array(out)


@pytest.mark.parametrize("block", [2048, 40])
def test_silhouette_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_ROWS", block)
    df, x = blobs(spark, 150)
    truth = np.arange(150) // 50
    odd = np.where(np.arange(150) == 3, 2, np.arange(150) % 2)  # a cluster of one
    df = df.withColumn("odd", F.when(F.col("id") == "3", 2).otherwise(F.col("id").cast("int") % 2))
    got = D.silhouette_samples(df, ["truth", "odd"], "id", "features", "euclidean").toPandas().set_index("id").loc[[str(i) for i in range(150)]]
    assert np.allclose(got["silhouette_truth"], brute_silhouette(x, truth))
    assert np.allclose(got["silhouette_odd"], brute_silhouette(x, odd))


def test_squared_mode_equals_the_built_in_evaluator(spark):
    from pyspark.ml.evaluation import ClusteringEvaluator
    df, _ = blobs(spark)
    df = df.withColumn("other", (F.col("id").cast("int") % 4)).persist()
    got = D.silhouette_scores(df, ["truth", "other"], "id", metric="squared")
    for c in ("truth", "other"):
        want = ClusteringEvaluator(predictionCol="p").evaluate(df.withColumn("p", F.col(c).cast("double")))
        assert got[c] == pytest.approx(want, abs=1e-9)


def test_silhouette_metric_is_the_callers_choice(spark):
    df, x = blobs(spark)
    exact = D.silhouette_scores(df, ["truth"], "id", metric="euclidean")
    squared = D.silhouette_scores(df, ["truth"], "id")
    assert squared["truth"] > exact["truth"] and squared == D.silhouette_scores(df, ["truth"], "id", metric="squared")
    assert D.silhouette_scores(df.withColumn("one", F.lit(0)), ["one"], "id")["one"] is None
    with pytest.raises(ValueError):
        D.silhouette_scores(df, ["truth"], "id", metric="auto")


def test_scores_of_all_labellings_in_two_scans(spark):
    df, x = blobs(spark)
    labelled = df.withColumn("other", (F.col("id").cast("int") % 4)).withColumn("same", F.lit(0))
    truth = np.arange(300) // 100
    rows = vectors(labelled, "features")
    key = {tuple(np.round(v, 9)): i for i, v in enumerate(x)}
    pick = lambda m, y: np.array([y[key[tuple(np.round(v, 9))]] for v in m])
    got = labelling_scores(rows, lambda m: [pick(m, truth), pick(m, np.arange(300) % 4), np.zeros(len(m), int)], [3, 4, 2])
    want = D.silhouette_scores(labelled, ["truth", "other"], "id")
    assert got[0][1] == pytest.approx(want["truth"]) and got[1][1] == pytest.approx(want["other"]) and got[2] == (0.0, None)
    for i, c in enumerate(("truth", "other")):
        assert got[i][0] == pytest.approx(D.davies_bouldin(labelled, c).first()["davies_bouldin"])


def test_search_does_not_depend_on_the_layout_of_its_input(spark):
    df, _ = blobs(spark)
    a = {r["k"]: r for r in evaluate_k_range(df, range(2, 4), restarts=2, id_col="id")[0].collect()}
    b = {r["k"]: r for r in evaluate_k_range(df.repartition(5), range(2, 4), restarts=2, id_col="id")[0].collect()}
    assert all(a[k]["inertia"] == pytest.approx(b[k]["inertia"], rel=1e-9) and a[k]["silhouette_metric"] == "squared" for k in a)
    exact = evaluate_k_range(df, [3], restarts=1, id_col="id", silhouette_metric="euclidean")[0].first()
    assert exact["silhouette_metric"] == "euclidean" and exact["silhouette"] < a[3]["silhouette"]


def test_davies_bouldin_matches_brute_force(spark):
    df, x = blobs(spark)
    labels = np.arange(300) // 100
    cen = np.array([x[labels == c].mean(axis=0) for c in range(3)])
    s = [np.linalg.norm(x[labels == c] - cen[c], axis=1).mean() for c in range(3)]
    want = np.mean([max((s[i] + s[j]) / np.linalg.norm(cen[i] - cen[j]) for j in range(3) if j != i) for i in range(3)])
    row = D.davies_bouldin(df, "truth").first()
    assert row["davies_bouldin"] == pytest.approx(want)
    assert row["inertia"] == pytest.approx(((x - cen[labels]) ** 2).sum())


def test_kmeans_search_finds_three_blobs(spark):
    df, _ = blobs(spark)
    metrics, models = evaluate_k_range(df, range(2, 6), restarts=2, id_col="id")
    rows = {r["k"]: r for r in metrics.collect()}
    assert set(rows) == {2, 3, 4, 5} and all(-1 <= r["silhouette"] <= 1 for r in rows.values())
    assert rows[2]["inertia"] > rows[3]["inertia"] > rows[4]["inertia"]
    assert select_best_k(metrics).first()["k"] == 3
    labels = models[3].transform(df).groupBy("truth").agg(F.count_distinct("Cluster_ID").alias("n")).collect()
    assert all(r["n"] == 1 for r in labels)
    assert fit_kmeans(df, 3, restarts=1).transform(df).select("Cluster_ID").distinct().count() == 3


def test_selection_rules(spark):
    m = spark.createDataFrame([(2, 0.5), (3, float("nan")), (4, 0.5), (5, None)], "k int, silhouette double")
    assert select_best_k(m).first()["k"] == 2
    g = spark.createDataFrame([(3, "spherical", 1.0), (4, "tied", 1.0), (2, "tied", 1.0), (9, "full", float("nan"))],
                              "k int, covariance_type string, bic double")
    best = select_best_gmm_config(g).first()
    assert (best["k"], best["covariance_type"]) == (2, "tied")


@pytest.mark.parametrize("kind", COVARIANCE_TYPES)
def test_mixture_probabilities(spark, kind):
    df, x = blobs(spark)
    model, ll = fit_gmm(df, 3, kind, restarts=1)
    out = soft_labels(model, df).select("truth", "Cluster_ID", "probability").toPandas()
    assert np.allclose([sum(p) for p in out["probability"]], 1.0)
    assert np.isfinite(ll)
    assert out.groupby("truth")["Cluster_ID"].nunique().max() == 1


def test_own_mixture_likelihood_is_that_of_its_parameters(spark):
    df, x = blobs(spark)
    model = GaussianMixtureEM(k=3, covarianceType="full").fit(df)
    s = model.learned
    total = np.zeros(len(x))
    for w, m, c in zip(s["weights"], np.array(s["means"]), np.array(s["covs"])):
        gap = x - m
        total += w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap)) / np.sqrt(np.linalg.det(2 * np.pi * c))
    assert np.log(total).sum() == pytest.approx(model.log_likelihood, rel=1e-6)


def test_information_criteria():
    assert [free_parameters(2, 3, c) for c in COVARIANCE_TYPES] == [19, 13, 13, 9]
    bic, aic = information_criteria(-10.0, 100, 2, 3, "diag")
    assert (bic, aic) == (pytest.approx(20 + 13 * np.log(100)), 46.0)


def test_gmm_grid(spark):
    df, _ = blobs(spark)
    grid = evaluate_gmm_grid(df, range(2, 4), ("tied", "spherical"), restarts=1, id_col="id")
    assert grid.count() == 4
    assert select_best_gmm_config(grid).first()["k"] == 3


def profile_rows(spark):
    rows = [("a", 5, 20, 5000.0, 0), ("b", 7, 22, 5200.0, 0), ("c", 6, 21, 4800.0, 0),
            ("d", 300, 1, 50.0, 1), ("e", 310, 2, 60.0, 1), ("f", 305, 1, 55.0, 1)]
    return spark.createDataFrame(rows, "id string, Recency int, Frequency int, Monetary double, Cluster_ID int")


def test_profile_and_personas(spark):
    profile = profile_clusters(profile_rows(spark))
    rows = profile.collect()
    assert [r["Cluster_ID"] for r in rows] == [0, 1] and [r["Pct_of_Base"] for r in rows] == [50.0, 50.0]
    personas = assign_personas(profile)
    assert {r["Cluster_ID"]: r["Persona"] for r in personas.collect()} == {0: "Champions", 1: "Hibernating"}
    assert {r["Persona"]: r["n_clusters"] for r in persona_counts(personas).collect()} == {"Champions": 1, "Hibernating": 1}


def test_pca_is_centred_and_matches_numpy(spark):
    df, x = blobs(spark, dims=5)
    out, ratios = pca_reduce(df, 2)
    got = out.select("id", "PC1", "PC2").toPandas()
    got = got.assign(n=got["id"].astype(int)).sort_values("n")[["PC1", "PC2"]].to_numpy()
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    for j in range(2):
        v = vt[j] * np.sign(vt[j][np.abs(vt[j]).argmax()])
        assert np.allclose(got[:, j], (x - x.mean(axis=0)) @ v)
    assert np.allclose(ratios, (s**2 / (s**2).sum())[:2])


def test_starts_are_drawn_over_all_rows_when_copies_stand_together(spark):
    from stayflow.operators.segmentation import starting_centers

    points = spark.range(6).selectExpr("array(cast(id * 10 as double), cast(id * id as double)) AS features")
    rows = points.crossJoin(spark.range(5001)).select(F.col("features").alias("x"))
    starts = starting_centers(rows, [(6, s) for s in range(3)] + [(3, 0), (8, 1)])
    for s in (0, 2):
        assert len({tuple(c) for c in starts[6, s]}) == 6
    assert len({tuple(c) for c in starts[8, 1]}) == 6 and len(starts[8, 1]) == 8
    assert (starts[3, 0] == starts[6, 0][:3]).all()
    assert fit_kmeans(rows.withColumnRenamed("x", "features"), 6, restarts=1).training_cost == pytest.approx(0, abs=1e-6)


def test_many_dimensions_meet_in_packed_blocks(spark, monkeypatch):
    import numpy as np

    from stayflow.operators import distances as D

    monkeypatch.setattr(D, "CELL_ROWS", 20)
    monkeypatch.setattr(D, "PACK_ROWS", 70)
    monkeypatch.setattr(D, "TILE", (8, 16))
    calls, packed, shipped = [], D._search_packed, D._cells_to_visit
    monkeypatch.setattr(D, "_search_packed", lambda *a: calls.append("packed") or packed(*a))
    monkeypatch.setattr(D, "_cells_to_visit", lambda *a: calls.append("cells") or shipped(*a))
    x = np.random.default_rng(6).normal(size=(300, 12))
    x[250:] = x[:50]
    df = spark.createDataFrame([(f"c{i:03}", v.tolist()) for i, v in enumerate(x)], "id string, features array<double>")
    got = {(r["src"], r["rank"]): (r["dst"], r["distance"]) for r in D.knn_graph(df, 3).collect()}
    assert calls == ["packed"] and len(got) == 900
    for i in range(300):
        gaps = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        want = sorted((gaps[j], f"c{j:03}") for j in range(300) if j != i)[:3]
        assert [got[f"c{i:03}", k][0] for k in (1, 2, 3)] == [j for _, j in want]
        assert np.allclose([got[f"c{i:03}", k][1] for k in (1, 2, 3)], [g for g, _ in want])


def test_tiles_of_distances_equal_plain_differences_even_for_copies():
    import numpy as np

    from stayflow.operators import distances as D

    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(300, 3)) + 1e4, rng.normal(size=(1500, 3)) + 1e4
    b[:300] = a
    hot = [np.eye(2)[rng.integers(0, 2, n)] for n in (300, 1500)]
    there, back = D._tile_sums(a, b, *hot, mirrored=True)
    plain = D._distances(a, b)
    assert np.allclose(there, plain @ hot[1], rtol=1e-10) and np.allclose(back, plain.T @ hot[0], rtol=1e-10)
    same = np.ones((40, 3)) * 0.3
    assert not D._tile_sums(same, same, np.ones((40, 1)), np.ones((40, 1)), mirrored=False)[0].any()


def test_pairs_of_blocks_shuffle_sums_that_grow_with_the_rows(spark, monkeypatch):
    def held():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size()) if "shuffle" in files.apply(i).getName()}

    monkeypatch.setattr(D, "PACK_ROWS", 50)
    rng = np.random.default_rng(9)
    x, labels = rng.normal(size=(3000, 3)), rng.integers(0, 4, 3000)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))], "id long, features array<double>, k int").persist()
    df.count()
    before = held()
    got = {r["id"]: r["silhouette_k"] for r in D.silhouette_samples(df, ["k"], metric="euclidean").collect()}
    assert sum(n for path, n in held().items() if path not in before) < 25 * 3000 * 4 * 8
    gaps = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))
    sums, sizes = gaps @ np.eye(4)[labels], np.bincount(labels)
    mean = sums / sizes
    mean[np.arange(3000), labels] = np.inf
    inside, outside = sums[np.arange(3000), labels] / (sizes[labels] - 1), mean.min(axis=1)
    assert np.allclose([got[i] for i in range(3000)], (outside - inside) / np.maximum(inside, outside), atol=1e-9)


def test_groups_meet_every_pair_of_blocks_once():
    for blocks in ([0], list(range(7)), [*range(40), 55]):
        met = [(i, j) for one, two in D._groups(blocks, 4, 3) for i in one for j in two if j >= i]
        assert sorted(met) == [(i, j) for i in blocks for j in blocks if j >= i]
    assert max(len(one) for one, _ in D._groups(list(range(4000)), 4, 100)) * 2 * D.PACK_ROWS * 100 * 8 <= D.SUMS_HELD
