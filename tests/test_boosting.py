"""Second-order boosting: splits against a brute-force search, growth orders, partitions, storage and quality."""

import heapq

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from retentio.operators import boosting as B
from retentio.operators import tree_shap as TS


def table(spark, n=600, parts=3, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n).round(1), rng.integers(0, 2, n), rng.integers(0, 5, n), np.zeros(n)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] == 1)) | (rng.random(n) < 0.1)
    rows = [(f"c{i}", *map(float, r), int(t), 1.0 + (i % 3), 1.0) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "customerID string, a double, b double, c double, d double, Churn int, w double, one double")
    return VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="scaled").transform(df.repartition(parts)), x, y.astype(float)


def brute_tree(x, y, w, margin, p):
    """Best-first or level-wise tree by trying every value of every feature as a cut: {path: (gain, feature, cut)}."""
    chance = 1 / (1 + np.exp(-margin))
    g, h = w * (chance - y), w * chance * (1 - chance)

    def search(rows):
        best = None
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                left = rows[x[rows, f] <= cut]
                right = rows[x[rows, f] > cut]
                if min(h[left].sum(), h[right].sum()) < p.min_hessian or min(len(left), len(right)) < p.min_rows:
                    continue
                score = lambda r: g[r].sum() ** 2 / (h[r].sum() + p.l2)
                gain = 0.5 * (score(left) + score(right) - score(rows)) - p.gamma
                if gain > 1e-12 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, cut, left, right
        return best
    out, queue = {}, []

    def offer(path, rows):
        found = search(rows) if len(path) < p.max_depth else None
        if found:
            heapq.heappush(queue, (-found[0] if p.growth == "leaf" else len(path), path, found))
    offer("", np.arange(len(y)))
    leaves = 1
    while queue and (p.growth == "level" or leaves < p.num_leaves):
        _, path, (gain, f, cut, left, right) = heapq.heappop(queue)
        out[path] = gain, f, cut
        leaves += 1
        offer(path + "l", left)
        offer(path + "r", right)
    return out


def tree_of(model, k=0):
    """{path: (feature, cut)} of one tree of a fitted model."""
    t = model.node_table()
    out, stack = {}, [(int(t.roots[k]), "")]
    while stack:
        n, path = stack.pop()
        if t.feature[n] >= 0:
            out[path] = int(t.feature[n]), t.threshold[n]
            stack += [(int(t.left[n]), path + "l"), (int(t.right[n]), path + "r")]
    return out


@pytest.mark.parametrize("growth,leaves", [("level", 0), ("leaf", 4), ("leaf", 6)])
def test_splits_equal_brute_force(spark, growth, leaves):
    df, x, y = table(spark)
    rows = df.select("w", "Churn", vector_to_array("scaled").alias("x")).collect()
    x, y, w = np.array([r["x"] for r in rows]), np.array([float(r["Churn"]) for r in rows]), np.array([r["w"] for r in rows])
    p = B.BoosterParams(growth=growth, num_leaves=leaves, rounds=2, max_depth=4, learning_rate=0.5, min_hessian=2.0, min_rows=5, gamma=0.01)
    model = B.fit(df, {"m": (p, "w")})["m"]
    margin = np.zeros(len(y))
    for k in range(2):
        want = brute_tree(x, y, w, margin, p)
        got = tree_of(model, k)
        assert {q: (f, c) for q, (_, f, c) in want.items()} == got
        assert growth == "level" or len(got) == leaves - 1
        chance = 1 / (1 + np.exp(-margin))
        g, h = w * (chance - y), w * chance * (1 - chance)
        for i in range(len(y)):
            path, rows_at = "", np.ones(len(y), bool)
            while path in got:
                f, c = got[path]
                side = x[i, f] <= c
                rows_at &= (x[:, f] <= c) == side
                path += "l" if side else "r"
            margin[i] += -p.learning_rate * g[rows_at].sum() / (h[rows_at].sum() + p.l2)
    assert np.allclose(model.node_table().predict(x), margin, atol=1e-9)


def test_partitions_and_company_do_not_matter(spark):
    few, _, _ = table(spark, parts=1)
    many, _, _ = table(spark, parts=7)
    level, leaf = B.BoosterParams(rounds=4), B.BoosterParams(growth="leaf", rounds=6, num_leaves=8, l2=0.0, from_average=True, min_rows=20)
    alone = B.fit(few, {"a": (level, "w")})["a"]
    both = B.fit(many, {"a": (level, "w"), "b": (leaf, "one")})
    for k in range(4):
        assert tree_of(alone, k) == tree_of(both["a"], k)
    assert len(both["b"].node_table().roots) == 6 and len(both["a"].node_table().roots) == 4
    assert max(len(tree_of(both["b"], k)) for k in range(6)) <= 7
    assert any(tree_of(both["a"], k) != tree_of(both["b"], k) for k in range(4))


def test_model_scores_stores_and_explains(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(B, "CHECKPOINT_ROUNDS", 5)
    df, x, y = table(spark)
    model = B.fit(df, {"m": (B.BoosterParams(rounds=25, learning_rate=0.3, max_depth=3), "one")})["m"]
    scored = model.transform(df).select("customerID", "Churn", "prediction", "scaled", vector_to_array("probability").alias("p"))
    assert scored.filter("(prediction = 1) = (Churn = 1)").count() > 0.85 * len(y)
    PipelineModel([model]).write().save(f"{tmp_path}/m")
    again = PipelineModel.load(f"{tmp_path}/m").transform(df).select("customerID", vector_to_array("probability")[1].alias("q"))
    assert scored.join(again, "customerID").filter("p[1] != q").count() == 0
    weights = model.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1.0) and weights[3] == 0.0 and model.params_used.rounds == 25
    attr = TS.attribute(df.select("customerID", vector_to_array("scaled").alias("x")), TS.node_table(model), list("abcd"), "x", "x")
    sums = attr.select("customerID", F.aggregate("attr", F.lit(0.0), lambda acc, s: acc + s["shap"]).alias("s"))
    margin = F.log(F.col("p")[1] / F.col("p")[0]) - F.lit(model.node_table().expectation())
    off = scored.join(sums, "customerID").agg(F.max(F.abs(margin - F.col("s")))).first()[0]
    assert off < 1e-8


def test_one_class_and_constant_features(spark):
    df, _, _ = table(spark, 60)
    model = B.fit(df.withColumn("Churn", F.lit(1)), {"m": (B.BoosterParams(rounds=3, from_average=True), "one")})["m"]
    assert model.transform(df).select(vector_to_array("probability")[1].alias("p")).agg(F.min("p")).first()[0] >= 0.5
    with pytest.raises(ValueError, match="no rows"):
        B.fit(df.limit(0), {"m": (B.BoosterParams(rounds=3), "one")})


def test_best_splits_of_features_of_unlike_sizes_equal_a_plain_search():
    chance = np.random.default_rng(5)
    sizes = [2, 7, 1, 2, 30]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    rows = 400
    bins = [chance.integers(0, s, rows) for s in sizes]
    g, h = chance.normal(size=rows), chance.random(rows) + 0.1
    hist = np.zeros((1, offsets[-1], 3))
    for f, b in enumerate(bins):
        for k, v in enumerate((g, h, np.ones(rows))):
            hist[0, offsets[f]:offsets[f + 1], k] = np.bincount(b, v, sizes[f])
    p = B.BoosterParams(min_rows=5)
    gain, feature, cut, left = B.best_splits(hist, offsets, p)[0]
    plain = {(f, c): B.split_gain(g[b <= c].sum(), h[b <= c].sum(), g.sum(), h.sum(), p)
             for f, b in enumerate(bins) for c in range(sizes[f] - 1) if 5 <= (b <= c).sum() <= rows - 5}
    assert (feature, cut) == max(plain, key=plain.get) and np.isclose(gain, max(plain.values()))
    assert np.allclose(left, [v[bins[feature] <= cut].sum() for v in (g, h, np.ones(rows))])


def test_features_that_share_a_code_are_counted_and_walked_as_if_apart():
    chance = np.random.default_rng(7)
    sizes, rows = [2, 300, 1, 2, 9, 2, 2000, 2, 13], 500
    bins = np.column_stack([chance.integers(0, s, rows) for s in sizes])
    bins[:, 5] = bins[:, 0]  # two equal columns
    packing = B.Packing.of(sizes)
    assert sorted(f for g in packing.groups for f in g) == list(range(9)) and len(packing.groups) < 6
    assert all(c <= B.MOST_CODES or len(g) == 1 for c, g in zip(packing.codes, packing.groups))
    codes, offsets = packing.pack(bins), np.concatenate([[0], np.cumsum(sizes)])
    tree = B.Tree()
    for _ in range(5):
        tree.add((0.0, 0.0, 0.0))
    tree.feature[:2], tree.bin[:2], tree.left[:2], tree.right[:2] = [1, 4], [120, 3], [1, 3], [2, 4]
    node = np.where(bins[:, 1] > 120, 2, np.where(bins[:, 4] > 3, 4, 3))
    assert packing.node_of(tree, codes).tolist() == node.tolist()
    label, weight, margin = chance.integers(0, 2, rows).astype(float), chance.choice([1.0, 2.7], rows), chance.normal(size=rows)
    block = B.Block(codes, *B._coded(label), [B._coded(weight)])
    hist, = B._histogram(block, [margin], [tree], [[3, 4]], offsets, packing, [True])
    p = 1 / (1 + np.exp(-margin))
    for k, v in enumerate((weight * (p - label), weight * p * (1 - p), np.ones(rows))):
        for i, n in enumerate((3, 4)):
            for f, s in enumerate(sizes):
                assert np.allclose(hist[k, i, offsets[f]:offsets[f + 1]], np.bincount(bins[node == n, f], v[node == n], s), atol=1e-9)
    assert (hist[:, :, offsets[0]:offsets[1]] == hist[:, :, offsets[5]:offsets[6]]).all()
    # Sums of any grouping are the same to the last bit.
    assert (hist[:, :, offsets[4]:offsets[5]].sum(2) == hist[:, :, offsets[6]:offsets[7]].sum(2)).all()
    assert B._histogram(block, [margin], [tree], [[3, 4]], offsets, packing, [False])[0].shape[0] == 2


def test_of_a_column_and_its_complement_the_first_is_split(spark):
    chance = np.random.default_rng(3)
    a = chance.integers(0, 2, 4000)
    y = (a == 1) ^ (chance.random(4000) < 0.1)
    rows = [(1.0 - v, float(v), int(t), 0.1 + 0.7 * (i % 3)) for i, (v, t) in enumerate(zip(a.tolist(), y))]
    df = VectorAssembler(inputCols=["b", "a"], outputCol="scaled").transform(
        spark.createDataFrame(rows, "b double, a double, Churn int, w double").repartition(4))
    model = B.fit(df, {"m": (B.BoosterParams(rounds=12), "w")})["m"]
    assert {f for k in range(12) for f, _ in tree_of(model, k).values()} == {0}
