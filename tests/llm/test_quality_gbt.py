import numpy as np
import pyarrow as pa

from tessera.llm import quality_gbt


def test_trees_fit_and_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    model = quality_gbt.fit(x[:2000], y[:2000], trees=60)
    p = quality_gbt.score(model, x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95 and p.min() >= 0 and p.max() <= 1
    # the arrays say the same as walking each row alone
    binned = [np.searchsorted(model["cuts"][f], x[2000, f], "left") for f in range(4)]
    total = float(model["base"])
    for feature, bin_, leaf in zip(model["feature"], model["bin"], model["leaf"]):
        node = 0
        for _ in range(quality_gbt.DEPTH):
            node = 2 * node + 1 + int(binned[feature[node]] > bin_[node])
        total += leaf[node - (1 << quality_gbt.DEPTH) + 1]
    assert np.isclose(1 / (1 + np.exp(-total)), p[0])


def test_statistics():
    x = quality_gbt.statistics(pa.array(["Ab cd!\nab cd!", None, "", "é"]))
    names = quality_gbt.STATISTICS
    assert np.isclose(x[0, names.index("shout")], 2 / 13) and np.isclose(x[0, names.index("distinct")], 0.5)
    assert not x[1].any() and not x[2].any() and x[3, names.index("wide")] == 1


def test_held_out_accuracy(spark):
    rows = quality_gbt.query(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) and sum(1 - r.predicted for r in bad) >= 0.8 * len(bad)


def test_odd_rows(spark, odd, clash, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (5, None), (99, 0), (None, 1)], "doc_id bigint, quality int")
    model = quality_gbt.train(clash(odd), labels)
    got = quality_gbt.scored(clash(odd), model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    empty = quality_gbt.train(odd, labels.where("false"))
    assert {round(r.score, 6) for r in quality_gbt.scored(odd, empty).collect()} == {0.5}
    assert quality_gbt.scored(docs([]), empty).count() == 0
