"""Fits over all labelled rows in blocks: against fits of one array, with rows that only the later blocks have."""

import random

import numpy as np
import pytest

from tilewright.llm import labelled, quality

WORDS = "the of and thing erst onan tion ouea reth with from anin shen ndly".split()


def corpus(spark, n, rare=5, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        text = " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(rng.randint(3, 30)))
        bad = k % rare == 0
        rows.append((k, text.upper() if bad and rng.random() < 0.8 else text, int(not bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(n + 1, "no label"), (None, "no id"), (1, None)], "doc_id long, text string")
    return docs, spark.createDataFrame([(k, q) for k, _, q in rows] + [(2, None), (None, 1), (n + 9, 1)], "doc_id long, quality int")


def written_blocks(spark, n, rare=5):
    docs, labels = corpus(spark, n, rare)
    known = labelled.known_labels(labels)
    return labelled.blocks(docs, known, dict(map(tuple, known.groupBy("quality").count().collect())), quality.features)


@pytest.mark.parametrize("rare", [3, 50])
def test_every_labelled_row_is_in_a_block(spark, monkeypatch, rare):
    monkeypatch.setattr(labelled, "BLOCK_ROWS", 100)
    monkeypatch.setattr(labelled, "FEWEST_IN_BLOCK", 20)
    rows = written_blocks(spark, 1000, rare).toPandas()
    assert sorted(rows[rows.own].doc_id) == list(range(1000))
    assert not rows.duplicated(["block", "doc_id"]).any()
    assert rows[rows.quality == 0].groupby("block").size().reindex(range(10)).min() >= (5 if rare == 3 else 9)


def test_quality_is_learned_from_all_rows(spark, monkeypatch):
    """The weights are those of least loss over the pairs of all blocks, whatever they start from; the threshold is the quantile of all rows."""
    monkeypatch.setattr(labelled, "BLOCK_ROWS", 200)
    docs, labels = corpus(spark, 1500)
    one, other = (quality.train(docs, labels, rows) for rows in (800, 1400))
    assert np.abs(one.weights).max() > 0.1 and one.weights == pytest.approx(other.weights, abs=1e-4)
    assert one.threshold == pytest.approx(other.threshold, abs=1e-3) and one.slope == other.slope
    # the same by an array of all rows
    table = written_blocks(spark, 1500).toPandas().sort_values(["block", "doc_id"])
    x = np.stack([np.frombuffer(v, np.float32) for v in table.x]).astype(float)
    own = table.own.to_numpy()
    assert one.mean == pytest.approx(x[own].mean(axis=0), abs=1e-9) and one.scale == pytest.approx(np.maximum(x[own].std(axis=0), 1e-6), abs=1e-9)
    z, slope, pairs = np.clip((x - one.mean) / one.scale, -8, 8), 0, 0
    for b in set(table.block):
        rows = np.flatnonzero(table.block == b)
        better, worse = (rows[r] for r in quality.preferences(table.quality.to_numpy()[rows]))
        diff = z[better] - z[worse]
        slope, pairs = slope - (diff / (1 + np.exp(diff @ one.weights))[:, None]).sum(axis=0), pairs + len(diff)
    assert np.abs(slope / pairs + quality.RIDGE * one.weights).max() < 1e-5


def test_rows_beyond_the_start_count(spark, monkeypatch):
    """A feature of later blocks' rows alone has a weight, and rows of one label alone accept all."""
    monkeypatch.setattr(labelled, "BLOCK_ROWS", 100)
    docs, labels = corpus(spark, 1000)
    start = labelled._hash(61, 10)
    later = docs.selectExpr("doc_id", "case when doc_id % 5 = 0 then concat(text, '#####') else text end as text")
    docs = later.withColumn("first", start).join(docs.withColumnRenamed("text", "plain"), "doc_id").selectExpr("doc_id", "case when first < 5 then plain else text end as text")
    model = quality.train(docs, labels, 500)
    kind = quality._CLASS[ord("#")]
    assert model.weights[kind] < -0.05
    none = quality.train(docs, labels.filter("quality = 1"), 500)
    assert not none.weights.any() and {r["predicted"] for r in quality.score(docs, none).collect()} == {1}


def test_places_in_the_order(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate((rng.normal(size=300), [0.0, -0.0, 1e300, -1e300, 2.5, 2.5, 2.5]))
    found = spark.createDataFrame([(0, float(v)) for v in values], "quality int, m double")
    ranks = [0, 7, 150, 151, 303, len(values) - 1]
    assert labelled.at_ranks(found, ranks) == np.sort(values)[ranks].tolist()


def test_rules_are_learned_from_all_rows(spark, monkeypatch):
    """Rows in blocks give the weights that one array of all of them gives, and about the same calibration."""
    from tilewright.llm import quality_rules

    monkeypatch.setattr(labelled, "BLOCK_ROWS", 200)
    docs, labels = corpus(spark, 1200)
    whole, some = quality_rules.train(docs, labels, 1200), quality_rules.train(docs, labels, 900)
    assert np.abs(whole.weights).max() > 0.01
    assert some.mean == pytest.approx(whole.mean, abs=1e-6) and some.weights == pytest.approx(whole.weights, abs=2e-3)
    assert some.slope == pytest.approx(whole.slope, rel=0.1) and some.shift == pytest.approx(whole.shift, abs=0.2)
