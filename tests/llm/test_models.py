"""Learned operators: held-out accuracy, isolation of held-out rows, awkward tables."""
import zlib

import numpy as np
import pyarrow as pa
import pytest

from cataloom.llm import language as lang
from cataloom.llm import quality as qual
from cataloom.llm import toxicity as tox
from cataloom.llm.queries import QUERIES

MEDIUM = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}


def test_language_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = QUERIES["op3_language"](spark, MEDIUM).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97


@pytest.mark.parametrize("name,column,parts,bucket,least", [("op5_quality", "quality", 5, 0, 0.95), ("op7_toxicity", "toxic", 3, 1, 0.85)])
def test_held_out(spark, labels, name, column, parts, bucket, least):
    rows = QUERIES[name](spark, MEDIUM).collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % parts == bucket) and 0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == int(r["score"] >= (0.3 if column == "quality" else 0.7)) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]][column]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([p == y for p, y in held]) > least


def test_awkward_tables(spark, awkward, empty):
    known = spark.createDataFrame([(0, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (7, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
    none = known.limit(0)
    for call in (lambda d, x: tox.toxicity(d, x), lambda d, x: qual.quality(d, x), lambda d, x: lang.language(d)):
        for labelled in (known, none):
            out = call(awkward, labelled)
            assert out.count() == awkward.count() and {*awkward.columns} <= {*out.columns} | {"score"}
            assert all(0 <= r["score"] <= 1 for r in out.collect())
            assert call(empty, labelled).count() == 0
    found = {(r["doc_id"], r["text"]): r for r in lang.language(awkward).collect()}
    assert found[(12, "!!! ???")]["lang_pred"] == "und" and found[(4, "")]["lang_pred"] == "und"


def test_gradients():
    """Analytic gradients of the network agree with differences."""
    rng = np.random.default_rng(0)
    f = lambda *s: rng.standard_normal(s) * 0.3
    h, d = tox.HIDDEN, tox.DIM
    p = {"wx": f(2, 2 * d, 3 * h), "u": f(2, h, 3 * h), "b": f(2, 3 * h), "att": f(2 * h), "out": f(2 * h), "bias": f(1)}
    vectors = f(20, 2 * d)
    ids = rng.integers(0, 20, (5, tox.WINDOW))
    valid = (np.arange(tox.WINDOW) < rng.integers(3, tox.WINDOW + 1, 5)[:, None]).astype(float)
    y, w = np.array([0, 1, 0, 1, 1.0]), np.ones(5)

    def loss():
        states, _ = tox._run(p, np.stack([vectors @ p["wx"][k] + p["b"][k] for k in (0, 1)]), ids, valid)
        logit = tox._pool(p, states, valid)[4]
        return np.mean(np.logaddexp(0, logit) - y * logit)

    g, _, _ = tox._gradients(p, vectors, np.stack([vectors @ p["wx"][k] + p["b"][k] for k in (0, 1)]), ids, valid, y, w)
    for name in p:
        flat, at = p[name].reshape(-1), int(rng.integers(p[name].size))
        old = flat[at]
        flat[at] = old + 1e-2
        up = loss()
        flat[at] = old - 1e-2
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-2 - g[name].reshape(-1)[at]) < 2e-4 + 0.05 * abs(g[name].reshape(-1)[at]), name


def test_trees_split_and_traverse():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = qual.fit(x[:400], y[:400])
    assert np.mean((qual.predict(model, x[400:]) > 0.5) == (y[400:] == 1)) > 0.9


def test_windows_cover_all_words():
    first, length, text = tox.windows_of(np.array([0, 0, 5, 5 + 32, 37 + 100]))
    for t, (a, b) in enumerate([(0, 0), (0, 5), (5, 37), (37, 137)]):
        seen = {i for s, n, k in zip(first, length, text) if k == t for i in range(s, s + n)}
        assert seen == set(range(a, b))


def test_statistics_of_odd_texts():
    assert qual.statistics(pa.array([None, "", "a"])).shape == (3, len(qual.NAMES))
