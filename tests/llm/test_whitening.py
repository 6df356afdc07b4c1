import math

import numpy as np
import pytest

from postbag.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, component string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in rows], SCHEMA)


def expected(vectors):
    """By an eigenvalue decomposition of the whole covariance; deviations in whole numbers of any size."""
    x = [tuple(math.floor(256 * float(np.float32(c))) for c in v) for v in vectors]
    fit = np.array(sorted(set(x)), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit - sums / n).astype(float)
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    dev = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums))) for row in x]
    projected = (np.array(x, float) - (sums / n).astype(float)) @ axes / np.sqrt(np.maximum(values, 1e-300))
    return n, dev, projected, values / np.trace(cov)


@pytest.fixture(scope="module")
def vectors():
    draw = np.random.default_rng(3)
    base = draw.standard_normal((900, 40)) * np.linspace(1.0, 0.7, 40)
    out = [list(map(float, v)) for v in base.astype(np.float32)]
    return out + [out[5]] * 300 + [out[6], [0.0] * 40, [-0.0] * 40]


def check(found, vectors, k=4):
    n, dev, projected, explained = expected(vectors)
    assert len(found) == k * len(vectors)
    signs = {}
    for r in found:
        own, c = projected[r.vec_id][r.component - 1], r.component
        assert (r.n, r.deviation) == (n, dev[r.vec_id])
        assert r.explained == pytest.approx(explained[c - 1], rel=1e-9)
        assert r.identity_error < 1e-8
        if abs(own) > 1e-6:
            assert signs.setdefault(c, np.sign(own * r.whitened)) == np.sign(own * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(own), rel=1e-7, abs=1e-8)


def test_against_a_whole_decomposition(spark, vectors):
    check(wh.whitening_digests(frame(spark, list(enumerate(vectors)))).collect(), vectors)


def test_a_small_block_is_filtered_until_certified(spark, vectors):
    fit = frame(spark, list(enumerate(vectors))).select(wh.whole(wh.F.col("embedding")).alias("x")).distinct()
    fit = wh.pin(fit, "fit")
    found = wh.principal_components(fit, block=10, degree=10)
    assert found.rounds > 1 and found.residuals.max() <= wh.LEAST and found.vectors.shape == (40, 4)
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(4), atol=1e-12)


def test_the_polynomial_is_small_below_and_one_at_the_top():
    values = np.array([3.0, 2.0, 1.0, 0.5, 0.0])
    out = np.diag(wh.chebyshev(lambda q: values[:, None] * q, np.eye(5), np.diag(values), 9, 1.0, 3.0))
    assert out[0] == pytest.approx(1) and abs(out[2:]).max() < 1e-5 < out[1]


def test_rows_that_take_no_part(spark, vectors):
    odd = [
        (1000, None), (1001, []), (1002, [None] + vectors[0][1:]), (1003, [float("nan")] + vectors[0][1:]),
        (1004, [float("inf")] + vectors[0][1:]), (1005, vectors[0][:-1]), (1006, vectors[0] + [1.0]), (None, None),
    ]
    found = wh.whitening_digests(frame(spark, list(enumerate(vectors[:300])) + odd)).collect()
    check(found, vectors[:300])


def test_few_dimensions_rows_and_no_variance(spark):
    line = [[1.0, 2.0], [2.0, 4.0], [3.0, 6.0]]
    found = wh.whitening_digests(frame(spark, list(enumerate(line)))).collect()
    assert {r.component for r in found} == {1} and sorted(round(abs(r.whitened), 9) for r in found) == [0, 1.224744871, 1.224744871]
    assert found[0].explained == pytest.approx(1)
    assert wh.whitening_digests(frame(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect() == []
    assert wh.whitening_digests(frame(spark, [])).collect() == []
    assert wh.whitening_digests(frame(spark, [(1, None)])).collect() == []
    three = [(i, v) for i, v in enumerate([[1.0, 0.0, 0.5], [0.0, 3.0, 0.25], [0.5, 0.5, 9.0], [2.0, 1.0, 1.0], [0.0, 0.0, 0.0]])]
    check(wh.whitening_digests(frame(spark, three)).collect(), [v for _, v in three], k=3)


def test_deviations_too_large_for_a_long(spark):
    rows = [(0, [4e6, 0.0]), (1, [-4e6, 1.0]), (2, [0.0, 0.5])]
    n, dev, *_ = expected([v for _, v in rows])
    found = {r.vec_id: r.deviation for r in wh.whitening_digests(frame(spark, rows)).collect()}
    assert found == {i: d if d < 2**63 else None for i, d in enumerate(dev)} and None in found.values()


def test_missing_and_repeated_ids(spark, vectors):
    found = wh.whitening_digests(frame(spark, [(None, vectors[0]), (7, vectors[0]), (7, vectors[0]), (8, vectors[1]), (9, vectors[2])])).collect()
    values = {r.whitened for r in found if r.vec_id in (None, 7) and r.component == 1}
    assert len(found) == 5 * len({r.component for r in found}) and max(values) - min(values) < 1e-12
