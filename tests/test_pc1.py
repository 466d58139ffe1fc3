"""Leading eigenvectors on the table of cells against a full decomposition."""

import numpy as np
import pytest

from locusframe.operators import scores
from locusframe.plans import registry
from locusframe.plans import views as V


def _maps(n):
    rng = np.random.default_rng(6)
    noise = rng.standard_normal((n, n))
    turn = np.linalg.qr(rng.standard_normal((n, n)))[0]
    near = np.concatenate([[5.0, 5.0 * (1 - 1e-3), -5.0 * (1 - 2e-3)], rng.uniform(-4, 4, n - 3)])
    plaid = np.sign(np.sin(np.arange(n) / 9.0))
    return {"noise": (noise + noise.T) / 2, "near": turn * near @ turn.T, "plaid": np.outer(plaid, plaid) * 0.4 + (noise + noise.T) * 0.1}


@pytest.mark.parametrize("work", [scores.pc1, scores.pc1_cells])
def test_pc1_equals_a_full_decomposition(spark, work):
    n, dead = (250, [0, 57, 58, 249]) if work is scores.pc1_cells else (60, [0, 20, 59])
    rows, want = [], {}
    for run, a in _maps(n).items():
        value = a + 1
        alive = np.setdiff1d(np.arange(n), dead if run == "plaid" else [])
        rows += [(run, int(i), int(j), float(value[i, j])) for i in alive for j in alive]
        e, v = np.linalg.eigh(a[np.ix_(alive, alive)])
        x = v[:, np.argmax(np.abs(e))]
        want[run] = dict(zip(alive.tolist(), x * np.sign(x[np.argmax(np.abs(x))]), strict=True))
    table = spark.createDataFrame(rows, "run string, i int, j int, value double")
    got = {}
    for r in work(table, n).collect():
        got.setdefault(r.run, {})[r.bin] = r.value
    for run, x in want.items():
        assert len(got[run]) == n
        assert max(abs(got[run][b] - y) for b, y in x.items()) < 1e-5
    for b in dead[1:-1]:  # masked bins have the mean of three bins before and two after
        near = [want["plaid"][c] for c in range(b - 3, b + 3) if c in want["plaid"]]
        assert abs(got["plaid"][b] - np.mean(near)) < 1e-5


@pytest.mark.parametrize("name,resolution,bins", [("prj09_select_runs", "8Mb", 25), ("cmp12_pool_experiments", "4Mb", 50)])
def test_sweep_scores_are_eigenvectors(spark, name, resolution, bins):
    """The second score of a sweep is each map's eigenvector, not something made of its insulation."""
    sf = "/root/testdata/sf0.001"
    maps = V.contacts(spark, sf, bins, registry.EXPERIMENTS).toPandas()
    want = {}
    for key, m in maps.groupby(["experiment", "run"]):
        a = np.zeros((bins, bins))
        a[m["i"], m["j"]] = m["value"]
        oe = np.zeros((bins, bins))
        for i, j in zip(m["i"], m["j"], strict=True):
            d = abs(i - j)
            cells = m.loc[abs(m["i"] - m["j"]) == d, "value"]
            oe[i, j] = a[i, j] / (1 if d == 0 else cells.mean()) - 1
        values, vectors = np.linalg.eigh((oe + oe.T) / 2)
        v = vectors[:, np.argmax(abs(values))]
        want[key] = v * np.sign(v[np.argmax(abs(v))])
    got = registry.queries()[name](spark, sf).where("score_type = 'PC1'").toPandas()
    assert len(got) == (2 * 2 * bins)
    for x in got.itertuples():
        true = want[x.experiment, x.run][x.bin] - (want[x.experiment, "N"][x.bin] if name.startswith("cmp12") else 0)
        assert getattr(x, "resolution", resolution) == resolution
        assert abs(x.value - true) < 2e-6
