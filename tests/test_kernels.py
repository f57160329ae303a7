import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelloom.functions import kernels as K
from panelloom.operators.snn import synthesise
from panelloom.spec import MssaConfig, PanelSpec, SnnConfig


def brute_biclique(mask):
    best = (0, 0)
    for r in range(1, mask.shape[0] + 1):
        for rows in itertools.combinations(range(mask.shape[0]), r):
            c = int(mask[list(rows)].all(axis=0).sum())
            if c:
                best = max(best, (min(r, c), r * c))
    return best


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 7), st.integers(1, 7), st.floats(0.1, 0.95))
def test_biclique_is_complete_and_maximal(seed, n, m, p):
    mask = np.random.default_rng(seed).random((n, m)) < p
    rows, cols = K.best_biclique(mask)
    assert mask[np.ix_(rows, cols)].all()
    assert min(len(rows), len(cols)) == brute_biclique(mask)[0]


def test_biclique_corner_cases():
    assert len(K.best_biclique(np.zeros((3, 3), bool))[0]) == 0
    r, c = K.best_biclique(np.ones((3, 2), bool))
    assert list(r) == [0, 1, 2] and list(c) == [0, 1]


def test_ranks():
    s = np.array([10.0, 1.0, 0.1])
    assert [K.spectral_rank(s, t) for t in (0.5, 0.99, 0.995, 1)] == [1, 1, 2, 3]
    assert K.universal_rank(s, 3, 3) == 1
    assert K.choose_rank(s, 3, 3, 2, 0.5) == 2
    assert abs(K.omega(1.0) - 2.86) < 1e-12


def test_pcr_recovers_span_and_drops_zero_values():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 12))
    y = x @ np.full(12, 0.5)
    beta, v = K.pcr(x, y, 5, None, 1e-7)
    assert np.allclose(x @ beta, y) and v.shape[0] == 2


def test_row_splits_and_hankel():
    assert [list(p) for p in K.row_splits(np.arange(7), 3)] == [[0, 1, 2], [3, 4], [5, 6]]
    ts = np.arange(9.0)
    assert np.allclose(K.unhankel(K.hankel(ts, 4)), ts)
    assert K.page(ts, 4).shape == (4, 2)


def test_masked_cp_recovers_noiseless_truth():
    rng = np.random.default_rng(0)
    f = [rng.uniform(0.5, 2, (n, 2)) for n in (20, 15, 3)]
    full = np.einsum("nk,tk,ik->nti", *f)
    seen = rng.random(full.shape) < 0.5
    index = list(np.nonzero(seen))
    g = K.masked_cp(index, full[seen], full.shape, 2, 500, 1e-9, 1e-14, 0)
    fit = np.einsum("nk,tk,ik->nti", *g)
    assert 1 - ((fit - full)[~seen] ** 2).sum() / ((full[~seen] - full[~seen].mean()) ** 2).sum() > 0.999


def test_mssa_continues_a_sine():
    t = np.arange(120)
    coefs, ar, rank, smooth = K.mssa_fit(np.sin(t / 5), 10, 2, "fixed", 0.9, False, 0.3, 0)
    assert np.allclose(K.mssa_predict(np.sin(t / 5), coefs, 5), np.sin((120 + np.arange(5)) / 5), atol=1e-6)
    assert np.isnan(K.mssa_predict(np.array([1.0] * 9 + [np.nan]), coefs, 1)).all() and rank == 2 and len(ar) == 0 and len(smooth) == 120


def test_ar_fit():
    x = [1.0, 0.5]
    for _ in range(50):
        x.append(0.6 * x[-1] + 0.2 * x[-2])
    assert np.allclose(K.ar_fit(np.array(x), 2), [0.6, 0.2])


def test_synthesise_aligns_rows_and_rejects_other_weights():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 3)) @ rng.normal(size=(3, 30))
    y, x1, x2, want = base[0, :20], base[1:, :20], base[1:, 20:], base[0, 20:]
    for cfg in (SnnConfig(max_rank=3), SnnConfig(max_rank=3, n_neighbors=3, weights="distance")):
        got = synthesise(y, x1, x2, cfg)
        assert np.allclose([g[0] for g in got], want, atol=1e-6) and all(g[1] for g in got)
    clipped = synthesise(y, x1, x2, SnnConfig(max_rank=3, min_value=0.0, max_value=0.5))
    assert all(0 <= g[0] <= 0.5 for g in clipped)
    with pytest.raises(ValueError):
        SnnConfig(weights="other")
    with pytest.raises(ValueError):
        MssaConfig(rank_rule="other")
    with pytest.raises(ValueError):
        PanelSpec("a", "a", ("b",), "c")


def test_copies_of_rows_weigh_as_rows_of_their_own(monkeypatch):
    for seed in range(12):
        rng = np.random.default_rng(seed)
        mask, copies = rng.random((7, 6)) < 0.6, rng.integers(1, 6, 7) * 2
        full = np.repeat(mask, copies, axis=0)
        of = np.repeat(np.arange(7), copies)
        for budget in (None, 5):
            rows, cols, exact = K.search_biclique(full, budget)
            for bits in (0, 1000):
                monkeypatch.setattr(K, "PLAIN_BITS", bits)
                r, c, e = K.search_biclique(mask, budget, copies)
                assert e == exact and r.tolist() == np.unique(of[rows]).tolist() and c.tolist() == cols.tolist()
