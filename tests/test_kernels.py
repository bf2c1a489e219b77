import itertools
import math

import numpy as np
import pandas as pd
import pytest

from marketlab.functions import kernels as K
from marketlab.functions import stats as S
from marketlab.functions.trees import Forest, Tree


def test_tick_signs_carry_over_no_change():
    assert K.tick_signs(np.array([1, 1, 2, 2, 1, 1.0])).tolist() == [1, 1, 1, 1, -1, -1]


def test_default_imbalance_bar_closes_at_the_second_tick():
    ids = K.bar_ids(np.array([1.0, 2.0, 3.0, 4.0]), "imbalance")
    assert ids[:2].tolist() == [0, 0] and ids[2] == 1


@pytest.mark.parametrize("kind", ["imbalance", "run"])
def test_bars_of_a_prefix_are_a_prefix_of_the_bars(kind):
    mid = np.cumsum(np.random.default_rng(1).standard_normal(2000)) + 100
    whole, part = K.bar_ids(mid, kind, expected_ticks=20), K.bar_ids(mid[:1200], kind, expected_ticks=20)
    closed = part >= 0
    assert (whole[:1200][closed] == part[closed]).all()
    assert len(K.bar_ids(mid[:0], kind)) == 0 and K.bar_ids(mid[:1], kind).tolist() == [-1]


def test_ewm_matches_its_definition():
    x = np.random.default_rng(2).standard_normal(60)
    a = 2 / 21
    w = np.array([(1 - a) ** 59, *[a * (1 - a) ** (59 - i) for i in range(1, 60)]])
    m = w @ x
    assert K.ewm_std(x, 20)[-1] == pytest.approx(math.sqrt((w @ (x - m) ** 2) / (1 - w @ w)))


def test_cusum_skips_rows_without_threshold():
    r, h = np.array([0.5, np.nan, 0.6, -2.0]), np.array([1.0, 1.0, 1.0, 0.0])
    assert K.cusum(r, h).tolist() == [0, 0, 1, 0]


def test_lz_counts_phrases():
    assert K.lz_phrases([0] * 10) == 2 and K.lz_phrases([0, 1]) == 2
    assert K.lz_phrases([0, 0, 0, 1, 1, 0, 1, 0, 0, 1, 0, 0, 0, 1, 0, 1]) == 6


def test_ffd_of_order_one_is_the_difference_and_truncation_invariant():
    x = np.random.default_rng(3).standard_normal(300).cumsum()
    w = K.ffd_weights(1.0)
    assert w.tolist() == [1.0, -1.0] and np.allclose(K.ffd(x, 1.0), np.diff(x)[1:])
    a, b = K.ffd(x, 0.4, 1e-2), K.ffd(x[:200], 0.4, 1e-2)
    assert (a[: len(b)] == b).all() and len(K.ffd(x[:3], 0.4)) == 0
    with pytest.raises(ValueError):
        K.ffd_weights(1.5)


def test_gsadf_equals_every_window():
    y = np.random.default_rng(4).standard_normal(45).cumsum()
    best = max(K.adf_lag0_tstat(y[a:b]) for a, b in itertools.combinations(range(46), 2) if b - a >= 20)
    assert K.gsadf(y) == pytest.approx(best, rel=1e-9)
    assert K.gsadf(np.ones(100)) == 0 and K.gsadf(y[:10]) == 0
    bubble = np.concatenate([y, y[-1] + 1.15 ** np.arange(40)])
    assert K.gsadf(bubble) > K.gsadf(y)


def test_distributions():
    assert S.f_quantile(0.95, 2, 30) == pytest.approx(3.3158, abs=1e-3)
    assert S.t_sf(2.0, 10) == pytest.approx(0.036694, abs=1e-5)
    assert S.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)
    assert S.bet_size(0.5) == 0 and 0 < S.bet_size(0.6) < S.bet_size(0.9) < 1


def test_adf_tells_noise_from_a_walk():
    r = np.random.default_rng(5)
    assert S.adf_pvalue(r.standard_normal(400)) < 0.01
    assert S.adf_pvalue(r.standard_normal(400).cumsum()) > 0.05
    with pytest.raises(ValueError):
        S.adf_pvalue(np.arange(10.0))


def test_shapiro_tells_normal_from_skewed():
    r = np.random.default_rng(6)
    assert S.shapiro_p(r.standard_normal(200)) > 0.05 > S.shapiro_p(r.exponential(size=200))


def test_deflated_sharpe_needs_trials_and_falls_with_them():
    few = S.deflated_sharpe(500, 0.2, 0, 3, 30, 0.05)
    assert few > S.deflated_sharpe(500, 0.2, 0, 3, 3000, 0.05) and S.deflated_sharpe(500, 0.2, 0, 3, 10, 0.05) == 0


def test_forest_learns_and_is_deterministic():
    r = np.random.default_rng(7)
    x = r.standard_normal((400, 3))
    y = (x[:, 0] > 0).astype(float)
    p = Forest(20, seed=1).fit(x[:300], y[:300]).predict(x[300:])
    assert ((p > 0.5) == y[300:]).mean() > 0.9
    assert (p == Forest(20, seed=1).fit(x[:300], y[:300]).predict(x[300:])).all()
    assert Tree().fit(x, np.ones(400), np.ones(400)).predict(x).tolist() == [1.0] * 400


def test_sequential_bootstrap_prefers_unique_labels():
    from marketlab.operators.models import sequential_bootstrap

    t0, t1 = np.array([0, 0, 0, 0, 10]), np.array([5, 5, 5, 5, 15])
    rows = np.concatenate([sequential_bootstrap(t0, t1, 3, np.random.default_rng(i))[0] for i in range(400)])
    assert (rows == 4).mean() > 0.24
    a = sequential_bootstrap(t0, t1, 5, np.random.default_rng(1))
    b = sequential_bootstrap(t0, t1, 5, np.random.default_rng(1))
    assert (a[0] == b[0]).all() and ((a[1] > 0) & (a[1] <= 1)).all()


def test_ewm_agrees_with_pandas_shift():
    x = pd.Series(np.random.default_rng(8).standard_normal(150))
    assert np.isnan(K.ewm_std(x.to_numpy(), 100)[:99]).all() and not np.isnan(K.ewm_std(x.to_numpy(), 100)[99])
