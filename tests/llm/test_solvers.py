"""The linear fit against a plain solver, and the chain against one made of such fits."""

import numpy as np
import pytest

from sievemill.llm import toxicity
from sievemill.llm.toxicity import BITS, FOLDS, PENALTY, SEEN, SIGMAS, fit_chain, fit_linear, probability


def some(seed, n=600, words=40, extra=1):
    rng = np.random.default_rng(seed)
    lists = [np.unique(rng.integers(0, words, rng.integers(1, 25))) for _ in range(n)]
    logit = np.array([3.0 * (3 in x) - 4.0 * (7 in x) + 2.0 * (11 in x) - 0.3 for x in lists])
    y = (rng.random(n) < 1 / (1 + np.exp(-logit))).astype(float)
    at = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    return np.concatenate(lists).astype(np.int64), at, rng.random((n, extra)), y, lists


def newton(lists, before, y, chosen):
    """Logistic regression with the same penalty by Newton steps on a dense matrix: weights of the chosen cells, of what came before, and the constant."""
    x = np.zeros((len(y), len(chosen) + before.shape[1] + 1))
    for i, own in enumerate(lists):
        x[i, : len(chosen)] = np.isin(chosen, own)
    x[:, len(chosen) : -1], x[:, -1] = before, 1
    ridge = np.full(x.shape[1], PENALTY)
    ridge[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (p - y) / len(y) + ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(y) + np.diag(ridge)
        w = w - np.linalg.solve(hessian, slope)
    return w


def usable(lists, y):
    """Cells in enough texts whose share of positive ones is off by enough."""
    found, share = [], y.mean()
    for cell in sorted({int(c) for x in lists for c in x}):
        has = np.array([cell in x for x in lists])
        seen, hits = has.sum(), (has & (y > 0)).sum()
        if seen >= SEEN and (hits - seen * share) ** 2 >= SIGMAS**2 * max(seen * share * (1 - share) * (1 - seen / len(y)), 1e-9):
            found.append(cell)
    return np.array(found, np.int64)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fit_against_newton(monkeypatch, seed):
    monkeypatch.setattr(toxicity, "STEPS", 20_000)
    cells, at, before, y, lists = some(seed)
    chosen = usable(lists, y)
    model = fit_linear(cells, at, before, y)
    assert set(np.flatnonzero(model.words)) <= set(chosen.tolist()) and len(chosen) >= 1
    want = newton(lists, before, y, chosen)
    got = np.concatenate([model.words[chosen], model.earlier, [model.constant]])
    assert np.abs(got - want).max() < 2e-3, (got, want)


def test_given_steps_come_near(monkeypatch):
    """The number of steps in use gives probabilities near those of the solved problem."""
    cells, at, before, y, lists = some(5, n=600)
    near = probability(fit_linear(cells, at, before, y).log_odds(cells, at, before))
    chosen = usable(lists, y)
    w = newton(lists, before, y, chosen)
    x = np.array([np.isin(chosen, own) for own in lists], float)
    solved = 1 / (1 + np.exp(-(x @ w[: len(chosen)] + before @ w[len(chosen) : -1] + w[-1])))
    assert np.abs(near - solved).max() < 0.02


def test_chain_against_single_fits():
    """Each category's held-out probabilities come from fits without the fold, and feed the next category."""
    cells, at, _, y, lists = some(9, n=300)
    labels = np.stack([y, ((y > 0) ^ (np.arange(300) % 7 == 0)).astype(float)], axis=1)
    fold = np.arange(300) % FOLDS
    chain = fit_chain(cells, at, labels, fold, ["first", "second"])
    before = np.zeros((300, 0))
    part = lambda mask: (np.concatenate([lists[i] for i in np.flatnonzero(mask)]), np.concatenate([[0], np.cumsum([len(lists[i]) for i in np.flatnonzero(mask)])]))
    for c in range(2):
        unseen = np.zeros(300)
        for k in range(FOLDS):
            held = fold == k
            unseen[held] = probability(fit_linear(*part(~held), before[~held], labels[~held, c]).log_odds(*part(held), before[held]))
        assert np.abs(chain.out_of_fold[:, c] - unseen).max() < 1e-6
        before = np.hstack([before, unseen[:, None]])
    assert chain.models[1].earlier.shape == (1,) and abs(chain.models[1].earlier[0]) > 0 and len(chain.models[0].words) == 1 << BITS
