"""The label model of toxicity against exact posteriors of planted voters."""

from __future__ import annotations

import numpy as np
import pytest

from varsparq.llm import toxicity


def planted(seed, prior, silent_rate=0.02, n=6000):
    r = np.random.default_rng(seed)
    y = r.random(n) < prior
    rate_1, rate_0 = np.array([0.6, 0.5, 0.4, 0.35, 0.3, 0.5]), np.full(6, silent_rate)
    votes = r.random((n, 6)) < np.where(y[:, None], rate_1, rate_0)
    odds = np.log(prior / (1 - prior)) + (votes * np.log(rate_1 / rate_0) + ~votes * np.log((1 - rate_1) / (1 - rate_0))).sum(1)
    return y, votes, 1 / (1 + np.exp(-odds))


@pytest.mark.parametrize("prior", [0.05, 0.15])
def test_posteriors_order_rows_as_the_exact_ones(prior):
    y, votes, exact = planted(1, prior)
    got = toxicity.label_model(votes, prior)
    some = votes.sum(1)
    assert ((got > 0.5) == (exact > 0.5))[some != 1].mean() > 0.99  # a single vote is a close call
    assert got[some >= 2].min() > 0.9 and got[some == 0].max() < prior / 3
    assert len(set(got[some == 0])) == 1  # estimated, and the same for all silent rows
    assert np.mean(((got > 0.5) == y)[some != 1]) > 0.97


def test_silent_rows_follow_the_share_of_toxic_ones():
    low, high = (toxicity.label_model(planted(2, prior)[1], prior) for prior in (0.03, 0.3))
    silent = lambda prior, p: p[~planted(2, prior)[1].any(1)][0]
    assert 0 < silent(0.03, low) < silent(0.3, high) < 0.3


def test_copies_of_a_voter_count_once():
    y, votes, _ = planted(3, 0.1)
    alone = toxicity.label_model(votes, 0.1)
    copied = toxicity.label_model(np.column_stack([votes, *[votes[:, 0]] * 5]), 0.1)
    only = votes[:, 0] & (votes.sum(1) == 1)
    assert abs(copied[only].mean() - alone[only].mean()) < 0.1  # without shared weight, six votes of one would settle it
