"""The score's step curve against the max-min formula, and its mean with the logistic curve."""

import numpy as np

from cohortry.llm import toxicity


def plain_steps(x, y):
    """Of every point the highest, over the points before it, of the lowest mean share that a stretch to a point behind it has."""
    points = np.unique(x)
    mean = lambda a, b: y[(x >= points[a]) & (x <= points[b])].mean()
    level = [max(min(mean(a, b) for b in range(i, len(points))) for a in range(i + 1)) for i in range(len(points))]
    out = []
    for value in sorted(set(np.round(level, 12))):
        own = [p for p, v in zip(points, level, strict=True) if round(v, 12) == value]
        rows = y[(x >= own[0]) & (x <= own[-1])]
        share = (rows.sum() + 0.5) / (len(rows) + 1)
        share = max(share, out[-1][1]) if out else share
        out += [(end, share) for end in sorted({own[0], own[-1]})]
    return out


def test_isotonic_is_the_plain_one():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        for _ in range(20):
            x = rng.integers(0, 12, n) / 4
            y = (rng.random(n) < x / 3).astype(float)
            assert np.allclose(toxicity._isotonic(x, y, np.ones(n)), plain_steps(x, y))


def test_weights_count_as_repeats():
    x, y = np.array([0.0, 1.0, 1.0, 2.0]), np.array([0.0, 1.0, 0.0, 1.0])
    weight = np.array([3.0, 1.0, 2.0, 2.0])
    assert np.allclose(toxicity._isotonic(x, y, weight), toxicity._isotonic(x, y, weight * 5))
    points = dict(toxicity._isotonic(x, y, weight))
    assert np.isclose(points[1.0], (0.5 + 0.5) / (1.5 + 1))  # weights are scaled to 4 rows


def test_score_is_the_mean_of_both_curves_and_rises():
    lexicon = toxicity.Lexicon({" nit ": 1.0}, (), 2.0, -1.0, ((0.0, 0.1), (0.3, 0.1), (0.6, 0.9)))
    plain = toxicity.Lexicon({" nit ": 1.0}, (), 2.0, -1.0)
    texts = ["", "a nit b c d e f g", "a nit b", "nit nit"]
    scores = [lexicon.score(t) for t in texts]
    for text, score in zip(texts, scores, strict=True):
        x = lexicon.density(toxicity.folded(text))
        assert np.isclose(score, (plain.score(text) + np.interp(x, [0, 0.3, 0.6], [0.1, 0.1, 0.9])) / 2)
    assert sorted(scores) == scores and len(set(scores)) == 4


def test_every_supported_entry_is_kept():
    rng = np.random.default_rng(2)
    names = [f" w{k:04d} " for k in range(300)]
    holders = [np.array([2 * k, 2 * k + 1]) for k in range(300)]
    chosen = toxicity._greedy(rng.random(300) + 1, names, holders, 2)
    assert sorted(chosen) == list(range(300))
