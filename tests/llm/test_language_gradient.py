import itertools

import numpy as np

from quillon.llm import language_id as li


def setup():
    rng = np.random.default_rng(7)
    words = ["sol", "sun", "soleil", "a", "il", "the"]
    sequences = [[(words[j], int(rng.integers(3))) for j in rng.integers(0, 6, n)] for n in (1, 4, 3, 2)]
    training = li.Training(sequences, ["x", "y", "z"], {"x": frozenset(["sol", "a"])}, penalty=0.01)
    return sequences, training, rng.normal(size=(len(training.used), 3)), rng.normal(size=(3, 3)), rng.normal(size=3)


def test_likelihood_equals_a_sum_over_all_labellings():
    sequences, training, theta, step, first = setup()
    weights = np.zeros((li.BUCKETS, 3))
    weights[training.used] = theta
    total = 0.0
    for s in sequences:
        score = {w: weights[li.features_of([w], {"x": frozenset(["sol", "a"])})[1]].sum(axis=0) for w, _ in s}
        path = lambda ys: first[ys[0]] + sum(score[w][y] for (w, _), y in zip(s, ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:]))
        total += path([y for _, y in s]) - np.logaddexp.reduce([path(ys) for ys in itertools.product(range(3), repeat=len(s))])
    expected = total / sum(map(len, sequences)) - 0.005 * (theta**2).sum()
    assert abs(training.value(theta, step, first)[0] - expected) < 1e-9


def test_gradients_equal_finite_differences():
    _, training, *parameters = setup()
    _, gradients = training.value(*parameters)
    rng = np.random.default_rng(1)
    for which in range(3):
        flat = gradients[which].reshape(-1)
        for i in rng.choice(flat.size, min(20, flat.size), replace=False):
            moved = []
            for sign in (1, -1):
                changed = [p.copy() for p in parameters]
                changed[which].reshape(-1)[i] += sign * 1e-6
                moved.append(training.value(*changed)[0])
            assert abs((moved[0] - moved[1]) / 2e-6 - flat[i]) < 1e-7
