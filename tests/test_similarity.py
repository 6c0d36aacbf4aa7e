import random
import resource

import numpy as np
import pytest

from plumbline.functions import longtexts
from plumbline.functions import similarity as sim
from tests.helpers import name_score, partial, token_set


def _texts(seed, size, longest):
    random.seed(seed)
    make = lambda n: "".join(random.choice("abcde  é") for _ in range(random.randint(0, n))).strip()
    a = [make(longest) for _ in range(size)]
    return a, [make(longest) if random.random() < 0.6 else x + make(longest // 4) for x in a]


@pytest.mark.parametrize("size,longest", [(800, 12), (100, 90), (25, 200)])
def test_scores_equal_plain_definitions(size, longest):
    left, right = _texts(longest, size, longest)
    a, b, at = sim.Texts(left), sim.Texts(right), np.arange(size)
    tokens = [token_set(x, y) for x, y in zip(left, right)]
    parts = [partial(x, y) for x, y in zip(left, right)]
    assert np.allclose(sim.token_set_ratio(a, at, b, at), tokens)
    assert np.allclose(sim.partial_ratio(a.texts, b.texts), parts)
    common = np.minimum(a.histogram, b.histogram).sum(axis=1)
    bound = sim.upper_bound(common, np.minimum(a.least, b.least))
    assert (bound >= np.maximum(tokens, parts) - 1e-9).all()
    best = sim.name_score(a, at, b, at, bound)
    assert np.allclose(best, np.maximum(tokens, parts))


@pytest.mark.parametrize("longest", [6, 14, 40])
def test_gram_bound_never_undercuts_a_score(longest):
    left, right = _texts(longest + 1, 60, longest)
    words = ["acme", "steel", "of", "ohio", "co", "steal"]
    left[:30] = [" ".join(random.choices(words, k=random.randint(1, 5))) for _ in range(30)]
    right[:30] = [" ".join(random.choices(words, k=random.randint(1, 5))) for _ in range(30)]
    texts = sim.Texts(left + right)
    a, b = np.arange(60), np.arange(60, 120)
    bound = sim.gram_bound(texts, a, b)
    assert (bound <= 100).all()
    score = np.array([[name_score(x, y) for y in right] for x in left])
    assert (bound >= score - 1e-3).all()


def test_grid_counts_common_characters():
    a, b = sim.Texts(["aab", ""]), sim.Texts(["ab b", "zz", "aabb"])
    assert sim.common_grid(a.histogram, b.histogram).tolist() == [[2, 0, 3], [0, 0, 0]]


def test_known_scores():
    assert round(name_score("acme corp.", "acme corporation"), 2) == 94.74
    assert name_score("", "") == 100.0
    assert name_score("a", "") == 0.0


@pytest.mark.parametrize("letters,longest", [("ab", 9), ("abcde é😀", 40), ("ab ", 70)])
def test_one_sweep_has_every_window(letters, longest):
    random.seed(longest)
    make = lambda n: "".join(random.choice(letters) for _ in range(n))
    for _ in range(60):
        a, b = make(random.randint(1, longest)), make(random.randint(1, longest))
        if random.random() < 0.3:
            b = make(len(a))
        needle, hay = sorted((a, b), key=len)
        assert longtexts.partial_ratio(needle, hay) == pytest.approx(partial(needle, hay))
        assert longtexts.lcs_length(a, b) == longtexts.Braid(a, b).whole() == sim.lcs_lengths([a], [b])[0]


def test_long_pairs_score_like_short_ones(monkeypatch):
    left, right = _texts(3, 60, 60)
    left, right = [*left, "", "abc"], [*right, "", ""]
    a, b, at = sim.Texts(left), sim.Texts(right), np.arange(len(left))
    whole = sim.token_set_ratio(a, at, b, at), sim.partial_ratio(a.texts, b.texts)
    monkeypatch.setattr(sim, "_CELLS", 20)
    alone = sim.token_set_ratio(a, at, b, at), sim.partial_ratio(a.texts, b.texts)
    assert np.allclose(whole[0], alone[0]) and np.allclose(whole[1], alone[1])


def test_long_texts_take_little_memory():
    random.seed(5)
    hay = "".join(random.choices("abcdefgh ", k=30_000))
    needle = hay[9_000:21_000].replace("a", "b")
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (score,) = sim.partial_ratio(np.array([needle], object), np.array([hay], object))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000
    assert 100 * (1 - needle.count("b") / len(needle)) <= score < 100
