import numpy as np

from quillon.llm import language_id as li


def buckets(word):
    return set(li.features_of([word], {})[1].tolist())


def test_letter_ngrams_over_long_runs():
    start, end = "ab" * 30, "xy" * 30
    plain, other = (buckets(start + middle + end) for middle in ("cdcdcdcd", "efefefef"))
    inner = buckets("cdcdcdcd")
    assert len(plain - other) >= 6 and len(inner & (plain - other)) >= 4  # c, d, cd, dc, cdc, dcd


def test_features_do_not_depend_on_the_other_words():
    words = ["sun", "a", "éclair", "ab" * 3000, "sun"]
    lexicons = {"en": frozenset(["sun", "a"]), "fr": frozenset(["a"])}
    of, found = li.features_of(words, lexicons)
    for n, w in enumerate(words):
        _, own = li.features_of([w], lexicons)
        assert sorted(found[of == n].tolist()) == sorted(own.tolist())


def test_every_letter_of_a_long_run_counts():
    text = "word " + "é" * 10_000 + "z"
    assert "".join(li.words_of(text)) == text.replace(" ", "") and max(map(len, li.words_of(text))) <= li.LONGEST


def test_a_full_memo_gives_the_same_marginals():
    rng = np.random.default_rng(3)
    words = ["".join(map(chr, 97 + rng.integers(0, 26, 5))) for _ in range(600)]
    weights = rng.normal(size=(li.BUCKETS, 3)).astype(np.float32)
    model = li.Model(["a", "b", "c"], weights, rng.normal(size=(3, 3)), rng.normal(size=3), {"a": frozenset(words[:5])})
    texts = [words[i : i + 40] for i in range(0, 600, 20)]
    small, large = li.Tagger(model, 10_000), li.Tagger(model)
    for t in texts + texts[::-1]:
        assert np.allclose(small.tag([t])[0], large.tag([t])[0])
