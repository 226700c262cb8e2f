import random
import zlib

import numpy as np

from quillon.llm import language_id as li
from quillon.llm import toxicity as tox

CIVIL = "we like tea and cake in the garden near river with friends while music plays softly every evening after work".split()
RUDE = ["rotterish", "rotterly", "rottering", "vilebag"]


def civil(rng, n=12):
    return " ".join(rng.choice(CIVIL) + rng.choice(["", "s", "er", "ly"]) for _ in range(n))


def test_toxicity_holds_out_and_generalises(spark):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        docs.append((i, civil(rng) + (" " + rng.choice(RUDE) if bad else "") + ". " + civil(rng), "en"))
        labels.append((i, int(bad)))
    docs += [(1000, "you rotterful thing", None), (1001, None, None), (1002, "", None), (1002, "", None), (None, "vilebag", None), (1003, " ".join(civil(rng) for _ in range(3000)), None)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame(labels + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    weights = tox.train(df, marks)
    found = tox.score(df, weights).collect()
    assert len(found) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in found)
    by = {r.doc_id: r for r in found}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    wrong = [i for i, y in labels if by[i].predicted != y]
    assert len(wrong) <= 6
    assert by[1000].predicted == 1 and by[1001].score == by[1002].score == 0 and by[None].predicted == 1 and by[1003].predicted == 0
    kept = tox.keep_civil(df, weights)
    assert kept.columns == df.columns and kept.count() == sum(1 - r.predicted for r in found)
    assert tox.score(df.limit(0), weights).count() == 0 and not tox.train(df.limit(0), marks)[1:].any()


def test_counterfactual_penalty_frees_identity_terms():
    rng = random.Random(2)
    texts, labels, swaps = [], [], []
    for i in range(400):
        bad = i % 2
        named = "muslims" if bad and i % 4 == 1 else "women" if i % 8 == 0 else ""
        text = civil(rng, 8) + f" {named}" + (" vilebag" if bad and i % 8 < 6 else "")
        texts.append(tox.words_of(text))
        labels.append(bad)
        swaps.append((texts[-1], tox.counterfactuals(sorted(texts[-1]))))
    assert ("muslims", "christians") in [p for _, pairs in swaps for p in pairs]
    neutral = "muslims like tea and cake"
    plain, fair = (tox.Intensities(tox.Problem(texts, np.array(labels), swaps, penalty).solve()) for penalty in (0.0, tox.PENALTY))
    assert plain.score(neutral) > 0.95 and fair.score(neutral) < tox.THRESHOLD < fair.score("vilebag")


LANGS = {"aa": ["strun", "brunt", "krist", "glost", "prenk"], "bb": ["ola", "emia", "uvo", "aneo", "isu"], "cc": ["zhyx", "qyz", "xuzh", "yzyq", "zzux"]}


def sentence(rng, lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(LANGS[lang])[:2] for _ in range(n))


def brute_marginals(emit, step, first):
    n, k = emit.shape
    f, b = np.zeros((n, k)), np.ones((n, k))
    f[0] = first * emit[0]
    for t in range(1, n):
        f[t] = (f[t - 1] @ step) * emit[t]
        f[t] /= f[t].sum()
    for t in range(n - 2, -1, -1):
        b[t] = step @ (emit[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    p = f * b
    return p / p.sum(axis=1, keepdims=True)


def test_chunked_forward_backward_equals_plain():
    rng = np.random.default_rng(3)
    step, first = rng.random((3, 3)) + 0.05, rng.random(3)
    lengths = [1, 5, 8, 9, 16, 17, 100, 0, 3]
    emits = [rng.random((n, 3)) + 1e-3 for n in lengths]
    chunk = 8
    chunks = [-(-n // chunk) for n in lengths]
    e, mask = np.ones((sum(chunks), chunk, 3)), np.zeros((sum(chunks), chunk), bool)
    starts = np.concatenate([[0], np.cumsum(chunks)])
    for x, at in zip(emits, starts):
        e.reshape(-1, 3)[at * chunk : at * chunk + len(x)] = x
        mask.reshape(-1)[at * chunk : at * chunk + len(x)] = True
    found = li.marginals(e, mask, np.repeat(np.arange(len(lengths)), chunks), step, first).reshape(-1, 3)
    for x, at in zip(emits, starts):
        if len(x):
            assert np.allclose(found[at * chunk : at * chunk + len(x)], brute_marginals(x, step, first))


def test_language_of_texts_and_switches(spark):
    rng = random.Random(4)
    docs = [(i, sentence(rng, l := list(LANGS)[i % 3], rng.randint(5, 60)), l if i % 11 else None) for i in range(400)]
    docs += [(1000, None, "aa"), (1001, "123 !! ²", "aa"), (1002, "", None), (None, docs[0][1], "aa"), (1003, " ".join(sentence(rng, "bb", 500) for _ in range(40)), None)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, lang string, lang_pred string")
    model = li.train(df, epochs=20)
    assert model.labels == ["aa", "bb", "cc"]
    found = li.predict(df, model).collect()
    by = {r.doc_id: r for r in found}
    assert len(found) == len(docs) and all(0 <= r.score <= 1 for r in found)
    assert all(by[i].lang_pred == list(LANGS)[i % 3] and by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert all(by[i].lang_pred == "und" for i in (1000, 1001, 1002)) and by[1003].lang_pred == "bb" and by[None].lang_pred == "aa"
    mixed = sentence(rng, "aa", 30) + " " + sentence(rng, "cc", 30)
    tagged = li.Tagger(model).tag([li.words_of(mixed)])[0].argmax(axis=1)
    assert (tagged == [0] * 30 + [2] * 30).mean() > 0.95
    assert li.keep_known(df, model).count() == len(docs) - 3 and li.keep_known(df, model).columns == df.columns
    assert li.train(df.limit(0)) is None and {r.lang_pred for r in li.predict(df, None).collect()} == {"und"}
    assert li.keep_known(df, None).count() == len(docs) - 3
