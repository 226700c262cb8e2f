import random

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import decontaminate as d


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i]
        for j, t in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != t)))
    return min(row), row.index(min(row))


def brute_words(text):
    return regex.findall(r"[\p{Thai}\p{Han}]|[\p{L}\p{N}_--[\p{Thai}\p{Han}]]+", (text or "").lower(), regex.V1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=80), st.lists(st.sampled_from("abcd"), max_size=90))
def test_bit_parallel_distance(pattern, text):
    assert d.nearest_end(d._places(pattern), len(pattern), text) == brute_distance(pattern, text)


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 40)))) for i in range(25)] + [(90, None), (91, ""), (3, "x y z q r s t")]
    docs = []
    for k in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        passage = (rng.choice(items[:25])[1]).split()
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(passage) + 1)
            passage[at : at + rng.randrange(2)] = rng.choice([[], ["new"], [rng.choice(vocabulary)]])
        at = rng.randrange(len(words) + 1)
        docs.append((k, ",  ".join(words[:at] + [w.upper() for w in passage] + words[at:])))
    docs += [(100, None), (101, ""), (102, items[0][1] + " " + items[0][1]), (None, items[1][1]), (5, docs[5][1])]
    df = spark.createDataFrame([(k, t, "e") for k, t in docs], "doc_id long, text string, item_id string")
    found = [(r.doc_id, r.item_id, r.distance) for r in d.find_leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string")).collect()]
    expected = []
    for key, text in docs:
        for item, passage in items:
            words = brute_words(passage)
            if words and (x := brute_distance(words, brute_words(text))[0]) <= len(words) // 5:
                expected.append((key, item, x))
    assert sorted(found, key=str) == sorted(expected, key=str) and len(found) > 30
    clean = d.keep_clean(df, "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"))
    evidence = {i for i, p in items if len(brute_words(p)) >= 5}
    leaked = {(k, t) for k, t in docs for k2, i, _ in expected if k == k2 and i in evidence}
    assert clean.columns == df.columns and leaked
    assert sorted(((r.doc_id, r.text) for r in clean.collect()), key=str) == sorted((x for x in docs if x not in leaked), key=str)


def test_unspaced_scripts_short_items_and_text_ids(spark):
    item = "水在标准大气压下的沸点是多少摄氏度请给出准确的数值"
    docs = [(1, "题目：" + item + "。" + item), (2, "题目：" + item.replace("沸", "冰").replace("准确", "大概")), (3, "水在桌上"), (4, "the answer is Forty-Two, surely"), (5, "forty three"), (6, "กขค " + item[:10])]
    items = [("zh", item), ("short", "forty two"), ("one", "surely"), (None, "the answer")]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    found = {(r.doc_id, r.item_id, r.distance) for r in d.find_leaks(df, "doc_id", "text", spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert found == {(1, "zh", 0), (2, "zh", 3), (4, "short", 0), (4, "one", 0)}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9))
def test_blocks_of_bits_equal_one_integer(seed):
    rng = random.Random(seed)
    pattern = [rng.choice("abc") for _ in range(rng.randint(1, 300))]
    text = [rng.choice("abcd") for _ in range(rng.randrange(60))] + [c for c in pattern if rng.random() < 0.9] + [rng.choice("abcd") for _ in range(rng.randrange(60))]
    before, d.LONG = d.LONG, 32
    try:
        assert d.nearest_end_of_long(pattern, text) == d.nearest_end(d._places(pattern), len(pattern), text)
    finally:
        d.LONG = before


def test_items_longer_than_a_block():
    rng = random.Random(8)
    item = [f"v{rng.randrange(400)}" for _ in range(d.LONG + 900)]
    edited = list(item)
    for _ in range(600):
        edited[rng.randrange(len(edited))] = "new"
    matcher = d.Matcher(([("long", " ".join(item)), ("short", " ".join(item[:30]))], 0.2))
    found = matcher.find("a b " + " ".join(edited) + " c")
    assert {f[0] for f in found} == {"long", "short"} or {f[0] for f in found} == {"long"}
    long = next(f for f in found if f[0] == "long")
    assert long[1] == sum(x != y for x, y in zip(item, edited)) and long[2] == 2 and long[4] == len(item)
    assert [f for f in matcher.find("a b " + " ".join(f"x{i}" for i in range(6000))) if f[0] == "long"] == []


def test_items_of_many_megabytes_are_blocks_of_their_own(spark):
    long = "alpha beta gamma delta " * 60_000  # more than BLOCK_BYTES
    long = "".join(f"{w}{i % 9973} " for i, w in enumerate(long.split() * 3))
    assert len(long) > d.BLOCK_BYTES
    df = spark.createDataFrame([(1, "nothing of it here"), (2, "one two three four five six")], "doc_id int, text string")
    items = spark.createDataFrame([(1, long), (2, "one two three four five six")], "item_id long, text string")
    assert [tuple(r)[:2] for r in d.find_leaks(df, "doc_id", "text", items).collect()] == [(2, 2)]
    assert [r.doc_id for r in d.keep_clean(df, "doc_id", "text", items).collect()] == [1]


def test_span_is_the_passage(spark):
    item = " ".join(f"q{i}" for i in range(20))
    df = spark.createDataFrame([(1, "a b c " + item.replace("q7", "zz") + " d e")], "doc_id int, text string")
    row = d.find_leaks(df, "doc_id", "text", spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.distance, row.first_word, row.n_words, row.item_words) == (1, 3, 20, 20)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f")], "doc_id int, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert d.find_leaks(docs.limit(0), "doc_id", "text", items).count() == 0
    assert d.find_leaks(docs, "doc_id", "text", items.limit(0)).count() == 0
