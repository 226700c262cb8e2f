import random

import xxhash

from quillon.llm import components, simhash, storage


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(items):
    root = {i: i for i in range(len(items))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if (items[i][1] ^ items[j][1]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(items):
        groups.setdefault(find(i), []).append(key)
    return {(items[i][0], items[i][1], min(groups[find(i)])) for i in range(len(items))}


def test_fingerprints_equal_brute_force():
    rng = random.Random(1)
    for n in [*range(6), 100, 254, 255, 256, 257, 300, 70_000]:
        text = " \t".join(rng.choice(["The", "cat", "É", "x y", "no", "%%"]) for _ in range(n))
        assert simhash.fingerprint(text) == brute_fingerprint(text), n
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def test_links_on_dense_and_sparse_keys(spark):
    rng = random.Random(2)
    values = {0, 1, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base, base ^ 1 << rng.randrange(64), base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
        values.add(base ^ 7 << rng.randrange(60))
    centre = rng.getrandbits(64)
    for _ in range(600):  # one key with many fingerprints
        values.add(centre ^ sum(1 << rng.randrange(24) for _ in range(rng.randrange(4))) & (1 << 64) - 1)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    with storage.Scratch(spark, "test") as scratch:
        found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), scratch).collect()
        joined = {r.node: r.root for r in components.connect(spark.createDataFrame([(r.a, r.b) for r in found], "a long, b long"), scratch).collect()}
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
    got = {}
    for v in signed:
        got.setdefault(joined.get(v, v), set()).add(v)
    expected = {}
    for key, _, first in brute_components(list(zip(signed, values))):
        expected.setdefault(first, set()).add(key)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_with_nulls_ties_and_clashing_columns(spark):
    long = " ".join(f"word{i}" for i in range(900))
    rows = [(5, "same text here now"), (3, "same text here now"), (3, "same text here now"), (9, None), (8, ""), (7, "alone in the world"), (2, long), (4, long + " extra"), (None, "nobody knows this one")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, fp int, root int")
    found = sorted((r.doc_id is None, r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, "doc_id", "text").collect())
    expected = brute_components([(10**9 if k is None else k, brute_fingerprint(t)) for k, t in rows])
    expected = {(None if k == 10**9 else k, f"{fp:016x}", None if c == 10**9 else c) for k, fp, c in expected}
    assert {x[1:] for x in found} == expected and len(found) == len(rows)
    assert simhash.near_duplicates(df.limit(0), "doc_id", "text").count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(300, 299), (7, 7)]
    with storage.Scratch(spark, "test") as scratch:
        found = {r.node: r.root for r in components.connect(spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long"), scratch).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(201)}}
