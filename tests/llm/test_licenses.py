import math
import random
import re
from collections import Counter

from quillon.llm import licenses as l


def brute_words(text):
    return re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", text.lower())


def brute_paragraphs(text):
    return [p for p in re.split(r"\n(?:[^\w\n]*\n)+", "\n" + text + "\n") if brute_words(p)]


def brute_own(text, whole, frequency, n):
    """The nearest template of any kind, by comparing every stretch with every template."""
    if not text:
        return None, 0.0
    weigh = lambda words: {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + frequency.get(w, 0))) + 1) for w, c in Counter(words).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))

    def cosine(x, y):
        a, b = weigh(brute_words(x)), weigh(brute_words(y))
        return round(sum(a[w] * b.get(w, 0) for w in a) / norm(a) / norm(b), 9) if a and b else 0.0

    notices, full = l.notices_of(l.NOTICES), l.read_texts()
    held = brute_paragraphs(text)
    tried = [(name, x, s) for s in text.split("\n") + held + [text] * whole for name, given in notices.items() for x in given]
    for name, x in full.items():
        parts = brute_paragraphs(x)
        runs = {max(0, i - j) for i, p in enumerate(held) for j, q in enumerate(parts) if cosine(p, q) >= l.THRESHOLD} if len(held) < 20 else set()
        tried += [(name, x, " ".join(held[a : a + len(parts)])) for a in runs] + [(name, x, text)] * whole
    best = min(((-cosine(s, x), name) for name, x, s in tried), default=(0.0, None))
    return (best[1], -best[0]) if -best[0] >= l.THRESHOLD else (None, 0.0)


def test_scan_and_inheritance(spark):
    rows = [
        ("src/LICENSE", "Released under the MIT License."),
        ("src/a/b/x.py", "code\nmore code"),
        ("src/a/LICENSE.md", "Licensed under the\nApache License, Version 2.0."),
        ("src/a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode of the work"),
        ("src/z.py", None), ("src/z.py", None), ("other/q.py", ""), (None, "SPDX-License-Identifier: ISC"), (None, "nothing here"),
        ("LICENSE", "my own words about nothing"), ("top.py", "this work is the license of the version"), ("dir/COPYING", "long text " * 500), ("dir/f", "x"),
        ("two/LICENSE", "Copyright 2020 Somebody\n\n" + l.read_texts()["BSD-2-Clause"]), ("two/deep/er/x", "y"),
    ]
    df = spark.createDataFrame([(i, p, t, "e") for i, (p, t) in enumerate(rows)], "doc_id int, path string, text string, license string")
    found = {r.doc_id: r for r in l.scan(df, "doc_id", "path", "text").collect()}
    vocabulary = {w for x in [n for given in l.notices_of(l.NOTICES).values() for n in given] + list(l.read_texts().values()) for w in brute_words(x)}
    frequency = Counter(w for _, t in rows for w in vocabulary.intersection(brute_words(t or "")))
    for i, (path, text) in enumerate(rows):
        name, cosine = brute_own(text, path is not None and path.rsplit("/")[-1].split(".")[0] in ("LICENSE", "COPYING"), frequency, len(rows))
        assert found[i].own_license == name and abs(found[i].cosine - cosine) < 1e-8, (path, found[i], name, cosine)
    assert [found[i].own_license for i in (0, 2, 3, 7, 13)] == ["MIT", "Apache-2.0", "CC-BY-NC-4.0", "ISC", "BSD-2-Clause"]
    assert (found[1].license, found[1].inherited_from) == ("Apache-2.0", "src/a") and (found[3].license, found[3].inherited_from) == ("CC-BY-NC-4.0", None)
    assert (found[4].license, found[4].inherited_from) == (found[5].license, found[5].inherited_from) == ("MIT", "src")
    assert (found[14].license, found[14].inherited_from) == ("BSD-2-Clause", "two")
    assert all(found[i].license is None for i in (6, 8, 9, 10, 11, 12)) and len(found) == len(rows)
    assert l.scan(df.limit(0), "doc_id", "path", "text").count() == 0


def test_inheritance_equals_brute_force(spark):
    rng = random.Random(5)
    names = ["MIT", "ISC", "GPL-2.0", "MPL-2.0"]
    rows = {}
    for _ in range(400):
        parts = [rng.choice("abc") for _ in range(rng.randrange(6))]
        rows["/".join([*parts, f"f{rng.randrange(10**6)}"])] = None
        if rng.random() < 0.2:
            rows["/".join([*parts, "LICENSE"])] = rng.choice(names)
    df = spark.createDataFrame([(i, p, f"SPDX-License-Identifier: {n}" if n else "plain words") for i, (p, n) in enumerate(rows.items())], "doc_id int, path string, text string")
    found = {r.path: (r.license, r.inherited_from) for r in l.scan(df, "doc_id", "path", "text").select("path", "license", "inherited_from").collect()}
    for path, name in rows.items():
        expected, at = (name, None), path
        while name is None and "/" in at:
            at = at.rsplit("/", 1)[0]
            if (got := rows.get(at + "/LICENSE")) is not None:
                expected, name = (got, at), got
        if name is None and rows.get("LICENSE") is not None:
            expected = (rows["LICENSE"], "")
        assert found[path] == expected, path


def scanner(extra=()):
    notices, full = l.notices_of(l.NOTICES), l.read_texts()
    return l.Scanner((notices, full, {w: 5 for x in full.values() for w in brute_words(x)}, 1000))


def test_full_texts_and_headers_are_told_apart():
    scan = scanner().scan
    for name, text in l.read_texts().items():
        holder = "Copyright (c) 2021 The Example Authors. All rights reserved.\n\n" if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause") else ""
        assert scan(holder + text, True)[0] == name
        assert scan(text[: len(text) * 9 // 10], True)[0] == name or len(text) < 1500
        if len(text) < 1500:  # in a comment at the head of a source file
            comment = "\n".join(f" * {line}".rstrip() for line in (holder + text).split("\n"))
            assert scan(f"/*\n{comment}\n */\n\nint main(void) {{ return 0; }}\n\nstatic int other = 3;\n", False)[0] == name
    for name, given in l.NOTICES.items():
        for notice in given:
            words, lines = notice.split(), []
            while words:
                lines.append("# " + " ".join(words[:9]))
                words = words[9:]
            assert scan("\n".join(lines) + "\n\nimport os\n", False)[0] == name, notice
    agpl = l.read_texts()["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE", "GNU AFFERO GENERAL PUBLIC LICENSE").replace("29 June 2007", "19 November 2007")
    assert scan(agpl, True)[0] == "AGPL-3.0"
    assert scan("Permission is hereby granted to nobody. The conditions of the sale are met in the following list.", True)[0] is None
