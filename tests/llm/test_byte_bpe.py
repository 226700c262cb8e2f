import hashlib
import random
from array import array

import public_tokenizers
import tiktoken

from quillon.llm import byte_bpe, token_counts

RANKS = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
PATTERN = public_tokenizers.PATTERN
OWN = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(7)
    odd = ["\u0085", "\x1c", "\x1f", "​", " ", " ", "᠎", "̀", "é", "ß", "中", "😀", "퟿", "'", "'s", " ", "\n", "\t", "٣", "²", "ஃ", "\x00"]
    yield from [None, "", " ", "the the  the", "it's they'll  \n\n x", "a" * 3000, " " * 5000, "ab" * 4000 + "!" * 999, "thethingand" * 3000]
    for _ in range(300):
        yield "".join(rng.choice(odd + list("abcdeTHE 019.,")) for _ in range(rng.randint(1, 60)))


def test_encoder_equals_the_library():
    encoder, split = byte_bpe.Encoder(RANKS), byte_bpe.compile_pattern(PATTERN)
    for text in texts():
        ids = list(array("I", encoder.encode(text, split)))
        assert ids == (OWN.encode_ordinary(text) if text else []), repr(text)
        assert encoder.decode(array("I", ids).tobytes()) == (text or "").encode()


def test_every_code_point_splits_as_in_the_library():
    encoder, split = byte_bpe.Encoder(RANKS), byte_bpe.compile_pattern(PATTERN)
    text = "".join(f"a{chr(c)} 1{chr(c)}" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    assert list(array("I", encoder.encode(text, split))) == OWN.encode_ordinary(text)


def test_digests(spark):
    rows = [(1, "the cat's hat", "x"), (1, "the cat's hat", "y"), (2, None, "z"), (3, "", None), (None, "é" * 2000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = sorted(map(tuple, byte_bpe.digests(df, "doc_id", "text", RANKS, PATTERN).collect()), key=str)
    expected = []
    for key, text, _ in rows:
        ids = OWN.encode_ordinary(text or "")
        expected.append((key, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert byte_bpe.digests(df.limit(0), "doc_id", "text", RANKS, PATTERN).count() == 0


def brute_count(data, scores):
    best = [(0.0, 0)]
    for end in range(1, len(data) + 1):
        options = [(best[s][0] + scores[data[s:end]], -(best[s][1] + 1)) for s in range(end) if data[s:end] in scores]
        score, pieces = max(options)
        best.append((score, -pieces))
    return best[-1][1]


def test_trie_counts_equal_brute_force(spark):
    scores = token_counts.zipf_scores(RANKS)
    split = byte_bpe.compile_pattern(PATTERN)
    rng = random.Random(5)
    cases = ["", None, "running runner runs rerun", "x" * 300, "thé the thé", " \n\n "] + ["".join(rng.choice("thein gré") for _ in range(80)) for _ in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(0, "again")], "doc_id int, text string")
    found = sorted(map(tuple, token_counts.count_tokens(df, "doc_id", "text", scores, PATTERN).collect()))
    expected = []
    for i, t in [*enumerate(cases), (0, "again")]:
        pieces = split.findall(t or "")
        expected.append((i, len(pieces), sum(brute_count(p.encode(), scores) for p in pieces)))
    assert found == sorted(expected)


def test_small_trie_starts_anew():
    scores = token_counts.zipf_scores(RANKS)
    small, large = token_counts.CountTrie(scores, 40), token_counts.CountTrie(scores)
    words = [f"word{i}ly" for i in range(50)]
    assert [small[w] for w in words] == [large[w] for w in words]
