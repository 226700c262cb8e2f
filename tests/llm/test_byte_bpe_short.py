import random

import public_tokenizers

from quillon.llm import byte_bpe
from quillon.llm.queries import VOCABULARY

RANKS = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def test_short_pretokens_merge_as_long_ones():
    rng, encoder = random.Random(6), byte_bpe.Encoder(RANKS)
    tokens = list(RANKS)
    for n in [0, 1, 2, 3, 9, 40, 200] * 30 + [byte_bpe.SHORT] * 4:
        piece = b"".join(rng.choice(tokens) for _ in range(n))[: byte_bpe.SHORT]
        for p in (piece, bytes(rng.randrange(256) for _ in range(n)), b"ab" * (n // 2), b"a" * n):
            assert encoder.merge_short(p) == encoder.merge(p)
    assert not any(encoder.words) and not any(encoder.buckets)  # the queue is left empty


def test_any_ranks_do():
    """Ranks with gaps, merged tokens that come before their parts, more ranks than a word of the queue has."""
    rng = random.Random(7)
    names = [bytes([b]) for b in range(256)] + list({bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(150)})
    encoder = byte_bpe.Encoder(dict(zip(names, rng.sample(range(70_000), len(names)))))
    for n in range(byte_bpe.SHORT):
        piece = bytes(rng.choice(b"abcd") for _ in range(n))
        assert encoder.merge_short(piece) == encoder.merge(piece)


def test_frequent_words_of_a_large_text_are_made_once(monkeypatch):
    made = []
    monkeypatch.setattr(byte_bpe.Encoder, "make", lambda self, word: made.append(word) or b"12345678")
    encoder = byte_bpe.Encoder(RANKS)
    words = [f" word{i:07d}" for i in range(330_000)]
    for _ in range(2):
        for w in words:
            encoder[w]
    assert len(made) == len(words)
