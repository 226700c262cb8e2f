"""Token counts of texts under a unigram vocabulary, by dynamic programming over a trie of distinct pre-tokens.

The best segmentation of a byte string into vocabulary pieces is found left to right: the best score of a prefix is
the maximum, over the pieces that end there, of the best score before the piece plus the piece's score. That value
depends on the prefix alone, so distinct pre-tokens are inserted in a trie and each node, one per distinct prefix,
holds its forward score and the number of pieces on its best path. A pre-token pays only for the bytes that no
earlier pre-token shared; the count at its terminal node is the answer for each of its occurrences.

Scores follow Zipf's law from the rank of a piece in the vocabulary file (log-probability -ln(rank + 2.7), a
parameter), since the vocabulary files hold ranks and no tokenizer is trained here. Of equal scores the segmentation
with fewer pieces counts.

Each worker has a trie of bounded size (it starts anew when full), rows are independent, and nothing is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import compile_pattern
from .storage import Shared, bounded_batches

#: Nodes of a worker's trie; pre-tokens of more bytes than LONG get the same recurrence over a sliding window instead.
NODES, LONG = 500_000, 512


def zipf_scores(ranks: dict[bytes, int], shift: float = 2.7) -> dict[bytes, float]:
    return {token: -math.log(rank + shift) for token, rank in ranks.items()}


class CountTrie(dict):
    """Maps a pre-token to the number of pieces of its best segmentation; inserts those not seen yet."""

    def __init__(self, scores: dict[bytes, float], nodes: int = NODES):
        super().__init__()
        self.scores, self.most = scores, nodes
        self.longest = max(map(len, scores), default=1)
        self._start()

    def _start(self) -> None:
        self.clear()
        self.child: dict[int, int] = {}
        self.best, self.pieces = [0.0], [0]

    def __missing__(self, pretoken: str) -> int:
        data = pretoken.encode()
        if len(data) > LONG:
            return self.sliding(data)
        if len(self.best) + len(data) > self.most:
            self._start()
        child, best, pieces, scores = self.child, self.best, self.pieces, self.scores
        node, path = 0, [0]
        for depth, byte in enumerate(data, 1):
            step = node << 8 | byte
            known = child.get(step)
            if known is None:
                top, fewest = -math.inf, 0
                for size in range(1, min(depth, self.longest) + 1):
                    if (score := scores.get(data[depth - size : depth])) is not None:
                        before = path[depth - size]
                        total = best[before] + score
                        if total > top or total == top and pieces[before] + 1 < fewest:
                            top, fewest = total, pieces[before] + 1
                known = child[step] = len(best)
                best.append(top)
                pieces.append(fewest)
            node = known
            path.append(node)
        self[pretoken] = pieces[node]
        return pieces[node]

    def sliding(self, data: bytes) -> int:
        """The same recurrence without the trie: only the last ``longest`` prefixes are held."""
        span = self.longest + 1
        best, pieces = [0.0] * span, [0] * span
        for depth in range(1, len(data) + 1):
            top, fewest = -math.inf, 0
            for size in range(1, min(depth, self.longest) + 1):
                if (score := self.scores.get(data[depth - size : depth])) is not None:
                    at = (depth - size) % span
                    total = best[at] + score
                    if total > top or total == top and pieces[at] + 1 < fewest:
                        top, fewest = total, pieces[at] + 1
            best[depth % span], pieces[depth % span] = top, fewest
        return pieces[len(data) % span]


def count_tokens(df: DataFrame, key: str, text: str, scores: dict[bytes, float], pattern: str) -> DataFrame:
    """``key``, ``n_pretokens`` and ``n_tokens`` of each row's whole text.

    Null and empty texts have no tokens. Rows are independent: repeated keys or rows stay, null keys stay null, an
    empty table gives no rows, other columns are ignored. Every single byte must be in the vocabulary, so that every
    text has a segmentation; otherwise this raises ValueError.
    """
    if any(bytes([b]) not in scores for b in range(256)):
        raise ValueError("the vocabulary lacks single bytes")
    shared = Shared(df.sparkSession, scores)
    out = T.StructType([df.schema[key], T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.built(CountTrie)
        split = compile_pattern(pattern).findall
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                before, tokens = [], []
                for x in part.column(1).to_pylist():
                    pretokens = split(x) if x else []
                    before.append(len(pretokens))
                    tokens.append(sum(map(trie.__getitem__, pretokens)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(before, pa.int64()), pa.array(tokens, pa.int64())], out.names)

    return bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(counted, out)
