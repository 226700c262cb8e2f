"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The merge loop keeps, for one pre-token, a linked list of tokens and a queue of the pairs that a merge rule knows.
The queue has one bucket of list positions for each merge rank. Two levels of bitmaps over the ranks (a bit for a bucket, a bit
for a word of 64 buckets) give the lowest rank that has entries by find-first-set, whatever the number of pending
pairs. A merge does not search for the entries that it makes obsolete:
a popped entry counts only if its position still starts a pair of that very rank. The work is proportional to the
length of the pre-token, times the logarithm within one bucket, so a megabyte of one letter class is no special case.
In pre-tokens of at most SHORT bytes, which is nearly all, the positions of a bucket are a bitmap too, and the queue is
one of fixed tables that each pre-token leaves empty.

Texts pass through ``mapInArrow``; there is no shuffle and nothing depends on other rows, so a hot key cannot arise
and a lost executor costs its running tasks only. Distinct pre-tokens are encoded once per worker and kept in a
memo of bounded size.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Memo, Shared, bounded_batches

#: Bytes of a short pre-token, ranks (and such positions) of a word of the short queue; bytes of a generation of the memo.
SHORT, MEMO = 256, 64 << 20

def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@lru_cache(maxsize=8)
def compile_pattern(pattern: str) -> regex.Pattern:
    r"""The pattern with ``\s`` read as Unicode's White_Space, which is how the tiktoken library reads it."""
    inside = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]")
    return regex.compile(inside.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder(Memo):
    """Maps a pre-token to its ids as little-endian unsigned 32-bit integers; also a memo of those seen."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__(MEMO)
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=0)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.firsts = [ranks.get(bytes([b])) for b in range(256)]
        most = max(ranks.values(), default=0)
        self.buckets, self.words = [0] * (most + 1), [0] * ((most >> 8) + 1)  # the short queue
        self.bits = [1 << i for i in range(max(SHORT, len(self.words)))]
        self.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]  # the rank of each two bytes

    def make(self, pretoken: str) -> bytes:
        piece = pretoken.encode()
        return array("I", self.merge_short(piece) if len(piece) <= SHORT else self.merge(piece)).tobytes()

    def merge_short(self, piece: bytes) -> list[int]:
        """As ``merge``, with positions as bits of a number."""
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        get, longest, n, bit, words, buckets, pairs = self.ranks.get, self.longest, len(piece), self.bits, self.words, self.buckets, self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [pairs[a << 8 | b] for a, b in zip(piece, piece[1:])]
        pair.append(-1)
        ids = list(map(self.firsts.__getitem__, piece))
        top = i = 0
        for rank in pair:
            if rank >= 0:
                word = rank >> 8
                top |= bit[word]
                words[word] |= bit[rank & 255]
                buckets[rank] |= bit[i]
            i += 1
        while top:
            lowest = top & -top
            word = lowest.bit_length() - 1
            bits = words[word]
            first = bits & -bits
            rank = (word << 8) + first.bit_length() - 1
            bucket = buckets[rank]
            place = bucket & -bucket
            i = place.bit_length() - 1
            buckets[rank] = bucket = bucket ^ place
            if not bucket:
                words[word] = bits = bits ^ first
                if not bits:
                    top ^= lowest
            if pair[i] != rank:
                continue  # a stale entry
            gone = after[i]
            end = after[i] = after[gone]
            ids[i] = rank
            pair[gone] = pair[i] = -1
            start = before[i]
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (rank := get(piece[i:stop], -1)) >= 0:
                    pair[i] = rank
                    word = rank >> 8
                    top |= bit[word]
                    words[word] |= bit[rank & 255]
                    buckets[rank] |= bit[i]
            if start >= 0:
                rank = pair[start] = get(piece[start:end], -1) if end - start <= longest else -1
                if rank >= 0:
                    word = rank >> 8
                    top |= bit[word]
                    words[word] |= bit[rank & 255]
                    buckets[rank] |= bit[start]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        get, longest, n = self.ranks.get, self.longest, len(piece)
        of = (lambda values: array("q", values)) if n > 4096 else list
        after = of(range(1, n + 1))  # where the token that starts here ends
        before = of(range(-1, n - 1))  # where the token before the one that starts here starts
        pairs = self.pairs
        pair = of([pairs[a << 8 | b] for a, b in zip(piece, piece[1:])])  # the rank of the token that starts here with its right neighbour
        pair.append(-1)
        ids = list(map(self.firsts.__getitem__, piece))  # the token that starts here
        # The queue, written out here since calls would cost more than the work: buckets of positions (heaps) by rank,
        # a bit for each bucket in words of 64 ranks, a bit for each such word in ``top``.
        buckets: dict[int, list[int]] = {}
        words: dict[int, int] = {}
        top = 0
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)  # ascending positions are a heap
                else:
                    buckets[rank] = [i]
                    word = rank >> 6
                    if word in words:
                        words[word] |= 1 << (rank & 63)
                    else:
                        words[word] = 1 << (rank & 63)
                        top |= 1 << word
        while top:
            word = (top & -top).bit_length() - 1
            bits = words[word]
            rank = (word << 6) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                if bits := bits & (bits - 1):
                    words[word] = bits
                else:
                    del words[word]
                    top &= top - 1
            if pair[i] != rank:
                continue  # a stale entry
            gone = after[i]
            end = after[i] = after[gone]
            ids[i] = rank
            pair[gone] = pair[i] = -1
            start = before[i]
            if end < n:
                before[end] = i
                stop = after[end]
                if stop - i <= longest and (rank := get(piece[i:stop], -1)) >= 0:
                    pair[i] = rank
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        word = rank >> 6
                        if word in words:
                            words[word] |= 1 << (rank & 63)
                        else:
                            words[word] = 1 << (rank & 63)
                            top |= 1 << word
            if start >= 0:
                rank = pair[start] = get(piece[start:end], -1) if end - start <= longest else -1
                if rank >= 0:
                    if rank in buckets:
                        heappush(buckets[rank], start)
                    else:
                        buckets[rank] = [start]
                        word = rank >> 6
                        if word in words:
                            words[word] |= 1 << (rank & 63)
                        else:
                            words[word] = 1 << (rank & 63)
                            top |= 1 << word
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def encode(self, text: str | None, pattern: regex.Pattern) -> bytes:
        return b"".join(map(self.__getitem__, pattern.findall(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(packed).cast("I").tolist())) if packed else b""


def encode_texts(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``key`` and ``ids``: each row's whole text as token ids, packed as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows are independent: repeated keys or rows stay, null keys stay null, an empty
    table gives no rows, other columns are ignored. Texts of any length are encoded whole.
    """
    shared = Shared(df.sparkSession, ranks)
    out = T.StructType([df.schema[key], T.StructField("ids", T.BinaryType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split = shared.built(Encoder), compile_pattern(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encoder.encode(x, split) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], [key, "ids"])

    return bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(encoded, out)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that the packed ids stand for; null ids give empty bytes, an unknown id is an error."""
    shared = Shared(df.sparkSession, ranks)
    rest = [c for c in df.columns if c != to]
    out = T.StructType([df.schema[c] for c in rest] + [T.StructField(to, T.BinaryType())])
    place = rest.index(ids)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared.built(Encoder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [encoder.decode(x) for x in part.column(place).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*rest, to])

    return bounded_batches(df).select(*rest).mapInArrow(decoded, out)


def digests(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """The number of ids of each text, and SHA-256 digests of the ids and of what they decode to.

    Both directions run in one pass, so a worker holds one vocabulary and no ids travel between the two.
    """
    shared = Shared(df.sparkSession, ranks)
    out = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, split, digest = shared.built(Encoder), compile_pattern(pattern), hashlib.sha256
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, coded, decoded = [], [], []
                for x in part.column(1).to_pylist():
                    ids = encoder.encode(x, split)
                    sizes.append(len(ids) // 4)
                    coded.append(digest(ids).hexdigest())
                    decoded.append(digest(encoder.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], out.names)

    return bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(digested, out)
