"""Benchmark decontamination by pigeonhole edit matching.

A test item of n words may differ from a passage of a document in at most k = n / 5 words (inserted, deleted or
replaced), the similarity of 0.8 or more that near-duplicates have here. Split into k + 1 pieces, at least one piece
then occurs unchanged. An Aho-Corasick automaton of all pieces finds the exact hits in one pass over a document; each
hit names the only window in which its item can match, overlapping windows of an item are merged, and Myers'
bit-parallel algorithm (columns of the edit matrix as bits of one integer, words as symbols) gives the exact distance.
Very long items have their pieces, all of four or five words, in a table of hashes instead, and their columns are cut
into blocks of bits that pass their lower edge on to the next block.

Words are lower-cased runs of letters, digits and underscores, so case, punctuation and spacing do not count. In
scripts without spaces every character is a word.

Documents stream past the items; the items are broadcast in blocks whose size is checked, with one pass over the
documents for each block, so a large set of benchmarks takes more passes, not more memory. An item is never cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .storage import Shared, bounded_batches, materialize

#: Share of an item's words that may be edited. Words from which on an item is evidence enough to drop a document.
BUDGET, EVIDENCE = 0.2, 5
#: UTF-8 bytes of benchmark text in one block (more only if one item has more); words of an item that are one block of
#: bits, and from which on its pieces are hashed.
BLOCK_BYTES, LONG = 4 << 20, 4096

#: Fixed ranges: scripts written without spaces (Thai and Lao, Myanmar, Khmer, kana, Han).
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"(?=\w)[{UNSPACED}]|[^\W{UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def budget_of(n: int, share: float = BUDGET) -> int:
    return int(n * share + 1e-9)


def nearest_end(pattern: dict, m: int, text: list) -> tuple[int, int]:
    """Myers' algorithm: the least edit distance of the pattern to any stretch of the text, and its first end.

    ``pattern`` maps a symbol to the bits of its places; the distance of the empty stretch is m, at end 0.
    """
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best, at = mask, 0, m, m, 0
    for j, symbol in enumerate(text, 1):
        eq = pattern.get(symbol, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        up = up << 1 & mask
        down = down << 1 & mask
        plus = down | ~(diagonal | up) & mask
        minus = up & diagonal
        if score < best:
            best, at = score, j
    return best, at


def nearest_end_of_long(pattern: list, text: list) -> tuple[int, int]:
    """As ``nearest_end`` for a pattern of any length, a block of LONG symbols at a time: what a block's lower edge
    adds to the distance, at each place of the text, is what the next one's upper edge gets."""
    edge = [0] * len(text)  # a match may start anywhere: nothing is added above the first block
    for at in range(0, len(pattern), LONG):
        block = pattern[at : at + LONG]
        places, width = _places(block), len(block)
        mask, high = (1 << width) - 1, 1 << (width - 1)
        plus, minus = mask, 0
        for j, symbol in enumerate(text):
            eq, above = places.get(symbol, 0), edge[j]
            below = eq | minus
            if above < 0:
                eq |= 1
            diagonal = ((((eq & plus) + plus) ^ plus) | eq) & mask
            up = minus | ~(diagonal | plus) & mask
            down = plus & diagonal
            edge[j] = 1 if up & high else -1 if down & high else 0
            up = up << 1 & mask
            down = down << 1 & mask
            if above > 0:
                up |= 1
            elif above < 0:
                down |= 1
            plus = down | ~(below | up) & mask
            minus = up & below
    score = best = len(pattern)
    end = 0
    for j, step in enumerate(edge, 1):
        score += step
        if score < best:
            best, end = score, j
    return best, end


def _places(words: list) -> dict:
    found: dict[str, int] = {}
    for i, w in enumerate(words):
        found[w] = found.get(w, 0) | 1 << i
    return found


def _grams(symbols: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` symbols."""
    if len(symbols) < size:
        return np.empty(0, np.uint64)
    h = np.zeros(len(symbols) - size + 1, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[i : len(symbols) - size + 1 + i]
    return h


def _symbols(words: list[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


class Matcher:
    """The pieces of a block of items, and the verification of their hits."""

    def __init__(self, block: tuple[list[tuple], float]):
        items, share = block
        self.items: list[tuple] = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        self.hashed: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # item, words of a piece, sorted hashes, first words
        for key, text in items:
            words = words_of(text)
            n, k = len(words), budget_of(len(words), share)
            cuts = [n * i // (k + 1) for i in range(k + 2)]
            if n > LONG:
                symbols = _symbols(words)
                starts, sizes = np.array(cuts[:-1]), np.diff(cuts)
                for size in np.unique(sizes).tolist():
                    first = starts[sizes == size]
                    own = _grams(symbols, size)[first]
                    order = np.argsort(own, kind="stable")
                    self.hashed.append((len(self.items), size, own[order], first[order]))
                self.items.append((key, n, k, symbols, None))
                continue
            for a, b in zip(cuts, cuts[1:]):
                pieces.setdefault(" " + " ".join(words[a:b]) + " ", []).append((len(self.items), a))
            self.items.append((key, n, k, _places(words), _places(words[::-1])))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.some = bool(pieces)

    def hits(self, words: list[str], symbols: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, place in the item, place in the text) of each piece that occurs."""
        if self.some:
            flat = " " + " ".join(words) + " "
            starts: list[int] = []
            for end, (size, places) in self.automaton.iter(flat):
                starts = starts or [*accumulate((len(w) + 1 for w in words), initial=1)]
                at = bisect_right(starts, end - size + 2) - 1
                for item, offset in places:
                    yield item, offset, at
        for item, size, hashes, first in self.hashed:
            grams = _grams(symbols, size)
            low, high = np.searchsorted(hashes, grams, "left"), np.searchsorted(hashes, grams, "right")
            for at in np.flatnonzero(high > low).tolist():
                for offset in first[low[at] : high[at]].tolist():
                    yield item, offset, at

    def find(self, text: str | None) -> list[tuple]:
        """(item, distance, first word, words, words of the item) for each item within its budget, at its best place."""
        if not self.items:
            return []
        words = words_of(text)
        symbols = _symbols(words) if self.hashed else np.empty(0, np.uint64)
        windows: dict[int, set[tuple[int, int]]] = {}
        for item, offset, at in self.hits(words, symbols):
            _, n, k, _, _ = self.items[item]
            windows.setdefault(item, set()).add((max(0, at - offset - k), min(len(words), at - offset + n + k)))
        found = []
        for item, spans in windows.items():
            key, n, k, forward, backward = self.items[item]
            merged: list[list[int]] = []
            for a, b in sorted(spans):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            best = None
            for a, b in merged:
                distance, end = nearest_end(forward, n, words[a:b]) if backward is not None else nearest_end_of_long(forward.tolist(), symbols[a:b].tolist())
                if distance <= k and (best is None or distance < best[0]):
                    best = (distance, a + end, a)
            if best:
                distance, end, a = best
                _, back = nearest_end(backward, n, words[a:end][::-1]) if backward is not None else nearest_end_of_long(forward[::-1].tolist(), symbols[a:end][::-1].tolist())
                found.append((key, distance, end - back, back, n))
        return found


def _blocks(items: DataFrame, key: str, text: str, least_words: int) -> Iterator[list[tuple]]:
    """Usable items, a block of bounded size at a time; an item with more than a block's bytes is a block of its own."""
    rows = items.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).filter("k is not null and x is not null").distinct()
    small, large = rows.filter(F.octet_length("x") <= BLOCK_BYTES), rows.filter(F.octet_length("x") > BLOCK_BYTES)
    size = small.agg(F.coalesce(F.sum(F.octet_length("x") + 16), F.lit(0))).first()[0]
    n = int(size // BLOCK_BYTES) + 1
    for i in range(n):
        block = small.filter(F.pmod(F.xxhash64("k", "x"), F.lit(n)) == i).orderBy("k", "x").collect()  # about BLOCK_BYTES
        yield [(r.k, r.x) for r in block if len(words_of(r.x)) >= least_words]
    for r in large.orderBy("k", F.octet_length("x")).toLocalIterator():
        yield [(r.k, r.x)] if len(words_of(r.x)) >= least_words else []


def find_leaks(
    df: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text",
    budget: float = BUDGET, least_words: int = 1,
) -> DataFrame:
    """``key``, ``item_id``, ``distance``, ``first_word``, ``n_words``, ``item_words``: the items that a text holds.

    One row for each row of ``df`` and item whose best match in the whole text is within the item's budget; ties
    between places go to the first that ends. Items of fewer words than one edit needs are found where they occur exactly.
    Null and empty texts hold nothing; items without words (or with fewer than ``least_words``), or null ones, take no
    part; item ids are of any type; repeated items (same key and text) count once; repeated rows
    of ``df`` give repeated results; empty tables give no rows; other columns are ignored.
    """
    id_type = items.schema[item_key].dataType
    fields = [T.StructField(n, T.LongType()) for n in ("distance", "first_word", "n_words", "item_words")]
    out = T.StructType([df.schema[key], T.StructField("item_id", id_type), *fields])
    kinds = [to_arrow_type(id_type), *[pa.int64()] * 4]
    texts = bounded_batches(df).select(key, F.col(text).cast("string"))
    found = None
    for block in _blocks(items, item_key, item_text, max(1, least_words)):
        shared = Shared(df.sparkSession, (block, budget))

        def matched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.built(Matcher)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    hits = [matcher.find(x) for x in part.column(1).to_pylist()]
                    rows = pa.array([i for i, h in enumerate(hits) for _ in h], pa.int64())
                    columns = zip(*(x for h in hits for x in h)) if len(rows) else [[]] * 5
                    yield pa.RecordBatch.from_arrays([part.column(0).take(rows), *(pa.array(c, t) for c, t in zip(columns, kinds))], out.names)

        part = texts.mapInArrow(matched, out)
        found = part if found is None else found.union(part)
    return found


def keep_clean(
    df: DataFrame, key: str, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text",
    budget: float = BUDGET, least_words: int = EVIDENCE,
) -> DataFrame:
    """The rows of ``df`` that hold no benchmark item, with all their columns; rows are judged one by one, whatever their
    key.

    Items of fewer than ``least_words`` words do not count here: a document is not dropped for a word or two that any
    text may hold. ``find_leaks`` reports them. There is no shuffle; between the blocks of a large set of items the
    rows that are left are written to the shared folder."""
    place, kept = df.columns.index(text), df
    for i, block in enumerate(_blocks(items, item_key, item_text, max(1, least_words))):
        shared = Shared(df.sparkSession, (block, budget))

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = shared.built(Matcher)
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield part.filter(pa.array([not matcher.find(x) for x in part.column(place).to_pylist()], pa.bool_()))

        kept = bounded_batches(materialize(kept, "clean") if i else kept).mapInArrow(clean, df.schema)
    return kept
