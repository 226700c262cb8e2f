"""SimHash fingerprints, their links within a few bits, and the connected groups that the links make.

Fingerprints are 64-bit sums over word shingles, computed a document at a time. Links are searched among *distinct*
fingerprints, so exact copies cost nothing but a count, by a pigeonring filter: the 64 bits form a ring of nine
segments, and if two fingerprints differ in at most two bits, then from some segment on every chain of consecutive
segments, of whatever length l, has at most floor(2 l / 9) differences in all. Chains of up to four segments thus
have none, which makes a join key of 28 or 29 bits for each of the nine starts; the longer chains' budgets prune the
candidates of a key before their full distance is computed.

A key that many fingerprints share (copies with small edits) is not compared pair by pair: its fingerprints each
name the 65 values within one bit of them, and all that name one value are linked in a star. Two fingerprints within
two bits always share such a value, and no value is named by more than 65 fingerprints, so this is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connect
from .storage import Scratch, bounded_batches, in_slices, materialize

#: Widths of the ring's segments, chain length of a join key, and fingerprints of one key that are compared in pairs.
WIDTHS, CHAIN, IN_PAIRS = (8, 7, 7, 7, 7, 7, 7, 7, 7), 4, 64
STARTS = (0, *accumulate(WIDTHS))[:-1]
DISTANCE = 2


def folded(hashes: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes, given as rows of eight bytes, first byte first: a bit is set if it is set in
    over half of them."""
    n = len(hashes)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].reshape(-1)).view(np.uint64).reshape(-1, 8)
        whole = len(bits) // 255 * 255
        for lanes in ([bits[:whole].reshape(-1, 255, 8).sum(axis=1)] if whole else []) + [bits[whole:].sum(axis=0, keepdims=True)]:
            counts += np.ascontiguousarray(lanes).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a whole text: a bit is set if it is set in over half the shingles' hashes."""
    split = text.encode().lower().split() if text else []  # bytes: lower() and split() know ASCII only
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in split)]
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1 :])])
    return folded(np.frombuffer(hashes, np.uint8).reshape(-1, 8))


def fingerprints(df: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """``key`` and ``fp`` (the fingerprint as a signed long) of each row's whole text.

    A text without words, or a null one, has fingerprint 0. Repeated rows and null keys stay; other columns are
    ignored; an empty table gives no rows.
    """
    out = T.StructType([df.schema[key], T.StructField("fp", T.LongType())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = np.array([fingerprint(x, words) for x in part.column(1).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], [key, "fp"])

    return bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(hashed, out)


def _rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, 64 - by)) if by else fp


def _chain_key(start: int) -> Column:
    width = sum(WIDTHS[(start + k) % 9] for k in range(CHAIN))
    return F.struct(F.lit(start).cast("tinyint").alias("start"), F.shiftrightunsigned(_rotated(F.col("fp"), STARTS[start]), 64 - width).alias("bits"))


def _within_budgets(a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
    """Which pairs keep every chain from this start within its proportional budget."""
    x = a ^ b
    if STARTS[start]:
        x = x << np.uint64(STARTS[start]) | x >> np.uint64(64 - STARTS[start])
    kept, width = np.ones(len(x), bool), 0
    for length in range(1, 10):
        width += WIDTHS[(start + length - 1) % 9]
        if length >= CHAIN:
            kept &= np.bitwise_count(x >> np.uint64(64 - width)) <= DISTANCE * length // 9
    return kept


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within keys of few fingerprints: a spanning forest of each key's links."""
    for rows in in_slices(batches, 4096):
        a_out, b_out = [], []
        for start, members in zip(rows["start"], rows["members"]):
            values = np.unique(np.array(members, np.int64).view(np.uint64))
            i, j = np.triu_indices(len(values), 1)
            near = _within_budgets(values[i], values[j], start)
            i, j = i[near], j[near]
            true = np.bitwise_count(values[i] ^ values[j]) <= DISTANCE
            root = list(range(len(values)))
            for p, q in zip(i[true].tolist(), j[true].tolist()):
                x, y = p, q
                while root[x] != x:
                    x = root[x]
                while root[y] != y:
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    pair = sorted(np.array([values[p], values[q]], np.uint64).view(np.int64).tolist())
                    a_out.append(pair[0])
                    b_out.append(pair[1])
        yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """``a`` < ``b``: links between the distinct fingerprints ``fp`` that span every group within two bits.

    Each pair within two bits is joined by a path of rows; pairs that other rows join already may be left out. What it
    reads lies in ``scratch``.
    """
    keyed = distinct.select("fp", F.explode(F.array(*map(_chain_key, range(9)))).alias("key")).select("fp", "key.*")
    shared = keyed.groupBy("start", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    grouped = scratch.table(keyed.join(shared, ["start", "bits"]).select("fp", "start", "bits", "n"), "keys")
    few = grouped.filter(F.col("n") <= IN_PAIRS).groupBy("start", "bits").agg(F.collect_list("fp").alias("members"))
    in_pairs = few.select("start", "members").mapInArrow(_pairs, "a long, b long")
    near = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda k: F.col("fp").bitwiseXOR(F.when(k == 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), k))))
    many = grouped.filter(F.col("n") > IN_PAIRS).select("fp").distinct()
    stars = (
        many.select("fp", F.explode(near).alias("value"))
        .groupBy("value")
        .agg(F.collect_list("fp").alias("members"))  # 65 at most
        .filter(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
        .filter("a < b")
    )
    return in_pairs.union(stars).distinct()


def near_duplicates(df: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """``key``, ``fingerprint`` (16 lower-case hex digits) and ``component_id`` of each row.

    ``component_id`` is the smallest key that can be reached over links between fingerprints that differ in two bits
    or fewer. Rows with equal fingerprints are linked, texts without words (fingerprint 0) too. A null key never is
    the smallest unless all its group's keys are null; then the component is null. Repeated rows stay.
    """
    hashed = materialize(fingerprints(df, key, text, words), "simhash-fingerprints")
    with Scratch(df.sparkSession, "simhash") as scratch:
        nodes = scratch.table(hashed.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
        roots = connect(links(nodes.select("fp"), scratch), scratch)
        placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
        smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
        component = materialize(placed.select("fp", "root").join(smallest, "root").select("fp", "component_id"), "simhash-components")
    return hashed.join(component, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
