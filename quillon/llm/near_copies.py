"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or more.

Two searches propose pairs, and only pairs whose whole sets are similar become links.

* SimHash fingerprints of the sets, linked by the pigeonring filter of ``simhash``, bring together texts with few edits,
  however many of one origin there are, with a chain of rows for each group and never all its pairs.
* No Hamming distance between 64-bit fingerprints holds all similar pairs, so a prefix filter, which is exact, finds
  the rest: with the shingles of all texts in one order, two sets of n and m shingles that have 4/5 in common share one
  among the first n - ceil(4n/5) + 1 of the one and the first m - ceil(4m/5) + 1 of the other. Rare shingles come
  first, by counts in a table of fixed size; any order gives the same pairs, this one keeps groups of a shingle small.
  Sizes, and what can still be common after a shingle's places, prune pairs as they are joined; before whole sets
  travel, so do sketches of about a bit a shingle: shingles behind bits that only one of two sketches has are not common.

Texts of equal words are one node. Each shared shingle first links its nodes to one of them; once all these links have
made groups, only pairs of different groups are left to compare.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .components import connect
from .storage import Scratch, Shared, bounded_batches, forget, materialize

#: Words of a shingle, counters of the table of shingle counts, bits of a map of digests (4 MB), bits of the least sketch.
WORDS, COUNTERS, BITS, SKETCH = 5, 1 << 18, 1 << 25, 256
#: Distinct texts that a task remembers, so that it does not hand on the shingles of a copy again.
SEEN = 100_000


def _joined(text: str | None) -> bytes:
    return " ".join(text.lower().split()).encode() if text else b""


def node_of(text: str | None) -> int:
    """A signed 64-bit digest of a text's words in lower case; texts without words have that of an empty text."""
    return _signed(xxhash.xxh64_intdigest(_joined(text), 42))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingles of a whole text, hashed and in order; a shorter text is one shingle, an empty one has none."""
    joined = _joined(text)
    if not joined:
        return np.empty(0, np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in joined.split(b" "))]
    starts = [0, *(e + 1 for e in ends[: max(len(ends) - WORDS, 0)])]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], 42) for s, e in zip(starts, ends[min(len(ends), WORDS) - 1 :])], np.uint64))


def sketch(own: np.ndarray) -> bytes:
    """Which remainders the shingles have, modulo a power of two that is no less than their number."""
    bits = np.zeros(max(SKETCH, 1 << (len(own) - 1).bit_length()) if len(own) else SKETCH, bool)
    bits[own & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_similar(x: bytes, n: int, y: bytes, m: int) -> bool:
    """False only if sets of n and m shingles with these sketches are not similar: for each bit that one sketch has and
    the other lacks, the one's set has a shingle of its own."""
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    both = x & y
    common = min(n - int(np.bitwise_count(x ^ both).sum()), m - int(np.bitwise_count(y ^ both).sum()))
    return 9 * common >= 4 * (n + m)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _named(df: DataFrame, key: str, text: str) -> DataFrame:
    """``place`` (key, and a digest of all columns), ``node``, ``fp``, ``n`` (shingles) and ``sketch`` of each row, the
    sketch for the first row of a node that a task sees (null: as there); and for each task rows ``counter``, ``times``: how often shingles of a counter occur in its distinct texts."""
    place = F.struct(F.col(key).isNull().alias("absent"), F.col(key).alias("key"), F.xxhash64(*map(F.col, df.columns)).alias("digest"))
    rows = bounded_batches(df).select(place.alias("place"), F.col(text).cast("string").alias("text"))
    out = T.StructType([T.StructField("place", rows.schema["place"].dataType), *(T.StructField(n, T.LongType()) for n in ("node", "fp", "n")), T.StructField("counter", T.IntegerType()), T.StructField("times", T.LongType()), T.StructField("sketch", T.BinaryType())])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, kind = np.zeros(COUNTERS, np.int64), {}, None
        for part in _parts(batches):
            kind = part.schema.field(0).type
            found, sketches = [], []
            for x in part.column(1).to_pylist():
                node = node_of(x)
                sketches.append(None)
                if node not in seen:
                    own = shingles(x)
                    sketches[-1] = sketch(own)
                    np.add.at(counts, own % np.uint64(COUNTERS), 1)
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen[node] = (_signed(simhash.folded(own.byteswap().view(np.uint8).reshape(-1, 8))) if len(own) else 0, len(own))
                found.append((node, *seen[node]))
            columns = [pa.array(c, pa.int64()) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.nulls(len(part), pa.int32()), pa.nulls(len(part), pa.int64()), pa.array(sketches, pa.binary())], out.names)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(used), kind), *(pa.nulls(len(used), pa.int64()) for _ in range(3)), pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.nulls(len(used), pa.binary())], out.names)

    return rows.mapInArrow(named, out)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(1), pa.array([shingles(x).tobytes() for x in part.column(0).to_pylist()], pa.binary())], ["node", "hashes"])


def _not_excluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches, 4096):
        x, n, y, m = (part.column(i).to_pylist() for i in range(2, 6))
        yield part.select(["a", "b"]).filter(pa.array(list(map(may_be_similar, x, n, y, m)), pa.bool_()))


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _parts(batches):
        near = []
        for x, y in zip(part.column(2), part.column(3)):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            near.append(9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)))
        yield part.select(["a", "b"]).filter(pa.array(near, pa.bool_()))


def _possible(n: Column, at: Column, m: Column, there: Column) -> Column:
    """Whether sets of n and m can be similar if their first common shingle is at these places."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - there) >= 4 * (n + m))


def _ordered(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _prefixes(df: DataFrame, text: str, counts: np.ndarray) -> DataFrame:
    """``shingle``, ``node``, ``n``, ``at``: the first shingles of each text in the order of the counts. A task hands a
    text on once, as far as it remembers, so a text with very many copies is no hot group."""
    shared = Shared(df.sparkSession, counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = shared.sent.value, set()
        for part in _parts(batches):
            found = [np.empty((4, 0), np.int64)]
            for x in part.column(0).to_pylist():
                node = node_of(x)
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                own = shingles(x)
                n = len(own)
                if n:
                    first = own[np.lexsort((own, often[own % np.uint64(COUNTERS)]))[: n + 1 - (4 * n + 4) // 5]].view(np.int64)
                    found.append(np.stack([first, np.full(len(first), node), np.full(len(first), n), np.arange(len(first))]))
            s, v, n, at = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(v), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["shingle", "node", "n", "at"])

    return bounded_batches(df).select(F.col(text).cast("string")).mapInArrow(prefixes, "shingle long, node long, n int, at int")


def _bit(digest: Column) -> tuple[Column, Column]:
    """Which part of a map, of 32768 bits, and which bit of it a digest sets."""
    at = F.pmod(digest, F.lit(BITS))
    return F.shiftright(at, 15).cast("int"), at.bitwiseAND(F.lit(32767))


def _map_of(places: DataFrame) -> DataFrame:
    """``part``, ``bits``: a map of BITS bits, however many the rows, in which the digests of ``places`` are set. It only
    says which rows need not be dealt out with their texts to be joined to ``places``: none that it has not marked."""
    part, bit = _bit(F.col("digest"))
    return places.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))


def _marked(rows: DataFrame, digest: str, bits: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows that the map marks, or with ``left_anti`` the others. The map is broadcast, rows stay where they are."""
    part, bit = _bit(rows[digest])
    byte = F.conv(F.hex(F.substring(bits["bits"], (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    return rows.join(F.broadcast(bits), (part == bits["part"]) & is_set, how)


def links(df: DataFrame, key: str, text: str, named: DataFrame, scratch: Scratch) -> DataFrame:
    """``a`` < ``b``: similar nodes of the texts of ``df``, enough of them to span every group. ``named``: see ``_named``."""
    table = named.filter("counter is not null").groupBy("counter").agg(F.sum("times").alias("times")).toArrow()  # COUNTERS rows at most
    counts = np.zeros(COUNTERS, np.int64)
    counts[table["counter"].to_numpy()] = table["times"].to_numpy()
    # A shingle of one row is of no use. Copies of a text that met in no task count as two rows here, which does no harm.
    # Rows are dealt out by shingle once, and counted and rid of copies where they are then.
    found = _prefixes(df, text, counts).withColumn("rows", F.count("*").over(Window.partitionBy("shingle")))
    grouped = scratch.table(found.filter("rows > 1").drop("rows").distinct(), "grouped")
    nodes = named.filter("n > 0").groupBy("node").agg(F.min("place").alias("place"), F.min("fp").alias("fp"), F.min("n").cast("int").alias("n"), F.min("sketch").alias("sketch"))
    nodes = scratch.table(nodes, "nodes")

    def similar(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose whole sets are similar."""
        pairs = scratch.table(pairs, f"{name}-proposed")
        first, second = (nodes.select(F.col("node").alias(i), F.col("sketch").alias(f"of_{i}"), F.col("n").alias(f"n_{i}")) for i in "ab")
        pairs = pairs.join(first, "a").join(second, "b").select("a", "b", "of_a", "n_a", "of_b", "n_b")
        pairs = scratch.table(pairs.mapInArrow(_not_excluded, "a long, b long"), f"{name}-pairs")
        wanted = scratch.table(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select("node", "place.*"), f"{name}-wanted")
        texts = df.select(F.col(key).alias("key"), F.xxhash64(*map(F.col, df.columns)).alias("digest"), F.col(text).cast("string").alias("text"))
        texts = _marked(bounded_batches(texts), "digest", _map_of(wanted))
        own = texts.join(wanted, texts["key"].eqNullSafe(wanted["key"]) & (texts["digest"] == wanted["digest"])).select("text", "node")
        sets = own.mapInArrow(_sets, "node long, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes"))  # repeated rows give one
        sets = scratch.table(sets, f"{name}-sets")
        first, second = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
        both = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y")
        out = scratch.table(both.mapInArrow(_confirmed, "a long, b long"), name)
        scratch.drop(f"{name}-proposed", f"{name}-pairs", f"{name}-sets", f"{name}-wanted")
        return out

    # Stars: texts of one fingerprint to the least of them, these along the links of fingerprints, and the texts of a
    # shingle to that of them which shares most of its shingles with any other. The text that the others are edits of, or
    # the least edited one, is nearest to all, and as all its shingles name it, the stars of a group have few centres.
    centres = scratch.table(nodes.groupBy("fp").agg(F.min("node").alias("centre")), "centres")
    to_centre = nodes.select("node", "fp").join(centres, "fp").filter("node <> centre").select(*_ordered("node", "centre"))
    near = simhash.links(centres.select("fp"), scratch)
    left, right = centres.select(F.col("fp").alias("a"), F.col("centre").alias("x")), centres.select(F.col("fp").alias("b"), F.col("centre").alias("y"))
    between = near.join(left, "a").join(right, "b").select(*_ordered("x", "y"))
    weighed = grouped.join(grouped.groupBy("node").agg(F.count("*").alias("shared")), "node")
    ends = weighed.groupBy("shingle").agg(F.max(F.struct("shared", "node", "n", "at")).alias("end"))
    stars = grouped.join(ends, "shingle").filter("node <> end.node")
    stars = stars.filter(_possible(F.col("n"), F.col("at"), F.col("end.n"), F.col("end.at"))).select(*_ordered("node", "end.node"))
    spanning = similar(stars.union(to_centre).union(between).distinct(), "stars")

    placed = grouped.join(connect(spanning, scratch), "node", "left").select("shingle", "node", "n", "at", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("shingle")
    left = scratch.table(placed.join(open_, "shingle"), "open")
    scratch.drop("grouped")
    right = left.select("shingle", F.struct("node", "n", "at", "root").alias("end"))
    # The first shingle that a similar pair has in common meets the conditions, whatever later ones do.
    pairs = left.join(right, "shingle").filter((F.col("root") < F.col("end.root")) & _possible(F.col("n"), F.col("at"), F.col("end.n"), F.col("end.at")))
    pairs = pairs.select(*_ordered("node", "end.node")).distinct()
    return spanning.union(similar(pairs.join(spanning, ["a", "b"], "left_anti"), "pairs"))


def keep_one(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``df`` of each group of near copies: the one with the smallest key.

    Null keys come last, and rows of one key go by a digest of all their columns, so repeated rows leave one. Texts of
    equal words are in one group, texts without words too. Words end at white space, so a text in a script without
    spaces has only its exact copies.
    """
    with Scratch(df.sparkSession, "near") as scratch:
        named = scratch.table(_named(df, key, text), "named")
        nodes = named.filter("counter is null").groupBy("node", "place").agg(F.count("*").alias("times"))
        placed = nodes.join(connect(links(df, key, text, named, scratch), scratch), "node", "left")
        placed = scratch.table(placed.select(F.coalesce("root", "node").alias("root"), F.struct("place", "times").alias("spot")), "placed")
        first = placed.groupBy("root").agg(F.min("spot").alias("first"))
        gone = materialize(placed.join(first, "root").filter("spot.place <> first.place").select("spot.place.key", "spot.place.digest"), "near-gone")
        repeated = materialize(first.filter("first.times > 1").select("first.place.key", "first.place.digest"), "near-repeated")
    digest = "digest" + "_" * max(map(len, df.columns))  # no column of df
    every = df.withColumn(digest, F.xxhash64(*map(F.col, df.columns)))
    bits = materialize(_map_of(gone.union(repeated)), "near-map")
    rows = _marked(every, digest, bits)
    kept = rows.join(gone, _same(rows, gone, key, digest), "left_anti")
    if not repeated.isEmpty():
        once = kept.join(repeated, _same(kept, repeated, key, digest), "left_semi").dropDuplicates([key, digest])
        kept = kept.join(repeated, _same(kept, repeated, key, digest), "left_anti").union(once)
    kept = kept.union(_marked(every, digest, bits, "left_anti"))
    return kept.select(*df.columns)


def _same(rows: DataFrame, places: DataFrame, key: str, digest: str) -> Column:
    return rows[key].eqNullSafe(places["key"]) & (rows[digest] == places["digest"])
