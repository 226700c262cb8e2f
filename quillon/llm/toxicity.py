"""A toxicity classifier with counterfactual regularisation.

A text is toxic if one of its words is: each distinct word has an intensity, softplus of the sum of its features'
weights (the word, its beginnings and its end, which also judge words never seen), and the score of a text is
1 - exp(-sum of intensities), so clean padding of any length does not hide a word, nor do many clean words add up to
a toxic text once training has seen such. The loss is the usual log loss of the labels plus a penalty: in labelled
sentences a term that names a group is swapped for another one, and the mean squared change of the sentences' scores
counts for each term.
That takes from group terms what they have only by keeping company with toxic words.

Group terms are those of a fixed list and, since every corpus has its own, words that the training texts themselves
show to be neutral: about as frequent, neither rare nor ubiquitous, in texts of either label.

Fitting uses a bounded sample of labelled rows, about ``per_class`` texts of each label and about ``sentences`` of
their sentences with group terms (both by a hash), and runs in the driver; scoring is independent row by row and covers
whole texts.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import Memo, Scratch, Shared, bounded_batches, remainder, thinned

#: Fixed list: terms that name groups, swapped for each other within a language.
IDENTITY_TERMS = {
    "en": ("women", "men", "girls", "boys", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants", "refugees", "gays", "lesbians", "blacks", "whites", "asians", "africans", "europeans", "americans"),
    "de": ("frauen", "männer", "mädchen", "jungen", "muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "einwanderer", "flüchtlinge", "schwule", "lesben", "afrikaner", "europäer"),
    "fr": ("femmes", "hommes", "filles", "garçons", "musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "immigrés", "réfugiés", "homosexuels", "lesbiennes", "africains", "européens"),
    "es": ("mujeres", "hombres", "chicas", "chicos", "musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "inmigrantes", "refugiados", "homosexuales", "lesbianas", "africanos", "europeos"),
}

#: Buckets of hashed features; texts of each label, and sentences with group terms, in the sample; epochs; weights of the
#: counterfactual penalty and of the squared feature weights (the best of five on a split of the training rows).
BUCKETS, PER_CLASS, SENTENCES, EPOCHS, PENALTY, DECAY = 1 << 19, 4000, 40_000, 120, 20.0, 1e-5
#: Terms found in the training texts: how many at most, their least length, the share of the texts of a label that hold
#: one, and the most that the shares of the two labels differ by.
FOUND, LEAST_LETTERS, SHARES, RATIO = 128, 4, (0.005, 0.1), 1.5
THRESHOLD = 0.7

_WORD = regex.compile(r"\p{L}+")
_SENTENCE = re.compile(r"[.!?\n]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(word: str) -> list[int]:
    n = len(word)
    parts = ["w" + word] + [f"p{word[:k]}" for k in (3, 4, 5) if n > k] + [f"s{word[-4:]}"] * (n > 4)
    return [zlib.crc32(p.encode()) % (BUCKETS - 1) + 1 for p in parts]


class Intensities(Memo):
    """Maps a word to its intensity."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def make(self, word: str) -> float:
        z = sum(map(self.weights.item, features_of(word))) + self.weights.item(0)
        return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))

    def score(self, text: str | None) -> float:
        return -math.expm1(-math.fsum(map(self.__getitem__, words_of(text))))  # exactly rounded: any order gives the same


def found_terms(texts: Iterable[tuple[Iterable[str], int]], known: Iterable[str] = ()) -> tuple[str, ...]:
    """Words that texts of either label (distinct words, label) use alike, the most frequent first; ``known`` ones are
    left out. They stand in for names of groups: what a text says of one, it could say of another."""
    counts, sizes, leave = (Counter(), Counter()), [0, 0], set(known)
    for words, y in texts:
        counts[y].update(w for w in words if len(w) >= LEAST_LETTERS)
        sizes[y] += 1
    if not all(sizes):
        return ()
    shares = ((w, n / sizes[0], counts[1][w] / sizes[1]) for w, n in counts[0].items() if w in counts[1] and w not in leave)
    neutral = [(x + y, w) for w, x, y in shares if min(x, y) >= SHARES[0] and max(x, y) <= min(SHARES[1], RATIO * min(x, y))]
    return tuple(w for _, w in sorted(neutral, key=lambda p: (-p[0], p[1]))[:FOUND])


def counterfactuals(words: Iterable[str], groups: Iterable[tuple[str, ...]] = tuple(IDENTITY_TERMS.values())) -> list[tuple[str, str]]:
    """(word, word in its place) for each term among a sentence's words: two other terms of each group that it is in."""
    found = []
    for word in words:
        for same in groups:
            if word in same:
                at = same.index(word)
                found += [(word, same[(at + k) % len(same)]) for k in (1, 1 + len(same) // 2) if same[(at + k) % len(same)] != word]
    return found


class Problem:
    """The loss of weights on labelled texts and sentences with swaps, and its gradient."""

    def __init__(self, texts: Iterable[Iterable[str]], toxic: np.ndarray, swaps: Iterable[tuple[Iterable[str], list[tuple[str, str]]]] = (), penalty: float = PENALTY, decay: float = DECAY):
        """``texts``: the distinct words of each, ``toxic``: their labels; ``swaps``: the distinct words of a sentence, and
        what is swapped in it."""
        index: dict[str, int] = {}
        self.toxic, self.penalty, self.decay = toxic, penalty, decay
        number = lambda w: index.setdefault(w, len(index))
        self.word, self.doc, self.n_texts = self._flat((map(number, sorted(words)) for words in texts))
        held, out, into, at, new = [], array("i"), array("i"), array("i"), array("b")
        for words, pairs in swaps:
            words = set(words)
            for a, b in pairs:
                out.append(number(a))
                into.append(number(b))
                at.append(len(held))
                new.append(b not in words)
            held.append(sorted(map(number, words)))
        self.held, self.sentence, self.n_sentences = self._flat(held)
        self.out, self.into, self.at = (np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32) for x in (out, into, at))
        self.new = np.frombuffer(new, np.int8).astype(float) if len(new) else np.empty(0)
        self.weight = 1 / np.bincount(self.out)[self.out] if len(out) else np.empty(0)  # a rare term counts as much as a frequent one
        hashed, spans = array("i"), array("i")
        for w in index:
            own = features_of(w)
            hashed.extend(own)
            spans.append(len(own))
        self.n_words = len(index)
        self.used, feature = np.unique(np.frombuffer(hashed, np.int32) if index else np.empty(0, np.int32), return_inverse=True)
        self.feature = feature.astype(np.int32)
        self.of_word = np.repeat(np.arange(self.n_words, dtype=np.int32), np.frombuffer(spans, np.int32)) if index else np.empty(0, np.int32)

    @staticmethod
    def _flat(lists) -> tuple[np.ndarray, np.ndarray, int]:
        numbers, sizes = array("i"), array("i")
        for x in lists:
            before = len(numbers)
            numbers.extend(x)
            sizes.append(len(numbers) - before)
        as_array = lambda x: np.frombuffer(x, np.int32) if len(x) else np.empty(0, np.int32)
        return as_array(numbers), np.repeat(np.arange(len(sizes), dtype=np.int32), as_array(sizes)), len(sizes)

    def loss(self, theta: np.ndarray, bias: float) -> tuple[float, np.ndarray]:
        """The loss, and its gradient by the weights of the used features and, last, by the bias."""
        z = np.bincount(self.of_word, theta[self.feature], self.n_words) + bias
        rate = np.logaddexp(0, z)
        total = np.bincount(self.doc, rate[self.word], self.n_texts) + 1e-9
        loss = np.where(self.toxic == 1, -np.log(-np.expm1(-np.minimum(total, 50))), total).sum() / self.n_texts
        by_doc = np.where(self.toxic == 1, np.where(total < 50, -1 / np.expm1(np.minimum(total, 50)), 0.0), 1.0) / self.n_texts
        by_word = np.bincount(self.word, by_doc[self.doc], self.n_words)
        if len(self.at) and self.penalty:
            before = np.bincount(self.sentence, rate[self.held], self.n_sentences)[self.at]
            after = before - rate[self.out] + self.new * rate[self.into]
            clean, other = np.exp(-before), np.exp(-after)  # the chance that no word is toxic: the score's complement
            change = clean - other
            loss += self.penalty * (self.weight * change**2).sum()
            by_before, by_after = (2 * self.penalty * self.weight * change * x for x in (-clean, other))
            by_sentence = np.bincount(self.at, by_before + by_after, self.n_sentences)
            by_word += np.bincount(self.held, by_sentence[self.sentence], self.n_words)
            by_word += np.bincount(self.into, self.new * by_after, self.n_words) - np.bincount(self.out, by_after, self.n_words)
        by_word *= 1 / (1 + np.exp(-z))
        loss += self.decay / 2 * (theta**2).sum()
        return loss, np.append(np.bincount(self.feature, by_word[self.of_word], len(self.used)) + self.decay * theta, by_word.sum())

    def solve(self, epochs: int = EPOCHS) -> np.ndarray:
        """Weights by gradient descent (Adam): the bias at 0, features at their hashes."""
        weights = np.zeros(BUCKETS, np.float32)
        weights[0] = -6.0
        if not self.n_words or not self.n_texts:
            return weights
        theta, bias = np.zeros(len(self.used)), -6.0
        m, v = np.zeros(len(self.used) + 1), np.zeros(len(self.used) + 1)
        for epoch in range(1, epochs + 1):
            _, gradient = self.loss(theta, bias)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            step = 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
            theta -= step[:-1]
            bias -= step[-1]
        weights[self.used], weights[0] = theta, bias
        return weights


def gather(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, sentences: int = SENTENCES, terms: dict = IDENTITY_TERMS,
) -> tuple[list[tuple[list[str], int]], list[tuple[list[str], list[tuple[str, str]]]]]:
    """What is learned from: (distinct words, label) of sampled texts, and (distinct words, swaps) of their sentences.

    Only rows whose crc32(key as text) mod 3 is not 1 are read. Where the sampled texts have more sentences with group
    terms than ``sentences``, about so many are taken by a hash of the sentence, from anywhere in the texts.
    """
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    sample = thinned(marked.filter(remainder("k", 3) != 1), "k", "y", per_class)
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x")).filter("x is not null").join(F.broadcast(sample), "k")
    with Scratch(df.sparkSession, "toxicity") as scratch:
        rows = scratch.table(bounded_batches(rows).groupBy("k", "y").agg(F.min("x").alias("x")).select("x", "y"), "sample")  # an id counts once

        def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(words_of(x))) for x in batch.column(0).to_pylist()], pa.string()), batch.column(1)], ["words", "y"])

        found = rows.mapInArrow(distinct, "words string, y int").toArrow()  # 2 per_class texts' distinct words
        texts = sorted(zip(found["words"].to_pylist(), found["y"].to_pylist()))  # rows arrive in any order
        texts = [(x.split(" ") if x else [], y) for x, y in texts]
        listed = [w for same in terms.values() for w in same]
        groups = (*terms.values(), found_terms(texts, listed))
        known = frozenset(w for same in groups for w in same)

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0).to_pylist():
                    own = (words_of(s) for s in _SENTENCE.split(x))
                    yield pa.RecordBatch.from_arrays([pa.array([" ".join(sorted(s)) for s in own if not known.isdisjoint(s)], pa.string())], ["words"])

        named = scratch.table(rows.mapInArrow(split, "words string"), "sentences")
        n, spread = named.count(), 1 << 30
        some = named.filter(F.pmod(F.xxhash64("words"), F.lit(spread)) < min(spread, spread * sentences // max(n, 1))).toArrow()  # about ``sentences``
    words = [x.split(" ") for x in sorted(some["words"].to_pylist())]
    return texts, [(s, counterfactuals(s, groups)) for s in words]


def train(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = PER_CLASS, sentences: int = SENTENCES, penalty: float = PENALTY, terms: dict = IDENTITY_TERMS,
) -> np.ndarray:
    """Weights learned from labelled rows whose crc32(key as text) mod 3 is not 1: see ``gather``."""
    texts, swaps = gather(df, labels, key, text, label, per_class, sentences, terms)
    toxic = np.array([y for _, y in texts], np.int32)
    return Problem((x for x, _ in texts), toxic, swaps, penalty).solve()


def score(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``score`` (0 to 1; higher: label 1 is likelier) and ``predicted`` (1 from THRESHOLD on).

    Null and empty texts score 0. Rows are independent: repeated rows stay, null keys stay null, an empty table gives
    no rows, other columns are ignored.
    """
    shared = Shared(df.sparkSession, weights)
    out = T.StructType([df.schema[key], T.StructField("score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intensities = shared.built(Intensities)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([intensities.score(x) for x in part.column(1).to_pylist()], pa.float64())], out.names)

    rows = bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(scored, out)
    return rows.select(key, (remainder(key, 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_civil(df: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that are not predicted toxic, with all their columns."""
    shared = Shared(df.sparkSession, weights)
    place = df.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        intensities = shared.built(Intensities)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part.filter(pa.array([intensities.score(x) < THRESHOLD for x in part.column(place).to_pylist()], pa.bool_()))

    return bounded_batches(df).mapInArrow(kept, df.schema)
