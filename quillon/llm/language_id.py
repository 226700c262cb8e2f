"""Language identification of words and texts by a linear-chain conditional random field.

Each word of a text (a run of letters) has a label, its language. Emission scores come from features of the word
alone (its beginnings and ends, letter n-grams over the whole of it, the word, and in which languages' lexicons of
frequent words it stands); learned transitions make neighbours agree, yet allow a switch. Forward-backward gives each word's marginal
probabilities; a text's language has the largest mean marginal over all its words.

Marginals only choose among the learned languages: words of any other have large ones too. Whether a word is in a known
language at all is told by its letter trigrams: its support by a language is the share of them that the language's
training words hold, over what share new words of that language may be expected to have.

Training texts have one language each, so fragments of several are spliced into sequences with known switches, from
which transitions are learned too. Fitting uses a bounded sample (about ``per_language`` texts by a hash of the id, from
each a fragment of at most FRAGMENT words) and runs in the driver.

Scoring takes whole texts. All texts of a slice are cut into chunks of equal length whose forward, backward and
transfer-matrix recurrences run side by side; the chunks of a text are then tied together exactly by their transfer
matrices, so a very long text is no long loop. Memory is in proportion to the longest text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import MEMO_BYTES, Shared, bounded_batches, remainder, thinned

#: Buckets of hashed features; texts of each language in the sample; words of a fragment; fragments of a sequence; epochs.
BITS, PER_LANGUAGE, FRAGMENT, SPLICED, EPOCHS = 17, 1500, 60, 3, 50
BUCKETS, MASK = 1 << BITS, (1 << 64) - 1
#: Words of a language's lexicon; chunk length of scoring; words of a passage that shows a known language.
LEXICON, CHUNK, PASSAGE = 300, 64, 20
UNDETERMINED = "und"

#: Longer runs of letters, as in scripts without spaces, are cut into several words of so many letters.
LONGEST = 4096
_WORD = regex.compile(rf"\p{{L}}{{1,{LONGEST}}}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words, each marked at both ends, and the sizes of the marked words."""
    chars = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return chars, np.fromiter(map(len, words), np.int64, len(words)) + 2


def trigrams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and letter trigrams (21 bits a letter) of marked words, as often as they occur; each word has one."""
    chars, sizes = _letters(words)
    at = np.arange(len(chars))
    of = np.repeat(np.arange(len(words)), sizes)
    whole = at[np.cumsum(sizes)[of] - at >= 3]
    shift = np.uint64(21)
    return of[whole], (chars[whole] << shift | chars[whole + 1]) << shift | chars[whole + 2]


def _mixed(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of hashes; ``kind`` tells features of one hash apart."""
    return ((h ^ np.uint64(kind * 0x9E3779B97F4A7C15 & MASK)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BITS)).astype(np.int32)


def features_of(words: list[str], lexicons: dict[str, frozenset]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and buckets of the features of many words at once: for each word its letter n-grams over the whole
    of it (marked at both ends; as often as they occur), its first and last letters, itself, and the lexicons it is in."""
    chars, sizes = _letters(words)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    number = np.arange(len(words))
    of = np.repeat(number, sizes)
    at = np.arange(len(chars))
    left = ends[of] - at
    padded = np.concatenate([chars, np.zeros(4, np.uint64)])
    base = np.uint64(0x100000001B3)
    found_of, found = [], []

    def add(places: np.ndarray, h: np.ndarray, kind: int) -> None:
        found_of.append(places)
        found.append(_mixed(h, kind))

    h = np.zeros(len(chars), np.uint64)
    for k in (1, 2, 3):
        h = h * base + padded[k - 1 : k - 1 + len(chars)]
        whole = left >= k
        add(of[whole], h[whole], k)
    head, tail, factor = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64), 1
    for k in (1, 2, 3, 4):
        some = sizes - 2 >= k
        head[some] = head[some] * base + chars[(starts + k)[some]]
        add(number[some], head[some], 3 + k)
        tail[some] += np.uint64(factor) * chars[(ends - 1 - k)[some]]
        add(number[some], tail[some], 7 + k)
        factor = factor * int(base) & MASK
    if len(words):
        powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(int(sizes.max()), base)]))
        add(number, np.add.reduceat(chars * powers[at - starts[of]], starts), 12)
    known = {}
    for i, lang in enumerate(sorted(lexicons)):
        for w in lexicons[lang]:
            known.setdefault(w, []).append(i)
    listed = [(n, i) for n, w in enumerate(words) if w in known for i in known[w]]
    add(np.array([n for n, _ in listed], np.int64), np.array([i for _, i in listed], np.uint64), 13)
    return np.concatenate(found_of).astype(np.int32), np.concatenate(found)


class Model:
    """Weights of features by label, and log scores of transitions and first labels."""

    def __init__(self, labels: list[str], weights: np.ndarray, transitions: np.ndarray, first: np.ndarray, lexicons: dict):
        self.labels, self.weights, self.transitions, self.first, self.lexicons = labels, weights, transitions, first, lexicons
        self.trigrams, self.shares = np.empty(0, np.uint64), np.zeros((0, len(labels)))

    def observe(self, found: list[tuple[str, list[str]]]) -> Model:
        """Notes which trigrams the training texts (label, words) of each label hold: 1 / expected share of them in new
        words of that label, by Good and Turing's estimate over texts; 0 for trigrams that the label's texts lack."""
        each = [(self.labels.index(y), np.unique(trigrams_of(words)[1])) for y, words in found]
        self.trigrams = np.unique(np.concatenate([g for _, g in each]))
        texts = np.zeros((len(self.trigrams), len(self.labels)), np.int64)
        for j, g in each:
            texts[np.searchsorted(self.trigrams, g), j] += 1
        expected = 1 - (texts == 1).sum(axis=0) / np.maximum(texts.sum(axis=0), 1)
        self.shares = (texts > 0) / np.maximum(expected, 0.1)
        return self

    def support(self, words: list[str]) -> np.ndarray:
        """The support (0 to 1) of each word by each label."""
        of, g = trigrams_of(words)
        place = np.minimum(np.searchsorted(self.trigrams, g), len(self.trigrams) - 1)
        held = self.shares[place] * (self.trigrams[place] == g)[:, None]
        total = np.stack([np.bincount(of, held[:, j], len(words)) for j in range(len(self.labels))], axis=1)
        return np.minimum(total / np.maximum(np.bincount(of, minlength=len(words)), 1)[:, None], 1.0)


def _normal(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(emit: np.ndarray, mask: np.ndarray, texts: np.ndarray, step: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Forward-backward over chunks. emit: chunks x length x labels (positive); mask: which places hold words (from
    the left); texts: the text of each chunk, ascending; step: transitions; first: weights of first labels.
    Gives the marginal of each place."""
    n, length, k = emit.shape
    new = np.append(True, texts[1:] != texts[:-1])
    single = new & np.append(new[1:], True)
    into = np.broadcast_to(first, (n, k)).copy()  # what a chunk's first word finds before its emission
    after = np.ones((n, k))  # what a chunk's last word finds behind it
    many = np.flatnonzero(~single)
    if len(many):
        moved = np.broadcast_to(np.eye(k), (len(many), k, k)).copy()
        for t in range(length):
            lead = moved if t == 0 else (moved.reshape(-1, k) @ step).reshape(-1, k, k)
            put = _normal((lead * emit[many, t][:, None, :]).reshape(len(many), -1)).reshape(-1, k, k)
            moved = np.where(mask[many, t][:, None, None], put, moved)
        for i, c in enumerate(many):  # along each text's chunks
            if not new[c]:
                into[c] = _normal(_normal(into[c - 1] @ moved[i - 1]) @ step)
        for i in range(len(many) - 1, -1, -1):
            c = many[i]
            if c + 1 < n and not new[c + 1]:
                after[c] = _normal(step @ (moved[i + 1] @ after[c + 1]))
    ahead = np.empty_like(emit)
    state = into
    for t in range(length):
        lead = state if t == 0 else state @ step
        state = np.where(mask[:, t, None], _normal(lead * emit[:, t]), state)
        ahead[:, t] = state
    back = after
    out = np.empty_like(emit)
    for t in range(length - 1, -1, -1):
        out[:, t] = _normal(ahead[:, t] * back)
        back = np.where(mask[:, t, None], _normal((emit[:, t] * back) @ step.T), back)
    return out


class Training:
    """The mean log likelihood of all words' labels in training sequences, and its gradients."""

    def __init__(self, sequences: list[list[tuple[str, int]]], labels: list[str], lexicons: dict, penalty: float = 1e-7):
        self.k, self.penalty = len(labels), penalty
        index: dict[str, int] = {}
        for s in sequences:
            for w, _ in s:
                index.setdefault(w, len(index))
        self.n_words = len(index)
        self.of_word, hashed = features_of(list(index), lexicons)
        self.used, feature = np.unique(hashed, return_inverse=True)
        self.feature = feature.astype(np.int32)
        shape = (len(sequences), max(map(len, sequences)))
        self.word, gold, self.mask = np.zeros(shape, np.int32), np.zeros(shape, np.int32), np.zeros(shape, bool)
        for i, s in enumerate(sequences):
            self.word[i, : len(s)], gold[i, : len(s)], self.mask[i, : len(s)] = [index[w] for w, _ in s], [y for _, y in s], True
        self.truth = np.eye(self.k)[gold] * self.mask[:, :, None]
        self.total = self.mask.sum()
        self.inner = self.mask[:, 1:]
        self.want_step = np.einsum("stk,stl->kl", self.truth[:, :-1] * self.inner[:, :, None], self.truth[:, 1:])
        self.want_first = self.truth[:, 0].sum(axis=0)

    def value(self, theta: np.ndarray, step: np.ndarray, first: np.ndarray) -> tuple[float, list[np.ndarray]]:
        scores = np.stack([np.bincount(self.of_word, theta[self.feature, j], self.n_words) for j in range(self.k)], axis=1)
        top = scores.max(axis=1)
        e, a, f = np.exp(scores - top[:, None])[self.word], np.exp(step - step.max()), np.exp(first - first.max())
        p = marginals(e, self.mask, np.arange(len(self.word)), a, f) * self.mask[:, :, None]
        # Pairs: P(y, y') at a step is proportional to ahead(y) a(y, y') emit(y') back(y'); by marginals p / lead it is:
        ahead, lead, size = np.empty_like(e), np.ones_like(e), np.ones(self.mask.shape)
        state = f * e[:, 0]
        size[:, 0] = state.sum(axis=1)
        ahead[:, 0] = state = _normal(state)
        for t in range(1, e.shape[1]):
            lead[:, t] = state @ a
            put = lead[:, t] * e[:, t]
            size[:, t] = np.where(self.mask[:, t], put.sum(axis=1), 1.0)
            ahead[:, t] = state = np.where(self.mask[:, t, None], _normal(put), state)
        pairs = np.einsum("stk,stl->kl", ahead[:, :-1] * self.inner[:, :, None], p[:, 1:] / np.maximum(lead[:, 1:], 1e-300)) * a
        of_truth = (self.truth * (scores - top[:, None])[self.word]).sum() + (self.want_step * (step - step.max())).sum() + (self.want_first * (first - first.max())).sum()
        value = (of_truth - np.log(size).sum()) / self.total - self.penalty / 2 * (theta**2).sum()
        flat, at = (self.truth - p)[self.mask], self.word[self.mask]
        by_word = np.stack([np.bincount(at, flat[:, j], self.n_words) for j in range(self.k)], axis=1)
        by_feature = np.stack([np.bincount(self.feature, by_word[self.of_word, j], len(self.used)) for j in range(self.k)], axis=1)
        return value, [by_feature / self.total - self.penalty * theta, (self.want_step - pairs) / self.total, (self.want_first - p[:, 0].sum(axis=0)) / self.total]


def fit(sequences: list[list[tuple[str, int]]], labels: list[str], lexicons: dict, epochs: int = EPOCHS) -> Model:
    """Maximises the likelihood of the labels of all words, by gradient ascent (Adam) with a small penalty."""
    k, training = len(labels), Training(sequences, labels, lexicons)
    theta, step, first = np.zeros((len(training.used), k)), np.zeros((k, k)), np.zeros(k)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (theta, step, first)]
    for epoch in range(1, epochs + 1):
        _, gradients = training.value(theta, step, first)
        for value, gradient, moment in zip((theta, step, first), gradients, moments):
            moment[0] = 0.9 * moment[0] + 0.1 * gradient
            moment[1] = 0.99 * moment[1] + 0.01 * gradient**2
            value += 0.1 * (moment[0] / (1 - 0.9**epoch)) / (np.sqrt(moment[1] / (1 - 0.99**epoch)) + 1e-9)
    weights = np.zeros((BUCKETS, k), np.float32)
    weights[training.used] = theta
    return Model(labels, weights, step, first, lexicons)


def train(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, epochs: int = EPOCHS) -> Model | None:
    """A model of the languages of rows whose crc32(key as text) mod 5 is not 0; None if there is none to learn from.

    The sample has about ``per_language`` texts of each language and of each a stretch of at most FRAGMENT words, at a
    place that a hash of the key chooses, so the driver's work is bounded by these two whatever texts there are."""
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("x"), F.col(lang).cast("string").alias("y"))
    rows = rows.filter("k is not null and x is not null and y is not null").filter(remainder("k", 5) != 0)
    picked = thinned(rows, "k", "y", per_language).groupBy("k").agg(F.min(F.struct("y", "x")).alias("r"))  # an id counts once
    picked = picked.select("r.x", F.xxhash64("k").alias("h"), "r.y")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(x)
                at = h % max(1, len(words) - FRAGMENT + 1)
                found.append(" ".join(words[at : at + FRAGMENT]))
            yield pa.RecordBatch.from_arrays([pa.array(found), batch.column(2), batch.column(1)], ["words", "y", "h"])

    table = picked.mapInArrow(read, "words string, y string, h long").toArrow()
    found = sorted(set(zip(table["h"].to_pylist(), table["y"].to_pylist(), table["words"].to_pylist())))
    found = [(y, w.split()) for _, y, w in found if w]
    labels = sorted({y for y, _ in found})
    if not labels:
        return None
    counts = {y: Counter() for y in labels}
    for y, words in found:
        counts[y].update(set(words))
    lexicons = {y: frozenset(w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]) for y, c in counts.items()}
    sequences = []
    for at in range(0, len(found), SPLICED):
        parts = found[at : at + SPLICED]
        sequences.append([(w, labels.index(y)) for y, words in parts for w in words])
    return fit(sequences, labels, lexicons, epochs).observe(found)


class Tagger(dict):
    """Maps a word to the row of its emissions, for two generations of words of bounded size; gives the marginals of texts."""

    def __init__(self, model: Model, most: int = MEMO_BYTES):
        super().__init__()
        self.model, self.most = model, most
        self.k = len(model.labels)
        self.emit, self.size = self.emissions([]), 0
        self.older: tuple[dict, np.ndarray] = ({}, self.emit)
        self.step, self.first = np.exp(model.transitions - model.transitions.max()), np.exp(model.first - model.first.max())

    def emissions(self, words: list[str]) -> np.ndarray:
        of, feature = features_of(words, self.model.lexicons)
        score = np.stack([np.bincount(of, self.model.weights[feature, j], len(words)) for j in range(self.k)], axis=1)
        return np.maximum(np.exp(score - score.max(axis=1, keepdims=True)), 1e-30)

    def learn(self, words: set[str]) -> None:
        """Makes room for the words and has a row for each."""
        fresh = [w for w in words if w not in self]
        need = sum(map(len, fresh)) + len(fresh) * (150 + 8 * self.emit.shape[1])  # bytes, about; wide letters are rare enough
        if self.size + need > self.most:  # what is asked for again moves on, the rest goes
            self.older, self.size = (dict(self), self.emit), 0
            self.clear()
            self.emit = self.emissions([])
            fresh = list(words)
            need = sum(map(len, fresh)) + len(fresh) * (150 + 8 * self.emit.shape[1])
        self.size += need
        known, rows = self.older
        moved = [w for w in fresh if w in known]
        new = [w for w in fresh if w not in known]
        parts = [self.emit, rows[[known[w] for w in moved]]] if moved else [self.emit]
        at = size = 0
        for i, w in enumerate(new):  # features of a bounded number of letters at a time
            size += len(w)
            if size >= 1 << 18 or i == len(new) - 1:
                parts.append(self.emissions(new[at : i + 1]))
                at, size = i + 1, 0
        for w in moved + new:
            self[w] = len(self)
        self.emit = np.concatenate(parts) if len(parts) > 1 else self.emit

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The marginals (words x labels) of each text's words, with what else their rows have."""
        self.learn(set().union(*texts))
        chunks = np.array([-(-len(t) // CHUNK) for t in texts], np.int64)
        mask = np.zeros((int(chunks.sum()), CHUNK), bool)
        place = np.zeros(mask.shape, np.int64)
        starts = np.concatenate([[0], np.cumsum(chunks)])
        for t, at in zip(texts, starts.tolist()):
            if t:
                ids = np.fromiter(map(self.__getitem__, t), np.int64, len(t))
                place.reshape(-1)[at * CHUNK : at * CHUNK + len(t)] = ids
                mask.reshape(-1)[at * CHUNK : at * CHUNK + len(t)] = True
        if not len(mask):
            return [self.emissions([]) for _ in texts]
        rows = self.emit[place]
        rows[:, :, : self.k] = marginals(rows[:, :, : self.k], mask, np.repeat(np.arange(len(texts)), chunks), self.step, self.first)
        found = rows.reshape(-1, rows.shape[2])
        return [found[at * CHUNK : at * CHUNK + len(t)] for t, at in zip(texts, starts.tolist())]

    def languages(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for p in self.tag([words_of(x) for x in texts]):
            if len(p):
                mean = p.mean(axis=0)
                best = int(mean.argmax())
                out.append((self.model.labels[best], float(min(1.0, max(0.0, mean[best])))))
            else:
                out.append((UNDETERMINED, 0.0))
        return out


class Judge(Tagger):
    """Also has the support of each word by each language in its row, behind the emissions."""

    def emissions(self, words: list[str]) -> np.ndarray:
        return np.concatenate([super().emissions(words), self.model.support(words)], axis=1)

    def evidence(self, texts: list[str | None]) -> list[float]:
        """How far a text is in known languages, 0 to 1: the support of a word is that by its language, by the marginals;
        of all passages of PASSAGE words (a shorter text is one), the best mean counts. 0 without words."""
        out = []
        for p in self.tag([words_of(x) for x in texts]):
            n = min(len(p), PASSAGE)
            sums = np.concatenate([[0.0], np.cumsum((p[:, : self.k] * p[:, self.k :]).sum(axis=1))])
            out.append(float((sums[n:] - sums[: len(sums) - n]).max() / n) if n else 0.0)
        return out


def _slices(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` characters in all."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        size += len(x or "")
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _tagged(texts: list[str | None], tagger: Tagger | None) -> list[tuple[str, float]]:
    if tagger is None:
        return [(UNDETERMINED, 0.0)] * len(texts)
    return [found for a, b in _slices(texts) for found in tagger.languages(texts[a:b])]


def predict(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``held_out``, ``lang_pred`` and ``score`` (mean marginal of that language over the text's words).

    Texts that are null or hold no letter are ``und`` with score 0; so are all if there was nothing to learn from. Ties
    go to the first label. Repeated rows and null keys stay; an empty table gives no rows; other columns are ignored.
    """
    shared = Shared(df.sparkSession, model)
    out = T.StructType([df.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.built(Tagger) if model is not None else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = _tagged(part.column(1).to_pylist(), tagger)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], out.names)

    rows = bounded_batches(df).select(key, F.col(text).cast("string")).mapInArrow(tagged, out)
    return rows.select(key, (remainder(key, 5) == 0).alias("held_out"), "lang_pred", "score")


def keep_known(df: DataFrame, model: Model | None, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``df`` in known languages, one or several: those whose ``evidence`` is ``least`` or more, so a passage in
    known languages keeps a text, and one of words that no learned language would have goes; without a model, those
    that hold a letter."""
    if model is None:
        return df.filter(F.col(text).rlike(r"\p{L}"))
    shared = Shared(df.sparkSession, model)
    place = df.columns.index(text)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.built(Judge)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(place).to_pylist()
                found = [score for a, b in _slices(texts) for score in judge.evidence(texts[a:b])]
                yield part.filter(pa.array([score > 0 and score >= least for score in found], pa.bool_()))

    return bounded_batches(df).mapInArrow(kept, df.schema)
