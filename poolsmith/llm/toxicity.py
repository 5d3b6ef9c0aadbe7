"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Two words are alike by the subsequences of three signs that they share, each weighed by DECAY for every sign
that it spans and none spanning more than SPAN (word ends count as signs): letters put in or left out lower
the likeness only a little. A sentence is the sum of its words' likenesses to the landmarks, to a power that
keeps the kernel positive and leaves chance likenesses near zero. Landmarks are words of labelled rows that
set toxic rows apart, and some of the commonest. The machine is trained on labelled sentences: of a toxic
row, the sentence that the machine itself finds worst. A row's score is that of its worst sentence, made a
probability by a logistic fit. As the decision is linear in the words, each word's share is worked out once
and remembered.

Defined results: a null text is empty and is scored like any text without a hit; a null id counts as held
out or not like the text "" does; repeated rows are scored each; without labels of both kinds, or
words that rows of one kind have, every score is 0; an empty table gives an empty result; label, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import fresh, table, text_or_empty

#: At most so many labelled rows, those with the smallest hashes of their ids, are trained on.
LABELLED = 3000
TOXIC_LANDMARKS, COMMON_LANDMARKS = 64, 8
SPAN, DECAY, POWER = 5, 0.7, 4
#: Longer sentences are read through windows of so many words, each of which begins in the middle of the one before.
SENTENCE = 64
ROUNDS, COST = 4, 10.0
CUT = 0.7
#: A worker forgets words' shares when it holds this many.
WORDS = 500_000

_CODES = np.array([ord(chr(c).lower()) - 96 if chr(c).isascii() and chr(c).isalpha() else 28 + c % 4 for c in range(0x250)], np.int32)
_BEGIN, _END, _SIGNS = 27, 0, 32
_LOOKALIKE = str.maketrans("013457@$!|", "oieasTasii".lower())
_LETTERS = re.compile(r"[^\W\d_]+")
_TRIM = "*#%&?.,;:()[]{}<>'\"`~!|$-_"
#: Places of three signs from the first on, of a span of at most SPAN.
_PLACES = [(0, *p) for p in combinations(range(1, SPAN), 2)]
_WEIGHTS = np.array([DECAY ** (p[-1] + 1) for p in _PLACES])


def plain(word: str) -> str:
    """Letters alone, in lower case; inside a word, signs that look like letters count as such."""
    w = word.strip(_TRIM).lower()
    if not w.isalpha():
        if not any(map(str.isalpha, w)):
            return ""
        w = "".join(_LETTERS.findall(w.translate(_LOOKALIKE)))
    return w


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, feature, weight) of the subsequences of all words, by word and feature, weights of equal ones summed."""
    size = max(map(len, words)) + 2
    codes = np.zeros((len(words), size), np.int32)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    inside = np.arange(size) < lengths[:, None]
    codes[inside] = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    signs = np.full((len(words), size + SPAN), -1, np.int32)
    signs[:, 1 : size + 1][inside] = np.where(codes < 0x250, _CODES[np.minimum(codes, 0x24F)], 28 + codes % 4)[inside]
    signs[:, 0] = _BEGIN
    signs[np.arange(len(words)), lengths + 1] = _END
    keys = []
    for place, (a, b, c) in enumerate(_PLACES):
        x, y, z = (signs[:, p : p + size] for p in (a, b, c))
        keys.append(np.where(z >= 0, ((x * _SIGNS + y) * _SIGNS + z) << 3 | place, -1))
    keys = np.sort(np.concatenate(keys, axis=1), axis=1)
    word, column = np.nonzero(keys >= 0)
    keys = keys[word, column]
    feature = keys >> 3
    first = np.flatnonzero(np.concatenate([[True], (feature[1:] != feature[:-1]) | (word[1:] != word[:-1])]))
    return word[first], feature[first], np.add.reduceat(_WEIGHTS[keys & 7], first)


class Kernel:
    """Likenesses of words to landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        word, feature, weight = subsequences(landmarks)
        table_ = np.zeros((_SIGNS**3, len(landmarks)), np.float32)
        table_[feature, word] = weight
        self.known = np.flatnonzero(table_.any(axis=1))
        self.table = table_[self.known] / np.sqrt((table_**2).sum(0))

    def __call__(self, words: list[str]) -> np.ndarray:
        place = np.full(_SIGNS**3, -1, np.int64)
        place[self.known] = np.arange(len(self.known))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        i = 0
        while i < len(order):  # like lengths together, and the fewer the longer they are
            j = i + max(1, 8000 // (len(words[order[i]]) + 2))
            while j < len(order) and len(words[order[min(j, len(order)) - 1]]) > 2 * len(words[order[i]]) + 8 and j > i + 1:
                j = i + (j - i) // 2
            at = order[i:j]
            word, feature, weight = subsequences([words[k] for k in at])
            norm = np.sqrt(np.bincount(word, weight**2, len(at)))
            hit = np.flatnonzero(place[feature] >= 0)
            if len(hit):
                owner = word[hit]
                first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                parts = self.table[place[feature[hit]]] * weight[hit, None].astype(np.float32)
                out[np.array(at)[owner[first]]] = np.add.reduceat(parts, first, axis=0) / norm[owner[first], None]
            i = j
        out **= POWER
        return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float | None = None, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    cost = COST if cost is None else cost
    z = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        inside = y * (z @ w) < 1
        a = z[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + 2 * cost * a.T @ z[inside], 2 * cost * a.T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = w + (new - w) * 0.7
    return w[:-1], float(w[-1])


def logistic(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt's fit of P(y) = 1 / (1 + exp(-(a s + b))), with his smoothed targets."""
    up, down = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    z, w = np.stack([s, np.ones_like(s)], axis=1), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), z.T @ (target - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def sentence_words(text: bytes) -> list[bytes]:
    """Words at ASCII white space; a line's end is a word of its own."""
    return text.replace(b"\n", b" \0 ").split()


def sentence_starts(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Where sentences and, in longer ones, windows of SENTENCE words begin, given which words end a sentence; and the other way to cut these, in the middle of windows (None: there are none)."""
    n = len(ends)
    first = np.concatenate([[0], np.flatnonzero(ends[:-1]) + 1])
    place = np.arange(n) - np.repeat(first, np.diff(np.concatenate([first, [n]])))
    starts = np.flatnonzero(place % SENTENCE == 0)
    return starts, None if len(starts) == len(first) else np.flatnonzero((place == 0) | (place % SENTENCE == SENTENCE // 2))


def distinct_words(words: np.ndarray, starts: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, word) of each sentence's distinct words, by sentence; words are numbers below ``many``."""
    sentence = np.zeros(len(words), np.int64)
    sentence[starts[1:]] = 1
    return np.divmod(np.unique(np.cumsum(sentence) * many + words), many)


class Model:
    """Shares of words in a sentence's decision, and the way from decisions to probabilities."""

    def __init__(self, kernel: Kernel | None, share: np.ndarray | None, bias: float, scale: tuple[float, float]):
        self.kernel, self.share, self.bias, self.scale = kernel, share, bias, scale
        self.forget()

    def forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.shares, self.ends, self.single = np.zeros(0), np.zeros(0, bool), np.zeros(0, bool)

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("kernel", "share", "bias", "scale")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def word_shares(self, words: list[str]) -> np.ndarray:
        named = [w for w in dict.fromkeys(words) if w]
        values = dict(zip(named, self.kernel(named) @ self.share, strict=True)) if named else {}
        return np.array([values.get(w, 0.0) for w in words])

    def learn(self, words: list[bytes]) -> None:
        text = [w.decode() for w in words]
        base = len(self.place)
        self.place.update(zip(words, range(base, base + len(words)), strict=True))
        self.shares = np.concatenate([self.shares, self.word_shares([plain(w) for w in text])])
        self.ends = np.concatenate([self.ends, [w[-1] in ".!?\0" for w in text]]).astype(bool)
        self.single = np.concatenate([self.single, [len(w.strip(_TRIM)) == 1 and w.strip(_TRIM).isalpha() for w in text]]).astype(bool)

    def decisions(self, texts: list[bytes]) -> np.ndarray:
        """Of each text, the decision on its worst sentence."""
        words = [sentence_words(t) for t in texts]
        used = set().union(*words)
        new = used.difference(self.place)
        if len(self.place) + len(new) > WORDS:
            self.forget()
            new = used
        if new:
            self.learn(list(new))
        out = np.full(len(texts), self.bias)
        for i, ws in enumerate(words):
            if ws:
                at = np.fromiter(map(self.place.__getitem__, ws), np.int64, len(ws))
                shares = self.shares[at]
                single = self.single[at]
                if (single[3:] & single[2:-1] & single[1:-2] & single[:-3]).any():
                    shares = shares + self.spelled(ws, single)
                # a word that a sentence repeats n times counts 1 + log(n) times if it speaks for toxicity, else once
                out[i] += max(self.worst(at, shares, starts) for starts in sentence_starts(self.ends[at]) if starts is not None)
        return out

    def worst(self, at: np.ndarray, shares: np.ndarray, starts: np.ndarray) -> float:
        """The highest sum of shares of a sentence's words, given where sentences begin."""
        key = np.cumsum(np.bincount(starts[1:], minlength=len(at))) * len(self.place) + at
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        own = shares[first]
        return np.bincount(key[first] // len(self.place), np.where(own > 0, own * (1 + np.log(n)), own), len(starts)).max()

    def spelled(self, words: list[bytes], single: np.ndarray) -> np.ndarray:
        """Four or more single letters in a row are read as one word; its share goes to the first of them."""
        out = np.zeros(len(words))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        runs = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True) if b - a >= 4]
        joined = [plain("".join(w.decode().strip(_TRIM) for w in words[a:b])) for a, b in runs]
        out[[a for a, _ in runs]] = self.word_shares(joined)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.kernel is None:
            return np.zeros(len(texts))
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.decisions(texts) + b, -30, 30)))


def train(texts: list[bytes], toxic: np.ndarray) -> Model:
    if not toxic.any() or toxic.all():
        return Model(None, None, 0.0, (0.0, 0.0))
    # words as numbers: a row's words are held but once
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in sentence_words(t)], np.int32) for t in texts]
    plains = [plain(w.decode()) for w in number]
    ends = np.array([w[-1] in b".!?\0" for w in number])
    names = {w: i for i, w in enumerate(sorted(set(plains) - {""}), 1)} | {"": 0}
    of = np.array([names[w] for w in plains], np.int32)
    up, down = Counter(), Counter()
    seen, named = set(), list(names)[-1:] + list(names)[:-1]
    for d, y in zip(docs, toxic, strict=True):
        own = np.unique(of[d])
        if (key := own.tobytes()) not in seen:  # copies of a row tell nothing new
            (up if y else down).update(named[i] for i in own.tolist() if i)
        seen.add(key)
    all_ = up + down
    # how far a word's share of toxic rows is beyond chance, in standard deviations, of words mostly found in such rows
    rate = min(0.5, up.total() / max(1, all_.total()))
    far = {w: (up[w] - n * rate) / np.sqrt(n * rate * (1 - rate)) for w, n in all_.items() if up[w] >= 3 and 2 * up[w] > n and len(w) > 2}
    landmarks = sorted(far, key=lambda w: (-far[w], w))[:TOXIC_LANDMARKS]
    landmarks += [w for w, _ in sorted(down.items(), key=lambda x: (-x[1], x[0])) if w not in landmarks][:COMMON_LANDMARKS]
    if not landmarks:  # no word tells the two kinds apart
        return Model(None, None, 0.0, (0.0, 0.0))
    kernel = Kernel(landmarks)
    like = np.zeros((len(names), len(landmarks)), np.float32)
    if len(names) > 1:
        like[1:] = kernel(named[1:])
    rows, owner = [], []
    for i, d in enumerate(docs):
        if len(d):
            starts, _ = sentence_starts(ends[d])
            sentence, at = distinct_words(of[d], starts, len(names))
            first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
            rows.append(np.add.reduceat(like[at], first, axis=0))
            owner += [i] * len(starts)
    if not rows:
        return Model(None, None, 0.0, (0.0, 0.0))
    x, owner = np.concatenate(rows), np.array(owner)
    del rows, like
    values, vectors = np.linalg.eigh(kernel(landmarks))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T  # Nyström
    z = x @ root.astype(np.float32)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    decision = x[:, : min(TOXIC_LANDMARKS, len(far))].sum(1)
    share, bias = np.zeros(len(landmarks)), 0.0
    marked = decision >= 0.5
    for _ in range(ROUNDS):
        worst = np.zeros(len(owner), bool)
        worst[[a + int(np.argmax(decision[a:b])) for a, b in zip(first, [*first[1:], len(owner)], strict=True)]] = True
        # of a toxic row each sentence found toxic so far, and the worst one in any case; of another row the worst one
        used = np.flatnonzero(worst | marked & toxic[owner])
        y = np.where(toxic[owner[used]], 1.0, -1.0)
        beta, bias = svm(z[used].astype(np.float64), y, np.where(y > 0, 1.0 / max(1e-9, (y > 0).mean()), 1.0 / max(1e-9, (y < 0).mean())) / 2)
        share = root @ beta
        decision = x @ share + bias
        marked = decision >= 0
    model = Model(kernel, share, bias, (1.0, 0.0))
    model.scale = logistic(model.decisions(texts), toxic.astype(float))
    return model


def held_out(doc_id):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, sample: int = LABELLED) -> Model:
    """A model from at most ``sample`` labelled rows, none of them held out."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    if not chosen:
        return Model(None, None, 0.0, (0.0, 0.0))
    # at most ``sample`` ids
    ids = F.broadcast(docs.sparkSession.createDataFrame([(r["doc_id"], int(r["toxic"])) for r in chosen], "doc_id long, toxic int"))
    # of rows with one id the least text, whatever order they come in
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic = [], []
        for batch in batches:
            texts += batch.column(1).cast(pa.binary()).to_pylist()
            toxic += batch.column(2).to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, np.array(toxic, np.int64) > 0))], pa.binary())], names=["model"])

    # one task trains on the bounded sample; only the model comes to the driver
    found = rows.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else Model(None, None, 0.0, (0.0, 0.0))


def scored(docs: DataFrame, model: Model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column ``out``."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                found = model.scores([t or b"" for t in part.column(len(names)).cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(j) for j in range(len(names))), pa.array(found)], schema=pa.schema([*(part.schema.field(j) for j in range(len(names))), (out, pa.float64())]))

    from pyspark.sql import types as T

    return docs.select(*names, text_or_empty(text_col).alias(fresh("_text", names))).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    ids = docs.select("doc_id", "text")
    found = scored(ids, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= CUT).cast("int").alias("predicted"))
