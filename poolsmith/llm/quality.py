"""Quality rules with an isolation forest over their statistics.

Each document's rule statistics are counted over its whole text. Trees of random splits are grown on the
statistics of labelled rows: as the method has it, each tree on SUBSAMPLE rows of its own, drawn from all of
them. A document that few splits set apart from the others has a short mean path and so a high anomaly score.
The threshold on the score is the one of least cost over all labelled rows. The base rules hold besides: what
fails them is never kept.

Defined results: a null text has no words and fails the base rules; a null id is scored like any other;
repeated rows are scored each and learnt from once, different texts of one id each; without labelled rows of
both kinds nothing is anomalous; an empty table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import shared_table, table, text_or_empty
from poolsmith.sources.shared import spread

TREES, SUBSAMPLE, SEED = 100, 256, 11
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
STATISTICS = ["word_length", "symbols_a_word", "dup_lines", "repeated_words", "upper", "exclaimed", "digits", "distinct_words"]

_SPACE_OR_CONTINUATION = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside runs of ``size`` words that the text holds twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    x = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    # equal runs have equal sums, so where all sums differ nothing repeats
    width = 1
    while width < size:
        x = x[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + x[width:]
        width *= 2
    x.sort()
    if not (x[1:] == x[:-1]).any():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    width = 1
    while width < size:  # exact: a run's number stands for its words
        _, ids = np.unique(ids[:-width] * (len(words) + 1) + ids[width:], return_inverse=True)
        width *= 2
    again = (np.bincount(ids)[ids] > 1).astype(np.int64)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[size : size + n] -= again
    return int((np.cumsum(edges)[: len(words)] > 0).sum())


def count(text: bytes) -> tuple[list[int], list[float]]:
    """(base counts, statistics for the forest)."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, _SPACE_OR_CONTINUATION))
    left = lambda drop: len(text) - len(text.translate(None, drop))
    symbols, dup, repeat = left(b"#*$%&|<>"), len(lines) - len(set(lines)), repeated_words(words)
    letters = max(1, chars)
    return [n, chars, symbols, dup, repeat], [
        chars / max(1, n), symbols / max(1, n), dup / max(1, len(lines)), repeat / max(1, n),
        left(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / letters, left(b"!?") / max(1, n), left(b"0123456789") / letters,
        len(set(words)) / n**0.9 if n else 0.0,
    ]


def path_average(n: int) -> float:
    """Mean path length of a failed search among n (Liu, Ting and Zhou)."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


class Forest:
    """Isolation trees as flat arrays; pickled to the workers."""

    def __init__(self, samples: list[np.ndarray], seed: int = SEED):
        """samples: each tree's rows, as many for each."""
        rng = np.random.default_rng(seed)
        self.size = len(samples[0])
        self.height = max(1, math.ceil(math.log2(max(2, self.size))))
        self.trees = []
        for rows in samples:
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(rows, 0, rng, nodes)
            self.trees.append(tuple(np.array(x) for x in zip(*nodes, strict=True)))

    def _grow(self, rows: np.ndarray, depth: int, rng, nodes: list) -> int:
        at = len(nodes)
        nodes.append((0, 0.0, at, at, depth + path_average(len(rows))))
        low, high = rows.min(0), rows.max(0)
        wide = np.flatnonzero(high > low)
        if depth < self.height and len(rows) > 1 and len(wide):
            f = int(rng.choice(wide))
            cut = rng.uniform(low[f], high[f])
            below = rows[:, f] < cut
            if below.any() and not below.all():
                a = self._grow(rows[below], depth + 1, rng, nodes)
                b = self._grow(rows[~below], depth + 1, rng, nodes)
                nodes[at] = (f, cut, a, b, 0.0)
        return at

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; about 0.5 and less is ordinary."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, cut, low, high, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.height):
                at = np.where(rows[every, feature[at]] < cut[at], low[at], high[at])
            total += path[at]
        return 2.0 ** -(total / len(self.trees) / max(path_average(self.size), 1e-9))


def threshold(scores: np.ndarray, good: np.ndarray, weight: float = 4.0) -> float:
    """The score from which on rows are rejected: the least cost on labelled rows, where a lost good row costs ``weight`` times a kept bad one."""
    if not len(scores) or good.all() or not good.any():
        return math.inf
    order = np.argsort(-scores, kind="stable")
    s, g = scores[order], good[order]
    cost = np.concatenate([[0], np.cumsum(np.where(g, weight, -1.0))])
    ends = np.concatenate([[True], s[1:] < s[:-1], [True]])  # equal scores go together
    best = int(np.argmin(np.where(ends, cost, math.inf)))
    return math.inf if best == 0 else float(s[best - 1] if best == len(s) else (s[best - 1] + s[best]) / 2)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base counts, statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                found = [count(t) for t in part.column(1).cast(pa.binary()).to_pylist()]
                base = np.array([x for x, _ in found], np.int64).reshape(-1, len(BASE))
                more = np.array([x for _, x in found], np.float64).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(base[:, j]) for j in range(len(BASE))), *(pa.array(more[:, j]) for j in range(len(STATISTICS)))], names=["doc_id", *BASE, *STATISTICS])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, ", ".join(["doc_id long", *(f"{x} long" for x in BASE), *(f"{x} double" for x in STATISTICS)]))


def scored(found: DataFrame, forest: Forest | None) -> DataFrame:
    """found with a column anomaly in place of the statistics; 0 without a forest."""
    names = [x for x in found.columns if x not in STATISTICS]
    if forest is None:
        return found.select(*names, F.lit(0.0).alias("anomaly"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([batch.column(len(names) + j).to_numpy() for j in range(len(STATISTICS))], axis=1)
            anomaly = np.concatenate([np.zeros(0), *(forest.scores(rows[i : i + 1000]) for i in range(0, len(rows), 1000))])
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in range(len(names))), pa.array(anomaly)], names=[*names, "anomaly"])

    return found.select(*names, *STATISTICS).mapInArrow(run, ", ".join([*(f"{x} {found.schema[x].dataType.simpleString()}" for x in names), "anomaly double"]))


def samples(known: DataFrame, n: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> list[np.ndarray]:
    """The rows of each tree, drawn from all n rows of ``known``: those with the least of the tree's hashes, whatever order they come in.

    About 1.6 * subsample rows a tree come to the driver.
    """
    size = min(subsample, n)
    share = min(1.0, (size + 10 * math.sqrt(size)) / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(min(2**64 - 1, int(share * 2**64)))
        for batch in batches:
            key = batch.column(0).to_numpy().view(np.uint64)
            drawn = [_tree_hash(key, t) for t in range(trees)]
            at = [np.flatnonzero(h <= limit) for h in drawn]
            tree, rows = np.repeat(np.arange(trees), [len(x) for x in at]), pa.array(np.concatenate(at))
            own = np.concatenate([h[x] for h, x in zip(drawn, at, strict=True)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(own), *(batch.column(1 + j).take(rows) for j in range(len(STATISTICS)))], names=["tree", "h", *STATISTICS])

    keyed = known.select(F.xxhash64("doc_id", *STATISTICS).alias("key"), *STATISTICS)
    schema = ", ".join(["tree long", "h long", *(f"{x} double" for x in STATISTICS)])
    while True:
        got = keyed.mapInArrow(run, schema).toArrow()
        tree, h = got["tree"].to_numpy(), got["h"].to_numpy().view(np.uint64)
        if np.bincount(tree, minlength=trees).min() >= size:
            break
        share = min(1.0, 2 * share)  # a tree has had too few
    rows = np.stack([got[x].to_numpy() for x in STATISTICS], axis=1)
    order = np.lexsort([*rows.T, h, tree])
    ends = np.searchsorted(tree[order], np.arange(trees))
    return [rows[order[a : a + size]] for a in ends]


def _tree_hash(key: np.ndarray, tree: int) -> np.ndarray:
    """A hash of each key, another one for each tree (the last steps of SplitMix64)."""
    z = key + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def least_cost(rows: DataFrame, weight: float = 4.0) -> float:
    """``threshold`` of all rows (anomaly, good): costs are summed within ranges of scores, and a row for each range comes to the driver."""
    kinds = rows.agg(F.min("good").alias("all"), F.max("good").alias("any")).first()
    if kinds["any"] is None or kinds["all"] or not kinds["any"]:
        return math.inf
    names = ["first", "total", "least", "at", "below"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = at = below = None  # below: the score that follows ``at`` in this range
        total, least = 0.0, math.inf
        for batch in batches:
            s, costs = batch.column(0).to_numpy(), total + np.cumsum(batch.column(1).to_numpy())
            if not len(s):
                continue
            first = s[0] if first is None else first
            below = s[0] if at is not None and below is None else below
            i = int(np.argmin(costs))
            if costs[i] < least:
                least, at, below = costs[i], s[i], s[i + 1] if i + 1 < len(s) else None
            total = costs[-1]
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.float64()) for x in (first, total, least, at, below)], names=names)

    # equal scores go together
    costs = rows.groupBy("anomaly").agg(F.sum(F.when(F.col("good"), F.lit(weight)).otherwise(F.lit(-1.0))).alias("cost"))
    ranges = costs.orderBy(F.desc("anomaly")).mapInArrow(run, ", ".join(f"{x} double" for x in names)).collect()
    best, limit, before = 0.0, math.inf, 0.0
    ranges.sort(key=lambda r: -r["first"])
    for r, after in zip(ranges, [*(x["first"] for x in ranges[1:]), None], strict=True):
        if before + r["least"] < best:
            best = before + r["least"]
            below = after if r["below"] is None else r["below"]
            limit = r["at"] if below is None else (r["at"] + below) / 2
        before += r["total"]
    return limit


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    """(forest, threshold) from all labelled rows."""
    return _fit(shared_table(counted(docs), "quality-counts"), labels)


def _fit(found: DataFrame, labels: DataFrame) -> tuple[Forest | None, float]:
    marked = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).alias("good"))
    known = shared_table(found.select("doc_id", *STATISTICS).join(marked, "doc_id").distinct(), "quality-known")
    n = known.count()
    if n < 2:
        return None, math.inf
    known = spread(known)
    forest = Forest(samples(known, n))
    return forest, least_cost(shared_table(scored(known, forest).select("anomaly", "good"), "quality-scores"))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, base counts, base_failed, kept, anomaly: one row per row of docs."""
    counts = shared_table(counted(docs), "quality-counts")
    forest, limit = _fit(counts, labels)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored(counts, forest).select("doc_id", *BASE, failed.alias("base_failed"), (~failed & (F.col("anomaly") < F.lit(limit))).alias("kept"), "anomaly")


def query(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
