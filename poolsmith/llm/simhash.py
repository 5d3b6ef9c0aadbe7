"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; two that differ in few bits differ in very few bits of some segment.
Each fingerprint stands in one table for each segment, and fetches from it what lies in a small Hamming
ball around its own segment (own value, and own value with one set bit cleared: of two values one bit
apart, one is the other with that bit cleared). Complete distances are verified inside a table's bucket,
block by block, and only a spanning forest of each bucket's links is given out: components lose no link
and a group of many near copies gives no square of rows. Copies are one fingerprint from the start.

With ``segments`` * 2 > ``radius`` every link within the radius is found. Beyond some millions of fingerprints,
tables are keyed by several segments together, so that a bucket holds a few fingerprints however many there
are: of ``segments`` of which ``radius`` at most are touched, some ``segments`` - ``radius`` + 1 differ in one
bit at most together. Buckets that are large all the same are dealt out in parts, each of which meets all others.
A wider radius is searched with the recall that the segments give, see ``keep_one``.

Defined results: a null text is empty; texts without a word have fingerprint zero; a null id is never the
component's id unless all are null; repeated rows are separate documents of one component; an empty table
gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import checkpoint, fresh, hot_keys, spread_join, table, text_or_empty
from poolsmith.llm.components import components

SEED = 42
#: Pairs whose distance is worked out at once.
BLOCK = 1 << 21
#: Sets of at most SHORT shingles are searched for like ones exactly; sets of up to LISTED are looked through for them.
SHORT, LISTED = 64, 80


def shingle_hashes(text: bytes, size: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``size`` words (lower-cased A-Z, cut at ASCII white space), repeats included."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    return np.frombuffer(b"".join([xxh64_digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)]), ">u8").astype(np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """64 * lanes bits as ``lanes`` unsigned numbers, of which the first is of the hashes themselves: a bit is 1 if set in over half of them."""
    out = np.zeros(lanes, np.uint64)
    if len(hashes):
        for lane in range(lanes):
            x = hashes
            if lane:  # more bits of the same shingles: the hash is mixed anew (splitmix64)
                x = x + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
                x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
                x = x ^ x >> np.uint64(31)
            counts = np.zeros(64, np.int64)
            for i in range(0, len(x), 1 << 15):
                counts += np.unpackbits(x[i : i + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
            out[lane] = np.packbits(2 * counts > len(x)).view(">u8")[0]
    return out


def cut_set(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, cut to 32 bits."""
    return np.unique(hashes.astype(np.uint32)).view(np.int32)


def fingerprints(docs: DataFrame, size: int, lanes: int = 1, id_col: str = "doc_id", text_col: str = "text", also: tuple[str, ...] = (), sets: bool = False) -> DataFrame:
    """doc_id, also..., f0, f1, ...: one row per row; signed longs with the fingerprint's bits. also: further long columns to keep.

    sets: repeats of a shingle count once, a column ``set`` holds a hash of the whole set, and a column
    ``shingles`` the set itself as in shingle_sets, where it has at most LISTED.
    """
    from xxhash import xxh64_digest

    names = [f"f{i}" for i in range(lanes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = (shingle_hashes(t, size) for t in batch.column(1 + len(also)).cast(pa.binary()).to_pylist())
            listed = []
            if sets:
                found = []
                for x in map(np.unique, hashes):
                    found.append(np.append(fingerprint(x, lanes), np.frombuffer(xxh64_digest(x.tobytes()), np.uint64)))
                    listed.append(cut_set(x) if len(x) <= LISTED else None)
            else:
                found = [fingerprint(x, lanes) for x in hashes]
            bits = np.array(found, np.uint64).reshape(-1, lanes + sets).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(1 + len(also))), *(pa.array(bits[:, i]) for i in range(lanes + sets)), *[pa.array(listed, pa.list_(pa.int32()))] * sets], names=["doc_id", *also, *names, *["set", "shingles"] * sets])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *also, text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in also), *(f"{n} long" for n in names), *["set long", "shingles array<int>"] * sets]))


def segment_places(bits: int, segments: int, width: int | None = None, together: int = 1) -> list[np.ndarray]:
    """The bits of each table's key: all bits dealt evenly to segments, or the first ones in segments of the given width; ``together`` segments make up a key."""
    cuts = [i * width if width else bits * i // segments for i in range(segments + 1)]
    parts = [np.arange(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [np.concatenate(x) for x in combinations(parts, together)]


def tables_for(fingerprints: int, radius: int) -> tuple[int, int]:
    """(segments, of which together a key): the fewest tables whose buckets hold about 16 of so many fingerprints of 64 bits."""
    together = 1
    segments = radius // 2 + 1
    while 64 * together / segments < min(48, np.log2(max(2, fingerprints)) - 4):
        together += 1
        segments = radius + together - 1
    return segments, together


def probes(fps: np.ndarray, places: list[np.ndarray], balls: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, own) of each table's own value and, with balls, of the values with one bit cleared."""
    keys, rows, own = [], [], []
    every = np.arange(len(fps))
    wide = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(len(fps), -1), axis=1)
    for s, bits in enumerate(places):
        value = np.zeros(len(fps), np.int64)
        for b in bits:
            value = value << 1 | wide[:, b]
        value |= s << 48
        keys.append(value), rows.append(every), own.append(np.ones(len(fps), bool))
        for i, b in enumerate(bits if balls else []):
            has = np.flatnonzero(wide[:, b])
            keys.append(value[has] ^ (1 << (len(bits) - 1 - i))), rows.append(has), own.append(np.zeros(len(has), bool))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0..n-1's component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low), np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def near_pairs(key: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, own row, distance) of all pairs within the radius in each bucket, by blocks; rows are sorted by key.

    own rows stand in the bucket; each row is held against them all.
    """
    bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    stand = np.concatenate([[0], np.cumsum(own)])
    low, high = np.repeat(stand[bounds[:-1]], np.diff(bounds)), np.repeat(stand[bounds[1:]], np.diff(bounds))
    table_ = np.flatnonzero(own)
    count = high - low
    starts = np.concatenate([[0], np.cumsum(count)])
    row = 0
    while row < len(key):
        # whole rows up to BLOCK pairs; a row of more is a block of its own
        to = max(row + 1, int(np.searchsorted(starts, starts[row] + BLOCK, "right")) - 1)
        total = int(starts[to] - starts[row])
        if total:
            left = np.repeat(np.arange(row, to), count[row:to])
            right = table_[np.arange(total) - np.repeat(starts[row:to] - starts[row], count[row:to]) + np.repeat(low[row:to], count[row:to])]
            distance = np.zeros(total, np.int16)
            for lane in range(fps.shape[1]):
                distance += np.bitwise_count(fps[left, lane] ^ fps[right, lane])
            near = np.flatnonzero((distance <= radius) & (left != right))
            if len(near):
                yield left[near], right[near], distance[near]
        row = to


def bucket_links(key: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (row, root) of a spanning forest of the links within the radius in each bucket."""
    root = np.arange(len(key))
    for left, right, _ in near_pairs(key, fps, own, radius):
        x, y = root[left], root[right]
        ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        root[ids] = ids[forest(at[: len(x)], at[len(x) :], len(ids))]
        root = root[root]
    moved = np.flatnonzero(root != np.arange(len(key)))
    return moved, root[moved]


def shortest_forest(a: np.ndarray, b: np.ndarray, distance: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs make up a minimum spanning forest (Boruvka's rounds, nearest pairs first)."""
    order = np.argsort(distance, kind="stable")
    a, b, root, taken = a[order], b[order], np.arange(n), []
    left = np.arange(len(a))
    while True:
        left = left[root[a[left]] != root[b[left]]]
        if not len(left):
            return order[np.unique(np.concatenate(taken))] if taken else order[:0]
        # each tree takes its first pair; ties in distance go by place, so no ring arises
        ends = np.concatenate([root[a[left]], root[b[left]]])
        _, first = np.unique(ends[np.argsort(np.concatenate([left, left]), kind="stable")], return_index=True)
        pick = np.unique(np.sort(np.concatenate([left, left]), kind="stable")[first])
        taken.append(pick)
        root = forest(root[a[pick]], root[b[pick]], n)[root]


def bucket_candidates(key: np.ndarray, fps: np.ndarray, own: np.ndarray, radius: int, spare: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of pairs to verify first, and whether others of their bucket are left: all pairs within the radius in buckets that have at most ``spare`` of them a row, else a minimum spanning forest of them by distance."""
    a, b, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int16)]
    bucket = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    size = np.bincount(bucket)
    found = np.zeros(len(size), np.int64)
    for left, right, distance in near_pairs(key, fps, own, radius):
        found += np.bincount(bucket[left], minlength=len(size))
        a, b, d = [np.concatenate([*a, left])], [np.concatenate([*b, right])], [np.concatenate([*d, distance])]
        many = found[bucket[a[0]]] > spare * size[bucket[a[0]]]
        if many.any():  # what has been found so far gives way to its forest
            at = np.flatnonzero(many)
            kept = np.concatenate([np.flatnonzero(~many), at[shortest_forest(a[0][at], b[0][at], d[0][at], len(key))]])
            a, b, d = [a[0][kept]], [b[0][kept]], [d[0][kept]]
    return a[0], b[0], found[bucket[a[0]]] > spare * size[bucket[a[0]]]


def set_links(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of links that connect what all pairs of sets as alike as ``similarity`` connect; rows of one root are connected already."""
    n, sizes = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    tree = np.unique(root, return_inverse=True)[1]
    left, right = [], []
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    # postings of each shingle: the rows that hold it
    rows = np.repeat(np.arange(n), sizes)[np.argsort(code, kind="stable")]
    count = np.bincount(code, minlength=len(values))
    starts, ends = np.cumsum(count) - count, np.cumsum(sizes)
    for i in range(n):
        if (tree == tree[0]).all():
            break
        own = code[ends[i] - sizes[i] : ends[i]]
        own = own[count[own] > 1]
        many = count[own]
        at = np.arange(many.sum()) + np.repeat(starts[own] - np.cumsum(many) + many, many)
        common = np.bincount(rows[at], minlength=n)
        hits = np.flatnonzero((tree != tree[i]) & (common >= similarity * (sizes[i] + sizes - common)))
        if len(hits):
            others, first = np.unique(tree[hits], return_index=True)
            left.append(np.full(len(others), i)), right.append(hits[first])
            tree[np.isin(tree, others)] = tree[i]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def verify_buckets(members: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect what all pairs alike in a bucket connect. members: key, id, root, shingles; no pair is given out but a link."""

    def links(ids, root, sets):
        a, b = set_links(sets, np.array(root), similarity)
        ids = np.array(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Buckets arrive whole, one after the other."""
        last, ids, root, sets = None, [], [], []
        for batch in batches:
            keys, all_ids, all_roots = (batch.column(i).to_pylist() for i in range(3))
            values, places = batch.column(3).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(3).value_lengths().to_numpy())])
            for i, k in enumerate(keys):
                if k != last:
                    if len(ids) > 1:
                        yield links(ids, root, sets)
                    last, ids, root, sets = k, [], [], []
                ids.append(all_ids[i]), root.append(all_roots[i]), sets.append(values[places[i] : places[i + 1]])
        if len(ids) > 1:
            yield links(ids, root, sets)

    return members.select("key", "id", "root", "shingles").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


#: At most so many ids or buckets are sent to every task; more are joined by a shuffle.
SENT = 1 << 20
#: A bucket in which more fingerprints stand is dealt out in parts of so many. Each part gives a forest of links, so that parts are for buckets that one task can't compare in minutes.
STANDING = 1 << 16


def search_buckets(fps: DataFrame, radius: int, places: list[np.ndarray], pairs_of) -> DataFrame:
    """a, b, more: ids of the pairs that ``pairs_of`` (bucket_links or bucket_candidates) gives in each table's buckets. fps: id, f0, f1, ..., distinct.

    more: the bucket, where pairs_of says that other pairs of it are left, else -1.
    """
    names = fps.columns[1:]
    lanes = len(names)

    def dealt(balls: bool) -> DataFrame:
        def deal(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                bits = np.stack([batch.column(1 + i).to_numpy().view(np.uint64) for i in range(lanes)], axis=1)
                step = max(1, 2000 * 64 // sum(map(len, places)))
                for i in range(0, len(bits), step):
                    part = bits[i : i + step]
                    key, row, own = probes(part, places, balls)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(ids[i : i + step][row]), *(pa.array(part[row, j].view(np.int64)) for j in range(lanes))], names=["key", "own", "id", *names])

        return fps.mapInArrow(deal, ", ".join(["key long", "own boolean", "id long", *(f"{n} long" for n in names)]))

    def found(pieces):
        key, own, ids, bits = (np.concatenate(x) for x in zip(*pieces, strict=True))
        a, b, *more = pairs_of(key, bits, own, radius)
        more = np.where(more[0], key[a], -1) if more else np.full(len(a), -1)
        pairs = np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]), more], axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, i]) for i in range(3)], names=["a", "b", "more"])

    def search(batches):
        """Buckets arrive whole, one after the other: the last one of a batch waits for what follows. Parts of a bucket are buckets of their own here."""
        kept, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            now = key, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), np.stack([batch.column(4 + j).to_numpy().view(np.uint64) for j in range(lanes)], axis=1)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            begin = 0
            if last is not None and (key[0], part[0]) != last:
                edges = np.concatenate([[0], edges])
            if len(edges):
                # parts of one key are taken one by one; whole keys together, up to the last one
                cuts = [e for e in edges if e == edges[-1] or part[max(0, e - 1)] or part[min(e, len(part) - 1)]]
                for end in cuts:
                    kept.append(tuple(x[begin:end] for x in now))
                    if sum(len(x[0]) for x in kept):
                        yield found(kept)
                    kept, begin = [], end
            kept.append(tuple(x[begin:] for x in now))
            last = (key[-1], part[-1])
        if kept:
            yield found(kept)

    rows = dealt(True)
    crowded = checkpoint(dealt(False).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > STANDING).select("key", F.ceil(F.col("n") / F.lit(STANDING)).cast("int").alias("parts")))
    if crowded.isEmpty():
        rows = rows.withColumn("part", F.lit(0))
    else:  # each row goes to all parts of its bucket, and stands in one of them
        if crowded.count() <= SENT:
            crowded = F.broadcast(crowded)
        rows = rows.join(crowded, "key", "left")
        rows = rows.withColumn("home", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))).withColumn("part", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.col("parts")))))
        rows = rows.withColumn("own", F.col("own") & (F.col("parts").isNull() | (F.col("part") == F.col("home") + 1)))
    return rows.select("key", "part", "own", "id", *names).repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(search, "a long, b long, more long")


def near_duplicates(docs: DataFrame, size: int = 4, lanes: int = 1, radius: int = 4, tables: tuple[int, int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, f0.., component_id (the smallest doc_id reachable), n_texts: fingerprints in the component, one row per row.

    tables: segments and how many of them together are a key; by the number of fingerprints where none are given.
    """
    found = checkpoint(fingerprints(docs, size, lanes, id_col, text_col))
    names = [f"f{i}" for i in range(lanes)]
    # a fingerprint of one number is its own id
    distinct = found.groupBy(*names).agg(F.min("doc_id").alias("low"))
    distinct = checkpoint(distinct.withColumn("id", F.col("f0") if lanes == 1 else F.monotonically_increasing_id()))
    segments, together = tables or tables_for(distinct.count(), radius)
    places = segment_places(64 * lanes, segments, together=together)
    roots = components(search_buckets(distinct.select("id", *names), radius, places, bucket_links))
    tops = checkpoint(distinct.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    groups = checkpoint(tops.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("n_texts")))
    placed = checkpoint(spread_join(tops, groups, ["root"], hot=hot_keys(tops, ["root"])).select(*names, "component_id", "n_texts"))
    return spread_join(found, placed, names, hot=hot_keys(found, names)).select("doc_id", *names, "component_id", "n_texts")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """text_hash, shingles: the distinct hashes, cut to 32 bits, of docs (text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [cut_set(shingle_hashes(t, size)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["text_hash", "shingles"])

    return docs.mapInArrow(run, "text_hash long, shingles array<int>")


def verify_rest(candidates: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: links between texts of different roots, of buckets in which only a forest was verified."""
    crowded = candidates.where("more >= 0")
    members = crowded.select(F.col("more").alias("key"), F.col("a").alias("id")).union(crowded.select("more", "b")).distinct()
    members = checkpoint(members.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id")))
    open_ = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return checkpoint(verify_buckets(members.join(open_, "key", "left_semi").join(sets.withColumnRenamed("text_hash", "id"), "id"), similarity))


def short_links(classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: links that connect what all pairs alike connect, of which one has at most SHORT shingles. classes: id, shingles.

    Two sets of a similarity share one of the first n - ceil(similarity * n) + 1 shingles of either, in any
    order that both follow (prefix filter). The rarest come first; shingles of one set take a place only.
    """
    assert LISTED * similarity >= SHORT
    short = classes.where(F.col("shingles").isNotNull()).select("id", "shingles")
    tokens = short.select("id", F.explode("shingles").alias("t"))
    shared = tokens.groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    ordered = tokens.join(shared, "t").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "t"))).alias("ts")).join(short, "id")
    n = F.size("shingles")
    # hair's breadth: 0.8 * 15 must not count as above 12
    first = n - F.ceil(F.lit(similarity) * n - 1e-9) + 1 - (n - F.size("ts"))
    keyed = ordered.withColumn("first", first.cast("int")).where("first > 0").select(F.explode(F.expr("slice(ts, 1, first)")).alias("x"), "id", "shingles")
    members = keyed.select(F.col("x.t").cast("long").alias("key"), "id", F.col("id").alias("root"), "shingles")
    return checkpoint(verify_buckets(members, similarity).distinct())


def keep_one(docs: DataFrame, similarity: float = 0.8, size: int = 5, lanes: int = 4, radius: int = 52, segments: int = 8, width: int = 14) -> DataFrame:
    """docs with one row of each group of near-duplicates, the one with the smallest id; all columns stay.

    Two texts are alike when the Jaccard similarity of their sets of word runs is ``similarity`` or more.
    Pairs of which one has at most SHORT distinct word runs are all found, see short_links. Of longer ones,
    candidates are fingerprints of 64 * ``lanes`` bits within ``radius``, of which one of ``segments``
    segments differs in one bit at most; each candidate pair is verified on the sets. At similarity 0.8 a
    bit differs with probability 0.15; then 96 of 100 pairs share a segment, and 99 are within the radius.
    In a bucket with more pairs than four a row, those of a minimum spanning forest by distance are
    verified first: with nearest pairs first, a group of many copies is mostly connected by as many pairs as
    copies. Where it is not, and rows of the bucket are still in several groups, all pairs between those groups
    are verified in the bucket's task, which gives out only the links that join groups.
    """
    names = [f"f{i}" for i in range(lanes)]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    prints = checkpoint(fingerprints(keyed, size, lanes, also=("text_hash",), sets=True))
    # texts of one set of shingles are one class; of equal fingerprints with different sets, each class is verified
    classes = checkpoint(prints.groupBy("set", *names).agg(F.min("text_hash").alias("id"), F.first("shingles").alias("shingles")))
    short = short_links(classes, similarity)
    long = classes.where(F.col("shingles").isNull() | (F.size("shingles") > SHORT))
    candidates = checkpoint(search_buckets(long.select("id", *names), radius, segment_places(64 * lanes, segments, width), bucket_candidates))
    pairs = checkpoint(candidates.select("a", "b").distinct())
    needed = checkpoint(pairs.select(F.col("a").alias("text_hash")).union(pairs.select("b")).distinct())
    if needed.count() <= SENT:
        needed = F.broadcast(needed)
    sets = checkpoint(shingle_sets(keyed.select("text_hash", "text").join(needed, "text_hash", "left_semi"), size).dropDuplicates(["text_hash"]))
    side = lambda x: sets.select(F.col("text_hash").alias(x), F.col("shingles").alias(f"s{x}"))
    common = F.size(F.array_intersect("sa", "sb"))
    alike = pairs.join(side("a"), "a").join(side("b"), "b").where(common >= F.lit(similarity) * (F.size("sa") + F.size("sb") - common)).select("a", "b")
    alike = checkpoint(alike.union(short))
    roots = components(alike)
    rest = verify_rest(candidates, roots, sets, similarity)
    if not rest.isEmpty():
        roots = components(alike.union(rest))
    classed = prints.drop("shingles")
    placed = spread_join(classed, classes.drop("shingles"), ["set", *names], hot=hot_keys(classed, ["set", *names])).join(roots.withColumnRenamed("node", "id"), "id", "left").select("doc_id", "text_hash", F.coalesce("root", "id").alias("root"))
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"))
    key, kept_id, kept_hash = (fresh(n, docs.columns) for n in ("_hash", "_kept_id", "_kept_hash"))
    kept = checkpoint(best.select(F.col("best.doc_id").alias(kept_id), F.col("best.text_hash").alias(kept_hash)))
    hashed = docs.withColumn(key, F.xxhash64(text_or_empty()))
    left = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept[kept_id]) & (hashed[key] == kept[kept_hash]), "left_semi")
    if not prints.groupBy("doc_id", "text_hash").count().where("count > 1").isEmpty():
        left = left.dropDuplicates(["doc_id", key])
    return left.drop(key)


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
