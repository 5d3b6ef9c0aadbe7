import hashlib
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from poolsmith.llm import exact_dedup, simhash
from poolsmith.llm.components import components


def groups_of(n, pairs):
    top = list(range(n))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in pairs:
        top[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def test_exact_against_sql(same):
    same(exact_dedup.query, exact_dedup.SQL)


@pytest.mark.parametrize("capacity", [1, 3, 1000])
def test_collisions_and_splits(spark, capacity):
    """A poor hash and no digest: chains hold many texts, which their bytes tell apart."""
    r = random.Random(1)
    rows = [(i, r.choice("abcdefgh") * r.randrange(6)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = exact_dedup.exact_dedup(df, capacity=capacity, hash_of=lambda c: F.pmod(F.char_length(c), F.lit(4)).cast("long") * F.lit(2**61), digest_of=lambda c: F.lit("")).collect()
    for f in found:
        text = dict(rows)[f["doc_id"]]
        equal = [i for i, t in rows if t == text]
        assert (f["keep_id"], f["group_size"], f["kept"]) == (max(equal), len(equal), f["doc_id"] == max(equal))


def test_directory_doubles(spark):
    hashes = [i << 54 for i in range(-512, 512)] + [5, 6, 7, 5 << 40]
    df = spark.createDataFrame([(h,) for h in hashes], "h long")
    depth, slots = exact_dedup.directory(df, 2)
    full = [(h % 2**64) >> (64 - depth) for h in hashes]
    counts = np.bincount([slots[s] for s in full])
    # what lies close together stays in one bucket at the deepest level
    assert sorted(counts)[-2:] == [2, 5] and depth == exact_dedup.DEEPEST
    assert exact_dedup.directory(df, 10**6) == (0, [0])


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    want = groups_of(400, pairs)
    found = components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in found} == {x: want[x] for p in pairs for x in p if p[0] != p[1]}


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def test_simhash_against_brute_force(spark):
    r = random.Random(3)
    docs = []
    for _ in range(40):
        words = [r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(r.choice([0, 1, 3, 9, 200]))]
        docs.append(" ".join(words))
        for _ in range(5):
            edited = list(words)
            if edited:
                edited[r.randrange(len(edited))] = "Zz"
            docs.append("\n".join(edited))
    prints = [brute_print(t) for t in docs]
    want = groups_of(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {f["doc_id"]: (f["f0"] % 2**64, f["component_id"]) for f in found} == {i: (p, w) for i, (p, w) in enumerate(zip(prints, want, strict=True))}
    assert len(set(want)) < len(docs) - 20


def test_no_link_is_lost():
    """Random fingerprints around centres, all pairs as the measure; links stay far below the square of a group."""
    r = random.Random(4)
    prints = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(400):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randrange(6))))
    fps = np.array(sorted(prints), np.uint64)
    key, row, own = simhash.probes(fps[:, None], simhash.segment_places(64, 3))
    order = np.argsort(key, kind="stable")
    for block in (simhash.BLOCK, 64):
        simhash.BLOCK, kept = block, simhash.BLOCK
        a, b = simhash.bucket_links(key[order], fps[row[order]][:, None], own[order], 4)
        simhash.BLOCK = kept
        got = groups_of(len(fps), zip(row[order][a].tolist(), row[order][b].tolist(), strict=True))
        far = np.bitwise_count(fps[:, None] ^ fps[None])
        assert got == groups_of(len(fps), zip(*(x.tolist() for x in np.nonzero(far <= 4)), strict=True))
        assert len(a) < 45 * len(fps)


@pytest.mark.parametrize("segments, together", [(3, 1), (5, 2), (6, 3), (7, 4)])
def test_every_pair_within_the_radius_shares_a_bucket(segments, together):
    """Whatever four bits differ, some table has the one value within a cleared bit of the other."""
    r = random.Random(14)
    places = simhash.segment_places(64, segments, together=together)
    for _ in range(60):
        x = r.getrandbits(64)
        y = x ^ sum(1 << b for b in r.sample(range(64), r.choice([1, 3, 4, 4])))
        key, row, own = simhash.probes(np.array([[x], [y]], np.uint64), places)
        stand = {(k, i) for k, i, o in zip(key.tolist(), row.tolist(), own.tolist(), strict=True) if o}
        assert any((k, 1 - i) in stand for k, i in zip(key.tolist(), row.tolist(), strict=True))


def test_tables_grow_with_the_corpus():
    assert simhash.tables_for(10**6, 4) == (3, 1)
    for n in (10**8, 10**10, 10**12):
        segments, together = simhash.tables_for(n, 4)
        assert together > 1 and segments == together + 3 and n / 2 ** (64 * together / segments) <= 20


@pytest.mark.parametrize("tables, standing", [((5, 2), 4096), ((3, 1), 8)])
def test_tables_and_parts_change_nothing(spark, monkeypatch, tables, standing):
    r = random.Random(15)
    docs = []
    for _ in range(25):
        words = [r.choice("abcdefghij") * r.randrange(1, 4) for _ in range(60)]
        for _ in range(r.randrange(1, 14)):
            edited = list(words)
            edited[r.randrange(60)] = "zz"
            docs.append(" ".join(edited))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    prints = [brute_print(t) for t in docs]
    want = groups_of(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    monkeypatch.setattr(simhash, "STANDING", standing)
    found = simhash.near_duplicates(df, tables=tables).collect()
    assert {f["doc_id"]: f["component_id"] for f in found} == dict(enumerate(want))


def test_shortest_forest():
    r = np.random.default_rng(5)
    a, b, d = r.integers(0, 50, 400), r.integers(50, 100, 400), r.integers(0, 9, 400)
    kept = simhash.shortest_forest(a, b, d, 100)
    for limit in range(9):  # at each distance the forest connects what all pairs connect
        near = d <= limit
        assert groups_of(100, zip(a[near], b[near], strict=True)) == groups_of(100, zip(a[kept][near[kept]], b[kept][near[kept]], strict=True))
    assert len(kept) <= 99


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    docs, same = [], []
    for g in range(30):
        words = [word() for _ in range(150)]
        copies = [words]
        for _ in range(g % 4):
            edited = list(words)
            edited[r.randrange(150)] = word()
            copies.append(edited)
        same.append(len(copies))
        docs += [" ".join(c) for c in copies]
    half = docs[0].split()
    docs.append(" ".join(half[:75] + [word() for _ in range(75)]))  # half alike: no copy
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.keep_one(df).collect()}
    firsts = {sum(same[:g]) for g in range(30)} | {len(docs) - 1}
    assert kept == firsts


def test_repeated_lines_make_no_copies(spark):
    """What repeats outweighs the rest in a count of all shingles, not in the sets that decide."""
    r = random.Random(9)
    prose = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    docs = [prose() + " the same line again and again" * 300 for _ in range(6)]
    docs += [docs[0] + " the same line again and again", docs[1].upper()]
    kept = simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert sorted(x["doc_id"] for x in kept) == [0, 1, 2, 3, 4, 5]


def test_recall_at_the_bound():
    """Pairs at a similarity of 0.8 and a little more: shared segment, and within the radius."""
    r = random.Random(7)
    places, hit = simhash.segment_places(256, 8, 14), 0
    for _ in range(200):
        words = [f"w{r.random()}" for _ in range(260)]
        edited = list(words)
        for at in r.sample(range(260), 5):
            edited[at] = f"v{r.random()}"
        x, y = (simhash.shingle_hashes(" ".join(w).encode(), 5) for w in (words, edited))
        assert len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist())) >= 0.8
        fps = np.stack([simhash.fingerprint(h, 4) for h in (x, y)])
        key, row, own = simhash.probes(fps, places)
        order = np.argsort(key, kind="stable")
        hit += len(simhash.bucket_candidates(key[order], fps[row[order]], own[order], 52)[0]) > 0
    assert hit >= 190


def jaccard_groups(docs, similarity=0.8):
    """Groups by brute force over all pairs of sets of five-word runs."""
    sets = [set(simhash.shingle_hashes(t.encode(), 5).astype(np.uint32).tolist()) for t in docs]
    alike = [(a, b) for a in range(len(docs)) for b in range(a) if len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    return groups_of(len(docs), alike), alike


def edited_copies(r, n, words, edits):
    text = [f"w{r.random()}" for _ in range(words)]
    docs = []
    for _ in range(n):
        edited = list(text)
        for at in r.sample(range(words), r.choice(edits)):
            edited[at] = f"v{r.random()}"
        docs.append(" ".join(edited))
    return docs


def test_set_links():
    r = np.random.default_rng(10)
    sets = [np.unique(np.concatenate([r.choice(40, r.integers(0, 30), replace=False), r.integers(1000, 10**6, r.integers(0, 4))])).astype(np.int32) for _ in range(200)]
    known = [(i, i + 1) for i in range(0, 60, 2)]
    alike = [(a, b) for a in range(200) for b in range(a) if len(sets[a]) + len(sets[b]) and len(np.intersect1d(sets[a], sets[b])) >= 0.6 * len(np.union1d(sets[a], sets[b]))]
    a, b = simhash.set_links(sets, np.array(groups_of(200, known)), 0.6)
    assert groups_of(200, known + list(zip(a.tolist(), b.tolist(), strict=True))) == groups_of(200, known + alike) and 0 < len(a) < 200


def test_crowded_groups_at_the_bound_stay_whole(spark):
    """Many copies of one text, pairs of which are near a similarity of 0.8 on both sides of it: as brute force over all pairs."""
    r = random.Random(11)
    docs = edited_copies(r, 300, 204, (3, 4)) + edited_copies(r, 200, 104, (1, 2))
    want, _ = jaccard_groups(docs)
    kept = {x["doc_id"] for x in simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert kept == set(want)


def test_short_texts_by_length(spark):
    """Pairs of a similarity from 0.8 on, the shorter of up to 64 shingles: every one is found."""
    r = random.Random(12)
    docs, pairs = [], 0
    for n in [1, 2, 4, 5, 6, 8, 8, 8, 9, 9, 12, 16, 19, 24, 30, 40, 50, 60, 64, 68] * 8:
        words = [f"w{r.random()}" for _ in range(n)]
        more = words + [f"v{r.random()}" for _ in range(max(0, n - 4) // 4)]  # as many shingles more as are allowed
        edited = list(words)
        if n > 40:
            edited[r.randrange(n)] = f"v{r.random()}"
        docs += [" ".join(words), " ".join(more), " ".join(edited)]
    docs += [f"x{i} y{i} " + "the line that many texts have in common " * (i % 3 + 1) for i in range(200)]
    want, alike = jaccard_groups(docs)
    found = simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert {x["doc_id"] for x in found.collect()} == set(want) and len(alike) > 300


def test_hot_texts_are_split(spark):
    """A text that a third of all rows have, with few buckets' share: several owners, one entry."""
    r = random.Random(8)
    rows = [(i if i % 7 else i - 1, "same" if i % 3 == 0 else f"text {r.randrange(150)}") for i in range(600)] + [(None, "same"), (None, "only null")]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), capacity=20).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(found) == len(rows)
    for f in found:
        ids = by_sha[f["text_sha256"]]
        assert (f["group_size"], f["keep_id"]) == (len(ids), max((i for i in ids if i is not None), default=None))
    kept = [f["text_sha256"] for f in found if f["kept"]]
    assert sorted(kept) == sorted(by_sha)


def test_results_come_from_the_bucket_files(spark, monkeypatch):
    made = {}
    write = exact_dedup.shared_table

    def spy(df, label):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(exact_dedup, "shared_table", spy)
    df = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    found = exact_dedup.exact_dedup(df, capacity=4)
    buckets = {x["bucket"]: x["n"] for x in made["exact-index"].groupBy("bucket").count().withColumnRenamed("count", "n").collect()}
    assert found.count() == 200 and len(buckets) > 8 and max(buckets.values()) <= 4 and sum(buckets.values()) == 50
    # each bucket is one range of keys
    ranges = sorted((x["low"] % 2**64, x["high"] % 2**64, x["bucket"]) for x in made["exact-index"].selectExpr("bucket", "conv(hex(h), 16, 10) AS u", "h").groupBy("bucket").agg(F.min_by("h", F.col("u").cast("decimal(20)")).alias("low"), F.max_by("h", F.col("u").cast("decimal(20)")).alias("high")).collect())
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and [x[2] for x in ranges] == sorted(buckets)
    for f in made["exact-index"].inputFiles():
        os.remove(f.removeprefix("file://"))
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        found.collect()
