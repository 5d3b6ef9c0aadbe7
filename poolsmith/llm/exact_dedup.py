"""Exact duplicates by an extendible-hash index in shared files (native operators only).

Rows are hashed to 64 bits. The directory over a hash's leading bits starts with one slot and doubles while a
bucket holds more than ``capacity`` keys; equal hashes, however many rows have them, are one key and never
force a split. Each row is routed to the bucket that the directory gives for its hash. A bucket's owner task
gets the whole texts of its key range, chains texts of equal hashes by comparing their bytes, and decides each
text's size and keeper; what it finds is the bucket's part of the index file. Every row then looks its entry up
in the file, under its bucket. Nothing else tells which row stays: without the files there is no result.

A hash with more rows than a bucket's share is split over several owners, each of which combines its copies;
the few entries that they give are combined once more. Of such hashes there are at most ``HOT``, so their
entries can be sent to every task for the lookup.

Defined results: a null text counts as empty; a null id sorts below every other id; of rows equal in both
id and text exactly one is kept; an empty table gives an empty result; columns other than id and text are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.llm.common import checkpoint, fresh, shared_table

#: Bits that one look at the counts resolves: at most 2 ** STEP slots come to the driver for each overfull one.
STEP = 10
#: The directory's slots number 2 ** DEEPEST at most; a bucket that is overfull there stays one, and is only longer.
DEEPEST = 16
#: At most so many hashes are split over several owners and their entries sent to every task.
HOT = 1 << 15


def directory(keys: DataFrame, capacity: int) -> tuple[int, list[int]]:
    """(global depth, bucket of each slot) over the leading bits of column ``h``.

    Only counts by prefix come to the driver: at most 2 ** STEP for each bucket that is still overfull.
    """
    depths: dict[tuple[int, int], int] = {}  # (depth, prefix) -> keys, of the leaves

    def slot(depth: int) -> Column:
        return F.shiftrightunsigned(F.col("h"), 64 - depth)

    def place(leaf: dict[int, int], depth: int, prefix: int, bottom: int) -> list[int]:
        """Split the bucket until its halves fit; gives the prefixes that are overfull at the bottom."""
        low, high = prefix << (bottom - depth), (prefix + 1) << (bottom - depth)
        n = sum(v for k, v in leaf.items() if low <= k < high)
        if n <= capacity or depth == DEEPEST:
            depths[depth, prefix] = n
            return []
        if depth == bottom:
            return [prefix]
        return place(leaf, depth + 1, 2 * prefix, bottom) + place(leaf, depth + 1, 2 * prefix + 1, bottom)

    depth, open_ = 0, [0]
    while open_:
        bottom = min(DEEPEST, depth + STEP)
        rows = keys if depth == 0 else keys.where(slot(depth).isin(open_))
        leaf = {r["s"]: r["n"] for r in rows.groupBy(slot(bottom).alias("s")).agg(F.count("*").alias("n")).collect()}
        leaf = {k % 2**bottom: v for k, v in leaf.items()}
        open_, depth = [x for prefix in open_ for x in place(leaf, depth, prefix, bottom)], bottom
    top = max(d for d, _ in depths)
    slots = [0] * 2**top
    for bucket, (d, prefix) in enumerate(sorted(depths, key=lambda k: k[1] << (64 - k[0]))):
        for x in range(prefix << (top - d), (prefix + 1) << (top - d)):
            slots[x] = bucket
    return top, slots


def _entries(rows: DataFrame, *by: str) -> DataFrame:
    """One entry for each text; equal hashes and digests are told apart by the texts' bytes."""
    return rows.groupBy(*by, "bucket", "h", "digest", "text").agg(F.sum("group_size").alias("group_size"), F.max("keep_id").alias("keep_id"))


def _owned(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Entries of routed rows (bucket, h, digest, text, doc_id), made by each bucket's owner, or owners."""
    rows = rows.withColumn("group_size", F.lit(1)).withColumnRenamed("doc_id", "keep_id")
    if hot is None:
        return _entries(rows.repartition("bucket"))
    spread = rows.join(F.broadcast(hot), "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("keep_id"), F.col("owners")) + 1, F.lit(0)).cast("int"))
    owned = _entries(spread.drop("owners").repartition("bucket", "part"), "part")
    return owned.where("part = 0").drop("part").unionByName(_entries(owned.where("part > 0").drop("part")))


def _looked_up(rows: DataFrame, index: DataFrame, key: list[str], hot: DataFrame | None) -> DataFrame:
    """rows (key, doc_id, rid, sha) with what the index says of them; of rows equal in id and text one is kept."""
    repeated = checkpoint(rows.groupBy("doc_id", *key).agg(F.count("*").alias("times"), F.max("rid").alias("last")).where("times > 1").drop("times"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    if hot is None:
        found = rows.join(index, key)
    else:
        few = F.broadcast(hot.select("h"))  # less than HOT of them, and an entry each
        found = rows.join(few, "h", "left_anti").join(index, key).unionByName(rows.join(few, "h", "left_semi").join(F.broadcast(index.join(few, "h", "left_semi")), key))
    if not repeated.isEmpty():
        there = found["doc_id"].eqNullSafe(repeated["doc_id"])
        for k in key:
            there = there & (found[k] == repeated[k])
        found = found.join(repeated, there, "left").select(*(found[c] for c in found.columns), "last")
        kept = kept & (F.col("last").isNull() | (F.col("last") == F.col("rid")))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "bucket", "chain")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1000, hash_of=F.xxhash64, digest_of=None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain (the text's place in its chain, from 0).

    hash_of, digest_of (the SHA-256 where none is given): other functions of a text, for tests.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select("doc_id", "text", hash_of("text").cast("long").alias("h"), F.unhex(F.sha2("text", 256)).alias("sha"))
    base = base.withColumn("digest", F.col("sha") if digest_of is None else digest_of("text").cast("binary"))
    named = ["doc_id", "rid", "h", "sha", *(["digest"] if digest_of else [])]
    rows = shared_table(base.withColumn("rid", F.monotonically_increasing_id()).select(*named), "exact-rows")
    if digest_of is None:
        rows = rows.withColumn("digest", F.col("sha"))

    hashes = shared_table(rows.groupBy("h").agg(F.count("*").alias("n")), "exact-hashes")
    depth, slots = directory(hashes, capacity)
    at = F.lit(1) if depth == 0 else F.shiftrightunsigned("h", 64 - depth) + 1
    # one literal, however many slots: folded into an array when the plan is made
    bucket = F.element_at(F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>"), at.cast("int"))
    share = max(capacity, -(-(hashes.agg(F.sum("n")).first()[0] or 0) // HOT))
    hot = checkpoint(hashes.where(F.col("n") > share).select("h", F.ceil(F.col("n") / F.lit(share)).alias("owners")))
    hot = None if hot.isEmpty() else hot

    key = ["bucket", "h", "digest"]
    owned = _owned(base.select(bucket.alias("bucket"), "h", "digest", "text", "doc_id"), hot)
    chains = owned.groupBy(*key).agg(F.count("*").alias("texts"), F.max(F.struct("group_size", "keep_id")).alias("e"))
    index = shared_table(chains.select(*key, "texts", "e.group_size", "e.keep_id").sortWithinPartitions(*key), "exact-index")
    routed = rows.withColumn("bucket", bucket)
    collided = index.where("texts > 1").select(*key)
    single = index.where("texts = 1").select(*key, "group_size", "keep_id", F.lit(0).alias("chain"))
    if collided.isEmpty():
        return _looked_up(routed, single, key, hot)
    # chains of several texts: rows with such a key look their own bytes up
    collided = checkpoint(collided)
    texts = shared_table(base.withColumn("bucket", bucket).withColumn("rid", F.monotonically_increasing_id()).join(collided, key, "left_semi").select(*key, "text", "doc_id", "rid", "sha"), "exact-chained")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("text")) - 1
    chained = shared_table(_owned(texts.drop("rid", "sha"), hot).withColumn("chain", place), "exact-chains")
    return _looked_up(routed.join(collided, key, "left_anti"), single, key, hot).unionByName(_looked_up(texts, chained, [*key, "text"], None))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay."""
    found = exact_dedup(docs)
    # rows equal in id and text can't be told apart by these: their surplus is dropped by id and digest
    again = checkpoint(found.where("not kept and doc_id <=> keep_id").select("doc_id").distinct())
    sha, kept_id, kept_sha = (fresh(n, docs.columns) for n in ("_sha", "_kept_id", "_kept_sha"))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = found.where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    left = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept[kept_id]) & (keyed[sha] == kept[kept_sha]), "left_semi")
    if not again.isEmpty():
        left = left.dropDuplicates(["doc_id", sha])
    return left.drop(sha)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
