"""Packing along a space-filling curve.

Each document's token ids become a hashed vector, projected to four dimensions; documents are sorted by the
Hilbert key of the quantised point and laid end to end in that order, and the line of ids is cut at every
4096th id. The rest after the last cut is cut into powers of two, which need no padding: no sequence is
padded. Token ids are written once to a shared table; only (key, row, length) is sorted by range, and a
join by the unique row number brings offsets to the ids, so that copies, which share a key, never meet in
one task: ties in key are split by row number.

Defined results: a null text is empty; each document ends with ``end_id``, so an empty one has one token; a
null id stays null; repeated rows are separate documents; an empty table gives an empty result; columns
other than id and text are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsmith.llm.common import checkpoint, shared_table, table, text_or_empty

LENGTH, END_ID = 4096, 2
DIMS, BITS, BUCKETS = 4, 15, 4096
#: A worker forgets the ids of words when it holds this many.
WORDS = 900_000
#: Words of these characters alone are cut like the tokenizer does before it merges; composing and special tokens can't matter there.
PLAIN = re.compile("[!-;=-~À-ÖØ-öø-ÿ]+")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

#: No byte of any text; stands for the mark that ends a word.
END_OF_WORD = b"\xff"

FORMS = [struct.Struct(f"<{n}H").pack for n in range(32)]

_encoders: dict = {}


def merges(path: str):
    """The tokenizer's merges as ranks of byte strings, for one word at a time.

    Merging any two neighbours that make up a token, lowest id first, is the same as following the list of
    merges, as ids go by that list and each token by itself comes out of its own merge (tests check that).
    """
    from tiktoken._tiktoken import CoreBPE
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path) as f:
        model = json.load(f)["model"]
    assert model["end_of_word_suffix"] == "</w>"
    signs = sorted(ByteLevel.alphabet(), key=ord)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = dict(zip((chr(b) for b in plain), plain, strict=True))
    of |= dict(zip([c for c in signs if c not in of], [b for b in range(256) if b not in plain], strict=True))
    ranks = {}
    for token, i in model["vocab"].items():
        ended = token.endswith("</w>")
        raw = bytes(of[c] for c in token.removesuffix("</w>")) if set(token.removesuffix("</w>")) <= of.keys() else None
        if raw and END_OF_WORD not in raw:
            ranks[raw + END_OF_WORD * ended] = i
    ranks[END_OF_WORD] = model["vocab"]["\u00ff"]
    return CoreBPE(ranks, {}, r"\S+")


class Words(dict):
    """Ids of words as bytes; a word that isn't there yet is encoded and remembered."""

    def __init__(self, tokenizer, merges):
        self.tokenizer, self.piece = tokenizer, merges.encode_single_piece

    def __missing__(self, w: bytes) -> bytes:
        if w.isalpha():  # letters of ASCII alone
            ids = self.piece(w.lower() + END_OF_WORD)
        elif PLAIN.fullmatch(s := w.decode()):
            ids = [i for x in PIECE.findall(s.lower()) for i in self.piece(x.encode() + END_OF_WORD)]
        else:
            ids = self.tokenizer.encode(s, add_special_tokens=False).ids
        out = self[w] = FORMS[len(ids)](*ids) if len(ids) < len(FORMS) else np.array(ids, "<u2").tobytes()
        return out


class WordEncoder:
    """Ids of whole texts, encoded by the tokenizer word by word and remembered.

    The tokenizer never joins anything across white space, so a text's ids are those of its words;
    words are cut at ASCII white space only, and whatever else is white space the tokenizer cuts itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Words(self.tokenizer, merges(path))
        assert self.tokenizer.get_vocab_size() <= 2**16
        buckets = np.random.default_rng(7).standard_normal((BUCKETS, DIMS)).astype(np.float32)
        ids = np.arange(2**16, dtype=np.uint64)
        self.projected = np.ascontiguousarray(buckets[(ids * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % BUCKETS].T)

    def encode(self, texts: list[bytes], end_id: int) -> list[bytes]:
        """Of each text, little-endian unsigned 16-bit ids."""
        if len(self.known) > WORDS:
            self.known.clear()
        end, get = struct.pack("<H", end_id), self.known.__getitem__
        return [b"".join(map(get, t.split())) + end for t in texts]

    def points(self, ids: list[bytes]) -> np.ndarray:
        """Each text's mean of its ids' projections, on the unit sphere."""
        lengths = np.array([len(x) // 2 for x in ids], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        every = np.frombuffer(b"".join(ids), "<u2")
        means = np.stack([np.add.reduceat(column[every], starts) for column in self.projected], axis=1) / lengths[:, None]
        return means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-9)


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions along the Hilbert curve of points in [-1, 1] ** dims (Skilling's transform)."""
    n = points.shape[1]
    x = [np.clip((points[:, i] + 1) / 2 * 2**bits, 0, 2**bits - 1).astype(np.int64) for i in range(n)]
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            set_, t = (x[i] & q) != 0, (x[0] ^ x[i]) & low
            first = np.where(set_, x[0] ^ low, x[0] ^ t)
            x[i] = np.where(set_, x[i], x[i] ^ t)
            x[0] = first
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        t = np.where(x[n - 1] & (1 << b), t ^ ((1 << b) - 1), t)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | ((x[i] ^ t) >> b & 1)
    return key


def tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """doc_id, row (unique), key (on the curve), n, ids; written to a shared table."""

    def run(batches):
        coder = encoder(tokenizer)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = coder.encode(part.column(2).cast(pa.binary()).to_pylist(), end_id)
                n = np.array([len(x) // 2 for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(hilbert_keys(coder.points(ids))), pa.array(n), pa.array(ids, pa.binary())], names=["doc_id", "row", "key", "n", "ids"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    return shared_table(base.mapInArrow(run, "doc_id long, row long, key long, n long, ids binary"), "tokens")


def offsets(found: DataFrame) -> tuple[DataFrame, int]:
    """row, at: where each document begins on the line of all ids; and the line's length.

    One sum for each partition comes to the driver.
    """
    order = found.select("key", "row", "n").repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    order = checkpoint(order.withColumn("part", F.spark_partition_id()))
    sums, total, before = order.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect(), 0, []
    for r in sums:
        before.append((r["part"], total))
        total += r["n"]
    starts = order.sparkSession.createDataFrame(before, "part int, before long")
    running = F.sum("n").over(Window.partitionBy("part").orderBy("key", "row")) - F.col("n")
    # one row for each partition: bounded by their number
    return order.withColumn("running", running).join(F.broadcast(starts), "part").select("row", (F.col("before") + F.col("running")).alias("at")), total


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (unsigned 16-bit)."""
    found = tokens(docs, tokenizer, id_col, text_col)
    at, total = offsets(found)
    full, rest = divmod(total, length)
    ends = []  # of the sequences after the full ones, which are powers of two
    for b in range(length.bit_length() - 1, -1, -1):
        if rest >> b & 1:
            ends.append((ends[-1] if ends else full * length) + (1 << b))

    def sequence(g: int) -> tuple[int, int, int]:
        """Number, beginning and end of the sequence that holds place g."""
        if g < full * length:
            return g // length, g // length * length, (g // length + 1) * length
        i = next(i for i, e in enumerate(ends) if g < e)
        return full + i, ends[i - 1] if i else full * length, ends[i]

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, g, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, start = np.frombuffer(ids, "<u2"), 0
                while start < len(ids):
                    number, begin, end = sequence(g + start)
                    piece = ids[start : start + end - g - start]
                    out.append((doc_id, start, len(piece), zlib.crc32(piece.astype("<u4").tobytes()), len(ids), number, g + start - begin, piece.tobytes()))
                    start += len(piece)
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.binary())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    placed = found.select("doc_id", "row", "ids").join(at, "row").select("doc_id", "at", "ids")
    return placed.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), default_tokenizer()).drop("ids")
