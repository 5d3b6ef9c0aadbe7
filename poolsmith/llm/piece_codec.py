"""Encoding into, and decoding from, scored pieces: an Aho-Corasick automaton drives a one-pass Viterbi.

The automaton over all pieces reads a text once; at each place it gives, along its output links, the pieces
that end there, longest first, and each relaxes the best score of its end. A sign that is no piece costs
more than any piece and is written as its UTF-8 bytes. As no piece goes on past the end of a word, words
are solved each for itself and remembered. This is the best segmentation by the model's scores; a model
whose scores are ranks of merges is segmented by those scores too, not by replaying its merges.

Defined results: a null text is empty, and an empty text has no pieces; a sign U+2581 is read as a space,
as the pieces write one so; a null id stays null; repeated rows are encoded each; an empty table gives an
empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsmith.llm.common import table, text_or_empty

SPACE = "▁"
#: How much more than the worst piece a sign costs that is none.
PENALTY = 10.0
#: A worker forgets words' ids when it holds this many.
WORDS = 600_000

_codecs: dict = {}


class Codec:
    """A model's pieces; ids are below 65536."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        assert n <= 2**16
        if model.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise NotImplementedError("only models that put a space before the text and change nothing else")
        self.byte_ids, self.surfaces, self.scores = [0] * 256, [b""] * n, np.zeros(n)
        self.automaton, self.signs = ahocorasick.Automaton(), {}
        alphabet = set()
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.surfaces[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.scores[i] = model.get_score(i)
                self.surfaces[i] = piece.replace(SPACE, " ").encode()
                self.automaton.add_word(piece, (i, len(piece), float(self.scores[i])))
                if SPACE in piece.lstrip(SPACE):
                    raise NotImplementedError("pieces that go on past a space")
                alphabet.update(piece)
                if len(piece) == 1:
                    self.signs[piece] = i
        self.automaton.make_automaton()
        self.unknown = float(self.scores.min()) - PENALTY
        #: white space that no piece has ends a word too
        self.ends = "".join(c for c in "\n\t\r" if c not in alphabet)
        self.words = re.compile(f" *[^ {self.ends}]+| +" + (f"|[{self.ends}]+" if self.ends else ""))
        self.known: dict[str, bytes] = {}

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose spaces are written as pieces write them; of equal ones, that with the longer last pieces."""
        n = len(text)
        best, back, ids = [0.0] + [float("-inf")] * n, [0] * (n + 1), [-1] * (n + 1)
        matches = self.automaton.iter(text)
        end, match = next(matches, (n, None))
        for place in range(n):
            while end == place:
                i, length, score = match
                total = best[place + 1 - length] + score
                if total > best[place + 1]:
                    best[place + 1], back[place + 1], ids[place + 1] = total, place + 1 - length, i
                end, match = next(matches, (n, None))
            if text[place] not in self.signs and best[place] + self.unknown > best[place + 1]:
                best[place + 1], back[place + 1], ids[place + 1] = best[place] + self.unknown, place, -1
        out = []
        at = n
        while at:
            if ids[at] >= 0:
                out.append(ids[at])
            else:
                out.extend(self.byte_ids[b] for b in reversed(text[back[at] : at].encode()))
            at = back[at]
        return out[::-1]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.words.findall(" " + t.replace(SPACE, " ")) if t else [] for t in texts]
        used = set().union(*words)
        own = dict(zip(used, map(self.known.get, used), strict=True))
        new = [w for w, ids in own.items() if ids is None]
        if len(self.known) + len(new) > WORDS:
            self.known.clear()
        for w in new:
            own[w] = self.known[w] = np.array(self.viterbi(w.replace(" ", SPACE)), "<u2").tobytes()
        get = own.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<u2") for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        """The text; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.surfaces.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_pieces, score (the sum of the pieces' scores), ids_crc32, round_trip: whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = part.column(1).to_pylist()
                found = coder.encode(texts)
                same = [coder.decode(x) == t for x, t in zip(found, texts, strict=True)]
                ints = [x.astype(np.int32) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ints, pa.list_(pa.int32())), pa.array([len(x) for x in found], pa.int64()), pa.array([float(coder.scores[x].sum()) for x in found], pa.float64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ints], pa.int64()), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "score", "ids_crc32", "round_trip"],
                )

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, score double, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of arrays of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model)
        for batch in batches:
            texts = [coder.decode(np.array(x or [], np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), default_model()).drop("ids")
