"""Personal data by bootstrapped contextual extraction.

Seeds are what four patterns match (e-mail addresses, IP addresses, payment cards and phone numbers) and
identifiers that stand as the value of a key that names a secret (token = ..., api_key: ...). The words around
each seed, and around each other token that looks like an identifier, are lexical patterns: the two words
before it, the word on each side, and, of a value, its key with the value's shape. A pattern has letters in
each of its words; where a word is missing there is none. Spark scores the graph of patterns and instances in
rounds: a pattern's confidence is the share of its occurrences whose instances are believed, an instance's
belief is its best pattern's confidence, and seeds are always believed, wherever they stand. Patterns of high confidence and support
then mark unseen identifiers, kind "id"; seeds that are secrets are of that kind, too. Edges are aggregated by
pattern and instance before they are joined, so a passage that many documents share is one edge.

Defined results: a null text is empty; a null id stays null; repeated rows are separate documents and count
twice as evidence; an empty table gives an empty result; other columns are ignored (``redact`` keeps them).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from poolsmith.llm.common import checkpoint, fresh, shared_table, table, text_or_empty

KINDS = ["email", "ip", "card", "phone", "id"]
CONFIDENCE, SUPPORT, ROUNDS = 0.8, 3, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Possessive, and from the beginning of a run of digits: what fails there fails from each later digit too
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
#: Runs of signs that identifiers are made of; at least eight from letter or digit to letter or digit, three of them digits, look like one.
_RUN = re.compile("[A-Za-z0-9_:/.-]{8,}+")
_ENDS = "_:/.-"
_DIGITS = str.maketrans("123456789", "000000000")
_WORD = re.compile(r"[^\W_]+")
#: What stands between a key and its value.
_ASSIGNED = re.compile(r"""["'`]?\s*(?:=|:|=>|:=)\s*["'`]?""")
#: Keys that name a secret, or end a name of one (api_key, accessToken), and the least length of its value.
SECRETS = frozenset("token secret password passwd pwd key apikey auth credential bearer".split())
SECRET_SIGNS = 16


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            free = m.end()
            out.append((start, free))
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _RUN.finditer(text):
        if _DIGIT.search(run := m[0]):
            start, end = m.start() + len(run) - len(run.lstrip(_ENDS)), m.end() - len(run) + len(run.rstrip(_ENDS))
            if end - start >= 8 and len(_DIGIT.findall(run)) >= 3:
                out.append((start, end))
    return out


def _hash(*parts: str) -> int:
    x = xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass"))
    return x - 2**64 if x >= 2**63 else x


def shape(value: str) -> str:
    """Hexadecimal numbers with their length; else kinds of signs in their order."""
    if not value.strip("0123456789abcdefABCDEF"):
        return f"hex{len(value)}"
    return re.sub(r"(.)\1+", r"\1", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value))))


class Around:
    """The words of one text, to be looked up by place. A word is a run of letters and digits, however long."""

    def __init__(self, text: str):
        self.text = text
        spans = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def word(self, i: int) -> str:
        """In lower case, digits alike; empty where there is none or it has no letter."""
        if not 0 <= i < len(self.starts):
            return ""
        w = self.text[self.starts[i] : self.ends[i]].lower().translate(_DIGITS)
        return w if any(map(str.isalpha, w)) else ""

    def patterns(self, start: int, end: int) -> tuple[list[int], bool]:
        """Hashes of the lexical patterns around a span, and whether it is the value of a key that names a secret."""
        last = bisect_right(self.ends, start) - 1
        before, after, out, secret = self.word(last), self.word(bisect_left(self.starts, end)), [], False
        if before:
            if further := self.word(last - 1):
                out.append(_hash("L", further, before))
            if after:
                out.append(_hash("B", before, after))
            if _ASSIGNED.fullmatch(self.text, self.ends[last], start):
                out.append(_hash("K", before, shape(self.text[start:end])))
                secret = end - start >= SECRET_SIGNS and before.endswith(tuple(SECRETS))
        return out, secret


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), row_col: str | None = None) -> DataFrame:
    """keep..., row (row_col, or made here), base (spans as text), counts by kind, and around: each seed and candidate with its patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("secret", pa.bool_()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))

        def seen(words: Around, start: int, end: int, base: bool) -> dict:
            named, secret = words.patterns(start, end)
            return {"start": start, "end": end, "seed": base or secret, "secret": secret and not base, "instance": _hash(words.text[start:end].lower()), "patterns": named}

        for batch in batches:
            base, counts, around = [], [], []
            for text in batch.column(len(keep) + 1).to_pylist():
                found = base_spans(text)
                base.append(spans_text(found))
                counts.append([sum(k == i for _, k, _ in found) for i in range(4)])
                others = candidates(text) if _DIGIT.search(text) else []
                words = Around(text) if found or others else None
                spots = [seen(words, a, b, True) for a, _, b in found]
                taken, i = sorted((a, b) for a, _, b in found), 0
                for a, b in others:
                    while i < len(taken) and taken[i][1] <= a:
                        i += 1
                    if i == len(taken) or taken[i][0] >= b:
                        spots.append(seen(words, a, b, False))
                around.append(spots)
            names = [*keep, "row", "base", *(f"n_{k}" for k in KINDS[:4]), "around"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep) + 1)), pa.array(base, pa.string()), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4)), pa.array(around, spot)], names=names)

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = docs.select(*keep, row.alias("row"), text_or_empty(text_col).alias("text"))
    kinds = ", ".join(f"{c} {dict(source.dtypes)[c]}" for c in keep)
    return source.mapInArrow(run, ", ".join(filter(None, [kinds, "row long, base string, "])) + ", ".join(f"n_{k} long" for k in KINDS[:4]) + ", around array<struct<start: long, end: long, seed: boolean, secret: boolean, instance: long, patterns: array<long>>>")


def confident_patterns(scanned: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """pattern, confidence: those that reach both bounds after the rounds."""
    spots = scanned.select(F.explode("around").alias("s")).select("s.seed", "s.instance", F.explode("s.patterns").alias("pattern"))
    edges = checkpoint(spots.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    seeds = checkpoint(edges.where("seed").select("instance", F.lit(1.0).alias("belief")).distinct())
    belief = seeds
    for _ in range(rounds):
        rows = edges.join(belief, "instance", "left").select("pattern", "n", F.coalesce("belief", F.lit(0.0)).alias("score"))
        scored = rows.groupBy("pattern").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("confidence"), F.count_if(F.col("score") >= 0.5).alias("support"))
        scored = checkpoint(scored.where(F.col("support") >= support).select("pattern", "confidence"))
        told = edges.join(scored, "pattern").select("instance", F.col("confidence").alias("belief"))
        belief = checkpoint(told.unionByName(seeds).groupBy("instance").agg(F.max("belief").alias("belief")))
    return scored.where(F.col("confidence") >= confidence)


def find(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), row_col: str | None = None) -> DataFrame:
    """keep..., row, counts, base and spans (kind:start:end, comma-joined, by start and kind), n_found."""
    scanned = shared_table(scan(docs, text_col, keep, row_col), "pii")
    good = confident_patterns(scanned)
    spots = scanned.select("row", F.explode(F.filter("around", lambda s: ~s["seed"])).alias("s")).select("row", "s.start", "s.end", F.explode("s.patterns").alias("pattern"))
    found = spots.join(good.select("pattern"), "pattern").select("row", "start", "end").distinct()
    more = found.groupBy("row").agg(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end")).alias("more"))
    base = F.transform(F.filter(F.split("base", ","), lambda x: x != ""), lambda x: F.struct(F.split(x, ":")[1].cast("long").alias("start"), (F.array_position(F.array(*map(F.lit, KINDS)), F.split(x, ":")[0]) - 1).cast("int").alias("kind"), F.split(x, ":")[2].cast("long").alias("end")))
    secrets = F.transform(F.filter("around", lambda s: s["secret"]), lambda s: F.struct(s["start"].alias("start"), F.lit(4).alias("kind"), s["end"].alias("end")))
    joined = scanned.withColumn("secrets", secrets).drop("around").join(more, "row", "left").withColumn("more", F.concat("secrets", F.coalesce("more", F.expr("cast(array() as array<struct<start: long, kind: int, end: long>>)"))))
    spans = F.array_sort(F.concat(base, "more"))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return joined.select(*keep, "row", *(f"n_{k}" for k in KINDS[:4]), "base", text.alias("spans"), F.size("more").cast("long").alias("n_found"))


def redacted(text: str, spans: str) -> str:
    """Each span, or run of overlapping ones, gives way to its first kind in brackets."""
    out, at = [], 0
    for kind, a, b in (s.split(":") for s in spans.split(",") if s):
        if int(a) >= at:
            out += [text[at : int(a)], f"[{kind.upper()}]"]
        at = max(at, int(b))
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with personal data replaced in the text; all columns stay, a null text stays null. length_col: gets the text's length, where neither is null."""
    names = docs.columns
    row, spans = fresh("_row", names), fresh("_spans", names)
    numbered = shared_table(docs.withColumn(row, F.monotonically_increasing_id()), "pii-docs")
    found = find(numbered, text_col, (), row).where("spans != ''").select(F.col("row").alias(row), F.col("spans").alias(spans))
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [redacted(t, s) if t is not None and s else t for t, s in zip(batch.column(where).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field(where).type) if i == where else batch.column(i) for i in range(len(names))], schema=pa.schema([batch.schema.field(i) for i in range(len(names))]))

    out = numbered.join(found, row, "left").select(*names, spans).mapInArrow(run, docs.schema)
    if length_col in names:
        changed = F.col(length_col).isNotNull() & F.col(text_col).isNotNull()
        out = out.withColumn(length_col, F.when(changed, F.char_length(text_col)).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType)).select(*names)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS[:4]), F.sha2("base", 256).alias("base_sha256"), "spans", "n_found")
