"""Steps that ask a model: rendering, versions, retries, and replies as rows. A model is a function that the caller passes in."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsmith.functions import fixed, rubric
from poolsmith.functions.text import stripped
from poolsmith.sources.sinks import fingerprint, prompt_hash

#: What isn't tried again: the reply came, and was malformed.
MALFORMED = (KeyError, ValueError, TypeError)


def attempt(call: Callable, retries: int = 2, wait: float = 1.0, longest: float = 60.0, final: tuple[type[Exception], ...] = MALFORMED, sleep: Callable[[float], None] = time.sleep) -> tuple[object, str, int]:
    """(result, error, attempts) of call(): an error becomes data. Waits double from ``wait`` to ``longest``; errors that are ``final`` aren't tried again."""
    for n in range(retries + 1):
        try:
            return call(), "", n + 1
        except Exception as e:  # noqa: BLE001
            if isinstance(e, final) or n == retries:
                return None, f"{type(e).__name__}: {e}", n + 1
            sleep(min(longest, wait * 2**n))
    raise AssertionError


def encoded_with_retry(encode: Callable[[list[str]], list[list[float]]], retries: int = 4, wait: float = 2.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[list[str]], list[list[float]]]:
    """An encoder that tries again; when it has failed for good, the task fails, and Spark runs it anew."""

    def run(texts: list[str]) -> list[list[float]]:
        found, error, _ = attempt(lambda: encode(texts), retries, wait, longest, (), sleep)
        if error:
            raise RuntimeError(error)
        return found

    return run


# --- messages -----------------------------------------------------------------------------------


def _labelled(label: str, value: Column) -> Column:
    """Null where the value is missing or blank."""
    said = stripped(value.cast("string"))
    return F.when(said != "", F.concat(F.lit(label), said))


def _filled(template: str, **parts: Column) -> Column:
    """The template with its {names} replaced, each once, whatever the values hold."""
    out, rest = [], template
    for name, part in parts.items():
        before, _, rest = rest.partition("{" + name + "}")
        out += [F.lit(before), part]
    return F.concat(*out, F.lit(rest))


def judge_message(query: Column, source: Column, page: Column, text: Column) -> Column:
    """What a judge is shown of a pair."""
    head = F.concat_ws(" | ", _labelled(fixed.SOURCE_LABEL, source), _labelled(fixed.PAGE_LABEL, page))
    return _filled(fixed.JUDGE_MESSAGE, query=query, head=F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), text=stripped(F.coalesce(text, F.lit(""))))


def filter_message(source: Column, page: Column, breadcrumb: Column, text: Column) -> Column:
    """What a filter is shown of a chunk."""
    head = F.concat_ws("\n", _labelled(fixed.SOURCE_LABEL, source), _labelled(fixed.PAGE_LABEL, page), _labelled(fixed.BREADCRUMB_LABEL, breadcrumb))
    return _filled(fixed.FILTER_MESSAGE, head=F.when(head != "", F.concat(head, F.lit("\n\n"))).otherwise(""), text=stripped(F.coalesce(text, F.lit(""))))


# --- rubrics ------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rubric:
    """How pairs are graded: the prompt, the columns that a reply gives, and how it is read. Versions follow from the fields and the prompt."""

    name: str
    system: str
    columns: str
    read: Callable[[dict], tuple]
    failed: tuple

    @property
    def schema_version(self) -> str:
        return fingerprint(fixed.RUBRIC_FIELDS[self.name])

    @property
    def prompt_hash(self) -> str:
        return prompt_hash(self.system, fixed.JUDGE_MESSAGE)

    def contract(self, backend: str, model: str) -> dict[str, str]:
        return {"schema_version": self.schema_version, "prompt_hash": self.prompt_hash, "backend": backend, "model": model}


def _boolean(reply: dict) -> tuple:
    """Off topic is nothing; actionable implies meaningful; the score is d2 + d3."""
    on = bool(reply["d1"])
    actionable = on and bool(reply["d3"])
    meaningful = on and (bool(reply["d2"]) or actionable)
    return str(reply.get("reasoning", "")), on, meaningful, actionable, meaningful + actionable


def _graded(reply: dict) -> tuple:
    return bool(reply["d1"]), int(reply["d2"]), int(reply["d3"]), int(reply["d4"])


RUBRICS = {
    "v1_boolean": Rubric("v1_boolean", "Say whether the chunk is on the query's topic (d1), is a meaningful answer (d2) and can be acted on (d3), as JSON.", "reasoning string, d1 boolean, d2 boolean, d3 boolean, score int", _boolean, ("", False, False, False, -1)),
    "v2_graded": Rubric("v2_graded", "Say whether the chunk is on the query's topic (d1), and grade from 0 to 2 how meaningful (d2), actionable (d3) and dense (d4) it is, as JSON.", "d1 boolean, d2 int, d3 int, d4 int", _graded, (False, 0, 0, 0)),
}


def successful(name: str) -> Column:
    """Which labels of a rubric aren't errors."""
    return F.col("score") >= 0 if name == "v1_boolean" else F.coalesce("_error", F.lit("")) == ""


def asked(rows: DataFrame, keep: list[str], message: Column, model: Callable[[str], dict | str], columns: str, read: Callable[[dict], tuple], failed: tuple, retries: int = 2, wait: float = 1.0) -> DataFrame:
    """keep..., the columns that ``read`` gives, _error, _attempts: a row for each row, whatever the model does.

    A reply is an object, or text that holds one.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def reply(said: str) -> tuple:
        def call() -> tuple:
            found = model(said)
            if isinstance(found, str):
                text, _, error = rubric.read_reply(found)
                if error:
                    raise ValueError(error)
                found = json.loads(text)
            return read(found)

        found, error, n = attempt(call, retries, wait)
        return (*(failed if error else found), error, n)

    def run(frames):
        for f in frames:
            out = pd.DataFrame([reply(m) for m in f["_message"]], columns=[*names, "_error", "_attempts"])
            yield pd.concat([f[keep].reset_index(drop=True), out], axis=1)

    return rows.select(*keep, message.alias("_message")).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keep), columns, "_error string, _attempts int"]))


def judge(pairs: DataFrame, model: Callable[[str, str], dict | str], contract: dict[str, str], retries: int = 2, rubric_name: str = "v2_graded", wait: float = 1.0) -> DataFrame:
    """pairs (query_id, chunk_id, query_text, text) with the rubric's grades, _error, _attempts and the contract's columns. ``model`` grades one pair."""
    chosen = RUBRICS[rubric_name]
    pair = F.to_json(F.struct("query_text", "text"))

    def grade(said: str) -> dict | str:
        both = json.loads(said)
        return model(both.get("query_text"), both.get("text"))

    keyed = pairs.withColumns({k: F.col(k).cast("string") for k in ("query_id", "chunk_id")})
    found = asked(keyed, ["query_id", "chunk_id"], pair, grade, chosen.columns, chosen.read, chosen.failed, retries, wait)
    return found.withColumns({k: F.lit(v) for k, v in contract.items()})


def decided(chunks: DataFrame, model: Callable[[str], dict | str], backend: str, name: str, system: str = "Say whether the chunk can answer a question, and which, as JSON.", retries: int = 2, wait: float = 1.0) -> DataFrame:
    """chunk_id, seed_query (null: the chunk goes), reason, _error, _attempts and the contract, for chunks (chunk_id, source, page, breadcrumb, text). An empty query is none."""
    read = lambda r: ((r.get("query") or None), str(r.get("reason", "")))
    found = asked(chunks, ["chunk_id"], filter_message(*(F.col(c) for c in ("source", "page", "breadcrumb", "text"))), model, "seed_query string, reason string", read, (None, ""), retries, wait)
    contract = {"schema_version": fingerprint(fixed.FILTER_FIELDS), "prompt_hash": prompt_hash(system, fixed.FILTER_MESSAGE), "backend": backend, "model": name}
    return found.withColumn("seed_query", F.nullif(stripped(F.col("seed_query")), F.lit(""))).withColumns({k: F.lit(v) for k, v in contract.items()})


def kept(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """chunks with seed_query, of those that the filter keeps."""
    chosen = decisions.withColumn("seed_query", F.nullif(stripped(F.col("seed_query")), F.lit(""))).where(F.col("seed_query").isNotNull() & (F.coalesce("_error", F.lit("")) == ""))
    return chunks.join(chosen.select("chunk_id", "seed_query"), "chunk_id")


# --- stand-ins, deterministic, for tests --------------------------------------------------------


def stub_judge(query: str, text: str) -> dict:
    """Shared words decide."""
    shared = len(set(query.lower().split()) & set(text.lower().split()))
    return {"d1": shared > 0, "d2": min(2, shared), "d3": min(2, shared // 2), "d4": min(2, shared // 3)}


def stub_filter(message: str) -> dict:
    """Long messages are kept, with a question on their first word."""
    text = message.partition("Chunk:\n")[2]
    return {"query": f"what of {text.split()[0]}" if len(text) >= 1000 else "", "reason": "length"}


def stub_synthesis(message: str) -> dict:
    topic, ids, *_ = message.split("\n")
    return {"query_text": f"synthesis: {topic}", "seed_chunk_ids": ids.split(",")}


def stub_rewrite(message: str) -> dict:
    kind, _, question = message.partition("\n")
    return {"rewrite": f' "{kind}: {question}" '}
