"""Answers from sources: label them, ask a model in one of several ways, join what it says."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cite import label_sources
from . import prompts

#: All names of ways to answer, and those that can be asked for.
NAMES = tuple(f"{c}{m}" for c in ("cite_", "") for m in ("refine", "compact", "simple_summarize", "tree_summarize", "generation", "no_text", "accumulate", "compact_accumulate"))
MODES = ("cite_accumulate", "cite_compact", "refine", "compact", "tree_summarize", "simple_summarize", "generation", "accumulate")
EMPTY = "Empty Response"
BETWEEN = "\n---------------------\n"


def packed(texts: list[str], room: int) -> list[str]:
    """Texts in order, blank ones left out, joined as long as they fit into ``room`` characters; longer ones are cut."""
    out, now = [], ""
    for t in filter(None, (t.strip() for t in texts)):
        for part in (t[i : i + room] for i in range(0, len(t), room)):
            if now and len(now) + 2 + len(part) > room:
                out.append(now)
                now = ""
            now = f"{now}\n\n{part}" if now else part
    return [*out, now] if now else out


def _refined(ask: Callable[..., str], chunks: list[str]) -> str:
    answer = None
    for c in chunks:
        answer = ask("answer", context_str=c) if answer is None else ask("refine", context_msg=c, existing_answer=answer)
    return EMPTY if answer is None else answer


def _summed(ask: Callable[..., str], texts: list[str], room: int) -> str:
    chunks = packed(texts, room)
    while len(chunks) > 1:
        told = [ask("summary", context_str=c) for c in chunks]
        fewer = packed(told, room)
        chunks = fewer if len(fewer) < len(chunks) else [BETWEEN.join(told)]
    return ask("summary", context_str=chunks[0]) if chunks else EMPTY


def respond(model: Callable[[str], str], mode: str, question: str, texts: list[str], room: int, templates: Callable[[str, str], str] = prompts.bare) -> str:
    """One answer.  Without sources there is nothing to answer from, but in generation."""
    ask = lambda step, **values: model(prompts.fill(templates(mode, step), query_str=question, **values))
    if mode == "generation":
        return ask("simple")
    if not texts:
        return EMPTY
    if mode.endswith("accumulate"):
        return BETWEEN.join(ask("answer", context_str=t) for t in texts)
    if mode.endswith("compact"):
        return _refined(ask, packed(texts, room))
    if mode == "refine":
        return _refined(ask, [p for t in texts for p in packed([t], room)])
    if mode == "tree_summarize":
        return _summed(ask, texts, room)
    return ask("answer", context_str="\n".join(texts)[:room])


def synthesize(rows: DataFrame, model: Callable[[str], str], key: str, mode: str = "cite_accumulate", chunk: int = 4000, questions: DataFrame | None = None, fields: tuple[str, ...] = (), templates: Callable[[str, str], str] = prompts.bare) -> DataFrame:
    """key, answer, error for each key of ``rows`` (key, pos, text), or of ``questions`` (key, question), sources or not.

    A key holds the sources of one question, as many as a retriever gives.  Names of
    NAMES that aren't in MODES, and other names, raise ValueError.  A model's failure
    is that key's error.  ``templates`` gives the prompt of a step: bare() the sources
    alone, prompts.select() the templates.  With ``fields`` the model's reply is JSON, and those fields
    of it become columns.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    got = label_sources(rows, key) if mode.startswith("cite") else rows
    by = got.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]).alias("texts"))
    by = by.withColumn("question", F.lit("")) if questions is None else questions.select(key, "question").join(by, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers, errors = [], []
            for question, texts in zip(batch["question"], batch["texts"]):
                try:
                    answers.append(respond(model, mode, question or "", [] if texts is None else list(texts), chunk, templates))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  told as a row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: batch[key], "answer": answers, "error": errors})

    out = by.select(key, "question", "texts").mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, answer string, error string")
    if fields:
        parsed = F.from_json("answer", ", ".join(f"{f} string" for f in fields))
        out = out.withColumns({f: parsed[f] for f in fields})
    return out


def synthesizer(mode: str = "cite_accumulate", **options) -> Callable[..., DataFrame]:
    """synthesize() with a mode and options fixed; unknown modes raise at once."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    return lambda rows, model, key, **more: synthesize(rows, model, key, mode, **{**options, **more})


def shown_prompts(mode: str) -> str:
    """The templates of a mode as JSON, to be looked at."""
    return json.dumps({step: prompts.select(mode, step) for step in ("answer", "refine", "summary", "simple")}, indent=2)
