"""Model stages as plug-ins with deterministic stand-ins.

A stage is a callable from a list of payloads to a list of results; it runs in
Arrow batches, so a real model loads once a worker. No stand-in claims a
model's quality.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Rows = list[tuple[str, int, int, str]]  # label, start, end, text
Stage = Callable[[list[str]], list[Rows]]


def layout_by_lines(texts: list[str]) -> list[Rows]:
    """LAY05: paragraphs as regions, labelled by their look; start and end are lines."""
    out = []
    for t in texts:
        rows, start, lines = [], 0, t.split("\n") + [""]
        for i, line in enumerate(lines):
            if line.strip():
                continue
            if i > start:
                body = "\n".join(lines[start:i])
                label = "title" if body.lstrip().startswith("#") else "table" if body.lstrip().startswith("|") else "list" if re.match(r"\s*[-*] ", body) else "text"
                rows.append((label, start, i, body))
            start = i + 1
        out.append(rows)
    return out


def pages_by_marker(texts: list[str]) -> list[Rows]:
    """SRC27: pages of a text with page markers; start is the page, end the number of lines."""
    out = []
    for t in texts:
        parts = re.split(r"^\s*<!-- PDF page (\d+) -->\s*$", t, flags=re.M)
        out.append([("page", int(n), body.strip("\n").count("\n") + 1, body.strip("\n")) for n, body in zip(parts[1::2], parts[2::2], strict=True)])
    return out


def segments_by_sentence(texts: list[str], per_word: int = 400) -> list[Rows]:
    """SRC28: a transcript's sentences with times, ``per_word`` milliseconds a word."""
    out = []
    for t in texts:
        rows, at = [], 0
        for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", t)):
            if s:
                end = at + per_word * len(s.split())
                rows.append(("segment", at, end, s))
                at = end
        out.append(rows)
    return out


STAGES: dict[str, Stage] = {"layout": layout_by_lines, "pages": pages_by_marker, "speech": segments_by_sentence}


def run_stage(rows: DataFrame, key: str, payload: str, stage: str | Stage) -> DataFrame:
    """``(key, item_no, label, start, end, text)`` by a registered stage or a callable; null payloads give nothing."""
    model = STAGES[stage] if isinstance(stage, str) else stage
    source = rows.where(f"{payload} is not null").select(key, payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, i, *x) for k, found in zip(b.column(0).to_pylist(), model(b.column(1).to_pylist()), strict=True) for i, x in enumerate(found)]
            kinds = (b.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[key, "item_no", "label", "start", "end", "text"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, item_no int, label string, start int, end int, text string")
