"""Many needles in each text, one pass a text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Largest total size of the needles that are broadcast, in code points.
NEEDLE_POINTS = 16 << 20


def needle_blocks(needles: Iterable[tuple[str, str]]) -> Iterator[list[tuple[str, str]]]:
    """Needles in blocks of bounded size; one empty block without any."""
    block: list[tuple[str, str]] = []
    size, given = 0, False
    for n in needles:
        if block and size + len(n[1]) > NEEDLE_POINTS:
            yield block
            block, size, given = [], 0, True
        block.append(n)
        size += len(n[1])
    if block or not given:
        yield block


def holding(rows: DataFrame, key: str, text: str, needles: Iterable[tuple[str, str]], name: str = "query_id", beside: Sequence[str] = ()) -> DataFrame:
    """``(name, key, *beside)`` of the texts that hold a needle; one automaton for all needles of a block."""
    source = rows.where(F.col(text) != "").select(key, *beside, text)
    kinds = dict(source.dtypes)
    schema = f"{name} string, " + ", ".join(f"{c} {kinds[c]}" for c in (key, *beside))
    out = None
    for block in needle_blocks(needles):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for i, (_, needle) in enumerate(shared.value):
                automaton.add_word(needle, [*automaton.get(needle, []), i])
            if shared.value:
                automaton.make_automaton()
            for b in batches:
                at, found = [], []
                for row, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    for i in sorted({i for _, hits in (automaton.iter(t) if shared.value else ()) for i in hits}):
                        at.append(row)
                        found.append(shared.value[i][0])
                rows_at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(c.take(rows_at) for c in b.columns[:-1])], names=[name, *b.schema.names[:-1]])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct()
