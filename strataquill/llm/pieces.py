"""Oversized sections cut at natural boundaries, by ranges of the document (problem 1).

A document is worked on in ranges, each with a halo on both sides, so no task
needs a whole giant text. Files are read in byte ranges at their offsets (a
range owns the code points that begin in it; a code point cut by the range's
edge is put together from the halo); a Markdown column is sliced in one pass
over its cell.

1. Workers find the line starts and page marker lines of their range.
2. The ranges' boundary tables are stitched by prefix sums over the ranges'
   numbers alone (code points, lines, marker characters), in two levels, so that
   no task sees all ranges of a document. That gives every line its number, its
   offset and its offset without markers.
3. A section's length is the difference of two such offsets.
4. Cuts are greedy: from a cut the next one is the best natural boundary that
   the limit allows, so it depends on the text around it only. A section within
   one range is cut there. For one that crosses ranges every range tells for
   each place where a piece might begin in it where the first piece beyond it
   begins and how many pieces lie between; these tables are composed by pointer
   doubling from the section's start. The pieces are those of one pass over the
   whole text, whatever the size of the ranges.
5. Pieces are emitted by offset and numbered by the counts of the ranges before.

A piece ends, if it can, at the last paragraph, else line, else sentence end
beyond the first third of what it may hold, else at the last blank there, else
at the last boundary before. Each later piece begins with up to ``overlap`` code
points from the end of the piece before, from a word's beginning where there is
one. No piece begins or ends between a character and its combining marks.

Defined results: a null Markdown has no sections, an empty one has one empty
line; a null or negative start makes a section none; a null end stands for the
end of the document; rows delivered again count once, also with other headings
(the smallest stays); offsets and lengths are code points; a text without any
boundary is cut at the limit; a marker line longer than ``HALO`` code points is
text where it crosses ranges; bytes that aren't UTF-8 become replacement
characters.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

RANGE = 65_536
#: Bytes of files that a task reads.
TASK_BYTES = 32 << 20
#: Context for marker lines and blank lines at a range's edge.
HALO = 1_024
#: Most combining marks of one character that a cut at the limit goes back over.
MARKS = 64

MARKER = regex.compile(r"^[ \t]*+<!-- PDF page \d+ -->[ \t\r]*+$", regex.M)
PARAGRAPH = regex.compile(r"(?<=\n)[ \t\r]*+\n")
LINE = regex.compile(r"\n")
SENTENCE = regex.compile(r"[.!?…؟][\"'”’»)\]]*(?=\s)|[。！？；।][」』”’）》]*")
BLANK = regex.compile(r"\s")

# --- ranges -------------------------------------------------------------------------------------------------------------------------

PARTS = "document_id string, range_no int, lead int, own int, first boolean, last boolean, part string"
PART_TYPES = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
NUMBERS = "n_points bigint, n_lines bigint, cut bigint, starts array<int>, cuts array<int>"
NUMBER_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))


def names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def batch_of(rows: list[tuple], types: tuple, schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names_of(schema))


def text_range(text: str, no: int, size: int, left: int, right: int) -> tuple[int, int, bool, bool, str]:
    """``(lead, own, first, last, part)`` of a text in memory; halos count code points outside marker lines and grow until they hold enough."""
    at, end = no * size, min(len(text), no * size + size)
    a, b, more = max(0, at - left), min(len(text), end + right), max(left, right, 1)
    while (a > 0 and kept_points(text[a:at]) < left) or (b < len(text) and kept_points(text[end:b]) < right):
        more *= 2
        a, b = max(0, at - more), min(len(text), end + more)
    return at - a, end - at, no == 0, end == len(text) and end < no * size + size, text[a:b]


def kept_points(text: str) -> int:
    return len(text) - sum(m.end() - m.start() + 1 for m in MARKER.finditer(text)) if "<!-- PDF page" in text else len(text)


def byte_range(read: Callable[[int, int], bytes], total: int, no: int, size: int, left: int, right: int) -> tuple[int, int, bool, bool, str]:
    """``(lead, own, first, last, part)`` of a file's bytes [no * size, no * size + size); ``read(offset, length)``.

    Own are the code points whose first byte lies in the range. Halos are
    resynchronised: bytes that continue a code point begun before are left off.
    """
    at, end = no * size, min(total, no * size + size)
    more = 4 * max(left, right, 1)
    while True:
        a, b = max(0, at - more), min(total, end + more)
        raw = read(a, b - a)
        skip = next((i for i in range(min(4, len(raw))) if raw[i] & 0xC0 != 0x80), 0) if a else 0
        # the own bytes begin and end at first bytes of code points
        x, y = (_forward(raw, p - a) if p < total else len(raw) for p in (at, end))
        head, own, tail = (raw[i:j] for i, j in ((skip, x), (x, y), (y, len(raw))))
        if b < total:
            tail = tail[: len(tail) - _unfinished(tail)]
        parts = [p.decode("utf-8", "replace") for p in (head, own, tail)]
        if (a == 0 or kept_points(parts[0]) >= left) and (b == total or kept_points(parts[2]) >= right):
            return len(parts[0]), len(parts[1]), no == 0, end == total and end < at + size, "".join(parts)
        more *= 2


def _forward(raw: bytes, at: int) -> int:
    """The first byte at or after ``at`` that begins a code point; after four continuing bytes any byte does."""
    return next((at + i for i in range(4) if at + i >= len(raw) or raw[at + i] & 0xC0 != 0x80), at)


def _unfinished(raw: bytes) -> int:
    """How many bytes at the end begin a code point that isn't finished."""
    for i in range(1, min(4, len(raw)) + 1):
        c = raw[-i]
        if c & 0xC0 != 0x80:
            return i if (c >= 0xF0 and i < 4) or (0xE0 <= c < 0xF0 and i < 3) or (0xC0 <= c < 0xE0 and i < 2) else 0
    return 0


def range_count(total: int, size: int) -> int:
    """Ranges of a text or file; one that is a multiple of the size has an empty last one, which holds its end."""
    return total // size + 1


class Cells:
    """Ranges of the Markdown column of ``documents(document_id, markdown)``, sliced in one pass over each cell."""

    def __init__(self, documents: DataFrame, size: int = RANGE) -> None:
        self.rows, self.size = documents.where("document_id is not null and markdown is not null").select("document_id", "markdown"), size

    def boundaries(self) -> DataFrame:
        """Boundary numbers of texts within one range; longer ones as parts, for other workers."""
        size = self.size
        schema = f"{PARTS}, {NUMBERS}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if len(text) < size:
                        rows.append((doc, 0, 0, len(text), True, True, None, *range_numbers(text, 0, len(text), True, True)))
                    for no in range(range_count(len(text), size) if len(text) >= size else 0):
                        rows.append((doc, no, *text_range(text, no, size, HALO, HALO), *[None] * 5))
                        if len(rows) >= 256:
                            yield batch_of(rows, PART_TYPES + NUMBER_TYPES, schema)
                            rows = []
                yield batch_of(rows, PART_TYPES + NUMBER_TYPES, schema)

        return self.rows.mapInArrow(run, schema)

    def over(self, needed: DataFrame, left: int, right: int, each: Callable[[str, dict, tuple], list[tuple]], types: tuple, schema: str) -> DataFrame:
        """What ``each(document_id, range, part)`` gives for the ranges of ``needed(document_id, ranges)``, an array of structs with a ``range_no``."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows: list[tuple] = []
                for doc, text, ranges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    for r in ranges:
                        rows += each(doc, r, text_range(text, r["range_no"], size, left, right))
                        if len(rows) >= 1_024:
                            yield batch_of(rows, types, schema)
                            rows = []
                yield batch_of(rows, types, schema)

        return self.rows.join(needed, "document_id").select("document_id", "markdown", "ranges").mapInArrow(run, schema)


def opened(path: str):
    """A file of any file system that Arrow knows, for reads at offsets."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])
    return system.open_input_file(name)


class Files:
    """Byte ranges of the texts ``files(document_id, path, length[, begin])``; no worker reads more of a text than its range and halo.

    A text is a whole file, or the ``length`` bytes of one from ``begin`` on.
    """

    def __init__(self, files: DataFrame, size: int = RANGE) -> None:
        begin = F.col("begin") if "begin" in files.columns else F.lit(0)
        self.rows, self.size = files.where("document_id is not null").select("document_id", "path", begin.cast("bigint").alias("begin"), F.col("length").cast("bigint").alias("length")), size

    @staticmethod
    def found(spark, root: str) -> DataFrame:
        """``files`` of a folder with one folder a document, by Spark's own listing; contents aren't read."""
        listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).load(root)
        return listed.select(F.element_at(F.split("path", "/"), -2).alias("document_id"), "path", "length")

    @staticmethod
    def packed(documents: DataFrame, root: str) -> DataFrame:
        """Writes ``documents(document_id, markdown)`` one after the other, a file a task; their spans as ``files``."""
        source = documents.where("document_id is not null and markdown is not null").select("document_id", "markdown")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import uuid

            from pyarrow import fs

            address = root if "://" in root else "file://" + root[5:] if root.startswith("file:") else root
            system, folder = fs.FileSystem.from_uri(address)
            system.create_dir(folder, recursive=True)
            name, rows, at = f"part-{uuid.uuid4().hex}", [], 0
            with system.open_output_stream(f"{folder}/{name}") as f:
                for b in batches:
                    for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        raw = text.encode("utf-8", "replace")
                        f.write(raw)
                        rows.append((doc, f"{address.rstrip('/')}/{name}", at, len(raw)))
                        at += len(raw)
            yield batch_of(rows, (pa.string(), pa.string(), pa.int64(), pa.int64()), "document_id string, path string, begin bigint, length bigint")

        return cut_lineage(source.mapInArrow(run, "document_id string, path string, begin bigint, length bigint"))

    def over(self, needed: DataFrame, left: int, right: int, each: Callable[[str, dict, tuple], list[tuple]], types: tuple, schema: str) -> DataFrame:
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            path, file = None, None
            for b in batches:
                rows: list[tuple] = []
                for doc, name, begin, total, r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if name != path:
                        if file is not None:
                            file.close()
                        path, file = name, opened(name)
                    read = lambda at, n, f=file, begin=begin: f.read_at(n, begin + at)
                    rows += each(doc, r, byte_range(read, total, r["range_no"], size, left, right))
                    if len(rows) >= 1_024:
                        yield batch_of(rows, types, schema)
                        rows = []
                yield batch_of(rows, types, schema)
            if file is not None:
                file.close()

        asked = self.rows.join(needed, "document_id").select("document_id", "path", "begin", "length", F.explode("ranges").alias("r"))
        # rows are few bytes and much work, so the bytes behind them decide the number of tasks
        total = self.rows.agg(F.sum("length")).first()[0] or 0
        tasks = max(asked.sparkSession.sparkContext.defaultParallelism, total // TASK_BYTES)
        return asked.repartition(tasks, "document_id", "r.range_no").sortWithinPartitions("path", "begin").mapInArrow(run, schema)

    def boundaries(self) -> DataFrame:
        no = F.sequence(F.lit(0), F.floor(F.col("length") / self.size).cast("int"))
        every = self.rows.select("document_id", F.transform(no, lambda i: F.struct(i.alias("range_no"))).alias("ranges"))
        none = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in NUMBERS.split(", ")]
        return self.over(every, HALO, HALO, lambda doc, r, part: [(doc, r["range_no"], *part)], PART_TYPES, PARTS).select("*", *none)


# --- boundary tables ----------------------------------------------------------------------------------------------------------------


def range_numbers(part: str, lead: int, own: int, first: bool, last: bool) -> tuple[int, int, int, list[int], list[int]]:
    """``(n_points, n_lines, cut, starts, cuts)`` of the own part: line starts, and the marker characters of the range before each.

    The end of the text counts as one more line start, one past the last code point.
    """
    end = lead + own
    starts = [0] if first else []
    at = part.find("\n", max(0, lead - 1), end)
    while at >= 0:
        if lead <= at + 1 < end or at + 1 == end and last:
            starts.append(at + 1 - lead)
        at = part.find("\n", at + 1, end)
    marks = []
    if "<!-- PDF page" in part:
        for m in MARKER.finditer(part):
            p = m.start()
            if lead <= p < end and (p > 0 or first):
                marks.append((p - lead, m.end() - p + 1))
    ahead = [0, *accumulate(n for _, n in marks)]
    where = [p for p, _ in marks]
    if last:
        starts.append(own + 1)
    cuts = [ahead[bisect_left(where, s)] for s in starts] if marks else [0] * len(starts)
    return own, len(starts), ahead[-1], starts, cuts


def totals_before(rows: DataFrame, key: list[str], no: str, columns: list[str], block: int = 4_096) -> DataFrame:
    """``(key, no, <column>_before)``: sums over the smaller numbers of the same key, within blocks and over blocks, so no task sees a whole key."""
    numbered = rows.select(*key, no, *columns).withColumn("_block", F.floor(F.col(no) / block))
    inside = Window.partitionBy(*key, "_block").orderBy(no).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = numbered.groupBy(*key, "_block").agg(*(F.sum(c).alias(c) for c in columns))
    before = blocks.select(*key, "_block", *(F.coalesce(F.sum(c).over(over), F.lit(0)).alias(f"_{c}") for c in columns))
    own = numbered.select(*key, no, "_block", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_own_{c}") for c in columns))
    return own.join(before, [*key, "_block"]).select(*key, no, *((F.col(f"_own_{c}") + F.col(f"_{c}")).alias(f"{c}_before") for c in columns))


def boundary_table(source: Cells | Files) -> DataFrame:
    """``(document_id, range_no, n_points, n_lines, cut, starts, cuts)`` of every range, written once; the only reading of whole texts for lengths."""
    schema = f"document_id string, range_no int, {NUMBERS}"
    found = source.boundaries()
    if isinstance(source, Cells):
        found = cut_lineage(found)
    names = names_of(schema)
    far = found.where("part is not null").select(*names_of(PARTS))
    if isinstance(source, Cells):
        far = far.repartition("document_id", "range_no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc, no, *range_numbers(part, lead, own, first, last)) for doc, no, lead, own, first, last, part in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield batch_of(rows, (pa.string(), pa.int32(), *NUMBER_TYPES), schema)

    table = cut_lineage(far.mapInArrow(run, schema))
    return found.where("part is null").select(*names).unionByName(table) if isinstance(source, Cells) else table


def located(points: DataFrame, table: DataFrame, bucket: int = 256) -> DataFrame:
    """``points(document_id, line_no, …)`` with ``range_no``, ``start`` and ``kept`` of their lines.

    ``start`` is the line's offset, ``kept`` the same without the characters of
    marker lines before it; the end of the text is one more line. Line starts
    travel as arrays of a bucket of lines, not as rows.
    """
    before = totals_before(table, ["document_id"], "range_no", ["n_points", "n_lines", "cut"])
    rows = table.where("n_lines > 0").join(before, ["document_id", "range_no"])
    last = F.col("n_lines_before") + F.col("n_lines") - 1
    buckets = F.explode(F.sequence(F.floor(F.col("n_lines_before") / bucket), F.floor(last / bucket)))
    cut = rows.select("document_id", "range_no", "n_points_before", "n_lines_before", "cut_before", "starts", "cuts", buckets.alias("bucket"))
    low = F.greatest(F.col("bucket") * bucket - F.col("n_lines_before"), F.lit(0)).cast("int")
    part = lambda c: F.slice(c, low + 1, F.lit(bucket) - F.greatest(F.col("n_lines_before") - F.col("bucket") * bucket, F.lit(0)).cast("int"))
    held = cut.select(
        "document_id", "bucket", "range_no", (F.col("n_lines_before") + low).alias("first_line"), "n_points_before", (F.col("n_points_before") - F.col("cut_before")).alias("kept_before"),
        part("starts").alias("starts"), part("cuts").alias("cuts"),
    )
    at = (F.col("line_no") - F.col("first_line")).cast("int")
    found = points.withColumn("bucket", F.floor(F.col("line_no") / bucket)).join(held, ["document_id", "bucket"]).where((at >= 0) & (at < F.size("starts")))
    start = F.get("starts", at)
    return found.select(*points.columns, "range_no", (F.col("n_points_before") + start).alias("start"), (F.col("kept_before") + start - F.get("cuts", at)).alias("kept"))


def own_spans(sections: DataFrame) -> DataFrame:
    """``(document_id, section_id, heading, first, last)``: the lines of each section's own text, half open; ``last`` may be null."""
    keys = ["document_id", "section_id", "source_start", "source_end"]
    rows = sections.where("section_id is not null and document_id is not null and source_start >= 0").groupBy(*keys).agg(F.min("heading").alias("heading"))
    return rows.join(following_starts(rows), ["document_id", "source_start"]).select(
        "document_id", "section_id", "heading", F.col("source_start").alias("first"), F.least("next", "source_end").alias("last")
    )


def following_starts(rows: DataFrame, bucket: int = 4_096) -> DataFrame:
    """``(document_id, source_start, next)``: the next larger start of the document.

    Starts are compared within buckets of line numbers, which hold at most
    ``bucket`` different starts, and the buckets' first starts among each other,
    so a document with a third of all sections is not sorted in one task.
    """
    starts = rows.select("document_id", "source_start").distinct().withColumn("bucket", F.floor(F.col("source_start") / bucket))
    firsts = starts.groupBy("document_id", "bucket").agg(F.min("source_start").alias("first"))
    later = firsts.select("document_id", "bucket", F.lead("first").over(Window.partitionBy("document_id").orderBy("bucket")).alias("beyond"))
    within = starts.withColumn("inside", F.lead("source_start").over(Window.partitionBy("document_id", "bucket").orderBy("source_start")))
    return within.join(later, ["document_id", "bucket"]).select("document_id", "source_start", F.coalesce("inside", "beyond").alias("next"))


def as_source(documents: DataFrame | Cells | Files, size: int) -> Cells | Files:
    return Cells(documents, size) if isinstance(documents, DataFrame) else documents


def section_lengths(documents: DataFrame | Cells | Files, sections: DataFrame, size: int = RANGE, table: DataFrame | None = None) -> DataFrame:
    """``(document_id, section_id, heading, begin, end, from, n_chars, range_first, range_last)`` of each section with own lines.

    ``begin`` and ``end`` are offsets, half open; ``from`` is the begin without marker characters.
    """
    table = boundary_table(as_source(documents, size)) if table is None else table
    ends = table.groupBy("document_id").agg((F.sum("n_lines") - 1).alias("n_lines"))
    spans = own_spans(sections).join(ends, "document_id").withColumn("last", F.least(F.coalesce("last", "n_lines"), "n_lines")).where("first < last")
    point: Callable[[str, int], Column] = lambda c, sign: F.struct(F.col(c).cast("bigint").alias("line_no"), F.lit(sign).alias("sign"))
    points = spans.select("document_id", "section_id", "heading", F.col("first").alias("at"), F.explode(F.array(point("first", -1), point("last", 1))).alias("p"))
    placed = located(points.select("document_id", "section_id", "heading", "at", "p.line_no", "p.sign"), table)
    opened = lambda c: F.min(F.when(F.col("sign") < 0, F.col(c)))
    # a section that is delivered with two spans keeps the longer
    each = placed.groupBy("document_id", "section_id", "at").agg(
        F.min("heading").alias("heading"),
        opened("start").alias("begin"),
        (F.max("start") - 1).alias("end"),
        opened("kept").alias("from"),
        F.greatest(F.max("kept") - opened("kept") - 1, F.lit(0)).cast("int").alias("n_chars"),
        opened("range_no").alias("range_first"),
        F.max("range_no").alias("range_last"),
    )
    best = each.groupBy("document_id", "section_id").agg(F.max_by(F.struct("heading", "begin", "end", "from", "n_chars", "range_first", "range_last"), F.struct("n_chars", -F.col("begin"))).alias("x"))
    return best.select("document_id", "section_id", "x.*")


def oversized(documents: DataFrame | Cells | Files, sections: DataFrame, limit: int = 3_000, size: int = RANGE, table: DataFrame | None = None) -> DataFrame:
    return section_lengths(documents, sections, size, table).where(F.col("n_chars") > limit)


# --- cutting ------------------------------------------------------------------------------------------------------------------------


def joins(ch: str) -> bool:
    """Whether a character belongs to the one before it."""
    return unicodedata.category(ch)[0] == "M" or ch == "‍"


class Part:
    """A range's text without marker lines; places are counted so from the document's beginning."""

    def __init__(self, part: str, lead: int, own: int, first: bool, kept_before: int, points_before: int) -> None:
        runs, at = [], 0
        marks = [(m.start(), m.end() + 1) for m in MARKER.finditer(part) if m.start() > 0 or first and lead == 0] if "<!-- PDF page" in part else []
        for a, b in [*marks, (len(part), len(part))]:
            if at < a:
                runs.append((at, a))
            at = max(at, b)
        self.text = "".join(part[a:b] for a, b in runs)
        self.to = [0, *accumulate(b - a for a, b in runs)][:-1] if runs else []
        self.of = [a - lead + points_before for a, _ in runs]
        # what of a marker line that begins in the range before reaches into this one was taken off there
        spill = max((b - lead for a, b in marks if a < lead < b), default=0)
        kept_lead = sum(min(b, lead) - a for a, b in runs if a < lead)
        self.base = kept_before + spill - kept_lead
        self.begin = kept_before + spill
        self.end = self.base + sum(min(b, lead + own) - a for a, b in runs if a < lead + own)
        self.ends = [[m.end() for m in p.finditer(self.text)] for p in (PARAGRAPH, LINE, SENTENCE, BLANK)]
        self.ends = [[e for e in ends if e >= len(self.text) or not joins(self.text[e])] for ends in self.ends]

    def offset(self, place: int) -> int:
        """The document's offset of a place."""
        i = bisect_right(self.to, place - self.base) - 1
        return self.of[i] + place - self.base - self.to[i]

    def content(self, a: int, b: int) -> str:
        return self.text[a - self.base : b - self.base]

    def overlap_from(self, place: int, first: int, most: int) -> int:
        """Where the overlap of a piece at ``place`` begins: at a word's beginning within ``most`` code points, if there is one."""
        low = max(first, place - most)
        if low == place:
            return place
        at = low - self.base
        if low > first and not self.text[at - 1].isspace():
            blanks = self.ends[3]
            words = (e for e in blanks[bisect_right(blanks, at) : bisect_left(blanks, place - self.base)] if not self.text[e].isspace())
            at = next(words, at)
        while at < place - self.base and joins(self.text[at]):
            at += 1
        return at + self.base

    def next_cut(self, place: int, first: int, last: int, limit: int, overlap: int) -> int:
        """Where the piece that begins at ``place`` ends."""
        most = limit - (place - self.overlap_from(place, first, overlap))
        if last - place <= most:
            return last
        at, end = place - self.base, place - self.base + most
        third = at + most // 3
        for low, kinds in ((third, self.ends), (at, (*self.ends[2::-1], self.ends[3]))):
            for ends in kinds:
                i = bisect_right(ends, end) - 1
                if i >= 0 and ends[i] > low:
                    return ends[i] + self.base
        cut = next((c for c in range(end, max(at, end - MARKS), -1) if c >= len(self.text) or not joins(self.text[c])), end)
        return cut + self.base

    def entries(self, last: int, limit: int, overlap: int) -> list[int]:
        """Where a piece may begin that follows a piece of an earlier range: boundaries, and places far behind any."""
        low, high = self.begin, min(self.end, self.begin + limit, last)
        natural = sorted({e + self.base for ends in self.ends for e in ends[bisect_left(ends, low - self.base) : bisect_left(ends, high - self.base)]})
        before = max((ends[i - 1] for ends in self.ends if (i := bisect_left(ends, low - self.base))), default=None)
        marks = [self.base if before is None else before + self.base, *natural, high]
        far = (limit - overlap) // 2
        return sorted({*natural, *(p for a, b in zip(marks, marks[1:]) for p in range(max(low, a + far), b))})


PIECES = "section_id string, piece_no int, document_id string, heading string, start_pos int, end_pos int, overlap int, content string"
PIECE_TYPES = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
#: A range's text with what is known of it, and its place among the pieces of one pass.
HELD = "range_no int, kept_before bigint, n_points_before bigint, lead int, own int, first boolean, part string"
HELD_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string())
STEPS = "document_id string, range_no int, section_id string, entry bigint, exit bigint, n bigint"
STEP_TYPES = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())


def cut_section(part: Part, doc: str, s: dict, limit: int, overlap: int) -> list[tuple]:
    """The pieces of a section that begin in the range, from the place ``entry`` and the number ``base`` on."""
    rows, place, no = [], s["entry"], s["base"]
    while place < min(s["until"], part.end):
        stop = part.next_cut(place, s["from"], s["until"], limit, overlap)
        head = part.overlap_from(place, s["from"], overlap)
        rows.append((s["section_id"], no, doc, s["heading"], part.offset(place), part.offset(stop - 1) + 1, place - head, part.content(head, stop)))
        place, no = stop, no + 1
    return rows


def section_steps(part: Part, doc: str, range_no: int, s: dict, limit: int, overlap: int) -> list[tuple]:
    """For each place of the range where a piece of the section may begin, where the first piece beyond the range begins and how many lie between."""
    rows, known = [], {}
    for entry in [s["from"]] if s["from"] >= part.begin else part.entries(s["until"], limit, overlap):
        trail, place = [], entry
        while place not in known and place < min(s["until"], part.end):
            trail.append(place)
            place = part.next_cut(place, s["from"], s["until"], limit, overlap)
        exit_, n = known.get(place, (place, 0))
        for p in reversed(trail):
            n += 1
            known[p] = (exit_, n)
        rows.append((doc, range_no, s["section_id"], entry, *known.get(entry, (entry, 0))))
    return rows


def pieces(documents: DataFrame | Cells | Files, sections: DataFrame, limit: int = 3_000, overlap: int = 200, size: int = RANGE) -> DataFrame:
    """``(section_id, piece_no, document_id, heading, start_pos, end_pos, overlap, content)`` of the oversized sections.

    Sections within one range are cut in the one pass over the texts; of ranges
    that a section crosses the pass keeps the text for the steps after it.
    """
    if not 0 <= overlap < limit or size < 4 * limit:
        raise ValueError("0 <= overlap < limit and ranges of at least four times the limit are needed")
    source = as_source(documents, size)
    table = boundary_table(source)
    big = cut_lineage(oversized(source, sections, limit, size, table).withColumn("until", F.col("from") + F.col("n_chars")))
    crosses = F.col("range_first") < F.col("range_last")
    at = big.select("document_id", "section_id", "heading", "from", "until", crosses.alias("crosses"), F.explode(F.sequence("range_first", "range_last")).alias("range_no"))
    section = F.struct("section_id", "heading", "from", "until", F.col("from").alias("entry"), F.lit(0).cast("bigint").alias("base"))
    ranges = at.groupBy("document_id", "range_no").agg(F.max("crosses").alias("crossed"), F.collect_list(F.when(~F.col("crosses"), section)).alias("sections"))
    before = totals_before(table, ["document_id"], "range_no", ["n_points", "cut"]).select("document_id", "range_no", (F.col("n_points_before") - F.col("cut_before")).alias("kept_before"), "n_points_before")
    needed = ranges.join(before, ["document_id", "range_no"]).groupBy("document_id").agg(F.collect_list(F.struct("range_no", "kept_before", "n_points_before", "crossed", "sections")).alias("ranges"))

    def first_pass(doc: str, r: dict, found: tuple) -> list[tuple]:
        lead, own, first, _, text = found
        part = Part(text, lead, own, first, r["kept_before"], r["n_points_before"]) if r["sections"] else None
        rows = [(*p, *[None] * len(HELD_TYPES)) for s in r["sections"] for p in cut_section(part, doc, s, limit, overlap)]
        if r["crossed"]:
            rows.append((None, None, doc, None, None, None, None, None, r["range_no"], r["kept_before"], r["n_points_before"], lead, own, first, text))
        return rows

    out = source.over(needed, limit + HALO, limit + HALO, first_pass, PIECE_TYPES + HELD_TYPES, f"{PIECES}, {HELD}")
    crossing = at.where("crosses").drop("crosses")
    if crossing.isEmpty():
        return out.select(*names_of(PIECES))
    out = cut_lineage(out)
    held = out.where("part is not null").select("document_id", *names_of(HELD))
    key = ["document_id", "section_id"]

    def worked(rows: DataFrame, each: Callable[[Part, str, int, dict], list[tuple]], types: tuple, schema: str) -> DataFrame:
        grouped = rows.groupBy("document_id", "range_no").agg(F.collect_list(F.struct("section_id", "heading", "from", "until", "entry", "base")).alias("sections"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, no, kept, points, lead, own, first, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    part = Part(text, lead, own, first, kept, points)
                    yield batch_of([x for s in found for x in each(part, doc, no, s)], types, schema)

        return held.join(grouped, ["document_id", "range_no"]).select("document_id", *names_of(HELD), "sections").mapInArrow(run, schema)

    asked = crossing.withColumn("entry", F.lit(None).cast("bigint")).withColumn("base", F.lit(None).cast("bigint"))
    jumps = cut_lineage(worked(asked, lambda part, doc, no, s: section_steps(part, doc, no, s, limit, overlap), STEP_TYPES, STEPS).where("entry < exit"))
    begun = crossing.select(*key, F.col("from").alias("entry")).distinct()
    # a piece begins in a range only where one of the ranges before leads
    led = jumps.select(*key, F.col("exit").alias("entry")).unionByName(begun).distinct()
    jumps = places = cut_lineage(jumps.join(led, [*key, "entry"], "left_semi"))
    reached = begun.withColumn("base", F.lit(0).cast("bigint"))
    most, span = big.agg(F.max(F.col("range_last") - F.col("range_first"))).first()[0], 1
    while span <= most:
        ahead = reached.join(jumps, [*key, "entry"]).select(*key, F.col("exit").alias("entry"), (F.col("base") + F.col("n")).alias("base"))
        reached = cut_lineage(reached.unionByName(ahead))
        after = jumps.select(*key, F.col("entry").alias("exit"), F.col("exit").alias("beyond"), F.col("n").alias("more"))
        jumps = cut_lineage(jumps.join(after, [*key, "exit"]).select(*key, "entry", F.col("beyond").alias("exit"), (F.col("n") + F.col("more")).alias("n")))
        span *= 2
    across = crossing.join(places.select(*key, "range_no", "entry"), [*key, "range_no"]).join(reached, [*key, "entry"])
    rest = worked(across, lambda part, doc, no, s: cut_section(part, doc, s, limit, overlap), PIECE_TYPES, PIECES)
    return out.where("part is null").select(*names_of(PIECES)).unionByName(rest)
