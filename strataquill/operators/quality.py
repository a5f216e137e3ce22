"""Quality gates for texts and pages, table admission and layout geometry.

Spatial joins have the document and page as equi-keys, so only boxes of one
page meet. Null boxes meet nothing; intervals are closed at both ends for
points, open for overlaps of positive area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROL = r"[\x{FFFD}\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}]"
ALNUM = r"[^\p{L}\p{N}]+"


def visible(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, ALNUM, ""))


def sanity(text: Column) -> Column:
    """QLT01: reasons why a text looks broken; none for a sound one. Null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    n = F.length(visible(text))
    tokens = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), 0)
    single = F.size(F.filter(tokens, lambda x: F.length(x) == 1))
    return F.array_compact(
        F.array(
            F.when(text.rlike(CONTROL), "control"),
            F.when((n >= 20) & (alnum(text) < 0.35 * n), "few letters"),
            F.when((F.size(tokens) >= 10) & (single > 0.5 * F.size(tokens)), "single letters"),
        )
    )


def garbled(text: Column, allowed: str = r".,;:!?()\[\]/%+\-°'\"&") -> Column:
    """QLT02: whether a caption is obviously garbled."""
    n = F.length(visible(text))
    odd = F.length(F.regexp_replace(visible(text), rf"[\p{{L}}\p{{N}}{allowed}]+", ""))
    letters = alnum(text)
    return F.when(F.coalesce(n, F.lit(0)) == 0, False).otherwise(text.rlike(CONTROL) | (letters == 0) | ((n <= 6) & (letters <= 3) & (odd >= 2)) | ((n >= 8) & (odd > 0.35 * n)))


def pages(cells: DataFrame) -> DataFrame:
    """Per page: native and OCR characters and cells, the joined text, and a stand-in parse score."""
    rows = cells.where("document_id is not null and page_no is not null").select("document_id", "page_no", "ordinal", "source_ref", "text", "from_ocr").distinct()
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "source_ref", "text"))), lambda x: x["text"]), " ")
    count = lambda c: F.count_if(c)
    return rows.groupBy("document_id", "page_no").agg(
        ordered.alias("text"),
        count(~F.col("from_ocr")).alias("native_cells"),
        count(F.col("from_ocr")).alias("ocr_cells"),
        F.coalesce(F.sum(F.when(~F.col("from_ocr"), F.length("text"))), F.lit(0)).alias("native_chars"),
        F.coalesce(F.sum(F.when(F.col("from_ocr"), F.length("text"))), F.lit(0)).alias("ocr_chars"),
    )


def page_gate(rows: DataFrame) -> DataFrame:
    """QLT03: reasons against a page and whether it may be used; scores are the shares of native and OCR characters."""
    total = F.col("native_chars") + F.col("ocr_chars")
    native, ocr = F.col("native_chars") / F.greatest(total, F.lit(1)), F.col("ocr_chars") / F.greatest(total, F.lit(1))
    has = F.length(visible(F.col("text"))) > 0
    few = alnum(F.col("text")) < 20
    reasons = F.array_compact(
        F.array(
            F.when(F.size(sanity(F.col("text"))) > 0, "sanity"),
            F.when(has & (F.col("native_cells") > 0) & (native < 0.5), "parse score"),
            F.when(has & (F.col("native_cells") == 0) & ((ocr < 0.75) | (few & (ocr < 0.9))), "ocr score"),
            F.when(~has, "empty page"),
        )
    )
    return rows.select("document_id", "page_no", reasons.alias("reasons"), (F.size(reasons) == 0).alias("eligible"))


def source_kind(rows: DataFrame) -> DataFrame:
    """TBL01: native, OCR, mixed or empty, by characters."""
    kind = F.when((F.col("native_chars") > 0) & (F.col("ocr_chars") > 0), "mixed").when(F.col("native_chars") > 0, "native").when(F.col("ocr_chars") > 0, "ocr").otherwise("empty")
    return rows.select("document_id", "page_no", "native_chars", "ocr_chars", kind.alias("kind"))


def ocr_route(share: Column) -> Column:
    """QLT04: how much of a page is read by OCR."""
    return F.when(share > 0.75, "full").when(share > 0.05, "region").otherwise("native")


def orientation(scores: Column, ink: Column, blank: Column) -> Column:
    """QLT05: decision on a page's rotation from scores of the four angles."""
    ordered = F.sort_array(F.map_values(scores), False)
    best = F.element_at(F.map_keys(F.map_filter(scores, lambda k, v: v == F.element_at(ordered, 1))), 1)
    sure = (F.element_at(ordered, 1) >= 0.9) & (F.element_at(ordered, 1) - F.element_at(ordered, 2) >= 0.15)
    return F.when(blank, "blank").when(ink < 0.002, "low ink").when(~sure, "uncertain").when(best == "0", "upright").otherwise(F.concat(F.lit("rotate "), best))


def boxes(cells: DataFrame) -> DataFrame:
    """Cells with a complete box, each once."""
    return (
        cells.where("document_id is not null and page_no is not null and bbox is not null")
        .select("source_ref", "document_id", "page_no", "from_ocr", "text", F.col("bbox.l").alias("l"), F.col("bbox.t").alias("t"), F.col("bbox.r").alias("r"), F.col("bbox.b").alias("b"))
        .where("l is not null and t is not null and r is not null and b is not null")
        .distinct()
    )


def regions(found: DataFrame, rows: int = 4) -> DataFrame:
    """Bands of a page's envelope, as stand-ins of detected table regions: ``(region_id, document_id, page_no, rl, rt, rr, rb)``."""
    env = found.groupBy("document_id", "page_no").agg(F.min("l").alias("rl"), F.min("t").alias("y0"), F.max("r").alias("rr"), F.max("b").alias("y1"))
    band = env.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    height = (F.col("y1") - F.col("y0")) / rows
    return band.select(F.concat_ws("/", "document_id", "page_no", "k").alias("region_id"), "document_id", "page_no", "rl", (F.col("y0") + F.col("k") * height).alias("rt"), "rr", (F.col("y0") + (F.col("k") + 1) * height).alias("rb"))


def centres_in(found: DataFrame, areas: DataFrame) -> DataFrame:
    """JOI08: cells whose centre lies in a region, edges included."""
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    return found.join(areas, ["document_id", "page_no"]).where((x >= F.col("rl")) & (x <= F.col("rr")) & (y >= F.col("rt")) & (y <= F.col("rb"))).select("source_ref", "region_id", "from_ocr", "text")


def overlaps(found: DataFrame, areas: DataFrame) -> DataFrame:
    """JOI10-JOI12: cells and regions that share positive area, with the share of the cell and the IoU."""
    w = F.least("r", "rr") - F.greatest("l", "rl")
    h = F.least("b", "rb") - F.greatest("t", "rt")
    own, other = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t")), (F.col("rr") - F.col("rl")) * (F.col("rb") - F.col("rt"))
    met = found.join(areas, ["document_id", "page_no"]).where((w > 0) & (h > 0))
    return met.select("source_ref", "region_id", F.round(w * h / own, 6).alias("share"), F.round(w * h / (own + other - w * h), 6).alias("iou"), "text", "from_ocr")


def best_region(met: DataFrame, least: float = 0.2) -> DataFrame:
    """JOI12: each cell's region of the largest share above ``least``."""
    rank = F.row_number().over(Window.partitionBy("source_ref").orderBy(F.desc("share"), "region_id"))
    return met.where(F.col("share") > least).withColumn("i", rank).where("i = 1").select("source_ref", "region_id", "share")


def without_native_overlap(found: DataFrame) -> DataFrame:
    """JOI13: OCR cells that meet no native cell of their page.

    Cells are put into stripes of their page's height, so a page with very many
    cells is compared by stripe and not as a whole.
    """
    stripe = 20.0
    spread = lambda rows: rows.withColumn("s", F.explode(F.sequence(F.floor(F.col("t") / stripe), F.floor(F.greatest("t", "b") / stripe))))
    ocr = spread(found.where("from_ocr"))
    native = spread(found.where("not from_ocr")).select("document_id", "page_no", "s", F.col("l").alias("l2"), F.col("t").alias("t2"), F.col("r").alias("r2"), F.col("b").alias("b2"))
    hit = ocr.join(native, ["document_id", "page_no", "s"]).where((F.least("r", "r2") > F.greatest("l", "l2")) & (F.least("b", "b2") > F.greatest("t", "t2"))).select("source_ref").distinct()
    return found.where("from_ocr").join(hit, "source_ref", "left_anti").select("source_ref")


def owners(inside: DataFrame, found: DataFrame) -> DataFrame:
    """TBL03: number of regions that own each cell, and the decision."""
    counts = inside.groupBy("source_ref").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return found.select("source_ref").join(counts, "source_ref", "left").select("source_ref", n.alias("owners"), F.when(n == 1, "owned").when(n == 0, "dropped").otherwise("rejected").alias("decision"))


def grid_faults(grid: DataFrame, size: DataFrame) -> DataFrame:
    """TBL02, TBL05, SET05: spans outside the grid, coordinates covered twice or not at all.

    ``grid(table_id, cell, r0, r1, c0, c1)`` half open, ``size(table_id, n_rows, n_cols)``.
    """
    spans = grid.join(size, "table_id")
    outside = spans.where("r0 < 0 or c0 < 0 or r1 > n_rows or c1 > n_cols or r1 <= r0 or c1 <= c0").select("table_id", F.lit("outside").alias("fault"), F.col("r0").alias("row"), F.col("c0").alias("col"))
    sound = spans.where("r0 >= 0 and c0 >= 0 and r1 > r0 and c1 > c0")
    taken = sound.withColumn("row", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1))).withColumn("col", F.explode(F.sequence(F.col("c0"), F.col("c1") - 1))).groupBy("table_id", "row", "col").agg(F.count("*").alias("n"))
    twice = taken.where("n > 1").select("table_id", F.lit("overlap").alias("fault"), "row", "col")
    wanted = size.where("n_rows > 0 and n_cols > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1))).select("table_id", "row", "col")
    holes = wanted.join(taken.select("table_id", "row", "col"), ["table_id", "row", "col"], "left_anti").select("table_id", F.lit("hole").alias("fault"), "row", "col")
    return outside.unionByName(twice).unionByName(holes)


def table_markdown(grid: DataFrame) -> DataFrame:
    """TBL06: pipe table of ``grid(table_id, row, col, text)``: the first row is the header."""
    line = F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"\|", "\\\\\\\\|")), " | "), F.lit(" |"))
    rows = grid.groupBy("table_id", "row").agg(line.alias("line"), F.count("*").alias("n"))
    whole = rows.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row", "line", "n"))).alias("xs"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("xs")[0]["n"].cast("int")))
    lines = F.concat(F.array(F.col("xs")[0]["line"], rule), F.transform(F.slice("xs", F.lit(2), F.greatest(F.size("xs") - 1, F.lit(0))), lambda x: x["line"]))
    return whole.select("table_id", F.array_join(lines, "\n").alias("markdown"))


def preferred(met: DataFrame, threshold: float = 0.8) -> DataFrame:
    """LAY01, LAY02: of regions that share most of a cell, the one with the larger share, then the smaller name."""
    return best_region(met, threshold)
