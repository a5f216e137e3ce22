"""Quality gates, table admission and layout over source_cells, with bands of a page as regions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataquill.operators import quality as op
from strataquill.plans.registry import Registry
from strataquill.session import table

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


CTRL = "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]"
VIS = "regexp_replace({0}, '[\\s\\p{{Z}}\\x{{85}}\\x0B]+', '', 'g')"
ALN = "length(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


def sanity_sql(x):
    tok = f"regexp_extract_all({x}, '[A-Za-z0-9]+')"
    return f"""list_filter([CASE WHEN regexp_matches({x}, '{CTRL}') THEN 'control' END, CASE WHEN length({VIS.format(x)}) >= 20 AND {ALN.format(x)} < 0.35 * length({VIS.format(x)}) THEN 'few letters' END,
CASE WHEN len({tok}) >= 10 AND len(list_filter({tok}, lambda w: length(w) = 1)) > 0.5 * len({tok}) THEN 'single letters' END], lambda r: r IS NOT NULL)"""


PAGES = """cells AS (SELECT DISTINCT document_id, page_no, ordinal, source_ref, text, from_ocr FROM source_cells WHERE document_id IS NOT NULL AND page_no IS NOT NULL),
pages AS (SELECT document_id, page_no, coalesce(string_agg(text, ' ' ORDER BY ordinal NULLS FIRST, source_ref), '') AS text, count(CASE WHEN NOT from_ocr THEN 1 END) AS native_cells, count(CASE WHEN from_ocr THEN 1 END) AS ocr_cells,
  coalesce(sum(CASE WHEN NOT from_ocr THEN length(text) END), 0)::BIGINT AS native_chars, coalesce(sum(CASE WHEN from_ocr THEN length(text) END), 0)::BIGINT AS ocr_chars FROM cells GROUP BY 1, 2)"""
BOXES = """boxes AS (SELECT DISTINCT source_ref, document_id, page_no, from_ocr, text, bbox.l AS l, bbox.t AS t, bbox.r AS r, bbox.b AS b FROM source_cells WHERE document_id IS NOT NULL AND page_no IS NOT NULL AND bbox.l IS NOT NULL AND bbox.t IS NOT NULL AND bbox.r IS NOT NULL AND bbox.b IS NOT NULL),
env AS (SELECT document_id, page_no, min(l) AS x0, min(t) AS y0, max(r) AS x1, max(b) AS y1 FROM boxes GROUP BY 1, 2),
regions AS (SELECT document_id || '/' || page_no || '/' || k AS region_id, document_id, page_no, x0 AS rl, y0 + k * ((y1 - y0) / 4) AS rt, x1 AS rr, y0 + (k + 1) * ((y1 - y0) / 4) AS rb FROM env, range(0, 4) AS r(k)),
inside AS (SELECT source_ref, region_id, from_ocr, text FROM boxes JOIN regions USING (document_id, page_no) WHERE (l + r) / 2 BETWEEN rl AND rr AND (t + b) / 2 BETWEEN rt AND rb),
met AS (SELECT source_ref, region_id, text, from_ocr, round(w * h / own, 6) AS share, round(w * h / (own + other - w * h), 6) AS iou FROM (SELECT *, least(r, rr) - greatest(l, rl) AS w, least(b, rb) - greatest(t, rt) AS h, (r - l) * (b - t) AS own, (rr - rl) * (rb - rt) AS other FROM boxes JOIN regions USING (document_id, page_no)) WHERE w > 0 AND h > 0)"""


def cells(s, d):
    return t(s, d, "source_cells")


def found(s, d):
    return op.boxes(cells(s, d))


def met(s, d):
    b = found(s, d)
    return op.overlaps(b, op.regions(b))


def inside(s, d):
    b = found(s, d)
    return op.centres_in(b, op.regions(b))


@q("qlt01", f"SELECT doc_id, {sanity_sql('text')} AS reasons FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def qlt01(s, d):
    return t(s, d, "documents").select("doc_id", op.sanity(F.col("text")).alias("reasons"))


ODD = "length(regexp_replace(" + VIS + ", '[\\p{{L}}\\p{{N}}.,;:!?()\\[\\]/%+\\-°''\"&]+', '', 'g'))"


@q("qlt02", f"SELECT source_ref, CASE WHEN coalesce(length({VIS.format('text')}), 0) = 0 THEN false ELSE regexp_matches(text, '{CTRL}') OR {ALN.format('text')} = 0 OR (length({VIS.format('text')}) <= 6 AND {ALN.format('text')} <= 3 AND {ODD.format('text')} >= 2) OR (length({VIS.format('text')}) >= 8 AND {ODD.format('text')} > 0.35 * length({VIS.format('text')})) END AS garbled FROM (SELECT DISTINCT source_ref, text FROM source_cells)")
def qlt02(s, d):
    return cells(s, d).select("source_ref", "text").distinct().select("source_ref", op.garbled(F.col("text")).alias("garbled"))


@q("qlt03", f"""WITH {PAGES}, r AS (SELECT document_id, page_no, list_filter([CASE WHEN len({sanity_sql('text')}) > 0 THEN 'sanity' END,
CASE WHEN length({VIS.format('text')}) > 0 AND native_cells > 0 AND native_chars / greatest(native_chars + ocr_chars, 1) < 0.5 THEN 'parse score' END,
CASE WHEN length({VIS.format('text')}) > 0 AND native_cells = 0 AND (ocr_chars / greatest(native_chars + ocr_chars, 1) < 0.75 OR ({ALN.format('text')} < 20 AND ocr_chars / greatest(native_chars + ocr_chars, 1) < 0.9)) THEN 'ocr score' END,
CASE WHEN length({VIS.format('text')}) = 0 THEN 'empty page' END], lambda x: x IS NOT NULL) AS reasons FROM pages) SELECT document_id, page_no, reasons, len(reasons) = 0 AS eligible FROM r""")
def qlt03(s, d):
    return op.page_gate(op.pages(cells(s, d)))


@q("qlt04", f"WITH {PAGES}, x AS (SELECT document_id, page_no, ocr_chars / greatest(native_chars + ocr_chars, 1) AS v FROM pages) SELECT document_id, page_no, CASE WHEN v > 0.75 THEN 'full' WHEN v > 0.05 THEN 'region' ELSE 'native' END AS route FROM x")
def qlt04(s, d):
    share = F.col("ocr_chars") / F.greatest(F.col("native_chars") + F.col("ocr_chars"), F.lit(1))
    return op.pages(cells(s, d)).select("document_id", "page_no", op.ocr_route(share).alias("route"))


SCORES = [(1, {"0": 0.97, "90": 0.01, "180": 0.01, "270": 0.01}, 0.1, False), (2, {"0": 0.5, "90": 0.4, "180": 0.05, "270": 0.05}, 0.1, False), (3, {"0": 0.02, "90": 0.95, "180": 0.02, "270": 0.01}, 0.1, False), (4, {"0": 0.97, "90": 0.01, "180": 0.01, "270": 0.01}, 0.001, False), (5, {"0": 0.97, "90": 0.01, "180": 0.01, "270": 0.01}, 0.1, True)]


@q("qlt05", "SELECT * FROM (VALUES (1, 'upright'), (2, 'uncertain'), (3, 'rotate 90'), (4, 'low ink'), (5, 'blank')) AS v(page_no, decision)")
def qlt05(s, d):
    rows = s.createDataFrame(SCORES, "page_no int, scores map<string,double>, ink double, blank boolean")
    return rows.select("page_no", op.orientation(F.col("scores"), F.col("ink"), F.col("blank")).alias("decision"))


@q("qlt06", f"WITH {PAGES} SELECT document_id, CASE max(CASE WHEN ocr_cells > 0 AND native_cells = 0 THEN 3 WHEN ocr_cells > 0 THEN 2 ELSE 1 END) WHEN 3 THEN 'rejected' WHEN 2 THEN 'doubtful' ELSE 'trusted' END AS decision FROM pages GROUP BY 1")
def qlt06(s, d):
    """The worst decision over a document's pages wins."""
    worst = F.max(F.when((F.col("ocr_cells") > 0) & (F.col("native_cells") == 0), 3).when(F.col("ocr_cells") > 0, 2).otherwise(1))
    return op.pages(cells(s, d)).groupBy("document_id").agg(worst.alias("w")).select("document_id", F.when(F.col("w") == 3, "rejected").when(F.col("w") == 2, "doubtful").otherwise("trusted").alias("decision"))


@q("qlt07", "SELECT document_id, CASE WHEN min(status) IS NULL THEN 1 WHEN max(status <> 'ok') THEN 3 ELSE 0 END AS exit_code FROM quality_reports GROUP BY 1")
def qlt07(s, d):
    return t(s, d, "quality_reports").groupBy("document_id").agg(F.min("status").alias("a"), F.bool_or(F.col("status") != "ok").alias("b")).select("document_id", F.when(F.col("a").isNull(), 1).when(F.col("b"), 3).otherwise(0).alias("exit_code"))


@q("qlt08", f"WITH {BOXES}, u AS (SELECT source_ref FROM inside WHERE region_id LIKE '%/0' UNION SELECT source_ref FROM boxes WHERE text IS NULL OR text = '') SELECT source_ref FROM u EXCEPT SELECT source_ref FROM boxes WHERE starts_with(text, 'Fig')")
def qlt08(s, d):
    """Excluded references: those of the first band and blank ones, but accepted captions."""
    b = found(s, d)
    u = inside(s, d).where("region_id like '%/0'").select("source_ref").unionByName(b.where("text is null or text = ''").select("source_ref")).distinct()
    return u.join(b.where("text like 'Fig%'").select("source_ref"), "source_ref", "left_anti")


@q("qlt09", "SELECT m.id, m.sha256, q.document_id IS NOT NULL AS known FROM (SELECT DISTINCT id, sha256 FROM manifest) m LEFT JOIN (SELECT lower(source_sha256) AS h, min(document_id) AS document_id FROM quality_reports GROUP BY 1) q ON q.h = lower(m.sha256)")
def qlt09(s, d):
    known = t(s, d, "quality_reports").groupBy(F.lower("source_sha256").alias("h")).agg(F.min("document_id").alias("document_id"))
    rows = t(s, d, "manifest").select("id", "sha256").distinct().withColumn("h", F.lower("sha256"))
    return rows.join(known, "h", "left").select("id", "sha256", F.col("document_id").isNotNull().alias("known"))


@q("agg21", f"WITH {BOXES} SELECT document_id, page_no, round(avg(length(text)), 6) AS mean FROM boxes WHERE from_ocr AND source_ref NOT IN (SELECT source_ref FROM inside WHERE region_id LIKE '%/0') GROUP BY 1, 2")
def agg21(s, d):
    """A mean per page over cells outside visual regions."""
    out = inside(s, d).where("region_id like '%/0'").select("source_ref")
    return found(s, d).where("from_ocr").join(out, "source_ref", "left_anti").groupBy("document_id", "page_no").agg(F.round(F.avg(F.length("text")), 6).alias("mean"))


@q("joi08", f"WITH {BOXES} SELECT source_ref, region_id FROM inside")
def joi08(s, d):
    return inside(s, d).select("source_ref", "region_id")


@q("joi10", f"WITH {BOXES} SELECT source_ref, region_id FROM met")
def joi10(s, d):
    return met(s, d).select("source_ref", "region_id")


@q("joi11", f"WITH {BOXES} SELECT source_ref, region_id, share, iou FROM met WHERE iou > 0.8 OR share > 0.8")
def joi11(s, d):
    return met(s, d).where("iou > 0.8 or share > 0.8").select("source_ref", "region_id", "share", "iou")


@q("joi12", f"WITH {BOXES} SELECT source_ref, region_id, share FROM met WHERE share > 0.2 QUALIFY row_number() OVER (PARTITION BY source_ref ORDER BY share DESC, region_id) = 1")
def joi12(s, d):
    return op.best_region(met(s, d))


@q("joi13", f"WITH {BOXES} SELECT source_ref FROM boxes a WHERE from_ocr AND NOT EXISTS (SELECT 1 FROM boxes n WHERE NOT n.from_ocr AND n.document_id = a.document_id AND n.page_no = a.page_no AND least(a.r, n.r) > greatest(a.l, n.l) AND least(a.b, n.b) > greatest(a.t, n.t))")
def joi13(s, d):
    return op.without_native_overlap(found(s, d))


@q("joi09", """WITH a AS (SELECT event_id, user_id, epoch_us(ts) / 1000000 AS x, epoch_us(ts) / 1000000 + value AS y FROM events WHERE event_type = 'click' AND value > 0), b AS (SELECT event_id AS other, user_id, epoch_us(ts) / 1000000 AS x2, epoch_us(ts) / 1000000 + value * 100 AS y2 FROM events WHERE event_type = 'view' AND value > 0)
SELECT event_id, other, round(least(y, y2) - greatest(x, x2), 4) AS overlap FROM a JOIN b USING (user_id) WHERE least(y, y2) > greatest(x, x2) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY round(least(y, y2) - greatest(x, x2), 4) DESC, x2, other) = 1""")
def joi09(s, d):
    """Each segment's partner of the longest overlap; intervals meet by user and by the hours they touch."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    e = t(s, d, "events").where("value > 0")
    hours = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / 3600), F.floor(F.col(y) / 3600))).alias("h")
    a = e.where("event_type = 'click'").select("event_id", "user_id", at.alias("x"), (at + F.col("value")).alias("y"))
    b = e.where("event_type = 'view'").select(F.col("event_id").alias("other"), "user_id", at.alias("x2"), (at + F.col("value") * 100).alias("y2"))
    pairs = a.select("*", hours("x", "y")).join(b.select("*", hours("x2", "y2")), ["user_id", "h"])
    length = F.round(F.least("y", "y2") - F.greatest("x", "x2"), 4)
    hit = pairs.where(F.least("y", "y2") > F.greatest("x", "x2")).select("event_id", "other", "x2", length.alias("overlap")).distinct()
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("overlap"), "x2", "other"))
    return hit.withColumn("i", rank).where("i = 1").select("event_id", "other", "overlap")


@q("tbl01", f"WITH {PAGES} SELECT document_id, page_no, native_chars, ocr_chars, CASE WHEN native_chars > 0 AND ocr_chars > 0 THEN 'mixed' WHEN native_chars > 0 THEN 'native' WHEN ocr_chars > 0 THEN 'ocr' ELSE 'empty' END AS kind FROM pages")
def tbl01(s, d):
    return op.source_kind(op.pages(cells(s, d)))


GRID = "grid AS (SELECT l_orderkey AS table_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS cell, l_linenumber - 1 AS r0, l_linenumber AS r1, l_partkey % 3 AS c0, l_partkey % 3 + 1 + (l_quantity::INT % 2) AS c1 FROM lineitem), size AS (SELECT table_id, max(r1) AS n_rows, 3 AS n_cols FROM grid GROUP BY 1)"
FAULTS = f"WITH {GRID}, taken AS (SELECT table_id, row, col, count(*) AS n FROM (SELECT table_id, unnest(range(r0, r1)) AS row, c0, c1 FROM grid) x, unnest(range(c0, c1)) AS c(col) GROUP BY 1, 2, 3)"


def grid(s, d):
    l = t(s, d, "lineitem")
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    c0 = (F.col("l_partkey") % 3).cast("int")
    return l.select(F.col("l_orderkey").alias("table_id"), i.alias("cell"), (F.col("l_linenumber") - 1).alias("r0"), F.col("l_linenumber").alias("r1"), c0.alias("c0"), (c0 + 1 + F.col("l_quantity").cast("int") % 2).alias("c1"), F.col("l_partkey").cast("string").alias("text"))


def faults(s, d):
    g = grid(s, d)
    return op.grid_faults(g, g.groupBy("table_id").agg(F.max("r1").alias("n_rows")).withColumn("n_cols", F.lit(3)))


@q("tbl02", FAULTS + " SELECT table_id, 'outside' AS fault, r0::BIGINT AS row, c0::BIGINT AS col FROM grid JOIN size USING (table_id) WHERE c1 > n_cols UNION ALL SELECT table_id, 'overlap', row, col FROM taken WHERE n > 1")
def tbl02(s, d):
    return faults(s, d).where("fault <> 'hole'").select("table_id", "fault", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))


@q("tbl05", FAULTS + ", w AS (SELECT table_id, r AS row, c AS col FROM size, unnest(range(0, n_rows)) AS a(r), unnest(range(0, 3)) AS b(c)) SELECT table_id, row::BIGINT AS row, col::BIGINT AS col FROM w ANTI JOIN taken USING (table_id, row, col)")
def tbl05(s, d):
    """Coordinates of a grid that no cell covers."""
    return faults(s, d).where("fault = 'hole'").select("table_id", F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"))


@q("tbl03", f"WITH {BOXES}, n AS (SELECT source_ref, count(*) AS n FROM inside GROUP BY 1) SELECT b.source_ref, coalesce(n, 0) AS owners, CASE WHEN coalesce(n, 0) = 1 THEN 'owned' WHEN coalesce(n, 0) = 0 THEN 'dropped' ELSE 'rejected' END AS decision FROM boxes b LEFT JOIN n USING (source_ref)")
def tbl03(s, d):
    return op.owners(inside(s, d), found(s, d))


@q("tbl04", f"WITH {BOXES} SELECT region_id, count(DISTINCT source_ref) = count(*) AS one_to_one, coalesce(sum(length(text)), 0)::BIGINT AS chars FROM inside GROUP BY 1")
def tbl04(s, d):
    """Conservation: every reference once, and the characters a region holds."""
    return inside(s, d).groupBy("region_id").agg((F.count_distinct("source_ref") == F.count("*")).alias("one_to_one"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))


@q("tbl06", f"WITH {GRID}, x AS (SELECT l_orderkey AS table_id, l_linenumber - 1 AS row, l_partkey::VARCHAR AS text, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) AS col FROM lineitem), r AS (SELECT table_id, row, '| ' || string_agg(text, ' | ' ORDER BY col) || ' |' AS line, count(*) AS n FROM x GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY row) AS i FROM r) SELECT table_id, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '|' || repeat(' --- |', n::INT) ELSE line END, chr(10) ORDER BY row) AS markdown FROM o GROUP BY 1")
def tbl06(s, d):
    col = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_quantity"))
    rows = t(s, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_linenumber") - 1).alias("row"), col.alias("col"), F.col("l_partkey").cast("string").alias("text"))
    return op.table_markdown(rows)


@q("tbl07", "SELECT document_id, (length(markdown) - length(replace(markdown, '<!-- PDF page 1 -->', ''))) / 19 = 1 AS replaced, CASE WHEN (length(markdown) - length(replace(markdown, '<!-- PDF page 1 -->', ''))) / 19 = 1 THEN replace(markdown, '<!-- PDF page 1 -->', '[first page]') ELSE markdown END AS markdown FROM document_md")
def tbl07(s, d):
    """A placeholder that stands exactly once is replaced."""
    mark = "<!-- PDF page 1 -->"
    once = F.size(F.split("markdown", mark, -1)) == 2
    return t(s, d, "document_md").select("document_id", once.alias("replaced"), F.when(once, F.replace("markdown", F.lit(mark), F.lit("[first page]"))).otherwise(F.col("markdown")).alias("markdown"))


@q("tbl08", "SELECT document_id, count(DISTINCT page_no) AS pages, count(DISTINCT page_no) > 1 AS deferred FROM source_cells GROUP BY 1")
def tbl08(s, d):
    return cells(s, d).groupBy("document_id").agg(F.count_distinct("page_no").alias("pages"), (F.count_distinct("page_no") > 1).alias("deferred"))


@q("lay01", f"WITH {BOXES}, th AS (SELECT * FROM (VALUES ('true', 3), ('false', 6)) AS v(k, least)) SELECT source_ref, CASE WHEN length(text) >= least THEN 'kept' ELSE 'orphan' END AS state FROM boxes JOIN th ON th.k = from_ocr::VARCHAR WHERE text IS NOT NULL")
def lay01(s, d):
    """Thresholds per label from a table of two rows; what falls short becomes an orphan."""
    limits = F.when(F.col("from_ocr"), 3).otherwise(6)
    return found(s, d).where("text is not null and from_ocr is not null").select("source_ref", F.when(F.length("text") >= limits, "kept").otherwise("orphan").alias("state"))


@q("lay02", f"WITH {BOXES} SELECT source_ref, region_id, share FROM met WHERE share > 0.8 QUALIFY row_number() OVER (PARTITION BY source_ref ORDER BY share DESC, region_id) = 1")
def lay02(s, d):
    return op.preferred(met(s, d))


@q("lay03", f"WITH {BOXES}, u AS (SELECT source_ref, split_part(region_id, '/', 1) AS uri, sum(share) AS covered FROM met GROUP BY 1, 2) SELECT source_ref, arg_max(uri, (round(covered, 4), uri)) AS uri, round(max(round(covered, 4)), 4) AS covered FROM u WHERE covered > 0.3 GROUP BY 1")
def lay03(s, d):
    """The target with the largest summed coverage above a threshold."""
    sums = met(s, d).withColumn("uri", F.element_at(F.split("region_id", "/"), 1)).groupBy("source_ref", "uri").agg(F.sum("share").alias("covered")).where("covered > 0.3")
    return sums.groupBy("source_ref").agg(F.max_by("uri", F.struct(F.round("covered", 4), F.col("uri"))).alias("uri"), F.max(F.round("covered", 4)).alias("covered"))


@q("lay04", f"WITH {BOXES} SELECT source_ref, row_number() OVER (PARTITION BY document_id, page_no ORDER BY floor(t / 12), l, source_ref) AS i FROM boxes")
def lay04(s, d):
    """Reading order of a page: lines of a fixed height from the top, left to right."""
    w = Window.partitionBy("document_id", "page_no").orderBy(F.floor(F.col("t") / 12), "l", "source_ref")
    return found(s, d).select("source_ref", F.row_number().over(w).cast("bigint").alias("i"))
