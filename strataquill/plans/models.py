"""Plug-in stages over the test tables, by their stand-ins."""

from __future__ import annotations

from strataquill.operators import models
from strataquill.plans.registry import Registry
from strataquill.session import table

R = Registry()
t = table


def q(name, sql=None, **types):
    return R.query(name, sql, **types)


LAYOUT = """WITH docs AS (SELECT document_id, string_split(markdown, chr(10)) AS parts FROM document_md WHERE markdown IS NOT NULL),
lined AS (SELECT document_id, (i - 1)::INT AS line_no, parts[i] AS line FROM docs, unnest(range(1, len(parts) + 1)) AS r(i)),
runs AS (SELECT *, line_no - row_number() OVER (PARTITION BY document_id ORDER BY line_no) AS run FROM lined WHERE regexp_matches(line, '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\p{Z}]')),
blocks AS (SELECT document_id, min(line_no) AS start, (max(line_no) + 1)::INT AS "end", arg_min(line, line_no) AS head FROM runs GROUP BY document_id, run)
SELECT document_id, (row_number() OVER (PARTITION BY document_id ORDER BY start) - 1)::INT AS item_no, CASE WHEN regexp_matches(head, '^[\\s\\p{Z}]*#') THEN 'title' WHEN regexp_matches(head, '^[\\s\\p{Z}]*[|]') THEN 'table' WHEN regexp_matches(head, '^[\\s\\p{Z}]*[-*] ') THEN 'list' ELSE 'text' END AS label, start, "end" FROM blocks"""


@q("lay05", LAYOUT)
def lay05(s, d):
    return models.run_stage(t(s, d, "document_md"), "document_id", "markdown", "layout").drop("text")


SPEECH = """WITH a AS (SELECT query_id, unnest(range(1, len(ss) + 1)) AS i, ss FROM (SELECT query_id, string_split(regexp_replace(reference_answer, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM eval_items WHERE reference_answer IS NOT NULL)),
s AS (SELECT query_id, i, trim(ss[i]) AS text, 400 * len(list_filter(regexp_split_to_array(ss[i], '\\s+'), lambda x: x <> '')) AS ms FROM a WHERE trim(ss[i]) <> '')
SELECT query_id, (row_number() OVER w - 1)::INT AS item_no, 'segment' AS label, (sum(ms) OVER w - ms)::INT AS start, (sum(ms) OVER w)::INT AS "end", text FROM s WINDOW w AS (PARTITION BY query_id ORDER BY i)"""


@q("src28", SPEECH)
def src28(s, d):
    return models.run_stage(t(s, d, "eval_items").where("reference_answer is not null"), "query_id", "reference_answer", "speech")
