"""Routing, query processing, evidence, citations, answers, text-to-SQL.

Models are callables; the defaults are deterministic and need no network.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataquill.operators import lexical, relational


def has_any(text: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(text).rlike("|".join(map(re.escape, words))), F.lit(False))


def capability(text: Column) -> Column:
    """RTE01: knowledge, system or unsupported; nothing else."""
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", "unsupported").when(has_any(text, ("who are you", "help", "version")), "system").otherwise("knowledge")


def processed(queries: DataFrame, steps: Sequence[Callable[[DataFrame], DataFrame]] = ()) -> DataFrame:
    """RTE02, RTE08: the queries after each step; unchanged without steps."""
    for step in steps:
        queries = step(queries)
    return queries


def answer_kind(text: Column, label: Column | None = None) -> Column:
    """RTE03, RTE07: list, detail or general; a label that is none of these is general."""
    guess = F.when(has_any(text, ("which", "list", "what are")), "list").when(has_any(text, ("how", "why", "what")), "detail").otherwise("general")
    return guess if label is None else F.when(label.isin("list", "detail", "general"), label).otherwise("general")


def hit_ratio(text: Column, words: Sequence[str]) -> Column:
    """RTE04: share of the words that the text holds."""
    return sum((F.contains(F.lower(text), F.lit(w)).cast("int") for w in words), F.lit(0)) / float(len(words))


def split_k(k: Column) -> Column:
    """RTE05: shares of a combined search: at least one traditional hit, the rest from the graph."""
    first = F.greatest(F.lit(1), F.floor(k / 2).cast("int"))
    return F.struct(first.alias("traditional"), (k - first).alias("graph"))


def keyword_slices(text: Column) -> Column:
    """RTE09: the first three words, then the next three."""
    words = F.filter(F.split(text, " "), lambda x: x != "")
    return F.struct(F.slice(words, 1, 3).alias("entities"), F.slice(words, 4, 3).alias("topics"))


def context(ranked: DataFrame, query: str, text: str, limit: int) -> DataFrame:
    """GEN01: blocks in rank order up to the first that would go beyond the limit; later ones are not tried."""
    w = Window.partitionBy(query).orderBy("rank")
    upto = ranked.withColumn("total", F.sum(F.length(text)).over(w))
    fits = upto.withColumn("over", F.max((F.col("total") > limit).cast("int")).over(w))
    return fits.where("over = 0").groupBy(query).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text))), lambda x: x[text]), "\n\n").alias("context"), F.count("*").alias("blocks"))


def evidence(ranked: DataFrame, query: str, forms: Sequence[str], budget: int) -> DataFrame:
    """GEN02: evidence E1, E2, … in rank order: of each hit the largest form that what is left of the budget holds.

    ``forms`` are text columns from the largest to the smallest; a hit of which
    none fits is dropped, and smaller hits after it may still fit. A query has as
    many hits as its search gives, so they are folded in one array.
    """
    sizes = F.array(*(F.coalesce(F.length(f), F.lit(1 << 30)) for f in forms))
    hits = F.array_sort(F.collect_list(F.struct("rank", "doc_id", sizes.alias("sizes"))))

    def step(acc: Column, h: Column) -> Column:
        fits = F.filter(F.transform(h["sizes"], lambda n, i: F.when(n <= acc["left"], i)), lambda i: i.isNotNull())
        form = F.coalesce(F.get(fits, 0), F.lit(-1))
        left = acc["left"] - F.when(form >= 0, F.get(h["sizes"], form)).otherwise(0)
        return F.struct(left.alias("left"), F.concat(acc["out"], F.array(F.struct(h["rank"].alias("rank"), form.alias("form")))).alias("out"))

    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<rank:bigint,form:int>>").alias("out"))
    chosen = ranked.withColumn("rank", F.col("rank").cast("bigint")).groupBy(query).agg(hits.alias("hits")).select(query, F.explode(F.aggregate("hits", start, step)["out"]).alias("x"))
    kept = chosen.where("x.form >= 0").select(query, F.col("x.rank").alias("rank"), F.col("x.form").alias("form"))
    numbered = kept.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(query).orderBy("rank")).cast("string")))
    content = F.coalesce(*(F.when(F.col("form") == i, F.col(f)) for i, f in enumerate(forms)))
    name = F.coalesce(*(F.when(F.col("form") == i, F.lit(f)) for i, f in enumerate(forms)))
    return numbered.join(ranked, [query, "rank"]).select(query, "evidence_id", "doc_id", name.alias("granularity"), content.alias("content"))


def ladder(hits: DataFrame, asked: str, text: str, around: int = 3) -> DataFrame:
    """GEN02: hits with their forms ``whole``, ``window`` and ``sentence``: the sentence that shares most words with the question, and its neighbours."""
    own = F.array_distinct(lexical.words(F.col(asked)))
    rows = hits.withColumn("_ss", F.filter(F.split(text, r"[.!?]+\s+", -1), lambda x: x.rlike(r"\S"))).withColumn("_own", own)
    scores = F.transform("_ss", lambda x, i: F.struct(F.size(F.array_intersect(F.array_distinct(lexical.words(x)), F.col("_own"))).alias("n"), (-i).alias("i")))
    rows = rows.withColumn("_at", -F.array_max(scores)["i"])
    low = F.greatest(F.col("_at") - around, F.lit(0))
    window = F.array_join(F.slice("_ss", low + 1, F.least(F.col("_at") + around, F.size("_ss") - 1) - low + 1), " ")
    return rows.withColumn("whole", F.col(text)).withColumn("window", F.when(F.size("_ss") > 0, window)).withColumn("sentence", F.get("_ss", F.col("_at"))).drop("_ss", "_own", "_at")


def citations(answers: DataFrame, given: DataFrame, query: str) -> DataFrame:
    """GEN03: cited evidence with its document; unknown ids have none and are marked."""
    cited = answers.select(query, F.explode(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(E\d+)\]"), 1))).alias("evidence_id"))
    return cited.join(given.select(query, "evidence_id", "doc_id"), [query, "evidence_id"], "left").select(query, "evidence_id", "doc_id", F.col("doc_id").isNotNull().alias("known"))


def list_answer(rows: DataFrame, query: str, name: str, shown: int = 3) -> DataFrame:
    """GEN04: distinct names in rank order, the first few and how many more."""
    ordered = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", name))), lambda x: x[name]))
    got = rows.groupBy(query).agg(ordered.alias("names"))
    more = F.size("names") - shown
    return got.select(query, F.concat(F.array_join(F.slice("names", 1, shown), ", "), F.when(more > 0, F.concat(F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.lit(""))).alias("answer"))


def extractive(prompt: str) -> str:
    """Offline generator: the first sentence of the context."""
    return re.split(r"(?<=[.!?。])\s", prompt.strip(), maxsplit=1)[0]


def generate(rows: DataFrame, key: str, prompt: str, model: Callable[[str], str] = extractive, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """GEN05: answers of a pluggable model, tried again with linear pauses; null after the last failure."""
    source = rows.select(key, prompt)

    def ask(p: str | None) -> str | None:
        for i in range(attempts):
            try:
                return None if p is None else model(p)
            except Exception:  # noqa: BLE001
                time.sleep(pause * (i + 1))
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ask(p) for p in b.column(1).to_pylist()], pa.string())], names=[key, "answer"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, answer string")


def structured(text: Column, schema: str) -> Column:
    """GEN06: a model's JSON as a struct; null where it isn't one."""
    return F.from_json(F.regexp_replace(text, r"^\s*```(?:json)?\s*|\s*```\s*$", ""), schema, {"mode": "PERMISSIVE"})


def unfenced(statement: str) -> str:
    """T2S03: a statement without code fences."""
    return re.sub(r"^\s*```(?:sql)?\s*|\s*```\s*$", "", statement, flags=re.I).strip().rstrip(";")


def without_fences(statement: Column) -> Column:
    """T2S03 as a column."""
    bare = F.regexp_replace(statement, r"(?i)^\s*```(?:sql)?\s*|\s*```\s*$", "")
    return F.regexp_replace(F.trim(bare), r";+$", "")


def answer_by_sql(spark: SparkSession, statement: str, repair: Callable[[str, str], str] = lambda s, _: s, attempts: int = 3, limit: int = 100) -> DataFrame:
    """T2S04: the result of a statement, repaired by a pluggable callable after a failure; SELECT only."""
    for left in range(attempts - 1, -1, -1):
        try:
            return relational.guarded_select(spark, unfenced(statement), limit)
        except Exception as e:  # noqa: BLE001
            if not left or "only SELECT" in str(e):
                raise
            statement = repair(statement, str(e))
    raise AssertionError


def nearest_example(questions: DataFrame, examples: DataFrame, k: int = 1) -> DataFrame:
    """T2S02: stored examples by shared words with a question; the examples are joined on words, not all pairs."""
    words = lambda c: F.array_distinct(lexical.words(F.col(c), lexical.STOP_WORDS))
    a = questions.select("query_id", F.explode(words("question")).alias("word"))
    b = examples.select("example_id", F.explode(words("example")).alias("word"))
    scores = a.join(b, "word").groupBy("query_id", "example_id").agg(F.count("*").cast("double").alias("score"))
    return lexical.ranked(scores, "query_id", "example_id", k)
