"""Evaluation passages inside a training corpus (problem 7), as a prefix-filtered set join.

A text leaks an item when it holds ``window`` consecutive words of it (or, for
Chinese and Japanese items, ``cjk_window`` consecutive letters and digits).
Such a window is a set of shingles that must all occur, so one shingle of it is
a sufficient prefix: the one that is rarest in the corpus. The steps:

1. every text is read once; of its shingles those are kept that may occur in an
   item, told by a bit filter of fixed size (``2**filter_bits`` bits) that is
   built from the items; it lets strangers through, never holds back a hit. They
   are counted, and where as many as a window needs stand in a row, their words
   are kept in blocks of at most ``BLOCK`` window starts;
2. the corpus frequency of each item shingle orders the shingles by rarity;
   a window with a shingle that the corpus lacks can't occur and is dropped;
3. each window's rarest shingle is joined with the kept shingles of the texts;
4. length and positional bounds: the window, put where the shingle stands, must
   lie inside the text and begin in the block;
5. the words of what is left are compared one by one, over windows of item size,
   with the kept words, so that the corpus is neither read again nor shuffled.

Words are runs of letters, digits and their marks after compatibility folding;
case, width, punctuation, white space, invisible characters and the composition
of accents don't count.

Defined results: null and empty texts and items give nothing, nor do items that
are shorter than a window; several items of a group count once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataquill.session import cut_lineage

WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
SIGN = regex.compile(r"[\p{L}\p{N}]")
CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
HIDDEN = regex.compile(r"[\p{Cf}\p{Variation_Selector}͏ᅟᅠㅤ]+")
LETTER = regex.compile(r"\p{L}")

#: Words a shingle has, and letters of one for Chinese and Japanese.
SHINGLE, CJK_SHINGLE = 5, 10


def folded(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFKC", HIDDEN.sub("", text)).casefold())


def words_of(text: str) -> list[str]:
    return WORD.findall(folded(text))


def signs_of(text: str) -> list[str]:
    return SIGN.findall(folded(text))


def is_cjk(text: str) -> bool:
    """Whether at least three letters in ten are Chinese or Japanese."""
    return 10 * len(CJK.findall(text)) >= 3 * max(1, len(LETTER.findall(text)))


def shingle_hashes(units: list[str], k: int, cache: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all runs of k units."""
    if len(units) < k:
        return np.empty(0, np.uint64)
    codes = []
    for u in units:
        h = cache.get(u)
        if h is None:
            h = xxhash.xxh3_64_intdigest(u)
            if len(cache) < 200_000:
                cache[u] = h
        codes.append(h)
    a = np.array(codes, np.uint64)
    n = len(a) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ a[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


#: Window starts of a block of kept words.
BLOCK = 256
SHINGLES = "cjk boolean, units int, pos int, shingle bigint"


def _rows(ids: list, texts: list, each, bits: np.ndarray | None, filter_bits: int) -> tuple[list, ...]:
    cache: dict[str, int] = {}
    out: tuple[list, ...] = ([], [], [], [], [])
    for key, text in zip(ids, texts, strict=True):
        if not text:
            continue
        for cjk, units, k in each(text):
            h = shingle_hashes(units, k, cache)
            pos = np.arange(len(h))
            if bits is not None and len(h):
                slot = h >> np.uint64(64 - filter_bits)
                pos = np.flatnonzero(bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            if len(pos):
                n = len(pos)
                for column, values in zip(out, ([key] * n, [cjk] * n, [len(units)] * n, pos.tolist(), h[pos].astype(np.int64).tolist()), strict=True):
                    column.extend(values)
    return out


def _both(text: str) -> Iterator[tuple[bool, list[str], int]]:
    yield False, words_of(text), SHINGLE
    if CJK.search(text):
        yield True, signs_of(text), CJK_SHINGLE


def _own(text: str) -> Iterator[tuple[bool, list[str], int]]:
    if is_cjk(text):
        yield True, signs_of(text), CJK_SHINGLE
    else:
        yield False, words_of(text), SHINGLE


def shingles(rows: DataFrame, key: str, text: str, each, bits=None, filter_bits: int = 0) -> DataFrame:
    """``(key, cjk, units, pos, shingle)``; ``bits`` is a broadcast filter or None."""
    source = rows.select(key, text)
    schema = f"{key} {dict(source.dtypes)[key]}, {SHINGLES}"
    names = [key, "cjk", "units", "pos", "shingle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(0).type
            got = _rows(b.column(0).to_pylist(), b.column(1).to_pylist(), each, None if bits is None else bits.value, filter_bits)
            types = (kind, pa.bool_(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(got, types, strict=True)], names=names)

    return source.mapInArrow(run, schema)


def kept_runs(rows: DataFrame, key: str, text: str, bits, filter_bits: int, needed: dict[bool, int]) -> DataFrame:
    """What of the texts may be of an item: ``(key, cjk, units, start, words, shingles)`` blocks, and ``(cjk, shingles, n)`` counts with a null key.

    A block holds a run of passing shingles from ``start`` on, those of at most
    ``BLOCK`` window starts, and their words. ``needed`` is how many shingles a
    window has.
    """
    source = rows.select(key, text)
    kind = dict(source.dtypes)[key]
    schema = f"{key} {kind}, cjk boolean, units int, start int, words array<string>, shingles array<bigint>, n array<bigint>"
    names = [key, "cjk", "units", "start", "words", "shingles", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, int] = {}
        passing = bits.value
        for b in batches:
            at, out, seen = [], [], {False: [], True: []}
            for row, value in enumerate(b.column(1).to_pylist()):
                if not value:
                    continue
                for cjk, units, k in _both(value):
                    h = shingle_hashes(units, k, cache)
                    if not len(h):
                        continue
                    slot = h >> np.uint64(64 - filter_bits)
                    ok = (passing[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                    if not ok.any():
                        continue
                    seen[cjk].append(h[ok])
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], ok.view(np.int8), [0]))))
                    for first, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
                        n = needed[cjk]
                        for start in range(first, end - n + 1, BLOCK):
                            stop = min(end, start + BLOCK + n - 1)
                            at.append(row)
                            out.append((cjk, len(units), start, units[start : stop + k - 1], h[start:stop].astype(np.int64).tolist(), None))
            keys = b.column(0).take(pa.array(at, pa.int64()))
            for cjk, parts in seen.items():
                if parts:
                    values, counts = np.unique(np.concatenate(parts), return_counts=True)
                    out.append((cjk, None, None, None, values.astype(np.int64).tolist(), counts.tolist()))
            keys = pa.concat_arrays([keys, pa.nulls(len(out) - len(at), keys.type)])
            types = (pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], names=names)

    return source.mapInArrow(run, schema)


def bit_filter(item_shingles: DataFrame, filter_bits: int) -> np.ndarray:
    """Bits of the slots that item shingles fall on; made of at most ``2**filter_bits / 8`` slot rows."""
    slot = F.shiftrightunsigned("shingle", 64 - filter_bits)
    rows = item_shingles.select(slot.alias("slot")).groupBy(F.shiftright("slot", 3).alias("byte")).agg(F.bit_or(F.expr("1 << cast(slot & 7 as int)")).alias("bits"))
    bits = np.zeros(1 << (filter_bits - 3), np.uint8)
    for r in rows.collect():
        bits[r["byte"]] = r["bits"]
    return bits


def leaked(
    documents: DataFrame,
    items: DataFrame,
    doc_key: str = "doc_id",
    text: str = "text",
    item_key: str = "gold_group_id",
    item_text: str = "evidence_text",
    window: int = 12,
    cjk_window: int = 24,
    filter_bits: int = 23,
) -> DataFrame:
    """``(doc_key, item_key)``, each pair once."""
    spark = documents.sparkSession
    own = items.where(f"{item_text} <> '' and {item_key} is not null").select(item_key, item_text).distinct()
    own = own.withColumn("item", F.xxhash64(item_key, item_text))
    item_rows = shingles(own, "item", item_text, _own)
    bits = spark.sparkContext.broadcast(bit_filter(item_rows, filter_bits))
    lengths = {False: window, True: cjk_window}
    needed = {False: window - SHINGLE + 1, True: cjk_window - CJK_SHINGLE + 1}
    seen = cut_lineage(kept_runs(documents.where(F.col(doc_key).isNotNull()), doc_key, text, bits, filter_bits, needed))
    counts = seen.where("n is not null").select("cjk", F.explode(F.arrays_zip("shingles", "n")).alias("x"))
    rarity = counts.groupBy("cjk", F.col("x.shingles").alias("shingle")).agg(F.sum("x.n").alias("freq"))

    rated = item_rows.join(rarity, ["cjk", "shingle"], "left").withColumn("rank", F.struct(F.coalesce("freq", F.lit(0)).alias("freq"), "pos", "shingle"))
    order = Window.partitionBy("item").orderBy("pos")
    prefix = None
    for cjk, n in needed.items():
        part = (
            rated.where(F.col("cjk") if cjk else ~F.col("cjk"))
            .withColumn("rarest", F.min("rank").over(order.rowsBetween(0, n - 1)))
            .where((F.col("pos") + lengths[cjk] <= F.col("units")) & (F.col("rarest.freq") > 0))
            .select("item", "cjk", F.col("rarest.shingle").alias("shingle"), F.col("rarest.pos").alias("item_pos"), F.col("pos").alias("at"))
        )
        prefix = part if prefix is None else prefix.unionByName(part)
    prefix = prefix.groupBy("item", "cjk", "shingle", "item_pos").agg(F.collect_list(F.col("item_pos") - F.col("at")).alias("leads"))  # at most a window's shingles
    blocks = seen.where("words is not null")
    length = F.when(F.col("cjk"), cjk_window).otherwise(window)
    hits = blocks.select(doc_key, "cjk", "units", "start", F.posexplode("shingles").alias("i", "shingle"))
    begins = (
        hits.join(prefix, ["cjk", "shingle"])
        .select(doc_key, "cjk", "units", "start", "i", "item", "item_pos", F.explode("leads").alias("lead"))
        .withColumn("at", F.col("i") - F.col("lead"))
        .where((F.col("at") >= 0) & (F.col("at") < BLOCK) & (F.col("start") + F.col("at") + length <= F.col("units")))
        .select(doc_key, "cjk", "start", "at", "item", (F.col("item_pos") - F.col("lead")).alias("item_at"))
    )
    found = blocks.select(doc_key, "cjk", "start", "words").join(begins, [doc_key, "cjk", "start"]).join(item_words(own, item_text), ["item", "cjk"])
    same = F.slice("words", F.col("at") + 1, length) == F.slice("item_words", F.col("item_at") + 1, length)
    return found.where((F.size(F.slice("words", F.col("at") + 1, length)) == length) & same).select(doc_key, item_key).distinct()


def item_words(own: DataFrame, item_text: str) -> DataFrame:
    """The items with their words, or letters and digits."""
    kinds = dict(own.dtypes)
    names = own.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = [next(iter(_own(t))) for t in b.column(names.index(item_text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in split], pa.bool_()), pa.array([x[1] for x in split], pa.list_(pa.string()))], names=[*names, "cjk", "item_words"])

    return own.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", cjk boolean, item_words array<string>").drop(item_text)
