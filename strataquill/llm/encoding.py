"""A corpus as the ids of a public byte-level BPE, contracted by DuckDB (problem 6).

Per partition, texts are split into words; words not seen yet go to DuckDB as
token-position rows. A recursive query joins neighbouring tokens with the merge
table, takes each word's merge of lowest rank, contracts its occurrences from
the left, and repeats until no pair of the word can merge; finished words leave
the recursion. An ordered aggregation gives each word's ids, which the texts
then look up.

Contracting all occurrences of the pair in one step equals one at a time, since
a merge never makes a pair of lower rank than its own; ``merge_table`` proves
that of the vocabulary it loads.

Memory: words are encoded in blocks of at most ``BLOCK_WORDS`` words or
``BLOCK_BYTES`` bytes (a single longer word makes its own block), and a
partition's memory of words is emptied at ``KEPT_WORDS``; neither changes a
result. DuckDB has no folder to spill to. The merge table, bounded by the vocabulary, is read on the driver and
broadcast, so executors need no vocabulary file.

Defined results: an empty and a null text give an empty list; strings of
special tokens are ordinary text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The split of the byte-level vocabularies, with Unicode's white space spelled out.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
BLOCK_WORDS, BLOCK_BYTES, KEPT_WORDS = 20_000, 400_000, 200_000

CONTRACT = """
WITH RECURSIVE t AS (
  SELECT word, pos, tok, true AS live FROM start
  UNION ALL
  SELECT word, pos, CASE WHEN take THEN new ELSE tok END AS tok, best IS NOT NULL AS live
  FROM (
    SELECT *, lag(take, 1, false) OVER (PARTITION BY word ORDER BY pos) AS gone
    FROM (
      SELECT *, hit AND row_number() OVER (PARTITION BY word, island, hit ORDER BY pos) % 2 = 1 AS take
      FROM (
        SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY word ORDER BY pos) AS island
        FROM (
          SELECT *, coalesce(rank = best, false) AS hit
          FROM (
            SELECT a.word, a.pos, a.tok, m.rank, m.new, min(m.rank) OVER (PARTITION BY a.word) AS best
            FROM (SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt FROM t WHERE live) a
            LEFT JOIN merges m ON a.tok = m.l AND a.nxt = m.r))))
  ) WHERE NOT gone
)
SELECT word, list(tok ORDER BY pos) AS ids FROM t WHERE NOT live GROUP BY word
"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def merge_table(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The id of each byte, and merges as rows (left, right, rank, new).

    Vocabularies whose file asks for another treatment of texts are refused.
    """
    file = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    model, split = file["model"], file.get("pre_tokenizer") or {}
    plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if file.get("normalizer") or model.get("type") != "BPE" or not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError("only byte-level BPE without a normalizer, without a prefix blank and with the usual split is encoded")
    ids = model["vocab"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    rows = np.array([(ids[a], ids[b], rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)], np.int32)
    letters = byte_letters()
    made = np.full(rows.max() + 1, -1, np.int64)
    made[rows[::-1, 3]] = rows[::-1, 2]  # the first rank that makes a token
    if (made[rows[:, :2]].max(axis=1) >= rows[:, 2]).any():
        raise ValueError("a merge of this vocabulary ranks below one that makes its parts")
    return np.array([ids[letters[b]] for b in range(256)], np.int32), rows


class WordEncoder:
    """Encodes words in one process; keeps what it has encoded."""

    def __init__(self, byte_ids: np.ndarray, merges: np.ndarray) -> None:
        import duckdb

        self.byte_ids = byte_ids
        self.known: dict[str, list[int]] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
        left, right, rank, new = (pa.array(merges[:, i]) for i in range(4))
        self.db.register("merge_rows", pa.table({"l": left, "r": right, "rank": rank, "new": new}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")

    def _encode(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        sizes = np.array([len(b) for b in raw])
        ends = np.cumsum(sizes)
        start = pa.table(
            {
                "word": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), sizes)),
                "pos": pa.array((np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)).astype(np.int32)),
                "tok": pa.array(self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]),
            }
        )
        self.db.register("start", start)
        for at, ids in self.db.execute(CONTRACT).fetchall():
            self.known[words[at]] = ids
        self.db.unregister("start")

    def learn(self, words: set[str]) -> None:
        block, n = [], 0
        for w in sorted(words, key=len):  # words of like length finish together
            if block and (len(block) >= BLOCK_WORDS or n + 4 * len(w) > BLOCK_BYTES):
                self._encode(block)
                block, n = [], 0
            block.append(w)
            n += 4 * len(w)
        if block:
            self._encode(block)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        split = [WORDS.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)).difference(self.known))
        known = self.known
        return [list(chain.from_iterable([known[w] for w in words])) for words in split]


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, ids)`` of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(merge_table(vocabulary))
    source = documents.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for b in batches:
            encoder = encoder or WordEncoder(*shared.value)
            ids = encoder.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[key, "ids"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, ids array<int>")


def token_letters(vocabulary: str = DEFAULT_VOCABULARY) -> list[tuple[int, str]]:
    """Ids and the letters of their bytes, without special tokens."""
    letters = set(byte_letters().values())
    model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
    return [(i, s) for s, i in model["vocab"].items() if letters.issuperset(s)]


DECODE = "SELECT row, string_agg(letters, '' ORDER BY pos) AS text, count(letters) AS n FROM given LEFT JOIN tokens USING (id) GROUP BY row"


def decode(rows: DataFrame, key: str = "doc_id", ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``(key, text)`` by an ordered aggregation of token letters; an empty or null list gives an empty text, an unknown id fails."""
    shared = rows.sparkSession.sparkContext.broadcast(token_letters(vocabulary))
    source = rows.select(key, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db, back = None, str.maketrans({c: chr(b) for b, c in byte_letters().items()})
        for b in batches:
            if db is None:
                db = duckdb.connect(config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})
                db.register("vocabulary", pa.table({"id": [i for i, _ in shared.value], "letters": [s for _, s in shared.value]}))
                db.execute("CREATE TABLE tokens AS SELECT id::INT AS id, letters FROM vocabulary")
            lists, at, texts = b.column(1), 0, [""] * b.num_rows
            sizes = np.array([len(x) if x else 0 for x in lists.to_pylist()])
            while at < len(sizes):
                # as many texts at a time as hold a block of tokens, one at least
                n, end = int(sizes[at]), at + 1
                while end < len(sizes) and n + sizes[end] <= BLOCK_BYTES:
                    n += int(sizes[end])
                    end += 1
                own = sizes[at:end]
                begins = np.cumsum(own) - own
                pos = np.arange(n) - np.repeat(begins, own)
                flat = lists.slice(at, end - at).flatten()
                db.register("given", pa.table({"row": pa.array(np.repeat(np.arange(at, end), own)), "pos": pa.array(pos), "id": flat.cast(pa.int32())}))
                for row, text, found in db.execute(DECODE).fetchall():
                    if found != sizes[row]:
                        raise ValueError(f"row {row} of a batch holds ids that the vocabulary lacks")
                    texts[row] = text.translate(back).encode("latin-1").decode("utf-8", "replace")
                db.unregister("given")
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return source.mapInArrow(run, f"{key} {dict(source.dtypes)[key]}, text string")
