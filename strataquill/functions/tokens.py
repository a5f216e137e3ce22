"""Token counts and offsets by a public tokenizer file."""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def vocabulary_text(path: str = DEFAULT_VOCABULARY) -> str:
    """The file's content, which is bounded by the vocabulary; executors get it by value."""
    return Path(path).read_text(encoding="utf-8")


class TokenCount:
    """``len`` by tokens, without special tokens or truncation; their strings are ordinary text."""

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        self.known = lru_cache(maxsize=4_096)(self._count)

    def _count(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __call__(self, text: str) -> int:
        return self.known(text) if len(text) < 1_000 else self._count(text)

    def offsets(self, text: str) -> list[tuple[int, int]]:
        """Code point spans of the tokens."""
        return self.tokenizer.encode(text, add_special_tokens=False).offsets


@lru_cache(maxsize=2)
def counter(vocabulary: str) -> TokenCount:
    """One tokenizer a process and vocabulary."""
    return TokenCount(vocabulary)
