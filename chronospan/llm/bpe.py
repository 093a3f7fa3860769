"""Byte-level BPE ids of whole texts, from a public vocabulary file.

The vocabulary is the JSON file that the ``tokenizers`` library reads.
``Bpe.ids`` equals that library's ids with ``add_special_tokens=False``: an added
token of the file, such as ``<|endoftext|>``, is one id wherever a text holds its
string. ``Bpe.encode`` takes such a string for ordinary text, as the library does
with ``encode_special_tokens`` on. Words between single blanks never merge with each
other under this pattern, so ids of words are remembered, in a bounded cache,
and a text is mostly a join of remembered pieces.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

#: Words that a cache remembers; those first seen stay, as frequent words are seen early.
CACHE_WORDS = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def printable_bytes() -> dict[str, int]:
    """The vocabulary's sign for each byte: itself if printable Latin-1, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Uneven(Exception):
    """The text has runs of blanks, so it can't be cut at each blank."""


class _Pieces(dict):
    """Ids by word, for words that ``prefix`` stands before."""

    def __init__(self, encoding, prefix: str):
        super().__init__()
        self.encode, self.prefix = encoding.encode_ordinary, prefix
        self.marks = {m: packed(encoding.encode_ordinary(m)) for m in ".,;:!?"}

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Uneven
        stem = word[:-1]
        if word[-1] in self.marks and stem.isalpha():
            ids = self[stem] + self.marks[word[-1]]
        else:
            ids = packed(self.encode(self.prefix + word))
        if len(self) < CACHE_WORDS:
            self[word] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes()


class Bpe:
    def __init__(self, vocabulary: str):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{vocabulary}: added tokens that match more or less than their own string")
        special = {t["content"] for t in added}
        self._added = {t["content"]: packed([t["id"]]) for t in added}
        longest_first = sorted(map(re.escape, self._added), key=len, reverse=True)
        self._split = re.compile(f"({'|'.join(longest_first)})").split if added else lambda text: [text]
        byte_of = printable_bytes()
        ranks = {bytes(map(byte_of.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self._encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._first = _Pieces(self._encoding, "")
        self._later = _Pieces(self._encoding, " ")
        self._newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return packed(self._encoding.encode_ordinary(text))

    def ids(self, text: str) -> bytes:
        """Ids of a text, each added token in it being one id."""
        if not any(token in text for token in self._added):
            return self.encode(text)
        parts = self._split(text)
        return b"".join(self._added[x] if i % 2 else self.encode(x) for i, x in enumerate(parts))

    def encode(self, text: str) -> bytes:
        """Ids of ordinary text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, later = self._first, self._later.__getitem__
        try:
            lines = []
            for line in text.split("\n"):
                head, *rest = line.split(" ")
                lines.append(first[head] + b"".join(map(later, rest)))
            return self._newline.join(lines)
        except _Uneven:
            return self._whole(text)

    def encode_after_blank(self, text: str) -> bytes:
        """Ids of a blank and then ordinary text."""
        head, at, rest = text.partition("\n")
        try:
            first = b"".join(map(self._later.__getitem__, head.split(" ")))
            if not at:
                return first
            lines = [self._first[x] + b"".join(map(self._later.__getitem__, more)) for x, *more in (line.split(" ") for line in rest.split("\n"))]
            return self._newline.join([first, *lines])
        except _Uneven:
            return self._whole(f" {text}")


@lru_cache(maxsize=2)
def load(vocabulary: str) -> Bpe:
    """One tokenizer a Python worker, kept between tasks."""
    return Bpe(vocabulary)
