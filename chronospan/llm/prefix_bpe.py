"""BPE encoding by dynamic programming over prefixes, and decoding (operator 11).

A sequence of tokens is the BPE encoding of their string exactly when each token
encodes to itself and no merge would cross the border of any two neighbours. So
the last token of every prefix of a word is unique: of the vocabulary's tokens
that end there, found by a suffix automaton, the one whose predecessor, the last
token of the prefix before it, is compatible with it. Back-pointers from the end of
the word give its ids. The time is linear in the word, however long, as the work
at a place depends on the vocabulary alone.

The vocabulary is the JSON file that the ``tokenizers`` library reads; added
tokens, normalisation and the cut into words are as that library does them with
``add_special_tokens=False``. Text of plain Latin letters and signs, which are their
own composed forms, is put in lower case and cut by the vocabulary's own pattern;
other text is cut at ASCII blanks, which normalisation neither composes nor cuts
across, and left to the library. What stands between blanks is remembered, in a bounded cache.

Defined results: null and empty text, and text of blanks alone, have no ids and
decode to an empty text; equal rows give equal rows; empty input gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import packed, printable_bytes

#: Words that a worker's cache remembers, and the longest of them; those first seen stay.
CACHE_WORDS, CACHE_CHARS = 700_000, 32
#: A character that is not plain: neither a blank, printable ASCII nor a letter or sign of the first Latin blocks.
NOT_PLAIN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u024f]")
#: Pairs of tokens whose compatibility is remembered.
CACHE_PAIRS = 1 << 20
#: Rows of a batch that a task holds as ids and decoded texts at once.
SLICE = 256


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merges:
    """Merges of pairs of token ids, each token but the base ones made by one merge of its parts.

    ``made`` maps (left, right) to (rank, token). A token's rank is the time of its
    making; every merge must come after the merges that make its parts.
    """

    def __init__(self, made: dict[tuple[int, int], tuple[int, int]]):
        self.made = made
        self.parts = {token: pair for pair, (_, token) in made.items()}
        self.rank = {token: rank for rank, token in made.values()}
        if len(self.parts) != len(made):
            raise ValueError("a token is the result of two merges")
        if any(self.rank.get(x, -1) >= rank for pair, (rank, _) in made.items() for x in pair):
            raise ValueError("a merge comes before the merge of one of its parts")
        self.known: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stood at this side (0 left, 1 right) of the token's string while it was built, and the rank of the merge that took each up."""
        found, taken = [(token, float("inf"))], float("inf")
        while token in self.parts:
            taken, token = self.rank[token], self.parts[token][side]
            found.append((token, taken))
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b: one would if two tokens that face each other merge before either is taken up.

        Of equal merges the leftmost comes first, so a merge within ``a`` wins a tie and one within ``b`` loses it.
        """
        known = self.known.get(a << 32 | b)
        if known is None:
            rights = self.edge(b, 0)
            known = not any(
                (found := self.made.get((x, y))) and found[0] < x_taken and found[0] <= y_taken for x, x_taken in self.edge(a, 1) for y, y_taken in rights
            )
            if len(self.known) >= CACHE_PAIRS:
                self.known.clear()
            self.known[a << 32 | b] = known
        return known


def plain_pattern(spec: dict) -> str | None:
    """The pattern of words of a vocabulary that puts text in composed lower case and drops what is between words; None for other kinds."""
    steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if steps != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, signs = cuts
    blanks = spec["normalizer"]["normalizers"][1]
    plain = blanks["pattern"] == {"Regex": "\\s+"} and blanks["content"] == " " and split["behavior"] == "Removed" and split["invert"] and not signs["use_regex"] and not signs["add_prefix_space"]
    return split["pattern"].get("Regex") if plain else None


def merged(ids: list[int], made: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """BPE by its definition: the merge of least rank, leftmost first, until there is none. Slow; for single tokens and tests."""
    ids = list(ids)
    while True:
        best = min(((made[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in made), default=None)
        if best is None:
            return ids
        i = best[1]
        ids[i : i + 2] = [made[ids[i], ids[i + 1]][1]]


class PrefixBpe:
    def __init__(self, vocabulary: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(vocabulary, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError(f"{vocabulary}: a kind of model that this encoder does not know")
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{vocabulary}: added tokens that match more or less than their own string")
        library = Tokenizer.from_file(vocabulary)
        self._normal = library.normalizer.normalize_str if library.normalizer else str
        self._cut = library.pre_tokenizer.pre_tokenize_str
        pattern = plain_pattern(spec)
        self._plain = regex.compile(pattern).findall if pattern else None
        self._sign_of = {b: c for c, b in printable_bytes().items()}
        self._end = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in added}
        self._added = {t["content"]: t["id"] for t in added}
        self._split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self._added, key=len, reverse=True))).split if added else None
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)})
        base = {i: self._signs(t) for t, i in vocab.items() if i not in self.merges.parts and t not in self._added}
        self.base = {s: i for i, s in base.items() if len(s) == 1}
        self._automaton, self._length = ahocorasick.Automaton(), {}
        for token, signs in ({i: self._signs(self.tokens[i]) for i in self.merges.parts} | {i: s for s, i in self.base.items()}).items():
            if merged([self.base[s] for s in signs], self.merges.made) == [token]:
                self._automaton.add_word(signs, (token, len(signs)))
                self._length[token] = len(signs)
        self._automaton.make_automaton()
        self._known: dict[str, bytes] = {}

    def _signs(self, token: str) -> str:
        """One sign a symbol: a last symbol with the end-of-word mark is another sign than the plain one."""
        if self._end and token.endswith(self._end) and token != self._end:
            return self._closed(token[: -len(self._end)])
        return token

    def _closed(self, word: str) -> str:
        return word[:-1] + chr(0xF0000 + ord(word[-1])) if self._end else word

    def last_tokens(self, signs: str) -> list[int | None]:
        """The last token of the encoding of every prefix, by its end."""
        last: list[int | None] = [None] * len(signs)
        known, fits = self.merges.known, self.merges.compatible
        for end, (token, n) in self._automaton.iter(signs):
            if last[end] is None:
                if n > end:
                    last[end] = token
                elif (before := last[end - n]) is not None:
                    fit = known.get(before << 32 | token)
                    if fits(before, token) if fit is None else fit:
                        last[end] = token
        return last

    def word(self, signs: str) -> list[int]:
        """Ids of a word of base signs, the last one closed."""
        last, ids, at, length = self.last_tokens(signs), [], len(signs) - 1, self._length
        while at >= 0:
            token = last[at]
            if token is None:
                raise ValueError(f"no token ends at {at} of {signs[:80]!r}")
            ids.append(token)
            at -= length[token]
        return ids[::-1]

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk of plain lower-case text without blanks."""
        ids, sign, get = [], self._sign_of, self._known.get
        for word in self._plain(chunk):
            found = get(word)
            if found is None:
                found = packed(self.word(self._closed(word if word.isascii() else "".join([sign[b] for b in word.encode()]))))
                self._keep(word, found)
            ids.append(found)
        whole = b"".join(ids)
        self._keep(chunk, whole)
        return whole

    def _keep(self, chunk: str, ids: bytes) -> None:
        if len(chunk) <= CACHE_CHARS and len(self._known) < CACHE_WORDS:
            self._known[chunk] = ids

    def _part(self, part: str) -> bytes:
        """Ids of a text without added tokens."""
        if self._plain and not NOT_PLAIN.search(part):
            get, new = self._known.get, self._new
            return b"".join([get(chunk) or new(chunk) for chunk in part.lower().split()])
        words = [w for chunk in re.split("[ \n]+", part) if chunk for w, _ in self._cut(self._normal(chunk))]
        return b"".join(packed(self.word(self._closed(w))) for w in words)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings with blanks between, as a vocabulary without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, ids))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not any(t in text for t in self._added):
            return self._part(text)
        return b"".join(packed([self._added[x]]) if x in self._added else self._part(x) for x in self._split(text) if x)


@lru_cache(maxsize=2)
def load(vocabulary: str) -> PrefixBpe:
    """One tokenizer a Python worker, kept between tasks."""
    return PrefixBpe(vocabulary)


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, decoded) of all documents: ids packed as little-endian unsigned 32-bit integers, and the text decoded from them."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [bpe.encode(text or "") for text in part.column(1).to_pylist()]
                decoded = [bpe.decode(memoryview(x).cast("I")) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what ``encode`` returns."""
    n = (F.length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
