"""Problem 8: token ids of a byte-level BPE vocabulary.

A text is split by the tokenizer's pattern.  Within a part, an Aho-Corasick
automaton over the vocabulary (bytes as Latin-1 characters) gives the longest
token at each position.  Tokens are taken from left to right; a token must be
compatible with the one before it, that is, merging the bytes of the two by
rank gives those two again.  Where none fits, the last token is taken back and
a shorter one tried.  A sequence whose neighbours are all compatible is the one
that the merges give.  Compatibility is remembered, and so are parts.
"""

from __future__ import annotations

import base64
import os

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.rows import map_rows

#: Folder of the public vocabularies; a parameter, as the files are no part of this repository.
VOCABULARIES = os.environ.get("SKEIN_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that this vocabulary's merges assume.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of text; ``parts`` and ``pairs`` bound what is remembered."""

    def __init__(self, path: str, parts: int = 300_000, pairs: int = 1_000_000):
        self.rank: dict[str, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.rank[base64.b64decode(token).decode("latin-1")] = int(rank)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token, len(token))
        self.automaton.make_automaton()
        self.split = regex.compile(PATTERN).findall
        self.parts, self.pairs = parts, pairs
        self.known: dict[str, tuple[int, ...]] = {}
        self.fits: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Tokens by repeated merging of the neighbours of lowest rank; for the few bytes of two tokens."""
        pieces = list(text)
        rank = self.rank
        while len(pieces) > 1:
            best, at = None, -1
            for i in range(len(pieces) - 1):
                r = rank.get(pieces[i] + pieces[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
        return pieces

    def compatible(self, a: str, b: str) -> bool:
        found = self.fits.get((a, b))
        if found is None:
            if len(self.fits) > self.pairs:
                self.fits.clear()
            found = self.fits[a, b] = self.merged(a + b) == [a, b]
        return found

    def tokens(self, part: str) -> list[str]:
        """Tokens of one part, given as Latin-1."""
        if part in self.rank:
            return [part]
        n = len(part)
        longest = [1] * n
        for end, size in self.automaton.iter(part):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        out: list[str] = []
        starts: list[int] = []
        at, size = 0, longest[0]
        dead: set[int] = set()  # positions that no way leads on from
        while at < n:
            while size:
                token = part[at : at + size]
                if token in self.rank and at + size not in dead and (not out or self.compatible(out[-1], token)):
                    break
                size -= 1
            if size:
                out.append(token)
                starts.append(at)
                at += size
                size = longest[at] if at < n else 0
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead.add(at)
                size = len(out.pop()) - 1
                at = starts.pop()
        return out

    def part_ids(self, part: str) -> tuple[int, ...]:
        found = self.known.get(part)
        if found is None:
            found = tuple(self.rank[t] for t in self.tokens(part.encode("utf-8", "replace").decode("latin-1")))
            if len(part) <= 64:
                if len(self.known) > self.parts:
                    self.known.clear()
                self.known[part] = found
        return found

    def ids(self, text: str | None) -> list[int]:
        """Ids of the whole text; none for null and empty texts."""
        out: list[int] = []
        for part in self.split(text) if text else ():
            out.extend(self.part_ids(part))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """One encoder a worker process and vocabulary."""
    path = path or os.path.join(VOCABULARIES, VOCABULARY)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row; null and empty texts give an empty list."""

    def encode(rows):
        e = encoder(path)
        for doc_id, text in rows:
            yield doc_id, e.ids(text)

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), encode, "doc_id long, ids array<int>")


def counted(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tokens) of every row."""

    def count(rows):
        e = encoder(path)
        for doc_id, text in rows:
            yield doc_id, len(e.ids(text))

    return map_rows(documents.select(F.col("doc_id").cast("long"), "text"), count, "doc_id long, tokens int")
