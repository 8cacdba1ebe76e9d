"""Problem 5: natural language in comments and string literals.

A span is given the language whose dictionary lets zstandard encode it in the
fewest bytes; a dictionary of code takes part, and a span that it encodes about
as well is none.  Dictionaries are built on the driver from a bounded sample of
labelled texts (``PER_LANGUAGE`` documents a language, ``SAMPLE_CHARS``
characters of each).
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jslex
from skein.functions.rows import map_rows
from skein.llm import prose

LANGUAGES = ("en", "zh", "de", "fr", "es", "ja")
PER_LANGUAGE, SAMPLE_CHARS, PER_CODE = 400, 2000, 200
DICTIONARY, TRAINED_ON, LEVEL, MIN_MATCH, MARGIN = 32_000, 1500, 19, 3, 3
LEAST_WORDS, LEAST_CHARS = 6, 10
EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".vue")
_LATIN = ("en", "de", "fr", "es")


class Coder:
    """Encoded sizes under each dictionary."""

    def __init__(self, texts: dict[str, bytes]):
        self.coders = {}
        for name, data in texts.items():
            if data:
                d = zstandard.ZstdCompressionDict(data)
                how = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, write_checksum=False, write_content_size=False, write_dict_id=False)
                self.coders[name] = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        self.known: dict[str, str | None] = {}

    def sizes(self, text: str, names) -> dict[str, int]:
        data = text.lower().encode("utf-8", "replace")
        return {n: len(self.coders[n].compress(data)) for n in names if n in self.coders}

    def language(self, text: str) -> str | None:
        """The language of a span, or None if it is code or too close to call against code."""
        found = self.known.get(text, 0)
        if found == 0:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[text] = self._language(text)
        return found

    def _language(self, text: str) -> str | None:
        chars = len(prose.CJK.findall(text))
        words = len(prose.words(text))
        candidates = ("zh", "ja") if chars * 2 > words * 3 else _LATIN
        # sizes of natural text only: names of code in a sentence are code in every language
        text = prose.without_code(text).strip()
        sizes = self.sizes(text, (*candidates, "code"))
        code = sizes.pop("code", 1 << 30)
        if not sizes:
            return None
        best = min(sizes, key=lambda n: (sizes[n], n))
        return best if code - sizes.get(best, code) >= MARGIN else None


def normal(lang):
    """A language label in two lower-case letters, as a column."""
    return F.lower(F.regexp_extract(F.trim(lang), r"^([A-Za-z]{2})(?:[-_].*)?$", 1))


def thinned(rows: DataFrame, wanted: int, total: int, text: str = "text") -> DataFrame:
    """Different texts of about ``2 * wanted`` of the ``total`` rows, or of all if there are fewer, chosen by their hash alone, so what is chosen neither depends on partitions nor grows with the rows."""
    return rows.where(F.pmod(F.xxhash64(text), F.lit(max(1, total // (2 * wanted)))) == 0)


def _chosen(rows: list[tuple], wanted: int) -> list[str]:
    """The ``wanted`` texts with the smallest hashes, in the order of the texts."""
    return sorted(t for _, t in sorted(rows)[:wanted])


def train(documents: DataFrame, units: DataFrame) -> dict[str, bytes]:
    """Dictionaries by language, and ``code``, from bounded samples drawn by hash.

    A labelled text is used if its script and its words fit its label; the rest
    are taken for wrong labels.  Code is the text of script files without their
    comments, and literals that are not made of words.
    """
    labelled = documents.select(normal(F.col("lang")).alias("lang"), F.substring("text", 1, SAMPLE_CHARS).alias("text")).where(F.col("lang").isin(*LANGUAGES) & (F.length("text") > 40))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts: dict[str, list[str]] = {n: [] for n in LANGUAGES}
    if counts:
        share = F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, max(1, c // (2 * PER_LANGUAGE)))])
        sample = labelled.where(F.pmod(F.xxhash64("text"), F.element_at(share, F.col("lang")).cast("long")) == 0).distinct()
        by: dict[str, list[tuple]] = {}
        for lang, h, text in map(tuple, sample.select("lang", F.xxhash64("text", F.lit(1)), "text").collect()):
            by.setdefault(lang, []).append((h, text))
        for lang in sorted(by):
            for text in _chosen(by[lang], PER_LANGUAGE):
                chars, kana = len(prose.CJK.findall(text)), len(prose.KANA.findall(text))
                kind = "ja" if kana * 8 > max(chars, 40) else "zh" if chars * 5 > len(text) else "latin"
                if kind == lang or kind == "latin" and lang in _LATIN:
                    texts[lang].extend(x for x in (s.strip() for s in sentences(text)) if x)
    code: list[str] = []
    ending = F.lower(F.regexp_extract("file_path", r"(\.[^./\\]*)$", 1))
    scripts = units.where(F.col("content").isNotNull() & ending.isin(*EXTENSIONS[:4])).select(F.substring("content", 1, SAMPLE_CHARS).alias("text"))
    some = thinned(scripts, PER_CODE, scripts.count()).distinct().select(F.xxhash64("text", F.lit(1)), "text").collect()
    for content in _chosen(list(map(tuple, some)), PER_CODE):
        _, spans, _ = jslex.scan(content)
        code.append(re.sub(r"[ \t]+", " ", jslex.blanked(content, spans)))
        for kind, _, _, text in prose.stretches(spans, content):
            if kind == "literal" and re.search(r"[=<>{}_]|\w-\w*\d|/\w", text) and max(prose.size(text)) < 4:
                code.append(text)
    texts = texts | agreed({n: texts[n] for n in _LATIN})
    made = {n: dictionary(texts[n]) for n in LANGUAGES}
    if made["en"]:
        made["en"] += _NOTICES.lower().encode()  # a dictionary ends with its content, so text can follow
    return made | {"code": dictionary([*code, *_CODE])}


def agreed(texts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Texts whose words, by their rates under each label, speak for the label that they carry: wrong labels are few, so rates outvote them."""
    rates: dict[str, dict[str, float]] = {}
    texts = {n: t for n, t in texts.items() if t}
    seen = {n: Counter(w.lower() for t in texts[n] for w in prose.words(t)) for n in texts}
    size = len(set().union(*seen.values())) or 1
    for n, counts in seen.items():
        total = sum(counts.values()) + 0.5 * size
        rates[n] = {w: math.log((c + 0.5) / total) for w, c in counts.items()} | {"": math.log(0.5 / total)}

    def vote(text: str) -> str:
        found = [w.lower() for w in prose.words(text)]
        return max(texts, key=lambda n: (sum(rates[n].get(w, rates[n][""]) for w in found), n))

    return {n: [t for t in texts[n] if vote(t) == n] for n in texts}


def dictionary(parts: list[str]) -> bytes:
    """A zstandard dictionary with the letter statistics of at most ``TRAINED_ON`` different texts, or their bytes if they are too few to train on."""
    texts = [p.encode("utf-8", "replace") for p in dict.fromkeys(p.lower() for p in parts)]
    if len(texts) > TRAINED_ON:
        step = len(texts) / TRAINED_ON
        texts = [texts[int(i * step)] for i in range(TRAINED_ON)]
    if not texts:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts * 3).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[-DICTIONARY:]


#: Common forms of code in strings and comments.
_CODE = [
    "flex items-center justify-between px-4 py-2 text-sm font-bold bg-gray-100 border rounded-lg hover:bg-blue-500 grid gap-4 w-full h-screen",
    "SELECT id, name, status FROM user_log WHERE type = ? ORDER BY id DESC LIMIT 10; INSERT INTO t (a, b) VALUES (?, ?); UPDATE t SET a = ? WHERE b = ?; DELETE FROM t",
    "eslint-disable-next-line no-unused-vars no-console @ts-ignore prettier-ignore istanbul ignore next webpackChunkName",
    "application/json; charset=utf-8 text/html multipart/form-data https://example.com/api/v1/users?page=1&size=20 ../components/index.js @/utils/request",
]

#: Common English notices at the head of files, which the labelled texts lack.
_NOTICES = """
Copyright (c) the authors. All rights reserved. Licensed under the MIT license. See the LICENSE file in the root directory for license information.
This file was automatically generated from the schema. Code generated by a tool. DO NOT EDIT. Do not edit this file by hand, changes will be lost.
"""

_coders: dict[str, Coder] = {}


def coder_for(texts: dict[str, bytes]) -> Coder:
    """One coder a worker process for equal dictionaries."""
    key = hashlib.sha1(b"".join(n.encode() + b"\0" + texts[n] for n in sorted(texts))).hexdigest()
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(texts)
    return _coders[key]


_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])\s*")


def sentences(text: str) -> list[str]:
    """Sentences of a comment or literal; those of fewer than four words or six ideographs go with the one before."""
    found: list[str] = []
    for s in prose.segments(text):
        begun = len(found)
        for part in _SENTENCE.split(s):
            w, c = prose.size(part)
            if len(found) > begun and w < 4 and c < 6:
                found[-1] += " " + part
            elif part.strip():
                found.append(part)
    return found


def spoken(text: str, coder: Coder) -> dict[str, tuple[int, int]]:
    """Words and ideographs or kana of each language in one comment or literal."""
    if not _MAYBE.search(text):
        return {}
    found: dict[str, list[int]] = {}
    for s in sentences(text):
        w, c = prose.size(s)
        if w < 4 and c < 6:
            continue
        lang = coder.language(s)
        if lang:
            total = found.setdefault(lang, [0, 0])
            total[0] += w
            total[1] += c
    return {n: (w, c) for n, (w, c) in found.items()}


def _enough(lang: str, w: int, c: int) -> bool:
    return c >= LEAST_CHARS if lang in ("zh", "ja") else w >= LEAST_WORDS


#: What any text with six words or ten ideographs or kana matches.
_MAYBE = re.compile(r"(?:[^\W\d_]+[\W\d_]+){5}[^\W\d_]|(?:[㐀-鿿぀-ヿ][^㐀-鿿぀-ヿ]*){10}")


def _spans(content: str, ext: str):
    """(kind, text as read, length in the file) of each comment and literal that may hold a sentence."""
    content = content.removeprefix("﻿")
    for a, b, jsx in jslex.scripts(content, ext):
        part = content[a:b]
        _, spans, _ = jslex.scan(part, jsx)
        for kind, start, end, text in prose.stretches(spans, part):
            if end - start >= 12:
                yield kind, text, end - start


def _scripts_of(units: DataFrame) -> DataFrame:
    ending = F.lower(F.regexp_extract("file_path", r"(\.[^./\\]*)$", 1))
    return units.where(F.col("id").isNotNull() & F.col("content").isNotNull() & F.col("type").isin("file", "component") & ending.isin(*EXTENSIONS)).select("id", ending.alias("ending"), "content")


def found(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, lang) of every language that one comment or literal of a file or component holds a sentence in."""
    texts = train(documents, units)

    def look(rows):
        coder = coder_for(texts)
        for id_, ext, content in rows:
            seen = set()
            for _, text, _ in _spans(content, ext):
                for lang, (w, c) in spoken(text, coder).items():
                    if lang not in seen and _enough(lang, w, c):
                        seen.add(lang)
                        yield id_, lang

    return map_rows(_scripts_of(units), look, "id string, lang string").distinct()


def shares(units: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, lang, spans, chars, share): natural language in each file or component and its share of the content's characters."""
    texts = train(documents, units)

    def look(rows):
        coder = coder_for(texts)
        for id_, ext, content in rows:
            total: dict[str, list[int]] = {}
            for _, text, _ in _spans(content, ext):
                for lang, (w, c) in spoken(text, coder).items():
                    if _enough(lang, w, c):
                        t = total.setdefault(lang, [0, 0])
                        t[0] += 1
                        t[1] += sum(len(s) for s in sentences(text) if coder.language(s) == lang)
            for lang, (spans, chars) in total.items():
                yield id_, lang, spans, chars, chars / len(content)

    return map_rows(_scripts_of(units), look, "id string, lang string, spans int, chars long, share double").dropDuplicates(["id", "lang"])


def function_comments(functions: DataFrame, documents: DataFrame, units: DataFrame) -> DataFrame:
    """(func_id, lang, words, chars) of the sentences in the ``comments`` of functions."""
    texts = train(documents, units)

    def look(rows):
        coder = coder_for(texts)
        for func_id, comments in rows:
            for lang, (w, c) in spoken(comments, coder).items():
                if _enough(lang, w, c):
                    yield func_id, lang, w, c

    read = functions.where("func_id is not null and comments is not null").select(F.col("func_id").cast("long"), "comments")
    return map_rows(read, look, "func_id long, lang string, words int, chars int").dropDuplicates(["func_id", "lang"])
