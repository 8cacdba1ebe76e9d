"""What of a comment or a literal is natural language: lines without marks, tags and code, and their words."""

from __future__ import annotations

import re

_MARK = re.compile(r"^\s*(?:/\*+!?|\*+/|/{2,}!?|\*+(?!/))?\s?|\s*\*+/\s*$")
_TAG = re.compile(r"^\s*[@\\](\w+)\b\s*(?:\{(?:[^{}]|\{[^{}]*\})*\})?\s*")
_TAG_NAME = re.compile(r"^\[?[\w$.]+(?:\s*=\s*[^\]\s]*)?\]?\s*(?:[-–:：]\s*)?")
#: Tags whose text describes the thing itself, and tags that are followed by a name.
DESCRIBING = frozenset("description desc summary brief remarks classdesc overview fileoverview".split())
NAMING = frozenset("param arg argument prop property name function func method class typedef template callback module namespace event fires emits memberof member alias".split())
#: A token of code: a call, a path, a name with inner capitals, digits or underscores, a tag, a link, a placeholder.
CODE_TOKEN = re.compile(
    r"https?://\S+|</?[A-Za-z][^<>\n]*>|\$?\{\{?[^{}\n]*\}?\}|`[^`\n]*`|[\w$.]+\([^()\n]*\)|(?<![\w.])[\w$]+(?:[./\\:#@][\w$-]+)+/?|(?<![\w])[@#./\\$][\w$./-]+|\b[a-zA-Z]+[_$\d][\w$-]*|\b\w*[a-zß-ÿ]\w*[A-Z]\w*(?:-\w+)*|\b\w+(?:-\w+)*-\d\w*|\b\d[\w.:-]*",
)
#: What any token of code holds.
MAYBE_CODE = re.compile(r"[/\\:<{$`(#@_\d]|\.[\w$./-]|\w[A-Z]")
_CODE_LINE = re.compile(
    r"[;{}]\s*$|=>|^\s*(?:const|let|var|import|export|function|async|class)\s+[\w{*$]+.*[=({'\"]|^\s*(?:if|for|while|switch|catch)\s*\(|^\s*return\s+[\w$.]+(?:\(.*\))?\s*;?$|^\s*\}|[=!]==?|&&|\|\||\w\s\+?=\s\S|^\s*[\w$.]+\(.*\)\s*;?\s*$|^\s*(?:SELECT\b.+\bFROM|INSERT\s+INTO|UPDATE\b.+\bSET|DELETE\s+FROM)\b"
)
_DIRECTIVE = re.compile(
    r"^\s*(?:eslint|tslint|jshint|jslint|prettier|istanbul|c8|v8|ts-(?:ignore|nocheck|check|expect-error)|@ts-\w+|webpack\w*:|#\s*(?:region|endregion|source)|(?:end)?region\b|global\s|globals\s|noinspection|stylelint|biome-ignore|flow\b|@flow|vite-ignore|sonar|NOSONAR|use strict|<{7}|={7}|>{7})", re.I
)
#: What marks a notice of licence or authorship.
_NOTICE = re.compile(r"copyright|©|\(c\)\s*\d{4}|\blicen[sc]e[ds]?\b|all rights reserved|spdx|warrant(?:y|ies)|redistribut|\b(?:created|written|maintained|coded|authored) by\b|^\s*authors?\b|permission is hereby|版权|版權|许可证|作者|著作権|ライセンス|urheberrecht|lizenz|alle rechte|droits réservés|\bderechos reservados|\blicencia\b|sous licence|\bautor\b|\bauteur\b", re.I)
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿぀-ヿㇰ-ㇿｦ-ﾝ々〆]")
KANA = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾝ]")
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|(\r\n|[\s\S]))")
_SIMPLE = {"n": "\n", "t": " ", "r": "\n", "b": " ", "v": " ", "f": " ", "0": " ", "\n": "", "\r\n": "", "\r": ""}


def unescape(text: str) -> str:
    """A literal's text with its escapes read as the characters they stand for."""
    if "\\" not in text:
        return text

    def one(m: re.Match) -> str:
        code = m.group(1) or m.group(2) or m.group(3)
        if code:
            n = int(code, 16)
            return chr(n) if n < 0x110000 else " "
        return _SIMPLE.get(m.group(4), m.group(4))

    text = _ESCAPE.sub(one, text)
    if any("\ud800" <= c <= "\udfff" for c in text):
        text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return text


def lines(comment: str) -> list[str]:
    """Lines of a comment without the marks around and before them."""
    return [_MARK.sub("", x).rstrip() for x in re.split(r"\r\n|[\n\r\u2028\u2029]", comment)]


def without_code(line: str) -> str:
    """The line with its tokens of code taken out."""
    return CODE_TOKEN.sub(" ", line) if MAYBE_CODE.search(line) else line


def words(line: str) -> list[str]:
    """Words of alphabetic scripts that are no tokens of code; ideographs and kana are not words."""
    return [w for w in _WORD.findall(CJK.sub(" ", without_code(line))) if len(w) > 1 or w.lower() in ("a", "i", "à", "y", "e", "o", "ô")]


def size(line: str) -> tuple[int, int]:
    """Words and ideographs or kana of a line, tokens of code apart."""
    rest = without_code(line)
    n = len(CJK.findall(rest))
    return len(words(line)), n


def segments(comment: str) -> list[str]:
    """Pieces of a comment to be judged by themselves.

    A line of six words, or ten ideographs or kana, is a piece; shorter lines
    that follow each other are joined, as a sentence may be wrapped.  Lines of
    tags keep only what follows the tag's type and name and are never joined.
    Lines of code and directives are left out.
    """
    found: list[str] = []
    open_line: list[str] = []

    def close() -> None:
        if open_line:
            found.append(" ".join(open_line))
            open_line.clear()

    for line in lines(comment):
        if not line.strip() or _DIRECTIVE.match(line):
            close()
            continue
        tag = _TAG.match(line)
        if tag:
            close()
            rest = line[tag.end() :]
            if tag.group(1).lower() in NAMING:
                rest = _TAG_NAME.sub("", rest, count=1)
            if rest.strip() and not _CODE_LINE.search(rest):
                found.append(rest)
            continue
        if _CODE_LINE.search(line):
            close()
            continue
        w, c = size(line)
        if w >= 6 or c >= 10:
            if open_line and line[:1].islower() and not c:
                open_line.append(line)
                close()
            else:
                close()
                found.append(line)
        else:
            if found and not open_line and line[:1].islower() and not re.search(r"[.!?:;]\s*$", found[-1]):
                found[-1] += " " + line
            else:
                open_line.append(line)
    close()
    return found


def name_parts(name: str) -> set[str]:
    """Lower-case words that a name in camel case is made of."""
    return {p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name or "")}


#: Words that add nothing to a name that they accompany.
_FILLER = frozenset("the a an this of for to function method helper handler util utility hook component returns return".split())


def description(comment: str | None, name: str) -> tuple[str, int, int]:
    """Prose of a documentation about what the function does: its text, words and ideographs or kana.

    Left out: tags (but for those that describe), the function's own name and
    signature, directives, code, notices of licence or authorship, and lines
    that only repeat the parts of the name.
    """
    kept: list[str] = []
    in_tag = False
    for line in lines(comment or ""):
        if not line.strip():
            in_tag = False
            continue
        if _DIRECTIVE.match(line):
            continue
        tag = _TAG.match(line)
        if tag:
            in_tag = tag.group(1).lower() not in DESCRIBING
            if in_tag:
                continue
            line = line[tag.end() :]
        elif in_tag and line[:1].isspace():
            continue
        if _NOTICE.search(line) or _CODE_LINE.search(line):
            continue
        if name and name in line:
            line = re.sub(rf"(?<![\w$]){re.escape(name)}(?![\w$])\s*(?:\([^()]*\))?\s*[:：\-–—]?", " ", line)
        w = {x.lower() for x in words(line)}
        if w and not CJK.search(line) and w <= name_parts(name) | _FILLER:
            continue
        if line.strip():
            kept.append(line.strip())
    w = c = 0
    for line in kept:
        a, b = size(line)
        w, c = w + a, c + b
    return "\n".join(kept), w, c


def is_description(comment: str | None, name: str, least_words: int = 6, least_chars: int = 10) -> bool:
    _, w, c = description(comment, name)
    return w >= least_words or c >= least_chars


def stretches(spans: list, text: str) -> list[tuple[str, int, int, str]]:
    """Comments, adjacent line comments as one, and literals: (kind, start, end, text as read)."""
    found: list[tuple[str, int, int, str]] = []
    i, n = 0, len(spans)
    while i < n:
        s = spans[i]
        if s.kind == "//":
            end = s.end
            parts = [text[s.start : s.end]]
            while i + 1 < n and spans[i + 1].kind == "//":
                between = text[end : spans[i + 1].start]
                if between.strip() or between.replace("\r\n", "\n").count("\n") + between.replace("\r\n", "").count("\r") != 1:
                    break
                i += 1
                end = spans[i].end
                parts.append(text[spans[i].start : end])
            found.append(("comment", s.start, end, "\n".join(parts)))
        elif s.kind == "/*":
            found.append(("comment", s.start, s.end, text[s.start : s.end]))
        elif s.kind == "r":
            pass
        elif s.kind == "`":
            found.append(("literal", s.start, s.end, unescape(" ".join(text[a:b] for a, b in s.parts))))
        else:
            body = text[s.start + 1 : s.end]
            if body.endswith(text[s.start]):
                body = body[:-1]
            found.append(("literal", s.start, s.end, body if s.kind == "<" else unescape(body)))
        i += 1
    return found
