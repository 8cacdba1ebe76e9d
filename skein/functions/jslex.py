"""Lexical scanner for JavaScript, TypeScript and JSX text.

``scan`` finds comments, string literals, template literals and regular
expressions in one pass and returns a *masked* text in which each of them is
replaced by a short mark, so that later steps see code only.  The text is read
to its end whatever it holds: what is not closed runs to the end (comments and
templates) or to the end of the line (strings), and the mark ``BAD`` is left.

Marks in the masked text (all are characters that no source token starts with):

====== ==========================================
``""`` string literal
\\x01 \\x02 template literal, \\x03 \\x04 a substitution inside one
\\x05 \\x06 expression container inside a JSX element
\\x07 \\x08 JSX element
\\x0e  regular expression
\\x00  ``BAD``: something that no dialect accepts
====== ==========================================
"""

from __future__ import annotations

import re
from typing import NamedTuple

BAD, TPL, TPL_END, SUB, SUB_END, BOX, BOX_END, ELEM, ELEM_END, REGEX = "\x00", "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07", "\x08", "\x0e"

_LITERALS = r"//[^\n\r  ]*|/\*[\s\S]*?(?:\*/|\Z)|\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*|`|/"
_PLAIN = re.compile(_LITERALS)
_NESTED = re.compile(_LITERALS + r"|[{}]")
_PLAIN_JSX = re.compile(_LITERALS + r"|<(?=[A-Za-z_$>])")
_NESTED_JSX = re.compile(_LITERALS + r"|[{}]|<(?=[A-Za-z_$>])")
_QUASI = re.compile(r"(?:[^`\\$]+|\\[\s\S]|\$(?!\{))*")
_REGEX = re.compile(r"/(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_WORD_END = re.compile(r"[\w$]+$")
_NAME = re.compile(r"[A-Za-z_$][\w$]*(?:-[\w$]*)*(?:[.:][A-Za-z_$][\w$-]*)*")
_SPACE = re.compile(r"\s*")
_JSX_TEXT = re.compile(r"[^<{>}]*")
_NEWLINE = re.compile(r"[\n\r  ]")
#: Fixed values of the language: words after which an operand, so a regular expression or an element, follows.
OPERAND_AFTER = frozenset("return typeof case in of delete void throw new do else instanceof yield await default".split())


class Span(NamedTuple):
    """kind: ``//``, ``/*``, ``'``, ``"``, a backtick, ``<`` (text of an attribute) or ``r`` (regular expression); parts: text ranges of a template."""

    kind: str
    start: int
    end: int
    parts: tuple = ()


def _operand_next(out: list[str], text: str, at: int) -> bool:
    """Whether an operand, not an operator, is due after the masked text so far."""
    for i in range(len(out) - 1, -1, -1):
        piece = out[i].rstrip()
        if not piece:
            continue
        last = piece[-1]
        if last.isalnum() or last in "_$" or last > "\x7f":
            word = _WORD_END.search(piece)
            if word is None:
                return False
            before = piece[: word.start()].rstrip()
            return word.group() in OPERAND_AFTER and not before.endswith(".")
        if last in (TPL_END, ELEM_END, REGEX, BAD, '"', "]"):
            return False
        if last == ")":
            return _after_condition(out, i)
        if last == "}":
            return "\n" in out[i][len(piece) :] or i < len(out) - 1 and "\n" in "".join(out[i + 1 :])
        if piece.endswith(("++", "--")):
            return False
        return True
    return True


def _after_condition(out: list[str], i: int) -> bool:
    """Whether the parenthesis that ends the piece ``out[i]`` is the head of if, while, for or with."""
    depth = 0
    while i >= 0:
        piece = out[i]
        for at in range(len(piece) - 1, -1, -1):
            if piece[at] == ")":
                depth += 1
            elif piece[at] == "(":
                depth -= 1
                if not depth:
                    before = piece[max(0, at - 16) : at]
                    if len(before) < 16:
                        before = "".join(out[max(0, i - 4) : i])[-16:] + before
                    return bool(_CONDITION.search(before))
        i -= 1
    return False


_CONDITION = re.compile(r"(?<![\w$.])(?:if|while|for|with)\s*$")


def scan(text: str, jsx: bool = False, places: list | None = None) -> tuple[str, list[Span], bool]:
    """Masked text, spans in order of their start, and whether every literal is closed.

    ``places``, if given, is filled with (position in the masked text, position
    in the text) of every piece of code, in order.
    """
    out: list[str] = []
    spans: list[Span] = []
    ok = True
    pos, n = 0, len(text)
    stack: list[list] = []  # frames: ["sub", depth, start, parts], ["box", depth], ["elem", name]
    if text.startswith("#!"):
        end = text.find("\n")
        pos = n if end < 0 else end
        spans.append(Span("//", 0, pos))
    plain, nested = (_PLAIN_JSX, _NESTED_JSX) if jsx else (_PLAIN, _NESTED)
    add = out.append

    def copy(piece: str, at: int) -> None:
        if places is not None:
            places.append((len(out), at))
        add(piece)

    def quasi(at: int, start: int, parts: list) -> tuple[int, bool]:
        """Reads template text from ``at``; the new position, and whether code of a substitution follows."""
        nonlocal ok
        m = _QUASI.match(text, at)
        end = m.end()
        if end > at:
            parts.append((at, end))
        if end >= n:
            ok = False
            add(BAD)
            spans.append(Span("`", start, n, tuple(parts)))
            return n, False
        if text[end] == "`":
            add(TPL_END)
            spans.append(Span("`", start, end + 1, tuple(parts)))
            return end + 1, False
        add(SUB)
        stack.append(["sub", 0, start, parts])
        return end + 2, True

    def children(at: int) -> int:
        """Reads JSX children from ``at`` up to a container or to the end of the outermost element."""
        nonlocal ok
        while True:
            end = _JSX_TEXT.match(text, at).end()
            if end >= n:
                ok = False
                add(BAD)
                return n
            c = text[end]
            if c in ">}":
                ok = False
                add(BAD)
                at = end + 1
            elif c == "{":
                add(BOX)
                stack.append(["box", 0])
                return end + 1
            elif text.startswith("</", end):
                at = _SPACE.match(text, end + 2).end()
                m = _NAME.match(text, at)
                name = m.group() if m else ""
                at = _SPACE.match(text, m.end() if m else at).end()
                frame = stack.pop()
                if at >= n or text[at] != ">" or frame[1] != name:
                    ok = False
                    add(BAD)
                at += 1
                add(ELEM_END)
                if not (stack and stack[-1][0] == "elem"):
                    return min(at, n)
            else:
                at, opened = tag(end)
                if opened is None:  # stopped at a container in an attribute
                    return at
                if not opened and not (stack and stack[-1][0] == "elem"):
                    return at

    def tag(at: int) -> tuple[int, bool | None]:
        """Reads an opening tag from its ``<``."""
        add(ELEM)
        at = _SPACE.match(text, at + 1).end()
        m = _NAME.match(text, at)
        stack.append(["elem", m.group() if m else "", False])
        return attributes(m.end() if m else at)

    def attributes(at: int) -> tuple[int, bool | None]:
        """Reads attributes: True, an element is open; False, it was self-closing; None, a container begins."""
        nonlocal ok
        while True:
            at = _SPACE.match(text, at).end()
            if at >= n:
                ok = False
                add(BAD)
                stack.pop()
                return n, False
            c = text[at]
            if c == ">":
                stack[-1][2] = True
                return at + 1, True
            if text.startswith("/>", at):
                stack.pop()
                add(ELEM_END)
                return at + 2, False
            if c == "{":
                add(BOX)
                stack.append(["box", 0])
                return at + 1, None
            if text.startswith("//", at):
                end = _NEWLINE.search(text, at)
                end = end.start() if end else n
                spans.append(Span("//", at, end))
                at = end
            elif text.startswith("/*", at):
                end = text.find("*/", at + 2)
                end = n if end < 0 else end + 2
                spans.append(Span("/*", at, end))
                at = end
            elif c in "\"'":
                end = text.find(c, at + 1)
                if end < 0:
                    ok = False
                    end = n
                spans.append(Span("<", at, min(n, end + 1)))
                at = end + 1
            elif c == "=":
                at += 1
            elif m := _NAME.match(text, at):
                at = m.end()
            else:
                ok = False
                add(BAD)
                at += 1

    def resume(at: int) -> int:
        """Goes on inside the innermost element, after a container has been closed."""
        opened: bool | None = True
        if not stack[-1][2]:
            at, opened = attributes(at)
        if opened is None:
            return at
        if opened or stack and stack[-1][0] == "elem":
            return children(at)
        return at

    while pos < n:
        m = (nested if stack else plain).search(text, pos)
        if m is None:
            break
        at = m.start()
        if at > pos:
            copy(text[pos:at], pos)
        found = m.group()
        c = found[0]
        pos = m.end()
        if c == "/":
            if found[1:2] == "/":
                spans.append(Span("//", at, pos))
                add(" ")
            elif found[1:2] == "*":
                spans.append(Span("/*", at, pos))
                add("\n" if _NEWLINE.search(found) else " ")
                if len(found) < 4 or not found.endswith("*/"):
                    ok = False
                    add(BAD)
            else:
                r = _REGEX.match(text, at)
                if r is not None and _operand_next(out, text, at):
                    add(REGEX)
                    pos = r.end()
                    spans.append(Span("r", at, pos))
                else:
                    copy("/", at)
        elif c in "\"'":
            if text[pos : pos + 1] == c:
                pos += 1
                add('""')
            else:
                ok = False
                add('""' + BAD)
            spans.append(Span(c, at, pos))
        elif c == "`":
            add(TPL)
            pos, _ = quasi(pos, at, [])
        elif c == "{":
            stack[-1][1] += 1
            copy("{", at)
        elif c == "}":
            top = stack[-1]
            if top[1] > 0:
                top[1] -= 1
                copy("}", at)
            else:
                stack.pop()
                if top[0] == "sub":
                    add(SUB_END)
                    pos, _ = quasi(pos, top[2], top[3])
                else:
                    add(BOX_END)
                    pos = resume(pos)
        elif _operand_next(out, text, at):  # "<"
            pos, opened = tag(at)
            if opened:
                pos = children(pos)
        else:
            copy("<", at)
    if pos < n:
        copy(text[pos:], pos)
    if stack:
        ok = False
        add(BAD)
        for top in reversed(stack):
            if top[0] == "sub":
                spans.append(Span("`", top[2], n, tuple(top[3])))
    spans.sort(key=lambda s: s.start)
    if places:
        before = [0]
        for piece in out:
            before.append(before[-1] + len(piece))
        places[:] = [(before[i], at) for i, at in places]
    return "".join(out), spans, ok


def blanked(text: str, spans: list[Span]) -> str:
    """The text with everything inside comments and literals as blanks; positions and line ends stay."""
    ranges: list[tuple[int, int]] = []
    for s in spans:
        if s.kind == "`":
            ranges.append((s.start, s.start + 1))
            ranges.extend(s.parts)
            if text[s.end - 1 : s.end] == "`":
                ranges.append((s.end - 1, s.end))
        else:
            ranges.append((s.start, s.end))
    ranges.sort()
    out: list[str] = []
    at = 0
    for a, b in ranges:
        if a < at:
            continue
        out.append(text[at:a])
        piece = text[a:b]
        out.append(_NOT_BREAK.sub(" ", piece) if "\n" in piece or "\r" in piece else " " * (b - a))
        at = b
    out.append(text[at:])
    return "".join(out)


_NOT_BREAK = re.compile(r"[^\n\r]")
_BLOCK = re.compile(r"<(script|template)((?:\s+[\w:@.#-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*)\s*(/?)>", re.I)
_LANG = re.compile(r"\blang\s*=\s*[\"']?(\w+)", re.I)


class Block(NamedTuple):
    """A top-level block of a .vue file: content is text[start:end]; closed: whether its end tag was found."""

    kind: str
    lang: str
    start: int
    end: int
    closed: bool


_INNER_TEMPLATE = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<template\b[^>]*?(/?)>|</template\s*>", re.I)
_TOP = re.compile(r"<!--[\s\S]*?(?:-->|\Z)|<(script|template|style|[a-z][\w-]*)((?:\s+[^\s=>\"'/]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+))?)*)\s*(/?)>", re.I)


def vue_blocks(text: str) -> list[Block]:
    """The top-level blocks of a single-file component, in order; nested template tags are matched."""
    found: list[Block] = []
    pos = 0
    while m := _TOP.search(text, pos):
        pos = m.end()
        if m.group(1) is None:
            continue
        kind, attrs = m.group(1).lower(), m.group(2) or ""
        lang = _LANG.search(attrs)
        if m.group(3):
            found.append(Block(kind, lang.group(1).lower() if lang else "", pos, pos, True))
            continue
        end, closed, after = len(text), False, len(text)
        if kind == "template":
            depth, at = 1, pos
            while t := _INNER_TEMPLATE.search(text, at):
                at = t.end()
                if t.group().startswith("<!--"):
                    continue
                if t.group().startswith("</"):
                    depth -= 1
                    if not depth:
                        end, closed, after = t.start(), True, t.end()
                        break
                elif not t.group(1):
                    depth += 1
        else:
            t = re.compile(rf"</{kind}\s*>", re.I).search(text, pos)
            if t:
                end, closed, after = t.start(), True, t.end()
        found.append(Block(kind, lang.group(1).lower() if lang else "", pos, end, closed))
        pos = after
    return found


def extension(path: str) -> str:
    """Ending of the last path segment, in lower case, with its dot; empty if there is none."""
    name = re.split(r"[/\\]", path or "")[-1]
    dot = name.rfind(".")
    return name[dot:].lower() if dot >= 0 else ""


def scripts(text: str, ext: str) -> list[tuple[int, int, bool]]:
    """(start, end, jsx) of the script text in a file: all of it, or the script blocks of a .vue file."""
    if ext == ".vue":
        return [(b.start, b.end, b.lang in ("tsx", "jsx")) for b in vue_blocks(text) if b.kind == "script"]
    if ext in (".js", ".ts", ".jsx", ".tsx"):
        return [(0, len(text), ext in (".jsx", ".tsx"))]
    return []
