"""Functions, methods and arrow functions of JavaScript and TypeScript text, with the comments before them."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

from skein.functions import jslex

_MODS = r"(?:(?:public|private|protected|static|readonly|override|abstract|async|get|set)\s+|\*\s*)*"
_HEAD = re.compile(
    r"(?P<pre>(?:\bexport\s+(?:default\s+)?)?(?:\bdeclare\s+)?)(?P<fa>\basync\s+)?\bfunction\b\s*\*?\s*(?P<fn>[\w$]+)?\s*(?=[<(])"
    r"|(?P<xpre>\bexport\s+)?\b(?:const|let|var)\s+(?P<an>[\w$]+)\s*(?:(?P<at>:)|=\s*(?P<aa>\basync\b\s*)?(?=[(<]|[\w$]+\s*=>))"
    rf"|(?:^|(?<=[{{}};,]))[^\S\n]*(?P<mods>{_MODS})(?P<mn>[#\w$]+)\s*(?=[(<])"
    r"|(?:^|(?<=[{,]))[^\S\n]*(?P<pn>[\w$]+)\s*:\s*(?P<pa>\basync\b\s*)?(?P<pf>function\b\s*\*?\s*[\w$]*\s*)?(?=[(<]|[\w$]+\s*=>)",
    re.M,
)
_VALUE = re.compile(r"\s*(?P<aa>\basync\b\s*)?(?=[(<]|[\w$]+\s*=>)")
_BRACKET = re.compile(r"[(){}\[\]]")
_PAIRS = {")": "(", "}": "{", "]": "["}
_NOT_NAMES = frozenset("if for while switch catch function return with else do typeof new await super import case".split())
_CLASS = re.compile(r"\bclass\b[^{}()]*(?:\([^()]*\)[^{}()]*)*$")
_DEFAULT = re.compile(r"\bexport\s+default\s*(?:[\w$.]+\s*\(\s*)?$")


_GOES_ON = re.compile(r"\s*(?:[.?:&|+\-*/%<>=,]|instanceof\b|in\b)")


class Function(NamedTuple):
    """Lines count from 1 in the script text; comments: those directly before, as written; end: where the function ends."""

    name: str
    type: str
    params: list
    start_line: int
    end_line: int
    is_async: bool
    is_exported: bool
    comments: str | None
    start: int
    end: int


class _Text:
    def __init__(self, text: str, jsx: bool):
        self.text = text
        _, self.spans, _ = jslex.scan(text, jsx)
        self.blank = jslex.blanked(text, self.spans)
        self.close: dict[int, int] = {}
        self.outer: dict[int, int] = {}  # opening brace: the one around it
        stack: list[tuple[str, int]] = []
        braces_open: list[int] = []
        for m in _BRACKET.finditer(self.blank):
            c, at = m.group(), m.start()
            if c in "({[":
                stack.append((c, at))
                if c == "{":
                    self.outer[at] = braces_open[-1] if braces_open else -1
                    braces_open.append(at)
            elif stack and stack[-1][0] == _PAIRS[c]:
                if c == "}":
                    braces_open.pop()
                self.close[stack.pop()[1]] = at
        self.breaks = [m.end() for m in re.finditer(r"\n", text)]
        braces = sorted(a for a in self.close if self.blank[a] == "{")
        self.braces = braces
        comments = [s for s in self.spans if s.kind in ("//", "/*")]
        self.comment_end = [s.end for s in comments]
        self.comments = comments

    def heads_after_comments(self):
        """Matches of heads that begin at the first code after a comment."""
        last = -1
        for end in self.comment_end:
            if end <= last:
                continue  # the code after it is that after the comments before
            at = self.skip(end)
            if at >= len(self.blank):
                break
            last = at
            m = _HEAD.match(self.blank, at) or _HEAD.match(self.blank, self.blank.rfind("\n", 0, at) + 1)
            if m:
                yield m

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.breaks, at) + 1

    def around(self, at: int) -> int:
        """Position of the innermost brace around, or -1."""
        i = bisect.bisect_left(self.braces, at) - 1
        a = self.braces[i] if i >= 0 else -1
        while a >= 0 and self.close.get(a, -1) < at:
            a = self.outer[a]
        return a

    def skip(self, at: int) -> int:
        while at < len(self.blank) and self.blank[at].isspace():
            at += 1
        return at

    def before(self, at: int) -> tuple[str | None, list]:
        """Comments directly before a position, with at most blank space between, as written; those behind code on their line belong to that code."""
        i = bisect.bisect_right(self.comment_end, at) - 1
        found = []
        while i >= 0 and not self.text[self.comments[i].end : at].strip():
            first = self.comments[i].start
            if self.blank[self.blank.rfind("\n", 0, first) + 1 : first].strip():
                break  # it stands behind code on its line
            found.append(self.comments[i])
            at = self.comments[i].start
            i -= 1
        found.reverse()
        return ("\n".join(self.text[s.start : s.end] for s in found) if found else None), found

    def annotated(self, at: int) -> int | None:
        """Position after the ``=`` that follows the type at ``at``, which may span lines."""
        depth, n = 0, len(self.blank)
        while at < n:
            c = self.blank[at]
            if c in "{([" and at in self.close:
                at = self.close[at]
            elif c == "<":
                depth += 1
            elif c == ">" and self.blank[at - 1] != "=":
                depth -= 1
            elif c == "=" and depth <= 0 and not self.blank.startswith("=>", at):
                return at + 1
            elif c in ";)}]" or c == "," and depth <= 0:
                return None
            elif c == "\n" and depth <= 0 and self.blank[max(0, at - 200) : at].rstrip()[-1:] not in tuple(":|&>") and not re.compile(r"\s*(?:[|&=.]|$)").match(self.blank, at):
                return None
            at += 1
        return None

    def parameters(self, at: int) -> tuple[list, int] | None:
        """Names of the parameters of the list that opens at ``at``, and the position after it."""
        if at < len(self.blank) and self.blank[at] == "<":
            depth = 0
            while at < len(self.blank):
                c = self.blank[at]
                if c == "<":
                    depth += 1
                elif c == ">" and self.blank[at - 1] != "=":
                    depth -= 1
                    if not depth:
                        break
                elif c in "{([" and at in self.close:
                    at = self.close[at]
                elif c in ";)}":
                    return None
                at += 1
            at = self.skip(at + 1)
        if at >= len(self.blank) or self.blank[at] != "(" or at not in self.close:
            m = re.compile(r"[\w$]+").match(self.blank, at)
            return ([m.group()], m.end()) if m else None
        end = self.close[at]
        names, depth, start = [], 0, at + 1
        for i in range(at + 1, end + 1):
            c = self.blank[i]
            if c in "({[<":
                depth += 1
            elif c in ")}]>" and i < end and self.blank[i - 1] != "=":
                depth -= 1
            elif (c == "," and depth == 0) or i == end:
                part = self.blank[start:i].strip()
                if part:
                    part = re.sub(r"^(?:(?:public|private|protected|readonly)\s+)+", "", part)
                    m = re.match(r"([\w$]+)\s*\??\s*(?::|$)", part)
                    names.append(m.group(1) if m else "param")
                start = i + 1
        return names, end + 1

    def body(self, at: int, arrow: bool) -> int | None:
        """End of the body that follows a parameter list, if one does."""
        n = len(self.blank)
        at = self.skip(at)
        if at < n and self.blank[at] == ":":  # type of the result
            depth = 0
            at += 1
            seen = False
            while at < n:
                c = self.blank[at]
                if c in "{([" and at in self.close:
                    if c == "{" and seen and not arrow and self.blank[:at].rstrip()[-1:] not in "|&:<,=":
                        break
                    at = self.close[at]
                    seen = True
                elif c == "=" and self.blank.startswith("=>", at) and arrow and depth == 0:
                    break
                elif c == "<":
                    depth += 1
                elif c == ">" and self.blank[at - 1] != "=":
                    depth -= 1
                elif c in ";)}" or c == "," and depth <= 0:
                    return None
                elif not c.isspace():
                    seen = True
                at += 1
        if arrow:
            if not self.blank.startswith("=>", at):
                return None
            at = self.skip(at + 2)
            if at < n and self.blank[at] == "{" and at in self.close:
                return self.close[at] + 1
            while at < n:  # an expression
                c = self.blank[at]
                if c in "{([" and at in self.close:
                    at = self.close[at]
                elif c in ";,)}]":
                    break
                elif c == "\n" and not _GOES_ON.match(self.blank, at) and not re.search(r"(?:[.?:&|+\-*/%<>=,(]|=>)\s*$", self.blank[max(0, at - 40) : at]):
                    break
                at += 1
            return len(self.blank[:at].rstrip())
        if at < n and self.blank[at] == "{" and at in self.close:
            return self.close[at] + 1
        return None


def functions(text: str, jsx: bool = False, objects: bool = False, documented: bool = False) -> list[Function]:
    """Function declarations, class methods and arrow functions bound to a name, in order of their start.

    ``objects``: also methods and function-valued properties of the object that
    a .vue script exports by default.  ``documented``: only those that a comment
    directly precedes, which saves looking at the rest of the text.  Positions come from the text itself, so
    a file that does not parse still gives what can be found in it.
    """
    t = _Text(text, jsx)
    found: list[Function] = []
    kinds: dict[int, str] = {}

    def kind_of(brace: int) -> str:
        """``class``, ``default`` (inside export default) or nothing."""
        if brace < 0:
            return ""
        k = kinds.get(brace)
        if k is None:
            head = t.blank[max(0, brace - 400) : brace]
            if _CLASS.search(head):
                k = "class"
            elif objects and _DEFAULT.search(head):
                k = "default"
            elif objects and re.search(r"[:=(,\[]\s*$|\breturn\s*$", head) and kind_of(t.around(brace)) == "default":
                k = "default"
            else:
                k = ""
            kinds[brace] = k
        return k

    for m in t.heads_after_comments() if documented else _HEAD.finditer(t.blank):
        head_end = m.end()
        if m.group("fn") is not None or m.group("pre") is not None and m.group("an") is None and m.group("mn") is None and m.group("pn") is None:
            name, kind = m.group("fn"), "function"
            if not name:
                continue
            start = m.start() + len(m.group("pre") or "")
            exported, is_async, arrow = "export" in (m.group("pre") or ""), bool(m.group("fa")), False
            outer = m.start()
        elif m.group("an") is not None:
            name, kind, arrow = m.group("an"), "arrow", True
            value = m
            if m.group("at"):
                after = t.annotated(m.end())
                value = _VALUE.match(t.blank, after) if after is not None else None
                if value is None:
                    continue
            head_end = value.end()
            start = t.skip(value.start("aa") if value.group("aa") else head_end)
            exported, is_async, outer = False, bool(value.group("aa")), m.start()
        elif m.group("mn") is not None:
            name, kind, arrow = m.group("mn"), "method", False
            if name in _NOT_NAMES:
                continue
            start = t.skip(m.start())
            where = kind_of(t.around(start))
            if where not in ("class", "default"):
                continue
            exported, is_async, outer = False, bool(re.search(r"\basync\b", m.group("mods") or "")), start
        else:
            name, kind = m.group("pn"), "method"
            start = t.skip(m.start())
            if not objects or kind_of(t.around(start)) != "default":
                continue
            arrow = not m.group("pf")
            exported, is_async, outer = False, bool(m.group("pa")), start
        got = t.parameters(t.skip(head_end))
        if got is None:
            continue
        end = t.body(got[1], arrow)
        if end is None:
            continue
        comments, _ = t.before(outer)
        if documented and comments is None:
            continue
        found.append(Function(name, kind, got[0], t.line(start), t.line(max(start, end - 1)), is_async, exported, comments, start, end))
    found.sort(key=lambda f: (f.start, f.end))
    return found


def unmarked(comments: str | None) -> str | None:
    """Text of comments without their outer marks, joined by line ends."""
    if comments is None:
        return None
    parts = re.findall(r"/\*([\s\S]*?)\*/|//([^\n\r]*)", comments)
    return "\n".join(a or b for a, b in parts)
