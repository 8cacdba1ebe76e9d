"""Function nodes of the syntax trees of JavaScript and TypeScript text.

A text is read to bracket groups with the positions of their tokens; the
syntax tree of each group's content comes from the GLL recogniser, which keeps
one tree for equal contents.  The visitor goes down the tree, and at a function
node takes its name, its exact range in the text and the comments before it.
"""

from __future__ import annotations

import bisect
import re
import sys
from typing import NamedTuple

from skein.functions import jslex
from skein.llm import gll

sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))
_FUNCTION, _STAR, _ASYNC, _DEFAULT, _EQUALS, _COLON = (gll.CODE[x] for x in ("function", "*", "async", "default", "=", ":"))
_MODIFIERS = frozenset(gll.CODE[x] for x in ("public", "private", "protected", "static", "readonly", "override", "abstract", "async", "get", "set", "declare", "accessor", "*"))
_PARAMS = ("Params", "None", "One")
#: Content that holds methods, which have no word or arrow of their own.
_MEMBERS = ("ClassBody",)
_LINE, _LINES = re.compile(r"\n"), re.compile(r"\n\s*")
_recogniser: list[gll.Recogniser] = []


class Function(NamedTuple):
    """A function node: name, kind (function, method, arrow), its range in the text, its lines from 1, and the comments before it as written."""

    name: str
    kind: str
    start: int
    end: int
    start_line: int
    end_line: int
    comments: str | None


class _Visitor:
    def __init__(self, r: gll.Recogniser, text: str, masked: str, scan: tuple, objects: bool, documented: bool):
        self.r, self.text, self.masked, self.objects, self.documented = r, text, masked, objects, documented
        _, self.spans, _, places = scan
        self.at_masked, self.at_text = [p for p, _ in places], [q for _, q in places]
        self.literal_end = {s.start: s.end for s in self.spans if s.kind not in ("//", "/*")}
        self.comments = [s for s in self.spans if s.kind in ("//", "/*")]
        self.comment_ends = [s.end for s in self.comments]
        self.lines = [m.end() for m in _LINE.finditer(text)]
        self.blank: str | None = None
        self.found: list[Function] = []
        self.codes = list(map(gll._codes.__getitem__, gll._TOKEN.findall(masked)))
        # a token is found by the line that it stands on: line ends are tokens, and nothing else holds one
        self.line_tokens = [-1, *(i for i, c in enumerate(self.codes) if c == gll.NL)]
        self.line_starts = [0, *(m.start() for m in _LINES.finditer(masked))]
        self.lines_read: dict[int, list[int]] = {}
        self.match: dict[int, int] = {}
        self.top = r.grouped(self.codes, self.match)

    def tokens(self, opening: int, closing: int, lines: bool) -> list[int]:
        """The numbers of the tokens between two brackets, of a group in them the number of its opening bracket; ``lines``: line ends too."""
        found, i = [], opening + 1
        while i < closing:
            c = self.codes[i]
            if c != gll.NL or lines:
                found.append(i)
            i = self.match[i] + 1 if gll.OPEN_AT <= c < gll.CLOSE_AT else i + 1
        return found

    def start(self, token: int) -> int:
        """Where a token begins in the masked text."""
        k = bisect.bisect_right(self.line_tokens, token) - 1
        found = self.lines_read.get(k)
        if found is None:
            stop = self.line_starts[k + 1] if k + 1 < len(self.line_starts) else len(self.masked)
            found = self.lines_read[k] = [m.start() for m in gll._TOKEN.finditer(self.masked, self.line_starts[k], stop)]
        return found[token - self.line_tokens[k] - (k == 0)]

    def place(self, token: int, end: bool = False) -> int:
        """Where a token begins, or ends, in the text."""
        at = self.start(token)
        i = bisect.bisect_right(self.at_masked, at) - 1
        start = self.at_text[i] + at - self.at_masked[i] if i >= 0 else 0
        if not end:
            return start
        return self.literal_end.get(start) or start + gll._TOKEN.match(self.masked, at).end() - at

    def last(self, token: int) -> int:
        """Where the token, or the group that it opens, ends in the text."""
        return self.literal_end.get(self.place(token)) or self.place(self.match.get(token, token), True)

    def commented(self, token: int) -> bool:
        """Whether a comment stands within the group that the token opens."""
        k = bisect.bisect_right(self.comment_ends, self.place(token))
        return k < len(self.comment_ends) and self.comment_ends[k] < self.place(self.match[token])

    def before(self, at: int) -> str | None:
        """Comments directly before a position, with at most blank space between, as written; those behind code on their line belong to that code."""
        i = bisect.bisect_right(self.comment_ends, at) - 1
        found = []
        while i >= 0 and not self.text[self.comments[i].end : at].strip():
            at = self.comments[i].start
            if self.blank is None:
                self.blank = jslex.blanked(self.text, self.spans)
            if self.blank[self.blank.rfind("\n", 0, at) + 1 : at].strip():
                break
            found.append(self.text[at : self.comments[i].end])
            i -= 1
        return "\n".join(reversed(found)) if found else None

    def add(self, kind: str, at: list[int], name: int, first: int, last: int, outer: int) -> None:
        comments = self.before(outer)
        if self.documented and comments is None:
            return
        start, end = self.place(at[first]), self.last(at[last])
        line = lambda p: bisect.bisect_right(self.lines, p) + 1
        word = self.text[self.place(at[name]) : self.last(at[name])].strip("'\"")
        self.found.append(Function(word, kind, start, end, line(start), line(max(start, end - 1)), comments))

    def visit(self, codes: tuple, at: list[int], nodes, outer: int | None = None, default: bool = False) -> None:
        """Function nodes among ``nodes`` and below; ``codes`` and ``at`` are the tokens of the group that they are nodes of.

        ``outer``: where the statement around begins, before which comments
        stand; ``default``: within what the text exports by default.
        """
        for node in nodes:
            if node.context >= 0:
                if node.name in _MEMBERS or self.r.bears(codes[node.first : node.first + 1], self.objects):
                    opening = at[node.first]
                    if not self.documented or self.commented(opening):
                        group = codes[node.first]
                        inner = self.r.syntax(node.name, group, node.context, self.objects)
                        if inner:
                            self.visit(self.r.content[group - gll.BASE], self.tokens(opening, self.match[opening], self.r.kinds[group - gll.BASE] == 1), inner, None, default)
                continue
            here = outer if outer is not None else self.place(at[node.first])
            if node.name == "Func":
                name = next(i for i in range(node.first, node.last) if codes[i] == _FUNCTION) + 1
                name += codes[name] == _STAR
                self.add("function", at, name, node.first, node.last, here)
            elif node.name in ("ConstOne", "LetOne"):
                value = self.value(codes, node, _EQUALS)
                if value is not None and value.name == "Arrow" and codes[node.first] < gll.OPEN_AT:
                    self.add("arrow", at, node.first, value.first, value.last, here)
            elif node.name in ("Member", "Prop"):
                params = next((c for c in node.children if c.context >= 0 and c.name in _PARAMS), None)
                wanted = node.name == "Member" or self.objects and default
                if wanted and params is not None and node.children[-1].name == "SL" and node.children[-1].last == node.last:
                    name = node.first
                    while name + 1 < params.first and codes[name] in _MODIFIERS and codes[name + 1] != gll._LESS:
                        name += 1
                    if codes[name] < gll.BASE:
                        self.add("method", at, name, node.first, node.last, here)
                elif wanted and node.name == "Prop":
                    value = self.value(codes, node, _COLON)
                    if value is not None and value.name in ("Arrow", "FuncExpr") and codes[node.first] < gll.BASE:
                        self.add("method", at, node.first, node.first, node.last, here)
            elif node.name in ("Export", "Decl", "TsDecl", "DeclareOne"):
                within = default or node.name == "Export" and node.last > node.first and codes[node.first + 1] == _DEFAULT
                self.visit(codes, at, node.children[:1], here, within)
                self.visit(codes, at, node.children[1:], None, within)
                continue
            self.visit(codes, at, node.children, None, default)

    @staticmethod
    def value(codes, node, after: int):
        """The child that is all that follows the sign."""
        for c in node.children:
            if c.last == node.last and c.first > node.first and codes[c.first - 1] == after:
                return c
        return None


def scanned(text: str, jsx: bool) -> tuple:
    """What ``functions`` needs of the scanner: masked text, spans, whether all is closed, places."""
    places: list = []
    return (*jslex.scan(text, jsx, places), places)


def functions(text: str, jsx: bool = False, objects: bool = False, scan: tuple | None = None, documented: bool = False) -> list[Function] | None:
    """Function declarations, class methods and arrow functions bound to a name, in order; None if no dialect accepts the text.

    ``objects``: also methods and function-valued properties under what a .vue
    script exports by default.  ``scan``: what ``scanned`` gave for the text.
    ``documented``: only those with comments before them; groups without a
    comment in them are not visited then.
    """
    scan = scan or scanned(text, jsx)
    if not scan[2]:
        return None
    if not _recogniser:
        _recogniser.append(gll.Recogniser(gll.SCRIPT | gll.MODULE | gll.TYPED))
    r = _recogniser[0]
    if max(len(r.kinds), len(r.chunks), len(r.shapes)) > r.bound:
        r.clear()
    v = _Visitor(r, text, gll.spaced(scan[0]), scan, objects, documented)
    nodes = r.nodes_of("File", v.top, gll.TOP | gll.OUTSIDE, objects) if v.top is not None else None
    if nodes is None:
        return None
    v.visit(v.top, v.tokens(-1, len(v.codes), True), nodes)
    v.found.sort(key=lambda f: (f.start, f.end))
    return v.found
