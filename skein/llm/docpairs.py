"""Problem 3: functions with the comment that documents them.

Files are parsed to syntax trees, whose function nodes come with their exact
ranges and the comments directly before them (at most blank lines between); a
row of ``functions`` takes its own ``comments`` or, where they are null, those of
its node in the file.  Descriptions that are empty, too short, or repeat the name
are dropped.  A file that no dialect accepts has no tree; there heads of
functions are matched by a pattern instead.

Nulls: a row without func_id is left out; one without name or content is
judged by its comments alone.  Repeated rows give one result.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jslex
from skein.functions.rows import map_rows
from skein.llm import prose, tree
from skein.sources.jsfunctions import functions as heads_of

LEAST_WORDS, LEAST_CHARS = 6, 10
#: What comments with a description match, and what no function begins with.
_MAYBE = re.compile(r"(?:[^\W\d_]+[\W\d_]+){5}[^\W\d_]|(?:[㐀-鿿぀-ヿ][^㐀-鿿぀-ヿ]*){10}")


_NO_HEAD = re.compile(r"(?:import|return|if|for|while|do|switch|throw|try|case|break|continue|interface|type|enum|declare\s+(?:module|global)|namespace|else|catch|finally)\b|[^\w$@#'\"\[*\\]|\Z")
_HEAD_WORDS = re.compile(r"function|=>|class")


def _worth(text: str, spans: list, masked: str, objects: bool) -> bool:
    """Whether a comment that may be a description stands before something that a function can begin with; ``objects``: functions need no word or arrow of their own."""
    if not objects and not _HEAD_WORDS.search(masked):
        return False
    run, end = [], -1
    for s in (*(s for s in spans if s.kind in ("//", "/*")), None):
        if s is not None and run and not text[end : s.start].strip():
            run.append(s)
        else:
            if run and not _NO_HEAD.match(text, _SPACE.match(text, end).end()) and _MAYBE.search("\n".join(text[x.start : x.end] for x in run)):
                return True
            run = [s]
        end = s.end if s is not None else end
    return False


_SPACE = re.compile(r"\s*")


def nodes(content: str, ext: str, documented: bool):
    """(name, start, end, start_line, end_line, comments) of the function nodes of a file; lines count in the script text, in a .vue file from its opening tag.

    ``documented``: only those with comments; text without a comment that may be
    a description, before something that may be a function, is not parsed then.
    """
    bom = content.startswith("\ufeff")
    text = content[1:] if bom else content
    for a, b, jsx in jslex.scripts(text, ext):
        part = text[a:b]
        scan = tree.scanned(part, jsx)
        if documented and not _worth(part, scan[1], scan[0], ext == ".vue"):
            continue
        found = tree.functions(part, jsx, ext == ".vue", scan, documented)
        if found is None:
            found = heads_of(part, jsx, ext == ".vue", documented)
        for f in found:
            if f.comments or not documented:
                yield f.name, f.start + a + bom, f.end + a + bom, f.start_line, f.end_line, f.comments


def described(comments: str | None, name: str | None) -> str | None:
    """The description in comments, if it is one."""
    text, words, chars = prose.description(comments, name or "")
    return text if words >= LEAST_WORDS or chars >= LEAST_CHARS else None


def _contents(files: DataFrame) -> DataFrame:
    return files.where("file_id is not null and content is not null").select(F.col("file_id").cast("long"), "relative_path", "content")


def documented_nodes(files: DataFrame) -> DataFrame:
    """(file_id, start_line, name) of every function node with a real description."""

    def visit(rows):
        for file_id, path, content in rows:
            for name, _, _, line, _, comments in nodes(content, jslex.extension(path), True):
                if described(comments, name):
                    yield file_id, line, name

    return map_rows(_contents(files), visit, "file_id long, start_line int, name string").distinct()


def found(functions: DataFrame, files: DataFrame) -> DataFrame:
    """func_id of every function with a real description; only keys are shuffled."""

    def own(rows):
        for func_id, name, comments in rows:
            if described(comments, name):
                yield (func_id,)

    rows = functions.where("func_id is not null")
    with_own = map_rows(rows.where("comments is not null").select(F.col("func_id").cast("long"), "name", "comments"), own, "func_id long")
    without = rows.where("comments is null").select(F.col("func_id").cast("long"), F.col("file_id").cast("long"), F.col("start_line").cast("int"), "name")
    from_file = without.join(documented_nodes(files), ["file_id", "start_line", "name"]).select("func_id")
    return with_own.unionByName(from_file).distinct()


def pairs(functions: DataFrame, files: DataFrame) -> DataFrame:
    """(func_id, name, description, code, start_line, end_line, first_char, end_char) of each documented function, once.

    code is the text of its node, whose characters in the file are counted from
    0; a function whose file does not hold its node has the content of its row
    and no characters.
    """

    def visit(rows):
        for file_id, path, content in rows:
            for name, start, end, line, last, comments in nodes(content, jslex.extension(path), False):
                yield file_id, line, name, last, start, end, described(comments, name), content[start:end]

    def own(rows):
        for func_id, name, comments in rows:
            text = described(comments, name)
            if text:
                yield func_id, text

    keys = ["file_id", "start_line", "name"]
    node = map_rows(_contents(files), visit, "file_id long, start_line int, name string, last int, first_char int, end_char int, said string, node string")
    node = node.groupBy(*keys).agg(F.min(F.struct("first_char", "end_char", "last", "said", "node")).alias("node"))
    rows = functions.where("func_id is not null").select(F.col("func_id").cast("long"), F.col("file_id").cast("long"), F.col("start_line").cast("int"), F.col("end_line").cast("int"), "name", "content", "comments")
    own_text = map_rows(rows.where("comments is not null").select("func_id", "name", "comments"), own, "func_id long, own string").groupBy("func_id").agg(F.max("own").alias("own"))
    both = rows.join(node, keys, "left").join(own_text, "func_id", "left")
    text = F.when(F.col("comments").isNotNull(), F.col("own")).otherwise(F.col("node.said"))
    out = both.select("func_id", "name", text.alias("description"), F.coalesce("node.node", "content").alias("code"), "start_line", F.coalesce("end_line", "node.last").alias("end_line"), "node.first_char", "node.end_char")
    return out.where("description is not null").groupBy("func_id").agg(F.min(F.struct(*out.columns[1:])).alias("p")).select("func_id", "p.*")
