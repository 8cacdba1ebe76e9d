"""Problem 7: files that nobody on the project wrote by hand.

Three kinds of evidence, in this order:

* marks: a notice at the head that a program made the file, a library's licence
  banner, a folder that holds libraries;
* token composition: line lengths and white space (minified, bundled), the share
  of literals (data), the share of lines that repeat one shape (generated);
* containment across repositories, over an inverted index of the hashes of long
  lines.  A file most of whose lines occur in one marked library file, in
  whatever project, is an edited copy; the index is asked for the rarest lines of
  a file only, so many that a file that holds enough of them cannot be missed,
  and then all lines are counted.  A file nearly all of whose lines occur in
  several projects each is a copy too, whether any of them carries a mark or not;
  for that the projects of every line are counted, without comparing files.
"""

from __future__ import annotations

import re
from collections import Counter

import xxhash

from skein.functions import jslex

EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".vue")

# What generators and libraries write at the head of a file.
_GENERATED = re.compile(
    r"<auto-?generated|@generated\b|^\W*auto-?\s?generated\W*$|\b(?:this|the|whole)\s+(?:file|module|code|source)\b[^.\n]{0,60}\b(?:generated|created automatically|produced)\b"
    r"|\b(?:auto(?:matically)?[- ]?)generated\s+(?:by|from|file|code|with|using)\b|\bgenerated (?:by|with|using|from)\b[^.\n]*\b(?:generator|codegen|compiler|protoc|swagger|openapi|tool|script|schema)\b|\bcode generated\b"
    r"|\b(?:changes|edits)\b[^.\n]*\b(?:lost|overwritten)\b|automatisch (?:erzeugte|generierte)\w* (?:datei|code)|(?:datei|quelltext)[^.\n]*(?:automatisch )?(?:erzeugt|generiert)|fichier[^.\n]*(?:produit|généré|créé)[^.\n]*|(?:archivo|fichero)[^.\n]*(?:generado|producido|creado)[^.\n]*"
    r"|(?:此|本|该)?(?:文件|代码)[^。\n]*(?:自动|脚本)?(?:生成|产生)|(?:本|この)?(?:ファイル|コード)[^。\n]*(?:自動(?:的に)?)?(?:生成|作成)",
    re.I | re.M,
)
_DO_NOT_EDIT = re.compile(r"do not (?:edit|modify|change)\b|don't edit|nicht (?:von hand )?(?:ändern|bearbeiten)|ne pas (?:le |la )?modifier|no (?:lo |la )?(?:edite|modifi)|请勿|不要(?:手动)?(?:修改|编辑)|編集しないで|変更しないで", re.I)
_BANNER = re.compile(
    r"^\s*(?:/\*!|/\*\*?|//|\*)?\s*(?:@license\s+\S+|@preserve\b|(?P<name>(?!version\b)\w[\w.@/-]{1,40}?)(?:\.js)?\s+(?:-\s+)?v?\d+\.\d+(?:\.\d+)?(?:\s*(?:-\s*|\||\()\s*(?:MIT|BSD|Apache|ISC|GPL|MPL|LGPL|Unlicense|CC0)\S*|\s*\*/|\s*$))"
    r"|released under (?:the )?\S+ licen[sc]e|licensed under (?:the )?(?:MIT|BSD|Apache|ISC|GPL|MPL|LGPL)|^\s*\*?\s*\(c\) \d{4}[^\n]*\bcontributors\b",
    re.I | re.M,
)
_UMD = re.compile(r"typeof exports === ['\"]object['\"]|typeof define === ['\"]function['\"]|\bdefine\.amd\b|__webpack_require__|__pack_require__|installedModules|webpackJsonp|parcelRequire")
_FOLDER = re.compile(r"(?:^|[/\\])(?:vendor|third[_-]party|node_modules|bower_components|(?:plugins|assets|static|public|js)[/\\](?:ext|lib|libs|vendor|js)|(?:ext|libs))[/\\]", re.I)
_BUILD = re.compile(r"(?:^|[/\\])(?:build-output|dist|out|build|gen|__generated__|autogen)[/\\]|\.(?:min|bundle|chunk|generated|gen|pb|g)\.[jt]sx?$|[.-]min\.js$|_pb\.[jt]s$", re.I)
_NUMBER = re.compile(r"(?<![\w$])[-+]?(?:0x[\da-fA-F]+|\d[\d_]*(?:\.\d+)?(?:[eE][-+]?\d+)?)")
# Words that make a line's shape.
_KEEP = "import export from const let var function return class extends default if else for while switch case break continue new throw try catch typeof async await this null true false".split()
_NAME = re.compile(rf"(?<![\w$])(?!(?:{'|'.join(_KEEP)})(?![\w$]))[^\W\d][\w$]*|\$[\w$]*")
_KEYWORD = re.compile(r"\b(?:function|return|if|for|while|switch|class|new|typeof|throw|try)\b|=>")


def head(text: str, spans: list[jslex.Span]) -> str:
    """Comments before the first line of code."""
    parts, at = [], 0
    for s in spans:
        if s.kind not in ("//", "/*") or text[at : s.start].strip("﻿ \t\r\n"):
            break
        parts.append(text[s.start : s.end])
        at = s.end
    return "\n".join(parts)


def lines_of(text: str, least: int = 24) -> list[int]:
    """Hashes of the distinct lines long enough to be told from common ones."""
    found = set()
    for line in text.splitlines():
        line = line.strip().rstrip(";,")
        if len(line) >= least and not line.startswith(("import ", "//", "*")):
            found.add(xxhash.xxh3_64_intdigest(line) >> 1)
    return sorted(found)


def features(text: str, ext: str) -> dict:
    """Token composition of a source file; of a .vue file, of its scripts."""
    parts = [(text[a:b], j) for a, b, j in jslex.scripts(text, ext)]
    code = "\n".join(p for p, _ in parts)
    n = max(1, len(code))
    literal = 0
    spans0: list[jslex.Span] = []
    comment = 0
    masks: list[str] = []
    loader = False
    for i, (part, jsx) in enumerate(parts):
        mask, spans, _ = jslex.scan(part, jsx)
        if i == 0:
            spans0 = spans
        at = [m.start() for m in _UMD.finditer(part)]
        if at and not loader:  # what stands in a comment or a string is not code
            blank = jslex.blanked(part, spans)
            loader = any(not blank[a].isspace() for a in at)
        literal += sum(s.end - s.start for s in spans if s.kind in "\"'`")
        comment += sum(s.end - s.start for s in spans if s.kind in ("//", "/*"))
        masks.append(mask)
    masked = "\n".join(masks)
    shaped, n_numbers = _NUMBER.subn("9", masked)
    numbers = len(masked) - len(shaped) + n_numbers  # characters of numbers
    space = sum(map(masked.count, " \t\n\r"))
    long_rows = sum(len(x) for x in code.split("\n") if len(x) > 240)
    order = [x for x in map(str.strip, _NAME.sub("w", shaped).split("\n")) if x]
    total = len(order)
    best: dict[str, int] = {}
    for (first, _), count in Counter(zip(order, order[1:])).items():
        if count > best.get(first, 2):
            best[first] = count
    foreseen = sum(best.values())
    return {
        "n": n,
        "head": head(parts[0][0], spans0) if parts else "",
        "space": space / max(1, len(masked)),
        "long": long_rows / n,
        "data": (literal + numbers + sum(map(masked.count, "[]{},:"))) / max(1, n - comment - space),
        "keywords": len(_KEYWORD.findall(masked)),
        "foreseen": foreseen / max(1, total - 1),
        "shaped": total,
        "code": code,
        "loader": loader,
    }


def judge(path: str, text: str, ext: str) -> tuple[str | None, dict]:
    """The kind of file that marks and composition show (generated, minified, vendored, data), if any."""
    f = features(text, ext)
    marked = bool(_GENERATED.search(f["head"]))
    build = bool(_BUILD.search(path))
    if f["long"] > 0.5 and f["space"] < 0.14 and f["keywords"] >= 3 and f["data"] < 0.9:
        return "minified", f
    if f["data"] > 0.86 and f["n"] > 400 and f["keywords"] <= 2:
        return "data", f
    if f["shaped"] >= 12 and f["foreseen"] > (0.5 if marked or build else 0.85) or marked and f["shaped"] < 12:
        return "generated", f
    if f["loader"] or _BANNER.search(f["head"]):
        return "vendored", f
    if _FOLDER.search(path):
        return "vendored", f
    return None, f


def evidence(files):
    """(file_id, project, kind, n_lines, lines) of every source file that is not empty, by row.

    kind is null where marks and composition show nothing.
    """
    from skein.functions.rows import map_rows
    from skein.llm.validity import valid

    def look(rows):
        for file_id, project, path, relative, content in rows:
            ext = jslex.extension(relative)
            if ext not in EXTENSIONS or not content.strip():
                continue
            kind, f = judge(relative or path or "", content, ext)
            if kind is not None and not valid(content, ext):
                continue
            rows_ = lines_of(f["code"]) if kind in (None, "vendored") else []
            yield file_id, project, kind, len(rows_), rows_

    read = files.where("file_id is not null and content is not null").select("file_id", "project", "path", "relative_path", "content")
    return map_rows(read.withColumn("file_id", read["file_id"].cast("long")), look, "file_id long, project string, kind string, n_lines int, lines array<long>")


#: Projects that hold a line, share of such lines and long lines of a file that is a copy without a marked original.
PROJECTS, SPREAD, SPREAD_LINES = 3, 0.9, 12
#: Copies whose ids go to every task that reads the files, instead of the files to where the ids are.
SMALL = 1_000_000


def kinds(files, least_lines: int = 8, least_share: float = 0.55):
    """(file_id, kind) of every valid source file that was not written by hand.

    kind: generated, minified, data, vendored or copy.  A copy has at least
    ``least_lines`` long lines, of which ``least_share`` occur together in one
    file known as vendored, or ``SPREAD_LINES``, of which the share ``SPREAD``
    occurs in ``PROJECTS`` projects each.  The features are written once to the checkpoint folder, since the
    index and the files looked up in it both come from them.
    """
    from pyspark.sql import functions as F

    from skein.functions.rows import map_rows
    from skein.functions.state import durable
    from skein.llm.validity import valid

    seen = durable(evidence(files))
    marked = seen.where("kind is not null").groupBy("file_id").agg(F.max("kind").alias("kind"))
    # files with the same lines are one set
    sets = seen.select("file_id", "kind", "n_lines", "lines", F.md5(F.to_json("lines")).alias("set")).where("n_lines > 0")
    libraries = sets.where("kind = 'vendored'").groupBy(F.col("set").alias("library")).agg(F.first("n_lines").alias("size"), F.first("lines").alias("held"))
    held = libraries.select("library", "size", F.explode("held").alias("line"))
    often = held.groupBy("line").agg(F.count(F.lit(1)).alias("often"))
    unknown = sets.where(f"kind is null and n_lines >= {int(least_lines)}")
    asked = unknown.groupBy("set").agg(F.first("n_lines").alias("n_lines"), F.first("lines").alias("lines"))
    need = F.ceil(F.round(F.col("n_lines") * least_share, 6)).cast("int")
    # only lines that some library holds come out; those of the set that none holds are the rarest of all
    known = asked.select("set", "n_lines", F.explode("lines").alias("line")).join(often, "line")
    ranked = known.groupBy("set").agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_list(F.struct("often", "line"))).alias("known")).where(F.size("known") >= need)
    # of n lines, need are shared: any n - need + 1 of them hold a shared one; n - known of them are in no library
    rare = ranked.select("set", need.alias("need"), F.explode(F.slice("known", F.lit(1), F.size("known") - need + 1)).alias("r")).select("set", "need", F.col("r.line").alias("line"))
    pairs = rare.join(held, "line").where("size >= need").select("set", "need", "library").distinct()
    both = pairs.join(asked.select("set", "lines"), "set").join(libraries.select("library", "held"), "library")
    copied_sets = both.where(F.size(F.array_intersect("lines", "held")) >= F.col("need")).select("set").distinct()
    # lines of several projects: pairs of line and project are made distinct before they are counted
    spread = seen.select("project", F.explode("lines").alias("line")).distinct().groupBy("line").count().where(F.col("count") >= PROJECTS).select("line")
    met = asked.where(F.col("n_lines") >= SPREAD_LINES).select("set", "n_lines", F.explode("lines").alias("line")).join(spread, "line")
    spread_sets = met.groupBy("set").agg(F.first("n_lines").alias("n_lines"), F.count(F.lit(1)).alias("met")).where(F.col("met") >= SPREAD * F.col("n_lines")).select("set")
    copies = durable(unknown.join(copied_sets.unionByName(spread_sets).distinct(), "set", "left_semi").select("file_id").distinct())
    if copies.count() <= SMALL:
        copies = F.broadcast(copies)

    def check(rows):
        for file_id, relative, content in rows:
            if valid(content, jslex.extension(relative)):
                yield file_id, "copy"

    texts = files.where("file_id is not null and content is not null").select(F.col("file_id").cast("long"), "relative_path", "content").join(copies, "file_id", "left_semi")
    copied = map_rows(texts, check, "file_id long, kind string")
    return marked.unionByName(copied).groupBy("file_id").agg(F.min("kind").alias("kind"))


def found(files):
    return kinds(files).select("file_id")
