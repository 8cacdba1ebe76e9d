"""Problem 2: source files that are not valid in the language of their ending."""

from __future__ import annotations

import json
import sys

from skein.functions import jslex
from skein.llm import gll

sys.setrecursionlimit(max(sys.getrecursionlimit(), 60_000))
_recognisers: dict[int, gll.Recogniser] = {}


def _accepts(text: str, dialects: int, jsx: bool) -> int:
    wanted = gll.TYPED if dialects & gll.TYPED else gll.SCRIPT | gll.MODULE
    if wanted not in _recognisers:
        _recognisers[wanted] = gll.Recogniser(wanted)
    return _recognisers[wanted].accepts(text, dialects, jsx)


def _not_json(name: str) -> float:
    raise ValueError(name)


def valid(text: str | None, ext: str) -> bool:
    """Whether the text of a file is valid in the language of its ending; null text and unknown endings are."""
    if text is None:
        return True
    if text.startswith("﻿"):
        text = text[1:]
    if ext == ".json":
        try:
            json.loads(text, parse_constant=_not_json, parse_int=len)
        except (ValueError, RecursionError):
            return False
        return True
    if not text.strip():
        return ext != ".vue" or not text
    untyped = gll.SCRIPT | gll.MODULE
    if ext == ".vue":
        blocks = [b for b in jslex.vue_blocks(text)]
        main = [b for b in blocks if b.kind in ("script", "template")]
        if not main or not all(b.closed for b in main):
            return False
        for b in main:
            if b.kind == "script" and not _accepts(text[b.start : b.end], gll.TYPED if b.lang in ("ts", "tsx") else gll.MODULE, b.lang in ("jsx", "tsx")):
                return False
        return True
    if ext in (".js", ".jsx"):
        return bool(_accepts(text, untyped, ext == ".jsx"))
    if ext in (".ts", ".tsx"):
        return bool(_accepts(text, gll.TYPED, ext == ".tsx"))
    return True


def verdicts(files):
    """(file_id, project, extension, valid) of each file, once, however many rows carry it.

    Null content, unknown endings and empty texts (but for .json) are valid.
    Rows with a null file_id are left out.  Text is parsed where it is read;
    only the verdicts are shuffled.
    """
    from pyspark.sql import functions as F

    from skein.functions.rows import map_rows

    def judge(rows):
        for file_id, project, path, content in rows:
            ext = jslex.extension(path)
            yield file_id, project, ext, valid(content, ext)

    read = files.select(F.col("file_id").cast("long"), "project", "relative_path", "content").where("file_id is not null")
    return map_rows(read, judge, "file_id long, project string, extension string, valid boolean").groupBy("file_id").agg(F.max("project").alias("project"), F.max("extension").alias("extension"), F.min("valid").alias("valid"))


def found(files):
    """file_id of each invalid file.  Only the ids of invalid rows are shuffled."""
    from pyspark.sql import functions as F

    from skein.functions.rows import map_rows

    def judge(rows):
        for file_id, path, content in rows:
            if not valid(content, jslex.extension(path)):
                yield (file_id,)

    read = files.select(F.col("file_id").cast("long"), "relative_path", "content").where("file_id is not null and content is not null")
    return map_rows(read, judge, "file_id long").distinct()


def rates(files):
    """Files, invalid files and their share per project and language."""
    from pyspark.sql import functions as F

    return verdicts(files).groupBy("project", "extension").agg(F.count(F.lit(1)).alias("files"), F.count_if(~F.col("valid")).alias("invalid")).withColumn("rate", F.col("invalid") / F.col("files"))
