"""Units of files: one for a file, one for a component, one a function."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import jslex
from skein.functions import text as T
from skein.functions.rows import map_rows
from skein.sources.jsfunctions import functions, unmarked

_SCHEMA = "project string, file_path string, relative_path string, type string, name string, start_line int, end_line int, is_async boolean, is_exported boolean, kind string, params array<string>, comments string, code string, metadata string, head string"


def parsed(files: DataFrame, granularity: str = "both") -> DataFrame:
    """Units (without vectors) of files (project, path, relative_path, content).

    granularity: file, function or both.  Ids are hashes of project, path, type,
    name and lines, so a unit keeps its id.  Null content gives no unit; a file
    that does not parse gives what can be found in it.
    """
    parts = []
    rows = files.where("content is not null").withColumn("relative_path", F.coalesce("relative_path", F.lit("")))
    if granularity in ("file", "both"):
        size = F.col("size").cast("long") if "size" in rows.columns else F.octet_length("content").cast("long")
        meta = F.to_json(F.struct(T.extension("relative_path").alias("extension"), size.alias("size"), F.col("relative_path").alias("relativePath")))
        parts.append(
            rows.select("project", F.col("path").alias("file_path"), "relative_path", F.lit("file").alias("type"), T.base_name("path").alias("name"), F.lit(1).alias("start_line"), F.size(F.split("content", "\n")).alias("end_line"), T.file_text("relative_path", T.extension("relative_path"), "path", "content").alias("content"), T.dependencies("content").alias("dependencies"), meta.alias("metadata"))
        )
    if granularity in ("function", "both"):

        def visit(batch):
            for project, path, relative, content in batch:
                ext = jslex.extension(relative)
                found = []  # with the text whose lines a function's are
                props, emits, template, script = [], [], "", ""
                for start, end, jsx in jslex.scripts(content, ext):
                    lines_of = content[start:end].split("\n")
                    found += [(f, lines_of) for f in functions(content[start:end], jsx, ext == ".vue")]
                if ext == ".vue":
                    blocks = jslex.vue_blocks(content)
                    texts = {k: [content[b.start : b.end] for b in blocks if b.kind == k] for k in ("template", "script")}
                    template, script = (texts[k][-1] if texts[k] else "" for k in ("template", "script"))
                    first = texts["script"][0] if texts["script"] else ""
                    m = re.search(r"props:\s*\{([^}]+)\}", first)
                    props = [p.split(":")[0].strip() for p in m.group(1).split(",") if p.split(":")[0].strip()] if m else []
                    m = re.search(r"emits:\s*\[([^\]]+)\]", first)
                    emits = [re.sub("['\"`]", "", e).strip() for e in m.group(1).split(",") if e.strip()] if m else []
                    name = re.split(r"[/\\]", path or relative)[-1].removesuffix(".vue")
                    lines = [f"文件: {relative}", "类型: Vue组件"]
                    lines += [f"\n组件属性 (Props): {', '.join(props)}"] if props else []
                    lines += [f"组件事件 (Emits): {', '.join(emits)}"] if emits else []
                    if found:
                        lines += ["\n方法列表:", *(f"- {'async ' if f.is_async else ''}{f.name}({', '.join(f.params)})" for f, _ in found)]
                    lines += [f"\nTemplate:\n{template[:500]}{'...' if len(template) > 500 else ''}"] if template else []
                    lines += [f"\nScript:\n{script}"] if script else []
                    meta = json.dumps({"extension": ext, "relativePath": relative, "props": props, "emits": emits}, ensure_ascii=False)
                    yield project, path, relative, "component", name, 1, content.count("\n") + 1, False, False, "component", [], None, content, meta, "\n".join(lines)
                for f, lines_of in found:
                    code = "\n".join(lines_of[f.start_line - 1 : f.end_line])
                    meta = json.dumps({"extension": ext, "relativePath": relative, "functionType": f.type, "isAsync": f.is_async, "isExported": f.is_exported, "params": f.params}, ensure_ascii=False)
                    yield project, path, relative, "function", f.name, f.start_line, f.end_line, f.is_async, f.is_exported, f.type, f.params, None if f.is_exported or f.type == "arrow" else unmarked(f.comments), code, meta, None

        units = map_rows(rows.select("project", "path", "relative_path", "content"), visit, _SCHEMA)
        text = F.when(F.col("type") == "component", F.col("head")).otherwise(T.function_text("relative_path", "name", "kind", "params", "is_async", "is_exported", "comments", "code"))
        deps = F.when(F.col("type") == "component", T.dependencies("code")).otherwise(F.array().cast("array<string>"))
        parts.append(units.select("project", "file_path", "relative_path", "type", "name", "start_line", "end_line", text.alias("content"), deps.alias("dependencies"), "metadata"))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("project", "relative_path", "type", "name", "start_line", "end_line")]), 256))


def extracted(files: DataFrame) -> DataFrame:
    """(file_id, name, type, params, start_line, end_line, is_async, is_exported, comments) of every function in files (file_id, relative_path, content).

    Lines count in the script text: in a .vue file from the rest of the line with the script's tag.
    """

    def visit(batch):
        for file_id, relative, content in batch:
            ext = jslex.extension(relative)
            content = content.removeprefix("\ufeff")
            for start, end, jsx in jslex.scripts(content, ext):
                for f in functions(content[start:end], jsx, ext == ".vue"):
                    yield file_id, f.name, f.type, f.params, f.start_line, f.end_line, f.is_async, f.is_exported, unmarked(f.comments)

    read = files.where("file_id is not null and content is not null").select(F.col("file_id").cast("long"), "relative_path", "content")
    return map_rows(read, visit, "file_id long, name string, type string, params array<string>, start_line int, end_line int, is_async boolean, is_exported boolean, comments string")
