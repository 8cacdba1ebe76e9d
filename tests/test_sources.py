from skein.sources import parse, scan


def test_scan_keeps_hidden_names_and_prunes(spark, tmp_path):
    for path in ("src/_b.js", "src/.c.js", ".hidden/d.ts", "node_modules/x.js", "a/node_modules/y.js", "a/jquery-1.js", "a/z.min.js", "a/z.css", "r.md"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"let a\xff = 1")
    rows = {r.relative_path: r for r in scan.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"src/_b.js", "src/.c.js", ".hidden/d.ts", "r.md"}
    assert rows["r.md"].content == "let a� = 1" and rows["r.md"].size == 10


def test_parsed_units(spark):
    vue = "<template><p/></template>\n<script>\nexport default { props: { a: String }, methods: { go(x) { return 1 } } }\n</script>"
    files = spark.createDataFrame([("p", "/r/a.js", "a.js", "// hi\nfunction f(a) {\n}\n"), ("p", "/r/b.vue", "b.vue", vue), ("p", "/r/c.json", "c.json", "{}"), ("p", "/r/d.js", "d.js", None), ("p", "/r/e.js", "e.js", "function ( {{{")], "project string, path string, relative_path string, content string")
    rows = parse.parsed(files).collect()
    assert sorted((r.type, r.name) for r in rows) == [("component", "b"), ("file", "a.js"), ("file", "b.vue"), ("file", "c.json"), ("file", "e.js"), ("function", "f"), ("function", "go")]
    f = next(r for r in rows if r.name == "f")
    assert "函数签名: f(a)" in f.content and "功能说明: hi" in f.content and (f.start_line, f.end_line) == (2, 3)
    assert len({r.id for r in rows}) == len(rows)
    assert {r.id for r in parse.parsed(files).collect()} == {r.id for r in rows}
    assert parse.parsed(files.limit(0)).count() == 0


def test_stream_processes_each_record_once(spark, tmp_path):
    from skein.operators.incremental import Ledger
    from skein.streaming.ingest import follow

    schema = "project string, relative_path string, size long, checksum string"
    for n in range(2):
        spark.createDataFrame([("p", "a", 1, "x"), ("p", f"b{n}", n, "y")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), lambda df: df.select("project", "relative_path"), str(tmp_path / "ck")).awaitTermination()
    assert sorted(r.relative_path for r in Ledger(spark, str(tmp_path / "out")).output().collect()) == ["a", "b0", "b1"]


def test_stream_keeps_the_newest_version(spark, tmp_path):
    from skein.operators.incremental import Ledger
    from skein.streaming.ingest import follow

    schema = "project string, relative_path string, size long, checksum string, mtime long"
    rows = [("p", f"f{i}", v, f"v{v}", v) for i in range(20) for v in ((1, 2, 3) if i % 2 else (3, 1, 2))]
    for n in range(3):  # a backlog: one version of each file in each
        spark.createDataFrame(rows[n::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for version, expected in (("mtime", {3}), (None, {2, 3})):
        out = str(tmp_path / f"out_{version}")
        follow(spark, str(tmp_path / "in"), schema, out, lambda df: df.select("project", "relative_path", "size"), str(tmp_path / f"ck_{version}"), version=version).awaitTermination()
        got = Ledger(spark, out).output().collect()
        assert len(got) == 20 and {r.size for r in got} == expected


def test_functions_of_a_second_script(spark):
    vue = "<script>\nexport default { methods: { alpha() { return 1 } } }\n</script>\n<script setup>\nfunction beta() {\n  return 2\n}\n</script>"
    rows = {r.name: r.content for r in parse.parsed(spark.createDataFrame([("p", "/r/b.vue", "b.vue", vue)], "project string, path string, relative_path string, content string"), "function").collect()}
    assert "function beta() {\n  return 2\n}" in rows["beta"] and "alpha() { return 1 }" in rows["alpha"]


def test_texts_of_files(spark, tmp_path):
    (tmp_path / "a.js").write_text("let a")
    df = spark.createDataFrame([(str(tmp_path / "a.js"),), (str(tmp_path / "none.js"),), (None,)], "path string")
    assert {r.path and r.path[-4:]: r.content for r in scan.with_texts(df).collect()} == {"a.js": "let a", "e.js": None, None: None}
    listed = scan.scan(spark, str(tmp_path), content=False).collect()
    assert len(listed) == 1 and listed[0].content is None and listed[0].size == 5


def test_project_lookup(spark):
    from skein.sources import config

    projects = spark.createDataFrame([("1", "a", "C:\\x", True), ("2", "1", "/y", False), ("3", "a", "/z", None)], "id string, name string, path string, indexed boolean")
    keys = spark.createDataFrame([("1",), ("a",), ("none",), (None,)], "key string")
    got = {r.key: (r.id, r.path) for r in config.lookup(projects, keys).collect()}
    assert got == {"1": ("1", "C:/x"), "a": ("1", "C:/x"), "none": (None, None), None: (None, None)}


def test_component_text(spark):
    vue = "<template><p>{{ a }}</p></template>\n<script>\nexport default { props: { a: String, b: Number }, emits: ['done', \"go\"], methods: { async save(x, { y }) { return 1 } } }\n</script>"
    row = parse.parsed(spark.createDataFrame([("p", "/r/views/Box.vue", "views/Box.vue", vue)], "project string, path string, relative_path string, content string"), "function").where("type = 'component'").first()
    assert (row.name, row.start_line, row.end_line) == ("Box", 1, 4)
    assert row.content.startswith("文件: views/Box.vue\n类型: Vue组件\n\n组件属性 (Props): a, b\n组件事件 (Emits): done, go\n\n方法列表:\n- async save(x, param)\n\nTemplate:\n<p>{{ a }}</p>\n\nScript:\n")
    import json

    assert json.loads(row.metadata) == {"extension": ".vue", "relativePath": "views/Box.vue", "props": ["a", "b"], "emits": ["done", "go"]}
