"""Operators on small tables: brute force, nulls, empty tables, repeated rows, clashing columns."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import bpe, chunking, docpairs, handmade, languages, neighbours, packing, quality, queries, validity

NOW = datetime(2025, 1, 1)
FILES = "file_id long, project string, path string, relative_path string, extension string, size long, mtime_ms double, scanned_at timestamp, content string"
FUNCS = "func_id long, file_id long, name string, type string, params array<string>, start_line int, end_line int, content string, is_async boolean, is_exported boolean, comments string"
UNITS = "id string, vector array<float>, content string, file_path string, project string, type string, name string, start_line int, end_line int, dependencies string, metadata string, indexed_at timestamp"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, project string, created_at timestamp, loaded_at timestamp"
BODIES = ["if (!alpha.ready) return beta.fallback", "for (const key of Object.keys(alpha)) beta.push(key)", "while (alpha.size > beta.limit) alpha.pop()", "const total = alpha.reduce((a, b) => a + b, 0)", "try { beta.open(alpha) } catch (err) { alpha.close(err) }", "switch (alpha.kind) { case 'member3': return beta.third() }", "throw new RangeError('value out of range: ' + alpha)", "return typeof alpha === 'string' ? alpha.trim() : beta", "beta.on('change', () => alpha.emit('updated'))", "alpha.items.sort((x, y) => x.order - y.order)"]
LIB = "/**\n * @license lib 1.0.0\n */\n" + "".join(f"export function lib{i}(alpha, beta) {{\n  {b}\n}}\n" for i, b in enumerate(BODIES))
SAY = "The order form merges all pending orders before the route changes."


def files(spark):
    rows = [
        (1, "a.js", "let a = 1"), (2, "b.js", "let a: number"), (3, "c.json", ""), (4, "d.ts", None), (5, "e.vue", "<script>let</script"), (6, None, "x y"), (None, "f.js", "x y"), (2, "b.js", "let a: number"),
        (7, "g.js", f"// {SAY}\nexport function go() {{}}\n\n// go\nfunction no() {{}}\nclass A {{\n  /** {SAY} */\n  meth() {{}}\n}}\n"), (8, "vendor/lib/x.js", LIB), (9, "src/y.js", LIB.split("*/\n")[1].replace("member3", "edited")), (10, "long.js", "a = 1;\n" * 40_000),
    ]
    return spark.createDataFrame([(i, "p", p and "/r/" + p, p, None, len(c or ""), None, None, c) for i, p, c in rows], FILES)


def functions(spark):
    rows = [(70, 7, "go", 2, None), (71, 7, "no", 5, None), (72, 7, "meth", 8, None), (73, 7, "own", 1, f"*\n * {SAY}\n "), (74, 7, None, None, None), (None, 7, "go", 2, SAY), (75, None, "x", 1, "short"), (73, 7, "own", 1, f"*\n * {SAY}\n ")]
    return spark.createDataFrame([(i, f, n, "function", ["a"], s, s, "code", False, False, c) for i, f, n, s, c in rows], FUNCS)


def documents(spark):
    rows = [(1, SAY, "en"), (2, None, None), (3, "", "de"), (4, "  \n", "xx"), (5, "a\tb\t1\t2\n" * 20, "EN"), (6, "订单表单会合并未完成的请求，当窗口重新获得焦点时执行。", "zh-CN"), (7, SAY + " " + SAY.replace("order", "price"), "en"), (8, "word " * 5000, "en")]
    rows += [(100 + i, f"The {a} keeps the {b} of user {i} until the server answers.", "en") for i, (a, b) in enumerate((x, y) for x in ("parser", "loader", "session", "form") for y in ("path", "list", "token", "page", "order"))]
    rows += [(200 + i, f"Die {a} speichert die {b} von {i}, solange der Server nicht antwortet.", "de") for i, (a, b) in enumerate((x, y) for x in ("Sitzung", "Liste", "Seite", "Suche") for y in ("Anfrage", "Frage", "Zeile", "Spalte", "Datei"))]
    return spark.createDataFrame([(i, t, l, "s", None, None, None, None) for i, t, l in rows], DOCS)


def units(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 64))
    rows = []
    for i in range(200):
        v = base[i % 40] * (1 + i) + (rng.normal(size=64) * 0.12 * (1 + i) if i >= 40 else 0)
        rows.append((f"u{i:03d}", [float(x) for x in v], "x" * (i * 40), "/r/a.js", "file"))
    rows += [("same1", [1.0] * 64, None, None, "file"), ("same2", [2.0] * 64, "", "/r/b.ts", "file"), ("same3", [0.5] * 64, f"// {SAY}\nconst s = '{SAY}'", "/r/b.ts", "file"), rows[0], ("bad1", None, None, None, None), ("bad2", [0.0] * 64, None, None, None), ("bad3", [1.0], None, None, None), ("bad4", [float("nan")] * 64, None, None, None), (None, [1.0] * 64, "z", "/r/a.js", "file")]
    return spark.createDataFrame([(i, v, c, p, "p", t, "n", None, None, None, None, None) for i, v, c, p, t in rows], UNITS)


def ids(df):
    return {tuple(r) if len(r) > 1 else r[0] for r in df.collect()}


def test_validity(spark):
    assert ids(validity.found(files(spark))) == {2, 3, 5}
    rows = {(r.project, r.extension): (r.files, r.invalid) for r in validity.rates(files(spark)).collect()}
    assert rows["p", ".js"][1] == 1 and rows["p", ".json"] == (1, 1)


def test_documented_functions(spark):
    assert ids(docpairs.found(functions(spark), files(spark))) == {70, 72, 73}
    assert {r.func_id: r.description for r in docpairs.pairs(functions(spark), files(spark)).collect()}[72] == SAY


def test_handmade(spark):
    got = {r.file_id: r.kind for r in handmade.kinds(files(spark)).collect()}
    assert got[8] == "vendored" and got[9] == "copy" and not {1, 2, 7} & set(got)


def test_splitting_gives_the_text_back(spark):
    rows = chunking.split(units(spark), 2990, 200).orderBy("id", "piece").collect()
    long = {r.id: r.content for r in units(spark).where("length(content) > 2990").collect() if r.id}
    assert {r.id for r in rows} == set(long) == ids(chunking.found(units(spark)))
    assert all(len(r.content) <= 2990 and r.start_line == r.end_line == 1 for r in rows)


def test_lines_of_pieces(spark):
    text = "".join(f"line {i} of the text\n" for i in range(600))
    df = spark.createDataFrame([("a", text, 11)], "id string, content string, start_line int")
    lines = text.split("\n")
    for r in chunking.split(df).collect():
        assert r.content.rstrip("\n").split("\n")[0] in lines[r.start_line - 11] and r.content.rstrip("\n").split("\n")[-1] in lines[r.end_line - 11]


def test_neighbours_against_brute_force(spark):
    got = ids(neighbours.found(units(spark)))
    x = {r.id: np.array(r.vector, dtype=float) for r in units(spark).collect() if r.id and r.vector and len(r.vector) == 64 and np.isfinite(r.vector).all() and np.any(r.vector)}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    expected = set()
    for i, v in x.items():
        best = sorted((-round(float(v @ w), 5), j) for j, w in x.items() if j != i)[:5]
        expected |= {(min(i, j), max(i, j)) for c, j in best if -c >= 0.9}
    assert len(got & expected) >= 0.98 * len(expected) and len(got - expected) <= 0.02 * len(expected)
    assert {("same1", "same2"), ("same1", "same3"), ("same2", "same3")} <= got


def test_a_large_group_of_equal_vectors(spark):
    df = spark.range(3000).select(F.format_string("%05d", "id").alias("id"), F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vector"))
    near = neighbours.neighbours(df)
    assert near.count() == 15_000 and near.select("other").distinct().count() == 6


def test_tokens_and_packing(spark):
    e = bpe.encoder()
    got = {r.doc_id: r.ids for r in bpe.encoded(documents(spark)).collect()}
    assert got[2] == got[3] == [] and got[1] == e.ids(SAY)
    rows = packing.packed(documents(spark)).collect()
    assert {r.doc_id for r in rows} == {i for i, x in got.items() if x}
    spans = sorted((r.container, r.start, r.tokens) for r in rows)
    assert all(s + n <= 2048 for _, s, n in spans) and all(c != d or s + n <= t for (c, s, n), (d, t, _) in zip(spans, spans[1:]))
    parts = sorted((r.part, r.tokens) for r in rows if r.doc_id == 8)
    assert sum(n for _, n in parts) == len(got[8]) and [n for _, n in parts[:-1]] == [2048] * (len(parts) - 1)


def test_quality(spark):
    assert ids(quality.found(documents(spark))) == {5, 8}
    rows = {r.doc_id: r for r in quality.tails(documents(spark)).collect()}
    assert len(rows) == documents(spark).count() and rows[2].words == 0 and not rows[2].tail


def test_spoken_languages(spark):
    assert ("same3", "en") in ids(languages.found(units(spark), documents(spark)))
    assert languages.found(units(spark), documents(spark).limit(0)).count() >= 0
    assert languages.function_comments(functions(spark), documents(spark), units(spark)).where("func_id = 73").count() == 1


@pytest.mark.parametrize("name", sorted(queries.queries()))
@pytest.mark.parametrize("case", ["empty", "nulls", "clash"])
def test_edges(spark, tmp_path, name, case):
    """Empty tables, rows of nulls only, and extra columns with names that operators use inside."""
    tables = {"files": files(spark), "functions": functions(spark), "code_units": units(spark), "documents": documents(spark)}
    for t, df in tables.items():
        if case == "empty":
            df = df.limit(0)
        elif case == "nulls":
            df = spark.createDataFrame([tuple([None] * len(df.columns))] * 2, df.schema)
        else:
            df = df.limit(30)
            for c in ("rank", "kind", "lines", "unit", "point", "rep", "tree", "key", "salt", "tokens", "part", "language", "words", "tail", "line", "n"):
                if c not in df.columns:
                    df = df.withColumn(c, F.lit("x"))
        df.write.parquet(str(tmp_path / f"{t}.parquet"))
    out = queries.queries()[name](spark, str(tmp_path))
    n = out.count()
    if case == "empty":
        assert n == (name == "p6_recall")  # one row of totals
    assert len(set(out.columns)) == len(out.columns)


def test_a_dense_group_of_different_vectors(spark):
    """All of 6,000 vectors lie within a cosine of 0.95 to 0.995 of each other, and beside them 3,000 elsewhere."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) / 8 + rng.normal(size=(6000, 64)) * 0.018
    x = np.vstack([x, rng.normal(size=(3000, 64))])
    df = spark.createDataFrame([(f"d{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, vector array<float>")
    near = {}
    for r in neighbours.neighbours(df, least=0.9).collect():
        near.setdefault(r.id, set()).add(r.other)
    x /= np.linalg.norm(x, axis=1)[:, None]
    right = 0
    for i in range(0, 6000, 20):
        scores = x @ x[i]
        scores[i] = -2
        right += len(near[f"d{i:05d}"] & {f"d{j:05d}" for j in np.argsort(-scores)[:5]})
    assert right >= 0.98 * 1500


def test_every_usable_unit_has_its_five_neighbours(spark):
    got = {}
    for r in neighbours.neighbours(units(spark)).collect():
        got.setdefault(r.id, []).append(r.other)
    x = {r.id: np.array(r.vector, dtype=float) for r in units(spark).collect() if r.id and r.vector and len(r.vector) == 64 and np.isfinite(r.vector).all() and np.any(r.vector)}
    x = {i: v / np.linalg.norm(v) for i, v in x.items()}
    assert set(got) == set(x) and all(len(o) == 5 for o in got.values())
    right = sum(len(set(got[i]) & {j for _, j in sorted((-round(float(v @ w), 5), j) for j, w in x.items() if j != i)[:5]}) for i, v in x.items())
    assert right >= 0.99 * 5 * len(x)


def test_much_junk_does_not_hide_junk(spark):
    half = SAY + "\n" + "a\tb\t1\t22\t333\n" * 12
    assert 0.25 < quality.readable_share(half) < 0.5
    df = spark.createDataFrame([(i, half if i < 60 else SAY, "en", "s", None, None, None, None) for i in range(100)], DOCS)
    assert ids(quality.found(df)) == set(range(60))


@pytest.mark.parametrize("junk", [10, 90])
def test_the_sketches_of_ordinary_text_choose_what_is_read(spark, junk):
    verbs, names = ("keeps", "reads", "merges", "stores", "closes"), ("path", "list", "token", "page", "order", "window")
    good = [f"The {a} {v} every {b} before users of our shop open another drawer." for a in names for v in verbs for b in names][:100]
    bad = ["a\tb\t1\t22\t333\n" * 9, "Or under and order token or under is. Not not cart with when list under with under of. A is of the by it.", "undefined undefined undefined", "- cart id\n- order score\n- unit total"]
    rows = [(i, (bad[i % 4] if i % 100 < junk else good[i % 100]), "en", "s", None, None, None, None) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    want = {i for i, text, *_ in rows if quality.readable_share(text) < 0.5}
    assert ids(quality.found(df)) == want and len(want) >= 4 * junk
    by = {r.doc_id: r.tail for r in quality.tails(df).collect()}
    assert want <= {i for i, t in by.items() if t} and sum(not t for t in by.values()) >= 0.5 * (400 - 4 * junk)
    assert {r.statistic for r in quality.reasons(df).collect()} == {x for t in by.values() for x in t}


def test_a_popular_library_does_not_hide_a_copy(spark):
    """Half of the copied lines stand in fifty other library files, the other half only in the original."""
    line = lambda x, i: "  " + BODIES[i].replace("alpha", f"{x}{i}") + "\n"
    wrap = lambda body: "export function run(alpha, beta, gamma) {\n" + body + "}\n"
    common = "".join(line("common", i) for i in range(10))
    copy = wrap(common + "".join(line("own", i) for i in range(10)))
    mark = "/**\n * @license lib 1.0.0\n */\n"
    rows = [(1, "src/copy.js", copy), (2, "vendor/own.js", mark + copy), (3, "src/hand.js", wrap("".join(line("hand", i) for i in range(10)) + common.split("\n", 2)[2]))]
    rows += [(100 + v, f"vendor/other{v}.js", mark + wrap(common + "".join(line(f"v{v}x", i) for i in range(10)))) for v in range(300)]
    df = spark.createDataFrame([(i, "p", "/r/" + p, p, None, len(c), None, None, c) for i, p, c in rows], FILES)
    got = {r.file_id: r.kind for r in handmade.kinds(df).collect()}
    assert got.get(1) == "copy" and 3 not in got


def test_a_library_without_marks_in_three_projects(spark):
    """Edited copies of one library in four repositories, without banner, folder or loader, are found by their lines; what two projects share is not."""
    line = lambda x, i: "  " + BODIES[i].replace("alpha", f"{x}{i}") + "\n"
    wrap = lambda body: "export function run(alpha, beta, gamma) {\n" + body + "}\n"
    shared = [line("lib", i) for i in range(10)] + [line("more", i) for i in range(10)]
    rows = [(k, f"p{k}", f"src/a{k}.js", wrap("".join(x for i, x in enumerate(shared) if i != k) + line(f"edit{k}", 1))) for k in range(4)]
    rows += [(10 + k, f"p{k}", f"src/b{k}.js", wrap("".join(line("two", i) for i in range(10)) + "".join(line("pair", i) for i in range(10)))) for k in range(2)]
    rows += [(20 + k, f"p{k}", f"src/c{k}.js", wrap("".join(line(f"own{k}x", i) for i in range(10)) + "".join(shared[:8]))) for k in range(4)]
    df = spark.createDataFrame([(i, p, "/r/" + f, f, None, len(c), None, None, c) for i, p, f, c in rows], FILES)
    assert {r.file_id: r.kind for r in handmade.kinds(df).collect()} == {k: "copy" for k in range(4)}


def test_pieces_of_one_id_come_from_one_content(spark):
    rows = [("a", "x\n" * n, 1) for n in (2000, 4000, 9000)] * 2
    got = chunking.split(spark.createDataFrame(rows, "id string, content string, start_line int"), 2990, 0).orderBy("piece").collect()
    assert "".join(r.content for r in got) in {t for _, t, _ in rows} and [r.piece for r in got] == list(range(len(got)))


def test_recall_is_measured(spark):
    x = np.random.default_rng(8).normal(size=(3000, 64)) * np.linspace(2, 0.3, 64)
    df = spark.createDataFrame([(f"r{i:05d}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, vector array<float>")
    true = neighbours.exact(df)
    assert true.count() == 5 * neighbours.asked(df).count() > 0 and true.where("id = other").count() == 0
    row = neighbours.measured_recall(df).first()
    assert row.pairs == true.count() and row.hits >= 0.95 * row.pairs
    assert neighbours.recall(df.limit(0)).first().queries == 0
