"""Parts that need no Spark."""

import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import bpe, chunking, gll, handmade, languages, packing, prose, quality, validity

R = gll.Recogniser()
BOTH = gll.SCRIPT | gll.MODULE


@pytest.mark.parametrize(
    "text",
    ["", "a = b\n(c)", "if (a)\n{ b }\nelse\n{ c }", "x = y\n .foo()\n .bar(z => z.q)", "for (const a of b) { if (a) continue\n else break }", "label: for (;;) { break label }", "class A { static #x = 1\n async *g() { yield* await 1 } get [k]() { return this.#x } }", "const {a = 1, ...b} = c, [d, , e] = f", "`a${`b${c}`}`", "var async = 1; async()", "do x++\nwhile (x < 5)", "a ? b : c ? d : e", "switch (a) { case 1: b\n default: c }", "try { } catch { } finally { }", "(async () => { await x })()", "import('x').then(a => a?.b?.[0]?.(1))", "x = function* () { yield }", "if (a) ; else b", "new.target", "export { a as default } from 'b'", "import a, { default as b } from 'c'", "await x\nexport {}"],
)
def test_valid_javascript(text):
    if text == "new.target":
        text = "function f() { new.target }"
    assert R.accepts(text, BOTH, False), text


@pytest.mark.parametrize("text", ["const = 1", "a b", "let a: number = 1", "if (a", "return 1", "<<<<<<< HEAD\na\n=======\nb\n>>>>>>> x", "function f( { }", "x = <div/>", "a = “b”", "const <%= x %> = 1", "foo(a, [1, 2)", "'open", "server:\n  filter: 73\n  score:\n    - address: total 0", "import os\n\ndef f(a):\n    pass", "{ \"a\": 1, \"b\": 2 }", "await x", "function f() { await x }", "interface A { }", "const a", "for (const a b) {}", "class A { x y }"])
def test_invalid_javascript(text):
    assert not R.accepts(text, BOTH if text != "await x" else gll.SCRIPT, False), text


@pytest.mark.parametrize("text", ["interface A<T> extends B { a?: string; [k: string]: any\n f(x: number): void }", "const f = async <T,>(a: T, b?: string[]): Promise<Record<string, any>> => { return a as any }", "type X = { [K in keyof T]?: T[K] } | ((a: string) => void)", "enum A { B = 1, C }", "export abstract class Foo<T> { private readonly x: Map<string, Array<number>> = new Map(); constructor(private a: string) { super() } }", "let x = <any>y!", "declare module 'x' { export function f(): void }", "function f(a?: string): a is string;", "import type { A } from 'b'", "let t: [a: string, b?: number] = x satisfies Y"])
def test_typescript(text):
    assert R.accepts(text, gll.TYPED, False), text
    assert not R.accepts(text, BOTH, False), text


def test_jsx():
    text = "const a = () => (<><p {...q} a=\"b\" c={d}>it's {e && <b/>} {/* f */}</p></>)"
    assert R.accepts(text, BOTH, True) and not R.accepts(text, BOTH, False)
    assert not R.accepts("x = <a><b></a>", BOTH, True)


@pytest.mark.parametrize("text, ext, ok", [("", ".json", False), ("", ".js", True), (None, ".json", True), ("[1,]", ".json", False), ("{\"a\": NaN}", ".json", False), ("﻿{}", ".json", True), ("# x", ".md", True), ("<style></style>", ".vue", False), ("<template>a</template>", ".vue", True), ("<template>a", ".vue", False), ("<script>let a: b</script>", ".vue", False), ("<script lang=\"ts\">let a: b</script>", ".vue", True), ("<!-- x\nlet a = 1", ".js", True), ("((((" * 3000 + "))))" * 3000, ".js", False)])
def test_validity(text, ext, ok):
    assert validity.valid(text, ext) == ok


def test_deep_nesting_does_not_crash():
    assert validity.valid("(" * 3000 + "a" + ")" * 3000, ".js")


@given(st.text(alphabet="ab \n\r日", max_size=400), st.integers(10, 60), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_text(text, limit, overlap):
    got = list(chunking.pieces(text, limit, overlap))
    assert got[0][0] == 0 and got[-1][2] == len(text)
    for (a, fresh, b), (a2, fresh2, b2) in zip(got, got[1:]):
        assert fresh2 == b and b - overlap <= a2 <= b and b2 > fresh2
    assert all(b - a <= limit for a, _, b in got) or len(text) <= limit


def test_pieces_cut_where_the_topic_changes():
    text = "\n".join(["alpha beta gamma delta"] * 30 + ["omega sigma kappa theta"] * 30) + "\n"
    got = list(chunking.pieces(text, 900, 0))
    assert got[0][2] == 30 * 23


@pytest.mark.skipif(not os.path.exists(os.path.join(bpe.VOCABULARIES, "byte_bpe_50k.json")), reason="no vocabulary")
def test_bpe_equals_the_reference_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(bpe.VOCABULARIES, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    e = bpe.encoder()
    rnd = random.Random(5)
    texts = ["", " ", "\n\n  x", "用户登录ログイン😀", "<|endoftext|>", "a" * 3000, "don't DON'T 123abc  \t"] + ["".join(rnd.choice("aeioutnsr \n.,_()=é用ロ😀AB019") for _ in range(rnd.randint(1, 200))) for _ in range(300)]
    assert [e.ids(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.ids(None) == []


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=12))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_item_once(counts):
    runs, total = packing.plan(counts, 64)
    room: dict[int, set] = {}
    for length, n in counts.items():
        ranks = []
        for r in runs[length]:
            for i in range(r.containers * r.each):
                slot, c = divmod(i, r.containers)
                start = r.start + slot * length
                cells = set(range(start, start + length))
                assert max(cells) < 64 and not cells & room.setdefault(r.container + c, set())
                room[r.container + c] |= cells
                ranks.append(r.rank + i)
        assert ranks == list(range(n))
    assert len(room) == total
    rooms: list[int] = []
    for length in sorted(counts, reverse=True):  # best fit, item by item
        for _ in range(counts[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(64 - length)
    assert total == len(rooms)


def test_plan_of_nothing():
    assert packing.plan({}) == ({}, 0)
    assert packing.plan({5000: 2, 0: 3})[1] == 0


@pytest.mark.parametrize(
    "comment, name, ok",
    [("/** Loads the list of all open orders again. */", "f", True), ("// Format order state helper", "formatOrderState", False), ("/**\n * @param {string} a the name of the user that is shown\n * @returns {*}\n */", "f", False), ("// f(a, b);\n// return a.b", "f", False), ("/* Copyright (c) 2024 Some Company. All rights reserved by them. */", "f", False), ("// eslint-disable-next-line no-console -- we need it here for now", "f", False), ("/** 索引任务负责缓存草稿收货地址 */", "f", True), ("/** 函数说明 */", "f", False), (None, "f", False), ("", None, False), ("/**\n * @description Loads the list of all open orders\n */", "f", True), ("* f：この関数は注文の一覧を読み込みます。", "f", True)],
)
def test_descriptions(comment, name, ok):
    assert prose.is_description(comment, name or "") == ok


def test_adjacent_line_comments_are_one():
    from skein.functions import jslex

    text = "// one two three\n// four five six\n\n// apart\nx = 'it\\u0061 \\n b'"
    got = [t for _, _, _, t in prose.stretches(jslex.scan(text)[1], text)]
    assert got == ["// one two three\n// four five six", "// apart", "ita \n b"]


@pytest.mark.parametrize(
    "path, text, kind",
    [
        ("src/a.js", "// This file was automatically generated from the schema.\n\nexport const A_0 = \"1\";\n" + "".join(f"export const B_{i} = \"{i}\";\n" for i in range(30)), "generated"),
        ("src/a.js", "// The key below is generated by the server, do not edit it.\nimport a from 'b'\nexport function f(x) {\n  if (!x) return null\n  return a(x)\n}\n", None),
        ("vendor/lib/a.js", "export function f(x) {\n  return x\n}\n", "vendored"),
        ("src/vendors/a.js", "export function f(x) {\n  return x\n}\n", None),
        ("src/a.js", "/*!\n * lib v1.2.3\n * Released under the MIT license\n */\nfunction f() {}\n", "vendored"),
        ("src/a.js", "!function(a){\"use strict\";a.b||(a.b=!0)}(this.c||{});" * 30, "minified"),
        ("src/a.js", "export const points = [\n" + "  [1.25, 3.75, -2.5, 9.125],\n" * 40 + "]\n", "data"),
    ],
)
def test_handmade(path, text, kind):
    assert handmade.judge(path, text, ".js")[0] == kind


@pytest.mark.parametrize(
    "text, prose_",
    [("The parser keeps the last known path. It fails when the server answers late.", True), ("between four and six the parser keeps the last known path while the drawer is still open", True), ("Die Sitzung speichert die offenen Anfragen, solange der Benutzer nichts bestätigt hat.", True), ("订单表单会合并未完成的请求，当窗口重新获得焦点时执行。", True), ("セッション管理は三回失敗したあとで表示中の列をまとめます。", True), ("Home | About | Help\nDocs | Next | Login", False), ("a\tb\t1\t0.5\n" * 9, False), ("- cart id\n- order score\n- unit total", False), ("Or under and order token or under is. Not not cart price blue when list under with under of. A is of the by.", False), ("function f(row) {\n  return row.a\n}", False), ("g1w6wqw9O1TuC/CBCDpscrNrgnP6zZQeCW9ghXIYI6UK8Yl+DAQp", False), ("undefined undefined undefined undefined undefined", False), ("Hide the scrollPosition() by comparing the sizeAnd() the time of the file.", True)],
)
def test_readable_share(text, prose_):
    share = quality.readable_share(text)
    assert (share >= 0.5) == prose_


def test_measures_of_blank_texts():
    assert quality.measure(None) == quality.measure(" \n") == (0,) + (None,) * (len(quality.STATISTICS) - 1) and quality.readable_share(None) is quality.readable_share(" ") is None


def test_languages_by_encoded_size():
    coder = languages.Coder({"en": languages.dictionary([f"the {a} of the {b} is not {c}" for a in ("list", "page", "order") for b in ("user", "cart", "server") for c in ("open", "late", "ready")]), "de": languages.dictionary([f"die {a} der {b} ist nicht {c}" for a in ("Liste", "Seite", "Frage") for b in ("Benutzer", "Bestellung", "Antwort") for c in ("offen", "da", "fertig")]), "code": languages.dictionary(languages._CODE)})
    assert coder.language("the page of the server is not ready today") == "en"
    assert coder.language("die Seite der Antwort ist nicht fertig") == "de"
    assert languages.Coder({}).language("the page of the server") is None
    assert languages.dictionary([]) == b""


def test_a_library_that_registers_at_its_end():
    from skein.llm import handmade

    parts = ["  if (!a{i}.ready) return b{i}.fallback\n", "  for (const key of Object.keys(a{i})) b{i}.push(key)\n", "  throw new RangeError('bad ' + a{i})\n", "  while (a{i}.size > b{i}.limit) a{i}.pop()\n", "  switch (a{i}) { case 1: return b{i}.third() }\n"]
    body = "".join("function f%d(x) {\n" % i + "".join(parts[j % 5].replace("{i}", str(i)) for j in range(i % 3, i * i % 7 + 3)) + "}\n" for i in range(40))
    assert len(body) > 3000 and handmade.judge("src/x.js", body, ".js")[0] is None
    assert handmade.judge("src/x.js", body + "if (typeof define === 'function' && define.amd) define(f1)\n", ".js")[0] == "vendored"
    assert handmade.judge("src/x.js", body + "log(\"define.amd\") // define.amd\n", ".js")[0] is None


def test_arrow_functions_with_types_over_lines():
    from skein.sources.jsfunctions import functions as nodes

    text = "/** a */\nexport const load: Loader<\n  Foo\n> = async (id) => id\n/** b */\nconst cmp: (a: A,\n  b: B) => number = (a, b) => 1\n// c\nlet x: number\nfoo = (z) => 2\n// d\nconst one: F = y => 3\n"
    for documented in (False, True):
        assert [(f.name, f.is_async, f.params) for f in nodes(text, documented=documented)] == [("load", True, ["id"]), ("cmp", False, ["a", "b"]), ("one", False, ["y"])]


@pytest.mark.parametrize("text", ["a ?? b || c", "a || b ?? c", "-1 ** 2", "await x ** 2", "({get a(x){}})", "({set a(){}})", "if (a) let b = 1", "while (a) class B {}", "1 = 2", "f() = 1", "a + b = 1", "!a = 1", "[1] = x", "({a=1})", "a || () => 1"])
def test_holes_of_the_grammar(text):
    assert not R.accepts(text, BOTH, False), text


@pytest.mark.parametrize(
    "text",
    ["(a ?? b) || c", "(-1) ** 2", "a - b ** 2", "2 ** -1", "a++ ** 2", "({get a(){}, set b(x){}})", "if (a) function f(){}", "a.b = 1", "a[0] += 2", "(a) = 1", "[a, b.c, [d]] = e", "({a, b: c.d, e = 1} = f)", "({a=1}) => a", "for ({a=1} of b) ;", "for (a.b in c);", "x = {a: 1, get: 2, set, get b(){return 1}}", "x => ({y} = z)", "a.default = 1", "this.x = y = z", "a = b ? c : d = e", "new A().b = 1", "yield = 1", "x = `a${b}`[0]", "a?.[0](b).c"],
)
def test_no_hole_closed_too_far(text):
    assert R.accepts(text, BOTH, False), text


def test_long_lists_take_linear_time():
    import time

    n = 100_000
    texts = ["x=[" + ",".join(map(str, range(n))) + "]", "x={" + ",".join(f"a{i}:{i}" for i in range(n)) + "}", "f(" + ",".join(f"a{i}" for i in range(n)) + ")", "x=" + "+".join(f"a{i}" for i in range(n // 10)), "x=a" + ".m(1)" * (n // 10), "class A {" + "\n".join(f"m{i}() {{ }}" for i in range(n // 20)) + "}"]
    for text in texts:
        began = time.perf_counter()
        assert gll.Recogniser(BOTH).accepts(text, BOTH, False)
        assert time.perf_counter() - began < 10, text[:20]


def test_function_nodes_of_the_tree():
    from skein.llm import tree

    text = '// one\nexport default async function go(a, {b}) { return `${() => 1}` }\n/* two */\nexport const load = async (x) => {\n  class A {\n    // three\n    static async *run() { const inner = y => y }\n    get size() { return "}" }\n    field = 1\n  }\n}, other = 2\nconst s = "function no() {}" // behind\nfunction last() {}\n'
    got = {f.name: (f.kind, f.comments, text[f.start : f.end]) for f in tree.functions(text)}
    assert set(got) == {"go", "load", "run", "inner", "size", "last"}
    assert got["go"] == ("function", "// one", "async function go(a, {b}) { return `${() => 1}` }") and got["load"][:2] == ("arrow", "/* two */") and got["load"][2].startswith("async (x) =>") and got["load"][2].endswith("}\n}")
    assert got["run"] == ("method", "// three", "static async *run() { const inner = y => y }") and got["inner"] == ("arrow", None, "y => y") and got["size"][2] == 'get size() { return "}" }' and got["last"][1] is None
    assert tree.functions("function a( {") is None
    vue = "export default { data() { return { a: 1, b() {} } }, methods: { go: async () => 1, 'x': function () {}, y } }\nconst z = { no() {} }"
    assert [f.name for f in tree.functions(vue, objects=True)] == ["data", "b", "go", "x"]


def test_nodes_of_many_lines_and_dialects():
    from skein.llm import docpairs

    text = "﻿// the list of all open orders is read here\r\nexport function a<T>(x: T[]): Promise<void> {\r\n  return g(x)\r\n}\r\n"
    (name, start, end, line, last, comments), = docpairs.nodes(text, ".ts", True)
    assert (name, line, last) == ("a", 2, 4) and text[start:end].startswith("function a<T>") and text[start:end].endswith("}") and "open orders" in comments
    assert [n[0] for n in docpairs.nodes("// a broken file keeps its documented functions too\nfunction a() {}\n<<<<", ".js", True)] == ["a"]
    assert list(docpairs.nodes("// short\nfunction a() {}", ".js", True)) == [] and len(list(docpairs.nodes("// short\nfunction a() {}", ".js", False))) == 1
