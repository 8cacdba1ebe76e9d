"""Goldens worked out by hand."""

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import context, rank


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


@pytest.mark.parametrize(
    "text, expected",
    [("用户登录失败时前端怎么处理 login Failed_x ab", ["用户登录失败时前", "端怎么处理", "login", "failed_x"]), ("登录 a1 OK foo-bar", ["登录", "foo", "bar"]), ("b login login", ["login"]), ("", []), (None, [])],
)
def test_tokens(spark, text, expected):
    assert one(spark, T.tokens(F.lit(text).cast("string"))) == expected


@pytest.mark.parametrize("word, weight", [("逻辑", 0.0), ("登录", 0.8), ("x", 0.4), ("auth", 1.0), ("login", 1.0), ("signin", 1.2), ("", 0.0), (None, 0.0)])
def test_specificity(spark, word, weight):
    assert one(spark, T.specificity(F.lit(word).cast("string"))) == weight


def test_set_similarities(spark):
    a, b, none = (T.tokens(F.lit(x)) for x in ("login user page", "login page admin form", ""))
    assert one(spark, T.overlap(a, b)) == pytest.approx(2 / 3)
    assert one(spark, T.jaccard(a, b)) == pytest.approx(0.4)
    assert one(spark, T.overlap(a, none)) == one(spark, T.jaccard(none, b)) == 0.0


@pytest.mark.parametrize("path, key", [("/p/src/Views/Login/index.vue", "views/login"), ("C:\\p\\src\\a.js", "a.js"), ("/a/b/c/d.js", "b/c/d.js"), ("/x.js", "x.js")])
def test_path_key(spark, path, key):
    assert one(spark, T.path_key(F.lit(path))) == key


@pytest.mark.parametrize("path, ext", [("/a/b.js", ".js"), ("/x/.env", ""), ("/x/.a.js", ".js"), ("/x.y/b", ""), ("/x/a.min.js", ".js"), ("/x/a.", ".")])
def test_extension(spark, path, ext):
    assert one(spark, T.extension(F.lit(path))) == ext


@pytest.mark.parametrize(
    "query, limit, expected", [("login", 10, "...fghijlogin..."), ("nothere", 10, "abcdefghij..."), ("zzzzzzzzzz", 10, "...56789zzzzz..."), ("0123456789 login", 11, "...login012345..."), ("login", 100, "abcdefghijlogin0123456789zzzzzzzzzz")]
)
def test_snippet(spark, query, limit, expected):
    assert one(spark, T.snippet(F.lit("abcdefghijlogin0123456789zzzzzzzzzz"), T.tokens(F.lit(query)), limit)) == expected


def test_dependencies_and_props(spark):
    assert one(spark, T.dependencies(F.lit("import a from 'x'\nimport 'w'\nconst y=require('y')\nimport(\"z\")"))) == ["w", "y", "z"]
    assert one(spark, T.declared_props(F.lit("props: { a: String, b: Number }"))) == ["a", "b"]
    assert one(spark, T.declared_props(F.lit("props: { a: { type: String, default: '' }, b: Number }"))) == ["a", "default"]
    assert one(spark, T.declared_emits(F.lit("emits: ['x', \"y\"]"))) == ["x", "y"]


@pytest.mark.parametrize("n, tokens", [(0, 0), (1, 1), (5, 2), (1200, 480)])
def test_token_estimate(spark, n, tokens):
    assert one(spark, T.token_estimate(F.lit("a" * n))) == tokens


@pytest.mark.parametrize("size, cap", [(2048, 1800), (4096, 2990), (8192, 3000)])
def test_embed_cap(spark, size, cap):
    assert len(one(spark, T.embed_text(F.lit("a" * 5000), size))) == cap + 3


@pytest.mark.parametrize(
    "path, name, kind, content, score, matches, points",
    [("/p/src/user/login.js", "loadUser", "function", "await fetchUser()", 300.0, 2, 405), ("/p/docs/a.md", "readme", "file", "x", 900.0, 0, -120), ("/p/src/index.js", "target", "function", "x", 0.0, 0, 200), ("/p/src/index.js", "foo", "block", "x", 1000.0, 0, -40)],
)
def test_evidence(spark, path, name, kind, content, score, matches, points):
    df = spark.createDataFrame([(path, name, kind, content, score)], "file_path string, name string, type string, content string, score double")
    m = F.array_repeat(F.lit("k"), matches)
    assert df.select(rank.evidence_score(matches=m).alias("x")).collect()[0].x == pytest.approx(points)


def test_citations(spark):
    good = "## 结论\n是 来源[1]\n## 证据\n来源[2] 来源[9]"
    assert one(spark, context.valid_citation(F.lit(good), F.lit(3)))
    assert one(spark, context.citations(F.lit(good), F.lit(3))) == [1, 2]
    assert not one(spark, context.valid_citation(F.lit("## 结论\n是\n## 证据\n来源[1] 来源[2]"), F.lit(3)))
    assert not one(spark, context.valid_citation(F.lit(None).cast("string"), F.lit(3)))
