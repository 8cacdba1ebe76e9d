from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import incremental as inc
from skein.operators.index import Index, embed, without_paths
from skein.models import HashingEmbedder, ScriptedChat
from skein.operators import assist
from skein import schema as S

FILES = "project string, relative_path string, mtime_ms double, size long, scanned_at timestamp, extra string"
STATE = "project_id string, relative_path string, mtime_ms double, size long, run_id long, updated_at string"
RUNS = "run_id long, project_id string, started_at timestamp, finished_at timestamp, status string"


def t(day):
    return datetime(2025, 1, day)


def test_pending(spark):
    files = spark.createDataFrame([("p", "a", 1.0, 1, t(1), ""), ("p", "a", 2.0, 1, t(2), ""), ("p", "s/b", None, 1, t(1), ""), ("p", "s/c", 1.5, 1, t(1), ""), ("p", "new", 1.0, 1, t(1), ""), ("q", "a", 1.0, 1, t(1), ""), (None, "a", 1.0, 1, t(1), ""), ("p", "same", 1.0, 1, t(1), ""), ("p", "same", 1.0, 1, t(1), "")], FILES)
    state = spark.createDataFrame([("p", "a", 1.0, 1, 1, ""), ("p", "s\\b", None, 1, 1, ""), ("p", "s\\c", 1.0, 1, 1, ""), ("p", "s/c", 1.5, 1, 2, ""), ("p", "gone", 1.0, 1, 1, ""), ("q", "a", 1.0, 1, 4, ""), ("p", "same", 1.0, 1, 3, ""), ("p", "same", 1.0, 1, 3, "")], STATE)
    runs = spark.createDataFrame([(1, "p", t(1), t(2), "success"), (2, "p", t(1), t(9), "failed"), (3, "p", t(1), t(1), "success"), (4, "q", t(1), None, "running")], RUNS)
    assert {(r.project, r.relative_path) for r in inc.pending(files, state, runs).collect()} == {("p", "a"), ("p", "s/c"), ("p", "new"), ("q", "a")}
    status = {(r.project, r.relative_path): r.status for r in inc.changes(files, state, runs).collect()}
    assert status["p", "gone"] == "deleted" and status["p", "same"] == "unchanged" and status["p", "s/b"] == "unchanged"
    assert inc.pending(files.limit(0), state, runs).count() == 0
    assert inc.pending(files, state.limit(0), runs.limit(0)).count() == 6


def test_ledger_survives_failures(spark, tmp_path):
    listing = spark.createDataFrame([("p", "a", 1, "x"), ("p", "b", 2, "y"), (None, "c", 3, None)], "project string, relative_path string, size long, checksum string")
    ledger = inc.Ledger(spark, str(tmp_path))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run("b1", listing, broken)
    assert ledger.output() is None and ledger.pending(listing).count() == 3
    job = lambda df: df.select("project", "relative_path", F.col("size").alias("n"))
    assert ledger.run("b1", listing, job) == 3
    assert ledger.run("b1", listing, job) == 0
    changed = listing.withColumn("checksum", F.when(F.col("relative_path") == "b", "z").otherwise(F.col("checksum")))
    assert [r.relative_path for r in ledger.pending(changed).collect()] == ["b"]
    assert ledger.run("b2", changed, job) == 1
    assert ledger.run("b3", changed, job) == 0
    assert sorted(r.relative_path for r in ledger.output().collect()) == ["a", "b", "c"]


def unit(i, path, kind="function"):
    return (f"id{i}", "p", "/r/" + path, path, kind, f"n{i}", f"load user {i}", 1, 2, [], "{}", None)


def test_index_twice_is_index_once(spark, tmp_path):
    units = spark.createDataFrame([unit(1, "a.js"), unit(2, "b.js"), unit(3, "c.js", "file")], S.UNITS)
    done = embed(units, HashingEmbedder())
    assert done.where("error is null").count() == 2
    index = Index(spark, str(tmp_path / "i"))
    touched = units.select("project", "relative_path")
    assert index.read() is None
    index.replace(done, touched)
    index.replace(done, touched)
    assert index.read().count() == 2 and index.version() == 2
    index.delete(touched.where("relative_path = 'a.js'"))
    assert [r.id for r in index.read().collect()] == ["id2"]
    assert without_paths(units, units.where("id = 'id1'").select("project", "file_path")).count() == 2


class Broken:
    def embed(self, texts):
        if "user 1" in texts[0]:
            raise ValueError("no")
        return [[0.0] * 64]


def test_one_failed_unit_does_not_stop_the_rest(spark):
    rows = embed(spark.createDataFrame([unit(1, "a.js"), unit(2, "b.js")], S.UNITS), Broken()).collect()
    assert {r.id: r.error for r in rows} == {"id1": "no", "id2": None}


def test_assist_fallbacks():
    results = [{"name": "f", "type": "function", "file_path": "/a", "start_line": 1, "end_line": 2, "content": "x"}, {"name": "g", "type": "function", "file_path": "/b", "start_line": 1, "end_line": 2, "content": "y"}]
    down = ScriptedChat([OSError("down")])
    assert assist.expand_query(down, "登录失败")["keywords"] == ["登录", "login", "auth", "signin"]
    assert assist.expand_query(ScriptedChat(['so {"keywords": ["a"], "expandedQueries": ["b"]} there']), "q") == {"keywords": ["a"], "expanded": ["b"]}
    assert assist.model_rerank(ScriptedChat(["score: [2, 9]"]), "q", results)[0]["name"] == "g"
    assert assist.model_rerank(ScriptedChat(["[8.5, 5]"]), "q", results) == results
    assert assist.understand(ScriptedChat(["nonsense"]), "the login page", ["login", "cart"])["keywords"] == ["login"]
    assert assist.analyze_report(down, "【首页】加载失败 https://x.y/z").keywords == ["首页", "加载失败"]
    assert assist.analyze_code(down, "s", [], results)["suspicious"][1]["confidence"] == "low"
    good = "## 结论\n来源[1]\n## 证据\n来源[2]"
    assert assist.grounded_answer(ScriptedChat([good]), "q", "p", results) == (good, 1)
    answer, calls = assist.grounded_answer(ScriptedChat(["bad ``` code"]), "q", "p", results, "w", results * 2)
    assert calls <= 5 and assist.is_grounded(answer, 4)
    assert "2 个" in assist.summary(4, [{"confidence": "high"}] * 2)


def test_ledger_keeps_one_version_of_a_record(spark, tmp_path):
    schema = "project string, relative_path string, size long, checksum string"
    ledger = inc.Ledger(spark, str(tmp_path))
    job = lambda df: df.select("project", "relative_path", "checksum")
    one = spark.createDataFrame([("p", "a", 1, "x"), ("p", "b", 2, "y"), (None, "c", 3, None)], schema)
    two = spark.createDataFrame([("p", "a", 1, "z"), ("p", "d", 2, "y")], schema)
    assert ledger.run("b1", one, job) == 3
    # a run that fails after its output is written, before its commit, leaves nothing behind that counts
    commit, ledger._commit = ledger._commit, lambda entry: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        ledger.run("b2", two, job, complete=True)
    ledger._commit = commit
    assert ledger.commits() == ["b1"] and ledger.output().count() == 3 and ledger.pending(two).count() == 2
    assert ledger.run("b2", two, job, complete=True) == 2 and ledger.run("b2", two, job, complete=True) == 0
    expected = {("a", "z"), ("d", "y")}
    assert {(r.relative_path, r.checksum) for r in ledger.output().collect()} == expected
    assert ledger.pending(one).count() == 3
    ledger.compact("all")
    ledger.vacuum()
    assert {(r.relative_path, r.checksum) for r in ledger.output().collect()} == expected
    assert ledger.pending(two).count() == 0 and ledger.run("b1", one, job) == 0 and ledger.run("b3", one, job) == 3
    assert {(r.relative_path, r.checksum) for r in ledger.output().collect()} == {("a", "x"), ("b", "y"), ("c", None), ("d", "y")}
    with pytest.raises(ValueError):
        ledger.run("b4", two, lambda df: df.select("size"))


def test_two_commits_at_once(spark, tmp_path):
    schema = "project string, relative_path string, size long, checksum string"
    one, two = inc.Ledger(spark, str(tmp_path)), inc.Ledger(spark, str(tmp_path))
    rows = lambda c: spark.createDataFrame([("p", "a", 1, c)], schema)

    def job(df):
        two.run("inner", rows("y"), lambda d: d)  # the other run commits while this one works
        return df

    one.run("outer", rows("x"), job)
    assert sorted(one.commits()) == ["inner", "outer"] and [r.checksum for r in one.output().collect()] == ["x"]


def test_index_by_project(spark, tmp_path):
    make = lambda rows: spark.createDataFrame([(f"id{i}", p, None, f, "function", "n", "c", 1, 2, [], "{}", [float(i)]) for i, p, f in rows], S.UNITS)
    index = Index(spark, str(tmp_path / "i"))
    index.append(make([(1, "p", "a"), (2, "q/1", "b"), (3, None, "c")]))
    index.append(make([(4, "p", "a")]))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(index.read()) == ["id1", "id2", "id3", "id4"] and ids(index.read(["q/1"])) == ["id2"]
    index.replace_project("p", make([(5, "p", "z"), (6, "other", "z")]))
    assert ids(index.read()) == ["id2", "id3", "id5"]
    index.delete(make([(2, "q/1", "b")]).select("project", "relative_path"))
    assert ids(index.read()) == ["id3", "id5"]
    index.delete(make([(3, None, "c")]).select("project", "relative_path"))
    assert ids(index.read()) == ["id5"]
    index.vacuum(1)
    assert index.versions() == [5] and ids(index.read()) == ["id5"]
    base = index.version()
    index._write(make([(7, "p", "a")]), base, {}, False)
    with pytest.raises(RuntimeError):
        index._write(make([(8, "p", "a")]), base, {}, False)  # another run took the version
    assert ids(index.read()) == ["id7"]


def test_embedding_statistics(spark):
    class Slow:
        attempts = [2]

        def embed(self, texts):
            self.attempts = [2] * len(texts)
            return [[0.0] * 64] * len(texts)

    from skein.operators.index import embedding_stats

    done = embed(spark.createDataFrame([unit(1, "a.js"), unit(2, "b.js")], S.UNITS), Slow())
    row = embedding_stats(done).first()
    assert (row.calls, row.failed, row.average_attempts, row.first_try_percent) == (2, 0, 2.0, 0.0)
    row = embedding_stats(done.limit(0)).first()
    assert (row.calls, row.average_attempts) == (0, 0.0)


def test_repair_of_answers():
    results = [{"name": "f", "type": "function", "file_path": "/a", "start_line": 1, "end_line": 2, "content": "x"}] * 2
    good = "## 结论\n来源[1]\n## 证据\n来源[2]"
    chat = ScriptedChat(["no", good])
    assert assist.grounded_answer(chat, "q", "p", results) == (good, 2)
    assert "1 到 2 的来源编号" in chat.seen[1][0]["content"] and chat.seen[1][0]["content"].startswith("p\n\n")
    fenced = good + "```"
    assert assist.grounded_answer(ScriptedChat([fenced]), "q", "p", results) == (fenced, 2)  # a fence alone does not call for the fallback
    assert assist.rewrite(ScriptedChat([" a b \n"]), "q") == "a b"
