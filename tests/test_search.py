import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import diversify, rank, search, vector, vocab

UNIT = "id string, project string, file_path string, type string, name string, content string, start_line int, end_line int, vector array<float>"


def units(spark, n=60, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"u{i:03d}", f"p{i % 3}", f"/a/src/m{i % 7}/f{i}.{'vue' if i % 2 else 'js'}", ("function", "component", "file")[i % 3], f"load{i}", f"login order {i} " * (i % 4), 1, 2, [float(x) for x in rng.normal(size=64)]) for i in range(n)]
    rows += [rows[0], ("n1", None, None, None, None, None, None, None, None), ("n2", "p0", "/x", "file", "a", "b", 1, 1, [1.0]), ("n3", "p0", "/x", "file", "a", "b", 1, 1, [float("nan")] * 64), (None, "p0", "/x", "file", "a", "b", 1, 1, [0.5] * 64)]
    return spark.createDataFrame(rows, UNIT)


def queries(spark, n=3):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(i, "login 订单", [float(x) for x in rng.normal(size=64)]) for i in range(n)] + [(99, None, None)], "query_id long, query string, vector array<float>")


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_knn_is_exact(spark, metric):
    u, q = units(spark), queries(spark)
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in vector.knn(q, u, 5, metric).collect()}
    x = {r.id: np.array(r.vector, dtype=float) for r in u.collect() if r.id and r.id.startswith("u")}
    for r in q.where("query_id < 99").collect():
        v = np.array(r.vector, dtype=float)
        d = sorted((round(float(((y - v) ** 2).sum() if metric == "l2" else 1 - y @ v / np.linalg.norm(y) / np.linalg.norm(v)), 6), i) for i, y in x.items())[:5]
        assert [got[r.query_id, k + 1] for k in range(5)] == [(i, pytest.approx(s, abs=2e-6)) for s, i in d]
    assert len(got) == 15


def test_filters_come_after_the_ranking(spark):
    u, q = units(spark), queries(spark)
    rows = vector.search(q, u, limit=5, projects=["p1"], code_types=["component"], file_types=[".vue"]).collect()
    near = {(r.query_id, r.id) for r in vector.knn(q, u, 10).collect()}
    assert all((r.query_id, r.id) in near and r.project == "p1" for r in rows)


@pytest.mark.parametrize("scores, kept", [([10, 20, 30, 400], 3), ([100, 200, 300, 1000], 3), ([0, 0, 0, 121], 3), ([10, 20, 300], 3), ([1, 2, 3, 4], 4)])
def test_outlier_cut(spark, scores, kept):
    df = spark.createDataFrame([(1, str(i), float(s)) for i, s in enumerate(scores)], "query_id int, id string, score double")
    assert vector.outlier_cut(df).count() == kept


def test_keyword_scores(spark):
    k = spark.createDataFrame([("q", "login"), ("q", "LOGIN"), ("q", " "), ("q", None), ("r", "nowhere"), ("q", "a.b(")], "query_id string, keyword string")
    rows = search.keyword_scores(k, units(spark)).collect()
    assert all(r.match_score % 10 == 0 and r.keyword_matches == ["login"] for r in rows) and max(r.match_score for r in rows) == 30
    assert search.keyword_scores(k.limit(0), units(spark)).count() == 0


def test_matched_first_never_ranks_unmatched_above(spark):
    hits = vector.knn(queries(spark), units(spark), 20).join(vector.unit_rows(units(spark), units(spark), "file_path", "name", "content", "type"), "id").withColumn("keywords", F.array(F.lit("order")))
    rows = search.matched_first(search.keyword_bonus(hits), 10).orderBy("query_id", "rank").collect()
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(bool(r.keyword_matches))
    assert all(x == sorted(x, reverse=True) for x in by.values())


def test_merge_unique(spark):
    a = spark.createDataFrame([(1, "x", 1, 0.1), (1, "y", 2, 0.2)], "query_id int, id string, rank int, score double")
    b = spark.createDataFrame([(1, "y", 1, 9.0), (1, "z", 2, 9.0)], a.schema)
    rows = rank.merge_unique(a, b).orderBy("merged_rank").collect()
    assert [(r.id, r.score) for r in rows] == [("x", 0.1), ("y", 0.2), ("z", 9.0)]


def test_mmr():
    assert diversify.mmr([1.0, 2.0], [{1}, {2}], 3) == [0, 1]
    assert diversify.mmr([10.0, 9.9, 1.0], [{1, 2}, {1, 2}, {3}], 2) == [0, 2]
    assert diversify.mmr([], [], 2) == []


def test_selection_gives_distinct_ids(spark):
    u, q = units(spark), queries(spark)
    hits = vector.knn(q, u, 20).join(vector.unit_rows(u, u, "file_path", "name", "content", "type"), "id").join(q.select("query_id", "query"), "query_id")
    ranked = rank.rule_rerank(hits)
    for chosen in (diversify.select_mmr(ranked, 6), diversify.select_context(ranked, 6)):
        rows = chosen.collect()
        assert len(rows) == 18 and len({(r.query_id, r.id) for r in rows}) == 18
    best = {r.query_id: r.id for r in ranked.where("new_rank = 1").collect()}
    assert all(best[int(r.query_id)] == r.id for r in diversify.select_mmr(ranked, 6).where("position = 1").collect())


def test_smart_search_and_stats(spark):
    q = queries(spark).withColumn("expansions", F.array(F.struct(F.lit("login 订单 page").alias("query"), F.col("vector").alias("vector"))))
    rows = search.smart_search(q, units(spark), 5).collect()
    assert rows and {r.source for r in rows} <= {"vector", "keyword", "hybrid"}
    assert {(r.kind, r.key): r.units for r in search.index_stats(units(spark)).collect()}["total", ""] == 63


def test_vocabulary(spark):
    v = vocab.learn(units(spark))
    words = {r.word for r in v.collect()}
    assert "src" in words
    q = spark.createDataFrame([(1, "the SRC folder"), (2, "sr"), (3, None)], "query_id int, query string")
    got = {(r.query_id, r.word) for r in vocab.match_words(q, v).collect()}
    brute = {(i, w) for i, t in ((1, "the src folder"), (2, "sr")) for w in words if w.lower() in t or t in w.lower()}
    assert got == brute


def test_filters_apply_to_keyword_results(spark):
    rows = search.smart_search(queries(spark), units(spark), 50, projects=["p1"], file_types=[".vue"], code_types=["component"], fields=("project", "type", "file_path")).collect()
    assert rows and all(r.project == "p1" and r.type == "component" and r.file_path.endswith(".vue") for r in rows)


def test_many_keywords_by_an_automaton(spark):
    few = ["login", "order", "a", "aa", "log", "5"]
    k = spark.createDataFrame([("q", w) for w in few], "query_id string, keyword string")
    many = k.unionByName(spark.createDataFrame([("z", f"nowhere{i}") for i in range(200)], k.schema))
    one, two = (sorted((r.id, r.match_score, tuple(r.keyword_matches)) for r in search.keyword_scores(x, units(spark), None).collect()) for x in (k, many))
    assert one == two and one


def test_lookup_in_blocks(spark):
    from skein.functions.lookup import holds

    texts = spark.createDataFrame([(1, "aaa bc"), (2, ""), (3, None), (4, "bcbc")], "key int, text string")
    pats = spark.createDataFrame([("aa",), ("bc",), ("",), (None,), ("bc",), ("x",)], "pattern string")
    for block in (1, 100):
        assert sorted(tuple(r) for r in holds(texts, pats, block).collect()) == [(1, "aa", 1), (1, "bc", 1), (4, "bc", 2)]
    assert holds(texts, pats.limit(0)).count() == 0


def test_kept_vocabulary_and_feedback(spark, tmp_path):
    folder = str(tmp_path / "v")
    assert vocab.load(spark, folder) is None
    learned = {r.word: r.freq for r in vocab.learn(units(spark)).collect()}
    assert {r.word: r.freq for r in vocab.load(spark, folder, units(spark)).collect()} == learned
    assert {r.word: r.freq for r in vocab.load(spark, folder).collect()} == learned
    assert vocab.to_map(vocab.load(spark, folder), 10_000) == learned
    got = {r.word: r.freq for r in vocab.merged(vocab.load(spark, folder), {"src": 9, "new": 1}).collect()}
    assert got == learned | {"src": 9, "new": 1}
    assert vocab.vocab_stats(vocab.learn(units(spark)).limit(0)).first().total == 0
    history = spark.createDataFrame([(1,), (2,)], "query_id long")
    given = spark.createDataFrame([(1, 1, None, "good"), (1, 2, None, "so so"), (9, 3, None, "bad")], vocab.FEEDBACK)
    for _ in range(2):
        vocab.record_feedback(history, given, str(tmp_path / "f"))
    assert [(r.query_id, r.feedback) for r in spark.read.parquet(str(tmp_path / "f")).collect()] == [(1, "good")] * 2


def test_knn_of_many_units_with_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(f"u{i % 700:04d}", [float(x) for x in rng.normal(size=64)]) for i in range(2100)]
    u = spark.createDataFrame(rows, "id string, vector array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=64)]) for i in range(40)], "query_id long, vector array<float>")
    vector.CELLS, before = 4000, vector.CELLS
    try:
        got = {(r.query_id, r["rank"]): r.id for r in vector.knn(q, u, 7).collect()}
    finally:
        vector.CELLS = before
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    for r in q.collect():
        d = np.round(((x - np.array(r.vector, dtype=np.float32).astype(float)) ** 2).sum(axis=1), 6)
        best = {}
        for (i, _), s in zip(rows, d):
            best[i] = min(s, best.get(i, 9e9))
        assert [got[r.query_id, k + 1] for k in range(7)] == [i for _, i in sorted((s, i) for i, s in best.items())[:7]]


def test_projection_of_malformed_json(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "{", "["), (4, '["a"]', '{"k": "v", "n": 1}')], "i int, dependencies string, metadata string")
    rows = {r.i: (r.dependencies, r.metadata) for r in vector.projected(df).collect()}
    assert rows[1] == rows[2] == rows[3] == ([], {}) and rows[4] == (["a"], {"k": "v", "n": "1"})


def test_knn_by_expressions(spark):
    u, q = units(spark), queries(spark)
    one, two = ({(r.query_id, r["rank"]): (r.id, round(r.score, 4)) for r in rows.collect()} for rows in (vector.knn(q, u, 5), vector.knn_columns(q, u, 5)))
    assert one == two
