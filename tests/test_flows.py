import pytest

from skein.models import HashingEmbedder, ScriptedChat
from skein.plans.flows import Engine
from skein.sources.config import Config

GOOD = "## 结论\n来源[1]\n## 证据\n来源[2]"


@pytest.fixture
def project(tmp_path):
    code = tmp_path / "code"
    for i, name in enumerate(("src/login/page.js", "src/order/list.js", "src/cart/cart.ts", "docs/read.md")):
        f = code / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"// load the {name}\nfunction loadUser{i}(a) {{\n  return fetch('/api/login', a)\n}}\nfunction initOrder{i}() {{\n  return {i}\n}}\n")
    (tmp_path / "c.json").write_text("{}")
    config = Config.load(str(tmp_path / "c.json"))
    config.add("shop", str(code))
    return Config.load(config.file).project("shop"), code


def test_build_search_and_answer(spark, tmp_path, project):
    p, code = project
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder(), ScriptedChat([GOOD]))
    assert engine.search(["anything"]).count() == 0
    assert engine.build(p) == {"units": 6, "failed": 0, "files": 4}
    assert engine.build(p, incremental=True) == {"units": 0, "failed": 0, "files": 0}
    assert engine.units().count() == 6
    (code / "src/order/list.js").unlink()
    (code / "src/cart/cart.ts").write_text("export const x = (a: number) => a\n")
    assert engine.build(p, incremental=True)["files"] == 1
    assert sorted(r.name for r in engine.units().collect()) == ["initOrder0", "loadUser0", "x"]
    rows = engine.rerank(["load login"], 5, 2).collect()
    assert len(rows) == 2 and rows[0].query == "load login"
    row = engine.context(["load login"]).first()
    assert "来源[1]" in row.context and row.tokens > 0 and row.remaining >= 0
    assert engine.answer("load login") == GOOD
    out = engine.chat("加载 login 流程")
    assert out["answer"] == GOOD and out["calls"] == 1 and 2 <= len(out["sources"]) <= 6
    assert engine.vocabulary_search("login").count() == 3
    shown = engine.display(["load login"], 2, verbose=True).collect()
    assert len(shown) == 2 and all(r.file_text and len(r.short_id) <= 18 for r in shown)
    smart = Engine(spark, engine.root, HashingEmbedder(), ScriptedChat(['{"keywords": ["login"], "expandedQueries": ["load login page"]}', "[1, 9, 3]"])).smart_search(["load login"], 3)
    assert [len(x) for x in smart] == [3] and smart[0][0]["rerank_score"] == 9
    assert engine.embedding("a").first().dimensions == 64
    found = engine.analyze("【登录】加载失败")
    assert found["results"] and found["summary"].startswith(f"分析了 {len(found['results'])}")
    assert engine.stats.summary()["calls"] > 0


def test_a_full_build_drops_deleted_files(spark, tmp_path, project):
    p, code = project
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder())
    engine.build(p)
    (code / "src/order/list.js").unlink()
    assert engine.build(p) == {"units": 4, "failed": 0, "files": 3}
    assert engine.build(p, incremental=True)["files"] == 0
    assert {r.relative_path for r in engine.units().collect()} == {"src/login/page.js", "src/cart/cart.ts"} and engine.state("none") is None


def test_config(tmp_path):
    file = str(tmp_path / "c.json")
    with pytest.raises(FileNotFoundError):
        Config.load(file)
    config = Config(file)
    with pytest.raises(ValueError):
        config.add("", "x")
    p = config.add("a", "C:\\x")
    assert config.update(p.id, indexed=True) and not config.update("none", indexed=True)
    assert Config.load(file).project(p.id).indexed and Config.load(file).project("b") is None


def test_unreadable_state_is_none(spark, tmp_path, project):
    p, _ = project
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder())
    engine.build(p)
    assert engine.state(p.id).count() == 4
    (tmp_path / "index/state/manifests/1.json").write_text("{")
    (tmp_path / "index/state/manifests/.1.json.crc").unlink(missing_ok=True)
    assert engine.state(p.id) is None and engine.state() is None
    assert engine.build(p, incremental=True)["files"] == 4  # without a state all is built
