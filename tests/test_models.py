"""The client of a model server against a server of this process, and fixed texts."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from skein import models
from skein.models import HttpModel
from skein.operators import context


class Server(BaseHTTPRequestHandler):
    failures = 0
    seen: list = []

    def _send(self, code, body):
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(body).encode())

    def do_GET(self):
        self._send(200, {})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.seen.append((self.path, body))
        if Server.failures:
            Server.failures -= 1
            self._send(500, {})
        elif self.path == "/api/embeddings":
            self._send(200, {"embedding": [float(len(body["prompt"])), 0.5]})
        else:
            self._send(200, {"message": {"content": "answer"}})

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    Server.failures, Server.seen = 0, []
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_client(server, monkeypatch):
    waits = []
    monkeypatch.setattr(models.time, "sleep", waits.append)
    model = HttpModel(server)
    assert model.healthy() and not HttpModel("http://127.0.0.1:9").healthy()
    Server.failures = 2
    assert model.embed(["abc", "d"]) == [[3.0, 0.5], [1.0, 0.5]]
    assert model.attempts == [3, 1] and waits == [0.5, 1.0]
    assert model.chat([{"role": "user", "content": "q"}]) == "answer"
    path, body = Server.seen[-1]
    assert path == "/api/chat" and body["options"] == {"num_predict": 320, "temperature": 0.1} and body["keep_alive"] == "30m" and body["stream"] is False
    Server.failures = 9
    with pytest.raises(Exception):
        model.embed(["x"])
    assert model.attempts == [5]
    Server.failures = 1
    with pytest.raises(Exception):
        model.chat([])  # no second attempt


def test_fallback_answer():
    r = [{"name": f"n{i}", "type": "function", "file_path": f"/f{i}", "start_line": i, "end_line": i + 1} for i in range(1, 5)]
    lines = context.fallback_answer("q", r).split("\n")
    assert lines[:3] == ["## 结论", "1. 当前上下文可确认与问题相关的代码入口为 `n1`（来源[1]）。", "2. 当前上下文可确认与问题相关的代码入口为 `n2`（来源[2]）。"]
    assert lines[5:8] == [f"{i}. 来源[{i}]：`n{i}`（function），位置 `/f{i}:{i}-{i + 1}`。" for i in (1, 2, 3)] and "“q”" in lines[10]
    assert context.fallback_answer("q", []).startswith("## 结论\n\n## 证据")


def test_snippets_are_never_shorter_than_their_least(spark):
    df = spark.createDataFrame([(1, "word", 1, "/a", 1, 2, "n", "function", "x" * 500 + "word" + "y" * 500, ["d"])], "query_id int, query string, rank int, file_path string, start_line int, end_line int, name string, type string, content string, dependencies array<string>")
    text = context.context(df, snippet_chars=10).first().context
    code = text.split("代码片段:\n")[1]
    assert len(code) == 206 and code.startswith("...") and code.endswith("...") and "word" in code and "依赖: d" in text


def test_chat_reports_times_and_keeps_few_sources_when_fast(spark, tmp_path):
    from skein.models import HashingEmbedder, ScriptedChat
    from skein.plans.flows import Engine
    from skein.sources.config import Project

    for i in range(6):
        f = tmp_path / "code" / "src" / f"m{i}" / "a.js"
        f.parent.mkdir(parents=True)
        f.write_text(f"function loadUser{i}(a) {{\n  return fetch('/api/login', a)\n}}\n" + "// pad\n" * 200)
    engine = Engine(spark, str(tmp_path / "index"), HashingEmbedder(), ScriptedChat(["## 结论\n来源[1]\n## 证据\n来源[2]"]))
    engine.build(Project("p", "p", str(tmp_path / "code")))
    out = engine.chat("load login", fast=True)
    assert len(out["sources"]) == 3 and all(len(s["content"]) <= 326 for s in out["sources"])
    assert 0 < out["retrieval_s"] <= out["total_s"] and abs(out["retrieval_s"] + out["answer_s"] - out["total_s"]) < 1e-6
