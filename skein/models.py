"""Embedding and chat models: protocols, clients over HTTP, and deterministic stand-ins."""

from __future__ import annotations

import hashlib
import json
import math
import re
import time
import urllib.request
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class ChatModel(Protocol):
    def chat(self, messages: list[dict]) -> str: ...


@dataclass
class HashingEmbedder:
    """Signed hashing of words into a unit vector; the same everywhere."""

    dimensions: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.dimensions
            for w in re.findall(r"[a-z0-9_]+|[一-龥]", (text or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


@dataclass
class ScriptedChat:
    """Answers from a list, in order; an exception in the list is raised."""

    answers: list
    seen: list = field(default_factory=list)

    def chat(self, messages: list[dict]) -> str:
        self.seen.append(messages)
        answer = self.answers[min(len(self.seen), len(self.answers)) - 1]
        if isinstance(answer, Exception):
            raise answer
        return answer


@dataclass
class HttpModel:
    """Client of a model server with /api/embeddings, /api/chat and /api/tags."""

    base_url: str
    embed_model: str = "bge-m3"
    chat_model: str = "llama3"
    timeout: float = 60.0
    retries: int = 5
    #: Attempts that each text of the last call of ``embed`` took.
    attempts: list[int] = field(default_factory=list)

    def _post(self, path: str, body: dict, timeout: float) -> dict:
        request = urllib.request.Request(self.base_url + path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.loads(r.read())

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        self.attempts = []
        return [self._embed_one(t) for t in texts]

    def _embed_one(self, text: str) -> list[float]:
        for attempt in range(1, self.retries + 1):
            self.attempts[len(self.attempts) - (attempt > 1) :] = [attempt]
            try:
                return self._post("/api/embeddings", {"model": self.embed_model, "prompt": text}, self.timeout)["embedding"]
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(0.5 * attempt)
        raise AssertionError

    def chat(self, messages: list[dict]) -> str:
        body = {"model": self.chat_model, "messages": messages, "stream": False, "keep_alive": "30m", "options": {"num_predict": 320, "temperature": 0.1}}
        return self._post("/api/chat", body, 120.0)["message"]["content"]

    def healthy(self) -> bool:
        try:
            with urllib.request.urlopen(self.base_url + "/api/tags", timeout=5) as r:
                return r.status == 200
        except Exception:
            return False


def json_object(answer: str) -> dict | None:
    """The outermost JSON object in an answer, or None."""
    m = re.search(r"\{[\s\S]*\}", answer or "")
    try:
        found = json.loads(m.group()) if m else None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def json_integers(answer: str) -> list[int] | None:
    """The first JSON list of whole numbers in an answer, or None."""
    m = re.search(r"\[[\d\s,]+\]", answer or "")
    try:
        return [int(x) for x in json.loads(m.group())] if m else None
    except ValueError:
        return None


def ask(chat: ChatModel, prompt: str) -> str:
    return chat.chat([{"role": "user", "content": prompt}])
