"""The project list: one small JSON document, read and written on the driver, or a table of it."""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Project:
    id: str
    name: str
    path: str
    indexed: bool = False
    last_indexed: str | None = None


@dataclass
class Config:
    """Projects and settings; ``load`` fails if there is no file, ``save`` replaces it at once."""

    file: str
    projects: list[Project] = field(default_factory=list)
    settings: dict = field(default_factory=dict)

    @classmethod
    def load(cls, file: str) -> Config:
        with open(file, encoding="utf-8") as f:
            raw = json.load(f)
        return cls(file, [Project(**p) for p in raw.get("projects", [])], raw.get("settings", {}))

    def save(self) -> None:
        temporary = f"{self.file}.{os.getpid()}"
        with open(temporary, "w", encoding="utf-8") as f:
            json.dump({"projects": [asdict(p) for p in self.projects], "settings": self.settings}, f, ensure_ascii=False, indent=2)
        os.replace(temporary, self.file)

    def project(self, key: str) -> Project | None:
        """The first project with this id, else the first with this name."""
        return next((p for p in self.projects if p.id == key), None) or next((p for p in self.projects if p.name == key), None)

    def add(self, name: str, path: str) -> Project:
        if not name or not path:
            raise ValueError("a project needs a name and a path")
        p = Project(uuid.uuid4().hex[:12], name, path)
        self.projects.append(p)
        self.save()
        return p

    def update(self, id_: str, **changes) -> bool:
        """Whether there is such a project."""
        for p in self.projects:
            if p.id == id_:
                for k, v in changes.items():
                    setattr(p, k, v)
                self.save()
                return True
        return False


def lookup(projects: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, id, name, path, indexed) of each key: the project with this id, else the first by id with this name; nulls where there is none.  Paths have slashes only."""
    asked = keys.select("key").distinct()
    named = projects.select("id", "name", F.regexp_replace("path", r"\\", "/").alias("path"), "indexed").where("id is not null").dropDuplicates(["id"])
    both = named.select(F.col("id").alias("key"), F.lit(0).alias("by"), F.struct("id", "name", "path", "indexed").alias("p")).unionByName(named.where("name is not null").select(F.col("name").alias("key"), F.lit(1).alias("by"), F.struct("id", "name", "path", "indexed").alias("p")))
    first = both.groupBy("key").agg(F.min(F.struct("by", "p")).alias("m"))
    return asked.join(first, "key", "left").select("key", "m.p.id", "m.p.name", "m.p.path", "m.p.indexed")


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def normal_path(path: str) -> str:
    return re.sub(r"\\", "/", path)
