"""Which of many patterns each of many texts holds, as literal text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.rows import ship

try:
    import ahocorasick
except ImportError:  # pragma: no cover
    ahocorasick = None

#: Patterns that one pass over the texts serves; more are served in blocks by their hash, so what the driver and a task hold is bounded.
BLOCK = 50_000

_built: dict[int, object] = {}


def _finder(patterns: tuple[str, ...]):
    """A function from a text to the set of numbers of patterns in it; one automaton a worker process is kept."""
    key = hash(patterns)
    if key not in _built:
        _built.clear()
        if ahocorasick is None:  # without the automaton each pattern is looked for
            _built[key] = lambda text: {i for i, p in enumerate(patterns) if p in text}
        else:
            machine = ahocorasick.Automaton()
            for i, p in enumerate(patterns):
                machine.add_word(p, i)
            machine.make_automaton()
            _built[key] = lambda text: {i for _, i in machine.iter(text)}
    return _built[key]


def holds(texts: DataFrame, patterns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(key, pattern, n): how often each text (key, text) holds each pattern, occurrences that do not overlap; only those that it holds.

    Null or empty texts and patterns hold, and are held by, nothing; repeated
    patterns count once, repeated rows of texts give repeated rows.
    """
    ship(texts.sparkSession)
    wanted = patterns.where("pattern is not null and pattern <> ''").select("pattern").distinct()
    key_field = texts.schema["key"]
    schema = f"key {key_field.dataType.simpleString()}, pattern string, n int"
    blocks = max(1, -(-wanted.count() // block))
    out = None
    for b in range(blocks):
        some = tuple(sorted(r[0] for r in wanted.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).collect()))

        def look(batches, some=some):
            find = _finder(some) if some else (lambda text: ())
            for batch in batches:
                rows, names, counts = [], [], []
                for i, text in enumerate(batch.column(1).to_pylist()):
                    for j in sorted(find(text)) if text else ():
                        rows.append(i)
                        names.append(some[j])
                        counts.append(text.count(some[j]))
                if rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(names), pa.array(counts, pa.int32())], ["key", "pattern", "n"])

        part = texts.where("text is not null").select("key", "text").mapInArrow(look, schema)
        out = part if out is None else out.unionByName(part)
    return out
