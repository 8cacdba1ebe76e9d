"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from skein.functions.rows import table
from skein.llm import bpe, chunking, docpairs, handmade, languages, neighbours, packing, quality, validity


def queries() -> dict:
    t = table
    return {
        "p1_found": lambda s, d: chunking.found(t(s, d, "code_units")),
        "p1_pieces": lambda s, d: chunking.split(t(s, d, "code_units")),
        "p2_found": lambda s, d: validity.found(t(s, d, "files")),
        "p2_rates": lambda s, d: validity.rates(t(s, d, "files")),
        "p3_found": lambda s, d: docpairs.found(t(s, d, "functions"), t(s, d, "files")),
        "p3_pairs": lambda s, d: docpairs.pairs(t(s, d, "functions"), t(s, d, "files")),
        "p5_found": lambda s, d: languages.found(t(s, d, "code_units"), t(s, d, "documents")),
        "p5_shares": lambda s, d: languages.shares(t(s, d, "code_units"), t(s, d, "documents")),
        "p5_function_comments": lambda s, d: languages.function_comments(t(s, d, "functions"), t(s, d, "documents"), t(s, d, "code_units")),
        "p6_found": lambda s, d: neighbours.found(t(s, d, "code_units")),
        "p6_neighbours": lambda s, d: neighbours.neighbours(t(s, d, "code_units")),
        "p6_exact": lambda s, d: neighbours.exact(t(s, d, "code_units")),
        "p6_recall": lambda s, d: neighbours.recall(t(s, d, "code_units")),
        "p7_found": lambda s, d: handmade.found(t(s, d, "files")),
        "p7_kinds": lambda s, d: handmade.kinds(t(s, d, "files")),
        "p8_ids": lambda s, d: bpe.encoded(t(s, d, "documents")),
        "p9_packed": lambda s, d: packing.packed(t(s, d, "documents")),
        "p10_found": lambda s, d: quality.found(t(s, d, "documents")),
        "p10_statistics": lambda s, d: quality.statistics(t(s, d, "documents")),
        "p10_reasons": lambda s, d: quality.reasons(t(s, d, "documents")),
        "p10_tails": lambda s, d: quality.tails(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    usable = "v AS (SELECT DISTINCT id, vector FROM code_units WHERE id IS NOT NULL AND vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x) OR isnan(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0), q AS (SELECT * FROM v WHERE ('0x' || substring(md5(id), 1, 4))::INT % 100 = 0)"
    dot = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
    cosine = f"({dot.format(a='q.vector', b='v.vector')} / sqrt({dot.format(a='q.vector', b='q.vector')} * {dot.format(a='v.vector', b='v.vector')}))"
    return {
        "p6_exact": f"WITH {usable}, d AS (SELECT q.id, v.id AS other, min(round(1.0::DOUBLE - {cosine}, 6)) AS distance FROM q, v WHERE q.id <> v.id GROUP BY 1, 2) SELECT id, other, distance, row_number() OVER (PARTITION BY id ORDER BY distance, other)::INT AS rank FROM d QUALIFY rank <= 5",
        "p6_recall": f"WITH {usable}, n AS (SELECT count(DISTINCT id) AS n FROM v) SELECT count(DISTINCT id) AS queries, (count(DISTINCT id) * least(5, max(n.n) - 1))::BIGINT AS pairs, true AS enough FROM q, n",
        "p1_found": "SELECT DISTINCT id FROM code_units WHERE length(content) > 2990",
    }
