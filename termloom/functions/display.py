"""Tables and lines for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.schema import SearchResult


def format_score(score: Column) -> Column:
    return F.format_string("%.3f", score)


def format_metadata(metadata: Column) -> Column:
    """Entries as ``k=v``, sorted by key."""
    return F.concat_ws(", ", F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(e["key"], F.lit("="), e["value"])))


def _table(head: list[str], rows: list[list[str]]) -> str:
    widths = [max(len(r[i]) for r in [head, *rows]) for i in range(len(head))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(head), line(["-" * w for w in widths]), *map(line, rows)])


def result_table(results: list[SearchResult], second: list[float] | None = None) -> str:
    if not results:
        return "No results"
    rows = []
    for i, r in enumerate(results):
        meta = ", ".join(f"{k}={v}" for k, v in sorted(r.metadata.items()))
        text = " ".join((r.text or "").split())[:80]
        rows.append([str(i + 1), r.doc_id, f"{r.score:.3f}", *([f"{second[i]:.3f}"] if second else []), meta, text])
    return _table(["#", "doc_id", "score", *(["cosine"] if second else []), "metadata", "text"], rows)


def stats_table(stats: dict) -> str:
    return _table(["key", "value"], [[k, f"{v:.3f}" if isinstance(v, float) else str(v)] for k, v in stats.items()])
