"""Sinks: one Parquet table per result, one JSON document, one self-contained page."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .induce import Model

DISCLAIMERS = {
    "git": "A history shows what was merged, not what was decided beside it.",
    "email": "A mailbox shows its custodians' side of a conversation only.",
    "github": "A tracker shows what was done in the tracker.",
    "changelog": "A changelog has no times, actors or order within a version.",
    "table": "A sheet shows what was entered, when somebody entered it.",
}


def disclaimers(sources: list[str]) -> list[str]:
    kinds = {s.split(":")[0] for s in sources}
    return [t for k, t in DISCLAIMERS.items() if k in kinds]


def write_tables(model: Model, path: str) -> None:
    """Every table as Parquet under ``path``: the sink for models of any size."""
    for name, df in model.tables().items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def stats(model: Model) -> DataFrame:
    """(block, value, n): cases by order and tier, gaps by kind, steps by name."""
    by = lambda df, block, col: df.groupBy(F.lit(block).alias("block"), F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by(model.runs, "order_status", "order_status").unionByName(by(model.cases, "tier", "confidence")).unionByName(by(model.gaps, "gap", "kind")).unionByName(by(model.runs, "kind", "kind"))


def document(model: Model, sources: list[str] = (), max_rows: int = 10_000) -> dict:
    """The model as one JSON-ready document for a reader: each table up to ``max_rows`` rows, its full count, and whether it
    is complete. The Parquet tables are the complete result; events are in these alone."""
    out: dict = {"disclaimers": disclaimers(list(sources)), "stats": [r.asDict() for r in stats(model).collect()], "tables": {}}
    for name, df in model.tables().items():
        if name in ("events",):
            continue
        flat = df.select(F.to_json(F.struct(*df.columns)).alias("j"))
        rows, n = [json.loads(r.j) for r in flat.limit(max_rows).collect()], df.count()
        out["tables"][name] = {"n": n, "complete": len(rows) == n, "rows": rows}
    return out


def write_json(model: Model, path: str, sources: list[str] = ()) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document(model, sources), f, ensure_ascii=False, indent=1, sort_keys=True)


def write_page(model: Model, path: str, sources: list[str] = (), rows: int = 200) -> None:
    """A page without outside parts: kinds, variants, waits and gaps as tables, and a search box over them."""
    doc = document(model, sources, rows)
    parts = ["<!doctype html><meta charset=utf-8><title>Process model</title><style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}</style>"]
    parts.append("<input id=q placeholder=Search oninput=\"for(const r of document.querySelectorAll('tbody tr'))r.hidden=!r.innerText.toLowerCase().includes(this.value.toLowerCase())\">")
    parts += [f"<p>{html.escape(d)}</p>" for d in doc["disclaimers"]]
    for name in ("headline", "kinds", "variants", "waits", "cycle", "gaps", "orphans"):
        t = doc["tables"][name]
        cols = sorted({k for r in t["rows"] for k in r})
        parts.append(f"<h2>{name} ({t['n']})</h2><table><thead><tr>" + "".join(f"<th>{html.escape(c)}" for c in cols) + "</thead><tbody>")
        parts += ["<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}" for c in cols) for r in t["rows"]]
        parts.append("</tbody></table>")
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(parts))
