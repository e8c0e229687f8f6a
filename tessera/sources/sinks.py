"""Writing logs, tables, snapshots and reports."""

from __future__ import annotations

import html
import io
import zipfile
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def selection_log(rows: DataFrame, query: str = "query") -> DataFrame:
    """Chunk selections with the query cut to 120 characters."""
    return rows.withColumn(query, F.substring(query, 1, 120))


def selection_records(scores: DataFrame, part: list[str], query: str = "query", at: str | None = None) -> DataFrame:
    """One log row a turn: the columns of part, the query's first 120 characters, a time stamp, and selected_chunks in order of rank. at: a column with the time, else now.

    scores has a row for each chosen chunk, with rank and any scores, as of score_rows().
    """
    stamp = F.max(F.col(at)) if at else F.current_timestamp()
    own = [c for c in scores.columns if c not in (*part, query, at, "rank")]
    listed = F.array_sort(F.collect_list(F.struct("rank", *own)))
    return scores.groupBy(*part).agg(F.substring(F.max(query), 1, 120).alias("query"), stamp.alias("timestamp"), listed.alias("selected_chunks"))


def portable(df: DataFrame) -> DataFrame:
    """Without vectors, as rows leave the engine."""
    return df.drop("embedding")


def run_records(summaries: DataFrame, turns: DataFrame, part: list[str]) -> DataFrame:
    """One row a run: its columns of part, summary, and detailed_metrics, all its turns in order."""
    own = [c for c in turns.columns if c not in part]
    detailed = turns.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("iteration", *[c for c in own if c != "iteration"]))).alias("detailed_metrics"))
    told = summaries.select(*part, F.struct(*[c for c in summaries.columns if c not in part]).alias("summary"))
    return told.join(detailed, part, "left")


def comparison_records(compared: DataFrame) -> DataFrame:
    """One row a mode: its state, and all figures by name."""
    return compared.groupBy("mode").agg(F.min("state").alias("state"), F.map_from_entries(F.collect_list(F.struct("metric", F.struct("base", "other", "delta", "improvement_pct")))).alias("metrics"))


#: The columns of the table of modes and the figures in them.
MODE_COLUMNS = {
    "Evidence Recall@5": "avg_evidence_recall_at_5", "Recall@5": "avg_retrieval_recall_at_5", "Answer Token-F1": "avg_answer_token_f1", "ROUGE-L": "avg_answer_rougeL", "Avg Latency ms": "avg_latency_ms", "Avg VRAM GB": "avg_vram_gb",
    "KV Cache Avg": "avg_vllm_kv_cache_usage_after", "GPU Util Avg %": "avg_gpu_utilization_pct", "Generated tok/s": "avg_vllm_tokens_per_second", "Swaps": "total_swap_operations", "Preemptions": "total_vllm_preemptions",
}


def mode_table(summaries: DataFrame, mode: str = "mode", labels: dict[str, str] | None = None) -> DataFrame:
    """The twelve columns of a report, a row a mode."""
    name = F.col(mode)
    for key, label in (labels or {}).items():
        name = F.when(F.col(mode) == key, F.lit(label)).otherwise(name)
    return summaries.select(name.alias("Mode"), *[F.round(F.col(k).cast("double"), 4).alias(c) for c, k in MODE_COLUMNS.items()])


def series(turns: DataFrame, part: list[str]) -> DataFrame:
    """(part, series, iteration, value): the curves of a run, one row a point."""
    curves = {"coverage": "coverage_ratio", "vram": "vram_allocated_gb", "latency": "latency_ms", "active_chunks": "active_chunks"}
    points = F.array(*[F.struct(F.lit(n).alias("series"), F.col(c).cast("double").alias("value")) for n, c in curves.items()])
    return turns.select(*part, "iteration", F.explode(points).alias("p")).select(*part, "p.series", "iteration", "p.value")


def write_csv(tables: list[DataFrame], path: str, sep: str = ",") -> None:
    """All rows under one header with every table's columns."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).write.mode("overwrite").csv(path, header=True, sep=sep)


def write_json(df: DataFrame, path: str, name: str) -> None:
    """Each row as one object under `name`."""
    df.select(F.struct(*df.columns).alias(name)).write.mode("overwrite").json(path)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str, stamp: str) -> bool:
    """The graph under latest and under its stamp; nothing for an empty graph."""
    if nodes.isEmpty():
        return False
    for name in ("latest", stamp):
        nodes.write.mode("overwrite").json(f"{path}/{name}/nodes")
        edges.write.mode("overwrite").json(f"{path}/{name}/edges")
    return True


def html_report(title: str, cards: dict[str, str], table: DataFrame, most: int = 1000) -> str:
    """A page with figures and the first rows of a small result table (a top-k report); it says how many rows are left out."""
    rows = table.limit(most + 1).collect()
    left, rows = _left_out(table, rows, most), rows[:most]
    cell = lambda x, tag="td": f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    head = "<tr>" + "".join(cell(c, "th") for c in table.columns) + "</tr>"
    body = "".join("<tr>" + "".join(cell(v) for v in r) + "</tr>" for r in rows)
    figures = "".join(f"<div><b>{html.escape(k)}</b> {html.escape(v)}</div>" for k, v in cards.items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{figures}<table>{head}{body}</table>{f'<p>{left}</p>' if left else ''}</body></html>"


def _left_out(table: DataFrame, rows: list, most: int) -> str:
    """rows: the first most + 1 of table."""
    return f"{table.count() - most} more rows are not shown" if len(rows) > most else ""


def docx_report(title: str, tables: dict[str, DataFrame], most: int = 1000) -> bytes:
    """A word-processing document with a heading and a table for each small result table (the first `most` rows, and how many more there are)."""
    para = lambda t: f"<w:p><w:r><w:t xml:space='preserve'>{html.escape('' if t is None else str(t))}</w:t></w:r></w:p>"
    body = para(title)
    for name, table in tables.items():
        found = table.limit(most + 1).collect()
        left, rows = _left_out(table, found, most), [table.columns, *found[:most]]
        body += para(name) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{para(v)}</w:tc>" for v in r) + "</w:tr>" for r in rows) + "</w:tbl>" + (para(left) if left else "")
    kind = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kind}"/></Types>',
        "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
        "word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, text in parts.items():
            z.writestr(path, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()
