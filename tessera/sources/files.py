"""Reading documents, scenarios, snapshots and reports as DataFrames. Failures are rows with an error, not exceptions."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The suffixes that can be loaded, and the namespace of word-processing documents.
SUFFIXES = (".txt", ".pdf", ".docx")
WORDML = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

TURN = T.StructType([
    T.StructField("query", T.StringType()), T.StructField("ground_truth_chunks", T.ArrayType(T.StringType())), T.StructField("ground_truth", T.ArrayType(T.StringType())),
    T.StructField("ground_truth_answer", T.StringType()), T.StructField("ground_truth_text", T.StringType()), T.StructField("ground_truth_texts", T.ArrayType(T.StringType())),
    T.StructField("expected_entities", T.ArrayType(T.StringType())),
])
SCENARIO = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("document", T.StringType()), T.StructField("baseline_mode", T.BooleanType()),
    T.StructField("chunk_size", T.IntegerType()), T.StructField("chunk_overlap", T.IntegerType()), T.StructField("turns", T.ArrayType(TURN)),
])


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def decoded(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def docx_text(content: bytes) -> str:
    """Non-blank paragraphs, then table rows with ' | ' between cells, a line each; ValueError if there is no text."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORDML}body")
    if body is None:
        raise ValueError("no body")
    text_of = lambda node: "".join(t.text or "" for t in node.iter(f"{WORDML}t"))
    lines = [t for p in body.findall(f"{WORDML}p") if (t := text_of(p)).strip()]
    for row in body.iter(f"{WORDML}tr"):
        cells = [" ".join(text_of(p) for p in cell.findall(f"{WORDML}p")).strip() for cell in row.findall(f"{WORDML}tc")]
        if any(cells):
            lines.append(" | ".join(cells))
    if not lines:
        raise ValueError("no text in document")
    return "\n".join(lines)


def pdf_text(content: bytes) -> str:
    """Text of all pages that can be read, a line break after each. Needs pypdf."""
    from pypdf import PdfReader

    pages = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            pages.append((page.extract_text() or "") + "\n")
        except Exception:  # noqa: BLE001, S112  a page that cannot be read is skipped
            continue
    if not "".join(pages).strip():
        raise ValueError("no text in document")
    return "".join(pages)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, kind, content in zip(batch["path"], batch["suffix"], batch["content"], strict=True):
            try:
                rows.append((path, docx_text(content) if kind == ".docx" else pdf_text(content), None))
            except Exception as e:  # noqa: BLE001  one bad file is one error row
                rows.append((path, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["path", "text", "error"])


def read_documents(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, name, status, text, error) of all files under path. Text stays with the JVM; only .docx and .pdf bytes go to Python.

    Other suffixes, .doc included, and files without text are error rows.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", suffix(F.col("path")).alias("suffix"), "content")
    plain = files.where("suffix = '.txt'").select("path", decoded(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    rich = files.where(F.col("suffix").isin(".docx", ".pdf")).mapInPandas(_extract, "path string, text string, error string")
    other = files.where(~F.col("suffix").isin(*SUFFIXES)).select("path", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported suffix "), "suffix").alias("error"))
    rows = plain.unionByName(rich).unionByName(other)
    return rows.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.when(F.col("error").isNull(), "success").otherwise("error").alias("status"), "text", "error")


def read_scenarios(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scenarios, turns) of scenario JSON files. ground_truth_chunks wins over ground_truth if it is not empty; missing values become '' or empty lists."""
    raw = spark.read.schema(SCENARIO).option("multiLine", True).json(path)
    head = raw.select("name", "document", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("baseline_mode", F.lit(False)).alias("baseline_mode"), "chunk_size", F.coalesce("chunk_overlap", F.greatest(F.lit(1), (F.col("chunk_size") / 8).cast("int"))).alias("chunk_overlap"))
    turns = raw.select("name", F.posexplode("turns").alias("turn", "t"))
    none = F.array().cast("array<string>")
    truth = F.when(F.size(F.coalesce("t.ground_truth_chunks", none)) > 0, F.col("t.ground_truth_chunks")).otherwise(F.coalesce("t.ground_truth", none))
    return head, turns.select(
        "name", "turn", "t.query", truth.alias("ground_truth"), F.coalesce("t.ground_truth_answer", F.lit("")).alias("answer"), F.coalesce("t.ground_truth_text", F.lit("")).alias("phrase"),
        F.coalesce("t.ground_truth_texts", none).alias("texts"), F.coalesce("t.expected_entities", none).alias("entities"),
    )


def list_stems(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """Names of files without their suffix; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("name"))


def latest_result(spark: SparkSession, path: str, scenario: str) -> DataFrame:
    """The newest {scenario}_comparison_*.json, else the newest {scenario}_*.json: one row, or none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{scenario}_*.json").load(path).select("path", "modificationTime")
    preferred = F.regexp_extract("path", r"([^/]+)$", 1).startswith(f"{scenario}_comparison_")
    return files.orderBy(preferred.desc(), F.desc("modificationTime"), "path").limit(1).select("path")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph snapshot."""
    return spark.read.json(f"{path}/nodes"), spark.read.json(f"{path}/edges")


def read_turn_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)
