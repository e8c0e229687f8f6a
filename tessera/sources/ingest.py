"""Files of a folder into the chunk store, in one call and one commit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.common import store
from tessera.operators import chunking
from tessera.sources import files
from tessera.sources.chunks import DOCUMENTS, ChunkStore, Conflict

#: chunks(id, text, ...) with an array<float> column embedding.
Embed = Callable[[DataFrame], DataFrame]


def ingest(target: ChunkStore, path: str, session: str, embed: Embed, max_words: int = 512, recursive: bool = True, attempts: int = 3) -> DataFrame:
    """(path, name, status, document_uuid, version, previous_uuid, chunks_created, error) of every file under path; files of no bytes are not listed.

    A file is a document by its name; of equal names the last path counts, the others are error rows. One that the session has already becomes its next version, whose chunks take the place of the
    former's. Files of other kinds, that cannot be read, or without text are error rows and change nothing. Chunks, versions and removals of all files take effect together; if another
    writer changed the session meanwhile, the whole is worked out again, `attempts` times in all. No session is a ValueError.
    """
    if not session:
        raise ValueError("session is required")
    spark = target.spark
    read = store(files.read_documents(spark, path, recursive), "ingest-files")
    last = read.where("status = 'success'").groupBy("name").agg(F.max("path").alias("path")).withColumn("_last", F.lit(True))
    read = read.join(last, ["name", "path"], "left")
    for turn in range(attempts):
        base = target.version()
        had = target.documents(session, base).select("name", F.col("document_uuid").alias("previous_uuid"), F.col("version").alias("_before"))
        fresh = read.where("_last").join(had, "name", "left").withColumn("version", F.coalesce(F.col("_before") + 1, F.lit(1)))
        fresh = store(fresh.select("name", "text", "version", "previous_uuid", F.md5(F.concat_ws("|", F.lit(session), "name", F.col("version").cast("string"))).alias("document_uuid"), F.lit(session).alias("session_id")), "ingest-new")
        cut = chunking.chunk(fresh, max_words, "session_id", "document_uuid")
        made = store(embed(cut), "ingest-chunks")
        counts = made.groupBy("document_uuid").agg(F.count("*").alias("chunks"))
        documents = fresh.drop("text").join(counts, "document_uuid", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
        documents = store(documents.select(*[f.split()[0] for f in DOCUMENTS.split(", ")]), "ingest-documents")
        if documents.isEmpty():
            break
        try:
            target.put(made, documents, [session], base)
            break
        except Conflict:
            if turn == attempts - 1:
                raise
    told = read.join(documents.select("name", F.lit(True).alias("_last"), "document_uuid", "version", "previous_uuid", "chunks"), ["name", "_last"], "left")
    twice = (F.col("status") == "success") & F.col("_last").isNull()
    return told.select(
        "path", "name", F.when(twice, "error").otherwise(F.col("status")).alias("status"), "document_uuid", "version", "previous_uuid", F.coalesce("chunks", F.lit(0)).alias("chunks_created"),
        F.when(twice, "another file of this name").otherwise(F.col("error")).alias("error"),
    )


def ingest_scenarios(target: ChunkStore, scenarios: DataFrame, folder: str, embed: Embed) -> DataFrame:
    """ingest() of each scenario's document into a session of the scenario's name, with its own size of chunks; scenarios(name, document, chunk_size) has a few rows."""
    found = None
    for r in scenarios.select("name", "document", "chunk_size").collect():
        rows = ingest(target, f"{folder.rstrip('/')}/{r.document}", r.name, embed, r.chunk_size or 512).withColumn("scenario", F.lit(r.name))
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return target.spark.createDataFrame([], "scenario string, name string, status string, chunks_created long, error string")
    return found
