"""The chunk store: Parquet parts and a log of commits. Nothing is rewritten, and readers see whole commits only."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, text string, chunk_index int, chunk_size int, embedding array<float>, document_uuid string, session_id string"
REQUIRED = ("id", "text", "session_id", "document_uuid")
DOCUMENTS = "session_id string, name string, document_uuid string, version int, previous_uuid string, chunks long"
#: What was taken out: of a session all, or a document, or an id.
GONE = "session_id string, document_uuid string, id string"
LOG = "commit long, data string, gone string, documents string, sessions array<string>"


class Conflict(RuntimeError):
    """Another writer has changed the same session since it was read."""


def valid() -> Column:
    """All required fields are there."""
    ok = F.lit(True)
    for c in REQUIRED:
        ok = ok & F.col(c).isNotNull()
    return ok


class ChunkStore:
    """Rows by session and document.

    A change writes its parts first: chunks, marks of what goes, and document versions, for however many sessions. It takes effect by one commit, a file with the next number that can only be
    made once; a writer that finds the number taken looks at what came between. Additions go on with the next number; a change that was worked out from what it read fails with Conflict if
    a commit in between has touched one of its sessions. A row is there if no later commit took out its session, document or id.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> int:
        """The number of the last commit, 0 before the first."""
        files, at = self._files("log")
        return max((int(f.getPath().getName().split(".")[0]) for f in files.listStatus(at) if f.getPath().getName().endswith(".json")), default=0) if files.exists(at) else 0

    def _log(self, version: int | None = None) -> list:
        """Commits up to version; one row each."""
        last = self.version() if version is None else version
        return self.spark.read.schema(LOG).json([f"{self.path}/log/{i:012d}.json" for i in range(1, last + 1)]).orderBy("commit").collect() if last else []

    def _write(self, kind: str, rows: DataFrame | None) -> str | None:
        if rows is None:
            return None
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/part={part}")
        return part

    def _commit(self, data: DataFrame | None, gone: DataFrame | None, documents: DataFrame | None, sessions: list[str] | None, base: int | None) -> int:
        """sessions: those that the change concerns, None for unknown many; base: the version that it was worked out from, None if from none."""
        entry = {"data": self._write("data", data), "gone": self._write("gone", gone), "documents": self._write("documents", documents), "sessions": sessions}
        number = (self.version() if base is None else base) + 1
        while True:
            files, at = self._files(f"log/{number:012d}.json")
            try:
                out = files.create(at, False)
            except Exception as e:
                if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                    raise
                if base is not None:
                    other = self.spark.read.schema(LOG).json(f"{self.path}/log/{number:012d}.json").first()
                    if other is None or other.sessions is None or sessions is None or set(other.sessions) & set(sessions):
                        raise Conflict(f"commit {number} came first") from None
                number += 1
                continue
            out.write(bytearray(json.dumps({"commit": number, **entry}).encode()))
            out.close()
            return number

    def _all(self, kind: str, schema: str, version: int | None) -> DataFrame:
        """The parts of one kind with the commit that brought each row."""
        parts = {r[kind]: r.commit for r in self._log(version) if r[kind]}
        names = [f.split()[0] for f in schema.split(", ")]
        if not parts:
            return self.spark.createDataFrame([], schema + ", _commit long")
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/part={p}" for p in parts])
        numbers = self.spark.createDataFrame(list(parts.items()), "_part string, _commit long")
        return rows.select(*names, F.regexp_extract(F.col("_metadata.file_path"), "/part=([0-9a-f]+)/", 1).alias("_part")).join(F.broadcast(numbers), "_part").drop("_part")

    def _alive(self, rows: DataFrame, version: int | None) -> DataFrame:
        gone = self._all("gone", GONE, version).withColumnRenamed("_commit", "_gone")
        for key, mark in ((["session_id"], "document_uuid IS NULL AND id IS NULL"), (["session_id", "document_uuid"], "document_uuid IS NOT NULL"), (["session_id", "id"], "id IS NOT NULL")):
            if set(key) <= set(rows.columns):
                last = gone.where(mark).groupBy(*key).agg(F.max("_gone").alias("_gone"))
                rows = rows.join(last, key, "left").where(F.col("_gone").isNull() | (F.col("_gone") <= F.col("_commit"))).drop("_gone")
        return rows

    def read(self, session: str | None = None, version: int | None = None) -> DataFrame:
        """All chunks, or those of a session, as of a version; an unknown session has none."""
        rows = self._all("data", SCHEMA, version)
        rows = rows if session is None else rows.where(F.col("session_id") == session)
        return self._alive(rows, version).select(*[f.split()[0] for f in SCHEMA.split(", ")])

    def documents(self, session: str | None = None, version: int | None = None) -> DataFrame:
        """(session_id, name, document_uuid, version, previous_uuid, chunks): the newest version of every document that is still there."""
        rows = self._all("documents", DOCUMENTS, version)
        rows = rows if session is None else rows.where(F.col("session_id") == session)
        rows = self._alive(rows, version)
        newest = rows.groupBy("session_id", "name").agg(F.max_by(F.struct(*[f.split()[0] for f in DOCUMENTS.split(", ")]), "version").alias("r"))
        return newest.select("r.*")

    def document(self, session: str, document: str) -> DataFrame:
        return self.read(session).where(F.col("document_uuid") == document)

    @staticmethod
    def _shaped(chunks: DataFrame) -> DataFrame:
        return chunks.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in SCHEMA.split(", ")])

    def add(self, chunks: DataFrame) -> int:
        """Append chunks of any sessions; ValueError, and nothing written, if a row lacks a required field."""
        if not chunks.where(~valid()).isEmpty():
            raise ValueError("chunk rows need " + ", ".join(REQUIRED))
        shaped = self._shaped(chunks)
        self._commit(shaped, None, None, None, None)
        return shaped.count()

    def _mark(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, GONE)

    def _drop(self, session: str, which: Column, marks: list[tuple], base: int) -> int:
        n = self.read(session, base).where(which).count()
        if n:
            self._commit(None, self._mark(marks), None, [session], base)
        return n

    def delete_session(self, session: str) -> int:
        return self._drop(session, F.lit(True), [(session, None, None)], self.version())

    def delete_document(self, session: str, document: str) -> int:
        return self._drop(session, F.col("document_uuid") == document, [(session, document, None)], self.version())

    def delete_ids(self, session: str, ids: list[str]) -> int:
        return self._drop(session, F.col("id").isin(*ids), [(session, None, i) for i in ids], self.version()) if ids else 0

    def replace_document(self, chunks: DataFrame, session: str, previous: str | None, base: int | None = None) -> int:
        """A new version's chunks in, those of the previous version out, in one commit; returns how many went. base: the version that previous was read from."""
        base = self.version() if base is None else base
        gone = self.read(session, base).where(F.col("document_uuid") == previous).count() if previous else 0
        self._commit(self._shaped(chunks), self._mark([(session, previous, None)]) if previous else None, None, [session], base)
        return gone

    def put(self, chunks: DataFrame, documents: DataFrame, sessions: list[str], base: int) -> int:
        """Chunks and their documents(DOCUMENTS) in, the previous versions of these documents out, in one commit that was worked out from version base."""
        old = documents.where("previous_uuid IS NOT NULL").select("session_id", F.col("previous_uuid").alias("document_uuid"), F.lit(None).cast("string").alias("id"))
        return self._commit(self._shaped(chunks), old, documents.select(*[f.split()[0] for f in DOCUMENTS.split(", ")]), sessions, base)

    def info(self) -> dict:
        return {"name": self.path.rsplit("/", 1)[-1], "count": self.read().count(), "directory": self.path}
