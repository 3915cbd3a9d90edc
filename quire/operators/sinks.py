"""Writing results: tables that appear as a whole, upserts into a store, and the checks before vectors are exported."""

from __future__ import annotations

from collections.abc import Callable
from itertools import batched
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a statement and of a vector store's request.
STATEMENT_ROWS, REQUEST_POINTS = 100, 128
COLUMNS = ("chunk_id", "document_id", "text", "embedding", "section", "metadata")


def _folder(spark: SparkSession, path: str):
    """(file system, function that makes a path of it) of a path, in whatever store it is."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_outputs(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below ``path``, written aside first; old tables are replaced only when all new ones are complete.

    ``manifest`` is moved last: where it is, all is there.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, at = _folder(spark, path)
    aside = f"{path}/_new-{uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{aside}/{name}")
        fs.delete(at(f"{path}/manifest"), True)
        for name in sorted(tables, key=lambda n: (n == "manifest", n)):
            fs.delete(at(f"{path}/{name}"), True)
            if not fs.rename(at(f"{aside}/{name}"), at(f"{path}/{name}")):
                raise OSError(f"could not move {name} to {path}")
    finally:
        fs.delete(at(aside), True)


def read_outputs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that ``write_outputs`` left; FileNotFoundError without a manifest. Chunks without boxes have an empty list."""
    fs, at = _folder(spark, path)
    if not fs.exists(at(f"{path}/manifest")):
        raise FileNotFoundError(f"{path} holds no complete output")
    out = {s.getPath().getName(): spark.read.parquet(str(s.getPath())) for s in fs.listStatus(at(path)) if s.isDirectory() and not s.getPath().getName().startswith("_")}
    if "chunks" in out and "boxes" not in out["chunks"].columns:
        out["chunks"] = out["chunks"].withColumn("boxes", F.array().cast("array<struct<page:int,x:double,y:double,w:double,h:double>>"))
    return out


def vector_size(chunks: DataFrame, column: str = "embedding") -> int:
    """The vectors' common size. Raises ValueError where sizes differ or vectors are missing."""
    r = chunks.agg(F.min(F.coalesce(F.size(column), F.lit(-1))).alias("a"), F.max(F.size(column)).alias("b")).first()
    if r["a"] is None or r["a"] != r["b"] or r["a"] < 1:
        raise ValueError("every chunk needs a vector of the same size")
    return r["a"]


def export_rows(chunks: DataFrame) -> DataFrame:
    """Rows for a vector store: id, text, vector and metadata as JSON; section paths joined for stores without arrays."""
    meta = F.to_json(F.struct("document_id", "chunk_index", "content_type", "section_path", "page_start", "page_end"))
    return chunks.select("chunk_id", "document_id", F.col("raw_content").alias("text"), "embedding", F.array_join("section_path", " > ").alias("section"), meta.alias("metadata"))


def upsert_statement(table: str, rows: int, mark: str = "%s") -> str:
    """An insert of so many rows that replaces rows with the same chunk id."""
    values = ", ".join(["(" + ", ".join([mark] * len(COLUMNS)) + ")"] * rows)
    return f"INSERT INTO {table} ({', '.join(COLUMNS)}) VALUES {values} ON CONFLICT (chunk_id) DO UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in COLUMNS[1:])


def upsert(rows: DataFrame, connect: Callable[[], object], table: str, mark: str = "%s") -> None:
    """Upserts ``export_rows`` over DB-API connections, one transaction a partition, STATEMENT_ROWS a statement.

    ``connect`` is called where the rows are. A partition that is tried again upserts the
    same rows, so nothing is doubled. Vectors go as text, ``[1.0,2.0]``.
    """
    vector = F.concat(F.lit("["), F.array_join(F.transform("embedding", lambda x: x.cast("string")), ","), F.lit("]"))
    ready = rows.withColumn("embedding", vector).select(*COLUMNS).dropDuplicates(["chunk_id"])

    def run(part) -> None:
        con = connect()
        try:
            cursor = con.cursor()
            for some in batched(part, STATEMENT_ROWS):
                cursor.execute(upsert_statement(table, len(some), mark), [v for r in some for v in r])
            con.commit()
        except BaseException:
            con.rollback()
            raise
        finally:
            con.close()

    ready.foreachPartition(run)


def send_points(rows: DataFrame, send: Callable[[list[dict]], None]) -> None:
    """Points (id, vector, payload) to a vector store, REQUEST_POINTS a request; ids follow from chunk ids, so that sending again changes nothing."""
    from quire.functions.text import point_id

    ready = rows.select(point_id(F.col("chunk_id")).alias("id"), F.col("embedding").alias("vector"), F.struct("chunk_id", "document_id", "text", "section", "metadata").alias("payload"))

    def run(part) -> None:
        for some in batched(part, REQUEST_POINTS):
            send([r.asDict(True) for r in some])

    ready.foreachPartition(run)
