"""Incremental NAV ingest as a Structured Streaming query.

Landed NAV documents (JSON Lines) are the stream source. Each micro-batch runs
the batch ingest: malformed documents and bad rows go to their quarantine
tables, the rest is appended to ``raw_nav`` by key (first write wins in the
batch, stored keys win over the batch). All three targets are keyed, quarantine
by a lasting place in the landed files, so a micro-batch that is replayed after a
failure adds nothing twice. The checkpoint path is required and belongs to the
landing folder: a restart goes on where the last run stopped. ``availableNow``
processes whatever has landed and stops, which is the weekly batch schedule
expressed as a stream; a processing-time trigger keeps it running.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from navframe.plans.jobs import ingest_nav_documents
from navframe.sinks.table import Table
from navframe.sources.json_docs import parse_nav_documents, with_line, with_source


def nav_document_stream(spark: SparkSession, landing_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Newly landed JSON Lines files as a stream of lines with their file."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return with_source(reader.load(landing_path))


def start_nav_ingest(
    spark: SparkSession,
    landing_path: str,
    raw_nav: str | Table,
    checkpoint_path: str,
    quarantine_path: str | None = None,
    corrupt_path: str | None = None,
    available_now: bool = True,
    processing_time: str | None = None,
    schemes: str | Table | None = None,
) -> StreamingQuery:
    """Start the ingest stream; returns the running query.

    ``raw_nav`` is a folder or a :class:`Table`, whose layout is kept. With
    ``schemes`` (a stored scheme list) only NAVs of listed schemes are appended,
    as in the batch ingest."""
    if not checkpoint_path:
        raise ValueError("a checkpoint path is required: without it each start reads everything again")
    listed = Table(path=schemes) if isinstance(schemes, str) else schemes

    def _batch(batch: DataFrame, epoch_id: int) -> None:
        session = batch.sparkSession
        ingest_nav_documents(
            session,
            parse_nav_documents(with_line(batch)),
            raw_nav,
            quarantine_path,
            corrupt_path,
            listed.read(session) if listed is not None else None,
        )

    lines = nav_document_stream(spark, landing_path)
    writer = lines.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint_path)
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
