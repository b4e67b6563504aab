"""Streams: documents into the mutation log, a change classifier with state, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLASSIFIED = "path string, sha256 string, change string"
STATE = "sha256 string, structural_sha256 string"


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path, content of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "content")


def classify(rows: DataFrame) -> DataFrame:
    """path, sha256, change (full, cosmetic, unchanged) of a stream of (path, sha256, structural_sha256, seq), in order of seq for each path. The state of
    a path is its last content and structure."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        out = []
        last = tuple(state.get) if state.exists else None
        new = pd.concat(list(batches)).sort_values("seq")
        for sha, structure in zip(new["sha256"], new["structural_sha256"], strict=True):
            change = "full" if last is None or last[1] is None else "unchanged" if sha == last[0] else "cosmetic" if structure == last[1] else "full"
            out.append((key[0], sha, change))
            last = (sha, structure)
        state.update(last)
        yield pd.DataFrame(out, columns=["path", "sha256", "change"])

    from pyspark.sql.streaming.state import GroupStateTimeout

    return rows.groupBy("path").applyInPandasWithState(step, CLASSIFIED, STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events(ts, event_type, value). A stream has a watermark; a batch gives the same rows."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events without a longer gap."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def ingest(files: DataFrame, log_path: str, checkpoint: str, now: int, hooks=None):
    """Starts a query that parses files(path, content), extracts their facts and appends them to the log as one batch for each micro-batch. A batch that
    is run again overwrites its own folder, so that nothing is appended twice."""
    from ..operators import extract, mutations
    from ..sources import parse

    def write(batch: DataFrame, epoch: int) -> None:
        docs = parse.parse_files(batch, hooks).persist()
        try:
            facts = extract.extract_all(docs, None, now)
            pairs = facts["edge_evidence"].groupBy(F.col("edge_id").alias("id")).agg(F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"))
            steps = [("upsert_node", facts["nodes"]), ("upsert_evidence", facts["evidence"]), ("upsert_edge", facts["edges"].join(pairs, "id")), ("record_value", facts["metric_values"])]
            out = mutations.log_rows(steps, epoch)
            out.write.mode("overwrite").parquet(f"{log_path}/batch={epoch}")
            docs.where("error IS NOT NULL").select("source_path", "error").write.mode("overwrite").json(f"{log_path}-errors/batch={epoch}")
        finally:
            docs.unpersist()

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return spark.read.schema("seq long, op string, id string, payload string").option("basePath", log_path).parquet(log_path).select(F.col("batch").cast("long").alias("batch"), "seq", "op", "id", "payload")
