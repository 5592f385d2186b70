"""Applying a fitted ensemble to a streaming DataFrame.

The reference has no streams; this is not a new operator but PU6/PU7 used as
they are: scoring is a narrow projection against the broadcast model table (a
stream-static join), so the same ``predict_proba`` / ``predict`` plan runs per
micro-batch with no state. ``score_files`` is the usual file-source wiring:
new feature files in a folder are scored and appended to a sink folder, with
the checkpoint in the shared location so a restarted query resumes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_stream(model, stream_df: DataFrame, hard: bool = False) -> DataFrame:
    """predict_proba (or predict) on a streaming DataFrame with the model's key and feature columns."""
    return model.predict(stream_df) if hard else model.predict_proba(stream_df)


def score_files(model, spark, in_dir: str, schema, out_dir: str, checkpoint: str, hard: bool = False,
                available_now: bool = True):
    """Score feature files arriving in ``in_dir`` (Parquet) into ``out_dir``; returns the query."""
    src = spark.readStream.schema(schema).parquet(in_dir)
    out = score_stream(model, src, hard)
    w = out.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
