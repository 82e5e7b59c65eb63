"""Micro-batch adapters: the batch operators applied to a stream.

The reference has no streaming; these helpers only let a fitted model and the
row-wise preparation (source counting, cached location lookup, encoding) run
on each micro-batch of a Structured Streaming source. State lives in the
sink and the cache table, not in the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import clean, encode, learn, locate


def prepare_stream(stream: DataFrame, sources_col: str | None = None, cache: DataFrame | None = None,
                   mapping: DataFrame | None = None, encode_cols: list[str] | None = None,
                   lat_col: str = "latitude", lon_col: str = "longitude") -> DataFrame:
    """Stateless per-row steps; a stream-static join to the cache and the encoder mapping."""
    out = stream
    if sources_col:
        out = clean.count_sources(out, sources_col)
    if cache is not None:
        out = locate.enrich_location(out, cache, lat_col=lat_col, lon_col=lon_col)
    if mapping is not None and encode_cols:
        out = encode.transform_ordinal(out, mapping, encode_cols)
    return out


def score_stream(stream: DataFrame, built: learn.BuiltModel, keep: list[str], sink_path: str,
                 checkpoint_path: str, trigger_once: bool = True):
    """Score every micro-batch with a fitted model and append it to a Parquet sink."""
    scored = learn.score(built, stream, keep=keep)
    writer = (scored.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint_path).outputMode("append"))
    if trigger_once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
