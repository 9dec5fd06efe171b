"""Trajectories as a stream: micro-batches of frames, summed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.trajectory import frame_results

FRAMES = "structure_id string, frame int, atom_index int, x double, y double, z double"


def frame_stream(spark: SparkSession, path: str, files: int | None = None, schema: str = FRAMES) -> DataFrame:
    """Parquet files of frames as a stream, files of them to a micro-batch at most. A file holds its frames whole."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def write_frame_totals(frames: DataFrame, topology: DataFrame, out: str, checkpoint: str, once: bool = False, **options) -> StreamingQuery:
    """Start a query that writes the frame_results() of each micro-batch's frames to the folder batch=N of out, in order of structure and frame.

    A batch that is run again after a failure replaces its own folder, so every frame is written once. once: take what is there and stop.
    A frame that lacks atoms of its topology is an error row; options go to the kernel.
    """

    def put(batch: DataFrame, number: int) -> None:
        frame_results(topology, batch, **options).orderBy("structure_id", "frame").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = frames.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
