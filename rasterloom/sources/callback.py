"""Frames handed to functions of the user's own, image by image and in order: sockets, object stores, archives.

A sink is what open_sink(image_id) returns, with write(bytes) -> how many it took and flush() -> whether that worked. A short write or a
failed flush is an error, which fails the task; a task that is tried again opens its sinks anew, so a sink should replace what an earlier
attempt left. Rows of an image reach one task, sorted; only one frame is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

from pyspark.sql import DataFrame, Row

from ..session import ship_package


def _send(open_sink: Callable, rows: Iterator[Row]) -> None:
    image, sink = None, None

    def close() -> None:
        if sink is not None and not sink.flush():
            raise OSError(f"image {image}: the sink couldn't be flushed")

    for row in rows:
        if sink is None or row["image_id"] != image:
            close()
            image = row["image_id"]
            sink = open_sink(image)
        data = bytes(row["frame"])
        if (took := sink.write(data)) != len(data):
            raise OSError(f"image {image}: the sink took {took} of {len(data)} bytes")
    close()


def deliver(framed: DataFrame, open_sink: Callable) -> None:
    """Sends image_id, ordinal, tag, frame to sinks, images side by side."""
    ship_package(framed.sparkSession)
    framed.select("image_id", "ordinal", "frame").repartition("image_id").sortWithinPartitions("image_id", "ordinal").foreachPartition(partial(_send, open_sink))


def deliver_stream(framed: DataFrame, open_sink: Callable, checkpoint: str, **trigger):
    """The same for a stream of frames. A batch holds the frames that follow those before, so a sink here appends to what it has."""
    writer = framed.writeStream.foreachBatch(lambda batch, _: deliver(batch, open_sink)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
