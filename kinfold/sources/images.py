"""Images: listing, deduplication by target, and decoding."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import IMAGE_EXTENSIONS
from ..operators.tables import numbered

GLOB = "*.{" + ",".join(e[1:] for ext in IMAGE_EXTENSIONS for e in (ext, ext.upper())) + "}"


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.append_column("resolved", pa.array([os.path.realpath(p) if p.startswith("/") else p for p in batch.column("path").to_pylist()], pa.string()))


def _files(spark: SparkSession, kind: str, at: str | list[str]) -> DataFrame:
    return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", GLOB).option("dropInvalid", False).load(at)


def _plain(path: str):
    return F.regexp_replace(path, r"^file:/+", "/")


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(path, resolved, content) of image files in all subfolders.

    Extensions are matched in lower or upper case, not mixed. Links are resolved on file systems;
    other stores have none. Spark's file sources leave out names that begin with a dot or an
    underscore.
    """
    files = _files(spark, "binaryFile", folder).select(_plain("path").alias("path"), *(["content"] if content else []))
    schema = "path string, " + ("content binary, " if content else "") + "resolved string"
    return files.mapInArrow(_resolved, schema).select("path", "resolved", *(["content"] if content else []))


def decoded(spark: SparkSession, at: str | list[str]) -> DataFrame:
    """(path, content) with content (height, width, data: BGR bytes) of image files in all subfolders, or of the files named.

    Null for files that cannot be read, and for formats that the JVM has no reader for (WebP).
    """
    image = _files(spark, "image", at).select(_plain("image.origin").alias("path"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("d"))
    return image.mapInArrow(_bgr, "path string, content struct<height:int,width:int,data:binary>")


def _bgr(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One or four channels become three."""
    import numpy as np

    for batch in batches:
        out = []
        for h, w, c, d in zip(*[batch.column(n).to_pylist() for n in "hwcd"], strict=True):
            if h <= 0 or c not in (1, 3, 4):
                out.append(None)
                continue
            x = np.frombuffer(d, np.uint8).reshape(h, w, c)
            out.append({"height": h, "width": w, "data": (np.repeat(x, 3, 2) if c == 1 else x[:, :, :3]).tobytes()})
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))], ["path", "content"])


def deduplicated(files: DataFrame) -> DataFrame:
    """The first path, in order, of each ``resolved`` target, with ``idx`` in path order."""
    first = F.row_number().over(Window.partitionBy("resolved").orderBy("path"))
    return numbered(files.withColumn("_r", first).where("_r = 1").drop("_r"), ["path"], "idx")
