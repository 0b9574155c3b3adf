"""Whole runs from a folder of images to folders of clusters: ``batch`` and ``add``.

Images are decoded and embedded where they are read; only vectors move on. The output folder
must be one that all machines mount, and must not lie in the input folder.
"""

from __future__ import annotations

import json
import os
import shutil
import time
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SpeciesConfig
from ..functions import models
from ..operators import tables as T
from ..operators.graph import durable
from ..sources import images
from ..sources import state as S
from . import identify

PATHS_AT_ONCE = 50_000
PLACED = "folder string, filename string, how string"


def _local(folder: str) -> str:
    if "://" in folder or folder.startswith("file:"):
        folder = folder.removeprefix("file://").removeprefix("file:")
        if "://" in folder:
            raise ValueError(f"links and copies need a mounted folder: {folder}")
    return os.path.abspath(folder)


def organize(rows: DataFrame, out: str, link: bool = True) -> DataFrame:
    """Links (or copies, also where links fail) of all images in folders of clusters; (folder, filename, how).

    Old folders of clusters in ``out`` go first. The tasks make the links.
    """
    out = _local(out)
    os.makedirs(out, exist_ok=True)
    for entry in os.scandir(out):
        if entry.is_dir(follow_symlinks=False) and (entry.name.startswith("cluster_") or entry.name == "unclustered"):
            shutil.rmtree(entry.path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how = []
            for path, folder, name in zip(*[batch.column(c).to_pylist() for c in ("path", "folder", "filename")], strict=True):
                os.makedirs(f"{out}/{folder}", exist_ok=True)
                to = f"{out}/{folder}/{name}"
                if os.path.lexists(to):  # a task that runs again
                    os.remove(to)
                try:
                    if not link:
                        raise OSError("copies are asked for")
                    os.symlink(os.path.realpath(path), to)
                    how.append("link")
                except OSError:
                    shutil.copy2(path, to)
                    how.append("copy")
            yield pa.RecordBatch.from_arrays([batch.column("folder"), batch.column("filename"), pa.array(how, pa.string())], ["folder", "filename", "how"])

    return durable(T.filenames(rows).select("path", "folder", "filename").mapInArrow(place, PLACED), "placed")


def write_summary(rows: DataFrame, out: str, cfg: SpeciesConfig, elapsed: float, **extra) -> dict:
    """``summary.json`` in ``out``, through the file system that the path names; the same as a dictionary."""
    spark = rows.sparkSession
    summary = json.loads(T.summary(rows, cfg.species, cfg.to_json(), elapsed, **extra).first()["json"])
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/summary.json")
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    stream.write(bytearray(json.dumps(summary, indent=2).encode()))
    stream.close()
    return summary


def embedded(decoded: DataFrame, factory: Callable, face_dim: int, body_dim: int) -> DataFrame:
    """(path, face, body, has_face, has_body) of decoded images (path, content), staged."""
    vectors = models.embedded(decoded.withColumn("idx", F.lit(0).cast("long")), factory)
    return durable(models.filled(vectors, face_dim, body_dim).drop("idx", "error"), "embedded")


def batch(spark: SparkSession, folder: str, out: str, cfg: SpeciesConfig, factory: Callable, face_dim: int, body_dim: int, link: bool = True) -> dict:
    """Clusters all images of ``folder`` into ``out``, where the state goes too; the summary. No images or no faces: ValueError."""
    began = time.time()
    files = durable(images.deduplicated(images.scan(spark, folder, content=False)), "files")
    if files.isEmpty():
        raise ValueError("no images found")
    vectors = embedded(images.decoded(spark, folder), factory, face_dim, body_dim)
    rows = files.join(vectors, "path").select("idx", "path", "face", "body", "has_face", "has_body")
    result = identify.batch(rows, cfg)
    organize(result.rows, out, link).count()
    elapsed = time.time() - began
    S.save(S.State(result.rows, face_dim, body_dim, cfg), f"{out}/state")
    return write_summary(result.rows, out, cfg, elapsed, **result.counts())


def add(spark: SparkSession, folder: str, state: str, out: str, factory: Callable, link: bool = True) -> dict | None:
    """Adds the new images of ``folder`` to the clusters of ``state``; the summary, or None if there are no new images."""
    began = time.time()
    stored = S.load(spark, state)
    files = images.deduplicated(images.scan(spark, folder, content=False)).drop("idx")
    new = durable(T.new_rows(files, stored.rows), "new-files")
    if new.isEmpty():
        return None
    vectors, paths = None, (r["path"] for r in new.select("path").toLocalIterator())
    while some := list(islice(paths, PATHS_AT_ONCE)):
        part = embedded(images.decoded(spark, some), factory, stored.face_dim, stored.body_dim)
        vectors = part if vectors is None else vectors.unionByName(part)
    result = identify.add(stored.rows, new.join(vectors, "path"), stored.config)
    organize(result.rows, out, link).count()
    elapsed = time.time() - began
    S.save(S.State(result.rows, stored.face_dim, stored.body_dim, stored.config), f"{out}/state")
    return write_summary(result.rows, out, stored.config, elapsed, mode="incremental", new_images=new.count(), assigned_to_existing=result.assigned)
