"""State of a clustering: one row an image as Parquet and one row of metadata, in numbered versions.

A save writes the rows of a new version and then its metadata; a version is whole once its
metadata are there, and the last whole version is the state. Nothing is overwritten or
deleted, so a save that stops at any point leaves the state before it, and a plan never
overwrites what it reads. All goes through Spark's readers and writers, so the folder may lie
in any store that Spark reaches. Two saves at once: the second to write fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SpeciesConfig

ROWS = "idx long, path string, face array<float>, body array<float>, has_face boolean, has_body boolean, label int"
META = "version long, species string, face_dim int, body_dim int, config_json string"


@dataclass(frozen=True)
class State:
    rows: DataFrame
    face_dim: int
    body_dim: int
    config: SpeciesConfig


def exists(spark: SparkSession, folder: str) -> bool:
    """Whether anything lies at ``folder``, be it a whole state or not."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _last(spark: SparkSession, folder: str):
    """The metadata of the last whole version, or None."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v-*/meta/*.parquet")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
        return None
    return spark.read.schema(META).parquet(f"{folder}/v-*/meta/*.parquet").orderBy(F.desc("version")).first()


def save(state: State, folder: str) -> int:
    """Writes a new version and gives its number."""
    spark = state.rows.sparkSession
    last = _last(spark, folder)
    # versions that a save left unfinished are stepped over
    version = (last["version"] if last else 0) + 1
    while exists(spark, f"{folder}/v-{version:09d}"):
        version += 1
    at = f"{folder}/v-{version:09d}"
    typed = state.rows.select("idx", "path", *[F.transform(F.coalesce(c, F.array_repeat(F.lit(0.0), d)), lambda x: x.cast("float")).alias(c) for c, d in (("face", state.face_dim), ("body", state.body_dim))], "has_face", "has_body", F.col("label").cast("int").alias("label"))
    typed.write.parquet(f"{at}/rows")
    spark.createDataFrame([(version, state.config.species, state.face_dim, state.body_dim, state.config.to_json())], META).coalesce(1).write.parquet(f"{at}/meta")
    return version


def load(spark: SparkSession, folder: str) -> State:
    """The last whole version. None, a corrupt configuration or vectors of other widths raise ValueError."""
    meta = _last(spark, folder)
    if meta is None:
        raise ValueError(f"Corrupt state file: no whole version in {folder}")
    rows = spark.read.schema(ROWS).parquet(f"{folder}/v-{meta['version']:09d}/rows")
    wide = rows.where((F.size("face") != meta["face_dim"]) | (F.size("body") != meta["body_dim"]))
    if not wide.isEmpty():
        raise ValueError("Corrupt state file: a vector has another width than the state says")
    return State(rows, meta["face_dim"], meta["body_dim"], SpeciesConfig.from_json(meta["config_json"]))
