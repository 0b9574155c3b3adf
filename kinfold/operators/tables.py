"""Labels, counts, unions and manifests. Label -1 is "no cluster" throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import durable


def numbered(rows: DataFrame, by: list[str], into: str, start: int = 0) -> DataFrame:
    """``into`` = ``start``, ``start`` + 1, ... in the order of ``by``, without one task that holds all rows.

    Rows are sorted over all tasks and staged with their place in their task; the tasks' counts
    (a row a task) give each task's start. Equal rows may come in any order.
    """
    staged = durable(rows.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    task, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = staged.groupBy(task.alias("_t")).agg(F.count("*").alias("_n")).select("_t", before.alias("_s"))
    return staged.withColumn("_t", task).join(F.broadcast(starts), "_t").withColumn(into, place + F.col("_s") + F.lit(start)).drop("_m", "_t", "_s")


def clusters(rows: DataFrame) -> DataFrame:
    return rows.where("label <> -1").select("label").distinct()


def renumber(rows: DataFrame) -> DataFrame:
    """Labels become 0 .. K-1 in the order of the old ones; -1 stays. Only the distinct labels are ranked."""
    ranks = clusters(rows).select(F.col("label").alias("_old"), (F.dense_rank().over(Window.orderBy("label")) - 1).alias("_new"))
    return rows.join(ranks, F.col("label") == F.col("_old"), "left").withColumn("label", F.coalesce("_new", F.lit(-1)).cast("int")).drop("_old", "_new")


def relabel(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels through ``mapping`` (cluster, root); others stay."""
    m = mapping.select(F.col("cluster").alias("_old"), F.col("root").alias("_new"))
    return rows.join(m, F.col("label") == F.col("_old"), "left").withColumn("label", F.coalesce("_new", "label").cast("int")).drop("_old", "_new")


def max_label(rows: DataFrame) -> int:
    return rows.agg(F.coalesce(F.max("label"), F.lit(-1))).first()[0]


def sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def modality_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.count_if("has_face").alias("n_face"), F.count_if("has_body").alias("n_body"))


def report(rows: DataFrame) -> DataFrame:
    """One row of counts and percents (one digit; 0 of no rows) of modalities and of rows with a cluster."""
    a = rows.agg(F.count("*").alias("n"), F.count_if("has_face").alias("n_face"), F.count_if("has_body").alias("n_body"), F.count_if(F.col("label") != -1).alias("n_clustered"), F.count_if(F.col("label") == -1).alias("n_unclustered"), F.count_distinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_clusters"))
    percent = lambda c: F.round(F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0)), 1)
    return a.withColumns({f"pct_{c}": percent(f"n_{c}") for c in ("face", "body", "clustered")})


def new_rows(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows of ``found`` (path, resolved) of which neither form is a stored ``path``: two equi anti-joins."""
    have = stored.select(F.col("path").alias("_have")).distinct()
    return found.join(have, F.col("path") == F.col("_have"), "left_anti").join(have, F.col("resolved") == F.col("_have"), "left_anti")


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows first; new rows get the next places in path order."""
    base = old.agg(F.coalesce(F.max("idx"), F.lit(-1)) + 1).first()[0]
    return old.unionByName(numbered(new.drop("idx"), ["path"], "idx", base).select(*old.columns))


def folder(label: Column, dense: Column) -> Column:
    return F.when(label == -1, "unclustered").otherwise(F.concat(F.lit("cluster_"), F.when(dense < 1000, F.lpad(dense.cast("string"), 3, "0")).otherwise(dense.cast("string"))))


def manifest(rows: DataFrame) -> DataFrame:
    """idx, folder, base (file name) and rank of that name in the folder, in idx order; dense folder numbers from 1."""
    ranks = clusters(rows).select(F.col("label").alias("_l"), F.dense_rank().over(Window.orderBy("label")).alias("_d"))
    named = rows.join(ranks, F.col("label") == F.col("_l"), "left").select("idx", "path", folder(F.col("label"), F.col("_d")).alias("folder"), F.substring_index("path", "/", -1).alias("base"))
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("folder", "base").orderBy("idx")) - 1)


def filenames(rows: DataFrame) -> DataFrame:
    """idx, path, folder, filename: the first file of a name keeps it, later ones try ``stem_1``, ``stem_2`` ...

    Names already taken in the folder are skipped, including real files called ``stem_1``. Only
    files whose names can clash are taken together: those of one folder whose stem without
    trailing ``_1``, ``_2`` ... and whose extension agree, where a name comes twice.
    """
    import pandas as pd

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values("idx")
        taken: set[str] = set()
        following: dict[str, int] = {}
        out = []
        for base in t["base"]:
            name = base
            if name in taken:
                dot = base.rfind(".")
                stem, ext = (base[:dot], base[dot:]) if dot > 0 else (base, "")
                k = following.get(base, 1)
                while f"{stem}_{k}{ext}" in taken:
                    k += 1
                name, following[base] = f"{stem}_{k}{ext}", k + 1
            taken.add(name)
            out.append(name)
        return t.assign(filename=out)[["idx", "path", "folder", "filename"]]

    ext = F.regexp_extract("base", r"^.+(\.[^.]*)$", 1)
    stem = F.expr("substring(base, 1, char_length(base) - char_length(_ext))")
    m = manifest(rows).withColumn("_ext", ext).withColumn("_stem", F.regexp_replace(stem, r"(_\d+)+$", ""))
    m = durable(m, "manifest")
    twice = m.where("rank > 0").select("folder", "_stem", "_ext").distinct()
    clash = m.join(twice, ["folder", "_stem", "_ext"]).groupBy("folder", "_stem", "_ext").applyInPandas(run, "idx long, path string, folder string, filename string")
    return m.join(twice, ["folder", "_stem", "_ext"], "left_anti").select("idx", "path", "folder", F.col("base").alias("filename")).unionByName(clash)


def summary(rows: DataFrame, species: str, config_json: str, elapsed: float, **extra) -> DataFrame:
    """One row: counts, cluster sizes by folder name, and the JSON of all with the configuration and extras."""
    named = manifest(rows).groupBy("folder").agg(F.count("*").alias("n"))
    agg = named.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_images"),
        F.count_if(F.col("folder") != "unclustered").alias("n_clusters"),
        F.coalesce(F.sum(F.when(F.col("folder") == "unclustered", F.col("n"))), F.lit(0)).alias("n_unclustered"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("folder") != "unclustered", F.struct("folder", "n"))))).alias("cluster_sizes"),
    )
    more = [F.lit(v).alias(k) for k, v in extra.items()]
    fields = [F.lit(species).alias("species"), "total_images", "n_clusters", "n_unclustered", "cluster_sizes", F.lit(round(elapsed, 2)).alias("elapsed_seconds"), F.from_json(F.lit(config_json), F.schema_of_json(F.lit(config_json))).alias("config"), *more]
    return agg.select("total_images", "n_clusters", "n_unclustered", "cluster_sizes", F.to_json(F.struct(*fields)).alias("json"))


def species_vote(boxes: DataFrame, images: int = 50, seed: int = 0) -> DataFrame:
    """(n_dog, n_cat, species) over the boxes (image, cls) of a seeded sample of images; a tie or none gives dog."""
    chosen = boxes.select("image").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("image").cast("string"))), "image").limit(images)
    v = boxes.join(chosen, "image", "left_semi").agg(F.count_if(F.col("cls") == 16).alias("n_dog"), F.count_if(F.col("cls") == 15).alias("n_cat"))
    return v.withColumn("species", F.when(F.col("n_dog") >= F.col("n_cat"), "dog").otherwise("cat"))
