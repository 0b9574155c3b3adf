"""Queries over the driver's tables, each with the same question in SQL where SQL can ask it."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, config
from .functions import geometry as G
from .functions import models, pixels
from .functions import vectors as V
from .operators import blocks, detect, phases
from .operators import clusterers as C
from .operators import tables as T
from .operators.graph import components, durable, shared_dir
from .plans import fixture, identify
from .sources import state as S
from .sources.images import deduplicated

DOG = config("dog")
R = 5  # digits that results are rounded to


def _r(c, digits: int = R):
    """Rounded, with -0.0 as 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("idx"), V.doubles(F.col("embedding")).alias("vec"), "label")


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return durable(fixture.modalities(spark, sf), "fixture")


def vec_norm(spark, sf):
    e = _embeddings(spark, sf)
    scaled = e.withColumn("vec", F.transform("vec", lambda x: x * (F.col("label") + 1)))
    return scaled.select("idx", _r(V.norm(F.col("vec"))).alias("norm"), _r(V.norm(V.normalise(F.col("vec")))).alias("unit"), _r(F.element_at(V.normalise(F.col("vec")), 1)).alias("first"))


def sim_edges(spark, sf):
    return blocks.edges(_embeddings(spark, sf), "idx", "vec", 0.3).select("a", "b", _r("sim").alias("sim"))


def knn_topk(spark, sf):
    return blocks.nearest(_embeddings(spark, sf), "idx", "vec", 2).select("idx", F.col("rank").cast("int").alias("rank"), _r("dist").alias("dist"))


def mutual_reach(spark, sf):
    e = _embeddings(spark, sf)
    core = blocks.nearest(e, "idx", "vec", 2).where("rank = 2").select(F.col("idx").alias("i"), F.col("dist").alias("core"))
    pairs = blocks.edges(e, "idx", "vec", 0.3)
    j = pairs.join(core.select(F.col("i").alias("a"), F.col("core").alias("ca")), "a").join(core.select(F.col("i").alias("b"), F.col("core").alias("cb")), "b")
    return j.select("a", "b", _r(F.greatest(1 - F.col("sim"), "ca", "cb")).alias("reach"))


def graph_components(spark, sf):
    e = _embeddings(spark, sf)
    return components(e.select(F.col("idx").alias("node")), blocks.edges(e, "idx", "vec", 0.35).select("a", "b"))


def fixture_modalities(spark, sf):
    f = fixture.modalities(spark, sf)
    return f.select("idx", "path", "has_face", "has_body", "label", _r(F.element_at("face", 1)).alias("f1"), _r(F.element_at("body", 1)).alias("b1"), _r(V.norm(F.col("face"))).alias("fn"))


def _centroid_rows(c: DataFrame) -> DataFrame:
    return c.select("cluster", F.posexplode("centroid").alias("pos", "x")).select("cluster", "pos", _r("x").alias("x"))


def centroid_median(spark, sf):
    return _centroid_rows(phases.face_centroids(_rows(spark, sf)))


def centroid_mean(spark, sf):
    r = _rows(spark, sf).where("label <> -1 and has_body").select(F.col("label").alias("cluster"), "body")
    return _centroid_rows(V.mean_vector(r, "cluster", "body", "centroid"))


def centroid_body(spark, sf):
    return _centroid_rows(phases.modality_centroids(_rows(spark, sf), "body"))


def body_rescue(spark, sf):
    r = _rows(spark, sf)
    log = phases.rescue(r, phases.face_centroids(r), DOG)
    return log.select("idx", "action", "cluster", _r("body_avg_sim").alias("body_avg_sim"), F.col("n_agree").cast("long").alias("n_agree"), "proposed_cluster")


def rescue_outcomes(spark, sf):
    return body_rescue(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def rescue_stats(spark, sf):
    return phases.rescue_stats(_rows(spark, sf), DOG).select("idx", "cluster", "first_idx", F.col("n_agree").cast("long").alias("n_agree"), _r("avg_sim").alias("avg_sim"))


def merge_candidates(spark, sf):
    return phases.merge_candidates(_rows(spark, sf), DOG).select("c1", "c2", _r("centroid_sim").alias("centroid_sim"))


def merge_stats(spark, sf):
    return phases.merge_decisions(_rows(spark, sf), DOG).select("c1", "c2", _r("avg_body_sim").alias("avg_body_sim"), _r("ratio_above").alias("ratio_above"), _r("avg_face_sim").alias("avg_face_sim"), "blocked")


def merge_components(spark, sf):
    r = _rows(spark, sf)
    d = phases.merge_decisions(r, DOG).where("not blocked").select(F.col("c1").cast("long").alias("a"), F.col("c2").cast("long").alias("b"))
    return components(T.clusters(r).select(F.col("label").cast("long").alias("node")), d)


def merged_labels(spark, sf):
    merged, _ = identify.merge_phase(_rows(spark, sf), DOG)
    return T.sizes(T.renumber(merged))


def renumber(spark, sf):
    r = fixture.modalities(spark, sf).select("idx", F.when(F.col("label") == -1, -1).otherwise(F.col("label") * 7 + 3).cast("int").alias("label"))
    return T.renumber(r).select("idx", "label")


def cluster_sizes(spark, sf):
    return T.sizes(fixture.modalities(spark, sf))


def label_stats(spark, sf):
    f = fixture.modalities(spark, sf)
    return T.modality_counts(f).crossJoin(f.agg(F.coalesce(F.max("label"), F.lit(-1)).alias("max_label"), F.countDistinct(F.when(F.col("label") != -1, F.col("label"))).alias("n_labels"), F.count_if(F.col("label") == -1).alias("n_noise")))


def _found(spark, sf):
    f = fixture.modalities(spark, sf)
    return f.select("idx", F.concat(F.lit("new/"), F.col("idx").cast("string")).alias("path"), F.concat(F.lit("/abs/"), F.col("idx").cast("string")).alias("resolved"))


def _stored_paths(spark, sf):
    f = fixture.modalities(spark, sf)
    return f.select(F.when(F.col("idx") % 3 == 0, F.concat(F.lit("new/"), F.col("idx").cast("string"))).when(F.col("idx") % 3 == 1, F.concat(F.lit("/abs/"), F.col("idx").cast("string"))).otherwise("elsewhere").alias("path"))


def new_rows_anti(spark, sf):
    return T.new_rows(_found(spark, sf), _stored_paths(spark, sf)).select("idx", "path")


def scan_dedupe(spark, sf):
    f = fixture.modalities(spark, sf).select(F.concat("path", F.lit("#"), F.col("idx").cast("string")).alias("path"), F.col("path").alias("resolved"))
    return deduplicated(f).select("idx", "path", "resolved")


def _split(spark, sf):
    r = _rows(spark, sf)
    return r.where("idx % 4 <> 0"), r.where("idx % 4 = 0")


def assign_centroid(spark, sf):
    old, new = _split(spark, sf)
    return phases.assign(new, old, DOG).select("idx", "cluster", _r("score").alias("score"))


def state_union(spark, sf):
    old, new = _split(spark, sf)
    both = T.append_rows(old.select("idx", "path", "label"), new.select("idx", F.concat("path", F.lit("#"), F.lpad(F.col("idx").cast("string"), 8, "0")).alias("path"), "label"))
    return both.select("idx", "path", "label")


def manifest(spark, sf):
    return T.manifest(fixture.modalities(spark, sf)).select("idx", "folder", "base", F.col("rank").cast("long").alias("rank"))


def summary_counts(spark, sf):
    s = T.summary(fixture.modalities(spark, sf), "dog", DOG.to_json(), 0.0)
    return s.select("total_images", "n_clusters", "n_unclustered", F.explode("cluster_sizes").alias("folder", "n"))


def summary_json(spark, sf):
    return T.summary(fixture.modalities(spark, sf), "dog", DOG.to_json(), 1.234, rescue_count=1, body_cluster_count=2, merge_count=3).select("json")


def report(spark, sf):
    return T.report(fixture.modalities(spark, sf))


def filenames(spark, sf):
    return T.filenames(fixture.modalities(spark, sf)).select("idx", "folder", "filename")


def state_roundtrip(spark, sf):
    """The last of two saved versions, read back."""
    r, folder = _rows(spark, sf), f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    S.save(S.State(r, 64, 64, DOG), folder)
    S.save(S.State(r.withColumn("label", F.col("label") + 1), 64, 64, DOG), folder)
    s = S.load(spark, folder)
    first = lambda c: _r(F.element_at(c, 1).cast("double"), 4)
    return s.rows.select("idx", "path", "has_face", "has_body", "label", first("face").alias("f1"), first("body").alias("b1"), F.lit(s.config.species).alias("species"), F.lit(s.face_dim).alias("face_dim"))


def merge_log(spark, sf):
    _, log = identify.merge_phase(_rows(spark, sf), DOG)
    return log.select("action", F.col("clusters")[0].alias("c1"), F.col("clusters")[1].alias("c2"), "avg_body_sim", "avg_face_sim", "reason")


def phase_guards(spark, sf):
    """Phases over rows that are too few for them: one face, one body, one cluster."""
    r = _rows(spark, sf)
    low = r.agg(F.min(F.when(F.col("has_face"), F.col("idx"))).alias("f"), F.min(F.when(F.col("has_body"), F.col("idx"))).alias("b"), F.min(F.when(F.col("label") != -1, F.col("label"))).alias("c")).first()
    face = identify.face_phase(r.where(~F.col("has_face") | (F.col("idx") == low["f"])), DOG)
    body, _ = identify.body_phase(r.where(~F.col("has_body") | (F.col("idx") == low["b"])).withColumn("label", F.lit(-1)), DOG)
    merged, _ = identify.merge_phase(r.where(F.col("label").isin(-1, low["c"])), DOG)
    out = None
    for name, d in (("face", face), ("body", body), ("merge", merged)):
        one = d.agg(F.lit(name).alias("guard"), F.count("*").alias("n"), F.count_if(F.col("label") != -1).alias("n_labelled"))
        out = one if out is None else out.unionByName(one)
    return out


def model_rows(spark, sf):
    """Vectors of a stand-in model, which fails on some rows and finds nothing on others."""

    def factory():
        def embed(content):
            k = int(content)
            if k % 13 == 0:
                raise RuntimeError(f"no image {k}")
            return ([k % 7, k % 5, 1.0] if k % 3 else None), ([0.0, 0.0] if k % 4 == 0 else [1.0, k % 11])

        return embed

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("idx"), F.lit("p").alias("path"), F.when(F.col("vec_id") % 17 != 0, F.col("vec_id").cast("string").cast("binary")).alias("content"))
    m = models.filled(models.embedded(e, factory), 3, 2)
    return m.select("idx", "has_face", "has_body", "error", *[_r(F.col(c)[i]).alias(f"{c}{i}") for c, n in (("face", 3), ("body", 2)) for i in range(n)])


def crop_input(spark, sf):
    """The model's input of crops of one colour: its three channels, and how many values it has."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            x = [pixels.model_input(np.tile(np.array([i % 256, i % 200, i % 150], np.uint8), (20 + i % 9, 30, 1))) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array([float(v[0, c].mean()) for v in x]) for c in range(3)], pa.array([v.size for v in x], pa.int64())], ["vec_id", "r", "g", "b", "n"])

    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id").where("vec_id < 40")
    return e.mapInArrow(run, "vec_id long, r double, g double, b double, n long").select("vec_id", *[_r(c, 4).alias(c) for c in "rgb"], "n")


def presets(spark, sf):
    names = list(asdict(DOG))
    d = spark.createDataFrame([tuple(asdict(c).values()) for c in PRESETS.values()], names)
    return d.select(*[F.col(c).cast("int") if t == "bigint" else F.col(c) for c, t in d.dtypes])


def _boxes(spark, sf):
    """Synthetic boxes from the vectors' components: image sizes, corners, eyes and scores."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    at = lambda i: F.element_at("embedding", i).cast("double")
    d = e.select("vec_id", (F.lit(400) + F.col("vec_id") % 300).cast("int").alias("w"), (F.lit(300) + F.col("vec_id") % 211).cast("int").alias("h"), (F.lit(320.0) + at(1) * 400).alias("cx"), (F.lit(320.0) + at(2) * 400).alias("cy"), (F.lit(60.0) + F.abs(at(3)) * 300).alias("bw"), (F.lit(60.0) + F.abs(at(4)) * 300).alias("bh"), (at(5) * 60).alias("ex"), (at(6) * 60).alias("ey"), F.abs(at(7)).alias("conf"), (F.col("vec_id") % 25).alias("image"))
    return d


def bbox_geometry(spark, sf):
    d = _boxes(spark, sf)
    lb = G.letterbox(F.col("w"), F.col("h"))
    d = d.withColumns(lb).withColumns({f"c_{k}": v for k, v in G.corners(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh")).items()})
    un = G.unletterbox({k: F.col(f"c_{k}") for k in ("x1", "y1", "x2", "y2")}, F.col("scale"), F.col("pad_x"), F.col("pad_y"), F.col("w"), F.col("h"))
    d = d.withColumns(un).withColumns(G.eye_geometry(F.lit(0.0), F.lit(0.0), F.col("ex"), F.col("ey")))
    d = d.withColumns(G.body_crop(F.col("x1").cast("double"), F.col("y1").cast("double"), F.col("x2").cast("double"), F.col("y2").cast("double"), F.col("w"), F.col("h")))
    d = d.withColumns(G.face_crop(F.col("x1").cast("double"), F.col("y1").cast("double"), F.col("x2").cast("double"), F.col("y2").cast("double"), F.col("level"), F.col("w"), F.col("h")))
    d = d.withColumn("kept", G.big_enough({k: F.col(k) for k in ("bx1", "by1", "bx2", "by2")}))
    return d.select("vec_id", _r("scale").alias("scale"), "new_w", "new_h", "pad_x", "pad_y", "x1", "y1", "x2", "y2", _r("eye_distance").alias("eye_distance"), _r("angle").alias("angle"), "usable", "level", "bx1", "by1", "bx2", "by2", "fx1", "fy1", "fx2", "fy2", "kept")


def _cornered(spark, sf):
    d = _boxes(spark, sf)
    return d.withColumns(G.corners(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh")))


def iou_pairs(spark, sf):
    """Overlap of each box with the next one of its image, by id."""
    from pyspark.sql import Window

    d = _cornered(spark, sf)
    w = Window.partitionBy("image").orderBy("vec_id")
    box = F.struct("x1", "y1", "x2", "y2")
    d = d.withColumn("n", F.lead(box).over(w)).where("n is not null")
    return d.select("vec_id", _r(G.iou({k: F.col(k) for k in ("x1", "y1", "x2", "y2")}, {k: F.col(f"n.{k}") for k in ("x1", "y1", "x2", "y2")})).alias("iou"))


def nms(spark, sf):
    d = _cornered(spark, sf).where("conf > 0.02")
    boxes = d.groupBy("image").agg(F.collect_list(F.struct("conf", "x1", "y1", "x2", "y2", "vec_id")).alias("boxes"))
    return boxes.select("image", F.explode(G.nms_keep(F.col("boxes"))).alias("b")).select("image", F.col("b.vec_id").alias("vec_id"), _r("b.conf").alias("conf"))


def best_box(spark, sf):
    d = _cornered(spark, sf).where("conf > 0.02")
    return d.groupBy("image").agg(F.max(F.struct("conf", (-F.col("vec_id")).alias("v"))).alias("b")).select("image", (-F.col("b.v")).alias("vec_id"), _r("b.conf").alias("conf"))


def species_vote(spark, sf):
    d = _boxes(spark, sf).select((F.col("vec_id") % 120).alias("image"), F.when(F.col("conf") > 0.08, 16).otherwise(15).alias("cls"))
    return T.species_vote(d)


def best_body(spark, sf):
    d = _cornered(spark, sf).select("image", (15 + F.col("vec_id") % 2).alias("cls"), (F.col("conf") * 3).alias("conf"), "x1", "y1", "x2", "y2")
    return detect.best_bodies(d, DOG.coco_class).select("image", *[_r(c).alias(c) for c in ("conf", "x1", "y1", "x2", "y2")])


def _predictions(spark, sf):
    """Synthetic face predictions, a few an image."""
    at = lambda i: F.element_at("embedding", i).cast("double")
    image = F.col("vec_id") % 25
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    lm = F.array(*[F.lit(320.0) + at(10 + i) * 900 for i in range(6)])
    return e.select(image.alias("image"), (400 + image * 7).cast("int").alias("w"), (300 + image * 5).cast("int").alias("h"), (F.lit(320.0) + at(1) * 400).alias("cx"), (F.lit(320.0) + at(2) * 400).alias("cy"), (F.lit(60.0) + F.abs(at(3)) * 300).alias("bw"), (F.lit(60.0) + F.abs(at(4)) * 300).alias("bh"), (F.abs(at(7)) * 3).alias("obj"), lm.alias("lm"), F.array(F.abs(at(8)), F.abs(at(9))).alias("cls"))


def face_decode(spark, sf):
    f = detect.faces(_predictions(spark, sf))
    return f.select("image", "rank", _r("conf").alias("conf"), "x1", "y1", "x2", "y2", *[_r(F.col("lm")[i], 3).alias(f"l{i}") for i in range(6)])


def best_face(spark, sf):
    return detect.best_faces(detect.faces(_predictions(spark, sf))).select("image", _r("conf").alias("conf"), "x1", "y1", "x2", "y2")


def _clustered(algorithm):
    def run(spark, sf):
        f = fixture.modalities(spark, sf).where("has_face").select("idx", F.col("face").alias("vec"))
        return C.cluster(durable(f, "faces"), config("dog", algorithm=algorithm))

    return run


def core_distance(spark, sf):
    f = durable(fixture.modalities(spark, sf).where("has_face").select("idx", F.col("face").alias("vec")), "faces")
    return blocks.nearest(f, "idx", "vec", 2).where("rank = 2").select("idx", _r("dist").alias("core"))


def pipeline_batch(spark, sf):
    return identify.batch(_rows(spark, sf), DOG).rows.select("idx", "path", "label")


def pipeline_add(spark, sf):
    r = _rows(spark, sf).withColumn("path", F.concat("path", F.lit("#"), F.lpad(F.col("idx").cast("string"), 8, "0")))
    first = identify.batch(r.where("idx % 4 <> 0"), DOG)
    return identify.add(first.rows, r.where("idx % 4 = 0").drop("label"), DOG).rows.select("idx", "path", "label")


LINKED = config("dog", algorithm="agglomerative")


def face_phase(spark, sf):
    return identify.face_phase(_rows(spark, sf), LINKED).select("idx", "label")


def body_phase(spark, sf):
    """Clusters of the bodies that the given labels leave out, and what the log says of them."""
    out, log = identify.body_phase(_rows(spark, sf), LINKED)
    return out.join(log.select("idx", "action"), "idx", "left").select("idx", "label", "action")


QUERIES = {
    f.__name__: f
    for f in (
        vec_norm, sim_edges, knn_topk, mutual_reach, graph_components, fixture_modalities, centroid_median, centroid_mean, centroid_body, body_rescue,
        rescue_outcomes, rescue_stats, merge_candidates, merge_stats, merge_components, merged_labels, renumber, cluster_sizes, label_stats, new_rows_anti,
        scan_dedupe, assign_centroid, state_union, manifest, summary_counts, summary_json, presets, bbox_geometry, iou_pairs, nms, best_box, species_vote,
        core_distance, pipeline_batch, pipeline_add, report, filenames, state_roundtrip, merge_log, phase_guards, model_rows, crop_input, best_body,
        face_decode, best_face, face_phase, body_phase,
    )
} | {"cluster_whispers": _clustered("chinese_whispers"), "cluster_agglomerative": _clustered("agglomerative"), "cluster_hdbscan": _clustered("hdbscan")}

_E = "e AS MATERIALIZED (SELECT vec_id AS idx, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec, label FROM embeddings)"
_SIM = "s AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b, list_dot_product(x.vec, y.vec) AS sim FROM e x JOIN e y ON x.idx < y.idx)"
_NEAR = """d AS (SELECT a AS idx, greatest(0.0, least(2.0, 1 - sim)) AS dist FROM s UNION ALL SELECT b, greatest(0.0, least(2.0, 1 - sim)) FROM s),
n AS MATERIALIZED (SELECT idx, CAST(row_number() OVER (PARTITION BY idx ORDER BY dist) AS INT) AS rank, dist FROM d QUALIFY rank <= 2)"""


def _median(source: str, cluster: str, vec: str, denominator: str, name: str = "c") -> str:
    return f"""{name}0 AS MATERIALIZED (SELECT {cluster} AS cluster, unnest(generate_series(1, 64)) AS p, unnest({vec}) AS x FROM {source}),
{name}1 AS MATERIALIZED (SELECT cluster, p, median(x) AS m FROM {name}0 GROUP BY cluster, p),
{name}2 AS MATERIALIZED (SELECT cluster, list(m ORDER BY p) AS m, sqrt(sum(m * m)) AS nrm FROM {name}1 GROUP BY cluster),
{name} AS MATERIALIZED (SELECT cluster, list_transform(m, lambda x: x / ({denominator})) AS centroid FROM {name}2)"""


_FACES = "(SELECT * FROM rows WHERE label <> -1 AND has_face)"
_BODIES = "(SELECT * FROM rows WHERE label <> -1 AND has_body)"
_SAFE = "CASE WHEN nrm > 0 THEN nrm ELSE 1 END"
_STATS = """mb AS (SELECT idx, label AS cluster, body, min(idx) OVER (PARTITION BY label) AS first_idx, count(*) OVER (PARTITION BY label) AS k FROM rows WHERE label <> -1 AND has_body),
st0 AS MATERIALIZED (SELECT u.idx, m.cluster, m.first_idx, list_dot_product(u.body, m.body) AS sim FROM (SELECT * FROM rows WHERE label = -1 AND has_body) u, mb m WHERE m.k >= 3),
st AS MATERIALIZED (SELECT idx, cluster, first_idx, count(*) FILTER (WHERE sim > 0.25) AS n_agree, avg(sim) AS avg_sim FROM st0 GROUP BY ALL)"""
_RESCUE = (
    _STATS
    + ", "
    + _median(_FACES, "label", "face", _SAFE)
    + """, best AS (SELECT * FROM st WHERE n_agree >= 3 AND avg_sim > -1 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY avg_sim DESC, first_idx) = 1),
lg AS (SELECT r.idx, r.has_body, b.cluster AS bc, b.avg_sim, b.n_agree, r.has_face AND sqrt(list_dot_product(r.face, r.face)) > 0.1 AND c.centroid IS NOT NULL AND list_dot_product(r.face, c.centroid) < 0.05 AS veto
    FROM rows r LEFT JOIN best b USING (idx) LEFT JOIN c ON c.cluster = b.cluster WHERE r.label = -1),
al AS (SELECT *, CASE WHEN NOT has_body THEN 'no_body' WHEN bc IS NULL THEN 'insufficient' WHEN coalesce(veto, false) THEN 'vetoed' ELSE 'rescued' END AS action FROM lg)"""
)
_CAND = _median(_BODIES, "label", "body", "nrm + 1e-8") + ", cand AS MATERIALIZED (SELECT x.cluster AS c1, y.cluster AS c2, list_dot_product(x.centroid, y.centroid) AS sim FROM c x JOIN c y ON x.cluster < y.cluster WHERE list_dot_product(x.centroid, y.centroid) > 0.7 * 0.35)"
_MERGE = (
    _CAND
    + """, bp AS MATERIALIZED (SELECT k.c1, k.c2, list_dot_product(x.body, y.body) AS sim FROM cand k JOIN rows x ON x.label = k.c1 AND x.has_body JOIN rows y ON y.label = k.c2 AND y.has_body),
bs AS (SELECT c1, c2, avg(sim) AS ab, avg(CASE WHEN sim > 0.35 THEN 1.0 ELSE 0.0 END) AS ra FROM bp GROUP BY c1, c2),
fp AS (SELECT k.c1, k.c2, avg(list_dot_product(x.face, y.face)) AS af FROM bs k JOIN rows x ON x.label = k.c1 AND x.has_face JOIN rows y ON y.label = k.c2 AND y.has_face WHERE k.ab >= 0.35 GROUP BY k.c1, k.c2),
dec AS MATERIALIZED (SELECT c1, c2, ab, ra, coalesce(af, 1.0) AS af, coalesce(af, 1.0) < 0.10 AS blocked FROM bs LEFT JOIN fp USING (c1, c2) WHERE ab >= 0.35 AND ra >= 0.5)"""
)
_COMP = """link AS (SELECT c1 AS a, c2 AS b FROM dec WHERE NOT blocked UNION ALL SELECT c2, c1 FROM dec WHERE NOT blocked),
reach AS (SELECT DISTINCT label AS node, label AS seen FROM rows WHERE label <> -1 UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_BOX = """bx AS (SELECT vec_id, CAST(400 + vec_id % 300 AS INT) AS w, CAST(300 + vec_id % 211 AS INT) AS h, 320.0::DOUBLE + embedding[1]::DOUBLE * 400 AS cx, 320.0::DOUBLE + embedding[2]::DOUBLE * 400 AS cy,
    60.0::DOUBLE + abs(embedding[3]::DOUBLE) * 300 AS bw, 60.0::DOUBLE + abs(embedding[4]::DOUBLE) * 300 AS bh, embedding[5]::DOUBLE * 60 AS ex, embedding[6]::DOUBLE * 60 AS ey, abs(embedding[7]::DOUBLE) AS conf, vec_id % 25 AS image FROM embeddings),
cb AS (SELECT *, cx - bw / 2 AS x1, cy - bh / 2 AS y1, cx + bw / 2 AS x2, cy + bh / 2 AS y2 FROM bx)"""
_IOU = "greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _iou(a: str, b: str) -> str:
    inter = _IOU.format(a=a, b=b)
    return f"({inter}) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - ({inter}) + 1e-6)"


def _f(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join([fixture.SQL.strip(), *ctes])} {select}"


def _trunc(x: str) -> str:
    return f"CAST(trunc({x}) AS INT)"


def _rank_cents(name: str) -> str:
    return f"SELECT cluster, CAST(unnest(generate_series(0, 63)) AS INT) AS pos, round(unnest(centroid), {R}) + 0.0 AS x FROM {name}"


_NAMED = "SELECT idx, label, CASE WHEN label = -1 THEN 'unclustered' ELSE 'cluster_' || lpad(CAST(dense_rank() OVER (PARTITION BY label = -1 ORDER BY label) AS VARCHAR), 3, '0') END AS folder, split_part(path, '/', 3) AS base FROM rows"
_CLAMP = "least(greatest((lm[{j}] - {pad}) / scale, 0.0), {most})"
_FACES_SQL = f"""pr AS (SELECT vec_id, vec_id % 25 AS image, CAST(400 + vec_id % 25 * 7 AS INT) AS w, CAST(300 + vec_id % 25 * 5 AS INT) AS h, 320.0::DOUBLE + embedding[1]::DOUBLE * 400 AS cx, 320.0::DOUBLE + embedding[2]::DOUBLE * 400 AS cy,
    60.0::DOUBLE + abs(embedding[3]::DOUBLE) * 300 AS bw, 60.0::DOUBLE + abs(embedding[4]::DOUBLE) * 300 AS bh, abs(embedding[7]::DOUBLE) * 3 AS obj, greatest(abs(embedding[8]::DOUBLE), abs(embedding[9]::DOUBLE)) AS best, list_transform(embedding[10:15], lambda x: 320.0::DOUBLE + x::DOUBLE * 900) AS lm FROM embeddings),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC) AS rk FROM (SELECT *, obj * best AS conf, cx - bw / 2 AS x1, cy - bh / 2 AS y1, cx + bw / 2 AS x2, cy + bh / 2 AS y2 FROM pr WHERE obj > 0.3)),
ov AS MATERIALIZED (SELECT a.image, a.rk AS hi, b.rk AS lo FROM o a JOIN o b ON a.image = b.image AND a.rk < b.rk WHERE {_iou('a', 'b')} > 0.5),
wk AS (SELECT image, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT image FROM o) UNION ALL
    SELECT wk.image, wk.rk + 1, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.image = wk.image AND ov.lo = wk.rk + 1 AND list_contains(wk.kept, ov.hi)) THEN wk.kept ELSE list_append(wk.kept, wk.rk + 1) END FROM wk WHERE EXISTS (SELECT 1 FROM o WHERE o.image = wk.image AND o.rk = wk.rk + 1)),
kp AS (SELECT o.*, row_number() OVER (PARTITION BY o.image ORDER BY o.rk) - 1 AS rank FROM (SELECT image, kept FROM wk QUALIFY row_number() OVER (PARTITION BY image ORDER BY rk DESC) = 1) z JOIN o ON o.image = z.image AND list_contains(z.kept, o.rk)),
g0 AS (SELECT *, least(640 / h, 640 / w) AS scale FROM kp), g1 AS (SELECT *, {_trunc('(640 - ' + _trunc('w * scale') + ') / 2')} AS px, {_trunc('(640 - ' + _trunc('h * scale') + ') / 2')} AS py FROM g0),
faces AS (SELECT image, CAST(rank AS INT) AS rank, conf, {_trunc('greatest((x1 - px) / scale, 0.0)')} AS x1, {_trunc('greatest((y1 - py) / scale, 0.0)')} AS y1, {_trunc('least((x2 - px) / scale, w)')} AS x2, {_trunc('least((y2 - py) / scale, h)')} AS y2,
    {', '.join(_CLAMP.format(j=i + 1, pad='px' if i % 2 == 0 else 'py', most='w' if i % 2 == 0 else 'h') + f' AS l{i}' for i in range(6))} FROM g1)"""


def _pairs_sql(mask: str, vec: str) -> str:
    return f"f AS MATERIALIZED (SELECT idx, {vec} AS v FROM rows WHERE {mask}), fs AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b, list_dot_product(x.v, y.v) AS sim FROM f x JOIN f y ON x.idx < y.idx)"


def _linkage_sql(mask: str, vec: str) -> str:
    """``linked`` (idx, label): average linkage merge by merge, inside the components of pairs below the limit.

    A pair that never merges keeps the table from running empty, whose last merge would be lost.
    """
    return f"""{_pairs_sql(mask, vec)},
lk AS MATERIALIZED (SELECT a, b FROM fs WHERE 1 - sim < 0.55 UNION ALL SELECT b, a FROM fs WHERE 1 - sim < 0.55),
re AS (SELECT idx AS node, idx AS seen FROM f UNION SELECT r.node, l.b FROM re r JOIN lk l ON l.a = r.seen),
co AS MATERIALIZED (SELECT node, min(seen) AS comp FROM re GROUP BY node),
p0 AS MATERIALIZED (SELECT a, b, greatest(0.0, least(2.0, 1 - sim)) AS tot FROM fs JOIN co x ON x.node = a JOIN co y ON y.node = b AND y.comp = x.comp UNION ALL SELECT -2, -1, 1e9),
pp AS (SELECT 0 AS step, a, b, tot, 1::BIGINT AS n, NULL::BIGINT AS ma, NULL::BIGINT AS mb FROM p0
  UNION ALL SELECT step + 1, least(a2, b2), greatest(a2, b2), sum(tot), sum(n)::BIGINT, ma, mb FROM (
    SELECT p.step, p.tot, p.n, m.a AS ma, m.b AS mb, CASE WHEN p.a = m.b THEN m.a ELSE p.a END AS a2, CASE WHEN p.b = m.b THEN m.a ELSE p.b END AS b2
    FROM pp p JOIN (SELECT a, b FROM pp WHERE tot / n < 0.55 ORDER BY tot / n, a, b LIMIT 1) m ON true) WHERE a2 <> b2 GROUP BY ALL),
mg AS MATERIALIZED (SELECT DISTINCT mb, ma FROM pp WHERE step > 0),
up AS (SELECT idx, idx AS label FROM f UNION ALL SELECT up.idx, ma FROM up JOIN mg ON mb = up.label),
linked AS MATERIALIZED (SELECT idx, min(label) AS label FROM up GROUP BY idx)"""


#: All sweeps over all nodes with a neighbour, one node a step; a sweep that changes nothing is followed by such sweeps only.
_WHISPERS = f"""{_pairs_sql("has_face", "face")},
nd AS MATERIALIZED (SELECT idx, row_number() OVER (ORDER BY idx) AS i FROM (SELECT a AS idx FROM fs WHERE sim > 0.45 UNION SELECT b FROM fs WHERE sim > 0.45)),
nb AS MATERIALIZED (SELECT x.i, y.i AS j, least(sim, 1.0) AS w FROM (SELECT a, b, sim FROM fs WHERE sim > 0.45 UNION ALL SELECT b, a, sim FROM fs WHERE sim > 0.45) e JOIN nd x ON x.idx = e.a JOIN nd y ON y.idx = e.b),
near AS MATERIALIZED (SELECT i, list(j ORDER BY j) AS js, list(w ORDER BY j) AS ws FROM nb GROUP BY i),
od AS MATERIALIZED (SELECT sweep * (SELECT count(*) FROM nd) + row_number() OVER (PARTITION BY sweep ORDER BY md5('0|' || sweep || '|' || idx)) AS k, i, js, ws FROM nd JOIN near USING (i), (SELECT unnest(generate_series(0, 19)) AS sweep)),
st AS (SELECT 0::BIGINT AS k, list(i ORDER BY i) AS lab FROM nd
  UNION ALL SELECT k, list_concat(lab[1:i - 1], [best], lab[i + 1:]) FROM (
    SELECT o.k, o.i, z.lab, (SELECT l FROM (SELECT z.lab[u.j] AS l, sum(u.w) AS v, min(u.j) AS t FROM (SELECT unnest(o.js) AS j, unnest(o.ws) AS w) u GROUP BY 1) ORDER BY v DESC, t LIMIT 1) AS best
    FROM st z JOIN od o ON o.k = z.k + 1)),
en AS (SELECT lab FROM st ORDER BY k DESC LIMIT 1),
lb AS (SELECT idx, min(idx) OVER (PARTITION BY lab[i]) AS label FROM nd, en)"""


def _presets_sql() -> str:
    """The fixed values of both presets as they are stated, and what is the same in both."""
    shared = "'face_detector.onnx' AS detector_model, 'body_detector.onnx' AS body_detector_model, 0.05::DOUBLE AS face_veto_threshold, 0.1::DOUBLE AS face_contradiction_threshold, 2 AS min_cluster_size, 2 AS min_samples, 0.5::DOUBLE AS min_body_overlap_ratio, 'hdbscan' AS algorithm, 0.55::DOUBLE AS distance_threshold, 0.45::DOUBLE AS cw_threshold, 20 AS cw_iterations, 0 AS seed"
    return f"SELECT *, species || '_face.onnx' AS face_model, species || '_body.onnx' AS body_model, {shared} FROM (VALUES ('dog', 16, 0.5::DOUBLE, 0.25::DOUBLE, 3, 0.35::DOUBLE), ('cat', 15, 0.3::DOUBLE, 0.2::DOUBLE, 2, 0.3::DOUBLE)) t(species, coco_class, face_weight, body_rescue_threshold, min_body_agreements, body_merge_threshold)"


SQL = {
    "vec_norm": f"WITH {_E}, z AS MATERIALIZED (SELECT idx, list_transform(vec, lambda x: x * (label + 1)) AS v FROM e), y AS MATERIALIZED (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM z), u AS MATERIALIZED (SELECT *, list_transform(v, lambda x: x / n) AS un FROM y) SELECT idx, round(n, {R}) + 0.0 AS norm, round(sqrt(list_dot_product(un, un)), {R}) + 0.0 AS unit, round(un[1], {R}) + 0.0 AS first FROM u",
    "sim_edges": f"WITH {_E}, {_SIM} SELECT a, b, round(sim, {R}) + 0.0 AS sim FROM s WHERE sim > 0.3",
    "knn_topk": f"WITH {_E}, {_SIM}, {_NEAR} SELECT idx, rank, round(dist, {R}) + 0.0 AS dist FROM n",
    "mutual_reach": f"WITH {_E}, {_SIM}, {_NEAR}, c AS MATERIALIZED (SELECT idx, dist FROM n WHERE rank = 2), p AS MATERIALIZED (SELECT a, b, sim FROM s WHERE sim > 0.3) SELECT a, b, round(greatest(1 - sim, x.dist, y.dist), {R}) + 0.0 AS reach FROM p JOIN c x ON x.idx = a JOIN c y ON y.idx = b",
    "graph_components": f"WITH RECURSIVE {_E}, {_SIM}, link AS MATERIALIZED (SELECT a, b FROM s WHERE sim > 0.35 UNION ALL SELECT b, a FROM s WHERE sim > 0.35), reach AS (SELECT idx AS node, idx AS seen FROM e UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen) SELECT node, min(seen) AS component FROM reach GROUP BY node",
    "fixture_modalities": _f(f"SELECT idx, path, has_face, has_body, label, round(face[1], {R}) + 0.0 AS f1, round(body[1], {R}) + 0.0 AS b1, round(sqrt(list_dot_product(face, face)), {R}) + 0.0 AS fn FROM rows"),
    "centroid_median": _f(_rank_cents("c"), _median(_FACES, "label", "face", _SAFE)),
    "centroid_body": _f(_rank_cents("c"), _median(_BODIES, "label", "body", _SAFE)),
    "centroid_mean": _f(f"SELECT cluster, CAST(p - 1 AS INT) AS pos, round(avg(x), {R}) + 0.0 AS x FROM (SELECT label AS cluster, unnest(generate_series(1, 64)) AS p, unnest(body) AS x FROM {_BODIES}) GROUP BY cluster, p"),
    "rescue_stats": _f(f"SELECT idx, cluster, first_idx, n_agree, round(avg_sim, {R}) + 0.0 AS avg_sim FROM st WHERE n_agree > 0", _STATS),
    "body_rescue": _f(f"SELECT idx, action, CASE WHEN action = 'rescued' THEN bc END AS cluster, CASE WHEN action IN ('rescued', 'vetoed') THEN round(avg_sim, {R}) + 0.0 END AS body_avg_sim, CASE WHEN action = 'rescued' THEN n_agree END AS n_agree, CASE WHEN action = 'vetoed' THEN bc END AS proposed_cluster FROM al", _RESCUE),
    "rescue_outcomes": _f("SELECT action, count(*) AS n FROM al GROUP BY action", _RESCUE),
    "merge_candidates": _f(f"SELECT c1, c2, round(sim, {R}) + 0.0 AS centroid_sim FROM cand", _CAND),
    "merge_stats": _f(f"SELECT c1, c2, round(ab, {R}) + 0.0 AS avg_body_sim, round(ra, {R}) + 0.0 AS ratio_above, round(af, {R}) + 0.0 AS avg_face_sim, blocked FROM dec", _MERGE),
    "merge_components": _f("SELECT CAST(node AS BIGINT) AS node, CAST(component AS BIGINT) AS component FROM comp", _MERGE, _COMP, recursive=True),
    "merged_labels": _f("SELECT CASE WHEN label = -1 THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY label = -1 ORDER BY label) - 1 AS INT) END AS label, n FROM (SELECT coalesce(component, label) AS label, count(*) AS n FROM rows LEFT JOIN comp ON node = label GROUP BY 1)", _MERGE, _COMP, recursive=True),
    "renumber": _f("SELECT idx, CASE WHEN label = -1 THEN -1 ELSE CAST(dense_rank() OVER (PARTITION BY label = -1 ORDER BY label) - 1 AS INT) END AS label FROM rows"),
    "cluster_sizes": _f("SELECT label, count(*) AS n FROM rows GROUP BY label"),
    "label_stats": _f("SELECT count(*) AS n, count(*) FILTER (WHERE has_face) AS n_face, count(*) FILTER (WHERE has_body) AS n_body, max(label) AS max_label, count(DISTINCT label) FILTER (WHERE label <> -1) AS n_labels, count(*) FILTER (WHERE label = -1) AS n_noise FROM rows"),
    "new_rows_anti": "SELECT vec_id AS idx, 'new/' || vec_id AS path FROM embeddings WHERE vec_id >= 20 AND vec_id % 3 = 2",
    "scan_dedupe": _f("SELECT row_number() OVER (ORDER BY path) - 1 AS idx, path, resolved FROM (SELECT min(path || '#' || idx) AS path, path AS resolved FROM rows GROUP BY 2)"),
    "assign_centroid": _f(
        f"SELECT idx, cluster, round(score, {R}) + 0.0 AS score FROM (SELECT * FROM sc WHERE score > -1 QUALIFY row_number() OVER (PARTITION BY idx ORDER BY score DESC, cluster) = 1) WHERE score > 0.25",
        _median("(SELECT * FROM rows WHERE label <> -1 AND has_face AND idx % 4 <> 0)", "label", "face", _SAFE, "cf"),
        _median("(SELECT * FROM rows WHERE label <> -1 AND has_body AND idx % 4 <> 0)", "label", "body", _SAFE, "cb"),
        "cc AS (SELECT cluster, cf.centroid AS f, cb.centroid AS b FROM cf FULL JOIN cb USING (cluster))",
        "ss AS MATERIALIZED (SELECT idx, cluster, CASE WHEN has_face AND f IS NOT NULL THEN list_dot_product(face, f) END AS sf, CASE WHEN has_body AND b IS NOT NULL THEN list_dot_product(body, b) END AS sb FROM rows, cc WHERE idx % 4 = 0)",
        "sc AS (SELECT idx, cluster, CASE WHEN sf IS NULL THEN sb WHEN sb IS NULL THEN sf ELSE 0.5 * sf + 0.5 * sb END AS score FROM ss)",
    ),
    "state_union": _f("SELECT idx, path, label FROM rows WHERE idx % 4 <> 0 UNION ALL SELECT (SELECT max(idx) FROM rows WHERE idx % 4 <> 0) + row_number() OVER (ORDER BY path), path, label FROM (SELECT path || '#' || lpad(CAST(idx AS VARCHAR), 8, '0') AS path, label FROM rows WHERE idx % 4 = 0)"),
    "manifest": _f("SELECT idx, folder, base, row_number() OVER (PARTITION BY folder, base ORDER BY idx) - 1 AS rank FROM (SELECT idx, CASE WHEN label = -1 THEN 'unclustered' ELSE 'cluster_' || lpad(CAST(dense_rank() OVER (PARTITION BY label = -1 ORDER BY label) AS VARCHAR), 3, '0') END AS folder, split_part(path, '/', 3) AS base FROM rows)"),
    "summary_counts": _f("SELECT (SELECT count(*) FROM rows) AS total_images, (SELECT count(DISTINCT label) FROM rows WHERE label <> -1) AS n_clusters, (SELECT count(*) FROM rows WHERE label = -1) AS n_unclustered, 'cluster_' || lpad(CAST(row_number() OVER (ORDER BY label) AS VARCHAR), 3, '0') AS folder, n FROM (SELECT label, count(*) AS n FROM rows WHERE label <> -1 GROUP BY label)"),
    "presets": _presets_sql(),
    "cluster_whispers": _f("SELECT f.idx, coalesce(label, -1) AS label FROM f LEFT JOIN lb USING (idx)", _WHISPERS, recursive=True),
    "cluster_agglomerative": _f("SELECT idx, label FROM linked", _linkage_sql("has_face", "face"), recursive=True),
    "face_phase": _f("SELECT r.idx, coalesce(d, -1)::INT AS label FROM rows r LEFT JOIN (SELECT idx, dense_rank() OVER (ORDER BY label) - 1 AS d FROM linked) USING (idx)", _linkage_sql("has_face", "face"), recursive=True),
    "body_phase": _f("SELECT r.idx, coalesce(d + (SELECT max(label) + 1 FROM rows), r.label)::INT AS label, CASE WHEN d IS NOT NULL THEN 'body_clustered' END AS action FROM rows r LEFT JOIN (SELECT idx, dense_rank() OVER (ORDER BY label) - 1 AS d FROM linked) USING (idx)", _linkage_sql("label = -1 AND has_body", "body"), recursive=True),
    "report": _f("SELECT *, round(n_face * 100.0 / n, 1)::DOUBLE AS pct_face, round(n_body * 100.0 / n, 1)::DOUBLE AS pct_body, round(n_clustered * 100.0 / n, 1)::DOUBLE AS pct_clustered FROM (SELECT count(*) AS n, count(*) FILTER (WHERE has_face) AS n_face, count(*) FILTER (WHERE has_body) AS n_body, count(*) FILTER (WHERE label <> -1) AS n_clustered, count(*) FILTER (WHERE label = -1) AS n_unclustered, count(DISTINCT label) FILTER (WHERE label <> -1) AS n_clusters FROM rows)"),
    "filenames": _f(f"SELECT idx, folder, CASE WHEN rank = 0 THEN base ELSE replace(base, '.jpg', '_' || rank || '.jpg') END AS filename FROM (SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY idx) - 1 AS rank FROM ({_NAMED}))"),
    "state_roundtrip": _f("SELECT idx, path, has_face, has_body, CAST(label + 1 AS INT) AS label, round(CAST(CAST(face[1] AS FLOAT) AS DOUBLE), 4) + 0.0 AS f1, round(CAST(CAST(body[1] AS FLOAT) AS DOUBLE), 4) + 0.0 AS b1, 'dog' AS species, 64 AS face_dim FROM rows"),
    "summary_json": _f(f"""SELECT '{{"species":"dog","total_images":' || count(*) || ',"n_clusters":' || count(DISTINCT folder) FILTER (WHERE label <> -1) || ',"n_unclustered":' || count(*) FILTER (WHERE label = -1)
    || ',"cluster_sizes":{{' || (SELECT string_agg('"' || folder || '":' || n, ',' ORDER BY folder) FROM (SELECT folder, count(*) AS n FROM named WHERE label <> -1 GROUP BY folder))
    || '}},"elapsed_seconds":1.23,"config":{json.dumps(asdict(DOG), sort_keys=True, separators=(",", ":"))},"rescue_count":1,"body_cluster_count":2,"merge_count":3}}' AS json FROM named""", f"named AS ({_NAMED})"),
    "merge_log": _f(
        """SELECT 'blocked' AS action, c1, c2, round(ab, 4) AS avg_body_sim, NULL::DOUBLE AS avg_face_sim, 'face_contradiction=' || printf('%.4f', af) AS reason FROM dec WHERE blocked
    UNION ALL SELECT 'merged', o.c1, o.c2, round(ab, 4), round(af, 4), NULL FROM uf JOIN ord o USING (k) WHERE joined""",
        _MERGE,
        "ord AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ab DESC, c1, c2) AS k, c1, c2, ab, af FROM dec WHERE NOT blocked)",
        """uf AS (SELECT 0::BIGINT AS k, list(label ORDER BY label) AS root, list(label ORDER BY label) AS names, false AS joined FROM (SELECT DISTINCT label FROM rows WHERE label <> -1) UNION ALL
    SELECT k, CASE WHEN ra <> rb THEN list_transform(root, lambda x: CASE WHEN x = rb THEN ra ELSE x END) ELSE root END, names, ra <> rb
    FROM (SELECT o.k, uf.root, uf.names, uf.root[list_position(uf.names, o.c1)] AS ra, uf.root[list_position(uf.names, o.c2)] AS rb FROM uf JOIN ord o ON o.k = uf.k + 1))""",
        recursive=True,
    ),
    "phase_guards": _f("""SELECT 'face' AS guard, count(*) AS n, 0::BIGINT AS n_labelled FROM rows WHERE NOT has_face OR idx = (SELECT min(idx) FROM rows WHERE has_face)
    UNION ALL SELECT 'body', count(*), 0 FROM rows WHERE NOT has_body OR idx = (SELECT min(idx) FROM rows WHERE has_body)
    UNION ALL SELECT 'merge', count(*), count(*) FILTER (WHERE label <> -1) FROM rows WHERE label = -1 OR label = (SELECT min(label) FROM rows WHERE label <> -1)"""),
    "model_rows": f"""WITH k AS (SELECT vec_id AS idx, vec_id % 17 <> 0 AS there, vec_id % 17 <> 0 AND vec_id % 13 = 0 AS bad, vec_id AS k FROM embeddings),
f AS (SELECT idx, there AND NOT bad AND k % 3 <> 0 AS has_face, there AND NOT bad AS has_body, CASE WHEN bad THEN 'RuntimeError: no image ' || k END AS error, [k % 7, k % 5, 1.0]::DOUBLE[] AS fv, CASE WHEN k % 4 = 0 THEN [0.0, 0.0]::DOUBLE[] ELSE [1.0, k % 11]::DOUBLE[] END AS bv FROM k),
n AS (SELECT *, sqrt(list_dot_product(fv, fv)) AS fn, greatest(sqrt(list_dot_product(bv, bv)), 1e-300) AS bn FROM f)
SELECT idx, has_face, has_body, error, {", ".join(f"CASE WHEN has_face THEN round(fv[{i + 1}] / fn, {R}) ELSE 0.0 END + 0.0 AS face{i}" for i in range(3))}, {", ".join(f"CASE WHEN has_body THEN round(bv[{i + 1}] / bn, {R}) ELSE 0.0 END + 0.0 AS body{i}" for i in range(2))} FROM n""",
    "crop_input": "SELECT vec_id, round((vec_id % 150 / 255.0::DOUBLE - 0.485) / 0.229, 4) + 0.0 AS r, round((vec_id % 200 / 255.0::DOUBLE - 0.456) / 0.224, 4) + 0.0 AS g, round((vec_id % 256 / 255.0::DOUBLE - 0.406) / 0.225, 4) + 0.0 AS b, 150528::BIGINT AS n FROM embeddings WHERE vec_id < 40",
    "best_body": f"WITH {_BOX} SELECT image, round(conf * 3, {R}) + 0.0 AS conf, round(x1, {R}) + 0.0 AS x1, round(y1, {R}) + 0.0 AS y1, round(x2, {R}) + 0.0 AS x2, round(y2, {R}) + 0.0 AS y2 FROM cb WHERE vec_id % 2 = 1 AND conf * 3 > 0.3 QUALIFY row_number() OVER (PARTITION BY image ORDER BY conf DESC, x1, y1, x2, y2) = 1",
    "face_decode": f"WITH RECURSIVE {_FACES_SQL} SELECT image, rank, round(conf, {R}) + 0.0 AS conf, x1, y1, x2, y2, {', '.join(f'round(l{i}, 3) + 0.0 AS l{i}' for i in range(6))} FROM faces",
    "best_face": f"WITH RECURSIVE {_FACES_SQL} SELECT image, round(conf, {R}) + 0.0 AS conf, x1, y1, x2, y2 FROM faces WHERE rank = 0",
    "bbox_geometry": f"""WITH {_BOX}, l0 AS (SELECT *, least(640 / h, 640 / w) AS scale FROM cb),
l1 AS (SELECT *, {_trunc('w * scale')} AS new_w, {_trunc('h * scale')} AS new_h FROM l0), l2 AS (SELECT *, {_trunc('(640 - new_w) / 2')} AS pad_x, {_trunc('(640 - new_h) / 2')} AS pad_y FROM l1),
u AS (SELECT * EXCLUDE (x1, y1, x2, y2), {_trunc('greatest((x1 - pad_x) / scale, 0.0)')} AS x1, {_trunc('greatest((y1 - pad_y) / scale, 0.0)')} AS y1, {_trunc('least((x2 - pad_x) / scale, w)')} AS x2, {_trunc('least((y2 - pad_y) / scale, h)')} AS y2, sqrt(ex * ex + ey * ey) AS ed, degrees(atan2(ey, ex)) AS angle FROM l2),
m AS (SELECT *, {_trunc('(x2 - x1) * 0.1::DOUBLE')} AS mx, {_trunc('(y2 - y1) * 0.1::DOUBLE')} AS my, NOT (ed < 5) AS usable, abs(angle) < 1 AS level FROM u),
q AS (SELECT *, greatest(x1 - mx, 0) AS bx1, greatest(y1 - my, 0) AS by1, least(x2 + mx, w) AS bx2, least(y2 + my, h) AS by2 FROM m)
SELECT vec_id, round(scale, {R}) + 0.0 AS scale, new_w, new_h, pad_x, pad_y, x1, y1, x2, y2, round(ed, {R}) + 0.0 AS eye_distance, round(angle, {R}) + 0.0 AS angle, usable, level, bx1, by1, bx2, by2,
    CASE WHEN level THEN greatest(x1, 0) ELSE bx1 END AS fx1, CASE WHEN level THEN greatest(y1, 0) ELSE by1 END AS fy1, CASE WHEN level THEN least(x2, w) ELSE bx2 END AS fx2, CASE WHEN level THEN least(y2, h) ELSE by2 END AS fy2,
    by2 - by1 >= 32 AND bx2 - bx1 >= 32 AS kept FROM q""",
    "iou_pairs": f"WITH {_BOX}, k AS (SELECT *, lead(vec_id) OVER (PARTITION BY image ORDER BY vec_id) AS nx FROM cb) SELECT a.vec_id, round({_iou('a', 'b')}, {R}) + 0.0 AS iou FROM k a JOIN cb b ON b.vec_id = a.nx",
    "nms": f"""WITH RECURSIVE {_BOX}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY image ORDER BY conf DESC, x1 DESC, y1 DESC, x2 DESC, y2 DESC, vec_id DESC) AS rk FROM cb WHERE conf > 0.02),
ov AS MATERIALIZED (SELECT a.image, a.rk AS hi, b.rk AS lo FROM o a JOIN o b ON a.image = b.image AND a.rk < b.rk WHERE {_iou('a', 'b')} > 0.5),
w AS (SELECT image, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM (SELECT DISTINCT image FROM o) UNION ALL
    SELECT w.image, w.rk + 1, CASE WHEN EXISTS (SELECT 1 FROM ov WHERE ov.image = w.image AND ov.lo = w.rk + 1 AND list_contains(w.kept, ov.hi)) THEN w.kept ELSE list_append(w.kept, w.rk + 1) END FROM w WHERE EXISTS (SELECT 1 FROM o WHERE o.image = w.image AND o.rk = w.rk + 1))
SELECT o.image, o.vec_id, round(conf, {R}) + 0.0 AS conf FROM (SELECT image, kept FROM w QUALIFY row_number() OVER (PARTITION BY image ORDER BY rk DESC) = 1) z JOIN o ON o.image = z.image AND list_contains(z.kept, o.rk)""",
    "best_box": f"WITH {_BOX} SELECT image, vec_id, round(conf, {R}) + 0.0 AS conf FROM cb WHERE conf > 0.02 QUALIFY row_number() OVER (PARTITION BY image ORDER BY conf DESC, vec_id) = 1",
    "species_vote": f"WITH {_BOX}, im AS (SELECT DISTINCT vec_id % 120 AS image FROM bx), ch AS (SELECT image FROM im ORDER BY md5('0|' || image), image LIMIT 50), v AS (SELECT count(*) FILTER (WHERE conf > 0.08) AS n_dog, count(*) FILTER (WHERE NOT conf > 0.08) AS n_cat FROM cb WHERE vec_id % 120 IN (SELECT image FROM ch)) SELECT n_dog, n_cat, CASE WHEN n_dog >= n_cat THEN 'dog' ELSE 'cat' END AS species FROM v",
    "core_distance": _f(f"SELECT idx, round(dist, {R}) + 0.0 AS core FROM (SELECT idx, dist FROM d QUALIFY row_number() OVER (PARTITION BY idx ORDER BY dist) = 2)", "s AS MATERIALIZED (SELECT x.idx AS a, y.idx AS b, list_dot_product(x.face, y.face) AS sim FROM rows x JOIN rows y ON x.idx < y.idx WHERE x.has_face AND y.has_face)", "d AS (SELECT a AS idx, greatest(0.0, least(2.0, 1 - sim)) AS dist FROM s UNION ALL SELECT b, greatest(0.0, least(2.0, 1 - sim)) FROM s)"),
}
