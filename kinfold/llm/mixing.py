"""Mixing sources to target weights by fixed-length blocks.

1. Packing: within each source, documents lie end to end in a seeded pseudorandom order and
   the stream is cut into blocks of ``BLOCK`` words (the last may be shorter).
2. Targets: source weights share the sum of all sizes; no target is over ``EPOCHS`` times its
   source, the excess going to the others by weight (water filling, in closed form).
3. Draw: a target is worth a whole number of draws, and all sources' draws together fill the
   slots of the output shards. A keyed permutation of all slots deals them out, so the counts
   of sources per output shard (``shard_counts()``) are multinomial given their totals. (Free
   multinomial counts would miss the targets and, at a capped source, pass the limit of three
   uses.)
4. Index: a source's slots are numbered through all shards, from the counts of the shards
   before. Slot j gets use ``j div B`` of block ``perm(j mod B)``, with one keyed Feistel
   permutation per source and use, so no block comes again before all have come.
5. Blocks and slots are joined by (source, block). ``assembled()`` gives the mix itself, a text
   for each slot of each shard; ``mixed()`` what it takes of each document; ``repeated()`` whole
   documents, each as often as the block that holds its first word is drawn.

The permutation walks cycles until it is back in range, at most 40 steps. The grid exceeds
the range by at most 2 sqrt(B) + 1 places, so 40 steps always suffice for B <= 380; beyond,
a walk fails with a chance below (2 / sqrt(B)) ** 40 < 1e-39.

Sources are few: their table (a row a source) is ranked in one task.

Defined results: null or empty texts have size 0 and are never taken; null sources are one
source, the last; documents with equal ids are separate rows, in one place of the stream
only if text and source are equal too; an empty table gives an empty result. Extra columns
are ignored, and kept by ``repeated()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running_total, shuffle_parts, stage, table, words_of

BLOCK = 64
EPOCHS = 3
ROWS_PER_BUCKET = 1_000
SLOTS_PER_SHARD = 16_384
CHUNK = 8192


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """A keyed bijection of 0 .. n-1: four Feistel rounds on a square grid, with cycle walking."""
    side = F.ceil(F.sqrt(n.cast("double"))).cast("long")

    def once(x):
        def turn(a, k):
            return F.struct(a["r"].alias("l"), F.pmod(a["l"] + F.pmod(F.xxhash64(a["r"], k, *key), side), side).alias("r"))

        start = F.struct(F.floor(x / side).cast("long").alias("l"), F.pmod(x, side).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(4)), start, turn, lambda a: a["l"] * side + a["r"])

    return F.aggregate(F.sequence(F.lit(0), F.lit(40)), i.cast("long"), lambda x, k: F.when((k == 0) | (x >= n), once(x)).otherwise(x))


def targets(sizes: DataFrame, epochs: int = EPOCHS, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size -> also weight and target. One row a source; sources in code point order, null last."""
    every = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    by = every.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(every)
    t = t.withColumn("_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)).withColumn("_k", F.row_number().over(by))
    level = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("weight"), F.struct("_k", "_level"))).over(every)["_level"]
    return t.withColumn("target", F.least(F.col("_cap"), F.col("weight") * F.coalesce(level, F.lit(0.0)))).drop("_cap", "_level", "_k")


def packed(docs: DataFrame, seed: int, key: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents with their place in their source's stream and the columns ``key``, sources with blocks and draws), both staged."""
    slim = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.xxhash64("text").alias("_th"), *key)
    slim = slim.withColumn("_src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    slim = stage(slim, "mix-sizes")
    sizes = slim.groupBy("_src", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    s = targets(sizes).withColumn("_blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    drawn = F.least(F.round(F.try_divide(F.col("target") * F.col("_blocks"), F.col("source_size"))).cast("long"), F.col("_blocks") * EPOCHS)
    s = s.withColumn("_drawn", F.coalesce(drawn, F.lit(0).cast("long")))
    s = s.withColumn("_from", F.coalesce(F.sum("_drawn").over(Window.partitionBy(F.lit(0)).orderBy("_src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    s = stage(s, "mix-sources")
    most = (s.agg(F.max("_rows")).first()[0] or 0) // ROWS_PER_BUCKET + 1
    h = F.pmod(F.xxhash64("doc_id", "_th", F.lit(seed)), F.lit(1 << 32))
    d = slim.withColumn("_h", h).join(s.select("_src", "source_size", "target", (F.floor(F.col("_rows") / ROWS_PER_BUCKET) + 1).alias("_nb")), "_src")
    d = running_total(d, ["_src"], [F.col("_h"), F.col("doc_id"), F.col("_th"), F.col("size")], F.floor(F.col("_h") * F.col("_nb") / F.lit(float(1 << 32))), most, "size", "_off")
    return d.drop("_h", "_nb"), s


def slots(sources: DataFrame, seed: int) -> DataFrame:
    """_src, _blocks, shard, slot: the source that fills each slot of each output shard."""
    spark = sources.sparkSession
    # a stated number of partitions: the few bytes of chunk numbers would else be put into one task
    parts = max(shuffle_parts(spark), (sources.agg(F.sum("_drawn")).first()[0] or 0) // (8 * CHUNK))
    total = F.sum("_drawn").over(Window.partitionBy(F.lit(0)))
    s = sources.where("_drawn > 0").withColumn("_pool", total)
    chunks = s.select("_src", "_blocks", "_drawn", "_from", "_pool", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_drawn") - 1) / CHUNK))).alias("_c"))
    chunks = chunks.repartition(parts, F.col("_src"), F.col("_c"))
    last = F.least(F.col("_drawn"), (F.col("_c") + 1) * CHUNK) - 1
    each = chunks.withColumn("_k", F.explode(F.sequence(F.col("_from") + F.col("_c") * CHUNK, F.col("_from") + last)))
    each = each.select("_src", "_blocks", permuted(F.col("_k"), F.col("_pool"), F.lit("pool"), F.lit(seed)).alias("_place"))
    return each.select("_src", "_blocks", F.floor(F.col("_place") / SLOTS_PER_SHARD).alias("shard"), F.pmod("_place", F.lit(SLOTS_PER_SHARD)).alias("slot"))


def shard_counts(sources: DataFrame, seed: int) -> DataFrame:
    """shard, _src, n: how many slots of each output shard a source fills."""
    return slots(sources, seed).groupBy("shard", "_src").agg(F.count("*").alias("n"))


def draws(sources: DataFrame, seed: int) -> DataFrame:
    """_src, _block, shard, slot: the block of each slot of the whole mix."""
    n_shards = (sources.agg(F.sum("_drawn")).first()[0] or 0) // SLOTS_PER_SHARD + 1
    each = slots(sources, seed).withColumn("_one", F.lit(1).cast("long"))
    each = running_total(each, ["_src"], [F.col("shard"), F.col("slot")], F.col("shard"), n_shards, "_one", "_j")
    use = F.floor(F.col("_j") / F.col("_blocks"))
    block = permuted(F.pmod(F.col("_j"), F.col("_blocks")), F.col("_blocks"), F.col("_src"), use, F.lit(seed))
    return each.select("_src", block.alias("_block"), "shard", "slot")


def pieces(placed: DataFrame) -> DataFrame:
    """One row for each block that a document has words in, with the count of these words."""
    first, last = F.floor(F.col("_off") / BLOCK), F.floor((F.col("_off") + F.col("size") - 1) / BLOCK)
    p = placed.where("size > 0").withColumn("_block", F.explode(F.sequence(first, last)))
    return p.withColumn("_words", F.least(F.col("_off") + F.col("size"), (F.col("_block") + 1) * BLOCK) - F.greatest(F.col("_off"), F.col("_block") * BLOCK))


def _uses(sources: DataFrame, seed: int) -> DataFrame:
    """_src, _block, _uses, _shards (three at most) of all blocks that are drawn."""
    return draws(sources, seed).groupBy("_src", "_block").agg(F.count("*").alias("_uses"), F.collect_set("shard").alias("_shards"))


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, n_shards (output shards with words of it) for every row of ``docs``."""
    placed, sources = packed(docs, seed)
    keys = ["doc_id", "_src", "_off", "size", "source_size", "target", "source"]
    # the planner takes the draws for as small as the sources that they are exploded from
    got = pieces(placed).join(_uses(sources, seed).hint("shuffle_hash"), ["_src", "_block"], "left")
    met = F.size(F.array_distinct(F.flatten(F.collect_set("_shards")))).cast("long")
    got = got.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_words") * F.col("_uses")), F.lit(0).cast("long")).alias("taken"), met.alias("n_shards"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("n_shards"))
    return got.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source", "n_shards")


def assembled(docs: DataFrame, seed: int = 11) -> DataFrame:
    """shard, slot, source, text: the mix, a block of ``BLOCK`` words (a source's last may be shorter) for each slot.

    Words are parted by single spaces. A document's words go on from its block to the next.
    """
    held = stage(docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_rid")), "mix-rows")
    placed, sources = packed(held, seed, ("_rid",))
    words = held.select("_rid", words_of(F.col("text")).alias("_ws"))
    p = pieces(placed.join(words, "_rid"))
    at = F.greatest(F.col("_block") * BLOCK - F.col("_off"), F.lit(0))
    p = p.select("_src", "_block", "source", "_off", F.array_join(F.slice("_ws", (at + 1).cast("int"), F.col("_words").cast("int")), " ").alias("_part"))
    blocks = p.groupBy("_src", "_block").agg(F.first("source").alias("source"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_off", "_part"))), lambda x: x["_part"]), " ").alias("text"))
    return blocks.join(draws(sources, seed).hint("shuffle_hash"), ["_src", "_block"]).select("shard", "slot", "source", "text")


def repeated(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` with each row as often as the block that holds its first word is drawn; rows without words go.

    So a document comes target / size times on average, and three times at most. The rows are
    staged with a number, by which they find their draws again. Columns stay as they are.
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.monotonically_increasing_id().alias("_rid"))
    held = stage(held, "mix-rows")
    placed, sources = packed(held.select("_row.doc_id", "_row.source", "_row.text", "_rid"), seed, ("_rid",))
    first = placed.where("size > 0").select("_rid", "_src", F.floor(F.col("_off") / BLOCK).alias("_block"))
    n = first.join(_uses(sources, seed).hint("shuffle_hash"), ["_src", "_block"]).select("_rid", "_uses")
    return held.join(n, "_rid").withColumn("_use", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_uses")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
