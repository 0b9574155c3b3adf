"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov models over characters are trained from labelled strings, one of
random strings and one of ordinary words. A long run of token characters is a secret if the
first model explains it better by ``MIN_RATIO`` nats in all and ``MIN_PER_CHAR`` a step. The
ratio of both models is one array literal, so scoring stays in SQL expressions. Runs are
sought between the matches of the assignment pattern, and those that hold a key id or hex
string of the base are left to it, so no span is found twice. Runs of digits and signs alone
are numbers, not secrets.

Work grows with a text's length: a run is split into its characters once, and positions are
running sums taken by chunks of chunks.

Training uses a bounded sample (``SAMPLE_DOCS`` documents of the lowest seeded hash, and
``SAMPLE_RANDOM`` generated strings); scanning covers every whole text.

Defined results: a null text is empty and has no spans, whose digest is that of the empty
string; positions count code points; repeated rows are scanned each; extra columns are
ignored; without any ordinary sample the models fall back to add-half smoothing alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table, words_of

SAMPLE_DOCS = 1000
SAMPLE_RANDOM = 3000
MIN_RATIO = 12.0
MIN_PER_CHAR = 0.5

#: The patterns of the contract; group 1 of the first is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")

CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
WIDE = len(CHARS) + 1


def _steps(s: Column) -> Column:
    """Codes of all character pairs of a string; empty if it has fewer than two characters."""
    codes = F.transform(F.split(s, ""), lambda c: F.call_function("instr", F.lit(CHARS), c))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: x * WIDE + y)
    return F.when(F.char_length(s) > 1, bind(codes, pairs)).otherwise(F.array().cast("array<int>"))


def labelled(docs: DataFrame) -> DataFrame:
    """(s, label): generated random strings (1) and words of eight and more characters of sampled documents (0)."""
    spark = docs.sparkSession
    ids = spark.range(SAMPLE_RANDOM).select(F.sha2(F.concat(F.lit("random"), F.col("id").cast("string")), 256).alias("h"), "id")
    code = F.base64(F.unhex("h"))
    text = F.when(F.col("id") % 3 == 0, F.substring("h", 1, 40)).when(F.col("id") % 3 == 1, code).otherwise(F.regexp_replace(code, "[+/=]", ""))
    # about twice the sample passes the bound on the hash, so few rows are sorted for the limit, at any size
    share = min(1.0, 2 * SAMPLE_DOCS / max(1, docs.count()))
    low = F.xxhash64("doc_id", F.lit(3)) <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1025)))
    sample = docs.select("doc_id", "text").where(low).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(SAMPLE_DOCS)
    plain = sample.select(F.explode(words_of(F.col("text"))).alias("s")).where(F.char_length("s") >= 8)
    plain = plain.where(~F.col("s").rlike(HEX) & ~F.col("s").rlike("[0-9]{6}"))
    return ids.select(text.alias("s"), F.lit(1).alias("label")).unionByName(plain.select("s", F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """log P(next | char, random) - log P(next | char, ordinary), by code of the pair.

    At most 2 * 68 * 68 rows of counts come to the driver.
    """
    rows = samples.select("label", F.explode(_steps(F.col("s"))).alias("pair")).groupBy("label", "pair").count().collect()
    counts = {(r["label"], r["pair"]): r["count"] for r in rows}

    def logs(label: int) -> list[float]:
        out = []
        for a in range(WIDE):
            row = [counts.get((label, a * WIDE + b), 0) + 0.5 for b in range(WIDE)]
            total = math.log(sum(row))
            out += [math.log(x) - total for x in row]
        return out

    return [x - y for x, y in zip(logs(1), logs(0), strict=True)]


def ratio(s: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string: random over ordinary."""
    table_ = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    return F.aggregate(_steps(s), F.lit(0.0), lambda a, k: a + F.get(table_, k))


def _running(lens: Column) -> Column:
    """For each entry the sum of those before it. By chunks of about the root of the count, so that no long array is built step by step."""

    def before(x, start):
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
        return F.aggregate(x, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda a: a["out"])

    def cut(x):
        wide = F.ceil(F.sqrt(F.size(x))).cast("int")
        return bind(wide, lambda c: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / c).cast("int")), lambda k: F.slice(x, k * c + 1, c)))

    def joined(chunks):
        sums = F.transform(chunks, lambda x: F.aggregate(x, F.lit(0), lambda a, n: a + n))
        return F.flatten(F.zip_with(chunks, before(sums, F.lit(0)), before))

    return bind(lens, lambda x: F.when(F.size(x) > 0, bind(cut(x), joined)).otherwise(F.array().cast("array<int>")))


_SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """Structs (s, k, e) of the leftmost matches of ``pattern``, in order."""

    def placed(m):
        lens = F.transform(m["hits"], lambda h, i: F.char_length(F.get(m["gaps"], i)) + F.char_length(h))
        span = lambda at, i: bind(at + F.char_length(F.get(m["gaps"], i)), lambda a: F.struct(a.alias("s"), F.lit(kind).alias("k"), (a + F.char_length(F.get(m["hits"], i))).alias("e")))
        return F.transform(_running(lens), span)

    found = bind(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _unlikely(text: Column, model: list[float], min_ratio: float, min_per_char: float) -> Column:
    """Spans of runs that look random and hold no other base match."""

    def judged(hit):
        return bind(ratio(hit, model), lambda r: (r >= min_ratio) & (r >= min_per_char * (F.char_length(hit) - 1)))

    def chosen(gap):
        ok = lambda hit: hit.rlike("[A-Za-z]") & ~hit.rlike(f"{ACCESS}|{HEX}") & judged(hit)
        keep = F.transform(F.regexp_extract_all(gap, F.lit(RUN), F.lit(0)), ok)
        return F.when(gap.rlike(RUN), bind(keep, lambda k: F.filter(_spans(gap, RUN, 4), lambda x, i: F.get(k, i)))).otherwise(F.array().cast(_SPAN))

    def shifted(m):
        at = lambda i: F.when(i > 0, F.get(m["assigned"], i - 1)["e"]).otherwise(F.lit(0))
        move = lambda x, n: F.struct((x["s"] + n).alias("s"), x["k"].alias("k"), (x["e"] + n).alias("e"))
        return F.flatten(F.transform(m["gaps"], lambda g, i: bind(at(i), lambda n: F.transform(chosen(g), lambda x: move(x, n)))))

    parts = bind(F.struct(F.split(text, ASSIGN, -1).alias("gaps"), _spans(text, ASSIGN, 1).alias("assigned")), shifted)
    return F.when(text.rlike(RUN), parts).otherwise(F.array().cast(_SPAN))


def scanned(docs: DataFrame, model: list[float], min_ratio: float = MIN_RATIO, min_per_char: float = MIN_PER_CHAR) -> DataFrame:
    """doc_id, text and ``base`` / ``extra``: arrays of structs (s, k, e), code points, end exclusive, by start and kind."""
    text = F.col("_text")
    # a span's index is its match's index
    values = lambda t: F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(1))
    long = bind(values(text), lambda v: F.filter(_spans(text, ASSIGN, 1), lambda x, i: F.char_length(F.get(v, i)) >= 8))
    assign = F.when(text.rlike(ASSIGN), long).otherwise(F.array().cast(_SPAN))
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    base = F.array_sort(F.concat(assign, _spans(text, ACCESS, 2), _spans(text, HEX, 3)))
    return d.select("doc_id", text.alias("text"), base.alias("base"), _unlikely(text, model, min_ratio, min_per_char).alias("extra"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, model: list[float]) -> DataFrame:
    s = scanned(docs, model)
    of = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return s.select("doc_id", of(1).alias("n_assign"), of(2).alias("n_access"), of(3).alias("n_hex"), F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "extra"))).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(docs, train(labelled(docs)))
