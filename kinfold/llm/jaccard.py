"""N-gram Jaccard join by PartEnum signatures, and components of its links.

Sets are distinct word shingles. Equal sets form a class, and only classes go on. Sizes fall
into bands whose neighbours hold all partners: a set signs for its own band and the next.
For a band, sets that link differ in at most k features. The feature domain is cut into
first-level partitions of a few second-level cells; with (k + 1) / 2 partitions, two linked
sets differ by at most one feature in one of them, so there they agree on some subset of its
cells that leaves one out. Each such subset signs. Some more partitions than needed are
made, and only sets with more partitions than that with an empty subset sign those
(otherwise a subset with features agrees too). Where k is 0 only equal sets would link.

Any part of the features differs by at most k too, so at thresholds that need small cells the
signatures leave out the most common features (``COMMON`` of them at most, counted in tasks
and broadcast); the same ones for all sets, else any choice is right.

Classes that share a signature are chained to the least one (a star, not all pairs), first
those of a batch, of which one goes on to meet the others, so no signature gathers all of a
large group's classes;
connected chains are families, which hold every linked pair. Common passages can chain many
sets that are not alike, so the members of families of more than ``BLOCK`` classes are cut
again before any comparison, by their rarest features: ordered by how many members have
them, the first n - ceil(threshold n) + 1 features of two linked sets share one, and a
feature that no other member has chains nothing.

Inside a family all sets are compared exactly, in blocks of about ``BLOCK`` by ``BLOCK`` sets:
shared features by matrix products. A block returns a spanning forest of its links, so
output grows with the members, while no link is lost. In families of several blocks all sets
are compared with the least one first; those linked to it are in one component already, so
only pairs with a set that is not are compared then. Links' components give the result.

Similarity is exact but for 64-bit hashes of shingles inside one pair of sets.

Defined results: null or empty texts have no shingles and link with nothing, so their
component is their own id; null ids never become a component's name unless all are null;
repeated rows are one class. Extra columns are ignored by ``linked()`` and kept by ``kept()``.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shuffle_parts, stage, table
from .components import components, matched
from .grams import chunks, distinct, mix, shingles

BLOCK = 1024
BROADCAST_ROWS = 500_000
LEFT_OUT = 1
COMMON = 100_000
COMMON_IN_TASK = 6


def bands(most: int, num: int, den: int) -> list[tuple[int, int]]:
    """Size bands [lo, hi] with hi = lo / threshold, up to ``most``."""
    out, lo = [], 1
    while lo <= max(1, most):
        out.append((lo, max(lo, lo * den // num)))
        lo = out[-1][1] + 1
    out.append((lo, max(lo, lo * den // num)))
    return out


def partitions(hi: int, num: int, den: int) -> tuple[int, int]:
    """(first-level partitions needed, partitions made) for sets of up to ``hi`` features; none if k is 0."""
    k = 2 * hi * (den - num) // (den + num)
    if not k:
        return 0, 0
    need = -(-(k + 1) // (LEFT_OUT + 1))
    return need, need + (1 + need // 16 if second_level(num, den) == 2 else 2 + need // 8)


def second_level(num: int, den: int) -> int:
    """Cells of a partition: two where cells are large enough at that threshold, else three."""
    return 2 if 9 * (den - num) <= den else 3


def signatures(h: np.ndarray, at: np.ndarray, num: int, den: int, left_out: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all sets in order, place of each set's first). Sizes count all features."""
    size = np.diff(at)
    b = bands(int(size.max(initial=1)), num, den)
    lows = np.array([x[0] for x in b])
    band = np.searchsorted(lows, np.maximum(size, 1), side="right") - 1
    need, made = np.array([partitions(hi, num, den) for _, hi in b]).T
    set_of = np.repeat(np.arange(len(size)), size)
    mixed, spot = mix(h, 5), mix(h, 9) >> np.uint64(32)
    cells = second_level(num, den)
    subsets = [list(s) for s in itertools.combinations(range(cells), cells - LEFT_OUT)]
    out, owner = [], []
    for shift in (0, 1):
        instance = band + shift
        n1 = np.where(size > 0, made[instance], 0)
        base = np.concatenate([[0], np.cumsum(n1 * cells)])
        place = base[set_of] + (spot * (n1 * cells)[set_of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        some = (n1 > 0)[set_of]
        if left_out is not None:
            some &= _without(h, left_out)
        total = np.zeros(base[-1], np.uint64)
        count = np.zeros(base[-1], np.int64)
        np.add.at(total, place[some], mixed[some])
        np.add.at(count, place[some], 1)
        total, count = total.reshape(-1, cells), count.reshape(-1, cells)
        row_of = np.repeat(np.arange(len(size)), n1)
        within = np.arange(len(row_of)) - np.repeat(base[:-1] // cells, n1)
        tag = mix((instance[row_of].astype(np.uint64) << np.uint64(32)) | within.astype(np.uint64), 7)
        empty = np.stack([count[:, s].sum(1) == 0 for s in subsets], 1)
        bad = np.bincount(row_of, weights=empty.any(1), minlength=len(size))
        show = bad > (made - need)[instance]
        for k, s in enumerate(subsets):
            ok = ~empty[:, k] | show[row_of]
            out.append(mix(total[:, s].sum(1, dtype=np.uint64) ^ tag, 11 + k)[ok])
            owner.append(row_of[ok])
    sig, own = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return sig[order], np.searchsorted(own[order], np.arange(len(size) + 1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _digests(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set."""
    sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(h, s), dtype=np.uint64)]) for s in (2, 3)]
    return [s[at[1:]] - s[at[:-1]] for s in sums]


def _features(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, off in chunks(batch.column("text")):
                h, at = distinct(*shingles(data, off, width))
                d1, d2 = _digests(h, at)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("th").slice(a, b - a), pa.array(np.diff(at).astype(np.int64)), _signed(d1), _signed(d2)], ["doc_id", "th", "n_shingles", "d1", "d2"])

    return run


def _frequent(width: int) -> Callable:
    """Rows (text) to (sig, n): features that at least ``COMMON_IN_TASK`` texts of some million features have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            f, n = np.unique(np.concatenate(held), return_counts=True)
            many = n >= COMMON_IN_TASK
            return pa.RecordBatch.from_arrays([_signed(f[many]), pa.array(n[many].astype(np.int64))], ["sig", "n"])

        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                h, _ = distinct(*shingles(data, off, width))
                held.append(h)
                size += len(h)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def common_features(docs: DataFrame, width: int) -> np.ndarray:
    """The most common features, sorted; ``COMMON`` at most."""
    found = _whole(docs).select("text").mapInArrow(_frequent(width), "sig long, n long").groupBy("sig").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "sig").limit(COMMON).select("sig").toArrow().column("sig").to_numpy()
    return np.sort(top.view(np.uint64))


def _without(h: np.ndarray, left_out: np.ndarray) -> np.ndarray:
    """True for features to keep."""
    if not len(left_out):
        return np.ones(len(h), bool)
    k = np.minimum(np.searchsorted(left_out, h), len(left_out) - 1)
    return left_out[k] != h


_SIGNED = "sig long, d1 long, b long"


def _combined(sig: np.ndarray, d1: np.ndarray) -> pa.RecordBatch:
    """Rows (sig, d1, b): each signature with its least class and b null, and links (d1, b) of its other classes, spread by d1."""
    order = np.lexsort((d1, sig))
    s, d = sig[order], d1[order]
    start = np.ones(len(s), bool)
    start[1:] = s[1:] != s[:-1]
    first = d[start][np.cumsum(start) - 1]
    a, b = np.unique(np.stack([d, first], 1)[d != first], axis=0).T
    keep = np.sort(order[start])  # in the order given, in which a class's rows stand together and pack well
    whole = pa.array(np.concatenate([np.zeros(len(keep), np.int64), b]), mask=np.concatenate([np.ones(len(keep), bool), np.zeros(len(b), bool)]))
    spread = mix(np.ascontiguousarray(a).view(np.uint64), 17).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([sig[keep], spread])), pa.array(np.concatenate([d1[keep], a])), whole], ["sig", "d1", "b"])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _combined(batch.column("sig").to_numpy(), batch.column("d1").to_numpy())


def _signs(width: int, num: int, den: int, shared=None) -> Callable:
    """Rows (text) to rows (sig, d1, b). A class signs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        left_out = shared.value if shared else np.zeros(0, np.uint64)
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                h, at = distinct(*shingles(data, off, width))
                size = np.diff(at)
                d1, _ = _digests(h, at)
                fresh = np.array([n > 0 and not (x in seen or seen.add(x)) for x, n in zip(d1.tolist(), size.tolist(), strict=True)], bool)
                if not fresh.any():
                    continue
                sig, place = signatures(h[np.repeat(fresh, size)], np.concatenate([[0], np.cumsum(size[fresh])]), num, den, left_out)
                if len(sig):
                    yield _combined(sig.view(np.int64), np.repeat(d1[fresh], np.diff(place)).view(np.int64))

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, d1, b), sorted: (a, b) = (class, first class of its signature), for signatures of several classes, and the links there are."""
    sig0 = first0 = None
    for batch in batches:
        link = batch.column(2).is_valid()
        if link.true_count:
            known = batch.filter(link)
            yield pa.RecordBatch.from_arrays([known.column(1), known.column(2)], ["a", "b"])
            batch = batch.filter(pa.compute.invert(link))
        if not batch.num_rows:
            continue
        sig, d1 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        start = np.ones(len(sig), bool)
        start[1:] = sig[1:] != sig[:-1]
        if sig0 is not None and sig[0] == sig0:
            start[0] = False
        run = np.cumsum(start)
        firsts = np.concatenate([[first0 if first0 is not None else 0], d1[start]])
        first = firsts[run]
        sig0, first0 = sig[-1], first[-1]
        pairs = np.unique(np.stack([d1, first], 1)[d1 != first], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _sets(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(n) for n in ("node", "family", "part", "parts")]
            for a, b, data, off in chunks(batch.column("text")):
                h, at = distinct(*shingles(data, off, width))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _signed(h))], ["node", "family", "part", "parts", "items"])

    return run


def _shared(rows: list[np.ndarray], cols: list[np.ndarray]) -> np.ndarray:
    """Counts of common features of two lists of sets, over features that occur on both sides."""
    ra, ca = np.concatenate(rows), np.concatenate(cols)
    both = np.intersect1d(ra, ca)
    out = np.zeros((len(rows), len(cols)), np.float32)
    ri = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    ci = np.repeat(np.arange(len(cols)), [len(x) for x in cols])
    rk, ck = np.searchsorted(both, ra), np.searchsorted(both, ca)
    rok, cok = rk < len(both), ck < len(both)
    rok[rok] = both[rk[rok]] == ra[rok]
    cok[cok] = both[ck[cok]] == ca[cok]
    ri, rk, ci, ck = ri[rok], rk[rok], ci[cok], ck[cok]
    ro, co = np.argsort(rk, kind="stable"), np.argsort(ck, kind="stable")
    ri, rk, ci, ck = ri[ro], rk[ro], ci[co], ck[co]
    for lo in range(0, len(both), 2048):
        hi = min(lo + 2048, len(both))
        x = np.zeros((len(rows), hi - lo), np.float32)
        y = np.zeros((len(cols), hi - lo), np.float32)
        r = slice(*np.searchsorted(rk, [lo, hi]))
        c = slice(*np.searchsorted(ck, [lo, hi]))
        x[ri[r], rk[r] - lo] = 1
        y[ci[c], ck[c] - lo] = 1
        out += x @ y.T
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    parent = list(range(n))
    out = []
    for i, j in pairs.tolist():
        a, b = i, j
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def _sets_of(t: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """(sets, their sizes)"""
    col = t.column("items").combine_chunks()
    off, values = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
    sets = [values[off[i] : off[i + 1]] for i in range(t.num_rows)]
    return sets, np.array([len(s) for s in sets], np.int64)


def _linked(sets: list[np.ndarray], size: np.ndarray, p: np.ndarray, q: np.ndarray, num: int, den: int) -> np.ndarray:
    """Rows (i, j), i of ``p`` and j of ``q``, of linked sets."""
    n = _shared([sets[i] for i in p], [sets[j] for j in q]).astype(np.int64)
    i, j = np.nonzero(n * den >= num * (size[p][:, None] + size[q][None, :] - n))
    return np.stack([p[i], q[j]], 1)


def _pairs(a: list[str], b: list[str]) -> pa.Table:
    return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})


def _verify(num: int, den: int) -> Callable:
    """Rows (node, side, items) of one block: a spanning forest of the links between sides 0 and 1, or inside side 0 if there is no other."""

    def run(t: pa.Table) -> pa.Table:
        node, side = t.column("node").to_pylist(), t.column("side").to_numpy()
        sets, size = _sets_of(t)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        inside = not len(right) and t.column("alone")[0].as_py()
        links = [np.zeros((0, 2), np.int64)]
        for x in range(0, len(left), BLOCK):
            for y in range(0, len(left if inside else right), BLOCK):
                found = _linked(sets, size, left[x : x + BLOCK], (left if inside else right)[y : y + BLOCK], num, den)
                links.append(np.array(_forest(len(node), found[found[:, 0] < found[:, 1]] if inside else found), np.int64).reshape(-1, 2))
        links = _forest(len(node), np.concatenate(links))
        return _pairs([node[i] for i, _ in links], [node[j] for _, j in links])

    return run


def _to_least(num: int, den: int) -> Callable:
    """Rows (node, least, items) of one block and the least set: (node, least, whether they link)."""

    def run(t: pa.Table) -> pa.Table:
        node, least = t.column("node").to_pylist(), t.column("least").to_numpy(zero_copy_only=False)
        sets, size = _sets_of(t)
        one, rest = np.flatnonzero(least), np.flatnonzero(~least)
        hit = set(_linked(sets, size, one, rest, num, den)[:, 1].tolist()) if len(rest) else set()
        names = [node[i] for i in rest]
        return pa.table({"a": pa.array(names, pa.string()), "b": pa.array([node[one[0]]] * len(names), pa.string()), "linked": pa.array([i in hit for i in rest.tolist()], pa.bool_())})

    return run


def _node() -> Column:
    return F.concat(F.lpad(F.hex("d1"), 16, "0"), F.lpad(F.hex("d2"), 16, "0"))


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), F.col("text").cast("string").alias("text"))


def _features_of(width: int) -> Callable:
    """Rows (text) to rows (sig, d1, n) of all features of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                h, at = distinct(*shingles(data, off, width))
                size = np.diff(at)
                d1, _ = _digests(h, at)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(np.repeat(d1, size)), pa.array(np.repeat(size, size).astype(np.int32))], ["sig", "d1", "n"])

    return run


def _chained(signed: DataFrame) -> DataFrame:
    """(d1, family) of all classes that share a signature, from rows (sig, d1, b)."""
    n = shuffle_parts(signed.sparkSession)
    pairs = signed.repartition(n, "sig").sortWithinPartitions("sig", "d1").mapInArrow(_stars, "a long, b long").distinct()
    found = components(pairs).select(F.col("node").alias("d1"), F.col("component").alias("family"))
    return stage(found, "jaccard-families")


def _rarest(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (sig, d1, n) of all features to those of each class's prefix, rarest first, that some other class has."""
    from pyspark.sql import Window

    df = rows.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    shared = rows.join(df, "sig")
    own = Window.partitionBy("d1")
    rank = F.row_number().over(own.orderBy("df", "sig"))
    # features that no other class has come first in the order, but have nobody to meet
    alone = F.col("n") - F.count("*").over(own)
    prefix = F.expr(f"n - ((n * {num}L + {den - 1}L) div {den}L) + 1")
    return shared.withColumn("_rank", rank + alone).where(F.col("_rank") <= prefix).select("sig", "d1")


def _texts_of(docs: DataFrame, members: DataFrame) -> DataFrame:
    """``members`` (mth, mid, ...) with the text of each; the list is broadcast up to ``BROADCAST_ROWS`` rows."""
    if members.count() <= BROADCAST_ROWS:
        members = F.broadcast(members)
    return _whole(docs).join(members, (F.col("th") == F.col("mth")) & F.col("doc_id").eqNullSafe(F.col("mid")))


def families(docs: DataFrame, classes: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(d1, family, size): families of two and more classes, large ones cut again."""

    def sized(family: DataFrame) -> DataFrame:
        sizes = stage(family.join(classes.select("d1"), "d1").groupBy("family").agg(F.count("*").alias("size")), "jaccard-sizes")
        return family.join(sizes, "family")

    shared = docs.sparkSession.sparkContext.broadcast(common_features(docs, width)) if second_level(num, den) > 2 else None
    first = sized(_chained(_whole(docs).select("text").mapInArrow(_signs(width, num, den, shared), _SIGNED)))
    large = stage(first.where(F.col("size") > BLOCK).select("d1"), "jaccard-large")
    small = first.where(F.col("size") <= BLOCK)
    if large.isEmpty():
        return small
    one = classes.select("d1", F.col("one.th").alias("mth"), F.col("one.doc_id").alias("mid"))
    members = stage(one.join(large, "d1"), "jaccard-large-members")
    release(docs.sparkSession)
    texts = _texts_of(docs, members).select("d1", "text").dropDuplicates(["d1"])  # wholly equal rows are one class
    rows = stage(texts.select("text").mapInArrow(_features_of(width), "sig long, d1 long, n int"), "jaccard-large-features")
    return small.unionByName(sized(_chained(_rarest(rows, num, den).mapInArrow(_combine, _SIGNED))))


def _links_of_large(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect what is linked in families of several blocks, from rows (node, family, part, parts, items)."""
    low = sets.groupBy("family").agg(F.min("node").alias("node"))
    least = sets.join(low, ["family", "node"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    others = sets.join(low.withColumnRenamed("node", "_low"), "family").where("node <> _low")
    block = ["family", "part"]
    cells = least.select(*block, "node", F.lit(True).alias("least"), "items").unionByName(others.select(*block, "node", F.lit(False).alias("least"), "items"))
    first = stage(cells.groupBy(*block).applyInArrow(_to_least(num, den), "a string, b string, linked boolean"), "jaccard-first")
    near = first.where("linked").select("a", "b")
    rest = first.where("not linked").select(F.col("a").alias("node"))
    if rest.isEmpty():
        return near
    rest = sets.join(rest, "node").select("family", "node", "parts", "items")
    sizes = rest.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rows"))
    rest = stage(rest.join(sizes, "family").withColumn("row", F.pmod(F.xxhash64("node"), F.col("rows")).cast("int")), "jaccard-rest")
    # every set that is not linked to the least one meets every set: those of its kind and the others
    left = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("family", "row", "part", "node", F.lit(0).alias("side"), F.lit(False).alias("alone"), "items")
    right = sets.join(sizes, "family").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select("family", "row", "part", "node", F.lit(1).alias("side"), F.lit(False).alias("alone"), "items")
    return near.unionByName(left.unionByName(right).groupBy("family", "row", "part").applyInArrow(_verify(num, den), "a string, b string"))


def linked(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id for every row; links at num/den or more."""
    f = stage(_whole(docs).mapInArrow(_features(width), "doc_id long, th long, n_shingles long, d1 long, d2 long"), "jaccard-features")
    classes = f.where("n_shingles > 0").groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("th", "doc_id")).alias("one"), F.min("doc_id").alias("least"))
    classes = stage(classes.withColumn("node", _node()), "jaccard-classes")
    family = families(docs, classes, width, num, den).withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = classes.join(family, "d1").select("node", "family", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("one.th").alias("mth"), F.col("one.doc_id").alias("mid"))
    members = stage(members, "jaccard-members")

    def sets(some: DataFrame) -> DataFrame:
        return _texts_of(docs, some).select("node", "family", "part", "parts", "text").mapInArrow(_sets(width), "node string, family long, part int, parts int, items array<long>")

    links = sets(members.where("parts = 1")).select("family", "node", F.lit(0).alias("side"), F.lit(True).alias("alone"), "items").groupBy("family").applyInArrow(_verify(num, den), "a string, b string")
    if not members.where("parts > 1").isEmpty():
        links = links.unionByName(_links_of_large(stage(sets(members.where("parts > 1")), "jaccard-large-sets"), num, den))
    group = components(links)
    named = classes.select("node", "d1", "d2", "n_shingles", "least").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stage(named, "jaccard-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = matched(named, "component", least, named.count()).select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n_shingles").alias("cn"), "component_id")
    some = f.where("n_shingles > 0").join(named, (F.col("d1") == F.col("c1")) & (F.col("d2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")))
    none = f.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    out = ["doc_id", "th", "n_shingles", "component_id"]
    return some.select(*out).unionByName(none.select(*out))


def kept(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The row of the least id of each component, and all rows without words; columns as in ``docs``.

    Of several rows with that id in a component, the one with the least text hash stays, and
    of wholly equal rows one.
    """
    verdict = stage(linked(docs, width, num, den), "jaccard-verdict")
    first = verdict.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("one"))
    keys = first.select(F.col("one.doc_id").alias("_id"), F.col("one.th").alias("_th"))
    copies = verdict.where("n_shingles > 0").groupBy(F.col("doc_id").alias("_id2"), F.col("th").alias("_th2")).agg((F.count("*") > 1).alias("_many"))
    keys = keys.join(copies, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_th") == F.col("_th2"))).select("_id", "_th", "_many")
    keys = stage(keys, "jaccard-keys")
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_h"), blank.alias("_blank"))
    hit = rows.where("not _blank").join(keys, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")))
    once = hit.where("_many").dropDuplicates(["_id", "_th"])
    return hit.where("not _many").select("_row.*").unionByName(once.select("_row.*")).unionByName(rows.where("_blank").select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")
