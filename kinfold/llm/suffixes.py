"""Suffix-array deduplication of repeated 200-byte strings by a distributed merge of suffixes.

Not all suffixes are sorted, only those at anchors: places whose 100-byte gram has the least
hash of all grams of some 200-byte window. Anchors depend on content alone and every window
holds one, so equal windows meet at equal anchors, and about one place in fifty is one.

1. Anchors: each task hashes its texts; anchors whose gram comes again in the same chunk are
   known to repeat, and one of them goes on for the others; a shuffle by gram hash finds the
   rest. Hashes only choose candidates.
2. Runs: each task sorts the suffixes (to 200 bytes) at its candidate anchors, with up to 100
   bytes before them, merges equal ones into one, and sends each partition one front-coded
   run: length of the prefix shared with the predecessor, and rest. What several places of a
   task share is repeated whatever the others have, so these places go straight to their
   texts, spread over all tasks, and only their common suffix goes on, once a task.
3. Merge: a loser tree over the runs keeps, for each run's head, the prefix it shares with
   the last suffix given out. Unequal prefixes decide without a look at the bytes; equal ones
   are compared from there on. The merge gives suffixes and their common prefixes.
4. Windows: for each offset of a window around the anchor, suffixes whose right parts agree
   are neighbours, as are those whose left parts agree in the order of reversed left parts;
   equal pairs of these class numbers are equal windows. This is exact, byte for byte.
5. The repeated ranges go back to their texts, where they are united and cut out.

Rows are known by a hash of id and text, so equal or null ids do not meet; places of wholly
equal rows are gathered once. All suffixes with one gram and different bytes around it meet in
one task: as many as the texts that have those 100 bytes each in another context.

Defined results: a null text is empty; texts under 200 bytes never match; wholly equal rows
repeat each other; null ids are handled as an id; an empty table gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_parts, stage, table
from .grams import Prefix, chunks, mix

WINDOW = 200
GRAM = 100
SIDE = WINDOW - GRAM  # bytes on either side of a gram that a window can reach
RUN_RECORDS = 100_000
RECORDS_PER_PART = 25_000
_TOP = np.uint64((1 << 64) - 1)


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for all whole windows."""
    wide, y = 1, x
    while wide * 2 <= n:
        y = pick(y[: len(y) - wide], y[wide:])
        wide *= 2
    return pick(y[: len(x) - n + 1], y[n - wide : n - wide + len(x) - n + 1]) if n > wide else y


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, gram hashes) of all anchors of the texts in one buffer."""
    if len(data) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = mix(Prefix(data).every(GRAM), 21)
    low = _slide(h, SIDE + 1, np.minimum)  # the least of each window's grams
    text_end = np.repeat(off[1:], np.diff(off))
    place = np.arange(len(low))
    low[place + WINDOW > text_end[: len(low)]] = 0  # windows must not cross texts
    pad = np.zeros(SIDE, np.uint64)
    most = _slide(np.concatenate([pad, low, pad]), SIDE + 1, np.maximum)
    at = np.flatnonzero(most == h)
    return at, h[at]


def _slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, rk, pos): x deals rows to tasks; pos < 0 (as -pos - 1) is known to repeat."""
    for batch in batches:
        ids = batch.column("rk")
        for a, b, data, off in chunks(batch.column("text")):
            at, h = anchors(data, off)
            order = np.argsort(h, kind="stable")
            s = h[order]
            start = np.ones(len(s), bool)
            start[1:] = s[1:] != s[:-1]
            again = ~start
            many = again.copy()
            many[:-1] |= again[1:]
            known = np.zeros(len(s), bool)
            known[order] = many
            spread = np.zeros(len(s), bool)
            spread[order] = again  # all but one of a gram's anchors need not meet others
            x = np.where(spread, mix(h + at.astype(np.uint64), 3), h)
            text_of = np.searchsorted(off, at, side="right") - 1
            pos = at - off[text_of]
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), ids.slice(a, b - a).take(pa.array(text_of)), pa.array(np.where(known, -pos - 1, pos).astype(np.int32))], ["x", "rk", "pos"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by x: those known, or of an x with several rows. The last row waits for the next batch."""
    held: pa.Table | None = None
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]) if held is not None else t
        x, pos = t.column("x").to_numpy(), t.column("pos").to_numpy()
        same = np.zeros(len(x), bool)
        same[1:] = x[1:] == x[:-1]
        same[0] = before is not None and x[0] == before
        keep = (pos < 0) | same
        keep[:-1] |= same[1:]
        out = np.flatnonzero(keep[:-1])
        yield from _places(t, out)
        held, before = t.slice(len(x) - 1), (x[-2] if len(x) > 1 else before)
        if same[-1]:
            before = x[-1]
    if held is not None and (held.column("pos")[0].as_py() < 0 or (before is not None and before == held.column("x")[0].as_py())):
        yield from _places(held, np.array([0]))


def _places(t: pa.Table, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    pos = t.column("pos").to_numpy()[rows]
    out = pa.table({"rk": t.column("rk").take(pa.array(rows)), "pos": pa.array(np.where(pos < 0, -pos - 1, pos).astype(np.int32))})
    yield from out.to_batches()


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, given that ``at`` bytes are common."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    step = 8
    while a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    while step > 1:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return at


def encode_run(suffixes: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Front coding of sorted strings of up to 255 bytes: shared lengths, rest lengths, rests."""
    shared, rest, tails, last = bytearray(), bytearray(), [], b""
    for s in suffixes:
        n = _common(last, s, 0)
        shared.append(n)
        rest.append(len(s) - n)
        tails.append(s[n:])
        last = s
    return bytes(shared), bytes(rest), b"".join(tails)


def decode_run(shared: bytes, rest: bytes, tails: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for n, m in zip(shared, rest, strict=True):
        last = last[:n] + tails[at : at + m]
        at += m
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], bytes]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, prefix shared with the predecessor) in sorted order; runs are (strings, shared lengths).

    A loser tree. Heads in it know their common prefix with the last string given out: the
    head with the longer one is the lesser, and only equal lengths need a comparison, which
    starts behind them and leaves the loser its prefix shared with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    strings = [r[0] for r in runs] + [[]] * (k - len(runs))
    shared = [r[1] for r in runs] + [b""] * (k - len(runs))
    index = [0] * k
    head = [s[0] if s else None for s in strings]
    lcp = [0] * k
    losers = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = lcp[a], lcp[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = _common(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            lcp[b] = n
            return a, b
        lcp[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        w, losers[node] = play(build(2 * node), build(2 * node + 1))
        return w

    win = build(1)
    while head[win] is not None:
        yield win, index[win], lcp[win]
        index[win] += 1
        i = index[win]
        if i < len(strings[win]):
            head[win] = strings[win][i]
            lcp[win] = shared[win][i]
        else:
            head[win] = None
        node = (win + k) // 2
        while node:
            win, losers[node] = play(win, losers[node])
            node //= 2


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as zstd frames, which halves what the shuffle of all texts writes."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for at in range(0, batch.num_rows, 256):
            rows = range(at, min(at + 256, batch.num_rows))
            part = batch.slice(at, len(rows))
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in ("rk", "doc_id", "th")], pa.array([pack(texts[r].as_py() or b"") for r in rows], pa.binary())], ["rk", "doc_id", "th", "text"])


def _runs(n_parts: int) -> Callable:
    """Texts with their places to rows (part, run); a part below 0 holds ranges that need no merge."""

    def flush(found: dict) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        by_part: dict[int, list] = {}
        for (suffix, left), places in found.items():
            by_part.setdefault(int.from_bytes(hashlib.blake2b(suffix[:GRAM], digest_size=8).digest(), "little") % n_parts, []).append((suffix, left, places))
        parts, loads = [], []
        known: list[tuple] = []  # (id, text hash, from, to)
        for part, items in by_part.items():
            items.sort(key=lambda x: x[:2])
            lefts = [x[1] for x in items]
            for suffix, left, places in items:
                if len(places) > 1 and len(suffix) + len(left) >= WINDOW:
                    known += [(i, h, p - len(left), p + len(suffix)) for i, h, p in places]
            own = [x[2][0] if len(x[2]) == 1 else None for x in items]
            loads.append(pack(pickle.dumps((encode_run([x[0] for x in items]), bytes(map(len, lefts)), b"".join(lefts), np.array([x is None for x in own]), [x and x[0] for x in own], np.array([x[1:] if x else (0, 0) for x in own], np.int64)), protocol=5)))
            parts.append(part)
        for at in range(0, len(known), RUN_RECORDS):
            some = known[at : at + RUN_RECORDS]
            loads.append(pack(pickle.dumps(([x[0] for x in some], np.array([x[1:] for x in some], np.int64)), protocol=5)))
            parts.append(-1 - abs(hash(some[0][1:])) % n_parts)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(loads, pa.binary())], ["part", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        held = 0
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids, hashes = batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()
            texts, places = batch.column("text"), batch.column("places")
            for r in range(batch.num_rows):
                data = unpack(texts[r].as_py())
                for p in places[r].as_py():
                    if p + GRAM <= len(data):
                        found.setdefault((data[p : p + WINDOW], data[max(0, p - SIDE) : p]), []).append((ids[r], hashes[r], p))
                        held += 1
                if len(found) > RUN_RECORDS or held > 2 * RUN_RECORDS:
                    yield from flush(found)
                    found, held = {}, 0
        yield from flush(found)

    return run


def _classes(step: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Class numbers along an order, with a new class at each break or where ``step`` holds."""
    return np.cumsum(step | breaks)


def repeated_windows(suffixes: list[bytes], lefts: list[bytes], shared: np.ndarray, many: np.ndarray) -> np.ndarray:
    """[record, offset] is True if the window that starts ``offset`` bytes before the anchor comes elsewhere.

    Records are in suffix order; ``shared`` is the prefix each shares with its predecessor,
    ``many`` says that a record stands for several places.
    """
    n = len(suffixes)
    offsets = np.arange(SIDE + 1)
    right_len = np.array([len(s) for s in suffixes]) - GRAM
    left_len = np.array([len(x) for x in lefts])
    fits = (offsets[None, :] <= left_len[:, None]) & (SIDE - offsets[None, :] <= right_len[:, None])
    out = fits & many[:, None]
    new_gram = shared < GRAM
    new_gram[0] = True
    gram = np.cumsum(new_gram)
    several = np.bincount(gram)[gram] > 1
    rows = np.flatnonzero(several)
    if not len(rows):
        return out
    gram, breaks, right = gram[rows], new_gram[rows], shared[rows] - GRAM
    back = [lefts[i][::-1] for i in rows]
    order = np.array(sorted(range(len(rows)), key=lambda i: (gram[i], back[i])))
    wide = np.zeros((len(rows), SIDE), np.uint8)
    for k, i in enumerate(order):
        wide[k, : len(back[i])] = np.frombuffer(back[i], np.uint8)
    own = np.array([len(back[i]) for i in order])
    left = np.zeros(len(rows), np.int64)
    diff = wide[1:] != wide[:-1]
    left[1:] = np.minimum(np.where(diff.any(1), diff.argmax(1), SIDE), np.minimum(own[1:], own[:-1]))
    left_breaks = np.ones(len(rows), bool)
    left_breaks[1:] = gram[order][1:] != gram[order][:-1]
    lclass = np.zeros(len(rows), np.int64)
    for o in range(SIDE + 1):
        rclass = np.cumsum(breaks | (right < SIDE - o))
        lclass[order] = np.cumsum(left_breaks | (left < o))
        key = rclass * np.int64(len(rows) + 1) + lclass
        key[~fits[rows, o]] = -1
        by = np.argsort(key, kind="stable")
        s = key[by]
        dup = np.zeros(len(s), bool)
        dup[1:] = s[1:] == s[:-1]
        dup[:-1] |= dup[1:]
        dup &= s >= 0
        out[rows[by[dup]], o] = True
    return out


_RANGES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])


def _merged(t: pa.Table) -> pa.Table:
    unpack = zstandard.ZstdDecompressor().decompress
    loads = (pickle.loads(unpack(x.as_py())) for x in t.column("run"))
    if t.column("part")[0].as_py() < 0:
        return pa.concat_tables([_RANGES.empty_table(), *[pa.table([pa.array(ids, pa.int64()), *[pa.array(c) for c in rest.T]], ["doc_id", "th", "a", "b"]).cast(_RANGES) for ids, rest in loads]])
    runs, lefts, places = [], [], []
    for (shared, rest, tails), left_lens, left_bytes, many, ids, where in loads:
        ends = np.cumsum(np.frombuffer(left_lens, np.uint8).astype(np.int64)).tolist()
        lefts.append([left_bytes[a:b] for a, b in zip([0, *ends], ends, strict=False)])
        places.append((many, ids, where))
        runs.append((decode_run(shared, rest, tails), shared))
    order = list(merge_runs(runs))
    suffixes = [runs[r][0][i] for r, i, _ in order]
    left = [lefts[r][i] for r, i, _ in order]
    many = np.array([places[r][0][i] for r, i, _ in order], bool)
    flags = repeated_windows(suffixes, left, np.array([n for _, _, n in order], np.int64), many) if order else np.zeros((0, SIDE + 1), bool)
    flags[many] = False  # their places have their ranges
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rec, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    found = [(places[r][1][i], *places[r][2][i].tolist()) for r, i, _ in (order[k] for k in rec.tolist())]
    at = np.array([p for _, _, p in found], np.int64)
    return pa.table([pa.array([i for i, _, _ in found], pa.int64()), pa.array([h for _, h, _ in found], pa.int64()), pa.array(at - last), pa.array(at - first + WINDOW)], ["doc_id", "th", "a", "b"]).cast(_RANGES)


def united(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of the union of ranges [a, b)."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    last = np.ones(len(a), bool)
    last[:-1] = new[1:]
    return a[new], b[last]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        n_bytes, removed, spans, kept, digest = [], [], [], [], []
        texts, ranges = batch.column("text"), batch.column("ranges")
        names = list(zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(), strict=True))
        for r in range(batch.num_rows):
            data = unpack(texts[r].as_py())
            n_bytes.append(len(data))
            found = ranges[r].as_py() or []
            found = np.array([(x["a"], x["b"]) for x in found if (x["doc_id"], x["th"]) == names[r]], np.int64).reshape(-1, 2)
            if len(found):
                a, b = united(found[:, 0], found[:, 1])
                rest = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
            else:
                a, rest = found, data
            removed.append(len(data) - len(rest))
            spans.append(len(a))
            digest.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) for every row."""
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    text = F.col("text").cast("string")
    rk = F.xxhash64("doc_id", F.xxhash64("text"))  # the key of a row; exact names of rows travel with ranges
    slim = docs.where(F.octet_length("text") >= WINDOW).select(rk.alias("rk"), text.alias("text"))
    found = slim.mapInArrow(_slim, "x long, rk long, pos int").repartition(n, "x").sortWithinPartitions("x").mapInArrow(_repeated, "rk long, pos int")
    places = stage(found.groupBy("rk").agg(F.collect_set("pos").alias("places")), "suffix-places")
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    n_parts = max(n, total // RECORDS_PER_PART)
    # one shuffle of the texts serves both joins
    dealt = docs.select(rk.alias("rk"), "doc_id", F.xxhash64("text").alias("th"), text.alias("text")).mapInArrow(_packed, "rk long, doc_id long, th long, text binary").repartition(n, "rk")
    with_places = dealt.join(places.withColumnRenamed("rk", "_p"), F.col("rk") == F.col("_p")).select("doc_id", "th", "text", "places")
    runs = with_places.mapInArrow(_runs(n_parts), "part int, run binary")
    ranges = runs.repartition(n_parts, "part").groupBy("part").applyInArrow(_merged, "doc_id long, th long, a int, b int")
    ranges = ranges.groupBy(F.xxhash64("doc_id", "th").alias("_r")).agg(F.collect_set(F.struct("doc_id", "th", "a", "b")).alias("ranges"))
    rows = dealt.join(ranges, F.col("rk") == F.col("_r"), "left").select("doc_id", "th", "text", "ranges")
    return rows.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("kept")
