"""Benchmark decontamination: a BM25 index of test items, searched by every training passage.

Items are the indexed documents, cut into segments of ``SEGMENT`` words, the last of which
reaches back into the one before; every training text is cut into passages of twice the
longest segment, in steps of that segment, so each stretch as long as a segment lies wholly in
a passage. A passage is the query. A segment is retrieved if its score is ``THRESHOLD`` of the
most that any passage can score with it; impacts are divided by that, so one threshold, 1,
holds for all.

Search is block-max WAND. Postings lie in blocks of segments; each term has a bound for its
whole list and one for each block that it is in. For whole batches at once: passages whose
list bounds stay below 1 go. Of the others' terms, those of the longest lists whose bounds
stay below ``IDLE`` in all cannot make a pivot alone, so only the blocks of the other terms
are visited; their block bounds with the idle terms' list bounds, and then all terms' block
bounds, rule out blocks. A document-at-a-time WAND with pivots runs over the postings of the
blocks that are left. All are upper bounds, so nothing above the threshold is lost.

Retrieved items are verified against the text: of the question's and of the answer's
five-word shingles (an item's last sentence is its answer, if it has several), at least
``OVERLAP`` each must be in it.

The index goes to the tasks by broadcast. Its size is checked: it takes some 60 bytes a word,
and items beyond ``ITEM_WORDS`` words make further indexes, built and broadcast one after the
other, with a staged result for each. Words weigh by their counts in all items in any case.

Defined results: null and empty texts and items match nothing; an item of fewer than five
words must come as a whole; repeated rows are reported each, and so are items of equal ids;
with no items all is clean. Words are lower-cased (A-Z) and stripped of ASCII punctuation.
Extra columns are ignored by ``matches()`` and kept by ``clean()``.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stage, table

THRESHOLD = 0.7
OVERLAP = 0.8
SHINGLE = 5
SEGMENT = 64
BLOCK = 8
IDLE = 0.5
ITEM_WORDS = 2_000_000
K1, B = 1.2, 0.75
_STRIP = bytes(range(33, 39)) + bytes(range(39, 48)) + b":;<=>?@[\\]^_`{|}~"
_CHUNK = 400_000
_VISITS = 2_000_000  # block bounds looked at together
_CACHED = 10_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(None, _STRIP).split()


def parts_of(text: str) -> tuple[str, str]:
    """(question, answer): the answer is what follows the last end of a sentence inside the text."""
    cut = [m.end() for m in re.finditer(r"[.!?]+\s+", text.strip())]
    return (text.strip()[: cut[-1]], text.strip()[cut[-1] :]) if cut else (text.strip(), "")


def shingles_of(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def segments_of(words: list[bytes]) -> list[list[bytes]]:
    """All segments of an item; the last one is as long as the others, if the item is."""
    return [words[at : at + SEGMENT] if at + SEGMENT <= len(words) else words[-SEGMENT:] for at in range(0, len(words), SEGMENT)]


class Index:
    """Postings of segments by term, in blocks with their largest impacts; all in flat arrays."""

    def __init__(self, items: list[tuple[int, str]], stats: tuple[int, float, dict[bytes, int]] | None = None):
        """``stats``: segments, their mean length and the segments that hold a word, if these items are not all."""
        self.items, texts = [], []  # items: (id, text); texts: (item, words)
        for item_id, text in items:
            if words := words_of((text or "").encode()):
                texts += [(len(self.items), x) for x in segments_of(words)]
                self.items.append((item_id, text))
        texts.sort(key=lambda x: len(x[1]))  # alike lengths share a block
        self.owner = np.array([x[0] for x in texts], np.int64)
        texts = [x[1] for x in texts]
        self.longest = max(map(len, texts), default=1)
        n, mean, df = stats or (len(texts), sum(map(len, texts)) / max(1, len(texts)), Counter(chain.from_iterable(map(set, texts))))
        self.term = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
        self.n_blocks = max(1, -(-len(texts) // BLOCK))
        rows = []
        for d, t in enumerate(texts):
            own = Counter(t)
            k, f = np.array(list(own.values()), float), np.array([df[w] for w in own], float)
            impact = np.log(1 + (n - f + 0.5) / (f + 0.5)) * k * (K1 + 1) / (k + K1 * (1 - B + B * len(t) / mean))
            rows.append((np.array([self.term[w] for w in own], np.int64), np.full(len(own), d, np.int32), impact / (THRESHOLD * impact.sum())))
        term, self.segment, self.impact = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))
        order = np.argsort(term, kind="stable")  # segments stay in order
        term, self.segment, self.impact = term[order], self.segment[order], self.impact[order]
        count = len(self.term)
        self.first = np.searchsorted(term, np.arange(count + 1))
        key = term * self.n_blocks + self.segment // BLOCK
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        up = np.float32(1.0001)  # so that bounds stay bounds in single precision
        self.block = key[new]  # term * n_blocks + block, ascending
        self.best = np.maximum.reduceat(self.impact, new).astype(np.float32) * up if len(new) else np.zeros(0, np.float32)
        # by term, with a last one for unknown words
        self.blocks_from = np.searchsorted(self.block, np.arange(count + 2) * self.n_blocks)
        self.blocks_from[count + 1 :] = len(self.block)
        self.most = np.zeros(count + 1, np.float32)
        if count:
            self.most[:count] = np.maximum.reduceat(self.best, self.blocks_from[:count])
        self._shingles: dict[int, tuple[set[bytes], set[bytes]]] = {}

    def size(self) -> int:
        """Bytes of the arrays and, about, of the words."""
        arrays = (self.owner, self.segment, self.impact, self.first, self.block, self.best, self.blocks_from, self.most)
        return sum(x.nbytes for x in arrays) + sum(len(w) + 100 for w in self.term) + sum(len(t) + 100 for _, t in self.items)

    def parts(self, item: int) -> tuple[set[bytes], set[bytes]]:
        """The shingles of an item's question and answer."""
        if item not in self._shingles:
            if len(self._shingles) >= _CACHED:
                self._shingles.clear()
            self._shingles[item] = tuple(shingles_of(words_of(x.encode())) for x in parts_of(self.items[item][1]))
        return self._shingles[item]

    def wand(self, terms: list[int], block: int) -> list[tuple[int, float]]:
        """Segments of a block whose score is 1 or more: a document at a time, with pivots."""
        lo, hi = block * BLOCK, (block + 1) * BLOCK
        lists, cursors = [], []  # (segments, impacts) of each term; [segment, place, bound, list]
        for t in terms:
            own = self.segment[self.first[t] : self.first[t + 1]]
            a, b = np.searchsorted(own, [lo, hi]).tolist()
            if a < b:
                impacts = self.impact[self.first[t] + a : self.first[t] + b].tolist()
                lists.append((own[a:b].tolist(), impacts))
                cursors.append([lists[-1][0][0], 0, max(impacts), len(lists) - 1])
        out = []
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, None
            for c in cursors:
                bound += c[2]
                if bound >= 1.0 - 1e-9:
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = 0.0
                for c in cursors:
                    if c[0] != pivot:
                        break
                    score += lists[c[3]][1][c[1]]
                if score >= 1.0 - 1e-9:
                    out.append((pivot, score))
                target = pivot + 1
            else:
                target = pivot
            for c in cursors:
                if c[0] < target:
                    docs = lists[c[3]][0]
                    c[1] = bisect_left(docs, target, c[1])
                    c[0] = docs[c[1]] if c[1] < len(docs) else hi
            cursors = [c for c in cursors if c[0] < hi]
        return out

    def _visited(self, row: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(row, block, terms of the row in it) whose block bounds reach 1, of rows of distinct terms in order of rows."""
        n_lists = self.blocks_from[term + 1] - self.blocks_from[term]
        order = np.lexsort((-n_lists, row))  # each row's longest lists first
        row, term, n_lists = row[order], term[order], n_lists[order]
        new = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        size = np.diff(np.r_[new, len(row)])
        sums = np.cumsum(self.most[term], dtype=np.float64)
        idle = sums - np.repeat(np.r_[0.0, sums][new], size) < IDLE
        idle_sum = np.add.reduceat(np.where(idle, self.most[term], 0.0), new)
        visits = np.add.reduceat(np.where(idle, 0, n_lists), new)
        group = np.cumsum(visits) // _VISITS
        for g in np.unique(group):
            rows = np.flatnonzero(group == g)
            lo, hi = new[rows[0]], new[rows[-1]] + size[rows[-1]]
            busy = lo + np.flatnonzero(~idle[lo:hi])
            n = n_lists[busy]
            at = np.repeat(self.blocks_from[term[busy]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            place = np.repeat(np.searchsorted(new, busy, side="right") - 1, n)
            key, inverse = np.unique(place * self.n_blocks + self.block[at] % self.n_blocks, return_inverse=True)
            bound = np.bincount(inverse, weights=self.best[at], minlength=len(key))
            key = key[bound + idle_sum[key // self.n_blocks] >= 0.999]
            for k in key.tolist():
                place, block = divmod(k, self.n_blocks)
                own = term[new[place] : new[place] + size[place]]
                want = own * self.n_blocks + block
                i = np.searchsorted(self.block, want)
                found = self.block[np.minimum(i, len(self.block) - 1)] == want
                if self.best[i[found]].sum(dtype=np.float64) >= 0.999:
                    yield int(row[new[place]]), block, own[found]

    def search(self, ids: np.ndarray, at: np.ndarray) -> dict[int, dict[int, float]]:
        """For texts given as term numbers (-1: unknown) and places: {text: {item: best score of a passage}}."""
        wide, step = 2 * self.longest, self.longest
        size = np.diff(at)
        n_pass = np.maximum(1, -(-np.maximum(size - step, 0) // step))
        n_pass[size == 0] = 0
        text_of = np.repeat(np.arange(len(size)), n_pass)
        first = np.concatenate([[0], np.cumsum(n_pass)])[:-1]
        start = at[:-1][text_of] + (np.arange(len(text_of)) - first[text_of]) * step
        end = np.minimum(start + wide, at[1:][text_of])
        sums = np.concatenate([[0.0], np.cumsum(self.most[ids], dtype=np.float64)])
        found: dict[int, dict[int, float]] = defaultdict(dict)
        live = np.flatnonzero(sums[end] - sums[start] >= 0.999)
        for lo in range(0, len(live), 4096):
            p = live[lo : lo + 4096]
            lens = end[p] - start[p]
            row = np.repeat(np.arange(len(p)), lens)
            inner = np.arange(len(row)) - np.repeat(np.cumsum(lens) - lens, lens)
            term = ids[start[p][row] + inner]
            ok = term >= 0
            key = np.unique(row[ok] * np.int64(len(self.most)) + term[ok])  # each term counts once
            row, term = key // len(self.most), key % len(self.most)
            bound = np.bincount(row, weights=self.most[term], minlength=len(p))
            keep = bound[row] >= 0.999
            row, term = row[keep], term[keep]
            if not len(row):
                continue
            for r, block, own in self._visited(row, term):
                for segment, score in self.wand(own.tolist(), block):
                    text, item = int(text_of[p[r]]), int(self.owner[segment])
                    found[text][item] = max(found[text].get(item, 0.0), score * THRESHOLD)
        return found

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, int, float, float, float]]:
        """(text, item id, score, question overlap, answer overlap) of all verified items."""
        out = []
        lists: list[list[bytes]] = []
        done = total = 0
        for k, text in enumerate([*texts, None]):
            last = k == len(texts)
            if not last:
                lists.append(words_of(text))
                total += len(lists[-1])
            if last or total > _CHUNK:
                at = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
                ids = np.fromiter((i for x in lists for i in map(self.term.get, x, repeat(-1))), np.int64, total)
                for text_no, items in sorted(self.search(ids, at).items()):
                    have = shingles_of(lists[text_no])
                    own = lists[text_no]
                    for item, score in sorted(items.items()):
                        q, a = (self._share(x, have, own) for x in self.parts(item))
                        if q >= OVERLAP and a >= OVERLAP:
                            out.append((done + text_no, self.items[item][0], score, q, a))
                done, lists, total = k + 1, [], 0
        return out

    @staticmethod
    def _share(part: set[bytes], have: set[bytes], own: list[bytes]) -> float:
        if not part:
            return 1.0
        found = 0
        for s in part:
            if s in have:
                found += 1
            elif s.count(b" ") < SHINGLE - 1:  # a part of fewer than five words is one sequence
                w = s.split(b" ")
                found += any(own[i : i + len(w)] == w for i in range(len(own) - len(w) + 1))
        return found / len(part)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) to rows (word, n) of the segments that hold a word, and (null, n, size) of segments and their words."""
    for batch in batches:
        df, n, size = Counter(), 0, 0
        for text in batch.column("text").to_pylist():
            for part in segments_of(words_of((text or "").encode())):
                df.update(set(part))
                n, size = n + 1, size + len(part)
        yield pa.RecordBatch.from_arrays([pa.array([None, *df], pa.binary()), pa.array([n, *df.values()], pa.int64()), pa.array([size, *[0] * len(df)], pa.int64())], ["word", "n", "size"])


def indexes(items: DataFrame) -> Iterator[Index]:
    """Indexes of all items, each of up to ``ITEM_WORDS`` words, one after the other."""
    spark = items.sparkSession
    some = items.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null")
    estimate = lambda text: len(text) // 4 + 1
    if (some.agg(F.sum(F.floor(F.char_length("text") / 4) + 1)).first()[0] or 0) <= ITEM_WORDS:
        yield Index([(r["item_id"], r["text"]) for r in some.orderBy("item_id", "text").collect()])
        return
    held = stage(some.select("text").mapInArrow(_held, "word binary, n long, size long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("size").alias("size")), "bm25-words")
    n, total = held.where("word is null").select("n", "size").first()

    def built(rows: list[tuple[int, str]]) -> Index:
        words = set(chain.from_iterable(words_of(t.encode()) for _, t in rows))
        own = spark.createDataFrame([(bytearray(w),) for w in words], "word binary")
        return Index(rows, (n, total / max(1, n), {bytes(r["word"]): r["n"] for r in held.join(own, "word").collect()}))

    rows, size = [], 0
    for r in some.orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += estimate(r["text"])
        if size > ITEM_WORDS:
            yield built(rows)
            rows, size = [], 0
    if rows:
        yield built(rows)


def _matches(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            rows = shared.value.hits(batch.column("text").cast(pa.binary()).to_pylist())
            t, item, score, q, a = (list(x) for x in zip(*rows, strict=True)) if rows else ([], [], [], [], [])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(t, pa.int64())), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array(q, pa.float64()), pa.array(a, pa.float64())], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return run


def _clean(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = {h[0] for h in shared.value.hits(batch.column("_text").cast(pa.binary()).to_pylist())}
            yield batch.take(pa.array([i for i in range(batch.num_rows) if i not in bad], pa.int64())).select(["_row"])

    return run


_FOUND = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row for each text and item that it holds."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out, shared = None, None
    for index in indexes(items):
        if shared is not None:  # another index came before: its result is written, so it may go
            out = stage(out, "bm25-found")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        found = slim.mapInArrow(_matches(shared), _FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``."""
    spark, out, shared = docs.sparkSession, docs, None
    for index in indexes(items):
        if shared is not None:
            out = stage(out, "bm25-clean")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        packed = out.select(F.struct(*[F.col(f"`{c}`") for c in out.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
        out = packed.mapInArrow(_clean(shared), StructType([packed.schema["_row"]])).select("_row.*")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
