"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are words.  Windows of min_match words that an item shares with a document are the seeds; they
are found by a Karp-Rabin hash over word numbers of the benchmark's vocabulary.  Seeds on one diagonal run together
to maximal matches.  Tiles are marked longest first; what an earlier tile has covered is cut off, and the rest
stands for its place anew, until no match of min_match words is left.  The tiles never overlap on either side, so
passages in another order count.  A document is contaminated by an item if tiles cover at least ``coverage`` of the item.

The benchmark is the stated query set: it goes to the tasks in blocks of about block_chars characters, as arrays of some 30 bytes a
word, one pass over the documents a block, so there's no shuffle and no bound on its size.

Defined results: a null or empty text matches nothing, nor does an item without words; an item with fewer than
min_match words needs all of them in a row; repeated rows repeat; no rows give no rows; other columns are left out of
pairs() and kept by keep_clean().
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import keep_rows

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 8_000_000
WORD = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of k word numbers, modulo 2^64."""
    out = np.zeros(max(0, len(ids) - k + 1), np.uint64)
    for j in range(k):
        out = out * BASE + ids[j : j + len(out)]
    return out


def tile(matches: list[tuple[int, int, int]], least: int, text_words: int, item_words: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, text, item): the longest match still free, ties by place, until all are under least."""
    heap = [(-n, t, i) for n, t, i in matches if n >= least]
    heapq.heapify(heap)
    text_marked, item_marked, left = bytearray(text_words), bytearray(item_words), item_words
    out = []
    while heap and left >= least:
        n, t, i = heapq.heappop(heap)
        n = -n
        if text_marked.find(1, t, t + n) < 0 and item_marked.find(1, i, i + n) < 0:
            out.append((n, t, i))
            text_marked[t : t + n] = item_marked[i : i + n] = b"\1" * n
            left -= n
            continue
        for run in FREE.finditer(bytes(map(int.__or__, text_marked[t : t + n], item_marked[i : i + n]))):
            d = run.start()
            if run.end() - d >= least:
                heapq.heappush(heap, (d - run.end(), t + d, i + d))
    return out


FREE = re.compile(b"\0+")
PAIRS_AT_ONCE = 1 << 19


class Index:
    """A block of benchmark items in arrays: the words of all items by number, and their seeds in order of hash."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        self.vocabulary: dict[str, int] = {}
        own = [(item_id, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]) for item_id, text in items]
        own = [x for x in own if x[1]]
        self.item_ids, self.min_match = [x[0] for x in own], min_match
        self.begin = np.cumsum([0, *(len(x[1]) for x in own)])
        self.flat = np.array([w for x in own for w in x[1]], np.uint64)
        self.least = np.minimum(np.diff(self.begin), min_match)  # words of each item's seeds
        owner = np.repeat(np.arange(len(own)), np.diff(self.begin))
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in np.unique(self.least).tolist():
            at = np.arange(max(0, len(self.flat) - k + 1))
            at = at[(owner[at] == owner[at + k - 1]) & (self.least[owner[at]] == k)]
            h = window_hashes(self.flat, k)[at]
            order = np.argsort(h, kind="stable")
            self.seeds[k] = h[order], at[order]

    def maximal_matches(self, ids: np.ndarray) -> np.ndarray:
        """Rows (item, length, place in the text, place in the item) of the matches that can't be made longer.

        Pairs of equal seeds are looked at a bounded number at once; only the first and the last one of a match are kept.
        """
        out = [np.empty((0, 4), np.int64)]
        for k, (hashes, at) in self.seeds.items():
            known = ids > 0
            runs = known[: max(0, len(ids) - k + 1)].copy()
            for j in range(1, k):
                runs &= known[j : j + len(runs)]
            place = np.flatnonzero(runs)
            h = window_hashes(ids, k)[place]
            low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, side="right")
            place, low, count = place[high > low], low[high > low], (high - low)[high > low]
            if not len(place):
                continue
            firsts, lasts = [], []
            part = np.searchsorted(np.cumsum(count), np.arange(0, int(count.sum()), PAIRS_AT_ONCE))
            for a, b in zip(part.tolist(), [*part[1:].tolist(), len(place)], strict=True):
                n = count[a:b]
                t = np.repeat(place[a:b], n)
                p = at[np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                same = np.ones(len(t), bool)
                for j in range(k):
                    same &= ids[t + j] == self.flat[p + j]
                t, p = t[same], p[same]
                item = np.searchsorted(self.begin, p, side="right") - 1
                first = (t == 0) | (p == self.begin[item]) | (ids[t - 1] != self.flat[p - 1])
                after, beyond = np.minimum(t + k, len(ids) - 1), np.minimum(p + k, len(self.flat) - 1)
                last = (t + k == len(ids)) | (p + k == self.begin[item + 1]) | (ids[after] != self.flat[beyond])
                rows = np.stack([item, t - p + self.begin[item], t], axis=1)
                firsts.append(rows[first])
                lasts.append(rows[last])
            first, last = (x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))] for x in (np.concatenate(firsts), np.concatenate(lasts)))
            out.append(np.stack([first[:, 0], last[:, 2] - first[:, 2] + k, first[:, 2], first[:, 2] - first[:, 1]], axis=1))
        return np.concatenate(out)

    def tiles(self, text: str) -> list[tuple[int, list[tuple[int, int, int]]]]:
        """(number of the item, its tiles in the text) for items with any."""
        if not self.item_ids:
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words(text)), np.uint64)
        found = self.maximal_matches(ids)
        found = found[np.argsort(found[:, 0], kind="stable")]
        edge = np.flatnonzero(np.r_[True, found[1:, 0] != found[:-1, 0]]) if len(found) else np.empty(0, np.int64)
        out = []
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(found)], strict=False):
            item = int(found[a, 0])
            out.append((item, tile(found[a:b, 1:].tolist(), int(self.least[item]), len(ids), int(self.begin[item + 1] - self.begin[item]))))
        return out

    def matches(self, text: str, coverage: float) -> list[tuple[int, float, int]]:
        """(item_id, share of the item's words that tiles cover, tiles) where the share reaches coverage."""
        out = []
        for item, found in self.tiles(text):
            share = sum(n for n, _, _ in found) / int(self.begin[item + 1] - self.begin[item])
            if share >= coverage:
                out.append((self.item_ids[item], share, len(found)))
        return out


def blocks(benchmark: DataFrame, min_match: int = MIN_MATCH, block_chars: int = BLOCK_CHARS) -> Iterator[Index]:
    """Indexes over the whole benchmark, each of about block_chars characters."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-int(chars) // block_chars))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])), min_match)


def pairs(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles) of the documents that an item contaminates."""

    def finder(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(d.as_py(), *m) for d, t in zip(batch.column(0), batch.column(1), strict=True) for m in index.matches(t.as_py() or "", coverage)]
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)], ["doc_id", "item_id", "coverage", "n_tiles"])

        return run

    base = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    whole = None
    for index in blocks(benchmark, min_match, block_chars):
        found = base.mapInArrow(finder(index), "doc_id long, item_id long, coverage double, n_tiles long")
        whole = found if whole is None else whole.unionByName(found)
    return whole


def keep_clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the contaminated rows."""
    at = docs.columns.index("text")

    def keeper(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.matches(t.as_py() or "", coverage) for t in batch.column(at)], pa.bool_()))

        return run

    for index in blocks(benchmark, min_match, block_chars):
        docs = keep_rows(docs, keeper(index))
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import table

    return pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
