"""Ranked lexical search of many queries at once, over what they have in common.

Terms that the same items hold equally often are one set; sets that stand together in several items are paired, and pairs
again, so that a block of items is a directed acyclic graph of sums. Over a run of documents each node's accumulator is
filled once, from the terms up, whatever the number of items that hold it; an item adds the few nodes left to it.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, texts_as_bytes, tidy, written

#: What separates terms is a blank; letters are folded. Beyond ASCII every byte is part of a term.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
#: A block of items ends at so many items, terms or bytes of terms: what is broadcast. Bytes of accumulators at a time, and
#: of text that is split at a time.
BLOCK_ITEMS, BLOCK_TERMS, BLOCK_BYTES, ACCUMULATORS, PART = 2000, 200_000, 16 << 20, 32 << 20, 4 << 20


def term_lists(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, of PART bytes at a time."""
    folded, start = text.translate(FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PART)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): each item's terms and their repeats. Rows of one item_id are one item; one without terms has no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(t for own in term_lists(text or b"") for t in own) for text in texts_as_bytes(batch.column(1))]
            at = np.repeat(np.arange(len(found)), [len(c) for c in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([t for c in found for t in c], pa.binary()), pa.array([n for c in found for n in c.values()], pa.int64())], names=["item_id", "term", "n"])

    rows = in_small_batches(items).select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(tidy(run), "item_id long, term binary, n long")
    return rows.groupBy("item_id", "term").agg(F.sum("n").alias("n")).groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "n"))).alias("terms"))


class Sharing:
    """The graph of a block of items.

    term: number of each term. leaf[term]: its node. scaled: (nodes, sources, factors) of sets that items hold several
    times. levels: (parents, left, right), a level's sources being of levels before. flat, starts: the nodes that each
    item adds up."""

    def __init__(self, items: list[tuple[int | None, list[tuple[bytes, int]]]]):
        self.ids = [item_id for item_id, _ in items]
        holders: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, terms) in enumerate(items):
            for term, n in terms:
                holders[term].append((i, n))
        self.term = {t: k for k, t in enumerate(holders)}
        sets: dict[tuple[tuple[int, int], ...], int] = {}
        self.leaf = np.array([sets.setdefault(tuple(own), len(sets)) for own in holders.values()], np.int64)
        self.nodes = len(sets)
        scaled: dict[tuple[int, int], int] = {}
        rows: list[list[int]] = [[] for _ in items]
        for own, node in sorted(sets.items(), key=lambda s: (-len(s[0]), s[1])):  # what many items hold comes first in each
            for i, n in own:
                if n > 1 and (node, n) not in scaled:
                    scaled[node, n] = self._node()
                rows[i].append(scaled[node, n] if n > 1 else node)
        self.scaled = tuple(np.array(x, np.int64) for x in ([*scaled.values()], [s for s, _ in scaled], [n for _, n in scaled]))
        self.levels = self._mine(rows)
        self.flat = np.array([node for row in rows for node in row], np.int64)
        self.starts = np.cumsum([0, *map(len, rows)])[:-1]

    def _node(self) -> int:
        self.nodes += 1
        return self.nodes - 1

    def _mine(self, rows: list[list[int]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Replaces neighbours that stand together in two items or more by a node of their own, until there are none; a round
        is linear in the rows and makes a level."""
        levels = []
        while True:
            counts = Counter(pair for row in rows for pair in zip(row, row[1:], strict=False))
            chosen: list[list[int]] = []
            uses: Counter[tuple[int, int]] = Counter()
            for row in rows:
                own, i = [], 0
                while i + 1 < len(row):
                    n = counts[row[i], row[i + 1]]
                    if n > 1 and not (i + 2 < len(row) and counts[row[i + 1], row[i + 2]] > n):
                        own.append(i)
                        uses[row[i], row[i + 1]] += 1
                        i += 1
                    i += 1
                chosen.append(own)
            made = {pair: self._node() for pair, n in uses.items() if n > 1}
            if not made:
                return levels
            for row, own in zip(rows, chosen, strict=True):
                for i in reversed(own):
                    if (node := made.get((row[i], row[i + 1]))) is not None:
                        row[i : i + 2] = [node]
            levels.append((np.array([*made.values()]), np.array([a for a, _ in made]), np.array([b for _, b in made])))

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
        """Each item's score of `count` documents, given the terms they hold and what each adds."""
        sums = np.zeros((self.nodes, count), np.int64)
        np.add.at(sums.reshape(-1), self.leaf[term] * count + doc, value)
        made, source, factor = self.scaled
        sums[made] = sums[source] * factor[:, None]
        for made, left, right in self.levels:
            sums[made] = sums[left] + sums[right]
        return np.add.reduceat(sums[self.flat], self.starts, axis=0)


def blocks(rows: DataFrame) -> Iterator[Sharing]:
    """The items of item_terms in blocks of bounded size."""
    held, terms, size = [], 0, 0
    for item_id, own in rows.toLocalIterator():
        held.append((item_id, [(bytes(t), n) for t, n in own]))
        terms, size = terms + len(own), size + sum(len(t) for t, _ in own)
        if len(held) >= BLOCK_ITEMS or terms >= BLOCK_TERMS or size >= BLOCK_BYTES:
            yield Sharing(held)
            held, terms, size = [], 0, 0
    if held:
        yield Sharing(held)


def postings(texts: list[bytes | None], index: dict[bytes, int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """All terms of each text (with repeats), and (text, term, repeats) of those in the index."""
    sizes, keys, get, width = [], [np.zeros(0, np.int64)], index.get, len(index)
    for i, text in enumerate(texts):
        n = 0
        for own in term_lists(text or b""):
            n += len(own)
            found = np.fromiter(map(get, own, repeat(-1)), np.int64, len(own))
            keys.append(found[found >= 0] + i * width)
        sizes.append(n)
    key, repeats = np.unique(np.concatenate(keys), return_counts=True)
    return sizes, key // width, key % width, repeats


def term_counts(docs: DataFrame, index: dict[bytes, int]) -> dict[int, int]:
    """Documents that hold each term of the index, and under -1 and -2 those with a term, and all their terms: a row per
    term of a block at most."""
    spread = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, some, total = np.zeros(len(spread.value), np.int64), 0, 0
        for batch in batches:
            sizes, _, term, _ = postings(texts_as_bytes(batch.column(1)), spread.value)
            held += np.bincount(term, minlength=len(held))
            some, total = some + sum(n > 0 for n in sizes), total + sum(sizes)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(held[at], [some, total]))], names=["term", "n"])

    found = docs.mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return dict(map(tuple, found.collect()))


def best(item: np.ndarray, score: np.ndarray, absent: np.ndarray, doc: np.ndarray, most: int) -> np.ndarray:
    """Places of each item's highest scores, equal ones by document."""
    order = np.lexsort((doc, absent, -score, item))
    own = item[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < most]


def ranked_block(docs: DataFrame, sharing: Sharing, counts: dict[int, int], most: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents of each item and task."""
    some, total = counts.get(-1, 0), counts.get(-2, 0)
    weights = np.array([math.floor(1000 * math.log((2 * some + 2) / (2 * counts.get(k, 0) + 1))) for k in range(len(sharing.term))], np.int64)
    spread = docs.sparkSession.sparkContext.broadcast((sharing, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sharing, weights = spread.value
        step = max(1, ACCUMULATORS // (8 * (sharing.nodes + len(sharing.flat) + len(sharing.ids))))
        top = [np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64)]  # item, score, no doc_id, doc_id
        floor, floor_id = np.zeros(len(sharing.ids), np.int64), np.full(len(sharing.ids), -1)
        for batch in batches:
            sizes, doc, term, repeats = postings(texts_as_bytes(batch.column(1)), sharing.term)
            length = np.array([75 + 25 * n * some // total if total else 75 for n in sizes], np.int64)  # exact beyond 64 bits
            value = weights[term] * (1_000_000_000 * repeats // (1000 * repeats + 12 * length[doc]))
            absent, ids = np.array([not x.is_valid for x in batch.column(0)], bool), batch.column(0).fill_null(0).to_numpy()
            for a in range(0, batch.num_rows, step):
                b = min(a + step, batch.num_rows)
                i, j = np.searchsorted(doc, [a, b])
                if i == j:
                    continue
                scores = sharing.scores(doc[i:j] - a, term[i:j], value[i:j], b - a)
                near = (scores > floor[:, None]) | ((scores == floor[:, None]) & (absent[a:b] | (ids[a:b] < floor_id[:, None])))
                item, at = np.nonzero(near & (scores > 0))
                if len(item):
                    all_ = [np.concatenate(x) for x in zip(top, (item, scores[item, at], absent[a:b][at], ids[a:b][at]), strict=True)]
                    top = [x[best(*all_, most)] for x in all_]
                    own, n = np.unique(top[0], return_counts=True)
                    full, last = own[n == most], np.cumsum(n)[n == most] - 1
                    floor[full], floor_id[full] = top[1][last], np.where(top[2][last], np.iinfo(np.int64).max, top[3][last])
        names = pa.array(sharing.ids, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(top[0]), names.take(pa.array(top[0])), pa.array(top[3], mask=top[2]), pa.array(top[1])], names=["item", "item_id", "doc_id", "score"])

    found = docs.mapInArrow(tidy(run), "item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= most).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, most: int = 20) -> DataFrame:
    """item_id, rank (int, from 1), doc_id, score: each item's `most` highest-scoring documents with a score above 0.

    Takes doc_id and text of docs, item_id and text of items; terms are runs of ASCII letters and digits and of all that is
    beyond ASCII, without the case of A-Z. Every document is scored for every item, in blocks of items whose graph is
    broadcast (BLOCK_ITEMS, BLOCK_TERMS and BLOCK_BYTES bound it); a task keeps `most` documents an item, which is all
    that is shuffled.

    Null and empty texts have no terms: such a document counts nowhere, such an item has no row. Rows of one item_id (null
    too) are one item, whose terms add up. Each row of docs is a document of its own, whatever its doc_id; equal scores go
    by doc_id, null ones last. Empty tables give an empty one. Other columns are not looked at."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = []
    for sharing in blocks(item_terms(items)):
        found.append(written(ranked_block(docs, sharing, term_counts(docs, sharing.term), most), "lexical-block"))
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
