"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet over shared seeds of `least` tokens. On each pair that shares enough of an item's
tokens, running Karp-Rabin matching marks the longest matches first, each token once, until none of `least` tokens is
left; the share of the item's tokens in tiles decides. Tiles may stand in any order, so a reordered passage counts too.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.llm import sketch
from doseframe.llm.base import HOT_ROWS, HOT_SHARE, WordHashes, gram_hashes, in_small_batches, texts_as_bytes, tidy, window_sums, written
from doseframe.llm.substring import chunks

EDGES = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())
FILTER_BITS = 27


class TokenHashes(WordHashes):
    """Hashes of words without case and without ASCII punctuation at their edges."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.decode().lower().strip(EDGES) or word.decode())
        return h


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, length) of greedy string tiling's matches of `least` tokens or more."""
    free = [np.ones(len(item), bool), np.ones(len(doc), bool)]
    out: list[tuple[int, int, int]] = []
    length = max(least, min(20, len(item)))
    while len(item) >= least and len(doc) >= least:
        found, longest = _matches(item, doc, free, length)
        if longest > 2 * length:
            length = longest  # look for the very long ones first
            continue
        for size, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free[0][i : i + size].all() and free[1][j : j + size].all():
                free[0][i : i + size] = free[1][j : j + size] = False
                out.append((i, j, size))
        if length == least:
            if not found:
                break
        else:
            length = max(least, length // 2)
    return out


def _matches(item: np.ndarray, doc: np.ndarray, free: list[np.ndarray], length: int) -> tuple[list[tuple[int, int, int]], int]:
    """Matches of unmarked tokens, as long as they go, from every place where `length` tokens have equal Karp-Rabin hashes."""
    starts = []
    for tokens, open_ in zip((item, doc), free, strict=True):
        hashes = window_sums(tokens, length, 0x9E3779B97F4A7C15)
        used = np.concatenate([[0], np.cumsum(~open_)])
        at = np.flatnonzero(used[length:] == used[:-length]) if len(hashes) else np.zeros(0, np.int64)
        starts.append((hashes[at], at))
    (h_item, at_item), (h_doc, at_doc) = starts
    shared = np.isin(h_doc, h_item)
    places = defaultdict(list)
    for h, j in zip(h_doc[shared].tolist(), at_doc[shared].tolist(), strict=True):
        places[h].append(j)
    found, longest = [], 0
    for h, i in zip(h_item.tolist(), at_item.tolist(), strict=True):
        for j in places.get(h, ()):
            if i and j and item[i - 1] == doc[j - 1] and free[0][i - 1] and free[1][j - 1]:
                continue  # part of the match that starts earlier
            most = min(len(item) - i, len(doc) - j)
            stop = np.flatnonzero((item[i : i + most] != doc[j : j + most]) | ~free[0][i : i + most] | ~free[1][j : j + most])
            size = int(stop[0]) if len(stop) else most
            if size >= length:
                found.append((size, i, j))
                longest = max(longest, size)
    return found, longest


def item_seeds(items: DataFrame, least: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), texts_as_bytes(batch.column(1)), strict=True):
                ids = hashes.of(t.split() if t else [])
                rows += [(i, len(ids), p, g) for p, g in enumerate(gram_hashes(ids, min(least, len(ids)) or least).view(np.int64).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64() if k in (0, 3) else pa.int32()) for k in range(4)], names=["item_id", "tokens", "place", "seed"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").mapInArrow(tidy(run), "item_id long, tokens int, place int, seed long")


def hot_seeds(hits: DataFrame) -> DataFrame:
    """(seed, n, shares) of the seeds that hold HOT_ROWS hits and one in HOT_SHARE of all: their hits, in shares of that size."""
    share = max(HOT_ROWS, -(-hits.count() // HOT_SHARE))
    counts = hits.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= share)
    counts = counts.select("seed", "n", F.ceil(F.col("n") / share).cast("int").alias("shares"))
    return hits.sparkSession.createDataFrame(counts.collect(), counts.schema)  # HOT_SHARE rows at most


def places_to_join(seeds: DataFrame, hot: DataFrame, least: int, coverage: float) -> DataFrame:
    """The rows of seeds less those that an item can spare, with the shares of their seed, and in spare the tokens that the
    item's spared places cover at most.

    A tile of n >= least tokens has n - least + 1 places, n / least of them at least. So a document that holds `coverage` of
    an item's tokens in tiles has ceil(coverage * tokens / least) of its places, and one fewer, the hottest, can be spared:
    the document is found by another place. Items that have a token count in common under one id are told apart by the tiling."""
    need = F.ceil(F.col("tokens") * coverage / least - 1e-9)
    heat = Window.partitionBy("item_id", "tokens").orderBy(F.desc("n"), "seed", "place")
    marked = seeds.join(F.broadcast(hot), "seed").withColumn("spared", F.row_number().over(heat) < need)
    spare = marked.where("spared").groupBy("item_id", "tokens").agg((F.count("*") * least).cast("int").alias("spare"))
    cold = seeds.join(F.broadcast(hot), "seed", "left_anti").withColumn("shares", F.lit(1))
    left = cold.unionByName(marked.where("not spared").select(cold.columns))
    return left.join(spare, ["item_id", "tokens"], "left").withColumn("spare", F.coalesce("spare", F.lit(0)))


def in_shares(hits: DataFrame, places: DataFrame, hot: DataFrame) -> DataFrame:
    """hits joined with places on their seed; each share of a hot seed's hits meets a copy of its places of its own."""
    if hot.isEmpty():
        return hits.join(places, "seed")
    hits = hits.join(F.broadcast(hot.select("seed", "shares")), "seed", "left")
    hits = hits.select("doc_id", "seed", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.coalesce("shares", F.lit(1))).cast("int").alias("share"))
    return hits.join(places.withColumn("share", F.explode(F.expr("sequence(0, shares - 1)"))), ["seed", "share"])


def contaminated(docs: DataFrame, items: DataFrame, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds, in whole or in reordered parts.

    Takes doc_id and text of docs, item_id and text of items. Returns doc_id, item_id, matched (the item's tokens in
    tiles), tokens (the item's), coverage (their quotient, at least the given one) and tiles (item_start, doc_start,
    length). Tokens are words without case and without ASCII punctuation at their edges.

    Null and empty texts match nothing; an item of fewer than `least` tokens, which any text may hold by chance, is found
    where it is the whole document. Rows with a
    null doc_id or item_id are left out. Equal rows give one pair; of several texts under one id the best pair counts.
    Empty tables give an empty table. Other columns are not looked at.

    A filter of 2**27 bits, whatever the number of items, is broadcast to pass over grams that no item has; the join
    on the grams themselves then finds the pairs. Of grams that very many documents hold, an item spares those without
    which its rarer ones find the same pairs; the others are joined in shares of their documents.
    """
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
    seeds = written(item_seeds(items, least), "decontaminate-seeds")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from sketch.partial(batch.column(0).to_numpy().view(np.uint64), 1, FILTER_BITS)

    spark = docs.sparkSession
    some = spark.sparkContext.broadcast(sketch.Sketch(sketch.merged(seeds.select("seed").mapInArrow(tidy(cells), sketch.CELLS), 1, FILTER_BITS), 1, FILTER_BITS))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = TokenHashes(), some.value
        for batch, words in chunks(batches, 1):
            sizes = np.array([len(w) for w in words], np.int64)
            ids = hashes.of([x for w in words for x in w])
            g = gram_hashes(ids, least)
            doc = np.repeat(np.arange(len(words)), sizes)[: len(g)]
            hit = known.reached(g) & (np.arange(len(g)) + least <= np.cumsum(sizes)[doc]) if len(g) else np.zeros(0, bool)
            short = [i for i, n in enumerate(sizes.tolist()) if 0 < n < least]  # such a document is one gram
            ends = np.cumsum(sizes)
            whole = np.array([gram_hashes(ids[ends[i] - sizes[i] : ends[i]], int(sizes[i]))[0] for i in short], np.uint64)
            short = np.array(short, np.int64)[known.reached(whole)]
            whole = whole[known.reached(whole)]
            pairs = np.unique(np.rec.fromarrays([np.append(doc[hit], short), np.append(g[hit], whole).view(np.int64)], names="d,g"))
            if len(pairs):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs.d)), pa.array(np.ascontiguousarray(pairs.g))], names=["doc_id", "seed"])

    hits = written(docs.mapInArrow(tidy(grams), "doc_id long, seed long"), "decontaminate-hits")
    hot = hot_seeds(hits)
    places = seeds.withColumns({"shares": F.lit(1), "spare": F.lit(0)}) if hot.isEmpty() else written(places_to_join(seeds, hot, least, coverage), "decontaminate-places")
    met = in_shares(hits, places, hot)
    # an item's places are at most its tokens; spared ones may be held too
    reach = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + least - 1))))) + F.col("spare")
    pairs = met.groupBy("doc_id", "item_id", "tokens", "spare").agg(F.collect_set("place").alias("places")).where(reach >= F.col("tokens") * coverage).select("doc_id", "item_id").distinct()
    pairs = written(pairs, "decontaminate-pairs")
    ids = pairs.select(F.col("doc_id").alias("id")).distinct()
    held = docs.join(ids, F.col("doc_id") == F.col("id"), "left_semi")
    both = pairs.join(items.select("item_id", F.col("text").alias("item")), "item_id").join(held, "doc_id").select("doc_id", "item_id", "item", "text")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = TokenHashes()
        for batch in batches:
            rows = []
            for k, (item, text) in enumerate(zip(texts_as_bytes(batch.column(2)), texts_as_bytes(batch.column(3)), strict=True)):
                a, b = (hashes.of(t.split() if t else []) for t in (item, text))
                found = tiles(a, b, least) if len(a) >= least else [(0, 0, len(a))] if len(a) and np.array_equal(a, b) else []
                matched = sum(n for _, _, n in found)
                if found and matched >= coverage * len(a):
                    rows.append((k, matched, len(a), [{"item_start": i, "doc_start": j, "length": n} for i, j, n in found]))
            at = pa.array([r[0] for r in rows], pa.int64())
            place = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[1] / r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], place)], names=["doc_id", "item_id", "matched", "tokens", "coverage", "tiles"])

    out = both.mapInArrow(tidy(tile), "doc_id long, item_id long, matched int, tokens int, coverage double, tiles array<struct<item_start:int,doc_start:int,length:int>>")
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "matched", "tokens", "tiles")).alias("m"))
    return best.select("doc_id", "item_id", "m.matched", "m.tokens", "m.coverage", "m.tiles")
