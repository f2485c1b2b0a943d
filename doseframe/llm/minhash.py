"""Near-duplicate documents by circulant MinHash.

Two permutations of a universe of 2**22 places make all coordinates of a signature: the first scatters a shingle,
the second, shifted circularly by k places, gives coordinate k. Bands of coordinates propose pairs, and the exact
Jaccard similarity of the full shingle sets confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import WordHashes, connected_components, finished, gram_hashes, in_small_batches, joined, mix, texts_as_bytes, tidy, written

PLACES = 1 << 22
BANDS, ROWS = 30, 4


@lru_cache(1)
def permutations(coordinates: int, seed: int = 20_240) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and every run of `coordinates` neighbouring places of the shifted one as a row."""
    rng = np.random.default_rng(seed)
    scatter, shifted = (rng.permutation(np.arange(PLACES, dtype=np.uint32)) for _ in range(2))
    ring = np.concatenate([shifted[-(coordinates - 1) :], shifted])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def shingle_set(text: bytes | None, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-word shingles; with fewer words, the whole sequence is one."""
    words = hashes.of(text.lower().split()) if text else np.zeros(0, np.uint64)  # bytes: only A-Z is lowered, only ASCII space splits
    return np.unique(gram_hashes(words, min(n, len(words)))) if len(words) else words


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    scatter, rows = permutations(coordinates)
    at = scatter[(shingles >> np.uint64(42)).astype(np.int64)]
    out = np.full(coordinates, PLACES, np.uint32)
    for i in range(0, len(at), 4096):
        np.minimum(out, rows[at[i : i + 4096]].min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band, which also tells the band."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[j::rows][:bands].astype(np.uint64))
    return out.view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, a, b, keys = [], [], [], []
            for text in texts_as_bytes(batch.column(1)):
                s = shingle_set(text, words, hashes)
                sizes.append(len(s))
                a.append(int(s.sum(dtype=np.uint64)) if len(s) else 0)
                b.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) if len(s) else 0)
                keys.append(band_keys(signature(s, bands * rows), bands, rows) if len(s) else np.zeros(0, np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )
        permutations.cache_clear()  # 32 MB that later tasks of this worker can use otherwise

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>")


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the full set as sorted unsigned 64-bit little-endian values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            made = [shingle_set(t, words, hashes).tobytes() for t in texts_as_bytes(batch.column(1))]
            for i in range(0, len(made), 500):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 500), pa.array(made[i : i + 500], pa.binary())], names=["id", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(tidy(run), "id long, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                least, most = sorted((len(x), len(y)))
                same = len(np.intersect1d(x, y, assume_unique=True)) if 100 * least >= percent * most else 0
                good.append(bool(same) and 100 * same >= percent * (len(x) + len(y) - same))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(tidy(run), "a long, b long").distinct()


def links_of(values: list[np.ndarray], owners: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links among sets, as few as join what they connect; sets of one owner count as connected already."""
    rows = np.repeat(np.arange(len(values)), [len(v) for v in values])
    seen, at, n = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = n[at] > 1
    rows, at = rows[shared], at[shared]
    same = np.zeros((len(values), len(values)), np.int64)
    place = np.cumsum(n > 1) - 1
    at = place[at]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        part = (at >= low) & (at < low + 4096)
        x = np.zeros((len(values), 4096), np.float32)
        x[rows[part], at[part] - low] = 1
        same += (x @ x.T).astype(np.int64)  # 4,096 at most: exact
    sizes = np.array([len(v) for v in values], np.int64)
    linked = (same > 0) & (100 * same >= percent * (sizes[:, None] + sizes[None, :] - same))
    out, todo = [], np.ones(len(values), bool)
    for root in range(len(values)):
        if not todo[root]:
            continue
        todo[root], queue = False, [root]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(linked[i] & todo):
                out.append((i, int(j)))
                queue.append(int(j))
            todo[queue] = False
    return [(i, j) for i, j in out if owners[i] != owners[j]]


#: Shingles and documents of one block, about; a task holds the documents of two blocks.
BLOCK, BLOCK_DOCS = 200_000, 500


def linked_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group `first` of members (first, node, size, component), over pairs of blocks.

    A component that fills blocks has blocks of its own, and isn't held against itself: its documents are linked already.
    The smaller components of a group share mixed blocks (component null)."""
    each = written(members.groupBy("first", "component").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "minhash-shares")
    large = (F.col("size") >= BLOCK) | (F.col("n") >= BLOCK_DOCS)
    of = F.ceil(F.greatest(F.sum("size") / BLOCK, F.sum("n") / BLOCK_DOCS)).cast("int")
    own = each.where(large).groupBy("first", "component").agg(of.alias("blocks"))
    mixed = each.where(~large).groupBy("first").agg(of.alias("blocks")).select("first", F.lit(None).cast("long").alias("component"), "blocks")
    # a row for each component that fills a block, and one for the others, of each group
    plan = written(own.unionByName(mixed), "minhash-plan")
    plans = plan.groupBy("first").agg(F.array_sort(F.collect_list(F.struct("component", "blocks"))).alias("plan"))
    dealt = joined(written(members, "minhash-dealt"), written(plans, "minhash-plans"), ["first"], "inner", "minhash-plans")
    fits = F.filter("plan", lambda p: p["component"] == F.col("component"))
    dealt = dealt.withColumn("own", F.when(F.size(fits) > 0, fits[0]).otherwise(F.filter("plan", lambda p: p["component"].isNull())[0]))
    block = F.struct(F.col("own.component").alias("of"), F.pmod(F.xxhash64("node"), F.col("own.blocks")).cast("int").alias("k"))
    others = F.flatten(F.transform(F.filter("plan", lambda p: p["component"].isNull() | F.col("own.component").isNull() | (p["component"] != F.col("own.component"))), lambda p: F.transform(F.sequence(F.lit(0), p["blocks"] - 1), lambda k: F.struct(p["component"].alias("of"), k.alias("k")))))
    dealt = dealt.select("first", "node", "component", block.alias("block"), F.explode(others).alias("other"))
    whole = dealt.join(sets.withColumnRenamed("id", "node"), "node")

    def run(rows: pa.Table) -> pa.Table:
        found = links_of([np.frombuffer(v.as_buffer(), np.uint64) for v in rows.column("shingles")], rows.column("component").to_numpy(), percent)
        node = rows.column("node").to_numpy()
        return pa.table({k: pa.array(node[[x[i] for x in found]] if found else [], pa.int64()) for i, k in enumerate("ab")})

    keys = [F.col("first"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")]
    return whole.select(*keys, "node", "component", "shingles").groupBy("first", "low", "high").applyInArrow(run, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least percent / 100 on `words`-word shingles.

    Takes doc_id and text of docs, whatever other columns it has. Returns one row per row of docs: doc_id, n_shingles,
    component_id (smallest doc_id reachable over links, itself included) and kept (doc_id = component_id).

    Null, empty and blank texts have no shingles, are linked with nothing and stay. Equal sets are one node, named by
    their smallest doc_id, so copies cost no pairs. Repeated rows of one doc_id are one document and get equal rows. A
    null doc_id has a null component_id and isn't kept. An empty table gives an empty table.

    Of the documents in a band's bucket, all are held against the smallest one. Where a bucket then still has more than
    one component, the documents of all buckets with that smallest one are held against each other in pairs of blocks
    of bounded size, so no proposed pair stays untested; a block pair sends back no more links than join its documents. A pair at the threshold is proposed by at least one of 30
    bands of 4 coordinates with a probability over 1 - 2e-7 at 0.80 and over 1 - 1e-9 at 0.85.
    """
    docs = in_small_batches(docs)
    sig = written(signatures(docs, words, bands, rows), "minhash-signatures")
    same = ["set_a", "set_b", "n_shingles"]
    real = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    copies = sig.where(real).groupBy(*same).agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    named = joined(sig.where(real).select("doc_id", *same), written(copies, "minhash-copies"), same, "left", "minhash-copies")
    named = written(named.select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("node")), "minhash-nodes")
    own = named.where("node = doc_id").select("node").distinct()
    keys = sig.where(real).select(F.col("doc_id").alias("node"), F.col("n_shingles").cast("int").alias("size"), "bands").join(own, "node", "left_semi").select("node", "size", F.explode("bands").alias("key"))
    keys = written(keys, "minhash-keys")
    buckets = written(keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").drop("last"), "minhash-buckets")
    members = written(joined(keys, buckets, ["key"], "inner", "minhash-buckets"), "minhash-members")
    star = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    ids = members.select("node").distinct()
    sets = written(shingle_sets(docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("node"), "left_semi"), words), "minhash-sets")
    links = written(confirmed(star, sets, percent), "minhash-links")
    comps = connected_components(links, "minhash-star")
    finished(docs.sparkSession)

    placed = written(members.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")), "minhash-placed")
    mixed = placed.groupBy("key").agg(F.first("first").alias("first"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("first").distinct()
    rest = placed.where("node <> first").select("first", "node", "size", "component").distinct().join(mixed, "first", "left_semi")
    more = written(linked_in_blocks(rest, sets, percent), "minhash-more")
    final = comps if more.isEmpty() else connected_components(links.union(more), "minhash-all")

    out = joined(named, final, ["node"], "left", "minhash-final").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = sig.where(~real).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
