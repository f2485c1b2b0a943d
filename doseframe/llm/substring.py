"""Repeated passages: words covered by a 20-word window that also starts earlier are removed.

Pass one counts windows in a count-min sketch. A window is counted by its minimiser, the smallest of the hashes of its
10-word grams: two equal windows have equal minimisers at different places, so the sketch's count of a minimiser is never
below the count of any of its windows, while only about one place in six is counted. Pass two groups exactly, by 128-bit
hashes, the windows whose minimiser the merged sketch has more than once; a window that occurs twice is always among them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.llm import sketch
from doseframe.llm.base import WordHashes, finished, gram_hashes, in_small_batches, mix, texts_as_bytes, tidy, window_sums, written

CHUNK = 1 << 20  # bytes of text that are hashed together


def chunks(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """Slices of the batches with the words of their texts, about CHUNK bytes at a time."""
    for batch in batches:
        start, size, words = 0, 0, []
        for i, t in enumerate(texts_as_bytes(batch.column(text))):
            words.append(t.split() if t else [])
            size += len(t or b"")
            if size >= CHUNK:
                yield batch.slice(start, i + 1 - start), words
                start, size, words = i + 1, 0, []
        if words:
            yield batch.slice(start, len(words)), words


def windows(words: list[list[bytes]], n: int, gram: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all n-word windows inside one document: document's index, start, place of its minimiser, minimiser; and the words' hashes."""
    sizes = np.array([len(w) for w in words], np.int64)
    ids = hashes.of([x for w in words for x in w])
    begins = np.cumsum(sizes) - sizes
    grams = gram_hashes(ids, gram)
    count = max(0, len(ids) - n + 1)
    doc = np.repeat(np.arange(len(words)), sizes)[:count]
    valid = np.flatnonzero(np.arange(count) + n <= (begins + sizes)[doc]) if count else np.zeros(0, np.int64)
    width = n - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, width) if count else np.zeros((0, width), np.uint64)
    place = valid + view[valid].argmin(axis=1) if len(valid) else valid
    return doc[valid] if count else valid, valid, place, grams[place] if len(valid) else grams[:0], ids


#: Cells of the sketch for each minimiser that the texts' bytes let expect (one in some six words), and bits at least.
CELLS_EACH, BYTES_EACH, LEAST_BITS = 8, 36, 16


def bits_for(size: int) -> int:
    """Bits of the places of a sketch row for texts of `size` bytes together."""
    return max(LEAST_BITS, int(np.ceil(np.log2(CELLS_EACH * max(1, size) / BYTES_EACH))))


#: Rows of the table of `asked`, in the order in which a block's rows come.
PLANE, QUESTION, KNOWN = 0, 1, 2


def asked(docs: DataFrame, n: int, gram: int, bits: int) -> DataFrame:
    """(block, kind, keys, ids, bits): each document's minimisers by the block of their cell, a row for each task, block and
    about a million minimisers. Those that a task has twice are surely repeated: it tells so, and no block is asked for them."""
    size = min(sketch.BLOCK, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, amount = WordHashes(), [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            keys, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
            at, sure = sketch.cells(keys, 0, bits) >> size, count[which] > 1
            # what is known is spread by document, as one minimiser may be in most of them
            at = np.where(sure, (mix(ids.view(np.uint64)) >> np.uint64(64 - bits + size)).astype(np.int64) if bits > size else 0, at)
            order = np.lexsort((at, sure))
            where = (at << 1 | sure)[order]
            starts = np.flatnonzero(np.diff(where, prepend=-1))
            ends = np.append(starts, len(where)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order].view(np.int64))) for x in (keys, ids)]
            kind = np.where(sure[order][starts], KNOWN, QUESTION).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at[order][starts].astype(np.int32)), pa.array(kind), *lists, pa.nulls(len(starts), pa.binary())], names=["block", "kind", "keys", "ids", "bits"])

        for batch, words in chunks(batches, 1):
            doc, _, place, least, _ = windows(words, n, gram, hashes)
            new = np.diff(place, prepend=-1) != 0
            known = ~batch.column(0).is_null().to_numpy(zero_copy_only=False)[doc] & new
            held.append((least[known], batch.column(0).fill_null(0).to_numpy()[doc[known]]))
            amount += int(known.sum())
            if amount > 1_000_000:
                yield from sent()
                held, amount = [], 0
        if amount:
            yield from sent()

    return docs.mapInArrow(tidy(run), "block int, kind int, keys array<long>, ids array<long>, bits binary")


def reached_minimisers(docs: DataFrame, blocks: DataFrame, n: int, gram: int, bits: int) -> DataFrame:
    """(id, some): for each document with any, its minimisers whose cells in the first row of the sketch are reached.

    The way for a sketch too large to broadcast: what is asked is dealt out by block, behind the block's own row, and
    streamed past it. A task holds one block at a time, every block travels once, and every minimiser as a hash and a
    document, whatever the number of blocks."""
    size = min(sketch.BLOCK, bits)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, plane = -1, np.zeros(0, np.uint8)
        for batch in batches:
            found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for at, kind, keys, ids, packed in zip(*(batch.column(i) for i in range(5)), strict=True):
                if kind.as_py() == PLANE:
                    block, plane = at.as_py(), np.frombuffer(packed.as_py(), np.uint8)
                    continue
                keys, ids = (x.values.to_numpy() for x in (keys, ids))
                if kind.as_py() == KNOWN:
                    found.append((ids, keys))
                elif at.as_py() == block:  # else the block has no cell that is reached
                    cell = sketch.cells(keys.view(np.uint64), 0, bits) & ((1 << size) - 1)
                    hit = (plane[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
                    found.append((ids[hit], keys[hit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["id", "key"])

    planes = blocks.where(F.col("sketch_row") == 0).select("block", F.lit(PLANE).alias("kind"), F.lit(None).cast("array<long>").alias("keys"), F.lit(None).cast("array<long>").alias("ids"), "bits")
    met = planes.unionByName(asked(docs, n, gram, bits)).repartition("block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(tidy(answer), "id long, key long").groupBy("id").agg(F.collect_set("key").alias("some"))  # of one document


def sketched(docs: DataFrame, n: int, gram: int, rows: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = WordHashes(), [], 0
        for _, words in chunks(batches, 0):
            _, _, place, least, _ = windows(words, n, gram, hashes)
            new = least[np.diff(place, prepend=-1) != 0]
            held.append(new)
            size += len(new)
            if size > 500_000:
                yield from sketch.partial(np.concatenate(held), rows, bits)
                held, size = [], 0
        if size:
            yield from sketch.partial(np.concatenate(held), rows, bits)

    return docs.select("text").mapInArrow(tidy(run), sketch.CELLS)


#: Windows that a task compares among themselves before it sends on the rest.
HELD = 300_000


def packed_place(check: np.ndarray, start: np.ndarray, n: np.ndarray, sure: bool) -> np.ndarray:
    """24 bits of the text's hash, 31 of the first window's start (more than a text's places), 8 of the number of consecutive
    windows, 1: surely repeated."""
    return (check.astype(np.int64) << 40 | start.astype(np.int64) << 9 | n.astype(np.int64) << 1 | int(sure)).astype(np.int64)


def unpacked_place(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places >> 40 & 0xFFFFFF, places >> 9 & 0x7FFFFFFF, places >> 1 & 0xFF


def text_check(text: bytes | None) -> int:
    return xxhash.xxh64_intdigest(text or b"") & 0xFFFFFF


def among(batch: pa.RecordBatch, doc: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether each window's minimiser is in its document's list; all are in that of a null doc_id."""
    some, out = batch.column(2), np.zeros(len(doc), bool)
    alone, edges = batch.column(0).is_null().to_numpy(zero_copy_only=False), np.searchsorted(doc, np.arange(batch.num_rows + 1))
    for i in range(batch.num_rows):
        own = slice(edges[i], edges[i + 1])
        out[own] = alone[i] or (some[i].is_valid and np.isin(least[own], some[i].values.to_numpy().view(np.uint64)))
    return out


def local_repeats(a: np.ndarray, b: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether each window also stands earlier among these: in a smaller document, or before it in its own row."""
    order = np.lexsort((start, row, doc, b, a))
    a, b, doc, row = a[order], b[order], doc[order], row[order]
    same = np.zeros(len(a), bool)
    same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    least = doc[np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))]
    out = np.zeros(len(a), bool)
    out[order] = doc > least
    inner = same.copy()
    inner[1:] &= row[1:] == row[:-1]
    out[order] |= inner
    return out


def repeated_candidates(docs: DataFrame, seen: object | None, n: int, gram: int) -> DataFrame:
    """Windows estimated repeated: by the broadcast sketch, or without one by docs' column some, the minimisers of each
    document that `reached_minimisers` found (a null doc_id, which is held only against itself, has all). Those that stand earlier among the task's own are sent as runs that are sure, the
    others one by one with their hashes (a, b), so that of a window in many documents each task sends one."""

    def sent(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        a, b, doc, null, row, start, check = (np.concatenate(x) for x in zip(*held, strict=True))
        again = local_repeats(a, b, np.where(null, 0, doc), row, start)
        one = ~again & ~null
        k = np.flatnonzero(again)
        k = k[np.lexsort((start[k], row[k]))]
        new = np.ones(len(k), bool)
        new[1:] = (row[k][1:] != row[k][:-1]) | (start[k][1:] != start[k][:-1] + 1)
        first = np.flatnonzero(new)
        inside = np.arange(len(k)) - (first[np.cumsum(new) - 1] if len(k) else 0)
        new |= inside % 255 == 0
        first = np.flatnonzero(new)
        length = np.diff(np.append(first, len(k)))
        k = k[first]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([a[one], a[k]]).view(np.int64)), pa.array(np.concatenate([b[one], mix(row[k].astype(np.uint64))]).view(np.int64)),
                pa.array(np.concatenate([doc[one], doc[k]]), mask=np.concatenate([null[one], null[k]])),
                pa.array(np.concatenate([packed_place(check[one], start[one], np.ones(one.sum(), np.int64), False), packed_place(check[k], start[k], length, True)])),
            ],
            names=["a", "b", "doc_id", "place"],
        )
        for i in range(0, out.num_rows, 50_000):  # the JVM holds a whole batch outside its heap
            yield out.slice(i, 50_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, found, held, size, rows = WordHashes(), seen.value if seen else None, [], 0, 0
        for batch, words in chunks(batches, 1):
            doc, start, _, least, ids = windows(words, n, gram, hashes)
            hit = found.reached(least) if found else among(batch, doc, least)
            doc, start = doc[hit], start[hit]
            if len(doc):
                a, b = (window_sums(ids, n, step)[start] for step in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03))
                begins = np.cumsum([0] + [len(w) for w in words])
                keys, null = batch.column(0).fill_null(0).to_numpy(), batch.column(0).is_null().to_numpy(zero_copy_only=False)
                alone = null[doc]
                b = np.where(alone, b ^ mix((rows + doc).astype(np.uint64)), b)  # meets no other row's
                check = np.array([text_check(t) for t in texts_as_bytes(batch.column(1))], np.int32)
                held.append((a, b, keys[doc], alone, (rows + doc).astype(np.int32), (start - begins[doc]).astype(np.int32), check[doc]))
                size += len(doc)
            rows += len(words)
            if size > HELD:
                yield from sent(held)
                held, size = [], 0
        if held:
            yield from sent(held)

    return docs.select("doc_id", "text", *([] if seen else ["some"])).mapInArrow(tidy(run), "a long, b long, doc_id long, place long")


def without_repeats(docs: DataFrame, n: int = 20, gram: int = 10, rows: int = sketch.ROWS, bits: int | None = None, carry: bool = False, most_bits: int = sketch.BITS) -> DataFrame:
    """docs' doc_id, with n_words, n_removed, spans (start, end of the removed runs of words) and kept_text; with
    carry, also all of docs' columns in one struct, carried.

    Words are runs of bytes other than ASCII white space, unchanged. A word goes if a window of n words over it also
    starts earlier: in a smaller doc_id, or before it in the same text. Windows are judged on the input. kept_text joins
    the other words by one space; a null text has no words and gives ''. A text of fewer than n words stays whole.
    Of rows with one doc_id, each is judged by itself and against smaller ids. A null doc_id is held only against itself,
    and nothing is held against it. An empty table gives an empty table. Other columns of docs are not looked at.

    The sketch has rows * 2**bits cells; if not given, bits grow with the texts' bytes, so that of the unrepeated windows a
    few in a hundred reach the exact grouping at any size. Up to most_bits the sketch is broadcast (2**most_bits / 8 bytes a
    row); a larger one has one row, of four times as many cells, and stays a table that minimisers are joined with.
    """
    finished(docs.sparkSession)
    whole, docs = docs, in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if bits is None:
        bits = bits_for(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    if bits <= most_bits:
        blocks = sketch.merged(sketched(docs, n, gram, rows, bits), 2, bits)
        found = repeated_candidates(docs, docs.sparkSession.sparkContext.broadcast(sketch.Sketch(blocks, rows, bits)), n, gram)
    else:
        bits += 2
        blocks = written(sketch.merged(sketched(docs, n, gram, 1, bits), 2, bits).where("bits <> unhex(repeat('00', octet_length(bits)))"), "substring-sketch")
        some = reached_minimisers(docs, blocks, n, gram, bits)
        found = repeated_candidates(docs.join(some, F.col("doc_id") == F.col("id"), "left"), None, n, gram)
    earliest = F.min("doc_id").over(Window.partitionBy("a", "b"))
    marks = found.withColumn("first", earliest).where("place & 1 = 1 or doc_id > first")
    # places of one document: no more than it has words
    marks = marks.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words in chunks(batches, 1):
            total, gone, spans, kept = [], [], [], []
            for own, text, places in zip(words, texts_as_bytes(batch.column(1)), batch.column(2), strict=True):
                total.append(len(own))
                runs = []
                if places.is_valid:
                    check, at, count = unpacked_place(np.asarray(places.values))
                    mine = check == text_check(text)
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, at[mine], 1)
                    np.add.at(edge, (at + count + n - 1)[mine], -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    runs = np.flatnonzero(np.diff(cover.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
                    own = [w for w, c in zip(own, cover, strict=True) if not c]
                gone.append(sum(j - i for i, j in runs))
                spans.append([{"start": i, "end": j} for i, j in runs])
                kept.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([*([batch.column(3)] if carry else []), batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary()).cast(pa.string())], names=[*(["carried"] if carry else []), "doc_id", "n_words", "n_removed", "spans", "kept_text"])

    row = [F.struct(*[F.col(f"`{c}`") for c in whole.columns]).alias("carried")] if carry else []
    keyed = whole.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *row)
    both = keyed.join(marks, keyed.doc_id.eqNullSafe(marks.id), "left").select("doc_id", "text", "places", *(["carried"] if carry else []))
    carried = f"carried {keyed.schema['carried'].dataType.simpleString()}, " if carry else ""
    return both.mapInArrow(tidy(run), carried + "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_text string")
