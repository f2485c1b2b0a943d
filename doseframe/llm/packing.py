"""Packing of token pieces into sequences: best-fit decreasing in cells, certified by dual-feasible functions.

Each partition packs its pieces in cells of bounded size, and every cell carries its certificate: the number of its
sequences, and the lower bound that a dual-feasible function over its own lengths gives. While the whole is above the
bound of all lengths, the cells deal the pieces of their sequences with a gap out anew to fewer, mixed cells, which are
packed and certified again; a cell that keeps only its full sequences is certified by them.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doseframe.llm.base import in_small_batches, tidy, written

CAPACITY = 2048
CELL_ROWS, CELL_BYTES = 100_000, 64 << 20
#: Texts and bytes of text that are encoded together.
TEXTS, TEXT_BYTES = 1000, 4 << 20


@lru_cache(2)  # a worker keeps it from task to task
def encoder(tokenizer: str, ranks: str | None) -> Callable[[list[str]], list[np.ndarray]]:
    """The ids of each text under the `tokenizers` file, without special tokens added.

    `ranks` is the same vocabulary as ranks of byte sequences, from which tiktoken makes the same ids (tests hold the two
    against each other on every character) in a fifth of the time. Strings of added tokens become these tokens, as there."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer)
    if ranks is None:
        own.no_padding()
        own.no_truncation()
        return lambda texts: [np.array(e.ids, np.uint32) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    import tiktoken

    with open(ranks, "rb") as lines:
        known = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    added = {str(token): i for i, token in own.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens=added)
    own.no_padding()
    own.no_truncation()

    def ids(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its regex gives up on runs of about a million blanks, the library's doesn't
            return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    return lambda texts: [ids(t) for t in texts]


def tokenized(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, ids: bool = True) -> DataFrame:
    """Pieces of at most `capacity` ids: doc_id, piece, start (ids of the document before it), length, ids_crc32 and, if
    asked for, ids (little-endian unsigned 32-bit). The ids of a text are those of the whole text, then the id `end`. Only
    longer documents are cut, and then only their first piece may be shorter than `capacity`."""
    path, ranks = (tokenizer, None) if tokenizer else (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if ids else {})

    def pieces(own: pa.Array, texts: list[str], encode: Callable[[list[str]], list[np.ndarray]]) -> pa.RecordBatch:
        at, rows = [], {k: [] for k in kinds}
        for i, found in enumerate(encode(texts)):
            whole = np.append(found, np.uint32(end)).astype("<u4")
            cuts = [0, *range((len(whole) - 1) % capacity + 1, len(whole) + 1, capacity)]
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                raw = whole[a:b].tobytes()
                at.append(i)
                for column, v in zip(rows.values(), (p, a, b - a, zlib.crc32(raw), raw), strict=False):
                    column.append(v)
        return pa.RecordBatch.from_arrays([own.take(pa.array(at, pa.int64())), *(pa.array(rows[k], kind) for k, kind in kinds.items())], names=["doc_id", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks)
        for batch in batches:
            first, size, texts = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or "")
                size += len(texts[-1])
                if len(texts) >= TEXTS or size >= TEXT_BYTES:
                    yield pieces(batch.column(0).slice(first, len(texts)), texts, encode)
                    first, size, texts = i + 1, 0, []
            if texts:
                yield pieces(batch.column(0).slice(first), texts, encode)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if ids else "")
    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), schema)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, count = 0, 0  # bit r of open_: some bin has room r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            own = by_room[room].pop()
            if not by_room[room]:
                open_ &= ~(1 << room)
        else:
            room, own, count = capacity, count, count + 1
        bins[i], offsets[i] = own, capacity - room
        if left := room - n:
            by_room[left].append(own)
            open_ |= 1 << left
    return bins, offsets, np.bincount(bins, weights=lengths, minlength=count).astype(np.int64)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The least number of bins for counts[n] pieces of length n, by two families of dual-feasible functions.

    For each e up to half the capacity: lengths over capacity - e count as the whole, lengths under e as nothing. For
    k = 1..24: x goes to floor((k + 1) x / capacity) / k of the capacity, unless that product is whole, then x stays."""
    x = np.arange(capacity + 1)
    n = counts.astype(object) if counts.sum() > 1 << 40 else counts.astype(np.int64)
    total, pieces = np.cumsum(x * n), np.cumsum(n)
    e = np.arange(1, capacity // 2 + 1)
    by_edge = pieces[capacity] - pieces[capacity - e] - (total[e - 1] - total[capacity - e]) // capacity
    best = max(-(-total[capacity] // capacity), max(by_edge, default=0))
    for k in range(1, 25):
        whole = (k + 1) * x % capacity == 0
        value = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in units of 1 / k
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return int(best)


#: What a cell adds to its pieces: place, fill of the piece's sequence, and the cell with its sequences, full ones and bound.
PLACED = ("sequence_id", "offset", "fill", "cell", "cell_sequences", "cell_full", "cell_bound")


def _cells(pieces: DataFrame, capacity: int, turn: int) -> DataFrame:
    """Every partition packed and certified cell by cell."""
    names = [c for c in pieces.columns if c not in PLACED]
    schema = T.StructType([pieces.schema[c] for c in names] + [T.StructField(c, T.LongType()) for c in PLACED])
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, used = turn << 58 | TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []

        def cell() -> Iterator[pa.RecordBatch]:
            nonlocal used
            lengths = np.concatenate([b.column(at).to_numpy() for b in held])
            bins, offsets, fill = best_fit_decreasing(lengths, capacity)
            own = (base + used, len(fill), int((fill == capacity).sum()), lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity))
            i = 0
            for b in held:
                j = i + b.num_rows
                certificate = [pa.array(np.full(j - i, v, np.int64)) for v in own]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base + used + bins[i:j]), pa.array(offsets[i:j]), pa.array(fill[bins[i:j]]), *certificate], names=[*names, *PLACED])
                i = j
            used += len(fill)
            held.clear()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CELL_ROWS or sum(b.nbytes for b in held) >= CELL_BYTES:
                yield from cell()
        if held:
            yield from cell()

    return pieces.select(names).mapInArrow(tidy(run), schema)


def packed(pieces: DataFrame, capacity: int = CAPACITY, turns: int = 6) -> tuple[DataFrame, dict[str, int]]:
    """pieces (any columns, length among them, each from 1 to capacity) with sequence_id, offset (gapless from 0), cell, and
    the cell's certificate: cell_sequences, and cell_bound, below which no packing of the cell's pieces can go.

    Returns the frame and the certificate of the whole: sequences, and the bound for all lengths. Cells exchange the
    pieces of their sequences with gaps until the whole meets that bound, a turn saves nothing, or `turns` are over; what
    is left between sequences and bound is reported by both certificates. Equal rows are packed each by itself. An empty
    table gives an empty one and zeros."""
    now = written(_cells(pieces, capacity, 0), "packing-cells")
    seen = now.groupBy("length").agg(F.count("*").alias("n"))  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in seen.toLocalIterator():
        counts[length] = n
    bound = lower_bound(counts, capacity)
    total = now.where("offset = 0").count()
    for turn in range(1, turns + 1):
        if total <= bound:
            break
        loose = now.where(F.col("fill") < capacity)
        rows, was = loose.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
        keys = [F.xxhash64(F.lit(turn), *[F.col(c) for c in pieces.columns])]
        again = written(_cells(loose.repartition(-(-rows // CELL_ROWS), *keys), capacity, turn), "packing-exchange")
        new = again.where("offset = 0").count()
        if new >= was:
            break
        full = now.where(F.col("fill") == capacity).withColumns({"cell_sequences": F.col("cell_full"), "cell_bound": F.col("cell_full")})
        now, total = full.unionByName(again), total - was + new
    return now.drop("fill", "cell_full"), {"sequences": total, "bound": bound}


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Whole documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset, cell, cell_sequences,
    cell_bound (see `packed`).

    A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed like any other; an empty
    table gives an empty one. Other columns are not looked at. The ids themselves are those of `tokenized`, which can be
    joined on (doc_id, piece), or packed along: `packed` takes any columns."""
    return packed(tokenized(docs, tokenizer, capacity, ids=False), capacity)[0].select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "cell", "cell_sequences", "cell_bound")
