"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of a piece's tree hold, for each symbol, the rank of the pair that it begins; inner nodes hold the least below
them. The root is the leftmost pair of the lowest rank: it is merged, its neighbours' leaves change in a logarithmic
number of nodes, and so on until no pair is left that the vocabulary merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, tidy

#: Pieces that a task remembers, and the most bytes of such a piece; trees of these are worked on side by side.
KNOWN, SHORT = 300_000, 64
#: Characters that are cut into pieces at once, where a text has a place at which the pattern cuts in any case.
PART = 1 << 20
NONE = 1 << 62


def byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder of a `tokenizers` file with byte-level BPE; files with other parts are an error."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, cut = spec["model"], spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and not cut.get("add_prefix_space") and cut.get("use_regex") and (spec["decoder"] or {}).get("type") == "ByteLevel"
        bare = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec["added_tokens"]
        if model["type"] != "BPE" or cut.get("type") != "ByteLevel" or not plain or not bare or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        letters, vocab = byte_letters(), model["vocab"]
        bytes_of = {c: b for b, c in enumerate(letters)}
        self.size = max([*vocab.values(), *(t["id"] for t in added)]) + 1
        self.tokens = [b""] * self.size
        for token, i in vocab.items():
            self.tokens[i] = bytes(bytes_of[c] for c in token)
        for t in added:  # its characters stand for bytes too, unless one of them is none of these characters
            self.tokens[t["id"]] = bytes(bytes_of[c] for c in t["content"]) if all(c in bytes_of for c in t["content"]) else t["content"].encode()
        self.added = {t["content"]: np.array([t["id"]], np.int32).tobytes() for t in added}
        self.single = [vocab[c] for c in letters]
        self.rank, self.made = {}, []
        for merge in model["merges"]:
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank.setdefault(vocab[a] * self.size + vocab[b], len(self.made))
            self.made.append(vocab[a + b])
        self.cut = regex.compile(public_tokenizers.PATTERN)
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, longest_first))) if longest_first else None
        self.pairs = np.full((257, 257), -1)  # the ranks of pairs of bytes; 256 is no byte
        for i, a in enumerate(self.single):
            for j, b in enumerate(self.single):
                self.pairs[i, j] = self.rank.get(a * self.size + b, -1)
        keys = np.array([*self.rank, NONE])
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([*self.rank.values(), -1])[order]
        self.single_array, self.made_array = np.array([*self.single, 0]), np.array(self.made)
        self.known: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one piece, all merges done."""
        symbols = [self.single[b] for b in piece]
        n = len(symbols)
        if n < 2:
            return symbols
        rank, made, size = self.rank, self.made, self.size
        width = 1 << (n - 2).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            r = rank.get(symbols[i] * size + symbols[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) < NONE:
            r, i = divmod(top, width)
            gone = after[i]
            k = after[gone]
            symbols[i] = own = made[r]
            after[i] = k
            changes = []
            if k < n:
                before[k] = i
                r = rank.get(own * size + symbols[k])
                changes.append((gone, NONE))
                changes.append((i, NONE if r is None else r * width + i))
            else:
                changes.append((i, NONE))
            if i:
                j = before[i]
                r = rank.get(symbols[j] * size + own)
                changes.append((j, NONE if r is None else r * width + j))
            for at, value in changes:
                at += width
                if tree[at] == value:
                    continue
                tree[at] = value
                while at > 1:
                    other = tree[at ^ 1]
                    if other < value:
                        value = other
                    at >>= 1
                    if tree[at] == value:
                        break
                    tree[at] = value
        out, i = [], 0
        while i < n:
            out.append(symbols[i])
            i = after[i]
        return out

    def merged_side_by_side(self, pieces: list[bytes]) -> list[bytes]:
        """As `merged`, as bytes, for pieces of 2 to SHORT bytes: the same trees, one column each, step by step together."""
        lengths = np.array([len(p) for p in pieces])
        n, count = int(lengths.max()), len(pieces)
        width = 1 << (n - 2).bit_length()
        raw = np.full((count, n), 256)
        inside = np.arange(n) < lengths[:, None]
        raw[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        raw = raw.T
        made = self.made_array
        symbols, alive = self.single_array[raw].ravel(), inside.T.copy().ravel()  # row by row, as all that follows
        tree = np.full((2 * width, count), NONE)
        r = self.pairs[raw[:-1], raw[1:]]
        tree[width : width + n - 1] = np.where(r >= 0, r * width + np.arange(n - 1)[:, None], NONE)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
        tree = tree.ravel()
        after = np.repeat(np.arange(1, n + 2), count)  # row n is the end
        before = np.repeat(np.arange(-1, n), count)
        column = np.arange(count)
        while len(column := column[(top := tree[count + column]) < NONE]):
            r, i = np.divmod(top[top < NONE], width)
            gone = after[i * count + column]
            k = after[gone * count + column]
            own = made[r]
            symbols[i * count + column], after[i * count + column], alive[gone * count + column] = own, k, False
            before[k * count + column] = i
            j = before[i * count + column]
            right, left = k < lengths[column], np.flatnonzero(j >= 0)
            first = self.leaf(own, np.where(right, symbols[np.minimum(k, n - 1) * count + column], -1), i, width)
            j, by = j[left], column[left]
            at = np.concatenate([np.minimum(gone, width - 1), np.minimum(i, width - 1), j]) + width
            where = np.concatenate([column, column, by])
            m = len(column)
            tree[at[:m] * count + column] = NONE  # the pair that began at the merged symbol is gone
            tree[at[m : 2 * m] * count + column] = first
            tree[at[2 * m :] * count + by] = self.leaf(symbols[j * count + by], own[left], j, width)
            while at[0] > 1:
                at = at >> 1
                below = 2 * at * count + where
                tree[at * count + where] = np.minimum(tree[below], tree[below + count])
        symbols, alive = symbols.reshape(n, count), alive.reshape(n, count)
        ids = symbols.T[alive.T].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(alive.sum(0))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def leaf(self, a: np.ndarray, b: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
        """The leaves of pairs of symbols; -1 is no symbol."""
        keys = np.where((a < 0) | (b < 0), -1, a * self.size + b)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.ranks[at] * width + place, NONE)

    def learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into `known`."""
        sizes: dict[int, list[str]] = {}
        for piece in pieces:
            sizes.setdefault(len(piece.encode()), []).append(piece)
        groups: dict[int, list[str]] = {}
        for n, own in sizes.items():
            if 2 <= n <= SHORT:
                groups.setdefault((n - 2).bit_length(), []).extend(own)
            else:
                self.known.update((p, np.array(self.merged(p.encode()), np.int32).tobytes()) for p in own)
        for own in groups.values():
            self.known.update(zip(own, self.merged_side_by_side([p.encode() for p in own]), strict=True))

    def parts(self, text: str) -> Iterator[str | bytes]:
        """A text in parts that the pattern never reaches across: it cuts before a space between two letters or digits.
        Strings of added tokens become these tokens' ids."""
        start, spots = 0, [*self.special.finditer(text)] if self.special else []
        for found in [*spots, None]:
            end = found.start() if found else len(text)
            while end - start > PART and (cut := SAFE.search(text, start + PART, end)):
                yield text[start : cut.start() + 1]
                start = cut.start() + 1
            if end > start:
                yield text[start:end]
            if found:
                yield self.added[found.group()]
                start = found.end()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each whole text, as 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str] | bytes]] = []
        size = 0

        def flush() -> None:
            pieces = set().union(*(own for _, own in held if isinstance(own, list)))
            new = pieces.difference(self.known)
            if len(self.known) + len(new) > KNOWN:
                self.known.clear()
                new = pieces
            self.learn(new)
            known = self.known.__getitem__
            for i, own in held:
                out[i].append(b"".join(map(known, own)) if isinstance(own, list) else own)
            for p in [p for p in new if len(p) > SHORT]:
                del self.known[p]
            held.clear()

        for i, text in enumerate(texts):
            for part in self.parts(text):
                held.append((i, self.cut.findall(part) if isinstance(part, str) else part))
                size += len(part)
                if size >= PART:
                    flush()
                    size = 0
        flush()
        return [b"".join(own) for own in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special ones too; ids that aren't in the vocabulary are passed over, bytes that are no UTF-8 are replaced."""
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids[(ids >= 0) & (ids < self.size)].tolist()]).decode("utf-8", "replace")


SAFE = regex.compile(r"[\p{L}\p{N}] (?=[\p{L}\p{N}])")


@lru_cache(2)  # a worker keeps it from task to task
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each whole text under a `tokenizers` file with byte-level BPE, without special tokens
    added, neither padded nor cut.

    A null or empty text has no ids (an empty array). Rows with a null or repeated doc_id are encoded like any other; an
    empty table gives an empty one. Other columns are not looked at. No merge depends on another row, so nothing is
    shuffled; a piece of n bytes takes n log n steps, however long it is."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            own = bpe.encode([text or "" for text in batch.column(1).to_pylist()])
            ends = np.cumsum([0, *(len(x) // 4 for x in own)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(own), np.int32)))], names=["doc_id", "ids"])
        bpe.known.clear()

    return in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decoded(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """rows (doc_id, ids) with text: what the ids say, special tokens included. Null ids are an empty text."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            texts = [bpe.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return in_small_batches(rows).select("doc_id", "ids").mapInArrow(tidy(run), "doc_id long, ids array<int>, text string")
