"""Phrases that are said together more often than by chance, counted by multikey three-way quicksort of suffix pointers.

A first pass counts words, and pairs of neighbours by hashes. In the second every word is the start of a suffix, as deep
as its pairs are frequent. Suffixes are put together within tasks, routed by their leading words, and sorted there: a
partition whose words are equal to some depth is a phrase, and its size the phrase's count; one too small is abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doseframe.llm import sketch
from doseframe.llm.base import STEP, in_small_batches, joined, mix, texts_as_bytes, tidy, written

DEEPEST, LEAST = 5, 100
FILTER_BITS = 27
#: Words that are worked on together, words that a task remembers, pointers that a sorting task gets (about), bytes of text
#: that are split at a time, parts in which a language's phrases are ranked first.
GROUP, KNOWN, POINTERS, PART, SALTS = 1 << 21, 250_000, 4_000_000, 4 << 20, 64
#: A lead of more than this share of all pointers is dealt out by its whole suffixes.
HOT_SHARE = 1000
#: Blanks part words, a full stop parts pieces (and is no part of words); letters are folded.
FOLD = bytes(46 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class Numbers(dict):
    """Words and their numbers; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({b".": 0})
        self.hashes = np.zeros(1, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, text: bytes) -> np.ndarray:
        folded, out, start = text.translate(FOLD), [], 0
        while start < len(folded):
            end = folded.find(b" ", start + PART)
            end = len(folded) if end < 0 else end
            words = folded[start:end].replace(b".", b" . ").split()
            out.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            start = end
        return np.concatenate([*out, np.zeros(1, np.int32)])

    def hashed(self) -> np.ndarray:
        """A hash of each word, by its number."""
        if len(self.hashes) < len(self):
            new = [*self][len(self.hashes) :]
            self.hashes = np.append(self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new)))
        return self.hashes


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Numbers, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about GROUP words: the words' numbers, the languages there are, each word's language and number,
    and the hash of the pair that each word begins (0 at the end of a piece)."""
    numbers, held, size = Numbers(), [], 0

    def group():
        names = [*dict.fromkeys(lang for lang, _ in held)]
        of = {lang: i for i, lang in enumerate(names)}
        ids = np.concatenate([x for _, x in held])
        langs = np.repeat(np.array([of[lang] for lang, _ in held]), [len(x) for _, x in held])
        h, own = numbers.hashed(), np.array([xxhash.xxh64_intdigest(lang, 1) for lang in names], np.uint64)
        next_ = np.append(ids[1:], 0).astype(np.int32)
        pairs = mix(h[ids] * np.uint64(STEP) + mix(h[next_] ^ own[langs]))
        pairs[(ids == 0) | (next_ == 0)] = 0
        return numbers, names, langs, ids, pairs

    for batch in batches:
        for lang, text in zip(texts_as_bytes(batch.column(0)), texts_as_bytes(batch.column(1)), strict=True):
            if text:
                ids = numbers.of(text)
                held.append((lang, ids))
                size += len(ids)
            if size >= GROUP:
                yield group()
                held, size = [], 0
                if len(numbers) > KNOWN:
                    numbers = Numbers()
    if held:
        yield group()


def counted(docs: DataFrame, least: int) -> DataFrame:
    """(lang, key, n): words of at least `least` occurrences in a language; without a key all words of the language; without a
    language hashes (8 bytes) of pairs of at least `least` occurrences, more only where hashes coincide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for numbers, names, langs, ids, pairs in groups(batches):
            words, width = [*numbers], len(numbers)
            key, n = np.unique((langs * width + ids)[ids > 0], return_counts=True)
            own = pa.array(names, pa.binary()).cast(pa.string())
            total = np.bincount(langs[ids > 0], minlength=len(names))
            for at in range(0, len(key), 50_000):
                part = key[at : at + 50_000]
                yield batch_of(own.take(pa.array(part // width)), pa.array([words[i] for i in (part % width).tolist()], pa.binary()), n[at : at + 50_000])
            yield batch_of(own, pa.nulls(len(names), pa.binary()), total)
            key, n = np.unique(pairs[pairs != 0], return_counts=True)
            for at in range(0, len(key), 200_000):
                part = key[at : at + 200_000]
                raw = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(np.arange(0, 8 * len(part) + 8, 8, dtype=np.int32)), pa.py_buffer(part.tobytes())])
                yield batch_of(pa.nulls(len(part), pa.string()), raw, n[at : at + 200_000])

    def batch_of(lang: pa.Array, key: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([lang, key, pa.array(n.astype(np.int64))], names=["lang", "key", "n"])

    sums = docs.mapInArrow(tidy(run), "lang string, key binary, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    return written(sums.where((F.col("n") >= least) | F.col("key").isNull()), "collocations-counts")


BLOCKS = "bucket int, langs array<string>, words array<binary>, lang binary, ids binary, hot binary, n binary"


def suffixes(docs: DataFrame, pairs: DataFrame, total: int, deepest: int, buckets: int) -> DataFrame:
    """The suffixes of frequent pairs, to `deepest` words or the first pair that isn't frequent, and how often a task has each:
    a block a bucket of leads, with its own words and, for each suffix, their places (int32, -1 beyond its end), its
    language's place (int32), whether its lead is hot (a byte), and its count (int64).

    The bucket is that of the leading pair's hash; of hot leads, of the whole suffix's hash."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from sketch.partial(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64), 1, FILTER_BITS)

    filter_ = sketch.Sketch(sketch.merged(pairs.select("key").mapInArrow(tidy(cells), sketch.CELLS), 1, FILTER_BITS), 1, FILTER_BITS)
    hot = np.sort(np.array([int.from_bytes(k, "little") for (k,) in pairs.where(F.col("n") * HOT_SHARE > total).select("key").collect()], np.uint64))  # HOT_SHARE keys at most
    spread = docs.sparkSession.sparkContext.broadcast((filter_, hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, hot = spread.value
        for numbers, names, langs, ids, pairs in groups(batches):
            good = np.zeros(len(ids) + deepest, bool)
            some = np.flatnonzero(pairs)
            good[some] = filter_.reached(pairs[some])
            at = np.flatnonzero(good)
            depth = np.ones(len(at), np.int64)
            open_ = np.ones(len(at), bool)
            for d in range(deepest - 1):
                open_ &= good[at + d]
                depth += open_
            width, padded = len(numbers), np.append(ids, np.zeros(deepest, np.int32)).astype(np.int64)
            rows = np.stack([np.where(d < depth, padded[at + d], 0) for d in range(deepest)], axis=1)
            code = langs[at]
            for d in range(deepest):  # equal suffixes get equal numbers, one word more at a time
                code = np.unique(code * width + rows[:, d], return_inverse=True)[1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            rows, lang, route = rows[first], langs[at[first]], pairs[at[first]]
            warm = np.isin(route, hot)
            route = np.where(warm, gram_sums(numbers.hashed()[rows]), route)
            bucket = (mix(route) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = [*np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)]
            words, out = [*numbers], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                own = order[a:b]
                used, place = np.unique(rows[own], return_inverse=True)
                place = np.where(rows[own] > 0, place.reshape(rows[own].shape) - (used[0] == 0), -1).astype(np.int32)
                out.append((int(bucket[own[0]]), names_of(names), [words[i] for i in used[used > 0].tolist()], lang[own].astype(np.int32).tobytes(), place.tobytes(), warm[own].tobytes(), n[own].astype(np.int64).tobytes()))
                if len(out) >= 64 or b == len(order):
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), KINDS, strict=True)], names=NAMES)
                    out = []

    return docs.mapInArrow(tidy(run), BLOCKS)


KINDS = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.binary()), *[pa.binary()] * 4)
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def names_of(langs: list[bytes]) -> list[str]:
    return [x.decode() for x in langs]


def gram_sums(hashes: np.ndarray) -> np.ndarray:
    """A hash of each row of words' hashes."""
    out = np.zeros(len(hashes), np.uint64)
    for column in hashes.T:
        out = mix(out * np.uint64(STEP) + column)
    return out


def equal_partitions(columns: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers to the columns' rows: (depth, pointers, sizes) of the partitions that are equal
    to each depth (from 1) and weigh `least` or more. Lighter partitions are abandoned at once; a negative value ends a row.

    All open partitions of a depth are parted around their pivots side by side: smaller and larger ones stay, equal ones
    go to the next depth."""
    pointers, sizes = np.arange(columns.shape[1]), np.array([columns.shape[1]])
    for depth, column in enumerate(columns, 1):
        deeper: list[tuple[np.ndarray, np.ndarray]] = []
        while len(pointers):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            ends_of = np.sort(column[pointers[[starts, (starts + ends) // 2, ends - 1]]], axis=0)
            pivots = ends_of[1]
            side = np.sign(column[pointers] - np.repeat(pivots, sizes))
            owner = np.repeat(np.arange(len(sizes)), sizes)
            rest: list[tuple[np.ndarray, np.ndarray]] = []
            for which in (-1, 1, 0):
                on = side == which
                weight = np.bincount(owner[on], weights[pointers[on]], len(sizes))
                keep = weight >= least
                if which == 0:
                    keep &= pivots >= 0
                on &= keep[owner]
                if on.any():
                    (rest if which else deeper).append((pointers[on], np.bincount(owner[on], minlength=len(sizes))[keep]))
                    if which == 0:
                        own = deeper[-1]
                        yield depth, own[0][np.cumsum(own[1]) - own[1]], weight[keep].astype(np.int64)
            pointers, sizes = (np.concatenate(x) for x in zip(*rest, strict=True)) if rest else (pointers[:0], sizes[:0])
        pointers, sizes = (np.concatenate(x) for x in zip(*deeper, strict=True)) if deeper else (pointers[:0], sizes[:0])


def phrases(rows: DataFrame, partitions: int, least: int, deepest: int) -> DataFrame:
    """(lang, phrase, words, a): phrases of 2 to `deepest` words with at least `least` occurrences.

    Each partition sorts the suffixes of its leads. Leads that are not hot are whole there, and their light partitions are
    abandoned; those of hot leads, of which a partition has a part, are added up afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[bytes, int] = {}
        names: dict[str, int] = {}
        parts, hot, weights = [], [], []
        for batch in batches:
            for _, langs, words, lang, place, warm, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lang_at = np.array([names.setdefault(x, len(names)) for x in langs], np.int32)
                word_at = np.array([*[numbers.setdefault(w, len(numbers)) for w in words], -1], np.int32)  # -1 stays -1
                ids = word_at[np.frombuffer(place, np.int32).reshape(-1, deepest)]
                parts.append(np.column_stack([lang_at[np.frombuffer(lang, np.int32)], ids]))
                hot.append(np.frombuffer(warm, bool))
                weights.append(np.frombuffer(n, np.int64))
        if not parts:
            return
        ids, hot, weights = np.concatenate(parts), np.concatenate(hot), np.concatenate(weights)
        parts.clear()
        words, langs = [*numbers], [*names]
        for own, floor in ((~hot, least), (hot, 1)):
            rows = ids[own]
            for depth, pointers, sizes in equal_partitions(np.ascontiguousarray(rows.T), weights[own], floor):
                if depth > 2:  # the first column is the language
                    found = rows[pointers, :depth].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([langs[f[0]] for f in found], pa.string()), pa.array([b" ".join([words[i] for i in f[1:]]) for f in found], pa.binary()), pa.array(np.full(len(found), depth - 1, np.int32)), pa.array(sizes)], names=["lang", "phrase", "words", "n"])

    found = rows.repartition(partitions, "bucket").mapInArrow(tidy(run), "lang string, phrase binary, words int, n long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def collocations(docs: DataFrame, least: int = LEAST, most: int = 2000, percent: int = 100, deepest: int = DEEPEST) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's `most` highest-scoring phrases of 2 to `deepest` words.

    Takes text and lang of docs. A-Z are folded; pieces end at . , ; : ! ? and line ends, words at blanks and tabs, and
    phrases stay within a piece. n counts the language's words, a the phrase's occurrences, overlapping ones too; a phrase
    of less than `least` is none. A cut after k words gives l and r, the occurrences of both sides, and the score
    floor(1000 a n / (l r)), exact at any size; the lowest-scoring cut counts, the smallest k of equal ones. A phrase goes
    if a longer one of at least `least` holds it and occurs `percent` % as often or more. Equal scores go by a, the higher
    first, then by the phrase's bytes.

    A null language is `und`; null and empty texts have no words; repeated rows count each; other columns are not looked
    at; an empty table gives an empty one. What is broadcast is bounded: a filter of 2**27 bits, and HOT_SHARE leads."""
    docs = in_small_batches(docs).select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    counts = counted(docs, least)
    pairs = counts.where(F.col("lang").isNull())
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // POINTERS))
    found = written(phrases(suffixes(docs, pairs, total, deepest, 4 * n), n, least, deepest), "collocations-phrases")
    text = F.col("phrase").cast("string")
    candidates = found.select("lang", text.alias("phrase"), F.split(text, " ").alias("w"), "a")
    known = candidates.select("lang", "phrase", F.col("a").alias("c")).union(counts.where(F.col("lang").isNotNull() & F.col("key").isNotNull()).select("lang", F.col("key").cast("string"), "n"))
    part = lambda start, length: F.concat_ws(" ", F.slice("w", start, length))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w")).alias("right")), "collocations-cuts")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = written(joined(cuts, known.select("lang", F.col("phrase").alias(side), F.col("c").alias(name)), ["lang", side], "inner", "collocations"), f"collocations-{side}")
    all_ = counts.where(F.col("lang").isNotNull() & F.col("key").isNull()).select("lang", "n")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))")
    scored = joined(cuts, all_, ["lang"], "inner", "collocations-all").withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("m"))
    # within a longer phrase, all phrases between are at least as frequent: those one word longer tell
    inner = candidates.where(F.size("w") > 2).select("lang", F.explode(F.array(part(F.lit(1), F.size("w") - 1), part(F.lit(2), F.size("w")))).alias("phrase"), F.col("a").alias("longer"))
    kept = scored.select("lang", "phrase", "m.*").join(inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer")), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    near = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("at", first).where(F.col("at") <= most)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return near.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
