"""Scores of whole documents under a gated recurrent language model learned from the corpus.

Token counts cover all training documents. The most frequent tokens are the model's own; any other is the model's
unknown token, times its share of all unknown ones, so the probabilities of all words sum to one. Every training document
is trained on once, in rounds: in each, every partition trains a copy on its part of them, and the copies are averaged.
"""

from __future__ import annotations

import io
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.llm import gru
from doseframe.llm.base import in_small_batches, texts_as_bytes, tidy, written

#: The end's place among the words; no word holds white space.
END_WORD = b"\n"
#: Tokens of the model, the unknown one and the end among them, at least. More are those that occur OFTEN, as many as
#: GROWN, or where that is more, twice the square root of the corpus's tokens: a pass's time grows with its square root.
VOCABULARY, OFTEN, GROWN = 1024, 50, 2048
TABLE = 1 << 19  # most frequent tokens whose counts are broadcast; the others' counts are joined
SHARDS, SHARD_TOKENS, ROUNDS = 4, 2_000_000, 3  # copies at least, tokens that one trains on at once, rounds in one pass
FOLD = 16  # copies that a task averages
CODED_TOKENS = 200_000  # tokens that are looked up together
HELD_TOKENS, HELD_DOCS = 4_000_000, 12_000


def tokens(text: bytes | None) -> list[bytes]:
    """Words of the text with A-Z in lower case, and the end."""
    return [*text.lower().split(), END_WORD] if text else [END_WORD]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n): 64-bit hashes of all tokens and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            h = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held))
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in batches:
            for t in texts_as_bytes(batch.column(0)):
                held.update(tokens(t))
                if len(held) >= 150_000:
                    yield sent()
        if held:
            yield sent()

    return texts.mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Table:
    """Places of words among the broadcast tokens, -1 for others; remembered up to a bounded number of words."""

    def __init__(self, hashes: np.ndarray, most: int = 200_000):
        self.hashes, self.most, self.known = hashes, most, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) >= self.most:
            self.known.clear()
        new = list(set(words).difference(self.known))
        h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        at = np.where(self.hashes[at] == h, at, -1) if len(self.hashes) else np.full(len(new), -1)
        self.known.update(zip(new, at.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))


class Model:
    """Broadcast part of the model. hashes: sorted; counts: of these; ids: their tokens, unknown where the model has none."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.distinct = total, distinct
        best = np.lexsort((self.hashes, -self.counts))[: max(VOCABULARY - 1, min(int(np.count_nonzero(self.counts >= OFTEN)), max(GROWN, int(2 * total**0.5))))]
        known = int(self.counts[best].sum())
        self.rest = total - known + distinct - len(best) + 1  # of counts and types beyond the model's own, and the unseen one
        n = np.append(self.counts[best], total - known)
        rank = np.empty(len(n), np.int64)
        rank[np.argsort(-n, kind="stable")] = np.arange(len(n))
        self.unknown = int(rank[-1])
        self.ids = np.full(len(hashes) + 1, self.unknown, np.int64)  # the last: words that aren't here
        self.ids[best] = rank[:-1]
        end = int(np.searchsorted(self.hashes, np.uint64(xxhash.xxh64_intdigest(END_WORD)))) if len(hashes) else 0
        self.end = int(self.ids[min(end, len(hashes))])
        self.params = gru.new(n[np.argsort(-n, kind="stable")])


def unpacked_params(raw: bytes) -> gru.Params:
    return dict(np.load(io.BytesIO(raw)))


def packed_params(p: gru.Params) -> bytes:
    out = io.BytesIO()
    np.savez(out, **p)
    return out.getvalue()


def coded(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs (doc_id, text, held_out) as numbers: row, doc_id, held_out, round (of training), n_tokens, known (of the
    broadcast tokens), base (what they add to base_score), more (to score, beside the model's), ids (the model's tokens), rare
    (hashes of tokens that aren't broadcast)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table, row = Table(model.hashes), TaskContext.get().partitionId() << 40
        logs = np.append(np.log10(model.counts + 1.0), 0.0)
        common, rest = float(np.log10(model.total + model.distinct + 1.0)), float(np.log10(model.rest))

        def sent(own: pa.RecordBatch, held: list[list[bytes]]) -> pa.RecordBatch:
            nonlocal row
            words = [w for d in held for w in d]
            at, sizes = table.of(words), np.fromiter(map(len, held), np.int64, len(held))
            starts = np.cumsum(sizes) - sizes  # every document has its end at least
            per = lambda x: np.add.reduceat(x, starts)
            ids, gone = model.ids[at], np.flatnonzero(at < 0)
            unknown = ids == model.unknown
            rare = np.fromiter((xxhash.xxh64_intdigest(words[i]) for i in gone.tolist()), np.uint64, len(gone)).view(np.int64)
            more = per(np.where(unknown, logs[at] - rest, 0.0)) if model.total else np.zeros(len(held))
            rows = np.arange(row, row + len(held))
            row += len(held)
            lists = lambda ends, flat: pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(flat))
            columns = [rows, rows % 27_720, sizes, per((at >= 0).astype(np.int64)), per(logs[at]) - sizes * common, more]
            return pa.RecordBatch.from_arrays(
                [own.column(0), own.column(2), *map(pa.array, columns), lists(starts + sizes, ids.astype(np.int32)), lists(np.cumsum(per((at < 0).astype(np.int64))), rare)],
                names=["doc_id", "held_out", "row", "round", "n_tokens", "known", "base", "more", "ids", "rare"],
            )

        for batch in batches:
            first, size, held = 0, 0, []
            for i, t in enumerate(texts_as_bytes(batch.column(1))):
                held.append(tokens(t))
                size += len(held[-1])
                if size >= CODED_TOKENS:
                    yield sent(batch.slice(first, len(held)), held)
                    first, size, held = i + 1, 0, []
            if held:
                yield sent(batch.slice(first), held)

    fields = "doc_id long, held_out boolean, row long, round long, n_tokens long, known long, base double, more double, ids array<int>, rare array<long>"
    return docs.select("doc_id", "text", "held_out").mapInArrow(tidy(run), fields)


def documents_of(ids: pa.Array) -> list[np.ndarray]:
    ends = np.cumsum(ids.value_lengths().to_numpy())
    return np.split(ids.flatten().to_numpy(), ends[:-1]) if len(ends) else []


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition's (n, params): the tokens of all copies, and the copies' mean by tokens."""
    total, mean = 0, {}
    for batch in batches:
        for n, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own, total = unpacked_params(raw.as_py()), total + n
            mean = gru.mean([mean, own], [total - n, n]) if mean else own
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([packed_params(mean)], pa.binary())], names=["n", "params"])


def trained(model: Model, docs: DataFrame, rounds: int) -> tuple[gru.Params, int]:
    """The model's parameters after rounds of training on docs (round, ids), each document in its round, and the tokens seen.

    Each partition trains a copy, buffer by buffer; the copies are averaged FOLD at a time on the executors after each round."""
    spark, params, seen = docs.sparkSession, model.params, 0
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast((params, model.end))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            (params, end), held, size, total = shared.value, [], 0, 0
            for batch in batches:
                held += documents_of(batch.column(0))
                size += len(batch.column(0).flatten())
                if size >= SHARD_TOKENS:
                    params, total = gru.train(params, held, end), total + size
                    held, size = [], 0
            if held:
                params, total = gru.train(params, held, end), total + size
            if total:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([packed_params(params)], pa.binary())], names=["n", "params"])

        own = docs.where(F.col("round") % rounds == turn).select("ids")
        got = written(own.mapInArrow(tidy(run), "n long, params binary"), "lm-params")
        while (parts := got.count()) > 1:
            got = written(got.coalesce(-(-parts // FOLD)).mapInArrow(tidy(averaged), "n long, params binary"), "lm-params")
        if (last := got.first()) is not None:
            seen, params = seen + last.n, unpacked_params(last.params)
    return params, seen


def counted(counts: DataFrame) -> Model:
    """The model of the counts, before training."""
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("n") * 16).cast("int")  # so many a doubling: a thousand at most
    above, least = 0, 0
    for step, n in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect(), reverse=True):
        if above + n > TABLE:
            least = step + 1
            break
        above += n
    top = counts.where(level >= least).toArrow()
    return Model(top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy(), total, distinct)


def fit(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model learned from the rows of docs (doc_id, text, held_out) that aren't held out, and their counts; and all docs coded."""
    model = counted(counts)
    rows = written(coded(docs, model), "lm-coded")
    shards = max(SHARDS, -(-model.total // (rounds * SHARD_TOKENS)))
    model.params, model.trained_tokens = trained(model, rows.where("not held_out").select("round", "ids").coalesce(shards), rounds)
    return model, rows


def scored(rows: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every coded row."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kept = ["doc_id", "held_out", "row", "n_tokens", "known", "base", "more", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, docs, size = shared.value, [], [], 0

        def sent() -> Iterator[pa.RecordBatch]:
            found, i = gru.scores(model.params, docs, model.end) / np.log(10) if model.total else np.zeros(len(docs)), 0
            for b in held:
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found[i : i + b.num_rows])], names=[*kept, "lm"])
                i += b.num_rows
            held.clear()
            docs.clear()

        for batch in batches:
            held.append(batch)
            docs += documents_of(batch.column(len(kept)))
            size += len(batch.column(len(kept)).flatten())
            if size >= HELD_TOKENS or len(docs) >= HELD_DOCS:
                yield from sent()
                size = 0
        if docs:
            yield from sent()

    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", lm double"
    first = written(rows.select(*kept, "ids").mapInArrow(tidy(run), fields), "lm-scores")
    # what the broadcast counts don't have adds log10(n + 1) to both scores
    found = first.select("row", F.explode("rare").alias("token")).join(counts, "token").groupBy("row").agg(F.count("*").alias("also"), F.sum(F.log10(F.col("n") + 1.0)).alias("log"))
    both = first.drop("rare").join(found, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    known = F.col("known") + F.coalesce("also", F.lit(0))
    return both.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("base") + log).alias("base_score"), (F.col("lm") + F.col("more") + log).alias("score"))


def language_model(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Learns from the rows of docs that aren't held out and scores all rows, whole texts.

    base_score sums log10((c + 1) / (N + V + 1)) over the tokens, score is the model's log10 probability. A null or empty
    text is the end alone. A null doc_id isn't held out and stays null; repeated rows count and are scored each. Without
    training rows both scores are 0; an empty table gives an empty one. Other columns are not looked at."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    counts = written(token_counts(docs.where("not held_out").select("text")), "lm-counts")
    model, rows = fit(docs, counts, rounds)
    return scored(rows, model, counts)
