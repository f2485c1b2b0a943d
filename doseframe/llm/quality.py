"""Quality and toxicity by hierarchical empirical Bayes.

Naive Bayes on words and measures of style gives each document's own evidence. Labelled shares of each host (source) are
shrunk toward the global share, and those of each path (source and language) toward their host's; how far follows from
how much the shares differ beyond chance. Posterior log odds: the global prior, the site's shift, the evidence.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import in_small_batches, texts_as_bytes, written

EDGES = b"".join(bytes([i]) for i in range(33, 127) if not chr(i).isalnum())
#: Features that count: seen in so many labelled documents, so many standard errors from no association, and with such a
#: log likelihood ratio at least (weak ones are many, depend on each other, and add up); how many, at most.
LEAST, SIGMAS, RATIO, MOST = 8, 4.0, 1.5, 20_000
TARGETS = ("quality", "toxic")
#: Probabilities from which a document is good and toxic; the latter is high, as a clean document wrongly called toxic is lost.
GOOD, TOXIC = 0.5, 0.9
#: Labelled documents the words and measures of style are learned from, about; sites' shares cover all of them.
SAMPLE = 50_000


def style(text: bytes, words: list[bytes]) -> list[str]:
    """Measures of a text's form, each as the name of one of its classes."""
    n = max(1, len(words))
    size = max(1, len(text))
    letters = len(text.translate(None, bytes(i for i in range(128) if not chr(i).isalpha())))
    upper = size - len(text.translate(None, bytes(range(65, 91))))
    marks = size - len(text.translate(None, b"#$%&*!|<>{}[]=_~^\\/@"))
    digits = size - len(text.translate(None, b"0123456789"))
    most = Counter(words).most_common(1)[0][1] if words else 0
    shares = {"letters": letters / size, "upper": upper / max(1, letters), "marks": marks / n, "digits": digits / size, "most": most / n if n > 20 else 0, "distinct": len(set(words)) / n**0.8}
    return [f"{k}:{min(9, int(v * 10))}" for k, v in shares.items()]


def features(text: bytes | None) -> np.ndarray:
    """Hashes of the distinct words (A-Z lower-cased, without marks at their edges) and of the style classes."""
    words = text.split() if text else []
    names = {w.strip(EDGES) for w in text.lower().split()} if text else set()
    names.discard(b"")
    out = [xxhash.xxh64_intdigest(w) for w in names]
    return np.array(out + [xxhash.xxh64_intdigest(s, 1) for s in (style(text, words) if words else ["empty"])], np.uint64)


def feature_counts(labelled: DataFrame) -> DataFrame:
    """(feature, n, quality, toxic): labelled documents with each feature, all, good and toxic ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int]] = []
        size = 0

        def sent() -> pa.RecordBatch:
            every, at = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
            columns = [np.bincount(at, np.repeat([x[k] if k else 1 for x in held], [len(x[0]) for x in held]), len(every)).astype(np.int64) for k in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, columns)], names=["feature", "n", *TARGETS])

        for batch in batches:
            for text, q, t in zip(texts_as_bytes(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append((features(text), q, t))
                size += len(held[-1][0])
                if size > 1_000_000:
                    yield sent()
                    held.clear()
                    size = 0
        if held:
            yield sent()

    counts = labelled.select("text", "quality", "toxic").mapInArrow(run, "feature long, n long, quality long, toxic long")
    return counts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])


def weights(counts: DataFrame, docs: int, good: dict[str, int]) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per target the features that count, sorted, and their log likelihood ratios; the driver gets MOST rows at most."""
    out = {}
    for t in TARGETS:
        yes, no = good[t], docs - good[t]
        share = F.col("n") / F.lit(float(max(1, docs)))
        sigma = (F.col(t) - F.lit(float(yes)) * share) / F.sqrt(F.lit(float(max(1, yes * no))) / F.lit(float(max(1, docs))) * share * F.greatest(1 - share, F.lit(1e-9)) + 1e-9)
        ratio = F.log((F.col(t) + 0.5) / F.lit(yes + 1.0)) - F.log((F.col("n") - F.col(t) + 0.5) / F.lit(no + 1.0))
        rows = counts.where((F.col("n") >= LEAST) & (F.abs(sigma) >= SIGMAS) & (F.abs(ratio) >= RATIO)).select("feature", ratio.alias("w"), F.abs(sigma).alias("s")).orderBy(F.desc("s"), "feature").limit(MOST).toArrow()
        keys, w = rows.column("feature").to_numpy().view(np.uint64), rows.column("w").to_numpy()
        order = np.argsort(keys)
        out[t] = keys[order], w[order]
    return out


def strength(groups: DataFrame, yes: str, expected: Column) -> float:
    """How many observations the prior of groups (n, yes) weighs: from the variance of their shares beyond chance.

    Moments over groups weighted by n: the squared distance from the expected share, less what chance alone makes."""
    gap = F.col(yes) / F.col("n") - expected
    chance = expected * (1 - expected)
    n, count, spread, noise, base = groups.agg(F.sum("n"), F.count("*"), F.sum(F.col("n") * gap * gap), F.sum(chance), F.sum(F.col("n") * chance)).first()
    if not n or count < 2:
        return 100.0
    between = max((spread - noise) / n, 1e-6)
    return min(1e4, max(1.0, base / n / between - 1))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic and kept (good and not toxic, by GOOD and TOXIC) for every row of docs.

    Learns from the rows of docs (doc_id, text, lang, source) with a label (doc_id, quality, toxic): the evidence from about
    SAMPLE of them, drawn by doc_id, the sites' shares from all. Null labels, label rows
    without their document and all but one of several labels of a document are left out (of these the least good, most toxic
    counts). A null text has no words; a null source or lang is a site of its own; a null doc_id stays null. Repeated rows are
    scored each. Without labels every document has even odds and is kept. An empty table gives an empty one; other
    columns are not looked at."""
    docs = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"))
    known = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 24)) < int(share * (1 << 24)) + 1)
    marked = docs.join(F.broadcast(drawn), "doc_id")  # about SAMPLE rows of three numbers at most: the texts stay where they are
    counts = written(feature_counts(marked), "quality-features")
    fitted, *fit_good = (int(x or 0) for x in marked.agg(F.count("*"), *[F.sum(t) for t in TARGETS]).first())
    sites = written(docs.select("doc_id", "source", "lang").join(known, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("toxic").alias("toxic")), "quality-sites")
    total, *good = (int(x or 0) for x in sites.agg(F.sum("n"), *[F.sum(t) for t in TARGETS]).first())
    prior = {t: min(0.999, max(0.001, (g + 0.5) / (total + 1))) for t, g in zip(TARGETS, good, strict=True)}
    model = docs.sparkSession.sparkContext.broadcast(weights(counts, fitted, dict(zip(TARGETS, fit_good, strict=True))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list[float]] = {t: [] for t in TARGETS}
            for text in texts_as_bytes(batch.column(3)):
                f = features(text)
                for t, (keys, w) in model.value.items():
                    at = np.searchsorted(keys, f)
                    at[at == len(keys)] = 0
                    found[t].append(float(w[at[keys[at] == f]].sum()) if len(keys) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(found[t], pa.float64()) for t in TARGETS)], names=["doc_id", "source", "lang", *TARGETS])

    evidence = docs.select("doc_id", "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, quality double, toxic double")
    hosts = sites.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("n", *TARGETS)])
    out = evidence
    shifts = sites.select("source", "lang")
    for t in TARGETS:
        mean = F.lit(prior[t])
        s = strength(hosts, t, mean)
        host = hosts.select("source", ((F.col(t) + s * mean) / (F.col("n") + s)).alias("host"))
        path = sites.join(host, "source")
        s = strength(path, t, F.col("host"))
        post = path.select("source", "lang", (logit((F.col(t) + s * F.col("host")) / (F.col("n") + s)) - logit(mean)).alias(f"{t}_shift"))
        shifts = shifts.join(post, ["source", "lang"])
        host = host.select("source", (logit(F.col("host")) - logit(mean)).alias(f"{t}_host"))
        out = out.join(host, "source", "left")
    out = out.join(shifts, ["source", "lang"], "left")
    odds = {t: F.lit(math.log(prior[t] / (1 - prior[t])) if total else 0.0) + F.col(t) + F.coalesce(f"{t}_shift", f"{t}_host", F.lit(0.0)) for t in TARGETS}
    p = {t: 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds[t])))) for t in TARGETS}
    kept = (p["quality"] >= GOOD) & (p["toxic"] < TOXIC) if total else F.lit(True)
    return out.select("doc_id", p["quality"].alias("p_quality"), p["toxic"].alias("p_toxic"), kept.alias("kept"))
