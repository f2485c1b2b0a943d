import random
import re
from collections import Counter

import numpy as np
from compare import duck, expected, rows
from pyspark.sql import types as T

from doseframe.llm import collocations, queries

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n", T.StringType())])


def plain(docs, least, most, percent=100, deepest=5):
    """All phrases of all pieces, counted and cut one by one."""
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", folded):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, deepest + 1) for i in range(len(w) - k + 1))
    good = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = []
    for lang in n:
        own = {w: a for (x, w), a in good.items() if x == lang}
        dropped = {w[i : i + k] for w, longer in own.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * longer >= percent * own[w[i : i + k]]}
        scored = []
        for w in own.keys() - dropped:
            a = own[w]
            score, _, left, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            scored.append((-score, -a, " ".join(w).encode(), left, r))
        out += [(lang, i + 1, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(scored)[:most])]
    return Counter(out)


def texts(seed, count):
    r = random.Random(seed)
    words = ["The", "the", "a", "of", "é", "É", "x y", "A"] + [f"w{i}" for i in range(12)]
    out = []
    for _ in range(count):
        own = words[: r.randint(1, len(words))]
        out.append(("".join(r.choice(own) + r.choice([" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", "; "]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und"])))
    return out + [("a a a a a a a", "en")] * 30 + [("one hot lead " + " ".join(r.choice(words) for _ in range(4)), "hot") for _ in range(200)] + [(None, "en"), ("", None), (" .,\n", "fr")]


def got(spark, docs, **options):
    d = spark.createDataFrame([(i, *x, "x", "y") for i, x in enumerate(docs)], SCHEMA).repartition(3)
    return Counter(map(tuple, collocations.collocations(d, **options).collect()))


def test_against_all_phrases(spark, monkeypatch):
    """Overlaps, ties, both kinds of blanks, null languages and texts, repeated rows, empty tables; hot leads and none."""
    docs = texts(1, 250)
    assert got(spark, docs, least=10, most=2000) == plain(docs, 10, 2000)
    monkeypatch.setattr(collocations, "HOT_SHARE", 10**9)  # all leads are hot
    assert got(spark, docs, least=6, most=25) == plain(docs, 6, 25)
    monkeypatch.setattr(collocations, "HOT_SHARE", 1)
    assert got(spark, docs, least=10, most=30, percent=80) == plain(docs, 10, 30, 80)
    assert got(spark, docs, least=10, most=30, deepest=3) == plain(docs, 10, 30, deepest=3)
    assert got(spark, []) == got(spark, [(None, "en"), ("one two", None)]) == Counter()


def test_scores_beyond_64_bits(spark):
    """The same exact division as the operator's, on counts of a very large corpus."""
    big = 10**16 + 7
    row = spark.createDataFrame([(big, big * 9, big + 11, big + 5)], "a long, n long, l long, r long")
    text = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"
    assert row.selectExpr(f"{text} AS s").first()[0] == 1000 * big * big * 9 // ((big + 11) * (big + 5))


def test_partitions_are_the_groups():
    r = np.random.default_rng(3)
    rows = np.where(np.arange(6) < r.integers(1, 7, 3000)[:, None], r.zipf(1.6, (3000, 6)) % 9, -1).astype(np.int32)
    weights = r.integers(1, 5, 3000)
    for least in (1, 40):
        want = Counter()
        for row, w in zip(rows.tolist(), weights.tolist(), strict=True):
            for d in range(1, 7):
                if row[d - 1] >= 0:
                    want[tuple(row[:d])] += w
        found = {}
        for depth, pointers, sizes in collocations.equal_partitions(np.ascontiguousarray(rows.T), weights, least):
            for p, n in zip(pointers.tolist(), sizes.tolist(), strict=True):
                assert tuple(rows[p, :depth].tolist()) not in found
                found[tuple(rows[p, :depth].tolist())] = n
        assert found == {k: n for k, n in want.items() if n >= least}
    assert list(collocations.equal_partitions(np.zeros((3, 0), np.int32), np.zeros(0), 1)) == []


def test_long_texts_in_parts():
    text = ("Ab cd. ef\tgh, " * 50).encode()
    whole = collocations.Numbers().of(text)
    was, collocations.PART = collocations.PART, 7
    try:
        assert collocations.Numbers().of(text).tolist() == whole.tolist()
    finally:
        collocations.PART = was


def test_query(spark):
    """At sf0.01, where there are phrases."""
    want = expected(duck("/root/testdata/sf0.01"), queries.OP11)
    assert len(want) > 20
    assert rows(queries.op11_collocations(spark, "/root/testdata/sf0.01")) == want
