import math
import random
import re
from collections import Counter

from compare import duck, expected, rows
from conftest import SF
from pyspark.sql import types as T

from doseframe.llm import lexical, queries

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("score", T.StringType()), T.StructField("term", T.LongType())])
ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("rank", T.StringType())])


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def plain(docs, items, most=20):
    """Every item against every document, term by term."""
    counts = [Counter(terms(t)) for _, t in docs]
    n, total, df = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts), Counter(t for c in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 100 - 25 + 25 * sum(c.values()) * n // total if total else 75
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in own.items() if c[t])
            scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(s for s in scored if s[0] < 0)[:most])]
    return Counter(out)


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*x, "x", 1) for x in docs], DOCS).repartition(3)
    return Counter(map(tuple, lexical.ranked(d, spark.createDataFrame([(*x, "x") for x in items], ITEMS), **options).collect()))


def test_against_every_pair(spark, monkeypatch):
    """Ties, repeated rows, nulls, empty texts, terms that items repeat, in one block and in many, with few accumulators."""
    r = random.Random(2)
    words = ["the", "The", "of", "été", "ÉTÉ", "x1", "a-b", "中文", "rare", "don't", " z"] + [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(r.choice(words[: r.randint(2, len(words))]) for _ in range(r.randint(0, n)))
    docs = [(r.choice([None, *range(400)]) if r.random() < 0.1 else i, text(40)) for i in range(400)]
    docs += [(1000 + i, "copy of the same text") for i in range(60)] + [docs[5]] * 3 + [(2000, None), (2001, ""), (2002, "-- !")]
    items = [(i, text(25)) for i in range(40)] + [(100, None), (101, ""), (102, "the the the of"), (3, "rare of"), (None, "of x1"), (103, "copy same text"), (104, "unheard")]
    want = plain(docs, items)
    assert got(spark, docs, items) == want
    assert got(spark, docs, items, most=3) == plain(docs, items, 3)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    assert got(spark, docs, items) == want
    # a task unpickles the module's functions by reference, so small limits inside tasks are tried on the parts
    for limit in (1, 7):
        assert [t for own in lexical_parts("The éa, of  x" * 5, limit) for t in own] == [t.encode() for t in terms("The éa, of  x" * 5)]
    assert got(spark, [], items) == got(spark, docs, []) == Counter()


def lexical_parts(text, part):
    was, lexical.PART = lexical.PART, part
    try:
        return list(lexical.term_lists(text.encode()))
    finally:
        lexical.PART = was


def test_sharing_sums_each_item_once():
    """Each item's nodes, taken apart again, are its terms with their repeats; shared pairs are nodes of their own."""
    r = random.Random(4)
    items = [(i, [(b"%d" % t, r.choice([1, 1, 1, 2])) for t in sorted(r.sample(range(40), r.randint(1, 25)))]) for i in range(60)]
    items += [(100 + i, [(b"%d" % t, 1) for t in range(20, 30)] + [(b"own%d" % i, 1)]) for i in range(5)]
    g = lexical.Sharing(items)
    holds = {int(n): Counter() for n in range(g.nodes)}
    for t, k in g.term.items():
        holds[g.leaf[k]][t] += 1
    for made, source, factor in zip(*g.scaled, strict=True):
        holds[made] = Counter({t: n * int(factor) for t, n in holds[source].items()})
    for level in g.levels:
        for made, a, b in zip(*level, strict=True):
            holds[made] = holds[a] + holds[b]
    ends = [*g.starts[1:], len(g.flat)]
    for (_, own), a, b in zip(items, g.starts, ends, strict=True):
        assert sum((holds[x] for x in g.flat[a:b]), Counter()) == Counter(dict(own))
    assert len(g.levels) > 1 and len(g.flat) + sum(len(level[0]) for level in g.levels) < sum(len(own) for _, own in items)
    assert sum(len(own) for _, own in items[-5:]) > 4 * sum(b - a for a, b in list(zip(g.starts, ends, strict=True))[-5:])


def test_query(spark):
    assert rows(queries.op12_lexical_search(spark, SF)) == expected(duck(SF), queries.OP12)
