"""Near-duplicates, repeated passages, decontamination and packing against brute force."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from doseframe.llm import base, decontaminate, minhash, packing, sketch, substring

SCHEMA = "doc_id long, text string, node string, component long, places string"  # clashing names among the others


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["É", "ß,", "Word."]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, base, passage = [], text(200), text(60)
    for i in range(60):
        if i % 6 == 0:  # near copies, more and less near
            w = base.split()
            for _ in range(rng.randint(0, 14)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((100 + i, " ".join(w)))
        elif i % 6 == 1:
            rows.append((100 + i, text(50) + "\n" + passage + "  " + text(50)))
        else:
            rows.append((100 + i, text(rng.randint(1, 90))))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "One"), (6, "two words"), (7, base), (8, base.upper()), (9, base), (9, base), (10, text(9000)), (11, "a " * 500), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "n", 1, "p") for i, t in corpus()], SCHEMA).repartition(3)


def lowered(t):
    return (t or "").encode().lower().split()


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (2, 60)])
def test_components(docs, n, percent):
    sets = {}
    for i, t in corpus():
        w = lowered(t)
        if i is not None:
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    rows = minhash.near_duplicates(docs, n, percent).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


@pytest.mark.parametrize("block", [500, 7])  # one block of all, and components with blocks of their own beside mixed ones
def test_mixed_groups_in_blocks(spark, monkeypatch, block):
    """Near copies around the threshold, whose star round leaves several components: blocks find every link."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", block)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(80):
        w = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            w[k] = f"x{rng.randrange(12)}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {i: root(i) for i in sets}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, how):
    left = spark.range(6000).selectExpr("if(id < 4000, 7, id) AS k", "id AS x")
    right = spark.range(5500).selectExpr("id AS k", "id * 2 AS y")
    got = base.joined(left, right, ["k"], how, "test")
    assert sorted(got.collect()) == sorted(left.join(right, "k", how).select(got.columns).collect())


# a sketch with room, one that lets everything pass, one sized by the texts, and one that is joined
@pytest.mark.parametrize("how", [{"bits": 20}, {"bits": 4}, {}, {"most_bits": 3}])
def test_repeated_passages(docs, how):
    n, seen, want = 20, {}, {}
    for i, t in sorted(((i, t) for i, t in corpus() if i is not None), key=lambda r: r[0]):
        w = (t or "").encode().split()
        cover, own = [0] * len(w), set()
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in own or seen.get(g, i) < i:
                cover[k : k + n] = [1] * n
            own.add(g)
        for g in own:
            seen.setdefault(g, i)
        want[i] = (len(w), sum(cover), b" ".join(x for x, c in zip(w, cover, strict=True) if not c).decode())
    rows = substring.without_repeats(docs, carry=True, **how).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_text) == want[r.doc_id]
            assert r.carried["node"] == "n" and sum(s["end"] - s["start"] for s in r.spans) == r.n_removed
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)


def test_few_unrepeated_windows_pass_the_sketch_at_any_size(spark):
    """Texts of words that are all different, several times as many from one size to the next."""
    for documents in (200, 2000):
        docs = spark.range(documents).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 300), x -> concat('w', hash(id * 300 + x)))) AS text")
        bits = substring.bits_for(docs.selectExpr("sum(octet_length(text))").first()[0])
        total = documents * 281
        seen = spark.sparkContext.broadcast(sketch.Sketch(sketch.merged(substring.sketched(docs, 20, 10, 2, bits), 2, bits), 2, bits))
        assert substring.repeated_candidates(docs, seen, 20, 10).count() < 0.05 * total
        blocks = sketch.merged(substring.sketched(docs, 20, 10, 1, bits + 2), 2, bits + 2)
        some = substring.reached_minimisers(docs, blocks, 20, 10, bits + 2)
        assert substring.repeated_candidates(docs.join(some, F.col("doc_id") == F.col("id"), "left"), None, 20, 10).count() < 0.05 * total


def test_places_of_the_longest_texts():
    at = np.array([0, 1 << 30, (1 << 31) - 1])
    check, start, n = substring.unpacked_place(substring.packed_place(np.array([5, 6, 0xFFFFFF]), at, np.array([1, 255, 7]), True))
    assert check.tolist() == [5, 6, 0xFFFFFF] and start.tolist() == at.tolist() and n.tolist() == [1, 255, 7]


def test_tiles_find_reordered_parts():
    item = np.arange(40, dtype=np.uint64)
    doc = np.concatenate([np.arange(100, 110), np.arange(25, 40), np.arange(200, 205), np.arange(0, 20), np.arange(300, 310)]).astype(np.uint64)
    found = decontaminate.tiles(item, doc, 5)
    assert sorted(found) == [(0, 30, 20), (25, 10, 15)]
    assert decontaminate.tiles(item[:3], doc, 5) == []
    assert sum(n for _, _, n in decontaminate.tiles(item, np.tile(item, 4), 5)) == 40


def test_decontamination(spark):
    rng = random.Random(9)
    text = lambda n: [f"t{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, text(30)) for i in range(20)]
    rows = [(i, text(200)) for i in range(40)]
    for i in range(10):
        own = items[i][1]
        rows[i] = (i, rows[i][1][:50] + (own if i < 4 else own[15:] + text(8) + own[:15] if i < 8 else own[:6]) + rows[i][1][50:])
    docs = [(i, " ".join(w)) for i, w in rows] + [(50, None), (51, ""), (52, " ".join(items[0][1]).upper() + "!"), (52, " ".join(items[0][1]).upper() + "!"), (53, "Too, short"), (54, "this is too short"), (55, "short too"), (None, " ".join(items[0][1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(98, None), (99, "too short"), (None, "a b c d e f g"), (0, " ".join(items[0][1]))]
    out = decontaminate.contaminated(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id long"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in out) == [(i, i) for i in range(8)] + [(52, 0), (53, 99)]
    assert all(r.coverage == r.matched / r.tokens >= 0.5 for r in out)


def plain_tiling(item, doc, least):
    """Greedy string tiling as it is defined: the longest matches of unmarked tokens first, by trying all places."""
    free, out = [[True] * len(item), [True] * len(doc)], 0
    while True:
        longest, found = least, []
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and free[0][i + k] and free[1][j + k]:
                    k += 1
                if k > longest:
                    longest, found = k, [(i, j)]
                elif k == longest:
                    found.append((i, j))
        if not found:
            return out
        for i, j in found:
            if all(free[0][i : i + longest]) and all(free[1][j : j + longest]):
                free[0][i : i + longest] = free[1][j : j + longest] = [False] * longest
                out += longest


def test_decontamination_equals_plain_tiling_of_all_pairs(spark):
    rng = random.Random(12)
    text = lambda n, k: [f"v{rng.randrange(k)}" for _ in range(n)]
    items = [(i, text(rng.randint(5, 30), 500)) for i in range(12)]
    docs = []
    for i in range(60):
        w = text(rng.randint(0, 40), 500)
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(items)[1]
            a = rng.randrange(len(own))
            at = rng.randint(0, len(w))
            w = w[:at] + own[a : a + rng.randint(3, 30)] + w[at:]
        docs.append((i, w))
    want = {(d, i): n for d, w in docs for i, x in items if (n := plain_tiling(x, w, 5)) >= 0.5 * len(x)}
    out = decontaminate.contaminated(spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): r.matched for r in out} == want and len(want) > 10


@pytest.mark.parametrize("rows", [1000, 20])
def test_grams_of_all_documents_and_items_are_spared_or_split(spark, monkeypatch, rows):
    """A passage that all items and documents hold makes hot seeds (from 20 hits here); pairs are those of plain tiling."""
    monkeypatch.setattr(decontaminate, "HOT_ROWS", rows)
    rng = random.Random(5)
    text = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    common = [f"c{k}" for k in range(9)]
    items = [(i, text(rng.randint(0, 40)) + common[: rng.choice([5, 6, 9])] + text(rng.randint(0, 40))) for i in range(20)]
    items += [(20, common), (21, common[:5] + common[:5]), (22, common[:4]), (3, text(30) + common)]
    docs = [(i, text(rng.randint(0, 30)) + common + rng.choice(items)[1][: rng.randint(0, 60)]) for i in range(80)]
    docs += [(80, []), (81, common[:4]), (82, common[2:])]
    want = {}
    for d, w in docs:
        for i, x in items:
            if (n := plain_tiling(x, w, 5) if len(x) >= 5 else len(x) if x == w else 0) >= 0.5 * len(x):
                want[d, i] = max(want.get((d, i), (0, 0)), (n / len(x), n))
    df, bench = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    out = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.matched) for r in out} == want and len(want) > 100


def test_hot_seeds_are_dealt_in_shares_and_spared_by_items_that_can(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "HOT_ROWS", 100)
    hits = spark.createDataFrame([(d, s) for d in range(1000) for s in (1, 2)] + [(d, 3) for d in range(9)], "doc_id long, seed long")
    hot = decontaminate.hot_seeds(hits)
    assert sorted(map(tuple, hot.collect())) == [(1, 1000, 10), (2, 1000, 10)]
    seeds = spark.createDataFrame([(7, 20, 0, 1), (7, 20, 1, 2), (7, 20, 2, 3), (8, 10, 0, 1), (8, 10, 1, 3)], "item_id long, tokens int, place int, seed long")
    places = decontaminate.places_to_join(seeds, hot, 5, 0.5)
    assert sorted((r.item_id, r.place, r.shares, r.spare) for r in places.collect()) == [(7, 1, 10, 5), (7, 2, 1, 5), (8, 0, 10, 0), (8, 1, 1, 0)]
    met = decontaminate.in_shares(hits, places, hot)
    assert met.count() == 1000 + 9 + 1000 + 9
    most = met.where("seed < 3").groupBy("seed", "share").count().agg({"count": "max"}).first()[0]
    assert most < 200


def test_packing(docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(int)
    capacity = 64
    for i, x in corpus():
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], np.uint32)
        start, piece = 0, 0
        while start < len(ids):
            size = (len(ids) - 1) % capacity + 1 if piece == 0 else capacity
            want[i, piece, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            start, piece = start + size, piece + 1
    rows = packing.packed_documents(docs, capacity=capacity).collect()
    got = defaultdict(int)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for own in places.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= capacity
    cells = defaultdict(lambda: ([], set(), set()))
    for r in rows:
        lengths, sequences, told = cells[r.cell]
        lengths.append(r.length)
        sequences.add(r.sequence_id)
        told.add((r.cell_sequences, r.cell_bound))
    for lengths, sequences, told in cells.values():
        assert told == {(len(sequences), packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity))}
    total = sum(k[3] * n for k, n in want.items())
    assert len(places) <= -(-total // capacity) * 1.02 + 1


def test_encoder_equals_the_tokenizer():
    """On texts of odd parts, on every character beside letters, digits, spaces and marks, and on long runs."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(1)
    alphabet = ["a", "B", "\u00e9", "\u00df", " ", "  ", "\n", "\t", "'s", "'", "1", "\u00bd", "\u00b2", "\u4e2d", "\u2009", "\u200b", "\xa0", "\x1c", "\x85", "<|endoftext|>", "<|endof", ".", "***", "\U0001f600", "\u00f1", "\u3000"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    for low in range(0, 0x30000, 16):
        texts.append(" ".join(f"a{c}b 1{c}2 {c} {c}{c}  {c}.{c}'s" for c in map(chr, range(low, low + 16)) if not 0xD800 <= ord(c) <= 0xDFFF))
    texts += ["a" * 100_000, " " * 100_000 + "a", "ab1." * 20_000]
    encode = packing.encoder(path, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for k in range(0, len(texts), 1000):
        part = texts[k : k + 1000]
        assert [x.tolist() for x in encode(part)] == [e.ids for e in t.encode_batch(part, add_special_tokens=False)]
    assert packing.encoder(path, None)(["a <|endoftext|> b"])[0].tolist() == [64, 220, 50256, 275] == encode(["a <|endoftext|> b"])[0].tolist()


def test_lower_bound_holds():
    rng = np.random.default_rng(0)
    for capacity in (10, 64, 100, 1):
        for _ in range(30):
            lengths = rng.integers(1, capacity + 1, rng.integers(1, 40))
            bins, offsets, fill = packing.best_fit_decreasing(lengths, capacity)
            assert fill.max() <= capacity
            assert packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity) <= len(fill)
    assert packing.lower_bound(np.bincount([6, 6, 6], minlength=11), 10) == 3


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(none).count() == 0
    assert substring.without_repeats(none).count() == 0
    assert packing.packed_documents(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_links_of_very_large_sets_are_exact():
    """Both sides of the threshold, where a comparison in 32-bit floats can't tell them apart."""
    for size, shared, linked in ((900_000, 827_027, False), (900_000, 827_028, True)):
        assert (100 * shared >= 85 * (2 * size - shared)) == linked
        a = np.arange(size, dtype=np.uint64)
        b = np.arange(size - shared, 2 * size - shared, dtype=np.uint64)
        assert bool(minhash.links_of([a, b], np.array([1, 2]), 85)) == linked


def test_large_sketches_are_asked_once_a_minimiser(spark):
    """At 2**31 cells: every minimiser is sent as two numbers, once, and a repeated one isn't asked for; each block with a
    reached cell is one row, and what comes back is what a dictionary says."""
    r = random.Random(8)
    common = " ".join(f"c{i}" for i in range(40))
    docs = [(i, " ".join(f"w{r.randrange(10**6)}" for _ in range(60)) + (f" {common}" if i % 2 else "")) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2)
    want, times = defaultdict(set), defaultdict(int)
    for i, t in docs:
        _, _, place, least, _ = substring.windows([t.encode().split()], 20, 10, base.WordHashes())
        for k in least[np.diff(place, prepend=-1) != 0].tolist():
            want[i].add(k)
            times[k] += 1
    want = {i: own for i, ks in want.items() if (own := {k for k in ks if times[k] > 1})}
    rows = substring.asked(df, 20, 10, 31).collect()
    sent = sum(len(x.keys) for x in rows)
    assert sent == sum(times.values()) == sum(len(x.ids) for x in rows)
    assert {k for x in rows if x.kind == substring.QUESTION for k in x["keys"]}.isdisjoint(np.array([k for k, c in times.items() if c > 2], np.uint64).view(np.int64).tolist())
    blocks = sketch.merged(substring.sketched(df, 20, 10, 1, 31), 2, 31).where("bits <> unhex(repeat('00', octet_length(bits)))")
    got = {x.id: {k % 2**64 for k in x.some} for x in substring.reached_minimisers(df, blocks, 20, 10, 31).collect()}
    assert got == want
