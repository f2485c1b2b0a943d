"""Language, quality, URLs, HTML, language model and media."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from doseframe.llm import gru, html, language, lm, mpeg, quality, queries, urls

EDGE = [(-1, None), (-2, ""), (-3, "123 !!"), (-4, "Der"), (None, "the"), (None, None), (-5, "word " * 40000)]


def with_edges(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.9 * len(held)
    assert sum(r.rejected for r in out) <= 0.02 * len(out) and all(0 <= r.score <= 1 for r in out)
    model = language.fit(docs.select("doc_id", "text", "lang"))
    edge = spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id long, text string, lang string")
    got = language.identified(edge, model).collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and all(r.rejected for r in got[:3]) and len(got) == len(EDGE)
    assert language.accepted(edge, model).count() <= 4
    assert language.language_id(edge.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identified(edge, language.fit(edge.limit(0))).collect()} == {"und"}


def test_short_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.union(spark.createDataFrame([(-1, "zug zug zug", "rare")], docs.schema)))
    assert all((f > 0).all() for f in model.floors)
    _, _, rejected = model.predict(["\u03ba\u03b1\u03bb\u03b7\u03bc\u03ad\u03c1\u03b1", "\u0434\u043e\u0431\u0440\u044b\u0439 \u0434\u0435\u043d\u044c", "xqzvk jwqx"])
    assert rejected.all()


def test_quality(spark):
    rows = [(i, f"some plain words here {i} " + ("you stupid idiot " if i % 5 == 0 else "") + ("### *** $$$ " * 20 if i % 7 == 0 else ""), "en", f"s{i % 3}") for i in range(300)]
    labels = [(i, int(i % 7 != 0), int(i % 5 == 0)) for i in range(0, 300, 2)] + [(0, 1, 1), (None, 1, 1), (2, None, 0), (9999, 1, 0)]
    docs = spark.createDataFrame(rows + [(-1, None, None, None), (None, "words", None, "s1"), (-2, "", "en", "s9")], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: r for r in quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    for i in range(300):
        assert out[i].kept == (i % 5 != 0 and i % 7 != 0), i
    assert len(out) == 303
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in quality.scored(docs, none).collect())
    assert quality.scored(docs.limit(0), none).count() == 0


def test_viterbi_takes_the_cheapest_split():
    costs = {"cheap": 5.0, "pills": 5.0, "chea": 9.0, "ppills": 9.0, "free": 4.0}
    assert urls.viterbi("cheappills", costs, 20.0) == ["cheap", "pills"]
    assert urls.viterbi("freexyz", costs, 20.0) == ["free", "xyz"]
    assert urls.viterbi("", costs, 20.0) == []


def test_urls(spark):
    given = [
        ("http://a.org/fr/x", "a.org", "/fr/x", "org/fr/", "allow"), ("https://M.Example.NET/en/1?q#t", "m.example.net", "/en/1", "example.net/en/", "allow"), ("http://other.net/en/", "other.net", "/en/", "net/", "block"),
        ("http://x.example.com/de/9#top", "x.example.com", "/de/9", "example.com/de/", "block"), ("http://net", "net", "", None, None), ("no scheme", "", "", None, None), (None, "", "", None, None), ("http://a.net?x=/en/", "a.net", "", None, None),
        ("http://xnet/y", "xnet", "/y", None, None), ("http://freecasinowin.example.com/", "freecasinowin.example.com", "/", None, "block"), ("http://gardenbook.example.com/", "gardenbook.example.com", "/", None, "allow"),
    ]
    text = "<p>free garden book casino win free garden book free garden book</p>"
    more = [("http://casino-win.example.com/", text)] * 6 + [(f"http://garden{i}.example.com/en/", text) for i in range(12)]
    rows = [(i, g[0], text) for i, g in enumerate(given)] + [(100 + i, u, t) for i, (u, t) in enumerate(more)]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(given):
        assert (out[i].host, out[i].path, out[i].rule) == (host, path, rule)
        assert verdict is None or out[i].verdict == verdict, given[i]
    assert {"free", "casino", "win"} <= set(out[9].words)
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_names_are_segmented_and_repeated_ones_count(spark):
    long = "gardenbookgardeningencyclopaedia"
    text = "<p>free casino garden book encyclopaediagardeningbook free casino garden book encyclopaediagardeningbook</p>"
    given = ["http://a.com/" + "freecasino" * 8, "http://b.com/casino", "http://b.com/casino/casino", "http://c.com/gardenencyclopaediagardeningbook", f"http://d.com/{long}"]
    out = {r.page_id: r for r in urls.judged(spark.createDataFrame([(i, u, text) for i, u in enumerate([*given, "http://casino-x.com/"])], "page_id long, url string, html string")).collect()}
    assert out[0].words == ["a", "casino", "com", "free"]
    assert out[1].log_odds != out[2].log_odds
    assert {"garden", "encyclopaediagardeningbook"} <= set(out[3].words) and long not in out[4].words


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><header>Site</header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="ad">Buy</div><article><h1>Title &amp; more</h1><p>First  <b>bold</b> text<br>next.<p>Second &eacute;&#33;</p><ul><li>item one<li>item two</ul><aside>side</aside><form><input>Send</form><div id="comments">A reader</div></article>
<div class="sidebar">links</div><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more\nFirst bold text next.\nSecond é!\nitem one\nitem two"


def test_html(spark):
    plain = "<html><body><div class=menu><a>Home</a></div><div class=content><p>The body {} of the page is long enough here.</p><p>And more.</p></div><div class=box><p>tip</p></div></body></html>"
    rows = [(i, "http://a.example.com/1", PAGE) for i in range(3)] + [(3, "http://a.example.com/2", PAGE[: PAGE.index("<aside>")]), (4, None, None), (5, "http://b.com", ""), (6, "http://b.com", "just text")]
    rows += [(10 + i, "http://c.com/x", plain.format(i)) for i in range(4)]
    out = {r.page_id: r.text for r in html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [out[i] for i in range(4)] == [TEXT] * 4
    assert (out[4], out[5], out[6]) == ("", "", "just text")
    assert out[12] == "The body 2 of the page is long enough here.\nAnd more."
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_are_no_part_of_an_article():
    for name in ("ad", "cookie-notice", "relatedPosts", "comments", "sidebar_left", "nav-bar", "search-form", "site-footer"):
        assert html.boilerplate(name), name
    for name in ("related-work", "search-results-table", "content", "post", "shared-memory", "", "123"):
        assert not html.boilerplate(name), name


def hosts_pages():
    rng = np.random.default_rng(8)
    own = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 9999, n))
    slogan, rows, want = "We are the site that says this on every page of all, at some length and with joy", [], []
    for i in range(6):  # a slogan longer than the page's own text
        text = own(6)
        rows.append(("http://slogan.com/", f"<body><div>{slogan}</div><div><p>{text}</p></div></body>"))
        want.append(text)
    for i in range(5):  # words of the site beside the article, equal pages, and parts whose names only look like others'
        text, more = own(30), own(10)
        body = f"<body><div><p>Read us</p></div><div><h1>{text}</h1><section id='related-work'>{more}</section><p class=notice>Look</p><div class='search-results-table'>{own(3)} {i}</div></div><div><p>About</p><p>Contact</p></div></body>"
        rows += [("http://b.com/", body)] * (1 + i % 2)
        want += ["\n".join([text, more, re.search(r"table'>(.*?)</div", body)[1]])] * (1 + i % 2)
    return rows, want


def test_the_template_of_a_host(spark):
    rows, want = hosts_pages()
    df = spark.createDataFrame([(i, u, h, "x", "y", 1) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, slot string, host string, text int")
    out = {r.page_id: r.text for r in html.main_texts(df).collect()}
    assert [out[i] for i in range(len(rows))] == want


def test_classes_equal_those_of_whole_vectors(spark):
    """Slots and fixed texts from sums of hashes against occurrence vectors written out."""
    rows, _ = hosts_pages()
    rows += [(f"http://c{k}.com/", PAGE.replace("item one", f"item {k * i}")) for k in (1, 2, 5) for i in range(4)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    host = urls.url_parts(df.url)[0]
    got = {r.host: (r.slot, r.fixed) for r in html.templates(df.selectExpr("page_id", "url", "html", "xxhash64(html) AS page_key").withColumn("host", host)).collect()}
    want = {}
    for url in {u for u, _ in rows}:
        pages = [html.Page(h) for h in sorted({h for u, h in rows if u == url})]
        vectors, facts = {}, {}
        for k, p in enumerate(pages):
            for t, e in p.elements.items():
                vectors.setdefault(t, [0] * len(pages))[k] = e.n
                f = facts.setdefault(t, {"token": t, "parent": e.parent, "tag": e.tag, "depth": e.depth, "chars": 0, "own": 0})
                f["chars"], f["own"] = f["chars"] + e.chars, f["own"] + e.own
            for t, (home, n, size) in p.texts().items():
                vectors.setdefault(t, [0] * len(pages))[k] = n
                f = facts.setdefault(t, {"token": t, "parent": home, "tag": "", "depth": 0, "chars": 0, "own": 0})
                f["chars"] += n * size
        if len(pages) >= 3:
            often = [t for t, v in vectors.items() if 2 * sum(x > 0 for x in v) >= len(pages) and sum(x > 0 for x in v) >= 3]
            kinds = {v: i for i, v in enumerate(sorted({tuple(vectors[t]) for t in often}))}
            want[url.split("/")[2]] = html.template([facts[t] | {"pages": sum(x > 0 for x in vectors[t]), "total": sum(vectors[t]), "kind": kinds[tuple(vectors[t])]} for t in often])
    assert got == want and len(want) == 5 and all(slot is not None for slot, _ in got.values())


def test_deep_and_long_pages(spark):
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    long = "<article>" + "<p>word text</p>" * 30_000 + "</article>"
    rows = [(1, "http://d.com/", deep), (2, "http://e.com/", long), (None, None, None), (2, "http://e.com/", long)]
    out = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id or 0, len(r.text)) for r in out) == [(0, 0), (1, 9), (2, 299_999), (2, 299_999)]


def test_gradients_of_the_network():
    rng = np.random.default_rng(2)
    p = {k: v.astype(np.float64) for k, v in gru.new(np.arange(70, 0, -1)).items()}
    p = {k: v + 0.05 * rng.standard_normal(v.shape) for k, v in p.items()}
    inputs, targets, mask = rng.integers(0, 70, (5, 3)), rng.integers(0, 70, (5, 3)), np.ones((5, 3), bool)
    mask[3:, 1] = False
    h = rng.standard_normal((3, gru.HIDDEN)) * 0.1
    g, _, _ = gru.gradients(p, h, inputs, targets, mask)
    for name in ("wh", "wx", "b", "wc", "bc", "ww", "bw", "embed"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        losses = []
        for e in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += e
            losses.append(gru.gradients(q, h, inputs, targets, mask)[2] / mask.sum())
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-4 * max(1, abs(g[name][at])), name


def test_gradients_where_documents_begin_within_a_window():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) + 0.05 * rng.standard_normal(v.shape) for k, v in gru.new(np.arange(70, 0, -1)).items()}
    inputs, targets, fresh = rng.integers(0, 70, (6, 3)), rng.integers(0, 70, (6, 3)), np.zeros((6, 3), bool)
    fresh[3, 1] = fresh[0, 2] = True
    h = rng.standard_normal((3, gru.HIDDEN)) * 0.1
    g, _, _ = gru.gradients(p, h, inputs, targets, np.ones((6, 3), bool), fresh)
    for name in ("wh", "wx", "embed"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        losses = []
        for e in (1e-5, -1e-5):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += e
            losses.append(gru.gradients(q, h, inputs, targets, np.ones((6, 3), bool), fresh)[2] / 18)
        assert abs((losses[0] - losses[1]) / 2e-5 - g[name][at]) < 1e-4, name


def test_a_document_of_millions_of_words_trains_in_streams():
    p = gru.new(np.arange(70, 0, -1))
    out = gru.train(p, [np.random.default_rng(1).integers(0, 4, 2_000_000).astype(np.int32), np.array([5], np.int32), np.zeros(0, np.int32)], 1)
    assert gru.scores(out, [np.array([1, 2, 3])], 1)[0] > gru.scores(p, [np.array([1, 2, 3])], 1)[0]
    assert all(np.array_equal(v, p[k]) for k, v in gru.train(p, [], 1).items())


def test_scores_equal_a_plain_network(spark):
    """score of the query against a network written out word by word, with the unknown token's share."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % (7 + i % 5)}" for k in range(60))) for i in range(80)] + [(500, "new words w1"), (501, None)], "doc_id long, text string")
    docs = docs.select("doc_id", "text", lm.held_out().alias("held_out"))
    counts = lm.token_counts(docs.where("not held_out").select("text"))
    model, rows = lm.fit(docs, counts)
    seen = Counter(w for r in docs.collect() if not r.held_out for w in lm.tokens((r.text or "").encode()))
    p, table = {k: v.astype(np.float64) for k, v in model.params.items()}, lm.Table(model.hashes)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    got = {r.doc_id: r.score for r in lm.scored(rows, model, counts).collect()}
    for r in docs.collect():
        h, last, total, n = np.zeros(gru.HIDDEN), model.end, 0.0, gru.HIDDEN
        for w in lm.tokens((r.text or "").encode()):
            x, u = p["embed"][last] @ p["wx"] + p["b"], h @ p["wh"]
            z, g = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
            c = np.tanh(x[2 * n :] + g * u[2 * n :])
            h = (1 - z) * c + z * h
            last = int(model.ids[table.of([w])[0]])
            k, j = divmod(last, p["ww"].shape[2])
            a, b = h @ p["wc"] + p["bc"], h @ p["ww"][k] + p["bw"][k]
            total += a[k] - np.log(np.exp(a).sum()) + b[j] - np.log(np.exp(b).sum())
            total += np.log((seen[w] + 1) / model.rest) if last == model.unknown else 0
        assert math.isclose(got[r.doc_id], total / math.log(10), rel_tol=1e-4), r.doc_id


def test_scores_go_on_over_windows_and_sum_to_one():
    p = gru.new(np.arange(70, 0, -1))
    p["wh"] += 0.3
    docs = [np.random.default_rng(i).integers(0, 70, n) for i, n in enumerate((1, 40, 7, 90))]
    assert np.allclose(gru.scores(p, docs, 1, 5), gru.scores(p, docs, 1, 1000), atol=1e-3)
    h = np.random.default_rng(0).standard_normal((1, gru.HIDDEN)).astype(np.float32)
    assert abs(np.exp(gru.log_probs(p, np.repeat(h, 70, 0), np.arange(70))).sum() - 1) < 1e-4


def test_scoring_holds_few_probabilities_at_once():
    """Those of 60,000 states over 23,000 tokens are many times what a core's cache holds; they are made block by block."""
    rng = np.random.default_rng(3)
    p = gru.new(np.arange(23_000, 0, -1))
    p = {k: v + (0.1 * rng.standard_normal(v.shape)).astype(np.float32) for k, v in p.items()}
    h, targets = (0.5 * rng.standard_normal((60_000, gru.HIDDEN))).astype(np.float32), rng.integers(0, 23_000, 60_000)
    tracemalloc.start()
    got = gru.log_probs(p, h, targets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25e6
    for i in range(0, 60_000, 997):
        k, j = divmod(int(targets[i]), p["ww"].shape[2])
        a, b = h[i].astype(np.float64) @ p["wc"] + p["bc"], h[i].astype(np.float64) @ p["ww"][k] + p["bw"][k]
        assert abs(a[k] - np.log(np.exp(a).sum()) + b[j] - np.log(np.exp(b).sum()) - got[i]) < 1e-3


def test_language_model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "the"), (-3, "The THE the")], docs.schema))
    rows = docs.collect()
    out = Counter()
    tok = lambda t: (t or "").encode().lower().split() + [b"\n"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm.language_model(docs, rounds=1).collect()}
    for i, t in rows:
        r, w = got[i], tok(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    unseen = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    assert lm.language_model(docs.limit(0)).count() == 0


def test_language_model_learns_from_all_documents(spark):
    docs = spark.range(5000).selectExpr("id AS doc_id", "concat('w', id % 1500, ' w', (id + 1) % 1500, ' ', repeat(concat('w', id % 1500, ' '), 20)) AS text")
    counts = lm.token_counts(docs.select("text"))
    model, _ = lm.fit(docs.selectExpr("*", "false AS held_out"), counts, rounds=3)
    assert model.trained_tokens == model.total == 5000 * 23
    assert len(model.params["embed"]) == 1502  # every word occurs over 50 times, and has a token of its own


def test_media(spark):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in EDGE + [(1, "é" * 1000), (2, "é" * 1000), (3, "x" * 192), (4, "ÿþ\xff" * 300)]], "doc_id long, text string, media binary")
    out = mpeg.text_media(docs).collect()
    assert len(out) == docs.count()
    texts = {i: t for i, t, _ in docs.collect() if i is not None}
    for r in out:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r.n_bytes == len(raw) and bytes(r.payload) == raw.ljust(max(1, -(-len(raw) // 192)) * 192)
            assert r.checksums == r.checksums_good == r.frames == len(r.offsets) and r.payload_good and r.table_good and r.skipped == 0
            assert r.samples == 1152 * r.frames and r.duration == r.samples / 48000
    same = [r for r in out if r.doc_id in (1, 2)]
    assert same[0].media_sha256 == same[1].media_sha256


def test_damaged_streams():
    payload = bytes(range(192)) * 9
    whole = mpeg.stored(payload)
    offsets = mpeg.read(whole)["offsets"]
    junk = whole[: offsets[1]] + b"\xff\xfbjunk\xff" * 3 + whole[offsets[1] :]
    got = mpeg.read(junk)
    assert got["payload"] == payload and got["skipped"] == 21
    broken = bytearray(whole)
    broken[offsets[0] + 8] ^= 1
    assert mpeg.read(bytes(broken))["checksums_good"] == len(offsets) - 1
    assert mpeg.read(whole[:-5])["frames"] == len(offsets) - 1
    assert mpeg.read(b"")["frames"] == 0 and mpeg.read(b"TAG" * 100)["frames"] == 0
    assert mpeg.read(whole + b"TAG" + bytes(125))["payload"] == payload
    assert hashlib.sha256(mpeg.read(whole)["payload"]).digest() == hashlib.sha256(payload).digest()
    assert mpeg.header(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417  # 128 kbit/s at 44.1 kHz
    assert mpeg.crc16(b"") == 0xFFFF


def test_streams_cut_off_and_broken_anywhere_are_read():
    rng = np.random.default_rng(3)
    whole = mpeg.stored(bytes(range(192)) * 5)
    short = bytes([0xFF, 0xF3, 0x14, 0xC4]) + bytes(9) + b"Xing" + bytes(7)  # a small frame whose table would go on beyond it
    assert mpeg.header(short[:4]) is not None and mpeg.read(short)["frames"] in (0, 1)
    for cut in range(0, len(whole), 7):
        mpeg.read(whole[:cut])
        mpeg.read(short + whole[cut:])
    for _ in range(200):
        broken = bytearray(whole)
        for at in rng.integers(0, len(whole), 20):
            broken[at] = rng.integers(0, 256)
        got = mpeg.read(bytes(broken[: rng.integers(0, len(whole))]))
        assert got["frames"] == len(got["offsets"])


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_queries_run(spark, name):
    assert queries.queries()[name](spark, SF).limit(1).count() == 1


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in c.STAGES[:-1]:
        kept = stage(spark, now, SF)
        assert kept.columns == docs.columns and 0 < kept.count() <= now.count(), name
        now = kept.persist()
    ids = {r.doc_id for r in now.select("doc_id").collect()}
    assert {r.doc_id for r in c.run(spark, SF).select("doc_id").distinct().collect()} == ids


def test_pipeline_keeps_documents_without_id_and_one_row_of_repeated_ones(spark):
    import corpus_pipeline as c

    texts = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, texts["a"]), (1, texts["a"]), (1, texts["a"]), (None, texts["b"]), (None, texts["b"]), (None, texts["c"]), (None, texts["a"]), (2, texts["d"])]
    got = c.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted((r.text[0], r.doc_id) for r in got) == [("a", 1), ("b", None), ("c", None), ("d", 2)]


def test_html_keeps_what_stands_in_every_article(spark):
    """Headings, bylines and statements that all articles of a host share; the site's own words around them go, also where an
    article repeats them."""
    page = "<body><div class='top'><p>The Daily</p></div><article><h1>Title {0}</h1><div><h2>Summary</h2></div><p>Body {0} of the story.</p><div class='by'>Jane Doe</div><section><p>This study was funded by the town.</p></section><div><p>The Daily</p></div></article><div><p>All rights reserved</p></div></body>"
    pages = spark.createDataFrame([(i, f"http://h.org/{i}", page.format(f"n{i}")) for i in range(6)], "page_id long, url string, html string")
    for r in html.main_texts(pages).collect():
        assert r.text.split("\n") == [f"Title n{r.page_id}", "Summary", f"Body n{r.page_id} of the story.", "Jane Doe", "This study was funded by the town."]


def brute_pipeline(rows, items):
    """near_duplicates and benchmark_decontamination on rows (key, text) by all pairs: which keys stay after each."""
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").translate(LOWER).split()] for i in range(max(1, len(w) - 4)) if w}
    sets = {k: shingles(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    first = [k for k in sets if root(k) == k]
    holds = lambda t: any(i and f" {i.lower()} " in f" {(t or '').lower()} " for i in items)
    return first, [k for k, t in rows if not holds(t)]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_stages_judge_rows_not_ids(spark, tmp_path):
    """Repeated ids of different texts, null ids, repeated rows, null, empty and long texts, other columns; every stage on an
    empty table."""
    import corpus_pipeline as c

    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    item = " ".join(f"q{i}" for i in range(12))
    near = text["a"].split()
    near[-1] = "other"
    texts = [(3, text["a"]), (5, text["a"]), (5, text["b"]), (7, text["c"]), (7, f"{text['d']} {item}"), (None, f"{item} {text['e']}"), (None, text["f"]), (None, text["f"]), (8, None), (8, ""), (9, ""), (6, " ".join(near)), (10, " ".join(f"long{i}" for i in range(60_000))), (11, item.upper())]
    rows = [(i, t, "en", "s", len(t or ""), k) for k, (i, t) in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_0 int"
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    spark.createDataFrame([(1, item), (2, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    first, clean = brute_pipeline([(k, t) for k, (_, t) in enumerate(texts)], [item])
    folder = f"file://{tmp_path}"
    got = c.near_duplicates(spark, docs, folder)
    assert got.columns == docs.columns and sorted(r["row_0"] for r in got.collect()) == first
    got = c.benchmark_decontamination(spark, docs, folder)
    assert got.columns == docs.columns and sorted(r["row_0"] for r in got.collect()) == clean
    got = {r["row_0"]: r["text"] for r in c.substring_dedup(spark, docs.where("doc_id is not null"), folder).collect()}
    assert got[0] == text["a"] and got[2] == text["b"] and got[8] is None and got[9] == "" and len(got[12].split()) == 60_000
    packed = c.best_fit_packing(spark, docs, folder)
    assert packed.where("piece = 0").count() == len(texts)
    for name, stage in c.STAGES:
        assert stage(spark, docs.limit(0), folder).collect() == [], name


def test_stages_leave_no_tables_but_what_their_result_reads(spark):
    import os

    import corpus_pipeline as c
    from doseframe.llm import base

    folder = base.shared_dir(spark).removeprefix("file://") + "/doseframe"
    os.makedirs(folder, exist_ok=True)
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(k, " ".join(f"{k % 3}w{i}" for i in range(30))) for k in range(9)], "doc_id long, text string")
    got = c.near_duplicates(spark, docs, "")
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"pipeline-keys", "pipeline-kept"}
    assert got.count() == 3
    with base.scratch(spark):
        inner = base.settled(spark, lambda: base.written(docs, "a").select("doc_id"), "b")
        assert inner.count() == 9
        assert [x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before if x[0] in "ab"] == ["b"]
    assert not [x for x in set(os.listdir(folder)) - before if x[0] in "ab"]


def test_quality_on_labels_it_did_not_learn_from(spark):
    """A quarter of the labels is held out, less those whose text is also learned from: how many verdicts agree, and how often
    a document with the label outranks one without it."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    learned = docs.join(labels.where("not held"), "doc_id").select("text").distinct()
    rows = quality.scored(docs, labels.where("not held").drop("held")).join(labels.where("held"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").join(learned, "text", "left_anti").collect()
    for p, label, bar in (("p_quality", "quality", quality.GOOD), ("p_toxic", "toxic", quality.TOXIC)):
        yes, no = ([r[p] for r in rows if r[label] == k] for k in (1, 0))
        ranked = sum((x > y) + 0.5 * (x == y) for x in yes for y in no) / (len(yes) * len(no))
        right = sum((r[p] >= bar) == bool(r[label]) for r in rows) / len(rows)
        assert len(yes) > 100 and len(no) > 100 and ranked > 0.9 and right > 0.95
