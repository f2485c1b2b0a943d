"""The url filter against all splits of all names and a naive Bayes written out."""

import math
import random
from collections import Counter
from itertools import pairwise

import regex

from doseframe.llm import urls

WORDS = ["a", "ad", "ads", "bet", "car", "cas", "casino", "den", "door", "en", "gar", "garden", "in", "news", "no", "win", "wing", "zoo"]
TAGS = r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[#A-Za-z0-9_]+;|[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+"


def letters(text):
    return [w for w in regex.split(r"[^\p{L}]+", text.lower()) if w]


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = regex.match(r"[^/?#]*", rest)[0]
    return host.lower(), regex.match(r"[^?#]*", rest[len(host) :])[0]


def counted(pages):
    counts = Counter(urls.SEEDS)
    for _, url, html in pages:
        host, path = parts_of(url)
        counts.update(letters(regex.sub(TAGS, " ", html or "")))
        counts.update(w for w in letters(path) + regex.findall(r"\p{L}+(?=-)|(?<=-)\p{L}+", host) if len(w) <= urls.LONGEST_NAME)
    return counts


def least(name, counts):
    """The cheapest of all ways to cut a name; pieces that are no word cost by the letter, and stand between words only."""
    total, best = sum(counts.values()), None
    for cuts in range(1 << (len(name) - 1)):
        at = [0, *[i for i in range(1, len(name)) if cuts >> (i - 1) & 1], len(name)]
        pieces = [name[i:j] for i, j in pairwise(at)]
        known = [p in counts for p in pieces]
        if any(not x and not y for x, y in pairwise(known)):
            continue
        cost = sum(math.log(total / counts[p]) if k else (math.log(total) + 3.0) * len(p) for p, k in zip(pieces, known, strict=True))
        if best is None or (cost, len(pieces)) < best[:2]:
            best = (cost, len(pieces), pieces)
    return best[2]


def plain(pages):
    """page_id, host, path, log_odds and words of each page, row by row."""
    counts, rows = counted(pages), []
    for page_id, url, _ in pages:
        host, path = parts_of(url)
        tokens = [(kind, w) for kind, text in (("h", host), ("p", path)) for name in letters(text) for w in least(name, counts)]
        rows.append((page_id, host, path, tokens, any(k == "h" and w in urls.SEEDS for k, w in tokens)))
    seen = {bad: Counter(t for r in rows if r[4] == bad for t in r[3]) for bad in (True, False)}
    kinds = len({*seen[True], *seen[False]})
    part = lambda t, bad: math.log((seen[bad][t] + 1) / (sum(seen[bad].values()) + kinds + 1))
    prior = math.log((sum(r[4] for r in rows) + 1) / (sum(not r[4] for r in rows) + 1))
    return [(i, h, p, prior + sum(part(t, True) - part(t, False) for t in tokens), sorted({w for _, w in tokens})) for i, h, p, tokens, _ in rows]


def test_verdicts_equal_all_splits_and_a_plain_naive_bayes(spark):
    draw = random.Random(11)
    name = lambda: "".join(draw.choices(WORDS + ["q", "xk"], k=draw.randint(1, 3)))[:11]
    pages = [(None, "http://Zoo.net/en/", "<p>garden</p>"), (1, None, None), (2, "no scheme", "casino news"), (3, "http://", ""), (4, "http://zoo.com?x=casino", "door " * 20000), (4, "http://zoo.com?x=casino", "again")]
    for i in range(70):
        url = f"http://{name()}{draw.choice(['-' + name(), ''])}.{draw.choice(['com', 'org', 'example.net'])}/{draw.choice(['en', 'fr', name()])}/{name()}{draw.choice(['', '/' + name(), '#x'])}"
        text = " ".join(draw.choices(WORDS, [k * k for k in range(3, 3 + len(WORDS))], k=30))
        pages += [(10 + i, url, f"<p class=x>{text} &amp; some-host.example.org</p><script>door()</script>")] * draw.choice([1, 1, 3])
    df = spark.createDataFrame([(*p, "x", 0.0, 1) for p in pages], "page_id long, url string, html string, host string, weight double, n long")
    got = [(r.page_id, r.host, r.path, r.log_odds, sorted(r.words), r.verdict, r.rule) for r in urls.judged(df).collect()]
    want, key = plain(pages), lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert len({r[1] for r in want if r[3] > 0}) > 5 and len({r[1] for r in want if r[3] < 0}) > 5
    for mine, own in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert mine[:3] == own[:3] and mine[4] == own[4]
        assert abs(mine[3] - own[3]) < 1e-9
        assert mine[6] is not None or mine[5] == ("block" if own[3] > 0 else "allow")
