"""URL filter: rules first, then naive Bayes on the words that host and path are segmented into.

Words and their frequencies come from all the pages (texts and delimited names). Viterbi finds the likeliest split of a
concatenated name under the unigram model; a name meets only those words that are its own substrings, by a join. The
classes are learned from the pages themselves: a segmented host that holds a seed word is an example to block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doseframe.llm.base import joined, written

if TYPE_CHECKING:
    import pandas as pd

#: (host, path, verdict) of the rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that make a host an example to block.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "pills", "poker", "porn", "sex", "spam", "track", "viagra", "xxx")
#: A longer name that stands in a path is no word by that alone: it may be a concatenation. Words of texts have any length.
LONGEST_NAME = 20


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ://, up to / ? # or the end, and up to ? # or the end; else empty."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the host or a domain above it and whose path starts the path, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # the longest last, so that it's tested first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def delimited(text: Column) -> Column:
    """Lower-case runs of letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")


def word_counts(pages: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """(word, n) over the visible texts, the paths and the hyphenated parts of hosts of all pages, and the seeds once.

    A host's name that stands alone is left out, in texts too: it may be a concatenation, and would be its own likeliest split."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>|&[#\w]+;|[\p{L}\p{N}-]+(\.[\p{L}\p{N}-]+)+", " ")
    host, path = url_parts(F.coalesce("url", F.lit("")))
    parts = F.regexp_extract_all(host, F.lit(r"(\p{L}+(?=-)|(?<=-)\p{L}+)"), 1)
    words = pages.select(F.explode(F.concat(delimited(text), F.filter(F.concat(delimited(path), parts), lambda w: F.length(w) <= LONGEST_NAME))).alias("word"))
    words = words.union(pages.sparkSession.createDataFrame([(w,) for w in seeds], "word string"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def viterbi(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The split of a name with the least cost; a character in no word costs `unknown`, neighbouring ones make one word."""
    lengths = sorted({len(w) for w in costs})
    best: list[tuple[float, int, int, bool]] = [(0.0, 0, 0, True)]
    for j in range(1, len(name) + 1):
        cost, count = best[j - 1][:2]
        options = [(cost + unknown, count + best[j - 1][3], j - 1, False)]
        for i in (j - n for n in lengths if n <= j):
            if (c := costs.get(name[i:j])) is not None:
                options.append((best[i][0] + c, best[i][1] + 1, i, True))
        best.append(min(options))
    words, j = [], len(name)
    while j:
        i, known = best[j][2], best[j][3]
        while not known and i and not best[i][3]:
            i = best[i][2]
        words.append(name[i:j])
        j = i
    return words[::-1]


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """(name, words) for distinct names of any length; of a name's substrings those of the words' lengths are looked up."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0]  # one number
    lengths = F.array(*[F.lit(r[0]) for r in counts.select(F.length("word")).distinct().collect()]).cast("array<int>")  # few
    names = names.select("name").distinct()
    ends = F.expr("explode(sequence(1, length(name)))")
    parts = names.select("name", ends.alias("i")).select("name", "i", F.explode(lengths).alias("k")).where("i + k <= length(name) + 1")
    parts = parts.select("name", F.expr("substring(name, i, k)").alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd  # other workers do without its memory

        for pdf in batches:
            words = []
            for name, found in zip(pdf["name"], pdf["known"], strict=True):
                costs = {w["word"]: math.log(total / w["n"]) for w in (found if found is not None else ())}
                words.append(viterbi(name, costs, math.log(total) + 3.0))
            yield pd.DataFrame({"name": pdf["name"], "words": words})

    return names.join(known, "name", "left").mapInPandas(split, "name string, words array<string>")


def judged(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, seeds: tuple[str, ...] = SEEDS, smoothing: float = 1.0) -> DataFrame:
    """Every row of pages (page_id, url; words are learned from html too) with host, path, rule, verdict, log_odds and words.

    The longest rule that fits decides; else naive Bayes blocks where the segmented host's and path's tokens have log odds
    over 0. Null urls and those without :// have an empty host and path, no token, and the verdict of the prior alone.
    Null ids stay null, repeated rows are judged each and count each; an empty table gives an empty one. Where the corpus has no
    example to block or none to allow, the odds are those of one smoothed example. Other columns are not looked at.
    """
    cols = {c: F.lit(None).cast("string") for c in ("html",) if c not in pages.columns}
    host, path = url_parts(F.coalesce("url", F.lit("")))
    rows = pages.withColumns(cols).select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    counts = written(word_counts(pages.withColumns(cols).select("url", "html"), seeds), "url-words")
    each = rows.groupBy("host", "path").agg(F.count("*").alias("n"))
    each = written(each.withColumns({"host_names": delimited(F.col("host")), "path_names": delimited(F.col("path"))}), "url-distinct")
    names = each.select(F.explode(F.array_distinct(F.concat("host_names", "path_names"))).alias("name"))
    words = written(segmented(names, counts), "url-segments")

    token = each.select("host", "path", "n", F.explode(F.concat(F.transform("host_names", lambda x: F.struct(x.alias("name"), F.lit("h").alias("kind"))), F.transform("path_names", lambda x: F.struct(x.alias("name"), F.lit("p").alias("kind"))))).alias("t"))
    token = joined(written(token.select("host", "path", "n", "t.kind", "t.name"), "url-names"), words, ["name"], "inner", "url-segments").select("host", "path", "n", "kind", F.explode("words").alias("word"))
    token = written(token, "url-tokens")
    bad = token.where("kind = 'h'").where(F.col("word").isin(*seeds)).select("host").distinct().withColumn("bad", F.lit(1))
    bad = written(bad, "url-bad")
    labelled = joined(token, bad, ["host"], "left", "url-bad").withColumn("bad", F.coalesce("bad", F.lit(0)))
    table = written(labelled.groupBy("kind", "word").agg(F.sum(F.col("n") * F.col("bad")).alias("yes"), F.sum(F.col("n") * (1 - F.col("bad"))).alias("no")), "url-table")
    yes, no, kinds = table.agg(F.coalesce(F.sum("yes"), F.lit(0)), F.coalesce(F.sum("no"), F.lit(0)), F.count("*")).first()
    urls = joined(each, bad, ["host"], "left", "url-bad").agg(F.coalesce(F.sum(F.when(F.col("bad") == 1, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("bad").isNull(), F.col("n"))), F.lit(0))).first()
    prior = math.log((urls[0] + smoothing) / (urls[1] + smoothing))
    weight = F.log((F.col("yes") + smoothing) / (yes + smoothing * (kinds + 1))) - F.log((F.col("no") + smoothing) / (no + smoothing * (kinds + 1)))
    scores = joined(token, table.select("kind", "word", weight.alias("weight")), ["kind", "word"], "inner", "url-table").groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.array_sort(F.collect_set("word")).alias("words"))
    odds = F.lit(prior) + F.coalesce("weight", F.lit(0.0))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = joined(rows, written(scores, "url-scores"), ["host", "path"], "left", "url-scores")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(odds > 0, "block").otherwise("allow")).alias("verdict"), odds.alias("log_odds"), F.coalesce("words", F.array().cast("array<string>")).alias("words"))
