"""The registered queries of these operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doseframe.llm import bpe, collocations, decontaminate, html, language, lexical, lm, minhash, mpeg, packing, quality, substring, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("p_quality", 6).alias("p_quality"), F.round("p_toxic", 6).alias("p_toxic"), "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urls.judged(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("log_odds", 6).alias("log_odds"), "words")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.without_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html.main_texts(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_model(table(spark, sf_dir, "documents"))


def op9_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mpeg.text_media(table(spark, sf_dir, "documents"))
    feature = F.format_string("mpeg1-layer3;hz=%d;frames=%d;samples=%d;variable=%s;checksums=%d/%d;payload=%s;table=%s;skipped=%d", "sample_rate", "frames", "samples", "variable", "checksums_good", "checksums", "payload_good", "table_good", "skipped")
    tail = F.crc32(F.expr("substring(payload, -16, 16)"))
    return out.select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), tail.alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"), "duration", "offsets")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "matched", "tokens", F.round("coverage", 6).alias("coverage"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_best_fit_packing, op3_quality_classifier, op4_language_id, op5_url_filter, op6_substring_dedup, op7_html_text, op8_gru_scores, op9_mpeg_media, op10_decontamination, op11_collocations, op12_lexical_search, op13_bpe_roundtrip)}


WORDS = r"list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
#: All pairs of documents that share a shingle, and everything reachable over links: for small tables only.
OP1 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, documents.doc_id = c.component_id AS kept
FROM documents LEFT JOIN n ON documents.doc_id = n.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON c.node = documents.doc_id"""
OP6 = f"""WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
c AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM p GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ps, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id"""

OP11 = r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
k AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS k FROM i),
f AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM k GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, phrase, f AS a, k AS words, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 100),
s AS (SELECT lang, phrase, a, words, w, unnest(range(1, words)) AS cut FROM c),
p AS (SELECT s.lang, s.phrase, a, s.w, cut, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM s JOIN n ON n.lang = s.lang
JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(s.w[:cut], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(s.w[cut + 1:], ' ')),
b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
g AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.a >= b.a AND c.words > len(b.w) AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g QUALIFY rank <= 2000"""
TERMS = r"unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12 = f"""WITH i AS (SELECT item_id, {TERMS.format("text")} AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS c FROM i GROUP BY ALL),
d AS (SELECT doc_id, {TERMS.format("text")} AS term FROM documents),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY 1),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
m AS (SELECT doc_id, 100 - 25 + (25 * n * n_docs) // n_terms AS m FROM n, s),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s WHERE term IN (SELECT term FROM q) GROUP BY 1),
r AS (SELECT item_id, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """What SQL can say; tests hold the other queries against brute force, round trips and held-out rows."""
    return {"op1_minhash_dedup": OP1, "op6_substring_dedup": OP6, "op11_collocations": OP11, "op12_lexical_search": OP12}
