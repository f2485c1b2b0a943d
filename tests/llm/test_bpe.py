import hashlib
import random

import numpy as np
import public_tokenizers
from conftest import SF
from pyspark.sql import types as T

from doseframe.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(bpe_, piece):
    """The leftmost pair of the lowest rank, found anew after each merge."""
    ids = [bpe_.single[b] for b in piece]
    while True:
        found = [(r, i) for i in range(len(ids) - 1) if (r := bpe_.rank.get(ids[i] * bpe_.size + ids[i + 1])) is not None]
        if not found:
            return ids
        r, i = min(found)
        ids[i : i + 2] = [bpe_.made[r]]


def test_trees_equal_plain_merging():
    own, r = bpe.byte_bpe(PATH), random.Random(3)
    pieces = [bytes(r.choice(b" theingr'") if r.random() < 0.9 else r.randrange(256) for _ in range(r.randint(2, 64))) for _ in range(3000)]
    want = [plain(own, p) for p in pieces]
    assert [own.merged(p) for p in pieces] == want
    assert [np.frombuffer(x, np.int32).tolist() for x in own.merged_side_by_side(pieces)] == want


def test_ids_equal_the_library():
    from tokenizers import Tokenizer

    r = random.Random(5)
    every = ["".join("{0}b {0}1 {0}  {0} \n".format(chr(c)) for c in range(low, low + 64) if not 0xD800 <= c < 0xE000) for low in range(0, 0x110000, 64)]
    mixed = ["".join(r.choice("aAeE tT  \n\t.'sSré1234ñ中　\x85\x1c") if r.random() < 0.95 else "<|endoftext|>" for _ in range(r.randint(0, 60))) for _ in range(3000)]
    runs = ["x" + c * 200_000 + "y z" for c in (" ", "\n", "a", "ab", "1", ".", "中", " a", "a <|endoftext|>")]
    long = [" ".join(r.choice(["the", "été", "Onen,", "12", "a-b", "", "\n"]) for _ in range(700_000))]
    texts = [*every, *mixed, *runs, *long]
    own = bpe.byte_bpe(PATH)
    got = [np.frombuffer(x, np.int32) for x in own.encode(texts)]
    library = Tokenizer.from_file(PATH)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(x) for x in got] == texts
    some = [[464, 50256, 99], [128, 129], [200, 201, 11]]  # bytes that are no UTF-8 too
    assert [own.decode(np.array(x)) for x in some] == [library.decode(x, skip_special_tokens=False) for x in some]


def test_ranks_take_runs_of_any_length():
    """op2's encoder, which works from ranks: millions of one character of each class, blanks among them."""
    from tokenizers import Tokenizer

    from doseframe.llm import packing

    library = Tokenizer.from_file(PATH)
    ranks = packing.encoder(PATH, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for run, n in ((" ", 5_000_000), ("\n", 1_000_000), ("\u3000", 1_000_000), ("\t ", 500_000), ("a", 1_000_000), ("1", 1_000_000), (".", 1_000_000), ("<|endoftext|> ", 100_000)):
        text = "x" + run * n + "y"
        assert ranks([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_does_not_matter(monkeypatch):
    texts = [f"{i} and{i % 7} th{i}ing" for i in range(500)]
    want = bpe.byte_bpe(PATH).encode(texts)
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "PART", 300)
    assert bpe.ByteBpe(PATH).encode(texts) == want
    assert bpe.ByteBpe(PATH).encode(["".join(texts)]) == [b"".join(bpe.byte_bpe(PATH).encode(["".join(texts)]))]


def test_rows(spark):
    """Nulls, empty texts, repeated rows, other columns of clashing names, and an empty table."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("n_tokens", T.LongType())])
    docs = spark.createDataFrame([(1, "a b", "x", 1), (1, "a b", "x", 1), (2, None, "x", 1), (3, "", None, 1), (None, "é", "x", 1)], schema)
    out = bpe.decoded(bpe.encoded(docs)).collect()
    key = lambda x: str(x)
    assert sorted(((r.doc_id, r.ids, r.text) for r in out), key=key) == sorted([(1, [64, 275], "a b")] * 2 + [(2, [], ""), (3, [], ""), (None, [2634], "é")], key=key)
    assert bpe.decoded(bpe.encoded(docs.limit(0))).collect() == []


def test_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {(i, len(x), sha(",".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))) for i, x in ids.items()}
    assert {tuple(r) for r in queries.op13_bpe_roundtrip(spark, SF).collect()} == want
