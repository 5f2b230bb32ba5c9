import random

import pytest
import tiktoken
from pyspark.sql import functions as F

from catalith.llm.encoding import SPLIT, VOCABULARY, Encoder, count_tokens, decode_ids, encode_texts, merge_long, merge_short, read_ranks

with open(VOCABULARY, "rb") as _file:
    RANKS = read_ranks(_file.read())
ORACLE = tiktoken.Encoding("own", pat_str=SPLIT.replace(r"\p{White_Space}", r"\s").replace(r"\P{White_Space}", r"\S"), mergeable_ranks=RANKS, special_tokens={})

TEXTS = [
    "", None, " ", "a", "Hello  world\n\n\n  x ", "<|endoftext|>", "don't WE'LL 's", "漢字カナ مرحبا привет", "\x1c\x1d\x85  y  ", "🙂" * 300, "a" * 3000, "ab" * 999 + "!" * 401, "\0\1",
    "x = {1: 'a',\r\n\t\t2: \"b\"}", " " * 700 + "x", "é" * 150, "é" * 300, "long " * 200_000,
]


def test_texts_against_another_encoder(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, "a"])], "doc_id long, text string, ids string")
    rows = encode_texts(df, "doc_id", "text").collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = [*TEXTS, "a"][r["doc_id"]]
        assert r["ids"] == (ORACLE.encode_ordinary(text) if text else [])


def test_round_trip():
    encoder, back = Encoder(RANKS), {v: k for k, v in RANKS.items()}
    for text in TEXTS:
        assert b"".join(back[i] for i in encoder.encode(text)).decode() == (text or "")


@pytest.mark.parametrize("alphabet", [b"ab", b"the ", bytes(range(256))])
def test_short_and_long_words_alike(alphabet):
    rnd = random.Random(alphabet)
    for n in (1, 2, 3, 50, 199, 400):
        word = bytes(rnd.choice(alphabet) for _ in range(n))
        assert merge_short(word, RANKS) == merge_long(word, RANKS)


def test_null_keys_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in encode_texts(df, "doc_id", "text").collect()) == [(0, 2), (1, 2), (1, 2)]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


def test_counts(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    both = count_tokens(df, "text").join(encode_texts(df, "doc_id", "text"), "doc_id")
    assert both.where(F.col("n_tokens") != F.size("ids")).count() == 0 and both.count() == len(TEXTS)


def test_ids_stand_for_the_texts_bytes(spark):
    texts = ["", None, "plain", "é漢🙂 <|endoftext|> \n\n  x", "a" * 3000, "plain"]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "doc_id long, text string, data string")
    back = decode_ids(encode_texts(df, "doc_id", "text").unionByName(spark.createDataFrame([(9, None)], "doc_id long, ids array<int>")), "ids")
    assert {r["doc_id"]: r["data"] for r in back.collect()} == {**{i: bytearray((t or "").encode()) for i, t in enumerate(texts)}, 9: None}
