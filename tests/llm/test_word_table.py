from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from tests.llm.test_token_operators import ODD

MORE = ["foo<|ENDOFTEXT|>bar A<|endoftext|>B <|StartOfText|> <|startoftext|>", "a   b", "   ", "x\x85y \x1cz\x00w", "'S it's WE'LL", "́start Ǆ ﬁ İ", "A" * 5000 + " " + "b1" * 3000, "q​ w﻿e"]
TEXTS = [(r[0], r[1]) for r in brute.awkward()] + [(100 + k, t) for k, t in enumerate(ODD + MORE)] + [(None, None), (5, "")]


@pytest.fixture(scope="module")
def tokenizer():
    from anchorloom.llm.tokens import tokenizer_path
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, rows):
    made = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    return Counter((d, len(x), np.array(x, "<u4").tobytes(), tokenizer.decode(x, skip_special_tokens=False)) for d, x in made)


@pytest.mark.parametrize("stretch,limit,most", [(1 << 20, 4_000_000, 200_000), (7, 10, 30), (7, 40, 0)])
def test_encode_and_decode(spark, tokenizer, monkeypatch, stretch, limit, most):
    from anchorloom.llm import word_table

    monkeypatch.setattr(word_table.stretches, "__defaults__", (stretch,))
    docs = spark.createDataFrame([(d, t, 1, b"x", "y") for d, t in TEXTS], "doc_id long, text string, batch int, ids binary, decoded string").repartition(3, "text")
    got = word_table.decode(word_table.encode(docs, limit=limit, most=most)).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == expected(tokenizer, TEXTS)


def test_empty_table(spark):
    from anchorloom.llm import word_table

    made = word_table.decode(word_table.encode(spark.createDataFrame([], "doc_id long, text string")))
    assert made.columns == ["doc_id", "n_tokens", "ids", "decoded"] and made.count() == 0


def test_decode_any_ids(spark, tokenizer):
    from anchorloom.llm import word_table

    ids = [[], [49406, 5, 49407, 255, 300], [99999, 127, 1 << 31], list(range(3000)), None]
    rows = [(k, None if x is None else np.array(x, "<u4").tobytes()) for k, x in enumerate(ids)]
    got = {r.k: r.decoded for r in word_table.decode(spark.createDataFrame(rows, "k int, ids binary")).collect()}
    assert got == {k: None if x is None else tokenizer.decode(x, skip_special_tokens=False) for k, x in enumerate(ids)}


def test_each_distinct_word_is_encoded_once(spark):
    from anchorloom.llm import word_table
    from anchorloom.llm.tokens import tokenizer_path
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "the same words The " + f"own{k % 7}") for k in range(500)], "doc_id long, text string").repartition(6)
    held = word_table.batches(docs, word_table.WORDS)
    table = word_table.word_table(held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("many")), tokenizer_path()).collect()
    assert sorted(bytes(r.word) for r in table) == sorted([b"the", b"same", b"words", *[b"own%d" % k for k in range(7)]])


def test_changed_batches_fail(spark, tmp_path):
    from anchorloom.llm import word_table

    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "t"))
    made = word_table.encode(spark.read.parquet(str(tmp_path / "t")))
    spark.createDataFrame([(1, "three four")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "t"))
    with pytest.raises(Exception, match="other batches|does not exist|FILE_NOT_EXIST"):
        made.collect()


def test_bound_on_broadcast_words(spark):
    from anchorloom.llm import word_table

    counts = [1] * 50 + [2] * 20 + [3] * 10 + [7] * 5 + [1000, 1_000_000]
    table = spark.createDataFrame([(b"w", m) for m in counts], "word binary, many long")
    for most in range(len(counts) + 2):
        at = word_table.frequent(table, most)
        assert sum(c >= at for c in counts) <= most
    assert word_table.frequent(table, len(counts)) == 1 and word_table.frequent(table, 20) == 3


class Caught:
    """Stands for a table: gives the function that a worker would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_workers_keep_no_words_of_the_table(monkeypatch):
    import pyarrow as pa
    from anchorloom.llm import tokens, word_table

    monkeypatch.setattr(tokens, "_encoders", {})
    run = word_table.word_table(Caught(), tokens.tokenizer_path())
    words = [b"word" + bytes([97 + k % 26, 97 + k // 26 % 26, 97 + k // 676]) + b"," * (k % 2) for k in range(10_000)]
    blocks = [pa.RecordBatch.from_arrays([pa.array(words[a : a + 500], pa.binary()), pa.array([1] * 500, pa.int64())], ["word", "many"]) for a in range(0, 10_000, 500)]
    assert sum(b.num_rows for b in run(iter(blocks))) == 10_000
    (enc,) = tokens._encoders.values()
    assert len(enc.memory) + len(enc.older) <= 2000


def test_distinct_words_bound_a_batch(spark, tokenizer):
    from anchorloom.llm import word_table

    rows = [(k, " ".join(f"own{k}x{i}" for i in range(20)) + " the same") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    made = word_table.batches(docs, word_table.WORDS, held=10_000).collect()
    assert len(made) > 10 and max(sum(len(w) + word_table.OWN for w in r.words) for r in made) < 10_000 + 22 * 120
    got = word_table.decode(word_table.encode(docs, held_bytes=10_000)).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got) == expected(tokenizer, rows)
