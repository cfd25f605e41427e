import random
import re

import pytest
from pyspark.sql import functions as F

from anchorloom.llm import personal_data as pd


def _masked(text, spans):
    out, end = "", 0
    for at, k, stop in spans:
        if at >= end:
            out += text[end:at] + f"<{pd.KINDS[k]}>"
        end = max(end, stop)
    return out + text[end:]


def _text(seed, n):
    rnd = random.Random(seed)
    kinds = [
        lambda: f"a{rnd.randrange(99)}@mail{rnd.randrange(9)}.org", lambda: f"10.{rnd.randrange(256)}.3.{rnd.randrange(300)}", lambda: "+1 (212) 555-0" + str(rnd.randrange(100, 999)), lambda: "4111 1111 1111 1111",
        lambda: "token = " + "".join(rnd.choice("0123456789abcdef") for _ in range(40)), lambda: "ssn 123-45-6789", lambda: "(212) 555-0100", lambda: "häuser", lambda: "x-212-555-0100@y.org", lambda: "10.1.2.3-aaaa_bbbb_cccc1", lambda: "+1 212 555 0100 123-45-6789",
    ]
    return rnd.choice((" ", ", ", "\n")).join(rnd.choice(kinds)() for _ in range(n))


@pytest.mark.parametrize("run", [2, 128])
def test_sweeps_equal_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(pd, "RUN", run)
    texts = [_text(i, n) for i, n in enumerate((1, 3, 40, 300, 5, 17, 64))] + ["", None, "no data here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    everything = df.withColumn("_pii_text", F.coalesce("text", F.lit(""))).withColumn("_pii_digits", F.lit(True))
    every = everything.select("doc_id", *[F.expr(f"transform(filter({pd._found(k)}, x -> {pd._valid(k)}), x -> struct(x.at, x.k, x.at + length(x.span)))").alias(k) for k in pd.KINDS]).collect()
    want = {}
    for r in every:
        spans = sorted(tuple(x) for k in pd.KINDS for x in r[k])
        base = [s for s in spans if s[1] < len(pd.BASE)]
        want[r.doc_id] = [s for s in spans if s[1] < len(pd.BASE) or not any(b[0] < s[2] and s[0] < b[2] for b in base)]
    found = pd.candidates(df)
    got = {r.doc_id: [(x["at"], x["k"], x["end"]) for x in r["_pii_spans"]] for r in found.collect()}
    assert got == want and any(len(x) > 2 * run for x in got.values())
    kept = {r.doc_id: [(x["at"], x["k"], x["end"]) for x in r["_pii_spans"]] for r in pd.spans(df).collect()}
    masked = {r.doc_id: r.text for r in pd.mask(df).collect()}
    assert masked == {i: t if t is None else _masked(t, kept[i]) for i, t in enumerate(texts)}


def test_a_text_of_many_spans_takes_no_square_of_time(spark):
    text = " ".join(f"a{i}@m.org 123-45-{i % 9000 + 1000}" for i in range(20_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = pd.mask(df).first().text
    assert len(re.findall("<email>", out)) == 20_000 and "@" not in out


def test_rates_by_kind_part_where_labelers_differ(spark):
    rows = [(0, 15, 400), (0, 0, 400), (1, 13, 300), (1, 2, 300), (2, 15, 1)]  # for kind 1, the second labeler (2) is wrong
    patterns = spark.createDataFrame(rows, "k int, votes int, n long")
    pooled = pd.reliabilities(patterns)
    p = pooled.first()
    by = {r.k: r for r in pd.reliabilities(patterns, pooled=pooled).collect()}
    assert by[0].yes[1] > 0.9 and by[0].no[1] < 0.1 and by[1].yes[1] < 0.1 < 0.9 < by[1].no[1]
    assert by[0].no[1] < p.no[1] < by[1].no[1] and abs(by[2].yes[0] - p.yes[0]) < 0.1  # one candidate says little


def test_a_word_that_no_list_holds_is_learnt(spark):
    rnd = random.Random(3)
    key = lambda: "".join(rnd.choice("0123456789abcdef") for _ in range(32))
    texts = [f"token = {key()} and vorzeichen = {key()}" for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert "vorzeichen" not in pd.CUES
    assert all(len(r["_pii_spans"]) == 2 for r in pd.spans(df).collect())
