import math
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

def texts():
    out = [None, "", "a", "a b", "a b c", "a a a a", " ".join(["a b c"] * 30)]
    return out + [" ".join(random.Random(k).choices("abcd" if k % 2 else "abcdefghijklmnop", k=40 + 9 * k)) for k in range(12)]


@pytest.mark.parametrize("mask", [-1, 7, 0])
def test_repeated_words_where_hashes_clash(spark, mask):
    from anchorloom.llm import quality_rules as q

    df = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = {r.doc_id: r for r in q.statistics(df, mask).collect()}
    for k, t in enumerate(texts()):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t)


def binomial(k, n, p):
    return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def test_verdicts_by_certified_cutoffs(spark):
    """Fifty languages and two rare ones: kept equals what plain sums of binomials over each stratum certify."""
    from anchorloom.llm import quality_rules as q

    rng, rows, least = random.Random(4), [], 60
    for i in range(5200):
        good, lang = rng.random() < 0.8, f"l{i % 50}" if i < 5000 else "rare" if i % 2 else None
        plain = [f"w{rng.randrange(900)}" for _ in range(55)]
        rows.append((i, " ".join(plain + ["#" * (0 if good else rng.randrange(60, 90))]), lang, int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int").repartition(4)
    # A wide alpha, so that about eighty good documents of a language certify a cutoff.
    made = {r.doc_id: r for r in q.judge(df.drop("quality"), df.select("doc_id", "quality"), alpha=0.9, least=least).collect()}
    counts = {}
    for _, _, lang, _ in rows:
        counts[lang] = counts.get(lang, 0) + 1
    own = {k for k, n in counts.items() if k and n >= least}
    assert len(own) == 51
    level, p = 0.05 / ((len(own) + 1) * len(q.RULES) * q.GRID), 0.9 / len(q.RULES)
    on = 0
    for stratum in [*sorted(own), None]:
        inside = [r for r in rows if (r[2] if r[2] in own else None) == stratum and not brute.rules(r[1])[5]]
        good = [r for r in inside if r[3]]
        value = {r[0]: brute.rules(r[1])[2] / max(1, brute.rules(r[1])[0]) for r in inside}
        passed = []
        for c in q.grid("symbols_a_word"):
            k, hit = sum(value[r[0]] > c for r in good), sum(value[r[0]] > c for r in inside if not r[3])
            if hit and binomial(k, len(good), p) <= level:
                passed.append(c)
        for r in inside:
            assert made[r[0]].kept or r[3] == 0
            if not passed:
                continue
            assert made[r[0]].kept == (r[3] == 1)
        on += bool(passed)
    assert on >= 40


def test_counts_of_frequent_pairs_are_whole(spark):
    from anchorloom.llm import language_model as lm

    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("abcde", k=60)) + (" q r" if i % 3 else "")) for i in range(50)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(None).cast("string"))
    plain, cut = lm.train(docs), lm.train(docs, most=3)
    assert not plain.frequent[0] and len(cut.frequent[0]) >= 25 and max(cut.frequent[1]) > 100
    score = lambda m: sorted(map(str, lm.score(docs, m).collect()))
    assert score(plain) == score(cut)


def test_windows_of_long_texts_have_numbers_of_their_own(spark):
    from anchorloom.llm import packing

    rows = [(k, f"w{k} " * 90) for k in range(6)]
    made = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), window=4).where("length = 4").collect()
    assert len({r.sequence_id for r in made}) == len(made) > 100
