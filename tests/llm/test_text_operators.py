import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute

ROWS = brute.awkward()
PAIRS = [(r[0], r[1]) for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, brute.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (12, 0, 0), (None, 1, 0), (13, None, 0)], "doc_id long, quality int, toxic int")


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_personal_data(docs, none):
    from anchorloom.llm import personal_data as pd

    found = pd.spans(docs).select("doc_id", pd.named(True), pd.named(False)).collect()
    assert sorted((str(r[0]), r[1]) for r in found) == sorted((str(d), ",".join(brute.private(t))) for d, t in PAIRS)
    assert all(set(r[1].split(",")) <= set(r[2].split(",")) for r in found if r[1])
    assert pd.spans(none).count() == 0
    masked = pd.mask(docs)
    assert masked.columns == docs.columns and masked.count() == len(ROWS)
    text = masked.where("doc_id = 11").first().text
    assert "<email>" in text and "<ip>" in text and "<card>" in text and "<phone>" in text and "a.b@c" not in text
    assert pd.mask(none).count() == 0


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "x" * 50_000 + "@", "9" * 50_000, "+1" + "(" * 40_000, "1.2.3.4@x.com 12345678901234.1.1.1", "a@b.c@d.e", "4111-1111-1111-1111 4111111111111111"])
def test_personal_data_shapes(spark, text):
    from anchorloom.llm import personal_data as pd

    found = pd.spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(pd.named(True)).first()[0]
    assert found == ",".join(brute.private(text))


def test_reliabilities_tell_good_labelers_from_bad(spark):
    from anchorloom.llm import personal_data as pd

    rng, counts = np.random.default_rng(3), collections.Counter()
    for _ in range(20_000):
        real = rng.random() < 0.4
        votes = [rng.random() < (a if real else b) for a, b in ((0.95, 0.05), (0.8, 0.1), (0.9, 0.3), (0.5, 0.5))]
        counts[sum(1 << i for i, v in enumerate(votes) if v)] += 1
    got = pd.reliabilities(spark.createDataFrame(list(counts.items()), "votes int, n long")).first()
    assert abs(got.p - 0.4) < 0.03 and abs(got.yes[0] - 0.95) < 0.03 and abs(got.no[1] - 0.1) < 0.03 and abs(got.yes[3] - got.no[3]) < 0.05


def test_near_join(docs, none):
    from anchorloom.llm import near_join

    assert rows(near_join.join(docs), "doc_id", "n_shingles", "component_id") == brute.near(PAIRS)
    assert near_join.join(none).count() == 0
    kept = near_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, 11, 12, 13, 14, 15, None}


def test_near_join_of_random_texts(spark):
    """Random edits around the threshold; blocks far beyond the chunk size."""
    from anchorloom.llm import common, near_join

    rng, data = np.random.default_rng(5), []
    seeds = [brute.passage(f"t{k}_", int(rng.integers(6, 90))) for k in range(6)]
    for i in range(150):
        w = list(seeds[int(rng.integers(len(seeds)))])
        for _ in range(int(rng.integers(0, 4))):
            w[int(rng.integers(len(w)))] = f"e{int(rng.integers(30))}"
        data.append((i, " ".join(w)))
    df = spark.createDataFrame(data, "doc_id long, text string")
    want = brute.near(data)
    assert rows(near_join.join(df), "doc_id", "n_shingles", "component_id") == want
    # Chunks of four documents: the rounds for large blocks find the same.
    table = common.written(near_join.classes(df).withColumn("rep", F.col("doc_id")))
    placed = common.written(near_join.blocks(df, table))
    grown = near_join.components(near_join.links(df, placed, block=4))
    got = {r.node: r.component for r in grown.collect()}
    assert sorted(((d, n, got.get(d, d)) for d, n, _ in want), key=str) == want


def test_count_tree_leaves_out_no_link():
    from anchorloom.llm import near_join

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, int(n)).astype(np.uint64) << np.uint64(20)) for n in rng.integers(1, 300, 80)]
    sets += [np.unique(np.concatenate([s[: max(1, len(s) - 2)], rng.integers(0, 400, 1).astype(np.uint64) << np.uint64(20)])) for s in sets[:40]]
    counts = np.array([np.bincount((s >> np.uint64(20)).astype(int) % near_join.GROUPS, minlength=near_join.GROUPS) for s in sets])
    found = {frozenset((int(a), int(b))) for i, j, _ in near_join.CountTree(counts, np.array([len(s) for s in sets])).pairs() for a, b in zip(i, j, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            c = len(np.intersect1d(sets[i], sets[j]))
            if 100 * c >= 75 * (len(sets[i]) + len(sets[j]) - c):
                assert frozenset((i, j)) in found


def test_source_mix(docs, none):
    from anchorloom.llm import mixing

    got = mixing.summary(docs).collect()
    source = {(r[0], r[1]): r[3] for r in ROWS}
    sizes = collections.Counter()
    for r in ROWS:
        sizes[r[3]] += len(brute.words(r[1]))
    want = brute.targets(sizes)
    assert sorted((str(r.doc_id), r["size"]) for r in got) == sorted((str(d), len(brute.words(t))) for d, t in PAIRS)
    by_doc, taken = {d: s for (d, _), s in source.items()}, collections.Counter()
    for r in got:
        s = by_doc[r.doc_id]
        assert math.isclose(r.target, want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.summary(docs).collect()))
    assert mixing.summary(none).count() == 0
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and {r.text for r in mixed.collect()} <= {t for _, t in PAIRS}


def test_targets_like_resharing_by_rounds(spark):
    from anchorloom.llm import mixing

    rng = np.random.default_rng(2)
    for _ in range(4):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.pareto(0.7, 9) * 100)} | {None: 5, "": 0}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        want = brute.targets(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-6) for s in sizes)


def test_substring_dedup(docs, none):
    from anchorloom.llm import substring_dedup

    assert rows(substring_dedup.remove(docs), "doc_id", "n_words", "n_removed", "kept") == brute.deduped(PAIRS)
    assert substring_dedup.remove(none).count() == 0


def test_quality_rules(docs, none, labels):
    from anchorloom.llm import quality_rules

    made = quality_rules.judge(docs, labels)
    got = rows(made, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert got == sorted(((d, *brute.rules(t)) for d, t in PAIRS), key=str)
    assert all(r.kept != r.base_failed for r in made.collect())  # five labels certify no cutoff
    assert quality_rules.rows_kept(docs, labels).columns == docs.columns
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).count() == len(ROWS)


def test_thresholds_are_exact_binomial(spark):
    """The cutoff taken is certified: the binomial tail, summed plainly, is below the shared level."""
    from anchorloom.llm import quality_rules as q

    good, bad = 4000, 400
    rng = np.random.default_rng(0)
    data = [(i, "en", 0.0 if rng.random() > 0.001 else 2.0, 1) for i in range(good)] + [(good + i, "en", 3.0, 0) for i in range(bad)]
    stats = spark.createDataFrame(data, "doc_id long, lang string, x double, quality int")
    labels = stats.select("doc_id", "quality")
    stats = stats.withColumns({f"_rule_{k}": F.col("x") if k == "symbols_a_word" else F.lit(0.0) for k in q.RULES} | {"base_failed": F.lit(False), "_rule_stratum": F.lit("en")})
    cutoffs = q.thresholds(stats, labels).first()._rule_cutoffs
    assert set(cutoffs) == {"symbols_a_word"} and cutoffs["symbols_a_word"] < 3
    k, p = sum(1 for r in data if r[3] == 1 and r[2] > cutoffs["symbols_a_word"]), q.ALPHA / len(q.RULES)
    tail = sum(math.comb(good, i) * p**i * (1 - p) ** (good - i) for i in range(k + 1))
    assert tail <= q.DELTA / (len(q.RULES) * q.GRID)
    assert q.thresholds(stats.where("doc_id < 300 or quality = 0"), labels).count() == 0


def test_language_model(docs, none):
    from anchorloom.llm import language_model as lm

    model = lm.train(docs.where(~lm.held_out()))
    train = [t for d, t in PAIRS if d is None or zlib.crc32(str(d).encode()) % 7 != 2]
    tok = lambda t: [*brute.words(brute.lower(t)), "\n"]
    count, pair = collections.Counter(), collections.Counter()
    for t in train:
        count.update(tok(t))
        pair.update(zip(["\n", *tok(t)[:-1]], tok(t), strict=True))
    n, v = sum(count.values()), len(count)
    assert model.tokens == n and model.vocabulary == v and model.types == len(pair)
    before = collections.Counter(b for _, b in pair)
    d, low_d = ([0, *lm.discounts(*(sum(c == k for c in x.values()) for k in (1, 2, 3, 4)))] for x in (pair, before))
    rest = sum(low_d[min(c, 3)] for c in before.values()) / len(pair)

    def p(a, b):
        low = max(before[b] - low_d[min(before[b], 3)], 0) / len(pair) + rest / (v + 1)
        if not count[a]:
            return low
        free = sum(d[min(c, 3)] for (x, _), c in pair.items() if x == a) / count[a]
        return max(pair[a, b] - d[min(pair[a, b], 3)], 0) / count[a] + free * low

    assert math.isclose(sum(p("alpha0", w) for w in count) + p("alpha0", "?unseen"), 1)
    short = docs.where("doc_id <> 13")
    got = {(r.doc_id, r.n_tokens): r for r in lm.score(short, model).collect()}
    for doc, t in PAIRS:
        if doc is None or doc == 13:
            continue
        w = tok(t)
        r = got[doc, len(w)]
        assert r.n_known == sum(count[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["\n", *w[:-1]], w, strict=True)), rel_tol=1e-9)
    empty = lm.train(none)
    assert empty.tokens == 0 and lm.score(docs, empty).count() == len(ROWS) and lm.score(none, model).count() == 0


def test_quality_model(docs, none, labels):
    from anchorloom.llm import quality_model as qm

    made = qm.score(docs, labels).collect()
    assert len(made) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in made)
    assert all(r.score == 0.5 for r in qm.score(docs, labels.limit(0)).collect()) and qm.score(none, labels).count() == 0


def test_trees_learn_and_flat_arrays_agree():
    from anchorloom.llm import quality_model as qm

    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = qm.fit(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95

    def walk(row):
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += leaf[node - len(f)]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.scores(x[:50]), [walk(r) for r in x[:50]])
