"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects a document whose statistic exceeds a cutoff. Cutoffs come from a grid fixed in advance. Labelled
documents give, for each stratum (language), rule and cutoff, how many of n good documents it would reject; an exact
binomial test must show, at level DELTA shared among all these tests (Bonferroni), that the rate of false rejection is
at most ALPHA over the number of rules. So with confidence 1 - DELTA no stratum loses more than ALPHA of its good
documents. Of the cutoffs that pass, the one that best parts bad from good is taken; without one, the rule is off.

Every language with LEAST labelled documents is a stratum, however many there are; with fewer no cutoff could be certified
for a language alone (at the level left to one of hundreds of tests), so the others are judged together. How many strata
there are depends on the number of labels only, not on what they say, and the tests of all strata share DELTA.

Defined cases: null text is an empty document, which the base rule rejects; null and rare languages form one stratum;
a doc_id labelled twice counts as good if any label says so; rows that share a doc_id are judged each; with no or too
few labels only the base rule acts; an empty table gives an empty result; helper columns bear reserved names (_rule_).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.native_text import SYMBOLS, count_of, whole, word_array

ALPHA, DELTA, LEAST, WEIGHT = 0.05, 0.05, 1000, 10.0
#: GRID: cutoffs of each rule. Up to SMALL strata are broadcast, more are shuffled.
GRID, SMALL = 32, 10_000
#: Rules: the statistic and its grid's first and last cutoff (geometric between).
RULES = {
    "symbols_a_word": ("n_symbols / greatest(n_words, 1)", 0.02, 4.0),
    "shouts_a_word": ("_rule_shouts / greatest(n_words, 1)", 0.02, 4.0),
    "duplicate_lines": ("n_dup_lines / greatest(_rule_lines, 1)", 0.05, 1.0),
    "repeated_words": ("n_repeat_words / greatest(n_words, 1)", 0.02, 0.5),
    "long_words": ("word_chars / greatest(n_words, 1)", 7.0, 40.0),
    "short_words": ("greatest(n_words, 1) / greatest(word_chars, 1)", 0.2, 1.0),
}


def grid(rule: str) -> list[float]:
    _, a, b = RULES[rule]
    return [a * (b / a) ** (i / (GRID - 1)) for i in range(GRID)]


def statistics(docs: DataFrame, mask: int = -1) -> DataFrame:
    """docs with the base statistics of each whole text and those of the rules.

    Windows of three words are equal if their words are: hashes (of which mask leaves some bits, for tests) only bring
    them together, and a text with two windows of one hash and other words sorts its windows by the words."""
    text = whole()
    out = docs.withColumns({"_rule_words": word_array(), "_rule_split": F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^ \\t-\\r]"))})
    out = out.withColumns(
        {
            "n_words": F.size("_rule_words").cast("long"),
            "word_chars": F.length(F.array_join("_rule_words", "")).cast("long"),
            "n_symbols": count_of(text, SYMBOLS).cast("long"),
            "_rule_shouts": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
            "_rule_lines": F.size("_rule_split"),
            "n_dup_lines": (F.size("_rule_split") - F.size(F.array_distinct("_rule_split"))).cast("long"),
            "_rule_hashes": F.transform("_rule_words", lambda w: F.xxhash64(w)),
        }
    )
    # A window's hash shares a long with its place: sorted, windows of one hash are neighbours, in order of place.
    out = out.withColumns({"_rule_bits": F.length(F.bin("n_words")), "_rule_windows": F.slice("_rule_hashes", 1, F.greatest(F.size("_rule_hashes") - 2, F.lit(0)))})
    window = lambda x, i: F.xxhash64(x, F.col("_rule_hashes")[i + 1], F.col("_rule_hashes")[i + 2]).bitwiseAND(F.lit(mask).cast("long"))
    out = out.withColumn("_rule_packed", F.transform("_rule_windows", lambda x, i: F.call_function("shiftleft", window(x, i), F.col("_rule_bits")).bitwiseOR(i.cast("long"))))
    out = out.withColumn("_rule_sorted", F.sort_array("_rule_packed"))
    s, bits, w = F.col("_rule_sorted"), F.col("_rule_bits"), F.col("_rule_words")
    right = lambda x: F.call_function("shiftright", x, bits)
    place = lambda x: (x - F.call_function("shiftleft", right(x), bits)).cast("int")
    left = lambda a, i: a[F.greatest(i - 1, F.lit(0))]
    pair = lambda x, i: F.when((i > 0) & (right(x) == right(left(s, i))), F.array(place(x), place(left(s, i))))
    out = out.withColumn("_rule_pairs", F.filter(F.transform("_rule_sorted", pair), lambda x: x.isNotNull()))
    unlike = lambda p: (w[p[0]] != w[p[1]]) | (w[p[0] + 1] != w[p[1] + 1]) | (w[p[0] + 2] != w[p[1] + 2])
    out = out.withColumn("_rule_clash", F.exists("_rule_pairs", unlike))
    worded = lambda x, i: F.struct(F.array(w[i], w[i + 1], w[i + 2]).alias("words"), i.alias("place"))
    out = out.withColumn("_rule_exact", F.when(F.col("_rule_clash"), F.sort_array(F.transform("_rule_windows", worded))))
    e = F.col("_rule_exact")
    same = lambda x, i: F.when((i > 0) & (x.words == left(e, i).words), F.array(x.place, left(e, i).place))
    exact = F.filter(F.transform("_rule_exact", same), lambda x: x.isNotNull())
    out = out.withColumn("_rule_places", F.array_distinct(F.flatten(F.when(F.col("_rule_clash"), exact).otherwise(F.col("_rule_pairs")))))
    out = out.withColumn("n_repeat_words", F.size(F.array_distinct(F.flatten(F.transform("_rule_places", lambda p: F.array(p, p + 1, p + 2))))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumns({f"_rule_{k}": F.expr(v[0]) for k, v in RULES.items()})
    return out.drop(*[f"_rule_{x}" for x in ("words", "split", "shouts", "lines", "hashes", "bits", "windows", "packed", "sorted", "pairs", "clash", "exact", "places")])


def strata(stats: DataFrame, labels: DataFrame, least: int = LEAST) -> DataFrame:
    """The languages with at least so many labelled documents: a row for each, so at most 1 / least of the labelled ones."""
    return stats.join(labels, "doc_id").where("lang is not null").groupBy("lang").count().where(F.col("count") >= least).select(F.col("lang").alias("_rule_lang"))


def _few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def thresholds(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, strata: int = 1) -> DataFrame:
    """(_rule_stratum, _rule_cutoffs): for each stratum, of which there are so many, a map from rule to certified cutoff."""
    labels = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("_rule_quality")).withColumnRenamed("doc_id", "_rule_doc")
    held = stats.join(labels, F.col("doc_id") == F.col("_rule_doc")).where("not base_failed")
    # How many grid cutoffs the statistic exceeds says which of them reject the document.
    level = lambda rule: F.size(F.filter(F.array(*[F.lit(x) for x in grid(rule)]), lambda c: F.col(f"_rule_{rule}") > c))
    cells = held.select("_rule_stratum", "_rule_quality", F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), level(k).alias("level")) for k in RULES])).alias("x"))
    counts = cells.groupBy("_rule_stratum", "x.rule", "x.level").agg(F.count_if(F.col("_rule_quality") == 1).alias("good"), F.count_if(F.col("_rule_quality") == 0).alias("bad"))
    at = counts.withColumns({"n_good": F.sum("good").over(W.partitionBy("_rule_stratum", "rule")), "n_bad": F.sum("bad").over(W.partitionBy("_rule_stratum", "rule"))})
    each = at.groupBy("_rule_stratum", "rule", "n_good", "n_bad").agg(F.collect_list(F.struct("level", "good", "bad")).alias("levels"))
    each = each.select("*", F.explode(F.sequence(F.lit(0), F.lit(GRID - 1))).alias("cut"))
    above = lambda what: F.expr(f"aggregate(filter(levels, x -> x.level > cut), 0L, (a, x) -> a + x.{what})")
    each = each.withColumns({"k": above("good"), "hit": above("bad"), "p": F.lit(alpha / len(RULES))})
    # ln P(X <= k) for X binomial(n, p), summed in logarithms; from the mean on it cannot be small.
    tail = F.expr(
        """case when n_good = 0 or k >= p * n_good then 0D else aggregate(
             if(k = 0, cast(array() as array<bigint>), sequence(1L, k)),
             named_struct('t', n_good * ln(1 - p), 's', n_good * ln(1 - p)),
             (a, i) -> named_struct(
               't', a.t + ln((n_good - i + 1) / i) + ln(p / (1 - p)),
               's', greatest(a.s, a.t + ln((n_good - i + 1) / i) + ln(p / (1 - p))) + ln(1 + exp(-abs(a.s - a.t - ln((n_good - i + 1) / i) - ln(p / (1 - p)))))),
             a -> a.s) end"""
    )
    tests = strata * len(RULES) * GRID
    passed = each.where(tail <= F.log(F.lit(delta / tests))).where("hit > 0")
    gain = F.col("hit") / F.col("n_bad") - WEIGHT * F.col("k") / F.col("n_good")
    best = passed.withColumn("gain", gain).where("gain > 0").groupBy("_rule_stratum", "rule").agg(F.max(F.struct(F.round("gain", 6).alias("gain"), "cut")).alias("b"))
    cutoff = F.element_at(F.create_map(*[x for k in RULES for x in (F.lit(k), F.array(*[F.lit(c) for c in grid(k)]))]), F.col("rule"))
    return best.select("_rule_stratum", "rule", F.element_at(cutoff, F.col("b.cut") + 1).alias("c")).groupBy("_rule_stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "c"))).alias("_rule_cutoffs"))


def judged(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    out = stats.join(_few(cutoffs.withColumnRenamed("_rule_stratum", "_rule_own")), F.col("_rule_stratum") == F.col("_rule_own"), "left")
    broken = [F.coalesce(F.col(f"_rule_{k}") > F.try_element_at("_rule_cutoffs", F.lit(k)), F.lit(False)) for k in RULES]
    reject = F.col("base_failed")
    for b in broken:
        reject = reject | b
    return out.withColumn("kept", ~reject)


def placed(stats: DataFrame, top: DataFrame) -> DataFrame:
    joined = stats.join(_few(top), F.col("lang") == F.col("_rule_lang"), "left")
    return joined.withColumn("_rule_stratum", F.coalesce("_rule_lang", F.lit("\x00other"))).drop("_rule_lang")


def fitted(slim: DataFrame, labels: DataFrame, alpha: float, delta: float, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The strata and their cutoffs, from written statistics."""
    bare = labels.select("doc_id", "quality")
    top = common.written(strata(slim, bare.select("doc_id").distinct(), least))
    return top, common.written(thresholds(placed(slim, top), bare, alpha, delta, top.count() + 1))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, least: int = LEAST) -> DataFrame:
    """doc_id, base statistics, base_failed and kept of each document. Texts are read once; only statistics are written."""
    slim = common.written(statistics(docs.select("doc_id", "lang", "text")).drop("text"))
    top, cutoffs = fitted(slim, labels, alpha, delta, least)
    return judged(placed(slim, top), cutoffs)


def rows_kept(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that no rule rejects, as they came. Statistics are computed again rather than joined to the texts."""
    stats = statistics(docs.select("doc_id", "lang", "text", F.struct("*").alias("_rule_row")))
    slim = common.written(stats.drop("text", "_rule_row"))
    top, cutoffs = fitted(slim, labels, alpha, delta)
    # A filter would be pushed below the statistics and repeat them; a generator is not.
    once = F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int")))
    return judged(placed(stats, top), cutoffs).select("_rule_row", once.alias("_rule_once")).select("_rule_row.*")
