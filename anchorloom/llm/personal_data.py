"""PII by weak supervision, in DataFrame operations only.

Candidate spans of each whole text come from patterns: the base kinds, whose valid matches always stay, and the wider
kinds of WIDER. Labelers vote on each candidate: the strict shape (regex), a cue word before it (gazetteer), clean
edges (context) and mixed characters (shape); of the text around, they see the NEAR characters before a span and one after it.
Candidates are counted by kind and votes, a table of at most kinds x 16 rows, on which expectation-maximisation estimates each
labeler's rates of voting for real and for other spans: first over all kinds, then for each kind, drawn towards the rates of
all by PULL candidates. The posteriors then train the final span classifier: naive Bayes over bounded features that hold no
vote, among them the word before a span in WORDS buckets, so that it learns its own cue words; one grouped sum of posteriors.
A wider span stays if the classifier finds it more likely real than not and no base span overlaps it.

Defined cases: null text is empty and has no spans; rows that share a doc_id are judged each; an empty table gives an
empty result; without candidates there is nothing to train and nothing to keep; extra columns stay in mask() and are not
read elsewhere; helper columns bear reserved names (prefix _pii_). Spans of one text are swept once, in runs of RUN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.native_text import whole

ROUNDS, RUN, NEAR, PULL, WORDS = 20, 128, 24, 20, 64
#: Base patterns, written so that Java neither recurses nor scans a run of characters again from each of its places; they match what the plain patterns match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+(?![A-Za-z0-9_-])",
    "ident": r"(?<![A-Za-z0-9+.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "local_phone": r"(?<![A-Za-z0-9+.)-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9-])",
}
KINDS = [*BASE, *WIDER]
#: Words that announce a span.
CUES = "api auth bearer call card contact email fax host id ip key mail mobile passwd password phone pin secret ssn tel telephone token user visa".split()
LABELERS = ("regex", "gazetteer", "context", "shape")
STRICT = {
    "email": r"^[^@]+@[^@]*\.[A-Za-z]{2,}$",
    "ip": r"^(?!0\d)[1-9]",
    "card": r"^[0-9]{14,19}$|^[0-9]{4}([ -][0-9]{2,6})+$",
    "phone": r"^\+[0-9]{1,3}[ (.-]",
    "secret": r"^(AKIA|ASIA|gh[a-z]_|sk-|xox)|^[0-9a-f]+$|^[0-9A-F]+$",
    "ident": r"^(?!000|666|9)",
    "local_phone": r"^\(?[2-9]",
}
LUHN = """aggregate(sequence(1, length(digits)), 0, (a, i) -> a + case
    when i % 2 = 1 then cast(substr(turned, i, 1) as int)
    else cast(substr('0246813579', cast(substr(turned, i, 1) as int) + 1, 1) as int) end) % 10 = 0"""


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: str) -> str:
    """Matches of a kind with their places: matches and the pieces between them alternate. Places are summed in runs of RUN
    matches, and runs are placed by their sums, so a text of many matches takes no square of time."""
    p = _sql(BASE.get(kind) or WIDER[kind])
    guard = {"email": "contains(_pii_text, '@')", "phone": "contains(_pii_text, '+')"}.get(kind, "_pii_digits")
    empty = "cast(array() as array<struct<at: int, k: int, span: string, before: string, after: string>>)"
    step = f"""named_struct('end', a.end + length(x.piece[i]) + length(x.hit[i]), 'out', concat(a.out, array(named_struct(
        'at', a.end + length(x.piece[i]), 'k', {KINDS.index(kind)}, 'span', x.hit[i], 'before', right(x.piece[i], {NEAR}), 'after', left(x.piece[i + 1], 1)))))"""
    both = f"named_struct('hit', regexp_extract_all(_pii_text, {p}, 0), 'piece', split(_pii_text, {p}, -1))"
    within = f"sequence(r * {RUN}, least((r + 1) * {RUN}, size(x.hit)) - 1)"
    runs = f"sequence(0, (size(x.hit) - 1) div {RUN})"
    sums = f"transform({runs}, r -> aggregate({within}, 0, (a, i) -> a + length(x.piece[i]) + length(x.hit[i])))"
    starts = f"aggregate({sums}, array(0), (a, n) -> concat(a, array(a[size(a) - 1] + n)))"
    placed = f"flatten(transform({runs}, r -> aggregate({within}, named_struct('end', s[r], 'out', {empty}), (a, i) -> {step}, a -> a.out)))"
    return f"""if({guard}, transform(array({both}), x -> if(size(x.hit) = 0, {empty}, transform(array({starts}), s -> {placed})[0]))[0], {empty})"""


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.span, '[^0-9]', '')"
    luhn = f"transform(array(named_struct('digits', {digits})), d -> transform(array(named_struct('digits', d.digits, 'turned', reverse(d.digits))), t -> {LUHN.replace('digits)', 't.digits)').replace('turned', 't.turned')})[0])[0]"
    return {
        "email": "true",
        "ip": "forall(split(x.span, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', ltrim('0', p)) as int) <= 255)",
        "card": f"length({digits}) between 14 and 19 and {luhn}",
        "phone": f"length({digits}) between 10 and 15",
        "secret": "x.span rlike '[0-9]' and x.span rlike '[A-Za-z]'",
        "ident": "true",
        "local_phone": "true",
    }[kind]


def candidates(docs: DataFrame) -> DataFrame:
    """docs (with text) and _pii_spans: candidates in order of start and kind, with votes (bits) and features."""
    out = docs.withColumn("_pii_text", whole())
    out = out.withColumn("_pii_digits", F.col("_pii_text").rlike("[0-9]"))
    out = out.withColumns({f"_pii_{k}": F.expr(f"filter({_found(k)}, x -> {_valid(k)})") for k in KINDS})
    strict = " ".join(f"when {i} then x.span rlike {_sql(STRICT[k])}" for i, k in enumerate(KINDS))
    cues = ", ".join(_sql(c) for c in CUES)
    digits = "length(regexp_replace(x.span, '[^0-9]', ''))"
    votes = f"""cast(case x.k {strict} end as int)
        + 2 * cast(lower(regexp_extract(x.before, '([A-Za-z]+)[^A-Za-z]{{0,4}}$', 1)) in ({cues}) as int)
        + 4 * cast(x.before rlike '(^|[\\\\s=:"\\'(<,;])$' and x.after rlike '^$|[\\\\s"\\')>,;.!?]' as int)
        + 8 * cast(10 * {digits} >= length(x.span) and size(array_distinct(split(x.span, ''))) >= 6 as int)"""
    edge = """case when x.before = '' then 0 when x.before rlike '[=:]\\\\s*["\\']?$' then 1 when x.before rlike '\\\\s$' then 2 else 3 end"""
    word = f"""transform(array(lower(regexp_extract(x.before, '([A-Za-z]+)[^A-Za-z]{{0,4}}$', 1))), w -> if(w = '', {WORDS}, cast(crc32(cast(w as binary)) % {WORDS} as int)))[0]"""
    struct = f"""named_struct('at', x.at, 'k', x.k, 'end', x.at + length(x.span), 'votes', {votes}, 'size', least(length(x.span) div 4, 15),
        'digits', cast(8 * {digits} / length(x.span) as int), 'edge', {edge}, 'word', {word})"""
    every = f"concat({', '.join(f'_pii_{k}' for k in KINDS)})"
    out = out.withColumn("_pii_spans", F.expr(f"array_sort(transform({every}, x -> {struct}))"))
    out = out.withColumn("_pii_spans", F.expr(f"if(exists(_pii_spans, x -> x.k >= {len(BASE)}), {_clear()}, _pii_spans)"))
    return out.drop("_pii_text", "_pii_digits", *[f"_pii_{k}" for k in KINDS])


def _runs() -> str:
    """_pii_spans in runs of RUN, each in order."""
    return f"transform(sequence(0, (size(_pii_spans) - 1) div {RUN}), r -> slice(_pii_spans, r * {RUN} + 1, {RUN}))"


def _through(values: str, best: str, start: int) -> str:
    """start, then the best of it and the first value, of the first two, and so on: one more than there are values."""
    return f"aggregate({values}, array({start}), (a, e) -> concat(a, array({best}(element_at(a, -1), coalesce(e, {start})))))"


def _clear() -> str:
    """Spans without wider ones that a base span overlaps: within a run they are compared, of other runs bounds say enough."""
    base, far = len(BASE), 2**31 - 1
    of_run = lambda pick, what: f"transform(runs, q -> {pick}(transform(filter(q, y -> y.k < {base}), y -> y.{what})))"
    bounds = f"named_struct('runs', runs, 'before', {_through(of_run('array_max', 'end'), 'greatest', 0)}, 'after', reverse({_through('reverse(' + of_run('array_min', 'at') + ')', 'least', far)}))"
    apart = f"b.before[r] <= x.at and b.after[r + 1] >= x.end and not exists(q, y -> y.k < {base} and y.at < x.end and x.at < y.end)"
    return f"transform(transform(array({_runs()}), runs -> {bounds}), b -> flatten(transform(b.runs, (q, r) -> filter(q, x -> x.k < {base} or ({apart})))))[0]"


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS, pooled: DataFrame | None = None) -> DataFrame:
    """p (share of real spans), and for each labeler yes (rate of votes for real spans) and no (for others).

    patterns: (k, votes, n), at most kinds x 2 ** labelers rows. One row for all kinds; with pooled, such a row, a row for each k
    whose rates are drawn towards it."""
    labelers = range(len(LABELERS))
    rate = lambda who, j: f"if((q.votes & {1 << j}) > 0, ln({who}[{j}]), ln(1 - {who}[{j}]))"
    real = "ln(s.p) + " + " + ".join(rate("s.yes", j) for j in labelers)
    other = "ln(1 - s.p) + " + " + ".join(rate("s.no", j) for j in labelers)
    share = f"transform(pats, q -> named_struct('votes', q.votes, 'r', q.n / (1 + exp(({other}) - ({real}))), 'n', q.n))"
    total = lambda of, what: f"aggregate({of}, 0D, (a, q) -> a + {what})"
    inside = lambda x: f"least(greatest({x}, 0.01D), 0.99D)"
    vote = lambda j: f"if((q.votes & {1 << j}) > 0, 1D, 0D)"
    drawn = lambda part, whole, to: inside(f"({part} + _pull * {to}) / ({whole} + _pull)")
    step = f"""transform(array({share}), e -> named_struct(
        'p', {drawn(total('e', 'q.r'), total('e', 'q.n'), '_to.p')},
        'yes', array({', '.join(drawn(total('e', f'q.r * {vote(j)}'), total('e', 'q.r'), f'_to.yes[{j}]') for j in labelers)}),
        'no', array({', '.join(drawn(total('e', f'(q.n - q.r) * {vote(j)}'), total('e', 'q.n - q.r'), f'_to.no[{j}]') for j in labelers)})))[0]"""
    one = F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))).alias("pats")
    if pooled is None:
        half = "array(0.5D, 0.5D, 0.5D, 0.5D)"
        start = "named_struct('p', 0.5D, 'yes', array(0.9D, 0.6D, 0.8D, 0.8D), 'no', array(0.3D, 0.1D, 0.5D, 0.3D))"
        ready = patterns.groupBy("votes").agg(F.sum("n").alias("n")).agg(one).select("pats", F.lit(2.0).alias("_pull"), F.expr(f"named_struct('p', 0.5D, 'yes', {half}, 'no', {half})").alias("_to"), F.expr(start).alias("_start"))
    else:
        to = pooled.select(F.struct("p", "yes", "no").alias("_to"))
        ready = patterns.groupBy("k").agg(one).crossJoin(F.broadcast(to)).select("k", "pats", F.lit(float(PULL)).alias("_pull"), "_to", F.col("_to").alias("_start"))  # pooled: one row
    out = ready.withColumn("m", F.expr(f"aggregate(sequence(1, {rounds}), _start, (s, i) -> {step})"))
    return out.select(*(["k"] if pooled is not None else []), "m.*")


FEATURES = ("k", "size", "digits", "edge", "word")


def classifier(spans: DataFrame) -> DataFrame:
    """One row: _pii_prior and _pii_odds, a map from feature:value to log odds. spans: exploded candidates, counted."""
    counts = common.written(spans.groupBy("votes", *FEATURES).agg(F.count("*").alias("n")))
    patterns = common.written(counts.groupBy("k", "votes").agg(F.sum("n").alias("n")))
    model = common.written(reliabilities(patterns, pooled=common.written(reliabilities(patterns))))
    labelers = range(len(LABELERS))
    bit = lambda j: F.col("votes").bitwiseAND(1 << j) > 0
    lean = F.log(F.col("p") / (1 - F.col("p")))
    for j in labelers:
        lean = lean + F.when(bit(j), F.log(F.col("yes")[j] / F.col("no")[j])).otherwise(F.log((1 - F.col("yes")[j]) / (1 - F.col("no")[j])))
    soft = counts.join(F.broadcast(model), "k").withColumn("r", 1 / (1 + F.exp(-lean)))  # model: a row for each kind
    each = soft.select("n", "r", F.explode(F.array(*[F.struct(F.concat(F.lit(f"{f}:"), F.col(f).cast("string")).alias("f"), F.lit(f).alias("kind")) for f in FEATURES])).alias("x"))
    sums = each.groupBy("x.f", "x.kind").agg(F.sum(F.col("n") * F.col("r")).alias("real"), F.sum(F.col("n") * (1 - F.col("r"))).alias("other"))
    total = soft.agg(F.sum(F.col("n") * F.col("r")).alias("all_real"), F.sum(F.col("n") * (1 - F.col("r"))).alias("all_other"))
    odds = sums.crossJoin(F.broadcast(total)).select("f", F.log((F.col("real") + 1) / (F.col("all_real") + 16) * (F.col("all_other") + 16) / (F.col("other") + 1)).alias("w"))
    table = odds.agg(F.map_from_entries(F.collect_list(F.struct("f", "w"))).alias("_pii_odds"))
    prior = total.select(F.log((F.coalesce("all_real", F.lit(0.0)) + 1) / (F.coalesce("all_other", F.lit(0.0)) + 1)).alias("_pii_prior"))
    return common.written(table.crossJoin(prior))


def kept(found: DataFrame, model: DataFrame) -> DataFrame:
    """found with _pii_spans reduced to those that stay."""
    odds = " + ".join(f"coalesce(try_element_at(_pii_odds, concat('{f}:', x.{f})), 0D)" for f in FEATURES)
    stays = F.expr(f"filter(_pii_spans, x -> x.k < {len(BASE)} or _pii_prior + {odds} >= 0)")
    return found.crossJoin(F.broadcast(model)).withColumn("_pii_spans", stays).drop("_pii_odds", "_pii_prior")  # model: one row


def _learned(slim: DataFrame) -> DataFrame:
    return classifier(slim.select(F.explode("_pii_spans").alias("x")).select("x.*"))


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, _pii_spans) of each row of docs (doc_id, text): texts are read once."""
    slim = common.written(candidates(docs.select("doc_id", "text")).drop("text"))
    return kept(slim, _learned(slim))


def named(base: bool) -> Column:
    """kind:start:end of the spans, joined by commas."""
    names = ", ".join(_sql(k) for k in KINDS)
    some = f"filter(_pii_spans, x -> x.k < {len(BASE)})" if base else "_pii_spans"
    return F.expr(f"array_join(transform({some}, x -> concat(array({names})[x.k], ':', x.at, ':', x.end)), ',')")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets; overlapping spans by the first one's."""
    row = docs.select("doc_id", "text", F.struct("*").alias("_pii_row"))
    slim = common.written(candidates(docs.select("doc_id", "text")).select("_pii_spans"))
    out = kept(candidates(row), _learned(slim))
    names = ", ".join(_sql(k) for k in KINDS)
    before = f"transform(array({_runs()}), runs -> named_struct('runs', runs, 'before', {_through('transform(runs, q -> array_max(transform(q, y -> y.end)))', 'greatest', 0)}))"
    # Characters from one run's end to the next one's, cut once; pieces are cut from these.
    cut = "substring(text, b.before[r] + 1, b.before[r + 1] - b.before[r])"
    step = f"""if(x.at < a.end, named_struct('end', greatest(a.end, x.end), 'out', a.out), named_struct('end', x.end,
        'out', concat(a.out, array(substring(c, a.end - b.before[r] + 1, x.at - a.end), concat('<', array({names})[x.k], '>')))))"""
    run = f"transform(array({cut}), c -> aggregate(q, named_struct('end', b.before[r], 'out', cast(array() as array<string>)), (a, x) -> {step}, a -> array_join(a.out, '')))[0]"
    masked = f"""if(size(_pii_spans) = 0 or text is null, text,
        transform({before}, b -> concat(array_join(transform(b.runs, (q, r) -> {run}), ''), substring(text, element_at(b.before, -1) + 1)))[0])"""
    fields = [F.expr(masked).alias("text") if c == "text" else F.col(f"_pii_row.`{c}`").alias(c) for c in docs.columns]
    return out.select(*fields)
