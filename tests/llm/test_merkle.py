import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hash string, g string, i long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text=None):
    return h(*map(field, (r[0], r[3], r[2], r[4], r[1] if text is None else text)))


def tree(nodes, fan):
    """The top of a list of digests, and each one's proof as (before, after) by level."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(own):
            a = p // fan * fan
            proofs[k].append(("".join(nodes[a:p]), "".join(nodes[p + 1 : a + fan])))
        nodes = [h(*nodes[a : a + fan]) for a in range(0, len(nodes), fan)]
        own = [p // fan for p in own]
    return nodes[0], proofs


def expected(rows, fan=8):
    """A multiset of what the query gives: rows in order of lang, doc_id and leaf, nulls first."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    made = {}
    for lang in langs:
        ordered = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        made[lang] = (ordered, *tree([leaf(r) for r in ordered], fan))
    root, above = tree([made[x][1] for x in langs], fan) if langs else (None, [])
    out = collections.Counter()
    for lang, top in zip(langs, above, strict=True):
        ordered, subroot, proofs = made[lang]
        for r, proof in zip(ordered, proofs, strict=True):
            proof = proof + top
            node = leaf(r)
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                node = leaf(r, brute.lower(r[1]))
            for a, b in proof:
                node = h(a, node, b)
            out[r[0], leaf(r), subroot, root, h(*[x for s in proof for x in s]), node, node == root] += 1
    return out


def query(spark, rows, tmp_path):
    from anchorloom.llm import queries

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    made = queries.op11_merkle_manifest(spark, str(tmp_path))
    assert made.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return collections.Counter(tuple(r) for r in made.collect())


def rows_of(n):
    langs = ["en", "en", "en", "de", "zh", "fr", "a", "é", "Z", "~", "b"]
    return [(k, f"Text {k}" if k % 4 else f"text {k}", langs[k % 7 if k % 3 else k % 11], f"s{k % 5}", k, "x", None, 3, "y") for k in range(n)]


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 1200])
def test_against_plain_trees(spark, tmp_path, n):
    assert query(spark, rows_of(n), tmp_path) == expected(rows_of(n))


def test_awkward_rows(spark, tmp_path):
    rows = [(*r[:5], "x", "g", 1, None) for r in brute.awkward()] + [(7, "Z", None, "s", 1, None, None, None, None)] * 9 + [(3, "Z" * 200_000, None, None, None, None, None, None, None)]
    assert query(spark, rows, tmp_path) == expected(rows)


def test_other_fan_and_proofs(spark):
    from anchorloom.llm import merkle

    rows = rows_of(300)
    made = merkle.manifest(spark.createDataFrame(rows, SCHEMA), {"own": F.col("n_chars") * 2}, fan=3)
    got = made.withColumn("folded", merkle.folded(F.col("leaf"), F.col("proof"))).collect()
    assert len(got) == 300 and all(r.folded == r.root and r.own == 2 * r.doc_id for r in got)
    assert {(r.doc_id, r.subroot, r.root) for r in got} == {(k[0], k[2], k[3]) for k in expected(rows, 3)}


def test_plan_has_no_window_over_a_group(spark):
    from anchorloom.llm import merkle

    made = merkle.manifest(spark.createDataFrame(rows_of(100), SCHEMA))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if x.lstrip(" :+-").startswith("Window")]
    assert windows and all("up#" in w for w in windows if "collect_list" in w)
