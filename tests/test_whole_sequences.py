import numpy as np

from anchorloom.plans import catalog


def test_motif_scan_reads_whole_texts(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abcdefghij KZ9\n"), n))) for i, n in enumerate((0, 3, 150, 900, 5000))]
    spark.createDataFrame([*rows, (9, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = set()
    for name, text in rows:
        seq = "".join("ACGT"[(ord(c) - ord("a")) % 4] for c in text if "a" <= c <= "z")
        for motif, w in catalog.WEIGHTS.items():
            for strand, m in (("+", w), ("-", w[::-1, ::-1])):
                for pos in range(len(seq) - m.shape[1] + 1):
                    score = sum(int(m["ACGT".index(seq[pos + k]), k]) for k in range(m.shape[1]))
                    if score >= catalog.CUTS[motif]:
                        want.add((name, motif, strand, pos, score))
    assert max(x[3] for x in want) > 2000
    got = [tuple(r) for r in catalog.QUERIES["motif_scan"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want
    counts = {r["name"]: sum(r[1:]) for r in catalog.QUERIES["motif_pivot"](spark, str(tmp_path)).collect()}
    assert counts == {n: sum(x[0] == n for x in want) for n in {x[0] for x in want}}
