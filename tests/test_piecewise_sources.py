"""Sources that are read in pieces: FASTA by byte ranges, bigWig by its index, chains by running sums."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from anchorloom.operators import intervals, motifs
from anchorloom.sources import bigwig, chains, fasta, readers


def whole(text):
    """(head, letters) of a FASTA text."""
    out = []
    for line in text.split("\n"):
        if line.startswith(">"):
            out.append([line[1:].rstrip("\r"), ""])
        elif out:
            out[-1][1] += "".join(line.split())
    return out


def cut(records, width, reach):
    return sorted((h, k, s[k * width : k * width + width + reach]) for h, s in records for k in range(max(1, -(-len(s) // width))))


def text_of(seed):
    rnd = random.Random(seed)
    parts = ["ACGT junk\n"] if seed % 2 else []
    for k in range(12):
        n = rnd.choice([0, 0, 1, 7, 30, 64, 200])
        letters = "".join(rnd.choice("ACGTNacgt") for _ in range(n))
        line = rnd.choice([1, 5, 60, 1000])
        end = rnd.choice(["\n", "\r\n"])
        parts.append(f">r{k} some > text{end}" + end.join(letters[i : i + line] for i in range(0, n, line)) + rnd.choice([end, end + "\n"]))
    return "".join(parts).rstrip("\n") if seed % 3 else "".join(parts)


@pytest.mark.parametrize("seed", range(6))
def test_fasta_ranges_of_any_size(spark, tmp_path, seed):
    text = text_of(seed)
    (tmp_path / "g.fa").write_text(text, newline="")
    records = whole(text)
    for size, width, reach in ((1, 4, 4), (7, 10, 3), (16, 5, 0), (100, 64, 9), (1 << 20, 8, 8)):
        got = sorted(tuple(r) for r in fasta.chunks(spark, str(tmp_path / "g.fa"), reach, width, size).collect())
        assert got == cut(records, width, reach), (size, width, reach)


def test_fasta_files_and_readers(spark, tmp_path):
    for k in range(3):
        letters = "ACGTTGCA" * (900 + k)
        (tmp_path / f"{k}.fa").write_text(f">NC_{k} Homo sapiens chromosome {k}, x\n" + "\n".join(letters[i : i + 60] for i in range(0, len(letters), 60)) + "\n>NW_9 other\nA\n")
    path = str(tmp_path / "*.fa")
    want = {r.chr: r.seq for r in readers.fasta(spark, path).collect()}
    got = readers.fasta_chunks(spark, path, width=500, size=1000)
    made = {}
    for r in sorted(got.collect()):
        made[r.chr] = made.get(r.chr, "") + r.seq
    assert made == want and len(want) == 3
    parts = spark.createDataFrame([(f"chr{k % 3}", k * 7, k * 7 + 20, f"p{k}") for k in range(1020)], "chr string, start long, end long, name string")
    of = motifs.slices_of_chunks(parts, readers.fasta_chunks(spark, path, reach=20, width=500, size=1000), 500)
    assert sorted(of.collect()) == sorted(motifs.slices(parts, readers.fasta(spark, path)).collect())


def test_one_long_line_is_several_tasks(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">long\n" + "ACGT" * 1_000_000)
    made = fasta.chunks(spark, str(tmp_path / "g.fa"), 100, 1 << 16, 1 << 19).withColumn("task", F.spark_partition_id())
    assert made.agg(F.max(F.length("seq"))).first()[0] <= (1 << 16) + 100
    assert made.select("task").distinct().count() > 1
    assert made.agg(F.sum(F.least(F.length("seq"), F.lit(1 << 16)))).first()[0] == 4_000_000


def test_empty_fasta(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert fasta.chunks(spark, str(tmp_path / "e.fa")).count() == 0


def bigwig_of(path, runs, each=4, fan=3):
    """A file whose runs (chromosome number, start, end, value) lie in blocks of `each`, under an R-tree of `fan` children."""
    blocks = []
    for n in sorted({r[0] for r in runs}):
        own = sorted(r for r in runs if r[0] == n)
        for k in range(0, len(own), each):
            some = own[k : k + each]
            body = struct.pack("<IIIIIBBH", n, some[0][1], some[-1][2], 0, 0, 1, 0, len(some)) + b"".join(struct.pack("<IIf", a, b, v) for _, a, b, v in some)
            blocks.append(((n, some[0][1], n, max(r[2] for r in some)), zlib.compress(body)))
    names = sorted({r[0] for r in runs})
    tree = struct.pack("<IIIIQQ", bigwig.TREE_MAGIC, len(names), 6, 8, len(names), 0) + struct.pack("<BBH", 1, 0, len(names)) + b"".join(struct.pack("<6sII", b"chr%d" % n, n, 1 << 30) for n in names)
    at = 64 + len(tree)
    data, level = b"", []
    for span, block in blocks:
        level.append((span, struct.pack("<QQ", at + len(data), len(block))))
        data += block
    index_at = at + len(data)
    head = struct.pack("<IIQIIIIQII", bigwig.INDEX_MAGIC, fan, len(blocks), 0, 0, 9, 1 << 30, index_at, each, 0)
    levels = [[level[i : i + fan] for i in range(0, len(level), fan)]]
    while len(levels[-1]) > 1:
        spans = [((g[0][0][0], g[0][0][1], g[-1][0][2], max(x[0][3] for x in g)), k) for k, g in enumerate(levels[-1])]
        levels.append([spans[i : i + fan] for i in range(0, len(spans), fan)])
    places, at_node = {}, index_at + len(head)
    for depth in reversed(range(len(levels))):
        for k, g in enumerate(levels[depth]):
            places[depth, k] = at_node
            at_node += 4 + len(g) * (24 if depth else 32)
    out = b""
    for depth in reversed(range(len(levels))):
        for g in levels[depth]:
            out += struct.pack("<BBH", not depth, 0, len(g)) + b"".join(struct.pack("<IIII", *span) + (struct.pack("<Q", places[depth - 1, x]) if depth else x) for span, x in g)
    path.write_bytes(struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, at, index_at, 0, 0, 0, 0, 4096, 0) + tree + data + head + out)


RUNS = [(n, 100 * k, 100 * k + 60, float(n * 1000 + k)) for n in (1, 2, 3) for k in range(50)]


def test_bigwig_filters_reach_the_index(spark, tmp_path):
    for name in ("a.bw", "b.bw"):
        bigwig_of(tmp_path / name, RUNS)
    bigwig.register(spark)
    path = f"{tmp_path}/a.bw,file://{tmp_path}/b.bw"
    both = spark.read.format("bigwig").option("blocks", 2).load(path)
    rows = {(f"chr{n}", a, b, v, t) for n, a, b, v in RUNS for t in ("a.bw", "b.bw")}
    assert {tuple(r) for r in both.collect()} == rows
    for where, holds in (
        ("chr = 'chr2' and start < 1000 and end > 700", lambda r: r[0] == "chr2" and r[1] < 1000 and r[2] > 700),
        ("chr in ('chr1', 'chr3') and start >= 4800", lambda r: r[0] in ("chr1", "chr3") and r[1] >= 4800),
        ("end <= 160 and value > 2000", lambda r: r[2] <= 160 and r[3] > 2000),
        ("start = 300", lambda r: r[1] == 300),
        ("chr = 'chr9'", lambda r: False),
        ("track = 'b.bw' and start < 250", lambda r: r[4] == "b.bw" and r[1] < 250),
    ):
        assert {tuple(r) for r in both.where(where).collect()} == {r for r in rows if holds(r)}, where


def test_bigwig_reads_the_blocks_that_overlap(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

    bigwig_of(tmp_path / "a.bw", RUNS)
    file = bigwig.File(str(tmp_path / "a.bw"))
    assert len(file.blocks(bigwig.Wanted())) == 39

    def count(*filters):
        reader = bigwig.BigWigReader({"path": str(tmp_path / "a.bw")})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sum(len(p.blocks) for p in reader.partitions())

    assert count(EqualTo(("chr",), "chr2")) == 13
    assert count(EqualTo(("chr",), "chr2"), LessThan(("start",), 1000), GreaterThan(("end",), 700)) == 2
    assert count(In(("chr",), ("chr1", "chr2")), In(("chr",), ("chr2", "chr3")), LessThan(("start",), 400)) == 1
    assert count(EqualTo(("chr",), "none")) == 0


def test_other_stores(tmp_path, monkeypatch):
    """A scheme that is not local goes through Arrow's file systems."""
    from pyarrow import fs

    from anchorloom.sources import files

    bigwig_of(tmp_path / "a.bw", RUNS)
    asked = []

    class Stores:
        @staticmethod
        def from_uri(uri):
            asked.append(uri)
            return fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), uri.partition("//bucket/")[2]

    monkeypatch.setattr(files.fs, "FileSystem", Stores)
    assert len(bigwig.File("s3://bucket/a.bw").blocks(bigwig.Wanted())) == 39
    assert asked == ["s3://bucket/a.bw"]


CHAINS = """##comment about a chain format
chain 1000 chr1 5000 + 100 400 chr2 9000 + 50 345 7
100 50 5
60	40	80
50

chain 2000 chr1 5000 + 300 380 chrX 1000 - 100 180 8
80

chain 2000 chr1 5000 + 370 390 chr3 1000 + 0 20 9
20
"""


def test_chain_blocks(spark, tmp_path):
    (tmp_path / "c.chain").write_text(CHAINS)
    made = chains.blocks(spark, str(tmp_path / "c.chain"))
    assert made.columns == chains.BLOCKS
    assert sorted(tuple(r) for r in made.collect()) == [
        ("1", 100, 200, "2", 50, "+", 1000, 7),
        ("1", 250, 310, "2", 155, "+", 1000, 7),
        ("1", 300, 380, "X", 820, "-", 2000, 8),
        ("1", 350, 400, "2", 295, "+", 1000, 7),
        ("1", 370, 390, "3", 0, "+", 2000, 9),
    ]
    # 1000 - 100 - 80 = 820. Of two of one score the lesser id goes first.
    best = chains.best(made)
    assert sorted((r.chr, r.start, r.end, r.to_chr, r.to_start, r.id) for r in best.collect()) == [
        ("1", 100, 200, "2", 50, 7), ("1", 250, 300, "2", 155, 7), ("1", 300, 380, "X", 820, 8), ("1", 380, 390, "3", 10, 9), ("1", 390, 400, "2", 335, 7),
    ]
    runs = spark.createDataFrame([("1", 290, 395, 1.5)], "chr string, start long, end long, value double")
    assert sorted(tuple(r) for r in intervals.liftover(runs, best).collect()) == [("2", 195, 205, 1.5), ("2", 335, 340, 1.5), ("3", 10, 20, 1.5), ("X", 820, 900, 1.5)]


def test_long_chain_and_bad_chain(spark, tmp_path):
    n = 10_000
    lines = "\n".join(["10 3 2"] * (n - 1) + ["10"])
    (tmp_path / "c.chain").write_text(f"chain 5 chr1 {14 * n} + 0 {13 * n - 3} chr2 {13 * n} - 0 {12 * n - 2} 1\n{lines}\n")
    rows = sorted((r.start, r.end, r.to_start) for r in chains.blocks(spark, str(tmp_path / "c.chain")).collect())
    assert rows == [(13 * k, 13 * k + 10, 13 * n - 12 * k - 10) for k in range(n)]
    (tmp_path / "bad.chain").write_text("chain 5 chr1 100 + 0 10 chr2 100 + 0 10 1\n11\n")
    with pytest.raises(Exception, match="leave its range"):
        chains.blocks(spark, str(tmp_path / "bad.chain")).collect()
