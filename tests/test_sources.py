import struct
import zlib

import pytest

from anchorloom.sources import bigwig, readers, writers


def test_bed_and_cells(spark, tmp_path):
    (tmp_path / "one.bed").write_text("chr1\t10\t20\tx\t5\nchrX\t1\t2\ty\t6\n")
    (tmp_path / "skip.txt").write_text("chr1\t1\t2\n")
    raw = readers.with_cells(readers.bed(spark, str(tmp_path)), {"one.bed": "A"})
    assert sorted(tuple(r) for r in readers.peaks(raw).collect()) == [("A", "1", 10, 20), ("A", "X", 1, 2)]
    with pytest.raises(Exception, match="no cell"):
        readers.with_cells(readers.bed(spark, str(tmp_path)), {}).collect()
    assert readers.with_cells(readers.bed(spark, str(tmp_path)), {}, strict=False).count() == 0
    with pytest.raises(ValueError, match="cells"):
        readers.check_cells({"f": "A"}, ["B"])


def test_loops(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("chr1\tx1\tx2\tchr2\ty1\ty2\tcolor\nchr1\t1\t4\tchr1\t3\t4\tred\n")
    raw = readers.tsv(spark, str(tmp_path / "l.tsv"), readers.LOOPS).selectExpr("*", "'A' cell_type")
    assert [(r.chr, r.x, r.y, r.x_start) for r in readers.loops(raw, 10).collect()] == [("1", 2, 4, -8)]
    assert [(r.x, r.y) for r in readers.loops(raw, 10, "fly").collect()] == [(2, 3)]
    with pytest.raises(Exception, match="two chromosomes"):
        readers.loops(raw.selectExpr("chr1", "x1", "x2", "'chr2' chr2", "y1", "y2", "cell_type"), 10).collect()


def test_fasta_jaspar_bedgraph(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">NC_1.1 Homo sapiens chromosome 7, part\nACG\nTT\n>NW_2 chromosome 8, x\nA\n>NC_3 mitochondrion\nC\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "g.fa")).collect()] == [("chr7", "ACGTT")]
    (tmp_path / "fly.fa").write_text(">chr2L\nAC\nGT\n>chrU\nA\n")
    assert [tuple(r) for r in readers.fasta(spark, str(tmp_path / "fly.fa"), "fly").collect()] == [("chr2L", "ACGT")]
    (tmp_path / "m.txt").write_text(">MA1.1\tN\nA [ 1 2 ]\nC [ 3 4 ]\nG [ 5 6 ]\nT [ 7 8 ]\n")
    assert readers.matrices(readers.jaspar(spark, str(tmp_path / "m.txt")))["MA1.1"].tolist() == [[1, 2], [3, 4], [5, 6], [7, 8]]
    (tmp_path / "s.bg").write_text("track type=bedGraph\nchr1 0 5 1.5\n")
    assert [tuple(r) for r in readers.bedgraph(spark, str(tmp_path / "s.bg")).collect()] == [("1", 0, 5, 1.5, "s.bg")]
    (tmp_path / "n.yml").write_text("peaks:\n  a.bed: A\n  'b.bed': B\n")
    assert readers.read_name_map(str(tmp_path / "n.yml")) == {"peaks": {"a.bed": "A", "b.bed": "B"}}


def make_bigwig(path):
    """A file of three blocks: bedGraph, variable step and fixed step items."""
    bodies = [
        struct.pack("<IIIIIBBH", 0, 0, 30, 0, 0, 1, 0, 2) + struct.pack("<IIfIIf", 0, 10, 1.5, 20, 30, 2.5),
        struct.pack("<IIIIIBBH", 1, 5, 15, 0, 4, 2, 0, 2) + struct.pack("<IfIf", 5, 3.0, 11, 4.0),
        struct.pack("<IIIIIBBH", 1, 100, 120, 10, 10, 3, 0, 2) + struct.pack("<ff", 5.0, 6.0),
    ]
    blocks = [zlib.compress(b) for b in bodies]
    tree = struct.pack("<IIIIQQ", bigwig.TREE_MAGIC, 2, 4, 8, 2, 0) + struct.pack("<BBH", 1, 0, 2) + b"".join(struct.pack("<4sII", n, i, 1000) for i, n in enumerate((b"chr1", b"chr2")))
    data_at = 64 + len(tree)
    places, at = [], data_at
    for b in blocks:
        places.append(at)
        at += len(b)
    index = struct.pack("<IIQIIIIQII", bigwig.INDEX_MAGIC, 3, 3, 0, 0, 1, 120, at, 1, 0) + struct.pack("<BBH", 1, 0, 3)
    index += b"".join(struct.pack("<IIIIQQ", 0, 0, 1, 120, p, len(b)) for p, b in zip(places, blocks, strict=True))
    head = struct.pack("<IHHQQQHHQQIQ", bigwig.MAGIC, 4, 0, 64, data_at, at, 0, 0, 0, 0, 4096, 0)
    path.write_bytes(head + tree + b"".join(blocks) + index)


def test_bigwig(spark, tmp_path):
    make_bigwig(tmp_path / "t.bw")
    bigwig.register(spark)
    got = spark.read.format("bigwig").option("blocks", 1).load(str(tmp_path / "t.bw")).drop("track")
    want = [("chr1", 0, 10, 1.5), ("chr1", 20, 30, 2.5), ("chr2", 5, 9, 3.0), ("chr2", 11, 15, 4.0), ("chr2", 100, 110, 5.0), ("chr2", 110, 120, 6.0)]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n1", "ACG", "A")], "name string, seq string, cell_type string")
    writers.fasta(df, str(tmp_path / "f"))
    assert [r.value for r in spark.read.text(str(tmp_path / "f")).collect()] == [">n1", "ACG"]
    writers.tsv(df, str(tmp_path / "t"))
    assert readers.tsv(spark, str(tmp_path / "t")).columns == df.columns
    writers.parquet(df, str(tmp_path / "p"), by_cell=True)
    assert (tmp_path / "p" / "cell_type=A").exists()
    for _ in range(2):
        writers.log_run(spark, str(tmp_path / "runs"), "r", {"f1": 0.5})
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2
    writers.parameters({"a": 1}, str(tmp_path / "x.json"))
    assert writers.load_parameters(str(tmp_path / "x.json")) == {"a": 1} and writers.load_parameters(str(tmp_path / "none")) is None
