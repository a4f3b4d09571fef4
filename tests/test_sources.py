import gzip

from palisade.operators import report
from palisade.sources import arrays_xml, dot, seqfile


def test_sequence_files(spark, tmp_path):
    plain, packed = tmp_path / "a.fa", tmp_path / "b.fq.gz"
    plain.write_text(">r1 first > read\nACGT\nAC GT\n>r2\nTTTT\n")
    packed.write_bytes(gzip.compress(b"@q1 c\nACGT\n+\nIIII\n@q2\nAC\nGT\n+q2\n@@\nII\n@q3\nACGT\n+\nII"))
    rows = sorted(seqfile.read(spark, str(plain), str(packed)).collect())
    assert [(r.name, r.comment, r.seq, r.qual) for r in rows] == [("q1", "c", "ACGT", "IIII"), ("q2", None, "ACGT", "@@II"), ("r1", "first > read", "ACGTACGT", None), ("r2", None, "TTTT", None)]
    native = sorted(seqfile.read_fasta(spark, str(plain)).collect())
    assert [(r.name, r.comment, r.seq) for r in native] == [("r1", "first > read", "ACGTACGT"), ("r2", None, "TTTT")]


def test_group_files(spark, tmp_path):
    reads = spark.createDataFrame([(1, "ACGT"), (2, "TTTT"), (3, "GGGG")], "read_id long, seq string")
    held = spark.createDataFrame([("G1", 1), ("G1", 2), ("G1", 2), ("G2", 2)], "gid string, read_id long")
    seqfile.write_groups(reads, held, str(tmp_path / "out"))
    back = spark.read.option("lineSep", "\n>").text(str(tmp_path / "out"))
    assert {r.gid for r in back.collect()} == {"G1", "G2"}


def tables(spark):
    make = spark.createDataFrame
    return {
        "groups": make([("G1", "ACGT"), ("G2", "TTTT")], "gid string, drseq string"),
        "drs": make([("G1", "DR1", "ACGT"), ("G2", "DR1", "TTTT")], "gid string, drid string, seq string"),
        "sources": make([("G1", "SO1", "read1")], "gid string, soid string, accession string"),
        "spacers": make([("G1", "SP1", "CC", 5), ("G1", "SP2", "GG", 1), ("G2", "SP1", "AA", 3)], "gid string, spid string, seq string, cov int"),
        "spacer_sources": make([("G1", "SP1", "SO1")], "gid string, spid string, soid string"),
        "flankers": make([("G1", "FL1", "CCC")], "gid string, flid string, seq string"),
        "cspacers": make([("G1", "C1", "SP1", 1), ("G1", "C1", "SP2", 2)], "gid string, cid string, spid string, pos int"),
        "links": make([("G1", "C1", "SP1", "fs", "SP2"), ("G1", "C1", "SP2", "bs", "SP1")], "gid string, cid string, spid string, kind string, target string"),
    }


def test_result_files_round_trip(spark, tmp_path):
    t = tables(spark)
    arrays_xml.write(arrays_xml.nested(t), str(tmp_path / "x"))
    back = arrays_xml.flattened(arrays_xml.read(spark, str(tmp_path / "x")))
    for name, columns in (("groups", ["gid", "drseq"]), ("spacers", ["gid", "spid", "seq", "cov"]), ("spacer_sources", ["gid", "spid", "soid"]), ("flankers", ["gid", "flid", "seq"]), ("cspacers", ["gid", "cid", "spid"]), ("links", ["gid", "cid", "spid", "kind", "target"])):
        assert sorted(back[name].select(*columns).collect()) == sorted(t[name].select(*columns).collect()), name


def test_coverage_filter_cascades(spark):
    t = tables(spark)
    kept, inside, links = report.covered(t["spacers"], t["cspacers"], t["links"], 2)
    assert kept.count() == 2 and [r.spid for r in inside.collect()] == ["SP1"] and links.count() == 0
    assert report.filtered(t["groups"], t["drs"], t["spacers"], t["flankers"]).count() == 0
    assert [r.gid for r in report.filtered(t["groups"], t["drs"], t["spacers"], t["flankers"], min_spacers=2).collect()] == ["G1"]
    assert sorted(r.gid for r in report.filtered(t["groups"], t["drs"], t["spacers"], t["flankers"], min_drs=1, min_flankers=2).collect()) == ["G2"]


def test_graph_text(spark):
    nodes = spark.createDataFrame([("G1", "a"), ("G1", "b")], "gid string, line string")
    edges = spark.createDataFrame([("G1", "a -> b"), ("G2", "x -> y")], "gid string, line string")
    rows = dot.graph_text(nodes, edges).collect()
    assert len(rows) == 1 and rows[0].text == 'digraph "spacers" {\na\nb\na -> b\n}\n'


def test_group_lists(spark, tmp_path):
    f = tmp_path / "ids.txt"
    f.write_text("G1 2\nG3\n")
    assert sorted(r.gid for r in report.group_ids(spark, str(f)).collect()) == ["G1", "G2", "G3"]
    assert sorted(r.gid for r in report.group_ids(spark, "1,G3").collect()) == ["G1", "G3"]
