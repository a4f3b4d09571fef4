"""The whole way on planted arrays."""

import random

from palisade.operators import durable
from palisade.plans import flagship


def planted(rnd, repeats, spacers, n):
    flip = str.maketrans("ACGT", "TGCA")
    for i in range(n):
        r = repeats[i % len(repeats)]
        own = spacers[i % len(repeats)]
        at = rnd.randrange(len(own) - 3)
        seq = "".join(rnd.choice("ACGT") for _ in range(30)) + "".join(r + s for s in own[at : at + 3]) + r
        yield i, seq.translate(flip)[::-1] if i % 2 else seq


def test_planted_arrays_are_recovered(spark):
    rnd = random.Random(5)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    repeats, spacers = [dna(30) for _ in range(3)], [[dna(33) for _ in range(12)] for _ in range(3)]
    reads = list(planted(rnd, repeats, spacers, 240)) + [(1000 + i, dna(150)) for i in range(40)]
    found = flagship.find_arrays(spark.createDataFrame(reads, "read_id long, seq string"))
    flip = str.maketrans("ACGT", "TGCA")
    true = [r.true_dr for r in found["groups"].collect()]
    assert len(true) == 3
    for r in repeats:
        low = min(r, r.translate(flip)[::-1])
        assert any(low in t or t in low for t in true)
    assert found["hits"].count() >= 235 and found["hits"].where("read_id >= 1000").count() == 0
    assert 30 <= found["spacers"].where("not flanker").count() <= 60
    assert found["contigs"].count() > 0


def test_components(spark):
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(30)] + [("g", 50, 51), ("h", 3, 90)], "gid string, a long, b long")
    rows = {(r.gid, r.node): r.root for r in durable.components(edges).collect()}
    assert all(rows["g", i] == 0 for i in range(31)) and rows["g", 51] == 50 and rows["h", 90] == 3


def test_files_and_command_line(spark, tmp_path, capsys):
    from palisade.__main__ import main
    from palisade.plans import output
    from palisade.sources import arrays_xml

    rnd = random.Random(6)
    dna = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    repeats, spacers = [dna(30) for _ in range(2)], [[dna(33) for _ in range(8)] for _ in range(2)]
    reads = spark.createDataFrame(list(planted(rnd, repeats, spacers, 120)), "read_id long, seq string")
    found = flagship.find_arrays(reads)
    output.write(found, reads, str(tmp_path / "out"))
    t = arrays_xml.flattened(arrays_xml.read(spark, str(tmp_path / "out/result.xml")))
    assert t["groups"].count() == 2 and t["drs"].count() == 2 and t["links"].count() > 0
    assert t["spacers"].count() == found["spacers"].where("not flanker").count()
    assert t["spacer_sources"].join(t["sources"], ["gid", "soid"], "left_anti").count() == 0
    assert spark.read.text(str(tmp_path / "out/reads")).where("value like '>%'").count() == t["sources"].count()
    xml = str(tmp_path / "out/result.xml")
    assert main(["stat", xml, "--separator", "|"]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0].startswith("gid|drseq|") and [x.split("|")[0] for x in lines[1:]] == ["G1", "G2"]
    assert main(["rm", xml, "--groups", "G1", "-o", str(tmp_path / "less")]) == 0
    assert [r._gid for r in arrays_xml.read(spark, str(tmp_path / "less")).collect()] == ["G2"]
    assert main(["merge", xml, str(tmp_path / "less"), "--sanitise", "-o", str(tmp_path / "more")]) == 0
    assert sorted(r._gid for r in arrays_xml.read(spark, str(tmp_path / "more")).collect()) == ["G1", "G2", "G3"]
    assert main(["filter", xml, "--coverage", "4", "-o", str(tmp_path / "deep")]) == 0
    deep = arrays_xml.flattened(arrays_xml.read(spark, str(tmp_path / "deep")))
    assert deep["spacers"].where("cov < 4").count() == 0 < deep["spacers"].count()
    assert main(["sanitise", xml, "-o", str(tmp_path / "clean")]) == 0
    clean = arrays_xml.flattened(arrays_xml.read(spark, str(tmp_path / "clean")))
    for name in ("groups", "spacers", "cspacers", "links", "spacer_sources"):
        assert clean[name].count() == t[name].count(), name
    spids = sorted(int(r.spid[2:]) for r in clean["spacers"].where("gid = 'G1'").collect())
    assert spids == list(range(1, len(spids) + 1))
    assert main(["draw", xml, "--groups", "G1", "-o", str(tmp_path / "drawn")]) == 0
    drawn = spark.read.text(str(tmp_path / "drawn"), wholetext=True).collect()
    assert len(drawn) == 1 and drawn[0].value.startswith("digraph") and " -> " in drawn[0].value
    assert main(["extract", xml, "--drs", "-o", str(tmp_path / "dr")]) == 0
    assert main(["nonsense"]) == 0
    assert main(["reads", xml, "--group", "G1", "--contigs", "1"]) == 0 and capsys.readouterr().out.count("\n") > 0


def test_longer_variants_decide_between_strands():
    from palisade.functions import kernels

    inner = "ACGTTACGTGGCCACGTAACGT"  # the same on both strands
    master = "TTG" + inner + "CCATG"
    assert kernels.offset_to_master(inner, master) == (None, False)
    assert kernels.offset_to_master(inner, master, "TG" + inner + "CC") == (3, False)


def test_assembler_commands():
    from palisade.plans import output

    assert output.assembler_commands("velvet", "r.fa", 38, "out") == [["velveth", "out", "38", "-fasta", "r.fa"], ["velvetg", "out"]]
    assert output.assembler_commands("cap3", "r.fa", 38, "out")[0][:2] == ["cap3", "r.fa"]
