import random

from pyspark.sql import functions as F

from palisade.functions import kernels, stats
from palisade.functions import sequence as S


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_strands(spark):
    assert one(spark, S.reverse_complement("s"), s="ACGTNRYKMacgt") == "acgtKMRYNACGT"
    assert one(spark, S.canonical("s"), s="TTTA") == "TAAA"
    rnd = random.Random(1)
    for _ in range(3):
        s = "".join(rnd.choice("ACGTN") for _ in range(40))
        assert one(spark, S.reverse_complement(S.reverse_complement("s")), s=s) == s


def test_searching(spark):
    assert one(spark, S.first_occurrence("t", "p"), t="ACGTACGT", p="GT") == 2
    assert one(spark, S.first_occurrence("t", "p"), t="ACGT", p="") == -1
    assert one(spark, S.all_occurrences("t", "p"), t="AAAA", p="AA") == [0, 1, 2]
    assert one(spark, S.all_occurrences("t", "p"), t="A", p="AA") == []
    assert one(spark, S.kmers("s", 3), s="ACGTA") == ["ACG", "CGT", "GTA"] and one(spark, S.kmers("s", 9), s="ACG") == []


def test_distance_agrees_with_the_kernel(spark):
    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 12))), "".join(rnd.choice("ACGT") for _ in range(rnd.randint(1, 12)))) for _ in range(60)]
    pairs += [("AACG", "AAGC"), ("CA", "AC"), ("", "ACG"), ("ACG", "")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", S.edit_distance("a", "b").alias("d"), S.similarity("a", "b").alias("s")).collect()
    for r in rows:
        assert r.d == kernels.edit_distance(r.a, r.b) and abs(r.s - kernels.similarity(r.a, r.b)) < 1e-12


def test_runs_and_complexity(spark):
    assert one(spark, S.squeezed("s"), s="AAACCG") == "ACG"
    assert one(spark, S.expanded(S.run_lengths("s")), s="AAAAAAAAAAAACCG") == "AAAAAAAAAAAACCG"
    for s in ("AAAAAAAT", "ACGTACGT", "aaaaaaaaac", "NNNNNNNNA"):
        assert one(spark, S.low_complexity("s"), s=s) == kernels.low_complexity(s)
    assert one(spark, S.trimer_share("s"), s="ACGACGACGA") == 3 / 7


def test_colours(spark):
    assert one(spark, S.heat_colour("v", 0, 10, 11), v=0) == "0000ff"
    assert one(spark, S.heat_colour("v", 0, 10, 11), v=10) == "ff0000"
    assert one(spark, S.heat_colour("v", 0, 10, 11, "RED_BLUE"), v=0) == "ff0000"
    assert one(spark, S.heat_colour("v", 0, 10, 11), v=11) == "000000"


def test_integer_statistics(spark):
    df = spark.createDataFrame([(x,) for x in (1, 2, 2, 6)], "x long")
    row = df.agg(stats.int_mean("x").alias("m"), stats.upper_median("x").alias("u"), stats.percentile("x", 0.9).alias("p"), stats.int_mean_deviation("x").alias("d")).first()
    assert (row.m, row.u, row.p) == (2, 2, 6) and abs(row.d - (17 / 4) ** 0.5) < 1e-9
    empty = df.where("false").agg(stats.int_mean("x").alias("m"), stats.upper_median("x").alias("u")).first()
    assert (empty.m, empty.u) == (0, None)


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("select reverse_complement('AACG') a, canonical('TTTA') b, squeezed('AAC') c, edit_distance('AACG','AAGC') d, low_complexity('AAAAAAAA') e").first()
    assert tuple(row) == ("CGTT", "TAAA", "AC", 1, True)


def test_repeats_and_spacers(spark):
    df = spark.createDataFrame([("AAACCCAAAGGGAAAT", [(0, 2), (6, 8), (12, 14)])], "seq string, repeats array<struct<start:int,stop:int>>")
    assert df.select(S.interior_spacers("seq", "repeats")).first()[0] == ["CCC", "GGG"]
    assert df.select(S.spacer_without_last("seq", "repeats", 0)).first()[0] == "CC"
    assert df.select(S.in_columns("seq", "repeats")).first()[0] == "DR: AAA SP: CCC DR: AAA SP: GGG DR: AAA"
    back = df.select(S.mirrored("repeats", F.length("seq"))).first()[0]
    assert [(r.start, r.stop) for r in back] == [(1, 3), (7, 9), (13, 15)]
