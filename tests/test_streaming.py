from palisade.streaming import detect

REPEAT = "CTTCCACTAACCATTTCCCCGTAAGGGGACGGAAAC"
READ = REPEAT + "ATTTTTTATCCAGATTTTTCCCCAAATTTGCAATAATTGCTA" + REPEAT + "TTCTGTAGAGTTATTGTATAAGAACCCCACGTAGAAACGAG" + REPEAT


def drained(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_detection_and_recruiting_on_a_stream(spark, tmp_path):
    rows = [(1, READ), (2, "ACGT" * 30), (3, "TTTT" + REPEAT + "GATTACA" * 6)]
    spark.createDataFrame(rows, "read_id long, seq string").write.parquet(str(tmp_path / "reads"))
    stream = spark.readStream.schema("read_id long, seq string").parquet(str(tmp_path / "reads"))
    assert [r.read_id for r in drained(spark, detect.repeat_bearing(stream), "bearing").collect()] == [1]
    patterns = spark.createDataFrame([(REPEAT,)], "pattern string")
    assert sorted((r.read_id, r.start) for r in drained(spark, detect.recruited(stream, patterns), "recruited").collect()) == [(1, 0), (3, 4)]


def test_arrivals_have_a_watermark(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id,0) as ts, 'x' as event_type from range(60)").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "events"))
    assert drained(spark, detect.arrivals(stream), "arrivals", "complete").selectExpr("sum(n) n").first().n == 60
