from pyspark.sql import functions as F

from tessera.operators import chunking
from tessera.streaming import ingest


def test_ingest_is_incremental_and_repeats_nothing(spark, tmp_path):
    folder, into, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    a = spark.createDataFrame([(1, "x" * 30), (2, "y" * 5)], "doc_id bigint, text string")
    a.coalesce(1).write.parquet(folder)
    ingest.ingest(spark, folder, "doc_id bigint, text string", into, mark, 10, 2).awaitTermination()
    b = spark.createDataFrame([(2, "y" * 5), (3, "z" * 12)], "doc_id bigint, text string")
    b.coalesce(1).write.mode("append").parquet(folder)
    ingest.ingest(spark, folder, "doc_id bigint, text string", into, mark, 10, 2).awaitTermination()
    got = {(r.doc_id, r.chunk_index, r.page_content) for r in spark.read.parquet(into).collect()}
    want = {(r.doc_id, r.chunk_index, r.page_content) for r in chunking.sliding(a.union(b).distinct(), 10, 2).collect()}
    assert got == want and spark.read.parquet(into).count() == len(want)


def run(spark, tmp_path):
    q = ingest.ingest(spark, str(tmp_path / "in"), "doc_id bigint, text string", str(tmp_path / "out"), str(tmp_path / "mark"), 10, 2)
    q.awaitTermination()
    return q


def test_a_batch_costs_what_it_brings(spark, tmp_path):
    """Rows of state that a batch writes, and rows that it reads, are its own, however many chunks there are."""
    before = spark.conf.get(ingest.STATE_STORE[0], None)
    first = spark.createDataFrame([(i, f"{i} " * 40) for i in range(300)], "doc_id bigint, text string")
    first.write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path)
    n = spark.read.parquet(str(tmp_path / "out")).count()
    more = spark.createDataFrame([(7, "7 " * 40), (1000, "new text of some length")], "doc_id bigint, text string")
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    last = [p for p in run(spark, tmp_path).recentProgress if p["numInputRows"]][-1]
    state = last["stateOperators"][0]
    fresh = chunking.sliding(more.where("doc_id = 1000"), 10, 2).count()
    assert last["numInputRows"] == 2 and state["numRowsUpdated"] == fresh and state["numRowsTotal"] == n + fresh
    assert spark.read.parquet(str(tmp_path / "out")).count() == n + fresh and n > 2000
    assert spark.conf.get(ingest.STATE_STORE[0], None) == before


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 30), (2, "y" * 50)], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    run(spark, tmp_path)
    want = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    committed = sorted((tmp_path / "mark/commits").glob("[0-9]*"))
    committed[-1].unlink()  # as if the run had ended before it noted that the batch was done
    (tmp_path / "mark/commits" / f".{committed[-1].name}.crc").unlink(missing_ok=True)
    run(spark, tmp_path)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want
    run(spark, tmp_path)  # nothing new at all
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == want


def test_windows_agree_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "click", float(i)) for i in range(30)]
    d = spark.createDataFrame(rows, "event_id int, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "e"))
    q = ingest.windowed_metrics(stream).writeStream.outputMode("complete").format("memory").queryName("windowed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, ingest.windowed_metrics(d).collect()))
