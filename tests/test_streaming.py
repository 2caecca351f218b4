"""Streams over several batches and a restart."""

from pyspark.sql import functions as F

from quirelake.streaming import ingest

SCHEMA = "page_id long, version long, text string"


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def take(spark, folder, out):
    pages = ingest.page_stream(spark, folder, SCHEMA, max_files=1)
    ingest.upsert_stream(pages, f"{out}/table", ["page_id"], "version", f"{out}/state").awaitTermination()


def test_newest_rows_over_batches_and_a_restart(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put(spark, folder, [(1, 1, "a"), (1, 3, "c"), (2, 5, "e"), (None, 1, "n")])
    put(spark, folder, [(1, 2, "older"), (3, 1, "x")])
    take(spark, folder, out)
    put(spark, folder, [(2, 6, "newer"), (None, 2, "m"), (3, 1, "x")])
    take(spark, folder, out)  # a restart from the checkpoint: only the new file is read
    want = {1: "c", 2: "newer", 3: "x", None: "m"}
    assert {r.page_id: r.text for r in ingest.latest(spark, f"{out}/table", ["page_id"], "version").collect()} == want
    sizes = spark.read.parquet(f"{out}/table").groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert len(sizes) == 3 and max(r.n for r in sizes) == 3  # deltas, each as large as its batch
    ingest.compact(spark, f"{out}/table", f"{out}/folded", ["page_id"], "version")
    assert {r.page_id: r.text for r in ingest.latest(spark, f"{out}/folded", ["page_id"], "version").collect()} == want


def test_windows_leave_the_state(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    schema = "ts timestamp, user_id long"
    for day, user in (("2024-01-01 10:00:00", 1), ("2024-01-01 11:00:00", 1), ("2024-01-03 10:00:00", 2), ("2024-01-01 12:00:00", 1), ("2024-01-05 00:00:00", 3)):
        spark.createDataFrame([(day, user)], "ts string, user_id long").select(F.col("ts").cast("timestamp").alias("ts"), "user_id").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        rows = ingest.access_windows(stream).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "user_id", "accesses")
        query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{out}/table").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        held = query.lastProgress["stateOperators"][0]["numRowsTotal"] if query.lastProgress else 0
    got = sorted((r.day, r.user_id, r.accesses) for r in spark.read.parquet(f"{out}/table").collect())
    assert got == [("2024-01-01", 1, 2), ("2024-01-03", 2, 1)]  # the late access of the first day is dropped
    assert held == 1
