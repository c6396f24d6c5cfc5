from corvina.streaming.incremental import changed_facts


def test_a_file_is_read_once_for_each_content(spark, tmp_path):
    schema = "repo_id string, path string, length long, content binary, seen timestamp"
    app, more = b"from fastapi import FastAPI\napp = FastAPI()\n", b"from fastapi import FastAPI\nother = FastAPI()\n"
    for k, content in enumerate((app, app, more)):
        spark.createDataFrame([("r", "main.py", len(content), bytearray(content))], "repo_id string, path string, length long, content binary").selectExpr("*", f"timestamp'2024-01-01 00:0{k}:00' AS seen").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = changed_facts(stream).writeStream.format("memory").queryName("facts").option("checkpointLocation", f"{tmp_path}/state").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("facts").count() == 2
