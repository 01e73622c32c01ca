import datetime as dt

from wordloom.streaming.edits import edit_findings, edit_rates, maintain

SCHEMA = "ts timestamp, lang string, ns string, path string, value string, vtype string"


def at(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def write(spark, folder, rows, n):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{n}")


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_findings_of_a_stream(spark, tmp_path):
    write(spark, tmp_path, [(at(1), "es", "a", "x", "Hola", "string"), (at(1), "es", "a", "y", "sin", "string"), (at(1), "es", "a", "z", "?", "string")], 0)
    source = spark.createDataFrame([("a", "x", "Hello", "string"), ("a", "y", "{{n}} left", "string")], "ns string, path string, value string, vtype string")
    q = edit_findings(source, stream(spark, tmp_path)).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.path, r.type) for r in spark.table("found").collect()) == [("y", "placeholder-missing"), ("z", "orphan-key")]


def test_late_edits_are_left_out(spark, tmp_path):
    write(spark, tmp_path, [(at(1), "es", "a", "x", "1", "string"), (at(1, 30), "es", "a", "y", "1", "string")], 0)
    write(spark, tmp_path, [(at(9), "es", "a", "x", "2", "string")], 1)
    write(spark, tmp_path, [(at(9, 1), "es", "a", "y", "2", "string")], 2)  # a batch is held against the watermark before the last
    write(spark, tmp_path, [(at(1, 5), "es", "a", "x", "late", "string"), (at(20), "fr", "a", "x", "3", "string")], 3)
    q = edit_rates(stream(spark, tmp_path)).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r.start, r.lang, r.edits) for r in spark.table("rates").collect()) == [(at(1), "es", 2), (at(9), "es", 2)]


def test_newest_entry_of_each_key(spark, tmp_path):
    held = {}

    def save(df, number):
        path = f"{tmp_path}/table-{number}"
        df.write.mode("overwrite").parquet(path)
        held["at"] = path

    for n, rows in enumerate([[(at(1), "es", "a", "x", "one", "string"), (at(2), "es", "a", "x", "two", "string")], [(at(1, 30), "es", "a", "x", "older", "string"), (at(3), "de", "a", "x", "eins", "string")]]):
        write(spark, tmp_path, rows, n)
    read = lambda: spark.read.parquet(held["at"]) if held else None
    maintain(stream(spark, tmp_path), read, save, f"{tmp_path}/check", key=["lang", "ns", "path"], order="ts").awaitTermination()
    assert {(r.lang, r.value) for r in read().collect()} == {("es", "two"), ("de", "eins")}
