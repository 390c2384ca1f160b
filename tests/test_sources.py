import pyarrow as pa
import pyarrow.feather as feather
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from quillon import schemas
from quillon.operators import stats
from quillon.sources import files
from quillon.streaming import counts


def test_text_corpus(spark, tmp_path):
    def put(path, text):
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())

    put("essay/human/1.txt", "a\r\nb\rc")
    put("reuter/gpt/An Author+x/2.txt", "é")
    put("reuter/gpt/logprobs/3.txt", "no")
    put("wp/gpt_prompt1/4.txt", "no")
    put("essay/human/5.md", "no")
    rows = sorted(tuple(r) for r in files.text_corpus(spark, str(tmp_path)).collect())
    assert rows == [("1", "essay", "human", None, "a\nb\nc"), ("2", "reuter", "gpt", "An Author+x", "é")]
    (tmp_path / "essay/human/6.txt").write_bytes(b"\xff\xfe bad")
    with pytest.raises(Exception, match="INVALID_UTF8_STRING"):
        files.text_corpus(spark, str(tmp_path)).collect()
    assert files.text_corpus(spark, str(tmp_path / "none")).columns == ["id", "domain", "source", "author", "text"]


def test_feather(spark, tmp_path):
    path = str(tmp_path / "x.feather")
    files.export_feather(spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s"), path)
    assert files.read_feather(spark, path).where("id > 6").count() == 3
    assert files.read_feather(spark, path, ["s"]).columns == ["s"]
    feather.write_feather(pa.table({"a": list(range(100))}), path, chunksize=10)
    assert files.read_feather(spark, f"file://{path}").agg({"a": "sum"}).first()[0] == 4950


def test_large_feather_files_are_split(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "x.feather")
    feather.write_feather(pa.table({"a": list(range(1000))}), path, chunksize=10, compression="uncompressed")
    schema = files.FeatherSource({"path": path}).schema()
    reader = files.FeatherReader(path, schema)
    assert len(reader.partitions()) == 1
    monkeypatch.setattr(files, "SPLIT", 2000)
    parts = reader.partitions()
    assert len(parts) > 3
    assert [v for p in parts for b in reader.read(p) for v in b.column("a").to_pylist()] == list(range(1000))


def test_feather_folder(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(0, 1000, 1, 5).selectExpr("id", "IF(id % 7 = 0, NULL, CAST(id AS STRING)) AS s", "array(id, id + 1) AS a", "CAST(id AS DOUBLE) / 3 AS d")
    files.write_feather(rows, path)
    assert sorted(map(tuple, files.read_feather(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    assert len(list((tmp_path / "out").glob("*.feather"))) == 5
    assert sum(feather.read_table(p).num_rows for p in (tmp_path / "out").glob("*.feather")) == 1000
    files.write_feather(rows.limit(3), path, "append")
    assert files.read_feather(spark, path).count() == 1003
    files.write_feather(rows.where("id < 0"), path)
    found = files.read_feather(spark, path)
    assert found.count() == 0 and found.columns == rows.columns
    # computed from what it replaces
    files.write_feather(rows, path)
    files.write_feather(files.read_feather(spark, path).where("id >= 900"), path)
    assert files.read_feather(spark, path).count() == 100
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    with pytest.raises(Exception, match="no Feather files"):
        files.read_feather(spark, str(tmp_path)).count()


def test_a_failed_task_leaves_no_file_and_the_old_table(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_feather(spark.range(3), path)
    bad = spark.range(0, 100_000, 1, 4).selectExpr("IF(id = 99999, raise_error('no'), id) AS id")
    with pytest.raises(Exception, match="no"):
        files.write_feather(bad, path)
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert sorted(r.id for r in files.read_feather(spark, path).collect()) == [0, 1, 2]


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "out")
    files.write_feather(spark.range(0, 100, 1, 2).selectExpr("id", "IF(id % 7 = 0, NULL, concat('k', id)) AS s", "IF(id = 5, double('nan'), id) AS d"), path)
    key = "spark.sql.python.filterPushdown.enabled"
    tests = ["id = 8", "id > 90 AND s IS NOT NULL", "id IN (1, 2, 7)", "s LIKE 'k9%'", "s <= 'k2' AND id >= 15", "d > 95", "d = double('nan')", "s IS NULL AND id < 20", "id = 3 OR id = 4"]
    want = [sorted(r.id for r in files.read_feather(spark, path).where(t).collect()) for t in tests]
    spark.conf.set(key, "true")
    try:
        assert [sorted(r.id for r in files.read_feather(spark, path).where(t).collect()) for t in tests] == want
    finally:
        spark.conf.unset(key)
    reader = files.FilteringReader(path, files.FeatherSource({"path": path}).schema())
    given = [EqualTo(("id",), 8), GreaterThan(("d",), 1.0)]
    assert list(reader.pushFilters(given)) == given
    assert [v for p in reader.partitions() for b in reader.read(p) for v in b.column("id").to_pylist()] == [8]


def test_jsonl_and_records(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"sentence": "a", "parse": "(S)", "more": 1}\n')
    assert tuple(files.read_jsonl(spark, str(tmp_path / "x.jsonl")).first()) == ("a", "(S)", None)
    assert tuple(files.from_records(spark, [{"sentence": "a"}]).first()) == ("a", None, None)


def test_backup(spark, tmp_path):
    path = str(tmp_path / "t")
    files.write_with_backup(spark.range(3), path)
    files.write_with_backup(spark.read.parquet(path).selectExpr("id + 10 AS id"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [10, 11, 12]
    assert spark.read.parquet(path + ".bak").count() == 3
    assert files.exists(spark, path)
    assert not files.exists(spark, path + "x")


def test_stream_equals_batch(spark, tmp_path):
    rows = [("1", "d", "gpt", None, "The cat sat on a mat. It was good, and he left."), ("2", "d", "human", None, "The cat.")]
    spark.createDataFrame(rows, schemas.CORPUS).write.parquet(str(tmp_path / "in"))
    query = counts.start(counts.motif_counts(counts.corpus_stream(spark, str(tmp_path / "in"))), "motif_stream", str(tmp_path / "state"))
    query.awaitTermination()
    batch = counts.motif_counts(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(map(tuple, spark.table("motif_stream").collect())) == sorted(map(tuple, batch.collect()))
    assert batch.count() > 0


def test_failed_renames_put_the_old_table_back(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    files.write_with_backup(spark.range(3), path)
    real = files._fs

    class Refusing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if str(b.getName()) == "t" and "t.bak" not in str(a) else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(files, "_fs", lambda s, p: (Refusing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError, match="can't rename"):
        files.write_with_backup(spark.range(9), path)
    assert spark.read.parquet(path).count() == 3
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["t"]


def test_summaries(spark, tmp_path):
    rows = [("essay", "gpt", 1.0), ("essay", "gpt", 3.0), ("essay", "human", 2.0)]
    df = spark.createDataFrame(rows, "domain string, source string, v double").withColumn("w", F.col("v") * 2)
    files.write_summary_csv(stats.describe(df, ["domain", "source"], "v", 1), str(tmp_path / "one.csv"), ["domain", "source"])
    assert (tmp_path / "one.csv").read_text().splitlines()[:2] == ["domain,source,count,mean,std,min,q25,q50,q75,max", "essay,gpt,2,2.0,1.4,1.0,1.5,2.0,2.5,3.0"]
    files.write_summary_csv(stats.describe_many(df, ["domain", "source"], ["v", "w"], 1), str(tmp_path / "two.csv"), ["domain", "source"], "metric")
    lines = (tmp_path / "two.csv").read_text().splitlines()
    assert lines[0] == ",," + ",".join(["v"] * 8 + ["w"] * 8)
    assert lines[1] == ",," + ",".join(["count,mean,std,min,25%,50%,75%,max"] * 2)
    assert lines[2] == "domain,source" + "," * 16
    assert lines[3].startswith("essay,gpt,2,2.0,1.4,1.0,1.5,2.0,2.5,3.0,2,4.0,2.8,2.0,")


def test_event_counts(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:20:00", "a"), ("2024-01-01 01:20:00", "a")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    query = counts.start(counts.event_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))), "events_stream", str(tmp_path / "state"))
    query.awaitTermination()
    assert sorted(r.n for r in spark.table("events_stream").collect()) == [1, 2]
