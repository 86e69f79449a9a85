"""Log objects beyond what the fixture's conversations hold."""

import gzip
import json
from collections import Counter

import pytest

from runweave.sources import log_objects

SCHEMA = "stream long, sequence long, bytes string"
ODD = [(1, 1, "b\r\nc\n"), (1, 0, ""), (1, 0, "again"), (-7, 0, None), (None, 3, "of no stream"), (None, None, " \x85\x0c\x00\"\\ é 😀"), (2**62 + 1, 5, "x" * 5_000_000)]


def back(spark, path):
    return Counter(map(tuple, log_objects.read_logs(spark, path).collect()))


def test_odd_records_come_back(spark, tmp_path):
    rows = ODD + [(9, i, f"r{i}") for i in range(9000)]
    log_objects.write_logs(spark.createDataFrame(rows, SCHEMA).repartition(3), str(tmp_path / "logs"))
    assert back(spark, str(tmp_path / "logs")) == Counter(rows)


def test_a_stream_is_one_object_and_reading_lists_none(spark, tmp_path):
    path = str(tmp_path / "logs")
    log_objects.write_logs(spark.range(600).selectExpr("id % 300 as stream", "599 - id as sequence", "string(id) as bytes"), path)
    read = log_objects.read_logs(spark, path)
    assert len(read.inputFiles()) <= 4 and read.count() == 600
    assert sorted(p.name for p in (tmp_path / "logs" / "objects").iterdir()) == sorted(f"{i}.gz" for i in range(300))
    with gzip.open(tmp_path / "logs" / "objects" / "7.gz", "rt") as f:
        assert [json.loads(x) for x in f] == [{"sequence": 292, "bytes": "307"}, {"sequence": 592, "bytes": "7"}]


def test_writing_again_replaces_everything(spark, tmp_path):
    path = f"file://{tmp_path}/logs"
    for rows in ([(1, 0, "a"), (2, 0, "b")], [(2, 0, "c")], []):
        log_objects.write_logs(spark.createDataFrame(rows, SCHEMA), path)
        assert back(spark, path) == Counter(rows)
        assert len(list((tmp_path / "logs" / "objects").iterdir())) == len(rows)


@pytest.mark.parametrize("harm", ["missing", "cut", "fewer"])
def test_a_harmed_object_is_an_error(spark, tmp_path, harm):
    path = str(tmp_path / "logs")
    log_objects.write_logs(spark.range(200).selectExpr("id % 2 as stream", "id as sequence", "sha2(string(id), 256) as bytes"), path)
    one = tmp_path / "logs" / "objects" / "1.gz"
    whole = one.read_bytes()
    one.unlink()
    if harm == "cut":
        one.write_bytes(whole[: len(whole) // 2])
    elif harm == "fewer":
        one.write_bytes(gzip.compress(b'{"sequence":1,"bytes":"x"}\n'))
    with pytest.raises(Exception, match={"missing": "No such file", "cut": "(?i)truncated|end of|decompress", "fewer": "has 1 records, its receipt 100"}[harm]):
        back(spark, path)


def test_a_store_that_only_spark_opens(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.logs.link./at", f"file://{tmp_path}/in")
    log_objects.write_logs(spark.createDataFrame(ODD[:5], SCHEMA), "viewfs://logs/at/logs")
    assert back(spark, "viewfs://logs/at/logs") == Counter(ODD[:5])
