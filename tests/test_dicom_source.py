import pytest
from pyspark.sql import functions as F

from tessera.sources import dicom_source
from tests.test_operators import element, file_of


def content(k):
    return bytearray(file_of(element(0x00100010, "PN", f"Name^{k}".encode()) + element(0x00100020, "LO", f"P{k}".encode()) + element(0x7FE00010, "OB", b"\1\2" * 500)))


def rows(spark, names):
    return spark.createDataFrame([(f"{k}.dcm", content(k)) for k in names], "name string, content binary").repartition(3)


@pytest.fixture
def store(spark, tmp_path):
    dicom_source.register(spark)
    return f"file://{tmp_path}/store"


def files_of(tmp_path):
    return sorted(p.name for p in (tmp_path / "store").rglob("*") if p.is_file() and not p.name.startswith((".", "_")))


def ids(df):
    return sorted(r.s[0] for r in df.where("tag = 1048608").collect())


def test_committed_files_are_read_and_overwritten(spark, store, tmp_path):
    rows(spark, range(7)).write.format("dicom").mode("append").save(store)
    rows(spark, range(7, 9)).select("content", "name").write.format("dicom").mode("append").save(store)
    assert files_of(tmp_path) == [f"{k}.dcm" for k in range(9)] and not (tmp_path / "store/_temporary").exists() and (tmp_path / "store/_SUCCESS").exists()
    assert ids(spark.read.format("dicom").load(store)) == [f"P{k}" for k in range(9)]
    rows(spark, [4]).write.format("dicom").mode("overwrite").save(store)
    assert files_of(tmp_path) == ["4.dcm"]
    rows(spark, []).write.format("dicom").mode("overwrite").save(store)
    assert files_of(tmp_path) == [] and spark.read.format("dicom").load(store).count() == 0


def test_a_failed_job_leaves_no_file(spark, store, tmp_path):
    rows(spark, [1, 2]).write.format("dicom").mode("append").save(store)

    def killed(batches):
        import os

        for batch in batches:
            yield batch
            if "9.dcm" in batch.column(0).to_pylist():
                os._exit(1)  # the worker dies after it has handed on files

    dying = rows(spark, range(3, 10)).mapInArrow(killed, "name string, content binary")
    for bad in (dying, rows(spark, [3]).union(rows(spark, [3])).coalesce(1), rows(spark, [5]).withColumn("name", F.lit("../x.dcm"))):
        with pytest.raises(Exception):
            bad.write.format("dicom").mode("append").save(store)
        assert files_of(tmp_path) == ["1.dcm", "2.dcm"] and not (tmp_path / "store/_temporary").exists()
    with pytest.raises(Exception):
        rows(spark, [1]).withColumn("more", F.lit(1)).write.format("dicom").mode("append").save(store)


def test_staged_files_are_not_read(spark, store, tmp_path):
    staged = tmp_path / "store/_temporary/job/part"
    staged.mkdir(parents=True)
    (staged / "1.dcm").write_bytes(content(1))
    assert dicom_source.listed(store) == [] and dicom_source.listed(f"file://{tmp_path}/nowhere") == []


def test_filters_are_pushed(spark, store):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

    rows(spark, range(4)).write.format("dicom").mode("append").save(store)
    reader = dicom_source.DicomReader({"path": store})
    paths = dicom_source.listed(store)
    given = [In(("tag",), (0x00100020, 0x00100010)), EqualTo(("tag",), 0x00100020), GreaterThan(("depth",), 0), EqualTo(("file",), paths[1]), StringStartsWith(("file",), paths[1][:-6])]
    assert list(reader.pushFilters(given)) == [given[2]]
    assert reader.only == {0x00100020} and [p.paths for p in reader.partitions()] == [[paths[1]]]
    assert {v for r in reader.read(reader.partitions()[0]) for v in r.column("tag").to_pylist()} == {0x00100020}
    # through Spark: nothing is left to look at above the scan, other filters are
    own = spark.read.format("dicom").load(store).where("tag IN (1048592, 1048608)")
    assert "Filter" not in own._jdf.queryExecution().executedPlan().toString().replace("RuntimeFilters", "")
    assert "Filter (" in own.where("depth + 1 > 0")._jdf.queryExecution().executedPlan().toString()
    assert own.count() == 8
    assert spark.read.format("dicom").load(store).where(F.col("file") == paths[2]).where("tag = 1048608").count() == 1
    assert spark.read.format("dicom").load(store).where("tag = 1 AND tag = 2").count() == 0


def test_a_stream_stores_each_file_once_over_restarts(spark, store, tmp_path):
    def run(fail=False, most=0):
        stream = spark.readStream.format("dicom").option("log", f"file://{tmp_path}/log").option("maxFilesPerTrigger", most).option("filesPerPartition", 2).load(store)

        def put(batch, number):
            if fail:
                raise RuntimeError("lost")
            batch.where("tag = 1048608").select(F.get("s", F.lit(0)).alias("id")).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

        query = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()

    stored = lambda: sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect())
    rows(spark, range(3)).write.format("dicom").mode("append").save(store)
    run()
    assert stored() == ["P0", "P1", "P2"]
    rows(spark, range(3, 8)).write.format("dicom").mode("append").save(store)
    with pytest.raises(Exception):
        run(fail=True)  # the batch is planned and lost
    rows(spark, [8]).write.format("dicom").mode("append").save(store)
    run()
    run()
    assert stored() == [f"P{k}" for k in range(9)]
    assert [len(x) for x in map(dicom_source.DicomStreamReader({"path": store, "log": f"file://{tmp_path}/log"})._entry, (1, 2, 3))] == [3, 5, 1]


def test_offsets_are_planned(spark, store, tmp_path):
    options = {"path": store, "log": f"file://{tmp_path}/own-log", "maxFilesPerTrigger": "2"}
    rows(spark, range(5)).write.format("dicom").mode("append").save(store)
    reader = dicom_source.DicomStreamReader(options)
    assert reader.initialOffset() == {"batch": 0} and [reader.latestOffset()["batch"] for _ in range(4)] == [1, 2, 3, 3]
    again = dicom_source.DicomStreamReader(options)
    assert again.latestOffset() == {"batch": 3}
    got = [p for a, b in ((0, 1), (1, 3)) for part in again.partitions({"batch": a}, {"batch": b}) for p in part.paths]
    assert sorted(got) == dicom_source.listed(store) and len(again.partitions({"batch": 0}, {"batch": 1})[0].paths) == 2
    with pytest.raises(ValueError):
        dicom_source.DicomStreamReader({"path": store})
