"""Files that a writer's task commits are dealt by folders of many, and their rows share batches."""

import pyarrow as pa
import pytest

from tessera.sources import dicom_source
from tests.test_dicom_source import content


def committed(store, names):
    system, root = dicom_source.fs.FileSystem.from_uri(store)
    writer = dicom_source.DicomWriter({"path": store}, ["name", "content"], False)
    system.create_dir(f"{root}/{dicom_source.STAGING}/{writer.job}")
    batch = pa.RecordBatch.from_arrays([pa.array([f"{k}.dcm" for k in names]), pa.array([bytes(content(k)) for k in names], pa.binary())], names=["name", "content"])
    writer.commit([writer.write(iter([batch.slice(0, 1), batch.slice(1)]))])


@pytest.fixture
def store(tmp_path, monkeypatch):
    monkeypatch.setattr(dicom_source, "CHUNK", 2)
    return f"file://{tmp_path}/store"


def planned(store, log, **options):
    reader = dicom_source.DicomStreamReader({"path": store, "log": log, **options})
    start = reader.latestOffset()["batch"]
    return reader, start


def ids(reader, start, end):
    found = [b for part in reader.partitions({"batch": start}, {"batch": end}) for b in reader.read(part)]
    return sorted(s[0] for b in found for tag, s in zip(b.column("tag").to_pylist(), b.column("s").to_pylist(), strict=True) if tag == 0x00100020)


def test_rows_of_many_files_share_a_batch(store):
    committed(store, range(50))
    for paths in (dicom_source.listed(store), dicom_source.units(store)):
        assert [b.num_rows for b in dicom_source.read_files(store, paths, frozenset([0x00100010, 0x00100020]))] == [100]


def test_chunks_are_whole_and_partitions_grow(store, tmp_path):
    committed(store, range(5))
    (tmp_path / "store/loose").mkdir()
    (tmp_path / "store/loose/5.dcm").write_bytes(content(5))
    (tmp_path / "store/_temporary/job/part").mkdir(parents=True)
    (tmp_path / "store/_temporary/job/part/6.dcm").write_bytes(content(6))
    found = dicom_source.units(store)
    assert len(found) == 4 and sum(p.endswith("/") for p in found) == 3 and len(dicom_source.listed(store)) == 6
    system, _ = dicom_source.fs.FileSystem.from_uri(store)
    assert sorted(dicom_source.files_in(system, found)) == dicom_source.listed(store)
    assert dicom_source.units(f"file://{tmp_path}/nowhere") == []
    assert [len(p.paths) for p in dicom_source.parts([f"{k}/" for k in range(5)], 4)] == [2, 2, 1]
    assert [len(p.paths) for p in dicom_source.parts(["x"] * 5, 2)] == [2, 2, 1] and dicom_source.parts([], 0)[0].paths == []
    assert {len(p.paths) for p in dicom_source.parts(["x"] * 1_000_000, 0)[:-1]} == {3906}


def test_a_stream_logs_chunks_and_goes_on_where_files_were_counted(store, tmp_path):
    log = f"file://{tmp_path}/log"
    committed(store, range(5))
    first, end = planned(store, log, maxFilesPerTrigger="1")
    assert end == 1 and len(ids(first, 0, 1)) == 1
    second, end = planned(store, log)  # the other file of that chunk, and two chunks
    assert end == 2 and len(second._entry(2)) == 3 and ids(second, 0, 2) == [f"P{k}" for k in range(5)]
    assert planned(store, log)[1] == 2 and planned(store, log, maxFilesPerTrigger="1")[1] == 2
    committed(store, range(5, 9))
    third, end = planned(store, log)
    assert end == 3 and [p[-1] for p in third._entry(3)] == ["/", "/"] and ids(third, 2, 3) == [f"P{k}" for k in range(5, 9)]
