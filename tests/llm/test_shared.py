"""Tables between steps."""

import os

import numpy as np
import pyarrow as pa
from strandline.llm import quality, shared


def _resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_materialise_sends_small_batches(spark):
    """Python functions get at most ROWS_AT_ONCE rows, whatever the session says; its setting stays."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for rows, most in (("10000", 1000), ("0", 1000), ("7", 7)):
            spark.conf.set(key, rows)
            found = shared.materialise(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "batches").agg({"n": "max"}).first()[0]
            count = shared.materialise(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "batches").agg({"n": "sum"}).first()[0]
            assert (found, count, spark.conf.get(key)) == (most, 5000, rows)
    finally:
        spark.conf.set(key, before)


def test_small_tables_are_few_files(spark, tmp_path):
    """A small table that many tasks make is one file, with all its rows; larger ones have as many
    as their sources' bytes warrant, and sources of unknown size leave the partitions as they are."""
    source = str(tmp_path / "source")
    spark.range(0, 3000, 1, 1).write.parquet(source)
    rows = spark.read.parquet(source)
    for many in (rows.repartition(97, "id"), rows.repartition(97, "id").groupBy("id").count().select("id")):
        table = shared.materialise(many, "small")
        assert len(table.inputFiles()) == 1
        assert sorted(r.id for r in table.collect()) == list(range(3000))
    cores = spark.sparkContext.defaultParallelism
    for size, most in ((3 * shared.SOURCE_BYTES_A_CORE, min(3, cores) + 1), ((cores + 5) * shared.SOURCE_BYTES_A_FILE, cores + 6)):
        known = spark.range(0, size // 8, 1, 200)  # 8 bytes a row
        assert shared.gathered(known).rdd.getNumPartitions() == most
    unknown = spark.createDataFrame(spark.sparkContext.parallelize([(k,) for k in range(40)], 20), "id long")
    assert shared.gathered(unknown).rdd.getNumPartitions() == 20
    assert shared.gathered(unknown, rows).rdd.getNumPartitions() == 1


def test_python_functions_give_back_memory(monkeypatch):
    """What a function has freed goes back to the system when its rows are through."""
    held = [np.ones(2000) for _ in range(12_000)]  # 190 MB, too small each to be mapped
    pins = held[::500]
    full = _resident()
    del held
    shared.give_back()
    assert pins and full - _resident() > 100_000_000

    calls = []
    monkeypatch.setattr(shared, "give_back", lambda: calls.append(1))
    row = pa.StructArray.from_arrays([pa.array([1, 2]), pa.array(["a b", None])], ["doc_id", "text"])
    batches = [pa.RecordBatch.from_arrays([row], ["row"])] * 2
    assert sum(b.num_rows for b in quality._measured(iter(batches))) == 4 and calls == [1]


def test_driver_gives_back(spark):
    """A heap that has grown with little of it alive shrinks when a table is written."""
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    gateway, held = spark.sparkContext._gateway, []
    shared._HEAP_KEPT.clear()
    while heap.totalMemory() <= shared.HEAP_SHARE * heap.maxMemory():
        held.append(gateway.new_array(gateway.jvm.long, 8 << 20))
    grown = heap.totalMemory()
    for array in held:
        gateway.detach(array)
    del held
    assert shared.materialise(spark.range(10), "given-back").count() == 10
    assert heap.totalMemory() < grown and list(shared._HEAP_KEPT) == [spark.sparkContext.applicationId]
