"""The store of model results: saved once, found again, and safe from broken files and other jobs."""

from __future__ import annotations

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from transcript_jobs.operators.store import ContentStore
from transcript_jobs.plans.scratch import Scratch


def test_scratch_tables_are_dropped_and_closed(spark):
    scratch = Scratch(spark, "closing")
    one, two = (scratch.save(spark.range(3), n) for n in ("one", "two"))
    folder = scratch.root.removeprefix("file://")
    scratch.drop("one", "never")
    assert sorted(os.listdir(folder)) == ["two"] and two.count() == 3 and one.columns == ["id"]
    scratch.close()
    assert not os.path.exists(folder)


@pytest.fixture
def store(spark, tmp_path):
    return ContentStore(spark, f"file://{tmp_path}/store")


def asked(spark, *ids):
    return spark.createDataFrame([(i, f"k{i % 100}" if i is not None else None) for i in ids], "id int, key string")


def upper(calls):
    def compute(missing):
        calls.append(missing.count())
        return missing.withColumn("output", F.when(F.col("key") != "k13", F.upper("key")))

    return compute


def test_second_run_computes_nothing(spark, store):
    calls = []
    first = store.fill(asked(spark, 1, 2, 101, None), upper(calls)).collect()
    assert {(r.id, r.output, r.computed) for r in first} == {(1, "K1", True), (2, "K2", True), (101, "K1", True), (None, None, False)} and calls == [2]
    again = ContentStore(spark, store.path).fill(asked(spark, 1, 2, 3), upper(calls))
    assert {(r.id, r.output, r.computed) for r in again.collect()} == {(1, "K1", False), (2, "K2", False), (3, "K3", True)} and calls == [2, 1]
    store.fill(asked(spark, 1, 2, 3), upper(calls))
    assert calls == [2, 1]


def test_null_values_are_not_kept(spark, store):
    calls = []
    for _ in range(2):
        assert [r.output for r in store.fill(asked(spark, 13), upper(calls)).collect()] == [None]
    assert calls == [1, 1]


def test_broken_file_costs_its_own_keys(spark, store, tmp_path):
    calls = []
    store.fill(asked(spark, *range(40)), upper(calls))
    files = sorted(glob.glob(f"{tmp_path}/store/batch=*/prefix=*/*.parquet"))
    lost = [r.key for r in spark.read.parquet(files[0]).select("key").collect()]
    with open(files[0], "wb") as f:
        f.write(b"no parquet")
    os.remove(os.path.join(os.path.dirname(files[0]), f".{os.path.basename(files[0])}.crc"))
    got = store.fill(asked(spark, *range(40)), upper(calls)).collect()
    assert {r.output for r in got} == {f"K{i}" for i in range(40) if i != 13} | {None}
    # The null of 13 is asked for each time.
    assert calls[1] == len({*lost, "k13"}) and sorted(r.key for r in got if r.computed) == sorted(lost)


def test_compaction_keeps_every_entry(spark, store, tmp_path):
    calls = []
    for n in (5, 10, 12):
        store.fill(asked(spark, *range(n)), upper(calls))
    assert len(glob.glob(f"{tmp_path}/store/batch=*")) == 3
    store.compact()
    assert len(glob.glob(f"{tmp_path}/store/batch=*")) == 1
    assert {(r.key, r.value) for r in store.entries().collect()} == {(f"k{i}", f"K{i}") for i in range(12)}
    store.fill(asked(spark, *range(12)), upper(calls))
    assert calls == [5, 5, 2]


def test_two_jobs_compute_a_key_once(spark, store):
    calls, got = [], []
    work = lambda: got.append(store.fill(asked(spark, *range(8)), upper(calls)).collect())
    jobs = [threading.Thread(target=work) for _ in range(2)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert sum(calls) == 8 and all({r.output for r in rows} == {f"K{i}" for i in range(8)} for rows in got)


def test_lock_of_a_lost_job_is_taken_over(spark, tmp_path):
    store = ContentStore(spark, f"file://{tmp_path}/store", lease=1.0)
    store._lock(spark.createDataFrame([("k1",)], "key string").select(store.prefix("key")).head()[0])
    calls = []
    assert store.fill(asked(spark, 1), upper(calls)).head().output == "K1" and calls == [1]
    assert not glob.glob(f"{tmp_path}/store/_locks/[0-9a-f]*")
