"""Streams over folders of files, in several batches, and over no rows at all."""

import time

import pytest

from millrace.plans import catalog
from millrace.streaming import streams
from tests.compare import same

STREAMS = [n for n in catalog.QUERIES if n.startswith("stream_") and n not in ("stream_rate", "stream_late")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The events as four files in order of time, beside the customers."""
    path = tmp_path_factory.mktemp("folder")
    for name in ("events", "customer"):
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        parts = [df.where(f"event_id % 1000 between {250 * k} and {250 * k + 249}") for k in range(4)] if name == "events" else [df]
        for part in parts:  # one after the other, as a stream reads files by their age
            part.coalesce(1).write.mode("append").parquet(f"{path}/{name}.parquet")
            time.sleep(0.01)
    return str(path)


@pytest.mark.parametrize("name", STREAMS)
def test_folder(spark, folder, name):
    same(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)


@pytest.mark.parametrize("name", ["stream_agg", "stream_complete", "stream_stateful", "stream_file", "stream_dedup", "stream_sessions", "stream_outer_join", "stream_event_timers", "stream_ttl"])
def test_batches(spark, folder, name, monkeypatch):
    """One file to a batch gives the same rows."""
    read = type(spark).readStream.fget
    monkeypatch.setattr(type(spark), "readStream", property(lambda s: read(s).option("maxFilesPerTrigger", 1)))
    same(catalog.QUERIES[name](spark, folder), catalog.ORACLES[name], folder)


@pytest.mark.parametrize("name", STREAMS)
def test_empty(spark, tmp_path, name):
    for t in ("events", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
