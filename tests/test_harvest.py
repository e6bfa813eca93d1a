"""Harvests: states of pages, batches, and streams that fail, pause, restart and get pages twice."""

import collections
import json
import os
import time

from pyspark.sql import functions as F

from admitflow.sources import captured, local
from admitflow.streaming import harvest, status
from tests import fake_oai

PAGE = "code string, nth int, token string, next_token string, state string, xml string, attempts int, at double"


def wait(stream, done):
    for _ in range(240):
        if stream.exception() or done():
            break
        time.sleep(0.5)
    assert stream.exception() is None and done()


def test_states_of_pages():
    good = fake_oai.page(["a"], " x ")[1]
    assert harvest.read_page(200, good) == (None, "x") and harvest.read_page(200, good.replace(" x ", " ")) == (None, None)
    assert [harvest.read_page(s, b)[0] for s, b in [(None, None), (503, ""), (429, ""), (403, ""), (404, ""), (200, None), (200, "<html><p></html>"), (200, "<OAI/>"), (200, '<O><error code="noRecordsMatch"/></O>'), (200, '<O><error code="x"/></O>')]] == [
        "TIMEOUT", "TIMEOUT", "RATE_LIMITED", "ACCESS_DENIED", "PARSER_ERROR", "PARSER_ERROR", "PARSER_ERROR", "PARSER_ERROR", "NOT_FOUND", "PARSER_ERROR"]


def test_batch_with_failures_and_search(spark, tmp_path):
    fake_oai.broken["so02"] = True
    path, codes = f"file://{tmp_path}/batch", ["so01", "so02", "so03", "sc01", "li01", "li02"]
    row = harvest.sync(spark, path, codes, "tests.fake_oai:fetch", 5.0, interval=0, indexed=True).first()
    assert (row["endpoints"], row["ok"], row["failed"], row["records"]) == (6, 2, 4, 5)
    sinks = harvest.Sinks(spark, path, True)
    assert sorted((r["code"], r["native_id"]) for r in sinks.records.read().collect()) == [("so01", "a"), ("so01", "b"), ("so01", "c"), ("so02", "a"), ("so02", "b")]
    assert {r["code"]: r["status"] for r in sinks.statuses.read().collect()} == {"so01": "OK", "sc01": "OK", "so02": "UNAVAILABLE:RATE_LIMITED", "so03": "UNAVAILABLE:TIMEOUT", "li01": "UNAVAILABLE:PARSER_ERROR", "li02": "UNAVAILABLE:PARSER_ERROR"}
    harvest.sync(spark, path, ["so01"], "tests.fake_oai:fetch", 9.0, interval=0)  # again: newer times, no new rows
    assert sinks.records.read().count() == 5 and sinks.records.read().filter("code = 'so01'").agg(F.min("harvested_at")).first()[0] == 9.0
    assert sinks.compact(2) > 0 and sinks.records.read().count() == 5

    # the index answers for its source: hits, nothing in a fresh or a stale snapshot, never filled
    wanted = spark.createDataFrame([(1, "t c", "THAIJO"), (2, "zebra", "THAIJO"), (3, "t c", "TNRR"), (4, "t forced", "THAIJO")], "query_id long, query string, adapter string")
    none = spark.createDataFrame([], "adapter string, query string, status int, failure string, body string")
    forced = spark.createDataFrame([("THAIJO", "t forced", "TIMEOUT")], "adapter string, query string, state string")
    calls, found = captured.search(none, wanted, forced, sinks.index, as_of=6.0)
    assert {r["query_id"]: r["outcome"] for r in calls.collect()} == {1: "HIT", 2: "NOT_FOUND", 3: "NOT_CONNECTED", 4: "TIMEOUT"}
    hits = found.collect()
    assert len(hits) == 5 and {r["source_adapter"] for r in hits} == {"THAIJO"} and {r["doi"] for r in hits} == {"10.1/a", "10.1/b", "10.1/c"}
    for index, as_of, evidence in ((sinks.index, 6.0, "FRESH"), (sinks.index, 2e6, "STALE"), (local.open_index(spark, f"file://{tmp_path}/none"), 6.0, "NEVER_SYNCED")):
        got = {r["query_id"]: r for r in local.search(index, wanted.filter("query_id <= 2"), as_of)[0].collect()}
        assert got[2]["evidence"] == evidence and got[2]["note"] == local.NOTES[evidence] and (got[1]["outcome"] == "HIT") == (evidence != "NEVER_SYNCED")


def test_stream_survives_failures_and_restarts(spark, tmp_path, monkeypatch):
    """503 three times, a stop in between, then success: all records, no request within the interval, none twice for an answered page."""
    note = f"{tmp_path}/notes"
    # workers are forked from a daemon that may be older than this test: the file's name travels in the function's module
    fetch = tmp_path / "fetch_for_stream.py"
    fetch.write_text(f"import os\nos.environ['FAKE_OAI_NOTES'] = {note!r}\nfrom tests.fake_oai import flaky\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(fetch))
    path, checkpoint, interval = f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint", 0.4
    sinks = harvest.Sinks(spark, path)
    harvest.sync(spark, path, ["sc01"], "tests.fake_oai:fetch", 1.0, interval=0)  # a batch job has filled the folder before
    run = lambda: harvest.sync_stream(spark, path, ["so01", "so04"], "fetch_for_stream:flaky", checkpoint, interval)
    stream = run()
    wait(stream, lambda: sinks.statuses.read().filter("status = 'UNAVAILABLE:TIMEOUT'").count() == 1)
    stream.stop()
    stream = run()
    want = sorted([(c, f"{c}-{n}{x}") for c in ("so01", "so04") for n in range(3) for x in ("", "b")] + [("so01", "same"), ("so04", "same")])
    wait(stream, lambda: sinks.records.read().count() == len(want))
    wait(stream, lambda: sinks.statuses.read().filter("status = 'OK'").count() == 3)
    stream.stop()
    assert sorted((r["code"], r["native_id"]) for r in sinks.records.read().collect()) == want
    asked = [json.loads(line) for line in open(note)]
    assert collections.Counter((c, t) for c, t, _ in asked) == {("so01", None): 1, ("so01", "1"): 4, ("so01", "2"): 1, ("so04", None): 1, ("so04", "1"): 1, ("so04", "2"): 1}
    for code in ("so01", "so04"):
        times = [at for c, _, at in asked if c == code]
        assert all(b - a >= interval * 0.95 for a, b in zip(times, times[1:]))
    # a batch that is replayed reads the log: the same rows, no request
    reader = harvest._Stream({"codes": "so01", "fetch": "fetch_for_stream:flaky", "log": f"{checkpoint}/pages", "interval": "0"})
    part = reader.partitions({"so01": [0, 0, 0.0]}, {"so01": [6, 0, 0.0]})
    rows = list(reader.read(part[0]))
    assert [(r[1], r[4]) for r in rows] == [(0, None), (1, "TIMEOUT"), (2, "TIMEOUT"), (3, "TIMEOUT"), (4, None), (5, None)] and rows == list(reader.read(part[0]))
    assert len(list(open(note))) == len(asked)
    assert reader.latestOffset()["so01"][0] == 6 and os.path.exists(f"{tmp_path}/checkpoint/pages/so01/00000005")


def pages(spark, rows):
    return spark.createDataFrame(rows, PAGE)


def replayed(spark, folder, batches):
    """A stream that gets each list of pages in a batch of its own."""
    for n, rows in enumerate(batches):
        pages(spark, rows).coalesce(1).write.mode("append").json(folder)
        time.sleep(1.1)  # files are taken by their times
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", 1).json(folder)


def test_pages_delivered_twice_and_out_of_order(spark, tmp_path):
    xml = lambda *ids: fake_oai.page(ids, "")[1]
    one, two = ("so01", 0, None, "1", None, xml("a", "b"), 0, 10_000.0), ("so01", 1, "1", None, None, xml("b", "c"), 0, 10_010.0)
    late = ("so01", 0, None, None, None, xml("old"), 0, 100.0)
    got = []
    stream = harvest.distinct_records(replayed(spark, f"{tmp_path}/in", [[two], [one], [two, one], [late]]), "1 hour")
    run = stream.writeStream.option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: got.extend((n, r["native_id"]) for r in b.collect())).trigger(availableNow=True).start()
    run.awaitTermination(120)
    # each once; a page from before the hour is late and counts no more
    assert [i for _, i in sorted(got)] == ["b", "c", "a"] and [n for n, _ in sorted(got)] == [0, 0, 1]


def test_last_status_and_silence(spark, tmp_path):
    good, bad = (lambda nth: ("so01", nth, None, "x", None, "<x/>", 0, float(nth))), (lambda nth: ("so01", nth, None, None, "TIMEOUT", None, 1, float(nth)))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = []
        stream = status.last_statuses(replayed(spark, f"{tmp_path}/in", [[good(0)], [bad(1)], [bad(1), bad(2)], [good(3), ("so02", 0, None, None, "NOT_FOUND", "<x/>", 0, 1.0)]]), silent_seconds=3)
        run = stream.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: got.extend(tuple(r) for r in b.collect())).start()
        wait(run, lambda: sum(r[1] == "STALE" for r in got) >= 2)
        run.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda code: [r[1:] for r in got if r[0] == code]
    assert [r for r in of("so01") if r[0] != "STALE"] == [("OK", 1, 0, 0.0), ("UNAVAILABLE:TIMEOUT", 1, 1, 1.0), ("UNAVAILABLE:TIMEOUT", 1, 2, 2.0), ("OK", 2, 0, 3.0)]
    assert of("so01")[-1] == ("STALE", 2, 0, 3.0) and of("so02") == [("OK", 1, 0, 1.0), ("STALE", 1, 0, 1.0)]
