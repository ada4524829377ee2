import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from test_sources import HEADER, line, write
from tipscope.operators.bursts import burst_stats
from tipscope.plans import registry
from tipscope.schemas import MESSAGE_KEY
from tipscope.session import scratch_path
from tipscope.streaming import streams as S

START = datetime(2026, 8, 1)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def run_to_parquet(spark, stream, state=None):
    out = scratch_path(spark, "out")
    finish(stream.writeStream.outputMode("append").format("parquet").option("path", out)
           .option("checkpointLocation", state or scratch_path(spark, "state"))
           .trigger(availableNow=True).start())
    return spark.read.parquet(out)


def post(directory, name, *messages):
    directory.mkdir(exist_ok=True)
    (directory / name).write_text("\n".join(json.dumps(m) for m in messages) + "\n")


def message(number, text, at, channel="c1"):
    return {"source": "telegram", "channel_id": channel, "message_id": str(number), "text": text,
            "posted_at": at.isoformat() + "Z"}


def test_new_files_are_added_once(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    table, state = scratch_path(spark, "prices"), scratch_path(spark, "state")
    write(files / "a.csv", HEADER, line("A", close="1"), line("B", day="31-Jul-2026"))
    finish(S.ingest_daily_files(spark, str(files), table, state))
    write(files / "b.csv", HEADER, line("A", close="2"), line("C"))
    for _ in range(2):
        finish(S.ingest_daily_files(spark, str(files), table, state))
    got = {r.symbol: (r.close, r.source_file) for r in spark.read.parquet(table).collect()}
    assert got == {"A": (2.0, "b.csv"), "B": (105.5, "a.csv"), "C": (105.5, "b.csv")}


def test_repeated_messages_are_dropped(spark, tmp_path):
    box = tmp_path / "box"
    post(box, "1.json", message(1, "a", START), message(1, "a", START + timedelta(minutes=5)),
         message(2, "b", START), message(3, "", START))
    got = run_to_parquet(spark, S.deduplicate(S.stream_messages(spark, str(box))))
    assert sorted(r.message_id for r in got.collect()) == ["1", "2"]


def test_tagging(spark, tmp_path):
    box = tmp_path / "box"
    post(box, "1.json", message(1, "buy SUZLON now", START), message(2, "SBI", START),
         message(3, "SUZLON or TCS", START), message(4, "chatter", START))
    master = spark.createDataFrame([("SUZLON", "Suzlon Energy"), ("TCS", "Tata Consultancy")],
                                   "symbol string, name string")
    tagged = S.tag_stream(S.stream_messages(spark, str(box)), master)
    rows = {r.message_id: r for r in S.settle_tags(run_to_parquet(spark, tagged)).collect()}
    assert {k: r.ticker for k, r in rows.items()} == {
        "1": "SUZLON", "2": "SBIN", "3": None, "4": None}
    assert (rows["1"].direction, rows["1"].urgency) == ("long", "high")
    assert set(MESSAGE_KEY) <= set(rows["1"].asDict())


def mention_rows():
    rows = []
    for hour in range(0, 30 * 24, 5):
        rows.append((f"c{hour % 4}", "A" if hour % 3 else "B", START + timedelta(hours=hour)))
    rows += [(f"p{i}", "PUMP", START + timedelta(days=20, hours=i)) for i in range(6)]
    rows.append(("c0", "LAST", START + timedelta(days=40)))
    return rows


def test_sliding_windows_equal_batch_counts(spark):
    source = scratch_path(spark, "mentions")
    df = spark.createDataFrame(mention_rows(), "channel_id string, ticker string, "
                                               "posted_at timestamp")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    got = run_to_parquet(spark, S.sliding_channels(stream)).collect()
    left = S.open_channels(spark.read.parquet(source)).collect()
    want = {}
    for channel, ticker, at in mention_rows():
        end = datetime(at.year, at.month, at.day)
        if at > end:
            end += timedelta(days=1)
        for step in (0, 1):
            want.setdefault((ticker, end + timedelta(days=step)), set()).add(channel)
    closed = max(at for _, _, at in mention_rows()) - timedelta(hours=2)
    assert {(r.ticker, r.window_end): r.n_channels for r in got} == {
        k: len(v) for k, v in want.items() if k[1] < closed}
    assert left and {(r.ticker, r.window_end): r.n_channels for r in left} == {
        k: len(v) for k, v in want.items() if k[1] >= closed}
    assert S.open_channels(spark.createDataFrame([], df.schema)).count() == 0


def test_streaming_watchlist(spark):
    df = spark.createDataFrame(mention_rows(), "channel_id string, ticker string, "
                                               "posted_at timestamp")
    source, out = scratch_path(spark, "mentions"), scratch_path(spark, "watchlist")
    df.write.parquet(source)
    baseline = burst_stats(df, START + timedelta(days=19)).select(
        "ticker", "baseline_mean", "baseline_std")
    windows = S.sliding_channels(spark.readStream.schema(df.schema).parquet(source))
    finish(S.run_watchlist(windows, baseline, out, scratch_path(spark, "state")))
    got = spark.read.parquet(out).where(F.col("ticker") == "PUMP").collect()
    assert got and all(r.z == float("inf") and r.n_channels >= 3 for r in got)


def test_each_window_end_of_a_backlog_is_ranked(spark):
    ends = [START + timedelta(days=k) for k in range(3)]
    windows = spark.createDataFrame(
        [(t, end, n) for end in ends for t, n in (("A", 9), ("B", 7), ("C", 1))],
        "ticker string, window_end timestamp, n_channels bigint")
    baseline = spark.createDataFrame([("A", 1.0, 1.0), ("B", 1.0, 1.0)],
                                     "ticker string, baseline_mean double, baseline_std double")
    got = S.rank_bursts(windows, baseline, limit=1).collect()
    assert [r.ticker for r in got] == ["A", "A", "A"] and len({r.window_end for r in got}) == 3


def test_tagging_writes_each_message_once(spark, tmp_path):
    box, out, state = tmp_path / "box", scratch_path(spark, "tags"), scratch_path(spark, "state")
    master = spark.createDataFrame([("SUZLON", "Suzlon Energy")], "symbol string, name string")

    def run():
        finish(S.run_tagging(S.stream_messages(spark, str(box)), master, out, state))
        return sorted((r.message_id, r.ticker) for r in spark.read.parquet(out).collect())

    post(box, "1.json", message(1, "buy SUZLON", START), message(1, "buy SUZLON", START),
         message(2, "SBI", START + timedelta(hours=3)), message(3, "", START))
    want = [("1", "SUZLON"), ("2", "SBIN")]
    assert run() == want
    assert run() == want  # nothing new
    post(box, "2.json", message(2, "SBI", START + timedelta(hours=3)),
         message(4, "chatter", START + timedelta(hours=4)))
    assert run() == [*want, ("4", None)]


def test_messages_without_a_symbol_do_not_share_a_join_key(spark):
    rows = [("t", f"c{i % 5}", str(i), "chatter" if i % 4 else "SEBI says", START)
            for i in range(400)]
    rows.append((None, "c", "x", "buy SUZLON", START))
    batch = spark.createDataFrame(rows, "source string, channel_id string, message_id string, "
                                        "text string, posted_at timestamp")
    master = spark.createDataFrame([("SUZLON", "Suzlon Energy")], "symbol string, name string")
    got = S.tag_batch(batch, master).collect()
    assert len(got) == len(rows)  # also where a part of the key is missing
    assert {r.message_id: r.ticker for r in got if r.ticker} == {"x": "SUZLON"}
    auto = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # as in a stream that keeps state
    try:
        sizes = S.tag_stream(batch, master).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", auto)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(r["count"] for r in sizes) < len(rows) / 2


@pytest.mark.parametrize("hours", [40 * 24, 40 * 24 + 2, 40 * 24 + 3])
def test_watchlist_of_stored_windows_equals_that_of_a_state_store(spark, hours):
    """Also where the watermark falls on the end of a window, which then stays open."""
    rows = mention_rows()[:-1] + [("c0", "LAST", START + timedelta(hours=hours)), ("c1", None, START),
                                  ("c1", "PUMP", None), (None, "PUMP", START + timedelta(days=20))]
    rows += [(f"x{k}", "EDGE", START + timedelta(days=39, hours=k)) for k in range(12)]
    df = spark.createDataFrame(rows, "channel_id string, ticker string, posted_at timestamp")
    source = scratch_path(spark, "mentions")
    df.write.parquet(source)
    baseline = burst_stats(df, START + timedelta(days=19)).select(
        "ticker", "baseline_mean", "baseline_std")
    outs = [scratch_path(spark, "watchlist") for _ in range(2)]
    stream = spark.readStream.schema(df.schema).parquet(source)
    finish(S.run_watchlist(S.sliding_channels(stream), baseline, outs[0],
                           scratch_path(spark, "state"), limit=2))
    root, state = scratch_path(spark, "windows"), scratch_path(spark, "state")
    query = S.run_stored_watchlist(stream, baseline, root, outs[1], state, limit=2)
    finish(query)
    assert not any(p["stateOperators"] for p in query.recentProgress)  # nothing held in memory
    want, got = ([tuple(r) for r in spark.read.parquet(out).drop("batch").collect()] for out in outs)
    assert sorted(got) == sorted(want) and len(got) > 3
    edge = datetime(START.year, START.month, START.day) + timedelta(days=40)
    assert any(r[1] == edge for r in got) == (hours > 40 * 24 + 2)
    # A batch that was committed but not published is published when it is replayed.
    again = scratch_path(spark, "watchlist")
    finish(S.run_stored_watchlist(stream, baseline, root, again, scratch_path(spark, "state"), limit=2))
    assert sorted(tuple(r) for r in spark.read.parquet(again).drop("batch").collect()) == sorted(want)


def test_stream_watchlist_keeps_no_state(spark, monkeypatch):
    named = spark.createDataFrame(mention_rows(), "channel_id string, ticker string, "
                                                  "posted_at timestamp")
    monkeypatch.setattr(registry, "crowded", lambda *_: named)
    seen, run = [], S.run_stored_watchlist
    monkeypatch.setattr(S, "run_stored_watchlist",
                        lambda *a, **k: seen.append(run(*a, **k)) or seen[-1])
    assert registry.queries()["stream_watchlist"](spark, "").count() > 0
    assert len(seen) == 1 and not any(p["stateOperators"] for p in seen[0].recentProgress)
