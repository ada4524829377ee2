"""Windows of a stream with late rows, over several micro-batches."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tipscope.session import scratch_path
from tipscope.sources import snapshots as S
from tipscope.streaming import windows as W

START = datetime(2026, 8, 1)
SCHEMA = "ticker string, channel_id string, posted_at timestamp"


def ends(at):
    end = datetime(at.year, at.month, at.day)
    if at > end:
        end += timedelta(days=1)
    return [end, end + timedelta(days=1)]


def batches(seed=1):
    """Days in order, each with rows of days long past, and window ends hit exactly."""
    rnd = random.Random(seed)
    out = []
    for day in range(0, 12, 2):
        rows = []
        for _ in range(30):
            back = rnd.choice([0, 0, 0, 3, 8])
            at = START + timedelta(days=day - back, minutes=rnd.randrange(0, 2880, 60))
            rows.append((rnd.choice(["A", "B", None]), f"c{rnd.randrange(5)}", at))
        rows += [("A", "c9", START + timedelta(days=day)), ("B", "c1", None)] + rows[:3]
        out.append(rows)
    return out


def plain(all_batches):
    """Closed counts, open pairs and late rows, row by row."""
    mark, opened, closed, late = None, set(), {}, []
    for rows in all_batches:
        known = [r for r in rows if r[0] and r[2]]
        for ticker, channel, at in known:
            for end in ends(at):
                if mark is not None and end <= mark:
                    late.append((ticker, channel, at, end))
                else:
                    opened.add((ticker, end, channel))
        newest = max(r[2] for r in known) - timedelta(hours=2)
        mark = newest if mark is None else max(mark, newest)
        for key in {o for o in opened if o[1] <= mark}:
            opened.discard(key)
            closed.setdefault(key[:2], set()).add(key[2])
    return {k: len(v) for k, v in closed.items()}, opened, sorted(late)


def run(spark, files, root, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(files)
    query = W.run_channel_windows(stream, root, state)
    query.awaitTermination()
    assert query.exception() is None


def write(spark, files, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(files)


def state_of(spark, root):
    return ({(r.ticker, r.window_end): r.n_channels for r in W.closed_windows(spark, root).collect()},
            {(r.ticker, r.window_end, r.channel_id) for r in W.open_windows(spark, root).collect()},
            sorted(tuple(r) for r in W.late_rows(spark, root).select(
                "ticker", "channel_id", "posted_at", "window_end").collect()))


def test_windows_open_windows_and_late_rows_are_all_there_is(spark):
    files, root, state = (scratch_path(spark, n) for n in ("files", "windows", "state"))
    done = []
    for rows in batches():
        write(spark, files, rows)
        run(spark, files, root, state)
        done.append(rows)
        if len(done) in (1, 3, 6):
            assert state_of(spark, root) == plain(done)
    closed, opened, late = state_of(spark, root)
    assert closed and opened and late
    every = {}
    for ticker, channel, at in (r for rows in done for r in rows if r[0] and r[2]):
        for end in ends(at):
            every.setdefault((ticker, end), set()).add(channel)
    assert {*closed, *(o[:2] for o in opened), *((r[0], r[3]) for r in late)} == set(every)
    # A run without new files changes nothing.
    number = S.read_version(spark, root).number
    run(spark, files, root, state)
    assert S.read_version(spark, root).number == number


@pytest.mark.parametrize("step", ["late", "commit"])
def test_a_batch_that_dies_is_taken_again_once(spark, monkeypatch, step):
    root = scratch_path(spark, "windows")
    first, second = (spark.createDataFrame(rows, SCHEMA) for rows in batches()[:2])
    sizes = [h * 3_600_000_000 for h in (2, 48, 24)]
    W._batch(first, 0, root, *sizes)
    before = state_of(spark, root)

    class Killed(Exception):
        pass

    def die(*args, **options):
        raise Killed

    with monkeypatch.context() as patch:
        if step == "commit":
            patch.setattr(S, "commit", die)
        else:
            patch.setattr(W, "release", die)  # after the commit
        with pytest.raises(Killed):
            W._batch(second, 1, root, *sizes)
    if step == "commit":
        assert state_of(spark, root) == before
    for _ in range(2):
        W._batch(second, 1, root, *sizes)
    assert state_of(spark, root) == plain(batches()[:2])


def test_nothing_yet(spark):
    root = scratch_path(spark, "windows")
    assert state_of(spark, root) == ({}, set(), [])
    W._batch(spark.createDataFrame([], SCHEMA), 0, root, 1, 48, 24)
    assert state_of(spark, root) == ({}, set(), [])


@pytest.mark.parametrize("window, step", [(48, 24), (60, 36), (24, 24), (10, 24)])
def test_window_ends_hold_the_time(spark, window, step):
    times = [0, 1, 23, 24, 25, 48, 100, -5]
    got = spark.createDataFrame([(t,) for t in times], "t bigint").select(
        "t", W.window_ends(F.col("t"), window, step).alias("ends")).collect()
    for r in got:
        assert r.ends == [e for e in range(-240, 480, step) if e - window < r.t <= e] or (
            r.ends == [e for e in range(-step * 20, step * 20, step) if e - window < r.t <= e])
