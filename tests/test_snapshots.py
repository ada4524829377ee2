"""Stored tables that change in one step."""

from datetime import date

import pytest

from tipscope.schemas import SESSION_KEY
from tipscope.session import scratch_path
from tipscope.sources import snapshots as S


def prices(spark, *rows):
    return spark.createDataFrame(
        [("NSE", symbol, "EQ", day, close, name) for symbol, day, close, name in rows],
        "exchange string, symbol string, series string, trade_date date, close double, "
        "source_file string")


def load(rows, root, **options):
    return S.load_snapshot(rows, root, SESSION_KEY, month_of="trade_date", order_by="source_file",
                           **options)


def content(spark, root, number=None):
    rows = S.read_snapshot(spark, root, number)
    return None if rows is None else sorted((r.symbol, r.trade_date, r.close) for r in rows.collect())


JULY, AUGUST = date(2026, 7, 31), date(2026, 8, 3)


def test_loads_replace_by_key_and_touch_only_their_months(spark):
    root = scratch_path(spark, "snapshots")
    assert S.read_snapshot(spark, root) is None and S.versions(spark, root) == []
    assert load(prices(spark, ("A", JULY, 1.0, "f1"), ("A", AUGUST, 2.0, "f1"),
                       ("A", AUGUST, 3.0, "f2")), root) == 1
    assert content(spark, root) == [("A", JULY, 1.0), ("A", AUGUST, 3.0)]
    assert load(prices(spark, ("A", AUGUST, 9.0, "f3"), ("B", AUGUST, 5.0, "f3")), root) == 2
    assert content(spark, root) == [("A", JULY, 1.0), ("A", AUGUST, 9.0), ("B", AUGUST, 5.0)]
    first, second = (S.read_version(spark, root, n) for n in (1, 2))
    assert first.months["2026-07"] == second.months["2026-07"]
    assert first.months["2026-08"] != second.months["2026-08"]
    assert content(spark, root, 1) == [("A", JULY, 1.0), ("A", AUGUST, 3.0)]  # pinned readers
    assert load(prices(spark, ("C", JULY, 4.0, "f")), root, replace=True) == 3
    assert content(spark, root) == [("C", JULY, 4.0)]


def test_odd_loads(spark):
    root = scratch_path(spark, "snapshots")
    assert load(prices(spark), root) == 1
    assert content(spark, root) == []
    load(prices(spark, ("A", None, 1.0, "f"), ("A", JULY, 2.0, "f")), root)
    load(prices(spark, ("A", None, 3.0, "g")), root)
    rows = {r.trade_date: r.close for r in S.read_snapshot(spark, root).collect()}
    assert rows == {None: 3.0, JULY: 2.0}
    plain = scratch_path(spark, "snapshots")
    for _ in range(2):
        S.load_snapshot(prices(spark, ("A", JULY, 2.0, "f")), plain, SESSION_KEY)
    assert S.read_snapshot(spark, plain).count() == 1


class Killed(Exception):
    pass


@pytest.mark.parametrize("step", ["_write_months", "commit", "put_file", "rename"])
def test_a_writer_that_dies_leaves_the_old_version(spark, monkeypatch, step):
    root = scratch_path(spark, "snapshots")
    load(prices(spark, ("A", JULY, 1.0, "f1")), root)
    old = content(spark, root)

    def die_before(*args, **options):
        raise Killed

    def die_after(real):
        def run(*args, **options):
            real(*args, **options)
            raise Killed
        return run

    change = prices(spark, ("A", JULY, 2.0, "f2"), ("B", AUGUST, 2.0, "f2"))
    with monkeypatch.context() as patch:
        if step == "rename":  # the version's text is written, its name is not
            patch.setattr(S, "uuid", _Names())
            patch.setattr(_Names, "die", True)
        else:
            patch.setattr(S, step, die_before)
        with pytest.raises(Killed):
            load(change, root)
    assert content(spark, root) == old
    if step == "_write_months":
        with monkeypatch.context() as patch:
            patch.setattr(S, step, die_after(S._write_months))
            with pytest.raises(Killed):
                load(change, root)
        assert content(spark, root) == old
    load(change, root)
    assert content(spark, root) == [("A", JULY, 2.0), ("B", AUGUST, 2.0)]
    if step == "commit":
        with monkeypatch.context() as patch:
            patch.setattr(S, step, die_after(S.commit))
            with pytest.raises(Killed):
                load(prices(spark, ("A", JULY, 7.0, "f9")), root)
        assert content(spark, root)[0] == ("A", JULY, 7.0)  # it was committed


class _Names:
    """Stands for ``uuid``: dies when the name beside a version file is asked for."""
    die = False

    def uuid4(self):
        import traceback
        import uuid
        if self.die and any(f.name == "put_file" for f in traceback.extract_stack()):
            raise Killed
        return uuid.uuid4()


def test_two_writers_of_one_version_both_count(spark, monkeypatch):
    root = scratch_path(spark, "snapshots")
    load(prices(spark, ("A", JULY, 1.0, "f1")), root)
    real, others = S._write_months, [prices(spark, ("B", JULY, 5.0, "f2"))]

    def overtaken(rows, place):
        if others:
            load(others.pop(), root)
        return real(rows, place)

    monkeypatch.setattr(S, "_write_months", overtaken)
    assert load(prices(spark, ("A", JULY, 2.0, "f3")), root) == 3
    assert content(spark, root) == [("A", JULY, 2.0), ("B", JULY, 5.0)]


def test_a_version_is_written_once(spark):
    root = scratch_path(spark, "snapshots")
    version = S.Version(1, "{}", {})
    S.commit(spark, root, version)
    with pytest.raises(S.VersionTaken):
        S.commit(spark, root, version)
    assert S.versions(spark, root) == [1]
    path = f"{root}/pointer"
    assert S.read_file(spark, path) is None
    for text in ("a", "é"):
        S.put_file(spark, path, text, replace=True)
        assert S.read_file(spark, path) == text


def test_a_noted_load_counts_once(spark):
    root = scratch_path(spark, "snapshots")
    assert load(prices(spark, ("A", JULY, 1.0, "f")), root, note=("stream", "4")) == 1
    assert load(prices(spark, ("A", JULY, 2.0, "g")), root, note=("stream", "4")) == 1
    assert load(prices(spark, ("A", JULY, 3.0, "h")), root, note=("stream", "5")) == 2
    assert content(spark, root) == [("A", JULY, 3.0)]


def test_old_versions_are_removed(spark):
    root = scratch_path(spark, "snapshots")
    for k in range(4):
        load(prices(spark, ("A", JULY, float(k), "f"), ("B", AUGUST, 0.0, "f")), root)
    assert S.drop_old_versions(spark, root, keep=1) == 3
    assert S.versions(spark, root) == [4] and len(content(spark, root)) == 2
    with pytest.raises(ValueError):
        S.read_snapshot(spark, root, 1)
