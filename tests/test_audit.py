"""Files that are audited inside the stream, against a plain walk over the same deliveries."""

import hashlib
import os
import random
from datetime import date, timedelta

import pytest

from test_sources import HEADER, line, write
from tipscope.session import scratch_path
from tipscope.sources import snapshots as S
from tipscope.streaming import audit as A


def text(day):
    return day.strftime("%d-%b-%Y")


class Store:
    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder
        self.prices, self.ledger = scratch_path(spark, "prices"), scratch_path(spark, "ledger")
        self.state = scratch_path(spark, "state")

    def run(self, **options):
        query = A.ingest_audited(self.spark, str(self.folder), self.prices, self.ledger,
                                 self.state, **options)
        query.awaitTermination()
        assert query.exception() is None

    def verdicts(self):
        rows = S.read_snapshot(self.spark, self.ledger).collect()
        return {r.path.split(f"{self.folder.name}/", 1)[1]: (r.status, r.note) for r in rows}

    def closes(self):
        rows = S.read_snapshot(self.spark, self.prices)
        return {} if rows is None else {(r.symbol, r.trade_date): r.close for r in rows.collect()}


def put(folder, name, at, *lines):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    write(path, *lines)
    os.utime(path, (at, at))


FRIDAY, MONDAY = date(2026, 8, 14), date(2026, 8, 17)


@pytest.fixture
def store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    return Store(spark, tmp_path / "in")


def test_only_files_of_their_own_day_count(store):
    at = 1_790_000_000
    put(store.folder, "2026-08-14.csv", at, HEADER, line("A", close="1"), line("B", close="2"))
    put(store.folder, "2026-08-17.csv", at, HEADER, line("A", close="3"))  # echo of Friday
    put(store.folder, "2026-08-18.csv", at, HEADER)
    (store.folder / "2026-08-19.csv").write_text("")  # passed over by the reader
    put(store.folder, "latest.csv", at, HEADER, line("A", close="4"))
    put(store.folder, "2026-08-20.csv", at, HEADER.replace("CLOSE_PRICE", "CLOSING"),
        line("A", day="20-Aug-2026"))
    store.run()
    assert store.verdicts() == {
        "2026-08-14.csv": ("valid", None), "2026-08-17.csv": ("nodata", A.STALE),
        "2026-08-18.csv": ("nodata", A.STALE),
        "latest.csv": ("error", A.NO_DAY), "2026-08-20.csv": ("error", A.NO_COLUMNS)}
    assert store.closes() == {("A", FRIDAY): 1.0, ("B", FRIDAY): 2.0}
    facts = {r.path.rsplit("/", 1)[1]: r for r in
             S.read_snapshot(store.spark, store.ledger).collect()}
    whole = (store.folder / "2026-08-14.csv").read_bytes()
    assert facts["2026-08-14.csv"].sha256 == hashlib.sha256(whole).hexdigest()
    assert facts["2026-08-14.csv"].bytes == len(whole)
    assert facts["2026-08-17.csv"].internal_date == "14-Aug-2026"


def test_repeats_revisions_and_columns_in_another_order(store):
    at = 1_790_000_000
    put(store.folder, "first/2026-08-14.csv", at, HEADER, line("A", close="1"), line("B"))
    put(store.folder, "a+b c%20/2026-08-14.csv", at + 1, HEADER, line("A", close="1"), line("B"))
    put(store.folder, "x/2026-08-14.csv", at + 2, HEADER, line("A", close="7"))
    store.run()
    assert store.verdicts() == {
        "first/2026-08-14.csv": ("valid", None), "a+b c%20/2026-08-14.csv": ("skipped", A.KNOWN),
        "x/2026-08-14.csv": ("valid", None)}
    assert store.closes() == {("A", FRIDAY): 7.0, ("B", FRIDAY): 105.5}
    put(store.folder, "y/2026-08-14.csv", at + 3, HEADER, line("A", close="7"))
    put(store.folder, "a z%2B+/2026-08-14.csv", at + 4, HEADER, line("A", close="8"))
    names = HEADER.split(", ")
    turned = dict(zip(names, line("C", day="17-Aug-2026", close="5").split(", ")))
    order = [*names[:3], *names[:2:-1]]
    put(store.folder, "y/2026-08-17.csv", at, ",".join(order), ",".join(turned[n] for n in order))
    store.run()
    verdicts = store.verdicts()
    assert verdicts["y/2026-08-14.csv"] == ("skipped", A.KNOWN)
    assert verdicts["a z%2B+/2026-08-14.csv"] == ("valid", None)
    assert store.closes() == {("A", FRIDAY): 8.0, ("B", FRIDAY): 105.5, ("C", MONDAY): 5.0}
    before = S.versions(store.spark, store.ledger), store.verdicts(), store.closes()
    store.run()  # nothing new
    assert before == (S.versions(store.spark, store.ledger), store.verdicts(), store.closes())
    store.state = scratch_path(store.spark, "state")
    store.run()  # everything read again
    assert before[1:] == (store.verdicts(), store.closes())


@pytest.mark.parametrize("dies_at", ["prices", "ledger"])
def test_a_batch_that_dies_counts_once(store, monkeypatch, dies_at):
    put(store.folder, "2026-08-14.csv", 1_790_000_000, HEADER, line("A", close="1"))
    commit = S.commit

    def die(spark, root, version):
        if root == getattr(store, dies_at):
            raise OSError("gone")
        commit(spark, root, version)

    with monkeypatch.context() as patch:
        patch.setattr(S, "commit", die)
        with pytest.raises(Exception, match="gone"):
            store.run()
    assert S.read_snapshot(store.spark, store.ledger) is None
    store.run()
    assert store.verdicts() == {"2026-08-14.csv": ("valid", None)}
    assert store.closes() == {("A", FRIDAY): 1.0}
    assert S.versions(store.spark, store.prices) == [1] == S.versions(store.spark, store.ledger)


def test_a_batch_given_again_after_its_commit_changes_nothing(store):
    put(store.folder, "2026-08-14.csv", 1_790_000_000, HEADER, line("A", close="1"))
    store.run()
    seen = store.spark.createDataFrame(
        [("other.csv", FRIDAY, None, 1, "f", HEADER, "14-Aug-2026")],
        "path string, day date, modified timestamp, bytes bigint, sha256 string, header string, "
        "internal_date string")
    A.load_audited(seen, 0, store.prices, store.ledger, store.state)
    assert store.verdicts() == {"2026-08-14.csv": ("valid", None)}


def test_random_deliveries_over_many_batches(store):
    rng = random.Random(5)
    current, closes, want, at = {}, {}, {}, 1_790_000_000
    for delivery in range(2):
        for number in range(9):
            at += 1
            day = FRIDAY + timedelta(days=rng.randrange(3))
            inside = day if rng.random() < 0.7 else day - timedelta(days=1)
            rows = {rng.choice("AB"): float(rng.randrange(2)) for _ in range(2)}
            lines = [line(s, day=text(inside), close=str(c)) for s, c in sorted(rows.items())]
            name = f"{delivery}-{number}/{day}.csv"
            put(store.folder, name, at, HEADER, *lines)
            if inside != day:
                want[name] = ("nodata", A.STALE)
            elif current.get(day) == lines:
                want[name] = ("skipped", A.KNOWN)
            else:
                want[name] = ("valid", None)
                current[day] = lines
                closes.update({(s, day): c for s, c in rows.items()})
        store.run(files_per_batch=4)
    assert store.verdicts() == want
    assert store.closes() == closes
    assert {status for status, _ in want.values()} == {"valid", "nodata", "skipped"}


def test_no_files(store):
    store.run()
    assert S.read_snapshot(store.spark, store.ledger) is None and store.closes() == {}
