import datetime as dt
import time
from collections import Counter

import pytest

from eventmine.streaming import events as ST

from support import make_events

D = dt.datetime(2024, 1, 1)


def at(h, m=0):
    return D + dt.timedelta(hours=h, minutes=m)


def write_files(spark, path, batches):
    for rows in batches:
        make_events(spark, rows).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(1.1)  # distinct modification times keep file order


def test_window_counts_drop_late_rows(spark, tmp_path):
    src = tmp_path / "src"
    write_files(spark, src, [
        [(1, at(10), 1, "view"), (2, at(10, 30), 1, "view"), (3, at(12), 1, "view")],
        [(5, at(11, 30), 1, "view"),     # behind max time but inside the delay: kept
         (6, at(15), 1, "view")],
        # the late-row filter uses the watermark the previous batch ended with
        # (11:00 here), so this 09:00 row is dropped
        [(4, at(9), 1, "view"), (7, at(14, 30), 1, "view")],
    ])
    s = ST.stream_window_counts(ST.read_event_stream(spark, str(src), max_files_per_trigger=1),
                                "1h", "1h")
    out = ST.run_available_now(spark, s, "t-win", sink=str(tmp_path / "sink"),
                               checkpoint=str(tmp_path / "ck"))
    got = {r.window_start.hour: r.n for r in out.collect()}
    assert got == {10: 2, 11: 1, 12: 1}   # 09:00 dropped as late, 15:00 still open


def test_stream_dedup_drops_repeat_arrival(spark, tmp_path):
    src = tmp_path / "src"
    write_files(spark, src, [
        [(1, at(10), 1, "view"), (2, at(10, 5), 2, "view")],
        [(2, at(10, 5), 2, "view"), (3, at(10, 20), 3, "click")],
    ])
    s = ST.stream_dedup(ST.read_event_stream(spark, str(src), max_files_per_trigger=1),
                        ["event_id"], "1h")
    out = ST.run_available_now(spark, s, "t-dedup", sink=str(tmp_path / "sink"),
                               checkpoint=str(tmp_path / "ck"))
    assert sorted(r.event_id for r in out.collect()) == [1, 2, 3]


def test_sessions_match_batch_on_closed_sessions(spark, tmp_path):
    src = tmp_path / "src"
    rows = [(1, at(1), 1, "view"), (2, at(1, 20), 1, "view"), (3, at(3), 1, "view"),
            (4, at(2), 2, "view"), (5, at(9), 2, "view")]
    write_files(spark, src, [rows])
    s = ST.stream_sessions(ST.read_event_stream(spark, str(src)), "30m", "1h")
    out = ST.run_available_now(spark, s, "t-sess", sink=str(tmp_path / "sink"),
                               checkpoint=str(tmp_path / "ck"))
    got = sorted((r.user_id, r.session_start.hour, r.n_events) for r in out.collect())
    # watermark 08:00: the 09:00 session of user 2 is still open
    assert got == [(1, 1, 2), (1, 3, 1), (2, 2, 1)]


def test_user_state_expiry_and_restart(spark, tmp_path):
    src = tmp_path / "src"
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")
    write_files(spark, src, [[(1, at(10), 1, "purchase"), (2, at(10, 30), 1, "view"),
                              (3, at(10), 2, "view")]])
    s = ST.stream_user_state(ST.read_event_stream(spark, str(src)), "2h", "10m")
    first = ST.latest_user_state(ST.run_available_now(spark, s, "t-us", sink=sink, checkpoint=ck))
    f = {r.user_id: r for r in first.collect()}
    assert f[1].n_events == 2 and f[1].n_purchases == 1 and not f[1].expired
    # more data arrives; rerun from the same checkpoint
    write_files(spark, src, [[(4, at(14), 2, "purchase")]])
    s = ST.stream_user_state(ST.read_event_stream(spark, str(src)), "2h", "10m")
    second = ST.latest_user_state(ST.run_available_now(spark, s, "t-us", sink=sink, checkpoint=ck))
    g = {r.user_id: r for r in second.collect()}
    # user 2 came back after more than 2h: a new spell
    assert g[2].n_events == 1 and g[2].n_purchases == 1 and not g[2].expired
    assert g[1].expired and g[1].n_events == 2                                 # 10:30 + 2h < 13:50
    assert g[1].last_purchase.hour == 10


def test_table_stream_from_file_or_directory(spark, tmp_path):
    from support import SF001
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartition(3).write.parquet(str(tmp_path / "events.parquet"))  # a directory table
    for base in (SF001, str(tmp_path)):
        s = ST.read_table_stream(spark, base, "events")
        out = ST.run_available_now(spark, s, "t-read", sink=str(tmp_path / f"sink{len(base)}"),
                                   checkpoint=str(tmp_path / f"ck{len(base)}"))
        assert out.count() == 1000


def shuffled_files(spark, path, n):
    """The events as ``n`` files not in time order."""
    from support import SF001
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev.repartition(n, "event_id").write.parquet(f"{path}/events.parquet")
    return str(path)


BUILDS = {
    "window_counts": lambda s: ST.stream_window_counts(s, "1d", "1h"),
    "sessions": lambda s: ST.stream_sessions(s, "8h", "1h"),
    "dedup": lambda s: ST.stream_dedup(s.unionByName(s), ["event_id"], "1h"),
    "user_state": lambda s: ST.stream_user_state(s, "3d", "1h")}


@pytest.mark.parametrize("name", sorted(BUILDS))
def test_replay_depends_on_neither_files_nor_batches(spark, tmp_path, name):
    from support import SF001
    last = ST.latest_user_state if name == "user_state" else (lambda x: x)

    def rows(base, slices):
        return Counter(map(tuple, last(ST.replay(spark, base, BUILDS[name], "t-replay", slices=slices)).collect()))

    want = rows(SF001, 1)
    six = shuffled_files(spark, tmp_path, 6)
    assert sum(want.values()) > 10
    assert rows(six, 1) == want and rows(six, 3) == want
    if name in ("dedup", "user_state"):
        assert rows(six, 8) == want


def test_a_replay_of_many_slices_reads_the_table_once(spark, monkeypatch):
    """Rows that leave the table: once for its times, once to be cut."""
    from support import SF001
    seen, real = spark.sparkContext.accumulator(0), ST.read_table

    def counted(*args):
        df = real(*args)

        def work(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b
        return df.mapInArrow(work, df.schema)

    monkeypatch.setattr(ST, "read_table", counted)
    out = ST.replay(spark, SF001, BUILDS["dedup"], "t-once", slices=8)
    n = spark.read.parquet(f"{SF001}/events.parquet").count()
    assert out.count() == n and seen.value == 2 * n


def test_over_two_thousand_files(spark, tmp_path):
    import __spark_entry__ as E
    from support import SF001
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    # 2,100 files: the rows three times over under other event ids
    many = ev.crossJoin(spark.range(3).withColumnRenamed("id", "k")).selectExpr("event_id * 3 + k AS event_id", "ts", "user_id", "event_type", "value", "props")
    many.repartitionByRange(2100, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    assert len(spark.read.parquet(str(tmp_path / "events.parquet")).inputFiles()) > 2000
    assert E.queries()["stream_dedup"](spark, str(tmp_path)).count() == 3000


def test_live_rows_are_kept_or_counted_late(spark, tmp_path):
    src = shuffled_files(spark, tmp_path, 6)
    stream = ST.read_event_stream(spark, f"{src}/events.parquet", max_files_per_trigger=2)
    home = str(tmp_path / "live")
    kept, late = ST.run_live(spark, stream, lambda s: ST.stream_dedup(s, ["event_id"], "1h"), "t-live", "1h", home=home)
    assert late.count() > 0 and kept.count() + late.count() == 1000
    again, late2 = ST.run_live(spark, stream, lambda s: ST.stream_dedup(s, ["event_id"], "1h"), "t-live", "1h", home=home)
    assert again.count() == kept.count() and late2.count() == late.count()


def test_user_state_with_rows_behind_the_watermark(spark, tmp_path):
    """A row whose timeout is already past, in a batch that still admits it."""
    src = tmp_path / "src"
    write_files(spark, src, [[(1, at(10), 1, "view")], [(2, at(20), 2, "view"), (3, at(9, 30), 3, "view")], [(4, at(21), 2, "view")]])
    s = ST.stream_user_state(ST.read_event_stream(spark, str(src), max_files_per_trigger=1), "10m", "1h")
    out = ST.run_available_now(spark, s, "t-late", sink=str(tmp_path / "sink"), checkpoint=str(tmp_path / "ck"))
    got = {r.user_id: (r.n_events, r.expired) for r in ST.latest_user_state(out).collect()}
    assert got[3] == (1, True) and got[1] == (1, True)


def test_a_hot_user_reaches_the_state_as_spells(spark, tmp_path, monkeypatch):
    """One user with most of the events: the state function gets rows in
    proportion to tasks and spells, not to events, and the answer stays."""
    rows = [(k, at(0) + dt.timedelta(minutes=(k * 37) % 6000 + (30_000 if k % 6000 >= 4000 else 0)), 1 if k % 10 else k % 50,
             "purchase" if k % 3 == 0 else "view") for k in range(6000)]
    rows += [(6000, at(1), None, "purchase"), (6001, at(2), None, "view"), (6002, None, 1, "view")]
    make_events(spark, rows).repartition(4, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    real = ST._user_state_fn

    def counting(*args):
        inner = real(*args)

        def fn(key, batches, state):
            n = 0

            def each():
                nonlocal n
                for b in batches:
                    n += len(b)
                    yield b

            out = list(inner(key, each(), state))
            if n > 50:
                raise AssertionError(f"{n} rows of one user")
            yield from out
        return fn

    monkeypatch.setattr(ST, "_user_state_fn", counting)
    out = ST.replay(spark, str(tmp_path), lambda s: ST.stream_user_state(s, "3d", "1h"), "t-hot")
    spells = {}
    for user in {r[2] for r in rows}:
        own = sorted((r[1], r[3]) for r in rows if r[2] == user and r[1])
        for k, (t, kind) in enumerate(own):
            if k == 0 or t - own[k - 1][0] > dt.timedelta(days=3):
                spells.setdefault(user, []).append([0, 0, None])
            spell = spells[user][-1]
            spell[0] += 1
            spell[1] += kind == "purchase"
            spell[2] = t
    got = Counter((r.user_id, r.n_events, r.n_purchases, r.last_event.replace(tzinfo=None)) for r in out.selectExpr(
        "user_id", "n_events", "n_purchases", "cast(last_event AS timestamp_ntz) last_event").distinct().collect())
    assert len(spells[1]) == 2 and got == Counter((u, *x) for u, own in spells.items() for x in own)


def test_user_timers_restart_and_read_back(spark, tmp_path):
    src = tmp_path / "src"
    sink, ck = str(tmp_path / "sink"), str(tmp_path / "ck")

    def run():
        s = ST.stream_user_timers(ST.read_event_stream(spark, str(src)), "2h", "10m")
        with ST.rocksdb_state(spark):
            out = ST.run_available_now(spark, s, "t-ut", sink=sink, checkpoint=ck)
        return {r.user_id: r for r in ST.latest_user_state(out).collect()}, {r.user_id: r for r in ST.open_spells(spark, ck).collect()}

    write_files(spark, src, [[(1, at(10), 1, "purchase"), (2, at(10, 30), 1, "view"), (3, at(10), 2, "view"),
                              (4, at(10), None, "view"), (5, None, 1, "view")]])
    got, kept = run()
    assert (got[1].n_events, got[1].n_purchases, got[1].expired) == (2, 1, False) and got[None].n_events == 1
    assert {u: (r.n_events, r.n_purchases) for u, r in kept.items()} == {1: (2, 1), 2: (1, 0), None: (1, 0)}
    assert kept[1].last_event == at(10, 30) and kept[1].last_purchase == at(10) and kept[2].last_purchase is None
    # the same user goes on, another comes back after more than 2h: its timer and the first one's fire
    write_files(spark, src, [[(6, at(14), 2, "purchase"), (7, at(11), 1, "view")]])
    got, kept = run()
    assert (got[2].n_events, got[2].n_purchases, got[2].expired) == (1, 1, False)
    assert (got[1].n_events, got[1].expired) == (3, True) and got[1].last_purchase == at(10) and got[None].expired
    assert set(kept) == {2} and kept[2].last_event == at(14)
    name = "spark.sql.streaming.stateStore.providerClass"
    assert spark.conf.get(name, None) != ST.ROCKSDB


def test_user_timers_equal_user_state(spark, tmp_path):
    """Over unordered files in three micro-batches, with a hot user; a part that is over when it comes counts as expired at once."""
    rows = [(k, at(0) + dt.timedelta(minutes=(k * 37) % 6000 + (30_000 if k % 1500 >= 1000 else 0)), 1 if k % 10 else k % 50,
             "purchase" if k % 3 == 0 else "view") for k in range(1500)]
    rows += [(1500, at(1), None, "purchase"), (1501, None, 1, "view")]
    make_events(spark, rows).repartition(3, "event_id").write.parquet(str(tmp_path / "events.parquet"))
    want = ST.replay(spark, str(tmp_path), lambda s: ST.stream_user_state(s, "3d", "1h"), "t-us", slices=3)
    with ST.rocksdb_state(spark):
        got = ST.replay(spark, str(tmp_path), lambda s: ST.stream_user_timers(s, "3d", "1h"), "t-ut", slices=3)
    cols = ["user_id", "as_of", "expired", "n_events", "n_purchases", "last_event", "last_purchase"]
    assert Counter(map(tuple, ST.latest_user_state(got).select(*cols).collect())) == Counter(map(tuple, ST.latest_user_state(want).select(*cols).collect()))
    ended = "expired AND user_id IS NOT NULL"
    assert got.where(ended).count() == want.where(ended).count() > 0
    src = tmp_path / "late"
    write_files(spark, src, [[(1, at(10), 1, "view")], [(2, at(20), 2, "view"), (3, at(9, 30), 3, "view")], [(4, at(21), 2, "view")]])
    s = ST.stream_user_timers(ST.read_event_stream(spark, str(src), max_files_per_trigger=1), "10m", "1h")
    with ST.rocksdb_state(spark):
        out = ST.run_available_now(spark, s, "t-late", sink=str(tmp_path / "sink"), checkpoint=str(tmp_path / "ck"))
    last = {r.user_id: (r.n_events, r.expired) for r in ST.latest_user_state(out).collect()}
    assert last[3] == (1, True) and last[1] == (1, True)
