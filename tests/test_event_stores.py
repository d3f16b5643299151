"""How the registered queries keep linked events."""

import threading
import time
from types import SimpleNamespace

from fixtures import need as N
from fixtures import study_queries as Q
from fixtures.study_queries import _event_store
from tests.conftest import tuples

STAYS = "entity_id bigint, stay_id bigint, start_ts timestamp_ntz, end_ts timestamp_ntz, screen_flag int"


def test_sources_are_stored_side_by_side(frame):
    """Each of two stores waits for the other to begin; the log is that of the events themselves."""
    t = SimpleNamespace(
        stays=frame(STAYS, (1, 1, "2000-01-01 00:00:00", None, 1)),
        cases=frame("case_no bigint, entity_id bigint", (7, 2)),
        inventory=frame("case_no bigint, assessed_ts timestamp_ntz, inventory_no int, a1 int, a2 int, a3 int", (7, "2000-02-01 00:00:00", 1, 1, 3, 4)),
    )
    both = threading.Barrier(2, timeout=60)
    names = ["screen", "inventory"]
    stored = N.need_log(t, names, lambda events, ts: (both.wait(), events)[1])
    assert tuples(stored) == tuples(N.need_log(t, names)) and stored.count() == 2


def test_a_stored_month_is_spread_over_tasks(spark, frame):
    stays = frame(STAYS, *[(i, i, "2000-01-01 00:00:00", None, 0) for i in range(100)])
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        stored = _event_store(stays, "start_ts")
    finally:
        spark.conf.unset(key)
    assert len(stored.inputFiles()) > 1
    assert tuples(stored, *stays.columns) == tuples(stays)


def test_sources_of_a_matrix_are_linked_once_and_its_dates_are_listed(frame, monkeypatch):
    stays = frame(STAYS, *[(1, y, f"{y}-03-01 00:00:00", f"{y}-04-01 00:00:00", 1) for y in range(1996, 2002)])
    logs, given, since = [], [], Q.X.time_since_known

    def need_log(t):
        logs.append(N.log_of("screen", t.stays, "start_ts"))
        return logs[-1]

    def recorded(events, ts, name, dates):
        given.append(dates)
        return since(events, ts, name, dates)

    monkeypatch.setattr(N, "need_log", need_log)
    monkeypatch.setattr(Q.X, "time_since_known", recorded)
    monkeypatch.setattr(Q, "bookings", lambda t: t.stays.selectExpr("entity_id", "start_ts as knowledge_date"))
    rows = Q._wide_matrices(SimpleNamespace(stays=stays)).collect()
    assert len(logs) == 1 and given and all(isinstance(dates, list) for dates in given)
    assert rows and all(r.since_last_need == r.since_last_booking == r.since_last_stay > 0 for r in rows)


def test_shuffles_of_stores_do_not_pile_up(spark, frame, tmp_path):
    """The files of a store's shuffle are gone when it is written; afterwards the session is as before."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(f) for f in manager.getAllFiles().mkString("\n").split("\n") if "shuffle_" in str(f)}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    stays, before = frame(STAYS, *[(i, i, "2000-01-01 00:00:00", None, 0) for i in range(100)]), spark.conf.get(key)
    known = shuffles()
    with Q.sinks.shuffles_freed(spark):
        _event_store(stays, "start_ts")
        left = time.time() + 30
        while shuffles() - known and time.time() < left:
            time.sleep(0.2)
    assert not shuffles() - known and spark.conf.get(key) == before


def test_stores_hold_what_the_log_reads(frame):
    t = SimpleNamespace(
        raw_incidents=frame("id bigint, hash_key string", (7, "h")),
        incidents=frame(
            "id bigint, incident_ts timestamp_ntz, disposition string, primary_txt string, secondary_txt string", (7, "2000-02-01 00:00:00", "d", "ANXIETY", "x"),
        ),
        crosswalk=frame("entity_id bigint, source string, source_key string, hash_key string", (3, N.HASH, None, "h")),
    )
    held = []
    stored = N.need_log(t, ["incident"], lambda events, ts: (held.append(events.columns), events)[1])
    assert held == [["entity_id", "incident_ts", "primary_txt", "secondary_txt"]]
    assert tuples(stored) == tuples(N.need_log(t, ["incident"])) and stored.count() == 1
