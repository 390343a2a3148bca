"""Keyed state against brute force, over several batches, and late and repeated rows."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import runs
from tidemark.streaming import feed as streams
from tidemark.streaming import keyed

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(autouse=True)
def store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    keyed.with_state(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def drained(spark, make, at, batches, schema, out):
    """What a stream writes for batches that land one after another."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        made = make(streams.files_stream(spark, f"{at}/in"))
        made.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out).parquet(f"{at}/out").collect()


def plain_cache(rows, most, life):
    held, out = {}, {}
    for cache, key, at, seq, op, value in sorted(rows, key=lambda r: (r[2], r[3])):
        mine = held.setdefault(cache, {})
        for k in [k for k, (_, t) in mine.items() if (at - t).total_seconds() > life]:
            del mine[k]
        if op == "put":
            outcome = "renewed" if key in mine else "kept"
            if len(mine) >= most:
                del mine[min(mine, key=lambda k: (mine[k][1], k))]
            mine[key] = value, at
        else:
            outcome, value = ("hit", mine[key][0]) if key in mine else ("miss", None)
        out[seq] = outcome, value
    return out


def test_cache_expires_and_evicts_as_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice("uvwxyz"), START + datetime.timedelta(seconds=40 * i + r.randint(0, 30)), i, r.choice(["put", "get", "get"]), f"v{i}") for i in range(240)]
    got = drained(spark, lambda s: keyed.cached(s, most=3, life=600), str(tmp_path), [rows[:80], rows[80:90], rows[90:]], "cache string, key string, at timestamp, seq long, op string, value string", keyed.Cache.FOUND)
    want = plain_cache(rows, 3, 600)
    assert {x["seq"]: (x["outcome"], x["value"]) for x in got} == want and len(got) == len(rows)
    assert {o for o, _ in want.values()} == {"hit", "miss", "kept", "renewed"}


def test_a_cache_with_room_for_all_is_dealt_to_parts(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice("ab"), f"k{r.randrange(40)}", START + datetime.timedelta(seconds=20 * i), i, r.choice(["put", "get"]), f"v{i}") for i in range(300)]
    make = lambda s: keyed.cached(s, most=1 << 40, life=600)
    got = drained(spark, make, str(tmp_path), [rows[:100], rows[100:200], rows[200:]], "cache string, key string, at timestamp, seq long, op string, value string", keyed.Cache.FOUND)
    assert {x["seq"]: (x["outcome"], x["value"]) for x in got} == plain_cache(rows, 1 << 40, 600) and len(got) == len(rows)
    plan = make(streams.files_stream(spark, f"{tmp_path}/in"))._jdf.queryExecution().analyzed().toString()
    assert "xxhash64(key" in plan


def test_a_put_does_not_look_at_all_entries():
    """Forty thousand entries that stay: a put that copies them all takes minutes."""
    import time
    from types import SimpleNamespace

    import pandas as pd

    cache = keyed.Cache(most=1 << 40, life=10**6)
    cache.entries, cache.handle = SimpleNamespace(iterator=lambda: [], updateValue=lambda k, v: None, removeKey=lambda k: None), SimpleNamespace(registerTimer=lambda t: None)
    n = 40_000
    rows = pd.DataFrame({"key": [f"k{i}" for i in range(n)], "at": pd.to_datetime(range(n), unit="s"), "seq": range(n), "op": "put", "value": "v"})
    began = time.process_time()
    assert sum(map(len, cache.handleInputRows(("a",), iter([rows]), None))) == n and time.process_time() - began < 10


def test_figures_equal_those_of_the_whole_log_after_every_batch(spark, tmp_path):
    r = random.Random(5)
    log = [(r.choice("abc"), i, 1000 + i, round(r.uniform(0, 12), 3), r.random() < 0.6, r.random() < 0.2) for i in range(150)]
    schema = "source string, seq long, at long, seconds double, ok boolean, limited boolean"
    seen = []
    for n, end in enumerate((40, 45, 150)):
        start = len(seen)
        seen = log[:end]
        spark.createDataFrame(log[start:end], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        made = keyed.figures(streams.files_stream(spark, f"{tmp_path}/in"))
        made.writeStream.outputMode("update").foreachBatch(lambda rows, _, n=n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out{n}")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        got = {x["source"]: x for x in spark.read.parquet(f"{tmp_path}/out{n}").collect()}
        whole = {x["source"]: x for x in runs._metrics(spark.createDataFrame(seen, schema), 10_000).collect()}
        assert set(got) == {x[0] for x in log[start:end]}
        for source, x in got.items():
            w = whole[source]
            assert x["mean"] == pytest.approx(w["mean"]) and x["rate"] == pytest.approx(w["rate"]) and (x["failures"], x["limits"]) == (w["failures"], w["limits"])
            assert (None if x["limited_at"] is None else 10_000 - x["limited_at"]) == w["since"]


def test_a_group_of_figures_holds_many_sources():
    """One call for a share of the sources, and one value of state read and written for each source of the batch."""
    calls, state = [], {}

    class Held:
        def getMapState(self, *_):
            return self

        def getValue(self, key):
            calls.append("get")
            return state.get(key)

        def updateValue(self, key, value):
            calls.append("put")
            state[key] = value

    requests, r, log, got = keyed.Requests(), random.Random(8), [], {}
    requests.init(Held())
    for batch in range(3):
        rows = [(r.choice([None, *(f"s{i}" for i in range(40))]), 1000 * batch + i, r.randint(0, 99), round(r.uniform(0, 9), 3), r.random() < 0.5, r.random() < 0.1) for i in range(600)]
        log += rows
        r.shuffle(rows)
        frame = pd.DataFrame(rows, columns=["source", "seq", "at", "seconds", "ok", "limited"])
        calls.clear()
        out = pd.concat(requests.handleInputRows((7,), iter([frame[:250], frame[250:]]), None))
        assert len(calls) == 2 * len(out) == 2 * len({x[0] for x in rows})
        got |= {x[0]: x[1:] for x in out.astype(object).where(out.notna(), None).itertuples(index=False, name=None)}
    for source in {x[0] for x in log}:
        mine = sorted(x[1:] for x in log if x[0] == source)
        failures = next((i for i, x in enumerate(reversed(mine)) if x[3]), len(mine))
        some, hits = [x[2] for x in mine[-5:]], [x[1] for x in mine if x[4]]
        assert got[source] == (mine[-1][0], sum(some) / len(some), sum(x[3] for x in mine) / min(len(mine), 10), failures, len(hits), max(hits, default=None), len(mine))
        assert state[(source,)][0] == [x[0] for x in mine[-20:]]


def test_figures_of_a_source_without_a_name(spark, tmp_path):
    rows = [(n, i, i, 1.0, i % 2 == 0, False) for n in (None, "a") for i in range(3)]
    for go in (0, 3):
        spark.createDataFrame([(n, i + go, *x) for n, i, *x in rows], "source string, seq long, at long, seconds double, ok boolean, limited boolean").write.mode("append").parquet(f"{tmp_path}/in")
        made = keyed.figures(streams.files_stream(spark, f"{tmp_path}/in"), 4)
        made.writeStream.outputMode("update").foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert {(x["source"], x["seq"], x["tries"]) for x in spark.read.parquet(f"{tmp_path}/out").collect()} == {(None, 5, 6), ("a", 5, 6)}


def test_later_requests_do_not_count_yet(spark):
    log = spark.createDataFrame([("a", 1, 50, 1.0, True, True), ("a", 2, 500, 99.0, False, True)], "source string, seq long, at long, seconds double, ok boolean, limited boolean")
    assert [(r["source"], r["delay"]) for r in runs.delays(log, 80).collect()] == [("a", 1.3)]


def test_sessions_in_append_mode_drop_repeats_and_late_rows(spark, tmp_path):
    at = lambda minutes: START + datetime.timedelta(minutes=minutes)
    first = [(1, 7, at(0)), (2, 7, at(10)), (2, 7, at(10)), (3, 8, at(5))]
    late = [(1, 7, at(0)), (9, 7, at(12))]  # a repeat and a new one, both behind the watermark by then
    batches = [first, [(4, 7, at(300))], late + [(5, 7, at(310))], [(-1, -1, at(5000))], [(-2, -1, at(5001))]]
    out = "user_id long, begun timestamp, ended timestamp, n long"
    got = drained(spark, lambda s: streams.sessions(s, "30 minutes", "1 hour"), str(tmp_path), batches, "event_id long, user_id long, ts timestamp", out)
    assert sorted((r["user_id"], r["begun"], r["ended"], r["n"]) for r in got if r["user_id"] > 0) == [(7, at(0), at(10), 2), (7, at(300), at(310), 2), (8, at(5), at(5), 1)]


def test_dedup_of_repeated_ids(spark, tmp_path):
    at = lambda hours: START + datetime.timedelta(hours=hours)
    batches = [[(1, at(0), "a"), (1, at(1), "a"), (2, at(2), "b")], [(2, at(3), "b"), (3, at(4), "c"), (1, at(5), "a")]]
    got = drained(spark, streams.deduplicated, str(tmp_path), batches, "event_id long, ts timestamp, event_type string", "event_id long, ts timestamp, event_type string")
    assert sorted(r["event_id"] for r in got) == [1, 2, 3]


def test_a_folder_is_removed(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/x")
    streams.remove(spark, f"{tmp_path}/x")
    assert not (tmp_path / "x").exists() and F.lit(1) is not None
