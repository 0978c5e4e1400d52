"""Streams give what the batch form gives."""

from quantloom.streaming import bars as st

DATA = "/root/testdata/sf0.001"


def run(spark, df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    path = str(tmp_path / "in")
    events.orderBy("ts").repartitionByRange(4, "ts").write.parquet(path)
    return st.read_ticks(spark, path, events.schema, 8), st.ticks(events)


def test_bars_of_ended_days(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    got = {tuple(r) for r in run(spark, st.bars(live), tmp_path, "bars", "append").collect()}
    want = {tuple(r) for r in st.bars(batch).collect()}
    assert got and got <= want and len(want - got) <= 60  # the last day is open


def test_latest_tick(spark, tmp_path):
    live, batch = stream(spark, tmp_path)
    last = {}
    for r in run(spark, st.latest(live), tmp_path, "latest", "complete").collect():
        last[r.code] = (r.ts, r.price)
    assert last == {r.code: (r.ts, r.price) for r in st.latest(batch).collect()}


def files(spark, path, parts):
    """A folder of parquet files of ticks, one a part, in their order."""
    import os

    for i, rows in enumerate(parts):
        df = spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long, value double, event_type string").coalesce(1)
        df.write.mode("append").parquet(path)
        for f in os.listdir(path):
            if f.endswith(".parquet") and not f.startswith("k"):
                os.rename(f"{path}/{f}", f"{path}/k{i:03d}.parquet")
                os.utime(f"{path}/k{i:03d}.parquet", (1_600_000_000 + i, 1_600_000_000 + i))
    return spark.read.parquet(path)


def late_ticks(seed):
    """Micro-batches of ticks of three codes in which many come after later ones, by at most ten minutes; the last one moves the watermark on."""
    import datetime as dt
    import random

    rng, at = random.Random(seed), dt.datetime(2024, 1, 1)
    ticks = [(rng.randrange(3), at + dt.timedelta(seconds=20 * k, microseconds=rng.randrange(10**6)), k, rng.random(), "x") for k in range(240)]
    ticks += [(1, ticks[30][1], 1000, 5.0, "x"), (1, ticks[30][1], 999, 6.0, "x")]  # ties in time go by event_id
    come = sorted(ticks, key=lambda r: r[1] + dt.timedelta(seconds=rng.randrange(580)))
    return [come[k : k + 40] for k in range(0, len(come), 40)] + [[(9, at + dt.timedelta(days=1), 5000, 0.0, "x")]], ticks


def test_triggers_under_late_files(spark, tmp_path):
    parts, ticks = late_ticks(3)
    path = str(tmp_path / "in")
    events = files(spark, path, parts)
    live = st.read_ticks(spark, path, events.schema, 1)
    got = {(r.code, r.nth): (r.last_ts, round(r["mean"], 9)) for r in run(spark, st.every_stream(live, 3, "15 minutes"), tmp_path, "every", "append").collect()}
    want = {(r.code, r.nth): (r.last_ts, round(r["mean"], 9)) for r in st.every(st.ticks(events)).collect()}
    assert got == want and len(got) >= 78


def test_recent_ticks_under_late_files(spark, tmp_path):
    parts, ticks = late_ticks(4)
    path = str(tmp_path / "in")
    events = files(spark, path, parts)
    live = st.read_ticks(spark, path, events.schema, 1)
    seen = []
    q = st.recent_stream(live, 4).writeStream.foreachBatch(lambda df, i: seen.append((i, [tuple(r) for r in df.collect()]))).outputMode("update").option("checkpointLocation", str(tmp_path / "recent")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    now = {}
    for _, rows in sorted(seen, key=lambda x: x[0]):
        for code in {r[0] for r in rows}:
            now[code] = {r for r in rows if r[0] == code}
    assert set().union(*now.values()) == {tuple(r) for r in st.recent(st.ticks(events), 4).collect()}
