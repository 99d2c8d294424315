"""Rules that SQL doesn't hold: cuts of a grid against plain Python, streams with state that ends, sources with odd rows, hot keys."""

import math
import random
import struct
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from tidemark import staging
from tidemark.operators import palettes as K
from tidemark.operators import pixels as X
from tidemark.operators import refine as R
from tidemark.operators import windows as W
from tidemark.sources import readers
from tidemark.sources.changes import read_changes, runs, upsert_batch
from tidemark.streaming import streams as T


def half_up(x):
    return math.floor(x + 0.5)


def ordered(cuts, limit, cells):
    cuts = [0, *cuts[1:-1], limit]
    for i in range(1, cells):
        cuts[i] = min(max(cuts[i], cuts[i - 1] + 1), limit - (cells - i))
    return cuts


def brute_cuts(edges, limit, cells, origin):
    """edges: strength at the places 1 to limit - 1."""
    step = limit / cells
    even = [min(half_up(i * step), limit) for i in range(cells + 1)]
    cuts = list(even)
    gate = 0.5 * sum(edges) / len(edges)
    for i in range(1, cells):
        target, reach = origin + i * step, max(0.35 * step, 2.0)
        last = limit - (cells - i)
        low, high = max(math.floor(target - reach), i), min(math.ceil(target + reach), last)
        seen = [(edges[c - 1], -c) for c in range(low, high + 1) if 1 <= c <= limit - 1]
        best = max(seen) if seen else None
        cuts[i] = -best[1] if best and best[0] >= gate else min(max(half_up(target), i), last)
    cuts = ordered(cuts, limit, cells)
    widths = [max(b - a, 1) for a, b in zip(cuts, cuts[1:])]
    ratio, off = max(widths) / min(widths), max(abs(w - step) / max(step, 1.0) for w in widths)
    if cells <= 1 or (ratio <= 1.8 and off <= 0.62):
        return cuts
    if ratio <= 2.25 and off <= 0.9:
        return ordered([half_up(c * 0.6 + e * 0.4) for c, e in zip(cuts, even)], limit, cells)
    return even


def test_cuts(spark):
    rnd = random.Random(5)
    limits, rows, want = [], [], {}
    for k in range(60):
        cells, size = rnd.randint(1, 12), rnd.randint(24, 120)
        edges = [rnd.choice([0.0, 1.0, rnd.random() * 9]) if k % 3 else (5.0 if (c + rnd.randint(-1, 1)) % max(2, size // cells) == 0 else 0.5) for c in range(1, size)]
        origin = rnd.choice([0.0, 1.5, 3.0])
        limits.append((k, size, cells, origin))
        rows += [(k, c + 1, e) for c, e in enumerate(edges)]
        want[k] = brute_cuts(edges, size, cells, origin)
    profile = spark.createDataFrame(rows, "image_id int, pos int, edge double")
    table = spark.createDataFrame(limits, "image_id int, size int, cells int, origin double")
    got = {}
    for r in R.stable_cuts(R.elastic_cuts(profile, table, "image_id", "pos", "edge"), "image_id").orderBy("image_id", "cut").collect():
        got.setdefault(r["image_id"], []).append(r["at"])
    assert got == want


def test_restore_both_ways(spark):
    """A picture of 4 x 4 flat cells of 8 pixels with noise comes back, by both pipelines."""
    rnd = random.Random(2)
    colours = [(200, 30, 30), (30, 60, 200), (240, 230, 90), (20, 20, 20)]
    cell = {(cx, cy): rnd.choice(colours) for cx in range(4) for cy in range(4)}
    noise = lambda v: max(0, min(255, v + rnd.randint(-6, 6)))
    rows = [(1, x, y, *[noise(v) for v in cell[x // 8, y // 8]], 255) for x in range(32) for y in range(32)]
    one = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")
    labelled = K.palette_labels(one, K.kmeans_palette(one, [4]))
    first = K.restore_grid(labelled, 4, 4, 4)
    second, counts = K.restore_advanced(one, 4, 4, k=4)
    for out in (first, second):
        got = {(r["cx"], r["cy"]): (r["r"], r["g"], r["b"]) for r in out.collect()}
        assert got.keys() == cell.keys() and all(max(abs(a - b) for a, b in zip(got[c], cell[c])) <= 4 for c in cell)
    row = counts.first()
    assert row["confident_ratio"] == 1.0 and row["protected_pixels"] <= 4 * 16  # at most the corners of the cells


def test_palette_is_brute(spark):
    """The error told is that of all pixels, labels are the nearest colours, and each colour is the mean of what lies nearest."""
    rnd = random.Random(11)
    rows = [(1, x, y, *[rnd.choice((20, 120, 220)) + rnd.randint(-9, 9) for _ in range(3)], 255 if rnd.random() < 0.9 else 0) for x in range(24) for y in range(24)]
    pixels = spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int, a int")
    fit = K.kmeans_palette(pixels, [6]).first()
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    solid = [r[3:6] for r in rows if r[6] >= 128]
    labels = {(r["x"], r["y"]): r["label"] for r in K.palette_labels(pixels, K.kmeans_palette(pixels, [6])).collect()}
    assert labels == {(r[1], r[2]): min(range(6), key=lambda k: (far(r[3:6], fit["palette"][k]), k)) for r in rows}
    # bins, not pixels, are dealt to colours, so the error is within a bin's width of brute force
    assert fit["rmse"] == pytest.approx(math.sqrt(sum(min(far(p, c) for c in fit["palette"]) for p in solid) / len(solid)), rel=0.02)
    for k, colour in enumerate(fit["palette"]):
        own = [p for p in solid if min(range(6), key=lambda j: far(p, fit["palette"][j])) == k]
        assert all(abs(sum(p[c] for p in own) / len(own) - colour[c]) < 4 for c in range(3))


def test_cell_without_winner_has_plain_mean(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 0, 10, 20, 30, 255, 1.0), (1, 0, 0, 0, 20, 40, 50, 255, 0.5)], "image_id int, cx int, cy int, label int, r int, g int, b int, a int, w double")
    winners = spark.createDataFrame([(1, 0, 0, 9)], "image_id int, cx int, cy int, label int")
    assert tuple(X.cell_color(pixels, winners).select("r", "g", "b", "a").first()) == (15, 30, 40, 255)


def test_bare_cells_share_alike(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 2, 9, 9, 9, 255, 0.0)], "image_id int, cx int, cy int, label int, r int, g int, b int, a int, w double")
    shares, means = X.label_shares(pixels, 4)
    assert sorted((r["label"], r["p"]) for r in shares.collect()) == [(k, 0.25) for k in range(4)] and means.first()["lab"]["L"] == 0.0


def files(spark, df, tmp_path, parts):
    rows = df.orderBy(df.columns[0]).collect()
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def finish(writer, tmp_path):
    q = writer.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_rate_limit_state_ends(spark, tmp_path):
    calls = spark.range(400).select((F.col("id") * 10.0 + 1000).alias("at"), F.floor(F.col("id") / 10).cast("string").alias("client"), F.col("id").alias("event_id"))
    stream = T.stream_rate_limit(files(spark, calls, tmp_path, 4), 4)
    q = finish(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: p if isinstance(p, dict) else __import__("json").loads(p.json), q.recentProgress) if p["stateOperators"]]
    assert kept[-1] < 30 < 40  # 40 clients were seen; those before the watermark are forgotten
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, T.rate_limit(calls, 4).collect()))


def test_stream_state_lives_and_ends(spark, tmp_path):
    events = spark.createDataFrame([(0.0, "a", "queued", 0.0), (50.0, "a", "downloading", 10.0), (60.0, "b", "queued", 0.0), (20_000.0, "c", "queued", 0.0), (20_001.0, "c", "completed", 100.0), (40_000.0, "d", "queued", 1.0)], "at double, job_id string, status string, percent double")
    out = T.stream_state(files(spark, events, tmp_path, 3))
    seen = []
    finish(out.writeStream.outputMode("update").foreachBatch(lambda b, _: seen.extend(tuple(r) for r in b.collect())), tmp_path)
    assert ("a", "downloading", 10.0, 7250.0, True) in seen and ("a", "downloading", 10.0, 7250.0, False) in seen and ("c", "completed", 100.0, 27_201.0, False) in seen
    assert not [r for r in seen if r[0] == "d" and not r[4]]


def test_idle_stream_is_batch(spark, tmp_path):
    calls = spark.range(60).select((F.col("id") * F.col("id") * 20.0).alias("at"), (F.col("id") % 2).cast("int").alias("node"), (F.col("id") % 5 * 300.0).alias("seconds"))
    finish(T.stream_idle(files(spark, calls, tmp_path, 3), 600).writeStream.format("parquet").option("path", str(tmp_path / "out")), tmp_path)
    got = sorted((r["node"], r["from"], r["to"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = T.idle_sessions(calls.select("node", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("ts"), (F.col("seconds") * 1000).alias("duration_ms")), 600)
    assert got == sorted((r["node"], r["f"], r["t"]) for r in batch.select("node", (F.unix_micros("from") / 1e6).alias("f"), (F.unix_micros("to") / 1e6).alias("t")).collect()) and got


def test_idle_is_without_active_requests(spark):
    """A request of 1,000 s keeps its worker busy although nothing begins meanwhile; exactly the gap is idle, a hair less is not."""
    rows = [(1, 0, 1000.0), (1, 100, 5.0), (1, 1599.5, 1.0), (1, 2200.5, 1.0), (2, 0, 1.0), (2, 600, 1.0), (2, 1201, 1.0)]
    df = spark.createDataFrame([(n, float(t), s * 1000) for n, t, s in rows], "node int, t double, duration_ms double").withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long")))
    got = sorted((r["node"], r["seconds"]) for r in T.idle_sessions(df, 600).collect())
    assert got == [(1, 600.0), (2, 600.0)]


@pytest.mark.parametrize("kind", ["sessions", "users"])
def test_upsert_streams(spark, tmp_path, kind):
    base = spark.range(120).select(F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.concat(F.lit("k"), F.col("id") % 17).alias("token"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("agent"), "id")).alias("agent"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("ip"), "id")).alias("ip"))
    base = base.withColumns({"uid": F.col("token"), "name": F.coalesce("agent", F.lit("")), "photo": F.col("ip")})
    make, batch = (T.stream_sessions, T.upsert_sessions) if kind == "sessions" else (T.stream_users, T.upsert_users)
    table = str(tmp_path / "table")
    finish(make(files(spark, base, tmp_path, 4), table), tmp_path)
    want = batch(base)
    got = read_changes(spark, table, T.fold_sessions if kind == "sessions" else T.fold_users).select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_changes_follow_the_batch(spark, tmp_path):
    """Twenty small batches upon a large one: each writes its own rows and folds small runs, never the large one before it is due; a
    repeated batch, before and after it was folded, changes nothing."""
    path = str(tmp_path / "table")
    size = lambda: {str(f): f.stat().st_size for f in tmp_path.rglob("*.parquet")}
    made = lambda k, n: spark.range(n).select(F.concat(F.lit("k"), F.col("id") * (k + 1) % 5000).alias("token"), (F.lit(k) * 100 + F.col("id") % 7).alias("created"), (F.lit(k) * 100 + 50).cast("long").alias("expires_at"), F.when(F.col("id") % 3 == k % 3, F.lit(f"agent{k}")).alias("agent"), F.lit(f"ip{k}").alias("ip"), F.lit("active").alias("status"))
    batches = [made(k, 5000 if k == 0 else 40).groupBy("token").agg(F.min("created").alias("created"), F.max("expires_at").alias("expires_at"), F.max("agent").alias("agent"), F.max("ip").alias("ip"), F.max("status").alias("status")) for k in range(21)]
    want = None
    for k, batch in enumerate(batches):
        before = size()
        upsert_batch(batch, path, k, T.fold_sessions, fan=4)
        new = sum(n for f, n in size().items() if f not in before)
        # due foldings of the level that holds the large run come after 4 and 16 batches
        assert k in (0, 3, 15) or new < 60_000, (k, new)
        if k in (5, 11):
            upsert_batch(batch, path, k, T.fold_sessions, fan=4)
            upsert_batch(batches[2], path, 2, T.fold_sessions, fan=4)
    ordered = [b.withColumn("order_", F.lit(k).cast("long")) for k, b in enumerate(batches)]
    want = T.fold_sessions(reduce(lambda a, b: a.unionByName(b), ordered))
    got = read_changes(spark, path, T.fold_sessions)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and len(runs(spark, path)) <= 5


def test_job_state_stream_and_metadata(spark, tmp_path):
    events = spark.range(90).select(F.timestamp_seconds(F.col("id")).alias("ts"), (F.col("id") % 7).cast("string").alias("job_id"), F.col("id").cast("double").alias("percent"))
    finish(readers.stream_job_state(files(spark, events, tmp_path, 3), str(tmp_path / "table")), tmp_path)
    got = {r["job_id"]: (r["percent"], str(r["expires_at"])) for r in readers.read_job_state(spark, str(tmp_path / "table")).collect()}
    assert len(got) == 7 and got["6"] == (83.0, "1970-01-01 02:01:23")
    rows = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-01 00:00:00', 60), ('a', TIMESTAMP '2024-01-01 00:01:00', NULL), ('b', TIMESTAMP '2024-01-01 00:00:00', 10) t(key, ts, ttl_seconds)")
    readers.write_metadata(rows, str(tmp_path / "meta"))
    assert {r["key"]: str(r["expires_at"]) for r in spark.read.parquet(str(tmp_path / "meta")).collect()} == {"a": "2024-01-01 01:01:00", "b": "2024-01-01 00:00:10"}


def png(rows):
    """A picture of (r, g, b, a) rows as PNG bytes."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pixels_and_sizes(spark, tmp_path):
    picture = [[(1, 2, 3, 255), (4, 5, 6, 255), (7, 8, 9, 255)], [(250, 0, 9, 255), (0, 0, 0, 255), (255, 255, 255, 255)]]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png(picture))
    (tmp_path / "in" / "b.png").write_bytes(b"no picture")
    got = {(r["x"], r["y"]): (r["r"], r["g"], r["b"], r["a"]) for r in readers.read_pixels(spark, str(tmp_path / "in")).collect()}
    assert got == {(x, y): p for y, row in enumerate(picture) for x, p in enumerate(row)}
    (tmp_path / "sizes.csv").write_text("image_id,cols,rows\na,4,5\nb,0,3\na,6,7\nc,x,1\n")
    assert [tuple(r) for r in readers.read_grid_sizes(spark, str(tmp_path / "sizes.csv")).collect()] == [("a", 6, 7)]


def test_host_snapshots(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"hostId": "h", "hostStats": {"cpu": 3.5, "memory": 100, "network": {"rx": 1, "tx": 2}, "cores": [1.0, 2.0], "topProcesses": [{"pid": 1, "name": "p", "cpu": 9.0}]}, "containers": [], "gpu": [{"gpuIndex": 0, "utilizationPercent": 80.0, "memoryUsedMb": 10.0, "memoryTotalMb": 20.0, "temperatureC": null}]}')
    (tmp_path / "b.json").write_text('{"hostId": "bare"}')
    got = readers.read_host_snapshots(spark, str(tmp_path))
    assert {r["host"]: r["cpu"] for r in got["hosts"].collect()} == {"h": 3.5, "bare": None}
    assert [tuple(r) for r in got["gpu"].collect()] == [("h", 0, 80.0, 10.0, 20.0, None)] and got["containers"].count() == 0 and [r["core"] for r in got["cores"].collect()] == [0, 1]


def test_log_lines(spark, tmp_path):
    (tmp_path / "api.log").write_text("one\n\nthree")
    assert [(r["pos"], r["line"]) for r in readers.read_log_lines(spark, str(tmp_path)).orderBy("pos").collect()] == [(0, "one"), (1, ""), (2, "three")]


def test_running_ewma_and_failures(spark):
    """Slices and blocks give what a walk gives, over several slices and blocks."""
    rows = [(k % 2, float(k * 37), k, float((k * 7919) % 300), 500 if (k * 31) % 10 < 6 else 200) for k in range(1500)]
    df = spark.createDataFrame(rows, "node int, at double, event_id long, duration_ms double, status_code int")
    got = {r["event_id"]: r for r in T.node_health(df, penalty=500.0).collect()}
    step = T.health_step(penalty=500.0)
    for node in (0, 1):
        state = T.HEALTH_START
        for r in (r for r in df.orderBy("at").collect() if r["node"] == node):
            state, out = step(state, r)
            assert got[r["event_id"]]["ewma"] == pytest.approx(out[1]) and (got[r["event_id"]]["in_row"], got[r["event_id"]]["open_until"]) == out[2:]


def test_no_task_has_a_nodes_history(spark):
    df = spark.range(1000).select(F.lit(1).alias("node"), F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.col("id").alias("event_id"), F.lit(1.0).alias("duration_ms"))
    plan = W.ewma_latency(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(node" in plan and "slice_" in plan.split("hashpartitioning(node", 1)[1][:40] or "slice_" in plan


def test_tables_end_with_their_scope(spark):
    import os

    place = staging.shared_dir(spark)
    with staging.scope(spark):
        staging.written(spark.range(3), "scoped")
        assert [n for n in os.listdir(place) if n.startswith("scoped-")]
    assert not [n for n in os.listdir(place) if n.startswith("scoped-")]
