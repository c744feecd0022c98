"""Readers, stores and sinks on small files; the anchors of the whole chain; results that do not hang on the partitioning."""

import random

import pytest
from pyspark.sql import functions as F

from stormsift.functions.asof import asof_join
from stormsift.operators import actions, baseline, graph, merge
from stormsift.params import MINUTE
from stormsift.plans.storm import reduce_storm
from stormsift.sources import archive, fixtures, io
from stormsift.streaming.minute_counts import stream_minute_counts
from stormsift.streaming.spikes import stream_spikes

HEAD = "alarm_id,timestamp,source_system,host,service,severity,alarm_type,message,veri_merkezi,kabin,ortam"


def test_csv_alarms_are_trimmed_and_typed_behind_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"﻿{HEAD}\n A1 ,2026-01-01T00:00:01, Zabbix ,h1,s1, 4 ,timeout,\"late, again\",dc1,rack-A,prod\n", encoding="utf-8")
    (r,) = io.read_alarms_csv(spark, str(tmp_path / "a.csv")).collect()
    assert (r["alarm_id"], r["us"], r["source_system"], r["severity"], r["message"], r["datacenter"], r["rack"], r["environment"]) == ("A1", 1_767_225_601_000_000, "Zabbix", 4, "late, again", "dc1", "rack-A", "prod")


@pytest.mark.parametrize("row", ["A1,yesterday,z,h,s,4,t,m,d,r,e", "A1,2026-01-01T00:00:01,z,h,s,high,t,m,d,r,e"])
def test_bad_cell_raises(spark, tmp_path, row):
    (tmp_path / "a.csv").write_text(f"{HEAD}\n{row}\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.read_alarms_csv(spark, str(tmp_path / "a.csv")).collect()


def test_json_alarms_have_nested_tags(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"alarm_id": "A1", "timestamp": "2026-01-01T00:00:01", "host": "h", "service": "s", "severity": "5", "tags": {"veri_merkezi": "dc2", "kabin": "rack-B"}}, {"alarm_id": "A2", "timestamp": "2026-01-01T00:00:02", "host": "h", "service": "s", "severity": "1"}]')
    rows = io.read_alarms_json(spark, str(tmp_path / "a.json")).orderBy("alarm_id").collect()
    assert [(r["alarm_id"], r["severity"], r["datacenter"], r["rack"], r["environment"]) for r in rows] == [("A1", 5, "dc2", "rack-B", None), ("A2", 1, None, None, None)]


def test_last_row_of_a_host_wins(spark, tmp_path):
    (tmp_path / "h.csv").write_text("host,servis,veri_merkezi,kabin,ortam,is_kritikligi\nh1,s1,dc1,rack-A,prod,orta\nh2,s2,dc1,rack-A,prod,orta\nh1, s9 ,dc2,rack-C,prod,kritik\n")
    assert {r["host"]: (r["service"], r["rack"], r["criticality"]) for r in io.read_hosts(spark, str(tmp_path / "h.csv")).collect()} == {"h1": ("s9", "rack-C", "kritik"), "h2": ("s2", "rack-A", "orta")}


def test_dependencies(spark, tmp_path):
    (tmp_path / "d.csv").write_text("kaynak_servis,hedef_servis,bagimlilik_tipi,kritiklik\n a , b ,senkron,orta\n")
    assert [tuple(r) for r in io.read_dependencies(spark, str(tmp_path / "d.csv")).collect()] == [("a", "b", "senkron", "orta")]


def _signature(spark, run, n):
    return spark.createDataFrame([("INC-001", run, 1, "timeout", "s", ["s"], ["dc1/rack-A"], {"timeout": 1.0}, 5, n, 1.0, 0)], io.HISTORY)


def test_archive_keeps_twenty_runs_and_replaces_one(spark, tmp_path):
    path = str(tmp_path / "history")
    assert archive.read_archive(spark, path).count() == 0 and archive.archived_runs(spark, path) == []
    for run, n in [*((f"r/{k}", 1) for k in range(21)), ("r/5", 7)]:  # a slash must not become a folder
        archive.append_run(_signature(spark, run, n), path, run)
    rows = {r["run_id"]: r["alarm_count"] for r in archive.read_archive(spark, path).collect()}
    assert len(rows) == 20 and "r/0" not in rows and rows["r/5"] == 7
    assert archive.archived_runs(spark, path) == [*(f"r/{k}" for k in range(1, 21) if k != 5), "r/5"]
    assert len(list((tmp_path / "history" / "runs").iterdir())) == 20 and len([f for f in (tmp_path / "history" / "manifest").iterdir() if f.suffix == ".json"]) == 1


def test_broken_append_reads_as_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    archive.append_run(_signature(spark, "one", 1), path, "one")
    with monkeypatch.context() as m:  # the job dies after the run's files, before its manifest
        m.setattr(archive, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            archive.append_run(_signature(spark, "two", 2), path, "two")
    assert archive.archived_runs(spark, path) == ["one"] and archive.read_archive(spark, path).count() == 1
    with monkeypatch.context() as m:  # dies before it cleans: the new manifest counts already
        m.setattr(archive, "_clean", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            archive.append_run(_signature(spark, "two", 3), path, "two")
    assert {r["run_id"]: r["alarm_count"] for r in archive.read_archive(spark, path).collect()} == {"one": 1, "two": 3}
    (tmp_path / "history" / "manifest" / "000000000009.json").write_text('{"runs": [')  # cut off
    assert archive.archived_runs(spark, path) == ["one", "two"]
    archive.append_run(_signature(spark, "three", 4), path, "three")
    assert archive.archived_runs(spark, path) == ["one", "two", "three"] and len(list((tmp_path / "history" / "runs").iterdir())) == 3


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    path = str(tmp_path / "history")
    archive.append_run(_signature(spark, "one", 1), path, "one")
    with pytest.raises(RuntimeError, match="taken"):
        archive._publish(spark, path, 1, [])
    with pytest.raises(ValueError, match="root_type"):
        archive.append_run(_signature(spark, "two", 1).drop("root_type"), path, "two")


def test_actions_keep_the_last_record_of_an_incident(spark, tmp_path):
    path = str(tmp_path / "actions")
    assert io.read_actions(spark, path).count() == 0
    io.write_actions(spark.createDataFrame([("a", "open", "x", "", 1, 1, 1), ("a", "resolved", "x", "", 1, 2, 2), (None, "open", "x", "", 1, 1, 3)], io.ACTIONS), path)
    assert [(r["incident_id"], r["status"]) for r in io.read_actions(spark, path).collect()] == [("a", "resolved")]
    io.write_actions(io.read_actions(spark, path), path)
    assert io.read_actions(spark, path).count() == 1


def test_outputs_lie_by_rule(spark, tmp_path):
    ledger = spark.createDataFrame([("a", "x"), ("b", "y")], "alarm_id string, rule string")
    io.write_outputs({"ledger": ledger, "cards": ledger.drop("rule")}, str(tmp_path))
    assert (tmp_path / "ledger" / "rule=x").is_dir() and spark.read.parquet(f"{tmp_path}/cards").count() == 2


def test_stream_counts_an_alarm_once(spark, tmp_path):
    a = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2026-01-01 00:00:10', 's'), ('a', TIMESTAMP '2026-01-01 00:00:10', 's'), ('b', TIMESTAMP '2026-01-01 00:00:50', 's'), ('c', TIMESTAMP '2026-01-01 00:01:00', 's') AS t(alarm_id, ts, service)")
    a.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_minute_counts(spark.readStream.schema(a.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("minutes").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((str(r["minute"]), r["cnt"]) for r in spark.table("minutes").collect()) == [("2026-01-01 00:00:00", 2), ("2026-01-01 00:01:00", 1)]


def _replay(spark, tmp_path, parts, base):
    """Each part is a query of its own that goes on from the checkpoint; gives all rows put out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, part in enumerate(parts):
        part.select("alarm_id", F.timestamp_micros("us").alias("ts"), "service").coalesce(1).write.parquet(f"{src}/f{k}")
        stream = spark.readStream.schema("alarm_id string, ts timestamp, service string").parquet(f"{src}/*")
        q = stream_spikes(stream, base).writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(200)
    return spark.read.parquet(out).collect()


def test_stream_of_spikes_equals_batch_over_restarts(spark, tmp_path):
    """Windows of a replay in three queries, one stopping amid a spike; late alarms come out by themselves."""
    rng = random.Random(3)
    t0, rows = 28_000_000, []
    for s in ("a", "b"):
        for m in range(200):
            n = int(rng.random() < 0.3) + (rng.randrange(2, 9) if 40 <= m < 45 else 0) + (rng.randrange(0, 4) if 120 <= m < 150 else 0)
            rows += [(f"{s}{m}-{k}", s, (t0 + m) * MINUTE + k * 1000) for k in range(n)]
    df = spark.createDataFrame(rows, "alarm_id string, service string, us long")
    base = baseline.service_baseline(baseline.minute_series(df))
    want = {tuple(r) for r in baseline.spike_windows(df).select("service", "kind", "start_us", "end_us", "peak_count", "baseline_per_min").collect()}
    cut = [0, 60, 130, 200]
    parts = [df.where(F.col("us").between((t0 + a) * MINUTE, (t0 + b) * MINUTE - 1)) for a, b in zip(cut, cut[1:], strict=False)]
    late = spark.createDataFrame([("late", "a", (t0 + 95) * MINUTE)], df.schema)  # 34 minutes behind: decided, but not yet dropped
    end = spark.createDataFrame([("end", "z", (t0 + 900) * MINUTE)], df.schema)
    got = _replay(spark, tmp_path, [parts[0], parts[1], late, parts[2].union(end)], base)
    assert {(r["service"], r["kind"], r["start_us"], r["end_us"], r["peak_count"], r["baseline_per_min"]) for r in got if r["kind"] != "late"} == want
    assert [(r["service"], r["alarm_id"], r["start_us"]) for r in got if r["kind"] == "late"] == [("a", "late", (t0 + 95) * MINUTE)] and len(want) > 5


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("width", [7, 10_000])
def test_asof_join_equals_a_plain_loop(spark, forward, width):
    rng = random.Random(width)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(k, key(), rng.choice([None, *range(200)])) for k in range(150)] + [(999, "only left", 5)]
    right = [(key(), rng.randrange(200), rng.choice(["x", "y", None]), k) for k in range(40)] + [("only right", 5, "x", 0)]
    r = spark.createDataFrame(right, "k string, t long, v string, n int")
    got = asof_join(spark.createDataFrame(left, "id int, k string, t long"), r, ["k"], "t", {"v": F.col("v"), "at": F.when(F.col("n") % 2 == 0, F.col("t"))}, width, forward)
    assert got.columns == ["id", "k", "t", "v", "at"] and got.count() == len(left)
    for x in got.collect():
        near = sorted((y for y in right if y[0] is not None and y[0] == x["k"] and x["t"] is not None and (y[1] >= x["t"] if forward else y[1] <= x["t"])), key=lambda y: y[1], reverse=not forward)
        named = [y for y in near if y[2] is not None]
        assert (x["v"] in {y[2] for y in named if y[1] == named[0][1]}) if named else x["v"] is None
        assert x["at"] == next((y[1] for y in near if y[3] % 2 == 0), None)


@pytest.mark.parametrize("piece", [3, 256])
@pytest.mark.parametrize("moves", [None, actions.MOVES, {"open": ("in_progress",), "in_progress": ("resolved",), "resolved": ()}])
def test_transitions_equal_a_plain_loop(spark, monkeypatch, piece, moves):
    """With narrow moves, a change counts or not by what was rejected before it, which no look at the row before can tell."""
    monkeypatch.setattr(actions, "PIECE", piece)
    rng = random.Random(piece)
    records = [(f"i{k}", "closed" if k == 4 else "open", "me", "look", 0, 0) for k in range(5)]
    changes = [(f"i{rng.randrange(6)}", rng.choice([*actions.STATUSES, *actions.STATUSES, "odd", None]), rng.choice(["", "you", None]), "", rng.randrange(60), k) for k in range(200)]
    changes += [("i3", s, "", "", 100, 1000 + k) for k, s in enumerate(["in_progress", "resolved", "open"] * 8)]
    current, moved, rejects = actions.apply_transitions(spark.createDataFrame(records, "incident_id string, status string, owner string, action string, created_us long, updated_us long"), spark.createDataFrame(changes, "incident_id string, status string, owner string, note string, us long, seq long"), moves)
    state, want, bad = {r[0]: r[1] for r in records}, [], 0
    for i, s, _, _, us, seq in sorted(changes, key=lambda c: (c[4], c[5])):
        if i not in state or s not in actions.STATUSES or (moves and state[i] in actions.STATUSES and s not in moves[state[i]]):
            bad += 1
            continue
        want.append((i, state[i], s, us, seq))
        state[i] = s
    assert sorted((r["incident_id"], r["previous_status"], r["status"], r["us"], r["seq"]) for r in moved.collect()) == sorted(want)
    assert {r["incident_id"]: r["status"] for r in current.collect()} == state and rejects.count() == bad
    nested = actions.with_history(current, moved, most=5).collect()
    for r in nested:
        own = [w for w in sorted(want, key=lambda w: (w[3], w[4])) if w[0] == r["incident_id"]]
        assert r["n_history"] == len(own) + 1 and [e["seq"] for e in r["history"]] == [-1, *(w[4] for w in own)][-5:]


def test_graph_anchors(spark):
    e, h = fixtures.dependencies(spark), fixtures.hosts(spark)
    nodes = graph.graph_nodes(e, h)
    top = graph.centrality(e, nodes).orderBy(F.col("raw").desc()).first()
    assert (nodes.count(), top["service"], top["raw"], top["centrality"]) == (27, "svc-01", 8.5, 1.0)
    assert (graph.impact_set(e).count(), graph.related_pairs(e, nodes).where("a <> b").count()) == (99, 168)


@pytest.mark.parametrize(
    ("sf", "rules", "clusters", "links", "incidents", "passing"),
    [
        ("0.001", {"maintenance_chatter": 411, "isolated_low_severity": 306, "background_baseline": 68, "background_in_window": 19, "unclustered_residual": 152}, {"burst": 2, "slow_burn": 2}, 2, 2, (2, 44)),
        ("0.01", {"maintenance_chatter": 3971, "isolated_low_severity": 3221, "background_baseline": 439, "background_in_window": 391, "unclustered_residual": 420, "low_confidence_cluster": 15}, {"burst": 29, "slow_burn": 31}, 67, 24, (22, 1543)),
    ],
)
def test_chain_anchors(spark, sf, rules, clusters, links, incidents, passing):
    e, h = fixtures.dependencies(spark), fixtures.hosts(spark)
    raw = fixtures.alarms(spark, f"/root/testdata/sf{sf}")
    s = reduce_storm(raw, h, e)
    assert {r["rule"]: r["count"] for r in s.ledger.groupBy("rule").count().collect()} == rules
    assert {r["window_kind"]: r["count"] for r in s.clusters.groupBy("window_kind").count().collect()} == clusters
    assert merge.candidate_links(s.clusters, graph.related_pairs(e, graph.graph_nodes(e, h))).count() == links
    assert s.incidents.count() == incidents
    assert tuple(s.incidents.where("passes").agg(F.count("*"), F.sum("alarm_count")).first()) == passing
    if sf == "0.001":  # the same rows in another order and partitioning give the same ranks and members
        again = reduce_storm(raw.repartition(7).sortWithinPartitions(F.hash("alarm_id")), h, e)
        for name in ("ranked", "members"):
            one, two = (getattr(x, name) for x in (s, again))
            assert sorted(map(str, one.select(sorted(one.columns)).collect())) == sorted(map(str, two.select(sorted(one.columns)).collect()))
