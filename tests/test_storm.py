"""Order-dependent steps against plain Python, traps at limits, and queries against DuckDB."""

import random
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from stormsift.functions import ordering
from stormsift.operators import baseline, cards, cluster, merge, noise, patterns, reports, rootcause
from stormsift.operators.graph import impact_set
from stormsift.params import DEFAULT, MINUTE
from stormsift.plans import queries
from stormsift.plans.storm import documents, held_by_cards, outputs, reduce_storm
from stormsift.sources import fixtures, io

SF = "/root/testdata/sf0.001"
ORACLE = ["input_checks", "enrich_alarms", "spike_windows", "rule_counts", "centrality", "root_and_counter", "suggested_owner", "explanations", "formula_links", "formula_ledger", "formula_integrity", "summary", "card_facts", "ledger_cube", "edge_metadata", "timeline", "apply_transitions", "retained_runs", "signatures", "similar_incidents"]


@pytest.mark.parametrize("name", ORACLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'").fetchall()
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def _alarms(spark, rows):
    return spark.createDataFrame([(f"A{k:03d}", s, u, 5) for k, (s, u) in enumerate(rows)], "alarm_id string, service string, us long, severity int")


def test_hot_bin_may_be_empty(spark):
    rows = [("s", 10 * MINUTE + k) for k in range(4)] + [("s", 12 * MINUTE + k) for k in range(4)] + [("s", 0), ("s", 100 * MINUTE)]
    hot = [r["bin"] for r in baseline.hot_bins(*(lambda x: (x, baseline.service_baseline(x)))(baseline.minute_series(_alarms(spark, rows))), baseline.DEFAULT.burst).collect()]
    assert hot == [11]


def test_claim_equals_plain_loop(spark):
    rng = random.Random(3)
    rows = [(f"s{rng.randrange(2)}", rng.randrange(60) * MINUTE) for _ in range(80)]
    windows = [(f"s{k % 2}", "slow", k, a * MINUTE, (a + rng.randrange(3, 15)) * MINUTE) for k, a in enumerate(sorted(rng.sample(range(50), 10)))]
    w = spark.createDataFrame(windows, "service string, kind string, window_no long, start_us long, end_us long")
    got = {(r["alarm_id"], r["window_no"]) for r in cluster.claim(_alarms(spark, rows), w, 4).collect()}
    want, taken = set(), set()
    for s, _, k, a, b in sorted(windows, key=lambda x: (x[0], x[3], x[2])):
        free = [f"A{i:03d}" for i, (t, u) in enumerate(rows) if t == s and a <= u <= b and i not in taken]
        if len(free) >= 4:
            want |= {(f, k) for f in free}
            taken |= {int(f[1:]) for f in free}
    assert got == want


def test_span_of_exactly_the_limit_is_joined():
    rows = [("a", 0, 10), ("b", 5, 30), ("c", 6, 31)]
    roots, accepted = merge.span_guarded_unions(rows, [(5, 0, 1, "x"), (1, 1, 2, "y")], 30)
    assert roots == [0, 1, 1] and [a[2] for a in accepted] == ["y"]
    assert merge.span_guarded_unions(rows[:2], [(5, 0, 1, "x")], 30)[0] == [0, 0]


def _graphs(n, seed):
    """Random clusters (many ties and overlaps) and links, each graph in a time of its own: path, star, clique, random."""
    rng = random.Random(seed)
    out = []
    for g in range(n):
        size = rng.randrange(2, 16)
        rows = sorted((g * 100_000 + rng.randrange(0, rng.choice([1, 30, 900])), f"s{rng.randrange(4)}", f"G{g:03d}-{k:02d}") for k in range(size))
        clusters = [(c, s, t * 1_000_000, (t + rng.randrange(0, rng.choice([2, 700, 1790]))) * 1_000_000) for t, s, c in rows]
        kind, pairs = rng.randrange(4), [(a, b) for a in range(size) for b in range(a + 1, size)]
        keep = {0: [(a, b) for a, b in pairs if b == a + 1], 1: [(a, b) for a, b in pairs if a == size // 2 or b == size // 2], 2: pairs, 3: [x for x in pairs if rng.random() < 0.4]}[kind]
        gap = (lambda a, b: 7) if rng.random() < 0.3 else (lambda a, b: clusters[b][2] - clusters[a][2])  # all gaps alike, or those of time
        out.append((clusters, [(a, b, gap(a, b), rng.choice([f"{a}-{b}", "same text"])) for a, b in keep]))
    return out


def _merged(spark, graphs, p=DEFAULT):
    clusters = [c for cs, _ in graphs for c in cs]
    links = [(cs[a][0], cs[b][0], g, r) for cs, ls in graphs for a, b, g, r in ls]
    rng = random.Random(1)
    rng.shuffle(clusters), rng.shuffle(links)
    frame = spark.createDataFrame(clusters, "cluster_id string, service string, start_us long, end_us long")
    return merge.merge_incidents(frame, spark.createDataFrame(links, "a string, b string, gap_us long, reason string"), p)


def _merged_by_loop(graphs, limit=DEFAULT.max_span * MINUTE):
    want = {}
    for clusters, links in graphs:
        roots, accepted = merge.span_guarded_unions([(c, s, e) for c, _, s, e in clusters], [(g, a, b, r) for a, b, g, r in links], limit)
        texts = {}
        for at in dict.fromkeys(a for a, _, _ in accepted):
            texts.setdefault(roots[at], []).extend(r for a, _, r in accepted if a == at)
        for k, r in enumerate(roots):
            want[clusters[k][0]] = (clusters[r][0], clusters[r][2], list(dict.fromkeys(texts.get(k, []))) if r == k else [])
    return want


@pytest.mark.parametrize("task_links,order_rows", [(merge.TASK_LINKS, ordering.TASK_ROWS), (0, 100), (40, 100)])
def test_merge_equals_one_pass_in_order(spark, monkeypatch, task_links, order_rows):
    """300 graphs at once: in one task, in rounds alone, in rounds and then a task; roots, starts and reasons."""
    monkeypatch.setattr(merge, "TASK_LINKS", task_links)
    monkeypatch.setattr(ordering, "TASK_ROWS", order_rows)
    graphs = _graphs(300, 11)
    got = {r["cluster_id"]: (r["root_cluster"], r["root_start_us"], r["reasons"]) for r in _merged(spark, graphs).collect()}
    assert got == _merged_by_loop(graphs)
    assert 300 < len({r for r, _, _ in got.values()}) < len(got)


def test_merge_has_no_window_over_all_clusters(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 10)
    plan = _merged(spark, _graphs(20, 3))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan or "windowspecdefinition(g" in plan


def test_many_interlocked_clusters(spark, monkeypatch):
    """2,000 clusters without a pause, each linked with the next three: rounds end in few steps, and groups keep to the span."""
    monkeypatch.setattr(merge, "TASK_LINKS", 500)
    n = 2000
    clusters = [(f"C{k:05d}", "s", k * 20_000_000, (k * 20 + 200) * 1_000_000) for k in range(n)]
    links = [(a, b, (b - a) * 20_000_000 + (a * 7919 + b * 104_729) % 1000, "x") for a in range(n) for b in range(a + 1, min(n, a + 4))]
    graphs = [(clusters, links)]
    got = {r["cluster_id"]: (r["root_cluster"], r["root_start_us"], r["reasons"]) for r in _merged(spark, graphs).collect()}
    assert got == _merged_by_loop(graphs)


def test_no_incidents_from_no_clusters(spark):
    assert _merged(spark, []).collect() == []
    lone = _merged(spark, [([("A", "s", 0, 1)], [])])
    assert [(r["root_cluster"], r["reasons"]) for r in lone.collect()] == [("A", [])]
    assert [r["incident_id"] for r in merge.number_incidents(lone).collect()] == ["INC-001"]


def test_numbers_past_a_thousand_stay_apart(spark):
    many = spark.range(1500).select(F.format_string("C%05d", "id").alias("cluster_id"), F.format_string("C%05d", "id").alias("root_cluster"), F.col("id").alias("root_start_us"), F.array().cast("array<string>").alias("reasons"))
    assert merge.number_incidents(many).select("incident_id").distinct().count() == 1500


@pytest.mark.parametrize("rows", [ordering.TASK_ROWS, 7])
def test_places_in_order(spark, monkeypatch, rows):
    monkeypatch.setattr(ordering, "TASK_ROWS", rows)
    df = spark.createDataFrame([(k * 37 % 101, f"x{k % 5}") for k in range(100)], "a int, b string").repartition(3)
    got = [(r["b"], r["a"]) for r in sorted(ordering.in_order(df, [F.col("b").desc(), "a"], "at").collect(), key=lambda r: r["at"])]
    assert got == sorted(((b, a) for a, b in ((k * 37 % 101, f"x{k % 5}") for k in range(100))), key=lambda x: (-int(x[0][1]), x[1]))
    assert ordering.in_order(df.limit(0), ["a"], "at").collect() == []


def test_links_equal_all_pairs(spark):
    """Clusters of 40 services in few slots: related services first, then shared places, each pair once."""
    rng = random.Random(5)
    places = [f"dc{k % 2}/r{k}" for k in range(6)]
    rows = [(f"C{k:03d}", f"s{rng.randrange(40):02d}", rng.randrange(0, 1500) * 1_000_000, sorted(rng.sample(places, rng.randrange(0, 3)))) for k in range(150)]
    related = {(f"s{k:02d}", f"s{k:02d}"): "same" for k in range(38)} | {(f"s{a:02d}", f"s{b:02d}"): f"{a}~{b}" for a, b in (rng.sample(range(40), 2) for _ in range(200))}
    got = merge.candidate_links(spark.createDataFrame(rows, "cluster_id string, service string, start_us long, locations array<string>"), spark.createDataFrame([(*k, v) for k, v in related.items()], "a string, b string, reason string")).collect()
    want = {}
    for x in rows:
        for y in rows:
            gap, shared = y[2] - x[2], sorted(set(x[3]) & set(y[3]))
            if (x[2], x[1], x[0]) < (y[2], y[1], y[0]) and gap <= 6 * MINUTE:
                if (x[1], y[1]) in related:
                    want[x[0], y[0]] = ("dependency", gap, related[x[1], y[1]])
                elif gap <= 4 * MINUTE and shared:
                    want[x[0], y[0]] = ("locality", gap, ", ".join(shared))
    assert len(got) == len(want) and {k for k, _, _ in want.values()} == {"dependency", "locality"}
    for r in got:
        kind, gap, text = want[r["a"], r["b"]]
        assert (r["link_kind"], r["gap_us"]) == (kind, gap) and text in r["reason"]


def _random_signatures(n, seed, run):
    rng = random.Random(seed)
    types = ["network_down", "pkt_loss", "disk_full", "oom_risk", "own_type", "db_conn_pool", ""]
    for k in range(n):
        kinds = rng.sample(["timeout", "http_5xx", "latency_high", "cpu_high"], rng.randrange(0, 4))
        yield (f"I{k:04d}", run, rng.choice(types), rng.choice(["", "a", "b", "c"]), sorted(rng.sample("abcdefgh", rng.randrange(0, 6))), sorted(rng.sample(["x/1", "x/2", "y/1"], rng.randrange(0, 3))), {t: round(rng.random(), 4) for t in kinds}, rng.randrange(3, 6))


def test_similar_incidents_by_bounds_equal_all_pairs(spark, monkeypatch):
    schema = "incident_id string, run_id string, root_type string, root_service string, services array<string>, locations array<string>, type_histogram map<string,double>, max_severity int"
    sigs = spark.createDataFrame(list(_random_signatures(90, 1, "now")), schema)
    past = spark.createDataFrame([s for r in range(3) for s in _random_signatures(60, r % 2, f"old-{r}")], schema)  # runs 0 and 2 are alike: ties
    rows = lambda: {(r["incident_id"], r["rank"]): (r["match"], r["match_run"], r["similarity"], tuple(r["reasons"]), r["runs_compared"]) for r in patterns.similar_incidents(sigs, past).collect()}
    plain = rows()
    monkeypatch.setattr(patterns, "PAIRS", 0)
    monkeypatch.setattr(patterns, "BLOCK", 16)
    assert rows() == plain and len(plain) > 300


def test_outputs_are_written_and_read(spark, tmp_path):
    edges, hosts = fixtures.dependencies(spark), fixtures.hosts(spark)
    s = reduce_storm(fixtures.alarms(spark, SF.replace("0.001", "0.01")), hosts, edges)
    io.write_outputs(outputs(s, hosts, edges), str(tmp_path))
    back = io.read_outputs(spark, str(tmp_path), "cards", "membership", "ledger", "timeline", "summary", "services", "edges", "ledger_cube")
    total = back["summary"].first()
    n = back["membership"].count()
    assert n + back["ledger"].count() == total["raw"] == 10_000 and n == total["linked"] + total["unclassified"] and total["noise"] == back["ledger"].count()
    assert back["cards"].count() == total["cards"] == 15 and back["timeline"].agg(F.sum("n")).first()[0] == 10_000
    assert back["services"].count() == 27 and back["edges"].count() == 32 and back["ledger_cube"].where("level = 7").first()["n"] == total["noise"]
    assert [r["n"] for r in reports.funnel(back["summary"]).orderBy("step").collect()] == [total[c] for c in ("raw", "signal", "clusters", "incidents", "own_cards")]


def test_advice_is_a_table(spark):
    roots = spark.createDataFrame([("i", "svc", "pkt_loss"), ("j", "svc", "odd")], "incident_id string, root_service string, root_type string")
    incidents = spark.createDataFrame([("i", 3, ["svc"]), ("j", 3, ["svc"])], "incident_id string, alarm_count long, services array<string>")
    advice = spark.createDataFrame([("rack-network-partition", "call the network team")], "pattern_key string, text string")
    got = {r["incident_id"]: r["action"] for r in rootcause.actions_for(roots, incidents, advice).collect()}
    assert got == {"i": "svc: call the network team (1 services, 3 alarms)", "j": "svc: open the runbook of odd (1 services, 3 alarms)"}


def test_impact_leaves_itself_out_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a")], "source string, target string")
    assert {(r["src"], r["dst"], r["hop"]) for r in impact_set(e).collect()} == {("b", "a", 1), ("a", "b", 1), ("a", "c", 1), ("b", "c", 2)}


def test_neighbour_at_exactly_thirty_minutes(spark):
    a = spark.createDataFrame([("x", "h", 0, 1), ("y", "h", 30 * MINUTE, 1), ("z", "h", 61 * MINUTE, 1)], "alarm_id string, host string, us long, severity int")
    assert {r["alarm_id"]: r["neighbours"] for r in baseline.host_neighbours(a).collect()} == {"x": 1, "y": 1, "z": 0}
    assert [r["alarm_id"] for r in baseline.lonely(a, 2).collect()] == ["z"]


def test_nothing_is_lost(spark):
    r = queries.QUERIES["integrity"](spark, SF).first()
    assert r["no_loss"] and r["ids_unique"] and F is not None


def test_cards_hold_incidents_past_the_cap(spark):
    p = replace(DEFAULT, cap=2)
    edges = fixtures.dependencies(spark)
    s = reduce_storm(fixtures.alarms(spark, SF.replace("0.001", "0.01")), fixtures.hosts(spark), edges, p)
    docs = documents(s, edges, p=p).cache()
    passing = {r["incident_id"] for r in s.incidents.where("passes").collect()}
    assert len(passing) > 2
    rows = {r["card_id"]: r for r in docs.collect()}
    assert sorted(rows) == ["INC-001", "INC-UNCLUSTERED"]
    assert {rows["INC-001"]["incident_id"]} | {x["incident_id"] for x in rows["INC-UNCLUSTERED"]["rolled_up"]} == passing
    held = held_by_cards(s)
    assert sorted(r["alarm_id"] for r in held.collect()) == sorted(r["alarm_id"] for r in s.members.collect() if r["incident_id"] in passing)
    at = {r["alarm_id"]: (r["us"], r["alarm_id"]) for r in s.alarms.collect()}
    for c, r in rows.items():
        own = sorted((x["alarm_id"] for x in held.where(F.col("card_id") == c).collect()), key=at.get)
        assert r["alarm_count"] == len(own) and r["alarm_ids"] == own[: cards.HEAD]
    assert rows["INC-UNCLUSTERED"]["alarm_count"] > cards.HEAD and rows["INC-UNCLUSTERED"]["n_rolled_up"] == len(passing) - 1
    assert rows["INC-001"]["evidence"]["lines"][0].startswith("Time: ") and len(rows["INC-001"]["evidence"]["lines"]) >= 4
    assert rows["INC-001"]["evidence"]["offset_min"] is not None and {"known_patterns", "similar_incidents"} <= set(docs.columns)
    whole, lost = (reports.integrity(s.alarms, h, s.ledger).first() for h in (held, held.where("card_id = 'INC-001'")))
    assert whole["no_loss"] and whole["ids_unique"] and not lost["no_loss"]


def test_bucket_over_residual_alone(spark):
    a = spark.createDataFrame([("x", "s", "h", "d", "r", 4, 5, "timeout", "m"), ("y", "s", "h", "d", "r", 5, 6, "timeout", "m")], "alarm_id string, service string, host string, datacenter string, rack string, severity int, us long, alarm_type string, source_system string")
    none = spark.createDataFrame([], "incident_id string, rank int, alarm_count long, score double, root_alarm_id string, slot string, card_id string")
    r = cards.bucket_card(none, a.limit(0).select("alarm_id", F.lit("i").alias("incident_id")), a, a.where("alarm_id = 'y'")).collect()
    assert [(x["alarm_ids"], x["reasons"]) for x in r] == [(["y"], ["1 alarms in no cluster"])]


def test_audit_search_sees_every_service(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'").fetchall()
    got = queries.audit_search(spark, SF)
    want = con.execute(queries.ORACLE_SQL["audit_search"]).fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    services = got.join(fixtures.alarms(spark, SF), "alarm_id").agg(F.count_distinct("service")).first()[0]
    assert services > 4


def test_audit_search_by_service(spark):
    entries = spark.createDataFrame([("A1", "r", 1, "s1", "disk_warn 3", "disk_warn"), ("A2", "r", 1, "s2", "disk_warn 4", "disk_warn"), ("A3", "r", 1, None, "x", "x")], "alarm_id string, rule string, severity int, service string, message string, alarm_type string")
    found = lambda **by: sorted(r["alarm_id"] for r in noise.audit_search(entries, **by).collect())
    assert found(services=("s1",)) == ["A1"] and found(text="DISK") == ["A1", "A2"] and found() == ["A1", "A2", "A3"]


@pytest.mark.parametrize("name", ["upstream_set", "hop_distance"])
def test_graph_reads_the_events_once(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().toString()
    assert "events.parquet" not in plan  # counted and kept before


def test_formula_integrity_derives_the_alarms_once(spark):
    capped, gated, m, a = queries._ranked(spark, SF)
    row = queries.formula_integrity(spark, SF)
    assert not any("events.parquet" in x._jdf.queryExecution().toString() for x in (capped, gated, m, a, row))
    assert row.first()["no_loss"] and row.first()["ids_unique"]
