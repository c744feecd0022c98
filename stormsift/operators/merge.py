"""Clusters merged to incidents along the dependency graph and shared places."""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.functions.columns import with_alarms
from stormsift.functions.ordering import in_order
from stormsift.params import DEFAULT, MINUTE, Params
from stormsift.sources.io import kept

#: Undecided links that one task takes; more are decided in rounds over all tasks.
TASK_LINKS = 200_000


def _meet(left: DataFrame, right: DataFrame, key: str, minutes: int) -> DataFrame:
    """Pairs of l_ and r_ columns with one key whose onsets lie within so many minutes, l before r by (start, service, cluster_id).

    A row of the right side stands in the slot of its onset, one of the left in its own slot and the next.
    """
    size = minutes * MINUTE
    both = left.withColumn("slot", F.explode(F.array(*(F.floor(F.col("l_start_us") / size) + k for k in (0, 1))))).join(right.withColumn("slot", F.floor(F.col("r_start_us") / size)), ["slot", key])
    at = lambda s: F.struct(*(F.col(f"{s}_{c}").alias(c) for c in ("start_us", "service", "cluster_id")))
    return both.where(at("l") < at("r")).withColumn("gap_us", F.col("r_start_us") - F.col("l_start_us")).where(F.col("gap_us") <= size).drop("slot", key)


def candidate_links(clusters: DataFrame, related: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(a, b, gap_us, link_kind, reason): a before b by (start, service, cluster_id).

    An inverted index in two parts. Dependency: each cluster looks up the services that its own is related to, so clusters
    meet by (slot, service), of which the detector leaves a few. Locality: they meet by (slot, place), and a pair that
    shares several places counts at the first of them; pairs of related services are left to the other part, whose
    reason goes first. So only clusters that a service or a place connects ever meet.
    """
    c = clusters.select("cluster_id", "service", "start_us", "locations")
    side = lambda s: c.select(*(F.col(x).alias(f"{s}_{x}") for x in c.columns))
    rel = related.select(F.col("a").alias("l_service"), F.col("b").alias("service"), F.col("reason").alias("how"))
    depends = _meet(side("l").drop("l_locations").join(rel, "l_service"), side("r").drop("r_locations").withColumn("service", F.col("r_service")), "service", p.onset_gap)
    depends = depends.withColumn("link_kind", F.lit("dependency")).withColumn("tail", F.concat(F.lit("; "), "how", F.lit(" (dependency)"))).drop("how")
    shared = F.array_sort(F.array_intersect("l_locations", "r_locations"))
    local = _meet(side("l").withColumn("place", F.explode("l_locations")), side("r").withColumn("place", F.explode("r_locations")).withColumn("r_place", F.col("place")), "place", p.locality_gap)
    local = local.withColumn("shared", shared).where(F.col("r_place") == F.col("shared")[0])
    local = local.join(rel.select("l_service", F.col("service").alias("r_service")), ["l_service", "r_service"], "left_anti")
    local = local.withColumn("link_kind", F.lit("locality")).withColumn("tail", F.concat(F.lit(" and share "), F.concat_ws(", ", "shared"), F.lit(" (locality)")))
    columns = ["l_cluster_id", "r_cluster_id", "l_service", "r_service", "gap_us", "link_kind", "tail"]
    pairs = depends.select(columns).union(local.select(columns))
    minutes = F.col("gap_us") / float(MINUTE)
    when = F.when(minutes < 1, "at the same time").otherwise(F.concat(F.round(minutes).cast("int").cast("string"), F.lit(" min apart")))
    reason = F.concat("l_service", F.lit(" and "), "r_service", F.lit(" began to fail "), when, "tail")
    return pairs.select(F.col("l_cluster_id").alias("a"), F.col("r_cluster_id").alias("b"), "gap_us", "link_kind", reason.alias("reason"))


@dataclass
class Groups:
    """Groups of clusters by their smallest member, with their times, as links join them in turn."""

    limit: int
    span: dict[int, tuple[int, int]]
    root: dict[int, int] = field(default_factory=dict)

    def find(self, k: int) -> int:
        while self.root.get(k, k) != k:
            self.root[k] = self.root.get(self.root[k], self.root[k])
            k = self.root[k]
        return k

    def join(self, i: int, j: int) -> int | None:
        """The smaller root, if the groups were two and their joined span is not too long."""
        a, b = sorted((self.find(i), self.find(j)))
        lo, hi = min(self.span[a][0], self.span[b][0]), max(self.span[a][1], self.span[b][1])
        if a == b or hi - lo > self.limit:
            return None
        self.root[b], self.span[a] = a, (lo, hi)
        return a


def span_guarded_unions(rows: list[tuple[str, int, int]], links: list[tuple[int, int, int, str]], max_span_us: int) -> tuple[list[int], list[tuple[int, int, str]]]:
    """Joins clusters (id, start, end; in order) by links (gap, i, j, reason) from near to far unless the joined span is too long.

    Gives each cluster's root (smallest index) and the accepted links as (root when joined, sequence, reason).
    """
    g = Groups(max_span_us, {k: (r[1], r[2]) for k, r in enumerate(rows)})
    accepted: list[tuple[int, int, str]] = []
    for _, i, j, reason in sorted(links, key=lambda x: x[:3]):
        at = g.join(i, j)
        if at is not None:
            accepted.append((at, len(accepted), reason))
    return [g.find(k) for k in range(len(rows))], accepted


#: What a step decides. Of a group: g, its root now, the root's times. Of an accepted link: gap, i, j, root when joined.
_DECIDED = "g long, root long, lo long, hi long, gap_us long, i long, j long, at_root long"


def _decided(g: Groups, accepted: list[tuple]) -> pd.DataFrame:
    groups = [(k, g.find(k), *g.span[g.find(k)], None, None, None, None) for k in g.span]
    rows = groups + [(None, None, None, None, *a) for a in accepted]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _DECIDED.split(", ")]).astype("Int64")


def _finish(limit: int):
    """All links at once, in order."""

    def run(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["gap_us", "i", "j"])
        g = Groups(limit, {k: (lo, hi) for s in "ab" for k, lo, hi in zip(links[s], links[f"{s}_lo"], links[f"{s}_hi"], strict=True)})
        tried = [(gap, i, j, g.join(a, b)) for gap, i, j, a, b in links[["gap_us", "i", "j", "a", "b"]].itertuples(index=False)]
        return _decided(g, [t for t in tried if t[3] is not None])

    return run


def _star(limit: int):
    """The links of one centre, in order, up to the first that something undecided could still touch before it."""

    def run(links: pd.DataFrame) -> pd.DataFrame:
        links = links.sort_values(["gap_us", "i", "j"])
        c, lo, hi = (int(links[x].iloc[0]) for x in ("c", "c_lo", "c_hi"))
        g, accepted, bar = Groups(limit, {c: (lo, hi)}), [], None
        for x in links.itertuples(index=False):
            o = (x.gap_us, x.i, x.j)
            if not x.satellite or (bar is not None and o > bar):
                break
            g.span[x.x] = (x.x_lo, x.x_hi)
            at = g.join(c, x.x)
            if at is None:
                del g.span[x.x]
                continue
            accepted.append((*o, at))
            if not pd.isna(x.next_gap):
                after = (x.next_gap, x.next_i, x.next_j)
                bar = after if bar is None else min(bar, after)
        return _decided(g, accepted)

    return run


def _open(links: DataFrame, groups: DataFrame, limit: int) -> DataFrame:
    """Undecided links (gap_us, i, j, a, b and the times of both groups), one for each pair of groups.

    Of several links between two groups the first decides: it joins them, or their span is too long, and groups only grow.
    For the same reason a pair whose span is too long by now can never be joined, whenever its turn comes.
    """
    first = links.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("gap_us", "i", "j")).alias("o")).select("a", "b", "o.*")
    for s in "ab":
        first = first.join(groups.select(F.col("g").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi")), s)
    return first.where(F.greatest("a_hi", "b_hi") - F.least("a_lo", "b_lo") <= limit)


def _round(links: DataFrame, limit: int) -> DataFrame:
    """Decides links that no earlier undecided link can influence: exactly what one pass in order would decide of them.

    A group's satellites are groups whose first link leads to it. Where two groups have their first link in common, the
    smaller is a centre: its links to satellites are decided in order, as long as none of the groups that joined has
    another link before the next one. The first link of all is always among them, so every round gets on.
    """
    end = lambda c, x: F.struct(F.col(c).alias("c"), F.col(f"{c}_lo").alias("c_lo"), F.col(f"{c}_hi").alias("c_hi"), F.col(x).alias("x"), F.col(f"{x}_lo").alias("x_lo"), F.col(f"{x}_hi").alias("x_hi"))
    ends = links.select("gap_us", "i", "j", F.inline(F.array(end("a", "b"), end("b", "a"))))
    two = ends.withColumn("k", F.row_number().over(W.partitionBy("c").orderBy("gap_us", "i", "j"))).where("k <= 2")
    o = F.struct("gap_us", "i", "j")
    firsts = kept(two.groupBy("c").agg(F.max(F.when(F.col("k") == 1, F.col("x"))).alias("to"), F.max(F.when(F.col("k") == 2, o)).alias("next")))
    centres = firsts.alias("p").join(firsts.alias("q"), (F.col("p.to") == F.col("q.c")) & (F.col("q.to") == F.col("p.c")) & (F.col("p.c") < F.col("q.c"))).select(F.col("p.c").alias("c"))
    of = firsts.select(F.col("c").alias("x"), "to", *(F.col(f"next.{c}").alias(f"next_{c.removesuffix('_us')}") for c in ("gap_us", "i", "j")))
    star = ends.join(centres, "c").join(of, "x").withColumn("satellite", F.col("to") == F.col("c")).drop("to")
    return star.groupBy("c").applyInPandas(_star(limit), _DECIDED)


def _in_one_task(clusters: DataFrame, links: DataFrame, limit: int) -> DataFrame:
    """merge_incidents of a few clusters and links: rows of both go to one task."""
    one = F.lit(0).alias("all")
    c = clusters.select(one, "cluster_id", "service", "start_us", "end_us")
    rows = c.unionByName(links.select(one, F.col("a").alias("cluster_id"), "b", "gap_us", "reason"), allowMissingColumns=True)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = rows[rows["b"].isna()].sort_values(["start_us", "service", "cluster_id"])
        at = {c: k for k, c in enumerate(part["cluster_id"])}
        met = rows[rows["b"].notna()]
        spans = [(c, int(a), int(b)) for c, a, b in zip(part["cluster_id"], part["start_us"], part["end_us"], strict=True)]
        roots, accepted = span_guarded_unions(spans, [(int(g), at[a], at[b], r) for a, b, g, r in zip(met["cluster_id"], met["b"], met["gap_us"], met["reason"], strict=True)], limit)
        texts: dict[int, dict[int, list[str]]] = {}
        for root, _, reason in accepted:
            texts.setdefault(roots[root], {}).setdefault(root, []).append(reason)
        own = [list(dict.fromkeys(x for xs in texts.get(k, {}).values() for x in xs)) if r == k else [] for k, r in enumerate(roots)]
        return pd.DataFrame({"cluster_id": [c for c, _, _ in spans], "root_cluster": [spans[r][0] for r in roots], "root_start_us": [spans[r][1] for r in roots], "reasons": own})

    return rows.groupBy("all").applyInPandas(run, "cluster_id string, root_cluster string, root_start_us long, reasons array<string>")


def merge_incidents(clusters: DataFrame, links: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(cluster_id, root_cluster, root_start_us, reasons): the incident's first cluster, its start and, on its row, the reasons of its unions.

    Links are taken from near to far and join two groups unless their span gets too long, so the result depends on the
    order. Up to TASK_LINKS links are decided by one task; more by rounds over all tasks (_round), each of which
    decides what no earlier link can influence, so the result is the same. No task holds more than TASK_LINKS links or the
    links of one group.
    """
    limit = p.max_span * MINUTE
    links = kept(links.select("a", "b", "gap_us", "reason"))
    if links.count() <= TASK_LINKS and clusters.count() <= TASK_LINKS:
        return _in_one_task(clusters, links, limit)
    nodes = kept(in_order(clusters.select("cluster_id", "service", "start_us", "end_us"), ["start_us", "service", "cluster_id"], "g"))
    at = lambda s, n: nodes.select(F.col("cluster_id").alias(s), F.col("g").alias(n))
    every = kept(links.join(at("a", "i"), "a").join(at("b", "j"), "b").drop("a", "b"))
    groups = nodes.select("g", F.col("start_us").alias("lo"), F.col("end_us").alias("hi"))
    members = nodes.select(F.col("g").alias("member"), "g")
    undecided = kept(_open(every.select("gap_us", "i", "j", F.col("i").alias("a"), F.col("j").alias("b")), groups, limit))
    accepted = None
    while True:
        last = undecided.count() <= TASK_LINKS
        decided = kept(undecided.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finish(limit), _DECIDED) if last else _round(undecided, limit))
        moved = decided.where("g IS NOT NULL").select("g", "root")
        members = members.join(moved, "g", "left").select("member", F.coalesce("root", "g").alias("g"))
        new = decided.where("g IS NULL").select("gap_us", "i", "j", "at_root")
        accepted = new if accepted is None else accepted.union(new)
        if last:
            break
        members = kept(members)
        now = decided.where("g = root").select("g", "lo", "hi")
        groups = kept(groups.join(moved.select("g"), "g", "left_anti").union(now))
        for s in "ab":
            undecided = undecided.join(moved.select(F.col("g").alias(s), F.col("root").alias(f"{s}_new")), s, "left").withColumn(s, F.coalesce(f"{s}_new", s))
        undecided = kept(_open(undecided.select("gap_us", "i", "j", "a", "b"), groups, limit))
    texts = _reasons(accepted.join(every.select("i", "j", "reason"), ["i", "j"]), members)
    roots = nodes.select("g", F.col("cluster_id").alias("root_cluster"), F.col("start_us").alias("root_start_us"))
    out = nodes.select("cluster_id", F.col("g").alias("member")).join(members, "member").join(roots, "g").join(texts, "g", "left")
    own = F.when(F.col("member") == F.col("g"), F.col("reasons"))
    return out.select("cluster_id", "root_cluster", "root_start_us", F.coalesce(own, F.array().cast("array<string>")).alias("reasons"))


def _reasons(accepted: DataFrame, members: DataFrame) -> DataFrame:
    """(g, reasons): texts of accepted links, by the root that they were joined under (in order of its first link), then in order; repeated texts once."""
    o = F.struct("gap_us", "i", "j")
    a = accepted.join(members.select(F.col("member").alias("at_root"), "g"), "at_root").groupBy("g", "at_root", "reason").agg(F.min(o).alias("o"))
    a = a.withColumn("first", F.min("o").over(W.partitionBy("g", "at_root")))  # distinct texts of one root
    return a.groupBy("g").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("first", "o", "reason"))), lambda x: x["reason"])).alias("reasons"))


def number_incidents(merged: DataFrame) -> DataFrame:
    """(cluster_id, incident_id, reasons): INC-nnn by the start of the incident, which is its root's."""
    merged = kept(merged)
    roots = in_order(merged.where("cluster_id = root_cluster").select("root_start_us", "root_cluster"), ["root_start_us", "root_cluster"], "number", cheap=True)
    return merged.join(roots, "root_cluster").select("cluster_id", F.format_string("INC-%03d", F.col("number") + 1).alias("incident_id"), "reasons")


def incident_summary(members: DataFrame, alarms: DataFrame) -> DataFrame:
    """Per incident of (alarm_id, incident_id): counts, sorted sets, times, duration and severity."""
    a = with_alarms(members, alarms, "us", "service", "host", "severity", "datacenter", "rack").withColumn("location", F.concat_ws("/", "datacenter", "rack"))
    sets = {c: F.sort_array(F.collect_set(x)).alias(c) for c, x in (("services", "service"), ("hosts", "host"), ("locations", "location"))}
    s = a.groupBy("incident_id").agg(F.count("*").alias("alarm_count"), *sets.values(), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.max("severity").alias("max_severity"))
    return s.withColumn("duration_min", F.floor((F.col("end_us") - F.col("start_us")) / float(MINUTE) * 10 + 0.5) / 10)


def sweep_merge(clusters: DataFrame, related: DataFrame, grid: list[tuple[int, int]], p: Params = DEFAULT) -> DataFrame:
    """(span, onset, incidents) for each pair of limits."""
    from dataclasses import replace
    from functools import reduce

    out = []
    for span, onset in grid:
        q = replace(p, max_span=span, onset_gap=onset)
        merged = merge_incidents(clusters, candidate_links(clusters, related, q), q)
        out.append(merged.agg(F.countDistinct("root_cluster").alias("incidents")).select(F.lit(span).alias("span"), F.lit(onset).alias("onset"), "incidents"))
    return reduce(DataFrame.union, out)
