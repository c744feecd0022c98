"""The whole reduction: alarms in; ranked incidents, cards and the ledger out."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stormsift.operators import baseline, cards, cluster, enrich, graph, merge, noise, patterns, reports, rootcause
from stormsift.params import DEFAULT, Params
from stormsift.sources.io import kept


@dataclass(frozen=True)
class Storm:
    alarms: DataFrame
    classified: DataFrame
    clusters: DataFrame
    incidents: DataFrame
    members: DataFrame
    roots: DataFrame
    ranked: DataFrame
    ledger: DataFrame
    reasons: DataFrame


def reduce_storm(raw: DataFrame, hosts: DataFrame, edges: DataFrame, p: Params = DEFAULT) -> Storm:
    """Tables that several later steps read are written once and read again; those that need not wait for each other are written side by side.

    Residual alarms go to the ledger, so they take no slot of a card.
    """
    nodes = graph.graph_nodes(edges, hosts)
    with ThreadPoolExecutor(3) as side:
        related = side.submit(kept, graph.related_pairs(edges, nodes, p.max_hops))
        central = side.submit(kept, graph.centrality(edges, nodes))
        alarms = kept(enrich.enrich_alarms(raw, hosts))
        classified = kept(noise.classify_noise(alarms, baseline.spike_windows(alarms, p), p=p))
        signal = enrich.cluster_gate(classified.where("rule IS NULL"), p.cluster_severity).select(alarms.columns)
        in_cluster = kept(cluster.find_clusters(signal, p))
        clusters = kept(cluster.cluster_summary(in_cluster, alarms))
        numbered = merge.number_incidents(merge.merge_incidents(clusters, merge.candidate_links(clusters, related.result(), p), p))
        members = kept(in_cluster.join(numbered, "cluster_id").select("alarm_id", "incident_id"))
        summary = side.submit(kept, merge.incident_summary(members, alarms))
        roots = kept(rootcause.root_and_counter(rootcause.score_alarms(members, alarms, central.result(), p)))
        gated = cards.with_gate(summary.result(), roots, p)
    ranked = cards.cap_cards(cards.prioritise(gated, members, alarms), p=p)
    carded = members.join(gated.where("passes").select("incident_id"), "incident_id", "left_semi")
    entries = noise.ledger(classified, in_cluster.select("alarm_id"), carded.select("alarm_id"), p)
    reasons = numbered.where(F.size("reasons") > 0).select("incident_id", "reasons")
    return Storm(alarms, classified, clusters, gated, members, roots, ranked, entries, reasons)


def held_by_cards(s: Storm) -> DataFrame:
    """(card_id, incident_id, alarm_id): which card, or the bucket, holds each alarm."""
    return cards.membership(s.ranked, s.members)


def documents(s: Storm, edges: DataFrame, history: DataFrame | None = None, run_id: str = "run", p: Params = DEFAULT, advice: DataFrame | None = None) -> DataFrame:
    """The card documents of a run, the bucket's among them; history are the signatures of past runs, advice the first steps by
    family of failures (`rootcause.actions_for`), if there are any."""
    slots = s.ranked.where("slot = 'card'")
    texts = rootcause.explanations(s.roots, s.incidents, graph.upstream_set(edges), s.alarms)
    evidence = kept(rootcause.evidence(s.members, s.alarms, s.roots, graph.impact_set(edges)))
    nodes = s.alarms.select("service").union(edges.select("source")).union(edges.select("target")).distinct()
    lines = rootcause.evidence_lines(evidence, s.roots, s.alarms, graph.describe_service(edges, nodes), p)
    evidence = evidence.join(lines, "incident_id", "left")
    known = patterns.match_patterns(s.members, s.alarms, s.roots, patterns.known_patterns(edges.sparkSession), p)
    sigs = card_signatures(s, run_id)
    similar = patterns.similar_incidents(sigs, sigs.limit(0) if history is None else history, p=p)
    return cards.build_cards(s.ranked, held_by_cards(s), s.alarms, s.roots, texts, rootcause.actions_for(s.roots, s.incidents, advice), s.reasons, evidence, known, similar)


def card_signatures(s: Storm, run_id: str) -> DataFrame:
    """What the archive keeps of a run: the signature of each card."""
    slots = s.ranked.where("slot = 'card'")
    sigs = patterns.signatures(slots.drop("root_service", "root_type"), s.members, s.alarms, s.roots, run_id)
    return kept(sigs.join(slots.select("incident_id", "card_id"), "incident_id").withColumn("incident_id", F.col("card_id")).drop("card_id"))


def outputs(s: Storm, hosts: DataFrame, edges: DataFrame, history: DataFrame | None = None, run_id: str = "run", p: Params = DEFAULT) -> dict[str, DataFrame]:
    """All tables of a run, for `io.write_outputs`: documents, which alarms they hold, ledger, timeline, summary and topology."""
    held = kept(held_by_cards(s))
    nodes = graph.graph_nodes(edges, hosts)
    return {
        "cards": documents(s, edges, history, run_id, p),
        "membership": held,
        "ledger": s.ledger,
        "timeline": reports.timeline(s.alarms, held.select("alarm_id", F.col("card_id").alias("owner"))),
        "summary": reports.summary(s.alarms, s.classified, s.clusters, s.incidents, s.ranked, held, s.ledger),
        "ledger_cube": noise.ledger_cube(s.ledger),
        "services": graph.describe_service(edges, nodes).join(graph.centrality(edges, nodes), "service"),
        "edges": graph.edge_metadata(edges),
    }
