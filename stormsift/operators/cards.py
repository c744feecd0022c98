"""Priorities, the quality gate, the cap, and the card documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.functions.columns import criticality_weight, half_up, type_prior, with_alarms
from stormsift.functions.ordering import in_order
from stormsift.params import DEFAULT, MINUTE, Params
from stormsift.sources.io import kept

BUCKET = "INC-UNCLUSTERED"


def with_gate(incidents: DataFrame, roots: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds passes: enough alarms, and several services, a critical alarm, or a root type that is a likely cause."""
    i = incidents.join(roots.select("incident_id", "root_alarm_id", "root_service", "root_type"), "incident_id", "left")
    strong = (F.size("services") >= p.gate_services) | (F.col("max_severity") >= p.gate_severity) | F.coalesce(type_prior(F.col("root_type"), p.default_prior) >= p.gate_prior, F.lit(False))
    return i.withColumn("passes", (F.col("alarm_count") >= p.gate_alarms) & strong)


def prioritise(gated: DataFrame, members: DataFrame, alarms: DataFrame) -> DataFrame:
    """Adds the four parts, score, rank and label to incidents that pass; maxima are over those alone."""
    crit = with_alarms(members, alarms, "criticality").groupBy("incident_id").agg(F.avg(criticality_weight(F.col("criticality"))).alias("crit"))
    i = gated.where("passes").join(crit, "incident_id").withColumn("breadth_raw", F.size("services") + 0.25 * F.size("hosts"))
    top = i.agg(F.greatest(F.lit(1.0), F.max("breadth_raw")).alias("max_breadth"), F.greatest(F.lit(1), F.max("alarm_count")).alias("max_volume"))
    i = i.join(F.broadcast(top))  # one row
    parts = {
        "p_severity": 0.40 * ((F.col("max_severity") - 1) / 4.0),
        "p_breadth": 0.35 * F.least(F.lit(1.0), F.col("breadth_raw") / F.col("max_breadth")),
        "p_volume": 0.15 * F.least(F.lit(1.0), F.col("alarm_count") / F.col("max_volume")),
        "p_criticality": 0.10 * F.col("crit"),
    }
    i = i.withColumns({k: half_up(v, 4) for k, v in parts.items()})
    i = i.withColumn("score", half_up(F.col("p_severity") + F.col("p_breadth") + F.col("p_volume") + F.col("p_criticality"), 4))
    label = F.when((F.col("score") >= 0.70) | ((F.col("max_severity") >= 5) & (F.size("services") >= 5)), "P1").when((F.col("score") >= 0.40) | (F.col("max_severity") >= 4), "P2").otherwise("P3")
    i = i.withColumn("label", label).drop("crit", "breadth_raw", "max_breadth", "max_volume")
    return in_order(i, [F.col("score").desc(), "start_us", "incident_id"], "rank").withColumn("rank", (F.col("rank") + 1).cast("int"))


def cap_cards(ranked: DataFrame, n_rejected: int = 0, n_residual: int = 0, p: Params = DEFAULT) -> DataFrame:
    """Adds slot (card or bucket) and card_id. One slot is the bucket's if anything must go there."""
    more = ranked.where(F.col("rank") > p.cap).limit(1).count() or n_rejected or n_residual  # ranks count all incidents
    room = p.cap - 1 if more else p.cap
    out = ranked.withColumn("slot", F.when(F.col("rank") <= room, "card").otherwise("bucket"))
    return out.withColumn("card_id", F.when(F.col("slot") == "card", F.format_string("INC-%03d", F.col("rank"))).otherwise(BUCKET))


def titles(cards: DataFrame) -> DataFrame:
    """(card_id, title, display_title); repeated display titles get the time of their start."""
    event = F.initcap(F.translate("root_type", "_", " "))
    place = F.element_at("locations", 1)
    local = (F.size("locations") == 1) & F.col("root_type").isin("network_down", "pkt_loss", "network_flap")
    dc_rack = F.concat(F.upper(F.substring_index(place, "/", 1)), F.lit(" "), F.replace(F.substring_index(place, "/", -1), F.lit("rack-"), F.lit("Rack-")), F.lit(" "), event)
    short = F.when(local, dc_rack).otherwise(F.concat("root_service", F.lit(" "), event))
    scope = F.when(F.size("services") > 1, F.concat(F.lit("spread to "), F.size("services").cast("string"), F.lit(" services"))).otherwise("within one service")
    c = cards.where("slot = 'card'").select("card_id", "start_us", F.concat("root_service", F.lit(": "), event, F.lit(" - "), scope).alias("title"), short.alias("short"))
    again = F.count("*").over(W.partitionBy("short")) > 1
    clock = F.date_format(F.timestamp_micros(F.col("start_us")), "HH:mm")
    return c.select("card_id", "title", F.when(again, F.concat("short", F.lit(" ("), clock, F.lit(")"))).otherwise(F.col("short")).alias("display_title"))


_HISTORY = lambda: F.array(F.struct(F.lit("open").alias("status"), F.lit("card opened").alias("note")))


#: Alarms and rolled-up incidents that a document names; `membership` has them all.
HEAD = 600


def membership(cards: DataFrame, members: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """(card_id, incident_id, alarm_id): every alarm that a card or the bucket holds; residual alarms (alarm_id) have no incident."""
    own = members.join(cards.select("incident_id", "card_id"), "incident_id").select("card_id", "incident_id", "alarm_id")
    return own if residual is None else own.union(residual.select(F.lit(BUCKET), F.lit(None).cast("string"), "alarm_id"))


def card_facts(held: DataFrame, alarms: DataFrame) -> DataFrame:
    """Per card_id of a membership: counts, sets of names, histogram of types, times, and the ids of the first HEAD alarms.

    The bucket may hold most alarms. Counts and sets are combined before they are shuffled, and so are the first alarms,
    of which each task keeps HEAD of a card; no list grows with the alarms.
    """
    used = alarms.select("alarm_id", "us", "service", "host", F.concat_ws("/", "datacenter", "rack").alias("location"), "severity", "alarm_type", "source_system")
    a = kept(held.join(used, "alarm_id"))
    names = {"services": "service", "hosts": "host", "locations": "location", "source_systems": "source_system"}
    sets = [F.sort_array(F.collect_set(c)).alias(n) for n, c in names.items()]
    total = a.groupBy("card_id").agg(F.count("*").alias("alarm_count"), *sets, F.max("severity").alias("max_severity"), F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count(F.when(F.col("incident_id").isNull(), 1)).alias("residual"))
    kinds = a.groupBy("card_id", "alarm_type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("card_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("alarm_type", "n")))).alias("alarm_type_histogram"))
    first = a.select("card_id", "us", "alarm_id").withColumn("k", F.row_number().over(W.partitionBy("card_id").orderBy("us", "alarm_id"))).where(F.col("k") <= HEAD)
    first = first.groupBy("card_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "alarm_id"))), lambda x: x["alarm_id"]).alias("alarm_ids"))
    return total.join(kinds, "card_id").join(first, "card_id")


def build_cards(cards: DataFrame, held: DataFrame, alarms: DataFrame, roots: DataFrame, texts: DataFrame, actions: DataFrame, reasons: DataFrame, evidence: DataFrame, known: DataFrame, similar: DataFrame) -> DataFrame:
    """One nested document per card, and one of the same shape for the bucket if anything goes there; held is their membership.

    Sets, histogram, the first HEAD alarms, root and counter, explanation, evidence, action with its first history entry,
    known patterns and similar incidents; similar has card ids as incident_id.
    """
    facts = kept(card_facts(held, alarms))
    c = cards.where("slot = 'card'").join(titles(cards), "card_id").join(facts.select("card_id", "alarm_type_histogram", "alarm_ids", "source_systems"), "card_id")
    c = c.join(roots.drop("root_service", "root_type", "root_alarm_id").join(roots.select("incident_id", "root_alarm_id").withColumnRenamed("root_alarm_id", "root_id"), "incident_id"), "incident_id").join(texts, "incident_id", "left").join(actions, "incident_id", "left").join(reasons, "incident_id", "left")
    c = c.join(evidence.select("incident_id", F.struct(*(x for x in evidence.columns if x not in ("incident_id", "n"))).alias("evidence")), "incident_id", "left")
    met = known.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("by"), "pattern_key", "confidence", "matched_symptoms", "symptom_share"))).alias("known"))
    alike = similar.groupBy(F.col("incident_id").alias("card_id")).agg(F.sort_array(F.collect_list(F.struct("rank", "match", "match_run", "similarity", "reasons"))).alias("similar_incidents"))
    c = c.join(met, "incident_id", "left").join(alike, "card_id", "left")
    own = c.select(
        "card_id", "incident_id", "title", "display_title", "label", "score", F.struct("p_severity", "p_breadth", "p_volume", "p_criticality").alias("score_parts"), "alarm_count", "services", "hosts", "locations", "max_severity",
        F.struct("start_us", "end_us", "duration_min").alias("time_range"), "alarm_ids", "alarm_type_histogram", "source_systems",
        F.struct("root_id", "root_service", "root_type", "root_total", "explanation").alias("root_cause"), F.struct("counter_alarm_id", "counter_service", "counter_total", "delta", "counter_reason").alias("counter"),
        F.struct("action", "owner", F.lit("open").alias("status"), _HISTORY().alias("history")).alias("recommended_action"), "reasons",
        "evidence", F.transform("known", lambda x: x.dropFields("by")).alias("known_patterns"), "similar_incidents",
    )
    b = _bucket(cards, facts)
    title = F.format_string("Other - %d alarms, %d services", F.col("alarm_count"), F.size("services"))
    action = F.struct(F.lit("review the remaining signals together").alias("action"), F.lit("platform-oncall").alias("owner"), F.lit("open").alias("status"), _HISTORY().alias("history"))
    minutes = half_up((F.col("end_us") - F.col("start_us")) / float(MINUTE), 1).alias("duration_min")
    rest = b.select(
        "card_id", F.col("card_id").alias("incident_id"), title.alias("title"), F.lit("Other").alias("display_title"), "label", F.lit(0.0).alias("score"), "alarm_count", "services", "hosts", "locations", "max_severity",
        F.struct("start_us", "end_us", minutes).alias("time_range"), "alarm_ids", "alarm_type_histogram", "source_systems", action.alias("recommended_action"), "reasons", "rolled_up", "n_rolled_up",
    )
    return own.unionByName(rest, allowMissingColumns=True)


def _bucket(cards: DataFrame, facts: DataFrame) -> DataFrame:
    """The bucket's row of facts with how many incidents went there, the best HEAD of them, and why."""
    over = cards.where("slot = 'bucket'")
    best = over.orderBy("rank").limit(HEAD).agg(F.sort_array(F.collect_list(F.struct("rank", "incident_id", "alarm_count", "score", "root_alarm_id"))).alias("rolled_up"))
    count = over.agg(F.count("*").alias("n_rolled_up"))
    below = F.when(F.col("n_rolled_up") > 0, F.concat(F.col("n_rolled_up").cast("string"), F.lit(" incidents ranked below the cards")))
    sparse = F.when(F.col("residual") > 0, F.concat(F.col("residual").cast("string"), F.lit(" alarms in no cluster")))
    one = facts.where(F.col("card_id") == BUCKET).join(F.broadcast(best)).join(F.broadcast(count))  # one row each
    return one.withColumn("label", F.lit("P4")).withColumn("reasons", F.array_compact(F.array(below, sparse)))


def bucket_card(cards: DataFrame, members: DataFrame, alarms: DataFrame, residual: DataFrame | None = None) -> DataFrame:
    """One document over the incidents that got no card of their own and the alarms (alarm_id) of residual; no row if there are none."""
    return _bucket(cards, card_facts(membership(cards.where("slot = 'bucket'"), members, residual), alarms))


def card_stats(gated: DataFrame, capped: DataFrame, known: DataFrame, residual: DataFrame) -> DataFrame:
    """One row: incidents detected, passing the gate and below it, cards of their own and rolled up, matches with known patterns, alarms in no incident."""
    g = gated.agg(F.count("*").alias("detected"), F.count(F.when(F.col("passes"), 1)).alias("passing"), F.count(F.when(~F.col("passes"), 1)).alias("below"))
    c = capped.agg(F.count(F.when(F.col("slot") == "card", 1)).alias("own_slot"), F.count(F.when(F.col("slot") == "bucket", 1)).alias("rolled_up"))
    k = known.join(capped.where("slot = 'card'").select("incident_id"), "incident_id", "left_semi").agg(F.countDistinct("incident_id").alias("known_cards"), F.count("*").alias("pattern_matches"))
    r = residual.agg(F.count("*").alias("residual"))
    one = g.join(F.broadcast(c)).join(F.broadcast(k)).join(F.broadcast(r))  # one row each
    return one.withColumn("total_cards", F.col("own_slot") + (F.col("rolled_up") > 0).cast("int"))
