"""Follow-up actions: current records and the transitions behind them. Times are microseconds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.sources.io import kept

STATUSES = ("open", "in_progress", "resolved")


def sync_actions(records: DataFrame, cards: DataFrame) -> DataFrame:
    """Records (incident_id, status, owner, action, created_us, updated_us) after a run's cards (incident_id, owner, action, created_us).

    Kept incidents keep their status and times and take the card's owner and action; new ones open; those without a card go.
    """
    r = records.select("incident_id", *(F.col(c).alias(f"r_{c}") for c in ("status", "owner", "action", "created_us", "updated_us")))
    j = cards.join(r, "incident_id", "left")
    return j.select(
        "incident_id", F.coalesce("r_status", F.lit("open")).alias("status"), F.coalesce("owner", "r_owner", F.lit("platform-oncall")).alias("owner"), F.coalesce("action", "r_action", F.lit("")).alias("action"),
        F.coalesce("r_created_us", "created_us").alias("created_us"), F.coalesce("r_updated_us", "created_us").alias("updated_us"),
    )


#: With enforced transitions, a status may go to any other one.
MOVES = {s: tuple(t for t in STATUSES if t != s) for s in STATUSES}
#: Changes of an incident that one step of the fold takes.
PIECE = 256


def _folded(good: DataFrame, moves: Mapping[str, Sequence[str]]) -> DataFrame:
    """good (incident_id, first_status, status, us, seq) with before, the status when the change comes, and whether it is allowed.

    Whether a change counts depends on all before it, so this is a fold. A piece of PIECE changes is folded from every
    status at once, to a table of where each leads; an incident's pieces are then folded as such tables, and each piece
    again from the status that it starts in. So an incident's changes are never one list.
    """
    states = (*STATUSES, "other")  # other: a record's status that is none of the three; it may go anywhere
    allowed = [[t in moves.get(s, ()) or s == "other" for t in STATUSES] for s in states]
    table = F.array(*(F.array(*(F.lit(k if ok else at) for k, ok in enumerate(row))) for at, row in enumerate(allowed)))
    may = F.array(*(F.array(*map(F.lit, row)) for row in allowed))
    number = lambda c, other: F.coalesce(*(F.when(F.col(c) == s, k) for k, s in enumerate(STATUSES)), F.lit(other))
    w = W.partitionBy("incident_id").orderBy("us", "seq")
    rows = good.withColumns({"to": number("status", 0), "first": number("first_status", 3), "k": F.row_number().over(w) - 1})
    pieces = rows.groupBy("incident_id", "first", F.expr(f"k div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list(F.struct("k", "to"))).alias("xs"))
    step = lambda s, x: table[s][x["to"]]
    from_each = F.array(*(F.aggregate("xs", F.lit(k), step) for k in range(len(states))))
    pieces = kept(pieces.withColumn("leads", from_each))
    whole = pieces.groupBy("incident_id", "first").agg(F.sort_array(F.collect_list(F.struct("piece", "leads"))).alias("ps"))
    none = F.array().cast("array<int>")
    run = F.aggregate("ps", F.struct(F.col("first").alias("s"), none.alias("out")), lambda a, p: F.struct(p["leads"][a["s"]].alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))
    starts = whole.select("incident_id", F.inline(F.arrays_zip(F.col("ps.piece").alias("piece"), run["out"].alias("start"))))
    each = F.aggregate("xs", F.struct(F.col("start").alias("s"), none.alias("out")), lambda a, x: F.struct(step(a["s"], x).alias("s"), F.concat(a["out"], F.array(a["s"])).alias("out")))
    found = pieces.join(starts, ["incident_id", "piece"]).select("incident_id", F.inline(F.arrays_zip(F.col("xs.k").alias("k"), each["out"].alias("at"))))
    names = F.array(*map(F.lit, STATUSES))
    out = rows.join(found, ["incident_id", "k"])
    before = F.when(F.col("at") < len(STATUSES), F.get(names, F.col("at"))).otherwise(F.col("first_status"))
    return out.withColumn("before", before).withColumn("allowed", may[F.col("at")][F.col("to")]).drop("to", "first", "k", "at")


def apply_transitions(records: DataFrame, changes: DataFrame, moves: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(current records, transitions, rejects) from changes (incident_id, status, owner, note, us, seq).

    A change to an unknown status or incident is rejected; with moves (as MOVES), also one that the status of that moment
    does not allow, which depends on the changes rejected before it. A transition knows its previous status; its owner is
    the last one named, and a note left empty says old -> new.
    """
    known = records.select("incident_id", F.col("status").alias("first_status"), F.col("owner").alias("first_owner"))
    c = changes.join(known, "incident_id", "left")
    why = F.when(~F.col("status").isin(*STATUSES) | F.col("status").isNull(), "invalid status").when(F.col("first_status").isNull(), "unknown incident")
    rejects = c.withColumn("error", why).where("error IS NOT NULL").select("incident_id", "status", "us", "error")
    good = c.where(why.isNull())
    w = W.partitionBy("incident_id").orderBy("us", "seq")
    if moves is None:
        good = good.withColumn("before", F.coalesce(F.lag("status").over(w), "first_status"))
    else:
        told = kept(_folded(good, moves))
        late = told.where("NOT allowed").select("incident_id", "status", "us", F.concat("before", F.lit(" may not go to "), "status").alias("error"))
        rejects, good = rejects.union(late), told.where("allowed")
    named = F.when(F.col("owner") != "", F.col("owner"))
    t = good.withColumn("previous_status", F.col("before")).withColumn("owner", F.coalesce(F.last(named, ignorenulls=True).over(w), "first_owner"))
    t = t.withColumn("note", F.when(F.coalesce("note", F.lit("")) != "", F.col("note")).otherwise(F.concat("previous_status", F.lit(" -> "), "status"))).select("incident_id", "previous_status", "status", "owner", "note", "us", "seq")
    last = t.groupBy("incident_id").agg(F.max_by(F.struct("status", "owner", "us"), F.struct("us", "seq")).alias("l"))
    current = records.join(last, "incident_id", "left").select("incident_id", F.coalesce("l.status", "status").alias("status"), F.coalesce("l.owner", "owner").alias("owner"), "action", "created_us", F.coalesce("l.us", "updated_us").alias("updated_us"))
    return current, t, rejects


def with_history(records: DataFrame, transitions: DataFrame, most: int = 600) -> DataFrame:
    """records with n_history and history: the opening and the transitions in order, of more than most the latest.

    The transitions themselves stay the whole history; the list is what a document shows.
    """
    entry = lambda seq, previous, status, owner, note, us: F.struct(us.alias("us"), seq.cast("long").alias("seq"), previous.alias("previous_status"), status.alias("status"), owner.alias("owner"), note.alias("note"))
    opened = records.select("incident_id", entry(F.lit(-1), F.lit(None).cast("string"), F.lit("open"), F.col("owner"), F.lit("card opened"), F.col("created_us")).alias("e"))
    moved = transitions.select("incident_id", entry(*(F.col(c) for c in ("seq", "previous_status", "status", "owner", "note", "us"))).alias("e"))
    every = opened.union(moved)
    newest = every.withColumn("k", F.row_number().over(W.partitionBy("incident_id").orderBy(F.col("e.us").desc(), F.col("e.seq").desc()))).where(F.col("k") <= most)
    lists = newest.groupBy("incident_id").agg(F.sort_array(F.collect_list("e")).alias("history"))  # at most `most`
    return records.join(every.groupBy("incident_id").agg(F.count("*").alias("n_history")), "incident_id").join(lists, "incident_id")


def history_timeline(records: DataFrame) -> DataFrame:
    """(incident_id, us, seq, previous_status, status, owner, note) of all histories, newest first."""
    return records.select("incident_id", F.inline("history")).orderBy(F.col("us").desc(), F.col("seq").desc(), "incident_id")


def status_counts(records: DataFrame) -> DataFrame:
    domain = records.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    n = records.groupBy("status").agg(F.count("*").alias("n"))
    return domain.join(n, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def action_timeline(transitions: DataFrame) -> DataFrame:
    return transitions.orderBy(F.col("us").desc(), F.col("seq").desc())
