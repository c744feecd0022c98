"""Operators as filtering, mixing and encoding stages: each takes and gives whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from stormsift.llm import mixing, near_dup, quality, sentence_piece, toxicity
from stormsift.llm.common import WORD_PATTERN


#: Columns of the stages' own; no table has names like these.
_KEY, _PLACE = "__stage_key__", "__stage_place__"


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents that score below the threshold, row by row.

    Null and empty texts have the score of the bias alone; nulls elsewhere and repeated rows stay as they are; an empty
    table gives no rows; without labels of both classes all stay; further columns are carried along.
    """
    model = toxicity.fit(docs, labels)
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [toxicity.word_values(model[0], *bag, model[1]) for bag in toxicity.word_bags(batch.column("text"))]
            if z:
                yield batch.filter(pa.array(1 / (1 + np.exp(-np.concatenate(z))) < threshold))

    return docs.mapInArrow(run, docs.schema)


def of_quality(docs: DataFrame) -> DataFrame:
    """Documents that the quality rules keep, row by row: rows that share a doc_id are judged apart.

    A row is known by doc_id, lang, source and a hash of its text, all that its verdict depends on. Rows with null or empty
    texts fail the base and go; nulls in other columns and repeated rows stay as they are; an empty table gives no rows;
    further columns, whatever their names, are carried along.
    """
    keys = {"doc_id": F.col("doc_id").cast("long"), "lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "text_hash": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    kept = quality.judged(docs).where("kept").select(F.struct(*keys).alias(_KEY)).distinct()
    return docs.withColumn(_KEY, F.struct(*(c.alias(k) for k, c in keys.items()))).join(kept, _KEY, "left_semi").select(*docs.columns)


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: the one of smallest doc_id; rows without doc_id all stay.

    Of rows that repeat a kept doc_id one stays, that of the least hash over all columns, so reruns agree. Null and empty
    texts are no duplicates of anything; an empty table gives no rows; further columns are carried along.
    """
    ids = near_dup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.struct("doc_id").alias(_KEY)).distinct()
    known = docs.where("doc_id IS NOT NULL").withColumn(_KEY, F.struct(F.col("doc_id").cast("long").alias("doc_id")))
    # a map has no hash; as text it has
    row = F.xxhash64(*(F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema))
    least = known.groupBy(_KEY).agg(F.count("*").alias("n"), F.min(row).alias("least")).where("n > 1").select(F.col(_KEY).alias("other"), "least")
    kept = known.join(ids, _KEY, "left_semi")
    one = kept.join(least, F.col(_KEY) == F.col("other"), "left_semi")
    once = kept.join(least, F.col(_KEY) == F.col("other"), "left_anti").select(*docs.columns)
    one = one.join(least.select(F.struct(F.col("other").alias("id"), F.col("least").alias("hash")).alias("best")), F.struct(F.col(_KEY).alias("id"), row.alias("hash")) == F.col("best"), "left_semi")
    # what is left of an id are equal rows, of which each task keeps one before they are shuffled
    first = F.row_number().over(W.partitionBy(_KEY).orderBy(row))
    one = one.withColumn(_PLACE, first).where(F.col(_PLACE) == 1)
    return once.union(one.select(*docs.columns)).union(docs.where("doc_id IS NULL"))


def mixed(docs: DataFrame, seed: int = 42) -> DataFrame:
    """Documents as often as the mix takes them; where it takes a part once more, a row holds that part's words.

    Null and empty texts are never taken; nulls in other columns stay; repeated rows are documents of their own; an empty
    table gives no rows; further columns, whatever their names, are carried along, n_chars fitted to a part's text.
    """
    plan = mixing.mix_sources(docs, seed, carry=True).where("taken > 0")
    text = F.col("doc").getField("text")
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))
    ring = F.concat(F.slice(words, F.col("part_from").cast("int") + 1, F.col("size").cast("int")), F.slice(words, F.lit(1), F.col("part_to").cast("int")))
    straight = F.slice(words, F.col("part_from").cast("int") + 1, F.col("part").cast("int"))
    part = F.array_join(F.when(F.col("part_from") < F.col("part_to"), straight).otherwise(ring), " ")
    copies = F.explode(F.sequence(F.lit(1), (F.col("rounds") + (F.col("part") > 0).cast("long")).cast("int")))
    rows = plan.select("doc", "size", "rounds", "part", "part_from", "part_to", copies.alias("copy"))
    cut = (F.col("copy") > F.col("rounds")) & (F.col("part") < F.col("size"))
    doc = F.col("doc").withField("text", F.when(cut, part).otherwise(text))
    if "n_chars" in docs.columns:
        doc = doc.withField("n_chars", F.when(cut, F.length(part)).otherwise(F.col("doc").getField("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(doc.alias("doc")).select("doc.*")


def encoded(docs: DataFrame) -> DataFrame:
    """Documents with ids, the piece ids of each text; null and empty texts have none. Rows stay one for one."""
    return sentence_piece.encode(docs)
