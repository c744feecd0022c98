"""Each stage and the whole pipeline against plain Python or the operators' SQL, on odd rows and clashing columns."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stormsift.llm import mixing, quality, sentence_piece, stages, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, part string, copy string, doc string, rounds int, kept boolean, node long, tree long"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(400)]
    prose = [" ".join(rng.choices(vocab, k=rng.randrange(55, 120))) for _ in range(60)]
    toxic = [p + " " + " ".join(rng.choices(["zorgle", "zorgles"], k=3)) for p in prose[:12]]
    near = [" ".join(w if k % 60 else "other" for k, w in enumerate(p.split())) for p in prose[20:30]]
    odd = [None, "", " \n\t", "few words", "# $ % " * 60, "same line of words\n" * 40, prose[5], prose[5], "x" + "y" * 50_000 + " " + prose[7]]
    texts = list(enumerate(prose + toxic + near + odd)) + [(3, prose[3]), (3, prose[40]), (None, prose[8]), (None, None), (4, None)]
    return [(i, t, None if k % 11 == 0 else "en", None if k % 13 == 0 else f"s{k % 2}", len(t or ""), 7, "p", "c", "d", 1, False, 5, None) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1, int("zorgl" in (r[1] or ""))) for r in rows if r[0] is not None] + [(3, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int")


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def test_toxicity_stage(docs, rows, labels):
    score = {(r["doc_id"], r["n_chars"]): r["score"] for r in toxicity.score_toxicity(docs, labels).join(docs.select("doc_id", "n_chars"), "doc_id").collect()}
    got = bag(stages.without_toxic(docs, labels))
    assert not got - Counter(rows) and not any("zorgl" in (r[1] or "") for r in got)
    assert all(r in got for r in rows if "zorgl" not in (r[1] or "") and score.get((r[0], r[4]), 0) < 0.7)
    assert bag(stages.without_toxic(docs, labels.limit(0))) == Counter(rows)


def test_quality_stage_keeps_and_drops_rows(docs, rows):
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    kept = con.execute(quality.OP5_SQL.rsplit("SELECT doc_id", 1)[0] + "SELECT doc_id, n_words, word_chars FROM v WHERE NOT base_failed AND NOT odd").fetchall()
    want = Counter((None if i != i else i, n, c) for i, n, c in kept)
    got = bag(stages.of_quality(docs))
    assert not got - Counter(rows)
    assert Counter((r[0], len(split(r[1])), sum(map(len, split(r[1])))) for r in got.elements()) == want
    assert sum(r[0] == 3 for r in got.elements()) >= 3 and not any(r[0] == 4 and r[1] is None for r in got)


def test_near_dedup_stage(docs, rows):
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [split((t or "").lower())] for k in range(max(1, len(w) - 4)) if w}
    sets = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = bag(stages.without_near_duplicates(docs))
    assert not got - Counter(rows)
    assert Counter(r[0] for r in got.elements()) == Counter({i: 1 for i in root if find(i) == i} | {None: 2})
    assert got == bag(stages.without_near_duplicates(docs.repartition(5)))


def test_mixing_stage(docs, rows):
    taken = Counter()
    for r in mixing.mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got = stages.mixed(docs)
    assert got.columns == docs.columns
    out, texts = Counter(), {}
    for r in rows:
        texts.setdefault(r[0], []).append(split(r[1]))
    for r in got.collect():
        w = split(r["text"])
        out[r["doc_id"]] += len(w)
        assert any(w == t or any((t + t)[k : k + len(w)] == w for k in range(len(t))) for t in texts[r["doc_id"]])
        assert (r["size"], r["part"], r["copy"], r["doc"]) == (7, "p", "c", "d") and r["n_chars"] == len(r["text"])
    assert out == Counter({k: n for k, n in taken.items() if n})


def test_stages_on_an_empty_table(docs, labels):
    none = docs.limit(0)
    for f in (lambda d: stages.without_toxic(d, labels), stages.of_quality, stages.without_near_duplicates, stages.mixed, stages.encoded):
        assert f(none).count() == 0


def test_run_chains_all_stages(spark, docs, labels, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert out.columns == [*docs.columns, "ids"]
    got = out.collect()
    back = {(r["doc_id"], r["text"]) for r in sentence_piece.decode(out).collect()}
    assert got and back == {(r["doc_id"], r["text"]) for r in got}
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, f"file://{tmp_path}")
        step = spark.createDataFrame(step.collect(), docs.schema)
        assert step.columns == docs.columns, name
    assert Counter(tuple(r) for r in step.collect()) == Counter(tuple(r)[:-1] for r in got)
    assert not any(r["text"] is None or "zorgl" in r["text"] for r in got) and step.where(F.col("text").contains("same line")).count() == 0


def test_stages_carry_a_map(docs, rows, labels):
    """A further column of type MAP, null in places, goes through all stages; of repeated rows near-dedup keeps one."""
    wide = docs.withColumn("tags", F.when(F.col("doc_id") % 3 > 0, F.create_map(F.lit("id"), F.col("doc_id"), F.lit("n"), F.col("n_chars"))))
    wide = wide.union(wide.where("doc_id = 5"))
    once = stages.without_near_duplicates(wide)
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())  # noqa: E731  of different rows of one id, the hash picks
    assert ids(once) == ids(stages.without_near_duplicates(docs))
    assert once.where("doc_id = 5").count() == 1
    last = wide
    for stage in (lambda d: stages.without_toxic(d, labels), stages.of_quality, stages.without_near_duplicates, stages.mixed, stages.encoded):
        last = stage(last)
    out = last.select("doc_id", "tags").where("doc_id % 3 > 0").collect()
    assert out and all(r["tags"]["id"] == r["doc_id"] for r in out)
