"""LM scoring: a weighted backoff automaton over n-grams counted across the corpus."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stormsift.llm.common import CHUNK_BYTES, chunks, mix, table, word_hashes, word_spans, written

#: Longest n-gram, and the pseudo-count that a state gives to its failure arc.
ORDER, PULL = 3, 5.0
#: Bytes of text of a block about, and blocks whose n-grams a bucket sums about. A task holds one block or one bucket.
BLOCK_BYTES, BUCKET_BLOCKS = 8 << 20, 2
#: Tokens that a lane of the traversal walks; lanes of a block walk side by side.
LANE = 64
_END = np.uint64(0x5851F42D4C957F2D)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def tokens(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each chunk: tokens per row (its words and one end), and the tokens' hashes."""
    for _, offsets, body in chunks(column, CHUNK_BYTES):
        starts, ends, n = word_spans(offsets, body)
        out = np.full(len(starts) + len(n), _END, np.uint64)
        at = np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)
        out[at] = word_hashes(body, starts, ends)
        yield n + 1, out


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values, ascending; a place of each; for each place its value's number)."""
    by = np.argsort(keys)
    ordered = keys[by]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    number = np.empty(len(keys), np.int32)  # a block's or a bucket's n-grams
    number[by] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], by[new], number


@dataclass
class Level:
    """Distinct n-grams of one length in a block: hashes, last tokens, the n-grams without their last and without their first token, and the n-gram that ends at each place (-1: none)."""

    hashes: np.ndarray
    token: np.ndarray
    context: np.ndarray
    suffix: np.ndarray
    at: np.ndarray


def levels(texts: pa.Array, order: int) -> tuple[np.ndarray, list[Level]]:
    """(tokens per row, levels 1..order) of a block's rows; an end token stands before each row."""
    found = list(tokens(texts))
    n = np.concatenate([x for x, _ in found]) if found else np.empty(0, np.int64)
    word = np.concatenate([x for _, x in found]) if found else np.empty(0, np.uint64)
    del found
    hashes, _, at = distinct(word)
    del word
    none = np.zeros(len(hashes), np.int32)
    out = [Level(hashes, np.arange(len(hashes), dtype=np.int32), none, none, at)]
    first = (np.cumsum(n) - n)[n > 0]
    end = int(np.searchsorted(hashes, _END))
    for k in range(2, order + 1):
        low = out[-1]
        before = np.full(len(at), -1, np.int32)
        before[1:] = low.at[:-1]
        before[first] = end if k == 2 else -1
        here = np.flatnonzero(before >= 0).astype(np.int32)
        keys = before[here].astype(np.int64)
        del before
        keys *= len(hashes)
        keys += at[here]
        keys, place_of, back = distinct(keys)
        suffix = low.at[here[place_of]]
        own = np.full(len(at), -1, np.int32)
        own[here] = back
        del here, place_of, back
        context, token = (x.astype(np.int32) for x in (np.divmod(keys, len(hashes)) if len(keys) else (keys, keys)))
        del keys
        # 56 bits of hash: the last byte is 0 and costs nothing on its way
        h = mix(low.hashes[context] * _STEP + hashes[token] + np.uint64(k)) & ~np.uint64(255)
        out.append(Level(h, token, context, suffix, own))
    return n, out


def planes(a: np.ndarray) -> bytes:
    """The array's bytes, all first bytes first: ascending hashes and small counts then compress well on their way."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def local_counts(level: Level, train: np.ndarray) -> np.ndarray:
    """How often each n-gram stands in training rows of the block; train tells it for each place."""
    here = level.at[train & (level.at >= 0)]
    return np.bincount(here, minlength=len(level.hashes)).astype(np.int64)


def messages(block: int, number: int, hashes: np.ndarray, counts: np.ndarray, n_buckets: int) -> pa.Table:
    """The block's n-grams of one level, ascending, one row for each bucket (range of hashes) that holds any."""
    cuts = np.searchsorted(hashes, np.array([(k << 64) // n_buckets for k in range(1, n_buckets)], np.uint64))
    cuts = np.concatenate(([0], cuts, [len(hashes)]))
    full = np.flatnonzero(np.diff(cuts))
    part = lambda a: pa.array([planes(a[cuts[q] : cuts[q + 1]]) for q in full], pa.binary())
    return pa.table({"block": pa.array(np.full(len(full), block), pa.int32()), "level": pa.array(np.full(len(full), number), pa.int32()), "bucket": pa.array(full, pa.int32()), "grams": part(hashes), "counts": part(counts.astype(np.uint32))})


SENT = "block int, level int, bucket int, grams binary, counts binary"
BACK = "block int, level int, bucket int, totals binary, n_tokens long, n_types long"


def add(bucket: pa.Table) -> pa.Table:
    """Answers each block of a bucket with the totals of its n-grams, doubled, plus 1 where other blocks hold them too.

    n_tokens and n_types of the bucket stand in the first row.
    """
    g = [from_planes(x, np.uint64) for x in bucket.column("grams").to_pylist()]
    c = np.concatenate([from_planes(x, np.uint32) for x in bucket.column("counts").to_pylist()])
    keys, _, at = distinct(np.concatenate(g))
    total = np.bincount(at, c, len(keys)).astype(np.int64)
    back = (2 * total + (np.bincount(at, minlength=len(keys)) > 1))[at]
    ends = np.concatenate(([0], np.cumsum([len(x) for x in g])))
    first = lambda x: pa.array([int(x)] + [0] * (len(g) - 1), pa.int64())
    return pa.table({"block": bucket.column("block"), "level": bucket.column("level"), "bucket": bucket.column("bucket"), "totals": pa.array([planes(back[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()), "n_tokens": first(total.sum()), "n_types": first((total > 0).sum())})


def answers(model: pa.Table, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(totals, held elsewhere) of a block's n-grams of one level, in the order sent."""
    own = model.filter(pc.equal(model.column("level"), number)).sort_by("bucket")
    x = np.concatenate([np.empty(0, np.int64), *(from_planes(x, np.int64) for x in own.column("totals").to_pylist())])
    return x >> 1, (x & 1).astype(bool)


def to_send(level: Level, elsewhere: np.ndarray | None) -> np.ndarray:
    """N-grams to send, ascending by hash. elsewhere tells which n-grams one shorter other blocks hold too: no other block
    holds an n-gram of which either part stands in this block alone, so its local count is its total."""
    pick = np.arange(len(level.hashes)) if elsewhere is None else np.flatnonzero(elsewhere[level.context] & elsewhere[level.suffix])
    return pick[np.argsort(level.hashes[pick])]


def totals_of(model: pa.Table, found: list[Level], train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(total, held elsewhere) of each level's n-grams, as far as the model answers."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for k, level in enumerate(found):
        pick = to_send(level, out[-1][1] if k >= 2 else None)
        total, elsewhere = local_counts(level, train), np.zeros(len(level.hashes), bool)
        total[pick], elsewhere[pick] = answers(model, k + 1)
        out.append((total, elsewhere))
    return out


@dataclass
class Automaton:
    """States are the root (0) and the n-grams seen in training. An arc takes a token from a state to the state of the
    longest suffix and weighs a log10 probability; where a state has no arc for a token, its failure arc leads to the
    n-gram without its first token and weighs what the state gives away. Arcs ascend by key (state, token): levels do, and
    within a level n-grams ascend by context and token."""

    n_types: int
    keys: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    failure: np.ndarray
    give: np.ndarray
    start: int

    def walk(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states, log10 probabilities) after one token in each lane; the root has an arc for every token."""
        gain = np.zeros(len(state))
        out = np.empty(len(state), np.int64)
        lane = np.arange(len(state))
        while len(lane):
            key = state * self.n_types + token
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[lane[hit]] = self.target[at[hit]]
            gain[lane[hit]] += self.weight[at[hit]]
            lane, state, token = lane[~hit], state[~hit], token[~hit]
            gain[lane] += self.give[state]
            state = self.failure[state]
        return out, gain


def automaton(found: list[Level], totals: list[np.ndarray], size: int, types: int) -> Automaton:
    """The part of the automaton that a block's texts can reach, of totals over all blocks, training tokens and types.

    Dirichlet smoothing: a state h of count c sends w with (c(hw) + PULL * p(w | shorter h)) / (c + PULL), so its failure
    arc weighs PULL / (c + PULL). At the root stands the add-one unigram.
    """
    n, order = len(found[0].hashes), len(found)
    first = np.cumsum([1] + [len(x.hashes) for x in found[: order - 1]])  # the first state of each level (64 bits, as keys are)
    p = (totals[0] + 1) / (size + types + 1)
    keys, target, weight = [np.arange(n)], [np.where(totals[0] > 0, first[0] + np.arange(n), 0) if order > 1 else np.zeros(n, np.int64)], [np.log10(p)]
    failure, give = [np.zeros(1, np.int64)], [np.zeros(1)]
    for k in range(1, order):
        level, low = found[k], totals[k - 1]
        seen = np.flatnonzero(totals[k] > 0)
        failure.append(first[k - 2] + found[k - 1].suffix if k > 1 else np.zeros(n, np.int64))
        give.append(np.log10(PULL / (low + PULL)))
        shorter = p[level.suffix[seen]]
        q = np.zeros(len(level.hashes))
        q[seen] = (totals[k][seen] + PULL * shorter) / (low[level.context[seen]] + PULL)
        keys.append((first[k - 1] + level.context[seen]) * n + level.token[seen])
        target.append(first[k] + seen if k < order - 1 else first[k - 1] + level.suffix[seen])
        weight.append(np.log10(q[seen]))
        p = q
    end = int(np.searchsorted(found[0].hashes, _END))
    start = int(first[0]) + end if order > 1 and n and totals[0][end] else 0
    return Automaton(n, np.concatenate(keys), np.concatenate(target, dtype=np.int32), np.concatenate(weight), np.concatenate(failure), np.concatenate(give), start)


def traverse(a: Automaton, n: np.ndarray, token: np.ndarray, order: int) -> np.ndarray:
    """Log10 probability of each row, from left to right, the state carried on.

    Long rows are cut into lanes. A state depends on the last order - 1 tokens, so a later lane takes up the state that the
    lane before it ends in by walking these tokens from the root, unscored.
    """
    lanes = -(-n // LANE)
    row = np.repeat(np.arange(len(n)), lanes)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = (np.cumsum(n) - n)[row] + turn * LANE
    size = np.minimum(LANE, n[row] - turn * LANE)
    by = np.argsort(-size, kind="stable")
    row, turn, begin, size = row[by], turn[by], begin[by], size[by]
    state = np.where(turn == 0, a.start, 0)
    later = np.flatnonzero(turn > 0)
    for back in range(order - 1, 0, -1):
        state[later] = a.walk(state[later], token[begin[later] - back])[0]
    score = np.zeros(len(row))
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, "left"))
        state[:live], gain = a.walk(state[:live], token[begin[:live] + step])
        score[:live] += gain
    return np.bincount(row, score, len(n))


def dealt(docs: DataFrame, columns: list[Column], n_blocks: int) -> DataFrame:
    """columns of docs and the block of each row, the same whenever the rows are read again.

    A row is known by its file and its place in it, which do not hang on how the scan is split, as a running number of rows
    would: the passes may run on clusters of different size. Rows that are no plain scan of files are written first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        named = docs.select(*columns, F.xxhash64(at["file_path"], at["row_index"]).alias("block"))
    except AnalysisException:
        return dealt(written(docs.select(*columns)), [F.col(c) for c in docs.select(*columns).columns], n_blocks)
    return named.withColumn("block", F.pmod("block", F.lit(n_blocks)).cast("int"))


def score_documents(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text.

    N-grams of all training rows are counted and become the states of a backoff automaton (see automaton), over which each
    text is one traversal from left to right.

    Rows are dealt to blocks of about block_bytes (dealt), to which each pass reads the same rows. Each block sends its distinct n-grams in ranges of hashes (buckets), a
    row for each range that it touches; a bucket sums all blocks' counts and answers each with the totals of its own
    n-grams. From length 3 on, a block sends only n-grams of which both parts stand in other blocks too, as the others
    stand nowhere else. So a block scores with just the part of the automaton that its texts can reach, what is sent
    grows with the texts, and nothing is broadcast. N-grams of two and more tokens are told apart by 56 bits of hash.

    Null text counts as empty (one token, the end); repeated rows count as often as they stand; an empty table gives no
    rows; null doc_ids count as training rows; other columns are not read.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    total = docs.select(*columns).agg(F.sum(F.octet_length("text") + F.lit(16)), F.count("*")).first()
    n_blocks = max(1, -(-max(total[0] or 0, total[1]) // block_bytes))
    n_buckets = max(1, n_blocks // BUCKET_BLOCKS)
    out_held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = dealt(docs, columns, n_blocks).withColumn("held_out", out_held).repartition(n_blocks, "block")

    def read(block: pa.Table, upto: int) -> tuple[np.ndarray, list[Level], np.ndarray]:
        n, found = levels(_one(block, "text"), upto)
        return n, found, np.repeat(~_bools(block, "held_out"), n)

    def send(block: pa.Table) -> pa.Table:
        _, found, train = read(block, min(order, 2))
        picks = [to_send(x, None) for x in found]
        return pa.concat_tables([messages(block.column("block")[0].as_py(), k + 1, x.hashes[pick], local_counts(x, train)[pick], n_buckets) for k, (x, pick) in enumerate(zip(found, picks, strict=True))])

    def send_longer(number: int):
        def run(block: pa.Table, model: pa.Table) -> pa.Table:
            _, found, train = read(block, number)
            known = totals_of(model, found[:-1], train)
            pick = to_send(found[-1], known[-1][1])
            return messages(block.column("block")[0].as_py(), number, found[-1].hashes[pick], local_counts(found[-1], train)[pick], n_buckets)

        return run

    model = written(rows.groupBy("block").applyInArrow(send, SENT).groupBy("level", "bucket").applyInArrow(add, BACK))
    x = model.where("level = 1").agg(F.sum("n_tokens"), F.sum("n_types")).first()  # two numbers
    size, types = x[0] or 0, x[1] or 0
    for number in range(3, order + 1):
        longer = rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(send_longer(number), SENT)
        model = model.union(longer.groupBy("level", "bucket").applyInArrow(add, BACK))
        model = written(model) if number < order else model

    def walk(block: pa.Table, model: pa.Table) -> pa.Table:
        n, found, train = read(block, order)
        totals = [t for t, _ in totals_of(model, found, train)]
        token = found[0].at
        row = np.repeat(np.arange(len(n)), n)
        base = np.bincount(row, np.log10((totals[0] + 1) / (size + types + 1))[token], len(n))
        known = np.bincount(row, (totals[0] > 0)[token], len(n)).astype(np.int64)
        score = traverse(automaton(found, totals, size, types), n, token, order)
        return pa.table({"doc_id": _one(block, "doc_id"), "held_out": _one(block, "held_out"), "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(block.num_rows, size)), "base_score": pa.array(base), "score": pa.array(score)})

    return rows.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(walk, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _one(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    if pa.types.is_string(c.type):  # 32-bit offsets end at 2 GB
        c = c.cast(pa.large_string())
    return c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()


def _bools(t: pa.Table, name: str) -> np.ndarray:
    return _one(t, name).to_numpy(zero_copy_only=False).astype(bool)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
