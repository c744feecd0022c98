"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stormsift.llm.common import chunks, mix, table, word_hashes

#: The vocabulary file that the queries use; any SentencePiece model with byte pieces does.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_MARK = "▁"
_UNKNOWN_PENALTY = 10.0
_TEXT_BYTES = 1 << 21
#: Bytes of a segment that is walked by itself.
LONG = 2048


@dataclass(eq=False)
class Pieces:
    """Pieces as bytes (the marker as a blank), log scores, ids of the 256 byte pieces, and the double-array trie."""

    data: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    solo: np.ndarray
    split: bool

    @cached_property
    def lists(self) -> tuple[list[int], list[int], list[int]]:
        return self.base.tolist(), self.check.tolist(), self.leaf.tolist()

    @cached_property
    def fallback(self) -> float:
        return float(self.scores[self.leaf[self.leaf >= 0]].min()) - _UNKNOWN_PENALTY if (self.leaf >= 0).any() else -_UNKNOWN_PENALTY


def double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, leaf): node s goes to base[s] + byte + 1 if check there is s; leaf is the piece's id or -1. Node 0 is the root."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for piece, number in pieces.items():
        at = 0
        for b in piece:
            nxt = children[at].get(b)
            if nxt is None:
                nxt = len(children)
                children[at][b] = nxt
                children.append({})
                ids.append(-1)
            at = nxt
        ids[at] = number
    size = 1 << 10
    used = bytearray(size)
    used[0] = 1
    base, check, leaf = [0] * size, [-1] * size, [-1] * size
    place = {0: 0}
    free, queue = 0, [0]
    for node in queue:
        kids = sorted(children[node])
        queue += [children[node][b] for b in kids]
        leaf[place[node]] = ids[node]
        if not kids:
            continue
        b0 = free
        while True:
            if b0 + 258 > size:
                used.extend(bytes(size))
                base, check, leaf = base + [0] * size, check + [-1] * size, leaf + [-1] * size
                size *= 2
            if not any(used[b0 + b + 1] for b in kids):
                break
            b0 += 1
        if b0 - free > 64:  # what lies before is nearly full
            free = b0 - 32
        s = place[node]
        base[s] = b0
        for b in kids:
            used[b0 + b + 1] = 1
            check[b0 + b + 1] = s
            place[children[node][b]] = b0 + b + 1
    return np.array(base, np.int32), np.array(check, np.int32), np.array(leaf, np.int32)


def make_pieces(names: list[tuple[bytes, float, int]], n: int, byte_ids: np.ndarray) -> Pieces:
    """From (bytes, log score, id) of ordinary pieces, the number of ids, and the byte pieces' ids."""
    data = [b""] * n
    scores = np.zeros(n)
    for piece, score, k in names:
        data[k], scores[k] = piece, score
    for b, k in enumerate(byte_ids.tolist()):
        data[k] = bytes([b])
    base, check, leaf = double_array({p: k for p, _, k in names})
    held = np.zeros(256, bool)
    for p, _, _ in names:
        held[list(p)] = True
    solo = ~held & (np.arange(256) < 128) & (np.arange(256) != 32)
    split = not any(b" " in p.lstrip(b" ") for p, _, _ in names)
    return Pieces(data, scores, byte_ids, base, check, leaf, solo, split)


@cache
def load_pieces(path: str = MODEL) -> Pieces:
    """Reads a model file. A BPE vocabulary has merge ranks in place of scores; a piece of rank r then gets the log
    probability of Zipf's law, -log(r + 2) less the log of their sum. A unigram model's own scores stay."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    plain = [k for k in range(n) if not (p.is_byte(k) or p.is_control(k) or p.is_unknown(k) or p.is_unused(k))]
    scores = np.array([p.get_score(k) for k in plain])
    if len(scores) and (scores == np.round(scores)).all():
        scores = -np.log(2.0 - scores)
        scores -= np.log(np.exp(scores).sum())
    byte_ids = np.array([p.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    return make_pieces([(p.id_to_piece(k).replace(_MARK, " ").encode(), float(s), k) for k, s in zip(plain, scores, strict=True)], n, byte_ids)


def viterbi_long(pieces: Pieces, body: bytes) -> list[int]:
    """The same path through one long segment, byte by byte: a segment without blanks can be as long as its text."""
    base, check, leaf = pieces.lists
    scores, fallback, byte_ids = pieces.scores.tolist(), pieces.fallback, pieces.byte_ids.tolist()
    n, m = len(body), len(check)
    best, back, came = [float("-inf")] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    best[0] = 0.0
    for r in range(n):
        value = best[r]
        if value + fallback > best[r + 1]:
            best[r + 1], back[r + 1], came[r + 1] = value + fallback, 1, byte_ids[body[r]]
        state, end = 0, r
        while end < n:
            nxt = base[state] + body[end] + 1
            if nxt >= m or check[nxt] != state:
                break
            state, end = nxt, end + 1
            k = leaf[state]
            if k >= 0 and value + scores[k] > best[end]:
                best[end], back[end], came[end] = value + scores[k], end - r, k
    out, at = [], n
    while at:
        out.append(came[at])
        at -= back[at]
    return out[::-1]


def viterbi(pieces: Pieces, body: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces per segment, ids): the path of highest summed score through each segment; of equal ones, that of earlier starts.

    All segments walk together: at step r every segment of more than r bytes follows the trie from its byte r. A byte
    that no piece covers is a byte piece at the fallback score.
    """
    n = len(starts)
    size = ends - starts
    first = np.concatenate(([0], np.cumsum(size + 1)))  # boundaries: one more than bytes
    best = np.full(first[-1], -np.inf)
    back = np.zeros(first[-1], np.int32)
    came = np.zeros(first[-1], np.int32)
    best[first[:-1]] = 0
    fallback = pieces.fallback
    order = np.argsort(-size, kind="stable")
    longest = -size[order]
    for r in range(int(size.max()) if n else 0):
        w = order[: int(np.searchsorted(longest, -r, "left"))]
        at = starts[w] + r
        here = first[w] + r
        value = best[here]
        end = here + 1
        low = value + fallback
        better = low > best[end]
        best[end[better]], back[end[better]], came[end[better]] = low[better], 1, pieces.byte_ids[body[at[better]]]
        state = np.zeros(len(w), np.int32)
        left = size[w] - r
        step = 0
        live = np.arange(len(w))
        while len(live):
            nxt = pieces.base[state] + body[at[live] + step] + 1
            ok = pieces.check[nxt] == state
            live, state = live[ok], nxt[ok]
            step += 1
            leaf = pieces.leaf[state]
            hit = leaf >= 0
            if hit.any():
                k = live[hit]
                end = here[k] + step
                new = value[k] + pieces.scores[leaf[hit]]
                better = new > best[end]
                end = end[better]
                best[end], back[end], came[end] = new[better], step, leaf[hit][better]
            more = left[live] > step
            live, state = live[more], state[more]
    count = np.zeros(n, np.int64)
    cursor = first[1:] - 1
    walk = np.flatnonzero(size > 0)
    trail = []
    while len(walk):
        count[walk] += 1
        trail.append((walk, came[cursor[walk]]))
        cursor[walk] -= back[cursor[walk]]
        walk = walk[cursor[walk] > first[walk]]
    offset = np.cumsum(count)
    ids = np.empty(int(offset[-1]) if n else 0, np.int32)
    for k, (w, number) in enumerate(trail):
        ids[offset[w] - 1 - k] = number
    return count, ids


def ragged(offsets: np.ndarray, counts: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Places of the items of the picked runs, one run after the other."""
    n = counts[pick]
    return np.repeat(offsets[pick] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))


def encode_rows(pieces: Pieces, offsets: np.ndarray, body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces per row, ids) of texts, each with one blank put before it; equal segments are encoded once."""
    n = len(offsets) - 1
    if not len(body):
        return np.zeros(n, np.int64), np.empty(0, np.int32)
    full = np.diff(offsets) > 0
    text = np.insert(body, offsets[:-1][full], 32)
    shift = np.cumsum(np.concatenate(([0], full)))
    begin = (offsets + shift)[:-1][full]
    cut = np.zeros(len(text) + 1, bool)
    cut[begin] = True
    if pieces.split:
        blank = text == 32
        cut[:-1] |= blank & ~np.concatenate(([False], blank[:-1]))
    alone = pieces.solo[text]
    cut[:-1] |= alone
    cut[1:] |= alone
    cut[-1] = False
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(text))
    _, one, inverse = np.unique(word_hashes(text, starts, ends, lower=False), return_index=True, return_inverse=True)
    long = ends[one] - starts[one] > LONG
    some, ids = viterbi(pieces, text, starts[one[~long]], ends[one[~long]])
    count = np.zeros(len(one), np.int64)
    count[~long] = some
    if long.any():  # their ids stand after the others'
        more = [viterbi_long(pieces, text[starts[k] : ends[k]].tobytes()) for k in one[long]]
        count[long] = [len(x) for x in more]
        ids = np.concatenate([ids, *(np.array(x, np.int32) for x in more)])
    order = np.concatenate((np.flatnonzero(~long), np.flatnonzero(long)))
    place = np.empty(len(one), np.int64)
    place[order] = np.cumsum(count[order]) - count[order]
    all_ids = ids[ragged(place, count, inverse)]
    per_row = np.zeros(n, np.int64)
    row = np.flatnonzero(full)[np.searchsorted(begin, starts, "right") - 1]
    np.add.at(per_row, row, count[inverse])
    return per_row, all_ids


def decode_rows(pieces: Pieces, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of the texts: pieces joined, byte pieces as their bytes, without the blank put before."""
    flat = np.frombuffer(b"".join(pieces.data), np.uint8)
    size = np.array([len(x) for x in pieces.data])
    out = flat[ragged(np.cumsum(size) - size, size, ids)]
    ends = np.concatenate(([0], np.cumsum(size[ids])))
    offsets = ends[np.concatenate(([0], np.cumsum(counts)))]
    full = counts > 0
    return offsets - np.concatenate(([0], np.cumsum(full))), np.delete(out, offsets[:-1][full])


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of docs (doc_id, text, ...) plus ids, the piece ids of each whole text; null and empty texts have none.

    The marker of pieces is a blank here, so a marker written in a text is no piece and falls back to bytes, and decoding
    gives every text back. Repeated rows each give a row; a column named ids is replaced.
    """
    pieces = load_pieces(path)
    docs = docs.drop("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, offsets, body in chunks(batch.column("text"), _TEXT_BYTES):
                counts, ids = encode_rows(pieces, offsets, body)
                ends = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                part = batch.slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(ids))], [*part.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give an empty text, and bytes that are no UTF-8 the replacement character."""
    pieces = load_pieces(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
            offsets, body = decode_rows(pieces, counts, lists.flatten().to_numpy())
            text = pa.array([body[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, n_bytes (fallback pieces), digest of the ids in order, and whether decoding gives the text back."""
    pieces = load_pieces(path)
    is_byte = np.zeros(len(pieces.data), bool)
    is_byte[pieces.byte_ids] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], []]
            for _, offsets, body in chunks(batch.column("text"), _TEXT_BYTES):
                counts, ids = encode_rows(pieces, offsets, body)
                row = np.repeat(np.arange(len(counts)), counts)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
                total = np.concatenate(([np.uint64(0)], np.cumsum(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64)))))
                ends = np.cumsum(counts)
                back, text = decode_rows(pieces, counts, ids)
                same = np.diff(back) == np.diff(offsets)
                if same.all():
                    wrong = np.concatenate(([0], np.cumsum(text != body)))
                    same = wrong[offsets[1:]] == wrong[offsets[:-1]]
                else:
                    same = np.array([bytes(text[a:b]) == bytes(body[c:d]) for a, b, c, d in zip(back[:-1], back[1:], offsets[:-1], offsets[1:], strict=True)])
                for to, x in zip(out, (counts, np.bincount(row, is_byte[ids], len(counts)).astype(np.int64), (total[ends] - total[ends - counts]).view(np.int64), same), strict=True):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.concatenate(x) if x else []) for x in out)], ["doc_id", "n_tokens", "n_bytes", "digest", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_bytes long, digest long, round_trip boolean")


def op8_sentence_piece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
