"""Token ids in a binary format: an adaptive context-mixing range coder in independent blocks.

A block holds up to BLOCK ids as a matrix of lanes (contiguous runs) by rows. Row by row, the model
predicts each lane's next id from three orders: the id that last followed the two ids before (order 2),
the id that last followed the one before (order 1), and adaptive frequencies of all ids (order 0).
Weights of the three come from counts of how often each was right at the same confidences; they mix
into one distribution that a carry-less 64-bit range coder codes in one step for each id. All lanes of a
row are coded before the model learns from them, so that encoder and decoder run the same vectorised
steps. Models start afresh in each block and every block carries a CRC-32, so blocks decode alone.

Layout of a block, little-endian: magic ``PLTC``, version u8, 3 zero bytes, first id position in its
shard u64, ids u32, lanes u32, largest id u32, documents u32, words u32, CRC-32 of the rest u32; then for
each document i64 doc_id, u64 number in its shard, u32 ids here, u8 flags (1: doc_id is null, 2: part of
a longer document), then u32 word counts of the lanes, then u32 code words.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.byte_bpe import Encoder, hub_encoder
from panelloom.llm.common import stored, table, text_slices

MAGIC, VERSION = b"PLTC", 1
HEAD = struct.Struct("<4sB3xQIIIIII")
BLOCK = 1 << 20
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
LANES = 4096
MIX = 12
_SLOTS = 1 << 17
_U = np.uint64
_WORD = _U(32)
_TOP = _BOT = _U(1) << _WORD
DOC = np.dtype([("doc_id", "<i8"), ("number", "<u8"), ("ids", "<u4"), ("flags", "u1")])


class Model:
    """Order-0 to order-2 predictions of a block and their mixing weights."""

    def __init__(self, largest: int, lanes: int, decodes: bool = False) -> None:
        self.size, self.decodes = largest + 1, decodes
        self.bits = max(16, self.size.bit_length() + 2)
        if self.bits > 24:
            raise ValueError(f"ids below {1 << 22} can be coded, not {largest}")
        # weights and frequencies share 32 bits: beyond 2**18 ids the weights are coarser
        self.mix = min(MIX, 32 - self.bits)
        self.counts = np.zeros(self.size, np.int64)
        self.seen: list[np.ndarray] = []
        # 8 * id + confidence of what last followed; no prediction yet: id -1, which equals none
        self.after1 = np.full(self.size, -8, np.int32)
        self.after2 = np.full(_SLOTS, -8, np.int32)
        self.right = np.ones((3, 64), np.int64)
        # what indexes tables has 64 bits: numpy would convert it each time
        self.prev1 = np.zeros(lanes, np.int64)
        self.prev2 = np.zeros(lanes, np.int64)
        self.rows = 0
        self.due = 1
        self.refresh()

    def refresh(self) -> None:
        """Order-0 intervals from the counts so far; every id keeps a width of at least one."""
        if self.seen:
            self.counts += np.bincount(np.concatenate(self.seen), minlength=self.size)
            self.seen = []
        room = (1 << self.bits) - self.size
        total = int(self.counts.sum())
        width = np.ones(self.size, np.int64)
        if total:
            width += self.counts * room // total
        width[int(self.counts.argmax())] += (1 << self.bits) - int(width.sum())
        self.start = np.concatenate(([0], np.cumsum(width))).astype(np.uint64)
        self.width = width.astype(np.uint64)
        if self.decodes:
            self.symbol = np.repeat(np.arange(self.size, dtype=np.int32), width)

    def predict(self) -> tuple[np.ndarray, ...]:
        """Candidates of order 2 and 1, where the mixed intervals of order 1 and 0 begin, and the weight of order 0."""
        self.slot = (self.prev2 * -1640531535 + self.prev1 * -2048144789) >> 7 & (_SLOTS - 1)
        was2, was1 = self.after2.take(self.slot, mode="clip"), self.after1.take(self.prev1, mode="clip")
        self.sure2, self.sure1 = (was2 & 7).astype(np.uint8), (was1 & 7).astype(np.uint8)
        self.context = (self.sure2 << 3 | self.sure1).astype(np.int64)
        right = self.right
        total = right.sum(axis=0)
        whole = 1 << self.mix
        w2 = np.minimum(right[2] * (whole - 64) // total, whole - 128)
        w1 = np.minimum(right[1] * (whole - 64) // total, whole - 64 - w2)
        w2[:8] = 0
        w1[::8] = 0
        two, one = was2 >> 3, was1 >> 3
        at1 = (w2 << self.bits).astype(np.uint64).take(self.context, mode="clip")
        at0 = (w1 << self.bits).astype(np.uint64).take(self.context, mode="clip")
        at0 *= one != two
        at0 += at1
        return two, one, at1, at0, _U(whole) - (at0 >> _U(self.bits))

    def learn(self, ids: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """After a row: which order was right, what followed, and now and then new frequencies."""
        n = len(ids)
        hit2, hit1 = hit2.view(np.uint8), hit1.view(np.uint8)
        self.right += np.bincount(self.context[:n] + (np.maximum(hit2 << 1, hit1) << 6), minlength=192).reshape(3, 64)
        # a right candidate gains confidence, up to 7; a wrong one gives way
        fresh = ids.astype(np.int32) << 3
        self.after2[self.slot[:n]] = fresh + np.minimum(self.sure2[:n] * hit2 + 1, 7)
        self.after1[self.prev1[:n]] = fresh + np.minimum(self.sure1[:n] * hit1 + 1, 7)
        self.prev2[:n] = self.prev1[:n]
        self.prev1[:n] = ids
        self.seen.append(ids)
        self.rows += 1
        if self.rows == self.due:
            self.refresh()
            self.due += max(1, min(self.due, 32))


def _interval(model: Model, row: np.ndarray, at1: np.ndarray, at0: np.ndarray, m0: np.ndarray, is2: np.ndarray, is1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids of a row begin in the mixed distribution, and how wide they are."""
    # by products: lanes differ so often that a choice by lane costs more
    by2, by1 = is2.astype(np.uint64), is1.astype(np.uint64)
    by0 = _U(1) - by2 - by1
    first = at1 * by1
    m0 = m0 * by0
    start = model.start.take(row, mode="clip") * m0
    start += at0 * by0
    start += first
    width = model.width.take(row, mode="clip") * m0
    width += at0 * by1
    width -= first
    width += at1 * by2
    return start, width


def _spent(low: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lanes whose leading word is settled or whose span is too narrow, and their spans, cut where they straddle."""
    same = (low ^ (low + span)) < _TOP
    go = np.flatnonzero(same | (span < _BOT))
    width = span.take(go)
    straddles = ~same.take(go)
    if straddles.any():
        np.copyto(width, (~low.take(go) + _U(1)) & (_BOT - _U(1)), where=straddles)
    return go, width


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, -(-n // 256)))
    return lanes, -(-n // lanes) if n else 0


def _turned(matrix: np.ndarray) -> np.ndarray:
    """The transposed matrix, copied by strips that stay in the cache."""
    out = np.empty(matrix.shape[::-1], matrix.dtype)
    for k in range(0, len(matrix), 64):
        out[:, k : k + 64] = matrix[k : k + 64].T
    return out


def _matrix(ids: np.ndarray, lanes: int, rows: int) -> list[np.ndarray]:
    """Rows of the block; lane k holds ids k*rows to (k+1)*rows; lanes that have ended are at the end."""
    whole = np.zeros(lanes * rows, np.int64)
    whole[: len(ids)] = ids
    return [row[: len(range(r, len(ids), rows))] for r, row in enumerate(_turned(whole.reshape(lanes, rows)))] if rows else []


def encode_words(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, words of each lane, code words) of ids."""
    lanes, rows = _shape(len(ids))
    model = Model(int(ids.max(initial=0)), lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0))
    shift = _U(model.bits + model.mix)
    out_lane, out_word = [], []
    for row in _matrix(ids, lanes, rows):
        n = len(row)
        two, one, at1, at0, m0 = (x[:n] for x in model.predict())
        hit2, hit1 = two == row, one == row
        is2 = hit2 & (at1 > 0)
        is1 = hit1 & (at0 > at1) & ~is2
        start, width = _interval(model, row, at1, at0, m0, is2, is1)
        r = span[:n] >> shift
        lo, sp = low[:n], span[:n]  # views: lanes that have ended keep their state
        lo += r * start
        np.multiply(r, width, out=sp)
        live, part = None, (lo, sp)
        while True:
            go, cut = _spent(*part)
            if not len(go):
                break
            live = go if live is None else live.take(go)
            leading = low.take(live)
            out_lane.append(live)
            out_word.append((leading >> _WORD).astype(np.uint32))
            part = leading << _WORD, cut << _WORD
            low[live], span[live] = part
        model.learn(row, hit2, hit1)
    for k in (32, 0):
        out_lane.append(np.arange(lanes))
        out_word.append((low >> _U(k)).astype(np.uint32))
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16), kind="stable")  # at most LANES; few bits are sorted by counting
    return lanes, np.bincount(lane, minlength=lanes).astype("<u4"), word[order].astype("<u4")


def decode_words(n: int, lanes: int, largest: int, lengths: np.ndarray, words: np.ndarray) -> np.ndarray:
    rows = -(-n // lanes) if n else 0
    model = Model(largest, lanes, True)
    at = np.concatenate(([0], np.cumsum(lengths.astype(np.int64))))[:-1]
    words = np.concatenate((words, np.zeros(8, "<u4"))).astype(np.uint64)
    low, span, code = np.zeros(lanes, np.uint64), np.full(lanes, ~_U(0)), np.zeros(lanes, np.uint64)
    for _ in range(2):
        code = code << _WORD | words[at]
        at += 1
    shift = _U(model.bits + model.mix)
    out = np.zeros((rows, lanes), np.uint32)
    limit = (1 << (model.bits + model.mix)) - 1
    for r0 in range(rows):
        k = len(range(r0, n, rows))
        two, one, at1, at0, m0 = (x[:k] for x in model.predict())
        lo, sp = low[:k], span[:k]
        r = sp >> shift
        v = np.minimum((code[:k] - lo) // r, _U(limit))
        deep = v >= at0
        is2 = v < at1
        is1 = ~deep & ~is2
        # below 2**32 by less than 2**16: the quotient of doubles has the same whole part
        place = (((v - at0) * deep).astype(np.float64) / m0.astype(np.float64)).astype(np.int64)
        row = (model.symbol.take(place, mode="clip") * deep + two * is2 + one * is1).astype(np.int64)
        start, width = _interval(model, row, at1, at0, m0, is2, is1)
        lo += r * start
        np.multiply(r, width, out=sp)
        live, part = None, (lo, sp)
        while True:
            go, cut = _spent(*part)
            if not len(go):
                break
            live = go if live is None else live.take(go)
            part = low.take(live) << _WORD, cut << _WORD
            low[live], span[live] = part
            place = at.take(live)
            code[live] = code.take(live) << _WORD | words.take(place, mode="clip")
            at[live] = place + 1
        out[r0, :k] = row
        model.learn(row, two == row, one == row)
    return _turned(out).ravel()[:n]


def encode_block(ids: np.ndarray, docs: np.ndarray, first: int = 0) -> bytes:
    """One block of ids (uint32) and its index of documents (DOC records)."""
    lanes, lengths, words = encode_words(ids)
    body = docs.tobytes() + lengths.tobytes() + words.tobytes()
    return HEAD.pack(MAGIC, VERSION, first, len(ids), lanes, int(ids.max(initial=0)), len(docs), len(words), zlib.crc32(body)) + body


def decode_block(data: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """(first position, DOC records, ids) of a block; ValueError if it is damaged."""
    if len(data) < HEAD.size or data[:4] != MAGIC or data[4] != VERSION:
        raise ValueError("not a token block")
    _, _, first, n, lanes, largest, n_docs, n_words, crc = HEAD.unpack_from(data)
    body = memoryview(data)[HEAD.size :]
    if zlib.crc32(body) != crc or len(body) != n_docs * DOC.itemsize + 4 * lanes + 4 * n_words:
        raise ValueError("damaged token block")
    docs = np.frombuffer(body, DOC, n_docs)
    lengths = np.frombuffer(body, "<u4", lanes, n_docs * DOC.itemsize)
    words = np.frombuffer(body, "<u4", n_words, n_docs * DOC.itemsize + 4 * lanes)
    return first, docs, decode_words(n, lanes, largest, lengths, words)


BLOCKS = "shard int, block int, first long, n_ids long, payload binary"


class _Shard:
    """Ids and index of one shard that are not in a block yet."""

    def __init__(self, shard: int) -> None:
        self.shard, self.block, self.first, self.number, self.n = shard, 0, 0, 0, 0
        self.ids: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, null: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        docs = np.zeros(len(count), DOC)
        docs["doc_id"], docs["flags"], docs["ids"] = doc_ids, null, count
        docs["number"] = np.arange(self.number, self.number + len(count))
        self.number += len(count)
        self.n += len(ids)
        self.ids.append(ids)
        self.docs.append(docs)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        """Blocks of BLOCK ids, and at last one of all that is left if that is ``least`` or more."""
        ids, docs = (np.concatenate(x) if x else x for x in (self.ids, self.docs))
        while self.n >= least:
            size = min(self.n, BLOCK)
            ends = np.cumsum(docs["ids"].astype(np.int64))
            k = int(np.searchsorted(ends, size)) + 1  # documents with ids here
            over = int(ends[k - 1]) - size
            here, docs = docs[:k].copy(), docs[k - (over > 0) :].copy()
            if over:
                here["ids"][-1] -= over
                here["flags"][-1] |= 2
                docs["ids"][0] = over
                docs["flags"][0] |= 2
            payload = encode_block(ids[:size], here, self.first)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([self.shard], pa.int32()), "block": pa.array([self.block], pa.int32()), "first": pa.array([self.first], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([payload], pa.binary())})
            ids, self.n, self.first, self.block = ids[size:], self.n - size, self.first + size, self.block + 1
        self.ids, self.docs = [ids], [docs]


def block_writer(make_encoder: Callable[[], Encoder], end_id: int):
    """Rows (doc_id, text) in order to block rows; each text's ids end with end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held = make_encoder(), _Shard(TaskContext.get().partitionId())
        for batch in batches:
            ids_of = batch.column(0)
            null = ids_of.is_null().to_numpy(zero_copy_only=False)
            doc_ids = ids_of.fill_null(0).to_numpy(zero_copy_only=False)
            for at, data, offsets in text_slices(batch, size=SLICE):
                ids, count = encode.flat(data, offsets)
                ends = np.cumsum(count)
                to = at + len(count)
                held.add(doc_ids[at:to], null[at:to], np.insert(ids, ends, np.uint32(end_id)), count + 1)
                if held.n >= BLOCK:
                    yield from held.flush(BLOCK)
        if held.n:
            yield from held.flush(1)

    return run


def _crc_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Block rows to one row for each document or part of one: its place, ids and their CRC-32."""
    for batch in batches:
        for shard, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            first, docs, ids = decode_block(payload.as_buffer().to_pybytes())
            raw = memoryview(ids.astype("<u4").tobytes())
            ends = np.cumsum(docs["ids"].astype(np.int64))
            starts = ends - docs["ids"]
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = len(docs)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(np.full(n, shard), pa.int32()), "number": pa.array(docs["number"].astype(np.int64)), "block": pa.array(np.full(n, block), pa.int32()),
                "doc_id": pa.array(docs["doc_id"].astype(np.int64), mask=(docs["flags"] & 1).astype(bool)), "part": pa.array((docs["flags"] & 2).astype(bool)),
                "at": pa.array(first + starts), "n": pa.array(docs["ids"].astype(np.int64)), "crc": pa.array(crc, pa.int64()),
            })


def crc32_combine(a: int, b: int, length: int) -> int:
    """CRC-32 of two byte strings joined, from their own and the second one's length (GF(2) matrices)."""

    def times(matrix: list[int], vector: int) -> int:
        total = 0
        for row in matrix:
            if not vector:
                break
            if vector & 1:
                total ^= row
            vector >>= 1
        return total

    matrix = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        matrix = [times(matrix, row) for row in matrix]
    while length:
        if length & 1:
            a = times(matrix, a)
        matrix = [times(matrix, row) for row in matrix]
        length >>= 1
    return a ^ b


def _join_parts(series):
    import pandas as pd

    out = []
    for parts in series:
        crc = 0
        for p in sorted(parts, key=lambda x: x["block"]):
            crc = crc32_combine(crc, p["crc"], 4 * p["n"])
        out.append(crc)
    return pd.Series(out, dtype="int64")


def write_tokens(spark: SparkSession, docs: DataFrame, make_encoder, end_id: int = 0) -> DataFrame:
    """Blocks of ``docs`` (doc_id, text, ...) in ascending doc_id order, written to the shared folder.

    Shards are ranges of doc_id, cut by Spark's range partitioner and sorted within; rows that share a
    doc_id are ordered by a hash of their text and then by text, also across shards, rows without doc_id
    come first, null texts have the end id alone, an empty table has no blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    return stored(spark, ordered.mapInArrow(block_writer(make_encoder, end_id), BLOCKS), "tokens")


def read_tokens(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from blocks."""
    parts = stored(blocks.sparkSession, blocks.select("shard", "block", "payload").mapInArrow(_crc_parts, "shard int, number long, block int, doc_id long, part boolean, at long, n long, crc long"), "token-parts")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    base = shards.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("base"))
    join = F.pandas_udf(_join_parts, "long")
    whole = parts.where("not part").select("shard", "doc_id", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    long = parts.where("part").groupBy("shard", "number").agg(F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"), F.collect_list(F.struct("block", "n", "crc")).alias("parts"))
    long = long.select("shard", "doc_id", "at", "n_tokens", join("parts").alias("ids_crc32"))
    return whole.unionByName(long).join(base, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the 50k byte-level BPE and the block format and back."""
    return read_tokens(write_tokens(spark, table(spark, sf_dir, "documents"), hub_encoder(vocabulary())))
