"""Token ids in files by canonical length-limited Huffman coding.

Format: `header` holds the type of doc_id and the code length of every id (one byte each; 0: unused); codes are canonical, in
order of (length, id), at most 16 bits. `blocks` holds rows of whole documents in ascending doc_id order:
part and seq (their order), first_id (ids of the part before the block), doc_ids, n_ids (of each
document), checks (bit offset of every 256th id, little-endian unsigned 32-bit) and bits. Any block decodes
by itself, and any checkpoint is an entry point, so lanes of a block decode side by side through a table of
65,536 entries.

Ids are made once and staged, in two bytes each where the vocabulary allows; code lengths come from
the counts of all ids (a row for each id of the vocabulary is all that reaches the driver). Null text: empty.
Null doc_ids come first, equal ones in the order of their rows. An empty table gives files without blocks.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import drop_staged, shared_dir, staged
from quire.llm.tokens import pieces, tokenizer_path

MAX_BITS, CHECK, BLOCK_IDS, LANES = 16, 256, 1 << 16, 1 << 13
#: Pieces that a worker remembers: it holds nothing else.
MEMORY = 1_000_000


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal code of at most `most` bits, by package-merge; 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids have no code of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, row = [], leaves
    for _ in range(most):
        leaf = np.concatenate([np.ones(len(leaves), bool), np.zeros(len(row) // 2, bool)]) if levels else np.ones(len(leaves), bool)
        if levels:
            pairs = row[: len(row) // 2 * 2]
            merged = np.concatenate([leaves, pairs[::2] + pairs[1::2]])
            by = np.argsort(merged, kind="stable")
            row, leaf = merged[by], leaf[by]
        levels.append(leaf)
    take = 2 * len(leaves) - 2
    for leaf in reversed(levels):
        n = int(leaf[:take].sum())
        lengths[order[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    width = lengths[order].astype(np.uint64)
    steps = np.uint64(1) << (np.uint64(MAX_BITS) - width)
    codes[order] = (np.cumsum(steps) - steps) >> (np.uint64(MAX_BITS) - width)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Id and code length for each 16-bit window."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (MAX_BITS - lengths[order].astype(np.int64)))
    ids, bits = np.zeros(1 << MAX_BITS, np.uint32), np.ones(1 << MAX_BITS, np.int64)
    n = int(spans.sum())
    ids[:n], bits[:n] = np.repeat(order, spans), np.repeat(lengths[order].astype(np.int64), spans)
    return ids, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """(bits, checkpoints)."""
    width = lengths[ids].astype(np.int64)
    ends = np.cumsum(width)
    at = ends - width
    total = int(ends[-1]) if len(ends) else 0
    window = codes[ids] << (np.uint64(64) - (at & 31).astype(np.uint64) - width.astype(np.uint64))
    word, n = at >> 5, (total >> 5) + 2
    words = np.bincount(word, (window >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (window & np.uint64(0xFFFFFFFF)).astype(np.float64), n)[:n]
    return words.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::CHECK].astype("<u4").tobytes()


def decode_blocks(blocks: list[tuple[bytes, bytes, int]], table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """Ids of each (bits, checkpoints, number of ids), all lanes of all blocks step by step."""
    symbols, widths = table
    data = np.frombuffer(b"".join(x[0] for x in blocks) + b"\0\0\0", np.uint8).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    starts, at = [], 0
    for bits, checks, _ in blocks:
        starts.append(np.frombuffer(checks, "<u4").astype(np.int64) + 8 * at)
        at += len(bits)
    p, last = np.concatenate(starts) if starts else np.zeros(0, np.int64), len(window) - 1
    out = np.empty((len(p), min(CHECK, max((x[2] for x in blocks), default=0))), np.uint32)
    for k in range(out.shape[1]):
        peek = (window[np.minimum(p >> 3, last)] >> (8 - (p & 7)).astype(np.uint32)) & 0xFFFF
        out[:, k] = symbols[peek]
        p += widths[peek]
    found, lane = [], 0
    for _, checks, n in blocks:
        m = len(checks) // 4
        found.append(out[lane : lane + m].reshape(-1)[:n] if n > out.shape[1] or m == 1 else out[lane, :n])
        lane += m
    return found


def tokenize(docs: DataFrame, end_id: int, path: str, n_ids: int) -> DataFrame:
    """doc_id, ordinal (unique), ids (binary) of each document, and a row for each task that has only counts: how
    often the task's documents hold each id (little-endian signed 64-bit, one for each id)."""
    kind = dict(docs.dtypes)["doc_id"]
    names = ["doc_id", "ordinal", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordinal, encoder, doc_type = TaskContext.get().partitionId() << 33, pieces(path, False, MEMORY), None
        end, counts = np.array([end_id], encoder.dtype).tobytes(), np.zeros(n_ids, np.int64)
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            ids = [x + end for x in encoder.encode(batch["text"].to_pylist())]
            counts += np.bincount(np.frombuffer(b"".join(ids), encoder.dtype), minlength=n_ids)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.arange(ordinal, ordinal + len(ids))), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=names)
            ordinal += len(ids)
        if doc_type is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, doc_type), pa.array([ordinal]), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ordinal long, ids binary, counts binary")


def count_ids(tokens: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs in the whole table: the sum of the tasks' counts, id by id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch["counts"]:
                counts += np.frombuffer(x.as_py(), "<i8")
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["id", "n"])

    counts = np.zeros(n_ids, np.int64)
    for r in tokens.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    return counts


def write_ids(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None, path: str | None = None) -> str:
    """Write the ids of all documents; returns the folder of the files."""
    spark, vocabulary = docs.sparkSession, vocabulary or tokenizer_path("byte_bpe_50k.json")
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    encoder = pieces(vocabulary, words=False)
    dtype, n_ids = encoder.dtype.str, max(encoder.tokenizer.get_vocab_size(), end_id + 1)
    tokens = staged(tokenize(docs, end_id, vocabulary, n_ids), "token-ids")
    lengths = code_lengths(count_ids(tokens, n_ids))
    shared = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # 9 bytes for each id of the vocabulary
    kind = dict(docs.dtypes)["doc_id"]
    spark.createDataFrame([(lengths.tobytes(), kind)], "lengths binary, id_type string").coalesce(1).write.parquet(f"{path}/header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        names, held, kind = [], [], None
        lengths, codes = shared.value

        def block() -> pa.RecordBatch:
            nonlocal seq, first, names, held
            n = [len(x) for x in held]
            bits, checks = encode_block(np.concatenate(held), codes, lengths)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([first], pa.int64()), pa.array([sum(n)], pa.int64()), pa.array([names], pa.list_(kind)), pa.array([n], pa.list_(pa.int64())), pa.array([checks], pa.binary()), pa.array([bits], pa.binary())],
                names=["part", "seq", "first_id", "total", "doc_ids", "n_ids", "checks", "bits"])
            seq, first, names, held = seq + 1, first + sum(n), [], []
            return row

        have = 0
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
                names.append(doc)
                held.append(np.frombuffer(ids.as_py(), dtype))
                have += len(held[-1])
                if have >= BLOCK_IDS:
                    yield block()
                    have = 0
        if held:
            yield block()

    ordered = tokens.where("counts is null").select("doc_id", "ordinal", "ids").repartitionByRange(F.col("doc_id"), F.col("ordinal")).sortWithinPartitions("doc_id", "ordinal")
    ordered.select("doc_id", "ids").mapInArrow(run, _blocks_schema(kind)).write.option("compression", "none").parquet(f"{path}/blocks")
    drop_staged(tokens)
    return path


def _blocks_schema(kind: str) -> str:
    return f"part int, seq long, first_id long, total long, doc_ids array<{kind}>, n_ids array<long>, checks binary, bits binary"


def _decoded(blocks: DataFrame, lengths: bytes, kind: str, with_ids: bool) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(np.frombuffer(shared.value, np.uint8))
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                end, lanes = at, 0
                while end < batch.num_rows and lanes < LANES:
                    lanes += len(batch["checks"][end].as_buffer()) // 4
                    end += 1
                part = batch.slice(at, end - at)
                at = end
                found = decode_blocks([(b.as_py(), c.as_py(), n.as_py()) for b, c, n in zip(part["bits"], part["checks"], part["total"], strict=True)], table)
                docs, starts, counts, crcs, raws = [], [], [], [], []
                for ids, names, sizes, first in zip(found, part["doc_ids"], part["n_ids"].to_pylist(), part["start"].to_pylist(), strict=True):
                    raw, k = ids.astype("<u4").tobytes(), 0
                    docs.append(names.values)
                    for n in sizes:
                        one = raw[4 * k : 4 * (k + n)]
                        starts.append(first + k)
                        counts.append(n)
                        crcs.append(zlib.crc32(one))
                        raws.append(one if with_ids else None)
                        k += n
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(raws, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    found = blocks.select("doc_ids", "n_ids", "total", "checks", "bits", "start").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, ids binary")
    return found if with_ids else found.drop("ids")


def read_ids(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit), read from files."""
    header = spark.read.parquet(f"{path}/header").first()
    lengths, kind = bytes(header.lengths), header.id_type
    blocks = spark.read.schema(_blocks_schema(kind)).parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("total").alias("n"))  # one row for each part file
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = blocks.join(F.broadcast(parts.select("part", before.alias("before"))), "part").withColumn("start", F.col("before") + F.col("first_id"))
    return _decoded(placed, lengths, kind, with_ids)
