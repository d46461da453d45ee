"""Operator 2: token-id sequences in training order.

Documents are encoded (an end id closes each) and cut into sequences of at most ``stride`` ids. All sequences are
numbered in the order of the stored table of sequences; a keyed Feistel permutation, walked along its cycle until it falls below the
number of sequences, turns the number into the slot of training. A shard is a range of slots, written as records of equal
length, so a reader seeks to any slot and resumes there without an index.

A record is 4 bytes of length and ``stride`` unsigned 16-bit ids, little-endian, padded with zeros.

Defined results: a null or empty text is one sequence with the end id alone; repeated rows are separate sequences;
an empty table gives no sequences and no shards.

Scale: texts are encoded once and kept as a compressed table in the shared folder (it, the key and the number of sequences fix the
order; runs that resume use the same table); numbering needs one count per writing task; one shuffle moves ids, in compressed bundles, to
the task that holds their range of slots. The query writes the shards below the shared folder and takes its lengths and checksums from them.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotledger.llm import tokens
from slotledger.llm.common import documents, shared_dir, stored

END = 2
STRIDE = 256
KEY = 0x5EED_2024
ROUNDS = 6
#: Sequences of a shard: 64 MB at the default stride.
SHARD_SEQUENCES = 131_072
#: Ids of a stored run, and ids that a task gathers before it deals them out (two bytes each).
RUN_IDS, DEALT_IDS = 1 << 19, 1 << 24
#: Compression of packed ids.
LEVEL = 3


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """64-bit finaliser with a round key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """Slots of the indices 0..n-1: a bijection of that range, the same for equal n and key."""
    half = np.uint64(_half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = np.asarray(index, dtype=np.uint64).copy()
    out = np.empty_like(x)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> half, x[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mix(right, key * ROUNDS + r & (2**63 - 1)) & mask)
        x[todo] = (left << half) | right
        done = x[todo] < np.uint64(max(n, 1))
        out[todo[done]] = x[todo[done]]
        todo = todo[~done]
    return out.astype(np.int64)


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids by their rank among the ids of this run, commonest first: a byte each, two more for ranks from 255 on; compressed."""
    counts = np.bincount(ids, minlength=1)
    found = np.flatnonzero(counts)
    found = found[np.argsort(-counts[found], kind="stable")].astype("<u2")
    rank = np.zeros(len(counts), dtype="<u2")
    rank[found] = np.arange(len(found))
    ranks = rank[ids]
    rest = ranks[ranks >= 255] - 255
    parts = [found, np.minimum(ranks, 255).astype("u1"), (rest & 255).astype("u1"), (rest >> 8).astype("u1")]
    data = b"".join(x.tobytes() for x in parts)
    head = np.array([len(found), len(ids), len(data)], dtype="<u4").tobytes()
    return head + pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def unpacked_ids(data: bytes) -> np.ndarray:
    n_found, n, size = (int(x) for x in np.frombuffer(data, "<u4", 3))
    raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(data)[12:], size, asbytes=True), "u1")
    found, lead, rest = raw[: 2 * n_found].view("<u2"), raw[2 * n_found : 2 * n_found + n], raw[2 * n_found + n :]
    ranks = lead.astype("<u2")
    low, high = rest.reshape(2, -1)
    ranks[lead == 255] = low + (high.astype("<u2") << 8) + 255
    return found[ranks]


def _run(columns: dict[str, pa.Array], ids: np.ndarray) -> bytes:
    """Sequences of a run: their columns, then their ids one after the other."""
    batch = pa.RecordBatch.from_pydict(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    head = sink.getvalue().to_pybytes()
    return len(head).to_bytes(4, "little") + head + packed_ids(ids)


def _opened(data: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    at = 4 + int.from_bytes(data[:4], "little")
    (batch,) = pa.ipc.open_stream(data[4:at])
    return batch, unpacked_ids(data[at:])


def _taken(ids: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of sequences that lie one after the other, in another order of the sequences."""
    n = lengths[order]
    ends = np.cumsum(n)
    starts = (np.cumsum(lengths) - lengths)[order]
    return ids[np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


def encoded(docs: DataFrame, stride: int = STRIDE, vocabulary: str | None = None) -> DataFrame:
    """One row per run of sequences: __block and __first (task that encoded it, place of its first sequence there), __n, rows (``_run``)."""
    path = vocabulary or tokens.vocabulary()
    schema = "__block int, __first bigint, __n bigint, rows binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, first = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        pieces: list[int] = []
        lengths: list[int] = []
        ids: list[np.ndarray] = []
        waiting = 0

        def run() -> pa.RecordBatch:
            columns = {"doc_id": pa.array(doc_ids, pa.int64()), "piece": pa.array(pieces, pa.int32()), "length": pa.array(lengths, pa.int32())}
            return _batch([(block, first, len(doc_ids), _run(columns, np.concatenate(ids)))], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.append(tokens.ids_of(text.as_py(), path), np.uint32(END)).astype("<u2")
                n = -(-len(data) // stride)
                doc_ids += [doc_id] * n
                pieces += range(n)
                lengths += [stride] * (n - 1) + [len(data) - (n - 1) * stride]
                ids.append(data)
                waiting += len(data)
                if waiting >= RUN_IDS:
                    yield run()
                    first += len(doc_ids)
                    doc_ids, pieces, lengths, ids, waiting = [], [], [], [], 0
        if doc_ids:
            yield run()

    source = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return stored(source.mapInArrow(cut, schema), "sequences")


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=_TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields]
    )


def numbered(sequences: DataFrame) -> tuple[np.ndarray, int]:
    """Number of the first sequence of each block, and the number of sequences.

    The driver sees one count per task that encoded documents.
    """
    counts = dict(sequences.groupBy("__block").agg(F.sum("__n")).collect())
    sizes = np.array([counts.get(b, 0) for b in range(max(counts, default=-1) + 1)], dtype=np.int64)
    return np.cumsum(sizes) - sizes, int(sizes.sum())


def training_order(docs: DataFrame, stride: int = STRIDE, key: int = KEY, shard_sequences: int = SHARD_SEQUENCES,
                   vocabulary: str | None = None) -> DataFrame:
    """Records in training order: shard, slot, byte_offset, doc_id, piece, length, ids_crc32, record (fixed stride).

    Each task holds a range of slots, sorted.
    """
    rows = encoded(docs, stride, vocabulary)
    before, n = numbered(rows)
    names = "doc_id bigint, piece int, length int, slot bigint, __ids binary"
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    per_task = max(1, -(-n // parts))  # slots are dense: equal ranges without sampling

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[pa.RecordBatch] = []
        ids: list[np.ndarray] = []

        def dealt() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(runs).combine_chunks()
            task = table["slot"].to_numpy() // per_task
            by_task = np.argsort(task, kind="stable")
            lengths = table["length"].to_numpy()
            table, task, all_ids = table.take(pa.array(by_task)), task[by_task], _taken(np.concatenate(ids), lengths, by_task)
            ends = np.cumsum(lengths[by_task])
            cuts = [*np.flatnonzero(np.diff(task, prepend=-1)), len(task)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                columns = {c: table[c].slice(lo, hi - lo).combine_chunks() for c in table.column_names}
                yield _batch([(int(task[lo]), _run(columns, all_ids[ends[lo] - lengths[by_task[lo]] : ends[hi - 1]]))], "task int, rows binary")

        for batch in batches:
            for block, first, data in zip(*(batch.column(c) for c in ("__block", "__first", "rows")), strict=True):
                run, run_ids = _opened(data.as_py())
                slots = permute(before[block.as_py()] + first.as_py() + np.arange(run.num_rows), n, key)
                runs.append(run.append_column("slot", pa.array(slots)))
                ids.append(run_ids)
                if sum(map(len, ids)) >= DEALT_IDS:
                    yield from dealt()
                    runs.clear()
                    ids.clear()
        if runs:
            yield from dealt()

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("rows"):
                run, ids = _opened(data.as_py())
                ends = np.concatenate([[0], np.cumsum(2 * run["length"].to_numpy())]).astype("<i4")
                values = pa.Array.from_buffers(pa.binary(), run.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(ids)])
                yield run.append_column("__ids", values)

    # ids of one task travel in bundles of many sequences: together they take less than each alone
    dealt = rows.mapInArrow(bundled, "task int, rows binary").repartitionById(parts, "task")
    ordered = dealt.mapInArrow(opened, names).sortWithinPartitions("slot")
    ordered = ordered.withColumn("shard", F.expr(f"slot div {shard_sequences}").cast("int"))
    schema = "shard int, slot bigint, byte_offset bigint, doc_id bigint, piece int, length int, ids_crc32 bigint, record binary"
    width = 4 + 2 * stride

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids = r["__ids"]
                record = (r["length"].to_bytes(4, "little") + ids).ljust(width, b"\0")
                at = (r["slot"] - r["shard"] * shard_sequences) * width
                crc = zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())
                rows.append((r["shard"], r["slot"], at, r["doc_id"], r["piece"], r["length"], crc, record))
            if rows:
                yield _batch(rows, schema)

    return ordered.mapInArrow(records, schema)


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Streams each task's range of slots into plain files of fixed-stride records below ``path``.

    ``path`` is a URI every executor can write (file:, hdfs:, s3:). A file holds consecutive slots of one shard and is
    named by shard and first slot; the slot's record starts at (slot - first_slot) * width. A file appears by renaming once it
    is whole, and a repeated task writes the same bytes, so lost executors leave nothing half done.
    Returns the manifest: shard, first_slot, n, bytes, crc32, file.
    """
    schema = "shard int, first_slot bigint, n bigint, bytes bigint, crc32 bigint, file string"
    return stored(records.select("shard", "slot", "record").mapInArrow(_writer(path, schema, False), schema), "manifest")


def written(records: DataFrame, path: str, stride: int = STRIDE) -> DataFrame:
    """Writes as ``write_shards`` does and returns shard, slot, byte_offset, doc_id, piece, length, ids_crc32 as read back from the files.

    Each batch of rows is a run of records of one file or a few, read with one seek each; the shard is its files one after the other,
    in the order of their first slots.
    """
    names = "shard int, slot bigint, byte_offset bigint, doc_id bigint, piece int, first_slot bigint, file string"
    rows = records.select("shard", "slot", "byte_offset", "doc_id", "piece", "record").mapInArrow(_writer(path, names, True), names)
    schema = "shard int, slot bigint, byte_offset bigint, doc_id bigint, piece int, length int, ids_crc32 bigint"
    width = 4 + 2 * stride

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        for batch in batches:
            slots, first, files = batch.column(1).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist()
            lengths, crcs, i = [], [], 0
            while i < len(slots):
                k = i + 1
                while k < len(slots) and files[k] == files[i] and slots[k] == slots[k - 1] + 1:
                    k += 1
                with store.open_input_file(files[i]) as f:
                    f.seek((slots[i] - first[i]) * width)
                    data = f.read((k - i) * width)
                if len(data) != (k - i) * width:
                    raise OSError(f"{files[i]} ends before slot {slots[k - 1]}")
                for at in range(0, len(data), width):
                    n = int.from_bytes(data[at : at + 4], "little")
                    lengths.append(n)
                    crcs.append(zlib.crc32(np.frombuffer(data, "<u2", n, at + 4).astype("<u4").tobytes()))
                i = k
            more = [pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[x.split()[0] for x in schema.split(", ")])

    return stored(rows, "records").mapInArrow(read, schema)


def _writer(path: str, schema: str, each: bool):
    """Writes files of records; yields the manifest's rows, or (``each``) the given columns of every record with first slot and file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, done, out = None, [], None
        attempt = TaskContext.get().taskAttemptId()
        name_of = lambda p: f"{base}/shard-{p[0]:06d}-from-{p[1]:015d}.bin"

        def close() -> None:
            out.close()
            name = name_of(part)
            store.move(f"{name}.{attempt}", name)
            done.append((*part, name))

        for batch in batches:
            first: list[int] = []
            files: list[str] = []
            for shard, slot, record in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "record")), strict=True):
                if part is None or part[0] != shard:
                    if part is not None:
                        close()
                    part = [shard, slot, 0, 0, 0]
                    out = store.open_output_stream(f"{name_of(part)}.{attempt}")
                out.write(record)
                part[2:] = [part[2] + 1, part[3] + len(record), zlib.crc32(record, part[4])]
                first.append(part[1])
                files.append(name_of(part))
            if each and files:
                more = [pa.array(first, pa.int64()), pa.array(files, pa.string())]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[f.split()[0] for f in schema.split(", ")])
        if part is not None:
            close()
        if done and not each:
            yield _batch(done, schema)

    return write


def read_slots(manifest_row, slot: int, n: int, stride: int = STRIDE) -> list[np.ndarray]:
    """Ids of ``n`` records of a file from ``slot`` on: one seek, then sequential."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(manifest_row["file"])
    width = 4 + 2 * stride
    with store.open_input_file(name) as f:
        f.seek((slot - manifest_row["first_slot"]) * width)
        data = f.read(n * width)
    return [np.frombuffer(data[i + 4 : i + 4 + 2 * int.from_bytes(data[i : i + 4], "little")], "<u2") for i in range(0, len(data), width)]


def query(spark, sf_dir: str) -> DataFrame:
    return written(training_order(documents(spark, sf_dir)), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}")
