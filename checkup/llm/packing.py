"""Operator 6: bounded-space online best-fit packing.

Each document becomes its token ids and one end id. Documents longer than a
sequence are cut into full pieces; the rest are packed whole. A task reads its
pieces once and keeps a fixed number of open sequences, found through a bitset
keyed by free space: the fullest open sequence that still has room takes the
piece; when none has, a new one opens, and past the bound the fullest closes.
Closed sequences are final. The pieces of sequences still open when a task
ends go to the next level, which has fewer tasks; the last level has one task.
Memory per task is the open sequences, whatever the input's size.

Defined results: null and empty texts are the end id alone; repeated rows are
packed each; an empty table gives an empty result; null ids stay null; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkup.llm.chunk_tokenizer import memo_encoder
from checkup.llm.common import ship, text_batches
from checkup.session import new_work_path

CAPACITY = 2048
OPEN_BINS = 1024
ROWS_PER_TASK = 200_000
MEMO_ENTRIES = 400_000     # pieces a worker remembers: its memory is this, whatever the input's size
TEXT_BYTES = 1 << 20       # of texts in Python at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, `offset` long, closed boolean"
_PIECES_PA = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED_PA = _PIECES_PA.append(pa.field("sequence_id", pa.int64())).append(
    pa.field("offset", pa.int64())).append(pa.field("closed", pa.bool_()))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of at most ``capacity`` ids."""
    ship(docs.sparkSession)

    def run(batches):
        encode = memo_encoder(tokenizer_path, "word", "ids", MEMO_ENTRIES)
        end = end_id.to_bytes(4, "little")  # packed ids: four bytes each
        for b in text_batches(batches, TEXT_BYTES):
            cols = ([], [], [], [], [])
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts)):
                ids += end
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    part = ids[4 * at:4 * (at + capacity)]
                    for col, v in zip(cols, (doc_id, k, at, len(part) // 4, zlib.crc32(part))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip(cols, _PIECES_PA)], schema=_PIECES_PA)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text")).mapInArrow(run, PIECES)


class BestFit:
    """Open bins of one task. ``bits`` has bit f set when an open bin has f
    free places; ``bins[f]`` lists those bins."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.n_open = 0, {}, 0

    def _take(self, free: int):
        stack = self.bins[free]
        b = stack.pop()
        if not stack:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return b

    def place(self, length: int, item) -> list:
        """Put ``item`` away; the bins that closed by it (lists of items)."""
        room = self.bits >> length
        if room:
            free = length + (room & -room).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, []
        bin_.append(item)
        free -= length
        if free == 0:
            return [bin_]
        self.bins.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.n_open += 1
        if self.n_open > self.open_bins:  # the fullest closes first
            return [self._take((self.bits & -self.bits).bit_length() - 1)]
        return []

    def rest(self):
        for free in sorted(self.bins):
            yield from self.bins[free]


def _place_task(level: int, last: bool, capacity: int, open_bins: int, chunk: int = 50_000):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        fit, out, n_bins = BestFit(capacity, open_bins), [], 0

        def emit(bin_, closed):
            nonlocal n_bins
            sequence, offset = (level << 56) | (part << 32) | n_bins, 0
            n_bins += 1
            for item in bin_:
                out.append((*item, sequence, offset, closed))
                offset += item[3]

        def flush():
            cols = list(zip(*out)) or [()] * len(_PLACED_PA)
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(c), f.type) for c, f in zip(cols, _PLACED_PA)], schema=_PLACED_PA)

        for b in batches:
            for item in zip(*(b.column(n).to_pylist() for n in _PIECES_PA.names)):
                for bin_ in fit.place(item[3], item):
                    emit(bin_, True)
                if len(out) >= chunk:
                    yield flush()
        for bin_ in fit.rest():
            emit(bin_, last)
            if len(out) >= chunk:
                yield flush()
        yield flush()

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS,
         rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    ship(spark)
    work = new_work_path(spark, "packing")
    pieces.write.parquet(f"{work}/pieces")
    level, source, parts = 0, spark.read.schema(PIECES).parquet(f"{work}/pieces"), []
    count, n_tasks = source.count(), None
    while True:
        # at least half as many tasks on each level, so that the levels end
        wanted = max(1, -(-count // rows_per_task))
        n_tasks = wanted if n_tasks is None else max(1, min(wanted, n_tasks // 2))
        last = n_tasks == 1
        df = source.coalesce(n_tasks)  # joins the files' splits, without a shuffle
        path = f"{work}/level{level}"
        df.mapInArrow(_place_task(level, last, capacity, open_bins), PLACED).write.parquet(path)
        placed = spark.read.schema(PLACED).parquet(path)
        parts.append(placed.where("closed").drop("closed"))
        if last:
            break
        source = placed.where("NOT closed").select(*_PIECES_PA.names)
        count, level = source.count(), level + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY,
                   open_bins: int = OPEN_BINS, rows_per_task: int = ROWS_PER_TASK, **cols) -> DataFrame:
    return pack(token_pieces(docs, tokenizer_path, capacity, **cols), capacity, open_bins, rows_per_task)
