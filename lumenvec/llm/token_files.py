"""Token-id output in Arrow files of equal-length sequences.

The ids of all documents, each ended by ``end_id``, are one stream in
ascending doc_id order. It is dealt to files by ranges of doc_id. A file holds
its part of the stream as sequences of ``length`` ids: fixed-size-list columns
``ids`` and ``mask`` (false: padding, only at the very end of a file), in
record batches of ``rows`` sequences, so sequence i is row i % rows of batch
i // rows and is read by mapping the file: ids and the mask's bits are views of
it, nothing is copied. The list column
``docs`` has (doc_id, at) for each document that begins in a sequence. Ids take
16 bits where the vocabulary allows it.

A task writes its file under a name of its own and reports it; the list of
reported files is written as a table, so what a lost or repeated task left
behind is never read. The folder must be one that all executors share and
that pyarrow opens; the default is in ``spark.checkpoint.dir``. A name without a
scheme means the default file system, as everywhere in Spark: the driver makes
it whole once.

Defined results: a null or empty text is its end id alone; a null doc_id comes
first; rows with equal doc_id follow each other in the order of their text; an
empty table gives no file and no row; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenvec.llm.encoding import encoder
from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package, work_dir

LENGTH = 2048
ROWS = 64


def arrow_schema(length: int, bits: int):
    import pyarrow as pa

    ids = pa.uint16() if bits <= 16 else pa.uint32()
    docs = pa.list_(pa.struct([("doc_id", pa.int64()), ("at", pa.int32())]))
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length)), ("docs", docs)])


class SequenceWriter:
    """Writes one file; memory holds the sequences of one record batch."""

    def __init__(self, sink, length: int = LENGTH, rows: int = ROWS, bits: int = 32) -> None:
        import numpy as np
        import pyarrow as pa

        self.schema, self.length, self.rows = arrow_schema(length, bits), length, rows
        self.kind = np.uint16 if bits <= 16 else np.uint32
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list = []
        self.n_held = self.n_tokens = self.n_docs = 0
        self.starts: list[tuple[int | None, int]] = []  # of documents, from the held ids' start

    def add(self, doc_id: int | None, ids) -> None:
        """Appends one document's ids."""
        self.starts.append((doc_id, self.n_held))
        self.held.append(ids.astype(self.kind))
        self.n_held += len(ids)
        self.n_tokens += len(ids)
        self.n_docs += 1
        if self.n_held >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        flat, per = np.concatenate(self.held) if self.held else np.zeros(0, self.kind), self.length * self.rows
        while len(flat) >= per or last and len(flat):
            self._batch(flat[:per])
            flat = flat[per:]
            self.starts = [(d, at - per) for d, at in self.starts if at >= per]
        self.held, self.n_held = [flat], len(flat)

    def _batch(self, flat) -> None:
        import numpy as np
        import pyarrow as pa

        n, length = -(-len(flat) // self.length), self.length
        ids = np.zeros(n * length, self.kind)
        ids[: len(flat)] = flat
        docs: list[list[dict]] = [[] for _ in range(n)]
        for d, at in self.starts:
            if at < len(flat):
                docs[at // length].append({"doc_id": d, "at": at % length})
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
            pa.FixedSizeListArray.from_arrays(pa.array(np.arange(n * length) < len(flat)), length),
            pa.array(docs, self.schema.field("docs").type),
        ]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        self._flush(True)
        self.out.close()


class SequenceReader:
    """Random access to the sequences of one file."""

    def __init__(self, path: str) -> None:
        import pyarrow as pa
        from pyarrow import fs

        files, inner = fs.FileSystem.from_uri(path)
        source = pa.memory_map(inner) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(inner)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.rows = self.file.get_batch(0).num_rows if self.file.num_record_batches else 0
        self.held: tuple = (-1, None, None, None)  # the batch last read

    def __len__(self) -> int:
        n = self.file.num_record_batches
        return 0 if not n else (n - 1) * self.rows + self.file.get_batch(n - 1).num_rows

    def sequence(self, i: int):
        """(ids, mask) of sequence i, both views of the file: the mask as its bits, 8 to a byte
        with the first in the lowest (``unpacked`` spreads them)."""
        import numpy as np

        k = i % self.rows
        if self.held[0] != i // self.rows:
            b = self.file.get_batch(i // self.rows)
            bits = b.column(1).values.buffers()[1]
            self.held = (i // self.rows, b.column(0).values.to_numpy(), np.frombuffer(bits, np.uint8), b.column(2))
        _, ids, bits, _ = self.held
        if self.length % 8:  # such sequences share a byte with their neighbours
            whole = np.unpackbits(bits, bitorder="little")[k * self.length : (k + 1) * self.length]
            return ids[k * self.length : (k + 1) * self.length], np.packbits(whole, bitorder="little")
        return ids[k * self.length : (k + 1) * self.length], bits[k * self.length // 8 : (k + 1) * self.length // 8]

    def starts(self, i: int) -> list[dict]:
        """The documents that begin in sequence i: doc_id, and where."""
        self.sequence(i)
        return self.held[3][i % self.rows].as_py()

    def documents(self) -> Iterator[tuple[int | None, int, "object"]]:
        """(doc_id, start, ids) of each document, start in the file's stream, sequence by sequence."""
        import numpy as np

        doc, begun, held = None, None, []
        for i in range(len(self)):
            ids, mask = self.sequence(i)
            last = 0
            for x in self.starts(i):
                held.append(ids[last : x["at"]])
                if begun is not None:
                    yield doc, begun, np.concatenate(held)
                doc, begun, held, last = x["doc_id"], i * self.length + x["at"], [], x["at"]
            held.append(ids[last : int(np.bitwise_count(mask).sum())])
        if begun is not None:
            yield doc, begun, np.concatenate(held)


def unpacked(mask, length: int):
    """A mask's bits as booleans."""
    import numpy as np

    return np.unpackbits(mask, count=length, bitorder="little").view(bool)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark gives it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    whole = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def write(docs: DataFrame, path: str, folder: str | None = None, text: str = "text", key: str = "doc_id",
          end_id: int = 0, length: int = LENGTH, rows: int = ROWS) -> DataFrame:
    """Writes the files; returns their list: (part, file, n_docs, n_tokens), a row a file."""
    spark = docs.sparkSession
    ship_package(spark)
    folder = qualified(spark, folder or work_dir(spark, f"token-files-{uuid.uuid4().hex}"))
    lean = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    # Spread by range, so that files follow each other in doc_id order.
    dealt = lean.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()
    )

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        enc, out, name = encoder(path), None, ""
        bits = 16 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 32
        end = np.array([end_id], "<u4")
        part = TaskContext.get().partitionId()
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if out is None:
                    files, inner = fs.FileSystem.from_uri(folder)
                    files.create_dir(inner, recursive=True)
                    name = f"part-{part:06d}-{uuid.uuid4().hex}.arrow"
                    sink = files.open_output_stream(f"{inner}/{name}")
                    out = SequenceWriter(sink, length, rows, bits)
                out.add(d, np.concatenate((np.frombuffer(enc.ids(t), "<u4"), end)))
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [out.n_docs], "n_tokens": [out.n_tokens]}
            )

    return materialize(dealt.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "token-file-list")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the listed files alone."""
    ship_package(files.sparkSession)
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    listed = files.withColumn("base", F.coalesce(before, F.lit(0))).select("file", "base")

    def run(batches: Iterator) -> Iterator:
        import zlib

        import pyarrow as pa

        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, out = SequenceReader(name).documents(), []
                for d, at, ids in found:
                    out.append((d, base + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield to_batch(out)
                        out = []
                if out:
                    yield to_batch(out)

    def to_batch(rows: list[tuple]):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"]
        )

    # A file a task, as near as dealing rows one by one gets.
    n = max(1, files.count())
    return listed.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
