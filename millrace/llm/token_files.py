"""Token files: each document compressed by itself with one shared zstandard dictionary, found by an offset index.

A file holds a header (magic, bytes per id, SHA-256 of the dictionary), one frame per document, an index (null flag,
doc_id, frame offset, number of ids) and a tail (index place, number of documents, magic). The dictionary is a file of its own.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.common import fresh_dir, map_arrow, stored
from millrace.llm.tokens import definition_of, encoder

MAGIC = b"MRTOK1\n\0"
HEADER, TAIL = struct.Struct("<8sB32s"), struct.Struct("<QQ8s")
ENTRY = np.dtype([("null", "u1"), ("doc_id", "<i8"), ("offset", "<u8"), ("n", "<u8")])
LEVEL = 3


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; of too few or too uniform samples, their concatenated ends; of none, no bytes."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


class Writer:
    """Documents of one file, in the order in which they come."""

    def __init__(self, out, width: int, dictionary: bytes):
        import zstandard

        self.out, self.width, self.index = out, width, []
        self.press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        out.write(HEADER.pack(MAGIC, width, hashlib.sha256(dictionary).digest()))
        self.at = HEADER.size

    def add(self, doc_id: int | None, ids: bytes) -> int:
        """`ids`: little-endian unsigned 32-bit. Returns their number."""
        frame = self.press.compress(np.frombuffer(ids, "<u4").astype(f"<u{self.width}").tobytes())
        self.out.write(frame)
        self.index.append((doc_id is None, doc_id or 0, self.at, len(ids) // 4))
        self.at += len(frame)
        return len(ids) // 4

    def close(self) -> None:
        self.out.write(np.array(self.index, dtype=ENTRY).tobytes())
        self.out.write(TAIL.pack(self.at, len(self.index), MAGIC))
        self.out.close()


class Reader:
    """Any document of a file by its number, through the index."""

    def __init__(self, file, dictionary: bytes):
        import zstandard

        self.file = file
        magic, self.width, digest = HEADER.unpack(file.read(HEADER.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or written with another dictionary")
        file.seek(file.size() - TAIL.size)
        self.end, n, _ = TAIL.unpack(file.read(TAIL.size))
        file.seek(self.end)
        self.index = np.frombuffer(file.read(n * ENTRY.itemsize), dtype=ENTRY)
        self.open = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def doc_id(self, i: int) -> int | None:
        return None if self.index["null"][i] else int(self.index["doc_id"][i])

    def ids(self, i: int) -> np.ndarray:
        at = int(self.index["offset"][i])
        to = int(self.index["offset"][i + 1]) if i + 1 < len(self.index) else self.end
        self.file.seek(at)
        raw = self.open.decompress(self.file.read(to - at), max_output_size=int(self.index["n"][i]) * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int = 1, out_dir: str | None = None, samples: int = 512, most_sample: int = 16_384, size: int = 65_536
) -> DataFrame:
    """Encode whole texts and write token files in ascending doc_id order: the manifest (seq, path, n_docs, n_tokens, base, dictionary).

    `tokenizer` is the tokenizer file's path on the driver. Null text is empty; each document ends with `end_id`. Null
    doc_ids come first; equal doc_ids are ordered by a hash of the text. The dictionary is trained on the ids of the `samples`
    documents with the smallest hashes of doc_id, but for those of over `most_sample` characters; nothing else is sampled. Each task writes a file of
    its own name, and only files of tasks that succeeded are in the manifest, so lost executors and repeated tasks leave no
    mark. `base` is the number of ids in all files before. Files are for the folder's owner to delete. Repeated rows are documents each, texts of any length are encoded whole, other
    columns aren't looked at, whatever their names, and an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    out_dir = out_dir or fresh_dir(spark, "tokens")
    definition = spark.sparkContext.broadcast(definition_of(tokenizer))
    end = int(end_id).to_bytes(4, "little")

    def encoded(texts: Iterable[str]) -> Iterator[bytes]:
        return (b + end for b in encoder(definition.value).encode(texts))

    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_str(definition.value).get_vocab_size(), end_id + 1) <= 65_536 else 4
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("__h", F.xxhash64("text"))
    lot = F.xxhash64("doc_id", F.lit("dictionary"))
    drawn = [r[0] for r in docs.select(lot.alias("lot")).orderBy("lot").limit(samples).collect()]
    short = docs.where((lot <= max(drawn, default=0)) & (F.length("text") <= most_sample))
    pick = short.select("text").limit(samples).collect()
    chosen = [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() for b in encoded([r.text for r in pick])]
    raw = train_dictionary(chosen, size)
    files.make_dir(out_dir)
    book = f"{out_dir}/dictionary-{hashlib.sha256(raw).hexdigest()[:16]}"
    with files.write_to(book) as f:
        f.write(raw)
    shared = spark.sparkContext.broadcast(raw)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, path, writer, tokens = TaskContext.get().partitionId(), f"{out_dir}/{uuid.uuid4().hex}.tok", None, 0
        for batch in batches:
            writer = writer or Writer(files.write_to(path), width, shared.value)
            texts = (t.as_py() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts), strict=True):
                tokens += writer.add(doc_id, ids)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"seq": [seq], "path": [path], "n_docs": [len(writer.index)], "n_tokens": [tokens]})

    order = [F.col("doc_id").asc_nulls_first(), F.col("__h")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = stored(map_arrow(spread, write, "seq long, path string, n_docs long, n_tokens long", remembers=True), "manifest")
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("dictionary", F.lit(book))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files in a manifest: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: dict[str, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] not in books:
                    with files.read_from(row["dictionary"]) as f:
                        books[row["dictionary"]] = f.read()
                with files.read_from(row["path"]) as f:
                    reader, start, part, size = Reader(f, books[row["dictionary"]]), row["base"], [], 0
                    for i in range(len(reader)):
                        ids = reader.ids(i)
                        part.append((reader.doc_id(i), start, ids.tobytes()))
                        start, size = start + len(ids), size + ids.nbytes
                        if size >= 1 << 20 or i + 1 == len(reader):
                            d, s, b = zip(*part, strict=True)
                            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(b, pa.binary())], ["doc_id", "start", "ids"])
                            part, size = [], 0

    n = manifest.count()
    return map_arrow(manifest.repartition(max(1, min(n, 20_000))), read, "doc_id long, start long, ids binary")
