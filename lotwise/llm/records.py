"""Operator 10: token ids of documents in length-delimited binary record files.

Documents are dealt out by ranges of doc_id and sorted, each task writes one data file and one index file, and a
manifest table lists the files of successful tasks: files of failed or repeated attempts have other names and are
never read. Files go through pyarrow's file systems, by the URI of the shared folder.

Record: length (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32 of the payload (u32), all
little-endian. A masked checksum is the CRC rotated right by 15 bits plus 0xa282ead8, so that checksums of data that
hold checksums stay sound. The payload is a document's ids, 2 bytes each where the vocabulary allows it, else 4.
The index has a row of INDEX for each record, so that shuffled readers can open any record alone.

Cases: null and empty texts give a record of the end id alone; null ids come first; rows with equal ids all stay,
in the order of their text's hash; an empty table gives no files and no rows.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lotwise.llm.common import saved, scratch, table, tidy

INDEX = np.dtype([("offset", "<u8"), ("bytes", "<u8"), ("start", "<u8"), ("n_tokens", "<u8"), ("is_null", "u1"), ("doc_id", "<i8")])
MANIFEST = "shard int, path string, n_docs long, n_tokens long, width int"
#: entries of a worker's word cache; it starts anew when full
CACHE = 600_000
#: bytes of a record beside its payload
FRAME = 16


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one starts; a wrong checksum is an error."""
    head = data[at : at + 8]
    (length,) = struct.unpack("<Q", head)
    if struct.unpack("<I", data[at + 8 : at + 12])[0] != masked_crc(head):
        raise ValueError(f"length checksum at {at}")
    payload = data[at + 12 : at + 12 + length]
    if struct.unpack("<I", data[at + 12 + length : at + 16 + length])[0] != masked_crc(payload):
        raise ValueError(f"payload checksum at {at}")
    return payload, at + 16 + length


def before(n: np.ndarray) -> np.ndarray:
    """The sum of what stands before each entry."""
    return np.cumsum(n, dtype=np.uint64) - n


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri.removeprefix("file:"))


def byte_letters() -> dict[int, str]:
    """The letters that byte-level models write bytes as: printable Latin-1 as itself, the other bytes from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


class WordEncoder(dict):
    """Encodes texts with the tokenizers library: word -> ids, each white-space-delimited word once while it is held.

    The file's normaliser works on characters and its splitter never crosses white space, so a text's ids are those
    of its words. Words of Latin-1 letters, with one mark after them or none, are what normaliser and splitter leave
    as they are (but for the mark, which the splitter cuts off): they go straight to the library's model, other words
    to the whole library.
    """

    def __init__(self, file: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(file)
        self.model = self.lib.model
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.letters = byte_letters()
        self.marks = {m: self.packed(self.lib.encode(m, add_special_tokens=False).ids) for m in ".,;:!?"}

    def packed(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        """Ids of a word without spaces and newlines, in lower case where its text is Latin-1."""
        mark = self.marks.get(word[-1:], b"")
        low = (word[:-1] if mark else word).lower()
        if low.isalpha() and (low.isascii() or max(word) < "\u0100"):
            low = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
            ids = self.packed([t.id for t in self.model.tokenize(low)]) + mark
        else:
            ids = self.packed(self.lib.encode(word, add_special_tokens=False).ids)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, lowered(text).replace("\n", " ").split(" "))) if text else b""


def lowered(text: str) -> str:
    """Latin-1 texts in lower case, so that forms of a word are one; for others the library's own rule holds."""
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


@lru_cache(maxsize=2)
def word_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def write_records(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id order; returns the manifest, one row per file, itself saved."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, data, n_docs, offset, start = word_encoder(tokenizer), None, 0, 0, 0
        end = enc.packed([end_id])
        for batch in batches:
            if data is None and batch.num_rows:
                system, base = open_fs(folder)
                system.create_dir(base)
                name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
                data, index = (system.open_output_stream(posixpath.join(base, name + kind)) for kind in (".rec", ".idx"))
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                records = [frame(enc.encode(t) + end) for t in part.column(1).to_pylist()]
                if len(enc) > CACHE:
                    enc.clear()
                rows = np.zeros(len(records), INDEX)
                rows["bytes"] = [len(r) for r in records]
                rows["n_tokens"] = (rows["bytes"] - FRAME) // enc.width
                rows["offset"], rows["start"] = offset + before(rows["bytes"]), start + before(rows["n_tokens"])
                ids = part.column(0)
                rows["is_null"], rows["doc_id"] = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                data.write(b"".join(records))
                index.write(rows.tobytes())
                n_docs, offset, start = n_docs + len(rows), offset + int(rows["bytes"].sum()), start + int(rows["n_tokens"].sum())
        if data is not None:
            data.close()
            index.close()
            cols = [[int(name[:6])], [name], [n_docs], [start], [enc.width]]
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["shard", "path", "n_docs", "n_tokens", "width"])

    return saved(dealt.mapInArrow(tidy(run), MANIFEST), "manifest")


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, ids): start counts the ids of all documents before; ids as little-endian u32. Checks every checksum."""
    # a row per file, so this window is small
    at = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.withColumn("base", at).select("path", "base", "width").repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base_dir = open_fs(folder)
        for batch in batches:
            for path, base, width in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(posixpath.join(base_dir, path + ".idx")) as f:
                    index = np.frombuffer(f.read(), INDEX)
                with system.open_input_file(posixpath.join(base_dir, path + ".rec")) as f:
                    for k in range(0, len(index), 500):
                        part = index[k : k + 500]
                        first = int(part["offset"][0])
                        block = f.read_at(int(part["offset"][-1] + part["bytes"][-1]) - first, first)
                        ids = [np.frombuffer(unframe(block, o - first)[0], f"<u{width}").astype("<u4").tobytes() for o in part["offset"].tolist()]
                        yield pa.RecordBatch.from_arrays([
                            pa.array(part["doc_id"], mask=part["is_null"].astype(bool)),
                            pa.array(part["start"].astype(np.int64) + base),
                            pa.array(ids, pa.binary()),
                        ], names=["doc_id", "start", "ids"])

    return files.mapInArrow(tidy(run), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())]))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "records")
    back = read_records(write_records(table(spark, sf_dir, "documents"), folder), folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
