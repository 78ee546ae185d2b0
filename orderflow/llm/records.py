"""Token ids in length-delimited binary shards, and an offset index to read them in any order.

A frame is: length of the payload (u64), masked checksum of those 8 bytes (u32), payload, masked checksum of the
payload (u32), and one line feed. A payload is: flags (u8: 1 if the id is null), bytes for each token id (u8),
document id (i64), token ids; all little-endian. Checksums are CRC-32, rotated and shifted by a constant so that a
checksum of data which holds checksums stays sound.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import shuffle_partitions
from .text import is_space, raw, slices, word_spans

SLICE_BYTES = 4 << 20
SHARD_BYTES = 256 << 20
CACHED_WORDS = 150_000
JOINED = 500
#: Fixed value: how a pre-tokenizer that parts letters, digits and other marks says so.
PARTING = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: 1: ASCII letters and digits; 2: marks that are no part of a contraction or a special token.
_SIDES = np.zeros(256, np.uint8)
_SIDES[[c for c in range(128) if chr(c).isalnum()]] = 1
_SIDES[[ord(c) for c in ".,;:!?#*$%&()[]{}\"/\\+=@^_~-`"]] = 2
_MASK = 0xA282EAD8


def _mask(crc: int) -> int:
    return ((crc >> 15 | crc << 17 & 0xFFFFFFFF) + _MASK) & 0xFFFFFFFF


def masked(data: bytes) -> int:
    return _mask(zlib.crc32(data))


def frame(doc_id: int | None, width: int, ids: bytes) -> bytes:
    payload = struct.pack("<BBq", doc_id is None, width, doc_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def frames(content: bytes | memoryview) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """Offset, length, document id and token ids of each frame; ValueError where a checksum doesn't hold."""
    at, end, crc = 0, len(content), zlib.crc32
    head, tail, top = struct.Struct("<QI").unpack_from, struct.Struct("<I").unpack_from, struct.Struct("<BBq").unpack_from
    while at < end:
        size, check = head(content, at)
        payload = content[at + 12 : at + 12 + size]
        if check != _mask(crc(content[at : at + 8])) or tail(content, at + 12 + size)[0] != _mask(crc(payload)):
            raise ValueError(f"damaged record at byte {at}")
        null, width, doc_id = top(payload)
        yield at, size + 16, None if null else doc_id, np.frombuffer(payload, "<u2" if width == 2 else "<u4", offset=10).astype("<u4")
        at += size + 17


class _Words:
    """Ids of words, as bytes: the library encodes new words in batches; what is known serves all tasks of a worker.

    Two generations are kept: once the younger is full it becomes the older, and words still met move over, so that
    frequent words stay and memory is bounded. A special token between the words of a batch parts their ids.
    """

    def __init__(self, tokenizer: str, width: int):
        self.tokenizer, self.width, self.library = tokenizer, width, None
        self.parts = any(x.get("pattern", {}).get("Regex") == PARTING for x in (json.loads(tokenizer).get("pre_tokenizer") or {}).get("pretokenizers", []))
        self.old: dict[bytes, bytes] = {}
        self.new: dict[bytes, bytes] = {}

    def __reduce__(self):
        return _Words, (self.tokenizer, self.width)

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of these different words."""
        found = list(map(self.new.get, words))
        lack = []
        for i in [i for i, x in enumerate(found) if x is None]:
            x = self.old.get(words[i])
            if x is None:
                lack.append(i)
            else:
                found[i] = self.new[words[i]] = x
        for i, x in zip(lack, self.encode([words[i] for i in lack])):
            found[i] = self.new[words[i]] = x
        if len(self.new) > CACHED_WORDS:
            self.old, self.new = self.new, {}
        return found

    def encode(self, words: list[bytes]) -> list[bytes]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.tokenizer)
            added = self.library.get_added_tokens_decoder()
            special = {x.content: i for i, x in added.items() if x.special}
            self.between, self.mark = next(iter(special.items()), ("", -1))
            self.heads = {x.content.encode()[:1] for x in added.values()}
            suffix = json.loads(self.tokenizer)["model"].get("end_of_word_suffix") if self.parts else None
            self.ends = np.array([i for t, i in self.library.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)], np.int64)
            self.last = np.zeros(max([*self.library.get_vocab().values(), 0]) + 1, bool)
            self.last[self.ends] = True
        said = [w.decode(errors="replace") for w in words]
        found: list[bytes | None] = [None] * len(words)
        letters = [i for i, x in enumerate(said) if x.isalpha()] if len(self.ends) else []
        self.joined(said, letters, found, " ")
        rest = [i for i, x in enumerate(found) if x is None]
        plain = [i for i in rest if self.between and not any(h in words[i] for h in self.heads)]
        self.joined(said, plain, found, self.between)
        rest = [i for i in rest if found[i] is None]
        for begin in range(0, len(rest), JOINED):
            some = rest[begin : begin + JOINED]
            for i, x in zip(some, self.library.encode_batch_fast([said[i] for i in some], add_special_tokens=False)):
                found[i] = np.array(x.ids, f"<u{self.width}").tobytes()
        return found

    def joined(self, said: list[str], which: list[int], found: list[bytes | None], between: str) -> None:
        """Encodes some words as one text: a space between words of letters, which end in a token that ends a word, else a special token.

        Words whose ids aren't told apart so are left for another way.
        """
        size = self.width
        for begin in range(0, len(which), JOINED):
            some = which[begin : begin + JOINED]
            ids = np.array(self.library.encode_batch_fast([between.join([said[i] for i in some])], add_special_tokens=False)[0].ids, np.int64)
            if between == " ":
                ends = np.flatnonzero(self.last[ids]) + 1
                starts = np.concatenate([[0], ends[:-1]])
            else:
                at = np.flatnonzero(ids == self.mark)
                ends, starts = np.concatenate([at, [len(ids)]]), np.concatenate([[0], at + 1])
            if len(ends) != len(some):
                continue
            flat = ids.astype(f"<u{size}").tobytes()
            for i, a, b in zip(some, (starts * size).tolist(), (ends * size).tolist()):
                found[i] = flat[a:b]


def encoded(column: pa.Array, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a column, one after another, and where each text's begin. Each different word is looked up once.

    Where the tokenizer parts letters from marks, a word is cut between them, which leaves fewer different ones.
    """
    data, offsets = raw(column)
    starts, ends, rows = word_spans(data, offsets)
    if known.parts and len(data):
        side = _SIDES[data]
        inner = np.flatnonzero(side[1:] + side[:-1] == 3) + 1
        inner = np.setdiff1d(inner, offsets, assume_unique=False)
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
        rows = np.searchsorted(starts, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    ink = np.ascontiguousarray(data[~is_space(data)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(ink)]).dictionary_encode()
    found = known.ids(words.dictionary.to_pylist())
    n = np.fromiter(map(len, found), np.int64, len(found)) // known.width
    flat, begin = np.frombuffer(b"".join(found), f"<u{known.width}"), np.cumsum(n) - n
    word = words.indices.to_numpy(zero_copy_only=False)
    sizes = n[word]
    total = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=total[1:])
    place = np.repeat(begin[word] - total[:-1], sizes)
    place += np.arange(total[-1])
    return flat[place], total[rows]


def sent_words(spark: SparkSession, tokenizer: str, end_id: int) -> Broadcast[_Words]:
    """What tasks need to encode; it holds the words known to each worker until it is destroyed."""
    said = json.loads(tokenizer)
    highest = max([end_id, *said["model"]["vocab"].values(), *(x["id"] for x in said.get("added_tokens", []))])
    return spark.sparkContext.broadcast(_Words(tokenizer, 2 if highest < 1 << 16 else 4))


def encode_frames(docs: DataFrame, sent: Broadcast[_Words], end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, frame. sent: of a tokenizer that drops white space and lets no token span it.

    ASCII white space parts a text into words that the library encodes on their own, unchanged, which for such a
    tokenizer gives the ids of the whole text. Null texts are empty; end_id follows each text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known = sent.value
        width, end = known.width, np.array([end_id], f"<u{known.width}").tobytes()
        for batch in slices(batches, "__text", SLICE_BYTES):
            ids, bounds = encoded(batch.column("__text"), known)
            flat, edge = ids.tobytes(), (bounds * width).tolist()
            found = [frame(i, width, flat[a:b] + end) for i, a, b in zip(batch.column("doc_id").to_pylist(), edge, edge[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["doc_id", "frame"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("__text")).mapInArrow(run, "doc_id long, frame binary")


def write_records(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_bytes: int = SHARD_BYTES) -> None:
    """Frames in ascending doc_id order (null first, ties by their texts), in shards of about shard_bytes of text.

    There are as many shards as shuffle partitions at least. Ranges are found by id and a hash of the text, so that no
    text comes to the driver, and texts are dealt before they are encoded, as finding the ranges reads them once more.
    Shards are written by Spark's text writer, which puts a row's bytes and a line feed, so that any file system and
    Spark's commit of task output serve; a lost executor's shard is written again.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(shuffle_partitions(docs.sparkSession), -(-size // shard_bytes))
    ordered = texts.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id"), F.xxhash64("text"), "text")
    sent = sent_words(docs.sparkSession, tokenizer, end_id)
    encode_frames(ordered, sent, end_id).select(F.col("frame").cast("string").alias("value")).write.text(path)
    sent.destroy()


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.regexp_extract("path", r"(part-[^/]*)$", 1).alias("shard"), "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """shard, offset, length, doc_id, first (ids before it in its shard), n_ids, ids (binary, u32 little-endian).

    Every checksum is proved. A shard is read as a whole, which its size bounds.
    """
    names = ["shard", "offset", "length", "doc_id", "first", "n_ids", "ids"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows, first, held = [], 0, 0
                for offset, length, doc_id, ids in frames(memoryview(content.as_buffer())):
                    rows.append((shard, offset, length, doc_id, first, len(ids), ids.tobytes()))
                    first, held = first + len(ids), held + length
                    if held > SLICE_BYTES:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return _files(spark, path).mapInArrow(run, "shard string, offset long, length long, doc_id long, first long, n_ids long, ids binary")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The offset index of the shards in path, written to index: where each record lies, its ids' number and CRC-32."""
    names = ["shard", "offset", "length", "doc_id", "first", "n_ids", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column("shard").to_pylist(), batch.column("content")):
                rows = [(offset, length, doc_id, len(ids), zlib.crc32(ids)) for offset, length, doc_id, ids in frames(memoryview(content.as_buffer()))]
                offset, length, doc_id, n, crc = (pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [()] * 5))
                first = np.cumsum(n.to_numpy()) - n.to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([shard] * len(rows), pa.string()), offset, length, doc_id, pa.array(first, pa.int64()), n, crc], names=names)

    _files(spark, path).mapInArrow(run, "shard string, offset long, length long, doc_id long, first long, n_ids long, ids_crc32 long").write.parquet(index)
    return spark.read.parquet(index)


def read_at(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """doc_id, ids (array<int>) of the wanted rows of an index (shard, offset, length), whatever their order.

    Where executors can open the path's file system themselves, a task opens a shard, seeks to each record and reads
    no more; in other stores whole shards are read by Spark. Rows that are wanted twice are given twice.
    """
    from pyarrow import fs

    place = re.sub("^file:/+", "/", path)
    rows = wanted.select("shard", "offset", "length")
    try:
        fs.FileSystem.from_uri(place)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        content = F.substring("content", F.col("offset").cast("int") + 1, F.col("length").cast("int") + 1)
        cells = _files(spark, path).join(rows, "shard").select(content.alias("content"))
        return cells.mapInArrow(_single, "doc_id long, ids array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(place)
        shard, file = None, None
        for batch in batches:
            content = []
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    shard, file = r["shard"], store.open_input_file(f"{root}/{r['shard']}")
                content.append(file.read_at(r["length"] + 1, r["offset"]))
            yield from _single([pa.RecordBatch.from_arrays([pa.array(content, pa.binary())], names=["content"])])

    return rows.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, "doc_id long, ids array<int>")


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [next(frames(memoryview(c.as_buffer()))) for c in batch.column("content")]
        yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in found], pa.int64()), pa.array([x[3].astype(np.int32) for x in found], pa.list_(pa.int32()))], names=["doc_id", "ids"])


def record_table(docs: DataFrame, tokenizer: str, end_id: int, path: str) -> DataFrame:
    """Writes docs to path and its index beside it; doc_id, start, n_tokens, ids_crc32 as read back from the files.

    Null texts are empty; rows with a null doc_id come first; repeated rows stay; further columns are left out. An
    empty table gives no rows. The running sum over shards is one row a shard.
    """
    spark = docs.sparkSession
    write_records(docs, tokenizer, end_id, path)
    index = write_index(spark, path, f"{path}-index")
    number = F.regexp_extract("shard", r"^part-(\d+)", 1).cast("long")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn("number", number)
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("number").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return index.join(shards, "shard").select("doc_id", (F.col("before") + F.col("first")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
