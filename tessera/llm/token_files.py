"""Token ids of documents as binary files: frequency-ranked ids in byte-aligned codes, with their lengths in control bytes of their own.

A folder holds `vocab.bin` (little-endian unsigned 32-bit ids, the commonest first), shard files, and `manifest`, a Parquet table with one row
for each shard (shard, file, docs, ids, bytes). Documents are in ascending order of their id within a shard and from shard to shard. A shard
is a sequence of chunks of whole documents:

    header   "<4sIQQQ": magic TKR1, bits of a length code (1 or 2), documents, control bytes, data bytes
    ids      int64 for each document, and one byte each: 1 where the id is null
    lengths  uint64 for each document: its number of token ids
    control  a length code for each id (its bytes less one), 8 or 4 to a byte, the first in the lowest bits
    data     the rank of each id, little-endian, in as many bytes as its code says

Ids are written by their rank, so the 256 commonest take one byte. Each document fills whole control bytes: ranks of 0 pad it to a multiple of
8 or 4, so that a chunk is decoded at once: a table of 256 rows gives the lengths that a control byte holds.

Only committed files count: a task writes under a name of its own and returns it; the manifest that Spark commits names one file for each
shard. What a lost or repeated task has left is named nowhere.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from tessera.llm.common import checkpoint_dir, map_texts

MAGIC, HEADER = b"TKR1", struct.Struct("<4sIQQQ")
#: LENGTHS[bits][control byte]: the bytes of each of the 8 or 4 ids that the control byte speaks of.
LENGTHS = {bits: ((np.arange(256)[:, None] >> (bits * np.arange(8 // bits))) & ((1 << bits) - 1)).astype(np.uint8) + 1 for bits in (1, 2)}
#: Ids of a chunk, after which it is written (a document is never cut, so one document may be more).
CHUNK_IDS = 1_000_000

# Letters, digits and white space up to U+017F, which every version of Unicode agrees on, for the pattern that the byte-level pre-tokenizer
# splits by (a fixed value). Texts with further characters, some punctuation aside, are encoded whole by the library.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = r"\t-\r \x85\xa0"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile(r"[^\x00-\x7f\x85\xa0-ſ‐-‧]")
#: Spaces that don't begin a word, as white space follows them (or the text ends).
_LONE_SPACES = tuple(f" {c}" for c in " \n\t\r\v\f\x85\xa0")


class _Kept(dict):
    """Values by key, made where they are missing; the first `most` keys of at most 64 characters are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most = make, most

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.most and len(key) <= 64:
            self[key] = value
        return value


class Encoder:
    """Ids of whole texts by the tokenizers library, as little-endian bytes of `width` 2 or 4.

    Strings of special tokens in a text are ordinary text. Where the file's pre-tokenizer is the byte-level one, whose pieces merges never
    cross, texts are split into the same pieces here and the library's model merges each once: what it gives for a piece, and for a word with the
    space before it, is kept. The ids are the library's for the whole text; texts that can't be split so are encoded whole.
    """

    def __init__(self, path: str, most: int = 650_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.width = 2 if self.lib.get_vocab_size() <= 1 << 16 else 4
        self.kind = "H" if self.width == 2 else "I"
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        before = told.get("pre_tokenizer") or {}
        self.in_pieces = (
            before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not told.get("normalizer")
            and told["model"].get("type") == "BPE" and not told["model"].get("dropout") and all(t["special"] for t in told.get("added_tokens", []))
        )
        # the byte-level alphabet: bytes that print stand for themselves, the others for the characters from U+0100 on (a fixed rule)
        printed = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.alphabet = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in printed)}
        self.model, self.space = self.lib.model, chr(self.alphabet[32])
        self.pieces = _Kept(self.merged, most)
        self.spaced = _Kept(lambda word: self.split(" " + word), most)

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.lib.encode(text, add_special_tokens=False).ids).tobytes()

    def merged(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        if word.isascii() and word.isalnum():  # the common case of the alphabet: the space alone is written otherwise
            piece = self.space + word if len(word) < len(piece) else piece
        else:
            piece = piece.encode().decode("latin-1").translate(self.alphabet)
        return array(self.kind, [t.id for t in self.model.tokenize(piece)]).tobytes()

    def split(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(text)))

    def __call__(self, text: str) -> bytes:
        if not self.in_pieces or not text.isascii() and _OTHER.search(text):
            return self.whole(text)
        if text.endswith(" ") or any(x in text for x in _LONE_SPACES):
            return self.split(text)
        first, *rest = text.split(" ")
        return b"".join([self.split(first), *map(self.spaced.__getitem__, rest)])


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python worker, which Spark uses for many tasks."""
    return Encoder(path)


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """(control, data) of the ranks of one document."""
    per = 8 // bits
    ranks = np.concatenate([ranks, np.zeros(-len(ranks) % per, ranks.dtype)]).astype(np.uint32)
    size = np.ones(len(ranks), np.int64)
    for k in range(1, 1 << bits):
        size += ranks >= 1 << (8 * k)
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = ranks & 255
    for k in range(1, 1 << bits):
        longer = size > k
        data[at[longer] + k] = (ranks[longer] >> (8 * k)) & 255
    control = ((size - 1).reshape(-1, per) << (bits * np.arange(per))).sum(axis=1).astype(np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, bits: int) -> np.ndarray:
    """Ranks of all documents of a chunk, with those that pad them."""
    size = LENGTHS[bits][np.frombuffer(control, np.uint8)].ravel()
    at = np.cumsum(size, dtype=np.int64) - size
    given = np.frombuffer(data, np.uint8)
    ranks = given[at].astype(np.uint32)
    for k in range(1, 1 << bits):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= given[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def chunk_bytes(doc_ids: list[int | None], lengths: list[int], control: bytes, data: bytes, bits: int) -> bytes:
    head = HEADER.pack(MAGIC, bits, len(doc_ids), len(control), len(data))
    nulls = bytes(d is None for d in doc_ids)
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), nulls, np.array(lengths, "<u8").tobytes(), control, data])


def read_chunks(file, vocab: np.ndarray) -> Iterator[tuple[list[int | None], np.ndarray, list[np.ndarray]]]:
    """(document ids, lengths, ids of each document) of each chunk of an open file."""
    while head := file.read(HEADER.size):
        magic, bits, n, n_control, n_data = HEADER.unpack(head)
        if magic != MAGIC:
            raise ValueError("no chunk of token ids begins here")
        ids, nulls, lengths = np.frombuffer(file.read(8 * n), "<i8").tolist(), file.read(n), np.frombuffer(file.read(8 * n), "<u8").astype(np.int64)
        found = vocab[unpack(file.read(n_control), file.read(n_data), bits)]
        padded = lengths + -lengths % (8 // bits)
        starts = np.cumsum(padded) - padded
        yield [None if nulls[k] else ids[k] for k in range(n)], lengths, [found[s : s + m] for s, m in zip(starts, lengths, strict=True)]


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, ids) of every whole text, `end_id` behind its ids; ids are little-endian unsigned integers of 2 bytes where the vocabulary
    has at most 65,536 entries, else of 4. Null texts are empty: they have the end id alone."""

    def run(texts: list[bytes | None]) -> Iterator[pa.Array]:
        encode = encoder(tokenizer)
        end = array(encode.kind, [end_id]).tobytes()
        ids = [encode((t or b"").decode("utf-8", "replace")) + end for t in texts]
        yield pa.array([len(x) // encode.width for x in ids], pa.int64())
        yield pa.array(ids, pa.binary())

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(own, "text", ["doc_id"], [T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())], run)


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """(id, n) over all documents. Each task counts into one array of the vocabulary's size before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for value in batch.column(0):
                own = np.bincount(np.frombuffer(value.as_buffer(), f"<u{width}"), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    return tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = 16_000_000) -> None:
    """Encode every whole text and write all ids to shard files of about `shard_ids` ids each, in ascending order of `id_col`.

    tokenizer: path of a file of the tokenizers library, there on every executor. Null texts are empty; null ids come first; rows of equal id
    are all written, in an order that reruns repeat. An empty table gives a folder without shards. The texts are encoded once: the ids are
    kept as Parquet in the folder until they have been counted and written. Beside counts of ids, of which there are as many as the
    vocabulary has entries, nothing reaches the driver; one exchange brings the documents' ids into order, and the task that codes them writes them.
    """
    spark = docs.sparkSession
    width = Encoder(tokenizer).width
    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root)
    token_ids(docs, tokenizer, end_id, id_col, text_col).write.option("compression", "zstd").parquet(f"{folder}/ids")
    tokens = spark.read.parquet(f"{folder}/ids")
    counts = id_counts(tokens, width).toArrow().to_pydict()
    ids, n = np.array(counts["id"], np.int64), np.array(counts["n"], np.int64)
    vocab = ids[np.lexsort((ids, -n))].astype("<u4")
    with system.open_output_stream(f"{root}/vocab.bin") as out:
        out.write(vocab.tobytes())
    rank = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank[vocab] = np.arange(len(vocab))
    bits = 1 if len(vocab) <= 1 << 16 else 2

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, at = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name, docs_, ids_, bytes_ = f"shard-{shard:06d}-{uuid.uuid4().hex}.bin", 0, 0, 0
        out, held, held_ids = None, ([], [], [], []), 0
        for batch in batches:
            out = out or target.open_output_stream(f"{at}/{name}")
            for doc_id, length, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                control, data = pack(rank[np.frombuffer(ids.as_buffer(), f"<u{width}")], bits)
                for part, value in zip(held, (doc_id, length, control, data), strict=True):
                    part.append(value)
                held_ids, docs_, ids_ = held_ids + length, docs_ + 1, ids_ + length
                if held_ids >= CHUNK_IDS:
                    bytes_ += out.write(chunk_bytes(held[0], held[1], b"".join(held[2]), b"".join(held[3]), bits))
                    held, held_ids = ([], [], [], []), 0
        if out:
            if held[0]:
                bytes_ += out.write(chunk_bytes(held[0], held[1], b"".join(held[2]), b"".join(held[3]), bits))
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "file": name, "docs": docs_, "ids": ids_, "bytes": bytes_}], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    # rows of equal id are told apart by a checksum, and equal rows by where they stand in the written table, so that no id is one task's
    keyed = tokens.select("doc_id", (F.crc32("ids") * (1 << 31) + F.monotonically_increasing_id() % (1 << 31)).alias("place"), "n", "ids")
    shards = max(1, -(-int(n.sum()) // shard_ids))
    ordered = keyed.repartitionByRange(shards, "doc_id", "place").sortWithinPartitions("doc_id", "place")
    ordered.select("doc_id", "n", "ids").mapInArrow(written, "shard int, file string, docs long, ids long, bytes long").write.parquet(f"{folder}/manifest")
    system.delete_dir(f"{root}/ids")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of a folder that `write_token_files` wrote.

    start is the number of ids of all documents before it; ids are little-endian unsigned 32-bit integers. A task reads a shard chunk by chunk.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("file", before.alias("start")).repartition(max(1, manifest.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        vocab = None
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if vocab is None:
                    with system.open_input_stream(f"{root}/vocab.bin") as file:
                        vocab = np.frombuffer(file.read(), "<u4")
                with system.open_input_stream(f"{root}/{name}") as file:
                    for ids, lengths, found in read_chunks(file, vocab):
                        starts = start + np.cumsum(lengths) - lengths
                        start += int(lengths.sum())
                        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def through_files(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """What `read_token_files` gives of documents written to a folder of their own beside the session's checkpoints."""
    spark = docs.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    write_token_files(docs, folder, tokenizer, end_id)
    return read_token_files(spark, folder)
