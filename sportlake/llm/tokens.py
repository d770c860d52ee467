"""Token ids in a binary format of static rANS blocks.

Documents are ordered by doc_id over range partitions. A partition tokenises its documents into shards of a few million
ids. Each shard has one frequency table, shared by its blocks, and every block of whole documents is coded on its own by
interleaved range asymmetric numeral systems: lane k of n holds ids k, k + n, k + 2n, ... of the block. A block carries
checkpoints (lane states and word position at every 2**k-th step), from which decoding may start, and a CRC-32 of its ids.

File format: Parquet rows, one per shard: part, shard, first_id and n_ids within the part, table, and the blocks with first_id,
doc_ids, lengths, payload and crc32. Payloads are little-endian: a table is n:u32, then n symbols u32, then n frequencies u32 that add up to
2**SCALE; a block is lanes:u32, ids:u32, words:u32, checkpoints:u32, then for each checkpoint step:u32, position:u32 and lane
states u64, then the words u32. Checkpoint 0 is at step 0 and so starts the block.

Nulls, ties and odd rows: a null text is empty and gives only the end id; rows with a null id come first; rows that share an
id follow one another, in the order of a hash of their texts. Further columns are ignored. An empty table gives no rows. A long document makes a long block, held whole in one task.
"""

from __future__ import annotations

import gc
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sportlake.llm.common import documents, mapped, text_of, written

END = 2
SHARD_IDS = 2_000_000
BLOCK_IDS = 524_288
STEPS = 512
SCALE = 20
LOW = np.uint64(1 << 31)
WORD_BITS = np.uint64(32)
FILE = "part int, shard int, first_id long, n_ids long, table binary, blocks array<struct<first_id:long,doc_ids:array<long>,lengths:array<long>,payload:binary,crc32:long>>"


# --- tokenising -------------------------------------------------------------------------------------------------------

#: A letter, ASCII marks other than an apostrophe, and a space: the pre-tokeniser always cuts between the letter and the marks.
MARKS = re.compile(rb"(?<=[a-z\xdf-\xf6\xf8-\xff])([!-&(-/:-@\[-^`{-~]+)(?=[ \t\r\x0b\x0c]|$)")
#: Latin-1 in lower case, and a line feed as a space.
LOWER = bytes(ord(chr(b).lower()) if b != 10 else 32 for b in range(256))
#: Latin-1 letters, digits, space, comma, full stop.
PLAIN = "".join(c for c in map(chr, range(256)) if c.isalpha() or c.isascii() and c.isdigit() or c in " ,.").encode("latin-1")


class Pieces(dict):
    """Ids, as bytes, of text between spaces. At most `most` pieces are remembered; beyond that they are looked up anew each time.

    The tokeniser drops white space, never joins what it separates, and lower-cases; in Latin-1 text this works byte by byte and nothing
    is left to compose. A lower-case word of Latin letters passes the normaliser and pre-tokeniser unchanged, so the library's model
    alone gives the same ids for it. Pieces of Latin-1 text are bytes, others str.
    """

    def __init__(self, path: str, most: int = 250_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.model = self.tokenizer.model
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.code = np.dtype(self.kind).char
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.byte_level = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}
        self.plain = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch

    def __missing__(self, piece: bytes | str) -> bytes:
        text = piece.decode("latin-1") if isinstance(piece, bytes) else piece
        if self.plain(text):
            ids = [t.id for t in self.model.tokenize(text if text.isascii() else text.translate(self.byte_level))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        found = array(self.code, ids).tobytes()
        if len(self) < self.most:
            self[piece] = found
        return found

    @staticmethod
    def split(text: str) -> list[bytes] | list[str]:
        """The text in pieces that the tokeniser treats apart; other than in plain Latin-1 text those between spaces."""
        try:
            data = text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if b"<|" in data:  # a special token, perhaps: these are as they are written
            return text.split(" ")
        data = data.translate(LOWER)
        if data.translate(None, PLAIN) or b".." in data or b",," in data or b".," in data or b",." in data:
            data = MARKS.sub(rb" \1", data)
        else:  # every mark stands alone
            data = data.replace(b". ", b" . ").replace(b", ", b" , ")
            if data.endswith((b".", b",")):
                data = data[:-1] + b" " + data[-1:]
        return data.split(b" ")

    def ids(self, text: str, end: int | None = END) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.split(text))) + (b"" if end is None else array(self.code, [end]).tobytes()), self.kind)


_PIECES: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """The tokeniser of a Python worker, made once."""
    if name not in _PIECES:
        import public_tokenizers

        _PIECES[name] = Pieces(public_tokenizers.path(name))
    return _PIECES[name]


# --- coding -----------------------------------------------------------------------------------------------------------


class Table:
    """Frequencies that add up to 2**SCALE, of the symbols that occur, each at least 1."""

    def __init__(self, symbols: np.ndarray, freqs: np.ndarray):
        self.symbols, self.freqs = symbols.astype(np.uint32), freqs.astype(np.uint64)
        self.starts = np.cumsum(self.freqs) - self.freqs
        self.place = np.zeros(int(self.symbols.max(initial=0)) + 1, np.int32)
        self.place[self.symbols] = np.arange(len(self.symbols))
        self.slots: np.ndarray | None = None

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        counts = counts[symbols]
        total = 1 << SCALE
        freqs = np.maximum(1, counts * (total - len(counts)) // max(1, counts.sum()))
        freqs[np.argmax(freqs)] += total - freqs.sum()
        return cls(symbols, freqs)

    def payload(self) -> bytes:
        return struct.pack("<I", len(self.symbols)) + self.symbols.astype("<u4").tobytes() + self.freqs.astype("<u4").tobytes()

    @classmethod
    def read(cls, payload: bytes) -> Table:
        (n,) = struct.unpack_from("<I", payload)
        return cls(np.frombuffer(payload, "<u4", n, 4), np.frombuffer(payload, "<u4", n, 4 + 4 * n))


def lanes_for(n: int) -> int:
    """Lanes of a block of n ids: about one for every STEPS ids, 8 at least."""
    return max(8, -(-n // STEPS))


def encode_block(ids: np.ndarray, table: Table, every: int = 256) -> bytes:
    n, lanes = len(ids), lanes_for(len(ids))
    place = table.place[ids]
    freq, start = table.freqs[place], table.starts[place]
    most, rest = freq << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - freq
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    written_words, points = 0, []
    for step in range(-(-n // lanes) - 1, -1, -1):
        a, b = step * lanes, min(n, (step + 1) * lanes)
        x = state[: b - a]
        full = np.flatnonzero(x >= most[a:b])
        if len(full):
            y = x[full]
            words.append(y.astype("<u4")[::-1])
            written_words += len(full)
            x[full] = y >> WORD_BITS
        x += x // freq[a:b] * rest[a:b] + start[a:b]
        if step % every == 0:
            points.append((step, written_words, state.copy()))
    if not points:
        points.append((0, 0, state))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    heads = [struct.pack("<II", step, written_words - at) + lane.astype("<u8").tobytes() for step, at, lane in reversed(points)]
    return struct.pack("<IIII", lanes, n, len(stream), len(heads)) + b"".join(heads) + stream.tobytes()


def decode_block(payload: bytes, table: Table, checkpoint: int = 0) -> np.ndarray:
    """The ids from a checkpoint on; from 0 all of them."""
    lanes, n, count, points = struct.unpack_from("<IIII", payload)
    head = 16 + checkpoint * (8 + 8 * lanes)
    step, at = struct.unpack_from("<II", payload, head)
    state = np.frombuffer(payload, "<u8", lanes, head + 8).copy()
    stream = np.frombuffer(payload, "<u4", count, 16 + points * (8 + 8 * lanes)).astype(np.uint64)
    if table.slots is None:
        table.slots = np.repeat(np.arange(len(table.symbols), dtype=np.int32), table.freqs.astype(np.int64))
    mask = np.uint64((1 << SCALE) - 1)
    out, first = np.empty(n - step * lanes, np.uint32), step * lanes
    for a in range(first, n, lanes):
        b = min(n, a + lanes)
        x = state[: b - a]
        slot = x & mask
        place = table.slots[slot]
        out[a - first : b - first] = table.symbols[place]
        x[:] = table.freqs[place] * (x >> np.uint64(SCALE)) + slot - table.starts[place]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << WORD_BITS) | stream[at : at + len(low)]
            at += len(low)
    return out


# --- files ------------------------------------------------------------------------------------------------------------

BLOCK = pa.struct([("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary()), ("crc32", pa.int64())])
ROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("table", pa.binary()), ("blocks", pa.list_(BLOCK))])


def _shard(part: int, shard: int, first: int, docs: list[tuple[int | None, np.ndarray]]) -> pa.RecordBatch:
    every = np.concatenate([x for _, x in docs])
    table = Table.of(every)
    blocks, held, size, at = [], [], 0, first
    for k, (doc_id, ids) in enumerate(docs):
        held.append((doc_id, ids))
        size += len(ids)
        if size >= BLOCK_IDS or k == len(docs) - 1:
            ids = np.concatenate([x for _, x in held])
            blocks.append({"first_id": at, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held], "payload": encode_block(ids, table), "crc32": zlib.crc32(ids.astype("<u4"))})
            held, at, size = [], at + size, 0
    return pa.RecordBatch.from_pylist([{"part": part, "shard": shard, "first_id": first, "n_ids": len(every), "table": table.payload(), "blocks": blocks}], ROW)


def _encoded(tokenizer: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = pieces(tokenizer)
        gc.disable()  # nothing here makes cycles, and walking the remembered pieces costs a tenth of the time
        try:
            yield from shards(encode, batches)
        finally:
            gc.enable()

    def shards(encode: Pieces, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int | None, np.ndarray]] = []
        part, shard, first, size = 0, 0, 0, 0
        for batch in batches:
            part = batch.column("part")[0].as_py() if len(batch) else part
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                docs.append((doc_id, encode.ids(text.as_py(), end)))
                size += len(docs[-1][1])
                if size >= SHARD_IDS:
                    yield _shard(part, shard, first, docs)
                    docs, shard, first, size = [], shard + 1, first + size, 0
        if docs:
            yield _shard(part, shard, first, docs)

    return run


def write_tokens(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END, path: str | None = None) -> DataFrame:
    """Write the token files of docs, in ascending doc_id order, to path, or without one to the shared folder; returns the rows of the files."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    shards = mapped(ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text"), _encoded(tokenizer, end), FILE)
    if path is None:
        return written(shards, "tokens")
    shards.write.parquet(path)
    return docs.sparkSession.read.schema(FILE).parquet(path)


def _decoded(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                table = Table.read(batch.column("table")[k].as_py())
                for block in batch.column("blocks")[k]:
                    block = block.as_py()
                    ids = decode_block(block["payload"], table).astype("<u4")
                    if zlib.crc32(ids) != block["crc32"]:
                        raise ValueError(f"the checksum of the block at id {block['first_id']} does not match")
                    n = np.array(block["lengths"], np.int64)
                    at = np.cumsum(n) - n
                    columns = [pa.repeat(batch.column("part")[k], len(n)), pa.array(block["doc_ids"], pa.int64()), pa.array(at + block["first_id"]), pa.array(n), pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at, at + n, strict=True)], pa.int64())]
                    names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(np.append(at, len(ids)).astype(np.int32), pa.array(ids.astype(np.int32))))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if asked for."""
    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return mapped(files.select("part", "table", "blocks"), _decoded(with_ids), schema).join(parts, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir)))
