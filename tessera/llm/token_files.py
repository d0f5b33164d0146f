"""Token-ID output: binary files of independent zstandard frames with a trailing seek table.

A file (shard) is a legal zstandard stream in the seekable format:

- one frame for each document, holding its token ids as little-endian unsigned integers (2 or 4 bytes wide);
- a skippable frame (magic 0x184D2A50) with the index: a zstandard-compressed Arrow table of doc_id and n_tokens,
  after a header of one byte that gives the width of an id;
- the seek table, a skippable frame (magic 0x184D2A5E): for each frame before it the compressed size, the size
  and the low 32 bits of XXH64 of the content; then the number of frames, a descriptor byte and 0x8F92EAB1.

A reader needs the last bytes of a file, then the index, then the frames of the documents it wants; each frame
is checked against its checksum. Nothing else is decompressed.

Files are written by Spark's own writer, one row to a file (maxRecordsPerFile = 1): the row is the shard without
its last four bytes, and those four bytes, which end every file, are the writer's line separator. So tasks that
are lost or run twice leave no half file, and any store that Spark writes to will do. Files are bounded
(`shard_bytes`, passed at most by one document), and a task holds one shard and one batch of texts at a time.

Documents are dealt by range of their id, so that files in order of name hold them in ascending order of id;
rows without an id come first; rows that share an id stand in order of their text's hash. Equal rows give equal
documents. A null text is empty: its document holds the end id alone. Other columns are not written.

The tokenizer's pre-tokens never span white space, so a word's ids do not depend on its neighbours. Words are
therefore looked up in a bounded cache. Words of plain letters, digits and marks are split into pre-tokens and
passed to the tokenizer's own model; any other word goes through the whole tokenizer. For tokenizers of another
make (`by_word=False`), whole texts go through encode_batch.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.runtime import map_arrow, scratch, small, table

END_ID = 2
SHARD_BYTES = 32_000_000
SKIPPABLE, SEEK_SKIPPABLE, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 3


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """The ids of a text as packed bytes, word by word."""

    #: Words that normalization leaves as they are but for case, and that hold no apostrophe (a pre-token of its own
    #: with the letters after it) and no "<|" (a special token).
    PLAIN = re.compile(r"(?!.*<\|)[!-&(-~À-ÖØ-öø-ÿ]+", re.DOTALL)
    PIECES = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")
    MAX_WORDS, MAX_PIECES = 300_000, 600_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = "<u4" if self.wide else "<u2"
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.alphabet = {c: "".join(rest.get(b) or chr(b) for b in chr(c).encode()) for c in range(0xC0, 0x100)}

    def _pack(self, ids: list[int]) -> bytes:
        return np.asarray(ids, self.kind).tobytes()

    def _word(self, word: str) -> bytes:
        if self.PLAIN.fullmatch(word):
            known, parts = self.pieces, []
            for piece in self.PIECES.findall(word):
                piece = piece.lower()
                packed = known.get(piece)
                if packed is None:
                    packed = self._pack([t.id for t in self.model.tokenize(piece.translate(self.alphabet))])
                    if len(known) >= self.MAX_PIECES:
                        known.clear()
                    if len(piece) < 64:
                        known[piece] = packed
                parts.append(packed)
            packed = b"".join(parts)
        else:
            packed = self._pack(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(self.words) < self.MAX_WORDS and len(word) < 32:
            self.words[word] = packed
        return packed

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        """The packed ids of each text in turn; null is empty."""
        # Only white space of ASCII parts words here: more of it is white space to the tokenizer, and left to it.
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        get, make = self.words.get, self._word
        packed = pa.array([get(w) or make(w) for w in words.dictionary.to_pylist()], pa.binary()).take(words.indices)
        if not len(packed):
            yield from (memoryview(b"") for _ in range(len(texts)))
            return
        _, ends, content = packed.buffers()
        at = np.frombuffer(ends, "<i4")[np.asarray(lists.offsets) - lists.offsets[0].as_py() + packed.offset]
        content = memoryview(content or b"")
        yield from (content[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))


class TextEncoder(WordEncoder):
    """The same, for tokenizers whose pre-tokens may span white space."""

    def encode(self, texts: pa.Array) -> Iterator[memoryview]:
        for found in self.tokenizer.encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False):
            yield memoryview(self._pack(found.ids))


def slices(batch: pa.RecordBatch, text: int, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, or one longer text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield batch.slice(start, end - start)
        start = end


_encoders: dict[tuple, WordEncoder] = {}


def encoder(path: str, by_word: bool = True) -> WordEncoder:
    """One for each worker process: tasks in turn use the same caches."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = (WordEncoder if by_word else TextEncoder)(path)
    return _encoders[path, by_word]


class ShardWriter:
    """Collects documents into the bytes of one file."""

    def __init__(self, width: int, level: int = LEVEL):
        self.width, self.packer = width, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.body, self.frames, self.docs = io.BytesIO(), [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.packer.compress(ids)
        self.body.write(packed)
        self.frames.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append((doc_id, len(ids) // self.width))

    def size(self) -> int:
        return self.body.tell() + 28 * len(self.frames)

    def finish(self) -> bytes:
        index = pa.table({"doc_id": pa.array([x[0] for x in self.docs], pa.int64()), "n_tokens": pa.array([x[1] for x in self.docs], pa.int64())})
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, index.schema) as stream:
            stream.write_table(index)
        content = bytes([self.width]) + zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue())
        self.body.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        frames = [*self.frames, (len(content) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        table_ = np.array(frames, "<u4").tobytes() + struct.pack("<IBI", len(frames), 0x80, SEEK_MAGIC)
        self.body.write(struct.pack("<II", SEEK_SKIPPABLE, len(table_)) + table_)
        return self.body.getvalue()


class ShardReader:
    """Reads documents of a file through a seekable object opened for reading bytes."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, io.SEEK_END)
        frames, descriptor, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("no seek table with checksums at the end")
        self.table = np.frombuffer(self._at(end - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        content = self._at(int(self.offsets[-2]) + 8, int(self.table[-1, 0]) - 8)
        self.width = content[0]
        index = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(content[1:])).read_all()
        self.doc_ids, self.n_tokens = index["doc_id"].to_pylist(), index["n_tokens"].to_pylist()
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def ids(self, k: int) -> np.ndarray:
        """Token ids of the k-th document; only its frame is read and decompressed."""
        size, full, checksum = map(int, self.table[k])
        content = self.unpacker.decompress(self._at(int(self.offsets[k]), size), max_output_size=max(full, 1))
        if len(content) != full or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(content, "<u4" if self.width == 4 else "<u2")

    def of(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents whose id is wanted."""
        wanted = set(wanted)
        return ((d, self.ids(k)) for k, d in enumerate(self.doc_ids) if d in wanted)


def write(docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, shard_bytes: int = SHARD_BYTES, by_word: bool = True) -> None:
    """Tokenize `docs` and write them to the folder `path`."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary, by_word)
        end, width = own._pack([end_id]), 4 if own.wide else 2
        shard = ShardWriter(width)

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array([shard.finish()[:-4]], pa.binary())], ["shard"])

        for batch in (part for whole in batches for part in slices(whole, 1)):
            for key, ids in zip(batch.column(0).to_pylist(), own.encode(batch.column(1)), strict=True):
                shard.add(key, bytes(ids) + end)
                if shard.size() >= shard_bytes:
                    yield out()
                    shard = ShardWriter(width)
        if shard.docs:
            yield out()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    made = map_arrow(dealt, shards, "shard binary")
    (
        made.select(F.col("shard").cast("string").alias("value"))
        .write.option("maxRecordsPerFile", 1)
        .option("encoding", "ISO-8859-1")
        .option("lineSep", struct.pack("<I", SEEK_MAGIC).decode("latin-1"))
        .text(path)
    )


def read(spark, path: str, visit, schema: str) -> DataFrame:
    """visit(file name, ShardReader) -> Arrow batches, for every file of the folder."""

    def each(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from visit(name.rsplit("/", 1)[-1], ShardReader(pa.BufferReader(content.as_buffer())))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return map_arrow(files.select("path", "content"), each, schema)


def read_documents(spark, path: str, wanted: Iterable[int]) -> DataFrame:
    """doc_id, ids of the documents wanted; the other frames stay compressed."""
    wanted = frozenset(wanted)

    def visit(name, reader):
        found = list(reader.of(wanted))
        if found:
            yield pa.record_batch([pa.array([d for d, _ in found], pa.int64()), pa.array([i.astype("<i8") for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return read(spark, path, visit, "doc_id long, ids array<long>")


def digest(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files of a folder.

    Starts are sums over one row for each file and, within a file, over its documents.
    """

    def visit(name, reader):
        ids = [reader.ids(k) for k in range(len(reader.doc_ids))]
        columns = [
            pa.array([name] * len(ids)),
            pa.array(range(len(ids)), pa.int32()),
            pa.array(reader.doc_ids, pa.int64()),
            pa.array(np.cumsum([0, *map(len, ids)])[:-1], pa.int64()),
            pa.array(map(len, ids), pa.int64()),
            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
        ]
        yield pa.record_batch(columns, ["file", "at", "doc_id", "inner", "n_tokens", "ids_crc32"])

    def totals(name, reader):
        yield pa.record_batch([pa.array([name]), pa.array([sum(reader.n_tokens)], pa.int64())], ["name", "total"])

    # A name is part-<task>-<job>-c<count>: both numbers have a fixed width up to their limit, and are compared as numbers beyond.
    order = [F.regexp_extract("name", r"part-(\d+)", 1).cast("long"), F.regexp_extract("name", r"-c(\d+)", 1).cast("long")]
    files = read(spark, path, totals, "name string, total long")
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = small(files.select("name", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before")))
    rows = read(spark, path, visit, "file string, at int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(starts, rows["file"] == starts["name"]).select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def token_output(spark, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write `docs` to a new folder of the shared place and give what is read back."""
    path = scratch(spark, "tokens")
    write(docs, path, vocabulary or vocabulary_path())
    return digest(spark, path)


def op1_token_files(spark, sf_dir):
    return token_output(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
