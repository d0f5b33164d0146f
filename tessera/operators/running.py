"""Counts of n-grams that run through all documents in order of id, without a row for each n-gram.

Documents go by ranges of ids to chunks, which are written. Each chunk sends the hashes of its n-grams, sorted and packed,
dealt by hash; for each hash of each chunk one number comes back (such as the count in the chunks before), packed alike. A
chunk makes the same hashes again and reads its answers by place, so neither strings nor rows of n-grams are ever dealt.
An n-gram that every document has is one entry a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.grams import PlainWords, Words, slices
from tessera.functions.text import MIN_BYTES
from tessera.runtime import map_arrow, materialize

#: Bytes of text: of a chunk, of what is taken apart at once, for each bucket of hashes.
CHUNK, PIECE, BUCKET = 4 << 20, 1 << 19, 3 << 20
_CODEC = pyarrow.Codec("zstd", 1)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte plane by byte plane."""
    raw = np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    raw = _CODEC.decompress(blob[8:], decompressed_size=8 * size, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, size).T).reshape(-1).view("<i8")


def chunks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> tuple[DataFrame, int]:
    """chunk, place (its order), doc_id, text: written, in order of id, so that no id is in two chunks and no chunk in two files;
    and the number of buckets for their hashes."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *more)
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / CHUNK), min(source.sparkSession.sparkContext.defaultParallelism, math.ceil(size / (1 << 18))))
    ranged = source.repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id")
    numbered = ranged.select(F.spark_partition_id().cast("long").alias("chunk"), F.monotonically_increasing_id().alias("place"), "doc_id", "text", *more)
    return materialize(numbered, "chunks"), min(1 << 16, max(16, math.ceil(size / BUCKET)))


def pieces(texts: pyarrow.ChunkedArray, kind: type = Words) -> Iterator[tuple[np.ndarray, Words]]:
    """Places of some texts, and their words."""
    text = texts.combine_chunks() if texts.num_chunks else pyarrow.array([], pyarrow.string())
    size = np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)
    piece = (np.cumsum(size) - size) // PIECE
    for at in np.split(np.arange(len(text)), np.flatnonzero(np.diff(piece)) + 1) if len(text) else []:
        yield at, kind(text.slice(int(at[0]), len(at)).to_pylist())


def keyed(n: int, h: np.ndarray, x: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and the hash of n-grams; the last three bits of a hash are n."""
    return (x.view(np.uint32).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16), (h & np.int64(-8)) | np.int64(n)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    out = np.concatenate(parts) if parts else np.zeros(0, kind)
    parts.clear()
    return out


def counted(table: pyarrow.Table, levels, least: int, buckets: int, kind: type = Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """bucket, hashes in order, counts: of the n-grams of a chunk."""
    bucket, hashes = [], []
    for _, words in pieces(table.column("text"), kind):
        for k, _, h, x, _ in words.grams(levels, least):
            b, h = keyed(k, h, x, buckets)
            bucket.append(b)
            hashes.append(h)
    bucket, hashes = _joined(bucket, np.uint16), _joined(hashes, np.int64)
    order = np.argsort(bucket, kind="stable")
    hashes, bounds = hashes[order], np.searchsorted(bucket, np.arange(buckets + 1), sorter=order)
    del bucket, order
    for k in np.flatnonzero(np.diff(bounds)):
        own, count = np.unique(hashes[bounds[k] : bounds[k + 1]], return_counts=True)
        yield k, own, count


class Chunk:
    """The n-grams of the documents of a chunk, in order of (bucket, hash, id, sentence, place)."""

    def __init__(self, table: pyarrow.Table, levels, least: int, buckets: int, kind: type = Words):
        ids = table.column("doc_id")
        ids = ids.combine_chunks() if ids.num_chunks else pyarrow.array([], ids.type)
        n = len(ids)
        new = np.ones(n, bool)
        if n > 1:
            new[1:] = ~_same(ids)
        group = (np.cumsum(new) - 1).astype(np.int32)  # rows that share an id are one document
        self.table, self.ids, self.groups, self.sentences = table, ids, group, np.zeros(n, np.int64)
        bucket, hashes, row, sentence, size, letters, start, base = [], [], [], [], [], [], [], 0
        for at, words in pieces(table.column("text"), kind):
            self.sentences[at] = words.sentences
            made, places = words.letters() if kind is Words else (np.zeros(0, np.uint8), words.start)
            letters.append(made)
            doc, sent, places = (words.doc + at[0]).astype(np.int32), words.sentence.astype(np.int32), places + base
            for k, last, h, x, wide in words.grams(levels, least):
                b, h = keyed(k, h, x, buckets)
                bucket.append(b)
                hashes.append(h)
                row.append(doc[last])
                sentence.append(sent[last])
                size.append(wide.astype(np.int32))
                start.append(places[last - k + 1])
            base += len(made)
        bucket, hashes, row, sentence = _joined(bucket, np.uint16), _joined(hashes, np.int64), _joined(row, np.int32), _joined(sentence, np.int32)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        bounds = np.searchsorted(bucket, np.arange(buckets + 1), sorter=order)
        del bucket
        apart = bool(new.all())
        for k in np.flatnonzero(np.diff(bounds)):
            at = order[bounds[k] : bounds[k + 1]]
            order[bounds[k] : bounds[k + 1]] = at[np.argsort(hashes[at], kind="stable") if apart else np.lexsort((sentence[at], group[row[at]], hashes[at]))]
        self.hash, self.row, self.sentence, self._order = hashes[order], row[order], sentence[order], order
        del hashes, row, sentence
        self.group = group[self.row]
        self._letters, self._start, self._size = _joined(letters, np.uint8), _joined(start, np.int64), _joined(size, np.int32)
        first = np.ones(len(order), bool)
        first[1:] = self.hash[1:] != self.hash[:-1]
        first[bounds[:-1][bounds[:-1] < len(order)]] = True
        self.first = np.flatnonzero(first)  # of each hash
        self.entry = np.cumsum(first, dtype=np.int32) - 1

    @property
    def n(self) -> np.ndarray:
        return (self.hash & 7).astype(np.int32)

    @property
    def bytes(self) -> np.ndarray:
        return self._size[self._order]

    def text(self, at: np.ndarray) -> pyarrow.Array:
        picked = self._order[at]
        return slices(self._letters, self._start[picked], self._size[picked].astype(np.int64))


def _same(ids: pyarrow.Array) -> np.ndarray:
    """Whether each id but the first is that of the row before; null is an id."""
    if pyarrow.types.is_struct(ids.type):
        return np.logical_and.reduce([_same(x) for x in ids.flatten()])
    a, b = ids.slice(1), ids.slice(0, len(ids) - 1)
    nulls = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.or_(nulls, pc.fill_null(pc.equal(a, b), False)))


def each_chunk(batches: Iterator) -> Iterator[tuple[int, pyarrow.Table]]:
    """The rows of each chunk, which come one after another."""
    held, now = [], None
    for batch in batches:
        numbers = np.asarray(batch.column("chunk"))
        for at in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1) if len(numbers) else []:
            if now is not None and numbers[at[0]] != now:
                yield now, pyarrow.Table.from_batches(held)
                held = []
            now = int(numbers[at[0]])
            held.append(batch.slice(int(at[0]), len(at)))
    if held:
        yield now, pyarrow.Table.from_batches(held)


_ENTRIES = "bucket int, chunk long, hashes binary, counts binary"


def entries(dealt: DataFrame, buckets: int, levels, least: int, kind: type = Words) -> DataFrame:
    """bucket, chunk, hashes (in order, as differences), counts: of the n-grams of each chunk."""

    def run(batches: Iterator) -> Iterator:
        for number, table in each_chunk(batches):
            rows = {"bucket": [], "chunk": [], "hashes": [], "counts": []}
            for k, hashes, counts in counted(table, levels, least, buckets, kind):
                for name, value in zip(rows, (k, number, pack(np.diff(hashes, prepend=np.int64(0))), pack(counts)), strict=True):
                    rows[name].append(value)
            yield pyarrow.RecordBatch.from_arrays([pyarrow.array(rows["bucket"], pyarrow.int32()), pyarrow.array(rows["chunk"], pyarrow.int64()), pyarrow.array(rows["hashes"], pyarrow.binary()), pyarrow.array(rows["counts"], pyarrow.binary())], names=list(rows))

    return map_arrow(dealt, run, _ENTRIES)


def together(table: pyarrow.Table) -> tuple[np.ndarray, ...]:
    """Of a bucket: chunks, the entries of each, and all hashes, counts and places of the first of each hash, in order of (hash, chunk); the order."""
    table = table.sort_by("chunk")
    chunk = np.asarray(table.column("chunk"))
    hashes = [np.cumsum(unpack(b.as_buffer())) for b in table.column("hashes")]
    sizes = np.array([len(h) for h in hashes])
    joined = np.concatenate(hashes)
    counts = np.concatenate([unpack(b.as_buffer()) for b in table.column("counts")])
    order = np.argsort(joined, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = joined[order[1:]] != joined[order[:-1]]
    return chunk, sizes, joined[order], counts[order], first, order


def answers(made: DataFrame, answer: Callable) -> DataFrame:
    """bucket, chunk, answers: answer(counts, first) for the entries of a bucket in order of (hash, chunk), by chunk."""

    def run(table: pyarrow.Table) -> pyarrow.Table:
        chunk, sizes, _, counts, first, order = together(table)
        out = np.empty(len(order), np.int64)
        out[order] = answer(counts, first)
        blobs = [pack(x) for x in np.split(out, np.cumsum(sizes)[:-1])]
        bucket = table.column("bucket")[0].as_py()
        return pyarrow.table({"bucket": pyarrow.array([bucket] * len(chunk), pyarrow.int32()), "chunk": pyarrow.array(chunk), "answers": pyarrow.array(blobs, pyarrow.binary())})

    return made.groupBy("bucket").applyInArrow(run, "bucket int, chunk long, answers binary")


def counts_before(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often chunks before have the n-gram."""
    before = np.cumsum(counts) - counts
    return before - before[np.flatnonzero(first)][np.cumsum(first) - 1]


def counts_in_all(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often all chunks together have the n-gram."""
    at = np.flatnonzero(first)
    return np.add.reduceat(counts, at)[np.cumsum(first) - 1] if len(at) else counts


def total_at_first(least: int) -> Callable:
    """The count in all chunks, at the first that has the n-gram; 0 elsewhere and below `least`."""

    def answer(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = np.zeros(len(counts), np.int64)
        at = np.flatnonzero(first)
        if len(at):
            total = np.add.reduceat(counts, at)
            out[at] = np.where(total >= least, total, 0)
        return out

    return answer


def with_answers(docs: DataFrame, answer: Callable, make: Callable, schema: str, levels, least: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text", kind: type = Words, more: tuple[str, ...] = ()) -> DataFrame:
    """make(chunk, answers for its hashes), a table for each chunk."""
    written, buckets = chunks(docs, doc_id, text, more)
    replies = answers(entries(written, buckets, levels, least, kind), answer)

    def run(texts: pyarrow.Table, replied: pyarrow.Table) -> pyarrow.Table:
        c = Chunk(texts.sort_by("place"), levels, least, buckets, kind)
        got = [unpack(b.as_buffer()) for b in replied.sort_by("bucket").column("answers")]
        return make(c, np.concatenate(got) if got else np.zeros(0, np.int64))

    return written.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def alone(docs: DataFrame, make: Callable, schema: str, levels, least: int = MIN_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """make(chunk), a table for each chunk: for what needs no other chunk."""
    written, buckets = chunks(docs, doc_id, text)

    def run(batches: Iterator) -> Iterator:
        for _, table in each_chunk(batches):
            yield from make(Chunk(table, levels, least, buckets)).to_batches()

    return map_arrow(written, run, schema)


def shared(left: DataFrame, right: DataFrame, levels) -> DataFrame:
    """n, shared: how many n-grams both of two sets of texts (doc_id, text) have."""
    (a, buckets), (b, more) = chunks(left), chunks(right)
    buckets = max(buckets, more)
    made = entries(a, buckets, levels, 1).unionByName(entries(b, buckets, levels, 1).withColumn("chunk", -1 - F.col("chunk")))

    def run(table: pyarrow.Table) -> pyarrow.Table:
        chunk, sizes, hashes, _, first, order = together(table)
        right = np.repeat(chunk < 0, sizes)[order]
        at = np.flatnonzero(first)
        both = np.logical_or.reduceat(right, at) & np.logical_or.reduceat(~right, at)
        n, count = np.unique(hashes[at][both] & 7, return_counts=True)
        return pyarrow.table({"n": pyarrow.array(n, pyarrow.int32()), "shared": pyarrow.array(count, pyarrow.int64())})

    return made.groupBy("bucket").applyInArrow(run, "n int, shared long").groupBy("n").agg(F.sum("shared").alias("shared"))
