"""Near-duplicate documents by HyperMinHash.

A document is the set of its distinct word shingles (of five words unless a caller says otherwise), hashed to 64 bits. Each shingle falls into one of 128
buckets; a bucket keeps, of its smallest value, the count of leading zeros and the 10 bits after them: 16 bits.
Empty buckets take the register of the first bucket with one in an order of their own (optimal densification),
so short texts are compared like long ones. Four registers make a band of 64 bits; two sets of similarity 0.8
share one of the 32 bands but for one pair in 20 millions.

1. Documents with the same set (128-bit fingerprint) are one node from here on, however many they are.
2. Buckets of the first four bands: all nodes of a bucket are paired with one of them, drawn by hash, so pairs grow
   with the members of a bucket, not with their square. Components are formed, and large groups are one from here on.
3. All 32 bands, with each node's component: a bucket whose nodes are all of one component is done. Of the others only
   a row for each (bucket, component) is carried on, with a few of its nodes, drawn by hash; in each turn those of the
   bucket's largest component are paired with those of the others, and buckets that have become one component go.
4. In buckets that still hold several components, every node outside the bucket's largest is compared with all nodes of
   other components, so no link within a bucket is left out: first by size and by a bitmap of the set, whose bits that
   differ bound the similarity exactly.
5. Pairs are kept if their collision-corrected Jaccard estimate is not below 0.8 by more than 5.5 standard errors, and
   links are confirmed on the full sets, in integers.

Nothing is collected to the driver but counts; a hot node or bucket is pre-aggregated, or joined so that the
optimizer can split it. Every step is written to the shared folder.

Defined results: texts that are null or have no word have no set and are linked with nothing; one word is the
set of itself; documents under one id count as linked; rows without an id take part, their component is the
smallest id in it, or null, and they are kept if no row of their component has an id; equal rows get equal
results. Other columns are not read. Where a row has to stay (keep_one), a component without any id keeps one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import hashing
from tessera.llm.token_files import slices
from tessera.operators.components import connected_components, joined_components
from tessera.runtime import map_arrow, materialize, release, small, table

REGISTERS, PER_BAND, MANTISSA = 128, 4, 10
PERCENT = 80
#: Words of a shingle, unless a caller says otherwise.
SHINGLE = 5
#: Bytes of texts that a task works on at once, and ids that are broadcast at most.
SLICE, IDS = 2_000_000, 500_000
#: Standard errors below the similarity at which an estimate rules a pair out: as rare as a pair that shares no band.
LENIENCE = 5.5
#: Of the bitmap of a set.
BITS = 2048
#: Bands of the first turn, and nodes drawn from each component of a bucket for the turns after it.
FIRST, DRAWS = 4, 1

_orders = np.stack([np.random.default_rng(1000 + j).permutation(REGISTERS) for j in range(REGISTERS)])


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; with fewer words, of all its words as one."""
    found = [(w.text, w.hashes()) for w in hashing.words(texts)]
    text = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in found)])
    words = np.concatenate([np.zeros(0, np.uint64), *(h for _, h in found)])
    ends = np.searchsorted(text, np.arange(len(texts) + 1))
    runs = words.copy()
    for k in range(1, size):
        runs = hashing.joined(runs[: len(words) - k], words[k:])
    for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if j - i >= size:
            yield np.unique(runs[i : j - size + 1])
        elif j > i:
            whole = words[i : i + 1]
            for k in range(i + 1, j):
                whole = hashing.joined(whole, words[k : k + 1])
            yield hashing.mix(whole + np.uint64(j - i))
        else:
            yield np.zeros(0, np.uint64)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The 128 registers of a set that is sorted and not empty (uint16)."""
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    filled = np.zeros(REGISTERS, bool)
    at = (hashes & np.uint64(REGISTERS - 1)).astype(np.int64)
    low[at[::-1]] = hashes[::-1]  # the smallest is written last
    filled[at] = True
    value = low >> np.uint64(7)  # 57 bits
    zeros = np.minimum(57 - np.where(value > 0, np.floor(np.log2(np.maximum(value, np.uint64(1)).astype(np.float64))).astype(np.int64) + 1, 0), 47)
    shift = np.maximum(57 - zeros - 1 - MANTISSA, 0).astype(np.uint64)
    mantissa = (value >> shift) & np.uint64((1 << MANTISSA) - 1)
    packed = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | mantissa).astype(np.uint16)
    return packed if filled.all() else np.where(filled, packed, packed[_orders[np.arange(REGISTERS), filled[_orders].argmax(axis=1)]])


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """A bit for each shingle, as longs."""
    bits = np.zeros(BITS, np.uint8)
    bits[(hashes >> np.uint64(30) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def prints_of(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """High and low half of the 128-bit fingerprint of each set."""
    if not sets:
        return pa.array([], pa.int64()), pa.array([], pa.int64())
    high, low = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in sets), "<i8").reshape(-1, 2).T
    return pa.array(high.copy()), pa.array(low.copy())


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc_id, n, high, low (fingerprint), bands (null without a set)."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE)):
            sets = list(shingle_sets(batch.column(1), size))
            bands = pa.array([registers(x).view(np.int64) if len(x) else None for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(map(len, sets), pa.int64()), *prints_of(sets), bands], ["doc_id", "n", "high", "low", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_arrow(rows, run, "doc_id long, n long, high long, low long, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key, set (array of longs), bits (its bitmap) of the nodes wanted (key, id: null for nodes of rows without one, high, low)."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            sets = list(shingle_sets(batch.column(0), size))
            columns = [pa.array(x, pa.list_(pa.int64())) for x in ([x.view(np.int64) for x in sets], [bitmap(x) for x in sets])]
            yield pa.record_batch([*prints_of(sets), *columns], ["high", "low", "set", "bits"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    named = small(wanted.filter("id is not null").select("id").distinct(), IDS)
    some = rows.join(named, "id", "left_semi").select("text")
    if wanted.filter("id is null").limit(1).count():
        some = some.unionByName(rows.filter("id is null and text is not null").select("text"))
    made = map_arrow(some, run, "high long, low long, set array<long>, bits array<long>")
    return made.join(small(wanted.select("key", "high", "low"), IDS), ["high", "low"]).select("key", "set", "bits").dropDuplicates(["key"])


def chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by chance, for sets of these sizes without a common shingle."""
    k = np.arange(40)

    def level(n):  # the share of minima with k leading zeros
        load = np.maximum(n / REGISTERS, 1.0)[:, None]
        return (1 - 2.0 ** -(k + 1)) ** load - (1 - 2.0**-k) ** load

    return (level(n_a) * level(n_b)).sum(axis=1) / (1 << MANTISSA)


def least_estimate(n_a: np.ndarray, n_b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    j = percent / 100
    return j - LENIENCE * np.sqrt(j * (1 - j) / np.minimum(np.minimum(n_a, n_b), REGISTERS))


def likely(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs (a, b, n_a, n_b, bands_a, bands_b) whose corrected estimate is high enough."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, n_a, n_b = (batch.column(k).to_numpy() for k in range(4))
            x, y = (np.asarray(batch.column(k).flatten()).view(np.uint16).reshape(batch.num_rows, REGISTERS) for k in (4, 5))
            c = chance(n_a, n_b)
            estimate = ((x == y).mean(axis=1) - c) / (1 - c)
            good = estimate >= least_estimate(n_a, n_b, percent)
            yield pa.record_batch([pa.array(a[good]), pa.array(b[good])], ["a", "b"])

    return map_arrow(pairs.select("a", "b", "n_a", "n_b", "bands_a", "bands_b"), run, "a long, b long")


def near_sizes(n_a: Column, n_b: Column, percent: int = PERCENT) -> Column:
    """Sizes that allow the similarity at all."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def near_bitmaps(percent: int = PERCENT) -> Column:
    """Whether bitmaps allow the similarity, exactly: each bit that differs is of a shingle that only one set has."""
    apart = sum((F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(BITS // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b"))


def near_registers(percent: int = PERCENT) -> Column:
    """Whether the share of equal registers, not corrected, is within LENIENCE of the similarity."""

    def lanes(p, q):
        d = p.bitwiseXOR(q)
        return sum(((d.bitwiseAND(F.lit(0xFFFF << (16 * k) if k < 3 else -(1 << 48)))) == 0).cast("int") for k in range(PER_BAND))

    equal = F.aggregate(F.zip_with("bands_a", "bands_b", lanes), F.lit(0), lambda a, v: a + v)
    j = percent / 100
    return equal >= REGISTERS * (j - LENIENCE * F.sqrt(F.lit(j * (1 - j)) / F.least("n_a", "n_b", F.lit(REGISTERS))))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """a, b of the pairs whose full sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("key").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.filter(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def buckets_of(nodes: DataFrame, first: int, *others: str) -> DataFrame:
    """bucket and `others`: a row for each of the first bands of each node."""
    bands = nodes.select(*others, F.posexplode(F.slice("bands", 1, first)).alias("pos", "band"))
    return bands.select(F.xxhash64("pos", "band").alias("bucket"), "pos", *others)


def ordered(a: str | Column, b: str | Column) -> list[Column]:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def component_labels(docs: DataFrame, nodes: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    """node, component: of the nodes (key, id, n, high, low, bands) that are linked to another."""
    every = REGISTERS // PER_BAND

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("key").alias(name), F.col("n").alias(f"n_{name}"), F.col("bands").alias(f"bands_{name}"))

    def promising(pairs: DataFrame) -> DataFrame:
        described = pairs.distinct().join(side("a"), "a").join(side("b"), "b").filter(near_sizes(F.col("n_a"), F.col("n_b"), percent))
        return materialize(likely(described, percent), "likely")

    def sets_for(keys: DataFrame) -> DataFrame:
        wanted = materialize(nodes.select("key", "id", "high", "low").join(keys, "key", "left_semi"), "wanted")
        return materialize(sets_of(docs, wanted, doc_id, text, size), "sets")

    def labelled(labels: DataFrame, *others: str) -> DataFrame:
        own = labels.select(F.col("node").alias("key"), "component")
        return nodes.select("key", *others).join(own, "key", "left").withColumn("component", F.coalesce("component", "key"))

    few = buckets_of(nodes, FIRST, "key")
    centers = few.groupBy("bucket").agg(F.count(F.lit(1)).alias("members"), F.min_by("key", F.xxhash64("key", "bucket")).alias("center")).filter("members > 1")
    pairs = promising(few.join(centers, "bucket").filter("key <> center").select(*ordered("key", "center")))
    sets = sets_for(pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    labels = materialize(connected_components(confirmed(pairs, sets, percent)), "labels")
    release(pairs)

    # Buckets that hold several components, and a row for each of them; draws are nodes of it.
    placed = materialize(labelled(labels, "bands"), "placed-nodes")
    rows = buckets_of(placed, every, "key", "component")
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    mixed = small(materialize(mixed.select("bucket"), "mixed"), IDS)
    draws = [F.min_by("key", F.xxhash64("key", F.lit(k))).alias(f"draw{k}") for k in range(DRAWS)]
    state = materialize(rows.join(mixed, "bucket", "left_semi").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("own"), *draws), "open")
    more = sets_for(labelled(labels).join(state.select("component").distinct(), "component", "left_semi").select("key").join(sets.select("key"), "key", "left_anti"))
    sets = sets.unionByName(more)

    def tied(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        found = promising(pairs)
        links = materialize(confirmed(found, sets, percent), "links")
        release(found)
        return joined_components(labels, links) if links.limit(1).count() else labels

    for k in range(DRAWS):
        if not state.limit(1).count():
            return labels
        largest = state.groupBy("bucket").agg(F.max_by(F.struct("component", f"draw{k}"), F.struct("own", "component")).alias("largest"))
        apart = state.join(largest, "bucket").filter(F.col("component") != F.col("largest.component"))
        labels = tied(labels, apart.select(*ordered(f"draw{k}", f"largest.draw{k}")))
        moved = labels.select(F.col("node").alias("component"), F.col("component").alias("into"))
        merged = state.join(moved, "component", "left").withColumn("component", F.coalesce("into", "component"))
        merged = merged.groupBy("bucket", "component").agg(F.sum("own").alias("own"), *[F.min_by(f"draw{j}", F.xxhash64(f"draw{j}", F.lit(j))).alias(f"draw{j}") for j in range(DRAWS)])
        several = merged.groupBy("bucket").agg(F.count(F.lit(1)).alias("components")).filter("components > 1").select("bucket")
        before, state = state, materialize(merged.join(several, "bucket", "left_semi"), "open")
        release(before)
    # What is left: members outside a bucket's largest component, and all of its members, in the first bucket that two share.
    largest = state.groupBy("bucket").agg(F.max_by("component", F.struct("own", "component")).alias("largest"))
    kept = ("key", "component", "n", "bands", "bits")
    placed = labelled(labels, "n", "bands").join(state.select("component").distinct(), "component", "left_semi").join(sets.select("key", "bits"), "key")
    members = materialize(buckets_of(placed, every, *kept).join(small(materialize(largest, "largest"), IDS), "bucket"), "members")
    x, y = (members.select("bucket", *[F.col(c).alias(f"{c}_{side_}") for c in ("pos", "largest", *kept)]) for side_ in "ab")
    apart = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("largest_b")) | (F.col("key_a") < F.col("key_b")))
    before = (F.slice(f"bands_{c}", F.lit(1), F.col("pos_a")) for c in "ab")
    again = F.exists(F.zip_with(*before, lambda p, q: p == q), lambda e: e)
    near = near_sizes(F.col("n_a"), F.col("n_b"), percent) & near_bitmaps(percent) & near_registers(percent)
    rest = x.filter("component_a <> largest_a").join(y, "bucket").filter(apart & near & ~again)
    return tied(labels, rest.select(*ordered("key_a", "key_b")))


def placed_rows(docs: DataFrame, doc_id: str, text: str, percent: int, size: int) -> DataFrame:
    """doc_id, n, high, low, component (a node), component_id, kept: a row for each row of `docs`."""
    signed = materialize(signatures(docs, doc_id, text, size), "signatures")
    by_print = -1 - F.col("low").bitwiseAND(F.lit((1 << 62) - 1))
    # A node is named by its smallest id; without an id, or if rows of one id have different sets, by its fingerprint.
    prints = F.struct("high", "low")
    several = signed.filter("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(prints).alias("x"), F.max(prints).alias("y")).filter("x <> y")
    several = small(materialize(several.select(F.col("doc_id").alias("several_id")), "several"))
    repeated = bool(several.limit(1).count())
    rows = signed.filter("n > 0")
    if repeated:
        rows = rows.join(several, F.col("doc_id") == F.col("several_id"), "left").withColumn("key", F.when(F.col("several_id").isNull(), F.col("doc_id")))
    else:
        rows = rows.withColumn("key", F.col("doc_id"))
    nodes = rows.groupBy("high", "low").agg(F.min("key").alias("key"), F.min("doc_id").alias("id"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("key", F.coalesce("key", by_print)), "nodes")
    labels = component_labels(docs, nodes, doc_id, text, percent, size)
    own = nodes.select("high", "low", "id", F.col("key").alias("node"))
    if repeated:
        rows = signed.filter("n > 0").join(several, F.col("doc_id") == F.col("several_id"), "left_semi")
        tied = materialize(rows.join(own, ["high", "low"]).select("doc_id", "node").distinct(), "tied")
        first = tied.groupBy("doc_id").agg(F.min("node").alias("b"))
        labels = joined_components(labels, tied.join(first, "doc_id").select(F.col("node").alias("a"), "b").filter("a <> b"))
    # Nodes have all that decides; rows only look it up.
    grouped = materialize(own.join(labels, "node", "left").select("high", "low", "id", F.coalesce("component", "node").alias("component")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("id").alias("component_id"))
    verdicts = materialize(grouped.join(smallest, "component").select("high", "low", "component", "component_id"), "verdicts")
    release(grouped)
    rows = signed.select("doc_id", "n", "high", "low")
    alone = rows.filter("n = 0").select("*", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    joined = rows.filter("n > 0").join(verdicts, ["high", "low"]).select("doc_id", "n", "high", "low", "component", "component_id").unionByName(alone)
    return joined.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of `docs`; shingles of `size` words."""
    return placed_rows(docs, doc_id, text, percent, size).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def fingerprints(texts: DataFrame, size: int) -> DataFrame:
    """text, n, high, low of (text)."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE)):
            found = list(shingle_sets(batch.column(0), size))
            yield pa.record_batch([batch.column(0), pa.array(map(len, found), pa.int64()), *prints_of(found)], ["text", "n", "high", "low"])

    return map_arrow(texts, run, "text string, n long, high long, low long")


def keep_without_id(bare: DataFrame, stay: DataFrame, text: str, size: int) -> DataFrame:
    """Of the rows without an id: one of each component of `stay` (n, high, low, component), and all without a word."""
    signed = materialize(fingerprints(bare.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct(), size), "bare")
    chosen = signed.filter("n > 0").join(stay.filter("n > 0").select("high", "low", "component").distinct(), ["high", "low"]).groupBy("component").agg(F.min("text").alias("stay_text"))
    chosen = materialize(chosen.select("stay_text"), "bare-stay")
    one = bare.join(chosen, bare[text] == chosen["stay_text"], "left_semi").dropDuplicates([text])
    wordless = signed.filter("n = 0").select(F.col("text").alias("stay_text"))
    return one.unionByName(bare.filter(F.col(text).isNull())).unionByName(bare.join(wordless, bare[text] == wordless["stay_text"], "left_semi"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """The documents that stay, with their own columns; of rows that share an id, one; of a component without an id, one.

    An id goes with all its rows if one of them is a copy of another id's. Only the ids that go are looked up, so texts
    are shuffled only where these are too many to broadcast.
    """
    rows = placed_rows(docs, doc_id, text, percent, size)
    rows = materialize(rows.filter("not kept or doc_id is null").select("doc_id", "n", "high", "low", "component", "kept").distinct(), "decided")
    gone = small(materialize(rows.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct(), "gone"), IDS)
    named = docs.filter(F.col(doc_id).isNotNull())
    kept = named.join(gone, named[doc_id] == gone["gone_id"], "left_anti")
    repeated = docs.filter(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.count(F.lit(1)).alias("again_rows")).filter("again_rows > 1").select(F.col(doc_id).alias("again_id"))
    repeated = small(materialize(repeated, "repeated"))
    if repeated.limit(1).count():
        several = kept[doc_id] == repeated["again_id"]
        kept = kept.join(repeated, several, "left_anti").unionByName(kept.join(repeated, several, "left_semi").dropDuplicates([doc_id]))
    bare = rows.filter("doc_id is null and kept")
    if bare.limit(1).count():
        kept = kept.unionByName(keep_without_id(docs.filter(F.col(doc_id).isNull()), bare, text, size))
    return kept


def op8_near_dups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=2)
