"""Fuzzy line dedup (DataFrame functions only).

Lines are normalised to their lower-cased words; equal lines are one node. A node has six blocks; each word
counts in one block alone, chosen by its hash, so a word that is changed, added or left out touches two blocks at most
and leaves the others as they are. A block, or a part of it that holds enough, is told by the hash of all its words; of
lines of very many words by the bits of its SimHash. Nodes share a bucket if a block of several words is equal, or two of the smaller ones are: by the
pigeonhole principle all lines that differ in at most two words, for every place where they do, and most that differ in
three. Blocks that hold too few words to tell lines apart make no key. So short lines have other keys as well: those of
at most SHORT characters blocks of character pairs, as one letter is much of their words, and those of at most FEW words
the line without each word that is short enough to be an edit.

Pairs of a bucket with an edit similarity of 0.8 or more are links: 1 - distance / the longer length, in characters if
both lines have at most FEW words, else in words, so that a text of 20,000 words without a line break is compared as
well. Lengths and bitmaps of words, which bound the distance, come first. Of each connected group one occurrence stays,
the first by document and line. Within a bucket all nodes are paired with the least, as nodes are hashes; where a bucket still holds
several components, the nodes outside its largest are compared with those of other components: no link of a bucket is
lost. That is quadratic in a bucket of many lines that share a third of their words, but are not alike.

Texts are normalised once and written as lines. Keys are made within the row of a line, whose words are never shuffled,
but for lines of very many words; a key that several nodes have is found by its least and greatest node, so copies need
not be told apart first. A line that every document has is counted before it is shuffled, and joined so that it can be
split. Candidate keys are a long each; only those that several nodes have are looked up again.

Defined results: null texts and lines without a word have nothing to remove; rows that are equal in id and text are
one document; rows without an id come last in order; an empty table gives an empty result. Other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import let, packed
from tessera.operators.components import connected_components, joined_components
from tessera.runtime import materialize, release, small, table

SIMILARITY = 0.8
#: Words of lines that are keyed within their row, at most.
MOST = 1023
#: Blocks of a line and, of very long lines, of a SimHash and, of longer lines, bits in each; three counters of WIDTH bits are summed in one long.
BLOCKS, BITS, PER_COUNTER, WIDTH = 6, 15, 3, 21
#: Characters of lines that have a SimHash of character pairs as well, and words of those with keys that leave a word out.
SHORT, FEW = 80, 12
#: Features that two blocks must hold for a key, by kind of feature: words and character pairs.
LEAST = {"w": 3, "c": 3}
#: Parts of a block, each a key of its own if it has enough: few of a long line's blocks are without any edit.
PARTS = {"w": 3, "c": 1}
#: Features of a block, or a part, that makes a key alone.
ALONE = {"w": 5, "c": 8}
#: Bits of the bitmap of a line's words, or of the character pairs of a line of FEW words, in longs of 64.
MAP = 256
#: Keys or nodes that are broadcast at most.
KEYS = 500_000
#: What parts words: all in ASCII but letters, digits and line feeds. Texts are lower-cased first. A lone space is as it should be.
MARKS = r"[\x00-\x09\x0B-\x1F\x21-\x2F\x3A-\x60\x7B-\x7F][\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*+| [\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]++"


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """ld_id, ld_hash, ld_at (from 0), ld_line (normalised), node: the lines with a word."""
    plain = F.regexp_replace(F.lower(F.col(text)), MARKS, " ")
    rows = docs.select(F.col(doc_id).alias("ld_id"), F.xxhash64(F.col(text)).alias("ld_hash"), F.posexplode(F.split(plain, "\n")).alias("ld_at", "raw"))
    made = rows.select("ld_id", "ld_hash", "ld_at", F.trim("raw").alias("ld_line")).filter("ld_line <> ''")
    return made.withColumn("node", F.xxhash64("ld_line"))


def simhash(features: DataFrame) -> DataFrame:
    """node, sim (an array: the bits of each block), counts (an array: its features) of (node, h: a feature's hash).

    Bit k of a block is set if it is set in more than half of the block's features. Sums that overflow are null.
    """
    one = F.lit(1).cast("bigint")
    block = F.pmod(F.shiftrightunsigned("h", BITS), F.lit(BLOCKS)).cast("int")
    packs = []
    for g in range(0, BITS, PER_COUNTER):
        total = F.lit(0).cast("bigint")
        for k in range(g, g + PER_COUNTER):
            total = total.bitwiseOR(F.shiftleft(F.shiftrightunsigned("h", k).bitwiseAND(one), WIDTH * (k - g)))
        packs.append(total.alias(f"p{g}"))
    spread = features.select("node", block.alias("block"), *packs)
    zero = F.lit(0).cast("bigint")
    sums = [F.try_sum(F.when(F.col("block") == b, F.col(f"p{g}")).otherwise(zero)).alias(f"c{b}_{g}") for b in range(BLOCKS) for g in range(0, BITS, PER_COUNTER)]
    sizes = [F.sum((F.col("block") == b).cast("bigint")).alias(f"n{b}") for b in range(BLOCKS)]
    summed = spread.groupBy("node").agg(*sizes, *sums)
    mask = F.lit((1 << WIDTH) - 1).cast("bigint")

    def bits(b: int) -> Column:
        value = zero
        for k in range(BITS):
            g = k - k % PER_COUNTER
            ones = F.shiftrightunsigned(f"c{b}_{g}", WIDTH * (k - g)).bitwiseAND(mask)
            value = value.bitwiseOR(F.shiftleft((2 * ones > F.col(f"n{b}")).cast("bigint"), k))
        return value

    return summed.select("node", F.array(*map(bits, range(BLOCKS))).alias("sim"), F.array(*[F.col(f"n{b}") for b in range(BLOCKS)]).alias("counts"))


def block_keys() -> Column:
    """Of a long line: a key for each pair of blocks with enough words: of the pair, both blocks' bits and sizes."""
    keys = []
    for n, (x, y) in enumerate(combinations(range(BLOCKS), 2)):
        parts = [F.get(c, F.lit(k)) for c in ("sim", "counts") for k in (x, y)]
        some = (parts[2] + parts[3] >= LEAST["w"]) & parts[0].isNotNull() & parts[1].isNotNull()
        keys.append(F.when(some, F.xxhash64(F.lit(f"long{n}"), *parts)))
    return F.filter(F.array(*keys), lambda k: k.isNotNull())


def table_of(values: list[int]) -> Column:
    return F.array(*[F.lit(x).cast("bigint") for x in values])


def row_keys(features: DataFrame, kinds: str, *others: str) -> DataFrame:
    """`others`, and keys_<kind> of each of `kinds`: bucket keys from the column of that name, the sorted hashes of a line's features.

    Without a shuffle. None for more than MOST features. Hashes in order fall into BLOCKS ranges of PARTS each, told apart
    by the least hash of each but the first, which is sorted in among them. A key is the hash of all that a part holds, if
    that is ALONE different features or more; of a block of ALONE features or more without such a part; or of a pair of smaller blocks, if they
    hold LEAST together. Lambdas, which Spark interprets, go through blocks, not words; written out for each block, the
    code is too long for the JVM to compile, and slower.
    """
    none = F.array().cast("array<bigint>")
    pairs = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in combinations(range(BLOCKS), 2)])

    def edges(kind: str) -> list[int]:
        ranges = BLOCKS * PARTS[kind]
        return [(k << 64) // ranges - (1 << 63) for k in range(1, ranges)]

    def starts(kind: str) -> Column:
        places = [F.array_position(kind, F.lit(x).cast("bigint")).cast("int") for x in edges(kind)]
        return F.when(F.col(kind).isNotNull(), F.array(F.lit(0), *places, F.size(kind) + 1))

    def blocks(kind: str) -> Column:
        at = lambda k: F.get(f"{kind}_at", k)

        def block(b: Column) -> Column:
            first = b * PARTS[kind]
            size = at(first + PARTS[kind]) - at(first) - 1

            def made(held: Column) -> Column:
                def part(k: Column) -> Column:
                    own = F.slice(held, at(first + k) - at(first) + 1, at(first + k + 1) - at(first + k) - 1)
                    return let(own, lambda x: F.when(F.size(F.array_distinct(x)) >= ALONE[kind], F.xxhash64(F.lit(kind), b, k, x)))

                whole, n = F.xxhash64(F.lit(kind), b, held), size - (PARTS[kind] - 1)
                parts = F.filter(F.transform(F.array(*map(F.lit, range(PARTS[kind]))), part), lambda x: x.isNotNull())
                alone = F.when(n >= ALONE[kind], let(parts, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(whole)))).otherwise(none)
                return F.struct(n.alias("n"), whole.alias("p"), alone.alias("alone"))

            return let(F.slice(kind, at(first) + 1, size), made)

        return F.when(F.col(kind).isNotNull(), F.transform(F.array(*map(F.lit, range(BLOCKS))), block))

    def keys(kind: str) -> Column:
        def pair(at: Column) -> Column:
            x, y = (F.get(kind, at[side]) for side in "xy")
            return F.when((x["n"] + y["n"] >= LEAST[kind]) & (F.greatest(x["n"], y["n"]) < ALONE[kind]), F.xxhash64(x["p"], y["p"]))

        alone = F.flatten(F.transform(kind, lambda b: b["alone"]))
        return F.coalesce(F.array_except(F.concat(alone, F.transform(pairs, pair)), F.array(F.lit(None).cast("bigint"))), none)

    ordered = features.select(*others, *[F.when(F.size(x) <= MOST, F.sort_array(F.concat(x, table_of(edges(x))))).alias(x) for x in kinds])
    placed = ordered.select(*others, *kinds, *[starts(x).alias(f"{x}_at") for x in kinds])
    blocked = placed.select(*others, *[blocks(x).alias(x) for x in kinds])
    return blocked.select(*others, *[keys(x).alias(f"keys_{x}") for x in kinds])


def word_keys(line: str) -> Column:
    """Of lines of FEW words or fewer: a key of the line, and of the line without each word of up to a third of it."""

    def without(w: Column) -> Column:
        def left(x: Column, i: Column) -> Column:
            rest = F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.lit(FEW)))
            return F.when((3 * F.length(x) <= F.length(line)) & (F.size(w) > 1), F.xxhash64(F.lit("d"), F.array_join(rest, " ")))

        return F.array_distinct(F.concat(F.array(F.xxhash64(F.lit("d"), line)), F.filter(F.transform(w, left), lambda k: k.isNotNull())))

    words = F.split(line, " ")
    return F.when(F.size(words) <= FEW, let(words, without)).otherwise(F.array().cast("array<bigint>"))


def character_pairs(line: str) -> Column:
    """Each two characters that follow one another, with a space at both ends."""
    edged = F.concat(F.lit(" "), line, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(edged) - 1), lambda i: F.substring(edged, i, F.lit(2)))


def hashes(features: Column) -> Column:
    return F.sort_array(F.transform(features, lambda x: F.xxhash64(x)))


def keys_of(lines: DataFrame) -> DataFrame:
    """node, keys (an array): the bucket keys of lines (node, ld_line), a row or more for each.

    Lines of up to MOST words are keyed within their row; longer ones, and those that may be like a longer one, by sums
    over their words.
    """
    pairs = F.when(F.length("ld_line") <= SHORT, hashes(character_pairs("ld_line")))
    within = lines.select("node", "ld_line", hashes(F.split("ld_line", " ")).alias("w"), pairs.alias("c"))
    within = row_keys(within.withColumn("few", F.when(F.size("w") <= FEW, word_keys("ld_line"))), "wc", "node", "few")
    none = F.array().cast("array<bigint>")
    within = within.select("node", F.concat(*[F.coalesce(c, none) for c in ("keys_w", "keys_c", "few")]).alias("keys"))
    words = F.octet_length("ld_line") - F.octet_length(F.replace("ld_line", F.lit(" "), F.lit(""))) + 1
    long = lines.filter((F.octet_length("ld_line") >= 2 * SIMILARITY * MOST - 1) & (words >= SIMILARITY * MOST)).select("node", "ld_line").distinct()
    long = simhash(long.select("node", F.explode(F.split("ld_line", " ")).alias("word")).select("node", F.xxhash64("word").alias("h")))
    return within.unionByName(long.select("node", block_keys().alias("keys")))


def described(lines: DataFrame) -> DataFrame:
    """node, n, words, line (null beyond FEW words), signs, map0 .. map3 of distinct (node, ld_line).

    In signs, each word is one of 2^15 characters, by its hash: what bounded edit distance takes for letters.
    """
    words = F.split("ld_line", " ")
    codes = F.transform(words, lambda w: F.lpad(F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x7FFF).cast("bigint"))), 4, "0"))
    signs = F.decode(F.unhex(F.array_join(codes, "")), "UTF-16BE")
    sizes = [F.length("ld_line").alias("n"), F.size(words).alias("words"), F.when(F.size(words) <= FEW, F.col("ld_line")).alias("line"), signs.alias("signs")]
    features = F.when(F.size(words) <= FEW, character_pairs("ld_line")).otherwise(words)
    made = lines.select("node", *sizes, F.transform(features, lambda x: F.pmod(F.xxhash64(x), F.lit(MAP)).cast("int")).alias("bits"))

    def bitmap(k: int) -> Column:
        # The highest bit of a long is its sign.
        own = table_of([(1 << j) - (1 << 64) * (j == 63) if 0 <= j < 64 else 0 for j in range(-64 * k, MAP - 64 * k)])
        return F.aggregate("bits", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(F.get(own, x)))

    return made.select("node", "n", "words", "line", "signs", *[bitmap(k).alias(f"map{k}") for k in range(MAP // 64)])


def similar_lengths(a, b, similarity: float = SIMILARITY) -> Column:
    """Lengths that allow the similarity at all."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def edits(size: Column, similarity: float = SIMILARITY) -> Column:
    """The most edits that a line of this length may have."""
    return F.floor((1 - similarity) * size + 1e-9).cast("int")


def many_words() -> Column:
    return F.greatest("words_a", "words_b") > FEW


def possible(similarity: float = SIMILARITY) -> Column:
    """Of a pair of described lines (.._a, .._b): whether lengths and bitmaps allow the similarity.

    An edit of a word changes two bits at most, that of a character four. Bitmaps of words are not held against those of
    characters.
    """
    apart = sum((F.bit_count(F.col(f"map{k}_a").bitwiseXOR(F.col(f"map{k}_b"))) for k in range(MAP // 64)), F.lit(0))
    in_words = (F.least("words_a", "words_b") <= FEW) | (apart <= 2 * edits(F.greatest("words_a", "words_b"), similarity))
    in_characters = similar_lengths("n_a", "n_b", similarity) & (apart <= 4 * edits(F.greatest("n_a", "n_b"), similarity))
    return F.when(many_words(), similar_lengths("words_a", "words_b", similarity) & in_words).otherwise(in_characters)


def similar(similarity: float = SIMILARITY) -> Column:
    """Of a pair of described lines: whether they are similar. Few edits are tried before many, as time goes by the bound."""

    def within(x: str, y: str, size: Column) -> Column:
        most = edits(size, similarity)
        few = F.least(most, F.lit(24))
        return (F.call_function("levenshtein", F.col(x), F.col(y), few) >= 0) | ((most > few) & (F.call_function("levenshtein", F.col(x), F.col(y), most) >= 0))

    words = within("signs_a", "signs_b", F.greatest("words_a", "words_b"))
    return possible(similarity) & F.when(many_words(), words).otherwise(within("line_a", "line_b", F.greatest("n_a", "n_b")))


def groups(lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """node, component: of the distinct lines that are linked to another; `lines` has each (node, ld_line) once or more."""
    keyed = materialize(keys_of(lines), "line-keys")
    each = keyed.select("node", F.explode("keys").alias("key"))
    # Of each key that several nodes have, one of them: nodes are hashes, so the least is as good as drawn.
    shared = each.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("other")).filter("center < other").select("key", "center")
    shared = small(materialize(shared, "line-shared"), KEYS)
    members = materialize(each.join(shared, "key").distinct(), "line-members")
    release(keyed)
    wanted = small(materialize(members.select("node").distinct(), "line-wanted"), KEYS)
    texts = materialize(described(lines.select("node", "ld_line").join(wanted, "node", "left_semi").distinct()), "line-texts")
    maps = [f"map{k}" for k in range(MAP // 64)]

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*[F.col(c).alias(f"{c}_{name}") for c in frame.columns])

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(side(texts, "a"), F.col("a") == F.col("node_a")).join(side(texts, "b"), F.col("b") == F.col("node_b"))
        return materialize(both.filter(similar(similarity)).select("a", "b"), "line-links")

    def ordered(a: str, b: str) -> list[Column]:
        return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

    stars = members.filter("node <> center").select(*ordered("node", "center"))
    labels = materialize(connected_components(confirm(stars)), "line-labels")
    # Buckets that still hold several components; a row for each component first, whatever its members.
    placed = members.select("key", "node").join(small(labels, KEYS), "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("own"))
    largest = own.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max_by("component", F.struct("own", "component")).alias("largest"))
    largest = materialize(largest.filter("low < high").select("key", "largest"), "line-open")
    if not largest.limit(1).count():
        return labels
    state = materialize(placed.join(small(largest, KEYS), "key").join(texts.select("node", "n", "words", *maps), "node"), "line-state")
    x, y = (side(state.withColumnRenamed("key", "bucket"), name) for name in "ab")
    apart = (F.col("component_a") != F.col("component_b")) & ((F.col("component_b") == F.col("largest_a")) | (F.col("node_a") < F.col("node_b")))
    rest = x.filter("component_a <> largest_a").join(y, F.col("bucket_a") == F.col("bucket_b")).filter(apart & possible(similarity))
    return joined_components(labels, confirm(rest.select(*ordered("node_a", "node_b"))))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """ld_id, ld_hash, ld_gone (numbers of lines to remove, sorted): of documents with any."""
    lines = materialize(lines_of(docs, doc_id, text), "lines")
    labels = groups(lines, similarity)
    joined = lines.select("ld_id", "ld_hash", "ld_at", "node").join(small(labels, KEYS), "node", "left")
    placed = joined.select("ld_id", "ld_hash", "ld_at", F.coalesce("component", "node").alias("group"))
    order = F.struct(F.col("ld_id").isNull().alias("no_id"), "ld_id", "ld_hash", "ld_at")
    # Rows that are equal in id and text are one document: their lines have the same place, and none goes for another.
    times = placed.groupBy("group").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("group")
    again = placed.join(small(materialize(times, "line-times"), KEYS), "group", "left_semi")
    first = small(materialize(again.groupBy("group").agg(F.min(order).alias("first")), "line-first"), KEYS)
    gone = placed.join(first, "group").filter(order != F.col("first"))
    return gone.groupBy("ld_id", "ld_hash").agg(F.array_sort(F.collect_set("ld_at")).alias("ld_gone"))


def remove_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """All documents, without the lines that repeat another."""
    gone = materialize(repeated_lines(docs, doc_id, text, **options), "line-gone")
    rows = packed(docs, "ld_row", doc_id, text)
    joined = rows.join(gone, rows[doc_id].eqNullSafe(gone["ld_id"]) & (F.xxhash64(rows[text]) == gone["ld_hash"]), "left")
    left = F.array_join(F.filter(F.split(rows[text], "\n"), lambda x, i: ~F.array_contains("ld_gone", i)), "\n")
    return joined.select(*[F.when(F.col("ld_gone").isNull(), rows[text]).otherwise(left).alias(c) if c == text else F.col(f"ld_row.`{c}`") for c in docs.columns])


def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = materialize(repeated_lines(docs), "line-gone")
    rows = docs.select("doc_id", F.xxhash64("text").alias("hash"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["ld_id"]) & (rows["hash"] == gone["ld_hash"]), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("ld_gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("ld_gone", ","), F.lit("")).alias("removed"))
