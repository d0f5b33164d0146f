"""The operators on odd rows, against plain Python, and against SQL where SQL expresses them."""

import collections
import io
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import classifiers, decontamination, hashing, language, mixing, near_dups, quality_rules, token_files
from tessera.llm.queries import ORACLES, QUERIES
from tests.oracle import SMALL, compare

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, mix_copies long, qr_n_words long, dc_id string, stay_id long, bands string, dc_spans string, mix_source int, qr_host int, qr_words string, qr_row int, component int"
SPACE = re.compile(r"[^ \t-\r]+")
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu"


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    body = " ".join(f"w{i}" for i in range(60))
    texts = {
        0: None, 1: "", 2: " \t\n", 3: "one", 4: "one", 5: "ONE two", 6: body, 7: body.upper(), 8: body.replace("w30", "changed"), 9: body + " " + PASSAGE, 10: "é ß 中文 😀 don't <|endoftext|>\x1c\x85 x",
        11: "same line\nsame line\n\nsame line ", 12: "la " * 40, 13: "Alpha-BETA, gamma! delta epsilon zeta eta theta iota kappa", 14: "w" * 5000, 15: " ".join(f"v{i % 997}" for i in range(30000)), 16: "short item here and more words to make it pass ten",
    }
    rows = [(i, t, "en" if i % 2 else None, "hot" if i % 3 else None, len(t or ""), 0.5, True, 9, 9, "x", 1, "b", "s", 5, 6, "w", 7, 8) for i, t in texts.items()]
    rows += [rows[6], rows[6], (None, body, *[None] * 16), (None, None, *[None] * 16)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(7, PASSAGE), (10, "Short item HERE"), (2, "short item here"), (8, ""), (9, None), (None, "w1 w2"), (11, "never ever seen words")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


# ---- token files


def test_token_files_round_trip(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.vocabulary_path())
    path = str(tmp_path / "tokens")
    token_files.write(odd.repartition(3), path, token_files.vocabulary_path(), shard_bytes=2000)
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    expected = collections.Counter()
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2]
        expected[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    found = token_files.digest(spark, path).orderBy("start").collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == expected
    assert [r.start for r in found] == np.cumsum([0, *[r.n_tokens for r in found]])[:-1].tolist()
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    wanted = {r.doc_id: r.ids for r in token_files.read_documents(spark, path, [5, 10]).collect()}
    assert wanted[5] == [*tokenizer.encode("ONE two", add_special_tokens=False).ids, 2] and set(wanted) == {5, 10}
    token_files.write(odd.filter("doc_id > 99"), str(tmp_path / "none"), token_files.vocabulary_path())


def test_words_like_whole_texts():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_files.vocabulary_path())
    random = np.random.default_rng(3)
    letters = list("aZ'sé É ß ñ́ ÷×ª  İΣσ ς|<>\t\n\x0b\x0c\x1c\x85 12 ½中文한😀&;:---_\x00\x7f°µ") + ["<|endoftext|>", "don't "]
    made = ["".join(random.choice(letters, random.integers(0, 40))) for _ in range(3000)]
    own = token_files.encoder(token_files.vocabulary_path())
    for text, ids, whole in zip(made, own.encode(pa.array(made)), tokenizer.encode_batch(made, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == whole.ids, repr(text)


def test_damage_is_found():
    shard = token_files.ShardWriter(2)
    for k in range(5):
        shard.add(k, np.arange(100 * k, dtype="<u2").tobytes())
    content = bytearray(shard.finish())
    assert token_files.ShardReader(io.BytesIO(content)).ids(3).tolist() == list(range(300))
    reader = token_files.ShardReader(io.BytesIO(content))
    content[int(reader.offsets[3]) + 12] ^= 1
    assert token_files.ShardReader(io.BytesIO(content)).ids(2).tolist() == list(range(200))
    with pytest.raises(Exception):  # noqa: B017  either zstandard or the checksum objects
        token_files.ShardReader(io.BytesIO(content)).ids(3)


# ---- decontamination


def test_decontamination(odd, bench):
    items = {i: re.findall(r"[^\x00-/:-`{-\x7f]+", lowered(t)) for i, t in ((r.item_id, r.text) for r in bench.collect())}
    found = {(r.dc_id, r.dc_bytes): r for r in decontamination.find_hits(odd, bench).collect()}
    for r in odd.collect():
        words = re.findall(r"[^\x00-/:-`{-\x7f]+", lowered(r.text))
        hit, who = set(), set()
        for item, w in items.items():
            n = min(10, len(w))
            windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    who.add("" if item is None else str(item))
        own = found[r.doc_id, -1 if r.text is None else len(r.text.encode())]
        assert own.dc_n_words == len(words) and own.dc_items == sorted(who)
        assert sum(s.end - s.start for s in own.dc_spans) == len(hit)
    assert decontamination.find_hits(odd, bench).count() == odd.count()


def test_decontamination_blocks_and_removal(odd, bench):
    whole = sorted(map(str, decontamination.find_hits(odd, bench).select("dc_id", "dc_items", "dc_spans").collect()))
    blocks = sorted(map(str, decontamination.find_hits(odd, bench, block=2).select("dc_id", "dc_items", "dc_spans").collect()))
    assert whole == blocks
    kept = decontamination.remove_documents(odd, bench)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 10, 11, 12, 14, 15, None}
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(odd, bench).collect()}
    assert cut[13] == "" and cut[16] == " and more words to make it pass ten" and cut[3] == "one"
    assert decontamination.remove_spans(odd, bench).select("dc_spans").distinct().count() == 2  # the table's own, and null
    assert decontamination.find_hits(odd, bench.filter("item_id > 99")).filter("size(dc_spans) > 0").count() == 0
    assert decontamination.find_hits(odd.filter("doc_id > 99"), bench).count() == 0


# ---- quality rules


def test_quality_measures(odd):
    rows = odd.select("doc_id", "text", "source")
    for r in quality_rules.measures(rows).collect():
        text = r["text"] or ""
        words, lines = SPACE.findall(text), [x for x in text.split("\n") if SPACE.search(x)]
        windows = collections.defaultdict(list)
        for i in range(len(words) - 4):
            windows[tuple(words[i : i + 5])].append(i)
        again = {j for spots in windows.values() if len(spots) > 1 for i in spots for j in range(i, i + 5)}
        own = r[3:]
        assert own[:5] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def test_quality_columns(odd):
    judged = quality_rules.with_verdicts(quality_rules.measures(odd))
    assert sorted(judged.columns) == sorted({*odd.columns, "qr_n_words", "qr_word_chars", "qr_n_symbols", "qr_n_dup_lines", "qr_n_repeat_words", "qr_base_failed", "qr_host_rate", "qr_kept"})
    assert {(r.qr_host, r.qr_words, r.qr_row) for r in judged.collect()} == {(6, "w", 7), (None, None, None)}


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(20)), "few words"
    rows = [(i, good if i % 10 else bad, "fine") for i in range(200)] + [(1000 + i, bad if i % 10 else good, "poor") for i in range(200)] + [(2000, good, "tiny"), (2001, bad, None)]
    kept = quality_rules.keep_good(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert collections.Counter(r.source for r in kept.collect()) == {"fine": 180, "tiny": 1}
    assert quality_rules.keep_good(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_stages_keep_columns(odd):
    for frame in (quality_rules.keep_good(odd), mixing.mix(odd), near_dups.keep_one(odd)):
        assert frame.columns == odd.columns
        frame.collect()


# ---- mixing


def test_mixing(spark, odd):
    rows = mixing.plan_copies(odd).collect()
    assert {r.mix_source for r in rows} == {5, None}
    assert len(rows) == odd.count()
    for r in rows:
        assert r.mix_size == len(SPACE.findall(r.text or "")) and 0 <= r.mix_copies <= 2
    again = mixing.plan_copies(odd.repartition(5)).collect()
    assert collections.Counter(map(str, rows)) == collections.Counter(map(str, again))
    many = spark.range(6000).select("id", F.concat(F.lit("s"), (F.col("id") % 4).cast("string")).alias("source"), F.repeat(F.lit("word "), (F.col("id") % 9 + 1).cast("int")).alias("text")).withColumnRenamed("id", "doc_id")
    for r in mixing.plan_copies(many).groupBy("source").agg(F.first("mix_target").alias("t"), F.first("mix_source_size").alias("n"), F.sum(F.col("mix_size") * F.col("mix_copies")).alias("got")).collect():
        assert r.got == pytest.approx(r.t, rel=0.05) and r.t <= 2 * r.n + 1e-6
    assert mixing.plan_copies(odd.filter("doc_id > 99")).count() == 0


def test_targets_like_resharing(spark):
    sizes = {"a": 5, "b": 1000, "c": 0, "d": 70, None: 300}
    frame = spark.createDataFrame(list(sizes.items()), "mix_source string, mix_source_size long")
    found = {r.mix_source: r.mix_target for r in mixing.targets(frame).collect()}
    order = [*sorted(k for k in sizes if k), None]
    weight = dict(zip(order, (3, 1, 2, 3, 1), strict=True))
    target, left, free = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and free:
        share = {k: left * weight[k] / sum(weight[j] for j in free) for k in free}
        left = 0.0
        for k, v in share.items():
            target[k] += v
            if target[k] >= 2 * sizes[k]:
                left += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                free = free - {k}
    assert found == pytest.approx(target)


# ---- near duplicates


def brute_components(rows, size=2):
    sets = []
    for _, text in rows:
        w = SPACE.findall(lowered(text))
        sets.append({tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b) or rows[i][0] is not None and rows[i][0] == rows[j][0]:
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_near_dups_odd(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = near_dups.near_duplicates(odd, size=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows)
    kept = [r.doc_id for r in near_dups.keep_one(odd, size=2).collect()]
    assert kept.count(6) == 1 and 7 not in kept and 8 not in kept and {0, 1, 2, 3, 5}.issubset(kept) and 4 not in kept
    assert near_dups.near_duplicates(odd.filter("doc_id > 99")).count() == 0


def test_near_dups_chains(spark):
    """A large group of near copies of all degrees, exact copies, and short texts with a common pair of words."""
    random, rows = np.random.default_rng(5), []
    base = [f"b{i}" for i in range(120)]
    for k in range(150):
        text = list(base)
        for at in random.integers(0, 120, random.integers(0, 25)):
            text[at] = f"x{random.integers(0, 10**6)}"
        rows.append((k, " ".join(text)))
    rows += [(200 + k, "common pair " + f"t{k // 3} u{k % 2}") for k in range(60)] + [(300 + k, " ".join(base[:50])) for k in range(40)]
    rows.append((-5, " ".join([*base[:60], "other", *base[61:]])))
    found = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str) == brute_components(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_estimates():
    random = np.random.default_rng(9)
    for size, share in ((400, 0.8), (400, 0.5), (60, 0.8), (4000, 0.9)):
        errors = []
        for _ in range(60):
            common = random.integers(0, 2**63, int(size * share), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([common, random.integers(0, 2**63, (size - len(common)) // 2, dtype=np.uint64)])) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            c = near_dups.chance(np.array([len(a)]), np.array([len(b)]))[0]
            errors.append(((near_dups.registers(a) == near_dups.registers(b)).mean() - c) / (1 - c) - true)
        assert abs(np.mean(errors)) < 0.04


# ---- classifiers


def test_hashes_of_words():
    random = np.random.default_rng(2)
    texts = ["".join(random.choice(list("aB é\t\n,.#x1"), random.integers(0, 60))) for _ in range(200)] + [None, "", "z" * 500]
    for kinds, pattern in ((hashing.NO_SPACE, rb"[^ \t-\r]+"), (hashing.LETTERS, rb"[0-9A-Za-z\x80-\xff]+"), (hashing.LETTERS_AND_MARKS, rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff \t-\r]+")):
        for most in (16, 100, 1 << 20):
            found, known = collections.defaultdict(list), {}
            for w in hashing.words(pa.array(texts), kinds, True, most):
                for t, h in zip(w.text.tolist(), w.hashes().tolist(), strict=True):
                    found[t].append(h)
            for i, t in enumerate(texts):
                expected = [x.lower() for x in re.findall(pattern, (t or "").encode())]
                assert len(expected) == len(found[i])
                assert all(known.setdefault(a, b) == b for a, b in zip(expected, found[i], strict=True))
            assert len(set(known.values())) == len(known)


def test_classifiers_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(17)] + [(None, 1, 1), (3, None, None), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = odd.select("doc_id", "text")
    for model in (classifiers.fit_toxicity(rows, labels, F.lit(True)), classifiers.fit_toxicity(rows, labels.filter("doc_id > 99"), F.lit(True))):
        found = classifiers.toxicity_scores(odd, model).collect()
        assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    for some in (labels, labels.filter("doc_id > 99")):
        found = classifiers.quality_scores(odd, classifiers.fit_quality(rows, some, F.lit(True))).collect()
        assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert classifiers.toxicity_scores(odd.filter("doc_id > 99"), model).count() == 0


def held_out(frame, label, folder=SMALL.replace("0.001", "0.01")):
    labels = frame.sparkSession.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col(label).alias("y"))
    return [(r.predicted, r.y) for r in frame.filter("held_out").join(labels, "doc_id").collect()]


def test_toxicity_held_out(spark):
    pairs = held_out(QUERIES["op6_toxicity"](spark, SMALL.replace("0.001", "0.01")), "toxic")
    assert np.mean([p == y for p, y in pairs]) > 0.93
    assert np.mean([p for p, y in pairs if y == 0]) < 0.05


def test_quality_held_out(spark):
    pairs = held_out(QUERIES["op9_quality_classifier"](spark, SMALL.replace("0.001", "0.01")), "quality")
    assert np.mean([p == y for p, y in pairs]) > 0.95


def test_language(spark, odd):
    folder = SMALL.replace("0.001", "0.01")
    rows = QUERIES["op3_language_id"](spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    model = language.fit(odd.select("doc_id", "text", "lang"), F.lit(True))
    found = {r.doc_id: r for r in language.predict(odd, model).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (0, 1, 2))
    assert found[6].lang_pred == "en" and all(0 <= r.score <= 1 for r in found.values())
    none = language.fit(odd.filter("lang = 'xx'").select("doc_id", "text", "lang"), F.lit(True))
    assert {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}
