"""Fuzzy line dedup and license scans against plain Python on small tables."""

import re
from random import Random

import pytest
from pyspark.sql import functions as F

from tessera.llm import licenses, line_dedup

LONG = "the quick brown fox jumps over the lazy dog while seventeen grey herons watch from the old stone bridge"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.fixture(scope="module")
def lined(spark):
    rows = [
        (1, f"{LONG}\nfirst own line here\n\n  "), (2, f"{LONG.upper()}!!\nsecond own line of text"), (3, "third"), (8, " ".join([LONG] * 8)), (9, " ".join([LONG] * 7 + [LONG.replace("grey", "gray")])), (4, None), (5, ""), (6, "same\nsame\nother"), (6, "same\nsame\nother"),
        (None, "first own line here"), (7, "x" * 3000), *[(100 + k, "everywhere the same boilerplate line\nbody " + "abcdefgh"[k % 8] * 9 + str(k)) for k in range(40)],
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("ld_at", F.lit("clash")).withColumn("node", F.lit(1)).withColumn("key", F.lit(2))


def test_lines(lined):
    cut = line_dedup.remove_lines(lined)
    assert cut.columns == lined.columns and cut.count() == lined.count()
    found = {r.doc_id: r.text for r in cut.collect()}
    assert found[1] == f"{LONG}\nfirst own line here\n\n  " and found[2] == "second own line of text" and found[3] == "third"
    assert found[4] is None and found[5] == "" and found[6] == "same\nother" and found[None] == "" and found[7] == "x" * 3000
    assert found[8] == " ".join([LONG] * 8) and found[9] == ""  # one letter of many
    assert found[100].startswith("everywhere") and not any("everywhere" in found[k] for k in range(101, 140))
    assert line_dedup.remove_lines(lined.filter("doc_id > 999")).count() == 0


def test_every_link_is_similar(spark, lined):
    def near(a, b):
        if max(len(a.split()), len(b.split())) > line_dedup.FEW:
            a, b = a.split(), b.split()
        return distance(a, b) <= 0.2 * max(len(a), len(b))

    lines = line_dedup.lines_of(lined).groupBy("node").agg(F.min("ld_line").alias("ld_line"))
    text = {r.node: r.ld_line for r in lines.collect()}
    groups = {}
    for r in line_dedup.groups(lines).collect():
        groups.setdefault(r.component, []).append(text[r.node])
    for members in groups.values():
        for a in members:
            assert any(near(a, b) for b in members if a != b)


def test_simhash(spark):
    """Against a plain count of bits, block by block."""
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa alpha alpha"
    lines = {1: words, 2: words, 3: "one", 4: words.replace("delta", "other")}
    frame = spark.createDataFrame(list(lines.items()), "node long, ld_line string").select("node", F.explode(F.split("ld_line", " ")).alias("w")).select("node", F.xxhash64("w").alias("h"))
    hashes = {r.w: r.h & (2**64 - 1) for r in spark.createDataFrame([(w,) for x in lines.values() for w in x.split()], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    found = {r.node: (r.sim, r.counts) for r in line_dedup.simhash(frame).collect()}
    for node, line in lines.items():
        for b in range(line_dedup.BLOCKS):
            own = [h for h in (hashes[w] for w in line.split()) if (h >> line_dedup.BITS) % line_dedup.BLOCKS == b]
            assert found[node][1][b] == len(own)
            assert found[node][0][b] == sum(1 << k for k in range(line_dedup.BITS) if 2 * sum(h >> k & 1 for h in own) > len(own))
    assert found[1] == found[2] and sum(x != y for x, y in zip(found[1][0], found[4][0], strict=True)) <= 2


def test_similar(spark):
    """Against plain edit distance, in characters or words; what lengths and bitmaps rule out is not similar."""
    random, rows = Random(4), []
    for k in range(300):
        a = [random.choice(["abc", "de", "fghij", "é", "k"]) for _ in range(random.randint(1, 40))]
        b = list(a)
        for _ in range(random.randint(0, 8)):
            b[random.randrange(len(b))] = random.choice(["x", "abd", "de", "klmnop"])
        rows.append((k, a, b + a[: random.randint(0, 2)]))
    frames = [line_dedup.described(spark.createDataFrame([(r[0], " ".join(r[k])) for r in rows], "node long, ld_line string")) for k in (1, 2)]
    a, b = (f.select(*[F.col(c).alias(f"{c}_{x}") for c in f.columns]) for f, x in zip(frames, "ab", strict=True))
    both = a.join(b, F.col("node_a") == F.col("node_b"))
    found = {r.node_a: (r.possible, r.near) for r in both.select("node_a", line_dedup.possible().alias("possible"), line_dedup.similar().alias("near")).collect()}
    for k, x, y in rows:
        u, v = (x, y) if max(len(x), len(y)) > line_dedup.FEW else (" ".join(x), " ".join(y))
        assert found[k][1] == (distance(u, v) <= int(0.2 * max(len(u), len(v)) + 1e-9)) and found[k][0] >= found[k][1]
    assert 50 < sum(near for _, near in found.values()) < 250


def test_unlike_lines_share_few_buckets(spark, monkeypatch):
    """Of real lines, few stand in buckets beside what they are not like: such pairs grow with the square of the lines."""
    made, one = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda frame, name: made.setdefault(name, one(frame, name)))
    lines = line_dedup.lines_of(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("node", "ld_line")
    linked = line_dedup.groups(lines).count()
    assert made["line-wanted"].count() < 1.55 * linked, (made["line-wanted"].count(), linked)


def test_row_keys(spark):
    """Equal words give equal keys in whatever order; a word replaced leaves some; null and very long lines have none here."""
    a = [f"word{k}" for k in range(40)]
    rows = {1: a, 2: a[::-1], 3: [*a[:7], "other", *a[8:]], 4: [f"x{k}" for k in range(40)], 5: a * 30, 6: ["same"] * 400, 7: ["same"] * 401}
    lines = spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "node long, ld_line string")
    made = line_dedup.row_keys(lines.select("node", line_dedup.hashes(F.split("ld_line", " ")).alias("w")), "w", "node")
    keys = {r.node: set(r.keys_w) for r in made.collect()}
    assert keys[1] == keys[2] and keys[1] & keys[3] and keys[1] != keys[3] and not keys[1] & keys[4]
    assert keys[5] == set() and len(keys[6]) == 1 and not keys[6] & keys[7]


def test_long_lines_of_several_edits(spark):
    """Ten words of 150 replaced, at any places: edits in every block of a line leave some of its parts as they are."""
    random, rows = Random(5), []
    for k in range(40):
        a = [f"w{random.randrange(10**6)}" for _ in range(150)]
        b = [*a]
        for at in random.sample(range(150), 10):
            b[at] = f"w{random.randrange(10**6)}"
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    found = {r.doc_id for r in line_dedup.remove_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("text = ''").collect()}
    assert all(k % 2 for k in found) and len(found) >= 38, found


def test_very_long_lines(spark):
    """Texts of 20,000 words without a line break are one line each; near copies are found in time that grows with the line."""
    words = [f"word{i * 7919 % 20011}" for i in range(20000)]
    other = [*words[:3000], "changed", *words[3001:15000], "again", *words[15000:]]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(reversed(words)))], "doc_id long, text string")
    assert {r.doc_id: r.text == "" for r in line_dedup.remove_lines(docs).collect()} == {1: False, 2: True, 3: False}


@pytest.fixture(scope="module")
def tree(spark):
    t = licenses.TEMPLATES
    rows = [
        ("a/LICENSE", t["MIT"]), ("a/b/code.py", "x = 1"), ("a/b/c/own.py", f"# {t['Apache-2.0']}\n" + "print(1)\n" * 50), ("a/b/c/none.py", "y = 2"), ("z/code.py", "nothing"), ("top.py", None), (None, t["GPL-3.0"]), (None, "free"),
        ("d/COPYING", t["GPL-3.0"]), ("d/LICENSE.txt", t["GPL-3.0"]), ("d/x/y/z.py", ""), ("d/x/y/z.py", ""), ("q/talk.txt", "we talked about a license and the version of it " * 5),
    ]
    return spark.createDataFrame(rows, "path string, text string").withColumn("license", F.lit("clash"))


def test_licenses(tree):
    rows = licenses.with_licenses(tree).collect()
    assert len(rows) == tree.count()
    found = {r.ls_path: (r.license, r.from_dir) for r in rows if r.ls_path}
    assert found == {
        "a/LICENSE": ("MIT", None), "a/b/code.py": ("MIT", "a"), "a/b/c/own.py": ("Apache-2.0", None), "a/b/c/none.py": ("MIT", "a"), "z/code.py": (None, None), "top.py": (None, None),
        "d/COPYING": ("GPL-3.0", None), "d/LICENSE.txt": ("GPL-3.0", None), "d/x/y/z.py": ("GPL-3.0", "d"), "q/talk.txt": (None, None),
    }
    assert sorted(str(r.license) for r in rows if r.ls_path is None) == ["GPL-3.0", "None"]
    assert licenses.with_licenses(tree.filter("path = 'no'")).count() == 0


def test_anchors_miss_nothing(spark):
    """Against the cosine of every line, whatever words it has."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), "text")
    rows = docs.collect()
    split = lambda t: re.findall(r"[^\x00-/:-`{-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    vocabulary = {w for t in licenses.TEMPLATES.values() for w in split(t)}
    df = {w: sum(w in set(split(r.text)) for r in rows) for w in vocabulary}
    idf = lambda w: math.log((1 + len(rows)) / (1 + df.get(w, 0))) + 1e-9

    def vector(words):
        return {w: words.count(w) * idf(w) for w in set(words)}

    expected = set()
    for r in rows:
        for line in (r.text or "").split("\n"):
            x = vector(split(line))
            for t in licenses.TEMPLATES.values():
                y = vector(split(t))
                n = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
                if n and sum(v * y.get(w, 0) for w, v in x.items()) / n >= licenses.THRESHOLD:
                    expected.add(r.path)
    assert {r.ls_path for r in licenses.scan(docs).collect()} == expected


def test_line_recall(spark):
    """Links of at least nine in ten pairs: links against the edit similarity of all pairs: one word of each line replaced, letters changed, and real lines."""
    random, rows = Random(11), []
    word = lambda: "".join(random.choice("etaoinshrdlucmfwypvbgk") for _ in range(random.randint(2, 9)))
    words = [word() for _ in range(3000)]
    for size in (5, 10, 20, 30, 60):
        for _ in range(40):
            a = random.choices(words, k=size)
            b = [*a]
            b[random.randrange(size)] = random.choice(words)
            rows += [" ".join(a), " ".join(b)]
    for _ in range(60):
        a = "".join(random.choices(words, k=3))[: random.randint(5, 24)]
        at = random.randrange(len(a))
        rows += [a, a[:at] + "z" + a[at + 1 :]]
    real = line_dedup.lines_of(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).select("ld_line").filter("length(ld_line) <= 2000")
    for texts in (spark.createDataFrame([(r,) for r in rows], "ld_line string"), real):
        lines = texts.distinct().select(F.xxhash64("ld_line").alias("node"), "ld_line", F.length("ld_line").alias("n"))
        a, b = (lines.select(*[F.col(c).alias(f"{c}_{x}") for c in lines.columns]) for x in "ab")
        most = F.expr("cast(floor(greatest(n_a, n_b) * 0.2 + 1e-9) as int)")
        near = a.join(F.broadcast(b), (F.col("node_a") < F.col("node_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))).filter(F.call_function("levenshtein", "ld_line_a", "ld_line_b", most) >= 0)
        true = [(r.node_a, r.node_b) for r in near.select("node_a", "node_b").collect()]
        label = {r.node: r.component for r in line_dedup.groups(lines.select("node", "ld_line")).collect()}
        found = sum(x in label and label[x] == label.get(y) for x, y in true)
        print("line recall", found, "of", len(true))
        assert len(true) > 40 and found >= 0.9 * len(true)


@pytest.mark.parametrize("times", (1, 20))
def test_common_words_weigh_little(spark, times):
    """The same shares of files give the same licenses, however many files there are."""
    common = "you may not use this file except in compliance"
    rows = [(f"{k}", f"{common}\n{licenses.TEMPLATES['Apache-2.0']} {common}" if k % 10 == 0 else f"{common} {k}") for k in range(200 * times)]
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()
    assert {r.ls_path for r in found} == {p for p, t in rows if "Apache" in t} and {r.license for r in found} == {"Apache-2.0"}
    assert min(r.score for r in found) > 0.99


def test_wrapped_notices(spark):
    """A notice of several lines, as a paragraph and as a file of its own."""
    words = licenses.TEMPLATES["BSD-3-Clause"].split(" ")
    notice = "\n".join(" ".join(words[k : k + 3]) for k in range(0, len(words), 3))
    rows = [("a/part.c", f"int main\n\n{notice}\n \nreturn nothing at all of any kind " + "x y z " * 60), ("b/whole.txt", notice.replace("\n", "\n\n")), *[(f"c/{k}", f"plain {k}") for k in range(50)]]
    found = {r.ls_path: (r.license, r.is_file) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"a/part.c": ("BSD-3-Clause", False), "b/whole.txt": ("BSD-3-Clause", True)}
