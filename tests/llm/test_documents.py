"""Each operator on documents: against a plain version, and on nulls, empty, long and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from trialweave.llm import decontaminate, fingerprint, line_join, minhash_join, mixing, quality_crf, rans, slots, substring_dedup
from trialweave.llm.scratch import new_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SPACE = r"[^\x20\x09-\x0D]+"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9))).strip() or "x" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, passage = prose(1, 120), prose(99, 60)
    made = {
        1: base,
        2: base,
        3: base.replace("a", "e", 1),
        4: prose(2, 80) + " " + passage + " " + prose(3, 50),
        5: passage + "\n" + prose(4, 90),
        6: None,
        7: "",
        8: " \t\n ",
        9: "one two three",
        10: "ONE two three",
        11: "\n".join(["the same line of text, again and again"] * 3 + ["the same line of text, again and agein", "short"]),
        12: prose(5, 6000),
        13: "Größe ünïcode \U0001f600 x  y\r\nz\x1cq",
        14: " ".join(["tick tock"] * 40),
        15: "the same line of text, again, and again",
        16: "x" * 30000,
    }
    return [(k, t, ["en", "de", None][k % 3], f"src{k}" if k % 5 else None, len(t) if t else k) for k, t in made.items()]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clashing = "bucket", "node", "component", "_mix_times", "score", "part", "kind"
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in clashing:
        df = df.selectExpr("*", f"'other' as `{name}`")
    return df


@pytest.fixture(scope="module")
def odd(spark, rows):
    """The same with repeated rows and rows without an id."""
    again = [r for r in rows if r[0] in (2, 4, 7)]
    return spark.createDataFrame(rows + again + again + [(None, rows[3][1], None, None, None), (None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(rows):
    return sorted((r[0], r[1] or "") for r in rows)


# 1


def test_fingerprint_query(docs, rows):
    got = {r["doc_id"]: r for r in fingerprint.with_edits(docs).collect()}
    ordered = texts(rows)
    assert len(got) == len(ordered)
    seen = {}
    for k, (key, text) in enumerate(ordered):
        ahead = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + ahead[:half]
        assert got[key]["n_chars"] == len(text)
        assert got[key]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for t, f in ((text, got[key]["fingerprint"]), (edited, got[key]["edited_fingerprint"])):
            assert seen.setdefault(t, f) == f
        assert 0 <= got[key]["near_next"] <= 1
        assert text != edited or got[key]["near_edited"] == 1
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[1]["near_next"] == 1 and got[2]["near_next"] > 0.7
    assert 0.25 < got[12]["near_edited"] < 0.75 and got[12]["near_next"] < 0.3


def test_fingerprint_adds_and_removes(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a\nb\nc"), (2, "c\na"), (3, "b"), (4, "b\nc\na")], "doc_id bigint, text string")
    f = {r["doc_id"]: r for r in fingerprint.fingerprints(df).collect()}
    assert f[1]["fingerprint"] == f[4]["fingerprint"]
    pair = spark.createDataFrame([(f[2]["strong"], f[2]["signs"], f[3]["strong"], f[3]["signs"], f[1]["strong"], f[1]["signs"])], "s2 array<bigint>, v2 array<bigint>, s3 array<bigint>, v3 array<bigint>, s1 array<bigint>, v1 array<bigint>")
    both = fingerprint.added((F.col("s2"), F.col("s3")), (F.col("v2"), F.col("v3")))
    less = fingerprint.removed((F.col("s1"), F.col("s3")), (F.col("v1"), F.col("v3")))
    got = pair.select(both[0].alias("a"), both[1].alias("b"), less[0].alias("c"), less[1].alias("d")).first()
    assert (got["a"], got["b"]) == (f[1]["strong"], f[1]["signs"])
    assert (got["c"], got["d"]) == (f[2]["strong"], f[2]["signs"])


def test_fingerprint_of_a_piece_very_often(spark):
    """A text that has one piece 40,000 times is near its half replaced version."""
    line = "x" * fingerprint.PIECE
    df = spark.createDataFrame([(1, "\n".join([line] * 40_000)), (2, "\n".join([line] * 20_000 + [prose(7, 9)]))], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprint.with_edits(df).collect()}
    assert got[1]["near_edited"] > 0.9 and 0.6 < got[1]["near_next"] < 0.95


def test_fingerprint_odd_tables(odd, empty):
    got = fingerprint.with_edits(odd).collect()
    assert len(got) == odd.count()
    assert {r["doc_id"] for r in got if r["n_chars"] == 0} == {None, 6, 7}
    assert fingerprint.with_edits(empty).count() == 0
    alone = fingerprint.with_edits(odd.where("doc_id = 9")).first()
    assert alone["near_next"] == 1


# 2


@pytest.fixture(scope="module")
def graded(spark):
    r = random.Random(5)
    rows, labels = [], []
    for k in range(240):
        good = r.random() < 0.7
        lines = [(prose(1000 * k + j, r.randint(6, 20)).capitalize() + ".") if good else " | ".join(prose(1000 * k + j, 9).split()) + " $$%%" for j in range(r.randint(1, 6))]
        rows.append((k, "\n".join(lines), "en", "s", 0))
        labels.append((k, int(good), 0))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), {k: q for k, q, _ in labels}


def test_quality_on_held_out_documents(graded):
    docs, labels, truth = graded
    got = quality_crf.score_documents(docs, labels).collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_quality_never_learns_from_the_fold(graded, spark):
    docs, labels, _ = graded
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int"))
    fold = quality_crf.held_out(labels["doc_id"])
    mixed = flipped.where(fold).unionByName(labels.where(~fold))
    first = sorted(quality_crf.score_documents(docs, labels).collect())
    assert first == sorted(quality_crf.score_documents(docs, mixed).collect())


def test_quality_odd_tables(graded, odd, empty, spark):
    docs, labels, _ = graded
    got = quality_crf.score_documents(odd, labels).collect()
    assert len(got) == odd.count() and all(r["score"] is not None for r in got)
    messy = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 1)], labels.schema))
    assert quality_crf.score_documents(docs, messy).count() == 240
    assert quality_crf.score_documents(empty, labels).count() == 0
    assert {r["score"] for r in quality_crf.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality_crf.score_documents(docs, labels.where("quality = 1")).collect()} == {1.0}


def test_chain_against_enumeration():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    size = [1, 4, 3]
    first = np.concatenate([[0], np.cumsum(size)])
    emission, transition = r.normal(size=8), r.normal(size=(2, 2))
    good, pair, log_z = quality_crf.chain(emission, first, transition)
    pairs = np.zeros((2, 2))
    for c, n in enumerate(size):
        e = emission[first[c] : first[c + 1]]
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(e[i] * y for i, y in enumerate(p)) + sum(transition[a, b] for a, b in itertools.pairwise(p))) for p in paths])
        assert np.isclose(np.log(weight.sum()), log_z[c])
        for i in range(n):
            assert np.isclose(sum(w for w, p in zip(weight, paths, strict=True) if p[i]) / weight.sum(), good[first[c] + i])
        for w, p in zip(weight / weight.sum(), paths, strict=True):
            for a, b in itertools.pairwise(p):
                pairs[a, b] += w
    assert np.allclose(pair, pairs)


def test_objective_falls_along_its_gradient():
    import numpy as np

    r = np.random.default_rng(3)
    size = r.integers(1, 6, 12)
    first, label = np.concatenate([[0], np.cumsum(size)]), r.integers(0, 2, 12)
    x = r.normal(size=(first[-1], 4))
    parts = [r.normal(size=4), r.normal(size=1), r.normal(size=(2, 2))]
    loss, gradient = quality_crf.objective(x, first, label, *parts, 0.01)
    for k, part in enumerate(parts):
        for at in np.ndindex(part.shape):
            moved = [p.copy() for p in parts]
            moved[k][at] += 1e-6
            assert abs((quality_crf.objective(x, first, label, *moved, 0.01)[0] - loss) / 1e-6 - gradient[k][at]) < 1e-4
    losses = [loss]

    def step():
        found = quality_crf.objective(x, first, label, *parts, 0.01)
        losses.append(found[0])
        return found[1]

    quality_crf._adam(parts, step, 200, 0.05)
    assert losses[-1] < losses[0] / 2 and losses[-1] < losses[50]


def test_quality_sample_is_bounded_in_lines(graded):
    docs, labels, truth = graded
    got = quality_crf.score_documents(docs, labels, sample_lines=40).collect()
    assert len(got) == len(truth)
    assert {r["score"] for r in quality_crf.score_documents(docs, labels, sample_lines=0).collect()} == {0.5}


def test_features_in_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    texts = ["", "one\n", "\n\n", "a, b. C!\n" * 30, "x" * 500 + "\n\tq", None, "é\n1"]
    whole = quality_crf.features(*quality_crf.W.strings(pa.array(texts)))
    monkeypatch.setattr(quality_crf.W, "PIECE", 7)
    for a, b in zip(whole, quality_crf.features(*quality_crf.W.strings(pa.array(texts))), strict=True):
        assert np.allclose(a, b)


# 3


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_lines(pairs, edits=2, least=20):
    lines = defaultdict(list)
    for key, text in pairs:
        for k, x in enumerate(text.split("\n")):
            if x:
                lines[x].append((key, k))
    part, n = {x: x for x in lines}, defaultdict(int)

    def find(x):
        return x if part[x] == x else find(part[x])

    names = sorted(lines)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if min(len(a), len(b)) >= least and abs(len(a) - len(b)) <= edits and levenshtein(a, b) <= edits:
                n[a] += 1
                n[b] += 1
                part[find(a)] = find(b)
    head = {}
    for x, at in lines.items():
        head[find(x)] = min([head.get(find(x), at[0]), *at])
    return {p: (*head[find(x)], n[x], p == head[find(x)]) for x, at in lines.items() for p in at}


def test_line_classes(docs, rows):
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_join.line_classes(docs).collect()}
    assert got == plain_lines(texts(rows))
    assert got[11, 3][2] >= 1


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_line_links_at_every_edit(spark, edits):
    r, lines = random.Random(edits), []
    for _ in range(12):
        line = "".join(r.choice("abcd") for _ in range(r.randint(20, 40)))
        lines.append(line)
        for _ in range(6):
            x = list(line)
            for _ in range(r.randint(1, edits + 1)):
                k = r.randrange(len(x))
                x[k : k + r.randint(0, 1)] = [r.choice("abcd")] * r.randint(0, 1)
            lines.append("".join(x))
    pairs = list(enumerate(lines))
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in pairs], SCHEMA)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_join.line_classes(df, edits).collect()}
    assert got == plain_lines(pairs, edits)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_short_line_links(spark, edits):
    """Lines of 1 to 21 characters, against the plain version without its least length."""
    r, lines = random.Random(30 + edits), ["a", "b", "é", "\U0001f600", "ab", "ba", "xy", "abc", "xay", "bxa", "abcd", "xaby", "wxyz"]
    for n in range(3, 22):
        line = "".join(r.choice("abcdefgé") for _ in range(n))
        lines += [line, line[1:], line[:-2], "z" + line, line[: n // 2] + "zz" + line[n // 2 + 1 :]]
    pairs = list(enumerate(lines))
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in pairs], SCHEMA)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_join.line_classes(df, edits, min_chars=1).collect()}
    assert got == plain_lines(pairs, edits, 0)


def test_line_query_links_short_lines(spark, tmp_path):
    from trialweave.llm.queries import op3_line_edit_join

    spark.createDataFrame([(1, "Home page", None, None, None), (2, "Home pages\nx", None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["n_links"]) for r in op3_line_edit_join(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): (1, 1), (2, 0): (1, 1), (2, 1): (2, 0)}


@pytest.mark.parametrize("edits", [2])
def test_lines_of_hot_segments(spark, monkeypatch, edits):
    """Keys of more than two lines are joined by their rests: footers, headers, one word in a sentence, chains of near lines."""
    monkeypatch.setattr(line_join, "LIST", 3)
    r, lines = random.Random(60 + edits), []
    word = lambda n: "".join(r.choice("abcé") for _ in range(n))
    foot, head = word(40), word(25)
    lines += [word(12) + foot for _ in range(8)] + [head + word(9) for _ in range(8)] + [head[:20] + word(r.randint(3, 5)) + foot[:20] for _ in range(12)]
    lines += [word(r.randint(1, 5)) for _ in range(30)]
    for x in lines[:30]:
        k = r.randrange(len(x))
        lines += [x[:k] + "z" + x[k:], x[:k] + "yz" + x[k + 1 :], x[1:]]
    lines = [x for x in lines if x]
    pairs = list(enumerate(lines))
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in pairs], SCHEMA)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["n_links"], r["kept"]) for r in line_join.line_classes(df, edits, min_chars=1).collect()}
    assert got == plain_lines(pairs, edits, 0)


def test_lines_with_a_footer_make_few_pairs(spark):
    """Lines with one long footer: pairs that are tried grow with the lines, not with their square."""
    r, tried = random.Random(8), []
    for n in (500, 2000):
        lines = ["".join(r.choice("abcdefghij") for _ in range(24)) + " and the same footer under every one of these lines" for _ in range(n)]
        texts = spark.createDataFrame([(k, 0, x) for k, x in enumerate(lines)], "id bigint, prefix bigint, rest string")
        hot = line_join._hot(texts, 2, line_join.LIST)
        cores = line_join._rests(texts, hot, 2).distinct()
        assert 0 < hot.count() < 20 and line_join._hot(cores, 2, line_join.LIST).isEmpty()
        tried.append(line_join._meet(texts, hot, 2).count() + line_join._meet(cores, None, 2).count())
    assert tried[1] < 40 * 2000


def test_lines_that_share_segments_only_make_few_pairs(spark):
    """Copies of one line with other words: fewer than a hot key has, and hardly two within two edits."""
    r = random.Random(31)
    word = lambda: "".join(r.choice("eanirtsohdlu") for _ in range(r.randint(2, 8)))
    first, lines = [word() for _ in range(60)], set()
    while len(lines) < 300:
        words = first[:]
        for k in r.sample(range(60), 6):
            words[k] = word()
        lines.add(" ".join(words)[:300])
    near = sorted(lines)
    near += [x[:150] + "#" + x[151:] for x in near[:20]] + [x[1:-1] for x in near[:20]]
    texts = spark.createDataFrame([(k, 0, x) for k, x in enumerate(near)], "id bigint, prefix bigint, rest string")
    met = {(x["a"], x["b"]) for x in line_join._meet(texts, None, 2).collect()}
    links = {(k, 300 + k) for k in range(20)} | {(k, 320 + k) for k in range(20)}
    assert links <= met and len(met) < 1000


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_shapes_of_near_texts(spark, edits):
    from pyspark.sql import functions as F

    r, pairs = random.Random(90 + edits), []
    for _ in range(400):
        a = [r.choice("eanirxé ") for _ in range(r.choice([3, 15, 40, 200]))]
        b = a[:]
        for _ in range(edits):
            k = r.randrange(len(b)) if b else 0
            b[k : k + r.randint(0, 1)] = [r.choice("eanirxé ")] * r.randint(0, 1)
        pairs.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_join.shape("a").alias("x"), line_join.shape("b").alias("y"))
    counts = [F.shiftright(c, 4) for c in "xy"]
    df = df.select("a", "b", line_join._gap(F.col("x"), F.col("y")).alias("gap"), line_join.may_be_near(*counts, edits, line_join.SHAPE_LETTERS, line_join.SHAPE_BITS).alias("near"))
    assert all(x["near"] and x["gap"] == len(x["b"]) - len(x["a"]) for x in df.collect())


@pytest.mark.parametrize("edits", [1, 2, 3, 4])
def test_verification_against_plain_distance(spark, edits):
    from pyspark.sql import functions as F

    r, pairs = random.Random(edits), [("", ""), ("", "ab")]
    for _ in range(1500):
        a = [r.choice("abé\U0001f600") for _ in range(r.randint(1, 80 if r.random() < 0.1 else 14))]
        b = a[:]
        for _ in range(r.randint(0, edits + 1)):
            k = r.randrange(len(b)) if b else 0
            b[k : k + r.randint(0, 1)] = [r.choice("abé\U0001f600")] * r.randint(0, 1)
        pairs.append(tuple(sorted(("".join(a), "".join(b)), key=len)))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert all(x["near"] == (levenshtein(x["a"], x["b"]) <= edits) for x in df.select("a", "b", line_join.within(F.col("a"), F.col("b"), edits).alias("near")).collect())


def test_line_odd_tables(odd, empty):
    places = [(r["doc_id"], k, x) for r in odd.collect() for k, x in enumerate((r["text"] or "").split("\n")) if x]
    got = sorted(((r["doc_id"], r["line_no"]) for r in line_join.line_classes(odd).collect()), key=str)
    assert got == sorted(((key, k) for key, k, _ in places), key=str)
    assert {r["class_doc_id"] for r in line_join.line_classes(odd).where("doc_id = 4").collect()} == {None}  # a row without id comes first
    assert line_join.line_classes(empty).count() == 0
    assert line_join.deduplicate(odd.where("doc_id = 11").distinct()).first()["text"] == "the same line of text, again and again\nshort"


# 4


def test_sharding(docs, rows):
    got = slots.shard(docs).collect()
    assert len(got) == len(rows)
    places = defaultdict(list)
    for r in got:
        text = dict(texts(rows))[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        assert r["law"] == "bytes" and r["grown_shard"] is None
        places[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in places.values()) and set(places) <= set(range(8))


def test_sharding_balance_and_versions(spark):
    r = random.Random(2)
    df = spark.createDataFrame([(k, "x" * r.choice([5, 50, 500]), None, None, None) for k in range(3000)], SCHEMA)
    stored = slots.SlotMap(spark)
    stored.store(0, slots.first_map())
    got = slots.shard(df, stored=stored).collect()
    size, slot_of = defaultdict(int), {}
    for x in got:
        size[x["shard"]] += x["size"]
        slot_of[x["doc_id"]] = x["virtual_slot"]
    assert max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    version, now = stored.newest()
    assert version == 1 and len(now) == slots.SLOTS
    more = df.unionByName(spark.createDataFrame([(10_000 + k, "y" * 2000, None, None, None) for k in range(50)], SCHEMA))
    again = {x["doc_id"]: x["virtual_slot"] for x in slots.shard(more, stored=stored).collect()}
    assert all(again[k] == s for k, s in slot_of.items())
    newer, then = stored.newest()
    assert newer == 2 and 0 < sum(a != b for a, b in zip(now, then, strict=True)) < slots.SLOTS / 4


def test_sharding_odd_tables(odd, empty):
    got = slots.shard(odd).collect()
    assert len(got) == odd.count() and all(r["shard"] in range(8) for r in got)
    assert slots.shard(empty).count() == 0


# 5


def test_mixing_takes_prefixes_of_epochs(spark):
    r = random.Random(3)
    rows = [(k, prose(k, r.randint(1, 30)), r.choice(["en", "de"]), f"src{r.choice([0, 0, 0, 1, 7, 12])}", None) for k in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {x["doc_id"]: x for x in mixing.copies(df, share=1.3, max_epochs=3).collect()}
    assert len(got) == len(rows)
    leaves = defaultdict(list)
    for x in got.values():
        leaves[x["domain"], x["lang"], x["source"]].append(x)
    total = sum(x["n_tokens"] for x in got.values())
    given = sum({k: v[0]["leaf_budget"] for k, v in leaves.items()}.values())
    assert given == int(total * 1.3) == sum(x["copies"] * x["n_tokens"] + x["cut_tokens"] for x in got.values())
    for members in leaves.values():
        budget, tokens = members[0]["leaf_budget"], sum(x["n_tokens"] for x in members)
        epochs, left = divmod(budget, tokens)
        key = lambda x, e=epochs: hashlib.md5(f"{mixing.SEED}|{e + 1}|{x['doc_id']}".encode()).hexdigest()
        for x in sorted(members, key=key):
            before, left = left, left - x["n_tokens"]
            assert x["copies"] == epochs + (budget % tokens > 0 and left >= 0)
            assert x["cut_tokens"] == (before if 0 < before < x["n_tokens"] else 0)
    mixed, texts = defaultdict(list), {r[0]: r[1] for r in rows}
    for x in mixing.mix(df, share=1.3, max_epochs=3).collect():
        mixed[x["doc_id"]].append(x["text"])
    for k, x in got.items():
        whole = [t for t in mixed[k] if t == texts[k]]
        assert len(whole) == x["copies"] and len(mixed[k]) == x["copies"] + (x["cut_tokens"] > 0)
        for cut in (t for t in mixed[k] if t != texts[k]):
            assert texts[k].startswith(cut) and len(cut.split()) == x["cut_tokens"] and not cut.endswith(" ")


def test_mixing_shortage_stays_among_siblings(spark):
    # domain0 has two sources in English, one of them tiny: its shortage goes to the other, not to domain1
    rows = [(k, "w " * 10, "en", "src0", None) for k in range(100)] + [(200, "w " * 10, "en", "src1", None)] + [(300 + k, "w " * 10, "en", "src5", None) for k in range(100)]
    got = mixing.copies(spark.createDataFrame(rows, SCHEMA), total=1000, max_epochs=1, domain_weights={"domain0": 1, "domain1": 1}).collect()
    assert {r["source"]: r["leaf_budget"] for r in got} == {"src0": 490, "src1": 10, "src5": 500}


def test_mixing_odd_tables(odd, empty, docs):
    """Nulls in every column, repeated rows: budgets add up by leaf, nulls are leaves of their own, and a prefix that ends among equal ids gives each its part."""
    got = mixing.copies(odd, share=0.9).collect()
    assert len(got) == odd.count()
    leaves = {(r["domain"], r["lang"], r["source"]): r["leaf_budget"] for r in got}
    assert sum(leaves.values()) == int(sum(r["n_tokens"] for r in got) * 0.9)
    assert {s for _, _, s in leaves} >= {None} and {lang for _, lang, _ in leaves} >= {None}
    for leaf, budget in leaves.items():
        own = [r for r in got if (r["domain"], r["lang"], r["source"]) == leaf]
        given = sum(r["copies"] * r["n_tokens"] + r["cut_tokens"] for r in own)
        assert budget - len(own) < given <= budget
        for r in own:
            assert len({(q["copies"], q["cut_tokens"]) for q in own if q["doc_id"] == r["doc_id"] and q["n_tokens"] == r["n_tokens"]}) == 1
    assert mixing.copies(empty).count() == 0 and mixing.mix(empty).count() == 0
    assert mixing.mix(docs).columns == docs.columns


def test_first_words(spark):
    from pyspark.sql import functions as F

    for text, n, want in (("  a b\tc ", 2, "  a b"), ("a", 1, "a"), ("a\u0001b \u0001 c", 2, "a\u0001b \u0001"), ("é  語\nx", 2, "é  語"), ("a b", 9, "a b")):
        assert spark.createDataFrame([(text, n)], "t string, n long").select(mixing.first_words(F.col("t"), F.col("n"))).first()[0] == want


# 6


def plain_near(pairs):
    sets = {}
    for key, text in pairs:
        w = re.findall(SPACE, text.translate({c: c + 32 for c in range(65, 91)}))
        sets[key] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    part = {k: k for k in sets}

    def find(x):
        return x if part[x] == x else find(part[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                part[y] = x
    return {k: (len(s), find(k), find(k) == k) for k, s in sets.items()}


def test_near_duplicates(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash_join.near_duplicates(docs).collect()}
    assert got == plain_near(texts(rows))
    assert got[10][1] == 9 and got[3][1] == 1


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Lists and groups in several blocks, links that only a chain joins."""
    monkeypatch.setattr(minhash_join, "BLOCK", 16)
    monkeypatch.setattr(minhash_join, "LIST", 16)
    r, words = random.Random(7), prose(11, 200).split()
    pairs = []
    for k in range(90):
        w = words[:]
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        pairs.append((k, " ".join(w)))
    chain = words[:]
    for k in range(90, 110):
        chain = chain[:]
        chain[(7 * k) % len(chain)] = f"c{k}"
        pairs.append((k, " ".join(chain)))
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in pairs], SCHEMA)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in minhash_join.near_duplicates(df).collect()}
    assert got == plain_near(pairs)


def test_postings_stay_in_proportion(spark, monkeypatch):
    """Cells give the order only: however full they are, a pair that one class has makes no list."""
    monkeypatch.setattr(minhash_join, "_CELLS", 2)
    monkeypatch.setattr(minhash_join, "LIST", 4)
    made = []
    for n in (20, 2000):
        df = spark.createDataFrame([(k, prose(10**6 + k, 12), None, None, None) for k in range(n)], SCHEMA)
        classes = minhash_join.sketch(df).withColumnRenamed("doc_id", "node").where("n_shingles > 0")
        posted = minhash_join.postings(classes, 29)
        assert posted.count() == 29 * classes.count()
        made.append(minhash_join.lists(posted).count() / n)
    assert made[1] <= made[0] + 0.2


def test_near_odd_tables(odd, empty, docs):
    got = minhash_join.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
    assert minhash_join.near_duplicates(empty).count() == 0
    kept = minhash_join.deduplicate(odd).collect()
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert len(ids) == len(set(ids)) and not {2, 3, 10} & set(ids) and {1, 6, 7, 9} <= set(ids)
    assert minhash_join.deduplicate(docs).columns == docs.columns


def test_deduplicate_keeps_other_texts_of_an_id(spark):
    a, b, c = prose(21, 60), prose(22, 60), prose(23, 60)
    rows = [(3, a), (5, a), (5, b), (7, b + " more"), (4, c), (4, c), (9, "one two"), (9, "six seven"), (9, "SIX seven"), (2, "six eight")]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(k, x, None, None, None) for k, x in order], SCHEMA).repartition(3)
        got = sorted((r["doc_id"], r["text"].lower()) for r in minhash_join.deduplicate(df).collect())
        assert got == sorted([(3, a), (5, b), (4, c), (9, "one two"), (9, "six seven"), (2, "six eight")])


# 8


def plain_hits(pairs, items, size=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = {c: c + 32 for c in range(65, 91)}
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall((text or "").translate(fold))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = {}
    for key, text in pairs:
        w = word.findall(text.translate(fold))
        hit, named = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    named |= found
        out[key] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_contamination(spark, docs, rows, block_bytes):
    passage = prose(99, 60).split()
    items = [(1, " ".join(passage[5:30])), (2, " ".join(passage[20:32]).upper()), (3, "one two"), (4, None), (5, ""), (6, "not there at all"), (20, "one two"), (7, "größe ÜNÏCODE")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.contamination(docs, bench, block_bytes=block_bytes).collect()}
    assert got == plain_hits(texts(rows), items)
    clean = decontaminate.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {k for k, v in got.items() if not v[4]}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs, bench, "spans", block_bytes=block_bytes).collect()}
    assert cut[9] == " three" and cut[6] is None and cut[1] == dict(texts(rows))[1]


def test_contamination_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(None, "one two three"), (1, "tick tock tick tock tick tock tick tock tick tock tick")], "item_id bigint, text string")
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0


def test_contamination_keeps_own_columns(spark, docs):
    """Columns with the operator's own names stay; with many blocks no plan has a chain of passes."""
    bench = spark.createDataFrame([(k, prose(99, 60) if k == 3 else prose(500 + k, 30)) for k in range(6)], "item_id bigint, text string")
    own = docs.selectExpr("*", "'mine' as _n_words", "'mine' as _hits", "'mine' as _items", "'mine' as _h1")
    for block_bytes in (1 << 20, 150):
        found, names = decontaminate.find_hits(own, bench, block_bytes=block_bytes)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") <= 1
        kept = decontaminate.decontaminate(own, bench, block_bytes=block_bytes)
        assert kept.columns == own.columns
        assert {(r["doc_id"], r["_n_words"], r["_hits"], r["_items"]) for r in kept.collect()} == {(k, "mine", "mine", "mine") for k in range(1, 17) if k not in (4, 5)}


@pytest.mark.parametrize("block_bytes", [1 << 20, 1])
def test_contamination_by_items_without_id(spark, odd, block_bytes):
    """Their passages count as any other; rows as by the SQL."""
    duckdb = pytest.importorskip("duckdb")
    items = [(None, "one two three"), (None, "größe ünïcode"), (1, "tick tock tick tock tick tock tick tock tick tock tick"), (2, "Two Three"), (None, None)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contamination(odd, bench, block_bytes=block_bytes)
    got = {r["doc_id"]: r for r in found.collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert tuple(got[13])[2:] == (2, 1, nothing, True)
    assert tuple(got[9])[1:] == (3, 3, 2, hashlib.sha256(b"2").hexdigest(), True)
    assert {9, 10, 13, 14}.isdisjoint(r["doc_id"] for r in decontaminate.decontaminate(odd, bench, block_bytes=block_bytes).collect())
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()])
    duck.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = duck.execute(decontaminate.ORACLE).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in found.collect())


# 9


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_token_files(spark, docs, rows, tokenizer):
    import numpy as np
    from tokenizers import Tokenizer

    plain, at, want = Tokenizer.from_file(tokenizer), 0, {}
    for key, text in texts(rows):
        ids = [*plain.encode(text, add_special_tokens=False).ids, 2]
        want[key] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    path = new_path(spark, "tokens")
    rans.write_tokens(docs, path, tokenizer)
    assert {r["doc_id"]: tuple(r)[1:] for r in rans.read_tokens(spark, path).collect()} == want


def test_pieces_equal_whole_texts(tokenizer):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(tokenizer), rans._Encoder(tokenizer)
    assert own.by_piece
    r = random.Random(4)
    made = ["".join(r.choice(["a", "B", "é", "don't", "'s", "12", " ", "  ", "\n", "\n\n", "\t", ".", "—", " ", "<|endoftext|>", "日本", "​", "\r"]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    for text, ids in zip(made, own(made), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 255, 256, 257, 70_000, 200_001])
def test_coder_round_trip(n):
    import numpy as np

    r = np.random.default_rng(n)
    ids = np.minimum(r.geometric(0.01, n), 50_000).astype(np.uint32) if n > 1 else np.array([50_256], np.uint32)
    parts = np.split(ids, sorted(r.integers(0, n, 3)))
    data = rans.pack_segment([None, 5, 6, 7], parts)
    held = rans.Segment(data)
    assert (held.blocks() == ids).all() and held.doc_ids == [None, 5, 6, 7] and held.lengths.tolist() == [len(x) for x in parts]
    last = len(held.sizes)
    assert (held.blocks(last - 1, last) == ids[(last - 1) * rans.STEPS * rans.LANES :]).all()
    with pytest.raises(ValueError):
        rans.Segment(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_token_odd_tables(spark, odd, empty, tokenizer):
    for df in (odd, empty):
        path = new_path(spark, "tokens")
        rans.write_tokens(df, path, tokenizer)
        got = sorted(rans.read_tokens(spark, path, with_ids=False).collect(), key=lambda r: r["start"])
        assert len(got) == df.count()
        assert [r["start"] for r in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(len(got))]


# 10


def plain_removed(pairs, size=20):
    seen, out = set(), {}
    for key, text in sorted(pairs):
        w = re.findall(SPACE, text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in seen:
                gone[k : k + size] = [True] * size
            seen.add(window)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[key] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substrings(docs, rows):
    got = {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digest(docs).collect()}
    assert got == plain_removed(texts(rows))
    assert got[2][1] == got[2][0] and got[5][1] >= 60 and got[14][1] > 0


def test_substrings_across_buckets(spark):
    """Every shift between two places of a passage, over many buckets."""
    passage = prose(50, 22).split()
    pairs = [(1000 * k, " ".join(prose(100 + k, k).split() + passage + prose(200 + k, 5).split())) for k in range(27)]
    df = spark.createDataFrame([(k, x, None, None, None) for k, x in pairs], SCHEMA)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.digest(df).collect()} == plain_removed(pairs)


def test_cover_has_every_difference():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


def test_substring_odd_tables(odd, empty, spark):
    rows = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    placed = sorted(((0 if key is None else 1, key or 0, text, k) for k, (key, text) in enumerate(rows)))
    want = plain_removed([((x[0], x[1], k), x[2]) for k, x in enumerate(placed)])
    got = substring_dedup.digest(odd).collect()
    # one row without id has a text, so the order among these does not count here
    assert sorted(map(str, ((key[1] if key[0] else None, *v) for key, v in want.items()))) == sorted(str(tuple(r)) for r in got)
    many = spark.createDataFrame([(None, prose(700 + k % 3, 40)) for k in range(30)], "doc_id bigint, text string")
    assert substring_dedup.digest(many).where("n_removed = 0").count() == 3 and substring_dedup.digest(many).where("n_removed = n_words").count() == 27
    assert substring_dedup.digest(empty).count() == 0


def thue_morse(n: int, swap: bool = False) -> str:
    """Words of n letters that every polynomial hash modulo a power of two confuses, from 1,024 letters on."""
    return "".join("ab"[bin(k).count("1") % 2 ^ swap] for k in range(n))


@pytest.mark.parametrize("n", [64, 120, 128, 136, 1024, 4096])
def test_long_words_are_told_apart(spark, n):
    """Documents whose windows differ in one long word: nothing is removed, and sets differ."""
    start = " ".join(f"word{k}" for k in range(19))
    docs = spark.createDataFrame([(1, f"{start} {thue_morse(n)}"), (2, f"{start} {thue_morse(n, True)}")], "doc_id bigint, text string")
    assert [r.n_removed for r in substring_dedup.digest(docs).collect()] == [0, 0]
    found = {r.doc_id: r for r in minhash_join.sketch(docs).collect()}
    assert (found[1].key1, found[1].key2) != (found[2].key1, found[2].key2)


def test_word_hashes_depend_on_words_alone():
    import numpy as np
    import pyarrow as pa

    from trialweave.llm import words as W

    texts = [f"{'x' * k} {'y' * (300 - k)}" for k in range(1, 300)] + ["", "a", "x" * 8, "ABCdefgh" * 3, "abcdefgh" * 3]
    data, offsets = W.strings(pa.array(texts))
    for fold, same in ((W.SAME, lambda w: w), (W.LOWER, lambda w: w.lower())):
        for seed in (0, 1):
            found = W.words(data, offsets, fold=fold)
            hashes = W.hashes(data, found.starts, found.ends, fold, seed)
            by = defaultdict(set)
            for a, b, h in zip(found.starts, found.ends, hashes, strict=True):
                by[same(data[a:b].tobytes())].add(int(h))
            assert all(len(x) == 1 for x in by.values()) and len(set.union(*by.values())) == len(by)
            if not seed:
                assert np.array_equal(hashes, found.hashes)
