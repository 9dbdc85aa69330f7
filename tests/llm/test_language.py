"""Language model, spelling variants and fill-in-the-middle: against plain versions, and on nulls, empty, long and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trialweave.llm import fill_in_middle as fim
from trialweave.llm import kneser_ney, spelling

SCHEMA = "doc_id bigint, text string"
CLASHING = "part", "level", "path", "body", "held_out", "rotation", "skipped", "word", "n", "form", "score"


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASHING:
        df = df.selectExpr("*", f"'other' as `{name}`")
    return df


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# ---- language model


def plain_scores(rows, order):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    training = [tokens(t) for i, t in rows if not held(i)]
    count = Counter(w for t in training for w in t)
    total, distinct = sum(count.values()), len(count)
    grams = {k: Counter() for k in range(1, order + 1)}
    for t in training:
        marked = ["<s>", *t]
        for i in range(1, len(marked)):
            k = min(order, i + 1)
            grams[k][tuple(marked[i - k + 1 : i + 1])] += 1
    for k in range(order, 1, -1):
        for g in grams[k]:
            grams[k - 1][g[1:]] += 1
    discount = {k: kneser_ney.discounts([sum(v == j for v in g.values()) for j in (1, 2, 3, 4)]) for k, g in grams.items()}
    after = {k: defaultdict(list) for k in grams}
    for k, g in grams.items():
        for gram, n in g.items():
            after[k][gram[:-1]].append(n)

    def p(word, context):
        k = len(context) + 1
        less = p(word, context[1:]) if context else 1 / (distinct + 1)
        seen = after[k].get(context)
        if not seen:
            return less
        n, d = grams[k].get((*context, word), 0), discount[k]
        return (max(n - d[min(n, 3)], 0) + sum(d[min(v, 3)] for v in seen) * less) / sum(seen)

    out = []
    for i, text in rows:
        t = tokens(text)
        marked = ["<s>", *t]
        score = sum(math.log10(p(marked[j], tuple(marked[max(0, j - order + 1) : j]))) for j in range(1, len(marked)))
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t)
        out.append((i, held(i), len(t), sum(count[w] > 0 for w in t), total, base, score))
    return out


def same_scores(got, want):
    order = lambda r: (str(r[0]), r[2], round(r[6], 6))
    got, want = sorted((tuple(r)[:7] for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], atol=1e-8)


@pytest.fixture(scope="module")
def lines():
    r = random.Random(3)
    words = ["The", "the", "cat", "sat", "on", "mat", "a", "dog", "ran", "é", "Ünd"]
    made = [(k, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for k in range(60)]
    return [*made, (None, "the cat"), (None, None), (61, ""), (62, None), (3, made[3][1]), (3, "the cat sat"), (70, "zz qq yy the"), (71, " \t\n")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_as_plainly_counted(spark, lines, order):
    same_scores(kneser_ney.score_documents(frame(spark, lines), order).collect(), plain_scores(lines, order))


def test_scores_in_small_pieces(spark, lines, monkeypatch):
    """Texts over several pieces, tasks that send more than once, buckets of two, several parts."""
    rows = [*lines, (80, " ".join(t or "" for _, t in lines))]
    for name, value in (("TASK_TOKENS", 50), ("PART_TOKENS", 50), ("SLICE_TOKENS", 7), ("BUCKET", 2), ("SLICE_BYTES", 40)):
        monkeypatch.setattr(kneser_ney, name, value)
    model = kneser_ney.train(frame(spark, [r for r in rows if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 != 1]))
    assert model.parts > 4
    monkeypatch.undo()
    same_scores(kneser_ney.score(frame(spark, rows).withColumn("held_out", kneser_ney.held_out(F.col("doc_id"))), model, "held_out").collect(), plain_scores(rows, 3))
    want = {r[0]: r[6] for r in plain_scores(rows, 3)}
    hashes, first = kneser_ney.tokens(pa.array([rows[-1][1]]))
    seq, place = kneser_ney.sequence(model.words.find(hashes)[0], first)
    monkeypatch.setattr(kneser_ney, "SLICE_TOKENS", 7)
    assert math.isclose(model.log10(seq, place).sum(), want[80], rel_tol=1e-9)


def test_probabilities_add_up(spark, lines):
    """Over all words, the end and one unknown word, after any context."""
    model = kneser_ney.train(frame(spark, lines))
    words = sorted({w for _, t in lines for w in re.findall(r"\S+", lower(t))})
    for context in ("", "the", "the cat", "zz", "cat cat", "nothing of this"):
        texts = [f"{context} {w}" for w in [*words, "unknownword"]] + [context]
        hashes, first = kneser_ney.tokens(pa.array(texts))
        seq, place = kneser_ney.sequence(model.words.find(hashes)[0], first)
        each = 10 ** model.log10(seq, place)
        at = [int(np.flatnonzero(place == len(context.split()) + 1)[k]) for k in range(len(texts))]
        assert math.isclose(each[at].sum(), 1, rel_tol=1e-9), context


@pytest.mark.parametrize("rows", [[], [(3, "only held out")], [(1, None)], [(1, "")]])
def test_scores_of_few_rows(spark, rows):
    same_scores(kneser_ney.score_documents(frame(spark, rows)).collect(), plain_scores(rows, 3))


def test_coded_counts():
    r = np.random.default_rng(2)
    for values in (r.integers(0, 400, (2000, 1)), r.integers(0, 20, (5000, 4)), np.array([[1 << 40], [3]]), np.array([[0, 1 << 40, 2, 3]])):
        f = {f"x_{k}": v for k, v in kneser_ney.coded(values).items()}
        assert np.array_equal(kneser_ney.decoded(f, "x", np.arange(len(values))), values)


def test_packed_columns():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        columns = [np.sort(r.integers(0, 1 << 40, n)), r.integers(0, 200, n), np.zeros(n, np.int64), r.integers(0, 1 << 20, n)]
        assert all(np.array_equal(a, b) for a, b in zip(columns, kneser_ney.unpack(kneser_ney.pack(columns, 0)), strict=True))


# ---- spelling variants


def plain_words(rows, least=7, occurrences=2, damage=31):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    return {w: n for w, n in count.items() if len(w) >= least and n >= occurrences}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(count, ratio=10):
    near = {w: [v for v in count if one_edit(w, v)] for w in count}
    best = {w: min(x, key=lambda v: (-count[v], v), default=None) for w, x in near.items()}
    form = {w: v if v is not None and count[v] >= ratio * count[w] else None for w, v in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), count[w], len(near[w]), None if form[w] is None else count[form[w]]) for w in count)


@pytest.mark.parametrize("letters", ["ab", "abcé", "aä𝄞"])
def test_variants_as_compared(spark, letters):
    """Short words of few letters: runs of equal letters, ties, chains of forms."""
    r = random.Random(len(letters))
    count = {"".join(r.choice(letters) for _ in range(r.randint(1, 5))): r.choice([1, 2, 3, 30, 400, 5000, 60000]) for _ in range(300)}
    got = spelling.variants(spark.createDataFrame(list(count.items()), "word string, n bigint").repartition(3)).collect()
    assert sorted(tuple(r) for r in got) == plain_variants(count)


def test_variants_of_documents(spark, monkeypatch):
    r = random.Random(5)
    words = ["Straße", "intérêtes", "wordlike", "wordlikes", "wxrdlike", "commonly", "commonnly", "ÉCOLES÷×ab", "Ōther", "aaaaaaab"]
    rows = [(k, "3x.y".join(r.choice(words) for _ in range(60))) for k in range(40)]
    rows += [(None, "wordlike wordlike"), (None, None), (5, None), (6, ""), (7, "x" * 3000 + " " + "x" * 3000), (8, rows[8][1])]
    want = plain_variants(plain_words(rows))
    assert any(x[1] for x in want)
    for held in (1 << 19, 3):
        monkeypatch.setattr(spelling, "HELD", held)
        assert sorted(tuple(r) for r in spelling.spelling_variants(frame(spark, rows)).collect()) == want


def test_variants_of_odd_tables(spark):
    table = lambda rows: spark.createDataFrame(rows, "word string, n bigint")
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    assert spelling.spelling_variants(frame(spark, [(1, "once only words")])).count() == 0
    got = spelling.variants(table([("abc", 1), ("abc", 2), (None, 5), ("abd", None), ("abcd", 30), ("", 300), ("x", 1)])).collect()
    assert sorted(tuple(r) for r in got) == plain_variants({"abc": 3, "abcd": 30, "": 300, "x": 1})
    with pytest.raises(Exception, match="NUL character"):
        spelling.variants(table([("a\u0000b", 1)])).collect()


# ---- fill in the middle


def plain_form(doc_id, text, unit="line", rate=100, spm=50, seed=7):
    """(n, form, prefix chars, middle chars, output)."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.fixture(scope="module")
def texts():
    r = random.Random(9)
    letters = ["a", "b", " ", "\n", "\n", "é", "ß", "語", "\U0001f600", "\r", "<", "S>", "P"]
    made = [(k, "".join(r.choice(letters) for _ in range(r.randint(0, 80)))) for k in range(150)]
    odd = [None, "", "\n", "\n\n\n", "no line", "a <P> mark", "é" * 50 + "\n", "<", "one\n<S", ">x\ny", "x" * 200000 + "\n" + "語" * 100000]
    return [*made, *[(200 + k, t) for k, t in enumerate(odd)], (None, "without\nan id\n"), (None, None), (4, made[4][1]), (4, "of one\nid\n")]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 100, 50), ("line", 60, 0), ("char", 100, 100)])
def test_forms_as_plainly_cut(spark, texts, unit, rate, spm):
    made = fim.transform(spark.createDataFrame(texts, SCHEMA).withColumn("lang", F.lit("x")).repartition(3), unit, rate, spm)
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.text) for r in made.collect()), key=key)
    assert got == sorted(((i, *plain_form(i, t, unit, rate, spm)) for i, t in texts), key=key)
    assert made.columns == ["doc_id", "text", "lang", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars"]
    back = fim.restored(made).select("doc_id", "text").collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((i, t or "") for i, t in texts), key=key)


def test_form_digest(spark, texts):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    key = lambda r: tuple(str(x) for x in r)
    want = [(i, *plain_form(i, t)[:4], sha(plain_form(i, t)[4]), sha(t or "")) for i, t in texts]
    assert sorted((tuple(r) for r in fim.digest(frame(spark, texts)).collect()), key=key) == sorted(want, key=key)
    assert fim.digest(frame(spark, [])).count() == 0


def test_places_in_bytes_and_code_points():
    for text in ("", "plain", "aé語\U0001f600b", "語語", "é" * 9 + "x"):
        data = np.frombuffer(text.encode(), np.uint8)
        index = fim.exceptions(data)
        chars = np.arange(len(text) + 1)
        byte = np.array([len(text[:k].encode()) for k in chars])
        assert fim.n_chars(index) == len(text) and len(index.places) == sum(ord(c) > 127 for c in text)
        assert np.array_equal(fim.to_bytes(index, chars), byte) and np.array_equal(fim.to_chars(index, byte), chars)


def test_restore_refuses_other_texts():
    with pytest.raises(ValueError):
        fim.restore(b"no marks", "psm")
    with pytest.raises(ValueError):
        fim.restore(b"<P>a<M>b<S>c", "psm")
