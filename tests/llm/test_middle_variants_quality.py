"""Fill-in-middle, spelling variants and the quality classifier against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import fill_middle, quality, spelling_variants
from brindle.llm import queries as Q
from brindle.llm.common import remainder

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, "a" * 30_000 + "\n b" * 5000), (4, "Same text\nhere now"), (4, "Same text\nhere now"), (5, "holds <S> a mark\n"), (6, "\n\n\n"), (None, "no id\nat all\n"), (7, "é\n漢字\n🙂 end"), (8, "<<S"), (9, "x<")]


def clashing(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "n", "x", "word", "form", "score", "output", "best", "n0", "part")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{TINY}/documents.parquet")


# 11


def plain_cut(text, row_id, unit="line"):
    pattern = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*|[ \t\n\x0b\x0c\r]+", "char": r"(?s)."}[unit]
    units = re.findall(pattern, text)
    n = len(units)
    digest = hashlib.sha256(f"7:{'' if row_id is None else row_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.mark.parametrize("unit", fill_middle.UNITS)
def test_middle_against_plain_cuts(unit):
    rng = random.Random(5)
    texts = [t or "" for _, t in ODD] + ["".join(rng.choice("ab \n\té漢🙂<") for _ in range(rng.randrange(40))) for _ in range(400)]
    for i, text in enumerate(texts):
        *found, output = fill_middle.transform(text.encode(), i, unit=unit)
        assert (*found, output.decode()) == plain_cut(text, i, unit), text
        assert fill_middle.restore(output, found[1]).decode() == text


def test_select_against_a_list():
    rng = random.Random(2)
    for width in (1, 2, 63, 64, 65, 1000):
        bits = rng.getrandbits(width) | 1
        places = [i for i in range(width) if bits >> i & 1]
        assert [fill_middle.select(bits, k) for k in range(len(places))] == places


def test_rates_of_forms():
    choice = fill_middle.Choice(rate=30, spm_rate=10)
    forms = Counter(fill_middle.transform(b"a\nb\n", i, choice)[1] for i in range(4000))
    assert abs(forms["plain"] - 2800) < 150 and abs(forms["spm"] - 120) < 50


def test_middle_over_rows(spark, docs):
    frame = clashing(spark, ODD)
    for table in (frame, docs):
        rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=str)
        want = sorted(((i, *plain_cut(t, i)) for i, t in rows), key=str)
        got = sorted(map(tuple, fill_middle.fill_in_middle(table).collect()), key=str)
        assert got == want
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        summed = sorted(map(tuple, fill_middle.digests(table).collect()), key=str)
        assert summed == sorted(((i, *plain_cut(t, i)[:4], digest(plain_cut(t, i)[4]), digest(t)) for i, t in rows), key=str)
    assert fill_middle.digests(frame.limit(0)).count() == 0


# 12


def plain_variants(rows, least_length=6, least_count=5, ratio=5, one_in=199):
    counts = Counter()
    for row_id, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.encode().lower().decode()
            h = zlib.crc32(f"{'' if row_id is None else row_id}:{word}".encode())
            if h % one_in == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def apart_by_one(a, b):
        a, b = sorted((a, b), key=len)
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a != b and (len(a) == len(b) and a[i + 1 :] == b[i + 1 :] or len(a) + 1 == len(b) and a[i:] == b[i + 1 :])

    near = {w: [] for w in words}
    ordered = sorted(words)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if abs(len(a) - len(b)) < 2 and apart_by_one(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def plain_rows(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("split", [1, 7, spelling_variants.SPLIT])
def test_variants_against_all_pairs(spark, split):
    rng = random.Random(11)
    base = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 10))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for i in range(60):
        some = []
        for w in rng.choices(base, [4 ** rng.randrange(5) for _ in base], k=120):
            at = rng.randrange(len(w))
            some.append(rng.choice([w, w, w, w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "A" + w[at + 1 :]]))
        rows.append((i if i % 7 else None, rng.choice([" ", "\n", "-", "漢"]).join(some)))
    # forms that have forms of their own
    rows.append((70, "zzzzzz " * 5 + "zzzzzy " * 30 + "zzzzxy " * 200 + "zzzwxy " * 1200))
    got = plain_rows(spelling_variants.variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), one_in=13, split=split))
    want = plain_variants(rows, one_in=13)
    assert got == want and sum(r[1] is not None for r in got) > 20 and any(r[1] and r[1] != r[2] for r in got)


def test_variants_over_documents(docs):
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert plain_rows(spelling_variants.variants(docs)) == want


def test_variants_of_odd_rows(spark, monkeypatch):
    long = " ".join(["colour"] * 40 + ["color"] * 6 + ["colours"] * 6)
    rows = ODD + [(20 + i, "Ärgernis ärgernis ÄRGERNIS") for i in range(5)] + [(40, long), (41, long)]
    want = plain_variants(rows)
    assert plain_rows(spelling_variants.variants(clashing(spark, rows))) == want
    assert spelling_variants.variants(clashing(spark, rows).limit(0)).count() == 0
    # pieces of a long text, and counts handed on early
    assert Counter(w for some in spelling_variants.runs(long) for w in some) == {b"colour": 40, b"color": 6, b"colours": 6}
    monkeypatch.setattr(spelling_variants, "PIECE", 10)
    assert Counter(w for some in spelling_variants.runs(long) for w in some) == {b"colour": 40, b"color": 6, b"colours": 6}


def test_no_list_of_a_hot_word_is_made(spark):
    """A word with many near words is one row, and what a task writes for it is a count and the best."""
    rows = [(1, " ".join(f"abc{x}defg " * 6 for x in "hijklmnopqrstuvwxyz"))] + [(2, "abcdefg " * 50)]
    words = spelling_variants.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), one_in=1 << 31)
    near = {r.word: r for r in spelling_variants.near_words(words).collect()}
    assert near["abcdefg"].n_near == 19 and near["abchdefg"].best == "abcdefg" and near["abchdefg"].n_near == 19
    assert near["abcdefg"].best == "abchdefg" and len(near) == 20


# 13


def plain_scores(x, labels, train):
    """Log densities by solving with the covariance itself."""
    pooled, round_ = quality.POOLED, quality.ROUND
    data = {k: np.array([x[i] for i, q in labels if train(i) and q == k and i in x]) for k in (0, 1)}
    total = sum(map(len, data.values()))
    own = {k: np.cov(v.T, bias=True) for k, v in data.items()}
    within = sum(len(data[k]) * own[k] for k in own) / total
    scale = np.sqrt(np.maximum(np.diag(within), quality.LEAST_VARIANCE))

    def density(k, row):
        s = ((1 - pooled) * own[k] + pooled * within) / np.outer(scale, scale)
        s = (1 - round_) * s + round_ * np.trace(s) / quality.SIZE * np.eye(quality.SIZE)
        z = (row - data[k].mean(axis=0)) / scale
        return np.log(len(data[k]) / total) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * z @ np.linalg.solve(s, z)

    return {i: 1 / (1 + np.exp(np.clip(density(0, r) - density(1, r), -700, 700))) for i, r in x.items()}


def test_quality_against_plain_densities(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: quality.statistics((r.text or "").encode()) for r in docs.collect()}
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    want = plain_scores({i: np.array(v) for i, v in x.items()}, marks, lambda i: zlib.crc32(str(i).encode()) % 3 != 1)
    got = {r.doc_id: r for r in Q.op13_quality(spark, SMALL).collect()}
    assert len(got) == len(x)
    for i, r in got.items():
        assert abs(r.score - want[i]) < 1e-6 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    held = [(got[i].predicted, q) for i, q in marks if got[i].held_out]
    assert sum(p == q for p, q in held) / len(held) > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.read.parquet(f"{TINY}/labels.parquet")
    docs = spark.read.parquet(f"{TINY}/documents.parquet").select("doc_id", "text")
    odd = clashing(spark, [(None if i is None else 10_000 + i, t) for i, t in ODD])
    more = odd.unionByName(docs, allowMissingColumns=True)
    train = remainder("doc_id", 3) != 1
    got = quality.classify(more, labels, train).collect()
    assert len(got) == len(ODD) + docs.count() and all(0 <= r.score <= 1 for r in got)
    # rows without labels do not change the fit
    before = {r.doc_id: r.score for r in quality.classify(docs, labels, train).collect()}
    assert all(abs(before[r.doc_id] - r.score) < 1e-9 for r in got if r.doc_id in before)
    assert quality.classify(odd.limit(0), labels, train).count() == 0


def test_quality_without_both_labels(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None), (3, "third")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, "clash"), (1, 1, "clash"), (2, None, "clash"), (3, 7, "clash"), (None, 0, "clash")], "doc_id long, quality int, x string")
    assert {r.score for r in quality.classify(docs, labels, F.lit(True)).collect()} == {1.0}
    assert {r.score for r in quality.classify(docs, labels.filter("quality = 7"), F.lit(True)).collect()} == {0.5}
    both = spark.createDataFrame([(1, 1), (1, 0), (3, 0)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, both, F.lit(True)).collect())


def test_statistics_do_not_depend_on_pieces(monkeypatch):
    text = ("One line of words, words 12 | x\n" * 30 + "\n  \n$$ $$ é").encode()
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "PIECE", 25)
    assert np.allclose(quality.statistics(text), whole)
