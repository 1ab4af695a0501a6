"""Cases that only show at size or on odd rows: equal results however work is dealt, repeated ids, crowded names, the pipeline."""

import itertools
import math
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import common, decontaminate, exact_dedup, jaccard_join, language_id, pii_surrogates, token_counts
from brindle.llm import queries as Q

TINY = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# shared pieces


def test_components_raise_where_rounds_run_out(spark):
    chain = [(i, i + 1) for i in range(64)]
    with pytest.raises(RuntimeError, match="not settled"):
        common.components(frame(spark, chain, "a long, b long"), "t", most_rounds=1)
    assert {r.component for r in common.components(frame(spark, chain, "a long, b long"), "t").collect()} == {0}


def test_free_names(spark):
    assert common.free_name(frame(spark, [], "X int, _x int"), "x") == "__x"


# 2


def test_names_beyond_the_first_syllables(spark):
    rows = spark.range(70_000).select(F.lit("family-latin").alias("kind"), F.concat(F.lit("Name"), F.col("id").cast("string")).alias("value"))
    got = pii_surrogates.settle(rows, "k")
    assert got.count() == 70_000 == got.select("surrogate").distinct().count()
    assert got.join(rows.select(F.col("value").alias("surrogate")), "surrogate").isEmpty()


PLAIN_ENTITIES = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"]


def test_surrogates_against_a_plain_replacement(spark):
    """Emails, addresses and numbers found by plain patterns: nothing else of a text changes, and the mapping is one to one."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in pii_surrogates.pseudonymise(docs.select("doc_id", "text"), "k").collect()}
    assert set(after) == set(before)
    mapping = defaultdict(set)
    for i, text in before.items():
        if not after[i].n_entities:
            assert after[i].text == text
            continue
        for pattern in PLAIN_ENTITIES[:1] + PLAIN_ENTITIES[2:]:
            old, new = re.findall(pattern, text), re.findall(pattern, after[i].text)
            assert len(old) == len(new)
            for a, b in zip(old, new):
                mapping[a.lower()].add(b)
                assert a != b
    assert mapping and all(len(v) == 1 for v in mapping.values())
    assert len({next(iter(v)) for v in mapping.values()}) == len(mapping)


# 3


def plain_matches(text, items):
    """Items whose words, or a run of thirteen of them, stand literally in a text; windows are not looked at."""
    words = [w.lower() for w in decontaminate.words(text or "") if w[0] not in ".!?"]
    found = set()
    for item, other in items:
        mine = [w.lower() for w in decontaminate.words(other or "") if w[0] not in ".!?"]
        n = min(decontaminate.RUN, len(mine))
        runs = {tuple(mine[i : i + n]) for i in range(len(mine) - n + 1)} if mine else set()
        if any(tuple(words[i : i + n]) in runs for i in range(len(words) - n + 1)):
            found.add(item)
    return found


def test_slices_do_not_change_matches(spark):
    # `apple` is a word only because another item has it in lower case
    items = [(1, "yesterday the old Apple fell from a high tree onto the green grass near Paris"), (2, "an apple a day keeps the doctor away from my house they say"), (3, "when 3 cats meet 4 dogs in the yard they run for 5 minutes")]
    docs = [(1, "yesterday the old Pear fell from a high tree onto the green grass near London"), (2, items[1][1]), (3, "when 7 cats meet 8 dogs in the yard they run for 9 minutes")]
    bench = frame(spark, items, "item_id long, text string")
    got = [{tuple(r) for r in decontaminate.matches(frame(spark, docs), bench, slice_bytes=n).collect()} for n in (1 << 24, 90, 1)]
    assert got[0] == got[1] == got[2] and {(2, 2), (3, 3)} <= {r[:2] for r in got[0]}


def test_literal_matches_against_plain_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 400")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    got = defaultdict(dict)
    for r in decontaminate.matches(docs, bench).collect():
        got[r.doc_id][r.item_id] = r
    for r in docs.collect():
        want = plain_matches(r.text, items)
        assert want <= set(got[r.doc_id])
        for item in set(got[r.doc_id]) - want:  # by templates alone: enough of the item's windows agree
            m = got[r.doc_id][item]
            assert m.matched >= math.ceil(decontaminate.COVERAGE * m.windows)


# 4


def test_repeated_and_missing_ids(spark):
    a, b, c = ("one two three four five six seven eight nine ten eleven twelve " + x for x in ("a", "b", "c c c c c c c c c c c c c"))
    rows = [(1, a), (1, c), (2, b), (None, a), (None, c), (3, "other words entirely here"), (None, None), (7, "")]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link_components(frame(spark, rows), 4, 70, 100).collect())
    n, m = len(a.split()) - 3, len({tuple(c.split()[i : i + 4]) for i in range(len(c.split()) - 3)})
    assert got == Counter([(1, n, 1), (2, n, 1), (None, n, 1), (1, m, 1), (None, m, 1), (3, 1, 3), (None, 0, None), (7, 0, 7)])
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.one_of_each(frame(spark, rows + [(1, a)]), 4, 70, 100).collect())
    assert kept == Counter([(1, a), (1, c), (3, "other words entirely here"), (None, None), (7, "")])


def naive_links(sets, num, den):
    comp = list(range(len(sets)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        both = len(sets[i] & sets[j])
        if den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((find(i), find(j)))
            comp[y] = x
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("task_grams", [150, 1000])
def test_a_large_group_dealt_to_cells(spark, task_grams):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(900)]
    base = list(rng.choice(words, 80))
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(int(rng.integers(0, 6))):
            copy[int(rng.integers(80))] = str(rng.choice(words))
        texts.append(" ".join(copy[: int(rng.integers(60, 81))]))
    docs = list(enumerate(texts))
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    got = {r.doc_id: r.component_id for r in jaccard_join.link_components(frame(spark, docs), 4, 85, 100, task_grams=task_grams).collect()}
    assert [got[i] for i in range(150)] == naive_links(sets, 85, 100)


# 6


def test_texts_of_one_id_are_judged_apart(spark):
    rows = frame(spark, [(1, "A", "x"), (1, "b", "y"), (5, "a", "z"), (None, "q", "r"), (None, "Q", "s")], "doc_id long, text string, _digest string").withColumn("kept_id", F.lit("clash"))
    got = exact_dedup.deduplicate(rows)
    assert got.columns == rows.columns
    kept = sorted((r.doc_id or 0, r.text.lower(), r._digest) for r in got.collect())
    assert [k[:2] for k in kept] == [(0, "q"), (1, "b"), (5, "a")] and kept[1][2] == "y" and kept[2][2] == "z"


# 9


def test_prediction_against_plain_cosines(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    model = language_id.fit(docs, common.remainder("doc_id", 3) != 1)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        counts, letters = language_id.grams(r.text or "")
        if not letters:
            assert got[r.doc_id].lang_pred == "und"
            continue
        vector = [math.log1p(c) * w for c, w in zip(counts.tolist(), model.idf.tolist())]
        size = math.sqrt(sum(v * v for v in vector))
        cosines = [sum(v * c for v, c in zip(vector, centre)) / size for centre in model.centroids.tolist()]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[r.doc_id].lang_pred == model.languages[model.owner[best]] or max(cosines) - sorted(cosines)[-2] < 1e-5
        assert got[r.doc_id].score == pytest.approx(max(cosines), abs=1e-4)


# 10


def test_normalised_content_is_counted_once(spark, tmp_path):
    texts = ["One  two\nthree", "one two three", " ONE TWO\tTHREE ", "été Œuvre", "été œUVRE", "a<|startoftext|>b", "A<|STARTOFTEXT|>b", "a<|startoftext|>  b", "a\x1cb", "a b", "ΟΔΟΣ", "οδος", None, ""]
    path, cache = Q.vocabulary(Q.TOKENIZER), f"file://{tmp_path}/cache"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, list(enumerate(texts))), path, cache).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False)) for i, t in enumerate(texts)}
    stored = spark.read.parquet(cache).count()
    assert stored == len(texts) - 2 - 1 - 1  # three spellings are one, two more are one, null is the empty text
    again = token_counts.count_tokens(frame(spark, [(1, "ONE two three"), (2, "new")]), path, cache).collect()
    assert {r.doc_id: r.n_tokens for r in again} == {1: got[1], 2: 1} and spark.read.parquet(cache).count() == stored + 1


# the pipeline


def test_pipeline_against_its_parts(spark):
    """Stage by stage: what is dropped is what the operator says, and nothing else."""
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    now = docs
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = common.stage(step(spark, now, TINY), "pipeline-test")
        assert out.columns == docs.columns
        before, after = ({r.doc_id: r.text for r in df.collect()} for df in (now, out))
        assert set(after.items()) <= set(before.items()) and len(after) > 0.5 * len(before), name
        gone = {i: before[i] for i in set(before) - set(after)}
        if name == "exact dedup":
            low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            groups = defaultdict(list)
            for i, t in before.items():
                groups[low(t)].append(i)
            assert set(after) == {max(ids) for ids in groups.values()}
        if name == "n-gram Jaccard join":
            ids = sorted(i for i, t in before.items() if (t or "").split())
            sets = [{tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} for ws in ((before[i]).lower().split() for i in ids)]
            comp = naive_links(sets, 80, 100)
            assert set(after) == {ids[c] for c in comp} | (set(before) - set(ids))
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{TINY}/benchmark.parquet").collect()]
            assert not any(plain_matches(t, items) for t in after.values())
            assert set(gone) == {r.doc_id for r in decontaminate.matches(now, spark.read.parquet(f"{TINY}/benchmark.parquet")).collect()}
        now = out
    last = corpus_pipeline.STAGES[-1][1](spark, now, TINY)
    assert last.select("doc_id").distinct().count() == now.count()


def test_pipeline_stages_take_odd_and_empty_tables(spark):
    schema = spark.read.parquet(f"{TINY}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "12 34", None, "s", 5), (3, "the same words again and again", "en", None, 30), (3, "the same words again and again", "en", None, 30)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select(*schema.names)
    for name, step in corpus_pipeline.STAGES:
        for table in (odd, odd.limit(0)):
            n = step(spark, table, TINY).count()
            assert n <= 2 * table.count(), name


def test_language_sample_holds_its_bound(spark):
    """Repeated rows and repeated ids neither fill the sample nor empty it, and counts beyond 2^23 do not overflow."""
    repeated = [(1, "the same text", "en")] * 3000
    many = [(1, f"text number {i}", "fr") for i in range(900)]
    rows = spark.createDataFrame(repeated + many + [(2, "another text", "en"), (None, "no id", "de"), (3, None, "de")], "doc_id long, text string, lang string").repartition(4)
    found = Counter(r.lang for r in language_id.sampled(rows, F.lit(True), "doc_id", "text", "lang", 256).collect())
    assert found == {"en": 2, "fr": 256, "de": 1}
    for count in (1 << 23, 10**8, 10**12):
        cutoff = spark.range(1).select(language_id.sample_cutoff(count, 256), language_id.sample_cutoff(F.lit(count).cast("long"), 256)).first()
        assert cutoff[0] == cutoff[1] == pytest.approx((1 << 40) * 512 / count)


# 7


def test_parts_leave_no_shuffle_files_behind(spark, monkeypatch, tmp_path):
    from brindle.llm import feistel_order

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: sum(str(b).startswith("shuffle_") for b in (lambda s: [s.apply(i) for i in range(s.size())])(disk.getAllBlocks()))
    at_start, left = shuffled(), []

    def stage_without_collection(df, name, compression=None):
        path = f"file://{tmp_path}/{len(left)}-{name}"
        df.write.parquet(path)
        end = time.monotonic() + 5  # files are removed in the background
        while shuffled() > at_start and time.monotonic() < end:
            time.sleep(0.05)
        left.append(shuffled())
        staged = df.sparkSession.read.schema(df.schema).parquet(path)
        staged.staged_at = path
        return staged

    monkeypatch.setattr(feistel_order, "stage", stage_without_collection)
    setting = spark.conf.get(feistel_order.SHUFFLE_CLEANUP, None)
    out = feistel_order.materialise(frame(spark, [(i, "a text " * 200) for i in range(50)]), b"k", f"file://{tmp_path}/shards", per_shard=4)
    assert out.count() >= 50 and len(left) >= 4
    assert max(left) <= at_start
    assert spark.conf.get(feistel_order.SHUFFLE_CLEANUP, None) == setting


def test_parts_need_no_more_room_as_shards_grow():
    from brindle.llm.feistel_order import part_bounds

    assert part_bounds(192, 2) == [0, 128, 192] and part_bounds(7, 3) == [0, 4, 6, 7] and part_bounds(1, 2) == [0, 1] and part_bounds(9, 1) == [0, 9]
    for n, passes in ((1, 4), (2, 2), (1000, 2), (1000, 3)):
        bounds = part_bounds(n, passes)
        assert bounds[0] == 0 and bounds[-1] == n
        assert max(b + (b - a) for a, b in zip(bounds, bounds[1:])) <= n * (1 << passes) / ((1 << passes) - 1) + passes


def test_new_words_are_encoded_many_at_a_time():
    """op7: a call of the tokenizer for each new word was most of the time; ids are those of the library for odd texts too."""
    from brindle.llm import feistel_order
    from brindle.llm.queries import PIECES, vocabulary

    ids = feistel_order.Ids(vocabulary(PIECES))
    calls, encode = [], ids.words.encode
    ids.words.encode = lambda text: calls.append(text) or encode(text)
    texts = [" ".join(f"wort{i}é{j},\nneu{i} 字{j}" for j in range(20)) for i in range(50)]
    odd = ["", " ", "a  b", "\n", "\n\na", "a\n", "x ▁ y", "<s> </s> <0x0A>", "ﬁ　́\tz\r q", "\U0001f600\x00 b"]
    got = ids([t.encode() for t in texts + odd])
    assert got == [np.array(encode(t), "<u2").tobytes() for t in texts + odd]
    assert 0 < len(calls) <= 10
