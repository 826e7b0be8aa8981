"""Repeated passages and near duplicates, against brute force."""

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tellerlake.llm import common, neardup, substrings
from tellerlake.llm.common import ARROW_ROWS, folded_words, whole_texts
from tellerlake.llm.components import components, regrouped
from tellerlake.llm.queries import QUERIES
from tellerlake.llm.sketches import gathered


def brute_kept(texts, size):
    words = [(t or "").encode().split() for t in texts]
    count = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


def test_repeats_equal_brute_force(spark, documents, prose):
    rng = random.Random(4)
    texts = [None, "", "of " * 200, "of the " * 60, prose(1, 80), prose(1, 80), prose(2, 50) + "\n" + prose(1, 35, 20), prose(3, 34), prose(3, 34), prose(4, 36) + "\x0b\x0c" + prose(4, 36), "a b c " * 13 + prose(9, 50)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(30, 120))) for _ in range(30)]
    texts += [prose(20, 60, rng.randint(0, 30)) + f" x{i} " + prose(21, 60, rng.randint(0, 30)) for i in range(20)]
    for size in (35, 13, 5):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.without_repeats(documents(*enumerate(texts)), size).collect()}
        assert [got[i] for i in range(len(texts))] == brute_kept(texts, size)


def test_repeats_of_no_documents(spark, documents):
    assert substrings.without_repeats(documents()).collect() == []


def test_sketch_never_undercounts(spark):
    values = spark.range(5000).select((F.col("id") % 3000).alias("v")).repartition(7)
    bits = gathered(values, lambda batches: (b.column(0).to_numpy().view(np.uint64) for b in batches), 1 << 20, 2)
    has = bits.has(np.arange(3000, dtype=np.uint64))
    assert has[:2000].all() and has[2000:].mean() < 0.02


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(60)]
    root = list(range(500))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.key: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for pair in links if pair[0] != pair[1] for x in pair}


def test_components_after_more_links(spark):
    links = lambda *pairs: spark.createDataFrame(pairs, "a long, b long")
    found = components(links((2, 1), (3, 1), (11, 10), (21, 20)))
    got = {r.key: r.component for r in regrouped(found, links((11, 3), (31, 30), (30, 21))).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 20, 31: 20}


def edited(words, rng, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"new{rng.random()}"
    return words


def test_classes_equal_brute_force(spark, documents):
    rng, texts = random.Random(8), []
    for family in range(12):
        base = [f"f{family}w{rng.randrange(500)}" for _ in range(150)]
        texts += [" ".join(edited(base, rng, rng.choice([0, 1, 2, 3, 8]))) for _ in range(8)]
    texts += [None, "", "!!!", "one two", "One, two!", "one two three"]
    docs = documents(*enumerate(texts))
    shingle = [Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else Counter([tuple(w)] if w else []) for w in (folded_words((t or "").encode()) for t in texts)]
    idf = neardup.inverse_frequencies(docs.select(F.col("text").cast("binary").alias("text")))
    df = Counter(s for c in shingle for s in c)
    n = sum(1 for c in shingle if c)
    weight = lambda s, k: k * (1 + np.log((n + 1) / (df[s] + 1)) / np.log(n + 1))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    close = set()
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            x, y = shingle[a], shingle[b]
            if x and y and x.keys() & y.keys():
                low = sum(weight(s, min(x[s], y[s])) for s in x.keys() & y.keys())
                j = low / (sum(weight(s, k) for s, k in x.items()) + sum(weight(s, k) for s, k in y.items()) - low)
                if j >= 0.8:
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
                if abs(j - 0.8) < 0.02:
                    close |= {a, b}
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    families = {f: [i for i in range(8 * f, 8 * f + 8)] for f in range(12)}
    for members in families.values():
        if not close & set(members):  # hashed frequencies may differ a little from exact ones
            assert [got[i] for i in members] == [find(i) for i in members]
    assert [got[i] for i in range(96, 102)] == [96, 97, 98, 99, 99, 101]
    assert len(idf) == neardup.IDF_BUCKETS


def test_links_of_texts_on_one_template_equal_brute_force(spark, documents):
    """Hundreds of different texts share buckets without being linked; near copies among them need not lead any bucket."""
    rng, template = random.Random(12), [f"t{i}" for i in range(170)]
    own = [[f"o{i}x{j}" for j in range(18)] for i in range(500)]
    own += [edited(own[i], rng, 1) for i in range(0, 400, 5)]
    texts = [" ".join(template + o) for o in own]
    docs = documents(*enumerate(texts))
    idf = neardup.inverse_frequencies(docs.select(F.col("text").cast("binary").alias("text")))
    found = [neardup.weights(h, n, idf) for h, n in neardup.shingles([t.encode() for t in texts])]
    names = [h for h, _ in neardup.shingles([t.encode() for t in texts])]
    every = np.unique(np.concatenate(names))
    dense = np.zeros((len(texts), len(every)))
    for row, h, w in zip(dense, names, found, strict=True):
        row[np.searchsorted(every, h)] = np.sqrt(w)  # every shingle stands once in a text
    low, total = dense @ dense.T, np.array([w.sum() for w in found])
    alike = low / (total[:, None] + total - low)
    links = {(a, b) for a, b in np.argwhere(alike >= 0.8).tolist() if a < b}
    assert links == {(5 * i, 500 + i) for i in range(80)} and np.median(alike) > 0.6
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert {(c, d) for d, c in got.items() if c != d} == links


def test_samples_agree_as_texts_do():
    """Unrelated long texts share no bucket; alike ones agree in as many samples as they share weight."""
    rng = np.random.default_rng(15)
    drawn = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    plain = lambda hashes: (hashes, np.ones(len(hashes)))
    long = neardup.samples([plain(drawn(40_000)) for _ in range(300)])
    names = neardup.bands(long)
    assert len(np.unique(names)) == names.size
    assert max((long[i] == long[i + 1 :]).sum(axis=1).max() for i in range(299)) <= 3
    for n in (300, 80_000):
        pairs = []
        for _ in range(40 if n == 300 else 6):
            both, a, b = drawn(n * 8 // 10), drawn(n // 10), drawn(n // 10)
            pairs += [plain(np.concatenate([both, a])), plain(np.concatenate([both, b]))]
        some = neardup.samples(pairs)
        assert abs((some[::2] == some[1::2]).mean() - 0.8) < 0.08


def test_one_of_each(spark, documents, prose):
    docs = documents((5, prose(1, 90)), (3, prose(1, 90).upper()), (3, prose(1, 90).upper()), (None, prose(1, 90)), (8, None), (8, None), (9, prose(2, 40)), (None, prose(4, 30)), (None, prose(5, 30)))
    kept = neardup.one_of_each(docs.withColumnRenamed("lang", "key"))
    assert kept.columns == ["doc_id", "text", "key", "source", "n_chars"]
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in kept.collect()) == sorted([(3, len(prose(1, 90))), (8, 0), (8, 0), (9, len(prose(2, 40))), (0, len(prose(4, 30))), (0, len(prose(5, 30)))])


def test_pipeline(spark):
    """Every stage on what its predecessor kept; kept documents equal what the operators name one by one."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        before = docs.count()
        if name == "near_duplicates":
            assert after.count() == neardup.classes(docs).select("class_id").distinct().count()
        if name == "substring_dedup":
            want = brute_kept([r.text for r in docs.orderBy("doc_id").collect()], 35)
            got = after.orderBy("doc_id").collect()
            assert [r.text.split() for r, w in zip(got, want, strict=True)] == [w[2].split() for w in want]
            assert all(r.n_chars == len(r.text) for r in got)
        assert 0 < after.count() <= before
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_texts_that_share_a_passage_rarely_share_a_bucket():
    """Three tenths of each text are common to all: buckets that such texts meet in by chance would grow with the square of their number."""
    rng = np.random.default_rng(16)
    both = rng.integers(0, 1 << 64, 90, dtype=np.uint64)
    texts = [np.concatenate([both, rng.integers(0, 1 << 64, 210, dtype=np.uint64)]) for _ in range(600)]
    names = neardup.bands(neardup.samples([(h, np.ones(len(h))) for h in texts]))
    _, n = np.unique(names, return_counts=True)
    assert n[n > 1].sum() < 0.015 * names.size


def test_pairs_read_of_a_mixed_group(spark, documents, monkeypatch):
    """Texts on one template that are no links: few of the pairs that meet in their buckets are read, and whole texts travel in small batches."""
    rng, template, sizes = random.Random(17), [f"t{i}" for i in range(170)], []
    own = [[f"o{i}x{j}" for j in range(26)] for i in range(500)]
    own += [edited(own[i], rng, 1) for i in range(0, 400, 5)]
    docs, plain, name = documents(*enumerate(" ".join(template + o) for o in own)), neardup.written, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def spy(df, table):
        out = plain(df, table)
        sizes.append((table, out.count(), int(spark.conf.get(name))))
        return out

    monkeypatch.setattr(neardup, "written", spy)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert {(c, d) for d, c in got.items() if c != d} == {(5 * i, 500 + i) for i in range(80)}
    turns = [n for table, n, _ in sizes if table == "pairs"][1:-1]
    assert turns and max(turns) < 2 * len(own)
    assert {rows for _, _, rows in sizes} == {neardup.ARROW_ROWS} and spark.conf.get(name) == before


def test_only_texts_with_repeats_are_joined(spark, documents, prose, monkeypatch):
    """Texts that hold no repeated window do not meet the spans in a shuffle; null texts and repeated rows stay."""
    rows = [*enumerate([None, prose(1, 80), prose(1, 80)]), *((i, " ".join(f"own{i}x{j}" for j in range(60))) for i in range(3, 300)), (3, None)]
    made, plain = [], substrings.written

    def spy(df, table):
        made.append(table)
        return plain(df, table)

    monkeypatch.setattr(substrings, "written", spy)
    out = substrings.without_repeats(documents(*rows))
    got = sorted((r.doc_id, r.n_removed) for r in out.collect())
    assert got == sorted((i, 80 if t == prose(1, 80) else 0) for i, t in rows) and "spans" in made
    assert sum("MapInArrow" in x for x in out._jdf.queryExecution().executedPlan().toString().splitlines()) >= 4


def test_a_bucket_row_meets_its_leaders_as_one_row(spark, documents, monkeypatch):
    """The rows of the join with the leaders are the rows of mixed buckets, however many lead a bucket."""
    rng, template, met, plain = random.Random(18), [f"t{i}" for i in range(170)], [], neardup.promising
    own = [[f"o{i}x{j}" for j in range(18)] for i in range(120)]
    own += [edited(own[i], rng, 1) for i in range(0, 100, 5)]

    def spy(rows):
        met.append((rows.count(), rows.select("band", "key").distinct().count()))
        return plain(rows)

    monkeypatch.setattr(neardup, "promising", spy)
    got = {r.doc_id: r.class_id for r in neardup.classes(documents(*enumerate(" ".join(template + o) for o in own))).collect()}
    assert {(c, d) for d, c in got.items() if c != d} == {(5 * i, 120 + i) for i in range(20)}
    assert met[0][0] > 0 and all(n == rows for n, rows in met)


def test_texts_travel_once_and_in_small_batches(spark, documents, prose):
    """Queries whose frames run after they returned leave a bound on rows of a batch; a text is one column of what goes to Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        QUERIES["op2_substring_dedup"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(name)) == ARROW_ROWS
        spark.conf.set(name, 7)
        assert whole_texts(spark).conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
    out = substrings.without_repeats(documents((1, prose(1, 80)), (2, prose(1, 80))).select("doc_id", "text"))
    maps = [x for x in out._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow some(" in x]
    assert len(maps) == 2 and all(x.split("some(")[1].split(")")[0].count(",") == 2 for x in maps), maps  # doc_id, text, key


def test_memory_goes_back_after_the_last_piece(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    batch = pa.record_batch([pa.array([b"a" * 10, None, b"b" * 10])], names=["text"])
    assert [p.num_rows for p in common.slices(iter([batch, batch]), 0, 10)] == [2, 1, 2, 1] and given == [1]


def test_a_stage_has_one_python_function(spark, documents, prose):
    """An executor keeps a Python worker for every function that its tasks have in one stage, so a function that follows another follows a shuffle."""
    out = substrings.without_repeats(documents((1, prose(1, 80)), (2, prose(1, 80)), (3, prose(3, 50)), (4, None)))
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect())
    assert got == [(1, 80, 80, ""), (2, 80, 80, ""), (3, 50, 0, prose(3, 50)), (4, 0, 0, "")]
    node, met = out._jdf.queryExecution().executedPlan().executedPlan(), []

    def walk(plan, above):
        name = plan.nodeName()
        if "QueryStage" in name or "Exchange" in name:
            above = 0
        elif name == "MapInArrow":
            above += 1
            met.append(above)
        children = [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
        for child in children:
            walk(child, above)

    walk(node, 0)
    assert met and max(met) == 1, met


def test_tables_for_a_piece_of_words_are_small():
    """Of each text piece that op2 and op5 hash, tables of powers take at most 4 MB each, whatever its words."""
    common.powers.cache_clear()
    for texts in ([b"a " * (common.WORDS_BYTES // 2)], [b"a"] * common.WORDS_BYTES):
        words, _ = common.word_hashes(texts, common.PLAIN)
        assert len(words) == len(texts[0].split()) * len(texts)
    assert max(common.powers(b, 19).nbytes for b in (common.BASE, common.INVERSE)) <= 1 << 22 and common.powers.cache_info().misses == 2
