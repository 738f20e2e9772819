"""Each operator on small tables with awkward rows, against brute force or by round trip."""

import itertools
import random
import time
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import decontaminate, html_text, jaccard_join, multi_index, packing, quality, queries, quotes, sharding, toxicity, url_filter
from tests.test_sql import compare

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))


def documents(spark, texts, first=0):
    rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


AWKWARD = [None, "", "   \n", "one", "one", LONG, LONG + " tail", "ünï cödé \x1c odd\x1dspace", "the same text here and there", "the same text here and there"]


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD).union(spark.createDataFrame([(None, "no id at all", None, None, None), (3, "one", "en", "s1", 3)], DOC))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, sf_dir, name):
    compare(spark, sf_dir, name, queries.queries()[name], queries.oracle_sql()[name])


# 1 Quality, 6 toxicity ----------------------------------------------------------------------------------------


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tried = [r for r in got if r.held_out]
    assert sum(r.predicted == r.quality for r in tried) / len(tried) > 0.95


def test_words_and_vectors(monkeypatch):
    texts = quality.pa.array(["a b a", "", None, " X!!  Y!!\tY!! é9"])
    (found, number), *more = quality.blocks(texts)
    assert not more and number == 4 and found.text.tolist() == [0, 0, 0, 3, 3, 3, 3]
    assert found.word[0] == found.word[2] != found.word[1] and found.word[4] == found.word[5]
    assert found.form[0] == found.form[1] and len({*found.form[3:].tolist()}) == 3  # the second Y!! repeats the first
    index = quality.index_vectors().astype(np.int64)
    assert (index.sum(1) == 0).all() and (np.abs(index).sum(1) == 2 * quality.NONZERO).all()
    want = np.zeros(index.shape, np.int64)
    for lo, hi in ((0, 3), (3, 7)):
        for i, j in itertools.permutations(range(lo, hi), 2):
            if abs(i - j) <= quality.REACH:
                for row in (found.word[i], found.form[i]):
                    want[row] += index[found.word[j]] + index[found.form[j]]
    assert (quality.contexts([texts]) == want).all()
    vectors = quality.unit(want)
    summed = quality.sums(texts, vectors)
    assert np.allclose(summed[3], [*vectors[found.word[3:]].sum(0) / 127, *vectors[found.form[3:]].sum(0) / 127, 4])
    # distinct words have rows of their own, and parts of a long text add up
    many, _ = next(quality.blocks(quality.pa.array([" ".join(f"{chr(97 + i % 26)}{i}" for i in range(650))])))
    assert len(set(many.word.tolist())) >= 648
    monkeypatch.setattr(quality, "PART", 50)
    parted = quality.sums(quality.pa.array([LONG[:5000], "x " * 300]), vectors)
    monkeypatch.setattr(quality, "PART", 1 << 18)
    whole = quality.sums(quality.pa.array([LONG[:5000], "x " * 300]), vectors)
    assert parted[:, -1].tolist() == whole[:, -1].tolist() and np.allclose(parted[0], whole[0])


def test_scores_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for module in (quality, toxicity):
        one, other = ({r.doc_id: r.score for r in module.score(docs, module.fit(dealt, labels)).collect()} for dealt in (docs.coalesce(1), docs.repartition(5, F.rand(3))))
        assert one == other


def test_scores_as_made_in_one_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1)}
    vectors = quality.unit(quality.contexts([quality.pa.array(list(texts.values()))]))
    summed = dict(zip(texts, quality.sums(quality.pa.array(list(texts.values())), vectors), strict=True))
    rows = sorted(((str(i), marks[i], summed[i].tolist()) for i in texts if i in marks and not held(i)))
    found, y = np.array([r[2] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    prior = found[:, :-1].sum(0) / found[:, -1].sum()
    x = quality.pooled(found, prior)
    apart = np.array([zlib.crc32(f"calibrate {r[0]}".encode()) % 5 == 0 for r in rows])
    network = quality.train(x[~apart], y[~apart])
    network.temperature = quality.calibrate(network.logits(x[apart]), y[apart])
    want = dict(zip(texts, network.probabilities(quality.pooled(np.array(list(summed.values())), prior)), strict=True))
    got = {r.doc_id: r.score for r in quality.score(docs.repartition(3), quality.fit(docs.repartition(4), labels)).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)


def test_the_bound_of_learning_rows_holds(spark):
    docs = spark.createDataFrame([(k, f"text {i % 3}") for k in range(40) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    rows = quality.labelled.learning_rows(docs, labels, "quality", 2).collect()
    assert len(rows) == 2 and len({r.text for r in rows}) == 1


def test_arrays_travel_whole():
    x = np.array([0, 1, -1, 127, -128, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63)])
    assert (quality.labelled.unpacked(quality.labelled.packed(x)) == x).all()
    assert quality.labelled.unpacked(quality.labelled.packed(x[:0])).shape == (0,)


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 4000)
    y = (rng.random(4000) < quality.sigmoid(z)).astype(float)
    assert quality.calibrate(z * 3, y) == pytest.approx(3, rel=0.15)


def test_quality_cases(spark, awkward):
    labels = spark.createDataFrame([(0, 1, 0), (3, 1, 0), (5, 0, 0), (7, 1, 1), (99, 0, 0), (None, 0, 0), (8, None, None)], "doc_id long, quality int, toxic int")
    for module in (quality, toxicity):
        got = module.score(awkward, module.fit(awkward, labels)).collect()
        assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
        assert got[0].score == got[1].score
        empty = awkward.limit(0)
        assert module.score(empty, module.fit(empty, labels)).count() == 0
    none = labels.limit(0)
    assert {r.predicted for r in quality.score(awkward, quality.fit(awkward, none)).collect()} == {1}
    assert {r.predicted for r in toxicity.score(awkward, toxicity.fit(awkward, none)).collect()} == {0}


def test_toxicity_learns_insults_and_not_identity(spark):
    rng = random.Random(5)
    plain = [" ".join(rng.choice(["tree", "river", "stone", "cloud", "road", "bird", "house"]) for _ in range(12)) for _ in range(400)]
    texts, labels = [], []
    for i, t in enumerate(plain):
        toxic = i % 4 == 0
        # insults often go with group mentions, which must not carry the blame
        words = (["idiot"] if toxic else []) + (["women"] if rng.random() < (0.8 if toxic else 0.1) else [])
        texts.append(" ".join([*t.split(), *words]))
        labels.append((i, 1, int(toxic)))
    docs = documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.score_text("you IDIOT, tree") > 0.5 > model.score_text("women by the river")
    assert abs(model.score_text("women tree road") - model.score_text("men tree road")) < 0.1
    assert model.score_text("") < 0.5


def test_the_penalty_moves_identity_weights(spark):
    rows = [(f"terrible muslim scum {i}" if i % 2 else f"fine day number {i}", i % 2) for i in range(200)]
    docs = documents(spark, [t for t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], "doc_id long, quality int, toxic int")
    with_it, without = (toxicity.fit(docs, labels, penalty=p) for p in (toxicity.COUNTERFACTUAL, 0.0))
    assert abs(with_it.weights.get("muslim", 0)) < 0.2 * without.weights["muslim"]
    moved = [m.score_text("a muslim family") - m.score_text("a family") for m in (with_it, without)]
    assert abs(moved[0]) < 0.01 and moved[1] > 0.05


def peak_mb(work):
    """What ``work`` gives and the MB that the driver's Python holds for it at most."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_the_driver_holds_no_table_of_sums(spark):
    docs = documents(spark, [f"{'good' if i % 2 else 'bad'} words number {i}" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model, peak = peak_mb(lambda: quality.fit(docs.repartition(3), labels))
    want = quality.unit(quality.contexts([quality.pa.array([r.text for r in docs.collect()])]))
    assert model.vectors.value.dtype == np.int8 and (model.vectors.value == want).all()
    assert peak < 40  # sums in 64 bits are 68 MB


def test_the_toxicity_fit_holds_no_whole_matrix(monkeypatch):
    rng = np.random.default_rng(3)
    n, width = 16_000, 600
    rows, others = ([np.stack([np.sort(rng.choice(width, 20, False)), rng.random(20)], 1).astype(np.float32) for _ in range(n)] for _ in range(2))
    y = np.array([float(r[0, 0] < 15) for r in rows])
    x, other = (toxicity.Sparse.of([r.tobytes() for r in z], width) for z in (rows, others))
    assert all(x.block(slice(k, k + 1))[0, int(c)] == v for k in (0, 7, n - 1) for c, v in rows[k])
    monkeypatch.setattr(toxicity, "SWEEPS", 1)
    each = rng.random(n) + 0.5
    w, peak = peak_mb(lambda: toxicity.solve(x, y, other, each))
    assert peak < 60  # four matrices of 38 MB if whole
    a = np.concatenate([x.block(slice(0, n)), np.ones((n, 1))], axis=1)
    change = other.block(slice(0, n)).astype(np.float64) - a[:, :-1]
    weight = each * each.sum() * np.where(y == 1, 0.5 / (each * y).sum(), 0.5 / (each * (1 - y)).sum())
    slope = a.T @ (weight * (quality.sigmoid(a @ w) - y))
    slope[:-1] += toxicity.RIDGE * w[:-1] + toxicity.COUNTERFACTUAL * (change.T @ (each * (change @ w[:-1])))
    assert np.abs(slope).max() < 0.05


def test_vocabulary_as_by_brute_force(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("ban", "kor", "mil") for b in ("ter", "dol", "ris") for c in ("", "es", "ing", "os")]
    rows = [(" ".join(rng.choices(words, weights=[1 + (k % 5) * (y + 1) for k in range(len(words))], k=rng.randint(3, 12))), y, rng.choice([0.25, 0.5, 1.0])) for y in (0, 1) for _ in range(60)]
    n, n1 = sum(r[2] for r in rows), sum(r[2] for r in rows if r[1])
    chi = {}
    for mark in {m for t, _, _ in rows for m in toxicity.marks_of(toxicity.words_of(t))}:
        held_by = [(toxicity.marks_of(toxicity.words_of(t)).get(mark), y, w) for t, y, w in rows]
        a, b = (round(sum(v * w for v, y, w in held_by if v is not None and y == k), 6) for k in (1, 0))
        if sum(v is not None for v, _, _ in held_by) >= toxicity.LEAST_ROWS and a + b > 0:
            chi[mark] = n * (a * (n - n1 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n - a - b + 1e-9) * n1 * (n - n1))
    want = sorted(chi, key=lambda m: (-round(chi[m], 4), m))[:25]
    frame = spark.createDataFrame(rows, "text string, y int, weight double").repartition(5)
    assert toxicity.vocabulary(frame, n1, n, 25) == want


def test_near_copies_share_a_weight():
    texts = [" ".join(f"w{i}_{k}" for k in range(200)) for i in range(3)]
    texts += [texts[0] + " end", texts[0] + " other end", "unrelated longestword", "another longestword here", None]
    assert toxicity.copies(toxicity.signature(toxicity.pa.array(texts)).to_pylist()).tolist() == [3, 1, 1, 3, 3, 1, 1, 1]


def test_counterfactual_swaps_within_a_group():
    assert toxicity.counterfactual({"muslim", "tree"}, 1) & set(toxicity.IDENTITY[1]) and "muslim" not in toxicity.counterfactual({"muslim"}, 1)
    assert len(toxicity.counterfactual({"tree"}, 1)) == 2


# 2 Decontamination --------------------------------------------------------------------------------------------

ITEM = "If Anna buys 3 apples for 2 dollars each and sells 3 pears to Bob, how many dollars does she have left after that trade?"


def test_templates(spark):
    again = ITEM.replace("Anna", "Clara").replace("3", "17").replace("2", "5")
    inconsistent = ITEM.replace("3 apples", "17 apples").replace("Anna", "Clara")
    part = " ".join(ITEM.split()[:9])
    filler = "some words that stand before the item and are not in it at all, "
    texts = [filler + ITEM + " and more", filler + again, filler + inconsistent, part, filler, None, ITEM, "", LONG]
    items = spark.createDataFrame([(7, ITEM), (8, ITEM), (9, None), (10, ""), (11, "two words"), (12, "one of a kind item text with quite enough words in it to be found")], "item_id long, text string")
    got = decontaminate.leaks(documents(spark, texts), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 7), (1, 7), (6, 7)}
    assert all(r.coverage >= 0.5 and r.n_items == 2 for r in got)
    assert {r.doc_id: r.place for r in got}[1] == len(filler.split())
    short = decontaminate.leaks(documents(spark, ["say two words now", "two", "words two"]), items).collect()
    assert [(r.doc_id, r.item_id) for r in short] == [(0, 11)]
    assert decontaminate.leaks(documents(spark, texts), items.limit(0)).count() == 0
    assert decontaminate.leaks(documents(spark, texts).limit(0), items).count() == 0
    assert {r.doc_id for r in decontaminate.without_leaks(documents(spark, texts), items).collect()} == {2, 3, 4, 5, 7, 8}


def test_exact_passages_are_found(spark, sf_dir):
    docs, items = queries.table(spark, sf_dir, "documents"), queries.table(spark, sf_dir, "benchmark")
    flat = lambda t: " ".join(t.lower().split())
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if flat(i.text) in flat(d.text)}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} >= want


def test_passages_in_other_case(spark):
    # most windows hold a sentence start or a name, and the copies have other ones
    item = "La casa. Rio verde. Sol alto. Mar frio. Pan duro. Luz roja. Voz baja. Fin."
    one = "If Anna often buys three apples for her neighbours and they then sell 9 pears to Bob, how much does she still have left?"
    other = one.replace("Anna", "Clara").replace("9", "17")
    items = spark.createDataFrame([(1, item), (2, one), (3, other)], "item_id long, text string")
    docs = documents(spark, [item.upper(), "he said: " + item.lower(), one.upper(), other.upper(), other.lower() + " so", item.lower()[:30]])
    got = decontaminate.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 1), (1, 1), (2, 2), (3, 2), (4, 2)}
    assert all(r.matched == r.windows for r in got) and {r.doc_id: r.place for r in got}[1] == 2


def test_items_rich_in_slots(spark):
    maria = "Maria Lopez paid 45 dollars for 9 tickets, John Smith paid 60 dollars for 12 tickets."
    anna = maria.replace("Maria Lopez", "Anna Berg").replace("45", "7").replace("John", "Otto").replace("12", "8")
    item = "What is 17 + 25 - 4 * 3 ?"
    items = spark.createDataFrame([(1, maria), (2, item), (3, "What is 4 * 9 * 2 * 7 ?"), (4, "Berlin 45"), (5, "Paris 60")], "item_id long, text string")
    texts = ["well, " + anna, anna.replace("60 dollars", "60 euros"), "so: What is 8 + 90 - 12 * 5 ? tell", "What is 8 + 90 + 12 * 5 ?", "It is 8 , 9 , 10 , 11", "Rome 45", "paris 60", "| 1 | 2 | 3 | 4 |"]
    got = decontaminate.leaks(documents(spark, texts), items).collect()
    # a repeated unit must stay repeated; other marks are another question; placeholders alone are none
    assert {(r.doc_id, r.item_id, r.place) for r in got} == {(0, 1, 1), (2, 2, 1), (6, 5, 0)}
    assert all(r.matched == r.windows and r.n_items == 1 for r in got)


def brute_leaks(texts, items):
    """Of items whose windows all have four literals or more, by loops over diagonals."""
    found = {}
    for item_id, item in items:
        words = [decontaminate.told(p) for p in item.split()]
        n = len(words) - 7
        assert all(sum(k == decontaminate.LITERAL for k, _ in words[i : i + 8]) >= 4 for i in range(n))
        template = lambda w: tuple(decontaminate.PLACEHOLDERS[k] or x for k, x in w)
        for doc_id, text in texts:
            said = [w for w in map(decontaminate.told, text.split()) if w[0] != decontaminate.MARK]
            for diagonal in range(-len(words), len(said)):
                matched, values = set(), {}
                for at in range(n):
                    if at + diagonal < 0 or at + diagonal + 8 > len(said):
                        continue
                    own, other = words[at : at + 8], said[at + diagonal : at + diagonal + 8]
                    for equal, of in ((template(own) == template(other), other), ([w for _, w in own] == [w for _, w in other], own)):
                        if equal:
                            matched.add(at)
                            for k in range(8):
                                if own[k][0] != decontaminate.LITERAL:
                                    values.setdefault(own[k], set()).add(of[k][1])
                if (2 * len(matched) >= n or len(matched) >= 13) and matched and all(len(v) == 1 for v in values.values()):
                    found[doc_id, item_id] = max(found.get((doc_id, item_id), 0), len(matched))
    return found


def test_leaks_as_by_brute_force(spark):
    rng = random.Random(12)
    plain = [f"{a}{b}" for a in ("ma", "lo", "ki", "su") for b in ("ra", "ten", "vil", "dor", "pes")]
    items, texts = [], []
    for k in range(6):
        words = rng.choices(plain, k=rng.randint(14, 34))
        for at in range(2, len(words), 5):
            words[at] = rng.choice(["7", "12", "Anna", "Boris", "7"])
        items.append((k, " ".join(words)))
        for turn in range(6):
            copy = list(words)
            if turn == 1:  # other values, each alike wherever it stands
                copy = [{"7": "31", "12": "45", "Anna": "Clara", "Boris": "Dan"}.get(w, w) for w in copy]
            if turn == 2:  # other values, at random
                copy = [rng.choice(["31", "45"]) if w.isdigit() else w for w in copy]
            if turn == 3:
                copy = copy[rng.randrange(10) :]
            if turn == 4:
                copy[rng.randrange(len(copy))] = "other"
            if turn == 5:
                copy = [w.upper() for w in copy]
            texts.append((10 * k + turn, " ".join(rng.choices(plain, k=rng.randint(0, 9)) + copy + rng.choices(plain, k=5))))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.leaks(docs.repartition(3), bench).collect()}
    assert got == brute_leaks(texts, items) and len(got) >= 18


def test_exact_passages_are_found_at_scale(spark):
    docs, items = (queries.table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "benchmark"))
    flat = lambda t: " ".join((t or "").lower().split())
    passages = [(i.item_id, flat(i.text)) for i in items.collect()]
    texts = [(d.doc_id, flat(d.text)) for d in docs.select("doc_id", "text").collect()]
    want = {(d, i) for d, text in texts for i, passage in passages if passage in text}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items).collect()} >= want


# 3 Top-k ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [64, 20, 130])
def test_top_k(spark, dims):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, dims))
    if dims > 64:
        x[:, :64] = 1  # only what lies beyond the first word differs
    x[40:80] = x[40]  # a hot code
    rows = [(i, v.tolist(), i) for i, v in enumerate(x)] + [(200, None, 0), (None, x[0].tolist(), 0), (5, x[5].tolist(), 1), (201, [float("nan")] * 64, 1), (202, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    dims = max(dims, 64)
    x = np.concatenate([x, np.zeros((120, dims - x.shape[1]))], axis=1)
    code = {i: tuple(v > 0) for i, v in enumerate(x)} | {201: (False,) * dims, 202: (False,) * dims}
    want = set()
    for q in (q for q in code if q % 10 == 0):
        near = sorted((sum(a != b for a, b in zip(code[q], c, strict=True)), i) for i, c in code.items() if i != q)[:7]
        want |= {(q, k + 1, i, d) for k, (d, i) in enumerate(near)}
    got = multi_index.nearest(table, F.col("id") % 10 == 0, 7)
    assert {tuple(r) for r in got.collect()} == want
    assert multi_index.nearest(table.limit(0), F.col("id") % 10 == 0, 7).count() == 0
    few = multi_index.nearest(table.where("vec_id in (0, 1, 2)"), F.col("id") == 0, 7).collect()
    assert len(few) == 2


# 4 Html -------------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
text.<p>Second &eacute;<!-- gone --> one<br>more</p><aside>Side</aside><div class="comments"><p>Reader says</p></div><form><input><label>x</label></form></article>
<footer>&copy; us</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Head & line\n\nFirst bold text.\n\nSecond é one more"
    for cut in range(len(PAGE)):  # cut off anywhere, nothing breaks and only noise is lost
        assert "Reader" not in html_text.main_text(PAGE[:cut])
    body = "".join(f"<p>{'long sentence of the article ' * 6}{i}</p>" for i in range(4))
    page = f"<body><div><a href=x>link one</a> <a href=y>link two</a></div>{'<div></div>' * 4}{body}{'<div></div>' * 4}<div>short end</div></body>"
    assert html_text.main_text(page).count("long sentence") == 24 and "link" not in html_text.main_text(page) and "short end" not in html_text.main_text(page)
    assert html_text.main_text("<article><p>Hi</p></article>") == "Hi"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""


def test_the_distribution_decides(sf_dir):
    import pyarrow.parquet as pq

    pages = [x.as_py() for x in pq.read_table(f"{sf_dir}/pages.parquet")["html"]]
    every = ["\n\n".join(x.text for x in html_text.lines(page or "") if x.text) for page in pages]
    assert all(html_text.main_text(page) != text for page, text in zip(pages, every, strict=True) if page)
    menu = "".join(f"<li><a href=/{i}>menu item {i}</a>" for i in range(9))
    assert html_text.main_text(f"<ul>{menu}</ul><div>{'Plain prose. ' * 20}</div><div>short</div><ul>{menu}</ul>") == ("Plain prose. " * 20).strip() + "\n\nshort"
    # a long text surges outside of a short article, and one in a wrongly named element is the heaviest run
    assert "far longer" in html_text.main_text(f"<article><p>teaser</p></article><div>{'far longer text ' * 900}</div>")
    assert html_text.main_text(f"<div class='site-header'>{'misnamed ' * 9}</div>") == ("misnamed " * 9).strip()


def test_names_of_noise():
    page = '<article><div class="article-header"><h1>Title</h1></div><p class="form-factor">A paragraph</p><div class="newsletter">Sign up</div><p>x <span class="share">Share!</span> y</p></article><footer>foot</footer>'
    assert html_text.main_text(page) == "Title\n\nA paragraph\n\nx y"
    prose = "<p>" + "prose " * 40 + "</p>"
    assert html_text.main_text(f"{prose}<p><a href=x>only links here</a></p>{prose}").split("\n\n")[1] == "only links here"


def test_runs_as_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        weights = [rng.choice([0, 0, 0, 5, 40, 200]) for _ in range(rng.randint(0, 30))]
        sums = [sum(weights[i : i + 3]) for i in range(len(weights))]
        kept, i = [], 0
        while i < len(sums):
            end = i
            while end < len(sums) and sums[end]:
                end += 1
            surge = next((k for k in range(i, end) if sums[k] > 80), None)
            heavy = [k for k in range(i if surge is None else surge, end) if weights[k]]
            if heavy:
                kept.append((heavy[0], heavy[-1] + 1, float(sum(weights[k] for k in heavy)), surge is not None))
            i = max(end, i + 1)
        assert html_text.runs(np.array(weights, dtype=np.float64), 3, 80) == kept


def test_html_takes_linear_time():
    for page in ("<span>" * 200_000 + "</b>" * 200_000, "<span>x" * 100_000 + "</b>" * 100_000 + "</span>" * 100_000, "<div class=ad>" * 100_000):
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 10  # seconds even of a slow machine; quadratic time would be hundreds


def test_extract(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", "<article>" + "<p>word</p>" * 20_000 + "</article>")]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()
    assert [r.n_chars for r in sorted(got, key=lambda r: r.page_id)] == [len(html_text.main_text(PAGE))] * 2 + [0, 20_000 * 6 - 2]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_very_long_urls_and_messages(spark):
    url = "http://bad.com/de/" + "x" * 300_000
    pages = spark.createDataFrame([(1, url, "<p>"), (2, "http://a.net/", f'<link rel=canonical href="{url}">' + "<p>word" * 50_000)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, spark.createDataFrame(queries.RULES, "action string, host string, path string")).collect()}
    assert got == {1: "block", 2: "block"}
    talk = spark.createDataFrame([(1, 0, "a", LONG), (1, 1, "b", "> " + LONG + "\nindeed")], "conv_id long, turn long, role string, text string")
    assert {r.turn: (r.reply_to, len(r.text)) for r in quotes.linked(talk).collect()} == {0: (None, len(LONG)), 1: (0, 6)}


# 5 Shards -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bits,axes", [(3, 2), (3, 3), (2, 4)])
def test_curve_visits_neighbours(bits, axes):
    points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
    place = sharding.hilbert(points, bits)
    assert sorted(place) == list(range(len(points)))
    assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_shards(spark, awkward):
    for docs, n in ((awkward, 12), (queries.table(spark, "/root/testdata/sf0.001", "documents"), 200), (awkward.limit(0), 0)):
        got = sharding.hilbert_shards(docs, 40).collect()
        assert len(got) == n
        sizes = [sum(r.shard == s for r in got) for s in range(40)]
        assert not n or max(sizes) - min(sizes) <= 1
        for s in range(40):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    text = {r.doc_id: r.text for r in awkward.collect()}
    for r in sharding.hilbert_shards(awkward).collect():
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)



def test_shards_prune_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.hilbert_shards(docs, 40).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    for name, cell in (("lang", "lang_cell"), ("source", "source_cell")):
        span = {}
        for r in rows:
            span.setdefault(r.shard, []).append(r[cell])
        ends = {k: (min(v), max(v)) for k, v in span.items()}
        cells = {r[name]: r[cell] for r in rows}
        assert [cells[n] for n in sorted(cells)] == sorted(cells.values())  # a cell is a range of names
        hit = [sum(a <= c <= b for a, b in ends.values()) for c in set(cells.values())]
        assert sum(hit) / len(hit) < 0.7 * 40, (name, hit)


def test_cells_of_names(spark):
    rows = [(n,) for n in ["a"] * 50 + ["b", None, "c"] + [f"x{i:03d}" for i in range(900)]]
    known = sharding.quantiles(spark.createDataFrame(rows, "lang string"), "lang")
    assert len(known[0]) <= 255 and known[1] == sorted(known[1]) and known[0] == sorted(known[0])
    got = sharding.cells_of(sharding.pd.Series(["a", None, "x000", "x899", "x000"]), known)
    assert got[1] == 0 and 0 < got[0] <= got[2] == got[4] < got[3] <= 255
    assert sharding.quantiles(spark.createDataFrame([], "lang string"), "lang") == ([], [])


# 7 Packing ----------------------------------------------------------------------------------------------------


def test_packing(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(awkward).collect()
    want = {}
    for r in awkward.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.setdefault((r.doc_id, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), []).append(1)
    seen = {}
    for r in got:
        seen.setdefault((r.doc_id, r.piece, r.start, r.length, r.ids_crc32), []).append(1)
    assert seen == want
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(awkward.limit(0)).count() == 0


def best_fit_one_by_one(lengths, capacity):
    gaps, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= x]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - x)
        else:
            gaps.append(capacity - x)
            n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_as_good_as_one_by_one(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([100, 37, rng.randint(1, 100), rng.randint(1, 30)]) for _ in range(400)]
    counts = {x: lengths.count(x) for x in set(lengths)}
    runs = packing.best_fit(counts, 100)
    held = {}
    ranks = {}
    for length, first, sequence, each, offset in sorted(runs):
        ranks.setdefault(length, []).append((first, sequence, each, offset))
    for length, some in ranks.items():
        ends = [r[0] for r in some[1:]] + [counts[length]]
        for (first, sequence, each, offset), end in zip(some, ends, strict=True):
            for k in range(end - first):
                held.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert sum(map(len, held.values())) == 400 and len(held) == best_fit_one_by_one(lengths, 100)


@pytest.mark.parametrize("seed", range(3))
def test_ids_of_odd_texts(seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(seed)
    letters = "aZéÉß'sStTİIıſKÅ̈́ '.,!?:;<|endoftext|>\t\x1c\x85 　中文ｆΣς̧ñÑ0９½²_-\""
    for _ in range(2000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert words.ids(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), text


# 8 Jaccard join -----------------------------------------------------------------------------------------------


def brute_components(rows):
    sets = {}
    for i, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def near_copies(seed, groups=12, most=9):
    rng, texts = random.Random(seed), []
    words = [f"word{i}" for i in range(300)]
    shared = [rng.choice(words) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, most)):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.3:
                copy = copy[rng.randint(0, 4) :]
            if rng.random() < 0.3:
                copy += shared
            texts.append(" ".join(copy).title() if rng.random() < 0.2 else "\t ".join(copy))
    return texts


@pytest.mark.parametrize("seed", range(2))
def test_join(spark, seed):
    texts = near_copies(seed) + [None, "", " \n", "a b", "a  b", "A b", "a b c d e", "a b c d e f", LONG, LONG + " x", "a\x0bb\x1cc"]
    random.Random(seed).shuffle(texts)
    docs = documents(spark, texts, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.components(docs).collect()}
    assert got == brute_components([(100 + i, t) for i, t in enumerate(texts)])


@pytest.mark.parametrize(("rounds", "subtree"), [(0, 4096), (0, 3), (1, 5)])
def test_trees_alone_find_all(spark, rounds, subtree):
    texts = near_copies(7, 6, 25)
    got = {r.doc_id: r.component_id for r in jaccard_join.similar(documents(spark, texts), rounds=rounds, subtree=subtree).members.collect()}
    assert got == {k: v[1] for k, v in brute_components(list(enumerate(texts))).items()}


def test_sets_of_one_first_half_stay_apart():
    assert jaccard_join._node(5, 9, frozenset([5])) == 9 and jaccard_join._node(5, 9, frozenset()) == 5


def test_pivots_stand_before_their_rows():
    rng = np.random.default_rng(3)
    nodes = rng.integers(-(1 << 62), 1 << 62, 5000)
    starts = np.array([0, 1, 700, 702])
    sizes = np.concatenate([np.sort(rng.integers(10, 400, k)) for k in (1, 699, 2, 4298)])
    got = jaccard_join.pivots(starts, nodes, sizes)
    group = np.searchsorted(starts, np.arange(5000), side="right")
    assert (got <= np.arange(5000)).all() and (group[got] == group).all()
    assert np.bincount(got).max() < 700  # no pivot of all


def test_bounds_lose_nothing():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randint(1, 400)
        a = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], dtype=np.uint64))
        keep = [x for x in a if rng.random() < 0.9]
        b = np.unique(np.array([*keep, *(rng.getrandbits(64) for _ in range(rng.randint(0, n // 6)))], dtype=np.uint64))
        common = len(np.intersect1d(a, b))
        if len(b) and 100 * common >= 75 * (len(a) + len(b) - common):
            assert jaccard_join.may_link(jaccard_join.bitmap(a), jaccard_join.bitmap(b), len(a), len(b), 75)
            counts = np.random.default_rng(0).integers(0, 9, 1 << jaccard_join.COUNTERS)
            one, other = sorted([jaccard_join.keys_of(a, counts), jaccard_join.keys_of(b, counts)], key=lambda k: len(k[0]))
            if len(a) != len(b):
                one, other = (jaccard_join.keys_of(x, counts) for x in sorted([a, b], key=len))
            assert set(one[0][: one[1]].tolist()) & set(other[0].tolist())


def test_join_cases(spark, awkward):
    got = jaccard_join.components(awkward).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by[0] == [(0, 0)] and by[3] == [(1, 3)] * 2 and by[4] == [(1, 3)] and by[9] == [(1 + 1, 8)] and by[6][0][1] == 5
    assert jaccard_join.components(awkward.limit(0)).count() == 0
    kept = jaccard_join.one_of_each(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [0, 1, 2, 3, 5, 7, 8, None]


# 9 Url filters ------------------------------------------------------------------------------------------------


def test_rules_and_aliases(spark):
    pages = [
        (1, "https://Blog.Example.org/es/1", None),
        (2, "http://x.net/a?utm_source=f&b=1#c", '<link rel="canonical" href="https://bad.com/de/1">'),
        (3, "http://y.net/", "<meta http-equiv='refresh' content='0; url=http://x.net/a?b=1'>"),
        (4, "http://z.net/", '<link href="/other" rel=canonical>'),
        (5, "http://w.net/", '<link rel="canonical" href="http://bad.com/de/2"><link rel=canonical href=//good.org/>'),
        (6, None, None),
        (7, "no scheme", "<p>"),
        (8, "http://notorg/", ""),
        (9, "http://a.org", ""),
        (9, "http://a.org", ""),
    ]
    rules = spark.createDataFrame(queries.RULES, "action string, host string, path string")
    redirects = spark.createDataFrame([("http://z.net/other", "http://bad.com/de/9"), (None, "http://q/")], "url string, target string")
    table = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(table, rules, redirects).collect()}
    assert got == {
        1: ("blog.example.org", "/es/1", "example.org/es/", "block"),
        2: ("x.net", "/a", None, "block"),
        3: ("y.net", "/", None, "block"),
        4: ("z.net", "/", None, "block"),
        5: ("w.net", "/", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("", "", None, "allow"),
        8: ("notorg", "/", None, "allow"),
        9: ("a.org", "", None, "allow"),
    }
    assert url_filter.judge(table, rules).where("page_id = 9").count() == 2
    assert url_filter.judge(table.limit(0), rules).count() == 0


# 10 Quotations ------------------------------------------------------------------------------------------------


def test_quotes(spark):
    rows = [
        (1, 0, "user", "How do I bake bread?\nI have flour."),
        (1, 1, "assistant", "On Monday user wrote:\n> how do I  bake BREAD\n\nUse yeast."),
        (1, 2, "user", "And cake?"),
        (1, 3, "user", "> Use yeast.\n>> How do I bake bread?\nHow much?"),
        (1, 4, "user", "> never said\nodd"),
        (2, 0, "user", None),
        (2, 1, "user", "> Use yeast.\nin another conversation"),
        (2, 1, "user", "> Use yeast.\nin another conversation"),
        (None, 0, "user", "> x"),
        (3, None, "user", ""),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotes.linked(table).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert {t: (r.reply_to, r.thread, r.position) for t, r in one.items()} == {0: (None, 0, 0), 1: (0, 0, 1), 3: (1, 0, 2), 2: (None, 2, 3), 4: (None, 4, 4)}
    assert one[1].text == "Use yeast." and one[3].text == "How much?" and one[4].text == "odd" and one[4].n_quoted == 1 and one[4].n_linked == 0
    assert sorted(r.position for r in got if r.conv_id == 2) == [0, 1, 2]
    assert quotes.linked(table.limit(0)).count() == 0


def test_passages_are_told_across_lines(spark):
    long = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix blue jelly"
    words = long.split()
    rows = [
        (1, 0, "a", f"Hello all.\n{long}."),
        (1, 1, "b", "Yes"),
        (1, 2, "a", "> " + " ".join(words[:7]) + "\n> " + " ".join(words[7:]) + "\nre-wrapped"),
        (1, 3, "b", "> " + " ".join(words[3:11]) + "\npart of a line"),
        (1, 4, "b", "> Yes\none word is not enough"),
        (1, 5, "b", "> re-wrapped quite another thing than that was\nno"),
    ]
    got = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("_rank", F.lit(1))).collect()}
    assert {t: r.reply_to for t, r in got.items()} == {0: None, 1: None, 2: 0, 3: 0, 4: None, 5: None}
    assert (got[2].n_quoted, got[2].n_linked, got[4].n_quoted, got[4].n_linked) == (1, 1, 1, 0)


def test_threads_of_random_replies(spark):
    rng = random.Random(6)
    said = {t: [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 5) for _ in range(9)] for t in range(60)}
    parent = {t: rng.choice([None, *range(t)]) if t else None for t in said}
    parent |= {t: t - 1 for t in range(20, 50)}  # a long chain
    rows = [(7, t, "u", ("" if parent[t] is None else "> " + " ".join(said[parent[t]]) + "\n") + " ".join(w)) for t, w in said.items()]
    got = {r.turn: r for r in quotes.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)).collect()}

    def root(t):
        return t if parent[t] is None else root(parent[t])

    assert {t: (r.reply_to, r.thread) for t, r in got.items()} == {t: (parent[t], root(t)) for t in said}
    order = sorted(said, key=lambda t: (root(t), t))
    assert [got[t].position for t in order] == list(range(60))


# Pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = queries.table(spark, sf_dir, "documents")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.columns == columns, name
        after = spark.createDataFrame(after.collect(), docs.schema)
        assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in before.collect()}
        before = after
    texts = [(r.doc_id, r.text) for r in before.collect()]
    assert len({label for _, label in brute_components(texts).values()}) == len(texts)
    run = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in run.collect()} == {i for i, _ in texts}


def test_awkward_rows_pass_the_pipeline(spark, awkward, tmp_path):
    import corpus_pipeline

    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    names = ("_node", "_row", "_chosen", "_id", "_leaked", "_own0", "_OWN1", "m1", "comp", "_rank", "score", "component_id")
    docs = awkward.withColumns({n: F.lit(n) for n in names})
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
    kept = sorted((tuple(r[:2]) for r in docs.collect()), key=str)
    assert kept == sorted([*((i, AWKWARD[i]) for i in (0, 1, 2, 3, 5, 7, 8)), (None, "no id at all")], key=str)
    assert all(r[n] == n for r in docs.collect() for n in names)
    packed = corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {0, 1, 2, 3, 5, 7, 8, None} and sum(r.piece == 0 for r in packed) == 8
    empty = awkward.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_rows_without_an_id_are_judged_by_their_text(spark):
    item = "the quick brown foxes jump over seven lazy dogs while nobody at all is looking at them"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = documents(spark, ["clean words only here", f"it says {item} there"]).withColumn("_leaked", F.lit(1))
    docs = docs.union(docs.withColumn("doc_id", F.lit(None).cast("long"))).union(docs.withColumn("doc_id", F.lit(0).cast("long")))
    left = decontaminate.without_leaks(docs, bench)
    assert left.columns == docs.columns and sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == sorted([(0, "clean words only here")] * 2 + [(None, "clean words only here")], key=str)


def test_duckdb_is_there():
    assert duckdb.sql("select 1").fetchall() == [(1,)]


@pytest.mark.parametrize("subtree", [4096, 1])
def test_trees_tell_long_sets_apart(spark, subtree):
    rng = np.random.default_rng(5)
    draw = lambda n: np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    base = draw(3000)
    some = [*(draw(3000) for _ in range(6)), base, np.unique(np.concatenate([base[:2900], draw(100)])), draw(100_000), draw(40)]
    shared = spark.createDataFrame([(5, i, len(s), True, i) for i, s in enumerate(some)], "key long, node long, n int, early boolean, comp long")
    nodes = spark.createDataFrame([(i, bytearray(jaccard_join.bitmap(s))) for i, s in enumerate(some)], "node long, bits binary")
    assert {tuple(r) for r in jaccard_join._tree_pairs(shared, nodes, 75, subtree).collect()} == {(6, 7)}
