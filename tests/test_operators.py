import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.operators import audit, calibration, catalog, dedup, graph, planning, retrieval, training


def brute_components(edges):
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], changed = low, True
    return label


@pytest.mark.parametrize("edges", [[(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)], [(1, 1), (2, 3)], [], [(random.Random(1).randrange(60), random.Random(i).randrange(60)) for i in range(50)]])
def test_components(spark, edges):
    got = graph.connected_components(spark.createDataFrame(edges + [(None, 5)], "a long, b long"))
    want = brute_components([e for e in edges if e[0] != e[1]])
    assert {r.node: r.component for r in got.collect()} == want


def test_components_of_many_partitions(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(80)] + [(200, 200 + i) for i in range(1, 60)] + [(300 + rng.randrange(90), 300 + rng.randrange(90)) for _ in range(70)]
    rng.shuffle(edges)
    want = brute_components([e for e in edges if e[0] != e[1]])
    frame = spark.createDataFrame(edges, "a long, b long").repartition(8)
    for found in (graph.connected_components(frame, per_task=20), graph.star_components(frame)):
        assert {r.node: r.component for r in found.collect()} == {k: v for k, v in want.items() if k in {x for e in edges if e[0] != e[1] for x in e}}
    names = frame.select(F.concat(F.lit("n"), F.col("a") + 1000).alias("a"), F.concat(F.lit("n"), F.col("b") + 1000).alias("b"))
    assert {(r.node, r.component) for r in graph.connected_components(names, per_task=30).collect()} == {(f"n{k + 1000}", f"n{v + 1000}") for k, v in want.items()}


def _edges(spark, rows):
    return spark.createDataFrame(rows, "product_id string, image_id string")


def test_splits_do_not_depend_on_order(spark):
    chain = [("a", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "3"), ("d", "3")]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(chain)
        rows = catalog.assign_splits(_edges(spark, chain)).collect()
        seen.add(tuple(sorted((r.product_id, r.component, r.split) for r in rows)))
    assert len(seen) == 1 and len({s for _, _, s in next(iter(seen))}) == 1
    assert {c for _, c, _ in next(iter(seen))} == {"a"}


def test_generic_cap_is_strict(spark):
    rows = [(f"p{i}", "x") for i in range(3)] + [(f"p{i}", "y") for i in range(4)] + [("p0", "y")]
    assert [r.image_id for r in catalog.generic_images(_edges(spark, rows), 3).collect()] == ["y"]


def test_kept_types_stop_before_the_share_is_passed(spark):
    rows = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "t string")
    assert {r.t for r in catalog.kept_types(rows, "t", 0.9).collect()} == {"a", "b"}
    assert {r.t for r in catalog.kept_types(rows, "t", 0.5).collect()} == {"a"}


def test_component_stats(spark):
    row = catalog.component_stats(catalog.assign_splits(_edges(spark, [("a", "1"), ("b", "1"), ("c", "2")]))).first()
    assert (row.products, row.components, row.largest_component, row.largest_component_share, row.singletons) == (3, 2, 2, 0.6667, 1)


def test_rolling_budget(spark):
    rows = spark.createDataFrame([("pairs", "train", f"k{i}", f"p{i}", n) for i, n in enumerate([5, 4, 3, 10, 1])], "role string, split string, key string, path string, n_bytes long")
    got = planning.rolled(rows, 9).orderBy("path").collect()
    assert [(r.shard, r.offset) for r in got] == [(0, 0), (0, 5), (1, 0), (1, 3), (2, 0)]


def test_ties_rank_last(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "id long, vector array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "vector", F.col("id").alias("target"))
    assert {r["rank"] for r in retrieval.vector_ranks(corpus, queries).collect()} == {5}


def test_vector_ranks_are_numpys(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 8)).astype(np.float32)
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    queries = corpus.select(F.col("id").alias("query_id"), "vector", ((F.col("id") + 1) % 700).alias("target"))
    scores = np.round(x.astype(float) @ x.astype(float).T, 9)
    want = {i: int((scores[i] >= scores[i, (i + 1) % 700]).sum()) for i in range(700)}
    assert {r.query_id: r["rank"] for r in retrieval.vector_ranks(corpus, queries).collect()} == want


def test_bm25_without_a_term_is_last(spark):
    corpus = spark.createDataFrame([(i, f"blue widget number {i}") for i in range(20)], "id long, text string")
    queries = spark.createDataFrame([(0, "number 7", 7), (1, "zebra", 3), (2, "", 3), (3, None, 4)], "query_id long, text string, target long")
    assert {r.query_id: r["rank"] for r in retrieval.bm25_ranks(corpus, queries).collect()} == {0: 1, 1: 20, 2: 20, 3: 20}


def test_bootstrap(spark):
    rows = spark.createDataFrame([(float(i % 5 == 0),) for i in range(200)], "difference double")
    got = retrieval.paired_bootstrap(rows, resamples=400).first()
    assert got.delta == pytest.approx(0.2) and 0.1 < got.low < 0.2 < got.high < 0.3 and got.claimed
    assert retrieval.paired_bootstrap(rows.repartition(7), resamples=400).first() == got
    zero = retrieval.paired_bootstrap(spark.createDataFrame([(float(i % 2) - 0.5,) for i in range(100)], "difference double"), resamples=200).first()
    assert not zero.claimed


def test_hamming_pairs_are_brute_force(spark):
    rng = random.Random(3)
    codes = [rng.getrandbits(63) for _ in range(12)]
    codes += [c ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for c in codes] + codes[:4] + [-1, 0]
    rows = spark.createDataFrame(list(enumerate(codes)), "idx long, hash long")
    want = {(i, j, (a ^ b & (2**64 - 1)).bit_count() if a >= 0 <= b else ((a ^ b) & (2**64 - 1)).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(codes), 2)}
    want = {w for w in want if w[2] <= 8}
    got = [tuple(r) for r in dedup.hamming_pairs(rows, 8).collect()]
    assert set(got) == want and len(got) == len(want)


def test_refusals(spark):
    rows = spark.createDataFrame([(0, 1, 1, [1] * 16, 9.0), (1, 1, 1, [1] * 16, 9.0), (2, 1, 1, [1] * 16, 1.0)], "idx long, dhash long, phash long, tiles array<long>, detail_std double")
    report = dedup.near_duplicates(rows)
    assert report["calibrated"] and [tuple(r) for r in report["pairs"].collect()] == [(0, 1, 0)] and [r.idx for r in report["skipped"].collect()] == [2]
    forced = dedup.near_duplicates(rows, method="tiles", cutoff=2)
    assert not forced["calibrated"] and forced["pairs"].count() == 1
    assert dedup.near_duplicates(rows, method="phash")["threshold"] is None
    assert dedup.near_duplicates(rows, dedup.THRESHOLDS | {"calibrated": False})["method"] is None


def test_mismatch_needs_a_near_neighbour(spark):
    rows = [(0, 0, "a", 9.0), (1, 1, "b", 9.0), (2, 2**40 - 1, "b", 9.0), (3, 3, None, 9.0), (4, 0, "b", 1.0)]
    got = dedup.group_mismatches(spark.createDataFrame(rows, "idx long, hash long, tag string, detail_std double"), 8).collect()
    assert sorted((r.idx, r.own, r.nearest, r.nearest_idx, r.distance, r.own_distance) for r in got) == [(0, "a", "b", 1, 1, None), (1, "b", "a", 0, 1, 39)]


def test_segments_follow_the_number_of_hashes(spark):
    assert dedup.segments_for(8, 10**3) >= dedup.segments_for(8, 10**6) >= dedup.segments_for(8, 10**9)
    assert sorted(dedup.ball(5, 2)) == [x for x in range(32) if x.bit_count() <= 2]
    rng = random.Random(9)
    codes = [rng.getrandbits(63) for _ in range(60)] * 2 + [0] * 20
    rows = spark.createDataFrame(list(enumerate(codes)), "idx long, hash long")
    for most in (0, 5, 20):
        want = {(i, j, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(enumerate(codes), 2) if (a ^ b).bit_count() <= most}
        assert {tuple(r) for r in dedup.hamming_pairs(rows, most).collect()} == want
        assert {tuple(r) for r in dedup.hash_clusters(rows, most).collect()} == {tuple(r) for r in dedup.clusters(dedup.hamming_pairs(rows, most)).collect()}


def test_tile_pairs_as_by_brute_force(spark):
    rng = random.Random(4)
    tiles = [[rng.getrandbits(60) for _ in range(6)] for _ in range(8)]
    tiles += [[t ^ (1 << rng.randrange(60)) if rng.random() < 0.7 else rng.getrandbits(60) for t in row] for row in tiles * 3]
    rows = spark.createDataFrame(list(enumerate(tiles)), "idx long, tiles array<long>")
    for most in (1, 3):
        want = {(i, j, d) for (i, a), (j, b) in itertools.combinations(enumerate(tiles), 2) if (d := sum((x ^ y).bit_count() > 4 for x, y in zip(a, b, strict=True))) <= most}
        assert {tuple(r) for r in dedup.tile_pairs(rows, most, 4, 6).collect()} == want


def test_auc_with_ties(spark):
    rows = [(1.0, 1), (2.0, 1), (2.0, 0), (3.0, 0), (0.5, 0)]
    pairs = [(p, q) for p, y in rows if y for q, z in rows if not z]
    want = sum((p < q) + 0.5 * (p == q) for p, q in pairs) / len(pairs)
    frame = spark.createDataFrame(rows, "s double, y int")
    assert calibration.roc_auc(frame, F.col("s"), F.col("y")).first().auc == pytest.approx(want)
    assert np.isnan(calibration.roc_auc(frame.where("y = 1"), F.col("s"), F.col("y")).first().auc)


def test_best_threshold_is_the_lowest(spark):
    frame = spark.createDataFrame([(1.0, 1), (2.0, 1), (3.0, 0), (4.0, 1)], "s double, y int")
    best = calibration.best_threshold(calibration.sweep(frame, F.col("s"), F.col("y")), 0.9).first()
    assert best.threshold == 2.0 and best.recall == pytest.approx(2 / 3)
    assert calibration.best_threshold(calibration.sweep(frame.where("y = 0"), F.col("s"), F.col("y")), 0.9).first() is None


def test_labeled_pairs(spark):
    rows = [("s1", None, None, "A"), ("s2", None, None, "A"), ("s3", None, None, "B"), ("m1", "s1", "badge", "A")]
    got = calibration.labeled_pairs(spark.createDataFrame(rows, "name string, source string, mutation string, asin string"))
    assert {(r.a, r.b, r.label, r.kind) for r in got.collect()} == {("s1", "m1", 1, "positive::badge"), ("s1", "s2", 0, "hard_negative"), ("s2", "m1", 0, "hard_negative"), ("s1", "s3", 0, "easy_negative"), ("s2", "s3", 0, "easy_negative")}


def test_false_negatives(spark):
    rows = spark.createDataFrame([(0, 0, 7, 1), (0, 1, 7, 2), (0, 2, 8, 2), (0, 3, 9, 0), (0, 4, 10, 0), (1, 5, 7, 1)], "batch long, i long, product_hash long, title_hash long")
    assert {(r.i, r.j) for r in training.false_negatives(rows).collect()} == {(0, 1), (1, 0), (1, 2), (2, 1)}


def test_info_nce_of_equal_rows(spark):
    rows = spark.createDataFrame([(0, i, [1.0, 0.0], [1.0, 0.0], i, 0) for i in range(4)], "batch long, i long, image array<float>, text array<float>, product_hash long, title_hash long")
    assert training.info_nce(rows).first().loss == pytest.approx(np.log(4))
    assert training.info_nce(rows.withColumn("product_hash", F.lit(1).cast("long"))).first().loss == pytest.approx(0)


def test_run_id_leaves_out_paths():
    assert training.run_id({"lr": 1, "notes": "a"}) == training.run_id({"notes": "b", "lr": 1}) != training.run_id({"lr": 2})


def test_encode_distinct(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, t string")
    got = training.encode_distinct(rows, "t", lambda v: [[len(x)] for x in v])
    assert {r.id: r.vector for r in got.collect()} == {1: [1.0], 2: [2.0], 3: [1.0], 4: None}


IMAGE = "set_id string, idx long, width int, height int, format string, had_alpha boolean, is_main boolean, exact_white_frac double, near_white_frac double, modal_r int, modal_g int, modal_b int, bbox_occupancy double, n_artifacts int"


def _image(idx, main, exact=1.0, occupancy=0.9, width=1200, kind="JPEG"):
    return ("s", idx, width, width, kind, False, main, exact, exact, 255, 255, 255, occupancy, 0)


def test_main_rules_are_advisory_elsewhere(spark):
    images = spark.createDataFrame([_image(0, True), _image(1, False, 0.1), _image(2, None, 0.1)], IMAGE)
    checked = audit.checks(images)
    tiers = {(r.idx, r.check_id): (r.tier, r.status) for r in checked.collect()}
    assert tiers[0, "white_background"] == ("measured", "pass")
    assert tiers[1, "white_background"] == tiers[2, "white_background"] == ("advisory", "fail")
    supplied = spark.createDataFrame([("s", 6)], "set_id string, n_images long")
    head = audit.headlines(checked, supplied).first()
    assert (head.headline, head.main_index) == ("pass", 0)
    groups = audit.finding_groups(checked).collect()
    assert sorted((r.indices, len(r.findings), r.n_measured_only) for r in groups) == [([0], 0, 0), ([1, 2], 0, 1)]


@pytest.mark.parametrize("width,kind,want", [(1000, "JPEG", "pass"), (999, "PNG", "warn"), (499, "JPEG", "fail"), (10001, "JPEG", "fail"), (2000, "BMP", "fail"), (2000, None, "fail")])
def test_resolution(spark, width, kind, want):
    checked = audit.checks(spark.createDataFrame([_image(0, True, width=width, kind=kind)], IMAGE))
    assert checked.where("check_id = 'resolution_and_format'").first().status == want


def test_payload(spark):
    images = spark.createDataFrame([_image(i, False, 0.1, width=400) for i in range(9)], IMAGE)
    supplied = spark.createDataFrame([("s", 9)], "set_id string, n_images long")
    clusters = spark.createDataFrame([("s", 0, 0), ("s", 0, 1)], "set_id string, cluster long, idx long")
    row = audit.payloads(audit.checks(images), supplied, clusters=clusters).first()
    body = audit.as_dict(row.payload)
    assert body["headline"] == "fail" and "caveat" in body and body["clusters"] == [[0, 1]] and len(row.payload) < 2400
    assert body["groups"] == [{"i": list(range(9)), "n_pass": 3, "f": [["res", "fail", 400.0]], "n_measured_only": 1}]
    assert {c for c, e in body["legend"].items() if "fix" in e} == {"res"} and all(e["rule"] and e["title"] for e in body["legend"].values())
    assert body["audit_id"] == "s" and body["f_schema"] == ["check_code", "status", "measured_value"] and body["set_checks"] == []
    assert "NOT rule verdicts" in body["key"]["n_measured_only"] and "fix" in body["key"]
    few = audit.as_dict(audit.payloads(audit.checks(images), spark.createDataFrame([("s", 2)], "set_id string, n_images long")).first().payload)
    assert few["set_checks"] == [["cnt", "warn", 2]] and "cnt" in few["legend"]


def test_a_wide_cutoff_compares_blocks_instead_of_probing(spark, monkeypatch):
    rng = random.Random(11)
    codes = [rng.getrandbits(64) - 2**63 for _ in range(150)]
    codes += [c ^ (1 << rng.randrange(63)) for c in codes[:40]] + codes[:5] + [-1, 0, 2**63 - 1, -(2**63)]
    rows = spark.createDataFrame([(i, c, i % 3) for i, c in enumerate(codes)] + [(999, None, 0), (998, 1, None)], "idx long, hash long, part int")
    far = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    probes = dedup._probes
    monkeypatch.setattr(dedup, "_probes", None)
    for block in ((1024, 65536), (16, 16)):
        monkeypatch.setattr(dedup, "BLOCK", block)
        found = dedup.hash_links(rows, 24).collect()
        want = {(min(a, b), max(a, b), far(a, b)) for a, b in itertools.combinations({*codes, 1}, 2) if far(a, b) <= 24}
        assert {tuple(r) for r in found} == want and len(found) == len(want)
        found = dedup.hash_links(rows, 24, within=("part",)).collect()
        parted = [{c for i, c in enumerate(codes) if i % 3 == p} for p in range(3)]
        want = {(p, min(a, b), max(a, b), far(a, b)) for p in range(3) for a, b in itertools.combinations(parted[p], 2) if far(a, b) <= 24}
        assert {tuple(r) for r in found} == want and len(found) == len(want)
    # where blocks would take longer, probes; but not where hashes crowd in some values of a segment
    used = []
    monkeypatch.setattr(dedup, "_probes", lambda *a: used.append(1) or probes(*a))
    monkeypatch.setattr(dedup, "PER_ROW", 0.2)
    want = {(min(a, b), max(a, b), far(a, b)) for a, b in itertools.combinations({*codes, 1}, 2) if far(a, b) <= 1}
    assert {tuple(r) for r in dedup.hash_links(rows, 1).collect()} == want and used
    monkeypatch.setattr(dedup, "_compared", None)
    crowded = spark.createDataFrame([(i, i << 40) for i in range(200)], "idx long, hash long")
    with pytest.raises(TypeError):
        dedup.hash_links(crowded, 1)


def test_mismatches_find_the_nearest_of_their_tag_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    near = [rng.getrandbits(63) for _ in range(20)]
    codes = [near[rng.randrange(20)] ^ (1 << rng.randrange(63)) for _ in range(60)] + near[:5] * 2
    rows = [(i, c, f"t{i % 4}", 9.0, i % 2) for i, c in enumerate(codes)] + [(900, codes[0], "alone", 9.0, 0), (901, codes[0] ^ 1, "", 9.0, 0)]
    monkeypatch.setattr(dedup, "BLOCK", (4, 4))
    got = dedup.group_mismatches(spark.createDataFrame(rows, "idx long, hash long, tag string, detail_std double, part int"), 8, within=("part",)).collect()
    want = set()
    for i, c, tag, _, part in rows:
        others = [((c ^ d).bit_count(), j, other) for j, d, other, _, q in rows if j != i and q == part and other]
        best = min((o for o in others if o[0] <= 8), default=None)
        if best and best[2] != tag:
            want.add((i, tag, best[2], best[1], best[0], min((d for d, _, other in others if other == tag), default=None)))
    assert len(want) > 20 and {tuple(r) for r in got} == want and len(got) == len(want)


def test_near_duplicates_hash_their_images_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kind = "idx long, dhash long, detail_std double"
    report = dedup.near_duplicates(spark.createDataFrame([(i, i, 9.0) for i in range(10)], kind).mapInArrow(run, kind))
    assert report["pairs"].count() == 45 and report["clusters"].count() == 10 and report["skipped"].count() == 0
    assert seen.value == 10
