"""Operators on small hand-made inputs: ties, empty classes, guards, traps."""

import json
import math

import pytest
from conftest import rows
from pyspark.sql import Observation, functions as F

from thresher.fixed_values import CLASS_NAMES, FIELDS, RECALL_TARGETS
from thresher.functions import labels as L, scores as S
from thresher.functions.hashing import hash_choice, split_80_10_10
from thresher.functions.text import basename, clean_utf8, nested_text, sniff_type, stem, suffix, text_eligible, token_count
from thresher.operators import calibration as K, learning as J, lineage as G, manifests as M, metrics as D, ranking as R, sampling as P
from thresher.sources.annotations import parse_records, read_annotations, read_image_records
from thresher.sources.files import ordered_files, scan_files
from thresher.sources.manifests import (
    append_manifest, new_arrivals, read_manifest, read_operating_point, report_json, scan_split, write_manifest, write_report, write_splits,
)


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0]


def fails(df, match):
    with pytest.raises(Exception, match=match):
        df.collect()


@pytest.fixture(scope="module")
def scored(spark):
    # Positives at .9 .8 .8 .4, negatives at .8 .3 .3 .1: ties within and across classes.
    data = [(1, 1, .9), (2, 1, .8), (3, 1, .8), (4, 1, .4), (5, 0, .8), (6, 0, .3), (7, 0, .3), (8, 0, .1)]
    return spark.createDataFrame(data, "id int, y int, s double")


# --- metrics ------------------------------------------------------------------------


def test_auc_counts_ties_half(scored):
    pairs = [(p, q) for p in (.9, .8, .8, .4) for q in (.8, .3, .3, .1)]
    assert one(D.roc_auc(scored, "y", "s")).auc == sum(1 if p > q else .5 if p == q else 0 for p, q in pairs) / 16


def test_auc_needs_both_classes(scored):
    assert one(D.roc_auc(scored.filter("y = 1"), "y", "s")).auc is None
    assert one(D.roc_auc(scored.filter("y > 1"), "y", "s")).auc is None


def test_zero_denominators_are_null(scored):
    row = one(D.confusion(scored.filter("y = 0").withColumn("said", F.lit(0)), "y", "said"))
    assert (row.n, row.tn, row.recall, row.precision, row.fpr, row.accuracy) == (4, 4, None, None, 0.0, 1.0)
    empty = one(D.confusion(scored.filter("y > 1").withColumn("said", F.lit(0)), "y", "said"))
    assert (empty.n, empty.accuracy) == (0, None)


def test_classification_matches_its_parts(scored):
    row = one(D.classification(scored, "y", "s", .4))
    assert (row.tp, row.fn, row.fp, row.tn, row.recall, row.fpr) == (4, 0, 1, 3, 1.0, .25)
    assert row.auc == one(D.roc_auc(scored, "y", "s")).auc
    assert row.tp + row.fn == row.positive and row.fp + row.tn == row.negative


def test_pr_curve(scored):
    assert rows(D.pr_curve(scored, "y", "s"), "threshold", "tp", "fp") == [(.1, 4, 4), (.3, 4, 3), (.4, 4, 1), (.8, 3, 1), (.9, 1, 0)]


def test_multiclass_report_over_seen_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 3)], "t int, p int")
    row = one(D.multiclass_report(df, "t", "p"))
    f1 = [2 / 3, 2 / 3, 0, 0]
    assert (row.n, row.accuracy) == (4, .5)
    assert row.macro_f1 == pytest.approx(sum(f1) / 4)


def test_summary_of_one_row(spark):
    row = one(D.score_summary(spark.createDataFrame([(.25,)], "s double"), "s", .25))
    assert (row.n, row.at_or_over, row.rate, row.p50, row.p99, row.max) == (1, 1, 1.0, .25, .25, .25)


def test_totals_stay_apart_from_a_null_category(spark):
    df = spark.createDataFrame([("train", None, .1), ("train", None, .3), ("train", "a", .9)], "split string, cat string, s double")
    found = rows(D.summary_with_totals(df, "s", .2, "split", "cat"), "level", "cat", "n", "at_or_over", "p50")
    assert found == [(0, None, 3, 2, .3), (1, "a", 1, 1, .9), (1, None, 2, 1, .2)]


def test_weights_of_present_classes_only(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (2,)], "c int")
    assert rows(D.class_weights(df, "c"), "c", "weight") == [(0, 4 / 6), (2, 2.0)]
    assert rows(D.class_weights(df, "c", classes=4, cap=.5), "c", "weight") == [(0, 4 / 12), (2, .5)]


def test_weight_rules_cap_each_step_or_once(spark):
    df = spark.createDataFrame([(0, "Negative/a"), (0, "b"), (0, "b"), (0, "b"), (1, "b")], "c int, path string")
    rules = [(F.col("path").startswith("Negative/"), 2.0), (F.lit(True), 2.0)]
    stepwise = D.weigh_rows(df, "c", factors=rules, factor_cap=2.0)
    at_end = D.weigh_rows(df, "c", factors=rules, factor_cap=("end", 3.0))
    assert rows(stepwise, "c", "weight") == [(0, 1.25)] * 3 + [(0, 2.0), (1, 2.0)]
    assert rows(at_end, "c", "weight") == [(0, 1.25)] * 3 + [(0, 2.5), (1, 3.0)]


def test_published_weights(spark):
    data = [("Negative/a", 0, 4, 0), ("data/raw/public_hard_negatives/b", 0, 2, 0), ("c", 0, 2, 0), ("d", 1, 0, 1)]
    df = spark.createDataFrame(data, "path string, bill int, cls int, ctx int")
    v2 = {r.path: (r.bill_weight, r.class_weight) for r in D.verifier_weights(df, "path", "bill", "cls").collect()}
    assert v2["Negative/a"] == pytest.approx((4 / 6 * 2.0, 4 / 7 * 1.5))
    assert v2["data/raw/public_hard_negatives/b"] == pytest.approx((4 / 6 * 1.35, 2 / 7))
    assert v2["d"] == pytest.approx((2.0, 4 / 7))
    router = {r.path: (r.bill_weight, r.class_weight, r.context_weight) for r in D.router_weights(df, "path", "bill", "cls", "ctx").collect()}
    assert router["Negative/a"] == pytest.approx((4 / 6 * 2.0, 4 / 3, 4 / 6))
    assert router["d"] == pytest.approx((2.0 * 1.15, 4 / 3, 2.0))


def test_targeted_labels(spark):
    df = spark.createDataFrame([(5,), (15,), (11,)], "n int")
    assert [r.l for r in df.select(L.targeted_label("n").alias("l")).collect()] == ["scientific_report", "memo", None]


def test_parity_fails_on_a_flip(spark):
    pairs = spark.createDataFrame([(.5, .5001), (.2, .3)], "score_a double, score_b double")
    row = one(D.score_parity(pairs, .4))
    assert (row.checked, row.flips) == (2, 0) and row.max_error == pytest.approx(.1)
    fails(D.score_parity(pairs, .25), "decisions changed")


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "i int, t string")
    b = spark.createDataFrame([(2, None), (1, "x")], "i int, t string")
    c = spark.createDataFrame([(1, "x"), (2, "")], "i int, t string")
    prints = [one(D.fingerprint(t, ["i", "t"])).fingerprint for t in (a, b, c)]
    assert prints[0] == prints[1] != prints[2]
    assert D.check_fingerprint(b, ["i", "t"], D.fingerprint(a, ["i", "t"])).count() == 2
    fails(D.check_fingerprint(c, ["i", "t"], D.fingerprint(a, ["i", "t"])), "not the one recorded")
    assert len(D.check_fingerprint(c, ["i", "t"], D.fingerprint(a, ["i", "t"]), allow_mismatch=True).collect()) == 2


def test_release_gate(spark):
    metrics = spark.createDataFrame([(.95,), (.9499,), (None,)], "recall double")
    assert rows(D.release_gate(metrics), "recall", "released") == [(.9499, 0), (.95, 1), (None, 0)]
    fails(D.release_gate(metrics, on_fail="error"), "below the floor")


def test_leaks_and_duplicates(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "val"), ("b", "train"), ("b", "train")], "g string, split string")
    assert rows(D.leaks(df, "g", "split")) == [("a", 2, 2)]
    assert rows(D.duplicates(df, ["g", "split"])) == [("b", "train", 2)]


def test_folder_regression_without_exclusion(spark):
    df = spark.createDataFrame([("f", 1, 1, "d"), ("f", 0, 1, "e")], "folder string, said int, want int, digest string")
    assert rows(D.folder_regression(df, "folder", "said", "want", "digest")) == [("f", 1, 2, 0)]
    assert rows(D.folder_regression(df, "folder", "said", "want", "digest", df.filter("digest = 'd'"))) == [("f", 0, 1, 1)]


def test_shortfall_lists_missing_categories(spark):
    targets = spark.createDataFrame([("a", 3), ("b", 2)], "c string, requested int")
    got = spark.createDataFrame([("a",), ("a",), ("a",), ("a",), ("z",)], "c string")
    assert rows(D.shortfall(targets, got, "c")) == [("a", 3, 4, 0), ("b", 2, 0, 2)]


# --- thresholds ---------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 10, 20, 37, 200])
@pytest.mark.parametrize("target", [.5, .9, .95, .99, 1.0])
def test_recall_thresholds(spark, n, target):
    positives = [i / 400 for i in range(n)]
    df = spark.createDataFrame([(1, p) for p in positives] + [(0, .999)], "y int, s double")
    misses = one(K.threshold_for_recall(df, "y", "s", target)).threshold
    ceiling = one(K.threshold_for_recall(df, "y", "s", target, "ceil")).threshold
    assert misses == positives[min(max(math.floor((1 - target) * n + 1e-12), 0), n - 1)]
    assert ceiling == positives[n - math.ceil(target * n)]
    for t in (misses, ceiling):
        assert sum(p >= t for p in positives) / n >= target - 1e-9


def test_recall_threshold_without_positives(spark):
    df = spark.createDataFrame([(0, .5)], "y int, s double")
    assert one(K.threshold_for_recall(df, "y", "s", .9)).threshold is None


def test_curve_threshold_prefers_precision_then_height(scored):
    row = one(K.threshold_from_curve(scored, "y", "s", (.75,), required=True))
    assert (row.threshold, row.recall, row.precision) == (.4, 1.0, .8)
    low = one(K.threshold_from_curve(scored, "y", "s", (.1,)))
    assert (low.threshold, low.precision) == (.9, 1.0)
    assert K.threshold_from_curve(scored, "y", "s", (1.5,)).count() == 0


def test_required_targets_must_be_reached(scored):
    fails(K.threshold_from_curve(scored, "y", "s", (.5, 1.5), required=True), "unreachable")


def test_recall_sweep_has_all_targets(scored):
    assert K.threshold_from_curve(scored, "y", "s").count() == len(RECALL_TARGETS)


def brute_route(data, cuts, t):
    out = {}
    for i, low in enumerate(cuts):
        for high in cuts[i:]:
            said = [(y, 1 if r >= high else int(l >= t) if r >= low else 0, low <= r < high) for y, r, l in data]
            out[low, high] = (
                sum(y and s for y, s, _ in said), sum((not y) and s for y, s, _ in said), sum(u for _, _, u in said))
    return out


def test_route_grid_equals_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(rng.randrange(2), rng.randrange(12) / 11, rng.randrange(7) / 6) for _ in range(300)]
    df = spark.createDataFrame(data, "y int, r double, l double")
    grid = K.route_grid(df, "y", "r", "l", .5, steps=9).collect()
    cuts = sorted({g.low for g in grid} | {g.high for g in grid})
    wanted = brute_route(data, cuts, .5)
    assert {(g.low, g.high): (g.tp, g.fp, g.routed) for g in grid} == wanted
    assert cuts[0] == float("-inf") and cuts[-1] == float("inf")


def test_route_profiles_fall_back_to_best_recall(spark):
    df = spark.createDataFrame([(1, .5, 0.), (1, .5, 0.), (0, .9, 1.), (0, .1, 0.)], "y int, r double, l double")
    points = {r.profile: r for r in K.calibrate_route(df, "y", "r", "l", .5, 1.0, steps=5).collect()}
    assert set(points) == {"accuracy_first", "route_cap_10pct", "route_cap_20pct", "route_cap_30pct", "route_cap_50pct"}
    assert points["accuracy_first"].recall == 1.0
    nothing_reaches = K.speed_profiles(K.route_grid(df.filter("r = .5"), "y", "r", "l", .5, 5).filter("recall < 1"), 1.0)
    assert all(r.recall < 1 for r in nothing_reaches.collect())


def test_fusion_reproduces_logged_scores(spark):
    # direct, class, fused at alpha 0.8, decision at 0.3006436387035705: published golden rows.
    golden = [
        (0.954319179058075, 0.9344936944544315, 0.9508756011738333, True),
        (0.9194956421852112, 0.9694432195974514, 0.9333819075006567, True),
        (0.8767994046211243, 0.7483691857196391, 0.8566767595480795, True),
        (0.7066961526870728, 0.5244228383526206, 0.6732820775149301, True),
        (0.008020924404263496, 0.0011954508372582495, 0.005487795111096232, False),
        (0.00529329152777791, 0.001102104113670066, 0.0038697334733987596, False),
        (0.03422202169895172, 0.04558672569692135, 0.036251565216247575, False),
        (0.6947336196899414, 0.14277194812893867, 0.5742918977322863, True),
        (0.8773747682571411, 0.6116048619151115, 0.8409152468728684, True),
    ]
    df = spark.createDataFrame([g[:2] for g in golden], "d double, c double")
    found = df.select(S.fuse_logit("d", "c", .8).alias("f"), S.decide(S.fuse_logit("d", "c", .8), 0.3006436387035705).alias("said")).collect()
    for (_, _, fused, said), row in zip(golden, found):
        assert row.f == pytest.approx(fused, abs=1e-12)
        assert bool(row.said) == said


def test_logit_is_clipped(spark):
    row = one(spark.createDataFrame([(0.0, 1.0)], "a double, b double").select(S.logit("a").alias("a"), S.logit("b").alias("b")))
    assert row.a == pytest.approx(math.log(1e-6 / (1 - 1e-6))) and row.b == pytest.approx(-row.a)


def test_candidates_tie_on_fpr_then_auc_then_order(spark):
    data = []
    for name, position, shift in (("late", 2, 0.), ("early", 1, 0.), ("worse", 0, 1.)):
        data += [(name, position, 1, .9), (name, position, 1, .6), (name, position, 0, .2 + .5 * shift), (name, position, 0, .1)]
    df = spark.createDataFrame(data, "c string, p int, y int, s double")
    row = one(K.select_candidate(df, "c", "p", "y", "s", 1.0))
    assert (row.c, row.threshold, row.recall, row.fpr, row.auc) == ("early", .6, 1.0, 0.0, 1.0)


def test_select_on_one_report_on_other(scored):
    report = {r.part: r for r in K.select_then_report(scored, scored.filter("id > 1"), "y", "s", 1.0, .5).collect()}
    assert report["validation"].threshold == report["test"].threshold == .4
    assert (report["test"].n, report["test_fixed"].threshold, report["test"].recall) == (7, .5, 1.0)


def test_expected_cost(spark):
    df = spark.createDataFrame([(1.0, 4.0, 1), (1.0, 6.0, 0)], "r double, l double, u int")
    assert one(K.expected_cost(df, "u", "r", "l")).expected_cost == 1.0 + .5 * 5.0


# --- mining and quotas --------------------------------------------------------------


def test_hardest_breaks_ties_by_the_higher_key(spark):
    df = spark.createDataFrame([("a", .5), ("b", .5), ("c", .4), ("d", .9)], "path string, s double")
    assert [r.path for r in R.hardest(df, 3, "s", "path", F.col("path") != "d").orderBy("path").collect()] == ["a", "b", "c"]
    assert [r.path for r in R.hardest(df, 2, "s", "path").orderBy("path").collect()] == ["b", "d"]


def test_hard_plus_random_needs_enough_rows(scored):
    chosen = R.hard_plus_random(scored, 5, 2, "s", "id", 1).collect()
    assert sorted(r.id for r in chosen if r.part == "hard") == [1, 2, 3]
    assert len({r.id for r in chosen}) == 5
    fails(R.hard_plus_random(scored, 9, 2, "s", "id", 1), "fewer rows")
    with pytest.raises(ValueError):
        R.hard_plus_random(scored, 2, 2, "s", "id", 1)


def test_round_robin_takes_first_pages_first(spark):
    pages = [("c", "long", p) for p in range(50)] + [("c", "short", 0), ("c", "mid", 0), ("c", "mid", 1)]
    df = spark.createDataFrame(pages, "c string, d string, p int")
    picked = R.round_robin(df, "c", "d", "p", cap=5, quota=4, seed=1).collect()
    assert {r["d"] for r in picked if r.page_rank == 1} == {"long", "short", "mid"}
    assert sorted(r.page_rank for r in picked) == [1, 1, 1, 2]
    everything = R.round_robin(df, "c", "d", "p", cap=5, quota=100, seed=1).collect()
    assert len(everything) == 5 + 1 + 2


def test_topup_takes_the_next_rows(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", i) for i in range(10)] + [("z", 1)], "source string, i int")
    spec = (("a", "p", .5, 100), ("b", "p", .5, 8), ("none", "n", 1.0, 5))
    picked = rows(R.quota_topup(df, "source", "i", spec, 10), "source", "i")
    assert picked == [("a", i) for i in range(4)] + [("b", i) for i in range(6)]
    capped = rows(R.quota_topup(df, "source", "i", spec, 40), "source", "i")
    assert len([r for r in capped if r[0] == "b"]) == 8


def test_quota_rounds_half_to_even(spark):
    supply = spark.createDataFrame([("a", 100), ("b", 100)], "source string, available bigint")
    spec = (("a", "p", .25, 100), ("b", "q", .35, 100))
    found = {r.source: (r["first"], r.extra) for r in R.source_quotas(supply, spec, 10).collect()}
    assert found == {"a": (2, 8), "b": (4 if .35 * 10 == 3.5 else 3, 6 if .35 * 10 == 3.5 else 7)}


def test_representative_prefers_the_original(spark):
    df = spark.createDataFrame([("r", "r"), ("a", "r"), ("syn_hard_neg_1", "q"), ("z", "q")], "path string, root string")
    prefer = [F.col("path") != F.col("root"), F.col("path").contains("syn_hard_neg")]
    assert rows(R.representative(df, "root", prefer, "path"), "root", "path") == [("q", "z"), ("r", "r")]


def test_caps_leave_out_unknown_splits(spark):
    df = spark.createDataFrame([("train", 3), ("train", 1), ("val", 2), ("other", 0)], "split string, at int")
    assert rows(R.arrival_caps(df, "split", "at", {"train": 1, "val": 5})) == [("train", 1), ("val", 2)]


def test_exemplars_are_ordered(scored):
    examples = one(R.exemplars(scored, "s", "id", ["id", "s"], 3)).examples
    assert [e.id for e in examples] == [1, 2, 3]


def test_misses(scored):
    assert rows(R.misses(scored, "y", "s", .8, ["id"])) == [(4,)]


# --- splits and samples -------------------------------------------------------------


def test_group_split_keeps_groups_and_shares(spark):
    data = [(i, f"g{i // 3}" if i % 10 else "giant", i % 4 == 0) for i in range(4000)]
    df = spark.createDataFrame(data, "id int, g string, lab boolean").withColumn("lab", F.col("lab").cast("int"))
    split = P.stratified_group_split(df, "g", "lab", 5).cache()
    assert split.count() == 4000
    assert D.leaks(split, "g", "split").count() == 0
    again = P.stratified_group_split(df.repartition(3), "g", "lab", 5)
    assert rows(split, "id", "split") == rows(again, "id", "split")
    shares = {r.split: r["count"] / 4000 for r in split.groupBy("split").count().collect()}
    assert shares["train"] > .7


def test_majority_tie_goes_to_the_lowest_label(spark):
    df = spark.createDataFrame([(i, f"g{i // 2}", i % 2) for i in range(200)], "id int, g string, lab int")
    by_zero = df.withColumn("lab", F.lit(0))
    assert rows(P.stratified_group_split(df, "g", "lab", 1), "id", "split") == rows(P.stratified_group_split(by_zero, "g", "lab", 1), "id", "split")


def test_forced_split_names_are_checked(spark):
    base = spark.createDataFrame([("a", "train")], "filepath string, split string")
    assert P.force_splits(base, spark.createDataFrame([("b", "val")], base.schema)).count() == 2
    fails(P.force_splits(base, spark.createDataFrame([("b", "dev")], base.schema)), "invalid forced split dev")


def test_thinning_rounds_half_to_even_and_keeps_one(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 10)] + [("c", i) for i in range(20, 27)] + [("keep", 30)], "s string, i int")
    kept = P.thin_by_source(df, "s", .5, "i", 1, F.col("s") != "keep").groupBy("s").count()
    assert rows(kept) == [("a", 2), ("b", 1), ("c", 4), ("keep", 1)]
    tiny = P.thin_by_source(df, "s", .1, "i", 1).groupBy("s").count()
    assert {r["count"] for r in tiny.collect()} == {1}
    for fraction in (0.0, 1.1):
        with pytest.raises(ValueError):
            P.thin_by_source(df, "s", fraction, "i", 1)


def test_oversampling_counts(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, hard boolean")
    assert rows(P.oversample(df, F.col("hard"), 3).groupBy("i").count()) == [(1, 3), (2, 1), (3, 1)]
    assert P.oversample(df, F.col("hard"), 1).count() == 3
    with pytest.raises(ValueError):
        P.oversample(df, F.col("hard"), 0)


def test_samples(spark):
    df = spark.range(50).withColumn("c", F.col("id") % 2)
    assert P.seeded_sample(df, 7, "id", 1).count() == 7
    assert rows(P.seeded_sample(df, 7, "id", 1)) == rows(P.seeded_sample(df.repartition(5), 7, "id", 1))
    assert rows(P.seeded_sample(df, 7, "id", 1)) != rows(P.seeded_sample(df, 7, "id", 2))
    assert P.exact_sample(df, 50, "id", 1).count() == 50
    fails(P.exact_sample(df, 51, "id", 1), "fewer than 51")
    assert rows(P.per_class_sample(df, "c", 4, "id", 1).groupBy("c").count()) == [(0, 4), (1, 4)]


def test_pair_plan(spark):
    data = [(f"p{i}", "rvlcdip_invoice", 1) for i in range(4)] + [("n", "rvlcdip_other", 0), ("b1", "coco_photos", 0), ("b2", "coco_photos", 0), ("s", "synthetic_hard_pos", 1)]
    df = spark.createDataFrame(data, "filepath string, source string, invoice_label int")
    pools = P.pair_pools(df, "source", "invoice_label")
    assert one(P.pool_sizes(pools)).asDict() == {"positives": 4, "negatives": 1, "backgrounds": 2}
    fails(P.pool_sizes(P.pair_pools(df.filter("source <> 'coco_photos'"), "source", "invoice_label")), "no backgrounds")
    plan = P.pair_plan(pools["positives"], pools["backgrounds"], "filepath", 100, "hard_pos", 1, 3).collect()
    assert len(plan) == 100 and {p.source_doc for p in plan} == {"p0", "p1", "p2", "p3"} and {p.background for p in plan} == {"b1", "b2"}
    assert min(p.filepath for p in plan) == "syn_hard_pos_00000.jpg"


def test_group_key(spark):
    df = spark.createDataFrame([("r", "a"), ("", "b"), (None, "c")], "source_doc string, filepath string")
    assert rows(P.group_key(df), "group") == [("b",), ("c",), ("r",)]


# --- lineage and manifests ----------------------------------------------------------


def test_lookup_fails_on_a_missing_key(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    reference = spark.createDataFrame([("a", 1)], "k string, v int")
    fails(G.lookup(df, reference, "k", "v"), "no v for b")
    assert rows(G.lookup(df, reference, "k", "v", required=False)) == [("a", 1), ("b", None)]


def test_own_fix_beats_the_fix_of_the_root(spark):
    df = spark.createDataFrame([("r", "r", "invoice"), ("s", "r", "receipt"), ("t", "r", "natural_photo"), ("u", "u", "invoice")],
                               "path string, root string, cls string")
    fixes = spark.createDataFrame([("r", "letter"), ("s", "form")], "path string, cls string")
    assert rows(G.repair_classes(df, fixes, "path", "root", "cls"), "path", "cls") == [
        ("r", "letter"), ("s", "form"), ("t", "natural_photo"), ("u", "invoice")]


def test_derived_rows_take_the_label_of_the_root(spark):
    columns = "filepath string, source string, source_doc string, invoice_label int"
    df = spark.createDataFrame([("r", "cord_receipts", "r", 1), ("x", "synthetic_hard_neg", "r", 0), ("p", "coco_photos", "p", 0),
                                ("y", "synthetic_hard_pos", "p", 1)], columns)
    assert rows(G.inherit_label(df, "filepath", "source_doc", "invoice_label", "source"), "filepath", "source", "invoice_label") == [
        ("p", "coco_photos", 0), ("r", "cord_receipts", 1), ("x", "synthetic_hard_pos", 1), ("y", "synthetic_hard_neg", 0)]
    orphan = spark.createDataFrame([("x", "synthetic_hard_neg", "gone", 0)], columns)
    fails(G.inherit_label(orphan, "filepath", "source_doc", "invoice_label", "source"), "missing lineage root")


def test_class_rules(spark):
    data = [
        ("a", 1, "cord_receipts", "a", "invoice", "receipt"), ("b", 1, "rvlcdip_invoice", "b", "invoice", "invoice"),
        ("c", 1, "synthetic_hard_pos", "x/sroie_receipts_1", "", "receipt"), ("d", 1, "synthetic_hard_pos", "b", "", "invoice"),
        ("e", 0, "coco_photos", "e", "letter", "natural_photo"), ("f", 0, "hiertext_text_scene", "f", "", "text_scene"),
        ("g", 0, "rvl_targeted_scientific_report", "g", "", "narrative_document"), ("h", 0, "rvlcdip_other", "h", " Advertisement ", "advertisement_presentation"),
        ("i", 0, "synthetic_hard_neg", "e", "letter", "natural_photo"), ("j", 0, "synthetic_hard_neg", "gone", "memo", "narrative_document"),
        ("k", 0, "target_hard_negative", "k", "letter", "structured_document"), ("l", 0, "other", "l", None, "structured_document"),
    ]
    df = spark.createDataFrame([d[:5] for d in data], "filepath string, invoice_label int, source string, source_doc string, predicted_class string")
    found = dict(rows(G.derive_class(df), "filepath", "class_name"))
    assert found == {d[0]: d[5] for d in data}


def test_scene_labels_exist_in_one_mapper_only(spark):
    df = spark.createDataFrame([("Text_Scene",), ("natural photo",), ("news_article",), ("?",)], "l string")
    assert rows(df.select(L.taxonomy("l").alias("t"))) == [("narrative_document",), ("natural_photo",), ("structured_document",), ("text_scene",)]
    assert rows(df.select(L.taxonomy("l", L.FAMILIES).alias("t"))) == [("narrative_document",)] + [("structured_document",)] * 3


def test_unknown_values_fail(spark):
    df = spark.createDataFrame([("cord_receipts",), ("new",)], "s string")
    fails(df.select(L.map_label("s")), "no label configured for source new")
    fails(df.select(L.class_position("s")), "unknown class")
    assert rows(spark.createDataFrame([(n,) for n in CLASS_NAMES], "s string").select(L.class_position("s").alias("i"))) == [(i,) for i in range(7)]


def test_excluding_content(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "i int, d string")
    b = spark.createDataFrame([("x",), ("x",)], "d string")
    assert rows(G.exclude_content(a, b, "d"), "i") == [(3,), (4,)]
    assert one(G.content_overlap(a, b, "d")).asDict() == {"kept": 2, "excluded": 2}


def test_resume_by_shard_and_digest(spark):
    df = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s2", "c"), ("s3", "a")], "shard string, d string")
    seen = spark.createDataFrame([("s1", "a")], "shard string, d string")
    assert rows(new_arrivals(df, seen, ["shard", "d"]), "shard", "d") == [("s2", "b"), ("s2", "c")]


def test_manifest_guards(spark):
    a = spark.createDataFrame([("x", "train"), ("y", "val")], "filepath string, split string")
    assert M.concat_unique(a, a.withColumn("filepath", F.concat("filepath", F.lit("2"))), key="filepath").count() == 4
    fails(M.concat_unique(a, a, key="filepath"), "duplicate keys")
    fails(M.assert_disjoint(a, a.limit(1), "filepath"), "already exist")
    fails(M.preserve_count(a, a.limit(1)), "rows were lost")
    assert len(M.preserve_count(a, a).collect()) == 2
    mined = spark.createDataFrame([("m", "train", "category_top_score"), ("h", "val", "external_holdout")], "filepath string, split string, selection string")
    fields = ["filepath", "split"]
    assert rows(M.add_train_only(a, mined, "filepath", fields)) == [("m", "train"), ("x", "train"), ("y", "val")]
    fails(M.add_train_only(a, mined.withColumn("split", F.lit("train")), "filepath", fields), "held-out row")
    fails(M.add_train_only(a, mined.filter("split = 'val'"), "filepath", fields), "no train rows")
    fails(M.add_train_only(a, mined.withColumn("filepath", F.lit("x")), "filepath", fields), "already exist")


def test_overlap_drops_copies_and_pairs_nulls(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("y", 2), (None, 3)], "k string, n int")
    b = spark.createDataFrame([("x", 1), (None, 3), ("y", 9)], "k string, n int")
    assert rows(M.overlap(a, b, ["k", "n"])) == [("x", 1), (None, 3)]
    assert rows(M.overlap(a, b, "k")) == [("x",), ("y",), (None,)]


def test_keep_selected_and_listed(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "val")], "filepath string, split string")
    chosen = spark.createDataFrame([("a",), ("a",)], "filepath string")
    assert rows(G.keep_selected(df, chosen, "filepath")) == [("a", "train"), ("c", "val")]
    assert G.listed(df, chosen, "filepath").count() == 1


# --- columns ------------------------------------------------------------------------


def test_text_columns(spark):
    df = spark.createDataFrame([("  one two\tthree ",), ("",), ("   ",)], "t string")
    assert [r.n for r in df.select(token_count("t").alias("n")).collect()] == [3, 0, 0]
    long = spark.createDataFrame([("a " * 20,), ("a " * 19,), ("b " * 20 + "reinvoiced",)], "t string")
    assert [r.e for r in long.select(text_eligible("t").alias("e")).collect()] == [True, False, False]


def test_nested_text_prefers_the_line(spark):
    schema = "paragraphs array<struct<lines:array<struct<text:string,words:array<struct<text:string>>>>>>"
    record = {"paragraphs": [{"lines": [{"text": "Total X", "words": [{"text": "no"}]}, {"text": "", "words": [{"text": "A"}, {"text": None}, {"text": "B"}]}]},
                             {"lines": None}, {"lines": [{"text": None, "words": None}]}]}
    df = spark.createDataFrame([(json.dumps(record),)], "j string").select(F.from_json("j", schema).alias("r"))
    assert one(df.select(nested_text("r.paragraphs").alias("t"))).t == "total x a  b"


def test_annotation_shapes(spark, tmp_path):
    files = {"many.json": {"annotations": [{"image_id": "1", "paragraphs": []}, {"image_id": "2", "paragraphs": []}]},
             "one.json": {"image_id": "3", "paragraphs": []}, "none.json": {"info": {}}}
    for name, content in files.items():
        (tmp_path / name).write_text(json.dumps(content, indent=1))
    assert rows(read_annotations(spark, str(tmp_path)), "image_id") == [("1",), ("2",), ("3",)]


def test_image_records(spark, tmp_path):
    (tmp_path / "train.json").write_text(json.dumps({"images": [{"file_name": "a.png", "page_no": 3}, {"file_name": "b.png"}]}))
    assert rows(read_image_records(spark, str(tmp_path), "file_name string, page_no int")) == [("a.png", 3), ("b.png", None)]
    df = spark.createDataFrame([(1, '[{"k": 1}, {"k": 2}]'), (2, '{"k": 3}'), (3, None)], "i int, j string")
    assert rows(parse_records(df, "j", "k int", ["i"])) == [(1, 1), (1, 2), (2, 3)]


def test_content_types(spark):
    data = [(b"\x89PNG\r\n\x1a\nrest", 9, 9, 3, "png"), (b"\xff\xd8\xff\xe0", 1, 4, 1, "jpg"), (b"\0" * 12, 2, 2, 3, "raw"),
            (b"\0" * 12, 2, 3, 2, None), (b"\0" * 11, 2, 2, 3, None)]
    df = spark.createDataFrame([tuple(bytearray(v) if isinstance(v, bytes) else v for v in d[:4]) for d in data], "b binary, w int, h int, c int")
    assert [r.t for r in df.select(sniff_type("b", "w", "h", "c").alias("t")).collect()] == [d[4] for d in data]


def test_bytes_to_text(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb\0c"),)], "b binary")
    assert one(df.select(clean_utf8("b").alias("t"))).t == "a�bc"


def test_paths(spark):
    df = spark.createDataFrame([("a/b/C.tar.GZ",), ("x",), ("d/.hidden",)], "p string")
    found = [tuple(r) for r in df.select(basename("p"), stem("p"), suffix("p")).collect()]
    assert found == [("C.tar.GZ", "C.tar", ".gz"), ("x", "x", ""), (".hidden", ".hidden", "")]


def test_screenshot_prefixes(spark):
    df = spark.createDataFrame([("data/raw/screenshot_x/1",), ("screenshot:chat:1",), ("data/raw/pool/1",)], "p string")
    assert [r.c for r in df.select(L.capture_context("p").alias("c")).collect()] == ["screenshot", "screenshot", "direct"]
    # The evaluation form knows the folder prefix only.
    assert [r.c for r in df.select(L.is_screenshot("p", ("data/raw/screenshot_",)).alias("c")).collect()] == [True, False, False]


def test_hash_split_and_choice_agree_with_plain_python(spark):
    from hashlib import sha256

    keys = [f"class:memo:{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    wanted = [{0: "val", 1: "test"}.get(int(sha256(k.encode()).hexdigest()[:8], 16) % 10, "train") for k in keys]
    assert [r.s for r in df.select(split_80_10_10("k").alias("s")).collect()] == wanted
    options = ("a", "b", "c", "d")
    wanted = [options[int(sha256(k.encode()).hexdigest()[16:24], 16) % 4] for k in keys]
    assert [r.s for r in df.select(hash_choice("k", options).alias("s")).collect()] == wanted


# --- storage ------------------------------------------------------------------------


def test_manifest_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('a "quoted", name', "1", "memo", 1, .25, None)], "filepath string, source string, predicted_class string, invoice_label int, confidence double, source_doc string")
    path = str(tmp_path / "m")
    write_manifest(df, path, "labeled")
    assert rows(read_manifest(spark, path, "labeled")) == rows(df)
    assert read_manifest(spark, path, "labeled").columns == list(FIELDS["labeled"])
    with pytest.raises(Exception, match="exist"):
        write_manifest(df, path, "labeled")
    append_manifest(df, str(tmp_path / "p"))
    append_manifest(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_split_scan_reads_one_partition(spark, tmp_path):
    path = str(tmp_path / "s")
    write_splits(spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string"), path)
    scan = scan_split(spark.read.parquet(path), "val")
    assert rows(scan, "i") == [(2,)]
    assert "PartitionFilters: [isnotnull(split" in scan._jdf.queryExecution().executedPlan().toString()


def test_operating_point(spark, tmp_path):
    path = tmp_path / "report.json"
    path.write_text(json.dumps({"architecture": "x", "calibration": {"alpha_direct_head": .8, "threshold": .3, "metrics": {"n": 3}}}, indent=2))
    assert rows(read_operating_point(spark, str(path))) == [(.8, .3)]


def test_reports(spark, tmp_path):
    report = spark.createDataFrame([(1, .5)], "n int, recall double")
    write_report(report, str(tmp_path / "r"))
    assert rows(spark.read.json(str(tmp_path / "r"))) == [(1, .5)]
    assert one(report_json(report)).report == '{"n":1,"recall":0.5}'


def test_listing(spark, tmp_path):
    for name in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "d.png").mkdir()
    assert [r.file for r in ordered_files(scan_files(spark, str(tmp_path))).collect()] == ["a.png", "b.JPG"]


# --- models -------------------------------------------------------------------------


def test_training_and_mining(spark):
    data = [(i, [float(i % 10), 1.0], int(i % 10 > 6), "train" if i % 5 else "val") for i in range(300)]
    df = spark.createDataFrame(data, "id int, v array<float>, y int, split string")
    model = J.train_weighted(df, "v", "y", classes=2)
    scored = J.apply_model(model, df, "v").withColumn("s", F.element_at("probability", 2))
    assert one(D.roc_auc(scored, "y", "s")).auc == 1.0
    batch = J.score_batches(df, "v", J.linear_scorer(model.coefficients.toArray(), model.intercept), 2)
    assert one(batch.join(scored.select("id", "s"), "id").agg(F.max(F.abs(F.col("s") - F.col("score"))).alias("e"))).e < 1e-6
    before, mined, after = J.mine_replay_retrain(df, "v", "y", "id", 5, 3)
    assert {tuple(r)[0] % 10 for r in mined.collect()} == {6}
    assert after.coefficients[0] != before.coefficients[0]


def test_models_score_in_a_session_that_has_observed(spark):
    df = spark.createDataFrame([(i, [float(i % 10), 1.0], int(i % 10 > 6)) for i in range(100)], "id int, v array<float>, y int")
    passed = Observation()
    df.observe(passed, F.count(F.lit(1)).alias("n")).collect()
    assert passed.get["n"] == 100
    scored = J.apply_model(J.train_weighted(df, "v", "y", classes=2), df, "v")
    assert one(scored.filter((F.element_at("probability", 2) > 0.5) == (F.col("y") == 1)).agg(F.count(F.lit(1)).alias("n"))).n == 100
