import pytest
from pyspark.sql import functions as F

from foldwright.operators import review, validate

REVIEW = "key string, label_old int, label_new int, decision string"
FOLDS = "key string, label int, fold int"


def checks(report):
    return {r["check"]: (r["ok"], r["n_bad"]) for r in report.collect()}


def test_severity_and_caption(spark):
    rows = [(2, 0, 2, 0.5, 0.123), (3, 1, 1, 0.2, None), (4, 1, 1, 0.9, float("nan")), (5, 2, 2, None, None)]
    df = spark.createDataFrame(rows, "csv_row int, label int, pred_class int, margin double, quality double")
    got = df.select("csv_row", review.review_severity().alias("s"), review.review_caption().alias("c")).collect()
    by = {r["csv_row"]: (r["s"], r["c"]) for r in got}
    assert by[2] == ("mislabel", "[Baris 2] ✗ Recyclable→Organic\nM=0.50 Q=0.12")
    assert by[3] == ("ambiguous", "[Baris 3] ✓ Electronic\nM=0.20")
    assert by[4] == ("correct", "[Baris 4] ✓ Electronic\nM=0.90")
    assert by[5] == ("correct", "[Baris 5] ✓ Organic\nM=nan")


def test_merge_prefers_the_issue(spark):
    issues = spark.createDataFrame(
        [("a", 0, 1, 0.5, 0.1, True), ("b", 1, 2, 0.6, 0.2, False)],
        "key string, label int, pred_class int, margin double, quality double, is_high_priority boolean")
    amb = spark.createDataFrame(
        [("b", 1, 2, 0.01, "both", True, True), ("c", 2, 2, 0.02, "low_margin", False, False)],
        "key string, label int, pred_class int, margin double, source string, is_priority_pair boolean, "
        "is_double_flagged boolean")
    rows = {r["key"]: r for r in review.merge_candidates(issues, amb).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["b"]["source"] == "label_issue" and rows["b"]["margin"] == 0.6
    assert rows["b"]["is_double_flagged"] and rows["b"]["ambig_source"] == "both"
    assert rows["c"]["source"] == "ambiguous_filter" and rows["c"]["quality"] is None
    kept = {r["key"]: r for r in review.merge_candidates(issues, amb, compat=True).collect()}
    assert kept["b"]["is_double_flagged"] is None and kept["b"]["margin"] == 0.6
    assert kept["c"]["is_double_flagged"] is False


def test_order_pages_and_log(spark):
    rows = [(i, [0, 1, 2][i % 3], [2, 0, 0][i % 3], i / 1000, i % 7 == 0, True) for i in range(137)]
    df = spark.createDataFrame(rows, "key int, label int, pred_class int, margin double, is_double_flagged boolean, "
                                     "is_priority_pair boolean")
    out = review.review_order(df.repartition(5), per_page=20)
    got = sorted(out.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in got] == list(range(137)) and [r["csv_row"] for r in got] == list(range(2, 139))
    rank = {(0, 2): 0, (2, 0): 1, (1, 0): 2}
    want = sorted(rows, key=lambda r: (rank[(r[1], r[2])], not r[4], r[3], r[0]))
    assert [r["key"] for r in got] == [r[0] for r in want]
    sizes = [46, 45, 46]
    page, seen = 0, {}
    for r in got:
        n = seen.get(r["pair_key"], 0)
        if n % 20 == 0:
            page += 1
        seen[r["pair_key"]] = n + 1
        assert r["page"] == page and r["page_in_pair"] == n // 20 + 1
    assert sorted(seen.values()) == sorted(sizes)
    assert review.review_order(df, per_page=20, max_pages=2).count() == 40
    log = review.init_review_log(out)
    assert log.where("decision <> 'pending' OR label_old <> label_new").count() == 0
    assert checks(validate.validate_review(log))["no_pending"] == (False, 137)
    alone = review.review_order(df, group_by_pair=False)
    assert {r["page"] for r in alone.collect()} == {1, 2, 3}


def test_pair_ranks():
    r = review.pair_ranks(3, ("Recyclable", "Electronic", "Organic"), ((0, 2), (2, 0)))
    assert [p for p, _ in sorted(r.items(), key=lambda x: x[1])] == [
        (0, 2), (2, 0), (1, 1), (1, 2), (1, 0), (2, 1), (2, 2), (0, 1), (0, 0)]


def test_apply_review(spark):
    folds = spark.createDataFrame([("a", 0, 0), ("b", 1, 1), ("c", 2, 2), ("d", 0, 3)], FOLDS)
    log = spark.createDataFrame([("a", 0, 0, "drop"), ("b", 1, 2, "relabel"), ("c", 2, 0, "keep"), ("z", 0, 1, "relabel")],
                                REVIEW)
    after = review.apply_review(folds, log)
    assert sorted(map(tuple, after.collect())) == [("b", 2, 1), ("c", 2, 2), ("d", 0, 3)]
    assert review.fold_unchanged(after, folds).count() == 0
    moved = after.withColumn("fold", F.col("fold") + 1)
    assert review.fold_unchanged(moved, folds).count() == 3
    s = review.cleaning_summary(folds, after, log).first()
    assert (s["total_before"], s["total_after"], s["n_dropped"], s["drop_pct"]) == (4, 3, 1, 25.0)
    assert not s["within_cap"] and s["weight_Electronic"] == float("inf") and s["weight_Organic"] == 0.5


@pytest.mark.parametrize("row,rule", [
    (("x", 0, 0, "pending"), "no_pending"), (("x", 0, 0, "maybe"), "decision_known"), (("x", 0, 0, None), "decision_known"),
    (("x", 1, 1, "relabel"), "relabel_changes_label"), (("x", 1, 5, "relabel"), "new_label_known"),
    (("a", 0, 0, "drop"), "key_once")])
def test_bad_reviews(spark, row, rule):
    good = [("a", 0, 0, "drop"), ("b", 1, 2, "relabel"), ("c", 2, 2, "keep")]
    assert all(ok for ok, _ in checks(validate.validate_review(spark.createDataFrame(good, REVIEW))).values())
    report = validate.validate_review(spark.createDataFrame([*good, row], REVIEW))
    assert checks(report)[rule] == (False, 1)
    with pytest.raises(ValueError, match=rule):
        validate.assert_ok(report)


def test_review_needs_its_columns(spark):
    assert checks(validate.validate_review(spark.createDataFrame([("a",)], "key string"))) == {
        "required_columns": (False, 3)}
