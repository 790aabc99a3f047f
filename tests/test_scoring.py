"""Cells and their pairs."""

from clausemill.operators import scoring


def test_cells_are_made_once_for_both_pairs(spark):
    runs = spark.createDataFrame([(1, 5, a, "s") for a in ("off", "mid", "on")] + [(1, 6, "mid", "s"), (1, 6, "mid", "t"), (1, 6, "on", None), (2, 5, "off", "s"), (None, 5, "mid", "s"), (None, 5, "off", "s")], "series long, document_id long, arm string, stratum string")
    judged = [(1, 5, "off", "correct", True, 1, True), (1, 5, "off", "correct", True, 1, True), (1, 5, "off", "incorrect", True, 2, True), (1, 5, "mid", "correct", True, 1, True), (1, 5, "mid", "correct", True, 3, True), (1, 5, "mid", "correct", None, 4, True), (1, 5, "on", None, True, 1, True), (1, 6, "on", "unresolved", True, 1, True)]
    judged = spark.createDataFrame([(*j, "correct", "unsupported", "not_applicable") for j in judged], "series long, document_id long, arm string, status string, anchored boolean, item_id long, covers boolean, classification string, legal_basis string, explanation string")
    cells = scoring.cells(runs, judged.repartition(3), spark.createDataFrame([(5, 4)], "document_id long, items long"))
    of = {(r["series"], r["document_id"], r["arm"], r["stratum"], r["dimension"]): (r["numerator"], r["denominator"]) for r in cells.collect()}
    assert len(of) == 9 * 7 and of[1, 5, "off", "s", "completeness"] == (1, 4) and of[1, 5, "mid", "s", "completeness"] == (2, 4) and of[1, 5, "off", "s", "precision"] == (2, 3)
    assert of[1, 5, "on", "s", "confirmed_share"] == (0, 0) and of[1, 5, "on", "s", "classification_accuracy"] == (1, 1) and of[1, 6, "mid", "t", "completeness"] == (0, 0) and of[1, 6, "on", None, "unresolved_share"] == (1, 1)
    pairs = scoring.paired_differences(cells)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 3
    got = sorted(((r["series"] or 0, r["document_id"], r["pair"], r["difference"]) for r in pairs.where("dimension = 'completeness'").collect()), key=repr)
    assert got == sorted([(1, 5, "mid_off", 0.25), (1, 5, "on_mid", -0.5), (1, 6, "mid_off", None), (1, 6, "mid_off", None), (1, 6, "on_mid", None), (1, 6, "on_mid", None), (0, 5, "mid_off", None)], key=repr)


def test_each_later_cell_meets_each_earlier_one(spark):
    rows = spark.createDataFrame([(1, 1, "d", "off", 0.5), (1, 1, "d", "off", 0.25), (1, 1, "d", "mid", 1.0), (1, 1, "d", "mid", None), (None, 1, "d", "off", 0.5), (None, 1, "d", "mid", 1.0), (1, 2, "d", "on", 0.5), (1, 2, "d", "x", 0.5)], "series long, document_id long, dimension string, arm string, rate double")
    got = sorted(((r["series"], r["document_id"], r["pair"], r["difference"]) for r in scoring.paired_differences(rows).collect()), key=repr)
    assert got == sorted([(1, 1, "mid_off", 0.5), (1, 1, "mid_off", 0.75), (1, 1, "mid_off", None), (1, 1, "mid_off", None), (None, 1, "mid_off", None), (1, 2, "on_mid", None)], key=repr)
