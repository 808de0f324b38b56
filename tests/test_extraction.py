"""Certificates, grades, named offers and proposals on small hand-made tables."""

from pyspark.sql import functions as F

from factloom.operators import extraction as E
from factloom.operators import rules as R
from factloom.operators import state as X

RULES = [("operation", "cutting", 0, ["cutting"], [], [], [], []), ("domain", "fast", 0, ["femtosecond"], [], [], [], [])]


def test_certificates_keep_the_first_source(spark):
    rows = [("a", "u2", "we hold ISO 9001 and EN9100"), ("a", "u1", "iso-9001:2015"), ("b", "u3", "ISO 90011"), ("b", "u4", None)]
    got = {tuple(r) for r in E.certificates(spark.createDataFrame(rows, "g string, url string, t string"), "g", "url", "t").collect()}
    assert got == {("a", "ISO 9001", "u1"), ("a", "AS 9100", "u2")}


def test_best_grade_prefers_the_current_standard(spark):
    rows = [("a", "u1", "cleanroom class 100 and ISO 7"), ("a", "u2", "clean room ISO class 5"), ("b", "u3", "cleanroom class 1000, class 100"), ("c", "u4", "ISO 5 without context"), ("d", "u5", None)]
    got = {tuple(r) for r in E.best_grade(spark.createDataFrame(rows, "g string, url string, t string"), "g", "url", "t").collect()}
    assert got == {("a", "current", 5, "u2"), ("b", "former", 100, "u3")}


def test_names(spark):
    rows = ["Laser cutting service", "why choose us?", "7 reasons to buy", "a lower start", "A sentence.", "Brochure 2020", "X" * 81, "One two three four five six seven eight nine ten eleven", "ÉCRAN 3000", "", None]
    got = [r.ok for r in spark.createDataFrame([(x,) for x in rows], "n string").select(E.nameable(F.col("n")).alias("ok")).collect()]
    assert got == [True, False, False, False, False, False, False, False, True, False, False]


def test_named_offers(spark):
    blocks = [
        (1, 0, "Fine cutting", "Intro", "General words. More."), (1, 1, "Fine cutting", "Cutting of tubes", "Cutting of tubes We cut with femtosecond pulses. Second."), (1, 2, "Fine cutting", "Contact", "Write to us."), (1, 3, "Fine cutting", "cutting of TUBES", "x"),
        (2, 0, "About us", "Model XR 200", "A thing of ours."), (3, 0, None, None, None),
    ]
    got = {(r.page_id, r.name): (r.kind, r.operations, r.status, r.description) for r in E.named_offers(spark.createDataFrame(blocks, "page_id long, pos int, title string, heading string, text string"), R.rule_table(spark, RULES), "domain").collect()}
    assert got[1, "Cutting of tubes"] == ("section", ["cutting"], "accepted", "We cut with femtosecond pulses.")
    assert got[1, "Fine cutting"][:3] == ("page", ["cutting"], "accepted") and got[2, "Model XR 200"][2] == "review" and got[2, "About us"][2] == "review"
    assert set(got) == {(1, "Fine cutting"), (1, "Cutting of tubes"), (2, "About us"), (2, "Model XR 200")}


def test_proposals_and_numbers(spark):
    words = spark.createDataFrame([(x,) for x in ["Cutting", "cuttings", "welding", "x", "123", "y" * 61]], "w string")
    assert [r.w for r in E.proposals(words, R.rule_table(spark, RULES), "w").collect()] == ["welding"]
    nums = [r.x for r in spark.createDataFrame([(x,) for x in ["1,50", "2.00", "300", "0,05", "10"]], "n string").select(E.number_text(F.col("n")).alias("x")).collect()]
    assert nums == ["1.5", "2", "300", "0.05", "10"]


def test_transition_log(spark):
    old, new = spark.createDataFrame([(1, "radar"), (2, "radar")], "k int, b string"), spark.createDataFrame([(1, "existing"), (2, "radar"), (3, "radar")], "k int, b string")
    assert [tuple(r) for r in X.transitions(old, new, ["k"], "b").collect()] == [(1, "radar", "existing")]


def test_measures_with_units(spark):
    rows = [("a", "u1", "pulses of 300 fs and 2,5 fs; feature size 5 µm ± 2 µm"), ("a", "u2", "holes of 0.8 um, 250 fs"), ("a", "u3", "up to 1500 mm, working area 400 mm"), ("b", "u4", "thickness 3 µm"), ("b", "u5", None)]
    got = {(r.g, r.measure): (r.value, r.url, r.implausible) for r in E.measures(spark.createDataFrame(rows, "g string, url string, t string"), "g", "url", "t").collect()}
    assert got == {("a", "pulse_fs"): (250.0, "u2", [2.5]), ("a", "tolerance_um"): (2.0, "u1", []), ("a", "feature_um"): (0.8, "u2", []), ("a", "part_mm"): (400.0, "u3", [1500.0])}
