import hashlib
import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import scoring as S, text as T
from orrery.functions.vectors import l2_normalize, mean_vector, require_unit


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_white_space_is_unicode(spark):
    assert one(spark, T.clean(F.col("t")), t="  a b\t") == "a b"
    assert one(spark, T.clean(F.col("t")), t="  ") == ""
    assert one(spark, T.clean(F.col("t").cast("string")), t=None) is None
    assert one(spark, T.normalize(F.col("t").cast("string")), t=None) == ""
    assert one(spark, T.normalize(F.col("t")), t=" A  b\n\nC ") == "A b C"


def test_truncation_stays_near_the_limit(spark):
    cut = one(spark, T.truncate(F.col("t"), 80), t="word " * 100)
    assert len(cut) <= 82 and cut.endswith("word …")
    assert one(spark, T.truncate(F.col("t"), 5), t="abcdefgh") == "abcde …"
    assert one(spark, T.truncate(F.col("t"), 9), t="abc, - def ghi") == "abc …"
    assert one(spark, T.truncate(F.col("t"), 9), t="short") == "short"


def test_stable_ids(spark):
    a, b = (one(spark, T.stable_id(F.col("t")), t=t) for t in ("Straße  C++", "STRASSE c++"))
    assert a == b and a.startswith("software:strasse-c:")
    assert one(spark, T.stable_id(F.col("t")), t="日本").startswith("software:software:")
    assert one(spark, T.stable_id(F.col("t")), t=" Microsoft  Excel ") == "software:microsoft-excel:" + hashlib.sha256(b"microsoft excel").hexdigest()[:10]
    assert one(spark, T.stable_id(F.col("t")), t="C") != one(spark, T.stable_id(F.col("t")), t="C#")


def test_lines_of_evidence(spark):
    line = lambda c, **row: one(spark, c, **row)
    day, none = F.lit("2021-03-04").cast("date"), F.lit(None).cast("date")
    assert line(T.job_line(F.col("t"), day, none, F.lit(" built  it ")), t="Lead  dev") == "Role: Lead dev. Dates: 2021-03-04 to present. Evidence: built it"
    assert line(T.project_line(F.col("t"), none, F.lit("x")), t="P") == "Project: P. Completed: unknown. Evidence: x"
    assert line(T.course_line(F.col("t"), day), t="C") == "Course: C. Completed: 2021-03-04."
    assert line(T.claim_line(F.col("t"), F.lit(3.0)), t="S") == "Claimed skill: S; level: 3." and line(T.claim_line(F.col("t"), F.lit(None)), t="S").endswith("level: unknown.")


def test_dates(spark):
    assert one(spark, T.date_label(T.month_year(F.col("t"))), t="07/2021") == "2021-07-01"
    assert one(spark, T.date_label(T.month_year(F.col("t"))), t="13/2021") == "unknown"


def test_surface_names(spark):
    low, high = [F.lit(0.0)] * 4, [F.lit(0.99)] * 4
    name = lambda t, d: tuple(spark.range(1).select(*T.surface_name(F.lit(t), d)).first())
    assert name("Microsoft Excel", low) == ("Excel", "manual_synonym")
    assert name("Microsoft Project", low) == ("Project", "vendor_shortened")
    assert name("Tools and Dies", [F.lit(0.9), F.lit(0.9), F.lit(0.9), F.lit(0.0)]) == ("Tools & Dies", "symbol_variant")
    assert name("SAP ERP", low) == ("sap erp", "case_variant")
    assert name("SAP ERP", high) == ("SAP ERP", "canonical")


def test_reliability_and_weights(spark):
    r = lambda source, age, n: one(spark, S.reliability(F.lit(source), F.lit(age).cast("int"), F.lit(n)))
    assert r("resume", None, 1) == 0.9 and r("resume", 5, 0) == 0.0
    assert r("courses", 2190, 3) == round(0.72 / math.e, 4)
    assert r("self_reported_skills", 0, 100) == round(0.65 / (1 + 0.35 * math.log1p(70)), 4)
    w = lambda a, b: one(spark, S.sample_weight(F.lit(a), F.lit(b)))
    assert w(1.0, 5.0) == 1.0 and w(0.0, 1.0) == pytest.approx(0.1) and w(0.5, 3.0) == pytest.approx(0.53)


def test_relevance(spark):
    x = lambda i, lvl, hot, dem, nope, soft: one(spark, S.relevance(*(F.lit(v).cast(t) for v, t in ((i, "double"), (lvl, "double"), (hot, "boolean"), (dem, "boolean"), (nope, "boolean"))), F.lit(soft)))
    assert x(5.0, 7.0, None, None, None, False) == 1.0 and x(None, None, None, None, None, False) == 0.03
    assert x(5.0, 7.0, None, None, True, False) == 0.03 and x(None, None, True, None, False, True) == pytest.approx(0.62)


def test_golden_split_shares(spark):
    got = dict(spark.range(10_000).groupBy(S.golden_split(F.col("id")).alias("s")).count().collect())
    assert got == {"train": 8001, "validation": 1000, "test": 999}


def test_vectors(spark):
    assert one(spark, l2_normalize(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert one(spark, l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]
    bad = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    with pytest.raises(Exception, match="not zero"):
        require_unit(bad, "v").collect()
    rows = spark.createDataFrame([("a", [1.0, 0.0], 1.0), ("a", [0.0, 1.0], 3.0), ("b", [1.0, 1.0], 0.0), ("b", [0.0, 0.0], 0.0)], "k string, v array<double>, w double")
    got = {r["k"]: r["v"] for r in mean_vector(rows, ["k"], "v", F.col("w")).collect()}
    assert got == {"a": [0.25, 0.75], "b": [0.5, 0.5]}
