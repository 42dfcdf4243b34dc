import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from methgrid.operators import convert, intervals, logs, regions, tabular

SITES = "sample string, chrom string, start long, end long, perc string, total long"
ONE = [("c", 1, 2, "1.00", 20), ("c", 3, 4, "1.00", 10), ("c", 12, 22, "0.00", 10), ("c", 21, 22, "0.00", 20), ("c", 31, 32, "0.50", 200)]


def sites(spark, rows=ONE, samples=("s1", "s2")):
    return spark.createDataFrame([(s, *r) for s in samples for r in rows], SITES)


def areas(spark, *rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "chrom string, start long, end long, name string, ord long")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_region_table(spark):
    rois = areas(spark, ("c", 1, 100, "r1"), ("c", 101, 1000, "r2"))
    assert rows_of(regions.roi_meth(sites(spark), rois, ["s1", "s2"], min_cpgs=1)) == [("c", 1, 100, "r1", 0.5, 0.5)]
    assert rows_of(regions.roi_meth(sites(spark), rois, ["s1", "s2"], min_cpgs=1, raw=True)) == [("c", 1, 100, "r1", 130, 260, 5, 130, 260, 5)]
    masked = areas(spark, ("c", 1, 2, ""))
    assert rows_of(regions.roi_meth(sites(spark), rois, ["s1", "s2"], masked, min_cpgs=1, raw=True))[0][4:7] == (110, 240, 4)


def test_gates_and_partial_samples(spark):
    df = sites(spark, samples=("s1",)).unionByName(sites(spark, ONE[:1], ("s2",)))
    rois = areas(spark, ("c", 1, 100, "r"))
    both = ["s1", "s2"]
    assert rows_of(regions.roi_meth(df, rois, both, min_cpgs=2)) == []
    assert rows_of(regions.roi_meth(df, rois, both, min_cpgs=2, min_samples=1)) == [("c", 1, 100, "r", 0.5, None)]
    assert rows_of(regions.roi_meth(df, rois, both, min_cpgs=2, min_samples=1, raw=True)) == [("c", 1, 100, "r", 130, 260, 5, 20, 20, 1)]
    assert rows_of(regions.roi_meth(df, rois, both, min_reads=21, min_cpgs=1, min_samples=1))[0][4:] == (0.5, None)


def test_same_interval_last_name_and_missing_chrom(spark):
    df = sites(spark).unionByName(spark.createDataFrame([("s1", "d", 1, 2, "1.00", 5)], SITES))
    rois = areas(spark, ("d", 1, 9, "x"), ("c", 1, 100, "old"), ("c", 1, 100, "new"))
    assert [r[3] for r in rows_of(regions.roi_meth(df, rois, ["s1", "s2"], min_cpgs=1))] == ["new"]
    files = spark.createDataFrame([(s, c) for s in ("s1", "s2") for c in ("c", "d")], "sample string, chrom string")
    got = rows_of(regions.roi_meth(df, rois, ["s1", "s2"], files=files, min_cpgs=1, min_samples=1))
    assert [(r[0], r[3], r[4], r[5]) for r in got] == [("d", "x", 1.0, None), ("c", "new", 0.5, 0.5)]


def test_windows(spark):
    chroms = spark.createDataFrame([("c", 41, 0)], "chrom string, length long, ord long")
    got = rows_of(regions.window_meth(sites(spark), chroms, ["s1", "s2"], 10, areas(spark, ("c", 1, 2, "")), min_cpgs=1))
    assert [(r[1], r[2], r[4]) for r in got] == [(1, 10, 1.0), (11, 20, 0.0), (21, 30, 0.0), (31, 40, 0.5)]
    assert [(r.start, r.end) for r in regions.windows(chroms, 20).collect()] == [(1, 20), (21, 40)]
    assert [(r.start, r.end) for r in regions.windows(chroms, 20, gapless=True).collect()] == [(0, 20), (20, 40), (40, 60)]


@pytest.mark.parametrize("gapless", [False, True])
@pytest.mark.parametrize("size", [2, 3, 7, 10])
def test_window_places_equal_the_join(spark, size, gapless):
    rng = random.Random(size)
    rows = [("c", s := rng.randrange(60), s + rng.randrange(1, 25), "0.50", rng.randrange(1, 9)) for _ in range(80)]
    df = sites(spark, rows, ("s1",))
    chroms = spark.createDataFrame([("c", 50, 0)], "chrom string, length long, ord long")
    want = regions.region_counts(df, regions.windows(chroms, size, gapless), ["s1"])
    assert sorted(rows_of(regions.window_counts(df, chroms, size, ["s1"], gapless))) == sorted(rows_of(want))


spans = st.lists(st.tuples(st.sampled_from("cd"), st.integers(0, 60), st.integers(1, 30)), min_size=0, max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(a=spans, b=spans, width=st.sampled_from([1, 5, 16]))
def test_overlaps_equal_the_plain_join(spark, a, b, width):
    schema = "chrom string, start long, end long, k long"
    left, right = ([(c, s, s + n, k) for k, (c, s, n) in enumerate(x)] for x in (a, b))
    hits = sorted((x[3], y[3]) for x in left for y in right if x[0] == y[0] and x[1] < y[2] and x[2] > y[1])
    one, two = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    assert sorted((r.k, r.r_k) for r in intervals.overlap_join(one, two, width).collect()) == hits
    inside = sorted({x for x, _ in hits})
    assert sorted(r.k for r in intervals.sites_in(one, two, width).collect()) == inside
    assert sorted(r.k for r in intervals.mask(one, two, width).collect()) == sorted({x[3] for x in left} - set(inside))
    assert intervals.mask(one, None) is one


def test_bins_follow_the_lengths(spark):
    """Few more pairs are compared than overlap, and few more bins made than intervals, for narrow regions as for wide ones; results equal the plain join, a huge interval among narrow ones too."""
    points = spark.range(0, 3000).selectExpr("'c' AS chrom", "id * 7 AS start", "id * 7 + 1 AS end")
    for length, step in ((100, 25), (5000, 2500)):
        many = spark.range(0, 400).selectExpr("'c' AS chrom", f"id * {step} AS start", f"id * {step} + {length} AS end")
        width = intervals.mean_length(many)
        a, b = intervals.binned(points, width), intervals.binned(many, width)
        assert b.count() <= 3 * 400
        assert a.join(b, ["chrom", "__bin"]).count() <= 3 * intervals.overlap_join(points, many).count()
    rows = [("c", 50 * k, 50 * k + 3 + k % 9, k) for k in range(60)] + [("c", 100, 900_000, 60), ("d", 0, 4, 61)]
    some = spark.createDataFrame(rows, "chrom string, start long, end long, k long")
    want = sorted((p, k) for c, s, e, k in rows for p in range(0, 21000, 7) if c == "c" and s < p + 1 and e > p)
    assert sorted((r.start, r.r_k) for r in intervals.overlap_join(points, some).collect()) == want
    inside = {p for p, _ in want}
    assert sorted(r.start for r in intervals.sites_in(points, some).collect()) == sorted(inside)
    assert sorted(r.start for r in intervals.mask(points, some).collect()) == sorted(set(range(0, 21000, 7)) - inside)
    assert intervals.overlap_join(points, some.limit(0)).count() == 0


def test_table_of_all_samples_reads_the_sites_once(spark):
    df = spark.range(0, 60).selectExpr("concat('s', id % 2 + 1) AS sample", "IF(id < 50, 'c', 'd') AS chrom", "id AS start", "id + 1 AS end", "'1.00' AS perc", "id AS total").filter("chrom = 'c' OR sample = 's1'")
    rois = areas(spark, ("c", 0, 40, "x"), ("d", 50, 60, "y"))
    for need in (-1, 2, 1):
        table = regions.roi_meth(df, rois, ["s1", "s2"], min_cpgs=1, min_samples=need)
        assert need == 1 or table._jdf.queryExecution().executedPlan().toString().count("Range (") == 1
        assert [r[3] for r in rows_of(table)] == ["x"]
    # a sample that isn't asked for says nothing about a chromosome
    more = df.unionByName(df.filter("sample = 's1'").withColumn("sample", F.lit("s3")))
    assert [r[3] for r in rows_of(regions.roi_meth(more, rois, ["s1", "s2"], min_cpgs=1, min_samples=1))] == ["x"]


def test_lossy_counts_and_forms(spark):
    df = sites(spark, [("c", 1, 2, f"{50 / 101:.2f}", 101)], ("s",))
    assert regions.parse_counts(df).first().meth == 51
    dss = {(r.pos, r.N, r.X) for r in convert.to_dss(sites(spark, samples=("s",))).collect()}
    assert dss == {(1, 20, 20), (3, 10, 10), (12, 10, 0), (21, 20, 0), (31, 200, 100)}
    assert ("c", 12, 13, "0.00") in rows_of(convert.to_bedgraph(sites(spark, samples=("s",))))
    assert rows_of(convert.stats(sites(spark, samples=("s",)))) == [(0.5, 130, 260, 5)]
    assert rows_of(convert.stats(df.limit(0))) == [(None, 0, 0, 0)]
    assert rows_of(convert.conversion_efficiency(sites(spark, samples=("s",)), "c")) == [(0.5, 130, 260, 5)]


def test_log_summary(spark):
    side = lambda n: spark.createDataFrame([(x,) for x in ("t Read filename : x a.fq", "[2] Mappability = 1 40%", f"Total bases of uniquely mapped reads x y z {n}", " mCG a b 1.5%", " mCHG a b 2.5%", "noise")], "value string")
    row = logs.summarize_logs(side(7), side(8), spark.createDataFrame([(0.9,)], "conv_eff double")).first()
    assert (row.bases_noadap, row.bases_trimmed, row.mcg_noadap, row.mchg_trimmed, row.mchh_noadap, row.conv_eff) == ("7", "8", "1.5%", "2.5%", None, 0.9)


def test_adjust_columns(spark):
    df = spark.createDataFrame([("h\t1\t2",), ("c\t1\t2\t3",), ("c\t1",)], "value string")
    got = [r.value for r in tabular.adjust_columns(df, [1, 3], [10, -1], df["value"].startswith("h")).collect()]
    assert got == ["h\t1\t2", "c\t11\t2\t2", "c\t11"]
    with pytest.raises(ValueError):
        tabular.adjust_columns(df, [1], [1, 2])
