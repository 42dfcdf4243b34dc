import pytest

from methgrid.operators import pileup

FIELDS = "ord long, chrom string, start long, mpos long, strand string, xm string"


def aligned(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], FIELDS)


def sites(df):
    return {(r.chrom, r.pos): (r.meth, r.total) for r in df.collect()}


def test_both_strands_and_directions(spark):
    df = aligned(spark, ("chr1", 10, -1, "+", "X-x"), ("chr1", 14, -1, "-", "X-X"), ("chr2", 10, -1, "+", "zYX"))
    assert sites(pileup.pileup(df)) == {("chr1", 10): (1, 1), ("chr1", 12): (1, 2), ("chr1", 14): (1, 1), ("chr2", 12): (1, 1)}


@pytest.mark.parametrize(("context", "want"), [("C", {0, 1, 2, 3}), ("CG", {3}), ("CH", {0, 1, 2}), ("CHG", {1}), ("CHH", {0, 2})])
def test_contexts(spark, context, want):
    assert {p for _, p in sites(pileup.pileup(aligned(spark, ("c", 0, -1, "+", "zYZx.-")), context))} == want


def test_strand_filter_comes_before_duplicates(spark):
    # the minus read between breaks the run only if both strands are read
    df = aligned(spark, ("c", 5, -1, "+", "X"), ("c", 5, -1, "-", "X"), ("c", 5, -1, "+", "x"))
    assert sites(pileup.pileup(df)) == {("c", 5): (2, 3)}
    assert sites(pileup.pileup(df, strand="positive")) == {("c", 5): (1, 1)}


@pytest.mark.parametrize(("max_dup", "kept"), [(1, [0, 3, 4]), (2, [0, 1, 3, 4]), (3, [0, 1, 2, 3, 4])])
def test_runs(spark, max_dup, kept):
    df = aligned(spark, ("c", 5, -1, "+", "X"), ("c", 5, -1, "+", "X"), ("c", 5, -1, "+", "X"), ("c", 5, 9, "+", "X"), ("c", 5, -1, "+", "X"))
    for spread in (False, True):
        assert sorted(r.ord for r in pileup.dedup_runs(df, max_dup, spread).collect()) == kept


def test_mate_truncation(spark):
    df = aligned(spark, ("c", 10, 12, "+", "XXXX"), ("c", 12, 10, "+", "XX"))
    assert sites(pileup.pileup(df)) == {("c", 10): (1, 1), ("c", 11): (1, 1), ("c", 12): (1, 1), ("c", 13): (1, 1)}


def test_arguments(spark):
    for bad in (("CC", "both"), ("CG", "plus")):
        with pytest.raises(ValueError):
            pileup.pileup(aligned(spark, ("c", 1, -1, "+", "X")), *bad)


def test_render_colours_and_rounding(spark):
    df = spark.createDataFrame([("c", 1, 0, 1), ("c", 2, 1, 3), ("c", 3, 4, 5), ("c", 4, 1, 1), ("c", 5, 3, 5), ("c", 6, 1, 8), ("c", 7, 3, 200)], "chrom string, pos long, meth long, total long")
    got = {r.start: (r.name, r.rgb, r.end) for r in pileup.render(df).collect()}
    assert got[1] == ("0.00-1", "0,0,0", 2)
    assert got[2][:2] == ("0.33-3", "27,74,210") and got[3][:2] == ("0.80-5", "27,210,57") and got[4][:2] == ("1.00-1", "210,27,27") and got[5][:2] == ("0.60-5", "27,74,210")
    assert got[6][0] == f"{1 / 8:.2f}-8" and got[7][0] == f"{3 / 200:.2f}-200"


def test_two_decimals_as_printf(spark):
    pairs = [(m, t) for t in range(1, 121) for m in range(t + 1)]
    df = spark.createDataFrame([("c", k, m, t) for k, (m, t) in enumerate(pairs)], "chrom string, pos long, meth long, total long")
    assert all(r.name == f"{pairs[r.start][0] / pairs[r.start][1]:.2f}-{pairs[r.start][1]}" for r in pileup.render(df).collect())


def test_runs_over_blocks(spark):
    """Runs that span one border, several blocks, or end at a border; chromosomes that share blocks; both directions of starts."""
    import random

    r = random.Random(4)
    rows, n = [], 0
    for chrom in ("a", "b"):
        while n < (150 if chrom == "a" else 330):
            start, strand, mpos = r.randrange(3), r.choice("+-"), r.choice([-1, 5, None])
            for _ in range(r.choice([1, 1, 2, 3, 25])):
                rows.append((chrom, start, mpos, strand, "X", n))
                n += r.choice([1, 1, 2])
    reads = spark.createDataFrame(rows, "chrom string, start long, mpos long, strand string, xm string, ord long").repartition(5)
    for max_dup in (1, 2, 9):
        want, run = [], {}
        for row in rows:
            key, (last, k) = row[1:4], run.get(row[0], (None, 0))
            run[row[0]] = (key, k + 1 if key == last else 1)
            if run[row[0]][1] <= max_dup:
                want.append(row[5])
        for block_rows in (1, 3, 10, 64, 1000):
            assert sorted(x.ord for x in pileup.dedup_runs(reads, max_dup, block_rows=block_rows).collect()) == want
