import pytest

from methgrid.functions.iupac import IUPAC, motif_pattern, offsets_of
from methgrid.operators import fastq, motif

ADAPTER = "AGATCGGAAG"
FIELDS = "src string, ord long, header string, seq string, third string, qual string"


def reads(spark, *rows, src="a"):
    return spark.createDataFrame([(src, k, h, s, "+", q if q is not None else "I" * len(s)) for k, (h, s, q) in enumerate(rows)], FIELDS)


def read(seq, flag="N", qual=None):
    return (f"@r 1:{flag}:0:A", seq, qual)


def test_quality_filter_keeps_passed(spark):
    df = reads(spark, read("A", "Y"), read("C", "Y"), read("G"), read("T"))
    assert sorted(r.seq for r in fastq.quality_filter(df).collect()) == ["G", "T"]


def test_quality_filter_without_flags(spark):
    df = reads(spark, ("@r", "A", None), ("@s", "C", None))
    assert fastq.quality_filter(df).count() == 2
    assert fastq.quality_filter(df, strict_compat=True).count() == 0


def test_quality_filter_reads_stay_where_they_are(spark):
    """Few files: no task gets all reads of one; null and repeated numbers and headers say what they did."""
    rows = [("a", 1, "@r"), ("a", 0, None), ("a", 2, "@r 1:N:0:A"), ("b", 5, "@r 1:Y:0:A"), ("b", 6, "@r"), (None, 3, "@r"), (None, 4, "@r 1:Y:0:A"), ("c", None, "@r 1:N:0:A")]
    df = spark.createDataFrame([(s, k, h, "A", "+", "I") for s, k, h in rows], FIELDS)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = fastq.quality_filter(df)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortAggregate" not in plan and "SortMergeJoin" not in plan
    # a's first header is missing, so it only keeps what passed; the file without a name has no flag at first
    assert sorted((r.src or "", r.ord or 0) for r in kept.collect()) == [("", 3), ("", 4), ("a", 2), ("c", 0)]


def test_trim_se_routes(spark):
    df = reads(spark, read("A" * 100), read("A" * 5 + ADAPTER + "C" * 85), read("A" * 61 + ADAPTER + "C" * 29), read("C" * 8), read("A" * 45 + ADAPTER), read("A" * 44 + ADAPTER))
    got = {r.ord: (r.route, len(r.seq), len(r.qual)) for r in fastq.trim_se(df).collect()}
    # the last is one base short; without the adapter no length is asked for
    assert got == {0: ("noadap", 90, 90), 2: ("trimmed", 51, 51), 3: ("noadap", 0, 0), 4: ("trimmed", 35, 35)}


def test_trim_se_chew_zero(spark):
    df = reads(spark, read("A" * 50))
    assert len(fastq.trim_se(df, chew=0).first().seq) == 50
    assert fastq.trim_se(df, chew=0, strict_compat=True).first().seq == ""


def test_trim_se_longer_quality(spark):
    assert len(fastq.trim_se(reads(spark, read("A" * 50, qual="I" * 60))).first().qual) == 50


def test_trim_pe(spark):
    f = reads(spark, read("A" * 100), read("A" * 100, "Y"), read("A" * 70 + ADAPTER), read("A" * 100), read("A" * 60))
    r = reads(spark, read("C" * 90), read("C" * 100), read("C" * 50 + ADAPTER), read("C" * 40 + ADAPTER), read("C" * 70 + ADAPTER))
    got = {x.ord: (x.route, len(x.f_seq), len(x.r_seq), len(x.f_qual), len(x.r_qual)) for x in fastq.trim_pe(f, r).collect()}
    # 0: the shorter reverse read looks like a cut; 3: cut at 40, too short; 4: the reverse adapter lies beyond the forward read's end
    assert got == {0: ("trimmed", 80, 80, 80, 80), 2: ("trimmed", 40, 40, 40, 40), 4: ("noadap", 50, 70, 50, 70)}


def test_iupac_codes():
    assert "".join(map(motif_pattern, "ACGTRYSWKMBDHVN")) == "".join(IUPAC.values())
    assert motif_pattern("cgy") == "CG[CT]"
    assert offsets_of("aYCy", "Y") == [1, 3]
    with pytest.raises(KeyError):
        motif_pattern("AX")


def test_motif_summary(spark):
    # leftmost match only; a read without the motif counts nowhere
    df = reads(spark, read("GGACGATGACGATG"), read("ATGATG"), read("ACGACGTT"), read("TTTT"), read("acgacg"))
    row = motif.motif_summary(df, "AYGAYG").first()
    assert (row.meth_1, row.total_1, row.meth_2, row.total_2) == (2, 3, 1, 3)
    assert row.avg_total == pytest.approx((2 / 3 + 1 / 3) / 2)
    assert motif.motif_summary(df.filter("seq = 'TTTT'"), "AYG").first().avg_total is None
