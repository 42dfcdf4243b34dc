import gzip
import struct
import sys
import zlib
from pathlib import Path

import pyarrow as pa
import pytest

from methgrid import cli
from methgrid.operators import fastq as operators
from methgrid.operators import pileup
from methgrid.plans import pipelines
from methgrid.sources import alignments, fastq, sinks, tables
from methgrid.sources.lines import numbered_lines
from methgrid.streaming import sites as streaming


def text(path: Path, value: str) -> str:
    data = value.encode()
    path.write_bytes(gzip.compress(data) if path.suffix == ".gz" else data)
    return str(path)


def joined(folder) -> str:
    parts = sorted(Path(folder).rglob("part-*"))
    return "".join((gzip.open(p) if p.suffix == ".gz" else p.open("rb")).read().decode() for p in parts)


def test_numbered_lines_over_blocks(spark, tmp_path):
    path = text(tmp_path / "a.txt", "".join(f"line {k}\n" for k in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = numbered_lines(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in rows) == [(k, f"line {k}") for k in range(5000)]


@pytest.mark.parametrize("suffix", ["", ".gz"])
def test_fastq_round_trip(spark, tmp_path, suffix):
    body = "".join(f"@r{k} 1:N:0:A\nACGT{'A' * k}\n+\nIIII{'#' * k}\n" for k in range(30))
    reads = fastq.read_fastq(spark, text(tmp_path / f"a.fq{suffix}", body))
    assert [(r.ord, len(r.seq)) for r in reads.orderBy("ord").collect()] == [(k, 4 + k) for k in range(30)]
    fastq.write_fastq(reads, str(tmp_path / "out"))
    assert joined(tmp_path / "out") == body


SAM = "@HD\tVN:1.0\n" + "".join(
    f"r{k}\t{flag}\t{c}\t{pos}\t255\t4M\t{'=' if mate else '*'}\t{mate}\t0\tACGT\tIIII\tXO:Z:{xo}\tXM:Z:{xm}\n"
    for k, (flag, c, pos, mate, xo, xm) in enumerate([(0, "chr1", 5, 0, "+FW", "X--x"), (16, "chr1", 9, 0, "-FW", "x--X"), (0, "chr2", 5, 7, "+FW", "XXXX"), (4, "*", 0, 0, "+FW", "----")])
)


def bgzf(data: bytes) -> bytes:
    out = b""
    for at in range(0, len(data), 50):
        part = data[at : at + 50]
        body = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = body.compress(part) + body.flush()
        out += struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def bam(sam: str) -> bytes:
    names = ["chr1", "chr2"]
    out = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 2)
    for n in names:
        out += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 1000)
    for line in sam.splitlines()[1:]:
        f = line.split("\t")
        ref = names.index(f[2]) if f[2] in names else -1
        body = struct.pack("<iiBBHHHiiii", ref, int(f[3]) - 1, len(f[0]) + 1, 255, 0, 1, int(f[1]), 4, ref, int(f[7]) - 1, 0)
        body += f[0].encode() + b"\0" + struct.pack("<I", 4 << 4) + b"\x12\x48" + b"IIII"
        body += b"NMi" + struct.pack("<i", 3) + b"ZBBc" + struct.pack("<i", 2) + b"ab" + b"".join(t[:2].encode() + b"Z" + t[5:].encode() + b"\0" for t in f[11:])
        out += struct.pack("<i", len(body)) + body
    return bgzf(out)


def test_sam_and_bam_agree(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bam(SAM))
    one = alignments.read_sam(spark, text(tmp_path / "a.sam", SAM))
    two = alignments.read_bam(spark, str(tmp_path / "a.bam"))
    columns = ["chrom", "start", "mpos", "strand", "xm"]
    rows = lambda df: [tuple(r) for r in df.orderBy("ord").select(*columns).collect()]
    assert rows(one) == rows(two) == [("chr1", 4, -1, "+", "X--x"), ("chr1", 8, -1, "-", "x--X"), ("chr2", 4, 6, "+", "XXXX")]
    assert alignments.read_bam(spark, str(tmp_path / "a.bam"), chroms=["chr2"]).count() == 1
    assert {(r.chrom, r.pos, r.meth, r.total) for r in pileup.pileup(two).collect()} == {("chr1", 4, 1, 1), ("chr1", 7, 0, 1), ("chr1", 8, 0, 1), ("chr1", 5, 1, 1), ("chr2", 4, 1, 1), ("chr2", 5, 1, 1)}


@pytest.mark.parametrize("part_bytes", [700, 4000, 1 << 27])
def test_bam_in_parts(spark, tmp_path, part_bytes):
    """A file read in parts of any size has the alignments of the whole, also those that cross borders, in their order."""
    sam = "@HD\tVN:1.0\n" + "".join(f"r{k}\t0\t{'*' if k % 9 == 8 else 'chr2'}\t{k + 1}\t255\t4M\t=\t{k * 3}\t0\tACGT\tIIII\tXO:Z:+FW\tXM:Z:{'Xx.z' * (k % 60)}\n" for k in range(900))
    (tmp_path / "a.bam").write_bytes(bam(sam))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(part_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = alignments.read_bam(spark, str(tmp_path / "a.bam")).orderBy("ord").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(r.ord, r.chrom, r.start, r.mpos, r.xm) for r in rows] == [(k, "chr2", k, k * 3 - 1, "Xx.z" * (k % 60)) for k in range(900) if k % 9 != 8]


def test_bam_cut_short_raises(spark, tmp_path):
    (tmp_path / "a.bam").write_bytes(bgzf(b"BAM\1" + struct.pack("<iiI", 0, 0, 500) + b"x" * 9))
    with pytest.raises(Exception, match="ends inside"):
        alignments.read_bam(spark, str(tmp_path / "a.bam"))


def test_missing_tag_raises(spark, tmp_path):
    path = text(tmp_path / "a.sam", SAM.replace("\tXM:Z:X--x", ""))
    with pytest.raises(Exception, match="XM tag"):
        alignments.read_sam(spark, path).collect()


def test_intervals(spark, tmp_path):
    bed = text(tmp_path / "a.bed", "track name=x\nc\t1\t9\nc\t3\t5\tn\t0\n")
    assert [tuple(r)[:4] for r in tables.read_intervals(spark, bed).orderBy("ord").collect()] == [("c", 1, 9, ""), ("c", 3, 5, "n")]
    gtf = text(tmp_path / "a.gtf", 'c\ts\tgene\t2\t9\t.\t+\t.\tgene_id "g1"; gene_name "G"\n')
    assert tuple(tables.read_intervals(spark, gtf).first())[:4] == ("c", 1, 9, "G")


@pytest.fixture
def bench(tmp_path):
    for s in ("pm01", "pm02"):
        for c, gz in (("c", ".gz"), ("d", "")):
            body = f"track name={s}{c}\n" + "".join(f"{c}\t{a}\t{b}\t{n}\t0\t+\t0\t0\t0,0,0\n" for a, b, n in [(1, 2, "1.00-20"), (3, 4, "1.00-10"), (12, 22, "0.00-10"), (21, 22, "0.00-20"), (31, 32, "0.50-200")])
            text(tmp_path / f"{s}_{c}.bed{gz}", body)
    text(tmp_path / "samples.tsv", f"s1\t{tmp_path}/pm01_\n\ns2\t{tmp_path}/pm02_\n")
    text(tmp_path / "roi.bed", "d\t1\t100\tr1\nc\t1\t2\tr2\n")
    text(tmp_path / "info.yaml", "hg:\n  chroms:\n    c: 41\n    d: 25\n")
    return tmp_path


def test_commands(spark, bench, tmp_path):
    cli.main(["roi", f"{bench}/samples.tsv", f"{bench}/out", f"{bench}/roi.bed", "--min-cpgs", "1", "--raw-data", f"{bench}/raw"])
    assert joined(bench / "out") == "chrom\tstart\tend\tname\ts1\ts2\nd\t1\t100\tr1\t0.500\t0.500\nc\t1\t2\tr2\t1.000\t1.000\n"
    assert "d\t1\t100\tr1\t130\t260\t5\t130\t260\t5\n" in joined(bench / "raw")
    cli.main(["window", f"{bench}/samples.tsv", f"{bench}/win", "--genome", "hg", "--infoyaml", f"{bench}/info.yaml", "--window-size", "20", "--min-cpgs", "3"])
    assert joined(bench / "win") == "chrom\tstart\tend\tname\ts1\ts2\nc\t1\t20\t\t0.750\t0.750\nc\t21\t40\t\t0.435\t0.435\nd\t1\t20\t\t0.750\t0.750\nd\t21\t40\t\t0.435\t0.435\n"
    cli.main(["pm2dss", f"{bench}/pm01_", f"{bench}/x_"])
    assert joined(bench / "x_c.dss").startswith("chr\tpos\tN\tX\nc\t1\t20\t20\n")
    cli.main(["pm2bg", f"{bench}/pm01_", f"{bench}/x_", "--gz"])
    assert "c\t12\t13\t0.00\n" in joined(bench / "x_c.bg")
    cli.main(["pm_stats", f"{bench}/pm0", f"{bench}/stats.txt"])
    assert (bench / "stats.txt").read_text().splitlines()[1] == "1_c\t0.5\t130\t260\t5"
    text(bench / "sizes", "chr1\t10\nchr1_alt\t5\n")
    cli.main(["add_genome", "new", "f.fa", "idx", "--sizes", f"{bench}/sizes", "--infoyaml", f"{bench}/info.yaml", "--main"])
    assert tables.read_catalog(spark, f"{bench}/info.yaml")["new"]["chroms"] == {"chr1": 10}
    text(bench / "m.fq", "@a 1:N:0:\nACGT\n+\nIIII\n")
    cli.main(["motif", f"{bench}/m.fq", f"{bench}/motif.txt", "--seq", "AYG"])
    assert (bench / "motif.txt").read_text() == "Name\tAvg_Total\tAvg_CpG_1\tCpG_meth_1\tCpG_total_1\nm.fq\t1\t1\t1\t1\n"
    (bench / "a.bam").write_bytes(bam(SAM))
    text(bench / "hg.yaml", "hg:\n  chroms:\n    chr1: 100\n    chr3: 100\n")
    cli.main(["bam2pm", f"{bench}/a.bam", f"{bench}/pm/x", "--genome", "hg", "--infoyaml", f"{bench}/hg.yaml"])
    made = {p.name: joined(p) for p in (bench / "pm").iterdir() if p.is_dir()}
    assert set(made) == {"x_chr1.bed.gz", "x_chr3.bed.gz"}
    assert made["x_chr3.bed.gz"] == "track name=x_chr3 description=x_chr3 useScore=0 itemRgb=On db=hg\n"
    assert made["x_chr1.bed.gz"].splitlines()[1] == "chr1\t4\t5\t1.00-1\t0\t+\t0\t0\t210,27,27"
    text(bench / "cols1.txt", "h\t1\na\t5\n")
    cli.main(["adjustcols", f"{bench}/cols", f"{bench}/new", "--cols", "1", "--adjusts", "3"])
    assert joined(bench / "new1.txt") == "h\t1\na\t8\n"


def test_commands_chain(spark, tmp_path):
    """What bam2pm writes, the other commands read; chromosomes whose names begin alike stay apart."""
    (tmp_path / "a.bam").write_bytes(bam(SAM))
    text(tmp_path / "hg.yaml", "hg:\n  chroms:\n    chr1: 30\n    chr2: 30\n    chr11: 30\n")
    cli.main(["bam2pm", f"{tmp_path}/a.bam", f"{tmp_path}/s_", "--genome", "hg", "--infoyaml", f"{tmp_path}/hg.yaml"])
    text(tmp_path / "samples.tsv", f"s1\t{tmp_path}/s_\n")
    text(tmp_path / "roi.bed", "chr1\t0\t6\ta\nchr2\t0\t9\tb\nchr11\t0\t9\tc\n")
    cli.main(["roi", f"{tmp_path}/samples.tsv", f"{tmp_path}/roi", f"{tmp_path}/roi.bed", "--min-cpgs", "1"])
    assert joined(tmp_path / "roi") == "chrom\tstart\tend\tname\ts1\nchr1\t0\t6\ta\t1.000\nchr2\t0\t9\tb\t1.000\n"
    cli.main(["window", f"{tmp_path}/samples.tsv", f"{tmp_path}/win", "--genome", "hg", "--infoyaml", f"{tmp_path}/hg.yaml", "--window-size", "30", "--min-cpgs", "1"])
    assert joined(tmp_path / "win") == "chrom\tstart\tend\tname\ts1\nchr1\t1\t30\t\t0.500\nchr2\t1\t30\t\t1.000\n"
    cli.main(["pm2dss", f"{tmp_path}/s_", f"{tmp_path}/d_"])
    assert joined(tmp_path / "d_chr1.dss") == "chr\tpos\tN\tX\nchr1\t4\t1\t1\nchr1\t5\t1\t1\nchr1\t7\t1\t0\nchr1\t8\t1\t0\n"
    cli.main(["pm2bg", f"{tmp_path}/s_", f"{tmp_path}/d_"])
    assert joined(tmp_path / "d_chr2.bg") == "chr2\t4\t5\t1.00\nchr2\t5\t6\t1.00\n" and "chr1" not in joined(tmp_path / "d_chr11.bg")
    cli.main(["pm_stats", f"{tmp_path}/s_", f"{tmp_path}/stats.txt"])
    assert (tmp_path / "stats.txt").read_text().splitlines()[1:] == ["chr1\t0.5\t2\t4\t4", "chr2\t1\t2\t2\t2"]


def test_pipeline_with_an_aligner(spark, tmp_path):
    path = text(tmp_path / "a.fq", "".join(f"@r{k} 1:N:0:\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for k in range(4)))

    def align(reads):
        from pyspark.sql import functions as F

        return reads.select("ord", F.lit("chrM").alias("chrom"), (F.col("ord") * 10).alias("start"), F.lit(-1).cast("long").alias("mpos"), F.lit("+").alias("strand"), F.lit("Xx").alias("xm"))

    run = pipelines.process_se(spark, path, align)
    assert run.sites.count() == 8
    assert tuple(run.conversion.first()) == (0.5, 4, 8, 8)
    pair = pipelines.process_pe(spark, path, path, align)
    assert pair.trimmed.count() == 4 and pair.sites.count() == 8


ALIGNER = """
import sys
lines = sys.stdin.read().split("\\n")
print("@HD")
for k in range(0, len(lines) - 3, 4):
    name = lines[k].split()[0][1:]
    print("\\t".join([name, "0", "chrM", str(int(name[1:]) * 10 + 1), "255", "2M", "*", "0", "0", "AC", "II", "XO:Z:+FW", "XM:Z:Xx"]))
"""


@pytest.mark.parametrize("piped", [True, False])
def test_process_with_a_program(spark, tmp_path, piped):
    """Sites, conversion and, where the program writes a log, the summary of both runs."""
    text(tmp_path / "a.fq", "".join(f"@r{k} 1:N:0:\n{'ACGT' * 20}\n+\n{'I' * 80}\n" for k in range(4)))
    text(tmp_path / "align.py", ALIGNER)
    stamped = ["Read filename: x", "Mappability = 41.5%", "Total bases of uniquely mapped reads :     240", " mCG  50.0%", " mCHG  1.0%", " mCHH  2.0%"]
    text(tmp_path / "log", "".join(f"[2020-01-01 00:00:00] {line}\n" for line in stamped))
    text(tmp_path / "hg.yaml", "hg:\n  chroms:\n    chrM: 100\n")
    command = f"{sys.executable} {tmp_path}/align.py"
    if not piped:
        command += f" < {{fastq}} > {{sam}}; cp {tmp_path}/log {{log}}"
    cli.main(["process_se", f"{tmp_path}/a.fq", f"{tmp_path}/out", "--genome", "hg", "--infoyaml", f"{tmp_path}/hg.yaml", "--aligner", command, "--shared", str(tmp_path)])
    assert joined(tmp_path / "out_chrM.bed.gz").count("\n") == 9
    assert (tmp_path / "out_conv.txt").read_text() == "conv_eff\tmeth\ttotal\tcpg_count\n0.5\t4\t8\t8\n"
    assert (tmp_path / "out_summary.txt").exists() != piped
    if not piped:
        heads, runs, row = (tmp_path / "out_summary.txt").read_text().splitlines()
        assert heads.endswith("mCHH\t\tconv_eff\tmeth\ttotal\tcpg_count") and runs == "\t".join(["noadap", "trimmed"] * 5)
        assert row == "240\t240\t41.5%\t41.5%\t50.0%\t50.0%\t1.0%\t1.0%\t2.0%\t2.0%\t0.5\t4\t8\t8"


def test_piped_aligner_that_fails(spark, tmp_path):
    path = text(tmp_path / "a.fq", "@r0 1:N:0:\nACGT\n+\nIIII\n")
    with pytest.raises(Exception, match="the aligner ended with 3"):
        pipelines.piped_aligner(spark, "cat > /dev/null; exit 3")(fastq.read_fastq(spark, path))


def test_streamed_stats(spark, tmp_path):
    schema = "sample string, chrom string, start long, end long, perc string, total long"
    spark.createDataFrame([("s", "c", 1, 2, "0.50", 10)], schema).write.parquet(str(tmp_path / "in"))
    for name in ("one", "two"):
        query = streaming.running_stats(streaming.watch_sites(spark, str(tmp_path / "in")), name, str(tmp_path / "state"))
        query.awaitTermination()
        if name == "one":
            assert tuple(spark.table("one").first()) == ("s", 0.5, 5, 10, 1)
            spark.createDataFrame([("s", "c", 5, 6, "1.00", 10)], schema).write.mode("append").parquet(str(tmp_path / "in"))
            break


def fastq_rows(spark, rows):
    return spark.createDataFrame([(k, f"@r{k} 1:N:0:A", x, "+", "I" * len(x)) for k, x in rows], "ord long, header string, seq string, third string, qual string")


def test_trim_pefq_pairs_folders_of_other_parts(spark, tmp_path):
    """Both folders have several parts, cut at other places: reads are paired by their number in the folder."""
    adapter = "AGATCGGAAG"
    forward = [(k, "A" * (50 + k) + adapter) for k in range(40)]
    reverse = [(k, "C" * 120) for k in range(40)]
    for name, rows, parts in (("f", forward, "3"), ("r", reverse, "5")):
        old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            fastq.write_fastq(fastq_rows(spark, rows), str(tmp_path / name))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", old[0])
            spark.conf.set("spark.sql.adaptive.enabled", old[1])
        assert len(list((tmp_path / name).glob("part-*"))) > 1
    assert sorted((r.src.rpartition("/")[2], r.ord) for r in fastq.read_fastq(spark, str(tmp_path / "f")).collect()) == [("f", k) for k in range(40)]
    cli.main(["trim_pefq", str(tmp_path / "f"), str(tmp_path / "r"), str(tmp_path / "out")])
    got = joined(tmp_path / "out_rev" / "route=trimmed").splitlines()
    assert [(h, len(x)) for h, x in zip(got[::4], got[1::4], strict=True)] == [(f"@r{k} 1:N:0:A", 40 + k) for k in range(40)]


def test_command_trim_pefq_writes_in_several_tasks(spark, monkeypatch):
    from methgrid.plans import file_queries, queries

    seen = []
    monkeypatch.setattr(file_queries, "command", lambda spark, name, *argv: seen.extend(argv))
    monkeypatch.setattr(file_queries.fastq_files, "read_fastq", lambda *_: spark.createDataFrame([], "header string, seq string, qual string"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        queries.QUERIES["command_trim_pefq"](spark, "/root/testdata/sf0.001")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert all(len(list(Path(x.removeprefix("file:")).glob("part-*"))) > 1 for x in seen[:2])


def test_fastq_records_over_blocks(spark, tmp_path):
    """Records that begin in one block and end in the next, an unfinished last one; lines are dealt to no other task, records over a border aside."""
    body = "".join(f"@r{k}\nACGT{'A' * (k % 50)}\n+\nIIII{'#' * (k % 50)}\n" for k in range(3000))
    path = text(tmp_path / "a.fq", body + "@last\nAC\n")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    for k, x in zip(old, ("7001", "-1", "7"), strict=True):
        spark.conf.set(k, x)
    try:
        reads = fastq.read_fastq(spark, path)
        plan = reads._jdf.queryExecution().executedPlan().toString()
        rows = reads.collect()
    finally:
        for k, x in old.items():
            spark.conf.set(k, x)
    assert "SortMergeJoin" not in plan
    assert sorted((r.ord, r.header, len(r.seq), r.third, len(r.qual)) for r in rows) == [(k, f"@r{k}", 4 + k % 50, "+", 4 + k % 50) for k in range(3000)]


def test_fold_refuses_lines_out_of_order():
    batch = lambda *lines: pa.RecordBatch.from_pydict({"src": ["f"] * len(lines), "line": list(lines), "value": [str(x) for x in lines]})
    assert [tuple(r.values()) for b in fastq.fold([batch(4, 5), batch(6, 7, 12), batch(13, 14, 15)]) for r in b.to_pylist()] == [("f", 1, "4", "5", "6", "7"), ("f", 3, "12", "13", "14", "15")]
    for lines in ((4, 5, 7, 6), (5, 6, 7, 8), (4, 5, 6)):
        with pytest.raises(ValueError):
            list(fastq.fold([batch(*lines)]))


def test_trim_sefq_keeps_the_order(spark, tmp_path):
    """Every route in the order of the file, though routes alternate; the filter deals no reads by file."""
    adapter = "AGATCGGAAG"
    body = "".join(f"@r{k} 1:N:0:A\n{'A' * 60 + (adapter if k % 3 else 'C' * 10)}\n+\n{'I' * 70}\n" for k in range(4000))
    path = text(tmp_path / "a.fq", body)
    cli.main(["trim_sefq", path, str(tmp_path / "out")])
    for route, own in (("trimmed", [k for k in range(4000) if k % 3]), ("noadap", range(0, 4000, 3))):
        assert joined(tmp_path / "out" / f"route={route}").splitlines()[::4] == [f"@r{k} 1:N:0:A" for k in own]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = operators.quality_filter(fastq.read_fastq(spark, path))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "MapInArrow" in plan
