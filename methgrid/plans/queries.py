"""One query for each operator over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methgrid.functions.iupac import IUPAC, motif_pattern
from methgrid.operators import convert, fastq, genome, intervals, logs, motif, pileup, regions, tabular
from methgrid.plans.views import SAMPLES, WINDOW, ctes, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MOTIF = "TTYGTGGTGYGTYGTTTTTTAAKTYGGTT"


def query(oracle: str | None = None, *needs: str):
    """Registers a query under its function's name; ``needs`` are the views of its SQL."""

    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: view(spark, sf_dir, name))
        if oracle is not None:
            ORACLES[f.__name__] = f"{ctes(*needs)} {oracle}" if needs else oracle
        return f

    return add


# --- reads as they come from the sequencer

PASSED_SQL = r"regexp_matches(header, '^@.* [^:]*:N:[^:]*:')"


@query(f"SELECT ord, src, header, seq, qual FROM fastq WHERE {PASSED_SQL}", "fastq")
def fastq_quality_filter(v):
    return fastq.quality_filter(v("fastq")).select("ord", "src", "header", "seq", "qual")


@query("SELECT ord, substr(seq, 1, greatest(length(seq) - 10, 0)) AS seq, substr(qual, 1, greatest(length(qual) - 10, 0)) AS qual FROM fastq WHERE strpos(seq, 'AGATCGGAAG') = 0", "fastq")
def fastq_trim_se_noadap(v):
    return fastq.trim_se(v("fastq")).filter("route = 'noadap'").select("ord", "seq", "qual")


@query("SELECT ord, substr(seq, 1, strpos(seq, 'AGATCGGAAG') - 11) AS seq, substr(qual, 1, strpos(seq, 'AGATCGGAAG') - 11) AS qual FROM fastq WHERE strpos(seq, 'AGATCGGAAG') - 11 >= 35", "fastq")
def fastq_trim_se_trimmed(v):
    return fastq.trim_se(v("fastq")).filter("route = 'trimmed'").select("ord", "seq", "qual")


@query(
    r"""SELECT ord, route, substr(fs, 1, greatest(CASE WHEN route = 'noadap' THEN length(fs) ELSE cut END - 10, 0)) AS f_seq, substr(fq, 1, greatest(CASE WHEN route = 'noadap' THEN length(fq) ELSE cut END - 10, 0)) AS f_qual,
        substr(rs, 1, greatest(CASE WHEN route = 'noadap' THEN length(rs) ELSE cut END - 10, 0)) AS r_seq, substr(rq, 1, greatest(CASE WHEN route = 'noadap' THEN length(rq) ELSE cut END - 10, 0)) AS r_qual
        FROM (SELECT *, CASE WHEN cut = length(fs) THEN 'noadap' ELSE 'trimmed' END AS route FROM
              (SELECT f.ord, f.seq AS fs, f.qual AS fq, r.seq AS rs, r.qual AS rq,
                      least(CASE WHEN strpos(f.seq, 'AGATCGGAAG') > 0 THEN strpos(f.seq, 'AGATCGGAAG') - 1 ELSE length(f.seq) END, CASE WHEN strpos(r.seq, 'AGATCGGAAG') > 0 THEN strpos(r.seq, 'AGATCGGAAG') - 1 ELSE length(r.seq) END) AS cut
               FROM fastq f JOIN fastq_r r ON f.ord = r.ord WHERE NOT regexp_matches(f.header, '^@.* [^:]*:Y:[^:]*:') AND NOT regexp_matches(r.header, '^@.* [^:]*:Y:[^:]*:')))
        WHERE route = 'noadap' OR cut - 10 >= 35""",
    "fastq",
    "fastq_r",
)
def fastq_trim_pe(v):
    return fastq.trim_pe(v("fastq"), v("fastq_r")).select("ord", "route", "f_seq", "f_qual", "r_seq", "r_qual")


PLACES = [k for k, x in enumerate(MOTIF) if x == "Y"]
_HITS = f"(SELECT regexp_extract(seq, '{motif_pattern(MOTIF)}') AS h FROM fastq WHERE regexp_matches(seq, '{motif_pattern(MOTIF)}'))"
_SITE = [f"count(*) FILTER (substr(h, {p + 1}, 1) = 'C') AS meth_{k}, count(*) FILTER (substr(h, {p + 1}, 1) IN ('C', 'T')) AS total_{k}" for k, p in enumerate(PLACES, 1)]
_AVG = [f"(meth_{k} / total_{k})" for k in range(1, len(PLACES) + 1)]


@query(f"SELECT ({' + '.join(_AVG)}) / {len(PLACES)} AS avg_total, {', '.join(f'{a} AS avg_{k}' for k, a in enumerate(_AVG, 1))}, {', '.join(f'meth_{k}, total_{k}' for k in range(1, len(PLACES) + 1))} FROM (SELECT {', '.join(_SITE)} FROM {_HITS})", "fastq")
def iupac_motif_meth(v):
    return motif.motif_summary(v("fastq"), MOTIF)


@query(f"SELECT ord, regexp_extract(seq, '{motif_pattern(MOTIF)}') AS hit FROM fastq WHERE regexp_matches(seq, '{motif_pattern(MOTIF)}')", "fastq")
def motif_search(v):
    return motif.motif_hits(v("fastq"), MOTIF).select("ord", "hit")


@query(f"SELECT n_nationkey, regexp_matches(upper(n_name), '{motif_pattern('RNY')}') AS hit FROM nation")
def iupac_pattern(v):
    return v("nation").select("n_nationkey", F.upper("n_name").rlike(motif_pattern("RNY")).alias("hit"))


_LOG = ", ".join(f"max(CASE WHEN run = '{r}' AND regexp_matches(value, '{m}') THEN list_filter(regexp_split_to_array(value, '\\s+'), lambda x: x <> '')[{p + 1}] END) AS {n}_{r}" for n, m, p in logs.METRICS for r in ("noadap", "trimmed"))


@query(f"SELECT {_LOG} FROM logs", "logs")
def log_summary(v):
    lines = v("logs")
    return logs.summarize_logs(lines.filter("run = 'noadap'"), lines.filter("run = 'trimmed'"))


_CONV = "(SELECT 1 - sum(m) / sum(t) AS conv_eff, sum(m)::BIGINT AS meth, sum(t)::BIGINT AS total, count(*)::BIGINT AS cpg_count FROM (SELECT cast(floor(cast(perc AS DOUBLE) * total + 0.5) AS BIGINT) AS m, total AS t FROM sites WHERE chrom = 'chr0'))"


@query(f"SELECT * FROM (SELECT {_LOG} FROM logs), {_CONV}", "logs", "sites")
def log_summary_conversion(v):
    lines = v("logs")
    return logs.summarize_logs(lines.filter("run = 'noadap'"), lines.filter("run = 'trimmed'"), convert.conversion_efficiency(v("sites"), "chr0"))


# --- aligned reads

_BY = "PARTITION BY chrom ORDER BY ord"


def _runs(max_dup: int, source: str = "reads") -> str:
    return f"""(SELECT ord, chrom, start, mpos, strand, xm FROM (SELECT *, row_number() OVER (PARTITION BY chrom, run ORDER BY ord) AS place FROM (SELECT *, sum(new) OVER ({_BY}) AS run FROM
        (SELECT *, CASE WHEN lag(start) OVER ({_BY}) = start AND lag(strand) OVER ({_BY}) = strand AND lag(mpos) OVER ({_BY}) = mpos THEN 0 ELSE 1 END AS new FROM {source}))) WHERE place <= {max_dup})"""


@query(f"SELECT * FROM {_runs(1)}", "reads")
def bam_dedup_runs(v):
    return pileup.dedup_runs(v("reads"), 1).select("ord", "chrom", "start", "mpos", "strand", "xm")


@query(f"SELECT * FROM {_runs(2)}", "reads")
def bam_dedup_runs_2(v):
    return pileup.dedup_runs(v("reads"), 2).select("ord", "chrom", "start", "mpos", "strand", "xm")


_CUT_MATES = "SELECT ord, chrom, start, mpos, strand, CASE WHEN mpos > start THEN substr(xm, 1, cast(mpos - start AS INTEGER)) ELSE xm END AS xm FROM {}"


@query(_CUT_MATES.format("reads"), "reads")
def bam_mate_truncate(v):
    return pileup.truncate_mates(v("reads")).select("ord", "chrom", "start", "mpos", "strand", "xm")


@query("SELECT ord, chrom, start FROM reads WHERE strand = '-'", "reads")
def bam_strand_filter(v):
    return pileup.strand_filter(v("reads"), "negative").select("ord", "chrom", "start")


@query("SELECT ord, chrom, start, part FROM (SELECT *, 0 AS part FROM reads WHERE ord % 2 = 0 UNION ALL SELECT *, 1 AS part FROM reads WHERE ord % 2 = 1)", "reads")
def bam_merge_sort(v):
    reads = v("reads")
    return pileup.merge_sorted(reads.filter("ord % 2 = 0"), reads.filter("ord % 2 = 1")).select("ord", "chrom", "start", "part")


def _piled(context: str, strand: str = "both", max_dup: int = 1) -> str:
    sign = pileup.STRANDS[strand]
    source = "reads" if sign is None else f"(SELECT * FROM reads WHERE strand = '{sign}')"
    calls = ", ".join(f"'{c}'" for c in pileup.CONTEXTS[context])
    return f"""(SELECT chrom, pos, count(*) FILTER (c = upper(c))::BIGINT AS meth, count(*)::BIGINT AS total FROM
        (SELECT chrom, CASE WHEN strand = '-' THEN start - i ELSE start + i END AS pos, substr(xm, cast(i + 1 AS INTEGER), 1) AS c FROM
         (SELECT *, unnest(range(0, length(xm))) AS i FROM ({_CUT_MATES.format(_runs(max_dup, source))})))
        WHERE c IN ({calls}) GROUP BY chrom, pos)"""


def _pileup_query(name: str, context: str, strand: str = "both") -> None:
    def run(v):
        return pileup.pileup(v("reads"), context, strand)

    run.__name__ = name
    query(f"SELECT * FROM {_piled(context, strand)}", "reads")(run)


for _context in pileup.CONTEXTS:
    _pileup_query(f"pileup_{_context.lower()}", _context)
_pileup_query("pileup_pos_strand", "CG", "positive")
_pileup_query("pileup_neg_strand", "CG", "negative")


@query(
    f"""SELECT chrom, pos AS start, pos + 1 AS "end", printf('%.2f', meth / total) || '-' || total AS name, 0::BIGINT AS score, '+' AS strand, 0::BIGINT AS thick_start, 0::BIGINT AS thick_end,
        CASE WHEN meth = 0 THEN '0,0,0' WHEN meth / total <= 0.6 THEN '27,74,210' WHEN meth / total <= 0.8 THEN '27,210,57' ELSE '210,27,27' END AS rgb FROM {_piled('CG')}""",
    "reads",
)
def pm_bed_render(v):
    return pileup.render(pileup.pileup(v("reads"), "CG"))


# --- sites, regions and windows

_METH = "cast(floor(cast(perc AS DOUBLE) * total + 0.5) AS BIGINT)"
_OVER = 's.chrom = r.chrom AND s.start < r."end" AND s."end" > r.start'


@query(f'SELECT sample, chrom, start, "end", perc, total, {_METH} AS meth FROM sites', "sites")
def pm_parse_counts(v):
    return regions.parse_counts(v("sites"))


@query('SELECT p_partkey, cast(p_size AS BIGINT) AS total, printf(\'%.2f\', 1.0 / p_size) AS perc FROM part')
def pm_name_split(v):
    name = F.concat(F.format_number(1.0 / F.col("p_size"), 2), F.lit("-"), F.col("p_size").cast("string"))
    perc, total = regions.split_name(name)
    return v("part").select("p_partkey", total.alias("total"), perc.alias("perc"))


@query(f"SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM mask r WHERE {_OVER})", "sites", "mask")
def mask_sites(v):
    return intervals.mask(v("sites"), v("mask"))


@query(f"SELECT * FROM sites s WHERE EXISTS (SELECT 1 FROM roi r WHERE {_OVER})", "sites", "roi")
def sites_in_roi(v):
    return intervals.sites_in(v("sites"), v("roi"))


@query(f'SELECT s.*, r.start AS r_start, r."end" AS r_end FROM sites s JOIN roi r ON {_OVER}', "sites", "roi")
def roi_hits(v):
    return regions.region_hits(v("sites"), v("roi"))


_ROIS = 'SELECT chrom, start, "end", max_by(name, ord) AS name FROM roi GROUP BY chrom, start, "end"'
_SAMPLES = "(VALUES " + ", ".join(f"('{s}')" for s in SAMPLES) + ") g(sample)"
_UNMASKED = "(SELECT * FROM sites s WHERE NOT EXISTS (SELECT 1 FROM mask r WHERE " + _OVER + "))"


def _counts(areas: str, sites: str = "sites") -> str:
    return f"""(SELECT r.chrom, r.start, r."end", r.name, g.sample, coalesce(meth, 0)::BIGINT AS meth, coalesce(total, 0)::BIGINT AS total, coalesce(cpgs, 0)::BIGINT AS cpgs FROM ({areas}) r CROSS JOIN {_SAMPLES}
        LEFT JOIN (SELECT r.chrom, r.start, r."end", s.sample, sum({_METH}) AS meth, sum(s.total) AS total, count(*) AS cpgs FROM {sites} s JOIN ({areas}) r ON {_OVER} GROUP BY ALL) h
        ON h.chrom = r.chrom AND h.start = r.start AND h."end" = r."end" AND h.sample = g.sample)"""


def _wide(counts: str, min_cpgs: int, need: int, raw: bool = False) -> str:
    ok = f"total >= 1 AND cpgs >= {min_cpgs}"
    cells = [f"max(CASE WHEN sample = '{s}' THEN {c} END) AS {s}_{n}" for s in SAMPLES for c, n in (("meth", "methylated"), ("total", "total"), ("cpgs", "cpgs"))] if raw else [f"max(CASE WHEN sample = '{s}' AND {ok} THEN meth / total END) AS {s}" for s in SAMPLES]
    return f'SELECT chrom, start, "end", name, {", ".join(cells)} FROM {counts} GROUP BY chrom, start, "end", name HAVING count(*) FILTER ({ok}) >= {need}'


_FULL = f"chrom IN (SELECT chrom FROM sites GROUP BY chrom HAVING count(DISTINCT sample) = {len(SAMPLES)})"
_OWN = f"SELECT * FROM ({_ROIS}) WHERE {_FULL}"


@query(f"SELECT * FROM {_counts(_ROIS)}", "sites", "roi")
def roi_meth_long(v):
    return regions.region_counts(v("sites"), regions.distinct_regions(v("roi")), SAMPLES)


@query(f"SELECT chrom, min(ord) AS chrom_ord FROM roi WHERE {_FULL} GROUP BY chrom", "sites", "roi")
def roi_chrom_eligible(v):
    return regions.eligible_chroms(v("sites"), v("roi"), len(SAMPLES))


@query(_wide(_counts(_OWN), 10, 3), "sites", "roi")
def roi_meth_table(v):
    return regions.roi_meth(v("sites"), v("roi"), SAMPLES)


@query(_wide(_counts(_OWN), 10, 3, raw=True), "sites", "roi")
def roi_raw_table(v):
    return regions.roi_meth(v("sites"), v("roi"), SAMPLES, raw=True)


@query(_wide(_counts(_OWN, _UNMASKED), 10, 3), "sites", "roi", "mask")
def roi_meth_masked(v):
    return regions.roi_meth(v("sites"), v("roi"), SAMPLES, masked=v("mask"))


@query(_wide(_counts(_OWN), 10, 1), "sites", "roi")
def roi_min_samples(v):
    return regions.roi_meth(v("sites"), v("roi"), SAMPLES, min_samples=1)


_WINDOWS = f'SELECT chrom, s AS start, s + {WINDOW - 1} AS "end", \'\' AS name FROM (SELECT chrom, unnest(range(1, length, {WINDOW})) AS s FROM chroms)'


@query(_WINDOWS, "chroms")
def window_generate(v):
    return regions.windows(v("chroms"), WINDOW)


@query(_wide(_counts(_WINDOWS), 20, 3), "sites", "chroms")
def window_meth(v):
    return regions.window_meth(v("sites"), v("chroms"), SAMPLES, WINDOW)


@query(_wide(_counts(_WINDOWS), 20, 3, raw=True), "sites", "chroms")
def window_raw(v):
    return regions.window_meth(v("sites"), v("chroms"), SAMPLES, WINDOW, raw=True)


@query(_wide(_counts(_WINDOWS, _UNMASKED), 20, 1), "sites", "chroms", "mask")
def window_masked(v):
    return regions.window_meth(v("sites"), v("chroms"), SAMPLES, WINDOW, masked=v("mask"), min_samples=1)


# --- other forms

@query(f'SELECT chrom AS chr, start AS pos, total AS "N", {_METH} AS "X" FROM sites', "sites")
def pm2dss(v):
    return convert.to_dss(v("sites"))


@query('SELECT chrom, start, start + 1 AS "end", perc FROM sites', "sites")
def pm2bg(v):
    return convert.to_bedgraph(v("sites"))


@query(f"SELECT sample, chrom, sum({_METH}) / sum(total) AS perc, sum({_METH})::BIGINT AS meth, sum(total)::BIGINT AS total, count(*)::BIGINT AS cpgs FROM sites GROUP BY sample, chrom", "sites")
def pm_stats(v):
    return convert.stats(v("sites"), ["sample", "chrom"])


@query(f"SELECT * FROM {_CONV}", "sites")
def conv_efficiency(v):
    return convert.conversion_efficiency(v("sites"), "chr0")


@query(r"SELECT chrom, length FROM sizes WHERE chrom NOT LIKE '%\_%' ESCAPE '\'", "sizes")
def genome_main_chroms(v):
    return genome.main_chroms(v("sizes"))


@query(
    """SELECT n, CASE WHEN value LIKE 'track%' THEN value ELSE array_to_string(list_transform(string_split(value, chr(9)), lambda x, i: CASE WHEN i = 2 THEN cast(cast(x AS BIGINT) + 1 AS VARCHAR) WHEN i = 4 THEN cast(cast(x AS BIGINT) - 3 AS VARCHAR) ELSE x END), chr(9)) END AS value FROM lines""",
    "lines",
)
def adjust_columns(v):
    return tabular.adjust_columns(v("lines"), [1, 3], [1, -3], F.col("value").startswith("track"))
