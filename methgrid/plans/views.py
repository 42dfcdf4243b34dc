"""Sequencing-shaped views over the driver's tables, as SQL that Spark and DuckDB both run.

``{name}`` stands for a table or view. Only the two-decimal text of a share is
spelled differently by the engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHROM = "concat('chr', cast({} % 5 as varchar(9)))"
SAMPLES = ["pm0", "pm1", "pm2"]
WINDOW = 1000

VIEWS = {
    "reads": f"""
        SELECT event_id AS ord, {CHROM.format('user_id')} AS chrom,
               user_id * 3 + CASE WHEN value < 100 THEN 0 ELSE 100 END AS start,
               CASE WHEN event_type = 'click' THEN user_id * 3 + CASE WHEN value < 100 THEN 20 ELSE 120 END ELSE -1 END AS mpos,
               CASE WHEN value < 100 THEN '+' ELSE '-' END AS strand,
               translate(concat(md5(cast(event_id as varchar(20))), md5(concat('b', cast(event_id as varchar(20))))), '0123456789abcdef', 'xXyYzZxXzz------') AS xm
        FROM {{events}}""",
    "counted": f"""
        SELECT concat('pm', cast(l_linenumber % 3 as varchar(9))) AS sample, {CHROM.format('l_suppkey')} AS chrom, l_partkey * 7 AS start,
               cast(sum(l_quantity) as bigint) AS total, cast(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) as bigint) AS meth
        FROM {{lineitem}}
        GROUP BY concat('pm', cast(l_linenumber % 3 as varchar(9))), {CHROM.format('l_suppkey')}, l_partkey * 7""",
    "sites": """
        SELECT sample, chrom, start, start + 1 AS "end", TWO_DECIMALS(cast(meth as double) / total) AS perc, total
        FROM {counted} WHERE total > 0""",
    "roi": f"""
        SELECT p_partkey AS ord, {CHROM.format('p_partkey')} AS chrom, p_partkey * 5 AS start, p_partkey * 5 + p_size * 4 AS "end", p_name AS name
        FROM {{part}} WHERE p_size > 0""",
    "mask": f"""
        SELECT {CHROM.format('s_suppkey')} AS chrom, s_suppkey * 60 AS start, s_suppkey * 60 + 30 AS "end" FROM {{supplier}}""",
    "chroms": f"""
        SELECT {CHROM.format('l_suppkey')} AS chrom, cast(max(l_partkey) * 7 + 1 as bigint) AS length, cast(min(l_suppkey % 5) as bigint) AS ord
        FROM {{lineitem}} GROUP BY {CHROM.format('l_suppkey')}""",
    "fastq": """
        SELECT ord, src, header, third,
               CASE WHEN ord % 3 = 0 THEN concat(substr(seq, 1, 20 + cast(ord % 60 as int)), 'AGATCGGAAG', substr(seq, 1, 60 - cast(ord % 60 as int)))
                    WHEN ord % 4 = 0 THEN concat(substr(seq, 1, 10), 'TT', CASE WHEN ord % 8 = 0 THEN 'C' ELSE 'T' END, 'GTGGTG', CASE WHEN ord % 5 = 0 THEN 'C' ELSE 'T' END, 'GTTGTTTTTTAAGTTGGTT', substr(seq, 30, 40))
                    ELSE seq END AS seq,
               substr(qual, 1, CASE WHEN ord % 3 = 0 THEN 90 WHEN ord % 4 = 0 THEN 79 ELSE 96 END) AS qual
        FROM (SELECT event_id AS ord, concat('f', cast(user_id % 3 as varchar(9))) AS src,
                     concat('@read', cast(event_id as varchar(20)), ' 1:', CASE WHEN event_id % 7 = 0 THEN 'Y' ELSE 'N' END, ':0:ACGT') AS header, '+' AS third,
                     translate(concat(md5(cast(event_id as varchar(20))), md5(concat('c', cast(event_id as varchar(20)))), md5(concat('d', cast(event_id as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS seq,
                     concat(md5(concat('q', cast(event_id as varchar(20)))), md5(concat('r', cast(event_id as varchar(20)))), md5(concat('s', cast(event_id as varchar(20))))) AS qual
              FROM {events}) t""",
    "fastq_r": """
        SELECT event_id AS ord, concat('@read', cast(event_id as varchar(20)), ' 2:', CASE WHEN event_id % 11 = 0 THEN 'Y' ELSE 'N' END, ':0:ACGT') AS header, '+' AS third,
               CASE WHEN event_id % 5 = 0 THEN concat(substr(md, 1, 30 + cast(event_id % 50 as int)), 'AGATCGGAAG', substr(md, 1, 20)) ELSE md END AS seq,
               concat(md5(cast(event_id as varchar(20))), md5(cast(event_id as varchar(20))), md5(cast(event_id as varchar(20)))) AS qual
        FROM (SELECT event_id, translate(concat(md5(concat('x', cast(event_id as varchar(20)))), md5(concat('y', cast(event_id as varchar(20)))), md5(concat('z', cast(event_id as varchar(20))))), '0123456789abcdef', 'ACGTACGTACGTACGN') AS md
              FROM {events}) t""",
    "logs": """
        SELECT run, concat('[2020-01-01 00:00:00] ', line) AS value FROM (VALUES
            ('noadap', 1, 'Read filename: reads_noadap.fq'), ('noadap', 2, 'Mappability = 41.5%'),
            ('noadap', 3, 'Total bases of uniquely mapped reads :     240'), ('noadap', 4, ' mCG  100.000%'), ('noadap', 5, ' mCHG 33.333%'), ('noadap', 6, ' mCHH 50.000%'),
            ('trimmed', 1, 'Read filename: reads_trimmed.fq'), ('trimmed', 2, 'Mappability = 100.0%'),
            ('trimmed', 3, 'Total bases of uniquely mapped reads :      41'), ('trimmed', 4, ' mCG  50.000%'), ('trimmed', 5, ' mCHG 0.000%'), ('trimmed', 6, ' mCHH 5.882%')
        ) t(run, n, line)""",
    "sizes": """
        SELECT concat(CASE WHEN n_nationkey % 3 = 0 THEN 'chrUn_' ELSE 'chr' END, cast(n_nationkey as varchar(9))) AS chrom, n_nationkey * 1000 + 5 AS length FROM {nation}""",
    "lines": """
        SELECT cast(o_orderkey as bigint) AS n, CASE WHEN o_orderkey % 50 = 0 THEN concat('track', chr(9), 'x', cast(o_orderkey as varchar(20)))
               ELSE concat('chr1', chr(9), cast(o_orderkey as varchar(20)), chr(9), cast(o_custkey as varchar(20)), CASE WHEN o_orderkey % 2 = 0 THEN concat(chr(9), '7') ELSE '' END) END AS value FROM {orders}""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
NEEDS = {name: [x for x in (*VIEWS, *TABLES) if "{" + x + "}" in sql] for name, sql in VIEWS.items()}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("TWO_DECIMALS(cast(meth as double) / total)", "format_number(cast(meth as double) / total, 2)").replace('"end"', "`end`")
    return spark.sql(sql, **{x: view(spark, sf_dir, x) for x in NEEDS[name]})


def ctes(*names: str) -> str:
    """The WITH clause that gives DuckDB these views."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name in VIEWS and name not in order:
            order.append(name)

    for name in names:
        add(name)
    plain = lambda n: VIEWS[n].format(**{x: x for x in (*VIEWS, *TABLES)}).replace("TWO_DECIMALS(cast(meth as double) / total)", "printf('%.2f', cast(meth as double) / total)")
    return "WITH " + ", ".join(f"{n} AS ({plain(n)})" for n in order)
