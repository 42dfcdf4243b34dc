import pytest

import __spark_entry__ as entry
import corpus_pipeline
from methgrid.llm import queries
from methgrid.llm.store import Store

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = queries.table(spark, DATA, "documents")
    clean = "the river ran past the old mill and over the stones where children used to play every summer until the bridge was built and nobody came back there at all"
    item = queries.table(spark, DATA, "benchmark").first().text
    extra = [(-1, clean, "en", "s", len(clean)), (-2, clean + " now", "en", "s", len(clean) + 4), (-3, clean[::-1] + " " + item, "en", "s", 1), (-4, "too short", "en", "s", 9), (-5, "%%% " * 40, "en", "s", 160), (-6, clean.replace("river", "stream by night token=abcdefghijklmnop of") + " and more of this was told by those who lived in that valley long ago", "en", "s", 9), (-7, None, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    left, store = {}, Store(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        docs = store.write(out, "docs")
        left[name] = {r.doc_id: r for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert {-4, -5, -7}.isdisjoint(left[names[0]]) and {-1, -2, -3, -6} <= set(left[names[0]])
    assert -1 not in left[names[1]] and -2 in left[names[1]]  # the smaller id stays
    assert -3 not in left[names[2]]
    assert "[REDACTED]" in left[names[3]][-6].text and left[names[3]][-6].n_chars == len(left[names[3]][-6].text)
    assert len(left[names[4]]) == len(left[names[3]]) and left[names[4]][-2].n_tokens > 0


def test_pipeline_runs(spark):
    assert entry.queries()["pipeline"](spark, DATA).count() > 100


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import os

    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    places = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[k] for k in places)) for r in want.fetchall())
