import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["noisiest_targets", "search_peaks", "consolidated_clusters", "injection_outcomes", "recovery_marginals", "quota_buckets", "detector_summary", "class_metrics", "label_transitions", "cadence_quality_gate"]


def test_every_oracle_belongs_to_a_query():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200 and len(o) / len(q) > 0.8


def test_flagship(spark):
    df = entry.entry(spark)
    assert "vet_class" in df.columns and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    f = lambda rows: sorted(str(tuple(0.0 if v == 0 and isinstance(v, float) else v for v in r)) for r in rows)
    assert f(map(tuple, df.select(*cols).collect())) == f(cur.fetchall())


def test_binned_spectrum_covers_the_whole_grid(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    df = entry.queries()["box_spectrum_binned"](spark, DATA)
    cur = con.execute(entry.oracle_sql()["box_spectrum_binned"])
    cols = [c[0] for c in cur.description]
    got = sorted(map(tuple, df.select(*cols).collect()))
    assert got == sorted(cur.fetchall())
    i = cols.index("period_idx")
    assert max(r[i] for r in got) > 4000
