"""The driver contract at the smallest scale: queries run, and agree with their SQL where there is any."""

import math
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v if not hasattr(v, "quantize") else float(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_core_queries(spark):
    from tallyloom.plans import oracle, queries

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    sql, bad = oracle.oracle_sql(), []
    for name, q in queries.queries().items():
        df = q(spark, str(DATA))
        rows = df.collect()
        if name not in sql:
            continue
        got = con.execute(sql[name])
        cols = [c[0] for c in got.description]
        if sorted(cols) != sorted(df.columns):
            bad.append((name, cols, df.columns))
            continue
        order = sorted(cols)
        a = sorted(str([plain(r[c]) for c in order]) for r in rows)
        b = sorted(str([plain(r[cols.index(c)]) for c in order]) for r in got.fetchall())
        if a != b:
            bad.append((name, a[:2], b[:2]))
    assert not bad


def test_rest_without_llm():
    """Nothing outside the subpackage imports it."""
    root = Path(__file__).resolve().parent.parent / "tallyloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tallyloom.llm" not in p.read_text(encoding="utf-8"), p
