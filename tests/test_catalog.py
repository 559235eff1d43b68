import math
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from lattica.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents labels".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    one = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(one(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert _norm(df.collect(), df.columns) == _norm(got.fetchall(), columns)


def test_csv_spelling_is_also_held_over_whole_texts(spark, tmp_path):
    texts = ["=" + "x" * 60 + ',"é\r\n', "y" * 60 + "\r", "z" * 60 + '"', "w" * 60, "", None, "a,\n" * 100_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.field for r in catalog.queries()["csv_spelling"](spark, str(tmp_path)).collect()}
    guarded = ["'" + t if t and t.lstrip()[:1] in tuple("=+-@") else t for t in texts]
    assert [got[i] for i in range(len(texts))] == ['"' + t.replace('"', '""') + '"' if t and set(t) & set(',"\r\n') else t for t in guarded]


def test_round_family_fills_every_row(spark, monkeypatch):
    bound = {}
    bind = catalog.Book.bind
    monkeypatch.setattr(catalog.Book, "bind", lambda self, name, df, *a: (bound.update({name: df.count()}), bind(self, name, df, *a))[1])
    assert catalog.round_family(spark, SF).count() == 50
    assert list(bound.values()) == [spark.read.parquet(f"{SF}/lineitem.parquet").count()]


def test_entry_works_without_the_corpus_package(tmp_path):
    root = Path(catalog.__file__).resolve().parents[2]
    for name in ("__spark_entry__.py", "lattica"):
        (tmp_path / name).symlink_to(root / name)
    code = "import sys; sys.modules['lattica.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op') or k == 'pipeline'], list(q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
