import duckdb
import pytest

from twinfold.plans import catalogue

from .conftest import SF

TABLES = ("documents", "events", "pages")


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_same_as_sql(spark, con, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


def test_links_are_made(spark):
    """The tree that apply_links worked on: copies share an inode, others don't."""
    assert catalogue.apply_links(spark, SF).count() > 0


@pytest.mark.parametrize("name", ["files_source", "apply_links"])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_tree_in_any_shared_folder(spark, con, monkeypatch, tmp_path, name, scheme):
    """A shared folder may be named without a scheme."""
    monkeypatch.setattr(catalogue.verify, "shared_folder", lambda _: f"{scheme}{tmp_path}/a folder")
    test_same_as_sql(spark, con, name)


def test_tree_in_the_warehouse_or_nowhere(spark, monkeypatch, tmp_path):
    """Where the shared folder isn't mounted the warehouse is taken; without either there is an error, not an empty result."""
    mounted = catalogue.verify.mounted
    monkeypatch.setattr(catalogue.verify, "mounted", lambda s, f: None if f == catalogue.verify.shared_folder(s) else mounted(s, f))
    assert catalogue.files_source(spark, SF).count() > 0
    monkeypatch.setattr(catalogue.verify, "mounted", lambda s, f: None)
    with pytest.raises(RuntimeError, match="mounted"):
        catalogue.files_source(spark, SF)


def test_documents_without_a_path(spark, tmp_path):
    """Such rows have no path in SQL either, which neither query tells."""
    rows = [(1, "a", "de", "src1"), (2, "a", "de", "src1"), (3, "a", "de", None), (None, "a", "de", "src1"), (4, None, "de", "src2")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("files_source", "apply_links"):
        got = [tuple(r) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(db.execute(catalogue.SQL[name]).fetchall())


def test_files_of_any_source(spark, tmp_path):
    """Each row is a file of its own, however often its path comes and whatever its source, also one that excludes leave out as a folder."""
    sources = ["x.bak", "x.bak/y", "", ".", "..", "a/../b", "/abs", "a//b", "a_/b_", "%41 +", "\u00fc\u65e5", "l\nm", "src1/1.txt", "z" * 300]
    rows = [(k, "t" * k, "de", s) for k, s in enumerate(sources, 2)] + [(1, "a", "de", "src1"), (1, "a", "de", "src1"), (1, "bb", "de", "src1"), (10, "c", "de", "src1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in catalogue.files_source(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(db.execute(catalogue.SQL["files_source"]).fetchall())
