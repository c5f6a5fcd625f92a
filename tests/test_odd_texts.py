"""Queries over texts that are empty, blank or null, against DuckDB."""
import duckdb
import pytest

from galley.plans import catalogue, relations, workflows  # noqa: F401  (these add their queries to the first)
from test_queries import plain

TEXTS = ["", " ", "\n", "\n  \n ", None, "a", "one two\nand three\n", "\n\n" + "word and more\n" * 9]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con


def agree(spark, odd, name):
    folder, con = odd
    found = catalogue.queries()[name](spark, folder)
    want = con.execute(f"select {', '.join(found.columns)} from ({catalogue.oracles()[name]})").fetchall()
    assert sorted((tuple(map(plain, r)) for r in found.collect()), key=str) == sorted((tuple(map(plain, r)) for r in want), key=str)


@pytest.mark.parametrize("name", ["command_unit_read", "unit_pages"])
def test_pages_of_odd_texts(spark, odd, name):
    agree(spark, odd, name)


@pytest.mark.parametrize("name", ["issue_codes", "verify_reports", "integrity_aligned", "parsed_reports", "word_delivery", "marker_audit", "report_issues", "reasons_vs_markers"])
def test_reports_of_odd_texts(spark, odd, name):
    agree(spark, odd, name)
