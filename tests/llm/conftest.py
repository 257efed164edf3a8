import glob
import os
import re

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text) as documents with columns that clash with the operators' own."""

    def make(rows):
        wide = [(d, t, "x", "y", 1, 7, "z", True, 5) for d, t in rows]
        return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, row long, sha string, kept boolean, fp long")

    return make


@pytest.fixture
def plans(monkeypatch):
    """The plans of all tables that are written on the way, and a look at them for Python workers."""
    from tallyforge.storage import Scratch

    seen, save = [], Scratch.save

    def saved(self, df, *args, **more):
        seen.append(df._jdf.queryExecution().toString())
        return save(self, df, *args, **more)

    monkeypatch.setattr(Scratch, "save", saved)

    def native(result, at_least):
        seen.append(result._jdf.queryExecution().toString())
        assert len(seen) > at_least
        return not any(re.search("PythonUDF|Pandas|Arrow|MapIn|Python", p) for p in seen)

    return native


@pytest.fixture(scope="session")
def oracle():
    def run(sql, sf_dir=SF):
        con = duckdb.connect()
        for f in glob.glob(f"{sf_dir}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        return con.execute(sql).fetchdf()

    return run


def rows(pdf):
    clean = lambda v: None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pdf[sorted(pdf.columns)].notna(), None)
    return sorted(repr(tuple(map(clean, r))) for r in pdf.itertuples(index=False, name=None))


#: Nulls, empty and blank texts, ties, repeated rows.
ODD = [(5, None), (6, ""), (7, " \t\n"), (8, "same text here, all of it"), (8, "same text here, all of it"), (9, "same  text\nhere, all of it"), (None, "same text here, all of it"), (None, None), (10, "x"), (11, "ÄÖÜ größer ß 漢字 🙂 " * 40), (12, "word " * 30_000)]
