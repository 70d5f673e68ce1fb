import duckdb
import pytest

from llm_helpers import DOCUMENTS, odd_rows


@pytest.fixture
def documents(spark, tmp_path):
    """Writes (doc_id, text, lang, source) rows, with columns of clashing names, as a table."""
    def write(rows, name="data"):
        folder = str(tmp_path / name)
        full = [(*r, None if r[1] is None else len(r[1]), "s", 1, "x", "p", 2, "b", "r", 3) for r in rows]
        spark.createDataFrame(full, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
        return folder
    return write


@pytest.fixture
def odd(documents):
    return documents(odd_rows(), "odd")


@pytest.fixture
def empty(documents):
    return documents([], "empty")


@pytest.fixture
def duck():
    def run(sql, folder, names=("documents",)):
        con = duckdb.connect()
        for name in names:
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
        cursor = con.execute(sql)
        columns = [c[0] for c in cursor.description]
        return sorted((dict(zip(columns, r)) for r in cursor.fetchall()), key=repr)
    return run
