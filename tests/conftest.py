import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    top = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(top / "shared"))
        .config("spark.sql.warehouse.dir", str(top / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in sorted(os.listdir(SF)):
        at = f"{SF}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{at if os.path.isfile(at) else at + '/*.parquet'}')")
    return c


def canonical(rows, columns):
    """Rows as sorted tuples of text, columns in order of name, so that engines can be compared."""

    def text(x):
        if x is None or x != x:
            return "None"
        if isinstance(x, bool):
            return str(x)
        if isinstance(x, float) or type(x).__name__ == "Decimal":
            return repr(round(float(x), 9))
        return str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(text(r[i]) for i in order) for r in rows)


def same_as_sql(df, duck, sql):
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    relation = duck.sql(sql)
    assert sorted(df.columns) == sorted(relation.columns)
    assert got == canonical(relation.fetchall(), relation.columns)
    return len(got)
