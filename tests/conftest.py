import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (str(ROOT), os.environ.get("PYTHONPATH", "")) if p)

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from paperloom.session import local_session

    # wide plans of small tables: fewer partitions and no generated code for huge expressions keep tests quick
    session = local_session(4, "4g", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(rows, columns):
    """Rows as sorted tuples with doubles rounded, for comparison."""
    cut = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(cut(r[c]) for c in columns) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    """Runs a query and its SQL and compares rows, column names and types."""

    def check(run, sql):
        got = run(spark, sf_dir)
        columns = sorted(got.columns)
        cursor = duck.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == columns
        want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
        assert plain([r.asDict() for r in got.collect()], columns) == plain(want, columns)

    return check
