import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from statweave.session import local_session, use_utc  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = use_utc(local_session(os.environ.get("TEST_CPUS", "8"), "statweave-tests", 4))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


URL = "https://www.pbs.gov.pk/fixture"
META = dict(
    source="Bureau fixture", source_url=URL, retrieval_date="2026-10-01", original_file="fixture.csv",
    dataset_version="fixture-v1", geographic_level="national", time_period="2020", ingestion_status="retrieved",
)


@pytest.fixture()
def meta():
    return dict(META)


@pytest.fixture()
def write_csv():
    import csv

    def write(path, values, **over):
        names = ["dataset", "indicator", "geography", "period", "value", "unit", "frequency", "source_url"]
        with open(path, "w", newline="") as f:
            out = csv.writer(f)
            out.writerow(names)
            for period, value in values:
                row = dict(dataset="test", indicator="cpi", geography="Pakistan", period=period, value=value,
                           unit="index", frequency="monthly", source_url=URL)
                row.update(over)
                out.writerow([row[n] for n in names])
        return str(path)

    return write


@pytest.fixture()
def series(spark):
    """A monthly series from plain values, starting 2000-01."""

    def build(values, start=(2000, 1), **over):
        import datetime as dt

        base = dict(dataset="test", indicator="cpi", geography="Pakistan", unit="index", frequency="monthly",
                    source_url=URL, dataset_version="v1", ingestion_id="r1")
        base.update(over)
        rows = []
        for i, v in enumerate(values):
            m = start[0] * 12 + start[1] - 1 + i
            rows.append((base["dataset"], base["indicator"], base["geography"], dt.date(m // 12, m % 12 + 1, 1),
                         None if v is None else float(v), base["unit"], base["frequency"], base["source_url"],
                         base["dataset_version"], base["ingestion_id"]))
        from statweave.schema import FACT_SCHEMA

        return spark.createDataFrame(rows, FACT_SCHEMA)

    return build
