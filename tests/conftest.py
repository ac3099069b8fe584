import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fleetratio.plans.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__sql__maxMetadataStringLength="10000",
        spark__sql__debug__maxToStringFields="1000",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


OB_SCHEMA = (
    "sector string, year int, gear string, haul_id string, trip_id string, drvid string, datatype string, "
    "species string, `grouping` string, common_name string, ifq int, catch_disposition string, mt double, "
    "dis_mt double, tgt_mt double, pwht_mt double, exp_sp_ct double, exp_sp_wt double"
)
OB_DEFAULTS = dict(
    sector="S", year=2020, gear="G", haul_id="h1", trip_id="t1", drvid="v1", datatype="Analysis Data", species="A",
    grouping=None, common_name="A", ifq=1, catch_disposition="D", mt=0.0, dis_mt=0.0, tgt_mt=0.0, pwht_mt=0.0,
    exp_sp_ct=0.0, exp_sp_wt=0.0,
)
FLEET_SCHEMA = "sector string, year int, gear string, drvid string, tgt_mt double, ftid string"
FLEET_DEFAULTS = dict(sector="S", year=2020, gear="G", drvid="v1", tgt_mt=0.0, ftid="T1")


def _frame(spark, rows, schema, defaults):
    return spark.createDataFrame([tuple({**defaults, **r}.values()) for r in rows], schema)


@pytest.fixture
def observer(spark):
    """Build observer records from partial rows."""
    return lambda *rows: _frame(spark, rows, OB_SCHEMA, OB_DEFAULTS)


@pytest.fixture
def landings(spark):
    """Build landing lines from partial rows."""
    return lambda *rows: _frame(spark, rows, FLEET_SCHEMA, FLEET_DEFAULTS)


@pytest.fixture
def by_key():
    """Collected rows as dicts by the values of the key columns."""

    def collect(df, *keys):
        rows = [r.asDict() for r in df.collect()]
        out = {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in rows}
        assert len(out) == len(rows), "keys are not unique"
        return out

    return collect
