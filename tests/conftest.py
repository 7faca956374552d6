import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tenantscope.session import get_session
    ckpt = str(tmp_path_factory.mktemp("ckpt"))
    s = get_session("local[4]", 8, app_name="tenantscope-tests",
                    extra={"spark.checkpoint.dir": ckpt})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def fleet(spark):
    from tenantscope.sources.fixtures import Fleet
    return Fleet(spark, SF_SMALL)


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
