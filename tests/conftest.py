import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowwatch.schemas import TRANSACTION_EVENT  # noqa: E402
from flowwatch.session import build_session, checkpoint_dir  # noqa: E402

T0 = dt.datetime(2026, 1, 1, 10, 0, 0)


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="flowwatch-tests", shuffle_partitions=8,
                      extra={"spark.driver.memory": "8g"})
    checkpoint_dir(s)
    yield s
    s.stop()


def acct(name: str) -> str:
    """Stable UUID-shaped account id for a short name."""
    import uuid
    return str(uuid.uuid3(uuid.NAMESPACE_OID, name))


def event(eid, src, dst, amount=1000, at=T0, arrival=None, currency="USD", device="dev-1", ip="ip-1",
          tx=None, version=1, corr=None):
    """One transaction_event row; ``at``/``arrival`` are datetimes or second offsets from T0."""
    at = T0 + dt.timedelta(seconds=at) if isinstance(at, (int, float)) else at
    arrival = at if arrival is None else (T0 + dt.timedelta(seconds=arrival)
                                          if isinstance(arrival, (int, float)) else arrival)
    return (eid, tx or f"tx-{eid}", version, corr or acct("corr-" + eid), src, dst, amount, currency, device, ip,
            at, arrival)


@pytest.fixture()
def events(spark):
    def make(rows):
        return spark.createDataFrame(rows, TRANSACTION_EVENT)
    return make
