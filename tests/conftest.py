import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from proxima.session import local_session
    s = local_session("*", 8, app="proxima-tests", driver_memory="4g")
    yield s
    s.stop()


# fixed values: the documented toy catalogue (item-query and user-query examples)
ITEMS = [
    {"id": "1", "price": "low", "category": "meat", "weight": 2.2, "country": "US"},
    {"id": "2", "price": "mid", "category": "meat", "weight": 3.0, "country": "US"},
    {"id": "3", "price": "low", "category": "dairy", "weight": 1.5, "country": "US"},
    {"id": "4", "price": "high", "category": "meat", "weight": 2.8, "country": "EU"},
]
FILTERS = [{"field": "country", "values": ["US", "EU"]}]
ENCODERS_3 = [
    {"field": "price", "values": ["low", "mid", "high"], "type": "onehot", "weight": 1},
    {"field": "category", "values": ["dairy", "meat"], "type": "onehot", "weight": 2},
    {"field": "weight", "values": [], "type": "numeric", "weight": 2},
]
ENCODERS_2 = ENCODERS_3[:2]


@pytest.fixture
def items(spark):
    return spark.createDataFrame(ITEMS, "id string, price string, category string, weight double, country string")
