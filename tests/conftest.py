import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from starloom.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8,
        4,
        **{
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.files.openCostInBytes": "65536",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set SQL settings for one test."""
    before = {}

    def change(**settings):
        for name, value in settings.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def sources(spark):
    """A hand-made set of raw tables with one of every fault."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return {
        "orders": make(
            [
                ("o1", "c1", "delivered", "8/11/2017 9:05"),
                ("o2", "c1", "shipped", "2/26/2017 23:59"),
                ("o3", "c9", "delivered", "8/11/2017 10:00"),
                ("o4", "c2", "canceled", "not a date"),
                ("o5", "c2", "created", None),
                ("o6", "c2", "delivered", "1/1/2018 0:00"),
            ],
            "order_id string, customer_id string, order_status string, order_purchase_timestamp string",
        ),
        "order_items": make(
            [
                ("o1", 1, "p1", "s1", "10.50", "1.00"),
                ("o1", 2, "p2", "s2", "20.00", "2.00"),
                ("o2", 1, "p1", "s1", "30.25", "3.00"),
                ("o3", 1, "p9", "s1", "40.00", "4.00"),
                ("o4", 1, "p1", "s9", "50.00", "5.00"),
                ("o5", 1, "p1", None, "60.00", "6.00"),
                ("o5", 1, "p1", "s1", "60.00", "6.00"),
                ("o7", 1, "p1", "s1", "70.00", "7.00"),
            ],
            "order_id string, order_item_id int, product_id string, seller_id string, price string, "
            "freight_value string",
        ),
        "customers": make(
            [
                ("c1", "u2", "01234", "  sao paulo ", "sp"),
                ("c1", "u1", "01235", "santos", " sp"),
                ("c2", "u3", "99999", "rio  de janeiro", "rj"),
            ],
            "customer_id string, customer_unique_id string, customer_zip_code_prefix string, "
            "customer_city string, customer_state string",
        ),
        "products": make(
            [
                ("p1", " toys ", 1, 2, 3, 4, 5, 6, 7),
                ("p2", None, 1, 2, 3, 4, 5, 6, 7),
            ],
            "product_id string, product_category_name string, product_name_lenght int, "
            "product_description_lenght int, product_photos_qty int, product_weight_g int, "
            "product_length_cm int, product_height_cm int, product_width_cm int",
        ),
        "sellers": make(
            [("s1", "04123", " lajeado ", "rs"), ("s2", "92420", "canoas", "rs")],
            "seller_id string, seller_zip_code_prefix string, seller_city string, seller_state string",
        ),
    }
