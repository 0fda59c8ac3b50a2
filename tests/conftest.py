import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from ebb.session import local_session
    s = local_session("*", shuffle_partitions=8, app="ebb-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_pdf():
    """Clients from the customer and orders tables; the label follows their idle days, with some exceptions."""
    orders = pd.read_parquet(f"{SF_SMALL}/orders.parquet", columns=["o_custkey", "o_totalprice", "o_orderdate"])
    orders["o_orderdate"] = pd.to_datetime(orders["o_orderdate"])
    last = orders["o_orderdate"].max()
    by = orders.groupby("o_custkey").agg(activity_date=("o_orderdate", "max"), total_orders=("o_orderdate", "size"),
                                         total_revenue=("o_totalprice", "sum")).reset_index()
    by["days_since_last_order"] = (last - by["activity_date"]).dt.days
    by["support_tickets"] = by["o_custkey"] * 7 % 5
    by["subscription_tier"] = np.where(by["o_custkey"] % 3 == 0, "v2.0", "v1.0")   # a dot in a category
    by["newsletter"] = by["o_custkey"] % 4 == 0
    by["country"] = "X"                                                           # a constant
    idle = by["days_since_last_order"] > by["days_since_last_order"].median()
    by["churned"] = np.where(by["o_custkey"] % 9 == 0, ~idle, idle).astype("int32")
    by.insert(0, "client_id", by.pop("o_custkey").map("C{:04d}".format))
    return by


@pytest.fixture(scope="session")
def sample_df(spark, sample_pdf):
    return spark.createDataFrame(sample_pdf)
