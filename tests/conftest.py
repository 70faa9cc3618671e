import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from retentio.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=8, app_name="retentio-tests")
    yield s


RAW_COLS = ["customerID", "gender", "SeniorCitizen", "Partner", "Dependents", "tenure",
            "PhoneService", "MultipleLines", "InternetService", "OnlineSecurity", "OnlineBackup",
            "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "Contract",
            "PaperlessBilling", "PaymentMethod", "MonthlyCharges", "TotalCharges", "Churn"]


def raw_row(cid, **kw):
    base = dict(customerID=cid, gender="Male", SeniorCitizen=0, Partner="No", Dependents="No",
                tenure=10, PhoneService="Yes", MultipleLines="No", InternetService="DSL",
                OnlineSecurity="No", OnlineBackup="No", DeviceProtection="No", TechSupport="No",
                StreamingTV="No", StreamingMovies="No", Contract="Month-to-month",
                PaperlessBilling="Yes", PaymentMethod="Electronic check", MonthlyCharges=50.0,
                TotalCharges="500", Churn="No")
    base.update(kw)
    return tuple(base[c] for c in RAW_COLS)


@pytest.fixture(scope="session")
def raw_df_factory(spark):
    from retentio.sources.io import SUBSCRIBER_SCHEMA

    def make(rows):
        return spark.createDataFrame(rows, SUBSCRIBER_SCHEMA)
    return make
