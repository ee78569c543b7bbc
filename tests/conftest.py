from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from roomledger.session import build_session

    session = build_session(
        "roomledger-tests",
        "local[4]",
        {
            "spark.sql.shuffle.partitions": "3",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            # Keep several ranges on tiny inputs, so that offsets and carries are used.
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
            # Tiny inputs: compiling code per query would take longer than running it.
            "spark.sql.codegen.wholeStage": "false",
        },
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def bookings(spark, sf):
    """The adapter's 37 columns, stored once."""
    from roomledger.sources.testdata import load_bookings

    frame = load_bookings(spark, sf).checkpoint()
    return frame
