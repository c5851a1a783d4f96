from __future__ import annotations

import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sparkwarden.schemas import EVENT_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Event rows from dicts; whatever is not given has a plain default."""

    def make(rows):
        full = []
        for i, row in enumerate(rows):
            base = {
                "event_id": i,
                "timestamp": datetime(2026, 4, 9, 12),
                "source": "auth",
                "event_type": "ssh_failed",
                "severity": "medium",
                "source_ip": None,
                "dest_ip": None,
                "dest_port": None,
                "raw_message": f"message {i}",
                "anomaly_score": 0.0,
                "metadata": {},
            }
            base.update(row)
            full.append(tuple(base[f] for f in EVENT_SCHEMA.fieldNames()))
        return spark.createDataFrame(full, EVENT_SCHEMA)

    return make
