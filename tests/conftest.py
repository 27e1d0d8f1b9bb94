import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stallwise.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


class Frames:
    """Hand-made tables with the column types of the engine."""

    def __init__(self, spark):
        self.spark = spark

    def behaviors(self, rows):
        """rows: (id, user, item, type, time[, device, channel])."""
        full = [(r[0], r[1], r[2], r[3], ts(r[4]), ts(r[4]).date(), ts(r[4]).hour,
                 r[5] if len(r) > 5 else "mobile", r[6] if len(r) > 6 else "organic") for r in rows]
        return self.spark.createDataFrame(full, """behavior_id string, user_id string, item_id string, behavior_type string,
            event_time timestamp_ntz, event_date date, event_hour int, device_type string, channel string""")

    def orders(self, rows):
        full = [(o, u, ts(t), float(a), s) for o, u, t, a, s in rows]
        return self.spark.createDataFrame(full, "order_id string, user_id string, order_time timestamp_ntz, total_amount double, status string")

    def lines(self, rows):
        full = [(o, i, q, float(a) / q, float(a)) for o, i, q, a in rows]
        return self.spark.createDataFrame(full, "order_id string, item_id string, quantity long, unit_price double, amount double")

    def items(self, rows):
        """rows: (id, name, category, brand, price, status, created)."""
        full = [(i, n, c, b, float(p), 10, s, ts(t)) for i, n, c, b, p, s, t in rows]
        return self.spark.createDataFrame(full, """item_id string, item_name string, category_id string, brand string, price double,
            stock int, status int, created_at timestamp_ntz""")

    def users(self, rows):
        """rows: (id, age, gender, registered)."""
        full = [(u, a, g, "X", ts(t)) for u, a, g, t in rows]
        return self.spark.createDataFrame(full, "user_id string, age int, gender string, city string, register_time timestamp_ntz")


@pytest.fixture(scope="session")
def make(spark):
    return Frames(spark)


def by(df, *keys):
    """Rows as a dict on the key columns."""
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}
