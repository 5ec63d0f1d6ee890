import csv
import sys
from datetime import date, timedelta
from pathlib import Path
from random import Random

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DEPOTS = ("Aarhus", "Breda", "Cork", "Turku", "Vigo")


def parcel_rows() -> list[dict]:
    """240 parcels from a seeded generator, 17 of them listed twice: gaps, bad dates, and two columns of no use."""
    random = Random(20)
    rows = []
    for k in range(240):
        sent = date(2022, 1, 1) + timedelta(days=3 * k)
        rows.append({
            "Sent On": random.choice(["", "", "tomorrow", "32.13.2022"]) if k % 19 == 4 else sent.isoformat(),
            "weightKg": "" if k % 23 == 7 else f"{random.uniform(0.2, 30):.3f}",
            "Depot": "" if k % 31 == 3 else random.choice(DEPOTS),
            "scratch 1": "", "Express?": "" if k % 40 == 9 else random.choice(["true", "false"]),
            "Label": "" if k % 17 == 2 else f"  parcel {k:04d} for {random.choice(DEPOTS)} ",
            "Pieces": "" if k % 29 == 5 else str(random.randint(1, 12)),
            "scratch 2": str(k) if k % 9 == 0 else "", "Parcel No": str(5000 + k),
        })
    return rows + [rows[k] for k in range(3, 240, 14)]


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("firstlook-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    if session.conf.get("spark.checkpoint.dir", None) is None:
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def parcels_path(tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "parcels.csv"
    rows = parcel_rows()
    with path.open("w", newline="") as file:
        lines = csv.DictWriter(file, list(rows[0]))
        lines.writeheader()
        lines.writerows(rows)
    return str(path)


@pytest.fixture(scope="session")
def parcels(parcels_path):
    """The distinct parcels in pandas, trimmed, as the tests expect them to be read."""
    frame = pd.read_csv(parcels_path, dtype={"Express?": object}).drop_duplicates()
    frame["Label"] = frame["Label"].str.strip()
    return frame


@pytest.fixture(scope="session")
def cleaned(spark, parcels_path):
    from firstlook.operators.clean import clean
    from firstlook.sources.csv import read_csv

    return clean(read_csv(spark, parcels_path))
