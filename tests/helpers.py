"""Small series for tests."""

import random
from datetime import datetime, timedelta

from baroflow.schema import MEASURES, READINGS

T0 = datetime(2020, 1, 1)


def series(spark, stations, minutes=60, **columns):
    """Regular series: ``columns`` maps a name to values shared by all stations."""
    n = len(next(iter(columns.values())))
    base = 26297280  # minutes from the epoch to T0
    rows = [
        (s, base // minutes + i, T0 + timedelta(minutes=minutes * i), *[columns[c][i] for c in columns])
        for s in stations
        for i in range(n)
    ]
    ddl = "Location string, step long, Time timestamp, " + ", ".join(f"{c} double" for c in columns)
    return spark.createDataFrame(rows, ddl)


def readings(spark, rows):
    """Rows of (station, time, {measure: value})."""
    data = [(t, s, *[v.get(m) for m in MEASURES]) for s, t, v in rows]
    return spark.createDataFrame(data, READINGS)


def random_readings(spark, stations=3, hours=900, keep=0.8, seed=1, holes=((200, 215), (500, 530))):
    rng = random.Random(seed)
    rows = []
    for k in range(stations):
        level = 1010.0
        for h in range(hours):
            level += rng.uniform(-2, 2) - (level - 1010) * 0.03
            if any(a <= h < b for a, b in holes) and k % 2 == 0 or rng.random() > keep:
                continue
            for _ in range(rng.choice([1, 1, 1, 2])):
                t = T0 + timedelta(hours=h, minutes=rng.uniform(-29, 29))
                rows.append(
                    (
                        f"s{k}",
                        t,
                        {
                            "Rain": max(0.0, rng.uniform(-8, 3)),
                            "Pressure_hPa": None if rng.random() < 0.05 else level,
                            "Temp_C": rng.uniform(5, 25),
                            "DewPt_C": rng.uniform(0, 5),
                            "RH": rng.uniform(0, 100),
                            "Wind_SP_m_s": 1.0,
                        },
                    )
                )
    return readings(spark, rows)


def column(df, name, order="step"):
    return [r[0] for r in df.orderBy("Location", order).select(name).collect()]
