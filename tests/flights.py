"""Small synthetic recordings."""

import numpy as np
import pandas as pd


def synthetic_flight(rows=50, noise=0.05, seed=0, headings=(0, 90, 180, 270)):
    """16 blocks: four headings, each steady, pitch, roll, yaw."""
    rng = np.random.default_rng(seed)
    blocks = []
    for name, base in zip("NESW", headings):
        for maneuver in ("steady", "pitch", "roll", "yaw"):
            wave = np.sin(2 * np.pi * np.arange(rows) / rows)
            pitch, roll = 10 * wave * (maneuver == "pitch"), 10 * wave * (maneuver == "roll")
            heading = base + 5 * wave * (maneuver == "yaw")
            blocks.append(pd.DataFrame({"heading": heading % 360, "pitch": pitch, "roll": roll, "segment": f"{maneuver}_{name}"}))
    df = pd.concat(blocks, ignore_index=True)
    h, p, r = (np.radians(df[c].to_numpy()) for c in ("heading", "pitch", "roll"))
    u, v = 40000 * np.cos(h), -40000 * np.sin(h)
    x = u * np.cos(p) - 20000 * np.sin(p)
    z = u * np.sin(p) + 20000 * np.cos(p)
    y = v * np.cos(r) + z * np.sin(r)
    z = -v * np.sin(r) + z * np.cos(r)
    size = np.sqrt(x * x + y * y + z * z)
    n = len(df)
    out = pd.DataFrame({"time": np.arange(n) * 1.0 + 0.25, "lat": 45.5, "lon": -75.5, "alt": 0.3, "B_total": size + (50 * x - 30 * y + 20 * z) / size + rng.normal(0, noise, n), "B_x": x + 0.25, "B_y": y, "B_z": z})
    return pd.concat([out, df], axis=1)


def random_directions(n=80, coefficients=(1.0, -2.0, 0.5), seed=0, noise=0.0, dt=1.0):
    """Random unit vectors with ``delta_B`` = A c (+ noise), model a."""
    rng = np.random.default_rng(seed)
    b = rng.normal(size=(n, 3))
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    delta = b @ np.array(coefficients) + rng.normal(0, noise, n) if noise else b @ np.array(coefficients)
    return pd.DataFrame({"flight_id": 0, "row_idx": np.arange(n), "time": np.arange(n) * dt, "lat": 45.0, "lon": -75.0, "alt": 0.3, "B_total": 50000.0 + delta, "B_x": b[:, 0] * 50000, "B_y": b[:, 1] * 50000, "B_z": b[:, 2] * 50000, "delta_B": delta})


SEGMENTS = "flight_id int, seg_ord int, maneuver string, heading string, start_idx int, end_idx int"


def segments(spark, *rows):
    return spark.createDataFrame([(0, i + 1, *r) for i, r in enumerate(rows)], SEGMENTS)
