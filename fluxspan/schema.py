"""Column names and types of a flight recording, and of the design matrix.

Fixed values: these names are the data model's contract.
"""

from __future__ import annotations

from pyspark.sql import types as T

COL_TIME, COL_LAT, COL_LON, COL_ALT = "time", "lat", "lon", "alt"
COL_BTOTAL, COL_BX, COL_BY, COL_BZ = "B_total", "B_x", "B_y", "B_z"
COL_DELTA_B, COL_TMI_COMPENSATED = "delta_B", "tmi_compensated"
COL_HEADING, COL_PITCH, COL_ROLL, COL_SEGMENT_LABEL = "heading", "pitch", "roll", "segment"
COL_ROLL_RATE, COL_PITCH_RATE, COL_YAW_RATE = "roll_rate", "pitch_rate", "yaw_rate"

REQUIRED_COLUMNS = (COL_TIME, COL_LAT, COL_LON, COL_ALT, COL_BTOTAL, COL_BX, COL_BY, COL_BZ)
IMU_COLUMNS = (COL_ROLL_RATE, COL_PITCH_RATE, COL_YAW_RATE)
MANEUVERS = ("steady", "pitch", "roll", "yaw")
HEADINGS = ("N", "E", "S", "W")

FLIGHT, ROW = "flight_id", "row_idx"  # which recording, and the position in it

_AXES = "xyz"
COSINES = tuple(f"cos_{a}" for a in _AXES)
RATES = tuple(f"dcos_{a}" for a in _AXES)
INDUCED = tuple(f"cos_{a}_cos_{b}" for i, a in enumerate(_AXES) for b in _AXES[i:])
EDDY = tuple(f"cos_{a}_dcos_{b}" for a in _AXES for b in _AXES)
TERMS = {"a": COSINES, "b": COSINES + INDUCED, "c": COSINES + INDUCED + EDDY, "d": COSINES + INDUCED + EDDY + RATES}
N_TERMS = {m: len(t) for m, t in TERMS.items()}

COL_COS_X, COL_COS_Y, COL_COS_Z = COSINES
COL_DCOS_X, COL_DCOS_Y, COL_DCOS_Z = RATES
COL_COS_X2, COL_COS_XY, COL_COS_XZ, COL_COS_Y2, COL_COS_YZ, COL_COS_Z2 = INDUCED
COL_COS_X_DCOS_X, COL_COS_X_DCOS_Y, COL_COS_X_DCOS_Z = EDDY[:3]
COL_COS_Y_DCOS_X, COL_COS_Y_DCOS_Y, COL_COS_Y_DCOS_Z = EDDY[3:6]
COL_COS_Z_DCOS_X, COL_COS_Z_DCOS_Y, COL_COS_Z_DCOS_Z = EDDY[6:]

RECORDING = T.StructType([T.StructField(c, T.DoubleType(), True) for c in REQUIRED_COLUMNS])
OPTIONAL_DOUBLES = (COL_HEADING, COL_PITCH, COL_ROLL, *IMU_COLUMNS)
SEGMENTS_DDL = "flight_id int, seg_ord int, maneuver string, heading string, start_idx int, end_idx int"
