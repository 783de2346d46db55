"""Column names and fixed schemas shared by the whole package."""

from pyspark.sql import types as T

STATION = "Location"
TIME = "Time"
STEP = "step"  # grid position: whole grid steps since the epoch
BLOCK = "_blk"  # run of consecutive grid positions handled by one task

MEASURES = ["Rain", "Pressure_hPa", "Temp_C", "DewPt_C", "RH", "Wind_SP_m_s"]

READINGS = T.StructType(
    [
        T.StructField(TIME, T.TimestampType()),
        T.StructField(STATION, T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in MEASURES],
    ]
)

# Rows per block.  One block (plus its halo) is the largest unit any task has to
# hold, however long or dense a single station is.
BLOCK_STEPS = 2048
