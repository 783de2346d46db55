from baroflow.functions.bins import (  # noqa: F401
    ceil_cut,
    epc_band,
    floor_step,
    half_year,
    log_step,
    month_season,
    pce_type,
    round_step,
    wet_dry,
)
from baroflow.functions.dates import (  # noqa: F401
    grid_step,
    grid_time,
    monday_of_week,
    week_of_year,
)
from baroflow.functions.nulls import (  # noqa: F401
    as_double,
    safe_ratio,
    snap,
    strict_avg,
    strict_max,
    strict_min,
    strict_sum,
)
