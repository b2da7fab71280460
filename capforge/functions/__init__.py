"""Column-expression helpers shared by the operators (all JVM-side built-ins)."""

from capforge.functions.scalar import (  # noqa: F401
    DAY_MICROS,
    PANDAS_NULL_TOKENS,
    above_flag,
    add_days,
    epoch_micros,
    floor_div,
    host_id,
    model_label,
    nan_to_null,
    round_doubles,
    table_suffix,
)
