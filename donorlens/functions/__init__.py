from donorlens.functions.rsemantics import (
    as_numeric,
    date_as_number,
    date_key,
    n_distinct,
    na_max,
    na_min,
    na_sum,
    not_in,
    paste,
    ymd,
)

__all__ = ["as_numeric", "date_as_number", "date_key", "n_distinct", "na_max", "na_min",
           "na_sum", "not_in", "paste", "ymd"]
