"""Parameters of the registered queries (shared by the Spark side and the
SQL oracle so both compute the same thing)."""

import datetime as dt

WEEKS = (1, 4)                       # cdr_week_range
HOURLY_YEAR, HOURLY_DAY = 2024, 10   # hourly_* : one calendar day
PROVINCE = "ASIA"                    # regional_records / user_sample
PERIOD_START = dt.datetime(2024, 1, 5)
PERIOD_END = dt.datetime(2024, 1, 12)   # inclusive, as a midnight
SAMPLE_USERS = 20
SAMPLE_SEED = 42
OVERSIZE_LENGTH = 2                  # ids here have 1-4 characters
