"""Fixed values.

Every value here must equal the reference's for the outputs to match: output
column names, report texts, defaults and limits of its service functions. They
are kept together, in the order they appear in an output, and used by name.
"""

# Device keys, time column and value column of the device series.
DEVICE_KEYS = ("Type", "Application", "IP")
TIME_COLUMN = "Date"
VALUE_COLUMN = "Value"

# Date offset columns (days added to the time column).
DATE_OFFSETS = (("Date_Next_2Weeks", 14), ("Date_Next_3Weeks", 21))

# Feature defaults (high-usage threshold, target threshold, horizon in days).
HIGH_THRESHOLD = 70.0
TARGET_THRESHOLD = 80.0
HORIZON_DAYS = 21

# Engineered feature columns, in output order. The count columns keep
# "Above_70" in their names whatever the threshold.
FUTURE_MAX = "Value_target_Max"
TARGET = "Target"
LAST_1_DAY = "Value_Last_1Day"
LAST_3_DAYS = "Value_Last_3Days"
SDEV_28_DAYS = "Date_Value_Last_28Days_SDev"
MEDIAN_28_DAYS = "Date_Value_Last_28Days_Median"
COUNT_ABOVE = tuple((f"Date_Count_Value_Above_70_Last_{n}Days", n) for n in (3, 7, 14, 28))
MINMAX_RANGE = tuple((f"Date_MinMax_Range_Last_{n}Days", n) for n in (3, 7, 14, 28))
FEATURE_COLUMNS = (FUTURE_MAX, TARGET, LAST_1_DAY, LAST_3_DAYS, SDEV_28_DAYS, MEDIAN_28_DAYS,
                   *[c for c, _ in COUNT_ABOVE], *[c for c, _ in MINMAX_RANGE])

# Feature selection.
TOP_K = 10
DROP_REASON = "Low correlation or outside top-k"

# Texts of registry views and model names.
FILENAME_PREFIX = "Filename: "
MODEL_NAME_INFIX = "Model-"
MODEL_ID_CHARS = 6

# Status of a finished prediction run.
RUN_DONE = "completed"

# Gap analysis defaults and the number of rows it reports.
GAP_DAYS = 2
GAP_REPORT_ROWS = 20

# Page size limits and defaults, preview default.
PAGE_SIZE_MIN, PAGE_SIZE_MAX, PAGE_SIZE_DEFAULT = 1, 100, 10
PREVIEW_ROWS = 5

# Statistics — most frequent values reported per column.
TOP_VALUES = 5

# Training split and boosted-tree settings.
TEST_FRACTION = 0.2
SEED = 42
GBT_ROUNDS, GBT_DEPTH, GBT_RATE = 100, 6, 0.1

# The cell texts pandas ``read_csv`` treats as missing by default
# (its documented ``na_values`` list). The CSV reader turns these into NULL.
PANDAS_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
)

# The texts pandas reads as booleans by default.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

# Declared column types of the relational schema and their Spark types.
DECLARED_TYPES = {
    "VARCHAR": "string",
    "INTEGER": "int",
    "FLOAT": "double",
    "DATE": "date",
    "JSONB": "string",
    "JSON": "string",
    "TIMESTAMPTZ": "timestamp",
}
