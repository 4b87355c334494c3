"""Table schemas and column names shared by every stage.

Fixed values: the column names and types below are those of the call-detail
record (CDR) files, the cell-adjacency file and the cell tables that the jobs
read and write; results must keep them to be interchangeable.
"""

from pyspark.sql import types as T

# Column names of the CDR and of derived tables.
SUBSCRIBER_ID = "SUBSCRIBER_ID"
CALL_TIME = "CALL_TIME"
CALL_TIMESTAMP = "CALL_TIMESTAMP"
INDEX_1KM = "INDEX_1KM"
YEAR = "YEAR"
WEEK_OF_YEAR = "WEEK_OF_YEAR"
DATE_OF_YEAR = "DATE_OF_YEAR"
HOUR_OF_DAY = "HOUR_OF_DAY"
HW_TIME_FILTER = "HW_TIME_FILTER"
APPEARANCE_COUNT = "APPEARANCE_COUNT"
MAX_APPEARANCE_COUNT = "MAX_APPEARANCE_COUNT"
# Fixed value: how the residents map job spells it in its location files.
MAX_APEARENCE_COUNT = "MAX_APEARENCE_COUNT"
LOCATION_ID = "LOCATION_ID"
COUNT_IN_1KM_CELL = "COUNT_IN_1KM_CELL"
LATITUDE = "LATITUDE"
LONGITUDE = "LONGITUDE"
ADJ_INDEX_1KM = "ADJ_INDEX_1KM"
ADJ_SLOTS = ("ADJ_1", "ADJ_2", "ADJ_3", "ADJ_4")
ADJ_APPEARANCE = "ADJ_APPEARANCE"

# Hour classes.
HOME_HOUR = "HOME_HOUR"
WORK_HOUR = "WORK_HOUR"
NO_HOUR = ""

# Raw CDR as stored: the time is text yyyyMMddHHmmss without zone.
# Spark file sources report every column nullable, so nullable=False on the
# id is documentation only; the operators treat nulls as possible.
CDR = T.StructType([
    T.StructField(SUBSCRIBER_ID, T.StringType(), False),
    T.StructField(CALL_TIME, T.StringType(), True),
    T.StructField(INDEX_1KM, T.StringType(), True),
])

# Four neighbours per cell, headerless CSV.
ADJACENCY = T.StructType(
    [T.StructField(ADJ_INDEX_1KM, T.StringType(), False)]
    + [T.StructField(s, T.StringType(), True) for s in ADJ_SLOTS]
)

# Cell centres (header CSV, read as text).
CENTRES = T.StructType([
    T.StructField(LOCATION_ID, T.StringType(), True),
    T.StructField(LATITUDE, T.StringType(), True),
    T.StructField(LONGITUDE, T.StringType(), True),
])

# Administrative areas per cell (header CSV, read as text).
AREA_COLUMNS = ("LONGITUDE", "LATITUDE", "DSD_CODE4", "PROVINCE_NAME",
                "DISTRICT_NAME", "DS_NAME", "LOCATION_ID", "BTS_AREA")
AREAS = T.StructType([T.StructField(c, T.StringType(), True) for c in AREA_COLUMNS])

ENRICHED_COLUMNS = (SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM, YEAR,
                    WEEK_OF_YEAR, DATE_OF_YEAR, HOUR_OF_DAY)
PRESENCE_COLUMNS = (SUBSCRIBER_ID, INDEX_1KM, WEEK_OF_YEAR, DATE_OF_YEAR, HW_TIME_FILTER)
HOME_WORK_COLUMNS = (SUBSCRIBER_ID, "HOME_INDEX_1KM", "HOME_APPEARANCE_COUNT",
                     "WORK_INDEX_1KM", "WORK_APPEARANCE_COUNT")
SAMPLE_COLUMNS = (SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM) + AREA_COLUMNS
HOURS = tuple(range(24))
