"""Records of a region and period, and a repeatable random user sample."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

# Hex digits of the sampling key that the histogram tells apart: 65,536 buckets.
_BUCKET_HEX = 4


def ntz(value: dt.datetime | dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal (no session time zone involved)."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat() + " 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


def regional_records(cdr: DataFrame, areas: DataFrame, province: str,
                     start: dt.datetime | dt.date | str,
                     end: dt.datetime | dt.date | str) -> DataFrame:
    """Calls made in cells of ``province`` with start <= CALL_TIMESTAMP <= end
    (both ends inclusive; a date means its midnight), joined to the area
    attributes. Columns: SUBSCRIBER_ID, CALL_TIMESTAMP, INDEX_1KM and the
    eight area columns.

    The optimizer broadcasts the areas of the province when they are below its
    byte threshold (then the CDR side is joined in place) and shuffles
    otherwise.
    """
    recs = cdr.filter(F.col(S.CALL_TIMESTAMP).between(ntz(start), ntz(end)))
    area = areas.filter(F.col("PROVINCE_NAME") == province).select(*S.AREA_COLUMNS)
    return (recs.join(area, recs[S.INDEX_1KM] == area[S.LOCATION_ID], "inner")
            .select(*S.SAMPLE_COLUMNS))


def sampling_key(seed: int | str, sub: Column | str = S.SUBSCRIBER_ID) -> Column:
    """md5 hex of ``"<seed>:<subscriber>"``: a uniform, repeatable order."""
    c = F.col(sub) if isinstance(sub, str) else sub
    return F.md5(F.concat(F.lit(f"{seed}:"), c))


def _is_sampled(users: DataFrame, n: int, seed: int | str) -> Column:
    """Whether a row's SUBSCRIBER_ID is among the ``n`` of ``users`` with the
    smallest sampling key: one comparison with the n-th key, a scalar.

    A histogram of the keys' first digits (65,536 buckets whatever the number
    of users, uniform by construction) says which bucket holds the n-th key and
    which key of it that is; only that bucket's keys are put in order. Fewer than
    ``n`` users: all of them.
    """
    bucket = F.substring("_key", 1, _BUCKET_HEX)
    keyed = (users.select(S.SUBSCRIBER_ID).filter(F.col(S.SUBSCRIBER_ID).isNotNull()).distinct()
             .select(S.SUBSCRIBER_ID, sampling_key(seed).alias("_key")))
    sizes = keyed.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    nothing = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("string").alias("bucket"))

    def pass_bucket(state: Column, entry: Column) -> Column:
        with_it = state["before"] + entry["size"]
        return (F.when(state["bucket"].isNotNull(), state)
                .when(with_it >= n, F.struct(state["before"].alias("before"), entry["bucket"].alias("bucket")))
                .otherwise(F.struct(with_it.alias("before"), F.lit(None).cast("string").alias("bucket"))))

    at = F.aggregate(F.sort_array(F.collect_list(F.struct("bucket", "size"))), nothing, pass_bucket)
    boundary = sizes.agg(at.alias("at")).scalar()
    inside = keyed.filter(bucket == boundary["bucket"])
    in_order = F.sort_array(F.collect_list(F.struct("_key", S.SUBSCRIBER_ID)))
    nth = F.lit(n) - boundary["before"]
    last = inside.agg(in_order.alias("keys")).select(F.get("keys", (nth - 1).cast("int"))).scalar()
    own = F.struct(sampling_key(seed).alias("_key"), F.col(S.SUBSCRIBER_ID))
    return F.col(S.SUBSCRIBER_ID).isNotNull() & F.coalesce(own <= last, F.lit(True))


def sample_users(users: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """The ``n`` distinct non-null SUBSCRIBER_IDs of ``users`` with the
    smallest sampling key (ties by id): a seeded uniform sample without
    replacement, the same on every run and in any SQL engine with md5."""
    if n <= 0:
        return users.select(S.SUBSCRIBER_ID).limit(0)
    return users.select(S.SUBSCRIBER_ID).filter(_is_sampled(users, n, seed)).distinct()


def user_sample(records: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """All records of ``n`` sampled users (see ``sample_users``): a filter of
    the records by the n-th key, without a join."""
    if n <= 0:
        return records.limit(0)
    return records.filter(_is_sampled(records, n, seed))
