"""Newest-first pages over (created_at, id)."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanguard.functions.stats import ts_lit

MAX_PAGE = 200
#: Name of the folder of rows without a day.
NO_DAY = "__HIVE_DEFAULT_PARTITION__"


def keyset_page(df: DataFrame, limit: int = 50, cursor=None) -> DataFrame:
    """`limit` + 1 rows after `cursor` = (created_at, id): the extra row says
    that a next page exists. `page_cursor` reads the cursor off a page, with the
    time in microseconds since the epoch; a timestamp or its text does as well.
    """
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must be within 1..{MAX_PAGE}")
    if cursor is not None:
        at, row_id = cursor[0], F.lit(cursor[1])
        ts = F.timestamp_micros(F.lit(at)) if isinstance(at, int) else ts_lit(at)
        if "dt" in df.columns:  # whole days after the cursor are skipped
            df = df.filter(F.col("dt") <= F.to_date(ts))
        df = df.filter(
            (F.col("created_at") < ts)
            | ((F.col("created_at") == ts) & (F.col("id") < row_id))
        )
    return df.orderBy(F.desc("created_at"), F.desc("id")).limit(limit + 1)


def day_page(df: DataFrame, limit: int = 50, cursor=None) -> DataFrame:
    """`keyset_page` of a table in folders by day (`dt`), read from the cursor's day downwards.

    Days are known from the names of the files. They are looked into one, two, four, … at a
    time until they hold `limit` + 1 rows of the page, so a page near the newest rows reads and
    sorts only these days.
    """
    found = {unquote(m[1]) for m in (re.search(r"/dt=([^/]+)/", f) for f in df.inputFiles()) if m}
    days = sorted((d for d in found if d != NO_DAY), reverse=True)
    first, have, step = 0, 0, 1
    while first < len(days) and have <= limit:
        some = df.filter(F.col("dt").between(days[min(first + step, len(days)) - 1], days[first]))
        have += keyset_page(some, limit, cursor).select("id").count()
        first, step = first + step, 2 * step
    if have > limit:
        df = df.filter(F.col("dt") >= F.lit(days[min(first, len(days)) - 1]).cast("date"))
    return keyset_page(df, limit, cursor)


def page_cursor(page: DataFrame, limit: int = 50):
    """Cursor of the next page, or None on the last one (reads limit + 1 rows)."""
    rows = page.select(F.unix_micros(F.col("created_at")), "id").take(limit + 1)
    return (rows[limit - 1][0], rows[limit - 1][1]) if len(rows) > limit else None
