"""Indian-time rendering, parts and the daily candle grid, independent of any host or session time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Minutes east of UTC, and the grid's anchor (17:30 local) as seconds of the UTC day.
IST_MINUTES, ANCHOR_SECONDS = 330, 43_200


def epoch(c: Column | str) -> Column:
    return F.unix_seconds(c)


def ist(c: Column | str) -> Column:
    """Local wall time as a timestamp (session zone UTC)."""
    return F.timestamp_seconds(F.unix_seconds(c) + IST_MINUTES * 60)


def ist_string(c: Column | str) -> Column:
    """'YYYY-MM-DDTHH:MM:SS+0530'."""
    return F.concat(F.date_format(ist(c), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0530"))


def ist_parse(c: Column | str) -> Column:
    """The timestamp of such a string; null for anything else."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ssXX"))


def slot_start(ts: Column | str, minutes: Column | int) -> Column:
    """Start of the candle that holds `ts`: slots count from 17:30 local of the local day, also where they do not divide a day."""
    size = (F.lit(minutes) if isinstance(minutes, int) else minutes).cast("bigint") * 60
    t = F.unix_seconds(ts)
    day = F.floor((t + IST_MINUTES * 60) / 86_400) * 86_400 - IST_MINUTES * 60 + 17 * 3600 + 1800
    return F.timestamp_seconds(day + F.floor((t - day) / size) * size)


def with_entry_time(df: DataFrame, ts: str = "entry_ts") -> DataFrame:
    """Local hour, minute, fractional hour, ISO weekday and date of the entry."""
    local = ist(ts)
    return df.withColumns(
        {
            "entry_hour": F.hour(local),
            "entry_minute": F.minute(local),
            "entry_time": F.hour(local) + F.minute(local) / 60,
            "entry_weekday": F.weekday(local) + 1,
            "entry_date": F.to_date(local),
        }
    )
