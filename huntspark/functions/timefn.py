"""Source time texts to timestamps. The session clock must be UTC."""
from __future__ import annotations

from pyspark.sql import Column, functions as F


def normalize_timestamp(c: Column, tz: str = "UTC", syslog_year: int = 2024, offset_minutes: int = 0) -> Column:
    """Epoch s or ms, syslog, Apache and ISO texts to one timestamp column.

    An offset in the text wins; naive texts are read in ``tz``. Syslog carries
    no year, so it is a parameter and results do not depend on today's date.
    Anything else is NULL.
    """
    s = F.trim(c.cast("string"))
    number = F.when(s.rlike(r"^[0-9]+(\.[0-9]+)?$"), s).try_cast("double")
    epoch = F.timestamp_micros((F.when(number > 1e12, number / 1000).otherwise(number) * 1_000_000).cast("bigint"))
    local = lambda t: F.to_utc_timestamp(t, tz)
    syslog_text = F.concat(F.lit(f"{syslog_year} "), F.regexp_replace(F.regexp_extract(s, r"^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})", 1), r"\s+", " "))
    syslog = local(F.try_to_timestamp(syslog_text, F.lit("yyyy MMM d HH:mm:ss")))
    apache = F.try_to_timestamp(s, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    iso = F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")
    shaped = s.rlike(r"^\d{4}-\d{2}-\d{2}([ T]|$)")
    has_offset = s.rlike(r"\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})$")
    iso_ts = F.when(shaped, F.when(has_offset, iso.try_cast("timestamp")).otherwise(local(s.try_cast("timestamp"))))
    ts = F.when(number.isNotNull(), epoch).otherwise(F.coalesce(iso_ts, syslog, apache))
    return ts + F.expr(f"INTERVAL '{int(offset_minutes)}' MINUTE") if offset_minutes else ts
