"""What a reader sees: words for the enumerations, dates, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words shown.
MISSING = "Brak danych"
TYPES = {"Tv": "Serial TV", "Movie": "Film", "Ova": "OVA", "Ona": "ONA", "Special": "Odcinek specjalny", "Unknown": "Nieznany typ"}
STATUSES = {"Finished": "Zakończone", "Ongoing": "Emitowane", "Upcoming": "Zapowiedziane", "Unknown": "Nieznany status"}
SEASONS = {"Winter": "Zima", "Spring": "Wiosna", "Summer": "Lato", "Fall": "Jesień", "Undefined": "Nieznany sezon"}
WATCH = {"Dropped": "Porzucone", "Completed": "Obejrzane", "Watching": "Oglądane", "OnHold": "Wstrzymane", "PlanToWatch": "W planach"}
MONTHS = ("sty", "lut", "mar", "kwi", "maj", "cze", "lip", "sie", "wrz", "paź", "lis", "gru")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word(c: Column | str, table: dict[str, str]) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), _col(c)), F.lit(MISSING))


def premiere_year(date: Column | str) -> Column:
    return F.coalesce(F.year(_col(date)).cast("string"), F.lit("Nieznany rok"))


def premiere_date(date: Column | str) -> Column:
    d = _col(date)
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.coalesce(F.month(d), F.lit(1)))
    return F.when(d.isNull(), "Nieznana data").otherwise(F.concat(F.date_format(d, "yyyy"), F.lit(", "), F.day(d).cast("string"), F.lit(" "), month))


def year(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(MISSING))


def episode_count(c: Column | str) -> Column:
    return F.when(_col(c) > 0, _col(c).cast("string")).otherwise("Brak")


def duration(seconds: Column | str) -> Column:
    return F.when(_col(seconds) > 0, F.concat(F.ceil(_col(seconds) / 60).cast("string"), F.lit(" min"))).otherwise(MISSING)
