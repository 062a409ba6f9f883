"""Schemas, enumerations and integer codes of the linkage tables."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


# The enumerations' members and wire codes.
SEASONS = {"Winter": 1, "Spring": 2, "Summer": 3, "Fall": 4, "Undefined": 5}
TYPES = {"Tv": 1, "Movie": 2, "Ova": 3, "Ona": 4, "Special": 5, "Unknown": 6}
STATUSES = {"Finished": 1, "Ongoing": 2, "Upcoming": 3, "Unknown": 4}
WATCH = {"Dropped": 1, "Completed": 2, "Watching": 3, "OnHold": 4, "PlanToWatch": 5}
PROVIDERS = {"a": 1, "b": 2, "c": 3}

#: One line of the catalogue file, as written.
RAW_ENTRY = _row(
    sources=T.ArrayType(S), title=S, type=S, episodes=I, status=S, animeSeason=_row(season=S, year=I), picture=S, thumbnail=S,
    duration=_row(value=I), synonyms=T.ArrayType(S), studios=T.ArrayType(S), producers=T.ArrayType(S), relatedAnime=T.ArrayType(S), tags=T.ArrayType(S),
)
RAW_HEADER = _row(lastUpdate=S, data=T.ArrayType(RAW_ENTRY))

TITLE_META = _row(season=D, part=D, episode=D, tokens=T.ArrayType(_row(kind=S, num=D, keyword=S)))
CONSOLIDATED = _row(season=D, part=D, episode=D, is_final_season=B, is_final_part=B, is_final_episode=B)

#: A watch list's rows, whatever site they come from; has_* say whether the site knows the attribute at all.
SOURCE = _row(
    list_pos=L, id=T.DecimalType(20, 0), provider=S, title=S, has_date=B, date=T.DateType(), has_year=B, year=I, has_type=B, anime_type=S, has_status=B,
    status=S, has_episodes=B, episodes=I, watch_status=S, watched_episodes=I, score=I, finish_date=T.DateType(), note=S, mal_id=L, source_url=S, section=S,
)

#: Source A: items in the JSON envelope. Mixed types are read as text and cast.
A_ITEM = _row(
    titleId=L, watchStatus=S, isFavourite=S, title=S, coverId=L, premiereDate=S, finishDate=S, titleStatus=S, episodes=I, animeType=S,
    watchedEpisodesCnt=S, rateTotal=I, userNote=S, descriptionPl=S,
)
A_ENVELOPE = _row(success=S, message=S, result=_row(items=T.ArrayType(A_ITEM)))
