"""Schemas of catalogs, queries, records and predictions; nothing is inferred."""

CATALOG = (
    "id long, idMal long, title struct<romaji:string,english:string,native:string>, format string, status string, episodes int, "
    "year int, startDate struct<year:int,month:int,day:int>, seasonYear int, genres array<string>, "
    "tags array<struct<name:string,rank:int>>, averageScore int, popularity long, isAdult boolean"
)
SET = "struct<all_of:array<string>,any_of:array<string>,none_of:array<string>>"
RANGE = "struct<min:int,max:int>"
QUERY = (
    f"hard_constraints struct<genres:{SET},tags:{SET},year:{RANGE},episodes:{RANGE},formats:array<string>,status:array<string>>, "
    "reference_titles array<string>, soft_preferences array<string>, unresolved_preferences array<string>"
)


def nested(ddl: str) -> str:
    """Columns as the fields of a struct."""
    return ddl.replace(", ", ",").replace(" ", ":")


#: A page as a media service gives it.
PAGE = f"schedule int, page int, data struct<Page:struct<pageInfo:struct<hasNextPage:boolean>,media:array<struct<{nested(CATALOG)}>>>>"
