"""The two fixed relations. Columns bind by position; the file's header is skipped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """A column by its name in files and in the engine; `width` is in bytes, None for numbers: 32-bit integers, or 32-bit floats if `real`."""

    header: str
    name: str
    width: int | None = None
    real: bool = False

    @property
    def type(self) -> T.DataType:
        return T.StringType() if self.width is not None else T.FloatType() if self.real else T.IntegerType()


# Names, order and widths of the relations' columns.
CAST_INFO = (
    Field("id", "cast_info_id"),
    Field("person_id", "person_id"),
    Field("movie_id", "movie_id"),
    Field("person_role_id", "person_role_id"),
    Field("note", "note", 100),
    Field("nr_order", "nr_order"),
    Field("role_id", "role_id"),
)
TITLE = (
    Field("id", "title_id"),
    Field("title", "title", 200),
    Field("imdb_index", "imdb_index", 12),
    Field("kind_id", "kind_id"),
    Field("production_year", "production_year"),
    Field("imdb_id", "imdb_id"),
    Field("phonetic_code", "phonetic_code", 5),
    Field("episode_of_id", "episode_of_id"),
    Field("season_nr", "season_nr"),
    Field("episode_nr", "episode_nr"),
    Field("series_years", "series_years", 49),
    Field("md5sum", "md5sum", 32),
)
#: Bytes that the generators count for a row.
ROW_BYTES = {"cast_info": 124, "title": 322}
RELATIONS = {"cast_info": CAST_INFO, "title": TITLE}
RESULT_COLUMNS = [f.name for f in (*TITLE, *CAST_INFO)]


def struct_type(fields: tuple[Field, ...]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.type) for f in fields])
