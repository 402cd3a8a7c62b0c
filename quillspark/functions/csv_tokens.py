"""The CSV dialect as one expression over a line of text.

A quoted field ends at a quote that no quote follows; doubled quotes stay as
they are. What follows a closing quote other than a comma is a new field. An
open quote takes the rest of the line. A last comma adds an empty field, an
empty line has none, and at most 48 fields are read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MOST_FIELDS

_INNER = r'[^"]*+(?:""[^"]*+)*+'
_FIELD = rf'"({_INNER})"?(,?)|([^,"][^,]*+)(,?)|(,)'
#: Put after every field, and before the comma that ended it, if one did.
_MARK = "\x01"
_SPLIT = rf"{_MARK},?"


def _marked(line: Column) -> Column:
    return F.regexp_replace(line, _FIELD, rf"$1$3{_MARK}$2$4$5")


def _split(marked: Column) -> Column:
    """The fields of a marked line. A mark at the end ends the last one; a comma
    after it means that an empty one follows."""
    return F.slice(F.split(F.rtrim(marked, F.lit(_MARK)), _SPLIT), 1, MOST_FIELDS)


def _found(line: Column) -> Column:
    """The same for lines that hold the mark itself, field by field."""
    raw = F.regexp_extract_all(line, F.lit(f"({_FIELD})"), F.lit(1))
    inner = lambda x: F.coalesce(*(F.nullif(F.regexp_extract(x, rf"\A(?:{_FIELD})", i), F.lit("")) for i in (1, 3)), F.lit(""))
    ended = lambda x: F.concat(*(F.regexp_extract(x, rf"\A(?:{_FIELD})\z", i) for i in (2, 4, 5))) == ","

    def fields(r: Column) -> Column:
        more = F.coalesce(ended(F.try_element_at(r, F.lit(-1))), F.lit(False))
        return F.slice(F.concat(F.transform(r, inner), F.when(more, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), 1, MOST_FIELDS)

    return F.transform(F.array(raw), fields)[0]  # raw is evaluated once


def csv_tokens(line: Column) -> Column:
    """One replacement marks where fields end, and one split takes them apart."""
    empty = F.array().cast("array<string>")
    return F.when(line == "", empty).when(F.contains(line, F.lit(_MARK)), _found(line)).otherwise(_split(_marked(line)))
