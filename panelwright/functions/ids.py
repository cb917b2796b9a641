"""One spelling for ids that were written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_id(col: Column | str, prefix: str = "MM", digits: int = 9) -> Column:
    """``mm 12345678-9`` → ``MM123456789``: letters and digits only, upper case, digits padded.

    Null, empty and separator-only ids give null.  An id that does not consist of the prefix (or none) and up
    to ``digits`` digits keeps its letters and digits in upper case, so different ids never fall together.
    The common spelling is let through by one anchored match, without rewriting the string.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.upper(F.regexp_replace(c, r"[^0-9A-Za-z]", ""))
    number = F.regexp_extract(bare, rf"^(?:{prefix})?([0-9]{{1,{digits}}})$", 1)
    return (
        F.when(c.rlike(rf"^{prefix}[0-9]{{{digits}}}$"), c)
        .when(number != "", F.concat(F.lit(prefix), F.lpad(number, digits, "0")))
        .when(bare != "", bare)
    )


def canonical_name(col: Column | str) -> Column:
    """``Ask_pile `` → ``askpile``: a source name without case, blanks and separators; empty gives null."""
    c = F.col(col) if isinstance(col, str) else col
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.when(bare != "", bare)


def canonical_id_sql(col: str) -> str:
    """The same spelling rule as DuckDB SQL, for the checks."""
    bare = f"upper(regexp_replace({col}, '[^0-9A-Za-z]', '', 'g'))"
    return (
        f"CASE WHEN regexp_full_match({bare}, '(MM)?[0-9]{{1,9}}') THEN 'MM' || lpad(regexp_replace({bare}, '^MM', ''), 9, '0') "
        f"WHEN {bare} <> '' THEN {bare} END"
    )
