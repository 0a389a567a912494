"""Search folding: compatibility decomposition, marks removed, lower case, trimmed."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(text: str | None) -> str | None:
    if text is None:
        return None
    if text.isascii():
        return text.lower().strip()
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if unicodedata.category(ch)[0] != "M").lower().strip()


#: White space that ASCII texts are trimmed of.
ASCII_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "

#: Rows go to Python some hundred at a time; an Arrow batch would hold ten thousand whole texts.
_fold_text = F.udf(fold, T.StringType(), useArrow=False)


def folded(x) -> Column:
    """FN13.  Spark has no normalisation function, so texts beyond ASCII go through ``unicodedata``."""
    x = x if isinstance(x, Column) else F.col(x)
    ascii_only = F.octet_length(x) == F.char_length(x)
    return F.when(ascii_only, F.btrim(F.lower(x), F.lit(ASCII_SPACE))).otherwise(_fold_text(F.when(~ascii_only, x)))


def contains_all(folded_text: Column, query: str) -> Column:
    out = F.lit(True)
    for term in fold(query).split():
        out = out & folded_text.contains(term)
    return out
