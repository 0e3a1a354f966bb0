"""Plain forms of ids and names that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Decimal digits of scripts that occur beside ASCII ones, each run of ten in order from zero.
_DIGIT_ZEROS = (0x0660, 0x06F0, 0x0966, 0x09E6, 0x0E50, 0xFF10)
_FOREIGN = "".join(chr(z + k) for z in _DIGIT_ZEROS for k in range(10))
_ASCII = "0123456789" * len(_DIGIT_ZEROS)


def plain_form(written: Column) -> Column:
    """Letters in lower case, then the number without leading zeros; null where there is neither.

    All other characters count for nothing, so ``(Aud-0012)`` and ``AUD_12`` agree. A null id gives
    null. Stays inside whole-stage code generation.
    """
    text = F.translate(written, _FOREIGN, _ASCII)
    letters = F.lower(F.regexp_replace(text, r"\P{L}+", ""))
    digits = F.regexp_replace(F.regexp_replace(text, r"[^0-9]+", ""), r"^0+(?=[0-9])", "")
    whole = F.concat(letters, digits)
    return F.when(F.length(whole) > 0, whole)
