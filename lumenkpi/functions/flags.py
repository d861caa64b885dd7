"""Per-row checks: nulls and sentinels, valid ranges, clean records."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput

#: Texts that stand for no value, trimmed and in any case.
NULL_TEXTS = ("", "null", "none", "n/a", "na")


def null_reason(value: str, kind: str, sentinels: Iterable[object] = ()) -> Column:
    """``null_value``, ``sentinel_value`` or null for a column of type ``kind`` ("double" or "string").

    A text sentinel matches in any case; a number matches by value, also where the column holds texts.
    """
    c = F.col(value)
    numbers = [float(x) for x in sentinels if isinstance(x, (int, float)) and not isinstance(x, bool)]
    texts = [str(x).strip().lower() for x in sentinels if isinstance(x, str)]
    if kind == "string":
        text = F.lower(F.trim(c))
        number = F.expr(f"try_cast({value} AS double)")
        missing = c.isNull() | text.isin(*NULL_TEXTS) | F.coalesce(F.isnan(number), F.lit(False))
        is_text = text.isin(*texts) if texts else F.lit(False)
    else:
        number, is_text = c.cast("double"), F.lit(False)
        missing = c.isNull() | F.isnan(number)
        numbers += [float(t) for t in texts if _number(t)]
    is_number = F.coalesce(number.isin(*numbers), F.lit(False)) if numbers else F.lit(False)
    return F.when(missing, F.lit("null_value")).when(is_text | is_number, F.lit("sentinel_value"))


def _number(text: str) -> bool:
    try:
        return math.isfinite(float(text))
    except ValueError:
        return False


def range_reason(value: Column | str, valid_min: Column | float | None, valid_max: Column | float | None) -> Column:
    """``below_valid_min``, ``above_valid_max`` or null; bounds are inclusive and may be missing."""
    if isinstance(valid_min, (int, float)) and isinstance(valid_max, (int, float)) and valid_min > valid_max:
        raise InvalidInput("valid_min is above valid_max", valid_min=valid_min, valid_max=valid_max)
    v = F.col(value) if isinstance(value, str) else value
    low = valid_min if isinstance(valid_min, Column) else F.lit(valid_min).cast("double")
    high = valid_max if isinstance(valid_max, Column) else F.lit(valid_max).cast("double")
    return F.when(v < low, F.lit("below_valid_min")).when(v > high, F.lit("above_valid_max"))


def is_clean(is_noise: str = "is_noise", quality_flag: str = "quality_flag") -> Column:
    """Not marked as noise and flagged ``good``; a null flag is not clean."""
    good = F.lower(F.trim(F.col(quality_flag))) == "good"
    return F.coalesce(~F.coalesce(F.col(is_noise), F.lit(False)) & good, F.lit(False))
