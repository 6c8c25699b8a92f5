"""Text in visual order back to logical order, in Arrow batches."""

from __future__ import annotations

import unicodedata
from itertools import groupby

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: What the two ligatures of lam with a marked alef become once they are decomposed and reversed (left),
#: and the letters in their order (right): lam with alef and hamza below, lam with alef and madda.
LIGATURES = {"اإل": "الإ", "اآل": "الآ"}


def _runs_right_to_left(ch: str) -> bool:
    return ch.isspace() or unicodedata.bidirectional(ch) in {"R", "AL"}


def in_logical_order(text: str | None) -> str | None:
    """Presentation forms as letters, runs of right-to-left letters and blanks reversed; digits and the rest stay in place."""
    if text is None:
        return None
    out = []
    for reverse, run in groupby(unicodedata.normalize("NFKC", text), _runs_right_to_left):
        part = "".join(run)
        if reverse:
            part = part[::-1]
            for seen, meant in LIGATURES.items():
                part = part.replace(seen, meant)
        out.append(part)
    return "".join(out)


@pandas_udf(StringType())
def logical_order(text: pd.Series) -> pd.Series:
    """``in_logical_order`` of each; null stays null. No built-in function has the compatibility form (NFKC)."""
    return text.map(in_logical_order, na_action="ignore")
