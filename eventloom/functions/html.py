"""HTML to text where regular expressions cannot: entities."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(T.StringType())
def html_text(s: pd.Series) -> pd.Series:
    """Entities first, then tags, as event descriptions are cleaned (so an escaped tag goes too)."""
    return s.map(lambda x: None if x is None else re.sub(r"<[^>]+>", "", html.unescape(x)).strip())
