"""How close two labels are: a sequence ratio, the shared part of the shorter label, and Jaccard."""

from __future__ import annotations

from difflib import SequenceMatcher

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHTS = (0.4, 0.35, 0.25)


def stems(text: Column) -> Column:
    """Distinct words without a plural s (words of more than three letters, not ending in ss)."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), F.regexp_replace(w, "s$", "")).otherwise(w)))


def token_part(a: Column, b: Column) -> Column:
    """The weighted containment and Jaccard of two labels' stems, unrounded; 0 if either has none."""
    x, y = stems(a), stems(b)
    shared, least = F.size(F.array_intersect(x, y)).cast("double"), F.least(F.size(x), F.size(y))
    jaccard = shared / F.size(F.array_union(x, y))
    contained = F.when(least == 1, jaccard).otherwise(shared / least)
    return F.when(least > 0, WEIGHTS[1] * contained + WEIGHTS[2] * jaccard).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a, b):
    """Ratcliff-Obershelp ratio; it has no built-in form and runs on Arrow batches."""
    import pandas as pd

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def similarity(a: Column, b: Column) -> Column:
    """Similarity to 4 digits; 0 if either label is empty, the sequence ratio alone if either has no words."""
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    seq = sequence_ratio(a, b)
    worded = (F.size(stems(a)) > 0) & (F.size(stems(b)) > 0)
    return F.when((a == "") | (b == ""), 0.0).when(worded, F.bround(WEIGHTS[0] * seq + token_part(a, b), 4)).otherwise(F.bround(seq, 4))
