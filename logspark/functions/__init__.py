"""Column functions: normalisers, levels, time stamps, predicates, line features."""

from .levels import canonical_level, fold_level, light_level
from .normalize import normalize, normalize_extended
from .predicates import CONTENT_ERROR, ERROR_LEVELS, in_time_range, is_content_error, is_error_level
from .timestamps import parse_timestamp, time_bucket

__all__ = [
    "CONTENT_ERROR", "ERROR_LEVELS", "canonical_level", "fold_level", "in_time_range", "is_content_error",
    "is_error_level", "light_level", "normalize", "normalize_extended", "parse_timestamp", "register", "time_bucket",
]


def register(spark) -> None:
    """SQL names for the normalisers and the level folding, as Arrow UDFs of their Python forms."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    from ..session import ship
    from . import python_forms

    ship(spark)
    for name, form in (("log_normalize", python_forms.normalize), ("log_normalize_ext", python_forms.normalize_extended), ("log_level", python_forms.fold_level)):

        def run(s: pd.Series, form=form) -> pd.Series:
            return s.map(form, na_action="ignore")

        spark.udf.register(name, pandas_udf(lambda s, run=run: run(s), "string"))
