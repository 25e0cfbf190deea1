"""Exact prices: integers of 1/10000, and their text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def price_text(raw: Column) -> Column:
    return (raw.cast("decimal(38,0)") / F.lit(10000).cast("decimal(5,0)")).cast("decimal(19,4)").cast("string")


def parse_price(text: Column) -> Column:
    """Raw price of digits with at most four after a point; null for anything else."""
    whole, part = F.split_part(text, F.lit("."), F.lit(1)), F.split_part(text, F.lit("."), F.lit(2))
    return F.when(text.rlike(r"^[0-9]{1,14}(\.[0-9]{1,4})?$"), F.concat(whole, F.rpad(part, 4, "0")).cast("long"))


def thousands(value: Column) -> Column:
    """A whole number with blanks between groups of three digits."""
    return F.translate(F.format_number(value, 0), ",", " ")
