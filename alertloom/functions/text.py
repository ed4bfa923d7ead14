"""String expressions."""

import re

from pyspark.sql import Column, functions as F


def clean_ip(c: Column) -> Column:
    """Strip leading zeros from every octet; null when an octet is not a number."""
    return F.when(c.rlike(r"^\d+(\.\d+)*$"), F.regexp_replace(c, r"\b0+(?=\d)", ""))


def optional_number(c: Column) -> Column:
    """``-`` and the empty string mean "not applicable"."""
    return F.when(~c.isin("-", ""), c.try_cast("double"))


def multi_marker(n: Column) -> Column:
    return F.format_string("MULTI(n=%d)", n)


def is_multi_marker(c: Column) -> Column:
    return c.startswith("MULTI(n=")


def scenario_source(scenario: Column, prefix: str = "darpa2000_") -> Column:
    short = F.replace(F.lower(scenario), F.lit("lls_ddos_"), F.lit("lldos"))
    return F.concat(F.lit(prefix), short)


def phase_number(name: Column) -> Column:
    return F.regexp_extract(name, r"phase-(\d+)", 1).try_cast("int")


def count_marker(c: Column, marker: str = "<Alert ") -> Column:
    return F.regexp_count(c, F.lit(re.escape(marker))).cast("long")


def seeded_hash(seed: int, *parts: Column) -> Column:
    """Hex digest that orders rows in a repeatable pseudo-random way."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))
