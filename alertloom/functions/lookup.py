"""Fixed lookup tables as literal maps: no join, no shuffle, stays inside codegen."""

from itertools import chain

from pyspark.sql import Column, functions as F

from .. import schema as S


def map_values(c: Column, table: dict, default=None) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    found = F.try_element_at(literal, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def phase_stage(phase: Column) -> Column:
    return map_values(phase, S.PHASE_STAGE)


def phase_attack_type(phase: Column) -> Column:
    return map_values(phase, S.PHASE_ATTACK_TYPE)


def label_stage(label: Column, compat: bool = False) -> Column:
    """Stage of a flow label. ``compat`` keeps the published spellings only, which
    leaves every underscore-spelled flood label at "unknown"."""
    if compat:
        return map_values(label, S.LABEL_STAGE, S.UNKNOWN_STAGE)
    table = {k.replace(" ", "_"): v for k, v in (S.LABEL_STAGE | S.LABEL_STAGE_ADDED).items()}
    return map_values(F.replace(label, F.lit(" "), F.lit("_")), table, S.UNKNOWN_STAGE)


def is_mapped_label(label: Column) -> Column:
    known = [k.replace(" ", "_") for k in S.LABEL_STAGE | S.LABEL_STAGE_ADDED]
    return F.replace(label, F.lit(" "), F.lit("_")).isin(known)


def file_day(name: Column) -> Column:
    return map_values(name, S.FLOW_FILE_DAY)


def stage_ordinal(stage: Column) -> Column:
    return map_values(stage, S.STAGE_ORDINAL, S.UNKNOWN_ORDINAL)
