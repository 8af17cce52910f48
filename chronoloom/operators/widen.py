"""Attribute-value rows into wide typed tables.

The grid of entities and attributes is completed, the values are left-joined to it, each entity's cells are collected into an
array in the order of the attributes' positions, and the array's fixed places become columns through a cast to the type of each.

The cells of an entity are at most one per known attribute, so the join is made inside the entity's row, after one shuffle by group
that brings the versions of a cell together. Where only the presence of values matters, an entity's line of the grid is a set of
bits, one per position: entities are aggregated by hash and written once, the bits of a group are the union of those of its
entities, and what they lack are the empty cells. Defined results: rows with a null key or an unknown attribute are left out; of rows for
one cell the latest counts (ties: a row with a value, then the larger value); a latest row without a value makes the cell empty; an
attribute that never has a value in a group is not among the group's attributes; what a type can't hold is null; an empty input
gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.numbers import is_number, parse_number
from chronoloom.operators.readings import known_readings
from chronoloom.storage import materialize


#: Positions per column of bits.
BITS = 62


def stated_cells(cells: DataFrame, group: list[str], entity: list[str], attribute: str, text: str, value: str, version: str) -> DataFrame:
    """One row per entity: group, entity and found, the cells whose latest version states a value, as structs of name and text, sorted by
    name. cells: one row per version of a cell, with its text and its value, null if the text states none."""
    keys, has = [*group, *entity], F.col(value).isNotNull()
    rank = F.struct(F.col(version), has, F.col(value))
    newest = cells.repartition(*group).groupBy(*keys, attribute).agg(F.max_by(text, rank).alias(text), F.max_by(has, rank).alias("stated"))
    pair = F.when(F.col("stated"), F.struct(F.col(attribute).alias("name"), F.col(text).alias("text")))
    return newest.groupBy(*keys).agg(F.array_sort(F.collect_list(pair)).alias("found"))


def completed(cells: DataFrame, group: list[str], entity: list[str], place: str, value: str, version: str, names: list[str]) -> DataFrame:
    """The completed grid, one row per entity: group, entity, and in columns of bits the places whose latest version states a value
    (found_0, ...) and those that any entity of the group has (wanted_0, ...). cells: one row per version of a cell; names: of the
    attributes, by their places."""
    keys, has = [*group, *entity], F.col(value).isNotNull()
    flags = cells.select(*keys, place, version, has.alias("_has")).repartition(*group).groupBy(*keys, place)
    last = flags.agg(F.max(version).alias("_last"), F.max(F.when(F.col("_has"), F.col(version))).alias("_with"), F.max("_has").alias("_any"))
    stated = F.coalesce(F.col("_with") >= F.col("_last"), F.col("_last").isNull() & F.col("_any"))
    words = range(-(-max(len(names), 1) // BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(place) % BITS)
    mask = lambda w: F.coalesce(F.bit_or(F.when(stated & (F.floor(F.col(place) / BITS) == w), bit)), F.lit(0).cast("long"))
    rows = materialize(last.groupBy(*keys).agg(*(mask(w).alias(f"found_{w}") for w in words)), "cells")
    whole = rows.groupBy(*group).agg(*(F.bit_or(f"found_{w}").alias(f"wanted_{w}") for w in words))
    return rows.join(whole, group)


def empty_cells(grid: DataFrame, names: list[str], attribute: str) -> DataFrame:
    """The cells of the completed grid without a value, one row each: the left join's rows without a partner."""
    marks = [c for c in grid.columns if c.startswith(("found_", "wanted_"))]
    keys = [c for c in grid.columns if c not in marks]
    lacks = [F.col(f"wanted_{w}").bitwiseAND(F.bitwise_not(f"found_{w}")) for w in range(len(marks) // 2)]
    some = grid.withColumns({f"lacks_{w}": c for w, c in enumerate(lacks)}).filter(" or ".join(f"lacks_{w} <> 0" for w in range(len(lacks))) or "false")
    each = [F.when(F.getbit(f"lacks_{k // BITS}", F.lit(k % BITS)) == 1, F.lit(name)) for k, name in enumerate(names)]
    return some.select(*keys, F.explode(F.array_compact(F.array(*each))).alias(attribute)) if names else grid.select(*keys, F.lit("").alias(attribute)).filter("false")


def wide_table(stated: DataFrame, columns: dict[str, str]) -> DataFrame:
    """One row per entity with a column of the given type for each attribute. The entity's line of the grid is the array of all
    attributes in the order of their positions (that of columns); the stated texts are left-joined to it, and fixed places of the
    result are cast to the type of each."""
    keys = [c for c in stated.columns if c not in ("wanted", "found")]
    known = F.map_from_entries("found")
    line = F.transform(F.array(*map(F.lit, columns)), lambda name: F.try_element_at(known, name))
    laid = stated.select(*keys, line.alias("cells")).withColumn("numbers", F.transform("cells", lambda x: parse_number(x)))
    taken = {k.lower() for k in keys}
    named = {name: f"{name}_" if name.lower() in taken else name for name in columns}
    place = lambda i, kind: F.get("numbers" if is_number(kind) else "cells", F.lit(i)).try_cast(kind)
    return laid.select(*keys, *(place(i, kind).alias(named[name]) for i, (name, kind) in enumerate(columns.items())))


def reading_cells(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """The stated cells of EEG readings: entities are (rec_id, trail_num, sample_num), attributes the known sensors."""
    known = known_readings(readings, sensors).select("rec_id", "trail_num", "sample_num", "sensor_pos", "sensor_val", "val", "loaded_at")
    return stated_cells(known, ["rec_id", "trail_num"], ["sample_num"], "sensor_pos", "sensor_val", "val", "loaded_at")


def sensor_list(sensors: DataFrame) -> list[str]:
    """The sensors by their places: the columns of the wide table."""
    return [r[0] for r in sensors.filter("sensor_pos is not null").select("sensor_pos").distinct().orderBy("sensor_pos").collect()]


def empty_readings(readings: DataFrame, sensors: DataFrame) -> DataFrame:
    """rec_id, trail_num, sample_num, sensor_pos of the empty cells of EEG readings; the attributes of a trial are those with a value in it."""
    names = sensor_list(sensors)
    known = known_readings(readings, sensors).select("rec_id", "trail_num", "sample_num", "place", "val", "loaded_at")
    return empty_cells(completed(known, ["rec_id", "trail_num"], ["sample_num"], "place", "val", "loaded_at", names), names, "sensor_pos")
