"""Unit conversion driven by a registry of affine rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellweave.constants import CONVERSIONS


def _rule(registry, variable: str, target_unit: str):
    for name, target, source, scale, offset in registry:
        if (name, target) == (variable, target_unit):
            return source, scale, offset
    return None


def affine(value: Column, scale: float, offset: float) -> Column:
    """``value * scale + offset``, leaving out what does nothing so that no rounding is added."""
    if scale != 1.0:
        value = value * scale
    if offset != 0.0:
        value = value + offset
    return value


def convert_cells(cells: DataFrame, variable: str, target_unit: str, registry=CONVERSIONS) -> DataFrame:
    """Convert one variable and leave the others as they are; no join, no shuffle.

    ``cells`` may carry ``units``; then only rows whose unit holds the expected one are converted.
    """
    rule = _rule(registry, variable, target_unit)
    if rule is None:
        raise ValueError(f"no conversion defined for {variable} to {target_unit}")
    source, scale, offset = rule
    hit = F.col("variable") == variable
    if "units" in cells.columns:
        hit = hit & F.coalesce(F.trim("units").contains(source), F.lit(False))
    changed = {"value": F.when(hit, affine(F.col("value"), scale, offset)).otherwise(F.col("value"))}
    if "units" in cells.columns:
        changed["units"] = F.when(hit, F.lit(target_unit)).otherwise(F.col("units"))
    return cells.withColumns(changed)


def rules_table(spark: SparkSession, registry=CONVERSIONS) -> DataFrame:
    """A registry as a table of rules."""
    return spark.createDataFrame(
        [tuple(r) for r in registry],
        "variable string, target_unit string, source_unit string, scale double, offset double",
    )


def convert_all(cells: DataFrame, registry=CONVERSIONS) -> DataFrame:
    """Convert every variable by its first rule; sets ``units`` and the note ``unit_conversion``."""
    first = {}
    for rule in registry:
        first.setdefault(rule[0], rule)
    rules = rules_table(cells.sparkSession, first.values())
    return _by_rules(cells, rules, [F.col("variable") == F.col("_variable")])


def convert_lookup(cells: DataFrame, conversions: DataFrame, target_unit: str | None = None) -> DataFrame:
    """The same with rules of any number: ``(variable, target_unit, source_unit, scale, offset)``.

    A variable may have rules to several units. ``target_unit`` names the wanted one, or else the
    column ``target_unit`` of ``cells`` does, row by row. One rule per variable and target. The join
    is left unhinted: the optimizer broadcasts the rules only if their measured size allows it.
    """
    if target_unit is not None:
        return _by_rules(cells, conversions.where(F.col("target_unit") == target_unit), [F.col("variable") == F.col("_variable")])
    return _by_rules(cells, conversions, [F.col("variable") == F.col("_variable"), F.col("target_unit") == F.col("_target")])


def _by_rules(cells: DataFrame, rules: DataFrame, on: list[Column]) -> DataFrame:
    """Rows with a rule are converted if their stored unit, where there is one, holds the rule's source unit."""
    rules = rules.select(
        F.col("variable").alias("_variable"), F.col("target_unit").alias("_target"), F.col("source_unit").alias("_source"), "scale", "offset"
    )
    stored = F.col("units") if "units" in cells.columns else F.lit(None).cast("string")
    hit = F.col("_variable").isNotNull()
    if "units" in cells.columns:
        hit = hit & F.coalesce(F.trim("units").contains(F.col("_source")), F.lit(False))
    return cells.join(rules, on, "left").select(
        *[c for c in cells.columns if c not in ("value", "units", "unit_conversion")],
        F.when(hit, F.col("value") * F.col("scale") + F.col("offset")).otherwise(F.col("value")).alias("value"),
        F.when(hit, F.col("_target")).otherwise(stored).alias("units"),
        F.when(hit, F.concat(F.lit("From "), F.col("_source"), F.lit(" to "), F.col("_target"))).alias("unit_conversion"),
    )


def convert_status(files: DataFrame, grid_vars: DataFrame, variable: str, target_unit: str, registry=CONVERSIONS) -> DataFrame:
    """Per file ``(file_id, ok, message)``: rule known, variable present, source unit as expected."""
    rule = _rule(registry, variable, target_unit)
    if rule is None:
        message = F.lit(f"No conversion defined for {variable} to {target_unit}")
        return files.select("file_id", F.lit(False).alias("ok"), message.alias("message"))
    source = rule[0]
    found = (
        grid_vars.where(F.col("var_name") == variable)
        .groupBy("file_id")
        .agg(F.min_by(F.trim(F.coalesce("units", F.lit(""))), "var_pos").alias("found"))
    )
    message = (
        F.when(F.col("found").isNull(), F.lit(f"Variable '{variable}' not found"))
        .when(
            ~F.col("found").contains(source),
            F.concat(F.lit(f"Unit mismatch: Expected {source}, found "), F.col("found")),
        )
    )
    return (
        files.select("file_id")
        .join(found, "file_id", "left")
        .select("file_id", message.isNull().alias("ok"), F.coalesce(message, F.lit("ok")).alias("message"))
    )


def convert_vars(grid_vars: DataFrame, variable: str, target_unit: str, registry=CONVERSIONS) -> DataFrame:
    """The variable table after a conversion: new unit, and the file note in ``attrs``.

    A variable whose unit is not the expected one stays as it is, as ``convert_status`` reports.
    """
    rule = _rule(registry, variable, target_unit)
    if rule is None:
        raise ValueError(f"no conversion defined for {variable} to {target_unit}")
    hit = (F.col("var_name") == variable) & F.coalesce(F.trim("units").contains(rule[0]), F.lit(False))
    note = F.create_map(
        F.lit("unit_conversion"), F.concat(F.lit("From "), F.trim("units"), F.lit(f" to {target_unit}"))
    )
    base = F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, _: k != "unit_conversion")
    return grid_vars.withColumns(
        {
            "units": F.when(hit, F.lit(target_unit)).otherwise(F.col("units")),
            "attrs": F.when(hit, F.map_concat(base, note)).otherwise(F.col("attrs")),
        }
    )
