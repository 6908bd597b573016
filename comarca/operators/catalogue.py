"""The catalogue of sheet indicators: building, ordering, looking up and comparing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import (
    CATALOGUE_FIELDS, NON_INDICATOR_COLUMNS, SPECIAL_EXPRESSIONS,
)

_LAST_BLOCK = 99


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def catalogue_rows(source: DataFrame) -> DataFrame:
    """Catalogue rows from the published dictionary of sheet columns.

    Identifying and geographic columns are no indicators.  Boolean indicators get their
    counting expression; every other indicator is its own column.
    """
    fields = ["tabla", "variable", "etiqueta", "bloque", "bloque_etiqueta", "tipo",
              "denominador", "tema", "tema_etiqueta"]
    rows = source.select(*[_text(f).alias(f) for f in fields],
                         F.col("bloque_orden").cast("int").alias("bloque_orden"))
    rows = rows.filter(~F.col("variable").isin(*NON_INDICATOR_COLUMNS))
    expr, den = F.col("variable"), F.col("denominador")
    for name, (special, special_den) in SPECIAL_EXPRESSIONS.items():
        expr = F.when(F.col("variable") == name, F.lit(special)).otherwise(expr)
        den = F.when(F.col("variable") == name, F.lit(special_den)).otherwise(den)
    table = (F.when(F.col("tabla") == "ficha", F.lit("fichas"))
             .when(F.col("tabla") == "unidad", F.lit("unidades"))
             .otherwise(F.col("tabla")))
    return rows.withColumns({
        "expr": expr, "denominador": den, "tabla": table,
        "tipo": F.when(F.col("tipo") == "", "numerica").otherwise(F.col("tipo"))})


def derive_pair_rows(rows: DataFrame) -> DataFrame:
    """Both-sex rows for every complete ``_h``/``_m`` pair.

    Label without the sex, expression the sum of the two, denominator the summed pair
    of the one the ``_h`` row declares.
    """
    base = F.regexp_replace("variable", "_[hm]$", "")
    halves = rows.filter(F.col("variable").rlike("_[hm]$")).withColumn("base", base)
    h_row = F.struct(*[c for c in rows.columns])
    pairs = halves.groupBy("tabla", "base").agg(
        F.max(F.when(F.col("variable").endswith("_h"), h_row)).alias("h"),
        F.max(F.col("variable").endswith("_m")).alias("has_m"))
    pairs = pairs.filter(F.col("h").isNotNull() & F.col("has_m"))
    out = pairs.select("h.*", F.col("base").alias("_base"))
    den = F.col("denominador")
    stem = F.regexp_replace(den, "_h$", "")
    return out.withColumns({
        "variable": F.col("_base"),
        "etiqueta": F.trim(F.regexp_replace("etiqueta", ",[^,]*$", "")),
        "expr": F.concat(F.lit("("), "_base", F.lit("_h + "), "_base", F.lit("_m)")),
        "denominador": F.when(den.endswith("_h"), F.concat(
            F.lit("("), den, F.lit(" + "), stem, F.lit("_m)"))).otherwise(den),
    }).drop("_base").select(*rows.columns)


def catalogue_sort_keys(block_order: str = "bloque_orden") -> dict[str, Column]:
    """Block order, table, base variable, and both sexes before ``_h`` before ``_m``."""
    v = F.col("variable")
    return {"bloque_orden": F.coalesce(F.col(block_order), F.lit(_LAST_BLOCK)),
            "tabla": F.col("tabla"), "base": F.regexp_replace(v, "_[hm]$", ""),
            "sexo": F.when(v.endswith("_h"), 1).when(v.endswith("_m"), 2).otherwise(0)}


def build_catalogue(source: DataFrame) -> DataFrame:
    """The whole catalogue, in selector order, from the published dictionary."""
    rows = catalogue_rows(source)
    everything = rows.unionByName(derive_pair_rows(rows))
    blocks = (rows.filter("bloque <> ''").groupBy(F.col("bloque").alias("_bloque"))
              .agg(F.coalesce(F.min("bloque_orden"), F.lit(_LAST_BLOCK)).alias("_orden")))
    ordered = everything.join(blocks, F.col("bloque") == F.col("_bloque"), "left")
    return (ordered.orderBy(*catalogue_sort_keys("_orden").values())
            .select(*CATALOGUE_FIELDS))


def describe_catalogue(catalogue: DataFrame) -> DataFrame:
    """Catalogue rows with a block label that is never empty and the measures allowed."""
    label = F.when(_text("bloque_etiqueta") != "", _text("bloque_etiqueta")).otherwise(
        _text("bloque"))
    return catalogue.withColumns({
        "bloque_etiqueta": label,
        "expr": F.when(_text("expr") != "", F.col("expr")).otherwise(F.col("variable")),
        "tiene_porcentaje": _text("denominador") != ""})


def find_indicator(catalogue: DataFrame, table: str, variable: str) -> DataFrame:
    """The catalogue row of a variable (no row when it is not there)."""
    return describe_catalogue(catalogue).filter(
        (F.col("tabla") == table) & (F.col("variable") == variable))


def catalogue_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(tabla, variable, cambio): added, removed, or changed expression or denominator."""
    keys = ["tabla", "variable"]
    side = lambda df, tag: df.select(*keys, _text("expr").alias(f"expr_{tag}"),
                                     _text("denominador").alias(f"den_{tag}"),
                                     F.lit(True).alias(f"in_{tag}"))
    both = side(before, "antes").join(side(after, "ahora"), keys, "full_outer")
    changed = ((F.col("expr_antes") != F.col("expr_ahora"))
               | (F.col("den_antes") != F.col("den_ahora")))
    kind = (F.when(F.col("in_antes").isNull(), "nueva")
            .when(F.col("in_ahora").isNull(), "eliminada")
            .when(changed, "cambiada"))
    return both.select(*keys, kind.alias("cambio")).filter("cambio IS NOT NULL")
