"""Dictionaries: variables, themes, universes, value labels and documentation.

Dictionaries are small in a census, but nothing here depends on that: lookups are
joins and choices between candidate rows are aggregates (first or last by a priority),
never per-group lists or windows over a whole variable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import (
    DESCRIPTION_COLUMNS, DOC_FIELDS, DOC_TABLES, ENTITY_COLUMNS, LABEL_CODE_COLUMNS,
    LABEL_TEXT_COLUMNS, LABEL_VARIABLE_COLUMNS, LEGAL_MEASURES, SEMANTIC_TYPES,
    SHEET_VALUE_LABELS, TABLE_ENTITIES, THEME_COLUMNS, THEME_LABEL_COLUMNS,
    TYPE_COLUMNS, UNIVERSE_COLUMNS, VARIABLE_COLUMNS,
)
from comarca.functions.codes import category_order, normalize_code
from comarca.functions.text import code_with_label, first_upper, squeeze, universe_text
from comarca.operators.measures import distinct_values
from comarca.sources.tables import resolve_columns


def _of_table(table: str | None) -> Column | None:
    """Whether a dictionary row belongs to the table, by its entity column."""
    entities = TABLE_ENTITIES.get(table or "")
    if not entities:
        return None
    return F.coalesce(F.upper(F.col("entidad")).isin(*entities), F.lit(False))


def _clean(col: Column) -> Column:
    text = F.trim(col.cast("string"))
    return F.when((text != "") & ~F.lower(text).isin("nan", "none"), text)


def variable_dictionary(raw: DataFrame, table: str | None = None,
                        order: Column | None = None) -> DataFrame:
    """(variable, label, tipo, universo, tema, tema_etiqueta) of one table.

    Column names vary by year and are found by candidates.  Rows of the table's
    entities, or all rows when none matches.  One row per variable: the last by
    ``order``, and among equals (or without an order) the greatest in its texts.
    """
    rows = resolve_columns(raw.withColumn("_ord", F.lit(0) if order is None else order), {
        "variable": VARIABLE_COLUMNS, "label": DESCRIPTION_COLUMNS, "tipo": TYPE_COLUMNS,
        "universo": UNIVERSE_COLUMNS, "tema": THEME_COLUMNS,
        "tema_etiqueta": THEME_LABEL_COLUMNS, "entidad": ENTITY_COLUMNS, "ord": ("_ord",)},
        required=["variable"])
    belongs = _of_table(table)
    if belongs is not None:
        some = rows.agg(F.coalesce(F.max(belongs), F.lit(False)).alias("any")).scalar()
        rows = rows.filter(belongs | ~some)
    entries = rows.select(
        "ord", F.trim(F.col("variable").cast("string")).alias("variable"),
        F.trim(F.col("label").cast("string")).alias("label"),
        F.lower(F.trim(F.col("tipo").cast("string"))).alias("tipo"),
        _clean(F.col("universo")).alias("universo"), _clean(F.col("tema")).alias("tema"),
        _clean(F.col("tema_etiqueta")).alias("tema_etiqueta"))
    texts = [c for c in entries.columns if c not in ("ord", "variable")]
    return (entries.groupBy("variable").agg(F.max(F.struct("ord", *texts)).alias("last"))
            .select("variable", *[f"last.{c}" for c in texts]))


def catalogue_as_dictionary(catalogue: DataFrame, table: str) -> DataFrame:
    """The dictionary of a sheet table: its indicators are described by the catalogue."""
    return catalogue.filter(F.col("tabla") == table).select(
        "variable", F.col("etiqueta").alias("label"), "tipo",
        F.lit(None).cast("string").alias("universo"),
        _clean(F.col("tema")).alias("tema"),
        _clean(F.col("tema_etiqueta")).alias("tema_etiqueta"))


def descriptions(dictionary: DataFrame) -> DataFrame:
    """(variable, label) of the described variables."""
    return dictionary.filter("label <> ''").select("variable", "label")


def types(dictionary: DataFrame) -> DataFrame:
    """(variable, tipo) of the variables with a declared type."""
    return dictionary.filter("tipo <> ''").select("variable", "tipo")


def universes(dictionary: DataFrame) -> DataFrame:
    """(variable, universo) in words: who was asked each question."""
    return (dictionary.select("variable", universe_text(F.col("universo")).alias("universo"))
            .filter("universo IS NOT NULL"))


def themes(dictionary: DataFrame) -> DataFrame:
    """(variable, tema, tema_etiqueta), the label made from the slug when missing."""
    fallback = first_upper(F.translate(F.col("tema"), "_", " "))
    return (dictionary.filter("tema IS NOT NULL")
            .select("variable", "tema",
                    F.coalesce(F.col("tema_etiqueta"), fallback).alias("tema_etiqueta")))


def theme_counts(dictionary: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(tema, tema_etiqueta, n): themes with at least one visible variable, by label."""
    rows = themes(dictionary)
    if columns is not None:
        rows = rows.filter(F.col("variable").isin(*columns))
    return (rows.groupBy("tema").agg(F.max("tema_etiqueta").alias("tema_etiqueta"),
                                     F.count(F.lit(1)).alias("n"))
            .orderBy("tema_etiqueta", "tema"))


def legal_measures(dictionary: DataFrame) -> DataFrame:
    """(variable, medida): the measures that may be asked of each variable by its type."""
    by_type = F.create_map(*[x for declared, kind in SEMANTIC_TYPES.items()
                             for x in (F.lit(declared), F.array(*map(F.lit, LEGAL_MEASURES[kind])))])
    unknown = F.array(*map(F.lit, LEGAL_MEASURES["unknown"]))
    return dictionary.select("variable", F.explode(F.coalesce(
        by_type[F.lower(F.trim(F.coalesce("tipo", F.lit(""))))], unknown)).alias("medida"))


def value_labels(raw: DataFrame, table: str | None = None, variable: str | None = None, *,
                 order: Column) -> DataFrame:
    """(variable, valor, etiqueta), variable in lower case.

    Labels of the table's own entity where the variable has any, else all of its
    labels.  Of several rows for one code the last one counts, by ``order``: a column
    of the table, as the order in which rows are read can differ from run to run.
    """
    raw = raw.withColumn("_ord", order)
    rows = resolve_columns(raw, {
        "variable": LABEL_VARIABLE_COLUMNS, "valor": LABEL_CODE_COLUMNS,
        "etiqueta": LABEL_TEXT_COLUMNS, "entidad": ENTITY_COLUMNS, "ord": ("_ord",)},
        required=["variable", "valor", "etiqueta"])
    rows = rows.withColumns({"variable": F.lower(F.col("variable").cast("string")),
                             "valor": F.col("valor").cast("string"),
                             "etiqueta": F.col("etiqueta").cast("string")})
    if variable is not None:
        rows = rows.filter(F.col("variable") == variable.lower())
    belongs = _of_table(table)
    if belongs is None:
        belongs = F.lit(False)
    entry = F.struct("ord", "etiqueta")
    per_code = rows.groupBy("variable", "valor").agg(
        F.max(F.when(belongs, entry)).alias("own"), F.max(entry).alias("any"))
    has_own = (per_code.groupBy(F.col("variable").alias("_v"))
               .agg(F.max(F.col("own").isNotNull()).alias("has_own")))
    picked = F.when(F.col("has_own"), F.col("own.etiqueta")).otherwise(F.col("any.etiqueta"))
    return (per_code.join(has_own, F.col("variable") == F.col("_v"))
            .filter(~F.col("has_own") | F.col("own").isNotNull())
            .select("variable", "valor", picked.alias("etiqueta")))


def sheet_value_labels(like: DataFrame, variable: str) -> DataFrame:
    """Labels of the two sheet columns with a domain of their own."""
    pairs = list(SHEET_VALUE_LABELS.get(variable, {}).items())
    return like.sparkSession.createDataFrame(
        [(variable, k, v) for k, v in pairs],
        "variable string, valor string, etiqueta string")


def with_value_labels(df: DataFrame, column: str, labels: DataFrame,
                      order: str = "valor") -> DataFrame:
    """Add ``etiqueta`` and ``texto`` ("code — label") by the normalised code.

    ``labels``: (valor, etiqueta) of one variable.  Of codes that are equal once
    normalised ('1', '01') the last counts by ``order``, a column of the labels.
    Unmatched codes show themselves.
    """
    keyed = (labels.select(normalize_code(F.col("valor")).alias("_code"), "etiqueta",
                           F.struct(F.col(order).alias("o"), "valor").alias("last"))
             .groupBy("_code").agg(F.max_by("etiqueta", "last").alias("etiqueta")))
    code = normalize_code(F.col(column))
    return (df.join(keyed, code == F.col("_code"), "left").drop("_code")
            .withColumn("texto", code_with_label(F.col(column), F.col("etiqueta"))))


def category_list(df: DataFrame, variable: str, labels: DataFrame,
                  limit: int | None = None) -> DataFrame:
    """(valor, texto) to choose a category from, numeric codes first.

    The labels of the variable; without any, its distinct values (the first ``limit``,
    if given).
    """
    known = labels.filter(F.col("variable") == variable.lower()).select(
        "valor", code_with_label(F.col("valor"), F.col("etiqueta")).alias("texto"))
    n_known = known.agg(F.count(F.lit(1)).alias("n")).scalar()
    found = (distinct_values(df, variable, limit).filter(n_known == 0)
             .select("valor", F.col("valor").alias("texto")))
    return known.unionByName(found).orderBy(*category_order(F.col("valor")))


# --- documentation of questions --------------------------------------------------

_DOC_TEXTS = DOC_FIELDS[3:]


def clean_docs(docs: DataFrame) -> DataFrame:
    """Documentation with single blanks and no NULL texts."""
    texts = {c: F.coalesce(squeeze(F.col(c)), F.lit("")) for c in _DOC_TEXTS}
    return docs.select(*DOC_FIELDS).withColumns(texts)


def in_key_order(docs: DataFrame) -> DataFrame:
    """Documentation in the order it is published in (a sort: only for writing)."""
    return docs.orderBy("anio", "tabla", "variable")


def duplicate_doc_keys(docs: DataFrame) -> DataFrame:
    """(anio, tabla, variable, n) of keys documented more than once."""
    return (docs.groupBy("anio", "tabla", "variable").agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))


def require_unique_docs(docs: DataFrame) -> None:
    """Raise when a key is documented twice (looks at one duplicate, not at the rows)."""
    found = duplicate_doc_keys(docs).head(1)
    if found:
        raise ValueError(f"duplicate documentation for {tuple(found[0])[:3]}")


def find_docs(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documentation of the wanted (anio, tabla, variable), tables under their own names.

    A table's documentation names are tried in order, then any other table of the
    year.  Returns the wanted key, ``doc_tabla`` and the documentation.
    """
    rank = F.lit(len(max(DOC_TABLES.values(), key=len)))
    for table, names in DOC_TABLES.items():
        for i, name in enumerate(names):
            rank = F.when((F.col("w.tabla") == table) & (F.col("d.tabla") == name),
                          i).otherwise(rank)
    pairs = wanted.alias("w").join(
        docs.alias("d"), (F.col("w.anio") == F.col("d.anio"))
        & (F.col("w.variable") == F.col("d.variable")))
    best = F.min(F.struct(rank.alias("rank"), F.col("d.tabla").alias("doc_tabla"),
                          *[F.col(f"d.{c}").alias(c) for c in _DOC_TEXTS]))
    return (pairs.groupBy("w.anio", "w.tabla", "w.variable").agg(best.alias("best"))
            .select("anio", "tabla", "variable", "best.doc_tabla",
                    *[f"best.{c}" for c in _DOC_TEXTS]))
