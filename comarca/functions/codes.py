"""Column expressions for codes: casting, padding, comparing and ordering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# What a code may carry around it: every character a text strip removes.
BLANKS = " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0"

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def int_code(df: DataFrame, name: str, as_type: str = "int") -> Column:
    """The column as an integer code, NULL where it is not one.

    An integral column is returned as it is, so that a comparison with a literal
    reaches the Parquet reader as a pushed filter; text goes through ``try_cast``.
    """
    if isinstance(df.schema[name].dataType, _INTEGRAL):
        return F.col(f"`{name}`")
    return F.col(f"`{name}`").try_cast(as_type)


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE, NULL where the text is not a number."""
    if isinstance(df.schema[name].dataType, T.DoubleType):
        return F.col(f"`{name}`")
    return F.col(f"`{name}`").try_cast("double")


def pad2(col: Column) -> Column:
    """A territory part as at least two characters; of a longer one only extra zeros go."""
    text = col.cast("string")
    return (F.when(F.length(text) < 2, F.lpad(text, 2, "0")).when(F.length(text) == 2, text)
            .otherwise(F.regexp_replace(text, r"^0+(?=\d\d)", "")))


#: Between the parts of a code of which one is longer than two characters.
BORDER = "-"


def joined_parts(parts: list[Column]) -> Column:
    """One code of the parts of a territory, NULL where a part is.

    Parts of two characters stand without a border; if one is longer, borders keep
    (1, 12, 345) and (1, 123, 45) apart.
    """
    padded = [pad2(p) for p in parts]
    if len(padded) == 1:
        return padded[0]
    bordered = F.concat(*[x for p in padded for x in (F.lit(BORDER), p)][1:])
    return F.when(F.greatest(*map(F.length, padded)) > 2, bordered).otherwise(F.concat(*padded))


def department_of(code: Column) -> Column:
    """The department of a department or municipality code, as it stands in the code."""
    return (F.when(F.contains(code, F.lit(BORDER)), F.substring_index(code, BORDER, 1))
            .when(F.length(code) >= 6, F.substring(code, F.lit(1), F.length(code) - 4)).otherwise(code))


def in_department(code: Column, department) -> Column:
    """Whether a department or municipality code lies in a department, whatever its zeros."""
    return department_of(code).try_cast("int") == F.lit(int(str(department)))


def zero_fill(code: Column, width: int) -> Column:
    """Zeros to the left up to a width; never truncates, keeps a leading sign."""
    signed = code.rlike("^[+-]")
    digits = F.regexp_replace(code, "^[+-]", "")
    filled = (F.when(signed, F.concat(F.substring(code, 1, 1),
                                      F.lpad(digits, width - 1, "0")))
              .otherwise(F.lpad(code, width, "0")))
    return F.when(F.length(code) < width, filled).otherwise(code)


def normalize_code(col: Column) -> Column:
    """Codes in the form dictionaries use: ``'001'`` → ``'1'``, text untouched.

    Works on the characters, so codes longer than any integer type keep all their
    digits.
    """
    text = F.btrim(col.cast("string"), F.lit(BLANKS))
    bare = F.regexp_replace(text, r"^(-?)0+(\d)", "$1$2")
    return (F.when(~text.rlike(r"^-?\d+$"), text)
            .when(bare == "-0", F.lit("0"))
            .otherwise(bare))


def _as_code(category) -> int | None:
    text = str(category).strip()
    digits = text[1:] if text.startswith("-") else text
    return int(text) if digits.isascii() and digits.isdigit() else None


def category_eq(df: DataFrame, name: str, category) -> Column:
    """``name = category``, whatever padding the data gives a numeric code."""
    code = _as_code(category)
    if code is None:
        return F.col(f"`{name}`").cast("string") == F.lit(str(category))
    if not -(1 << 63) <= code < (1 << 63):
        return normalize_code(F.col(f"`{name}`")) == F.lit(str(code))
    return int_code(df, name, "bigint") == F.lit(code)


def category_sort_keys(col: Column) -> dict[str, Column]:
    """Sort keys for categories: numeric codes by value, then texts."""
    code = normalize_code(col)
    is_code = code.rlike(r"^-?\d+$")
    return {"es_texto": F.when(is_code, 0).otherwise(1),
            "numero": F.when(is_code, code.try_cast("decimal(38,0)")),
            "texto": col.cast("string")}


def category_order(col: Column) -> list[Column]:
    """The sort keys as an ``orderBy`` list."""
    return [key.asc() for key in category_sort_keys(col).values()]
