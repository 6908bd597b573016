"""Column expressions for text and number presentation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from comarca.fixed_values import LABEL_MAX_CHARS, UNIVERSE_TEXT

# Every character that counts as white space, not only the ASCII ones.
WHITE = (r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")


def squeeze(col: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col, WHITE + "+", " "))


def shorten(col: Column, limit: int) -> Column:
    """Cut at the last blank before the limit and mark the cut."""
    head = F.regexp_replace(F.substring(col, 1, limit), " [^ ]*$", "")
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(head, F.lit("…")))


def format_number(col: Column, decimals: int = 2, percent: bool = False) -> Column:
    """Dots for thousands, a comma for decimals; no trailing zeros.

    With ``percent`` one decimal, no thousands and the sign.
    """
    value = col.cast("double")
    if percent:
        plain = F.regexp_replace(F.format_number(value, 1), ",", "")
        return F.concat(F.translate(plain, ".", ","), F.lit("%"))
    whole = F.abs(value - F.round(value)) < 1e-9
    as_whole = F.format_number(F.round(value).cast("decimal(38,0)"), 0)
    as_real = F.format_number(value, decimals)
    if decimals > 0:
        as_real = F.regexp_replace(as_real, r"\.?0+$", "")
    return F.translate(F.when(whole, as_whole).otherwise(as_real), ",.", ".,")


def first_upper(col: Column) -> Column:
    """First letter upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(col, 1, 1)),
                    F.lower(F.regexp_replace(col, r"(?s)^.", "")))


def universe_text(col: Column) -> Column:
    """A universe slug as words: ``personas_7_mas`` → people aged 7 or more."""
    slug = F.lower(squeeze(col.cast("string")))
    who = "^(personas|mujeres|hombres)"
    out = F.when(slug.isNull() | (slug == ""), F.lit(None).cast("string"))
    for key, text in UNIVERSE_TEXT.items():
        out = out.when(slug == key, F.lit(text))
    out = out.when(slug.rlike(who + r"_\d+_mas$"),
                   F.regexp_replace(slug, who + r"_(\d+)_mas$", "$1 de $2 años o más"))
    out = out.when(slug.rlike(who + r"_\d+_\d+$"),
                   F.regexp_replace(slug, who + r"_(\d+)_(\d+)$", "$1 de $2 a $3 años"))
    return out.otherwise(F.translate(slug, "_", " "))


def variable_label(variable: Column, description: Column,
                   limit: int | None = LABEL_MAX_CHARS) -> Column:
    """The description without question number or final colon, and the variable."""
    text = F.trim(F.coalesce(description, F.lit("")))
    numbered = text.rlike(r"^\d") & (F.instr(text, ". ") > 0)
    body = F.when(numbered, F.regexp_replace(text, r"(?s)^.*?\. ", "")).otherwise(text)
    body = F.trim(F.rtrim(F.trim(body), F.lit(":.")))
    if limit is not None:
        cut = F.concat(F.rtrim(F.substring(body, 1, limit), F.lit(" ,;")), F.lit("…"))
        body = F.when(F.length(body) > limit, cut).otherwise(body)
    return (F.when(text == "", variable)
            .otherwise(F.concat(body, F.lit(" ("), variable, F.lit(")"))))


def code_with_label(code: Column, label: Column) -> Column:
    """``code — label``, or the code alone when it has no label."""
    return (F.when(label.isNull() | (label == ""), code.cast("string"))
            .otherwise(F.concat(code.cast("string"), F.lit(" — "), label)))
