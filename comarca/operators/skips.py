"""Questionnaire skips: read from the wording of questions, explained, never computed with.

A question may say "1 Sí (PASE A P49)": who answers 1 is not asked anything before
question 49.  That explains missing answers that the declared universe does not.

The wording is read once, into a small checkpointed table (``parsed_questions``), when one
of the functions is called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from comarca.fixed_values import (
    ANSWER_MAX_CHARS, DEFINITION_MAX_CHARS, HELP_QUESTION, HELP_RULE, HELP_SKIP_ALONE,
    HELP_SKIP_WITHIN, HELP_UNIVERSE, PHRASE_CODE, PHRASE_END, PHRASE_NOR, PHRASE_OR,
    PHRASE_QUESTION, PHRASE_START, QUESTION_NUMBER_PATTERN, SKIP_PATTERN,
    STATEMENT_MAX_CHARS,
)
from comarca.functions.text import shorten, squeeze
from comarca.operators.lineage import cut

_EDGE = " .,;:"
_PATTERN = "(?iu)" + SKIP_PATTERN


def question_number(wording: Column) -> Column:
    """The number a question starts with ("43. …"), NULL when it has none."""
    return F.regexp_extract(wording, QUESTION_NUMBER_PATTERN, 1).try_cast("bigint")


def short_statement(wording: Column, max_chars: int | None = STATEMENT_MAX_CHARS) -> Column:
    """The question itself: no number, no list of answers; shortened unless None is given."""
    text = F.trim(F.regexp_replace(squeeze(wording), QUESTION_NUMBER_PATTERN, ""))
    ask, colon = F.instr(text, "?"), F.instr(text, ":")
    far = F.lit(1 << 30)
    cut = F.least(F.when(ask > 1, ask).otherwise(far), F.when(colon > 1, colon).otherwise(far))
    body = (F.when(cut == far, text)
            .when(cut == ask, F.substring(text, F.lit(1), ask))
            .otherwise(F.substring(text, F.lit(1), colon - 1)))
    body = F.btrim(body, F.lit(_EDGE))
    return body if max_chars is None else shorten(body, max_chars)


def skip_matches(wording: Column, max_answer: int | None = ANSWER_MAX_CHARS) -> Column:
    """Every skip of a wording as array<struct<codigo, respuesta, destino>>.

    One pass of the pattern over the text; the parts are then read from each match.
    The wording must have single blanks (``clean_docs``).  An answer that is really
    the next sub-question, or longer than ``max_answer``, is left empty.
    """
    def parts(m: Column) -> Column:
        answer = F.btrim(F.regexp_extract(m, _PATTERN, 2), F.lit(_EDGE))
        bad = F.contains(answer, F.lit("¿"))
        if max_answer is not None:
            bad |= F.length(answer) > max_answer
        return F.struct(
            F.regexp_extract(m, _PATTERN, 1).try_cast("bigint").alias("codigo"),
            F.when(bad, F.lit("")).otherwise(answer).alias("respuesta"),
            F.regexp_extract(m, _PATTERN, 3).try_cast("bigint").alias("destino"))
    return F.transform(F.regexp_extract_all(wording, F.lit(_PATTERN), F.lit(0)), parts)


def parsed_questions(docs: DataFrame, max_chars: int | None = STATEMENT_MAX_CHARS,
                     max_answer: int | None = ANSWER_MAX_CHARS) -> DataFrame:
    """(anio, tabla, variable, num, pregunta, saltos) of the variables that are questions.

    Read and matched once: the functions below take it in place of the documentation.
    """
    # a row for each wording keeps it from being worked out once for each use
    once = docs.select("anio", "tabla", "variable", F.explode(F.array("pregunta_literal")).alias("w"))
    wording = F.col("w")
    return cut(once.select("anio", "tabla", "variable", question_number(wording).alias("num"),
                           short_statement(wording, max_chars).alias("pregunta"),
                           skip_matches(wording, max_answer).alias("saltos")).filter("num IS NOT NULL"))


def _parsed(docs: DataFrame) -> DataFrame:
    return docs if "saltos" in docs.columns else parsed_questions(docs)


def skip_options(docs: DataFrame, max_answer: int | None = ANSWER_MAX_CHARS) -> DataFrame:
    """(anio, tabla, num, codigo, respuesta, destino, orden): the skips of each question.

    A question that is several variables declares its skips in each of them; they
    count once, in the order of first appearance (``orden``).
    """
    read = docs if "saltos" in docs.columns else parsed_questions(docs, max_answer=max_answer)
    found = (read.select("anio", "tabla", "variable", "num", F.posexplode("saltos").alias("pos", "o"))
             .filter("o.codigo IS NOT NULL AND o.destino IS NOT NULL"))
    return (found.groupBy("anio", "tabla", "num", "o.codigo", "o.respuesta", "o.destino")
            .agg(F.min(F.struct("variable", "pos")).alias("orden")))


def _blocks(low: str, high: str) -> Column:
    """The stretch of numbers [low, high] as dyadic blocks: array<struct<level, block>>.

    Block b of level k is the 2**k numbers from b * 2**k on.  A stretch is at most two
    blocks of each level, from ones at its ends to larger ones inside, without overlap.
    """
    at_level = f"""transform(sequence(0, int(floor(log2({high} - {low} + 1)))), k -> struct(k AS level,
        shiftright({low} + shiftleft(1L, k) - 1, k) AS l, shiftright({high} + 1, k) AS r))"""
    return F.expr(f"""flatten(transform({at_level}, x -> filter(array(
        struct(x.level AS level, x.l AS block, x.l < x.r AND x.l % 2 = 1 AS part),
        struct(x.level AS level, x.r - 1 AS block, x.l < x.r AND x.r % 2 = 1 AS part)), b -> b.part)))""")


def prior_conditions(docs: DataFrame) -> DataFrame:
    """Earlier questions that keep part of the universe from a question.

    (anio, tabla, num, previa, pregunta, respuestas): one row per question and earlier
    question with a skip that passes over it; ``respuestas`` are the answers that do,
    array<struct<codigo, etiqueta>>.

    A skip passes over a stretch of question numbers, which is cut into dyadic blocks; a
    question lies in one block of each level.  So the pairs are one join on equal blocks, its
    sides no larger than skips and questions times the logarithm of the longest stretch, and
    every pair comes up once.
    """
    read, key = _parsed(docs), ["anio", "tabla"]
    span = read.groupBy(*key).agg(F.max("num").alias("last"), F.expr("int(floor(log2(max(num) - min(num) + 1)))").alias("levels"))
    asked = (read.select(*key, "num").distinct().join(span, key)
             .select(*key, "num", F.explode(F.expr("sequence(0, levels)")).alias("level"))
             .withColumn("block", F.expr("shiftright(num, level)")))
    over = (skip_options(read).join(span, key)
            .withColumns({"from": F.col("num") + 1, "to": F.least(F.col("destino") - 1, F.col("last"))}).filter("to > num")
            .select(*key, F.col("num").alias("previa"), "codigo", "respuesta", "orden", F.explode(_blocks("from", "to")).alias("b"))
            .select("*", "b.level", "b.block").drop("b"))
    hits = asked.join(over, key + ["level", "block"])
    answers = F.sort_array(F.collect_list(F.struct("orden", "codigo",
                                                   F.col("respuesta").alias("etiqueta"))))
    grouped = hits.groupBy(*key, "num", "previa").agg(answers.alias("respuestas"))
    texts = (read.filter(F.size("saltos") > 0).groupBy(*key, F.col("num").alias("previa"))
             .agg(F.min_by("pregunta", "variable").alias("pregunta")))
    return (grouped.join(texts, key + ["previa"])
            .select(*key, "num", "previa", "pregunta",
                    F.transform("respuestas", lambda r: F.struct(
                        r["codigo"].alias("codigo"), r["etiqueta"].alias("etiqueta")))
                    .alias("respuestas")))


def condition_clause(previa: Column, pregunta: Column, respuestas: Column) -> Column:
    """One condition as words: the answers, or their codes when none is worded."""
    worded = F.filter(respuestas, lambda r: r["etiqueta"] != "")
    by_text = F.array_join(F.transform(worded, lambda r: F.concat(
        F.lit("«"), r["etiqueta"], F.lit("»"))), PHRASE_OR)
    by_code = F.array_join(F.transform(respuestas, lambda r: F.concat(
        F.lit(PHRASE_CODE), r["codigo"].cast("string"))), PHRASE_OR)
    answer = F.when(F.size(worded) > 0, by_text).otherwise(by_code)
    return F.concat(answer, F.lit(PHRASE_QUESTION), previa.cast("string"),
                    F.lit(" («"), pregunta, F.lit("»)"))


def condition_phrases(docs: DataFrame) -> DataFrame:
    """(anio, tabla, num, frase): the conditions of a question as one negative sentence."""
    clauses = prior_conditions(docs).select(
        "anio", "tabla", "num", "previa",
        condition_clause(F.col("previa"), F.col("pregunta"), F.col("respuestas"))
        .alias("clause"))
    ordered = F.sort_array(F.collect_list(F.struct("previa", "clause")))
    joined = F.array_join(F.transform(F.col("all"), lambda c: c["clause"]), PHRASE_NOR)
    return (clauses.groupBy("anio", "tabla", "num").agg(ordered.alias("all"))
            .select("anio", "tabla", "num",
                    F.concat(F.lit(PHRASE_START), joined, F.lit(PHRASE_END)).alias("frase")))


def variable_phrases(docs: DataFrame) -> DataFrame:
    """(anio, tabla, variable, num, frase): the sentence for every variable that has one."""
    read = _parsed(docs)
    return (read.select("anio", "tabla", "variable", "num").join(condition_phrases(read), ["anio", "tabla", "num"])
            .select("anio", "tabla", "variable", "num", "frase"))


def help_text(docs: DataFrame, max_chars: int | None = DEFINITION_MAX_CHARS) -> DataFrame:
    """(anio, tabla, variable, ayuda): what is documented about a variable, as one text.

    Definition and rule are shortened to ``max_chars``; None keeps them whole.
    """
    short = lambda c: c if max_chars is None else shorten(c, max_chars)
    phrases = condition_phrases(docs)
    rows = docs.withColumn("num", question_number(F.col("pregunta_literal")))
    rows = rows.join(phrases, ["anio", "tabla", "num"], "left")
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    some = lambda c, then: F.when(text(c) != "", then)
    lead = F.when(text("universo_literal") != "", HELP_SKIP_WITHIN).otherwise(HELP_SKIP_ALONE)
    parts = [
        some("definicion", short(text("definicion"))),
        some("pregunta_literal", F.concat(F.lit(HELP_QUESTION + "«"),
                                          text("pregunta_literal"), F.lit("»"))),
        some("universo_literal", F.concat(F.lit(HELP_UNIVERSE), text("universo_literal"))),
        F.when(F.col("frase").isNotNull(), F.concat(lead, F.col("frase"), F.lit("."))),
        some("regla_derivacion", F.concat(F.lit(HELP_RULE),
                                          short(text("regla_derivacion")))),
    ]
    return rows.select("anio", "tabla", "variable",
                       F.concat_ws("\n\n", *parts).alias("ayuda"))


def explain_missing(df: DataFrame, variable: str, universe: Column, skipped: Column,
                    by: Sequence[str] = ()) -> DataFrame:
    """Missing answers split by cause, in one pass.

    n_total, n_sin_dato, n_fuera (outside the declared universe), n_salto (inside, but
    an earlier answer skips the question) and n_residuo (everything else), which always
    add up to n_sin_dato.
    """
    missing = F.col(f"`{variable}`").isNull()
    outside = F.count_if(missing & ~universe)
    jumped = F.count_if(missing & universe & skipped)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(missing).alias("n_sin_dato"),
        outside.alias("n_fuera"), jumped.alias("n_salto"),
        (F.count_if(missing) - outside - jumped).alias("n_residuo"))
