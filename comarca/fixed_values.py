"""Values that are data, not logic.

Everything below is a FIXED VALUE: codes, names, column candidates, wording and
limits that results must agree with.  Nothing here is derived; change an entry
only when the published data it describes changes.
"""

# --- territory --------------------------------------------------------------
DEPARTMENT_NAMES = {
    "01": "Chuquisaca",
    "02": "La Paz",
    "03": "Cochabamba",
    "04": "Oruro",
    "05": "Potosí",
    "06": "Tarija",
    "07": "Santa Cruz",
    "08": "Beni",
    "09": "Pando",
}

AREAS = {"urbana": 1, "rural": 2}
AREA_LABELS = {"urbana": "Urbana", "rural": "Rural"}

DEPARTMENT_COLUMNS = ("idep", "dpto", "dep", "departamento", "cod_dep", "codep",
                      "iddep", "depto", "id_dep")
PROVINCE_COLUMNS = ("iprov", "prov", "provincia", "cod_prov", "idprov")
MUNICIPALITY_COLUMNS = ("imun", "mun", "municipio", "cod_mun", "comun", "munc",
                        "idmun", "id_mun")
UNIT_COLUMNS = ("codigo", "cod_unidad", "id_unidad")
AREA_COLUMNS = ("area",)

HIDDEN_COLUMNS = ("idep", "iprov", "imun", "i00", "area", "area_cod", "ubigeo",
                  "dpto", "dep", "departamento", "cod_dep", "depto",
                  "mun", "municipio", "cod_mun", "comun", "redcoden")
HIDDEN_SUFFIX = "_ref_id"

# --- census tables ----------------------------------------------------------
TABLE_FILES = {
    (2024, "personas"): "persona_dep{dep}.parquet",
    (2024, "viviendas"): "vivienda.parquet",
    (2024, "emigracion"): "emigracion.parquet",
    (2024, "mortalidad"): "mortalidad.parquet",
    (2024, "unidades"): "unidad.parquet",
    (2024, "fichas"): "ficha.parquet",
    (2012, "personas"): "persona.parquet",
    (2012, "viviendas"): "vivienda.parquet",
    (2012, "emigracion"): "emigracion.parquet",
    (2001, "personas"): "persona.parquet",
    (2001, "viviendas"): "vivienda.parquet",
    (1992, "personas"): "persona.parquet",
    (1992, "viviendas"): "vivienda.parquet",
    (1992, "mortalidad"): "mortalidad.parquet",
    (1976, "personas"): "poblacion.parquet",
    (1976, "viviendas"): "vivienda.parquet",
}
TABLE_LABELS = {
    "personas": "Personas",
    "viviendas": "Viviendas",
    "emigracion": "Emigración",
    "mortalidad": "Mortalidad",
    "fichas": "Ficha de indicadores (manzano/comunidad)",
    "unidades": "Unidades censales (manzano/comunidad)",
}
SHEET_TABLES = ("fichas", "unidades")
PART_FILE_PATTERN = r"persona_dep(\d+)"
BLOCK_GEOMETRY_FILE = "geo_manzano_dep{dep}.parquet"
COMMUNITY_GEOMETRY_FILE = "geo_comunidad.parquet"

# Dwelling-type column, codes that are not dwellings, private and collective codes.
DWELLING_TYPES = {
    2024: ("v01_tipoviv", (15, 16), (1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12, 13, 14)),
    2012: ("P01", (7, 8), (1, 2, 3, 4, 5), (6,)),
    2001: ("V04", (24,), (11, 12, 13, 14, 15), (16, 17, 18, 19, 20, 21, 22, 23)),
    1992: ("V01", (13,), (1, 2, 3, 4, 5, 6), (7, 8, 9, 10, 11, 12)),
    1976: ("v01", (), (11, 12, 13, 14, 15, 16, 17), (21, 22, 23, 24, 25, 26, 27)),
}
DWELLING_TABLE = "viviendas"

# --- dictionaries -----------------------------------------------------------
VARIABLE_COLUMNS = ("variable", "nombre_variable", "var", "nombre")
DESCRIPTION_COLUMNS = ("label", "etiqueta_variable", "descripcion",
                       "descripcion_variable", "etiqueta", "desc")
TYPE_COLUMNS = ("tipo", "type", "tipo_variable")
UNIVERSE_COLUMNS = ("universo",)
THEME_COLUMNS = ("tema",)
THEME_LABEL_COLUMNS = ("tema_etiqueta",)
ENTITY_COLUMNS = ("entidad", "tabla")
LABEL_VARIABLE_COLUMNS = ("variable", "var", "nombre_variable")
LABEL_CODE_COLUMNS = ("valor", "codigo", "code", "value")
LABEL_TEXT_COLUMNS = ("etiqueta", "label", "descripcion", "desc")

TABLE_ENTITIES = {
    "personas": ("PERSONA", "POBLACION"),
    "viviendas": ("VIVIENDA",),
    "emigracion": ("EMIGRACION",),
    "mortalidad": ("MORTALIDAD",),
}
DOC_TABLES = {
    "personas": ("persona", "poblacion", "discapacidad"),
    "viviendas": ("vivienda",),
    "emigracion": ("emigracion",),
    "mortalidad": ("mortalidad",),
}
SHEET_VALUE_LABELS = {
    "area": {"1": "Urbana", "2": "Rural"},
    "ficha": {"true": "Con ficha", "false": "Sin ficha"},
}
CATALOGUE_FIELDS = ("tabla", "variable", "etiqueta", "bloque", "bloque_etiqueta",
                    "tipo", "expr", "denominador", "tema", "tema_etiqueta")
DOC_FIELDS = ("anio", "tabla", "variable", "definicion", "pregunta_literal",
              "universo_literal", "regla_derivacion")
NON_INDICATOR_COLUMNS = ("codigo", "nombre", "area", "idep", "iprov", "imun")
SPECIAL_EXPRESSIONS = {"ficha": ("CASE WHEN ficha THEN 1 ELSE 0 END", "1")}

# --- universes --------------------------------------------------------------
UNIVERSE_TEXT = {
    "todas_personas": "todas las personas",
    "todas_viviendas": "todas las viviendas",
    "viviendas_presentes": "viviendas con personas presentes",
    "viviendas_particulares": "viviendas particulares",
    "personas_emigrantes": "personas emigrantes",
    "personas_fallecidas": "personas fallecidas",
    "hogares": "hogares",
}
OBVIOUS_UNIVERSES = ("todas las personas", "todas las viviendas", "hogares")

# --- questionnaire patterns and wording --------------------------------------
QUESTION_NUMBER_PATTERN = r"^\s*(\d+)\s*[.)]"
SKIP_PATTERN = r"(\d+)\s*([^\d()]*?)\s*\(\s*PASE\s+A\s*P?\.?\s*(\d+)\s*\)"
ANSWER_MAX_CHARS = 40
STATEMENT_MAX_CHARS = 90
DEFINITION_MAX_CHARS = 600
PHRASE_START = "no a quienes respondieron "
PHRASE_END = ": el cuestionario les salta esta pregunta"
PHRASE_CODE = "el código "
PHRASE_QUESTION = " en la pregunta "
PHRASE_OR = " o "
PHRASE_NOR = " ni "
HELP_QUESTION = "Pregunta en campo: "
HELP_UNIVERSE = "Se aplicó a: "
HELP_SKIP_WITHIN = "Y, dentro de ese universo, "
HELP_SKIP_ALONE = "Pero "
HELP_RULE = "Cómo se construyó: "
NOTE_UNIVERSE = "Pregunta aplicada a: "
NOTE_WITHIN = " — y, dentro de ese universo, "
NOTE_SKIP_ONLY = "Esta pregunta no se hizo a todos: "

# --- measures, titles and limits ----------------------------------------------
TITLES = {
    "expression": "Expresión SQL",
    "__count__": "Conteo de registros",
    "mean": "Media de {label}",
    "median": "Mediana de {label}",
    "sum": "Suma de {label}",
    "std": "Desv. estándar de {label}",
    "mode": "Categoría más frecuente de {label}",
    "pct_category": "% con «{category}» en {label}",
    "pct_total": "% con «{category}» en {label} (sobre todos los registros)",
    "total": "Total de {label}",
    "porcentaje": "% de {label}",
}
TITLE_BY_UNIT = "{title} — por {unit}"
DENSITY_UNIT = "km² ({unit})"
SEMANTIC_TYPES = {"categorica": "categorical", "texto": "categorical",
                  "numerica": "numeric"}
LEGAL_MEASURES = {
    "count": ("__count__",),
    "categorical": ("pct_category", "pct_total", "mode"),
    "numeric": ("mean", "median", "sum", "std"),
    "unknown": ("pct_category", "pct_total", "mode", "mean", "median", "sum", "std"),
}
LEVEL_WORDS = {"departamento": "departamento", "municipio": "municipio",
               "unidad": "manzano/comunidad"}
CLASSIFICATIONS = ("jenks", "quantile", "equal", "stddev")
CLASS_COUNT = 5
FRAGILE_CASES = 5
LOW_COVERAGE_PCT = 95.0
RANKING_ROWS = 15
MODAL_ROWS = 12
LABEL_MAX_CHARS = 52
