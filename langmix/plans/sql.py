"""DuckDB oracle SQL building blocks (independent restatements of each job).

Patterns here are RE2 (DuckDB); the Spark side uses Java regex. DuckDB's
``regexp_replace`` needs the 'g' flag to replace every match.
"""

from __future__ import annotations

from langmix.sources.tables import DOC_LANG_CODES, LANG_NAMES, RESOURCE_CLASSES


def values(rows, cols: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


CODES = f"codes AS (SELECT * FROM {values(DOC_LANG_CODES, 'iso_1, iso_3')})"
CLASSES = f"classes AS (SELECT * FROM {values(RESOURCE_CLASSES, 'lang_code, class')})"
NAMES = f"names AS (SELECT * FROM {values(LANG_NAMES, 'code, name')})"

STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
NTOK = "len(regexp_extract_all({x}, '\\S+'))"
SPECIAL = """regexp_matches({x}, '[!@#$%^&*()\\[\\]{{}};:,./<>?\\\\|`~=_+"''0-9-]')"""


def strip(x: str) -> str:
    return STRIP.format(x=x)


def ntok(x: str) -> str:
    return NTOK.format(x=x)


def special(x: str) -> str:
    return SPECIAL.format(x=x)


def md5_order(id_expr: str, seed="42") -> str:
    return f"md5('{seed}:' || CAST({id_expr} AS VARCHAR))"


CORPUS = f"""corpus AS (
  SELECT d.doc_id, d.text AS sentence, d.lang AS data_lang, COALESCE(c.iso_3, d.lang) AS language,
         d.source AS dataset
  FROM documents d LEFT JOIN codes c ON d.lang = c.iso_1
  WHERE {strip('d.text')} <> '' AND COALESCE(c.iso_3, d.lang) IS NOT NULL AND COALESCE(c.iso_3, d.lang) <> '')"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def base(*extra: str) -> str:
    return with_ctes(CODES, CORPUS, *extra)
