"""The functions and bound tables for Spark SQL: temporary SQL functions, which the optimizer inlines, and temporary views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Name: parameters, return type and body. Each gives what the Column function of the same name gives.
FUNCTIONS = {
    "effective_score": ("final DOUBLE, ai DOUBLE", "DOUBLE", "coalesce(final, ai, 0D)"),
    "quantize_quarter": ("x DOUBLE", "DOUBLE", "bround(x * 4) / 4"),
    "parse_decimal": ("x STRING", "DOUBLE", "try_cast(replace(trim(x), ',', '.') AS DOUBLE)"),
    "clamp_unit": ("x STRING", "DOUBLE", "CASE WHEN isnan(try_cast(x AS DOUBLE)) THEN double('NaN') WHEN try_cast(x AS DOUBLE) IS NOT NULL THEN greatest(0D, least(1D, try_cast(x AS DOUBLE))) END"),
    "clamp_grade": (
        "x STRING", "STRUCT<score: DOUBLE, invalid: BOOLEAN>",
        """transform(array(try_cast(replace(trim(x), ',', '.') AS DOUBLE)), v ->
        transform(array(greatest(0D, least(1D, ceil(v * 4 - 0.5D) / 4))), n ->
        CASE WHEN v IS NULL OR isnan(v) OR abs(v) = double('Infinity') THEN named_struct('score', 0D, 'invalid', true)
ELSE named_struct('score', n, 'invalid', n <> v) END)[0])[0]""",
    ),
    "int_or": ("x STRING, other INT", "INT", "coalesce(try_cast(x AS INT), other)"),
    "float_or": ("x STRING, other DOUBLE", "DOUBLE", "coalesce(try_cast(x AS DOUBLE), other)"),
    "normalize_confidence": ("x STRING", "STRING",
        "CASE WHEN lower(trim(x)) IN ('alta', 'media', 'baixa') THEN lower(trim(x)) WHEN lower(trim(x)) IN ('média', 'medio', 'médio') THEN 'media' ELSE 'baixa' END"),
    "needs_fallback": ("n INT, confidence DOUBLE", "BOOLEAN", "n < 3 OR coalesce(confidence < 0.70D, false)"),
    "sheet_score": ("total DOUBLE, questions INT", "DOUBLE", "CASE WHEN questions > 0 THEN bround(total / questions * 4) / 4 ELSE 0D END"),
    "words": ("x STRING", "ARRAY<STRING>", r"filter(split(coalesce(x, ''), r'(?U)\s+'), w -> w <> '')"),
    "word_count": ("x STRING", "INT", r"size(filter(split(coalesce(x, ''), r'(?U)\s+'), w -> w <> ''))"),
    "normalize_text": ("x STRING", "STRING", "trim(regexp_replace(lower(coalesce(x, '')), '[^a-z0-9áàâãéèêíïóôõöúçñ]+', ' '))"),
    "token_overlap": ("a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "size(array_intersect(a, b)) / greatest(1, size(array_distinct(a)))"),
    "format_qr": ("exam STRING, student STRING, page STRING, pages STRING", "STRING", "concat_ws('|', 'MQPC', exam, student, page, pages)"),
    "safe_uuid": (
        "x STRING", "STRING",
        r"""transform(array(lower(replace(regexp_replace(regexp_replace(trim(x), 'urn:|uuid:', ''), r'^[{}]+|[{}]+$', ''), '-', ''))), d ->
        CASE WHEN regexp_like(d, '^[0-9a-f]{32}$') THEN concat_ws('-', substr(d, 1, 8), substr(d, 9, 4), substr(d, 13, 4), substr(d, 17, 4),
substr(d, 21, 12)) END)[0]""",
    ),
    "safe_pdf_name": (
        "x STRING", "STRING",
        r"""transform(array(replace(regexp_extract(x, r'([^/]*)/*$', 1), '\\', '_')), b -> CASE WHEN endswith(lower(b), '.pdf') THEN b ELSE concat(b, '.pdf') END)[0]""",
    ),
    "display_justification": ("x STRING", "STRING", "CASE WHEN trim(x) <> '' AND NOT startswith(lower(trim(x)), 'erro no processamento:') THEN trim(x) END"),
}


def register_functions(spark: SparkSession, prefix: str = "sw_") -> list[str]:
    """Temporary SQL functions of the session, under prefixed names; the names."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f"{prefix}{name}" for name in FUNCTIONS]


def register_views(tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Temporary views of the session on tables of any source; the names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")
    return [f"{prefix}{name}" for name in tables]
