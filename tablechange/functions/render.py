"""Typed values as text: result cells, key text, definitions, CSV lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def quote_name(name: str) -> str:
    """Backtick-quote each part of a dotted name."""
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def field(name: str) -> Column:
    """A column by its exact name, also when the name holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def reference(name: str, prefix: str = "") -> str:
    """A column by its exact name as SQL text."""
    return prefix + "`" + name.replace("`", "``") + "`"


def _float_sql(ref: str) -> str:
    """Digits without exponent and without a trailing ``.0``."""
    raw = f"CAST({ref} AS STRING)"
    sign = f"IF(startswith({raw}, '-'), '-', '')"
    body = f"ltrim('-', {raw})"
    mantissa = f"regexp_replace(substring_index({body}, 'E', 1), r'\\.0$', '')"
    digits = f"replace({mantissa}, '.', '')"
    # position of the decimal point inside the digits, counted from the left
    point = f"(length(substring_index({mantissa}, '.', 1)) + TRY_CAST(substring_index({body}, 'E', -1) AS INT))"
    return f"""CASE WHEN {raw} = 'NaN' THEN 'NaN'
        WHEN endswith({raw}, 'Infinity') THEN concat({sign}, 'inf')
        WHEN NOT contains({raw}, 'E') THEN regexp_replace({raw}, r'\\.0$', '')
        WHEN {point} <= 0 THEN concat({sign}, '0.', repeat('0', -{point}), {digits})
        WHEN {point} >= length({digits}) THEN concat({sign}, rpad({digits}, {point}, '0'))
        ELSE concat({sign}, substring({digits}, 1, {point}), '.', substring({digits}, {point} + 1)) END"""


def text_sql(ref: str, dtype: T.DataType) -> str:
    """SQL for the text of one value by its type; null stays null. One SQL text per column keeps
    the building of wide plans short."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return _float_sql(ref)
    if isinstance(dtype, T.StringType):
        return ref
    if isinstance(dtype, T.BinaryType):
        return f"IF({ref} IS NULL, NULL, '[BLOB]')"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return f"date_format({ref}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
    if isinstance(dtype, T.DateType):
        return f"date_format({ref}, 'yyyy-MM-dd')"
    if isinstance(dtype, T.TimeType):
        text = f"CAST({ref} AS STRING)"
        return f"rpad(IF(contains({text}, '.'), {text}, concat({text}, '.')), 15, '0')"
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return f"to_json({ref})"
    return f"CAST({ref} AS STRING)"


def value_text(ref: str, dtype: T.DataType) -> Column:
    return F.expr(text_sql(ref, dtype))


def render_text(df: DataFrame, null: str | None = "NULL") -> DataFrame:
    """Every column as text, null as ``NULL``."""
    cells = []
    for f in df.schema.fields:
        text = value_text(reference(f.name), f.dataType)
        cells.append((F.coalesce(text, F.lit(null)) if null is not None else text).alias(f.name))
    return df.select(cells)


def named_text(texts: dict[str, Column]) -> Column:
    """``name=value`` of each text, in order; the definition shown for a whole row."""
    return F.concat_ws(", ", *[F.concat(F.lit(f"{n}="), F.coalesce(t, F.lit("NULL"))) for n, t in texts.items()])


def key_text(parts: list[tuple[str, T.DataType]]) -> Column:
    """One text per key, from references and types. A single key is its own text; parts of a
    compound key are joined by dots, with dots and backslashes inside a part escaped, so that
    different keys never share a text."""
    texts = [text_sql(ref, t) for ref, t in parts]
    if len(texts) == 1:
        return F.expr(texts[0])
    escaped = [rf"coalesce(replace(replace({t}, r'\', r'\\'), '.', r'\.'), r'\N')" for t in texts]
    return F.expr(f"concat_ws('.', {', '.join(escaped)})")


def row_key_text(df: DataFrame, keys: list[str]) -> Column:
    """``key_text`` of key columns of ``df``."""
    return key_text([(reference(k), df.schema[k].dataType) for k in keys])


def csv_cell(text: Column) -> Column:
    """Quoted when the cell holds a comma, a quote or a newline; inner quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def csv_line(df: DataFrame, name: str = "line") -> DataFrame:
    """Each row as one CSV line."""
    text = render_text(df)
    return text.select(F.concat_ws(",", *[csv_cell(field(c)) for c in text.columns]).alias(name))
