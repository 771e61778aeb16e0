"""Template variables and canonical text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: the form of a template variable
VARIABLE = r"\$\{([A-Za-z0-9_]+)\}"


def interpolate(text: Column | str, variables: Column | str) -> Column:
    """Replace each ``${NAME}`` by its value in the map; unknown names stay as written.

    One pass: the text is cut at the variables and joined again with the values, so a value
    that itself holds ``${...}`` is not expanded.
    """
    text = F.col(text) if isinstance(text, str) else text
    variables = F.col(variables) if isinstance(variables, str) else variables
    names = F.regexp_extract_all(text, F.lit(VARIABLE), F.lit(1))
    between = F.split(text, VARIABLE, -1)
    values = F.transform(
        names, lambda n: F.coalesce(F.try_element_at(variables, n), F.concat(F.lit("${"), n, F.lit("}")))
    )
    tail = F.zip_with(values, F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda v, t: F.concat(v, t))
    return F.concat(between[0], F.array_join(tail, ""))


def canonical_text(text: Column | str) -> Column:
    """Lower case, whitespace runs as one space, no outer space. Also inside quoted text:
    this is a comparison form, not a formatter."""
    text = F.col(text) if isinstance(text, str) else text
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


# a literal, a quoted name, what lies between them, or a quote that is never closed
PIECE = r"""'[^']*'|"[^"]*"|`[^`]*`|[^'"`]+|['"`]"""


def canonical_outside_quotes(text: Column | str) -> Column:
    """``canonical_text`` of what lies outside quotes; string literals and quoted names stay as they are.

    A doubled quote is two literals side by side, which join to the same text. A quote that is never closed
    is an ordinary character. Comments are not known: a quote in a comment opens a literal.
    """
    text = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))
    quoted = lambda x: F.substring(x, 1, 1).isin("'", '"', "`")
    form = F.transform(pieces, lambda x: F.when(quoted(x), x).otherwise(F.lower(F.regexp_replace(x, r"\s+", " "))))
    return F.trim(F.array_join(form, ""))


def fingerprint(text: Column | str) -> Column:
    """Digest of the canonical text."""
    return F.md5(canonical_text(text))
