"""Text without its markup, as SQL expressions; for measures that leave markup aside."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (what a text must hold for the steps to matter, its steps as (pattern, replacement)), applied in this order.
STEPS = (
    (("<!--",), ((r"(?s)<!--.*?-->", ""),)),
    (("---\n",), ((r"(?s)\A---\n.*?\n---\n", ""),)),
    (
        ("<",),
        (
            (r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|pre|html|head|body|title|blockquote)\b[^<>]*>", "\n"),
            (r"(?i)</?(?:td|th)\b[^<>]*>", " "),
            (r"</?[a-zA-Z][^<>]*>", ""),
        ),
    ),
    (("&",), ((r"&nbsp;", " "), (r"&(?:quot|amp|lt|gt|apos|#\d+|#x[0-9a-fA-F]+);", '"'))),
    (("{{",), ((r"\{\{(?:[^|{}]*\|)?([^{}]*)\}\}", "$1"),)),
    (
        ("[",),
        (
            (r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]", "$1"),
            (r"!?\[([^\[\]]*)\](?:\([^()\s]*\)|\[[^\[\]]*\])", "$1"),
            (r"\[(?:https?://)\S+ ([^\[\]]*)\]", "$1"),
        ),
    ),
    (
        ("\\",),
        (
            (r"~?\\(?:cite|label|ref|documentclass|usepackage|begin|end)\*?(?:\[[^\[\]]*\])?\{[^{}]*\}", ""),
            (r"\\[a-zA-Z]+\*?(?:\{([^{}]*)\})?", "$1"),
        ),
    ),
    (("# ", "===", "---", "```", "~~~"), ((r"(?=[#=\-`~])(?m)^(?:#{1,6} |={3,}$|-{3,}$|`{3,}.*$|~{3,}.*$)", ""),)),
    (("*", "__", "~~", "''", "`", "="), ((r"(?=[*_~'`=])(?:\*+|_{2,}|~{2,}|'{2,}|`+|(?m)^=+|=+$)", ""),)),
)


def with_plain(df: DataFrame, text: Column, name: str) -> DataFrame:
    """The rows with the text without markup as a column.

    A step is a column of its own, so that its text is worked out once however often it is mentioned; only texts
    that hold a step's sign pay for its patterns.
    """
    df = df.withColumn(name, text)
    for signs, steps in STEPS:
        mine = F.col(name)
        there = reduce(Column.__or__, [F.contains(mine, F.lit(sign)) for sign in signs])
        df = df.withColumn(name, F.when(there, reduce(lambda t, s: F.regexp_replace(t, *s), steps, mine)).otherwise(mine))
    return df
