"""Problem 1: several values packed in one field.

Quoted and bracketed spans are replaced by indexed placeholders, the rest is split at its separators, the spans are put
back by array lookup and the values are exploded with their positions. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.text import bound

#: Placeholder ``MARK i END``. A MARK that stands in the text is followed by ESCAPE meanwhile, so none can be mistaken.
MARK, END, ESCAPE = "", "", ""
_INNER = r"(?<=[\p{L}\p{N}])'(?=[\p{L}\p{N}])"
#: A quote opens only where no letter or digit stands before it and closes only where none follows: o'clock has none.
QUOTED = "|".join(
    [
        r"""(?<![\p{L}\p{N}])"(?:[^"]|"")*+"(?![\p{L}\p{N}])""",
        rf"""(?<![\p{{L}}\p{{N}}])'(?:[^']|''|{_INNER})*+'(?![\p{{L}}\p{{N}}])""",
        "«[^»]*»",
        "“[^”]*”",
        "„[^“”]*[“”]",
        "‘[^’]*’",
    ]
)
BRACKETED = r"\((?:[^()]|\([^()]*\))*\)|\[(?:[^\[\]]|\[[^\[\]]*\])*\]|\{(?:[^{}]|\{[^{}]*\})*\}"
#: White space at the ends of a value.
BLANKS = " \t\n\x0b\f\r\u00a0"
#: Comma, semicolon, bar, bullet, tab and line ends; a slash only between white space.
LIST_SEPARATORS = r"[,;|•\t\n\r]|(?<=\s)/(?=\s)"
#: Whatever is no digit and no part of a placeholder: for lists of numbers.
NUMBER_SEPARATORS = f"[^0-9{MARK}{END}]+"
#: A text without any of these has no span.
_OPENING = "[\"'«“„‘(\\[{]"


def split_values(column: Column, separators: str = LIST_SEPARATORS, protected: str = f"{QUOTED}|{BRACKETED}", opened: bool = False) -> Column:
    """The values of a packed text as an array, in order; null and blank texts give an empty array.

    White space around a value is dropped, then a pair of quotes around the whole of it, a doubled quote within becoming
    one. Values left empty are dropped. A quote or bracket without its partner is an ordinary character. With ``opened`` a
    span holds values of its own (numbers written as ``"1,2"; {3, 4}``): each restored value is split in turn.
    """
    text = F.replace(F.coalesce(column.cast("string"), F.lit("")), F.lit(MARK), F.lit(MARK + ESCAPE))
    some = text.rlike(_OPENING)
    spans = F.when(some, F.regexp_extract_all(text, F.lit(f"(?:{protected})"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    between = F.when(some, F.split(text, f"(?:{protected})", -1)).otherwise(F.array(text))

    def values(parts: Column) -> Column:
        none = F.size(parts["spans"]) == 0
        masked = F.array_join(
            F.transform(parts["between"], lambda piece, i: F.when(i == 0, piece).otherwise(F.concat(F.lit(MARK), (i - 1).cast("string"), F.lit(END), piece))), ""
        )
        masked = F.when(none, F.get(parts["between"], F.lit(0))).otherwise(masked)
        return bound(F.filter(F.transform(F.split(masked, separators, -1), _bare), lambda v: v != ""), lambda found: F.when(none, plain(found)).otherwise(whole(found, parts["spans"])))

    def plain(found: Column) -> Column:
        return F.transform(found, lambda v: F.replace(v, F.lit(MARK + ESCAPE), F.lit(MARK)))

    def whole(found: Column, held: Column) -> Column:
        restored = F.transform(found, lambda v: _restored(v, held))
        if opened:
            restored = F.flatten(F.transform(restored, lambda v: F.split(v, separators, -1)))
        return F.filter(restored, lambda v: _bare(v) != "")

    return bound(F.struct(spans.alias("spans"), between.alias("between")), values)


def _bare(value: Column) -> Column:
    return F.btrim(value, F.lit(BLANKS))


def _restored(value: Column, spans: Column) -> Column:
    def piece(token: Column) -> Column:
        index = F.regexp_extract(token, f"^{MARK}([0-9]+){END}$", 1)
        return F.when(index != "", F.get(spans, F.when(index != "", index).cast("int"))).otherwise(token)

    whole = F.array_join(F.transform(F.regexp_extract_all(value, F.lit(f"{MARK}[0-9]+{END}|{MARK}|[^{MARK}]+"), F.lit(0)), piece), "")
    alone = value.rlike(f"^{MARK}[0-9]+{END}$") & ~whole.rlike(r"^[(\[{]")
    inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
    quote = F.substring(whole, 1, 1)
    unquoted = F.when(quote.isin('"', "'"), F.replace(inner, F.concat(quote, quote), quote)).otherwise(inner)
    return F.replace(F.when(alone, unquoted).otherwise(whole), F.lit(MARK + ESCAPE), F.lit(MARK))


def packed_values(df: DataFrame, column: str, keys: list[str], **how) -> DataFrame:
    """One row per value of ``column``: the keys, ``pos`` from 0 and ``val``.

    A value that stands twice in a text gives two rows; rows alike in keys, position and value are given once. Null keys
    stay null; a null or blank text gives no row.
    """
    values = df.select(*keys, F.posexplode(split_values(F.col(column), **how)).alias("pos", "val"))
    return values.distinct()
