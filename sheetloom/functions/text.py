"""Column functions of the cleaning rules. All are expressions of built-in functions and stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: marks of attendance by their lower-case spelling
MARKERS = {"p": "P", "a": "A", "h": "H", "l": "L", "wfh": "WFH", "present": "P", "absent": "A", "half": "HD", "leave": "L", "holiday": "H", "sunday": "S"}

#: Every kind of white space.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_all(c: Column | str) -> Column:
    """Without any kind of white space at either end; trim() takes spaces only."""
    return F.btrim(col(c), F.lit(BLANKS))


def round_half_up(c: Column | str) -> Column:
    """Halves go up, also below zero."""
    return F.floor(col(c) + 0.5)


def display(c: Column | str, placeholder: str = "-") -> Column:
    """The value, or the placeholder for null and for empty text."""
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(placeholder))


def cut(c: Column | str, most: int = 12) -> Column:
    """At most so many characters, then an ellipsis."""
    return F.when(F.length(col(c)) > most, F.concat(F.left(col(c), F.lit(most)), F.lit("…"))).otherwise(col(c))


def percent(c: Column | str) -> Column:
    return F.concat(round_half_up(col(c) * 100).cast("string"), F.lit("%"))


def bars_to_capital_i(c: Column | str) -> Column:
    return F.replace(col(c), F.lit("|"), F.lit("I"))


def clean_numeric(c: Column | str) -> Column:
    """Letters that stand for digits are read as such and all but digits and points go, a sign too; text without a digit
    stays as it is."""
    digits = F.regexp_replace(F.translate(col(c), "OlISB", "01158"), "[^0-9.]", "")
    return F.coalesce(F.nullif(digits, F.lit("")), col(c))


def clean_serial(c: Column | str) -> Column:
    """As a number, but S and B are no digits, and nothing may remain."""
    return F.regexp_replace(F.translate(col(c), "OlI", "011"), "[^0-9.]", "")


def clean_status(c: Column | str) -> Column:
    """The mark of a known spelling, else capitals."""
    marks = F.create_map(*(F.lit(x) for pair in MARKERS.items() for x in pair))
    text = trim_all(c)
    return F.coalesce(F.element_at(marks, F.lower(text)), F.upper(text))


def title_words(c: Column | str) -> Column:
    """Lower case, with a capital at the start of each run of ASCII letters, digits and underscores. Unlike initcap, which
    parts at white space alone."""
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    capital = F.transform(runs, lambda t: F.when(t.rlike("^[a-z]"), F.concat(F.upper(F.left(t, F.lit(1))), F.substr(t, F.lit(2)))).otherwise(t))
    return F.array_join(capital, "")


def clean_name(c: Column | str) -> Column:
    """Bars read as I, words capitalised, and a lone mark between spaces dropped."""
    return trim_all(F.regexp_replace(trim_all(title_words(bars_to_capital_i(c))), r"\s[^A-Za-z\d]\s", " "))


def clean_cell(c: Column | str, kind: Column | str) -> Column:
    """Blank text becomes empty. Else bars, brackets and points go from both ends and the kind of column decides."""
    text = trim_all(F.btrim(trim_all(c), F.lit("[|].")))
    kind = col(kind)
    cleaned = (
        F.when(kind == "numeric", clean_numeric(text))
        .when(kind == "name", clean_name(text))
        .when(kind == "status", clean_status(text))
        .when(kind == "serial", clean_serial(text))
        .otherwise(bars_to_capital_i(text))
    )
    return F.when(F.coalesce(trim_all(c), F.lit("")) == "", "").otherwise(cleaned)


def apply_character_rules(c: Column | str) -> Column:
    """Substitutions by context, in order: letters next to digits, dashes, doubled bars, and cells of nothing but noise."""
    out = col(c)
    for pattern, to in CHARACTER_RULES:
        out = F.regexp_replace(out, pattern, to)
    return out


_B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
# fixed values: pattern and replacement, in the order in which they apply (word edges are ASCII)
CHARACTER_RULES = [
    (rf"{_B}O{_B}(?=\s*[0-9])", "0"),
    (rf"(?<=[0-9]\s*)O{_B}", "0"),
    (rf"{_B}[lL]{_B}(?=\s*[0-9])", "1"),
    (rf"{_B}S(?=[0-9])", "5"),
    (rf"(?<=[0-9])S{_B}", "5"),
    (rf"{_B}B(?=[0-9])", "8"),
    (rf"(?<=[0-9])B{_B}", "8"),
    (rf"{_B}l{_B}", "1"),
    (r"\|(?=\s*[0-9])", "1"),
    ("—", "-"),
    (r"\|{2,}", ""),
    (r"^[\s|\[\].]+$", ""),
]


def keep_number_marks(c: Column | str) -> Column:
    """What a number can hold, as the recogniser's output is cut for typed columns."""
    return F.regexp_replace(col(c), r"[^0-9.\-]", "")


def one_line(c: Column | str) -> Column:
    """Recognised text on one line, without white space at its ends."""
    return F.regexp_replace(trim_all(c), "\n", " ")
