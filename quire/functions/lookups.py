"""Lookup tables as small frames or map literals, and the expressions that read them.

The tables' sizes are fixed, so they are literals or broadcast sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A character's class and glyph in mathematics.
GLYPHS = (
    (",", "punct", ","),
    (":", "rel", ":"),
    (".", "ord", "."),
    ("<", "rel", "<"),
    (">", "rel", ">"),
    ("=", "rel", "="),
    ("+", "rel", "+"),
    ("/", "ord", "/"),
    ("\\sim", "ord", "~"),
    ("*", "ord", "*"),
    ("&", "ord", "&"),
    ("#", "ord", "#"),
    ("(", "ord", "("),
    (")", "ord", ")"),
    ("[", "ord", "["),
    ("]", "ord", "]"),
    ("\\mid", "rel", "|"),
    ("\\mathper", "inner", "%"),
    ("≠", "rel", "≠"),
    ("≈", "rel", "≈"),
    ("…", "inner", "…"),
    ("′", "inner", "'"),
    ("-", "bin", "−"),
)

#: A citation key's template; %l stands for the label.
CITATIONS = {
    "C-m": "~\\citet[]{%l}",
    "t": "~\\citet[]{%l}",
    "T": "~\\citet*[]{%l}",
    "c": "~\\cite[]{%l}",
    "p": "~\\citep[]{%l}",
    "P": "~\\citep*[]{%l}",
    "a": "~\\citeauthor{%l}",
    "A": "~\\citeauthor*{%l}",
    "n": "~\\nocite{%l}",
    "y": "~\\citeyearpar[]{%l}",
    "Y": "~\\citeyear[]{%l}",
}

#: An environment's label key, prefix and reference template; %s stands for the label.
LABELS = (
    ("eqclaim", "e", "eq:", "~\\eqref{%s}"),
    ("exe", "e", "eq:", "~\\eqref{%s}"),
    ("eqtext", "e", None, None),
)

#: How a bibliography field is edited.
FIELDS = {
    "multiline": ("abstract", "addendum", "note", "annotation"),
    "list": (
        "afterword", "annotator", "author", "bookauthor", "commentator", "editor", "editora", "editorb", "editorc", "foreword", "holder", "introduction", "sortname", "translator",
        "title", "booktitle", "institution", "location", "origlocation", "address", "publisher", "origpublisher",
    ),
    "ref": ("crossref", "xref"),
    "file": ("file",),
    "literal": ("journal", "journaltitle"),
    "separated-values": ("keywords",),
    "language": ("language", "origlanguage"),
}

#: Commands by name.
COMMANDS = (
    ("LaTeX", "%`%l%(mode)%' %T", "Run LaTeX"),
    ("BibTeX", "bibtex %(O?aux)", "Run BibTeX"),
    ("Biber", "biber %(output-dir) %s", "Run Biber"),
    ("View", "%V", "Run Viewer"),
)

#: Macros by highlight class.
KEYWORDS = {
    "constant": ("change", "scq", "word"),
    "string": ("sn", "ex"),
    "bold": ("mn", "marg", "mnshort", "mnlong"),
    "reference": ("hiddenref",),
}

#: Bibliographic sources that are left out; quotation marks; font heights; candidates shown.
LEFT_OUT = ("dblp", "arxiv", "ieee", "hal")
QUOTES = ("\\enquote{", "}")
SMALL_SCREEN_HEIGHT, HEIGHT = 141, 181
SHOWN = 10


def glyph_table(spark: SparkSession, minus: bool = True, prime: bool = True) -> DataFrame:
    """(char, class, glyph); the minus and the prime can be left as they are (the prime where the font lacks it)."""
    left = {c for c, shown in (("-", minus), ("′", prime)) if not shown}
    return spark.createDataFrame([g for g in GLYPHS if g[0] not in left], "char string, class string, glyph string")


def class_counts(text: Column) -> Column:
    """array<struct<class, n>>: for each glyph class, how many of the text's characters are of it."""
    classes: dict[str, str] = {}
    for char, kind, _ in GLYPHS:
        if len(char) == 1:
            classes[kind] = classes.get(kind, "") + char
    size = F.length(text)
    return F.array(*(F.struct(F.lit(kind).alias("class"), (size - F.length(F.translate(text, chars, ""))).cast("long").alias("n")) for kind, chars in classes.items()))


def translated(text: Column, minus: bool = True, prime: bool = True) -> Column:
    """The text with single characters replaced by their glyphs."""
    pairs = [(c, g) for c, _, g in GLYPHS if len(c) == 1 and c != g and (minus or c != "-") and (prime or c != "′")]
    return F.translate(text, "".join(c for c, _ in pairs), "".join(g for _, g in pairs))


def tilde_font(replace_sim: Column) -> Column:
    return F.when(replace_sim, "special").otherwise("regular")


def map_literal(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def citation(key: Column, label: Column) -> Column:
    """The key's template with the label filled in; null for another key."""
    return F.replace(F.try_element_at(map_literal(CITATIONS), key), F.lit("%l"), label)


def label_reference(environment: Column, label: Column) -> Column:
    """The reference to a label with its environment's prefix; null where the environment has no template."""
    known = [x for x in LABELS if x[2]]
    prefix, template = (map_literal({x[0]: x[k] for x in known}) for k in (2, 3))
    return F.replace(F.try_element_at(template, environment), F.lit("%s"), F.concat(F.try_element_at(prefix, environment), label))


def field_kind(field: Column) -> Column:
    return F.try_element_at(map_literal({f: kind for kind, fields in FIELDS.items() for f in fields}), field)


def field_values(field: Column, value: Column) -> Column:
    """array<string>: list fields split at ' and ', separated values at commas, others whole."""
    kind = field_kind(field)
    return F.when(kind == "list", F.split(value, "\\s+and\\s+")).when(kind == "separated-values", F.split(value, "\\s*,\\s*")).otherwise(F.array(value))


def citation_key(name: Column, year: Column) -> Column:
    """Capitalised name and four-digit year, nothing between and no title words."""
    return F.concat(F.initcap(F.regexp_extract(name, "^([^, ]+)", 1)), F.right(F.concat(F.lit("000"), year.cast("string")), F.lit(4)))


def highlight(macro: Column) -> Column:
    return F.try_element_at(map_literal({m: k for k, macros in KEYWORDS.items() for m in macros}), macro)


def command_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COMMANDS), "name string, command string, help string")


def quoted(text: Column) -> Column:
    return F.concat(F.lit(QUOTES[0]), text, F.lit(QUOTES[1]))


def font_height(machine: Column, small_screens: list[str]) -> Column:
    """141 on the machines named, 181 on others."""
    return F.when(machine.isin(*small_screens), SMALL_SCREEN_HEIGHT).otherwise(HEIGHT) if small_screens else F.lit(HEIGHT)


def without_sources(sources: Column) -> Column:
    return F.array_except(sources, F.array(*map(F.lit, LEFT_OUT)))


def without(sources: Column, one: Column) -> Column:
    return F.filter(sources, lambda s: ~s.eqNullSafe(one))


def with_added(values: Column, one: Column) -> Column:
    """The list with the value in front unless it is there."""
    return F.when(F.array_contains(values, one), values).otherwise(F.concat(F.array(one), values))
