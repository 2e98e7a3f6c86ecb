"""Section numbers, heading styles and their defaults, as Column expressions over a map<string,string> of style options."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Style options and their values when named without one.
OPTIONS = {
    "tf": "true",
    "oldnums": "true",
    "b": "true",
    "it": "true",
    "sc": "true",
    "sf": "true",
    "so": "soul",
    "sonum": "25",
    "nobold": "true",
    "nosectfont": "true",
    "evans": "true",
    "hempel": "true",
    "inline": "true",
    "nosect": "true",
    "para": "true",
    "sectionspace": "---",
    "evanshempel": "true",
}

#: Defaults where nothing is named: letter spacing, separators, endings, fonts by layout.
LETTER_SPACE = "25"
SECTION_SPACE = "---"
SECTION_SEPARATOR = "---"
SUBPARAGRAPH_SEPARATOR = "~"
ENDING = "."
LAYOUTS = {
    # layout: (section shape, section number, section font, subsection shape, subsection font, subsection numbers continue)
    "newdisplay": ("block", "arabic", "scshape", None, None, False),
    "newevans": ("block", "Roman", "bfseries", "runin", None, True),
    "newevanshempel": ("block", "Roman", "bfseries", "runin", "bfseries", True),
    "newhempel": ("runin", "arabic", "bfseries", None, None, False),
}


def options_of(text: Column) -> Column:
    """map<string,string> of 'name=value,name'; a name without a value has its option's own."""
    defaults = F.create_map(*(F.lit(x) for pair in OPTIONS.items() for x in pair))
    parts = F.filter(F.transform(F.split(text, ","), F.trim), lambda p: p != "")

    def entry(p: Column) -> Column:
        name = F.trim(F.substring_index(p, "=", 1))
        value = F.when(p.contains("="), F.trim(F.regexp_replace(p, "^[^=]*=", ""))).otherwise(F.try_element_at(defaults, name))
        return F.struct(name, F.coalesce(value, F.lit("true")))

    # The last of several values holds, as options are read in order.
    unique = F.aggregate(parts, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != entry(p)["col1"]), F.map_from_entries(F.array(entry(p)))))
    return unique


def is_on(options: Column, name: str) -> Column:
    """The option's flag, false unless set."""
    if name in ("evans", "oldnums", "b", "sf", "nobold", "hempel", "inline", "nosect", "para", "evanshempel", "so"):
        return F.coalesce(F.map_contains_key(options, F.lit(name)), F.lit(False))
    return F.coalesce(F.try_element_at(options, F.lit(name)) == "true", F.lit(False))


def title_font_set(options: Column, xetex: Column) -> Column:
    """tf names a title font where fonts can be loaded."""
    return xetex & is_on(options, "tf")


def small_caps(options: Column, xetex: Column) -> Column:
    """sc, or tf where no font can be loaded."""
    return is_on(options, "sc") | (~xetex & F.coalesce(F.map_contains_key(options, F.lit("tf")), F.lit(False)))


def layout(options: Column) -> Column:
    """centred unless evans, inline or evanshempel is set; evanshempel alone has no layout of its own."""
    return F.when(is_on(options, "evans"), "evans").when(is_on(options, "inline"), "inline").when(is_on(options, "evanshempel"), "none").otherwise("centred")


def title_font(options: Column, xetex: Column) -> Column:
    """The title font's rule: skipped, old-style numerals, bold, lining numerals - the first that applies; nothing without XeTeX."""
    rule = F.when(is_on(options, "nosectfont"), "normal").when(is_on(options, "oldnums"), "oldstyle").when(is_on(options, "nobold"), "bold").otherwise("lining")
    return F.when(xetex, rule).otherwise("none")


def title_symbol(options: Column) -> Column:
    return F.when(is_on(options, "para"), "§").otherwise("")


def letter_space(options: Column, xetex: Column) -> Column:
    """How titles are spaced out: 'soul', a number for the font, or null."""
    amount = F.when(xetex, F.coalesce(F.try_element_at(options, F.lit("sonum")), F.lit(LETTER_SPACE))).otherwise("microtype")
    return F.when(is_on(options, "so"), F.when(F.try_element_at(options, F.lit("so")) == "soul", "soul").otherwise(amount))


def inline_title(title: Column, options: Column) -> Column:
    """The title, a full stop, and with hempel the section space."""
    space = F.coalesce(F.try_element_at(options, F.lit("sectionspace")), F.lit(SECTION_SPACE))
    return F.concat(title, F.lit(ENDING), F.when(is_on(options, "hempel"), space).otherwise(""))


def centred_title(title: Column, level: Column) -> Column:
    """Centred layout: subparagraph titles end in a full stop and a dash."""
    return F.when(level == "subparagraph", F.concat(title, F.lit(ENDING + SECTION_SEPARATOR))).otherwise(title)


def evans_title(title: Column, level: Column, options: Column) -> Column:
    """Evans layout: paragraphs as inline ones; nosect turns sections into empty paragraphs."""
    return F.when(level == "paragraph", inline_title(title, options)).when((level == "section") & is_on(options, "nosect"), F.lit("")).otherwise(title)


def unknown_options(options: Column) -> Column:
    """Names that are no option, and combinations that do nothing."""
    unknown = F.filter(F.map_keys(options), lambda k: ~k.isin(*OPTIONS))
    idle = F.when(is_on(options, "evanshempel") & ~is_on(options, "evans"), F.array(F.lit("evanshempel without evans"))).otherwise(F.array().cast("array<string>"))
    idle_space = F.when(is_on(options, "hempel") & ~is_on(options, "evans") & ~is_on(options, "inline"), F.array(F.lit("hempel without inline or evans"))).otherwise(F.array().cast("array<string>"))
    return F.concat(unknown, idle, idle_space)


def or_default(value: Column, default: str) -> Column:
    return F.coalesce(value, F.lit(default))


def heading_end(title: Column, ending: Column | None = None, separator: str = SECTION_SEPARATOR) -> Column:
    """Title, ending and separator."""
    return F.concat(title, F.lit(ENDING) if ending is None else F.coalesce(ending, F.lit(ENDING)), F.lit(separator))


def subparagraph(title: Column, explicit: Column, ending: Column | None = None) -> Column:
    """The subparagraph's run-in heading: in explicit mode its text is part of the format, else it stands before it; both end alike."""
    tail = F.concat(F.lit(ENDING) if ending is None else F.coalesce(ending, F.lit(ENDING)), F.lit(SUBPARAGRAPH_SEPARATOR * 2))
    return F.struct(F.when(explicit, title).otherwise("").alias("in_format"), F.when(explicit, "").otherwise(title).alias("before"), tail.alias("tail"))


def roman(number: Column) -> Column:
    """Capital roman numerals of 1 to 3999; null otherwise."""
    n = number.cast("int")
    row = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    digit = lambda symbols, value: F.get(F.array(*map(F.lit, symbols)), F.floor(n / F.lit(value)).cast("int") % 10)
    text = F.concat(digit(["", "M", "MM", "MMM", "", "", "", "", "", ""], 1000), digit(row("C", "D", "M"), 100), digit(row("X", "L", "C"), 10), digit(row("I", "V", "X"), 1))
    return F.when((n >= 1) & (n <= 3999), text)
