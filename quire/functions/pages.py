"""Page specifications, page numbers and names, as Column expressions.

Page numbers in specifications are 1-based and ranges inclusive.  Segment
bounds (see ``quire.operators.segments``) are 0-based and half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The title of a segment without one, the digits of a padded page number, the default threshold in percent.
UNTITLED = "Section"
DIGITS = 3
THRESHOLD = 40


def _span(start: Column, end: Column) -> Column:
    """The integers start..end; none if end < start (sequence alone would count down)."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<int>"))


def page_list(spec: Column) -> Column:
    """array<int> of a specification such as '5,1-3, 2': order and repeats kept, a descending range is empty.

    An empty part, a part that is no number and a part with two hyphens raise.
    """

    def pages(part: Column) -> Column:
        ends = F.split(part, "-", -1)
        message = F.concat(F.lit("not a page or a range of pages: '"), part, F.lit("'"))
        number = lambda s: F.trim(s).cast("int")
        one = F.array(number(F.get(ends, F.lit(0))))
        two = _span(number(F.get(ends, F.lit(0))), number(F.get(ends, F.lit(1))))
        wrong = F.raise_error(message).cast("array<int>")
        return F.when(F.size(ends) == 1, one).when(F.size(ends) == 2, two).otherwise(wrong)

    return F.flatten(F.transform(F.split(spec, ",", -1), pages))


def lenient_page_list(spec: Column) -> Column:
    """As page_list, but parts are trimmed, trailing empty parts are dropped and only the first two fields of a part count."""

    def pages(part: Column) -> Column:
        ends = F.transform(F.split(part, "-", -1), F.trim)
        first, second = (F.get(ends, F.lit(k)).cast("int") for k in (0, 1))
        return F.when(F.size(ends) == 1, F.array(first)).otherwise(_span(first, second))

    return F.flatten(F.transform(F.split(F.regexp_replace(spec, "(,\\s*)+$", ""), ",", -1), pages))


def spaced_page_list(spec: Column) -> Column:
    """As page_list, for parts between commas or blanks; runs of these count once, empty parts not at all."""
    return page_list(F.array_join(F.filter(F.split(spec, "[ ,]+"), lambda p: p != ""), ","))


def required(spec: Column) -> Column:
    """The specification, or an error if it has no page."""
    return F.when(F.trim(F.coalesce(spec, F.lit(""))) != "", spec).otherwise(F.raise_error(F.lit("no pages given")).cast("string"))


def threshold_text(arguments: Column) -> Column:
    """The threshold among arguments (array<string>): of the last one that names it, what follows the last ':' and then the last '='."""
    named = F.filter(arguments, lambda a: F.lower(a).contains("threshold"))
    value = F.element_at(F.split(F.element_at(F.split(F.try_element_at(named, F.lit(-1)), ":", -1), -1), "=", -1), -1)
    return F.coalesce(value, F.lit(str(THRESHOLD)))


def threshold_token(argument: Column) -> Column:
    """The second token of 'threshold:60' or 'threshold=60', runs of the signs counting once; the default without one."""
    tokens = F.filter(F.split(argument, "[:=]+"), lambda t: t != "")
    return F.when(F.lower(argument).contains("threshold"), F.coalesce(F.get(tokens, F.lit(1)), F.lit(str(THRESHOLD))))


def threshold(value: Column | None = None) -> Column:
    """A typed threshold in percent, with the default for null."""
    default = F.lit(THRESHOLD)
    return default if value is None else F.coalesce(value.cast("int"), default)


def folder_of(path: Column) -> Column:
    """What stands before the last slash; '.' without one."""
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def file_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    """The file's name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(file_of(path), "(?<=[^.])\\.[^.]*$", "")


def cleaned_path(path: Column) -> Column:
    folder = folder_of(path)
    return F.concat(F.when(folder == "/", F.lit("")).otherwise(folder), F.lit("/"), stem_of(path), F.lit("_cleaned.pdf"))


def cleaned_here(path: Column) -> Column:
    """The cleaned file's name in the current folder."""
    return F.concat(stem_of(path), F.lit("_cleaned.pdf"))


def slug(title: Column) -> Column:
    """Only ASCII letters, digits, blanks and hyphens stay; runs of blanks become one, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, "[^a-zA-Z0-9 \\-]", ""), " +", " "))


def titled(title: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.lit(UNTITLED))


def padded(page: Column) -> Column:
    """At least three digits; longer numbers whole."""
    return F.format_string(f"%0{DIGITS}d", page.cast("long"))


def padded_last(page: Column) -> Column:
    """Exactly the last three digits: pages 1000 apart share a name.  For compatibility only."""
    return F.right(F.concat(F.lit("0" * DIGITS), page.cast("string")), F.lit(DIGITS))


def page_file(page: Column) -> Column:
    return F.concat(F.lit("page_"), padded(page))


def segment_file(folder: Column, seq: Column, title: Column) -> Column:
    return F.concat(F.concat_ws("-", folder, seq.cast("string"), titled(title)), F.lit(".pdf"))


def part_file(seq: Column, title: Column) -> Column:
    return F.concat(seq.cast("string"), F.lit("-"), title, F.lit(".pdf"))


def pages_between(start: Column, end: Column) -> Column:
    """Pages of a half-open 0-based segment."""
    return F.when(end > start, F.sequence(start, end - 1)).otherwise(F.array().cast("array<int>"))


def pages_through(start: Column, end: Column) -> Column:
    """Pages of an inclusive range."""
    return _span(start, end)


def manifest_line(path: Column, slashes: bool = True) -> Column:
    """A quoted line of a file list; backslashes become slashes unless they are to stay."""
    shown = F.replace(path, F.lit("\\"), F.lit("/")) if slashes else path
    return F.concat(F.lit('"'), shown, F.lit('"'))


def document_info(path: Column, author: str, joint: str = "_") -> Column:
    """Title <stem>_Cleaned (or <stem>Cleaned without a joint) and the author."""
    return F.create_map(F.lit("Title"), F.concat(stem_of(path), F.lit(f"{joint}Cleaned")), F.lit("Author"), F.lit(author))


def binarised(pixels: Column, percent: Column, white: int = 255) -> Column:
    """Grey values as black (0) or white: what lies above the threshold share of white turns white first, then the rest is cut at the middle."""
    limit = percent.cast("double") / 100 * white
    return F.transform(pixels, lambda p: F.when((p > limit) | (p > white / 2), F.lit(white)).otherwise(F.lit(0)))


def numbered_pick(key: Column) -> Column:
    """Digit keys pick the nth candidate; 0 the tenth."""
    return F.when(key == 0, F.lit(10)).otherwise(key)


def matches_terms(candidate: Column, query: Column) -> Column:
    """Whether the candidate matches every blank-separated term as a regular expression, in any order."""
    return F.forall(F.filter(F.split(query, " +"), lambda t: t != ""), lambda t: F.regexp_like(candidate, t))


def matches_literally(candidate: Column, query: Column) -> Column:
    return candidate.contains(query)


def matches_folded(candidate: Column, query: Column) -> Column:
    """Substring match without case and accents."""
    fold = lambda c: F.lower(F.collate(c, "UNICODE_CI_AI"))
    return F.contains(fold(candidate), fold(query))


def long_enough(query: Column, least: int = 2) -> Column:
    return F.length(query) >= least
