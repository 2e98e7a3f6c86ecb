import pytest
from pyspark.sql import functions as F

from quire.functions import headings as H
from quire.functions import lookups as L
from quire.functions import pages as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize("spec,want", [("5,1-3, 2,9-7", [5, 1, 2, 3, 2]), ("1-10", list(range(1, 11))), ("7", [7]), ("3-3,3", [3, 3]), (" 4 - 5 ", [4, 5])])
def test_page_list(spark, spec, want):
    assert value(spark, P.page_list(F.lit(spec))) == want


@pytest.mark.parametrize("spec", ["1-2-3", "1,,2", "", "a", "1,"])
def test_page_list_rejects(spark, spec):
    with pytest.raises(Exception):
        value(spark, P.page_list(F.lit(spec)))


def test_other_page_lists(spark):
    assert value(spark, P.lenient_page_list(F.lit("1, 3-5-9,2,,"))) == [1, 3, 4, 5, 2]
    assert value(spark, P.spaced_page_list(F.lit("1,2  3-5, 9-7"))) == [1, 2, 3, 4, 5]
    assert value(spark, P.required(F.lit("1"))) == "1"
    with pytest.raises(Exception):
        value(spark, P.required(F.lit("  ")))


def test_thresholds(spark):
    lists = lambda *a: F.array(*map(F.lit, a))
    assert value(spark, P.threshold_text(lists("x.pdf", "1-3", "threshold:a=65"))) == "65"
    assert value(spark, P.threshold_text(lists("THRESHOLD=1", "threshold:2"))) == "2"
    assert value(spark, P.threshold_text(lists("x.pdf"))) == "40"
    assert value(spark, P.threshold_text(lists("my-threshold.pdf"))) == "my-threshold.pdf"
    assert value(spark, P.threshold_token(F.lit("threshold:a=65"))) == "a"
    assert value(spark, P.threshold(F.lit(None))) == 40 and value(spark, P.threshold(F.lit("7"))) == 7


@pytest.mark.parametrize("path,folder,stem,out", [("a/b.c/d.e.pdf", "a/b.c", "d.e", "a/b.c/d.e_cleaned.pdf"), ("x.pdf", ".", "x", "./x_cleaned.pdf"), ("a.b/c", "a.b", "c", "a.b/c_cleaned.pdf"), ("/x.pdf", "/", "x", "/x_cleaned.pdf"), (".hidden", ".", ".hidden", "./.hidden_cleaned.pdf")])
def test_paths(spark, path, folder, stem, out):
    assert (value(spark, P.folder_of(F.lit(path))), value(spark, P.stem_of(F.lit(path))), value(spark, P.cleaned_path(F.lit(path)))) == (folder, stem, out)
    assert value(spark, P.cleaned_here(F.lit(path))) == f"{stem}_cleaned.pdf"


@pytest.mark.parametrize("title,want", [("  1.  What?  is: Ethics* ", "1 What is Ethics"), ("Über\tcafé – x", "bercaf x"), ("???", "")])
def test_slug(spark, title, want):
    assert value(spark, P.slug(F.lit(title))) == want
    assert value(spark, P.titled(P.slug(F.lit(title)))) == (want or "Section")


def test_names(spark):
    assert [value(spark, P.padded(F.lit(n))) for n in (7, 99, 1234)] == ["007", "099", "1234"]
    assert [value(spark, P.padded_last(F.lit(n))) for n in (7, 1234, 2234)] == ["007", "234", "234"]
    assert value(spark, P.segment_file(F.lit("F"), F.lit(1), F.lit("Ch1"))) == "F-1-Ch1.pdf"
    assert value(spark, P.part_file(F.lit(2), F.lit("Intro"))) == "2-Intro.pdf"
    assert value(spark, P.manifest_line(F.lit("a\\b.pdf"))) == '"a/b.pdf"' and value(spark, P.manifest_line(F.lit("a\\b.pdf"), False)) == '"a\\b.pdf"'
    assert value(spark, P.document_info(F.lit("d/x.pdf"), "me")) == {"Title": "x_Cleaned", "Author": "me"}
    assert value(spark, P.document_info(F.lit("d/x.pdf"), "me", "")) == {"Title": "xCleaned", "Author": "me"}
    assert value(spark, P.pages_between(F.lit(2), F.lit(2))) == [] and value(spark, P.pages_through(F.lit(2), F.lit(4))) == [2, 3, 4]
    assert value(spark, P.binarised(F.array(F.lit(10), F.lit(110), F.lit(200)), F.lit(40))) == [0, 255, 255]
    assert [value(spark, P.numbered_pick(F.lit(k))) for k in (0, 3)] == [10, 3]


def test_matching(spark):
    assert value(spark, P.matches_terms(F.lit("alpha beta"), F.lit("be.a al")))
    assert not value(spark, P.matches_terms(F.lit("alpha"), F.lit("al z")))
    assert value(spark, P.matches_literally(F.lit("a.b"), F.lit("."))) and not value(spark, P.matches_literally(F.lit("ab"), F.lit(".")))
    assert value(spark, P.matches_folded(F.lit("Café"), F.lit("cafe")))
    assert value(spark, P.long_enough(F.lit("ab"))) and not value(spark, P.long_enough(F.lit("a")))


def test_roman(spark):
    got = [value(spark, H.roman(F.lit(n))) for n in (1, 4, 9, 14, 40, 90, 444, 1994, 3999, 0, 4000)]
    assert got == ["I", "IV", "IX", "XIV", "XL", "XC", "CDXLIV", "MCMXCIV", "MMMCMXCIX", None, None]


def test_style_options(spark):
    options = H.options_of(F.lit("evans, hempel ,sectionspace=::,so=ls,sonum=30,it=false,sonum=31"))
    assert value(spark, options) == {"evans": "true", "hempel": "true", "sectionspace": "::", "so": "ls", "sonum": "31", "it": "false"}
    assert value(spark, H.layout(options)) == "evans" and not value(spark, H.is_on(options, "it"))
    assert value(spark, H.letter_space(options, F.lit(True))) == "31" and value(spark, H.letter_space(options, F.lit(False))) == "microtype"
    assert value(spark, H.inline_title(F.lit("T"), options)) == "T.::"
    assert value(spark, H.unknown_options(H.options_of(F.lit("evanshempel,what")))) == ["what", "evanshempel without evans"]
    assert [value(spark, H.title_font(H.options_of(F.lit(o)), F.lit(True))) for o in ("", "oldnums,nobold", "nobold", "nosectfont,oldnums")] == ["lining", "oldstyle", "bold", "normal"]
    assert value(spark, H.title_font(H.options_of(F.lit("")), F.lit(False))) == "none"
    tf = H.options_of(F.lit("tf"))
    assert value(spark, H.title_font_set(tf, F.lit(True))) and not value(spark, H.small_caps(tf, F.lit(True))) and value(spark, H.small_caps(tf, F.lit(False)))
    assert value(spark, H.centred_title(F.lit("T"), F.lit("subparagraph"))) == "T.---"
    assert value(spark, H.subparagraph(F.lit("T"), F.lit(True))).asDict() == {"in_format": "T", "before": "", "tail": ".~~"}
    assert value(spark, H.heading_end(F.lit("T"), F.lit(None).cast("string"))) == "T.---" and value(spark, H.or_default(F.lit(None), "x")) == "x"


def test_lookups(spark):
    assert value(spark, L.translated(F.lit("a-b′c"))) == "a−b'c" and value(spark, L.translated(F.lit("a-b′"), False, False)) == "a-b′"
    assert L.glyph_table(spark).count() == 23 and L.glyph_table(spark, False, False).count() == 21
    assert value(spark, L.citation(F.lit("Y"), F.lit("k"))) == "~\\citeyear[]{k}" and value(spark, L.citation(F.lit("?"), F.lit("k"))) is None
    assert value(spark, L.label_reference(F.lit("exe"), F.lit("one"))) == "~\\eqref{eq:one}" and value(spark, L.label_reference(F.lit("eqtext"), F.lit("one"))) is None
    assert value(spark, L.field_values(F.lit("author"), F.lit("A and B"))) == ["A", "B"] and value(spark, L.field_values(F.lit("keywords"), F.lit("x, y"))) == ["x", "y"]
    assert value(spark, L.citation_key(F.lit("evans"), F.lit(1999))) == "Evans1999" and value(spark, L.highlight(F.lit("sn"))) == "string"
    assert value(spark, L.quoted(F.lit("x"))) == "\\enquote{x}" and value(spark, L.tilde_font(F.lit(True))) == "special"
    assert value(spark, L.font_height(F.lit("a"), ["a"])) == 141 and value(spark, L.font_height(F.lit("b"), ["a"])) == 181 and value(spark, L.font_height(F.lit("b"), [])) == 181
    lists = F.array(F.lit("dblp"), F.lit("crossref"), F.lit("hal"))
    assert value(spark, L.without_sources(lists)) == ["crossref"] and value(spark, L.without(lists, F.lit("hal"))) == ["dblp", "crossref"]
    assert value(spark, L.with_added(lists, F.lit("x")))[0] == "x" and value(spark, L.with_added(lists, F.lit("hal"))) == ["dblp", "crossref", "hal"]
    assert L.command_table(spark).count() == 4
