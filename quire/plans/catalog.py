"""Registered queries over the provided tables, each with its SQL oracle.

The tables hold no paged documents, so the operators run on analogues: a
conversation is a document, its turns are pages and its user turns bookmarks;
a document's lines are pages; regions and nations form an outline; headings
of web pages are titles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import headings as H
from quire.functions import lookups as L
from quire.functions import pages as P
from quire.operators import candidates, headings, pages, segments

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bookmarks(spark, d):
    turns = table(spark, d, "conversations")
    docs = turns.groupBy("conv_id").agg((F.max("turn") + 1).cast("int").alias("num_pages"))
    marks = turns.filter("role = 'user'").select("conv_id", F.col("turn").cast("int").alias("ord"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("title"), F.col("turn").cast("int").alias("start"))
    return marks, docs


_SEGMENTS = """
    WITH docs AS (SELECT conv_id, max(turn) + 1 AS num_pages FROM conversations GROUP BY conv_id),
    marks AS (
        SELECT c.conv_id, c.turn AS st, 'turn ' || c.turn AS title, num_pages,
               row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS seq,
               coalesce(lead(c.turn) OVER (PARTITION BY c.conv_id ORDER BY c.turn), num_pages) AS nx
        FROM conversations c JOIN docs USING (conv_id) WHERE role = 'user'),
    seg AS (SELECT conv_id, seq, title, st, CASE WHEN nx <= st THEN least(st + 1, num_pages) ELSE nx END AS en FROM marks)
"""


@query(f'{_SEGMENTS} SELECT conv_id, CAST(seq AS INT) AS seq, title, CAST(st AS INT) AS "start", CAST(en AS INT) AS "end" FROM seg')
def segments_(spark, d):
    """Bookmarks to segments."""
    marks, docs = _bookmarks(spark, d)
    return segments.segments(marks, docs, "conv_id")


QUERIES["segments"], ORACLES["segments"] = QUERIES.pop("segments_"), ORACLES.pop("segments_")


@query(f"{_SEGMENTS} SELECT conv_id, CAST(seq AS INT) AS seq, CAST(unnest(range(st, en)) AS INT) AS page FROM seg")
def segment_pages_explode(spark, d):
    marks, docs = _bookmarks(spark, d)
    return segments.segment_pages(segments.segments(marks, docs, "conv_id"), "conv_id").select("conv_id", "seq", "page")


@query(f"{_SEGMENTS} SELECT conv_id, CAST(seq AS INT) AS seq, CAST(turn AS INT) AS page, role FROM seg JOIN conversations c USING (conv_id) WHERE turn >= st AND turn < en")
def segment_pages_join(spark, d):
    marks, docs = _bookmarks(spark, d)
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("page"), "role")
    return segments.assign_pages(turns, segments.segments(marks, docs, "conv_id"), "conv_id").select("conv_id", "seq", "page", "role")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '[^a-zA-Z0-9 \\-]', '', 'g'), ' +', ' ', 'g'), ' ') AS slug FROM pages")
def slug_titles(spark, d):
    return table(spark, d, "pages").select("page_id", P.slug(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("slug"))


@query(
    """WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)
    SELECT doc_id, CAST(page AS INT) AS page, line FROM lines WHERE page IN (1, 2, 3, 5)"""
)
def page_select(spark, d):
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("page"), "line")
    requests = docs.select("doc_id", F.lit("5,1-3, 2,9-7").alias("pages"))
    return pages.select(lines, requests)


@query("SELECT doc_id, 5 AS page FROM documents")
def preview_first(spark, d):
    return pages.preview(table(spark, d, "documents").select("doc_id", F.lit("5,1-3").alias("pages")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS padded FROM orders")
def padded_name(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.padded(F.col("o_orderkey")).alias("padded"))


@query("SELECT right('000' || CAST(o_orderkey AS VARCHAR), 3) AS name, count(*) AS pages FROM orders GROUP BY 1")
def pad3_collisions(spark, d):
    return table(spark, d, "orders").groupBy(P.padded_last(F.col("o_orderkey")).alias("name")).agg(F.count("*").alias("pages"))


_FILE = "'page_' || CASE WHEN o_orderkey < 1000 THEN lpad(CAST(o_orderkey AS VARCHAR), 3, '0') ELSE CAST(o_orderkey AS VARCHAR) END"


@query(f"SELECT o_custkey, {_FILE} AS file, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {_FILE}) AS INT) AS place FROM orders")
def lexicographic_order(spark, d):
    """A customer is a document, its orders are pages."""
    from pyspark.sql import Window

    rows = table(spark, d, "orders").select("o_custkey", P.page_file(F.col("o_orderkey")).alias("file"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("o_custkey").orderBy("file")))


@query(
    """WITH RECURSIVE entries AS (
        SELECT CAST(r_regionkey AS INT) AS id, CAST(NULL AS INT) AS parent, CAST(r_regionkey AS INT) AS ord, r_name AS title FROM region
        UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_nationkey, n_name FROM nation),
    outline AS (
        SELECT id, title, [ord] AS path FROM entries WHERE parent IS NULL
        UNION ALL SELECT e.id, e.title, list_append(o.path, e.ord) FROM entries e JOIN outline o ON e.parent = o.id)
    SELECT id, title, CAST(row_number() OVER (ORDER BY path) AS INT) AS ord FROM outline"""
)
def outline_flatten(spark, d):
    one = F.lit(0).alias("doc_id")
    top = table(spark, d, "region").select(one, F.col("r_regionkey").alias("id"), F.lit(None).cast("int").alias("parent"), F.col("r_regionkey").alias("ord"), F.col("r_name").alias("title"))
    below = table(spark, d, "nation").select(one, (F.col("n_nationkey") + 100).alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("title"))
    return segments.flatten_outline(top.unionByName(below).withColumn("start", F.col("ord"))).select("id", "title", "ord")


_COUNTERS = """WITH h AS (
        SELECT r_regionkey AS region, -1 AS pos, 'section' AS level FROM region
        UNION ALL SELECT n_regionkey, n_nationkey, 'subsection' FROM nation)
    SELECT region, pos, level, CAST(sum(CASE WHEN level = 'section' THEN 1 ELSE 0 END) OVER w AS INT) AS section,
        CAST(sum(CASE WHEN level = 'subsection' THEN 1 ELSE 0 END) OVER {w} AS INT) AS subsection FROM h
    WINDOW w AS (ORDER BY region, pos), v AS (PARTITION BY region ORDER BY pos)"""


def _headings(spark, d):
    top = table(spark, d, "region").select(F.col("r_regionkey").alias("region"), F.lit(-1).alias("pos"), F.lit("section").alias("level"))
    below = table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("pos"), F.lit("subsection").alias("level"))
    return top.unionByName(below).withColumn("doc_id", F.lit(0)).withColumn("at", F.struct("region", "pos"))


@query(_COUNTERS.format(w="w"))
def section_counters(spark, d):
    return headings.counters(_headings(spark, d), order="at").select("region", "pos", "level", "section", "subsection")


@query(_COUNTERS.format(w="v"))
def section_counters_reset(spark, d):
    return headings.counters(_headings(spark, d), order="at", continuous=False).select("region", "pos", "level", "section", "subsection")


@query("SELECT n_nationkey, ['I','II','III','IV','V'][n_regionkey + 1] || '.' || n_nationkey AS number FROM nation")
def roman_section(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.concat_ws(".", H.roman(F.col("n_regionkey") + 1), F.col("n_nationkey").cast("string")).alias("number"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'e') AND regexp_matches(p_name, 'a.*t')")
def unordered_filter(spark, d):
    return candidates.filtered(table(spark, d, "part").select("p_partkey", "p_name"), F.lit("a.*t e"), "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'a') AND length('a.') >= 2 AND NOT contains(p_name, 'a.')")
def literal_filter(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_name").filter(P.long_enough(F.lit("a.")))
    return candidates.filtered(rows, F.lit("a"), "p_name", literal=True).filter(~P.matches_literally(F.col("p_name"), F.lit("a.")))


@query("SELECT doc_id, translate(text, '-′', '−''') AS text FROM documents")
def glyph_translate(spark, d):
    return table(spark, d, "documents").select("doc_id", L.translated(F.col("text")).alias("text"))


@query("SELECT class, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) t JOIN (VALUES (',','punct'),(':','rel'),('.','ord'),('<','rel'),('>','rel'),('=','rel'),('+','rel'),('/','ord'),('*','ord'),('&','ord'),('#','ord'),('(','ord'),(')','ord'),('[','ord'),(']','ord'),('≠','rel'),('≈','rel'),('…','inner'),('′','inner'),('-','bin')) g(ch, class) ON t.c = g.ch GROUP BY class")
def glyph_classes(spark, d):
    counts = table(spark, d, "documents").select(F.inline(L.class_counts(F.col("text")))).filter("n > 0")
    return counts.groupBy("class").agg(F.sum("n").alias("n"))


@query("SELECT vec_id, [CASE WHEN CAST(x AS DOUBLE) > 0.4 THEN 1 ELSE 0 END FOR x IN embedding] AS pixels FROM embeddings")
def binarise_array(spark, d):
    """A threshold rule on arrays; white is 1, the middle cut lies above the threshold here."""
    return table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.when(x.cast("double") > P.threshold() / 100, F.lit(1)).otherwise(F.lit(0))).alias("pixels"))


@query("SELECT p_partkey, p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def first_ten(spark, d):
    return candidates.shown(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), F.desc("p_retailprice"), "p_partkey").select("p_partkey", "p_name")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS merged FROM conversations GROUP BY conv_id")
def ordered_merge(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("int").alias("page"), "text")
    return pages.merged(turns, "text", "conv_id").select("conv_id", F.array_join("payloads", "\n").alias("merged"))


@query("SELECT p_partkey, 'parts-' || p_size || '-' || coalesce(nullif(trim(regexp_replace(p_type, '[^a-zA-Z0-9 \\-]', '', 'g'), ' '), ''), 'Section') || '.pdf' AS file FROM part")
def segment_name(spark, d):
    return table(spark, d, "part").select("p_partkey", P.segment_file(F.lit("parts"), F.col("p_size"), P.slug(F.col("p_type"))).alias("file"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '~\\citet[]{' || p_brand || '}' WHEN 1 THEN '~\\citep[]{' || p_brand || '}' ELSE NULL END AS reference FROM part")
def cite_template(spark, d):
    key = F.get(F.array(F.lit("t"), F.lit("p"), F.lit("?")), (F.col("p_partkey") % 3).cast("int"))
    return table(spark, d, "part").select("p_partkey", L.citation(key, F.col("p_brand")).alias("reference"))


@query("SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 = 0 THEN 10 ELSE p_partkey % 10 END AS INT) AS pick FROM part")
def numbered_pick(spark, d):
    return table(spark, d, "part").select("p_partkey", P.numbered_pick((F.col("p_partkey") % 10).cast("int")).alias("pick"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '65' WHEN 1 THEN '40' ELSE 'x' END AS threshold FROM part")
def threshold_argument(spark, d):
    arguments = F.when(F.col("p_size") % 3 == 0, F.array(F.lit("a.pdf"), F.lit("Threshold:a=65"))).when(F.col("p_size") % 3 == 1, F.array(F.lit("1-3"))).otherwise(F.array(F.lit("threshold:1"), F.lit("threshold=x")))
    return table(spark, d, "part").select("p_partkey", P.threshold_text(arguments).alias("threshold"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS folder, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS stem FROM pages")
def path_parts(spark, d):
    return table(spark, d, "pages").select("page_id", P.folder_of(F.col("url")).alias("folder"), P.stem_of(F.col("url")).alias("stem"))


@query(
    """WITH l AS (SELECT s_suppkey, s_name || ';;' || s_nationkey || ';' || (s_nationkey + 2) AS line FROM supplier)
    SELECT s_suppkey, split_part(line, ';', 1) AS title, CAST(unnest(range(CAST(split_part(line, ';', 3) AS INT), CAST(split_part(line, ';', 4) AS INT) + 1)) AS INT) AS page FROM l"""
)
def parts_list(spark, d):
    from quire.sources import files

    line = F.concat_ws(";", "s_name", F.lit(""), F.col("s_nationkey").cast("string"), (F.col("s_nationkey") + 2).cast("string"))
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("ord"), line.alias("value"))
    return segments.part_pages(files.parsed_parts(lines)).select(F.col("ord").alias("s_suppkey"), "title", "page")


_STYLES = ("", "evans,hempel", "inline,hempel,sectionspace=::", "evanshempel", "evans,nosect,para", "tf,oldnums,so", "inline,so=ls,sonum=30")


@query(
    """SELECT n_nationkey,
        ['centred','evans','inline','none','evans','centred','inline'][n_nationkey % 7 + 1] AS layout,
        ['lining','lining','lining','lining','lining','oldstyle','lining'][n_nationkey % 7 + 1] AS font,
        ['','','','','§','',''][n_nationkey % 7 + 1] AS symbol,
        [NULL,NULL,NULL,NULL,NULL,'soul','30'][n_nationkey % 7 + 1] AS letter_space,
        CASE n_nationkey % 7 WHEN 2 THEN n_name || '.::' WHEN 4 THEN '' WHEN 6 THEN n_name || '.' ELSE n_name END AS shown
    FROM nation"""
)
def heading_styles(spark, d):
    texts = F.get(F.array(*map(F.lit, _STYLES)), F.col("n_nationkey") % 7)
    rows = table(spark, d, "nation").withColumn("options", H.options_of(texts)).withColumn("level", F.lit("section")).withColumn("title", F.col("n_name"))
    return headings.styled(rows, F.col("options"), F.lit(True)).select("n_nationkey", "layout", "font", "symbol", "letter_space", "shown")


@query("SELECT n_nationkey, n_name || '.---' AS heading FROM nation")
def heading_suffix(spark, d):
    return table(spark, d, "nation").select("n_nationkey", H.heading_end(F.col("n_name")).alias("heading"))


@query("SELECT c_custkey, ['multiline','list','ref','file','literal','separated-values','language',NULL][c_custkey % 8 + 1] AS kind FROM customer")
def field_kinds(spark, d):
    field = F.get(F.array(*map(F.lit, ("note", "author", "xref", "file", "journal", "keywords", "language", "doi"))), (F.col("c_custkey") % 8).cast("int"))
    return table(spark, d, "customer").select("c_custkey", L.field_kind(field).alias("kind"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE '~\\eqref{eq:' || c_name || '}' END AS reference FROM customer")
def label_references(spark, d):
    environment = F.get(F.array(*map(F.lit, ("eqclaim", "exe", "eqtext"))), (F.col("c_custkey") % 3).cast("int"))
    return table(spark, d, "customer").select("c_custkey", L.label_reference(environment, F.col("c_name")).alias("reference"))


@query("SELECT DISTINCT name FROM (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation)")
def candidate_union(spark, d):
    nations = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return candidates.union(nations, table(spark, d, "region").select(F.col("r_name").alias("name")), nations)


@query("SELECT o_orderkey, upper(substr(o_orderpriority, 3, 1)) || lower(regexp_replace(substr(o_orderpriority, 4), '[ ,].*$', '')) || year(o_orderdate) AS cite_key FROM orders")
def citation_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", L.citation_key(F.regexp_replace(F.substring("o_orderpriority", 3, 40), "[ ,].*$", ""), F.year("o_orderdate")).alias("cite_key"))


@query("SELECT '\"' || replace(p_name, '\\', '/') || '\"' AS line FROM part")
def manifest(spark, d):
    return table(spark, d, "part").select(P.manifest_line(F.col("p_name")).alias("line"))


_SPECS = ("5,1-3, 2,9-7", " 4 - 6 , 2,,", "7-9-11,3", "1")


def _spec(n):
    return F.get(F.array(*map(F.lit, _SPECS)), (n % 4).cast("int"))


@query("SELECT s_suppkey, [[5,1,2,3,2],[4,5,6,2],[7,8,9,3],[1]][s_suppkey % 4 + 1] AS pages FROM supplier")
def lenient_pages(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", P.lenient_page_list(_spec(F.col("s_suppkey"))).alias("pages"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN [5,1,2,3,2] ELSE [1,4,4] END AS pages FROM supplier")
def spaced_pages(spark, d):
    spec = F.when(F.col("s_suppkey") % 2 == 0, "5 1-3,, 2  9-7").otherwise(" 1 4-4,4,")
    return table(spark, d, "supplier").select("s_suppkey", P.spaced_page_list(spec).alias("pages"))


@query("SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || '-' || (s_nationkey + 1) AS spec FROM supplier")
def required_spec(spark, d):
    spec = F.concat_ws("-", F.col("s_nationkey").cast("string"), (F.col("s_nationkey") + 1).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", P.required(spec).alias("spec"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 40 END AS threshold FROM part")
def typed_threshold(spark, d):
    return table(spark, d, "part").select("p_partkey", P.threshold(F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))).alias("threshold"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) WHEN 2 THEN '40' END AS token FROM part")
def threshold_tokens(spark, d):
    size = F.col("p_size").cast("string")
    argument = F.get(F.array(F.concat(F.lit("threshold:"), size), F.concat(F.lit("Threshold=:"), size, F.lit("=x")), F.lit("threshold="), F.concat(F.lit("1-"), size)), F.col("p_size") % 4)
    return table(spark, d, "part").select("p_partkey", P.threshold_token(argument).alias("token"))


_PATHS = "CASE p_partkey % 4 WHEN 0 THEN 'scans.v2/' || p_name || '.pdf' WHEN 1 THEN p_name || '.tar.pdf' WHEN 2 THEN '/a.b/' || p_name ELSE '/' || p_name || '.pdf' END"


def _paths(spark, d):
    name, of = F.col("p_name"), F.col("p_partkey") % 4
    path = F.when(of == 0, F.concat(F.lit("scans.v2/"), name, F.lit(".pdf"))).when(of == 1, F.concat(name, F.lit(".tar.pdf"))).when(of == 2, F.concat(F.lit("/a.b/"), name)).otherwise(F.concat(F.lit("/"), name, F.lit(".pdf")))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'scans.v2/' || p_name WHEN 1 THEN './' || p_name || '.tar' WHEN 2 THEN '/a.b/' || p_name ELSE '/' || p_name END || '_cleaned.pdf' AS output FROM part")
def cleaned_paths(spark, d):
    return _paths(spark, d).select("p_partkey", P.cleaned_path(F.col("path")).alias("output"))


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 1 THEN '.tar' ELSE '' END || '_cleaned.pdf' AS output FROM part")
def cleaned_in_current_folder(spark, d):
    return _paths(spark, d).select("p_partkey", P.cleaned_here(F.col("path")).alias("output"))


@query("SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 1 THEN '.tar' ELSE '' END || '_Cleaned' AS title, 'me' AS author FROM part")
def document_metadata(spark, d):
    info = P.document_info(F.col("path"), "me")
    return _paths(spark, d).select("p_partkey", info["Title"].alias("title"), info["Author"].alias("author"))


@query("SELECT unnest(['nation.parquet', 'region.parquet']) AS name")
def files_by_pattern(spark, d):
    from quire.sources import files

    return files.documents(spark, d, "{nation,region}.parquet").select("name")


@query("SELECT p_partkey, p_size || '-' || p_type || '.pdf' AS file FROM part")
def part_files(spark, d):
    return table(spark, d, "part").select("p_partkey", P.part_file(F.col("p_size"), F.col("p_type")).alias("file"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Section' ELSE p_type END AS title FROM part")
def untitled_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", P.titled(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_type"))).alias("title"))


@query("SELECT vec_id, [CASE WHEN CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256 > 255 * 0.4 THEN 255 ELSE 0 END FOR x IN embedding] AS pixels FROM embeddings")
def binarised_pixels(spark, d):
    grey = F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 1000) % 256)
    return table(spark, d, "embeddings").select("vec_id", P.binarised(grey, P.threshold()).alias("pixels"))


def _turn_pages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.col("text").alias("path"))


def _faked():
    """Fakes of the cleaning steps: a raster for texts whose length is no multiple of 5, no recognition for multiples of 7."""

    def rasterise(path, page):
        return path.encode() if len(path) % 5 else None

    def recognise(image):
        if len(image.decode()) % 7 == 0:
            raise ValueError("unreadable")
        return image.upper() if image.isascii() else image

    return pages.cleaning(rasterise, lambda image, percent: image[: percent * 100], recognise)


_CLEANED = "SELECT conv_id AS doc_id, CAST(turn AS INT) AS page, CASE WHEN length(text) % 5 = 0 THEN 'rasterise: no result' WHEN length(text) % 7 = 0 THEN 'recognise: unreadable' END AS error FROM conversations"


@query(_CLEANED)
def cleaning_permissive(spark, d):
    return pages.process(_turn_pages(spark, d), _faked()).select("doc_id", "page", "error")


@query(f"SELECT doc_id, page FROM ({_CLEANED}) WHERE error IS NULL")
def cleaning_dropmalformed(spark, d):
    return pages.process(_turn_pages(spark, d), _faked(), mode="dropmalformed").select("doc_id", "page")


@query(f"SELECT doc_id, page, error FROM ({_CLEANED}) WHERE error IS NOT NULL")
def cleaning_errors(spark, d):
    return pages.errors(pages.process(_turn_pages(spark, d), _faked()))


@query("SELECT conv_id AS doc_id, CAST(turn AS INT) AS page FROM conversations WHERE length(text) % 35 IN (1, 2, 3, 4, 6)")
def cleaning_failfast(spark, d):
    return pages.process(_turn_pages(spark, d).filter("length(path) % 35 IN (1, 2, 3, 4, 6)"), _faked(), mode="failfast").select("doc_id", "page")


@query(f"SELECT doc_id, list(DISTINCT page ORDER BY page) AS pages FROM ({_CLEANED}) WHERE error IS NULL GROUP BY doc_id")
def merged_permissive(spark, d):
    made = pages.merged(pages.process(_turn_pages(spark, d), _faked()), "payload", error="error")
    return made.select("doc_id", F.transform("files", lambda f: F.substring(f, 6, 9).cast("int")).alias("pages"))


@query(f"SELECT doc_id, list(DISTINCT page ORDER BY page) AS pages FROM ({_CLEANED}) GROUP BY doc_id HAVING count(error) = 0")
def merged_dropmalformed(spark, d):
    made = pages.merged(pages.process(_turn_pages(spark, d), _faked()), "payload", mode="dropmalformed", error="error")
    return made.select("doc_id", F.transform("files", lambda f: F.substring(f, 6, 9).cast("int")).alias("pages"))


@query("SELECT p_partkey, CAST(row_number() OVER (ORDER BY p_partkey) AS INT) AS seq FROM part")
def parts_in_input_order(spark, d):
    return segments.numbered_parts(table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("ord"))).select("p_partkey", "seq")


@query('SELECT conv_id, CAST(0 AS INT) AS seq, text AS title, CAST(0 AS INT) AS "start", CAST(0 AS INT) AS "end" FROM conversations WHERE false')
def no_bookmarks(spark, d):
    marks, docs = _bookmarks(spark, d)
    return segments.segments(marks.filter("title = ''"), docs, "conv_id")


_FLAGS = ("tf", "tf,sc", "sc", "evanshempel,bogus", "hempel", "inline,hempel")


def _flags(spark, d):
    return table(spark, d, "nation").withColumn("options", H.options_of(F.get(F.array(*map(F.lit, _FLAGS)), F.col("n_nationkey") % 6))).withColumn("xetex", F.col("n_regionkey") % 2 == 0)


@query("SELECT n_nationkey, n_regionkey % 2 = 0 AND n_nationkey % 6 < 2 AS title_font, n_nationkey % 6 IN (1, 2) OR (n_regionkey % 2 = 1 AND n_nationkey % 6 < 2) AS small_caps FROM nation")
def title_fonts(spark, d):
    return _flags(spark, d).select("n_nationkey", H.title_font_set(F.col("options"), F.col("xetex")).alias("title_font"), H.small_caps(F.col("options"), F.col("xetex")).alias("small_caps"))


@query("SELECT n_nationkey, CASE n_nationkey % 6 WHEN 3 THEN ['bogus', 'evanshempel without evans'] WHEN 4 THEN ['hempel without inline or evans'] ELSE CAST([] AS VARCHAR[]) END AS idle FROM nation")
def idle_options(spark, d):
    return _flags(spark, d).select("n_nationkey", H.unknown_options(F.col("options")).alias("idle"))


_LAYOUTS = ("newdisplay", "newevans", "newevanshempel", "newhempel")


@query(
    """WITH h AS (SELECT n_nationkey, ['newdisplay','newevans','newevanshempel','newhempel'][n_nationkey % 4 + 1] AS layout, n_regionkey % 2 = 0 AS top, n_name, n_regionkey + 1 AS section FROM nation)
    SELECT n_nationkey, layout,
        CASE WHEN NOT top THEN n_nationkey || '.' WHEN layout IN ('newdisplay', 'newhempel') THEN section || '.' ELSE ['I','II','III','IV','V'][section] END AS number,
        n_name || CASE WHEN (layout = 'newhempel' AND top) OR (layout = 'newevanshempel' AND NOT top) THEN '.---' ELSE '' END AS shown,
        CASE WHEN top THEN CASE layout WHEN 'newdisplay' THEN 'scshape' ELSE 'bfseries' END WHEN layout = 'newevanshempel' THEN 'bfseries' END AS font
    FROM h"""
)
def numbered_layouts(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.get(F.array(*map(F.lit, _LAYOUTS)), F.col("n_nationkey") % 4).alias("layout"), F.when(F.col("n_regionkey") % 2 == 0, "section").otherwise("subsection").alias("level"), F.col("n_name").alias("title"), (F.col("n_regionkey") + 1).alias("section"), F.col("n_nationkey").alias("subsection"))
    return headings.numbered(rows, headings.layout_rows(spark)).select("n_nationkey", "layout", "number", "shown", "font")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '.' ELSE n_name END AS ending FROM nation")
def default_endings(spark, d):
    return table(spark, d, "nation").select("n_nationkey", H.or_default(F.when(F.col("n_regionkey") != 0, F.col("n_name")), H.ENDING).alias("ending"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN n_name ELSE '' END AS in_format, CASE WHEN n_regionkey = 0 THEN '' ELSE n_name END AS before, '.~~' AS tail FROM nation")
def subparagraphs(spark, d):
    return table(spark, d, "nation").select("n_nationkey", H.subparagraph(F.col("n_name"), F.col("n_regionkey") == 0).alias("s")).select("n_nationkey", "s.*")


@query("SELECT n_nationkey, n_name || CASE WHEN n_regionkey = 1 THEN '.---' ELSE '' END AS shown FROM nation")
def centred_titles(spark, d):
    level = F.when(F.col("n_regionkey") == 1, "subparagraph").otherwise("paragraph")
    return table(spark, d, "nation").select("n_nationkey", H.centred_title(F.col("n_name"), level).alias("shown"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'special' ELSE 'regular' END AS font FROM part")
def tilde_fonts(spark, d):
    return table(spark, d, "part").select("p_partkey", L.tilde_font(F.col("p_size") % 2 == 0).alias("font"))


@query("SELECT doc_id, translate(text, '′', chr(39)) AS kept_minus, translate(text, '-', '−') AS kept_prime FROM documents")
def glyph_options(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", L.translated(text, minus=False).alias("kept_minus"), L.translated(text, prime=False).alias("kept_prime"))


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'esta')")
def folded_filter(spark, d):
    return candidates.filtered(table(spark, d, "documents").select("doc_id", "text"), F.lit("ESTÁ"), "text", fold=True).select("doc_id")


@query("SELECT c_custkey, [x FOR x IN ['BUILDING', c_mktsegment, 'MACHINERY'] IF x <> c_mktsegment] AS sources FROM customer")
def sources_without_one(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.without(F.array(F.lit("BUILDING"), F.col("c_mktsegment"), F.lit("MACHINERY")), F.col("c_mktsegment")).alias("sources"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN ['BUILDING', 'MACHINERY'] ELSE [c_mktsegment, 'BUILDING', 'MACHINERY'] END AS list FROM customer")
def list_with_added(spark, d):
    return table(spark, d, "customer").select("c_custkey", L.with_added(F.array(F.lit("BUILDING"), F.lit("MACHINERY")), F.col("c_mktsegment")).alias("list"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN ['crossref'] ELSE ['crossref', 'hal9'] END AS left_in FROM customer")
def without_back_ends(spark, d):
    sources = F.when(F.col("c_nationkey") % 2 == 0, F.array(*map(F.lit, ("dblp", "crossref", "hal")))).otherwise(F.array(*map(F.lit, ("arxiv", "crossref", "ieee", "hal9"))))
    return table(spark, d, "customer").select("c_custkey", L.without_sources(sources).alias("left_in"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey IN (1, 2) THEN 141 ELSE 181 END AS INT) AS height FROM supplier")
def font_heights(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", L.font_height(F.col("s_suppkey").cast("string"), ["1", "2"]).alias("height"))


@query("SELECT n_nationkey, ['Run LaTeX','Run BibTeX','Run Biber','Run Viewer'][n_nationkey % 4 + 1] AS help FROM nation")
def commands(spark, d):
    name = F.get(F.array(*(F.lit(c[0]) for c in L.COMMANDS)), F.col("n_nationkey") % 4)
    return table(spark, d, "nation").withColumn("name", name).join(F.broadcast(L.command_table(spark)), "name").select("n_nationkey", "help")


@query("SELECT n_nationkey, ['constant','string','bold','reference',NULL][n_nationkey % 5 + 1] AS class FROM nation")
def highlights(spark, d):
    macro = F.get(F.array(*map(F.lit, ("scq", "ex", "marg", "hiddenref", "emph"))), F.col("n_nationkey") % 5)
    return table(spark, d, "nation").select("n_nationkey", L.highlight(macro).alias("class"))


@query("SELECT n_nationkey, '\\enquote{' || n_name || '}' AS quoted FROM nation")
def quotations(spark, d):
    return table(spark, d, "nation").select("n_nationkey", L.quoted(F.col("n_name")).alias("quoted"))


@query("""SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN [n_name, 'Doe, J.'] WHEN 1 THEN [n_name, 'two words'] ELSE [n_name || ' and x, y'] END AS parts FROM nation""")
def field_parts(spark, d):
    of, name = F.col("n_nationkey") % 3, F.col("n_name")
    field = F.get(F.array(*map(F.lit, ("author", "keywords", "note"))), of)
    value = F.when(of == 0, F.concat(name, F.lit(" and Doe, J."))).when(of == 1, F.concat(name, F.lit(" , two words"))).otherwise(F.concat(name, F.lit(" and x, y")))
    return table(spark, d, "nation").select("n_nationkey", L.field_values(field, value).alias("parts"))


@query("SELECT n_nationkey FROM nation ORDER BY n_nationkey LIMIT 1 OFFSET 9")
def tenth_pick(spark, d):
    return candidates.picked(table(spark, d, "nation").select("n_nationkey"), F.lit(0), "n_nationkey")


@query("""SELECT '"' || n_name || '/scan' || n_nationkey || '"' AS line FROM nation""")
def manifest_slashes(spark, d):
    return table(spark, d, "nation").select(P.manifest_line(F.concat("n_name", F.lit("\\scan"), F.col("n_nationkey").cast("string"))).alias("line"))


@query("SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS ord, CAST(n_nationkey + 1 AS INT) AS depth FROM nation")
def deep_outline(spark, d):
    """Each nation is the child of the one before."""
    key = F.col("n_nationkey")
    rows = table(spark, d, "nation").select(F.lit(0).alias("doc_id"), key.alias("id"), F.when(key > 0, key - 1).alias("parent"), key.alias("ord"), F.col("n_name").alias("title"), key.alias("start"))
    return segments.flatten_outline(rows).select(F.col("id").alias("n_nationkey"), "ord", F.size("path").alias("depth"))


@query("SELECT o_orderkey, CAST(o_orderkey + 3000000000 AS VARCHAR) AS padded FROM orders")
def padded_beyond_int(spark, d):
    return table(spark, d, "orders").select("o_orderkey", P.padded(F.col("o_orderkey") + 3_000_000_000).alias("padded"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
