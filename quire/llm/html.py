"""Main text of web pages by equivalence classes of tokens and a template a host.

A page is a sequence of tokens: its elements, each named by the path of tags
from the root, and the text runs between them.  Over the pages of one host

1. a token's occurrence vector is how often each page holds it.  Vectors are
   compared by a 64-bit sum over pages of a hash of (page, count), so that one
   distributed aggregation makes them, however many pages a host has;
2. tokens with equal vectors form an equivalence class.  A class counts if
   LEAST_PAGES pages and a LEAST_SHARE of the host's pages hold it, and if it
   has LEAST_TOKENS tokens and an element among them: text runs alone are
   copies of a passage, not a layout.  A layout that only some pages have is a
   class of its own, so a host may have several;
3. a second pass holds each class against every page.  Its tokens have to
   stand in one order, that of their mean places (those that leave it are
   taken out of the class), tuple after tuple if they repeat; and of any two
   classes one's tuples have to lie in one gap of the other's, the same one on
   all pages, or the smaller class is invalid.  Valid classes, nested by these
   gaps and by the paths of their elements, are the template;
4. a template's text runs are constants.  If they are more than MOST_CONSTANT
   of the text of the pages that hold the class, these pages are copies of one
   another and the runs are data;
5. what stands between the template's tokens is slots, named by the innermost
   template element around them.  The main slots are those of the template's
   article or main elements; on pages without them, those of the innermost
   element that holds most of the slots' text;
6. a page's text is what its main slots hold, without constants and excluded
   elements.  Pages that hold no main slot (a host with too few pages, a page
   of no layout) give their own article or main element, or all their text.

Excluded are the elements and roles of EXCLUDED_*: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments.  A class or id
that is one of EXCLUDED_NAMES excludes, too; one that only contains such a
name as a part (related-work) does so if the template holds the element.
Neither they nor forms exclude the page's only article or main element.

Pages meet their host's tokens and template by joins on the host, broadcast
where these are small and else sorted, whose large groups Spark may split; a
page is never collected with its host.  A template holds tokens of at least a
LEAST_SHARE of the host's pages, so its size is bounded by the size of pages,
not by their number.

Cases: a null or empty html gives an empty text; a null url is a host of its
own.  Repeated pages count as pages.  Unclosed and stray tags are read as
browsers do: an unclosed element ends with its parent.  Empty tables give
empty results; other columns are ignored.  Pages are read whole, in linear
time.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import _arrow_schema, checkpointed, frugal, saved, small_batches

LEAST_PAGES = 3
LEAST_SHARE = 0.02
LEAST_TOKENS = 3
MOST_CONSTANT = 0.2

#: Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
SCOPES = frozenset("ul ol dl table tbody thead tfoot select body article main section div td th nav aside header footer form".split())

#: What is no part of the main text.
EXCLUDED_TAGS = frozenset("head title nav header footer aside form script style noscript template iframe svg math button select option textarea input dialog menu object canvas audio video search".split())
EXCLUDED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
EXCLUDED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar"
    " aside cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay comment comments commentlist disqus respond reply replies related recommended share sharing social toolbar widget pagination pager skip".split()
)
MAIN_TAGS = frozenset(["article", "main"])

_TAG = re.compile(
    r"<!--(?:(?!-->).)*+(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?(?=\s|/|$)", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """A hash of the lower-cased host."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)))


def mark(text: str) -> int:
    """A signed 64-bit hash, equal on every machine."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


#: How an element is excluded: not, if the template holds it, unless the page's only main element is in it, always.
NOT, WEAK, NAMED, ALWAYS = range(4)


def excluded(tag: str, attributes: str) -> tuple[int, str]:
    """How an element is excluded, and the name that its path shows."""
    shown = tag
    out = NAMED if tag == "form" else ALWAYS if tag in EXCLUDED_TAGS else NOT
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                whole = value.lower().split()
                if not EXCLUDED_NAMES.isdisjoint(whole):
                    out = max(out, NAMED)
                elif any(x.lower() in EXCLUDED_NAMES for x in _SPLIT.split(value)):
                    out = max(out, WEAK)
                shown += f".{value.strip().lower()}" if name == "class" else ""
            elif name == "role":
                if value.strip().lower() in EXCLUDED_ROLES:
                    out = max(out, NAMED)
            elif name == "hidden" or value.strip().lower() == "true":
                out = ALWAYS
    return out, shown


class Open:
    """The open elements, at any depth: each tag's places are kept, so that closing takes constant time an element."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.scopes: list[int] = []
        self.path = 0  # the innermost element's

    def push(self, tag: str, path: int):
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append((tag, path))
        self.path = path

    def _cut(self, size: int):
        while len(self.stack) > size:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPES:
                self.scopes.pop()
        self.path = self.stack[-1][1] if self.stack else 0

    def end(self, tag: str):
        """The innermost element of the tag ends, with all inside it."""
        if places := self.places.get(tag):
            self._cut(places[-1])

    def close(self, tags: frozenset):
        """The innermost element of these tags ends, unless a scope stands in it."""
        at = max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)
        if at >= 0 and at >= (self.scopes[-1] if self.scopes else -1):
            self._cut(at)


class Page:
    """The tokens of a page: elements [path], and text runs (text, innermost path's number, excluded, in main)."""

    def __init__(self, source: str | None):
        self.paths: dict[str, int] = {"": 0}  # path -> its number
        self.parents = [-1]
        self.tags = [""]
        self.how = [NOT]  # by path: how this element alone is excluded
        self.counts = [1]
        self.runs: list[tuple[str, int]] = []  # ("\n" for a block's end, -1)
        self.sequence: list[tuple[int, int]] = []  # (path, -1) where an element begins, (path, run) of a text
        if source:
            self._read(source)
        for spared in (False, True):  # with main elements, if it has some that are not excluded
            self.out = self._out(spared)
            self.main = self._main()
            if any(self.main) or not any(t in MAIN_TAGS for t in self.tags):
                break

    def _out(self, spared: bool, template: frozenset = frozenset(), marks: list[int] = ()) -> list[bool]:
        """By path: an excluded element or inside one.  spared: names and forms do not exclude what holds a main element."""
        holds = [t in MAIN_TAGS for t in self.tags]
        for k in range(len(holds) - 1, 0, -1):  # a parent has a smaller number
            if holds[k]:
                holds[self.parents[k]] = True
        out = [False]
        for k in range(1, len(self.how)):
            how = self.how[k]
            own = how == ALWAYS or how == NAMED and not (spared and holds[k]) or how == WEAK and bool(template) and marks[k] in template and not holds[k]
            out.append(own or out[self.parents[k]])
        self.spared = spared
        return out

    def _main(self) -> list[bool]:
        """By path: a main element or inside one."""
        main = [False]
        for k in range(1, len(self.tags)):
            main.append(main[self.parents[k]] or (self.tags[k] in MAIN_TAGS and not self.out[k]))
        return main

    def confirm(self, template: frozenset, marks: list[int]):
        """Elements that only parts of names speak against are excluded if the template holds them."""
        if WEAK in self.how:
            self.out = self._out(self.spared, template, marks)
            self.main = self._main()

    def _path(self, parent: int, name: str, tag: str, how: int) -> int:
        key = f"{parent}>{name}"
        number = self.paths.get(key)
        if number is None:
            number = self.paths[key] = len(self.parents)
            self.parents.append(parent)
            self.tags.append(tag)
            self.how.append(how)
            self.counts.append(0)
        self.counts[number] += 1
        self.sequence.append((number, -1))
        return number

    def _text(self, text: str, path: int):
        text = _html.unescape(text) if "&" in text else text
        if text:
            self.sequence.append((path, len(self.runs)))
            self.runs.append((text, path))

    def _read(self, source: str):
        stack = Open()
        at, scan = 0, 0
        while (m := _TAG.search(source, scan)) is not None:
            if m.start() > at:
                self._text(source[at : m.start()], stack.path)
            at = scan = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if tag not in INLINE:
                self.runs.append(("\n", -1))
            if m[1] or m[4]:
                stack.end(tag)
                continue
            if tag in ENDS_P:
                stack.close(CLOSES["p"])
            elif tag in CLOSES:
                stack.close(CLOSES[tag])
            out, name = excluded(tag, m[3] or m[6] or "")
            path = self._path(stack.path, name, tag, out)
            if tag in VOID or (m[3] or m[6] or "").endswith("/") and tag in ("svg", "path", "math"):
                continue
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                at = scan = end.start() if end else len(source)
                stack.push(tag, path)
                continue
            stack.push(tag, path)
        if at < len(source):
            self._text(source[at:], stack.path)

    def anchors(self, marks: list[int], elements: frozenset) -> list[int]:
        """By path: the innermost of these elements around it, itself included; -1 for none."""
        found = [-1]
        for k in range(1, len(marks)):
            found.append(k if marks[k] in elements else found[self.parents[k]])
        return found

    def names(self) -> list[int]:
        """A hash for each path, equal on all pages."""
        marks = [0] * len(self.parents)
        for key, number in self.paths.items():
            if number:
                parent, _, name = key.partition(">")
                marks[number] = mark(f"{marks[int(parent)]}>{name}")
        return marks

    def text(self, keep) -> str:
        """Text of the runs whose path is kept, blocks joined by one space."""
        out = []
        for text, path in self.runs:
            out.append(" " if path < 0 else text if keep(text, path) else "")
        return " ".join("".join(out).split())


    def tokens(self, marks: list[int]) -> list[tuple[int, int, int]]:
        """(token, path, code points) in page order: elements, with -1 code points, and texts that are not excluded."""
        found = []
        for path, run in self.sequence:
            if run < 0:
                found.append((marks[path], path, -1))
            elif not self.out[path] and (shown := " ".join(self.runs[run][0].split())):
                found.append((mark(f"{marks[path]}|{shown}"), path, len(shown)))
        return found


TOKENS = "host long, token long, parent long, kind int, page long, n long, place long"
TEXT, PLAIN, MAIN, OUT, PAGE = range(5)


def _rows(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), host_of(url).alias("host"))


def tokens(pages: DataFrame) -> DataFrame:
    """A row for each page and token, with its kind, its number and its first place; a PAGE row for the page itself."""
    types = _arrow_schema(pages.sparkSession, TOKENS)

    def run(batches):
        for batch in small_batches(batches, "html"):
            rows = []
            for host, url, source in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page, this = Page(source), mark(f"{url}\n{source}")
                marks = page.names()
                rows.append((host, 0, 0, PAGE, this, 1, 0))
                seen: dict[int, list] = {}
                for place, (token, path, chars) in enumerate(page.tokens(marks)):
                    if token in seen:
                        seen[token][1] += 1
                    else:
                        kind = TEXT if chars >= 0 else OUT if page.out[path] else MAIN if page.main[path] else PLAIN
                        seen[token] = [marks[path] if chars >= 0 else marks[page.parents[path]], 1, place, kind]
                rows += [(host, t, parent, kind, this, n, place) for t, (parent, n, place, kind) in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), types)], schema=types)

    return _rows(pages).select("host", "url", "html").mapInArrow(frugal(run), TOKENS)


def candidates(pages: DataFrame) -> DataFrame:
    """(host, blob) of the hosts' frequent elements and the classes' tokens: token, parent, kind, class (-1: none), place in the class.

    Classes are numbered by their pages, the most first.
    """
    vector = F.xxhash64("page", "n")
    counted = tokens(pages).groupBy("host", "token", "parent").agg(
        F.sum(F.shiftright(vector, 32)).alias("high"),  # halves: their sums fit 64 bits up to 2^31 pages a host
        F.sum(vector.bitwiseAND(F.lit((1 << 32) - 1))).alias("low"),
        F.count(F.lit(1)).alias("pages"),
        F.max("kind").alias("kind"),
        (F.sum("place") / F.count(F.lit(1))).alias("place"),
    )
    counted = checkpointed(counted)
    hosts = counted.filter(F.col("kind") == PAGE).select(F.col("host").alias("__host"), F.col("pages").alias("of"))
    often = (F.col("pages") >= LEAST_PAGES) & (F.col("pages") >= LEAST_SHARE * F.col("of"))
    frequent = counted.filter(F.col("kind") != PAGE).join(hosts, F.col("host") == F.col("__host")).filter(often)
    classes = frequent.groupBy("host", "high", "low", "pages").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("kind") != TEXT).alias("elements"))
    classes = classes.filter((F.col("size") >= LEAST_TOKENS) & (F.col("elements") > 0)).select(*(F.col(c).alias(f"__{c}") for c in ("host", "high", "low", "pages")), "size")
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"__{c}") for c in ("host", "high", "low", "pages")))
    met = frequent.drop("__host").join(classes, same, "left").filter((F.col("kind") != TEXT) | F.col("size").isNotNull())
    rows = met.select("host", F.struct("token", "parent", "kind", "high", "low", "pages", "size", "place").alias("row"))
    types = _arrow_schema(pages.sparkSession, "host long, blob binary")

    def run(batches):
        for batch in batches:
            blobs = [numbered(r).tobytes() for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(blobs, types[1].type)], schema=types)

    return saved(rows.groupBy("host").agg(F.collect_list("row").alias("rows")).mapInArrow(frugal(run), "host long, blob binary"))


def numbered(rows: list[dict]) -> np.ndarray:
    """(token, parent, kind, class, place in the class) of a host's frequent elements and class tokens."""
    vectors: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["size"] is not None:
            vectors.setdefault((-r["pages"], -r["size"], r["high"], r["low"]), []).append(r)
    out = [(r["token"], r["parent"], r["kind"], -1, 0) for r in rows if r["size"] is None]
    for k, key in enumerate(sorted(vectors)):
        members = sorted(vectors[key], key=lambda r: (r["place"], r["token"]))
        out += [(r["token"], r["parent"], r["kind"], k, i) for i, r in enumerate(members)]
    return np.array(out, np.int64).reshape(-1, 5)


class Known:
    """What is known of hosts, read once each; the oldest goes when there are many."""

    def __init__(self, read, most: int = 512):
        self.read, self.most, self.held = read, most, {}

    def __call__(self, host: int, blob: bytes | None):
        if host not in self.held:
            if len(self.held) >= self.most:
                self.held.pop(next(iter(self.held)))
            self.held[host] = self.read(blob)
        return self.held[host]


def longest_increase(values: list[int]) -> set[int]:
    """The members of a longest increasing subsequence of distinct values."""
    tails, places, before = [], [], []
    for i, v in enumerate(values):
        at = bisect_left(tails, v)
        before.append(places[at - 1] if at else -1)
        tails[at : at + 1], places[at : at + 1] = [v], [i]
    kept, i = set(), places[-1] if places else -1
    while i >= 0:
        kept.add(values[i])
        i = before[i]
    return kept


class Classes:
    """A host's candidates as a page is held against them."""

    def __init__(self, blob: bytes | None):
        rows = np.frombuffer(blob or b"", np.int64).reshape(-1, 5).tolist()
        self.of = {t: (c, i) for t, _, _, c, i in rows if c >= 0}
        self.elements = frozenset(t for t, _, kind, _, _ in rows if kind != TEXT)


#: What a page says of a class or token: it leaves its order; is not a row of tuples; lies in a gap of another; constants of all text; text of a slot.
LEAVES, BROKEN, GAP, CONSTANT, SLOT = range(5)


def verdicts(page: Page, marks: list[int], known: Classes) -> list[tuple[int, int, int, int, int]]:
    """(what, key, other, a, b) that one page says of its host's classes."""
    said, found = [], page.tokens(marks)
    places: dict[int, list[tuple[int, int, int]]] = {}  # class -> (place, number in the class, token)
    for at, (token, _, _) in enumerate(found):
        if (member := known.of.get(token)) is not None:
            places.setdefault(member[0], []).append((at, member[1], token))
    positions: dict[int, list[int]] = {}  # of the classes that are rows of tuples
    spans: dict[int, list[tuple[int, int]]] = {}
    for c in sorted(places):
        first = list(dict.fromkeys(i for _, i, _ in places[c]))
        kept = longest_increase(first)
        said += [(LEAVES, t, 0, 1, 0) for t in {t for _, i, t in places[c] if i not in kept}]
        row = [(at, i) for at, i, _ in places[c] if i in kept]
        order, size = sorted(kept), len(kept)
        if len(row) % size or any(i != order[k % size] for k, (_, i) in enumerate(row)):
            said.append((BROKEN, c, 0, 1, 0))
            continue
        positions[c] = [at for at, _ in row]
        spans[c] = [(row[k][0], row[k + size - 1][0]) for k in range(0, len(row), size)]
    numbers = sorted(spans)
    for b in numbers:
        for a in numbers:
            if a >= b:
                break
            gaps = {(bisect_left(positions[a], x), bisect_left(positions[a], y)) for x, y in spans[b]}
            size = len(positions[a]) // len(spans[a])
            if all(x == y for x, y in gaps) and len({x % size for x, _ in gaps}) == 1:
                gap = next(iter(gaps))[0]
                said.append((GAP, b, a, -1 if gap in (0, len(positions[a])) else gap % size, 0))
            elif len({(bisect_left(positions[b], x), bisect_left(positions[b], y)) for x, y in spans[a]}) != 1 or any(bisect_left(positions[b], x) != bisect_left(positions[b], y) for x, y in spans[a]):
                said.append((BROKEN, b, 0, 1, 0))
    own = any(page.main)
    total = sum(chars for _, path, chars in found if chars > 0 and (page.main[path] or not own))
    constant: dict[int, int] = {}
    slot: dict[int, int] = {}
    anchors = page.anchors(marks, known.elements)
    for token, path, chars in found:
        if chars > 0 and (page.main[path] or not own):
            if token in known.of:
                c = known.of[token][0]
                constant[c] = constant.get(c, 0) + chars
            elif not own and anchors[path] >= 0:
                t = marks[anchors[path]]
                slot[t] = slot.get(t, 0) + chars
    said += [(CONSTANT, c, 0, n, total) for c, n in constant.items()]
    return said + [(SLOT, t, 0, n, 0) for t, n in slot.items()]


def templates(pages: DataFrame) -> DataFrame:
    """A row a host: (host, blob) with its template's main slots, elements and constants."""
    found = candidates(pages)
    schema = "host long, what int, key long, other long, a long, b long, low long, high long"
    types = _arrow_schema(pages.sparkSession, schema)
    met = _rows(pages).join(found.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host")).select("host", "html", "blob")

    def hold(batches):
        known = Known(Classes)
        for batch in small_batches(batches, "html"):
            sums: dict[tuple, list[int]] = {}
            for host, source, blob in zip(*(batch.column(i).to_pylist() for i in range(3))):
                page = Page(source)
                for what, key, other, a, b in verdicts(page, page.names(), known(host, blob)):
                    one = sums.setdefault((host, what, key, other), [0, 0, a, a])
                    one[0], one[1], one[2], one[3] = one[0] + a, one[1] + b, min(one[2], a), max(one[3], a)
            rows = [(*k, *v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(types)], schema=types)

    said = met.mapInArrow(frugal(hold), schema).groupBy("host", "what", "key", "other").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.min("low").alias("low"), F.max("high").alias("high"))
    said = said.groupBy("host").agg(F.collect_list(F.struct("what", "key", "other", "a", "b", "low", "high")).alias("said"))
    met = found.join(said.withColumnRenamed("host", "__host"), F.col("host") == F.col("__host"), "left").select("host", "blob", "said")
    made_types = _arrow_schema(pages.sparkSession, "host long, blob binary")

    def make(batches):
        for batch in batches:
            blobs = [packed(*deduce(np.frombuffer(blob, np.int64).reshape(-1, 5).tolist(), said or [])) for blob, said in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(blobs, made_types[1].type)], schema=made_types)

    return saved(met.mapInArrow(frugal(make), "host long, blob binary"))


def packed(*lists: list[int]) -> bytes:
    return np.array([len(x) for x in lists] + [v for x in lists for v in x], np.int64).tobytes()


def unpacked(blob: bytes | None) -> tuple[frozenset, ...]:
    """Main slots, plain slots, elements and constants."""
    if blob is None:
        return (frozenset(),) * 4
    values = np.frombuffer(blob, np.int64).tolist()
    out, at = [], 4
    for n in values[:4]:
        out.append(frozenset(values[at : at + n]))
        at += n
    return tuple(out)


def deduce(rows: list[list[int]], said: list[dict]) -> tuple[list[int], ...]:
    """(main slots, plain slots, elements, constants) of one host, from its candidates and what its pages say of them."""
    leaves = {r["key"] for r in said if r["what"] == LEAVES}
    broken = {r["key"] for r in said if r["what"] == BROKEN or r["what"] == GAP and r["low"] != r["high"]}
    copies = {r["key"] for r in said if r["what"] == CONSTANT and r["a"] > MOST_CONSTANT * r["b"]}
    parent = {t: p for t, p, kind, _, _ in rows if kind != TEXT}
    members: dict[int, list[tuple[int, int]]] = {}
    for t, _, kind, c, _ in rows:
        if c >= 0 and c not in broken and t not in leaves:
            members.setdefault(c, []).append((t, kind))
    valid = {c: m for c, m in members.items() if len(m) >= LEAST_TOKENS and any(kind != TEXT for _, kind in m)}
    kinds = {t: kind for m in valid.values() for t, kind in m if kind != TEXT}
    constants = sorted(t for c, m in valid.items() if c not in copies for t, kind in m if kind == TEXT)
    main = sorted(t for t, kind in kinds.items() if kind == MAIN)
    plain = {t for t, kind in kinds.items() if kind == PLAIN}
    text = {t: 0 for t in plain}
    for r in said:
        if r["what"] == SLOT and (t := nearest(r["key"], parent, plain)) is not None:
            text[t] += r["a"]
    up = {t: nearest(parent[t], parent, plain) for t in plain}
    return main, sorted(innermost(text, up)), sorted(kinds), constants


def nearest(token: int, parent: dict[int, int], among) -> int | None:
    """The token or the nearest element around it that is one of those."""
    while token not in among:
        if token not in parent:
            return None
        token = parent[token]
    return token


def innermost(text: dict[int, int], up: dict[int, int | None]) -> set[int]:
    """The innermost element that holds over four fifths of the text, with all elements inside it."""
    held, below = dict(text), {}
    for t, u in up.items():
        below.setdefault(u, []).append(t)
    order, more = [], sorted(below.get(None, ()))
    while more:
        t = more.pop()
        order.append(t)
        more += below.get(t, ())
    for t in reversed(order):
        if up[t] is not None:
            held[up[t]] += held[t]
    total, at = sum(held[t] for t in below.get(None, ())), None
    while total and (inner := [t for t in sorted(below.get(at, ())) if held[t] > 0.8 * total]):
        at = inner[0]
    if at is None:
        return set(text)
    inside, more = set(), [at]
    while more:
        t = more.pop()
        inside.add(t)
        more += below.get(t, ())
    return inside


def main_text(page: Page, main: frozenset = frozenset(), plain: frozenset = frozenset(), elements: frozenset = frozenset(), constants: frozenset = frozenset()) -> str:
    """What a page's main slots hold; elements that the template lacks belong to the slot they stand in."""
    marks = page.names()
    page.confirm(elements, marks)
    slots = main if not main.isdisjoint(marks) else plain
    if slots.isdisjoint(marks):
        own = any(page.main)
        inside = [m or not own for m in page.main]
    else:
        inside = [k >= 0 and marks[k] in slots for k in page.anchors(marks, elements)]

    def keep(text, path):
        return inside[path] and not page.out[path] and not (constants and mark(f"{marks[path]}|{' '.join(text.split())}") in constants)

    return page.text(keep)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    schema = "page_id long, url string, text string, n_chars long"
    types = _arrow_schema(pages.sparkSession, schema)
    found = templates(pages).withColumnRenamed("host", "__host")
    met = _rows(pages).join(found, F.col("host") == F.col("__host"), "left").select("page_id", "url", "html", "host", "blob")

    def run(batches):
        known = Known(unpacked)
        for batch in small_batches(batches, "html"):
            texts = [main_text(Page(source), *known(host, blob)) for source, host, blob in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=types)

    return met.mapInArrow(frugal(run), schema)
