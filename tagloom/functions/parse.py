"""Parsers of captured payloads: expressions where they suffice, Arrow-batched functions for markup."""

from __future__ import annotations

import html.parser
import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tagloom.operators.queue import appended

_TEXTS = T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


_S, _I = T.StringType(), T.IntegerType()
TAG_LIST = T.ArrayType(_struct(name=_S, uses=_I))
ITEM_LIST = T.ArrayType(_struct(title=_S, description=_S, published=_S, guid=_S, tags=_TEXTS, replies=_I))
SCHOOL_LIST = T.ArrayType(_struct(name=_S, start=_S, finish=_S))
PERSON = _struct(nick=_S, region=_S, birthday=_S, city=_S, bio=_S, created=_S, updated=_S, posts=_I, posted=_I, received=_I, interests=_TEXTS, schools=SCHOOL_LIST)
#: Uses of a tag are believed below this many digits.
USES_DIGITS = 6


def disallowed(body: Column) -> Column:
    """Paths of the ``Disallow`` lines after the first ``User-Agent: *``; an empty array if there is none."""
    segment = F.split(F.coalesce(body, F.lit("")), r"User-Agent: \*\r?\n")
    own = F.when(F.size(segment) > 1, segment[1]).otherwise("")
    lines = F.filter(F.split(own, r"\r?\n"), lambda x: x.startswith("Disallow: "))
    return F.array_distinct(F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(11), F.length(x)))))


def friends(body: Column) -> Column:
    """Nicks of a friends list: without its first line, marks of direction dropped, ``_`` written as ``-``."""
    rest = F.regexp_replace(F.coalesce(body, F.lit("")), r"^[^\n]*\n?", "")
    names = F.split(F.replace(F.regexp_replace(rest, "[<>] ", ""), F.lit("_"), F.lit("-")), r"\r?\n")
    return F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: x != ""))


def guid_number(guid: Column) -> Column:
    """The first run of digits after a slash, as a number; null if there is none or it is too long."""
    return F.nullif(F.regexp_extract(guid, r"/(\d+)", 1), F.lit("")).try_cast("bigint")


def uses_number(text: Column) -> Column:
    """The first run of digits, if it has fewer than six."""
    digits = F.regexp_extract(text, r"\d+", 0)
    return F.when((digits != "") & (F.length(digits) < USES_DIGITS), digits.try_cast("int"))


def rss_time(text: Column) -> Column:
    """A date such as ``Mon, 19 Oct 2015 08:11:41 GMT`` as a time stamp."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\s*\w{3},\s*", ""), F.lit("dd MMM yyyy HH:mm:ss zzz"))


def loose_date(text: Column) -> Column:
    """A date; a lone year means its first day; null for anything else."""
    return F.when(F.length(text) == 4, F.concat(text, F.lit("-01-01"))).otherwise(text).try_cast("date")


def loose_timestamp(text: Column) -> Column:
    return F.replace(text, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def joined_interests(values: Column) -> Column:
    """Values joined by commas, with one at the end; null for none."""
    return F.when(F.size(values) > 0, F.concat(F.array_join(values, ","), F.lit(",")))


#: Elements without an end tag, and attributes of an anchor that say nothing of its uses.
_EMPTY = {"br", "hr", "img", "input", "meta", "link"}
_UNUSED = {"href", "style", "target", "rel", "class"}


def unknown_items(items: DataFrame, known: DataFrame, key: str, arrival: str) -> DataFrame:
    """Items of keys not known yet, the first of each by arrival; those without a key are left out."""
    return appended(known, items, [key], [arrival])


class _Element:
    def __init__(self, name: str, attrs: dict, parent: _Element | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.parts: list[str] = []
        self.own: list[str] = []

    def marks(self) -> str:
        return " ".join(v or "" for k, v in self.attrs.items() if k not in _UNUSED)


class _Text(html.parser.HTMLParser):
    """The text of a page and its anchors, each with the element around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.anchors: list[_Element] = []
        self.top = _Element("", {}, None)
        self.rows: list[tuple[int, int, _Element]] = []  # table, row in it, row
        self.tables: list[list[int]] = []
        self.seen = 0

    def handle_starttag(self, tag, attrs):
        if tag in _EMPTY:
            return
        self.top = _Element(tag, dict(attrs), self.top)
        if tag == "table":
            self.tables.append([self.seen, 0])
            self.seen += 1
        elif tag == "tr" and self.tables:
            self.rows.append((*self.tables[-1], self.top))
            self.tables[-1][1] += 1

    def handle_endtag(self, tag):
        node = self.top
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is None:
            return  # closes nothing
        while self.top is not node.parent:
            self.closed(self.top)
            self.top = self.top.parent

    def closed(self, node):
        if node.name == "a":
            self.anchors.append(node)
        elif node.name == "table" and self.tables:
            self.tables.pop()

    def handle_data(self, data):
        self.parts.append(data)
        self.top.own.append(data)
        node = self.top
        while node is not None:
            if node.name in ("a", "tr"):
                node.parts.append(data)
            node = node.parent


def _parsed(page: str) -> _Text:
    parser = _Text()
    parser.feed(page)
    parser.close()
    return parser


@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """The text of a page: tags dropped, words on both sides of a tag kept apart, white space runs one blank."""
    return pages.map(lambda p: None if p is None else re.sub(r"\s+", " ", "".join(_parsed(p.replace("<", " <")).parts)).strip())


@F.pandas_udf(TAG_LIST)
def tag_anchors(pages: pd.Series, prefix: pd.Series, fallback: pd.Series) -> pd.Series:
    """Tags linked on a page: anchors whose address starts with ``prefix`` or, if there is none, with ``fallback``.

    Names are in lower case; the uses are the first number among the anchor's own attributes, else in the element around
    it, if it has fewer than six digits. Of a name seen twice the first uses known stay.
    """

    def number(text):
        digits = re.search(r"\d+", text)
        return digits[0] if digits else None

    def one(page, *starts):
        anchors = [a for a in _parsed(page or "").anchors]
        chosen = next((found for start in starts if start and (found := [a for a in anchors if (a.attrs.get("href") or "").startswith(start)])), [])
        out: dict[str, int | None] = {}
        for a in chosen:
            name = "".join(a.parts).strip().lower()
            digits = number(a.marks()) or number(a.parent.marks() + " " + " ".join(a.parent.own))
            if name and out.get(name) is None:
                out[name] = int(digits) if digits and len(digits) < USES_DIGITS else None
        return [{"name": k, "uses": v} for k, v in out.items()]

    return pd.Series([one(*x) for x in zip(pages, prefix, fallback, strict=True)])


@F.pandas_udf(_TEXTS)
def fact_rows(pages: pd.Series) -> pd.Series:
    """N-grams of an extractor's result page: of each table whose first row reads ``NGrams``, the rows after the second."""

    def one(page):
        out, good = [], set()
        for table, row, element in _parsed(page or "").rows:
            words = " ".join("".join(element.parts).split())
            if row == 0 and words == "NGrams":
                good.add(table)
            elif row > 1 and table in good:
                out.append(words)
        return out

    return pages.map(one)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


@F.pandas_udf(ITEM_LIST)
def rss_items(bodies: pd.Series) -> pd.Series:
    """Items of an RSS body; a body that is no XML has none."""

    def one(body):
        try:
            root = ET.fromstring(body or "")
        except ET.ParseError:
            return []
        out = []
        for item in root.iter("item"):
            get = {}
            tags = []
            for child in item:
                name = _local(child.tag)
                if name == "category":
                    tags.append((child.text or "").lower())
                else:
                    get.setdefault(name, child.text)
            replies = get.get("reply-count") or ""
            out.append(
                {
                    "title": get.get("title"),
                    "description": get.get("description"),
                    "published": get.get("pubDate"),
                    "guid": get.get("guid"),
                    "tags": tags,
                    "replies": int(replies) if replies.isdigit() else None,
                }
            )
        return out

    return bodies.map(one)


@F.pandas_udf(PERSON)
def foaf_person(bodies: pd.Series) -> pd.DataFrame:
    """The first person of a FOAF body; what is missing is null."""
    names = PERSON.fieldNames()
    texts = {"nick": "nick", "dateOfBirth": "birthday", "bio": "bio"}
    titles = {"country": "region", "city": "city"}

    def number(x):
        return int(x) if (x or "").strip().isdigit() and int(x) < 2**31 else None

    def one(body):
        out = dict.fromkeys(names)
        try:
            root = ET.fromstring(body or "")
        except ET.ParseError:
            return out
        person = next((x for x in root.iter() if _local(x.tag) == "Person"), None)
        if person is None:
            return out
        interests, schools = [], []
        for x in person.iter():
            name, attributes = _local(x.tag), {_local(k): v for k, v in x.attrib.items()}
            if name in texts and out[texts[name]] is None:
                out[texts[name]] = (x.text or "").strip() or None
            elif name in titles and out[titles[name]] is None:
                out[titles[name]] = (attributes.get("title") or x.text or "").strip() or None
            elif name == "interest" and attributes.get("title"):
                interests.append(attributes["title"])
            elif name == "weblog" and out["created"] is None:
                out["created"], out["updated"] = attributes.get("dateCreated"), attributes.get("dateLastUpdated")
            elif name in ("posts", "comments"):
                inside = {_local(y.tag): number(y.text) for y in x}
                if name == "posts":
                    out["posts"] = inside.get("posted")
                else:
                    out["posted"], out["received"] = inside.get("posted"), inside.get("received")
            elif name == "school" and attributes.get("title"):
                schools.append({"name": attributes["title"], "start": attributes.get("dateStart"), "finish": attributes.get("dateFinish")})
        out["interests"], out["schools"] = interests or None, schools or None
        return out

    return pd.DataFrame([one(b) for b in bodies], columns=names)
