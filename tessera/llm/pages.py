"""HTML extraction by deducing templates from equivalence classes of tokens over a host's pages.

What a host's pages share decides: texts of valid classes are the template's, and the content is in the
container that holds most of the text that varies. Element and class names only sort out what is
inside that container (adverts, forms, comments), choose among containers that hold alike much, and decide
alone for hosts with under LEAST_PAGES pages and pages that lack their host's container.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, bounded_batches, stored

#: Share of a host's pages in which a class must occur, and pages that a host needs for a template.
SUPPORT, LEAST_PAGES = 0.5, 3
#: Share of a host's varying text that its content container holds at least.
SHARE = 0.6
#: Templates of up to so many bytes in all are broadcast; more are joined by host.
BROADCAST_BYTES = 8 << 20

# Element names of the HTML standard.
_RAW = {"script", "style"}
_EMBEDDED = {"noscript", "template", "svg", "iframe", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "math", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_BOILER = {"head", "title", "nav", "header", "footer", "aside", "menu", "form", "button", "select", "option", "textarea", "input", "fieldset", "dialog", "datalist"} | _RAW | _EMBEDDED
_MAIN = {"article", "main"}
_NAMED = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|consent|cookie|cookies|disclaimer|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notices|popup|promo|promoted|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-]|\d)", re.I)
#: Elements that end an open paragraph.
_ENDS_P = {"p", "div", "ul", "ol", "table", "section", "article", "footer", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
_ROLES = re.compile(r"banner|navigation|complementary|contentinfo|search|form|dialog|alert", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_SPACE = re.compile(r"\s+")


class Token(NamedTuple):
    """An opening tag or a block's text.

    path: a hash of the names, classes and ids of the open elements. spot: the same with each one's number
    among its like siblings. up: the place of the element around it, -1 for none. bad: names say that it isn't
    content. main: it is an article or main element.
    """

    path: int
    spot: int
    up: int
    text: str | None
    name: str
    bad: bool
    main: bool

    @property
    def key(self) -> int:
        return (self.path if self.text is None else xxhash.xxh64_intdigest(self.text, self.path)) - (1 << 63)


def _named(attributes: str, name: str) -> tuple[str, bool]:
    """A tag's name with its class and id, and whether they say that it isn't content."""
    if "=" not in attributes:
        return name, False
    held = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    label = " ".join(held[k] for k in ("class", "id") if k in held)
    hidden = "display:none" in held.get("style", "").replace(" ", "").lower()
    return (f"{name}.{label}" if label else name), bool(_NAMED.search(label)) or bool(_ROLES.search(held.get("role", ""))) or hidden


def tokens(page: str) -> list[Token]:
    """Tags and block texts of a page in order. Unclosed elements end with the element around them, embedded ones at once; raw-text elements are skipped."""
    out: list[Token] = []
    stack: list[tuple[str, int, bool]] = []  # name, place of the block's token (for an inline element, of the block around it), is a block
    siblings: list[Counter] = [Counter()]  # of each open block and the page: its children so far, by label
    opened: Counter = Counter()
    text: list[str] = []

    def block() -> None:
        whole = _SPACE.sub(" ", "".join(text)).strip()
        text.clear()
        if whole:
            at = stack[-1][1] if stack else -1
            out.append(Token(out[at].path if at >= 0 else 0, 0, at, whole, "", False, False))

    def close(at: int) -> None:
        for name, _, is_block in stack[at:]:
            opened[name] -= 1
            if is_block:
                siblings.pop()
        del stack[at:]

    def last(name: str) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None) if opened[name] else None

    pos, n = 0, len(page)
    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            if not m[0].startswith(("<!", "<?")):
                text.append(entities.unescape(m[0]))
            continue
        name = name.lower()
        inline = name in _INLINE
        if m[1]:
            at = last(name)
            if at is not None and (inline or name in ("p", "li")) and any(s[0] in ("article", "main", "body", "table") for s in stack[at + 1 :]):
                at = None
            if not inline:
                block()
            if at is not None:
                if text and any(s[2] for s in stack[at:]):
                    block()
                close(at)
            continue
        if not inline:
            block()
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                held = last(name)
                if held is not None and not any(s[0] in ("ul", "ol", "dl", "table", "select") for s in stack[held + 1 :]):
                    close(held)
            elif name in _ENDS_P:
                held = last("p")
                if held is not None and all(s[0] in _INLINE for s in stack[held + 1 :]):
                    close(held)
        label, bad = _named(m[3], name)
        bad = bad or name in _BOILER
        up = stack[-1][1] if stack else -1
        if bad or not inline:  # an inline element that isn't content ends the text before it
            if inline:
                block()
            path, spot = (out[up].path, out[up].spot) if up >= 0 else (0, 0)
            siblings[-1][label] += 1
            out.append(Token(xxhash.xxh64_intdigest(label, path), xxhash.xxh64_intdigest(f"{label} {siblings[-1][label]}", spot), up, None, name, bad, name in _MAIN))
            up = len(out) - 1
        if name in _RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, pos)
            pos = end.end() if end else n
        elif name not in _VOID and not m[3].endswith("/") and (name not in _EMBEDDED or re.compile(rf"</{name}\s*>", re.I).search(page, pos)):
            stack.append((name, up, bad or not inline))
            opened[name] += 1
            if bad or not inline:
                siblings.append(Counter())
    block()
    return out


#: The host of a url, in the syntax that Python and Java share; ASCII letters are lower-cased.
_HOST = r"^(?:[a-zA-Z][a-zA-Z0-9_+.\-]*:)?//(?:[^/?#@]*@)?([^/:?#]+)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: F.Column) -> F.Column:
    """A url's host; '' for a null or odd url."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), _UPPER, _UPPER.lower())


def _containers(found: list[Token]) -> dict[int, tuple[int, int, int, bool]]:
    """Of each element that holds other blocks, by spot: the spot of the container around it, the characters of text in it, a hash of that text, and whether it is marked as content."""
    size, digest = [0] * len(found), [0] * len(found)
    holds = {t.up for t in found if t.text is None}
    for i in range(len(found) - 1, -1, -1):  # what is inside an element comes after it
        t = found[i]
        if t.text is not None:
            size[i], digest[i] = len(t.text), xxhash.xxh64_intdigest(t.text)
        if t.up >= 0:
            size[t.up] += size[i]
            digest[t.up] = (digest[t.up] * 0x9E3779B1 + digest[i]) & (2**63 - 1)
    return {t.spot: (found[t.up].spot if t.up >= 0 else 0, size[i], digest[i], t.main) for i, t in enumerate(found) if i in holds and size[i]}


#: Kinds of rows of _counted: a page, an element, a text, a container.
_PAGE, _ELEMENT, _TEXT, _CONTAINER = range(4)


def _counted(pages: DataFrame) -> DataFrame:
    """(host, kind, token, page hash, times, place, around, chars, digest, main): one row for each different token and each container of a page."""
    schema = pa.schema([("host", pa.string()), ("kind", pa.int32()), ("token", pa.int64()), ("page", pa.int64()), ("times", pa.int32()), ("place", pa.float64()), ("around", pa.int64()), ("chars", pa.int64()), ("digest", pa.int64()), ("main", pa.bool_())])

    def count(batch: pa.RecordBatch) -> list:
        out: list[tuple] = []
        for host, url, page in zip(*(batch.column(c).to_pylist() for c in ("host", "url", "html")), strict=True):
            page = page or ""
            own = xxhash.xxh64_intdigest(f"{url}\0{page}") - (1 << 63)
            seen: dict[int, list] = {}
            found = tokens(page)
            for i, t in enumerate(found):
                seen.setdefault(t.key, [0, i, _ELEMENT if t.text is None else _TEXT])[0] += 1
            out.append((host, _PAGE, 0, own, 1, -1.0, 0, 0, 0, False))
            out += [(host, kind, k, own, c, float(i), 0, 0, 0, False) for k, (c, i, kind) in seen.items()]
            out += [(host, _CONTAINER, spot - (1 << 63), own, 1, 0.0, around - (1 << 63), chars, digest, main) for spot, (around, chars, digest, main) in _containers(found).items()]
        return [list(x) for x in zip(*out, strict=True)]

    bounded_batches(pages.sparkSession)
    rows = pages.select(host_of(F.col("url")).alias("host"), "url", "html")
    return rows.mapInArrow(batches(count, schema), "host string, kind int, token long, page long, times int, place double, around long, chars long, digest long, main boolean")


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): of each host with LEAST_PAGES pages, as JSON, its tokens and its containers that occur in SUPPORT of the pages, by place.

    A token's occurrence vector, its number of occurrences in each page, is summarised by sums of hashes
    of page and number, so classes of equal vectors come from a grouped aggregate with partial sums and
    no task gathers a host. A container's varying text is all its text, unless it is the same on
    all pages. What is kept of a host is at most 1 / SUPPORT times the tokens of a page.
    """
    half = lambda salt: F.sum(F.pmod(F.xxhash64("page", "times", F.lit(salt)), F.lit(1 << 30)))
    varying = F.when(F.min("digest") < F.max("digest"), F.sum("chars")).otherwise(0)
    seen = _counted(pages).groupBy("host", "kind", "token").agg(F.count("*").alias("pages"), half(1).alias("v1"), half(2).alias("v2"), F.avg("place").alias("place"), F.sum("times").alias("times"), F.min("around").alias("around"), varying.alias("varying"), F.bool_or("main").alias("main"))
    seen = stored(seen.where(f"pages >= {LEAST_PAGES}"), "tokens")
    hosts = seen.where(f"kind = {_PAGE}").select("host", F.col("pages").alias("all_pages"))
    kept = seen.join(hosts, "host").where(F.col("pages") >= SUPPORT * F.col("all_pages"))
    entry = F.struct("place", "kind", "token", F.xxhash64("pages", "v1", "v2").alias("class"), (F.col("times") == F.col("pages")).alias("single"), "around", "varying", "main")
    return stored(kept.where(f"kind <> {_PAGE}").groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("template")), "templates")


class Template:
    """A host's equivalence classes and its content container."""

    def __init__(self, entries: list[dict]):
        groups: dict[int, list[dict]] = {}
        for e in entries:
            if e["kind"] != _CONTAINER:
                groups.setdefault(e["class"], []).append(e)
        self.classes = [([(e["token"], e["kind"] == _TEXT) for e in g], all(e["single"] for e in g)) for g in groups.values()]
        self.content = self._content([e for e in entries if e["kind"] == _CONTAINER])

    @staticmethod
    def _content(containers: list[dict]) -> int | None:
        """The spot of the innermost container with SHARE of the varying text; among containers that all have it, the innermost one marked as content."""
        most = max((e["varying"] for e in containers), default=0)
        chain = sorted((e for e in containers if most and e["varying"] >= SHARE * most), key=lambda e: -e["varying"])  # each is inside the one before
        inside = {e["token"]: e["around"] for e in containers}

        def depth(spot: int) -> int:
            n = 0
            while spot in inside:
                spot, n = inside[spot], n + 1
            return n

        chain.sort(key=lambda e: depth(e["token"]))
        marked = [e for e in chain if e["main"]]
        return (marked or chain)[-1]["token"] + (1 << 63) if chain else None

    def valid(self, found: list[Token]) -> set[int]:
        """The texts of the template's classes that are valid on this page.

        A class is valid if all its tokens are there, equally often, and those that occur once stand in the
        template's order: then each slot between two of them is nested in the class.
        """
        at: dict[int, list[int]] = {}
        for i, t in enumerate(found):
            at.setdefault(t.key, []).append(i)
        texts: set[int] = set()
        for group, single in self.classes:
            places = [at.get(k) for k, _ in group]
            if any(p is None for p in places) or len({len(p) for p in places}) != 1:
                continue
            if single and any(a[0] > b[0] for a, b in zip(places, places[1:], strict=False)):
                continue
            texts.update(k for k, is_text in group if is_text)
        return texts


def _inside(found: list[Token], top: int | None) -> list[tuple[Token, bool]]:
    """The texts inside the element of this spot, or inside marked ones, and whether that is so less what names say isn't content; headers in such elements, other than a page's own, are content."""
    state: list[int] = []  # of each token: 0 outside, 1 inside, 2 inside but not content
    out = []
    for t in found:
        before = state[t.up] if t.up >= 0 else 0
        if t.text is not None:
            out.append((t, before == 1))
            state.append(before)
        elif top is not None:
            heading = t.name == "header" and t.up >= 0 and found[t.up].name not in ("html", "body")
            state.append(1 if t.spot == top else 0 if not before else 2 if before == 2 or t.bad and not heading else 1)
        else:
            state.append(2 if before == 2 or t.bad and not (t.name == "header" and before == 1) else 1 if t.main or before else 0)
    return out


def _by_names(found: list[Token]) -> str:
    """The texts inside article and main elements or, if no text is, all texts, less what names say isn't content."""
    texts = _inside(found, None)
    if any(ok for _, ok in texts):
        return " ".join(t.text for t, ok in texts if ok)
    bad: list[bool] = []
    for t in found:
        bad.append(t.bad or t.up >= 0 and bad[t.up])
    return " ".join(t.text for t, x in zip(found, bad, strict=True) if t.text is not None and not x)


def main_text(page: str | None, template: Template | None) -> str:
    """The texts in the slots of a page's content container, joined by a space.

    Texts of the valid classes of the host's template fill no slot. Of the slots inside the container, those in
    navigation, footers, sidebars, forms and elements named as adverts, notices or comments go too. If no
    slot is left, a page is one of some copies that make up the host's template, and keeps all texts of
    the container. Without a template, or where the page lacks the container, names decide alone.
    """
    found = tokens(page or "")
    if template is None or template.content is None:
        return _by_names(found)
    texts = [t for t, ok in _inside(found, template.content) if ok]
    if not texts:
        return _by_names(found)
    own = template.valid(found)
    return " ".join(t.text for t in [t for t in texts if t.key not in own] or texts)


@lru_cache(1024)
def _parsed(template: str) -> Template:
    return Template(json.loads(template))


def extracted(pages: DataFrame, name: str = "text") -> DataFrame:
    """pages' own columns with the main text of each row ('' where there is none or html is null).

    Rows with a null or odd url share the host ''. Repeated rows each count as a page. Templates go to the
    pages by a broadcast if their bytes are few, else by a join on the host, whose rows can be split.
    """
    held = templates(pages.select("url", "html")).withColumnRenamed("host", "_host").withColumnRenamed("template", "_template")
    small = (held.agg(F.sum(F.octet_length("_template") + F.octet_length("_host"))).first()[0] or 0) <= BROADCAST_BYTES
    kept = [c for c in pages.columns if c != name]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col("url")).alias("_host"))
    by_host = pages.sparkSession.sparkContext.broadcast({r[0]: r[1] for r in held.collect()}) if small else None
    rows = rows.withColumn("_template", F.lit(None).cast("string")) if small else rows.join(held, "_host", "left")

    @F.pandas_udf("string")
    def text(html, host, template):  # noqa: ANN001
        import pandas as pd

        of = (by_host.value.get(h) for h in host) if by_host else template
        return pd.Series([main_text(page, _parsed(t) if t else None) for page, t in zip(html, of, strict=True)], dtype=object)

    bounded_batches(pages.sparkSession)
    return rows.withColumn(name, F.coalesce(text("html", "_host", "_template"), F.lit(""))).select(*kept, name)
