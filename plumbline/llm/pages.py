"""Main text of web pages by deducing the template that pages of one host share.

Tokens of a page are its containers, named by their path, and its texts, named by their path and
content. The occurrence vector of a token holds how often it stands on each page of the host;
tokens with one vector form an equivalence class. Spark adds up a fingerprint of each vector,
page by page, so no page list is ever gathered. Large and frequent classes whose tokens stand once
on each of their pages are valid; nested in each other by their paths they are the template, and
what lies between their tokens are its slots. The main slot is the innermost container of the
template that holds most of the text outside menus, notices and the like, or else the article or
main element around it, so that titles and leads beside it stay; texts that are template
themselves are left out of it, unless they are the larger part of its text on a page, as where a
host repeats one article.

Pages of hosts with few pages, pages without the main slot of their host, and pages with more text
beside it, texts of the template not counted, than in it, fall back on their article or main element, and at last on all of their
body.

Menus, adverts and the like are told by element, role and name. Outside of articles a part of a
class or id is enough. Within an article, and for sections anywhere, all parts of a class must be
such names or words of layout, as in ``ad-box``; ids of sections, and names of headings, say
nothing there, as they name what the text is about.

Blocks are separated by block elements; a line break element is white space.

Defined cases: null and empty pages have an empty text. Pages with a null or odd url belong to one
host without a name. Repeated pages each give a row. Cut tags are dropped, open elements end with
the element around them. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.arrows import beside, checkpointed, quoted, shards, told_apart

LEAST_PAGES = 5  # of a host, for a template
LEAST_TEXT_PAGES = 20  # of a host, for texts in the template
LEAST_CLASS = 3  # tokens of a class
FREQUENT, TEXT_FREQUENT = 0.5, 0.9  # shares of the pages of a host
MOST_TEXT = 0.8  # share of the text of a host that the main slot holds

# Elements and names of HTML.
_RAW = "script style textarea title noscript iframe template svg math object select"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CONTAINERS = frozenset(
    "html head body main article section div nav header footer aside ul ol dl table tbody tr td form "
    "figure blockquote h1 h2 h3 h4 h5 h6 details dialog fieldset menu center pre".split()
)
_BLOCKS = _CONTAINERS | frozenset("p li dt dd th hr figcaption caption thead tfoot address summary legend".split())
_ASIDE = frozenset("nav footer aside form dialog menu head button fieldset".split())
_ASIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer masthead cookie cookies consent notice notices newsletter subscribe "
    "subscription popup modal overlay share sharing social comment comments disqus respond related recommended "
    "widget toolbar skip login signup search pagination pager".split()
)
_LAYOUT = frozenset(
    "area bar block bottom box button buttons container content footer form global group header inner item left link "
    "links list main outer page panel reader right section site slot thread top unit user wrap wrapper".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW.replace(' ', '|')})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"""
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z|[^<]+|<",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_MASK = (1 << 63) - 1
_HALF = (1 << 31) - 1  # fingerprints are added in two halves, which no number of pages overflows


def _set_aside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element holds something else than the article."""
    if tag in _ASIDE or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        if name == "role" and value in _ASIDE_ROLES:
            return True
        if name in ("class", "id") and _names_aside(tag, name, value, in_article):
            return True
    return False


def _names_aside(tag: str, name: str, value: str, in_article: bool) -> bool:
    if not in_article and tag != "section" and tag not in _HEADINGS:
        return not _ASIDE_NAMES.isdisjoint(re.split(r"[^a-z0-9]+", value))
    if tag in _HEADINGS or (tag == "section" and name == "id"):
        return False
    for token in value.split():
        parts = [p for p in re.split(r"[^a-z]+", token) if p]
        if not _ASIDE_NAMES.isdisjoint(parts) and all(p in _ASIDE_NAMES or p in _LAYOUT for p in parts):
            return True
    return False


class Page:
    """Containers and texts of a page in their order.

    containers: (path number, parent or -1, tag, depth); texts: (container or -1, block, text, aside).
    """

    def __init__(self, source: str | None, numbers: dict[tuple[int, str], int]):
        self.containers: list[tuple[int, int, str, int]] = []
        self.texts: list[tuple[int, int, str, bool]] = []
        # open elements: tag, container, whether set aside, whether within an article
        stack: list[tuple[str, int, bool, bool]] = [("", -1, False, False)]
        open_tags: Counter[str] = Counter()
        block = 0
        for m in _TOKEN.finditer(source or ""):
            tag = m[3] or m[6]
            if tag is None:
                if m[0][0] != "<" or m[0] == "<":
                    _, container, aside, _ = stack[-1]
                    self.texts.append((container, block, m[0], aside))
                elif m[1]:
                    block += m[1].lower() in ("title", "textarea")
                continue
            tag = tag.lower()
            if tag in _BLOCKS:
                block += 1
            if tag == "br":
                self.texts.append((stack[-1][1], block, " ", stack[-1][2]))
            if m[2] or m[5]:
                while open_tags[tag]:
                    closed = stack.pop()[0]
                    open_tags[closed] -= 1
                    if closed == tag:
                        break
                continue
            if tag in _VOID or tag not in _CONTAINERS and tag not in ("li", "button"):
                # marks within a text need no place of their own, unless they are set aside
                if tag in _VOID or tag == "p" or not _set_aside(tag, m[4] or m[7], True):
                    continue
            top = stack[-1]
            if tag == "li" and top[0] == "li":
                open_tags[stack.pop()[0]] -= 1
                top = stack[-1]
            aside = top[2] or _set_aside(tag, m[4] or m[7], top[3])
            container = top[1]
            if tag in _CONTAINERS:
                path = self.containers[container][0] if container >= 0 else 0
                depth = self.containers[container][3] + 1 if container >= 0 else 1
                names = "".join(sorted(v.strip("\"'") for n, v in _ATTRIBUTE.findall(m[4] or m[7] or "") if n.lower() in ("class", "id")))
                key = (path, f"{tag}.{names}" if names else tag)
                number = numbers.get(key)
                if number is None:
                    number = numbers[key] = _number("tag", *key)
                self.containers.append((number, container, tag, depth))
                container = len(self.containers) - 1
            stack.append((tag, container, aside, top[3] or tag in ("article", "main")))
            open_tags[tag] += 1

    def around(self, container: int) -> int:
        """The article around a container, or else its main element, or else itself."""
        found, k = container, container
        while k >= 0:
            tag = self.containers[k][2]
            if tag == "article":
                return k
            if tag == "main":
                found = k
            k = self.containers[k][1]
        return found

    def within(self, containers: set[int]) -> list[bool]:
        """For each container, whether it is one of these or lies in one."""
        inside: list[bool] = []
        for k, (_, parent, _, _) in enumerate(self.containers):
            inside.append(k in containers or parent >= 0 and inside[parent])
        return inside


def _number(*parts) -> int:
    """A stable 63-bit number of a token."""
    digest = hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return int.from_bytes(digest, "little") & _MASK


def _text_number(path: int, text: str) -> int:
    return _number("text", path, " ".join(text.split()))


_COUNTED = pa.schema(
    [("host", pa.int64()), ("token", pa.int64()), ("kind", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("pages", pa.int64()),
     ("most", pa.int64()), ("mass", pa.int64()), ("depth", pa.int32())]
)
_COUNTED_DDL = "host bigint, token bigint, kind int, low bigint, high bigint, pages bigint, most bigint, mass bigint, depth int"
PAGE, TAG, TEXT = 0, 1, 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of a shard: fingerprint, pages, most on a page, text inside, depth."""
    numbers: dict[tuple[int, str], int] = {}
    for table in shards(batches, "html"):
        if len(numbers) > 1_000_000:
            numbers.clear()
        found: dict[tuple[int, int], list] = {}
        for host, mark, source in zip(*(table.column(c).to_pylist() for c in ("host", "mark", "html"))):
            page = Page(source, numbers)
            mass = [0] * len(page.containers)
            whole = 0
            count: dict[tuple[int, int, int], list[int]] = {}
            for container, _, text, aside in page.texts:
                size = len(text) - text.count(" ")
                if not text.strip():
                    continue
                path = page.containers[container][0] if container >= 0 else 0
                own = count.setdefault((TEXT, _text_number(path, text), 0), [0, 0])
                own[0] += 1
                if not aside:
                    whole += size
                    if container >= 0:
                        mass[container] += size
            for k in range(len(page.containers) - 1, -1, -1):
                number, parent, _, depth = page.containers[k]
                if parent >= 0:
                    mass[parent] += mass[k]
                own = count.setdefault((TAG, number, depth), [0, 0])
                own[0] += 1
                own[1] += mass[k]
            count[PAGE, 0, 0] = [1, whole]
            for (kind, token, depth), (n, inside) in count.items():
                row = found.setdefault((host, token), [kind, 0, 0, 0, 0, 0, depth])
                print_ = _number(mark, n)
                row[1] += print_ & _HALF
                row[2] += print_ >> 31
                row[3] += 1
                row[4] = max(row[4], n)
                row[5] += inside
        rows = [(h, t, *r) for (h, t), r in found.items()]
        columns = list(zip(*rows)) if rows else [[] for _ in _COUNTED]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)


_TEMPLATE = "host bigint, main bigint, texts array<bigint>, classes int"


def _deduced(table: pa.Table) -> pa.Table:
    """The template of a host from its frequent tokens."""
    rows = table.to_pylist()
    page = next(r for r in rows if r["kind"] == PAGE)
    classes: dict[tuple, list[dict]] = {}
    for r in rows:
        if r["kind"] != PAGE and r["most"] == 1:
            classes.setdefault((r["low"], r["high"], r["pages"]), []).append(r)
    valid = [c for c in classes.values() if len(c) >= LEAST_CLASS]
    template = [r for c in valid for r in c]
    texts = [
        r["token"]
        for r in template
        if r["kind"] == TEXT and page["pages"] >= LEAST_TEXT_PAGES and r["pages"] >= TEXT_FREQUENT * page["pages"]
    ]
    slots = [r for r in template if r["kind"] == TAG and r["mass"] >= MOST_TEXT * page["mass"] > 0]
    main = max(slots, key=lambda r: (r["depth"], r["mass"], r["token"]), default=None)
    return pa.table(
        {
            "host": pa.array([page["host"]], pa.int64()),
            "main": pa.array([main and main["token"]], pa.int64()),
            "texts": pa.array([sorted(texts)], pa.list_(pa.int64())),
            "classes": pa.array([len(valid)], pa.int32()),
        }
    )


def main_text(source: str | None, main: int | None, template_texts: set[int], numbers: dict) -> str:
    """The blocks of the main slot, joined by blank lines."""
    page = Page(source, numbers)
    texts: list[tuple[int, int, str, int, bool]] = []
    for container, block, text, aside in page.texts:
        if not aside:
            path = page.containers[container][0] if container >= 0 else 0
            known = bool(template_texts and text.strip()) and _text_number(path, text) in template_texts
            texts.append((container, block, text, sum(map(len, text.split())), known))

    def within(chosen: set[int]) -> list[tuple[int, int, str, int, bool]]:
        inside = page.within(chosen)
        return [t for t in texts if t[0] >= 0 and inside[t[0]]]

    def fresh(held: list[tuple[int, int, str, int, bool]]) -> int:
        return sum(t[3] for t in held if not t[4])

    chosen = {page.around(k) for k, c in enumerate(page.containers) if c[0] == main} if main is not None else set()
    if chosen:
        slot = within(chosen)
        beside = fresh(texts) - fresh(slot)
        if sum(t[3] for t in slot) < beside:
            chosen = set()
    for tags in (("article",), ("main",)):
        chosen = chosen or {k for k, c in enumerate(page.containers) if c[2] in tags}
    held = within(chosen) if chosen else texts
    all_fresh = fresh(held)
    known_larger = sum(t[3] for t in held) - all_fresh > all_fresh
    blocks: dict[int, list[str]] = {}
    for _, block, text, _, known in held:
        if not known or known_larger:
            blocks.setdefault(block, []).append(text)
    cleaned = (" ".join(entities.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n\n".join(c for c in cleaned if c)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers: dict[tuple[int, str], int] = {}
    for table in shards(batches, "html"):
        if len(numbers) > 1_000_000:
            numbers.clear()
        texts = [
            main_text(source, main, set(known or ()), numbers)
            for source, main, known in zip(*(table.column(c).to_pylist() for c in ("html", "main", "texts")))
        ]
        out = table.select(["id", "url"]).append_column("text", pa.array(texts, pa.string()))
        out = out.append_column("n_chars", pa.array(list(map(len, texts)), pa.int64()))
        yield from out.to_batches()


def templates(pages: DataFrame) -> DataFrame:
    """From rows (host, mark, html): for each host with enough pages, its main slot and texts."""
    counted = checkpointed(
        pages.mapInArrow(_counted, _COUNTED_DDL)
        .groupBy("host", "token", "kind")
        .agg(
            F.sum("low").alias("low"),
            F.sum("high").alias("high"),
            F.sum("pages").alias("pages"),
            F.max("most").alias("most"),
            F.sum("mass").alias("mass"),
            F.max("depth").alias("depth"),
        )
        .where(F.col("pages") >= LEAST_PAGES)
    )
    hosts = checkpointed(counted.where(F.col("kind") == PAGE).select("host", F.col("pages").alias("all_pages")))
    frequent = beside(counted, hosts, "host", hosts.count()).where(F.col("pages") >= FREQUENT * F.col("all_pages"))
    return checkpointed(frequent.drop("all_pages").groupBy("host").applyInArrow(_deduced, _TEMPLATE))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row per page: id, url, text, n_chars."""
    rows = pages.select(F.col(quoted(id)).alias("id"), F.col(quoted(url)).alias("url"), F.col(quoted(html)).alias("html"))
    host = F.lower(F.regexp_extract("url", _HOST, 1))
    rows = rows.withColumn("host", F.xxhash64(*told_apart(F.nullif(host, F.lit("")))))
    marked = rows.select("host", F.xxhash64(*told_apart(F.col("id"), F.col("url"))).alias("mark"), "html")
    known = templates(marked)
    placed = beside(rows, known.drop("classes"), "host", known.count()).select("id", "url", "html", "main", "texts")
    kind = rows.schema["id"].dataType.simpleString()
    out = placed.mapInArrow(_extracted, f"id {kind}, url string, text string, n_chars bigint")
    return out.withColumnsRenamed({"id": id, "url": url})
