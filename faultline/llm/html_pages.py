"""Main text of web pages by wrapper induction.

Pages of a host are parsed into trees and aligned by simple tree matching. The template
of a host is the aligned tree: nodes whose text is the same on all pages are constant,
the others are slots. The content is the innermost container that holds nearly all
text of the slots; on each page its blocks become the text, without the parts that markup names as
something else (menus, forms, adverts, comments ...) and without blocks that repeat on
every page. Templates are made where the pages are and merged per host; a template has
the size of one page's outline, however many pages a host has.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import pieces, stored

# fixed values of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
BLOCKS = set(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
              "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCKS - {"body", "html", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "optgroup": ("option", "optgroup"), "tbody": ("tr", "td", "th", "tbody", "thead"),
        "tfoot": ("tr", "td", "th", "tbody", "thead"), "thead": ("tr", "td", "th", "tbody")}
SCOPES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"},
          "tfoot": {"table"}, "thead": {"table"}, "option": {"select", "datalist"}, "optgroup": {"select"}}
# what is not content by its name
OTHER_TAGS = set(("head title nav header footer aside form button select option input label fieldset dialog menu script style noscript "
                  "template iframe svg math canvas object embed audio video textarea").split())
OTHER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}
OTHER_NAMES = set(("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar nav navbar navigation "
                   "menu menubar breadcrumb breadcrumbs header footer masthead comment comments discussion disqus reply replies respond cookie cookies "
                   "consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related "
                   "recommended widget pagination pager toolbar skip copyright legal").split())
PLACES = set(("top bottom left right main site page global primary secondary inner outer area bar box block container wrapper wrap list links "
              "item items section slot unit holder panel").split())  # what may stand beside such a name in a class or id
TEXT_TAGS = set("h1 h2 h3 h4 h5 h6 p".split())  # never named as something else
CONTAINERS = set("html body main article section div center table tbody tr td figure".split())
MAIN = {"article", "main"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME = re.compile(r"[A-Za-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
DEEPEST = 200  # nesting; what is opened deeper lies side by side
WIDEST = 24  # runs of children of a template node; beyond it all of one label are one node
SHARE = 0.9  # of the slots' text that the content container holds
ENOUGH = 3  # different pages before a block that never changes counts as template
NEARLY = 0.9  # of a host's different pages that must have such a block


class Node:
    __slots__ = ("tag", "mark", "other", "named", "items")

    def __init__(self, tag: str, mark: str, other: bool, named: bool = False):
        self.tag, self.mark, self.other, self.named = tag, mark, other or named, named and not other
        self.items: list = []  # texts and nodes in page order

    @property
    def label(self) -> str:
        return f"{self.tag}.{self.mark}" if self.mark else self.tag


def names_other(token: str) -> bool:
    """Whether a class or id token names no content as a whole: top-nav and comments-area do, with-sidebar and related-work do not."""
    words = {w.lower() for w in NAME.findall(CAMEL.sub(" ", token))}
    return bool(words & OTHER_NAMES) and words <= OTHER_NAMES | PLACES


def describe(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(class or id without digits, whether tag, role or style make it no content, whether class or id do)."""
    mark, other, named = "", tag in OTHER_TAGS, False
    if attributes and not attributes.isspace():
        found = {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(attributes)}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        mark = re.sub(r"\d+", "", " ".join(found.get("class", found.get("id", "")).split()))
        named = tag not in ("html", "body", "article", "main") and tag not in TEXT_TAGS and any(map(names_other, names.split()))
        other |= found.get("role", "").lower() in OTHER_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        other |= bool(HIDDEN.search(found.get("style", "")))
    return mark, other, named


def parse(page: str) -> Node:
    """A tree of a page, with the end tags that HTML lets authors leave out."""
    root = Node("html", "", False)
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].items.append(page[at:])
            break
        if m.start() > at:
            stack[-1].items.append(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "article", "body") and tag not in BLOCKS:
                    break
            continue
        if tag == "html":
            continue
        if tag in CLOSES_P:
            close(stack, ("p",), {"td", "th", "table", "button"})
        if tag in ENDS:
            close(stack, ENDS[tag], SCOPES[tag])
        if tag == "body":
            close(stack, ("head",), set())
        node = Node(tag, *describe(tag, m[3]))
        stack[-1].items.append(node)
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and len(stack) < DEEPEST:
            stack.append(node)
    keep_largest(root)
    return root


def keep_largest(root: Node) -> None:
    """An element that only its name makes no content counts as content if it holds nearly all text there is besides other such parts of markup."""
    def size(node: Node) -> int:
        return sum(len(clean(x)) if isinstance(x, str) else size(x) for x in node.items if isinstance(x, str) or x.named or not x.other)

    def visit(node: Node) -> None:
        for x in node.items:
            if isinstance(x, Node) and (x.named or not x.other):
                if x.named and size(x) >= SHARE * whole:
                    x.named = x.other = False
                visit(x)

    def any_named(node: Node) -> bool:
        return any(isinstance(x, Node) and (x.named or any_named(x)) for x in node.items)

    if any_named(root):
        whole = size(root)
        if whole:
            visit(root)


def close(stack: list, tags: tuple, border: set) -> None:
    """Ends the innermost open element of `tags`, if none of `border` lies between, and all within it."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            if "tr" not in tags:
                return
        elif stack[i].tag in border:
            return


def clean(text: str) -> str:
    return " ".join((html.unescape(text) if "&" in text else text).split())


def blocks(node: Node, skip: set | None = None) -> list[str]:
    """Texts of the blocks in page order; elements named as no content are left out, and nodes in `skip`."""
    out, run = [], []

    def flush():
        if run:
            text = clean("".join(run))
            if text:
                out.append(text)
            run.clear()

    def walk(x):
        for item in x.items:
            if isinstance(item, str):
                run.append(item)
            elif item.tag in ("br", "hr"):
                run.append(" ")
            elif not item.other and not (skip and id(item) in skip):
                if item.tag in BLOCKS:
                    flush()
                    walk(item)
                    flush()
                else:
                    walk(item)

    walk(node)
    flush()
    return out


# A template node: [label, pages that have it, text key ("" once it differs), size of its text, children, repeats].
# Neighbours with one label are one node, so a template does not grow with the length of pages.

def outline(node: Node, nodes: list | None = None) -> list:
    """The template of a single page; `nodes` collects what each template node stands for."""
    return _outline(node.label, [node], nodes)


def _outline(label: str, group: list, nodes: list | None) -> list:
    own, kids = [], []
    for node in group:
        for item in node.items:
            if isinstance(item, str):
                own.append(item)
            elif not item.other:
                if item.tag not in BLOCKS:
                    own.append(" ".join(blocks(item)) if item.items else " ")
                elif kids and kids[-1][0] == item.label:
                    kids[-1][1].append(item)
                else:
                    kids.append((item.label, [item]))
    if len(kids) > WIDEST:
        merged: dict = {}
        for name, part in kids:
            merged.setdefault(name, []).extend(part)
        kids = list(merged.items())
    text = clean(" ".join(own))
    made = [label, 1, hashlib.blake2b(text.encode(), digest_size=6).hexdigest(), len(text), [], len(group) > 1]
    if nodes is not None:
        nodes.append((made, group))
    made[4] = [_outline(k, g, nodes) for k, g in kids]
    return made


def matching(a: list, b: list) -> tuple[int, list]:
    """Simple tree matching: size of the best matching and the matched pairs of children."""
    if a[0] != b[0]:
        return 0, []
    x, y = a[4], b[4]
    score = [[matching(p, q)[0] for q in y] for p in x]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score[i - 1][j - 1])
    pairs, i, j = [], len(x), len(y)
    while i and j:
        if score[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1]:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1] + 1, pairs[::-1]


def merge(a: list, b: list) -> list:
    """The template of both; children of one side only keep their place."""
    _, pairs = matching(a, b)
    kids, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[4]), len(b[4]))]:
        kids += a[4][i:p] + b[4][j:q]
        if p < len(a[4]):
            kids.append(merge(a[4][p], b[4][q]))
        i, j = p + 1, q + 1
    return [a[0], a[1] + b[1], a[2] if a[2] == b[2] else "", a[3] + b[3], kids, a[5] or b[5]]


def align(template: list, page: list) -> list:
    """(page node, template node) of everything that matches."""
    if template[0] != page[0]:
        return []
    out = [(page, template)]
    for i, j in matching(template, page)[1]:
        out += align(template[4][i], page[4][j])
    return out


class Wrapper:
    """A host's template with the keys of up to `ENOUGH` different pages."""

    def __init__(self, tree: list, keys: list):
        self.tree, self.keys = tree, keys

    def add(self, other: Wrapper) -> Wrapper:
        return Wrapper(merge(self.tree, other.tree), sorted({*self.keys, *other.keys})[:ENOUGH])

    def constant(self, node: list) -> bool:
        return len(self.keys) >= ENOUGH and node[2] != "" and node[1] >= max(ENOUGH, NEARLY * self.tree[1])

    def slot_text(self, node: list) -> int:
        return (0 if self.constant(node) else node[3]) + sum(map(self.slot_text, node[4]))

    def content(self) -> list:
        """The innermost container with nearly all text of the slots."""
        node = self.tree
        while node[0].split(".")[0] not in MAIN:
            sizes = [self.slot_text(k) for k in node[4]]
            whole = self.slot_text(node)
            main = [i for i, k in enumerate(node[4]) if k[0].split(".")[0] in MAIN and sizes[i]]
            if main:
                node = node[4][max(main, key=lambda i: sizes[i])]
                continue
            fit = [i for i, k in enumerate(node[4]) if whole and sizes[i] >= SHARE * whole and k[0].split(".")[0] in CONTAINERS and not k[5]]
            if not fit:
                nested = [k for k in node[4] if self.inner_main(k)]
                if not nested:
                    break
                node = nested[0]
                continue
            node = node[4][fit[0]]
        return node

    def inner_main(self, node: list) -> bool:
        return any((k[0].split(".")[0] in MAIN and self.slot_text(k)) or self.inner_main(k) for k in node[4])

    def dump(self) -> str:
        return json.dumps([self.tree, self.keys])

    @staticmethod
    def load(text: str) -> Wrapper:
        return Wrapper(*json.loads(text))

    @staticmethod
    def of(page: str) -> Wrapper:
        tree = parse(page)
        return Wrapper(outline(tree), [hashlib.blake2b("\n".join(blocks(tree)).encode(), digest_size=6).hexdigest()])

    def extract(self, page: str) -> str:
        """The main text of one page; the page's own outline where the template has no match for it."""
        nodes: list = []
        outline(parse(page), nodes)
        groups = {id(t): g for t, g in nodes}
        found = align(self.tree, nodes[0][0])
        centre = self.content()
        place = next((p for p, t in found if t is centre), None)
        own = Wrapper(nodes[0][0], [])
        if place is None or (place[0].split(".")[0] not in MAIN and own.content()[0].split(".")[0] in MAIN):
            place = own.content()
        skip = {id(n) for p, t in found if self.constant(t) and not t[4] and t is not centre for n in groups[id(p)]} - within_main(groups, nodes)
        return " ".join(b for n in groups[id(place)] for b in blocks(n, skip))


def within_main(groups: dict, nodes: list) -> set:
    """Ids of all page nodes inside an article or main element."""
    out: set = set()

    def walk(node: Node, inside: bool) -> None:
        if inside:
            out.add(id(node))
        for x in node.items:
            if isinstance(x, Node):
                walk(x, inside or node.tag in MAIN)

    for n in groups[id(nodes[0][0])]:
        walk(n, False)
    return out


def host_of(url: str) -> Column:
    """Host of a URL column in lower case without port; text without a scheme or a null gives an empty name."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


TEMPLATES = "host string, template string"
HELD = 2_000  # hosts a task holds before it passes their templates on


def learn_templates(pages: DataFrame, url: str = "url", page: str = "html", fan_in: int = 32) -> DataFrame:
    """host, template (text) from all pages; a host's pages with one content count once. Tasks merge their
    own outlines first, then each host's parts are merged in two steps."""
    def outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            rows = []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    made = Wrapper.of(text)
                    if (name, made.keys[0]) not in seen:
                        if len(seen) > 100 * HELD:
                            seen.clear()
                        seen.add((name, made.keys[0]))
                        rows.append((name, made.keys[0], made.dump()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.string()) for i in range(3)], ["host", "content", "template"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([w.dump() for w in held.values()], pa.string())], ["host", "template"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    made = Wrapper.load(text)
                    held[name] = held[name].add(made) if name in held else made
                    if len(held) > HELD:
                        yield flush()
        if held:
            yield flush()

    def together(group):
        texts = sorted(group.column("template").to_pylist())
        whole = Wrapper.load(texts[0])
        for t in texts[1:]:
            whole = whole.add(Wrapper.load(t))
        return pa.table({"host": group.column("host")[:1], "template": pa.array([whole.dump()], pa.string())})

    parts = pages.select(host_of(url).alias("host"), F.col(page).alias("page")).mapInArrow(outlines, "host string, content string, template string")
    different = parts.groupBy("host", "content").agg(F.min("template").alias("template"))
    parts = different.select("host", "template").mapInArrow(run, TEMPLATES)
    parts = parts.withColumn("_salt", F.pmod(F.xxhash64("template"), F.lit(fan_in)))
    once = parts.groupBy("host", "_salt").applyInArrow(together, TEMPLATES)
    return once.groupBy("host").applyInArrow(together, TEMPLATES)


def extract_text(pages: DataFrame, url: str = "url", page: str = "html", out: str = "main_text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Adds `main_text` to every page; other columns pass through, an older `main_text` is replaced.

    Character references are decoded, white space inside a block becomes one blank, blocks are
    joined by a blank in page order, and nothing else is dropped or cut. A null or empty page, or one
    without text, gives an empty text. A host with fewer than three different pages has no
    constant nodes, so its pages count on their markup alone. Repeated rows stay. Templates are
    sent to all tasks if they have no more than `broadcast_bytes`, else joined by host.
    """
    templates = stored(learn_templates(pages, url, page), "templates")
    size = templates.agg(F.sum(F.octet_length("template") + F.octet_length("host")).alias("n")).first()["n"] or 0
    side = templates.select(F.col("host").alias("_host"), F.col("template").alias("_template"))
    side = F.broadcast(side) if size <= broadcast_bytes else side
    kept = pages.drop(out, "_host", "_template", "_page")
    joined = kept.withColumn("_page", F.struct(F.col(page).alias("page"), host_of(url).alias("host")))
    joined = joined.join(side, F.col("_page.host") == F.col("_host"), "left").withColumn("_page", F.struct(F.col("_page.page").alias("page"), "_template", "_host")).drop("_host", "_template")
    schema = T.StructType([*[f for f in joined.schema.fields if f.name != "_page"], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for batch in batches:
            place = batch.schema.get_field_index("_page")
            column = batch.column(place)
            rest = [c for i, c in enumerate(batch.columns) if i != place]
            for a, b in pieces(column.field(0)):
                texts = []
                for row in column.slice(a, b - a):
                    text, template, host = row["page"].as_py(), row["_template"].as_py(), row["_host"].as_py()
                    if not text or template is None:
                        texts.append("")
                        continue
                    if host not in known:
                        if len(known) > HELD:
                            known.clear()
                        known[host] = Wrapper.load(template)
                    texts.append(known[host].extract(text))
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], pa.array(texts, pa.string())], schema.names)

    return joined.mapInArrow(run, schema)
