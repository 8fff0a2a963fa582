"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page is a stream of block tags and text slots (inline markup belongs to the slot). The streams of a host are aligned one after the other, element by element from the root: a
tag is the same where its name, its classes and what it stands in are. Mismatches widen the wrapper. A tag that only some of its parent's pages have becomes optional,
``( )?``; one that repeats in its parent a repeated group, ``( )+``; a text that differs becomes a slot, ``#``, and one that all pages with texts in that element have stays
fixed, wherever in the element it stands. Aligning two wrappers is the same as aligning the pages of both, in any order, so tasks make wrappers of the pages they read and those of
a host are aligned at the end. All pages count.

The wrapper tells which texts are the site's (fixed) and how much of what varies is in each element; a page is read along it, by the elements that it has itself, so an odd
page changes no other one. Where a page marks its article (``article``, ``main`` and their like), the marks choose within what varies; elsewhere the article is the deepest container
that holds it. Menus, footers, forms and the like go by their tags, roles or names, since their texts may vary too. All of it takes linear time.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, fits

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
SKIPPED = frozenset("head script style noscript template iframe textarea title svg math object canvas audio video select option button form nav footer aside dialog menu input fieldset noembed noframes".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar form".split())
SKIPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup comment comments respond replies reviews disqus share sharing social related recommended paywall bio".split())
#: What a skipped name may be joined with: cookie-bar, main-menu, ad-box-2. A class with any other part, such as has-sidebar or social-studies, isn't skipped.
BESIDE_NAMES = frozenset("area articles author bar block bottom box button buttons container form global group header inner item items left link links list main offer outer page panel posts primary reader right secondary section site slot stories thread top user unit widget wrap wrapper".split())
#: What marks an article, the surest first.
MAIN_KINDS = ("article", "body-of-article", "main", "named")
MAIN_NAMES = frozenset("article content story entry main".split())
PLAIN = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())  # what their classes are called doesn't count
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
#: An element that ends an open one of these, if it begins in it.
ENDED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SHARE = 0.9  # of the varying text that the article's container holds
LONG = 20  # letters; where an article's slots are longer, shorter ones don't tell its container
LEAST_MARKED = 0.25  # of a page's varying text; marks with less aren't the article's
LEAST_WIDE = 5  # pages, and half of the host's, that tell a fixed text within a marked article
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"/?([A-Za-z][^\s/>]*)")
_PARTS = re.compile(r"[^a-z]+")


def _attributes(text: str) -> dict[str, str]:
    if not text.strip(" /\t\n\r\f"):
        return {}
    return {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in _ATTRIBUTE.finditer(text)}


def _skips(name: str) -> bool:
    """Whether a class or id says that its element isn't the article."""
    parts = {x for x in _PARTS.split(name) if x}
    return bool(parts & SKIPPED_NAMES) and parts <= SKIPPED_NAMES | BESIDE_NAMES


def _kind(name: str, found: dict[str, str], in_article: bool) -> str:
    """``-`` for what isn't the article by its tag or role, ``~`` by its name, a kind of MAIN_KINDS for what may hold it, else empty."""
    if name in SKIPPED or name == "header" and not in_article or found.get("role", "") in SKIPPED_ROLES:
        return "-"
    names = f"{found.get('class', '')} {found.get('id', '')}".split() if name not in PLAIN else []
    if any(_skips(x) or x == "header" and not in_article for x in names):
        return "~"
    if name == "article":
        return "article"
    if found.get("itemprop") == "articlebody":
        return "body-of-article"
    if name == "main" or found.get("role") == "main":
        return "main"
    return "named" if name in ("div", "section", "td") and {x for part in names for x in _PARTS.split(part)} & MAIN_NAMES else ""


def _pieces(page: str) -> Iterator[tuple[str, str]]:
    """("text", text) and ("tag", what stands between < and >), without comments, declarations and what raw elements hold."""
    at, n, last_quote = 0, len(page), {q: page.rfind(q) for q in "\"'"}
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", page[at:]
            return
        after = page[begin + 1 : begin + 2]
        if not (after.isascii() and after.isalpha() or after and after in "/!?"):
            yield "text", page[at : begin + 1]
            at = begin + 1
            continue
        if begin > at:
            yield "text", page[at:begin]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        end = page.find(">", begin)
        if end < 0:
            return
        look = begin
        while "=" in page[look:end]:  # a > in a quoted value doesn't end the tag
            quote = min((p for q in "\"'" if (p := page.find(q, look, end)) >= 0), default=-1)
            if quote < 0 or last_quote[page[quote]] <= quote:
                break
            closed = page.find(page[quote], quote + 1)
            look = closed + 1
            if closed > end:
                end = page.find(">", closed)
                if end < 0:
                    return
        tag = page[begin + 1 : end]
        at = end + 1
        name = _NAME.match(tag)
        if not name or after in "!?":
            continue
        yield "tag", tag
        if after != "/" and name[1].lower() in RAW and not tag.endswith("/"):
            closing = re.compile(rf"</{re.escape(name[1])}(?=[\s/>])", re.IGNORECASE).search(page, at)
            at = closing.start() if closing else n


def _hash(text: str) -> str:
    return xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))


class Page:
    """A page's elements and slots.

    ``elements`` are (path, parent's path, key, whether it repeats in its parent); a path is a hash of the keys from the root, and an element in one of the same key is the
    same node, so that nesting doesn't deepen the paths without end. ``slots`` are (path, text, letters in links, marks); marks are the kinds and numbers of marked elements around, of
    each kind the outermost. Texts that aren't the article's by a tag, role or name around them are left out; ``by_name=False`` leaves out none by name. Character references are
    decoded and white space is one space.
    """

    def __init__(self, page: str | None, by_name: bool = True):
        self.elements: list[tuple[str, str, str, bool]] = []
        self.slots: list[tuple[str, str, int, tuple[tuple[str, int], ...]]] = []
        open_: list[tuple] = []  # name, kind, path, key, marks, skipped before, children's keys
        root: dict[str, bool] = {}
        run: list[str] = []
        skipped = articles = links = linked = number = 0
        marks: tuple[tuple[str, int], ...] = ()
        counts = {}  # open elements of each name

        def close_run() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                self.slots.append((open_[-1][2] if open_ else "", text, linked, marks))
            linked = 0

        def pop() -> None:
            nonlocal skipped, articles, marks
            name, kind, _, _, marks, skipped, _ = open_.pop()
            counts[name] -= 1
            articles -= kind in ("article", "main")

        for what, value in _pieces(page or ""):
            if what == "text":
                if not skipped:
                    text = entities.unescape(value)
                    run.append(text)
                    if links:
                        linked += len(text)
                continue
            name = _NAME.match(value)[1].lower()
            if name == "br":
                run.append(" ")
                continue
            if name == "a":
                links = max(0, links + (1 if value[0] != "/" else -1))
            block = name not in INLINE
            if value[0] == "/":
                if block:
                    close_run()
                if counts.get(name):
                    while open_[-1][0] != name:
                        pop()
                    pop()
                continue
            if name == "body":  # ends a head that was left open
                close_run()
                while open_:
                    pop()
            found = _attributes(value[len(name) :])
            kind = _kind(name, found, articles > 0)
            if block:
                close_run()
                ends = ENDED.get(name, ("p",))
                while open_ and open_[-1][0] in ends:
                    pop()
            if name in VOID or value.endswith("/"):
                continue
            if block:
                parent, key_above, siblings = (open_[-1][2], open_[-1][3], open_[-1][6]) if open_ else ("", "", root)
                key = " ".join([name, *sorted({y for x in found.get("class", "").split() if (y := "-".join(z for z in _PARTS.split(x) if z))})])
                path = parent if key == key_above else _hash(f"{parent} {key}")
                if path != parent:
                    self.elements.append((path, parent, key, siblings.get(key, False)))
                    siblings[key] = True
                own = {} if path != parent else siblings
            else:
                path, key, own = (open_[-1][2], open_[-1][3], open_[-1][6]) if open_ else ("", "", root)
            open_.append((name, kind, path, key, marks, skipped, own))
            counts[name] = counts.get(name, 0) + 1
            if kind in MAIN_KINDS:
                if kind != "named" and skipped < 1_000_000:  # what a name would skip isn't skipped if the article is in it
                    skipped = 0
                if all(kind != k for k, _ in marks):
                    number += 1
                    marks = (*marks, (kind, number))
            elif kind == "-" or kind and by_name:
                skipped += 1_000_000 if kind == "-" else 1
            articles += kind in ("article", "main")
        close_run()


def _letters(text: str, linked: int) -> tuple[int, int]:
    """Letters outside links, and those if they are many."""
    n = max(0, len(text) - linked)
    return n, n if n > LONG else 0


class Wrapper:
    """``nodes``: {path: [parent's path, key, pages, repeats, sum of its first places, letters of text, those in long slots]}; ``texts``: {path: [pages with slots in it, whether a
    text isn't in all of them, {hash of a text that is: [letters, those of it that are long, sum of first places]}]}, so that a path has no more texts than its least page."""

    def __init__(self, nodes=None, texts=None, pages: int = 0):
        self.nodes, self.texts, self.pages = nodes or {}, texts or {}, pages

    @classmethod
    def of(cls, page: Page) -> Wrapper:
        nodes: dict[str, list] = {"": ["", "", 1, False, 0, 0, 0]}
        for at, (path, parent, key, again) in enumerate(page.elements):
            node = nodes.setdefault(path, [parent, key, 1, False, at, 0, 0])
            node[3] = node[3] or again
        texts: dict[str, list] = {}
        for at, (path, text, linked, _) in enumerate(page.slots):
            own = texts.setdefault(path, [1, False, {}])[2].setdefault(_hash(text), [0, 0, at])
            for k, n in enumerate(_letters(text, linked)):
                own[k] += n
                nodes[path][5 + k] += n
        return cls(nodes, texts, 1)

    @classmethod
    def infer(cls, pages: list[str | None]) -> Wrapper:
        found = cls()
        for page in pages:
            found.align(cls.of(Page(page)))
        return found

    def align(self, other: Wrapper) -> None:
        """Widen this wrapper so that it has what the other one has."""
        for path, (parent, key, pages, repeats, places, letters, long) in other.nodes.items():
            node = self.nodes.setdefault(path, [parent, key, 0, False, 0, 0, 0])
            node[2:] = node[2] + pages, node[3] or repeats, node[4] + places, node[5] + letters, node[6] + long
        for path, (pages, varies, texts) in other.texts.items():
            own = self.texts.get(path)
            if not own:
                self.texts[path] = [pages, varies, {h: list(x) for h, x in texts.items()}]
                continue
            both = {h: [x + y for x, y in zip(own[2][h], texts[h], strict=True)] for h in own[2].keys() & texts.keys()}
            own[:] = own[0] + pages, own[1] or varies or len(own[2]) + len(texts) > 2 * len(both), both
        self.pages += other.pages

    def dumps(self) -> str:
        return json.dumps([self.nodes, self.texts, self.pages], separators=(",", ":"))

    @classmethod
    def loads(cls, text: str) -> Wrapper:
        return cls(*json.loads(text))

    def expression(self) -> str:
        """The wrapper as a union-free expression: in an element its slot, its fixed texts and its children, by their mean places."""
        below: dict[str, list[str]] = {}
        for path, node in self.nodes.items():
            if path:
                below.setdefault(node[0], []).append(path)

        def part(path: str) -> str:
            parent, key, pages, repeats, *_ = self.nodes[path]
            inner = " ".join(part(x) for x in sorted(below.get(path, ()), key=lambda x: (self.nodes[x][4] / self.nodes[x][2], x)))
            _, varies, texts = self.texts.get(path, (0, False, {}))
            inner = " ".join([*["#"] * varies, *(f"'{h}'" for h in sorted(texts, key=lambda h: (texts[h][2], h))), *([inner] if inner else [])])
            if not path:
                return inner
            out = f"({key}: {inner})" if inner else f"({key})"
            return out + ("+" if repeats else "") if pages >= self.nodes[parent][2] else f"({out}{'+' if repeats else ''})?"

        return part("") if self.nodes else ""

    def decision(self) -> dict:
        """What pages are read by: ``fixed``, the hashes of the host's own texts by path, of them those in most pages, ``wide``; and ``mass``, for each path below which something varies the
        mean number of letters in a page that has it, in long slots if there are any, in thousandths. Nothing if nothing varies: one page, or copies of one."""
        if not any(varies for _, varies, _ in self.texts.values()):
            return {}
        fixed: dict[str, list[str]] = {}
        wide: dict[str, list[str]] = {}
        own = {path: [node[5], node[6]] for path, node in self.nodes.items()}
        for path, (pages, _, texts) in self.texts.items():
            if texts and pages > 1 and self.pages > 2:
                fixed[path] = sorted(texts)
                if pages >= LEAST_WIDE and 2 * pages >= self.pages:
                    wide[path] = fixed[path]
                own[path] = [n - sum(found[k] for found in texts.values()) for k, n in enumerate(own[path])]
        k = 1 if any(long for _, long in own.values()) else 0
        mass = {path: 1000 * letters[k] // self.nodes[path][2] for path, letters in own.items() if letters[k]}
        return {"mass": dict(sorted(mass.items())), "fixed": dict(sorted(fixed.items())), "wide": dict(sorted(wide.items()))}


def _container(page: Page, mass: dict[str, int]) -> set[str]:
    """The paths of the deepest container of what varies, among the page's own elements; the smallest hash of those that hold the same."""
    children: dict[str, dict[str, str]] = {}
    for path, parent, key, _ in page.elements:
        children.setdefault(parent, {})[path] = key
    order = [""]
    for path in order:
        order += children.get(path, ())
    total = {path: mass.get(path, 0) for path in order}
    for path in reversed(order):
        for child in children.get(path, ()):
            total[path] += total[child]
    at = ""
    while heavy := [x for x, key in children.get(at, {}).items() if key.split(" ")[0] in CONTAINERS and total[x] and total[x] >= SHARE * total[""]]:
        at = min(heavy)
    inside = [at]
    for path in inside:
        inside += children.get(path, ())
    return set(inside)


def _marked(slots: list[tuple], varying: list[int]) -> list[bool]:
    """Of each slot, whether it is in the elements whose marks are the article's: the surest kind of which one element has as much of what varies as the marked texts outside that
    kind. Of its elements those count that have half as much as the largest; teasers have less. Articles within the chosen elements, if they aren't that kind, aren't theirs."""
    masses: dict[tuple[str, int], int] = {}
    for (*_, marks), n in zip(slots, varying, strict=True):
        for mark in marks:
            masses[mark] = masses.get(mark, 0) + n
    present = [k for k in MAIN_KINDS if any(k == kind for kind, _ in masses)]
    for kind in present:
        largest = max(n for (k, _), n in masses.items() if k == kind)
        outside = sum(n for (*_, marks), n in zip(slots, varying, strict=True) if marks and all(k != kind for k, _ in marks))
        if largest >= outside or kind == present[-1]:
            chosen = {mark for mark, n in masses.items() if mark[0] == kind and 2 * n >= largest}
            refused = kind != "article" and all(k != "article" for k, _ in chosen)
            return [any(m in chosen and not (refused and any(k == "article" and x > m[1] for k, x in marks)) for m in marks) for *_, marks in slots]
    return [False] * len(slots)


def main_text(page: str | None, decision: dict | None) -> str:
    """The article's text: the slots that the host's wrapper and the page's marks say are the article's, in order, joined by a space. Empty for null.

    Without a decision, all texts count as varying. Fixed texts within a marked article go where what varies in it is more; where it's less, pages are near copies. A page without
    anything that varies is read whole, and one whose texts all go by name is read with them.
    """
    own, host = Page(page), decision or {}
    slots = own.slots or Page(page, by_name=False).slots
    fixed = [bool(host) and path in host["fixed"] and _hash(text) in host["fixed"][path] for path, text, *_ in slots]
    wide = [found and slot[0] in host["wide"] for found, slot in zip(fixed, slots, strict=True)]
    varying = [0 if found else _letters(text, linked)[0] for found, (_, text, linked, _) in zip(wide, slots, strict=True)]
    taken: list[int] = []
    if any(marks for *_, marks in slots):
        taken = [k for k, wanted in enumerate(_marked(slots, varying)) if wanted]
        if sum(varying[k] for k in taken) < LEAST_MARKED * sum(varying):
            taken = []
        elif 2 * sum(varying[k] for k in taken) >= sum(len(slots[k][1]) for k in taken):
            taken = [k for k in taken if not wide[k]]
    if not taken and host:
        inside = _container(own, host["mass"])
        taken = [k for k, (path, *_) in enumerate(slots) if path in inside and not fixed[k]]
    return " ".join(slots[k][1] for k in taken or range(len(slots)))


def _host(url: F.Column) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def wrappers(pages: DataFrame, *, held: int = 5_000, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row (host, wrapper) per host, of all its pages.

    A task aligns the pages it reads, so a host with a third of all pages brings a wrapper for each task, not its pages; beyond ``held`` hosts it gives out what it has and
    begins anew. Equal wrappers' rows and the hosts' others are then aligned as a stream sorted by host, one host at a time.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Wrapper] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found.setdefault(host, Wrapper()).align(Wrapper.of(Page(page.as_py())))
                if len(found) > held:
                    yield _rows(found)
                    found = {}
        yield _rows(found)

    def _rows(found: dict[str, Wrapper]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([w.dumps() for w in found.values()], pa.string())], names=["host", "wrapper"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, Wrapper] = {}
        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if last and host not in last:
                    yield _rows(last)
                    last = {}
                last.setdefault(host, Wrapper()).align(Wrapper.loads(text.as_py()))
        yield _rows(last)

    rows = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    parts = rows.mapInArrow(partial, "host string, wrapper string")
    return parts.repartition("host").sortWithinPartitions("host").mapInArrow(align, "host string, wrapper string")


def decisions(found: DataFrame) -> DataFrame:
    """One row (host, decision) per row of ``wrappers``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [json.dumps(Wrapper.loads(x.as_py()).decision(), separators=(",", ":")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "decision"])

    return found.mapInArrow(run, "host string, decision string")


def extract(pages: DataFrame, *, most_broadcast: int = 200_000, salts: int = 32, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, its url and ``text``, the main text of the whole page.

    A null or empty page, or one without text, has an empty text. Pages with a null url, or without ``://``, share the host "". Of containers that hold the same, the
    smallest hash counts. Repeated rows give repeated results and can't make a text fixed that differs elsewhere; an empty table gives an empty one. Very long pages are read
    whole, in linear time. Other columns aren't read, so their names can't clash.

    Up to ``most_broadcast`` hosts, if their decisions are small, those are broadcast and pages aren't shuffled. Beyond, pages are joined with them by host
    and one of ``salts``, so that a hot host is split.
    """
    found = cut(decisions(wrappers(pages, url_col=url_col, html_col=html_col)))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html"))
    known: dict[str, str] | None = None
    if fits(found, most_broadcast, "host", "decision"):
        known = {r["host"]: r["decision"] for r in found.collect()}
        rows = rows.withColumn("decision", F.lit(None).cast("string"))
    else:
        salted = found.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(salts)])))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(salts)).cast("int")).join(salted, ["host", "salt"], "left").select("id", "url", "host", "html", "decision")
    shared = pages.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_hosts: dict[str, dict] = {}
        for batch in batches:
            out = []
            for host, page, own in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                host = host.as_py()
                if host not in known_hosts:
                    if len(known_hosts) > 10_000:
                        known_hosts.clear()
                    text = own.as_py() if shared.value is None else shared.value.get(host)
                    known_hosts[host] = json.loads(text) if text else {}
                out.append(main_text(page.as_py(), known_hosts[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["id", "url", "text"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string")
