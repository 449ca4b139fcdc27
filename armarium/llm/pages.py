"""Main text of web pages by tag-path ratios.

A page's text nodes are gathered by their path of tags from the root. Text length and punctuation per path,
over the number of its nodes, are smoothed along the page, multiplied and thresholded: long, punctuated paths
are content. The containers of content paths give the article; parts that their tag, class, id or role names
as something else are left out of it. A name may also be that of a layout: a part that outweighs what is
outside of all such parts stays.
"""
from __future__ import annotations

import heapq
import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: kinds of elements, as the HTML standard has them -------------------------------
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|xmp|noembed|noframes"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSED_BY_SELF = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Elements, words of class or id, and roles that are not the article.
OTHER_TAGS = frozenset("head nav header footer aside form button dialog menu svg canvas select".split())
OTHER_NAMES = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu "
                        "modal nav navbar navigation newsletter notice notices pagination popup promo promoted promotion recommended related search share sharing sidebar signup social "
                        "sponsor sponsored subscribe toolbar widget".split())
#: Those that are so at any size; the others may name a layout around the article.
FIRM_TAGS = OTHER_TAGS - {"header", "form", "dialog"}
FIRM_NAMES = frozenset("comment comments disqus recommended related".split())
#: A named part with articles stays beside an article outside of such parts if its own are so many times as long.
OUTWEIGHS = 10
OTHER_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
CONTAINERS = frozenset("article main section div td body html blockquote".split())

#: What a tag may begin with: a comment, an element whose content is raw, an end or start tag, a declaration.
BEGIN = re.compile(rf"<(?:(!--)|({RAW})(?=[\s/>])|(/?)([a-zA-Z][^\s/>]*)|([!?/]))", re.I)
STOP = re.compile("[\"'>]")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKS = re.compile(r"[.,;:!?…。、，！？]")
#: Width of the smoothing in nodes, and the share of the mean that a content path reaches.
SMOOTH, SHARE = 1.0, 0.5


#: A word before a name that tells of a layout around the article, and words that make a header the site's.
LAYOUT_WORDS = frozenset("no with has without hide".split())
SITE_WORDS = frozenset("site page top main global".split())


def named_as(names: str) -> set[str]:
    """The words that classes and ids name an element by: the leading and the last word of each. Not the last
    word after one that tells of a layout, and a header only if it leads or is that of the site."""
    out = set()
    for name in names.lower().split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if words and words[0] not in LAYOUT_WORDS:
            out.add(words[0])
            if len(words) > 1 and words[-2] not in LAYOUT_WORDS and (words[-1] != "header" or words[0] in SITE_WORDS):
                out.add(words[-1])
    return out


def other(tag: str, attributes: str, in_article: bool = False) -> int:
    """2 for an element that is not the article at any size, 1 for one that is named as something else, 0 for
    any other. The header of an article is part of it."""
    if tag in FIRM_TAGS:
        return 2
    named = int(tag in OTHER_TAGS and not (tag == "header" and in_article))
    if not attributes.strip() or tag in ("html", "body", "article", "main"):
        return named
    a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I) or role in OTHER_ROLES - {"form", "dialog"}:
        return 2
    names = named_as(f"{a.get('class', '')} {a.get('id', '')}")
    if in_article:
        names.discard("header")
    return 2 if not FIRM_NAMES.isdisjoint(names) else int(bool(named or role in OTHER_ROLES or not OTHER_NAMES.isdisjoint(names)))


def tokens(page: str) -> Iterator[tuple[str, bool, str]]:
    """``(tag, whether it ends, attributes)`` of tags in order, and ``("", False, text)`` of the text between.

    Every character is looked at a bounded number of times: what is not found once (a closing quote, a mark, an
    end tag) is not looked for again. A quote that is never closed is a character like any other."""
    missing: set[str] = set()

    def find(what: str, at: int) -> int:
        if what in missing:
            return -1
        i = page.find(what, at)
        if i < 0:
            missing.add(what)
        return i

    def tag_end(at: int) -> int:
        while (m := STOP.search(page, at)) and m[0] != ">":
            i = find(m[0], m.end())
            at = m.end() if i < 0 else i + 1
        return m.start() if m else -1

    at = text = 0
    no_end = False  # no tag ends any more
    while (m := BEGIN.search(page, at)):
        raw, end, tag = (m[2] or "").lower(), bool(m[3]), (m[4] or "").lower()
        if m[1]:
            i = find("-->", m.end())
            stop = len(page) if i < 0 else i + 3
        elif no_end:
            break
        elif m[5]:
            i = find(">", m.end())
            stop = i + 1
        else:
            i = tag_end(m.end())
            stop = i + 1
        if stop <= 0:  # a mark without an end is text; without quotes there is none after it either
            no_end = no_end or ">" in missing or not (raw or tag) or find(">", m.end()) < 0
            at = m.end()
            continue
        if m.start() > text:
            yield "", False, page[text:m.start()]
        if raw:
            closing = None if raw in missing else re.compile(rf"</{raw}\s*>", re.I).search(page, stop)
            if closing is None:
                missing.add(raw)
            stop = closing.end() if closing else len(page)
        elif tag:
            yield tag, end, page[m.end():stop - 1]
        at = text = stop
    if text < len(page):
        yield "", False, page[text:]


class Page:
    """Text nodes of a page with the paths of their elements. A path is a number; what is asked of a path is
    known from its parent's when it is first met, so that depth costs nothing."""

    def __init__(self, page: str) -> None:
        self.paths: dict[tuple[int, str], int] = {}
        self.parent, self.article, self.main, self.inner = [-1], [-1], [-1], [-1]  # of path 0, the root
        self.texts: list[tuple[int, int, str, int, bool]] = []  # path, block, text, innermost named part or -1, in a heading of the first level
        self.part_of: list[int] = []  # the named part around each named part
        self._read(page)

    def step(self, path: int, tag: str, step: str) -> int:
        new = self.paths.setdefault((path, step), len(self.parent))
        if new == len(self.parent):
            self.parent.append(path)
            self.article.append(self.article[path] if self.article[path] >= 0 or tag != "article" else new)
            self.main.append(self.main[path] if self.main[path] >= 0 or tag != "main" else new)
            self.inner.append(new if tag in CONTAINERS else self.inner[path])
        return new

    def _read(self, page: str) -> None:
        """A block ends where an element of a block kind starts or ends. Tags may be left open or be closed
        twice, as on real pages."""
        stack: list[tuple[str, int, int, bool, bool, bool]] = []  # tag, path, named part, left out, in an article, in a heading
        places: dict[str, list[int]] = {}
        block = 0

        def close(tags: tuple[str, ...], within: str = "") -> None:
            at = max((places[t][-1] for t in tags if places.get(t)), default=-1)
            if at < 0 or any(places[w][-1] > at for w in within.split() if places.get(w)):
                return
            while len(stack) > at:
                places[stack.pop()[0]].pop()

        for tag, end, rest in tokens(page):
            if not tag or tag == "br":
                _, path, part, out, _, heading = stack[-1] if stack else ("", 0, -1, False, False, False)
                if not out:
                    self.texts.append((path, block, " " if tag else rest, part, heading))
                continue
            block += tag in BLOCK
            if end:
                close((tag,))
                continue
            if tag in BLOCK and tag not in ("option", "optgroup"):
                close(("svg",), "foreignobject")  # as the standard has it: a block breaks out of an open drawing
                close(("p",), "table td th button article section div li canvas object foreignobject")
            if tag in CLOSED_BY_SELF:
                close(("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), CLOSED_BY_SELF[tag])
            if tag in VOID or rest.rstrip().endswith("/"):
                continue
            if tag == "body":
                close(("head",))
            _, path, part, out, in_article, heading = stack[-1] if stack else ("", 0, -1, False, False, False)
            kind = 0 if out else other(tag, rest, in_article)
            if kind == 1:
                self.part_of.append(part)
                part = len(self.part_of) - 1
            name = re.search(r"class\s*=\s*[\"']?([^\"'>]*)", rest)
            path = path if out or kind == 2 else self.step(path, tag, f"{tag}.{name[1]}" if name else tag)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, path, part, out or kind == 2, in_article or tag in ("article", "main"), heading or tag == "h1"))

    def staying_parts(self) -> list[bool]:
        """Which named parts outweigh what is outside of all such parts: with most of the text (an article in
        them counts twice) where no article is outside, else with OUTWEIGHS times its length. A part that stays
        is outside from then on, and the parts in it are weighed in turn."""
        n = len(self.part_of)
        direct, whole = np.zeros((n + 1, 2), np.int64), np.zeros((n + 1, 2), np.int64)  # text, and text of articles; the last row is outside
        for path, _, text, part, _ in self.texts:
            size = len(text.strip())
            direct[part] += size, size * (self.article[path] >= 0 or self.main[path] >= 0)
        whole[:] = direct
        inside: list[list[int]] = [[] for _ in range(n + 1)]
        for e in range(n - 1, -1, -1):
            whole[self.part_of[e]] += whole[e]
            inside[self.part_of[e]].append(e)
        out = direct[-1].tolist()
        stay, set_aside = [False] * n, []
        waiting = [(-int(whole[e, 1]), -int(whole[e, 0]), e) for e in inside[-1]]
        heapq.heapify(waiting)
        while waiting:
            own, size, e = heapq.heappop(waiting)
            if not (-own > OUTWEIGHS * out[1] if out[1] else -size - own > out[0]):
                set_aside.append((own, size, e))
                continue
            had = out[1] > 0
            stay[e] = True
            out = [out[0] + int(direct[e, 0]), out[1] + int(direct[e, 1])]
            for c in inside[e]:
                heapq.heappush(waiting, (-int(whole[c, 1]), -int(whole[c, 0]), c))
            if not had and out[1]:  # the other measure holds from now on
                for x in set_aside:
                    heapq.heappush(waiting, x)
                set_aside = []
        return stay

    def nodes(self) -> list[tuple[int, int, str, bool]]:
        """``(path, block, text, heading)`` of the text nodes whose named parts all stay."""
        stay = self.staying_parts()
        fine = [True] * (len(stay) + 1)
        for e, around in enumerate(self.part_of):
            fine[e] = stay[e] and fine[around]
        return [(path, block, text, heading) for path, block, text, part, heading in self.texts if fine[part]]

    def home(self, path: int) -> int:
        """The path up to its article, or else up to its innermost container."""
        return self.article[path] if self.article[path] >= 0 else self.main[path] if self.main[path] >= 0 else max(self.inner[path], 0)


def content_paths(found: list[tuple[int, int, str, bool]]) -> set[int]:
    """Paths whose fused ratio reaches SHARE of the mean over all nodes."""
    sums: dict[int, list[int]] = {}
    for path, _, text, _ in found:
        s = sums.setdefault(path, [0, 0, 0])
        s[0] += len(text.strip())
        s[1] += len(MARKS.findall(text))
        s[2] += bool(text.strip())
    order = [path for path, _, text, _ in found if text.strip()]
    if not order:
        return set()
    ratio = np.array([[sums[p][0] / sums[p][2], (1 + sums[p][1]) / sums[p][2]] for p in order])
    reach = np.arange(-3, 4)
    bell = np.exp(-(reach / SMOOTH) ** 2 / 2)
    weight = np.convolve(np.ones(len(order)), bell, "full")[3:3 + len(order)]
    smooth = np.stack([np.convolve(ratio[:, i], bell, "full")[3:3 + len(order)] / weight for i in (0, 1)], axis=1)
    fused = smooth.prod(axis=1)
    by_path: dict[int, list[float]] = {}
    for p, v in zip(order, fused):
        by_path.setdefault(p, []).append(v)
    limit = SHARE * fused.mean()
    return {p for p, v in by_path.items() if np.mean(v) >= limit}


def main_text(page: str) -> str:
    """The article's blocks in page order, one a line; character references decoded, white space of a block
    as one space. Empty where no text is left. Time grows in proportion to the page, however it is nested; of a
    title outside the article's container the first is taken."""
    tree = Page(page)
    found = tree.nodes()
    homes = {tree.home(p) for p in content_paths(found)}
    if any(tree.article[h] >= 0 for h in homes):
        homes = {h for h in homes if tree.article[h] >= 0}
    under = [0 in homes]
    for p in range(1, len(tree.parent)):
        under.append(p in homes or under[tree.parent[p]])
    kept = [under[path] for path, _, _, _ in found]
    if any(kept) and not any(k and heading for k, (_, _, _, heading) in zip(kept, found)):
        title = next((block for (_, block, text, heading) in found[:kept.index(True)] if heading and text.strip()), None)
        kept = [k or (heading and block == title) for k, (_, block, _, heading) in zip(kept, found)]
    blocks: dict[int, list[str]] = {}
    for k, (_, block, text, _) in zip(kept, found):
        if k:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join(references.unescape("".join(b)).split()) for b in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` of every row in its place; a null page is empty and gives empty text. No
    rows give no rows; a page of any length and depth takes time in proportion to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([main_text(x.as_py()) for x in b.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), texts], names=["key", "url", "text"])

    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    out = rows.mapInArrow(run, f"key {pages.schema[key].dataType.simpleString()}, url string, text string")
    return out.select(F.col("key").alias(key), "url", "text", F.length("text").cast("bigint").alias("n_chars"))
