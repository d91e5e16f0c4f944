"""Main text of web pages by tree scoring.

Paragraphs earn points for their length and commas and pass them to their ancestors, less
with each level; a container loses the share of its text that is links.  The text is that
of the best container and of those siblings that look like its continuation.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser, tagfind_tolerant

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

# Elements by role.
SKIPPED = frozenset("aside button datalist dialog fieldset footer head iframe menu nav noscript object option script select style svg template textarea title".split())
#: Noise, unless they turn out to hold the text.
WEIGHED = frozenset(["form", "header"])
WHOLE = frozenset(["article", "main"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = WEIGHED | frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre li dd dt td th blockquote figcaption caption address".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD, P = frozenset(["head"]), frozenset(["p"])
IN_HEAD = frozenset("base link meta noscript script style template title".split())
FOREIGN, CHOICES = frozenset(["svg", "math"]), frozenset(["select", "datalist"])
#: What stands in these is apart from what is around them.
ISLANDS = frozenset(["foreignobject", "template", "object"])
P_LIMIT = ISLANDS | frozenset("button table td th caption".split())
ENDS_P = frozenset("aside dialog fieldset footer menu nav".split())
LISTS = frozenset("ul ol menu".split())
_APART = ISLANDS | frozenset("aside dialog footer form header nav table".split())
_ROWS = frozenset("table template".split())
#: A start tag of these ends an open element of the second set, up to the third.
CLOSES = {
    "a": (frozenset(["a"]), _APART | frozenset(["td", "th"])),
    "li": (frozenset(["li"]), _APART | LISTS),
    "dt": (frozenset(["dt", "dd"]), _APART | frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), _APART | frozenset(["dl"])),
    "tbody": (frozenset("caption tbody thead tfoot".split()), _ROWS),
    "thead": (frozenset("caption tbody thead tfoot".split()), _ROWS),
    "tfoot": (frozenset("caption tbody thead tfoot".split()), _ROWS),
    "tr": (frozenset(["tr", "caption"]), _ROWS | frozenset(["tbody", "thead", "tfoot"])),
    "td": (frozenset(["td", "th"]), _ROWS | frozenset(["tr"])),
    "th": (frozenset(["td", "th"]), _ROWS | frozenset(["tr"])),
    "option": (frozenset(["option"]), _APART | CHOICES),
}
#: Names of noise anywhere, and such as are noise only outside an article.
_ANYWHERE = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|side-?bar|comments?|disqus|respond|replies|"
    r"nav|navbar|navigation|menu|breadcrumbs?|pager|pagination|footer|masthead|site-?header|toolbar|share|sharing|social|related|recommended|"
    r"newsletter|subscribe|signup|login|search|skip|outbrain|taboola|hidden"
)
_OUTSIDE = r"banner|notices?|alerts?|overlay|widgets?|reviews?|foot|page-?header|toc|tags|meta|byline-links"
NOISE = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE}|{_OUTSIDE})(?:$|[\s_-])", re.I)
NOISE_WITHIN = re.compile(rf"(?:^|[\s_-])(?:{_ANYWHERE})(?:$|[\s_-])", re.I)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ROLES_WITHIN = ROLES - {"alert", "form"}
CONTENT = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|post|story|text)(?:$|[\s_-])", re.I)


#: Levels of ancestors that a paragraph passes points to.
LEVELS = 12
#: A page's noise is weighed anew at most so often; nested noise beyond stays noise.
WEIGHINGS = 64
_LONG_NUMBER = re.compile(r"&#([0-9]{9,})")


class _Page(HTMLParser):
    """Elements with their parents, skipped ones too, and the blocks of text.

    Elements of blocks all have a node; inline ones only if they are skipped or named like
    noise, or stand in an open element of the same name, which their end tag must not close.
    No markup is an error: what is no tag is a comment up to the next ``>``, and what never
    ends is a comment or a tag up to the end of the page.

    Depths of open elements are kept by name, so that a tag costs no walk up the page.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea", "iframe")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.liked = ["html"], [-1], [0.0]
        self.skipped, self.noisy, self.links_before = [False], [False], [0]
        self.holders, self.within = [0], [False]  # the block that an element's text belongs to; whether an article holds it
        self.open = [0]
        self.depths: dict[str, list[int]] = {}
        self.links = 0
        self.run: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.blocks: list[tuple[int, list[tuple[int, str, int]]]] = []

    # -- markup that the standard parser takes for text or refuses

    def _to_sign(self, i):
        """After the next ``>``, or at the end of the page."""
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def parse_html_declaration(self, i):
        return self.parse_comment(i) if self.rawdata.startswith("<!--", i) else self._to_sign(i)

    def parse_comment(self, i, report=1):
        empty = re.compile(r"<!---?>").match(self.rawdata, i)
        if empty:
            return empty.end()
        end = re.compile(r"--!?>").search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_pi(self, i):
        return self._to_sign(i)

    def parse_endtag(self, i):
        return super().parse_endtag(i) if self.rawdata.find(">", i) >= 0 else len(self.rawdata)

    def parse_starttag(self, i):
        end = self.check_for_whole_start_tag(i)
        if end > 0 and self.rawdata[end - 1] == ">":
            return super().parse_starttag(i)
        end = self._to_sign(i)
        if self.rawdata[end - 1] == ">":  # a quote left open, or a stray slash
            tag = tagfind_tolerant.match(self.rawdata, i + 1).group(1).lower()
            self.handle_starttag(tag, [])
            if tag in self.CDATA_CONTENT_ELEMENTS:
                self.set_cdata_mode(tag)
        return end

    # -- elements

    def flush(self):
        if self.run:
            self.blocks.append((self.holders[self.open[-1]], self.run))
            self.run = []

    def depth_of(self, tags):
        """Depth of the innermost open element of a set; 0 if there is none."""
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def close(self, depth=None):
        """End the open elements from a depth on; without one, the end of the page."""
        if depth is None:
            super().close()
            return
        while len(self.open) > depth:
            element = self.open.pop()
            self.depths[self.tags[element]].pop()
            if self.skipped[element] or self.noisy[element]:
                self.links = self.links_before[element]  # a link left open there ends there

    def end(self, ended, limit=frozenset()):
        """End the innermost open element of a set, with all in it, unless one of the limits stands in between."""
        depth = self.depth_of(ended)
        if depth and depth > self.depth_of(limit):
            self.close(depth)

    def imply_ends(self, tag):
        top = self.tags[self.open[-1]]
        if tag == "body":
            self.end(HEAD)
        elif top == "head" and tag not in IN_HEAD:
            self.close(len(self.open) - 1)
        if tag in BLOCKS:
            self.end(FOREIGN, ISLANDS)
            self.end(CHOICES, ISLANDS)
        if tag in BLOCKS or tag in ENDS_P:
            self.end(P, P_LIMIT)
        if tag in HEADINGS and self.tags[self.open[-1]] in HEADINGS:
            self.close(len(self.open) - 1)
        if tag in CLOSES:
            self.end(*CLOSES[tag])

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.run.append((self.open[-1], " ", 0))
            return
        own = dict(attrs)
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            self.flush()
        if block or tag in CLOSES or tag == "a" or self.tags[self.open[-1]] == "head":
            self.imply_ends(tag)
        within = self.within[self.open[-1]]
        names = f"{own.get('class') or ''} {own.get('id') or ''}"
        noise = NOISE_WITHIN if within else NOISE
        skipped = tag in SKIPPED or own.get("role") in (ROLES_WITHIN if within else ROLES) or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in (own.get("style") or "").replace(" ", "")
        noisy = not skipped and tag not in ("html", "body", "article", "main") and bool(noise.search(own.get("class") or "") or noise.search(own.get("id") or ""))
        # a content name beside the noise name, as in "post no-sidebar", not within it, as in "post-share"
        noisy = noisy and not any(CONTENT.search(name) and not noise.search(name) for name in names.split())
        # the header of an article is its own
        noisy = noisy or not skipped and (tag == "form" or tag == "header" and not within)
        before = self.links
        if tag == "a":
            self.links = 1
        if tag in VOID or not (block or skipped or noisy or tag in ISLANDS or self.depths.get(tag)):
            return
        element = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.liked.append(10.0 if tag in WHOLE or tag in BLOCKS and CONTENT.search(names) else 0.0)
        self.skipped.append(skipped)
        self.noisy.append(noisy)
        self.links_before.append(before)
        self.holders.append(element if block else self.holders[self.open[-1]])
        self.within.append(within or tag in WHOLE)
        self.depths.setdefault(tag, []).append(len(self.open))
        self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        # a slash closes an element of drawings and formulas only
        n = len(self.tags)
        self.handle_starttag(tag, attrs)
        if len(self.tags) > n and self.depth_of(FOREIGN):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        block = tag in BLOCKS or tag in SKIPPED
        if block:
            self.flush()
        if tag == "a":
            self.links = 0
        self.end(HEADINGS if tag in HEADINGS else frozenset([tag]), LISTS if tag == "li" else frozenset())

    def handle_data(self, data):
        if self.tags[self.open[-1]] == "head" and data.strip():
            self.close(len(self.open) - 1)
        self.run.append((self.open[-1], data, len(data.strip()) if self.links else 0))


def _points(text: str) -> float:
    return min(len(text) / 100, 3.0) + (1 + text.count(",") if len(text) >= 25 else 0)


def _blocks(page: _Page, gone: list[bool]) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of the blocks outside the elements that are gone."""
    out = []
    for element, run in page.blocks:
        if not gone[element]:
            text = " ".join("".join(t for k, t, _ in run if not gone[k]).split())
            if text:
                out.append((element, text, min(sum(n for k, _, n in run if not gone[k]), len(text))))
    return out


def _inherited(page: _Page, marked: list[bool]) -> list[bool]:
    gone = list(marked)
    for k in range(1, len(gone)):
        gone[k] = gone[k] or gone[page.parents[k]]
    return gone


def _gone(page: _Page) -> list[bool]:
    """Elements that are skipped, or noise by their name, with all they hold.

    A noise name loses if an article or main element lies within and none outside all noise,
    where elements named like content have less than a quarter of the page's points; where
    there is nothing of either kind, also if most of the points lie within and less than a
    quarter outside all noise.  The elements with the most points are first to win, so
    comments and related articles stay out where the text itself is outside.  With a winner
    wins what holds three quarters of its points and all elements in it that are named like
    content.
    """
    hard = _inherited(page, page.skipped)
    if not any(page.noisy):
        return hard
    n = len(page.tags)
    points, holds = [0.0] * n, [False] * n
    for element, text, _ in _blocks(page, hard):
        points[element] += _points(text)
    own = list(points)
    named_in = [int(page.liked[k] > 0 and not hard[k]) for k in range(n)]
    whole = [page.tags[k] in ("article", "main") and not hard[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        points[page.parents[k]] += points[k]
        named_in[page.parents[k]] += named_in[k] if points[k] else 0
        whole[k] = whole[k] and points[k] > 0
        holds[k] = holds[k] or whole[k]
        holds[page.parents[k]] = holds[page.parents[k]] or holds[k]
    noisy = list(page.noisy)
    for _ in range(WEIGHINGS):
        gone = _inherited(page, [a or b for a, b in zip(page.skipped, noisy)])
        outer = [k for k in range(1, n) if noisy[k] and not hard[k] and not gone[page.parents[k]]]
        if any(whole[k] and not gone[k] for k in range(n)):
            return gone
        alive = [0.0 if gone[k] else own[k] for k in range(n)]
        for k in range(n - 1, 0, -1):
            alive[page.parents[k]] += alive[k]
        named = max((alive[k] for k in range(1, n) if page.liked[k] and page.tags[k] != "body"), default=0.0)
        inside = [k for k in outer if holds[k]] if 4 * named < points[0] else []
        if not inside and not named:
            inside = [k for k in outer if 2 * points[k] > points[0] > 4 * alive[0]]
        if not inside:
            return gone
        first = max(inside, key=lambda k: points[k])
        wrapped = {first}
        for k in range(first + 1, n):
            if page.parents[k] in wrapped and 4 * points[k] >= 3 * points[first] and named_in[k] == named_in[first]:
                wrapped.add(k)
        for k in wrapped:
            noisy[k] = False
    return gone


def main_text(html: str | None) -> str:
    """Blocks of the main text, each with single spaces, joined by a line feed; empty if there is none."""
    if not html or not html.strip():
        return ""
    page = _Page()
    # beyond nine digits a character reference is no character
    page.feed(_LONG_NUMBER.sub(lambda m: f"&#{m[1].lstrip('0')[:9] or 0}", html))
    page.close()
    page.flush()
    blocks = _blocks(page, _gone(page))
    n = len(page.tags)
    score, size, links = list(page.liked), [0] * n, [0] * n
    earned = [0.0] * n
    for element, text, linked in blocks:
        points = _points(text)
        up = page.parents[element] if page.tags[element] in PARAGRAPHS and element else element
        for level in range(LEVELS):
            if up < 0:
                break
            earned[up] += points * (1.0, 0.5)[level] if level < 2 else points / (3 * level)
            up = page.parents[up]
        size[element] += len(text)
        links[element] += linked
    for k in range(n - 1, 0, -1):
        size[page.parents[k]] += size[k]
        links[page.parents[k]] += links[k]
    for k in range(n):
        score[k] = (earned[k] + (score[k] if earned[k] else 0)) * (1 - links[k] / size[k] if size[k] else 1)
    candidates = [k for k in range(n) if size[k] and page.tags[k] not in PARAGRAPHS]
    if not candidates:
        return ""
    best = max(candidates, key=lambda k: (score[k], k))
    # all that an article element holds belongs to it, its headline too
    whole = "article" if "article" in page.tags else "main"
    up = best
    while up >= 0 and page.tags[up] != whole:
        up = page.parents[up]
    best = up if up >= 0 else best
    chosen = {best}
    beside = [k for k in range(n) if page.parents[k] == page.parents[best] and best and size[k]]
    for k in beside:
        if k != best:
            likely = score[k] >= max(10.0, 0.2 * score[best]) and page.tags[k] not in ("ul", "ol")
            if links[k] / size[k] < 0.25 and (likely or page.tags[k] in ("p", "pre", "blockquote", "hgroup", *HEADINGS)):
                chosen.add(k)
    # a plain line between two that are chosen, such as a lead in a div, is one with them
    ends = [at for at, k in enumerate(beside) if k in chosen]
    leaves = {element for element, _, _ in blocks} - {page.parents[element] for element, _, _ in blocks}
    chosen.update(k for k in beside[min(ends) : max(ends)] if k in leaves and page.tags[k] == "div" and links[k] / size[k] < 0.25) if ends else None
    inside = [k in chosen for k in range(n)]
    for k in range(1, n):
        inside[k] = inside[k] or inside[page.parents[k]]
    # entries that are links are a menu, but in an article its sources
    menu = lambda k, text, linked: linked > 0.6 * len(text) and page.tags[k] in ("li", "div", "td", "dd") and not page.within[k]
    return "\n".join(text for k, text, linked in blocks if inside[k] and not menu(k, text, linked))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points).

    * Null, empty and textless pages give an empty text.  No markup is an error.
    * Of containers with equal scores the last one is taken, which is the innermost.
    * Long and deep pages take time in proportion to their length.
    * Repeated rows each get a row; an empty table gives an empty result; other columns are
      ignored, whatever their names.
    """

    @pandas_udf("string")
    def text_of_page(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    rows = pages.select(F.col(id_col), F.col(url_col), text_of_page(F.col(html_col).cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))
