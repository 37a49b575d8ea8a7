"""Main text of web pages by line-block distribution.

Markup is stripped to lines (one per block element). Page furniture is taken out and text in links
weighs nothing. The weights of the lines are summed over a sliding window; where the sum surges
from nothing a stretch begins, where it dives to nothing it ends, and the lines between are kept if
their weight is at least half of their length. No length of another stretch matters. In what a page
names as its article (``article``, ``main``) links weigh a third and furniture leaves no gap; what
lies outside is judged like any page.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from .common import map_rows, pick

_RAW = set(
    "script style template noscript textarea svg math iframe object title".split()
)
_NAME = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_SPECIAL = re.compile(r"[>\"']")
_NUMBER = re.compile(r"&#([0-9]{8,});?")
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu "
    "meta nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_FURNITURE = set(
    "aside button datalist dialog footer form head header menu nav select".split()
)
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|"
    r"notices?|notification|alert|popup|modal|overlay|sidebars?|side|nav\w*|menus?|breadcrumbs?|"
    r"foot(?:er)?|masthead|header|comments?|disqus|respond|replies|share|sharing|social|"
    r"related|recommend\w*|newsletter|subscribe|signup|login|search|form|widget|toolbar|"
    r"pagination|pager|copyright|skip|hidden)(?:$|[\s_-])",
    re.I,
)
_CERTAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|sidebars?|nav\w*|menus?|"
    r"breadcrumbs?|foot(?:er)?|masthead|comments?|disqus|respond|replies|newsletter|hidden)(?:$|[\s_-])",
    re.I,
)  # names that say it beyond doubt
_READERS = re.compile(r"comment|repl(?:y|ies)|advert|promo|sponsor", re.I)
_LAYOUT = re.compile(r"(?:has|with|no|without)[-_]", re.I)  # says what else the page has
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_ATTR = re.compile(r"""(?<![\w:-])([\w:-]++)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_ROLES = set(
    "navigation banner contentinfo complementary search form dialog alert menu menubar toolbar "
    "alertdialog".split()
)

WINDOW = 3  # lines that a block spans
NAMED = 1 / 3  # weight of links in what the page names as its article


def _is_furniture(tag: str, attrs: str, names: re.Pattern = _NAMED) -> bool:
    if tag in _FURNITURE:
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    named = _READERS if tag == "article" else names
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            if any(named.search(x) and not _LAYOUT.match(x) for x in value.split()):
                return True
        if name == "role" and value.strip().lower() in _ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _QUOTED.sub("", attrs), re.I))


class _Scanner:
    """Where tags end, in time linear in the page, however many are never closed.

    A tag ends at the first ``>`` outside quotes. The quotes that a failed search passed are kept:
    a later search that reaches one of them from outside quotes fails as well.
    """

    def __init__(self, page: str):
        self.page = page
        self.marks = [m.start() for m in _SPECIAL.finditer(page)]
        self.failed: set[int] = set()

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose attributes begin at ``at``; -1 without."""
        i, passed = bisect_left(self.marks, at), []
        while i < len(self.marks):
            x = self.marks[i]
            if self.page[x] == ">":
                return x
            if x in self.failed:
                break
            passed.append(x)
            x = self.page.find(self.page[x], x + 1)
            if x < 0:
                break
            i = bisect_left(self.marks, x + 1)
        self.failed.update(passed)
        return -1


def _tags(page: str) -> list[tuple[int, int, str, bool, str]]:
    """(start, end, tag, closing, attributes) of each piece of markup; '' for what has no tag.

    What is never closed is text, but for comments and elements whose content is no markup: those
    reach to the end of the page.
    """
    out, scan, last, at = [], _Scanner(page), page.rfind(">"), page.find("<")
    size = len(page)
    while at >= 0:
        end, tag, closing, attrs = -1, "", False, ""
        for begin, close in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(begin, at):
                end = page.find(close, at + len(begin))
                end = end + 3 if end >= 0 else size
        if end < 0 and (m := _NAME.match(page, at)):
            if (stop := scan.end(m.end())) >= 0:
                end, tag, closing, attrs = stop + 1, m[2].lower(), bool(m[1]), page[m.end() : stop]
                if tag in _RAW and not closing:
                    # its content and closing tag belong to it
                    after = re.compile(rf"</{tag}\s*+>", re.I).search(page, end)
                    end, tag = after.end() if after else size, ""
        if end < 0 and at < last and page[at + 1] in "!?/":
            end = page.find(">", at + 2) + 1 or -1
        if end < 0:
            at = page.find("<", at + 1)
            continue
        out.append((at, end, tag, closing, attrs))
        at = page.find("<", end)
    return out


def _enclosed(spans: dict[int, int], by: dict[int, int]) -> set[int]:
    """The starts of those spans that lie within one of the others."""
    found, outer, far, i = set(), sorted(by.items()), -1, 0
    for a, b in sorted(spans.items()):
        while i < len(outer) and outer[i][0] < a:
            far = max(far, outer[i][1])
            i += 1
        if b < far:
            found.add(a)
    return found


def _enclosing(spans: dict[int, int], others: dict[int, int]) -> set[int]:
    """The starts of those spans that hold one of the others."""
    found, inner, near = set(), sorted(others.items(), reverse=True), float("inf")
    i = 0
    for a, b in sorted(spans.items(), reverse=True):
        while i < len(inner) and inner[i][0] > a:
            near = min(near, inner[i][1])
            i += 1
        if near < b:
            found.add(a)
    return found


def _unescaped(text: str) -> str:
    # numbers of more digits than a character can have
    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0")
        return f"&#{digits or 0};" if len(digits) < 8 else "\ufffd"

    return html.unescape(_NUMBER.sub(short, text))


def _spans(tags: list, opens: list[int]) -> dict[int, int]:
    """For the openings asked for, the index of the closing tag; those never closed are left out."""
    wanted, stacks, found = set(opens), {}, {}
    for i, (_, _, tag, closing, attrs) in enumerate(tags):
        if not tag or tag in _VOID or attrs.endswith("/"):
            continue
        if not closing:
            stacks.setdefault(tag, []).append(i)
        elif stacks.get(tag):
            j = stacks[tag].pop()
            if j in wanted:
                found[j] = i
    return found


def lines_of(page: str, names: re.Pattern = _NAMED) -> list[tuple[str, int, int, bool]]:
    """Lines of (text, length without links, length of links, whether the page names it as article).

    Furniture has neither text nor lengths.
    """
    tags = _tags(page)
    furniture = [i for i, t in enumerate(tags) if t[2] and not t[3] and _is_furniture(t[2], t[4], names)]
    article = [
        i
        for i, t in enumerate(tags)
        if not t[3] and (t[2] in ("article", "main") or re.search(r"role\s*=\s*[\"']?main\b", t[4]))
    ]
    drop, keep = _spans(tags, furniture), _spans(tags, article)
    inside = _enclosed(keep, drop)
    keep = {a: b for a, b in keep.items() if a not in drop and (tags[a][2] != "article" or a not in inside)}
    around = _enclosing(drop, keep)
    drop = {a: b for a, b in drop.items() if a not in around}
    lines: list[tuple[str, int, int, bool]] = []
    parts: list[str] = []
    links = at = 0
    in_link = False
    dropped = -1
    deep = 0
    ends = set()
    gap = [("", 0, 0, False)]

    def end_line():
        nonlocal parts, links
        if parts:
            text = " ".join(_unescaped("".join(parts)).split())
            if text:
                linked = min(links, len(text))
                lines.append((text, len(text) - linked, linked, deep > 0))
        parts, links = [], 0

    def take(raw: str):
        nonlocal links
        if raw:
            parts.append(raw)
            if in_link:
                links += len(raw.strip())

    for i, (start, end, tag, closing, attrs) in enumerate(tags):
        if dropped < 0:
            take(page[at:start])
        at = end
        if dropped >= 0:
            if i == dropped:
                dropped = -1
                if not deep:
                    lines.extend(gap)
            continue
        if tag == "a":
            in_link = not closing
        if tag in _BLOCK or i in drop or i in keep or i in ends:
            end_line()
        if i in drop:
            dropped = drop[i]
            if not deep:
                lines.extend(gap * WINDOW)
        elif i in keep:
            deep += 1
            ends.add(keep[i])
        elif i in ends:
            deep -= 1
    if dropped < 0:
        take(page[at:])
    end_line()
    return lines


def main_text(page: str | None) -> str:
    """The kept lines, joined by one space; empty for a null or empty page.

    Where the names of a page leave nothing, only those that tell beyond doubt count.
    """
    return _kept(lines_of(page or "")) or _kept(lines_of(page or "", _CERTAIN))


def _kept(lines: list[tuple[str, int, int, bool]]) -> str:
    n = len(lines)
    # what the page names as its article weighs more: its links count in part
    weights = [own + NAMED * linked if named else own for _, own, linked, named in lines]
    blocks = [sum(weights[i : i + WINDOW]) for i in range(n)]
    kept: list[str] = []
    i = 0
    while i < n:
        if not blocks[i]:
            i += 1
            continue
        j = i
        while j < n and blocks[j]:
            j += 1  # the dive: a whole window without text
        end = min(n, j + WINDOW - 1)
        if 2 * sum(weights[i:end]) >= sum(own + linked for _, own, linked, _ in lines[i:end]):
            kept += [line[0] for line in lines[i:end] if line[0]]
        i = end
    return " ".join(kept)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; a null page gives an empty text.

    Null ids and urls, repeated rows and extra columns change nothing; an empty table gives none.
    """

    def run(batch):
        texts = [main_text(p) for p in batch["html"]]
        return {
            "page_id": batch["id"],
            "url": batch["url"],
            "text": texts,
            "n_chars": [len(t) for t in texts],
        }

    return map_rows(
        pick(pages, id=id_col, url=url_col, html=html_col),
        run,
        "page_id bigint, url string, text string, n_chars bigint",
    )
