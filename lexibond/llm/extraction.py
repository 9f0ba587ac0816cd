"""Main text of web pages by two passes over text blocks.

Pass one decides blocks by link density, length and stop-word density; elements and classes that name what surrounds an
article are one more sign, and lose against the density of nearly all the page's text. Pass two gives each block that is
still open the label of its nearest decided neighbour, where nearest is first the one in the innermost common element.
"""

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexibond.llm.common import small_batches
from lexibond.llm.toxicity import LANGUAGES

#: Elements that hold no markup, elements whose text is none of the page's, and elements around the article.
RAW = frozenset("script style title textarea iframe noscript".split())
DROPPED = frozenset("template svg canvas select option button audio video datalist".split())
AROUND = frozenset("nav header footer aside form dialog menu fieldset".split())
INNER = frozenset("b i u s em strong a span font small big sub sup code tt kbd samp var q cite dfn abbr mark ins del time bdi bdo ruby rt rp wbr label img br data acronym strike nobr math mi mo mn msup msub mrow mfrac object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tags are often left out; they part blocks and hold nothing that matters here.
LOOSE = frozenset("p li dt dd tr td th thead tbody tfoot optgroup colgroup html body head".split())
#: Words of class, id and role that mark what surrounds an article, and those for what readers write.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login sidebar widget menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer header masthead "
    "share sharing social related recommended toolbar contentinfo complementary search".split()
)
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Link share from which a block is none of the article, outside and inside an article element; length and stop-word share
#: from which it is; share of the page's text beside links with which an element isn't around the article, whatever its name.
LINKS, LINKS_INSIDE, LONG, STOPS, WRAPS = 0.4, 0.8, 60, 0.15, 0.8
#: Words in a block that is taken for its length, where no stop words are known.
WORDY = 8

_STOP_WORDS = frozenset(w for v in LANGUAGES.values() for w in v.split())
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[<>\"']")
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[^a-z0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    """Text between two tags that part blocks. ``gap``: fewest open elements since the block before."""

    around: int
    inside: bool
    gap: int = 0
    pieces: list = field(default_factory=list)
    linked: int = 0
    text: str = ""
    label: bool | None = None


def marks(attributes: str) -> set[str]:
    """Words of class, id and role."""
    return {p for m in _NAMED.finditer(attributes) for p in _PARTS.split((m[1] or m[2] or m[3] or "").lower())} if "=" in attributes else set()


def tokens(page: str):
    """``text, name, attributes`` of each stretch of text and the tag after it; an end tag's name starts with '/'.

    One forward scan: a quotation mark, comment or tag that is never closed is looked for once.
    """
    at, text, missing, n = 0, 0, set(), len(page)

    def find(what: str, start: int) -> int:
        k = page.find(what, start) if what not in missing else -1
        if k < 0:
            missing.add(what)
        return k

    while (k := page.find("<", at)) >= 0:
        m = _NAME.match(page, k + 1)
        if page.startswith("<!--", k):
            end = find("-->", k + 4)
            yield page[text:k], "", ""
            at = text = end + 3 if end >= 0 else n
            continue
        if not m:
            end = find(">", k) if page[k + 1 : k + 2] in ("!", "?", "/") else -1
            if end >= 0:
                yield page[text:k], "", ""
                at = text = end + 1
            else:
                at = k + 1
            continue
        end = m.end()
        while (s := _STOP.search(page, end)) and s[0] in "\"'":
            close = find(s[0], s.end())
            end = close + 1 if close >= 0 else s.end()
        if s is None:  # never closed: no tag
            at = k + 1
            if ">" not in page[end:]:
                break
            continue
        name, attributes = m[0].lower(), page[m.end() : s.start()]
        yield page[text:k], name, attributes
        at = text = s.end() if s[0] == ">" else s.start()
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\b[^<>]*>?", re.IGNORECASE).search(page, at) if name not in missing else None
            if close is None:
                missing.add(name)
            if close or name in ("script", "style"):
                at = text = close.end() if close else n
    yield page[text:], "", ""


def blocks(page: str) -> tuple[list[Block], list[list]]:
    """The page's blocks in order, empty ones left out; and the elements around articles: outer one, kind, length of text that isn't links.

    ``Block.around`` is the innermost such element's number, or -1. Kinds: 1 by name, 2 readers' comments.
    """
    out: list[Block] = []
    around: list[list] = []
    held: list[tuple[str, int, bool, bool]] = []  # name, element around, inside an article, without text
    opened: Counter = Counter()
    now, links, low = Block(-1, False), 0, 0

    def end() -> None:
        nonlocal now, low
        if not now.pieces:
            return
        now.text = " ".join("".join(now.pieces).split())
        if now.text:
            out.append(now)
            low = len(held)
        now = Block(now.around, now.inside)

    def close(tag: str) -> None:
        nonlocal low
        while opened[tag]:
            last = held.pop()
            opened[last[0]] -= 1
            low = min(low, len(held))
            if last[0] == tag:
                break

    for text, tag, attributes in tokens(page):
        if text and not (held and held[-1][3]):
            text = html.unescape(text)
            if not now.pieces:
                now.gap = low
            now.pieces.append(text)
            if links:
                now.linked += len("".join(text.split()))
        if not tag:
            continue
        closing, tag = tag[0] == "/", tag.lstrip("/")
        if tag in RAW:
            now.pieces.append(" ")
        elif tag in INNER:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif tag == "br":
                now.pieces.append(" ")
        elif tag in DROPPED:
            now.pieces.append(" ")
            if closing:
                close(tag)
            elif not attributes.endswith("/"):
                top = held[-1] if held else ("", -1, False, False)
                held.append((tag, top[1], top[2], True))
                opened[tag] += 1
        else:
            links = 0
            end()
            if closing:
                close(tag)
            elif tag not in VOID and tag not in LOOSE:
                _, outer, inside, dropped = held[-1] if held else ("", -1, False, False)
                names = marks(attributes)
                if names & READERS:
                    around.append([outer, 2, 0])
                    outer, inside = len(around) - 1, False
                elif tag in AROUND or (tag not in ("article", "main", "body") or outer >= 0) and names & MARKS:
                    around.append([outer, 1, 0])
                    outer, inside = len(around) - 1, False
                elif tag in ("article", "main"):
                    while outer >= 0 and around[outer][1] == 1:
                        outer = around[outer][0]
                    inside = outer < 0
                held.append((tag, outer, inside, dropped))
                opened[tag] += 1
            top = held[-1] if held else ("", -1, False, False)
            now.around, now.inside = top[1], top[2]
    end()
    return out, around


def dense(text: str, linked: int, inside: bool) -> bool | None:
    """What links, length and stop words say: True for running text, False for links, None if they don't tell."""
    n = len("".join(text.split()))
    if linked > (LINKS_INSIDE if inside else LINKS) * n:
        return False
    if len(text) < LONG:
        return None
    words = _WORDS.findall(text.lower())
    return True if words and sum(w in _STOP_WORDS for w in words) >= STOPS * len(words) else None


def decide(found: list[Block], around: list[list]) -> None:
    """Pass one: True for the article, False for what surrounds it, None if the block doesn't tell."""
    total = 0
    for b in found:
        b.label = dense(b.text, b.linked, b.inside)
        if b.label is not False:
            total += len(b.text)
            if b.around >= 0:
                around[b.around][2] += len(b.text)
    for k in range(len(around) - 1, -1, -1):  # an outer element has the text of those within; it comes before them
        if around[k][0] >= 0:
            around[around[k][0]][2] += around[k][2]
    out: list[bool] = []
    for outer, kind, own in around:
        out.append(kind == 2 or own <= WRAPS * total or outer >= 0 and out[outer])
    for b in found:
        if b.around >= 0 and out[b.around]:
            b.label = False
        elif not b.inside and "©" in b.text and len(b.text) < 2 * LONG:
            b.label = False
        elif b.inside and b.label is None and len(b.text) >= LONG:
            b.label = True
    if not any(b.label for b in found):  # a language without known stop words: length and links alone
        for b in found:
            b.label = True if b.label is None and len(b.text) >= LONG and len(_WORDS.findall(b.text)) >= WORDY else b.label


def together(found: list[Block]) -> None:
    """Decide runs of open blocks that lie deeper than both their ends as one text."""
    k, n = 0, len(found)
    while k < n:
        if found[k].label is not None:
            k += 1
            continue
        end = k
        while end < n and found[end].label is None:
            end += 1
        rim, start = max(found[k].gap, found[end].gap if end < n else 0), k
        for i in range(k + 1, end + 1):
            if i == end or found[i].gap <= rim:
                run = found[start:i]
                if dense(" ".join(b.text for b in run), sum(b.linked for b in run), run[0].inside):
                    for b in run:
                        b.label = True
                start = i
        k = end


def inherit(found: list[Block]) -> None:
    """Pass two: open blocks take the label of the nearest decided one; of two as near the article's."""
    n = len(found)
    near: list[list[tuple[int, int, bool]]] = [[] for _ in found]
    last, depth = -1, 0
    for i, b in enumerate(found):
        depth = min(depth, b.gap)
        if b.label is not None:
            last, depth = i, 1 << 60
        elif last >= 0:
            near[i].append((-depth, i - last, not found[last].label))
    last, depth = -1, 0
    for i in range(n - 1, -1, -1):
        b = found[i]
        if b.label is not None:
            last, depth = i, 1 << 60
        elif last >= 0:
            near[i].append((-depth, last - i, not found[last].label))
        depth = min(depth, b.gap)
    for b, x in zip(found, near, strict=True):
        if b.label is None:
            b.label = b.inside or (not min(x)[2] if x else False)


def main_text(page: str) -> str:
    """The article's blocks, joined by line ends."""
    found, around = blocks(page)
    decide(found, around)
    together(found)
    inherit(found)
    return "\n".join(b.text for b in found if b.label)


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """``key, url, text, n_chars`` of every page, from its whole html; ``text`` is empty if there is none.

    Null html is empty. Null and repeated keys and urls give a row each, an empty table none. Broken markup never fails
    and is read in one forward scan: a tag that isn't closed ends where the next begins, an element that isn't ends where
    its parent does, and text outside any tag is a block. Other columns are ignored.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for b in batches:
            texts = [main_text(x or "") for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [key, "url", "text", "n_chars"])

    return pages.select(F.col(key).cast("bigint").alias(key), F.col("url"), F.col(column)).mapInArrow(run, f"{key} bigint, url string, text string, n_chars bigint")
