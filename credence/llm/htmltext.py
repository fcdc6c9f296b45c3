"""Main text of web pages by maximum-scoring subsequence (operator 6)."""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, texts_of

#: Comments and declarations, and tags: of these, attribute values may hold ">", unless quotes don't pair up to the page's end.
COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?", re.DOTALL)
TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
PLAIN_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>")

#: Fixed values. Elements whose content is text to the parser until their end tag, and is never shown.
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "canvas", "select", "button")

#: Fixed values. Elements that are no part of an article wherever they stand.
ASIDE = ("nav", "footer", "aside", "form", "menu", "dialog", "head")

#: Fixed values. Elements without content, and elements that end where one of the same kind begins.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

#: Fixed values. Elements inside a line; all others begin and end blocks.
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "object", "math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "mfrac", "msqrt", "semantics")

#: Fixed values. Words of a class, id or role that name what is no part of an article.
NAMES = "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()

#: Fixed values. Of these, names that never stand for a part with running text of the article's own, and names of headers, which inside an article are its own.
FOREIGN = "comment comments commentlist cookie cookies consent disqus newsletter reply replies respond".split()
HEADERS = ("banner", "header", "masthead")

#: Fixed values. Further elements whose tags have weights of their own; those of others count as "<other".
OTHERS = ("html", "body", "div", "section", "article", "main", "header", "address", "center", "details", "summary", "fieldset", "legend", "optgroup", "option", "audio", "video", "picture", "caption", "colgroup", "thead", "tfoot", "hgroup", "search", "slot", "path")

#: Fixed values. Elements of running text, besides those inside lines: their names say nothing of what they are, as ids of headings are made of the heading's words.
TEXTUAL = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "pre", "blockquote", "dt", "dd", "figcaption", "caption")

#: Weight of a word, as a share of its usual one, in a part with one of NAMES among others in its name, and where that is a FOREIGN one.
NAMED, NAMED_FOREIGN = 0.25, -0.3

#: Share of a list's words that are links, and number of links, from which a list outside an article or main is a menu.
MENU_SHARE, MENU_LINKS = 0.8, 3

_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_SPACES = re.compile(r"\s+")

#: Pages that the weights are learned from, at most (about: they are drawn by a hash of page_id and html).
SAMPLE_PAGES = 2000

#: Fixed values. Elements that carry running text.
FLOW = ("p", "br", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ol", "ul", "blockquote", "pre", "dl", "dt", "dd", "table", "tbody", "tr", "td", "th", "figure", "figcaption", "hr", "img")

#: Fixed values. Weights where no page is labelled: of a word, a word of a link, a tag, and tags of running text and inside lines.
PLAIN = {"word": 1.0, "linked": -0.6, "tag": -3.0} | {f"<{x}": -0.4 for x in FLOW} | {f"<{x}": -0.1 for x in INLINE}

#: Share of a tag's weight that counts inside labelled content, and of a word's weight that counts there at least.
LABELLED_TAG, LABELLED_WORD = 0.1, 0.5


#: Times the plain weight of a tag of running text that its learned one is at least: menus are made of lists too.
TEXT_TAG = 3.0

#: Share of the best region's score from which a further article or main outside of it counts.
FURTHER = 0.1


def attributes_of(tag: str) -> dict[str, str]:
    """A start tag's attributes by lower-cased name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        found.setdefault(name.lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def _words_of(token: str) -> list[str]:
    return re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())


def names_of(name: str, attributes: dict[str, str], mark: str) -> list[str]:
    """What an element is called: the tokens of its class, role and label, of containers only. Ids are mostly made from headings: they
    count outside of an article or main, of a section those of FOREIGN only, and inside where a div is called by one of FOREIGN."""
    if name in TEXTUAL or name in INLINE:
        return []
    found = [t for x in ("class", "role", "aria-label") for t in attributes.get(x, "").split()]
    own = attributes.get("id", "").split()
    if mark not in ("article", "main"):
        return found + [t for t in own if name != "section" or t.lower() in FOREIGN]
    return found + [t for t in own if name == "div" and t.lower() in FOREIGN]


def named_aside(names: list[str], own_headers: bool = False) -> float:
    """What an element's names leave of the weight of words: 0 if one is of NAMES, NAMED or NAMED_FOREIGN if a part of one is, else 1."""
    found = 1.0
    for token in names:
        words = [w for w in _words_of(token) if w in NAMES and not (own_headers and w in HEADERS)]
        if words and token.lower() in words:
            return 0.0
        if words:
            found = min(found, NAMED_FOREIGN if any(w in FOREIGN for w in words) else NAMED)
    return found


def foreign(names: list[str]) -> bool:
    return any(w in FOREIGN for t in names for w in _words_of(t))


def lexed(page: str):
    """(text before, the match of a tag, or None for what is no tag) from start to end, in one pass."""
    at = start = 0
    tag, last = TAG, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        if after in ("!", "?") and after:
            m = COMMENT.match(page, at)
            yield page[start:at], None, m.end()
            at = start = m.end()
            continue
        opens = at < last and (after.isalpha() or after == "/")
        m = tag.match(page, at) if opens else None
        if not m and opens and tag is TAG and (m := PLAIN_TAG.match(page, at)):
            tag = PLAIN_TAG  # quotes that don't pair up: from here on they mean nothing
        if not m:
            at += 1
            continue
        skip = yield page[start:at], m, m.end()
        at = start = skip or m.end()
    yield page[start:], None, len(page)


def parsed(page: str) -> list[tuple[str, str, bool, str, float, int]]:
    """The page as (kind, name or text, whether it is inside what is no article, enclosing landmark, share of words' weights, innermost part
    that lowers it, by the place of its start, or -1) in order; kind: start, end, text.

    A named wrapper says nothing of an article or main inside it. A part with a name of NAMES is no article unless it holds
    more than half of the words of the page's content (those of FOREIGN never are); nor is a list of links outside an article or main.
    """
    out: list[tuple[str, str, bool, str, float, int]] = []
    special: list[int] = []  # each token's innermost doubtful part
    doubtful: list[list] = []  # parent, name or list, words, words of links, links, inside article or main
    stack: list[tuple[str, bool, str, float, int, int]] = []  # name, aside by element, landmark, share, part, doubtful part
    opened: dict[str, int] = {}
    total = {False: 0, True: 0}

    def put(kind: str, name: str, aside: bool, mark: str, share: float, part: int, own: int) -> None:
        out.append((kind, name, aside, mark, share, part))
        special.append(own)

    outside = ("", False, "", 1.0, -1, -1)
    tokens = lexed(page)
    send = None
    while True:
        try:
            text, m, at = tokens.send(send)
        except StopIteration:
            break
        send = None
        _, aside, mark, share, part, own = stack[-1] if stack else outside
        if text:
            put("text", text, aside, mark, share, part, own)
            if not aside:
                n = len(text.split())
                total[mark in ("article", "main")] += n
                if own >= 0:
                    doubtful[own][2] += n
                    doubtful[own][3] += n if opened.get("a") else 0
        if not m:
            continue
        name = m[1].lower()
        if m[0][1] == "/":
            if opened.get(name):
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == name:
                        break
                _, aside, mark, share, part, own = stack[-1] if stack else outside
            put("end", name, aside, mark, share, part, own)
            continue
        if name in RAW and not m[0].endswith("/>"):
            end = _RAW_END[name].search(page, at)
            send = end.end() if end else (at if name in ("button", "select", "svg") else len(page))
            put("start", name, True, mark, share, part, own)
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            opened["p"] -= 1
            stack.pop()
        given = names_of(name, attributes_of(m[2]), mark) if m[2] else []
        leaves = named_aside(given, mark == "article") if given and name not in ("body", "html", "main") else 1.0
        if name in ("article", "main"):
            if name == "article" and leaves > NAMED_FOREIGN and not (leaves == 0 and foreign(given)):
                leaves = 1.0
            if leaves == 1.0:
                own, share, part = -1, 1.0, -1
        if name in ("article", "main") or name == "body" and not mark:
            mark = name if mark != "article" else mark
        inside = mark in ("article", "main")
        aside = aside or name in ASIDE or (name == "header" and mark != "article")
        if own >= 0 and name == "a":
            doubtful[own][4] += 1
        if leaves == 0 or name in ("ul", "ol") and not inside:
            doubtful.append([own, "list" if leaves else "foreign" if foreign(given) else "name", 0, 0, 0, inside])
            own = len(doubtful) - 1
        if leaves not in (0.0, 1.0):
            share, part = min(share, leaves), len(out)
        put("start", name, aside, mark, share, part, own)
        if name not in VOID and not m[0].endswith("/>"):
            stack.append((name, aside, mark, share, part, own))
            opened[name] = opened.get(name, 0) + 1
    for i in range(len(doubtful) - 1, -1, -1):
        if (up := doubtful[i][0]) >= 0:
            for k in (2, 3, 4):
                doubtful[up][k] += doubtful[i][k]
    gone: list[bool] = []
    for up, kind, words, linked, links, inside in doubtful:
        if kind == "list":
            no = links >= MENU_LINKS and linked >= MENU_SHARE * words
        else:  # the content is what is labelled so, or else the page
            no = kind == "foreign" or 2 * words <= total[inside] or not inside and total[True] > 0
        gone.append(no or up >= 0 and gone[up])
    return [(*t[:2], t[2] or own >= 0 and gone[own], *t[3:]) for t, own in zip(out, special, strict=True)]


_RAW_END = {x: re.compile(rf"</{x}\s*>", re.IGNORECASE) for x in RAW}
_KNOWN = frozenset((*RAW, *ASIDE, *VOID, *INLINE, *FLOW, *OTHERS))


def feature(kind: str, name: str, links: int) -> str:
    return ("linked" if links else "word") if kind == "text" else f"<{name if name in _KNOWN else 'other'}"


def counted(page: str, into: dict) -> None:
    """Adds how often each feature stands inside and outside a page's labelled content (article or main) to `into`."""
    links = 0
    for kind, name, aside, mark, _, _ in parsed(page):
        links += (kind == "start") - (kind == "end") if name == "a" and kind != "text" else 0
        n = len(name.split()) if kind == "text" else 1
        inside = mark in ("article", "main") and not aside
        both = into.setdefault(feature(kind, name, max(links, 0)), [0, 0])
        both[inside] += n


def weights_of(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Weights from counts (outside, inside): log odds against the mean, of words above 0 and of tags below."""
    outside, inside = (sum(c[i] for c in counts.values()) + 1 for i in (0, 1))
    made = dict(PLAIN)
    for name, (o, i) in counts.items():
        odds = float(np.log((i + 1) / inside) - np.log((o + 1) / outside))
        if name == "word":
            made[name] = min(max(odds, 0.5), 2.0)
        elif name == "linked":
            made[name] = min(max(odds, -2.0), 0.3)
        else:
            plain = PLAIN.get(name, -1.0)
            made[name] = min(max(odds, TEXT_TAG * plain if name[1:] in FLOW else -6.0), plain)
    return made


def learn(pages: DataFrame, sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from pages that label their own content by an article or main element, about `sample` of them."""
    labelled = pages.select("page_id", F.col("html").cast("string").alias("html")).where(F.lower("html").rlike("<(article|main)[ >]"))
    n = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("page_id", "html", F.lit(5)), F.lit(1_000_003)) / 1_000_003.0 < min(1.0, sample / max(n, 1)))

    def count(batches):
        held: dict[str, list[int]] = {}
        for batch in batches:
            for page in texts_of(batch.column(0)).to_pylist():
                counted(page, held)
        yield pa.RecordBatch.from_pydict({"feature": list(held), "o": [c[0] for c in held.values()], "i": [c[1] for c in held.values()]}, schema=pa.schema([("feature", pa.string()), ("o", pa.int64()), ("i", pa.int64())]))

    known = drawn.select("html").mapInArrow(count, "feature string, o bigint, i bigint").groupBy("feature").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return weights_of({r["feature"]: (r["o"], r["i"]) for r in known.collect()})  # one for each of a fixed list of elements


def best_region(scores: np.ndarray) -> tuple[int, int]:
    """The contiguous range [a, b) of the largest sum, found in one pass; the first such, empty if none is above 0."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    low = np.minimum.accumulate(sums)
    gain = sums - low
    b = int(gain.argmax())
    if gain[b] <= 0:
        return 0, 0
    return int(np.flatnonzero(sums[:b] == low[b])[-1]), b


def scored(tokens: list[tuple], weights: dict[str, float]) -> np.ndarray:
    """Each token's score."""
    links, scores, before = 0, np.zeros(len(tokens)), False
    for k, (kind, name, aside, mark, share, _) in enumerate(tokens):
        links += (kind == "start") - (kind == "end") if name == "a" and kind != "text" else 0
        labelled = mark in ("article", "main")
        if aside:
            scores[k] = 0 if before else weights["tag"] * (LABELLED_TAG if labelled else 1)
        elif kind == "text":
            w = weights["linked"] if links > 0 else weights["word"]
            if share != 1:
                w = min(w, PLAIN["linked"]) if links > 0 else w * share
            scores[k] = len(name.split()) * (max(w, LABELLED_WORD * weights["word"]) if labelled and share == 1 else w)
        else:
            scores[k] = weights.get(feature(kind, name, 0), weights["tag"]) * (LABELLED_TAG if labelled else 1)
        before = aside
    return scores


def without_named(tokens: list[tuple], weights: dict[str, float]) -> list[tuple]:
    """The tokens, with those parts as no article whose name lowers their words' weights and whose score is not above 0 then."""
    scores, total = scored(tokens, weights), {}
    for k, t in enumerate(tokens):
        if t[5] >= 0:
            total[t[5]] = total.get(t[5], 0.0) + scores[k]
    gone = {p for p, x in total.items() if x <= 0}
    return [(kind, name, aside or part in gone, mark, share, part) for kind, name, aside, mark, share, part in tokens]


def regions(tokens: list[tuple], scores: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of tokens that hold the main text, in order.

    First the range of the largest score. Where most of its words are labelled (article or main), other labelled parts outside of it
    have a best range too, which counts if its score is FURTHER of the first one's: what stands between two parts of an article
    may cost more than either. Else a range without an h1 gets the one right before it, if no text of the page stands between.
    """
    a, b = best_region(scores)
    if a == b:
        return []
    labelled = np.array([mark in ("article", "main") for _, _, _, mark, _, _ in tokens])
    words = np.array([len(t[1].split()) if t[0] == "text" and not t[2] else 0 for t in tokens])
    if 2 * words[a:b][labelled[a:b]].sum() < words[a:b].sum():
        return [(heading_before(tokens, a, b), b)]
    found, least = [(a, b)], FURTHER * scores[a:b].sum()
    rest = labelled.copy()
    rest[a:b] = False
    edges = np.flatnonzero(np.diff(np.concatenate([[0], rest.astype(np.int8), [0]])))
    for i, j in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        x, y = best_region(scores[i:j])
        if x < y and scores[i + x : i + y].sum() >= least:
            found.append((i + x, i + y))
    return sorted(found)


def heading_before(tokens: list[tuple], a: int, b: int) -> int:
    """Where the h1 starts that stands before a range without one, no text between; else the range's start."""
    if any(t[0] == "start" and t[1] == "h1" and not t[2] for t in tokens[a:b]):
        return a
    inside = False
    for k in range(a - 1, -1, -1):
        kind, name, aside = tokens[k][:3]
        if aside:
            continue
        if name == "h1" and kind != "text":
            if kind == "start":
                return k if inside else a
            inside = True
        elif kind == "text" and not inside and name.strip():
            return a
    return a


def extract(page: str | None, weights: dict[str, float] = PLAIN) -> str:
    """A page's main text: the regions of the largest score, without what is no article inside them.

    Words score above 0 and tags below. What is no article costs its first tag only: it may stand inside the
    region, but its text never counts. A page without positive region has no text. Text that a page holds but doesn't show at once
    (hidden, aria-hidden, display: none) is text like other.
    """
    tokens = parsed(page or "")
    tokens = without_named(tokens, weights) if any(t[5] >= 0 for t in tokens) else tokens
    blocks, held = [], []

    def close():
        if text := _SPACES.sub(" ", html.unescape("".join(held))).strip():
            blocks.append(text)
        held.clear()

    for a, b in regions(tokens, scored(tokens, weights)):
        for kind, name, aside, *_ in tokens[a:b]:
            if kind == "text":
                if not aside:
                    held.append(name)
            elif name not in INLINE:
                close()
        close()
    return " ".join(blocks)


def extracted(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; a null or empty page has an empty text.

    Repeated rows give a row each; an empty table gives none; columns other than page_id, url and html are not read.
    """

    def run(texts):
        found = [extract(t, weights) for t in texts.to_pylist()]
        return {"text": found, "n_chars": [len(t) for t in found]}

    return map_texts(pages, "html", {"page_id": "page_id", "url": "url"}, run, "text string, n_chars bigint")
