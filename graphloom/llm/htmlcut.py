"""Main text of web pages by minimum-cut labelling.

A page is read into blocks: runs of text between block-level tags. A linear classifier over a block's own text (words, share
of words in links, sentence ends), its element and its place (marks of the elements above it: landmark elements, roles, class
and id words) gives log-odds of bounded size, which become the capacities from the source (content) and to the sink
(boilerplate). Blocks that follow each other, and blocks of one parent, are joined by smoothness edges whose weight falls with
the steps between them in the element tree, and more where the way crosses a mark. The minimum cut, found by maximum flow, is
the labelling of least cost. Blocks whose own cost outweighs all of their edges are settled first, which is exact.

No mark decides alone. The element around the page's main part (its longest article or main, or else an element named like one)
is a wrapper, whatever its class says, and so is an element with nearly all of the page's words. Class words count in full as
whole names, less as parts of a name, and not in names that say what a page has or lacks (``has-sidebar``, ``no-comments``).

The weights are fitted: by logistic regression on the blocks of up to SAMPLE pages that have an article or main element (those
of least hash; whether a block stands in it is the weak label and no input), with a prior around the weights given here and a
bounded distance from them; without such pages the given weights stand. The rest of the pages is not read for that.

Nulls and empty pages give an empty text. Unclosed, misnested and unknown tags are tolerated; nothing is dropped for length,
and pages of any length are read whole. Formulas, objects and other unusual elements of the article stay. Ties of the cut go to
boilerplate. Repeated rows give repeated rows. Columns of other names than those made here pass unchanged. An empty table
gives no rows."""

from __future__ import annotations

import math
import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import column, mapped, slices_by_bytes

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
RAW = {"script", "style", "template", "iframe", "svg", "textarea", "title", "select", "canvas", "audio", "video", "annotation", "annotation-xml", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
MATH = {"math", "semantics", "mrow", "mi", "mn", "mo", "mtext", "ms", "mspace", "mfrac", "msqrt", "mroot", "mstyle", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mfenced", "mpadded", "mphantom", "menclose"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "link", "mark", "meta", "nobr", "object", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "source", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"} | MATH
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select", "datalist"}}
OUTSIDE = {"nav", "footer", "aside", "menu", "dialog"}
OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
#: Words of class and id names; a plural may follow.
OUT_WORDS = "ad|adbox|advert|advertisement|advertising|alert|banner|breadcrumb|comment|commentlist|consent|cookie|copyright|disclaimer|discussion|disqus|footer|gdpr|legal|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notification|outbrain|overlay|pager|pagination|popup|promo|promotion|recommendation|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|skiplink|social|sponsor|sponsored|subscribe|subscription|taboola|teaser|toolbar|widget"
OUT_WORD = re.compile(rf"(?:{OUT_WORDS})s?")
#: Parts of a name after or before which another part says only what the page has, lacks or looks like.
MODIFIERS = {"has", "have", "no", "not", "with", "without", "is", "hide", "hidden", "show", "open", "opened", "close", "closed", "enabled", "disabled", "active", "left", "right", "layout", "page", "body", "single", "columns", "column", "col", "sticky", "fixed", "allow", "allowed", "on", "off"}
IN_WORD = re.compile(r"article\w*|main|content|post|entry|story|bodytext|articlebody")
NAME = re.compile(r"[^\s]+")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
COMMENTS = re.compile(r"(?:comments?|commentlist|discussion|disqus|respond|replies|reply)")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = {"p", "blockquote", "pre", "figcaption", "dd"}
SENTENCE = re.compile(r"[.!?…。！？](?:[\s\"'”’)]|$)")

#: Inputs of the classifier and the weights given to them.
INPUTS = ("bias", "words", "sentence", "links", "heading", "prose", "item", "sign", "landmark", "form", "header", "name", "part", "notice", "hidden", "in_main", "in_name", "beside")
GIVEN = np.array([-1.2, 1.1, 0.8, -4.0, 1.2, 1.0, -0.4, -2.0, -5.0, -4.0, -3.0, -4.5, -1.5, -3.0, -6.0, 3.0, 1.5, -3.0])
#: Which of them are fitted: not those that the weak labels are made of.
FITTED = np.array([n not in ("in_main", "in_name", "beside") for n in INPUTS])
#: Log-odds are cut to this; a fitted weight stays so near to the given one; pages of the sample.
MOST, NEAR, SAMPLE = 6.0, 1.5, 400
#: Kinds of marks.
NONE, LANDMARK, FORM, HEADER, NAMED, PARTLY, NOTICE, GONE = range(8)
#: Inputs of the kinds of marks, in their order.
MARKED = [None, *(INPUTS.index(n) for n in ("landmark", "form", "header", "name", "part", "notice", "hidden"))]


class Element:
    __slots__ = ("parent", "depth", "out", "inside", "comments", "words", "mark")

    def __init__(self, parent: int, depth: int, out: int, inside: int, comments: bool):
        self.parent, self.depth, self.out, self.inside, self.comments, self.words, self.mark = parent, depth, out, inside, comments, 0, NONE


class Block:
    __slots__ = ("text", "tag", "element", "words", "linked")

    def __init__(self, text: str, tag: str, element: int, words: int, linked: int):
        self.text, self.tag, self.element, self.words, self.linked = text, tag, element, words, linked


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def named(names: str) -> tuple[int, int, bool]:
    """Kind of mark of class and id names, whether they name a main part, whether they name comments."""
    out, inside, comments = NONE, 0, False
    for name in NAME.findall(names):
        parts = [p.lower() for p in PART.findall(name)]
        whole = "".join(parts)
        if IN_WORD.fullmatch(whole) or len(parts) == 2 and IN_WORD.fullmatch(parts[1]) and parts[0] in ("main", "post", "article", "entry", "page", "story"):
            inside = 2
        if OUT_WORD.fullmatch(whole):
            out = NAMED
            comments |= bool(COMMENTS.fullmatch(whole))
        elif len(parts) > 1 and not MODIFIERS.intersection(parts):
            hits = [p for p in parts if OUT_WORD.fullmatch(p)]
            if hits and out != NAMED:
                out = NAMED if OUT_WORD.fullmatch(parts[-1]) or OUT_WORD.fullmatch(parts[0]) else PARTLY
                comments |= any(map(COMMENTS.fullmatch, hits))
        elif len(parts) > 1 and any(OUT_WORD.fullmatch(p) for p in parts) and out == NONE:
            out = PARTLY
    return out, inside, comments


def marks_of(tag: str, raw: str) -> tuple[int, int, bool]:
    """Kind of mark of an element, 1 for a main part (2 if only named so), whether it holds comments."""
    out, inside, comments, role = NONE, 0, False, ""
    if raw and ("=" in raw or "hidden" in raw):
        found = attributes(raw)
        role = found.get("role", "").lower()
        out, inside, comments = named(f"{found.get('class', '')} {found.get('id', '')}")
        if "hidden" in found or found.get("aria-hidden") == "true" or HIDDEN.search(found.get("style", "")):
            return GONE, 0, False
        if role in OUT_ROLES:
            out = LANDMARK
        if role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
            inside = 1
    if tag in OUTSIDE:
        out = LANDMARK
    elif tag in ("form", "fieldset"):
        out = max(out, FORM) if out == LANDMARK else FORM
    elif tag == "header" and out == NONE:
        out = HEADER
    elif tag == "noscript" and out == NONE:
        out = NOTICE
    elif tag in ("article", "main") and out != NAMED:
        out, inside = NONE, 1
    if out in (LANDMARK, NAMED) and inside == 2:
        inside = 0
    return out, inside, comments


def parsed(page: str) -> tuple[list[Block], list[Element]]:
    out: list[Block] = []
    elements = [Element(0, 0, NONE, 0, False)]
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, element, in a link
    parts: list[str] = []
    words = linked = at = 0
    holder = ("", 0)

    def flush():
        nonlocal words, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(text, holder[0], holder[1], max(words, 1), linked))
                elements[holder[1]].words += max(words, 1)
            parts.clear()
        words = linked = 0

    def take(text):
        nonlocal words, linked, holder
        n = len(text.split())
        if not parts:
            tag = next((t for t, _, _ in reversed(stack) if t not in INLINE), "")
            holder = (tag, stack[-1][1])
        parts.append(text)
        words += n
        if stack[-1][2]:
            linked += n

    def open_element(tag, raw):
        above = elements[stack[-1][1]]
        elements.append(Element(stack[-1][1], above.depth + 1, *marks_of(tag, raw)))
        return len(elements) - 1

    while True:
        found = TOKEN.search(page, at)
        text = page[at : found.start() if found else len(page)]
        if text and (parts or not text.isspace()):
            take(text)
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            if found[0].startswith("<![CDATA["):
                take(found[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if found[1]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        raw = found[3]
        if tag in RAW:
            if tag not in ("svg", "canvas", "annotation", "annotation-xml"):
                flush()
            if not raw.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            if parts:
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag in VOID or raw.endswith("/"):
                continue
            below = stack[-1][1]
            if raw and tag != "a" and marks_of(tag, raw)[0]:
                below = open_element(tag, raw)
            stack.append((tag, below, stack[-1][2] or tag == "a"))
            continue
        flush()
        if tag in VOID:
            continue
        # tags that end by implication
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name == "p" or name == "head" and tag not in ("noscript", "base"):
                del stack[k:]
                break
            if name not in INLINE:
                break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[tag]:
                    del stack[k:]
                    break
                if stack[k][0] in HOLDERS[tag]:
                    break
        if raw.endswith("/") and tag not in ("p", "div", "li"):
            raw = raw[:-1]
        stack.append((tag, open_element(tag, raw), stack[-1][2]))
    flush()
    return out, elements


def placed(elements: list[Element]) -> tuple[int, int]:
    """Set each element's words and the mark that holds in it; the kind of the page's main part (0: none) and its element.

    The nearest mark from the top holds below it; marks of wrappers around the main part or nearly all of the page don't count."""
    for i in range(len(elements) - 1, 0, -1):  # children come after their parents
        elements[elements[i].parent].words += elements[i].words
    total = max(elements[0].words, 1)
    principal, kind = 0, 0
    for i, e in enumerate(elements):
        if e.inside and e.words and e.out == NONE:
            better = (e.inside == 1, e.words) > (kind == 1, elements[principal].words if kind else 0)
            above, in_comments = e.parent, False
            while above and not in_comments:
                in_comments, above = elements[above].comments or elements[above].out in (LANDMARK, GONE), elements[above].parent
            if better and not in_comments:
                principal, kind = i, e.inside
    wrappers = set()
    at = elements[principal].parent if kind else 0
    while at:
        wrappers.add(at)
        at = elements[at].parent
    for i, e in enumerate(elements[1:], 1):
        above = elements[e.parent].mark
        share = e.words / total
        wrapper = i in wrappers or (e.out != GONE and share >= (0.5 if e.out in (PARTLY, FORM, NOTICE) else 0.9))
        own = NONE if wrapper else e.out
        if own == HEADER and kind and _within(elements, i, principal):
            own = NONE
        e.mark = above if above not in (NONE, PARTLY) else own or above
    return kind, principal


def _within(elements: list[Element], i: int, top: int) -> bool:
    while i > top:
        i = elements[i].parent
    return i == top


def inputs(b: Block, e: Element, kind: int, within: bool) -> list[float]:
    row = [0.0] * len(INPUTS)
    row[0], row[1] = 1.0, min(math.log2(b.words + 1), 6.0) / 2 - 1.0
    row[2], row[3] = float(bool(SENTENCE.search(b.text))), b.linked / b.words
    row[4], row[5], row[6] = float(b.tag in HEADINGS), float(b.tag in PROSE), float(b.tag in ("li", "td", "th", "dt", "option"))
    row[7] = float("©" in b.text or "all rights reserved" in b.text.lower())
    if e.mark:
        row[MARKED[e.mark]] = 1.0
    if kind and not e.mark:
        row[15 if kind == 1 else 16] = float(within)
        row[17] = float(not within) * (1.0 if kind == 1 else 0.4)
    return row


def features(page: str) -> tuple[list[Block], list[Element], np.ndarray, np.ndarray]:
    """Blocks, elements, inputs of the blocks, and the weak labels: 1 in the main part, 0 outside, -1 if the page has none."""
    blocks, elements = parsed(page)
    kind, principal = placed(elements)
    within = [bool(kind) and _within(elements, b.element, principal) for b in blocks]
    rows = [inputs(b, elements[b.element], kind, w) for b, w in zip(blocks, within, strict=True)]
    label = [int(w and not elements[b.element].mark) if kind == 1 else -1 for b, w in zip(blocks, within, strict=True)]
    return blocks, elements, np.array(rows).reshape(-1, len(INPUTS)), np.array(label, np.int64)


def fitted(rows: np.ndarray, labels: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression with a prior of width 1 around the given ones, at most NEAR from them."""
    x, weights = rows[:, FITTED], GIVEN.copy()
    if not len(x) or labels.min() == labels.max():
        return weights
    w, prior = GIVEN[FITTED].copy(), GIVEN[FITTED]
    for _ in range(steps):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (labels - p) - (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)), slope)
        w = np.clip(w + np.clip(step, -1, 1), prior - NEAR, prior + NEAR)
    weights[FITTED] = w
    return weights


def cut(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling that minimises the costs of labels against log-odds and of edges between unlike labels."""
    n = len(costs)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), w in edges.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    costs, label = list(costs), [None] * n
    open_weight = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:  # settled: its own cost outweighs its edges, whatever the others are
        i = todo.popleft()
        if label[i] is None and abs(costs[i]) > open_weight[i]:
            label[i] = costs[i] > 0
            for j, w in near[i].items():
                if label[j] is None:
                    costs[j] += w if label[i] else -w
                    open_weight[j] -= w
                    todo.append(j)
    left = [i for i in range(n) if label[i] is None]
    if left:
        for i, side in zip(left, max_flow([costs[i] for i in left], {(a, b): w for a, b, w in _between(left, near)}), strict=True):
            label[i] = side
    return label


def _between(left, near):
    place = {i: k for k, i in enumerate(left)}
    return [(place[i], place[j], w) for i in left for j, w in near[i].items() if j in place and i < j]


def max_flow(costs: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Dinic's algorithm; True for what the source still reaches when the flow is at its maximum."""
    n = len(costs)
    source, sink = n, n + 1
    to, room, out = [], [], [[] for _ in range(n + 2)]

    def edge(a, b, there, back=0):
        out[a].append(len(to))
        to.append(b)
        room.append(there)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        units = round(c * 1000)
        if units > 0:
            edge(source, i, units)
        elif units < 0:
            edge(i, sink, -units)
    for (a, b), w in edges.items():
        edge(a, b, round(w * 1000), round(w * 1000))
    while True:
        level = [-1] * (n + 2)
        level[source], todo = 0, deque([source])
        while todo:
            a = todo.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        ahead = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                path, at = [], source
                continue
            while ahead[at] < len(out[at]):
                e = out[at][ahead[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    break
                ahead[at] += 1
            if ahead[at] < len(out[at]):
                path.append(out[at][ahead[at]])
                at = to[path[-1]]
            elif path:
                at = to[path.pop() ^ 1]
                ahead[at] += 1
            else:
                break


def edges_of(blocks: list[Block], elements: list[Element]) -> dict[tuple[int, int], float]:
    """Smoothness: blocks that follow each other, the stronger the nearer they are in the element tree, and blocks of one parent."""
    edges: dict[tuple[int, int], float] = {}
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        own = elements[b.element]
        if i:
            before = elements[blocks[i - 1].element]
            edges[i - 1, i] = (0.2 if before.mark != own.mark else 1.0) * 1.6 / (1 + 0.5 * _steps(elements, blocks[i - 1].element, b.element))
        j = last_of.get(own.parent)
        if j is not None and elements[blocks[j].element].mark == own.mark:
            edges[j, i] = edges.get((j, i), 0.0) + 0.6
        last_of[own.parent] = i
    return edges


def _steps(elements: list[Element], i: int, j: int) -> int:
    """Steps of the way between two elements beyond that of siblings."""
    steps = 0
    while i != j:
        if elements[i].depth >= elements[j].depth:
            i = elements[i].parent
        else:
            j = elements[j].parent
        steps += 1
    return max(steps - 2, 0)


def labelled(page: str | None, weights: np.ndarray = GIVEN) -> list[tuple[Block, float, bool]]:
    """Blocks, their log-odds and whether the cut leaves them with the content."""
    blocks, elements, rows, _ = features(page or "")
    costs = np.clip(rows @ weights, -MOST, MOST).tolist()
    return list(zip(blocks, costs, cut(costs, edges_of(blocks, elements)), strict=True))


def main_text(page: str | None, weights: np.ndarray = GIVEN) -> str:
    return "\n\n".join(b.text for b, _, keep in labelled(page, weights) if keep)


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> np.ndarray:
    """Weights fitted on the blocks of the sample: at most so many pages with an article or main element, those of least hash."""
    some = pages.select(F.col(html).alias("page")).filter(F.lower("page").rlike("<(?:article|main)[ >]")).orderBy(F.xxhash64("page"), "page").limit(sample)

    def run(batches):
        for batch in slices_by_bytes(batches, "page"):
            for page in column(batch, "page").to_pylist():
                _, _, rows, labels = features(page)
                # one row for each kind of block: pages repeat them
                kinds, n = np.unique(np.concatenate([rows.round(2), labels[:, None]], axis=1), axis=0, return_counts=True)
                kinds, n = kinds[kinds[:, -1] >= 0][:64], n[kinds[:, -1] >= 0][:64]
                yield pa.RecordBatch.from_arrays([pa.array(kinds.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["row", "n"])

    found = sorted((tuple(r.row), r.n) for r in some.transform(mapped, run, "row array<double>, n long").collect())  # at most 64 rows a page of the sample
    if not found:
        return GIVEN.copy()
    every = np.repeat(np.array([r for r, _ in found]), [min(n, 16) for _, n in found], axis=0)
    return fitted(every[:, :-1], every[:, -1])


def extract(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> DataFrame:
    """The columns of pages but the markup, with text and n_chars."""
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    weights = fit(pages, html, sample)

    def run(batches):
        for batch in slices_by_bytes(batches, html, 4 << 20):
            texts = [main_text(p, weights) for p in column(batch, html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    fields = "".join(f"`{c}` {pages.schema[c].dataType.simpleString()}, " for c in names)
    return pages.select(*names, html).transform(mapped, run, f"{fields}text string, n_chars long")
