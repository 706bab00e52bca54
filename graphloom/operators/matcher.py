"""Selectors against one page's tree, in memory: a page's elements meet in one task, so no step of a match needs a join.

A status says how sure a match is: EXACT, COND (in some state of the page), UNKNOWN (not understood), NO. A conjunction is
as sure as its least part, a choice as its best, a negation turns EXACT and NO. Candidates are found by the id, class or tag
of the rightmost compound; from there the chain is followed to the left."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

NO, UNKNOWN, COND, EXACT = 0, 1, 2, 3
#: Longer attribute values may have been cut by a reader, so nothing is sure about them.
LONG_VALUE = 4096

# Fixed values of HTML: attributes whose values have no case, and form elements.
CASELESS = {"accept", "accept-charset", "align", "alink", "axis", "bgcolor", "charset", "checked", "clear", "codetype", "color", "compact", "declare", "defer", "dir", "direction", "disabled", "enctype", "face", "frame", "hreflang", "http-equiv", "lang", "language", "link", "media", "method", "multiple", "nohref", "noresize", "noshade", "nowrap", "readonly", "rel", "rev", "rules", "scope", "scrolling", "selected", "shape", "target", "text", "type", "valign", "valuetype", "vlink"}
FORM_PARTS = {"button", "input", "select", "textarea", "optgroup", "option", "fieldset"}


def pieces(text: str, cuts: str) -> list[str]:
    """text cut at these characters, which stay as pieces of their own, but not inside brackets, parentheses or quotes."""
    out, held, deep, quote = [], "", 0, ""
    for c in text:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            deep += 1
        elif c in ")]":
            deep -= 1
        elif c in cuts and not deep:
            out += [held, c]
            held = ""
            continue
        held += c
    return [p for p in [*out, held] if p]


def selector_list(text: str) -> list[str]:
    return [p.strip() for p in pieces(text, ",") if p != "," and p.strip()]


def chain(selector: str) -> list[tuple[str, str]]:
    """(combinator before it, compound) from left to right; the first has none, unless the selector begins with one."""
    out, joint = [], ""
    for p in pieces(selector.strip(), " \t\n\r\f>+~"):
        if p.isspace():
            joint = joint or " "
        elif p in ">+~":
            joint = p
        else:
            out.append((joint, p))
            joint = ""
    return out


def simple_parts(compound: str) -> list[str]:
    """A compound's parts: a type or *, then #id, .class, [attribute], :state, :function(…)."""
    out, held = [], ""
    for p in pieces(compound, "#.:"):
        if p in "#." or p == ":":
            if p == ":" and held == ":":
                held = "::"
                continue
            if held.strip(":"):
                out.append(held)
            held = p
        else:
            held += p
    out += [held] if held else []
    return [x for p in out for x in _attributes(p)]


def _attributes(part: str) -> list[str]:
    at = part.find("[")
    if at < 0 or "(" in part[:at]:
        return [part]
    found, rest = [part[:at]] if at else [], part[at:]
    while rest.startswith("["):
        end = rest.index("]") + 1 if "]" in rest else len(rest)
        found.append(rest[:end])
        rest = rest[end:]
    return found + ([rest] if rest else [])


def steps_of(formula: str) -> tuple[int, int] | None:
    """(A, B) of An+B, odd, even."""
    text = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), re.sub(r"\s", "", formula.lower()))
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not found:
        return None
    if found[3]:
        return 0, int(found[3])
    return int(found[1] + "1" if found[1] in ("", "+", "-") else found[1]), int(found[2] or 0)


@lru_cache(maxsize=4096)
def compiled(selector: str) -> tuple[tuple[str, tuple], ...]:
    return tuple((joint, tuple(simple_parts(c))) for joint, c in chain(selector))


@lru_cache(maxsize=4096)
def _test(part: str):
    found = re.fullmatch(r"\[\s*(?:\w*\|)?([\w:-]+)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\"'\]\s]*)\s*([iIsS])?)?\s*\]", part)
    return found and (found[1].lower(), found[2], (found[3] or "").strip("\"'"), (found[4] or "").lower())


class Page:
    """Elements as rows (element, parent, depth, position, tag, id, classes, attributes, text), parents before their children.

    quirks: the page is shown in quirks mode, in which ids and classes have no case. What a selector asks for by id, class, tag
    or place in a family is counted once and kept for this selector alone, so no step looks through an element's siblings."""

    def __init__(self, rows, quirks: bool = False):
        self.rows, self.quirks = rows, quirks
        at = {r[0]: i for i, r in enumerate(rows)}
        self.parent = [at.get(r[1], -1) for r in rows]
        families: dict[int, list[int]] = {}  # children of -1: elements without a parent
        self.nth = array("q")  # place among the siblings
        for i, above in enumerate(self.parent):
            family = families.setdefault(above, [])
            self.nth.append(len(family))
            family.append(i)
        self.top = families.pop(-1, [])
        self.kids = [families.get(i, ()) for i in range(len(rows))]
        self.forget()

    def forget(self) -> None:
        self.by: dict[str, list[int]] = {}
        self.known: dict[tuple, int] = {}
        self.best: dict[tuple, list[int]] = {}
        self.places: dict[tuple, tuple] = {}

    def fold(self, name: str) -> str:
        return name.lower() if self.quirks else name

    def siblings(self, i: int):
        return self.kids[self.parent[i]] if self.parent[i] >= 0 else self.top

    def below(self, i: int):
        todo = [iter(self.kids[i])]
        while todo:
            if (j := next(todo[-1], None)) is None:
                todo.pop()
            else:
                yield j
                todo.append(iter(self.kids[j]))

    def select(self, selectors: str) -> dict[int, int]:
        """Status of each element that the selector list may match."""
        out: dict[int, int] = {}
        for one in selector_list(selectors):
            steps = compiled(one)
            if not steps:
                continue
            for i in self.candidates(steps[-1][1]):
                if (status := self.match(steps, len(steps) - 1, i, None)) > out.get(i, NO):
                    out[i] = status
            self.forget()
        return {self.rows[i][0]: s for i, s in out.items()}

    def candidates(self, parts: tuple) -> list[int]:
        for sign in "#.":
            if own := next((p for p in parts if p[0] == sign), None):
                return self.having(sign, self.fold(own[1:]))
        kind = next((p for p in parts if p[0] not in "#.[:*&"), None)
        return self.having("", kind.rpartition("|")[2].lower()) if kind and not kind.endswith("*") else range(len(self.rows))

    def having(self, sign: str, name: str) -> list[int]:
        """Elements with an id, a class or (without a sign) a tag."""
        if sign + name not in self.by:
            if sign == "#":
                found = [i for i, r in enumerate(self.rows) if r[5] and self.fold(r[5]) == name]
            elif sign == ".":
                found = [i for i, r in enumerate(self.rows) if r[6] and name in map(self.fold, r[6])]
            else:
                found = [i for i, r in enumerate(self.rows) if r[4] == name]
            self.by[sign + name] = found
        return self.by[sign + name]

    def match(self, steps: tuple, k: int, i: int, anchor: int | None) -> int:
        """Status of element i against the first k + 1 steps; anchor: the element that the first step's combinator starts from."""
        key = (steps, k, i, anchor)
        inner = k < len(steps) - 1  # the last step is asked for once an element
        if inner and key in self.known:
            return self.known[key]
        own, joint = self.compound(steps[k][1], i), steps[k][0]
        if own != NO and joint == "~":
            own = min(own, self.among_earlier(steps, k, i, anchor))
        elif own != NO and (k or joint):
            best = NO
            for j in self.left_of(joint, i):
                there = (EXACT if j == anchor else NO) if not k else self.match(steps, k - 1, j, anchor)
                best = max(best, there)
                if best == EXACT:
                    break
            own = min(own, best)
        if inner:
            self.known[key] = own
        return own

    def among_earlier(self, steps: tuple, k: int, i: int, anchor: int | None) -> int:
        """The best status of an earlier sibling against what stands before step k; a family's is kept up to each of its places."""
        if not k:
            return EXACT if anchor is not None and self.parent[anchor] == self.parent[i] and self.nth[anchor] < self.nth[i] else NO
        family, best = self.siblings(i), self.best.setdefault((steps, k, self.parent[i], anchor), [NO])
        while len(best) <= self.nth[i]:
            best.append(max(best[-1], self.match(steps, k - 1, family[len(best) - 1], anchor)))
        return best[self.nth[i]]

    def among_later(self, parts: tuple, i: int) -> int:
        """The best status of a later sibling against a compound; a family's is kept after each of its places."""
        key = (parts, self.parent[i])
        if key not in self.best:
            best = [NO]
            for j in reversed(self.siblings(i)):
                best.append(max(best[-1], self.compound(parts, j)))
            self.best[key] = best[-2::-1]
        return self.best[key][self.nth[i]]

    def left_of(self, joint: str, i: int):
        if joint == "+":
            if self.nth[i]:
                yield self.siblings(i)[self.nth[i] - 1]
            return
        i = self.parent[i]
        while i >= 0:
            yield i
            i = self.parent[i] if joint == " " else -1

    def compound(self, parts: tuple, i: int) -> int:
        status = EXACT
        for part in parts:
            status = min(status, self.part(part, i))
            if status == NO:
                break
        return status

    def part(self, part: str, i: int) -> int:
        _, _, _, _, tag, own_id, classes, _, _ = self.rows[i]
        sign = part[0]
        if sign == "#":
            return EXACT if own_id is not None and self.fold(own_id) == self.fold(part[1:]) else NO
        if sign == ".":
            return EXACT if self.fold(part[1:]) in map(self.fold, classes or ()) else NO
        if sign == "[":
            return self.attribute(part, i)
        if part.startswith("::"):
            return UNKNOWN if part.startswith(("::part", "::slotted")) else EXACT  # the element that it comes from
        if sign == ":":
            name, _, inner = part[1:].partition("(")
            return self.state(name.lower(), inner[:-1] if inner.endswith(")") else inner, i)
        name = part.rpartition("|")[2]
        if name == "*":
            return EXACT
        if not re.fullmatch(r"[\w-]+", name):
            return UNKNOWN
        return EXACT if tag.lower() == name.lower() else NO

    def attribute(self, part: str, i: int) -> int:
        if not (test := _test(part)):
            return UNKNOWN
        name, operator, want, flag = test
        held = (self.rows[i][7] or {}).get(name)
        if held is None:
            return NO
        if operator is None:
            return EXACT
        if len(held) >= LONG_VALUE:
            return UNKNOWN
        if flag == "i" or flag != "s" and name in CASELESS:
            held, want = held.lower(), want.lower()
        fits = {"=": held == want, "~=": bool(want) and want in re.split(r"[ \t\n\f\r]+", held), "|=": held == want or held.startswith(f"{want}-"), "^=": bool(want) and held.startswith(want), "$=": bool(want) and held.endswith(want), "*=": bool(want) and want in held}
        return EXACT if fits[operator] else NO

    def any_of(self, selectors: str, i: int) -> int:
        each = [compiled(x) for x in selector_list(selectors)]
        return max((self.match(s, len(s) - 1, i, None) for s in each if s), default=UNKNOWN if not each else NO)

    def state(self, name: str, inner: str, i: int) -> int:
        sure = lambda x: EXACT if x else NO
        now = lambda x: COND if x else NO  # noqa: E731  true as the page is written, and may change
        tag, found = self.rows[i][4].lower(), self.rows[i][7] or {}
        if name == "not":
            status = self.any_of(inner, i)
            return {EXACT: NO, NO: EXACT}.get(status, status)
        if name in ("is", "where", "matches", "-webkit-any", "-moz-any"):
            return self.any_of(inner, i)
        if name == "has":
            return max((self.has(s, i) for s in map(compiled, selector_list(inner)) if s), default=NO)
        if name in ("root", "scope"):
            return sure(self.parent[i] < 0 and (tag == "html" or not any(self.rows[j][4] == "html" for j in self.top)))
        if name == "empty":
            return sure(not self.kids[i] and not (self.rows[i][8] or ""))
        if name.endswith(("-child", "-of-type")):
            return self.place(name, inner, i)
        if name in ("link", "any-link", "visited", "local-link"):
            return (COND if name in ("visited", "local-link") else EXACT) if tag in ("a", "area") and "href" in found else NO
        if name == "lang":
            want, j = inner.split(",")[0].strip().strip("\"'").lower(), i
            while j >= 0 and "lang" not in (self.rows[j][7] or {}):
                j = self.parent[j]
            own = self.rows[j][7]["lang"].lower() if j >= 0 else ""
            return UNKNOWN if not own else sure(want == "*" or own == want or own.startswith(f"{want}-"))
        if name == "defined":
            return EXACT
        if name in ("checked", "default"):
            return now(tag == "option" and "selected" in found or tag == "input" and found.get("type", "").lower() in ("checkbox", "radio") and "checked" in found)
        if name in ("disabled", "enabled"):
            return now(tag in FORM_PARTS and ("disabled" in found) == (name == "disabled"))
        if name in ("required", "optional"):
            return now(tag in ("input", "select", "textarea") and ("required" in found) == (name == "required"))
        if name in ("read-write", "read-only"):
            writable = tag in ("input", "textarea") and not {"readonly", "disabled"} & set(found) or found.get("contenteditable", "false") != "false"
            return now(writable == (name == "read-write"))
        if name == "placeholder-shown":
            return now(tag in ("input", "textarea") and "placeholder" in found and not found.get("value"))
        if name == "indeterminate":
            return now(tag == "progress" and "value" not in found)
        if name in ("open", "closed"):
            return now(tag in ("details", "dialog") and ("open" in found) == (name == "open"))
        if name in ("host", "host-context"):
            return UNKNOWN
        if name in ("before", "after", "first-line", "first-letter"):
            return EXACT
        return UNKNOWN if inner else COND  # a state of the running page

    def has(self, steps: tuple, i: int) -> int:
        """Relative to element i: the argument's first combinator starts from it, and nothing above it takes part."""
        joint = steps[0][0] or " "
        steps = ((joint, steps[0][1]), *steps[1:])
        if joint in (" ", ">"):
            scope = self.kids[i] if joint == ">" and len(steps) == 1 else self.below(i)
        elif joint == "~" and len(steps) == 1:
            return self.among_later(steps[0][1], i)
        else:
            family = self.siblings(i)
            # what a next sibling begins lies below it or, by a further + or ~, beside it
            near = joint == "+" and not any(own in ("+", "~") for own, _ in steps[1:])
            after = range(self.nth[i] + 1, min(self.nth[i] + 2, len(family)) if near else len(family))
            inner = len(steps) > 1
            scope = (x for n in after for x in (family[n], *(self.below(family[n]) if inner else ())))
        best = NO
        for x in scope:
            best = max(best, self.match(steps, len(steps) - 1, x, i))
            if best == EXACT:
                break
        return best

    def place(self, name: str, inner: str, i: int) -> int:
        formula, _, among = inner.partition(" of ")
        status = self.any_of(among, i) if among else EXACT
        if status == NO:
            return NO
        key = (self.parent[i], self.rows[i][4] if name.endswith("-of-type") else None, among)
        if key not in self.places:
            self.places[key] = self.counted(*key)
        unsure, sure, total = self.places[key]
        if unsure - (status != EXACT):
            return UNKNOWN
        first = sure[self.nth[i]] + 1
        last = total - first + 1 + (status != EXACT)
        size = first + last - 1
        kind = name.removesuffix("-child").removesuffix("-of-type")
        if kind in ("first", "last", "only"):
            return status if {"first": first == 1, "last": last == 1, "only": size == 1}[kind] else NO
        steps = steps_of(formula)
        if steps is None or kind not in ("nth", "nth-last"):
            return UNKNOWN
        a, b = steps
        n = (first if kind == "nth" else last) - b
        return status if (n == 0 if a == 0 else n % a == 0 and n // a >= 0) else NO

    def counted(self, parent: int, tag: str | None, among: str) -> tuple[int, list[int] | range, int]:
        """Of a family (of one tag, if given): how many may be among some selectors, how many surely are before each place, and in all."""
        family = self.kids[parent] if parent >= 0 else self.top
        if tag is None and not among:
            return 0, range(len(family)), len(family)
        unsure, before, n = 0, [], 0
        for j in family:
            before.append(n)
            if tag is None or self.rows[j][4] == tag:
                own = self.any_of(among, j) if among else EXACT
                unsure += own in (UNKNOWN, COND)
                n += own == EXACT
        return unsure, before, n
