"""From one review page to raw container records, in one pass over its tags.

No tree is built: the standard library's parser sends events, a stack holds
the open elements, and each open container gathers its own text and the first
of each kind of nested element it needs.  What is held at a time is the stack
and the containers of the page.

Rules for broken markup: an end tag closes the nearest open element of that
name with all that is open inside it, and is ignored when none is open; void
elements never hold anything; whatever is open at the end ends there.  Text of
comments and of script, style and template elements is left out; CDATA
sections are text.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# --- Fixed values: these must equal the behaviour being reproduced. ---------
# Elements without an end tag, the obsolete ones included.
VOID = frozenset((
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer").split())
# Elements whose text is not text of the page.
HIDDEN_TEXT = frozenset(("script", "style", "template"))
# -----------------------------------------------------------------------------


class Container:
    """What an open container has gathered so far."""

    __slots__ = ("attrs", "depth", "pos", "texts", "div", "a_url", "timed", "time_href", "a_review")

    def __init__(self, attrs: dict[str, str], depth: int, pos: int):
        self.attrs, self.depth, self.pos = attrs, depth, pos
        self.texts: list[str] = []
        self.div = self.a_url = self.time_href = self.a_review = None
        self.timed = False


def _matches(tag: str, attrs: dict[str, str], selector) -> bool:
    name, attr, part = selector
    if tag != name:
        return False
    if attr is None:
        return True
    v = attrs.get(attr)
    return v is not None and (part is None or part in v)


class ContainerWalk(HTMLParser):
    """Collects the containers of a page: every ``article`` with the primary
    attribute; while none was met, every element matching one of the fallback
    selectors (tag, attribute or None, substring or None)."""

    def __init__(self, primary_attr: str, fallback):
        super().__init__(convert_charrefs=True)
        self.primary_attr, self.fallback = primary_attr, fallback
        self.primary = False  # whether a primary container was met
        self.found: list[Container] = []  # in document order
        self._open: list[Container] = []
        self._stack: list[tuple[str, str | None]] = []  # (tag, href of a link)
        self._names: Counter[str] = Counter()
        self._hidden: list[int] = []  # depths of the open elements of hidden text

    def _is_container(self, tag: str, attrs: dict[str, str]) -> bool:
        if tag == "article" and self.primary_attr in attrs:
            if not self.primary:
                self.primary, self.found, self._open = True, [], []
            return True
        return not self.primary and any(_matches(tag, attrs, s) for s in self.fallback)

    def _note(self, tag: str, attrs: dict[str, str]) -> None:
        """A nested element, for the containers around it: the first counts."""
        href = attrs.get("href", "") if tag == "a" else ""
        for c in self._open:
            if tag == "div" and c.div is None and self.primary_attr in attrs:
                c.div = attrs[self.primary_attr]
            elif tag == "a":
                if c.a_url is None and "data-review-url" in attrs:
                    c.a_url = attrs["data-review-url"]
                if c.a_review is None and "/reviews/" in href:
                    c.a_review = href
            elif tag == "time" and not c.timed and "datetime" in attrs:
                c.timed = True
                c.time_href = next((h for t, h in reversed(self._stack) if t == "a" and h is not None), None)

    def _begin(self, tag: str, attrs, closed: bool) -> None:
        a = {k: "" if v is None else v for k, v in attrs}  # of repeated attributes the last counts
        if self._open:
            self._note(tag, a)
        depth, holds = len(self._stack), not closed and tag not in VOID
        if self._is_container(tag, a):
            c = Container(a, depth, len(self.found))
            self.found.append(c)
            if holds:
                self._open.append(c)
        if holds:
            self._stack.append((tag, a.get("href") if tag == "a" else None))
            self._names[tag] += 1
            if tag in HIDDEN_TEXT:
                self._hidden.append(depth)

    def handle_starttag(self, tag, attrs):
        self._begin(tag, attrs, False)

    def handle_startendtag(self, tag, attrs):
        self._begin(tag, attrs, True)

    def handle_endtag(self, tag):
        if not self._names[tag]:
            return
        name = None
        while name != tag:
            name, _ = self._stack.pop()
            self._names[name] -= 1
        depth = len(self._stack)
        while self._hidden and self._hidden[-1] >= depth:
            self._hidden.pop()
        while self._open and self._open[-1].depth >= depth:
            self._open.pop()

    def handle_data(self, data):
        text = data.strip() if self._open else ""
        if text:
            for c in self._open:
                if not self._hidden or self._hidden[-1] < c.depth:
                    c.texts.append(text)

    def unknown_decl(self, data):
        if data.upper().startswith("CDATA["):
            self.handle_data(data[len("CDATA["):])


def containers(html: str, primary_attr: str, fallback) -> list[Container]:
    """The containers of a page, in document order."""
    walk = ContainerWalk(primary_attr, fallback)
    walk.feed(html)
    walk.close()
    return walk.found


def container_record(c: Container, primary_attr: str) -> dict:
    """Raw fields of one container; the id and rating rules run in Spark."""
    return {
        "testo": " ".join(c.texts),
        "rating_attr": c.attrs.get(primary_attr),
        "rating_div": c.div,
        "m1_url": c.a_url,
        "m2_id": c.attrs.get("data-service-review-id"),
        "m3_href": c.time_href,
        "m4_href": c.a_review,
        "m5_id": c.attrs.get("data-consumer-review-id"),
    }


def page_records(html: str | None, primary_attr: str, fallback) -> list[tuple[int | None, dict | None, str | None]]:
    """(pos, record, error) of each container of one page.  A container that
    cannot be read has an error instead of a record; a page without containers
    gives one row without pos, with an error if it could not be parsed."""
    try:
        found = containers(html or "", primary_attr, fallback)
    except Exception as e:  # a malformed page is reported, the crawl goes on
        return [(None, None, f"page: {type(e).__name__}: {e}")]
    out = []
    for c in found:
        try:
            out.append((c.pos, container_record(c, primary_attr), None))
        except Exception as e:
            out.append((c.pos, None, f"container: {type(e).__name__}: {e}"))
    return out or [(None, None, None)]
