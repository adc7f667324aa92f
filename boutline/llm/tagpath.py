"""Main text of web pages by tag-path ratios.

Every text node has a root-to-leaf tag path. Per path the page's text length and punctuation are added up and divided by the
number of its nodes; both ratios are smoothed over the paths in page order and fused by a geometric mean. Tags are one more feature: a
path inside an article or main element weighs ``MAIN_WEIGHT`` times its ratio. Paths at or above a share of the weights' root mean
square are content; this decides on every page. An article or main element with a content path is taken whole, and so are those
beside it, however short. Content paths outside of them are taken as they are. If all content is outside, the deepest element
around it is taken whole; if that is the whole page, headings, paragraphs, quotes and preformatted blocks go with the content paths.
What tags, roles or class names mark as page furniture is left out before; an article or main element is dropped for a class that names
reader comments only.

A page is one row and is handled on its own, so nothing is shuffled. Defined cases: null, empty or text-free html gives an empty text;
text outside any element counts as a block; unclosed and stray tags are closed or skipped as browsers do; repeated rows are
repeated results. Only the named column is read.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, unpacked

# Element names of HTML by their role, and words that mark page furniture in class names and ids.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("head title nav header footer aside form menu dialog button select option optgroup datalist fieldset legend input object svg canvas audio video map noembed noframes".split())
RAW = "script|style|noscript|template|textarea|iframe|xmp"
SECTIONS = frozenset("article main nav header footer aside section body".split())
MAIN = frozenset("article main".split())
FURNITURE = frozenset(
    """ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright
    disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pager
    pagination popup promo promoted promotion recommended related replies reply respond response responses search share sharing sidebar signup
    skyscraper social sponsor sponsored subscribe subscription toolbar widget""".split()
)
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond response responses".split())
ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation note search status toolbar".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"]),
}
LISTS = frozenset("ul ol dl table select".split())
MAIN_WEIGHT = 8.0
LIFT = 16.0
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？¿¡]")

_MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|\Z))",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _furniture(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is page furniture, and its class for the path."""
    if tag in SKIPPED:
        return True, ""
    if "=" not in attrs:
        return bool(re.search(r"(?:^|\s)hidden(?:\s|/|>|$)", attrs)), ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attrs)}
    kind = found.get("class", "")
    if tag in ("html", "body"):
        return False, kind
    if found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True, kind
    if re.search(r"\shidden(?:\s|/|>|$)", attrs):
        return True, kind
    for word in f"{kind} {found.get('id', '')}".split():
        parts = re.split(r"[-_]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower())
        listed = COMMENTS if tag in MAIN else FURNITURE
        if parts[0] not in ("has", "with", "no") and (parts[0] in listed or parts[-1] in listed):
            return True, kind
    return False, kind


class _Element:
    """``no`` counts elements in page order and ``end`` is the next number when the element is closed: what lies inside has numbers in between."""

    __slots__ = ("tag", "path", "parent", "off", "main", "no", "end", "depth", "para", "block")

    def __init__(self, tag: str, path: int, off: bool, parent: _Element | None, no: int):
        self.tag, self.path, self.parent, self.no, self.end = tag, path, parent, no, 1 << 62
        self.off = off or (parent is not None and parent.off)
        self.main = self if tag in MAIN and not self.off and not (parent and parent.main) else (parent.main if parent else None)
        self.depth = parent.depth + 1 if parent else 0
        # the open paragraph a block closes, and the nearest element that is no inline one
        self.para = self if tag == "p" else None if tag in SECTIONS or not parent else parent.para
        self.block = self if tag not in INLINE or not parent else parent.block


def _blocks(html: str) -> list[tuple[_Element, str]]:
    """Blocks in page order: the element that holds the block's text, and its text with single spaces."""
    root = _Element("", 0, False, None, 0)
    stack, out, run, at = [root], [], [], 0
    owner = root
    paths: dict[tuple[int, str, str], int] = {}
    opened: dict[str, int] = {}
    made = 1

    def close(depth: int):
        for e in stack[depth:]:
            e.end = made
            opened[e.tag] -= 1
        del stack[depth:]

    def flush():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append((owner, text))

    def add(raw: str, decode: bool = True):
        nonlocal owner
        if raw and not stack[-1].off:
            if not run:
                owner = stack[-1].block
            run.append(entities.unescape(raw) if decode and "&" in raw else raw)

    for m in _MARKUP.finditer(html):
        add(html[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(m["cdata"], False)
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        flush()
                    close(i)
                    break
                if stack[i].tag in SECTIONS and tag not in SECTIONS and tag != "html":
                    break
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        attrs = m["attrs"]
        if tag not in INLINE:
            stops = CLOSED_BY.get(tag)
            if not stops and stack[-1].para:
                close(stack[-1].para.depth)
            for i in range(len(stack) - 1, 0, -1) if stops and any(opened.get(t) for t in stops) else ():
                open_tag = stack[i].tag
                if open_tag in stops:
                    close(i)
                    if tag != "tr":
                        break
                elif open_tag in SECTIONS or open_tag in LISTS:
                    break
        if tag in MAIN:  # an article never lies in an advert or list that was left open
            while len(stack) > 1 and stack[-1].off and stack[-1].tag not in SECTIONS:
                close(len(stack) - 1)
        off, kind = _furniture(tag, attrs)
        if not attrs.rstrip(">").endswith("/") or tag not in ("br", "hr"):
            path = paths.setdefault((stack[-1].path, tag, kind), len(paths) + 1)
            stack.append(_Element(tag, path, off, stack[-1], made))
            opened[tag] = opened.get(tag, 0) + 1
            made += 1
    add(html[at:])
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    """Weights 1, 2, 1 over neighbours in page order; neighbours lift a value to at most ``LIFT`` times its own, so that a short text beside a
    very long one does not pass for one."""
    n = len(values)
    return [min((values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4, LIFT * values[i]) for i in range(n)]


def path_weights(blocks: list[tuple[int, str, bool]]) -> dict[int, float]:
    """Weight of every path of (path, text, whether inside a main element): smoothed and fused ratios, times the tag feature."""
    paths: dict[int, list[float]] = {}
    for path, text, inside in blocks:
        p = paths.setdefault(path, [0, 0, 0, inside])
        p[0] += len(text)
        p[1] += len(PUNCTUATION.findall(text))
        p[2] += 1
    length = _smooth([p[0] / p[2] for p in paths.values()])
    marks = _smooth([p[1] / p[2] for p in paths.values()])
    return {path: math.sqrt(x * (y + 1)) * (MAIN_WEIGHT if p[3] else 1.0) for (path, p), x, y in zip(paths.items(), length, marks)}


def main_text(html: str | None, share: float = 0.5) -> str:
    """Main text of one page; ``share`` of the weights' root mean square is the threshold."""
    blocks = _blocks(html or "")
    if not blocks:
        return ""
    weights = path_weights([(e.path, t, e.main is not None) for e, t in blocks])
    threshold = share * math.sqrt(sum(v * v for v in weights.values()) / len(weights))
    content = [e for e, _ in blocks if weights[e.path] >= threshold]
    around = {e.main.parent for e in content if e.main}
    if around:
        return " ".join(t for e, t in blocks if (e.main.parent in around if e.main else weights[e.path] >= threshold))
    first, last = min(content, key=lambda e: e.no), max(content, key=lambda e: e.no)
    container = first
    while container.end <= last.no:
        container = container.parent
    if container.tag in ("", "html", "body"):
        return " ".join(t for e, t in blocks if weights[e.path] >= threshold or re.fullmatch(r"h[1-6]|p|blockquote|pre", e.tag))
    return " ".join(t for e, t in blocks if container.no <= e.no < container.end)


def extract(pages: DataFrame, column: str = "html", carry: list[str] | None = None, share: float = 0.5) -> DataFrame:
    """``carry`` columns plus ``text`` and ``n_chars`` of every page."""
    rows = pages.select(carried(carry), F.col(column).alias("html"))
    schema = rows.select("row").schema.add("text", "string").add("n_chars", "long")

    def run(batches):
        for batch in batches:
            texts = [main_text(h, share) for h in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "text", "n_chars"])

    return rows.mapInArrow(run, schema).select(*unpacked(carry), "text", "n_chars")
