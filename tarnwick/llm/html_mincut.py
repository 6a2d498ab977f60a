"""Main text of web pages by minimum-cut labelling.

A page becomes text blocks in page order. A linear classifier gives each block log odds of content from features of bounded
size: the text's length, links and end, its element, the elements and class words around it, and whether the page's article holds it. The
log odds are the capacities to the two terminals. Neighbouring blocks, and blocks of one container, are joined by
smoothness edges, the stronger the nearer they are in the DOM and the more their elements are alike. The minimum cut, found by
maximum flow, labels all blocks at once: a short block amid content stays, a long one amid boilerplate goes.

The classifier starts from prior weights and is fitted to the pages themselves, at most about SAMPLE of them, chosen by a
hash: on pages with an article or main element, what it holds, without the site elements in it, counts as content and all else
as boilerplate. Each weight moves from its prior towards the log odds of its feature, by at most SHIFT. Class words of html and body, and of
elements around the article or headline, say nothing, as they describe the page.

Defined results: null, empty and text-less pages give an empty text; unclosed and stray tags are tolerated as browsers do, so an
unclosed svg or math ends at the next block, an unclosed button or object shows its content, and other unclosed elements without text end with
the element around them;
white space (also non-breaking) inside a block is one space; blocks hidden from readers, comments, scripts and styles
are no text; repeated rows give equal rows; an empty table gives an empty result; further columns are carried
through `extract`, where a column named as the result is replaced; time and memory grow with a page's length, however deep its elements are.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm.common import table

_ATTRS = r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)"
# Raw text runs to its end tag, or to the end of the page, as in browsers.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|iframe|textarea|title)(?=[\s/>])" + _ATTRS.replace("(", "(?:", 1) + r">.*?(?:</\1(?=[\s/>])[^>]*>|\Z)|<(/?)([a-zA-Z][\w:-]*)" + _ATTRS + r">|<[!?/][^>]*>|[^<]+|<", re.S | re.I)
# Elements whose content is no text of the page; an unclosed button or object shows its content.
_DROPPED = frozenset("template svg object select button math canvas audio video".split())
_FOREIGN, _SHOWN = frozenset(("svg", "math")), frozenset(("button", "object"))
_DROPS = re.compile(r"<(?:template|svg|object|select|button|math|canvas|audio|video)(?=[\s/>])", re.I)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")
# Elements that begin and end blocks.
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_ENDING = frozenset("li dt dd tr td th option".split())
#: Characters of the longest feature that is counted; a longer class word says nothing.
LONG = 60
_SITE = frozenset("nav aside form menu dialog footer".split())
# Words of class, id and role that mark what isn't the article.
_BAD = frozenset("nav navbar navigation menu sidebar aside footer banner cookie cookies consent gdpr notice alert ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply replies respond disqus share sharing social related recommended recommendations subscribe newsletter signup login register breadcrumb breadcrumbs pagination pager popup modal overlay widget copyright legal disclaimer tags tagcloud toolbar search contentinfo complementary masthead topbar skip outbrain taboola dialog rail".split())
_HEAD = frozenset("header head".split())
_GOOD = frozenset("article articlebody content entry post story body main text page blog prose".split())
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Edges: of neighbouring blocks in like elements of one container and in others, their decay with the distance in the DOM, and of blocks of one container.
LIKE, UNLIKE, NEAR, SAME = 3.0, 0.8, 0.6, 0.5
#: Log odds of being in the page's article or main element, or out of it on a page that has one; most that the text's own features say.
STORY, TEXT = 3.0, 3.0
#: Most and least log odds of the containers.
BEST, WORST = 2.0, -9.0
#: Pages fitted to, about; how far a weight goes from its prior; pages of a feature that weigh as much as the prior.
SAMPLE, SHIFT, PRIOR_PAGES = 20_000, 1.5, 50
_LENGTHS = 11
PRIOR = (
    {f"length:{k}": round(min(1.5 * 2**k / 80, 2.0) - 0.6, 3) for k in range(_LENGTHS)}
    | {"tag:p": 1.2, "tag:h1": 1.0, "tag:h2": 0.8, "tag:h3": 0.6, "tag:blockquote": 0.8, "tag:pre": 0.8, "tag:li": -0.2}
    | {"end:stop": 0.4, "link:some": -0.5, "link:most": -3.5, "mark:copyright": -3.0}
    | {f"in:{t}": -8.0 for t in sorted(_SITE)}
    | {"in:header": -8.0, "word:banner": -6.0}
    | {f"word:{w}": -6.0 for w in sorted(_BAD)}
    | {f"word:{w}": -5.0 for w in sorted(_HEAD)}
    | {f"word:{w}": 1.5 for w in sorted(_GOOD)}
)


class _Tree:
    """Elements of a page, numbered as they open."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.words, self.hide = ["#page"], [0], [0], [frozenset()], [False]

    def open(self, tag: str, attrs: str, up: int) -> int:
        words: set[str] = set()
        hide = self.hide[up]
        if attrs:
            for m in _ATTR.finditer(attrs):
                key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or key == "style" and _HIDDEN.search(value):
                    hide = True
                elif key in ("class", "id", "role", "itemprop"):
                    words.update(_NAME.findall(_CAMEL.sub(r"\1 \2", value).lower()))
        self.tag.append(tag)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.words.append(frozenset(words))
        self.hide.append(hide)
        return len(self.tag) - 1


def _closed(tokens: list[re.Match]) -> set[int]:
    """Places of the dropped elements that end with their own end tag, not with an element around them."""
    stack, out, open_ = [], set(), Counter()
    for k, m in enumerate(tokens):
        tag = (m[3] or "").lower()
        if tag not in _BLOCKS and tag not in _DROPPED:
            continue
        if not m[2]:
            if _opens(tag, m[4]):
                stack.append((tag, k))
                open_[tag] += 1
            continue
        while open_[tag]:
            top, at = stack.pop()
            open_[top] -= 1
            if top == tag:
                if tag in _DROPPED:
                    out.add(at)
                break
    return out


def _opens(tag: str, attrs: str) -> bool:
    """Whether a start tag leaves its element open."""
    return tag not in _VOID and not (attrs.endswith("/") and (tag in _BLOCKS or tag in _FOREIGN))


class Block:
    """A text block: its text, element, tag and share of linked characters."""

    __slots__ = ("box", "linked", "tag", "text")

    def __init__(self, text: str, box: int, tag: str, linked: float):
        self.text, self.box, self.tag, self.linked = text, box, tag, linked


def parse(page: str) -> tuple[list[Block], _Tree]:
    """The page's visible blocks in order, and its elements."""
    tree = _Tree()
    stack, open_ = [0], Counter()
    out: list[Block] = []
    parts: list[str] = []
    linked, links, tag_of = 0, 0, "#page"

    def flush():
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text and not tree.hide[stack[-1]]:
                out.append(Block(text, stack[-1], tag_of, min(1.0, linked / max(1, len(raw)))))
            parts, linked = [], 0

    def close(tag: str) -> None:
        while open_[tag]:
            top = tree.tag[stack.pop()]
            open_[top] -= 1
            if top == tag:
                break

    tokens, closed = _TOKEN.finditer(page), set()
    if _DROPS.search(page):
        tokens = list(tokens)
        closed = _closed(tokens)
    hidden: list[str] = []  # the open dropped element and what is open in it
    inside: Counter = Counter()
    breaks = False  # an unclosed svg or math ends at the next block
    for k, m in enumerate(tokens):
        name = m[3]
        if name is None:
            s = m[0]
            if not hidden and (s[0] != "<" or s == "<"):
                parts.append(s)
                if links:
                    linked += len(s)
            continue
        tag = name.lower()
        if hidden:
            if m[2] and inside[tag]:
                while inside[tag]:
                    top = hidden.pop()
                    inside[top] -= 1
                    if top == tag:
                        break
                continue
            if m[2] and open_[tag] or not m[2] and breaks and tag in _BLOCKS:
                hidden, inside = [], Counter()
            else:
                if not m[2] and (tag in _BLOCKS or tag in _DROPPED) and _opens(tag, m[4]):
                    hidden.append(tag)
                    inside[tag] += 1
                continue
        if tag in _DROPPED:
            if not m[2] and _opens(tag, m[4]) and (k in closed or tag not in _SHOWN):
                hidden, inside, breaks = [tag], Counter([tag]), k not in closed and tag in _FOREIGN
            continue
        if tag not in _BLOCKS:
            if tag == "a":
                links = 0 if m[2] else 1
            elif tag == "br":
                parts.append(" ")
            elif tag == "head" and not m[2]:
                parts, linked = [], 0
            continue
        flush()
        if m[2]:
            close(tag)
            tag_of = tree.tag[stack[-1]]
        else:
            tag_of = tag
            if tag not in _VOID and not m[4].endswith("/"):
                top = tree.tag[stack[-1]]
                if top == "p" or tag == top and tag in _SELF_ENDING:  # a block ends an open paragraph, an item the item before
                    close(top)
                stack.append(tree.open(tag, m[4], stack[-1]))
                open_[tag] += 1
    flush()
    return out, tree


def blocks(page: str) -> list[str]:
    """Texts of the page's visible blocks."""
    return [b.text for b in parse(page)[0]]


def _stories(found: list[Block], tree: _Tree) -> tuple[list[bool], list[bool], bool]:
    """By element: whether the page's article or main element holds it, and whether it holds an article or headline; and whether the page has an article."""
    n = len(tree.tag)
    core, mass = [t in ("article", "main", "h1") for t in tree.tag], [0] * n
    for b in found:
        mass[b.box] += len(b.text)
    around, has = [False] * n, any(core)
    for e in range(n - 1, 0, -1):
        up = tree.parent[e]
        mass[up] += mass[e]
        around[up] = around[up] or around[e] or core[e]
    if not has:  # without any mark, what holds most of the text is no part of the site
        around = [2 * m > mass[0] for m in mass]
    story = [False] * n
    for e in range(1, n):
        own = tree.tag[e] in ("article", "main") and mass[e] > 0 and (around[e] or not tree.words[e] & _BAD)
        story[e] = story[tree.parent[e]] or own
    return story, around, any(story[b.box] for b in found)


def _marks(tree: _Tree, story: list[bool], around: list[bool]) -> list[list[str]]:
    """Features of each element by itself."""
    out: list[list[str]] = [[]]
    for e in range(1, len(tree.tag)):
        tag, mine = tree.tag[e], []
        if tag in _SITE or tag == "header" and not story[e]:
            mine.append(f"in:{tag}")
        elif tag not in ("html", "body"):
            good = tree.words[e] & _GOOD
            for w in sorted(tree.words[e]):
                if w in _BAD and around[e] or w in _HEAD and (good or story[e] or tag in ("h1", "h2")):
                    continue
                mine.append(f"word:{w}")
        out.append(mine)
    return out


def _own(b: Block, inside: bool) -> list[str]:
    """Features of a block's text."""
    out = [f"length:{min(len(b.text).bit_length() - 1, _LENGTHS - 1)}", f"tag:{b.tag}"]
    if b.text[-1] in ".!?…\"'”»:":
        out.append("end:stop")
    if b.linked:
        out.append("link:most" if b.linked > 0.5 else "link:some")
    if not inside and b.text[0] == "©":
        out.append("mark:copyright")
    return out


def costs(found: list[Block], tree: _Tree, weights: dict[str, float]) -> list[float]:
    """Log odds of content of the blocks."""
    story, around, has = _stories(found, tree)
    box = [0.0] * len(tree.tag)
    for e, mine in enumerate(_marks(tree, story, around)):
        if e:
            worst = min((weights.get(f, 0.0) for f in mine), default=0.0)
            best = max((weights.get(f, 0.0) for f in mine), default=0.0)
            box[e] = max(WORST, min(BEST, box[tree.parent[e]] + (worst if worst < 0 else best)))
    out = []
    for b in found:
        inside = story[b.box]
        text = sum(weights.get(f, 0.0) for f in _own(b, inside))
        out.append(max(-TEXT, min(TEXT, text)) + box[b.box] + (0.0 if not has else STORY if inside else -STORY))
    return out


def fitted(counts: dict[str, tuple[int, int]], totals: tuple[int, int]) -> dict[str, float]:
    """Weights from the prior and, for each feature, the blocks out of and in articles that have it."""
    out = dict(PRIOR)
    for f, (out_, in_) in counts.items():
        odds = math.log((in_ + 1) / (totals[1] + 2)) - math.log((out_ + 1) / (totals[0] + 2))
        prior, seen = PRIOR.get(f, 0.0), out_ + in_
        w = (PRIOR_PAGES * prior + seen * odds) / (PRIOR_PAGES + seen)
        out[f] = round(max(prior - SHIFT, min(prior + SHIFT, w)), 6)
    return out


def _counts(html_col: str):
    """Per batch: by feature, the blocks out of and in articles that have it; feature "" counts all."""

    def run(batches):
        for batch in batches:
            by: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for page in batch.column(html_col).to_pylist():
                found, tree = parse(page or "")
                story, around, has = _stories(found, tree)
                if not has:
                    continue
                marks = _marks(tree, story, around)
                site = [False] * len(tree.tag)
                for e in range(1, len(tree.tag)):
                    site[e] = site[tree.parent[e]] or any(f.startswith("in:") for f in marks[e])
                for b in found:
                    y = int(story[b.box] and not site[b.box])
                    by[""][y] += 1
                    for f in {*_own(b, story[b.box]), *(f for f in marks[b.box] if len(f) < LONG)}:
                        by[f][y] += 1
            if by:
                yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), *(pa.array([c[y] for c in by.values()], pa.int64()) for y in (0, 1))], names=["f", "n0", "n1"])

    return run


def fit(pages: DataFrame, html_col: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights fitted to about sample pages. Features in at least PRIOR_PAGES of their blocks, at most some thousands, reach the driver."""
    n = pages.count()
    some = pages.select(html_col).where(F.pmod(F.xxhash64(html_col, F.lit(41)), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30)))
    rows = some.mapInArrow(_counts(html_col), "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where((F.col("n0") + F.col("n1") >= PRIOR_PAGES) | (F.col("f") == "")).collect()
    counts = {r.f: (r.n0, r.n1) for r in rows}
    return fitted(counts, totals) if (totals := counts.pop("", None)) and min(totals) else dict(PRIOR)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels that minimise the sum of |gain| over nodes labelled against their sign and of the edges that are cut."""
    n = len(gain)
    label = [g > 0 for g in gain]
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    # a node whose terminal capacity exceeds its edges keeps its own label in every minimum cut
    gain, fixed, queue = list(gain), [False] * n, deque(range(n))
    while queue:
        i = queue.popleft()
        if fixed[i] or abs(gain[i]) <= sum(w for j, w in around[i] if not fixed[j]):
            continue
        fixed[i], label[i] = True, gain[i] > 0
        for j, w in around[i]:
            if not fixed[j]:
                gain[j] += w if label[i] else -w
                queue.append(j)
    free = [i for i in range(n) if not fixed[i]]
    if free and len({gain[i] > 0 for i in free}) == 1:
        for i in free:  # all want one label, and nothing pulls them apart
            label[i] = gain[i] > 0
    elif free:
        side = _source_side(free, gain, around, fixed)
        for i in free:
            label[i] = i in side
    return label


def _source_side(free: list[int], gain: list[float], around: list[list[tuple[int, float]]], fixed: list[bool]) -> set[int]:
    """Free nodes on the content side of a minimum cut: maximum flow by level graphs, paths found depth first."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {i: {} for i in (*free, s, t)}
    for i in free:
        if gain[i] > 0:
            cap[s][i], cap[i][s] = gain[i], 0.0
        elif gain[i] < 0:
            cap[i][t], cap[t][i] = -gain[i], 0.0
        for j, w in around[i]:
            if not fixed[j]:
                cap[i][j] = cap[i].get(j, 0.0) + w
    tiny = 1e-9
    while True:
        level, queue = {s: 0}, deque([s])
        while queue:
            u = queue.popleft()
            for v, c in cap[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if t not in level:
            return {i for i in free if i in level}
        rest = {u: iter(list(cap[u])) for u in level}
        path = [s]
        while path:
            u = path[-1]
            if u == t:
                flow = min(cap[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    cap[a][b] -= flow
                    cap[b][a] += flow
                cut = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if cap[a][b] <= tiny)
                rest_of = path[cut + 1 :]
                del path[cut + 1 :]
                for v in rest_of:  # a node left by a full edge may be entered again
                    if v != t:
                        rest[v] = iter(list(cap[v]))
                continue
            for v in rest[u]:
                if cap[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                level.pop(u, None)


def smoothness(found: list[Block], tree: _Tree) -> list[tuple[int, int, float]]:
    """Edges of neighbouring blocks and of blocks of one container."""
    edges, last = [], {}
    depth, parent = tree.depth, tree.parent
    for i, b in enumerate(found):
        if i:
            x, y = found[i - 1].box, b.box
            far = 0
            while x != y:  # up to the element that holds both
                if depth[x] >= depth[y]:
                    x = parent[x]
                else:
                    y = parent[y]
                far += 1
            a = found[i - 1]
            like = a.tag == b.tag and parent[a.box] == parent[b.box] and tree.words[a.box] == tree.words[b.box]
            edges.append((i - 1, i, (LIKE if like else UNLIKE) / (1 + NEAR * max(0, far - 2))))
        up = parent[b.box]
        if up in last and last[up] != i - 1:
            edges.append((last[up], i, SAME))
        last[up] = i
    return edges


def main_text(page: str | None, weights: dict[str, float] = PRIOR) -> str:
    """The page's content blocks joined by line feeds."""
    if not page:
        return ""
    found, tree = parse(page)
    label = min_cut(costs(found, tree, weights), smoothness(found, tree))
    return "\n".join(b.text for b, keep in zip(found, label, strict=True) if keep)


def _texts(columns: list[str], html_col: str, out_col: str, weights: dict[str, float]):
    def run(batches):
        for batch in batches:
            text = pa.array([main_text(h, weights) for h in batch.column(html_col).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), text], names=[*columns, out_col])

    return run


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", keep: list[str] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The kept columns of pages (all but out_col by default) and the main text. weights: of `fit`, which is run where none are given."""
    from pyspark.sql.types import StringType, StructType

    keep = [c for c in pages.columns if c != out_col] if keep is None else keep
    weights = fit(pages, html_col) if weights is None else weights
    schema = StructType([pages.schema[c] for c in keep]).add(out_col, StringType())
    return pages.mapInArrow(_texts(keep, html_col, out_col, weights), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, keep=["page_id", "url"]).selectExpr("page_id", "url", "text", "cast(length(text) as bigint) as n_chars")


ORACLE = None
