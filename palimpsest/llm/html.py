"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: elements with the same path of
signatures (tag, class, id, role) are one element node. Of a node the tree
holds in how many pages it stands, which presentation styles (the sequences of
child signatures, repeats in a row once) it takes there, and which contents
(blocks of text) stand below it. Importance follows from entropy: a node with
one style on many pages carries no presentation information; content that the
pages of the host share carries no content information. The composite of both
(``composites``) is a number from 0 to 1 for each content of a node.

What a page itself says of a place is evidence that scales the composite to the
content's importance (``importance``):

- inside an article mark (article, main, role=main) it lacks less of 1;
- below a name that begins with a word for adverts or comments but goes on with another
  one (ad-hoc, comment-policy), inside an article mark, it counts as it is;
- outside the marks of a page that has some, or below a name in which boilerplate
  is a word (widgets, shares, related), it counts half, and where the tree has not
  seen the node often enough to tell, it is held to be shared;
- below structure of boilerplate (navigation, headers, footers, asides, forms,
  elements whose whole name is that of a menu, sidebar or notice, or names an advert
  or comments), or where both of the above speak against it, it counts 0.3. A form
  that holds an article mark or most of a page's text is the page, and no evidence.

Contents of less importance than ``threshold`` are removed from each page: a
branch goes only when all that stands below it goes. Scripts, styles and what no
reader sees (hidden, display: none) are no content at all.

Statistics are counts by (host, node, style or content): a host with any share
of the pages meets in one place only as counts. Of the tree, only composites that
some evidence can take below the threshold travel back. Up to ``broadcast_rows`` of
them are broadcast; more are sent once to each of ``spread`` parts of a host's pages.

Defined cases: a null or empty html gives an empty text, with its page_id and
url; a null url is a host of its own; a page of which everything would go gives
its largest branch, the one without evidence against it if there is any; ties
of branches go to the first; tags without an end are text; nesting of any depth
and very long pages take time and memory in proportion to their length; repeated
rows give repeated rows; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, memory, slices

# Fixed values of HTML: elements that make blocks, that have no end, whose content is no markup, that end an open p.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style noscript template textarea title select button iframe object svg canvas audio video xmp noembed noframes datalist".split())
#: Elements that say by themselves that they are no main text.
BOILERPLATE = frozenset("nav footer aside form menu dialog search fieldset".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|menus?|nav|navbar|navigation|breadcrumbs?|sidebars?|side-bar|"
    r"footers?|site-header|page-header|masthead|comments?|commentlist|respond|disqus|replies|share|sharing|social|newsletter|subscribe|signup|login|popup|modal|related|recommended|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Whole names of what is no main text wherever it stands, and, outside an article, of a page's head.
_WHOLE = frozenset(
    "sidebar sidebars side-bar menu menus main-menu nav navbar navigation breadcrumb breadcrumbs footer site-footer page-footer notice notices cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr banner banners "
    "sponsor sponsored promo promotion newsletter subscribe signup login popup modal".split()
)
_HEADS = frozenset("header site-header page-header masthead".split())
#: Words that say the same at either end of a longer name (user-comments, ad-slot), and words beside them that take it back (ad-free).
_NEVER = frozenset("ad ads advert adverts advertisement advertisements advertising comment comments commentlist respond disqus replies".split())
#: What may follow such a word at the beginning of a name for it to say the same (ad-slot, comment-list); before other words (ad-hoc, comment-policy) it is a hint.
_LAYOUT = frozenset(
    "area areas author banner bar block body bottom box button code col column container content count counter cta div embed footer form frame group header holder horizontal image inline inner item items label layer left leaderboard link links "
    "list main meta middle module native number outer overlay panel placeholder pos position rail rectangle region reply respond right row section sidebar slot slots small space square sticky thread threads title top tower unit units vertical "
    "video view wide widget wrap wrapper wrappers zone".split()
)
_BUT = frozenset("no has with is free open closed on off enabled disabled".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']*+(?:\"[^\"]*+\"|'[^']*+'))*+[^>\"']*+|[^>]*+)>|([^<]++|<)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())
_RAW_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in RAW}
_NUMBER = re.compile(r"\d+")
_UNSEEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s=/]|$)|style\s*=\s*[\"']?[^\"'>]*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)


class Node:
    """An element: its signature, its path's key, its children and texts in order."""

    __slots__ = ("tag", "sign", "key", "items", "hidden", "structure", "article", "named", "hint", "up")

    def __init__(self, tag: str, sign: str, up: Node | None, hidden: bool = False, structure: bool = False, article: bool = False, named: bool = False, hint: bool = False):
        self.tag, self.sign, self.up = tag, sign, up
        self.hidden, self.structure, self.article, self.named, self.hint = hidden, structure, article, named, hint
        self.key = _path_key(up.key if up else 0, sign)
        self.items: list = []


def parse(html: str) -> Node:
    """The tree of a page. Inline elements are no nodes unless there is evidence against them.

    Open elements are counted by tag, so that an end tag that closes nothing costs nothing.
    """
    root = top = Node("#root", "", None)
    at, n, open_, marks = 0, len(html), Counter(), 0
    last = html.rfind(">")  # behind it no tag ends
    endless: set[str] = set()  # raw elements whose end tag doesn't come any more

    def left(node: Node) -> Node:
        nonlocal marks
        open_[node.tag] -= 1
        marks -= node.article
        return node.up

    while at < n:
        m = _TOKEN.match(html, at) if at <= last else None
        if m is None:  # tags without an end
            top.items.append(html[at:])
            break
        at = m.end()
        if m[4] is not None:
            top.items.append(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                top.items.append(" ")
            elif open_[tag] > 0:
                while top.tag != tag:
                    top = left(top)
                top = left(top)
            continue
        block = tag in BLOCKS
        if block:
            while top.up and (top.tag == "p" or top.tag in _SIBLINGS.get(tag, ()) or (tag in _HEADINGS and top.tag in _HEADINGS)):
                top = left(top)
        if tag in RAW:
            end = _RAW_ENDS[tag].search(html, at) if tag not in endless else None
            if not end:
                endless.add(tag)
            at = end.start() if end else n
            if end:
                close = html.find(">", at)
                at = close + 1 if close >= 0 else n
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                top.items.append(" " if tag == "br" else Node("hr", "hr", top))
            continue
        names, role = "", ""
        if m[3] and "=" in m[3]:
            for a in _ATTRIBUTE.finditer(m[3]):
                name, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if name in ("class", "id"):
                    names += " " + value
                elif name == "role":
                    role = value.lower()
        hidden = tag in HIDDEN or (bool(m[3]) and ("hidden" in m[3] or "none" in m[3]) and tag not in ("html", "body") and bool(_UNSEEN.search(m[3])))
        structure = not hidden and (tag in BOILERPLATE or role in _ROLES or (tag == "header" and not marks))
        named = hint = False
        if names and not hidden and not structure and tag not in ("body", "html", "main"):
            if _NOISE.search(names):
                said = _named_structure(names.lower().split(), tag == "article")
                structure, hint = bool(said), said is None
                named = not structure and not hint and tag != "article"
            elif not marks and tag != "article":
                structure = not _HEADS.isdisjoint(names.lower().split())
        if not block and not hidden and not structure and not named and not hint:
            continue
        sign = tag + "".join("." + _NUMBER.sub("#", x) for x in sorted(names.split())) + (f"[{role}]" if role else "")
        article = tag in ("article", "main") or role == "main"
        node = Node(tag, sign, top, hidden, structure, article, named, hint)
        top.items.append(node)
        if m[3].endswith("/") and not block:
            continue
        top = node
        open_[tag] += 1
        marks += article
    return root


def _named_structure(names: list[str], article: bool) -> bool | None:
    """Whether a class or id says by itself that an element is no main text (of an article only that it is an advert or comment); None where it hints at it."""
    hint = False
    for name in names:
        words = re.split("[-_]+", name)
        if _BUT.isdisjoint((words[0], words[-1])):
            if words[-1] in _NEVER or (words[0] in _NEVER and all(w in _LAYOUT or w in _NEVER or not w.isalpha() for w in words[1:])):
                return True
            hint |= words[0] in _NEVER
        if not article and name in _WHOLE:
            return True
    return None if hint and all(_NOISE.search(n) is None or re.split("[-_]+", n)[0] in _NEVER for n in names) else False


@lru_cache(maxsize=50_000)
def _path_key(above: int, sign: str) -> int:
    return _key(f"{above}/{sign}")


def _key(path: str) -> int:
    """A number for a path or text; its last seven bits are free for a composite."""
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) & ~_STEPS


def _folded(text: str) -> str:
    """Every run of white space as one blank, at the ends too."""
    folded = " ".join(text.split())
    return (" " if text[:1].isspace() else "") + folded + (" " if folded and text[-1].isspace() else "")


def blocks(root: Node) -> list[tuple[Node, str, int]]:
    """Texts that a reader sees, in order, each with the element that holds it and the number of its block.

    A block has several texts only where elements in its line are nodes; blanks between these stay.
    """
    out, stack, text, line = [], [(root, iter(root.items))], [], 0

    def flush(ends: bool) -> None:
        nonlocal line
        s = _folded(entities.unescape("".join(text))) if text else ""
        text.clear()
        if s.strip():
            out.append((stack[-1][0], s, line))
        elif s and out and out[-1][2] == line:
            out[-1] = (out[-1][0], out[-1][1] + " ", line)
        line += ends

    while stack:
        item = next(stack[-1][1], None)
        if item is None:
            flush(stack[-1][0].tag in BLOCKS)
            stack.pop()
        elif isinstance(item, str):
            text.append(item)
        elif item.hidden:
            if item.tag in BLOCKS:
                flush(True)
        else:
            flush(item.tag in BLOCKS)
            stack.append((item, iter(item.items)))
    return out


def _joined(texts: list[tuple[str, int]]) -> str:
    lines: dict[int, str] = {}
    for text, line in texts:
        lines[line] = lines.get(line, "") + text
    return "\n\n".join(" ".join(x.split()) for x in lines.values())


def _largest(found: list[tuple[Node, str, int]]) -> list[tuple[str, int]]:
    """The texts of the narrowest branch with more than half of the text; elements of one path count as one branch."""
    sizes: Counter = Counter()
    for node, text, _ in found:
        sizes[node] += len(text)
    # Sums from the leaves up; nodes are met before those below them, so in reverse all below are done.
    every = _below_root(found)
    for node in reversed(every):
        if node.up:
            sizes[node.up] += sizes[node]
    by_path: Counter = Counter()
    for node in every:
        by_path[node.key] += sizes[node]
    half, best = sum(len(t) for _, t, _ in found), None
    for node in every:  # paths with more than half of the text form one line down
        if 2 * by_path[node.key] > half:
            best = node.key
    marked: set[Node] = set()
    for node in every:
        if node.key == best or node.up in marked:
            marked.add(node)
    return [(t, line) for node, t, line in found if best is None or node in marked]


def _below_root(found: list[tuple[Node, str, int]]) -> list[Node]:
    """The elements that hold the texts and all above them, each after the one above."""
    every: dict[Node, None] = {}
    for node, _, _ in found:
        line, up = [], node
        while up and up not in every:
            line.append(up)
            up = up.up
        every.update(dict.fromkeys(reversed(line)))
    return list(every)


#: Places of a content: inside an article mark, where nothing speaks for or against it, where marks or names speak against it, below structure of boilerplate.
INSIDE, PLAIN, DOUBTFUL, STRUCTURE = range(4)
#: Steps of a composite as it travels: in a key's last seven bits.
_STEPS = 127
#: Composite that is assumed of doubtful contents whose node the tree hasn't seen often enough.
_UNKNOWN = 0.5


def importance(composite: float, place: int) -> float:
    """The composite scaled by what the page says of the place."""
    if place == INSIDE:
        return composite + 0.3 * (1 - composite)
    return composite * (1.0, 1.0, 0.5, 0.3)[place]


def judged(root: Node) -> list[tuple[Node, str, int, int]]:
    """The blocks of a page, each with its place.

    The nearest structure wins over marks below it, the nearest mark over names above it. Marks below names count
    only where there are no others.
    """
    found = blocks(root)
    whole, sizes, marked = sum(len(t) for _, t, _ in found), Counter(), set()
    every = _below_root(found)
    for node, text, _ in found:
        sizes[node] += len(text)
    for node in reversed(every):
        if node.article:
            marked.add(node)
        if node.up:
            sizes[node.up] += sizes[node]
            if node in marked:
                marked.add(node.up)
    for strict in (True, False):
        state: dict[Node, tuple[bool, bool, bool, bool]] = {}  # structure, inside, named, hinted
        for node in every:
            structure, inside, named, hint = state[node.up] if node.up else (False, False, False, False)
            if node.structure and not (node.tag == "form" and (node in marked or 2 * sizes[node] > whole)):
                structure = True
            if node.article and not (strict and named):
                inside, named = True, False
            named = named or node.named
            state[node] = structure, inside and not structure, named, hint or node.hint
        any_inside = any(state[n][1] for n, *_ in found)
        if any_inside:
            break
    out = []
    for n, t, line in found:
        structure, inside, named, hint = state[n]
        outside = any_inside and not inside
        place = STRUCTURE if structure or ((named or hint) and outside) else DOUBTFUL if named or outside else INSIDE if inside and not hint else PLAIN
        out.append((n, t, line, place))
    return out


def extract(html: str | None, low: dict[int, int] | None = None, threshold: float = 0.35) -> str:
    """The main text of a page, given what its host's tree says: composites, in steps, by content, and _STEPS by doubtful node seen often enough.

    Contents that the tree doesn't list are the page's own, of composite 1.
    """
    if not html:
        return ""
    low = low or {}
    found, kept = judged(parse(html)), []
    for n, t, line, place in found:
        composite = low.get(_content(n, t), _STEPS) / _STEPS
        if place == DOUBTFUL and n.key not in low:
            composite = min(composite, _UNKNOWN)
        if importance(composite, place) >= threshold:
            kept.append((t, line))
    if not kept:
        for places in ((INSIDE,), (INSIDE, PLAIN), (INSIDE, PLAIN, DOUBTFUL), tuple(range(4))):
            if rest := [x[:3] for x in found if x[3] in places]:
                kept = [(t, line) for _, t, line in rest] if places == (INSIDE,) else _largest(rest)
                break
    return _joined(kept)


def _content(node: Node, text: str) -> int:
    return _key(f"{node.key}\0{text.strip()}")


def _nodes(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [x for x in node.items if not isinstance(x, str) and not x.hidden]


def tree_entries(html: str | None) -> set[tuple[int, int, int]]:
    """What a page adds to its host's tree.

    (node, 0, style) for nodes, (node, 1, content) for their own blocks of text,
    (node, 2, node) for those with doubtful blocks. Contents below structure of boilerplate
    are of too little importance whatever the tree says of them, so it holds only their nodes.
    """
    out: set[tuple[int, int, int]] = set()
    if not html:
        return out
    root = parse(html)
    for node in _nodes(root):
        signs: list[str] = []
        for x in node.items:
            sign = "#text" if isinstance(x, str) else x.sign
            if (not isinstance(x, str) or x.strip()) and (not signs or signs[-1] != sign):
                signs.append(sign)
        out.add((node.key, 0, _path_key(0, " ".join(signs))))
    for node, text, _, place in judged(root):
        if place != STRUCTURE:
            out.add((node.key, 1, _content(node, text)))
        if place == DOUBTFUL:
            out.add((node.key, 2, node.key))
    return out


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def composites(pages: DataFrame, least_pages: int = 4, gamma: float = 0.9) -> DataFrame:
    """(host, what, composite) of the contents that several pages share, and of doubtful nodes (composite 1), on ``least_pages`` pages or more.

    Node importance is the entropy of its styles to the base of its number of
    pages; content importance is 1 less the entropy of the content, spread evenly
    over the pages that have it in this node. The composite weighs the first by
    1 - gamma ** styles and the second by the rest. Contents of one page only, and
    those of nodes on fewer pages, count as important.
    """

    def run(batches):
        for b in slices(batches):
            seen: Counter = Counter()
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for entry in tree_entries(html):
                    seen[(host, *entry)] += 1
            columns = list(zip(*seen)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
            yield pa.record_batch([*[pa.array(c, t) for c, t in zip(columns, kinds)], pa.array(list(seen.values()), pa.int64())], names=["host", "node", "kind", "what", "n"])

    entries = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, node long, kind int, what long, n long")
    counted = entries.groupBy("host", "node", "kind", "what").agg(F.sum("n").alias("n"))
    # Both parts below read the counts; contents of one page are important anyway.
    counted = checkpoint(counted.filter("kind <> 1 or n > 1"))
    # Entropies from sums: -sum(p log p) = log(m) - sum(n log n) / m.
    n = F.when(F.col("kind") == 0, F.col("n"))
    nodes = (
        counted.filter("kind <> 1")
        .groupBy("host", "node")
        .agg(F.sum(n).alias("m"), F.count(n).alias("styles"), F.sum(n * F.log(n)).alias("spread"), F.max(F.col("kind") == 2).alias("doubtful"))
        .filter(F.col("m") >= least_pages)
    )
    base = F.log(F.greatest(F.col("m"), F.lit(2)))
    style = (base - F.col("spread") / F.col("m")) / base
    content = 1 - F.log("n") / base
    weight = F.pow(F.lit(gamma), F.col("styles"))
    composite = ((1 - weight) * style + weight * content).alias("composite")
    shared = counted.filter("kind = 1").join(nodes, ["host", "node"]).select("host", "what", composite)
    return shared.unionByName(nodes.filter("doubtful").select("host", F.col("node").alias("what"), F.lit(1.0).alias("composite")))


def low_contents(pages: DataFrame, threshold: float = 0.35, least_pages: int = 4) -> DataFrame:
    """(host, what): contents whose importance is below the threshold in some place, and doubtful nodes seen often enough; the last bits of ``what`` are the composite in steps."""
    seen = composites(pages, least_pages).filter((F.col("composite") * 0.5 < threshold) | (F.col("composite") == 1))
    steps = F.least(F.greatest(F.round(F.col("composite") * _STEPS), F.lit(0)), F.lit(_STEPS)).cast("long")
    return seen.select("host", (F.col("what") + steps).alias("what"))


def _table(what) -> dict[int, int]:
    return {x & ~_STEPS: x & _STEPS for x in what}


def main_text(pages: DataFrame, threshold: float = 0.35, least_pages: int = 4, broadcast_rows: int = 500_000, spread: int = 64) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    low = checkpoint(low_contents(pages, threshold, least_pages))
    schema = "page_id long, url string, text string, n_chars long"
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))

    def texts(b: pa.RecordBatch, table_of) -> pa.RecordBatch:
        found = [extract(h, table_of(host), threshold) for host, h in zip(b.column("host").to_pylist(), b.column("html").to_pylist())]
        return pa.record_batch([b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if low.count() <= broadcast_rows:
        by_host: dict[str, list[int]] = {}
        for host, what in low.collect():
            by_host.setdefault(host, []).append(what)
        own_name = uuid.uuid4().hex
        shared = pages.sparkSession.sparkContext.broadcast({h: np.array(sorted(x), dtype=np.int64) for h, x in by_host.items()})

        def run(batches):
            tables = memory((_table, own_name), dict)
            for b in slices(batches):
                for host in set(b.column("host").to_pylist()):
                    if host not in tables and host in shared.value:
                        tables[host] = _table(shared.value[host].tolist())
                yield texts(b, tables.get)

        return own.mapInArrow(run, schema)

    # A host's pages are dealt to ``spread`` parts; in each its list comes once, before the pages.
    blank = F.lit(None).cast("string")
    part = F.pmod(F.xxhash64("html", "url", "page_id"), F.lit(spread)).cast("int")
    rows = own.select("host", part.alias("part"), F.lit(1).alias("order"), "page_id", "url", "html", F.lit(None).cast("long").alias("what"))
    lists = low.select("host", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"), F.lit(0).alias("order"), F.lit(None).cast("long").alias("page_id"), blank.alias("url"), blank.alias("html"), "what")
    dealt = rows.unionByName(lists).repartition("host", "part").sortWithinPartitions("host", "part", "order")

    def merged(batches):
        now, table = None, {}
        for b in slices(batches):
            hosts, order, what = b.column("host").to_pylist(), b.column("order").to_pylist(), b.column("what").to_pylist()
            tables, take = [], []
            for k, host in enumerate(hosts):
                if host != now:
                    now, table = host, {}
                if order[k] == 0:
                    table[what[k] & ~_STEPS] = what[k] & _STEPS
                else:
                    take.append(k)
                    tables.append(table)
            if take:
                given = iter(tables)
                yield texts(b.take(pa.array(take)), lambda _: next(given))

    return dealt.mapInArrow(merged, schema)
