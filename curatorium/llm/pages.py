"""HTML extraction by inferring one wrapper per host: a union-free regular expression over token streams.

1. ``stream`` reads a page into tokens: opening and closing block tags and text slots, each slot named by its role and
   the nearest blocks around it.  Up to ``RUN`` sibling blocks that equal their left neighbours are folded into them, which
   makes them a repeated group.
2. ``merge`` aligns two streams of a host: tokens of both stay; a mismatch becomes a repeated group if it repeats what stands
   before it, else its tokens become optional.  Every task merges the pages of its own slice of a host; the results are
   merged again in groups of at most a few dozen, dealt out evenly, until one wrapper per host is left, so no task ever gets
   all pages of a hot host.
3. The wrapper also sums what its slots held: characters, characters in links, and whether the text ever differed.  Each
   page is then aligned with the wrapper of its host, and the texts in its main slots are its main text.

Roles come from the wrapper (``roles``).  Template is what is mostly links, or a text that never differs, is on at least
``SAME_PAGES`` pages and on the share ``SAME_SHARE`` of those pages of the host that have the slot's outermost block below
``body``; this holds inside ``article`` and ``main`` as well.  All other slots are fields.  The host's region is the innermost
block, not a block of text only, that holds ``REGION`` of the characters in its fields; fields outside it are asides, so a
host without telling names still gives its articles.  Names say what the wrapper can't: navigation, header, footer, sidebar,
form, advert and comment blocks are boilerplate by tag, role or class, and ``article`` or ``main`` is the region of a page
that has one.  The doubtful names (``DOUBTFUL``: social, related, notice, ...) only decide where the wrapper has nothing to say: inside
``article`` or ``main`` such a block belongs to the text if it differs between pages and is as long as prose.  Pages
count once if all their texts outside boilerplate are equal.  Which pages have a token is known for a seeded sample, the
``SEEN`` pages of least hash among them, so shares are exact up to ``SEEN`` pages and need no list of pages beyond.

Only the joined pages are shuffled, once, by host; the wrapper side has one row per host, so adaptive execution splits a
hot host.  Defined cases: null, empty or text-free html gives an empty text; a null url is a host of its own; unclosed tags
are closed by their parents; of elements without text (``svg``, ``object``, ``select`` and such) that are never closed only the tag is left out; a truncated character reference stays as it is; repeated rows give equal texts; an empty table
gives an empty one.  White space is what Unicode calls so; ``br`` counts as white space.
"""

from __future__ import annotations

import html as entities
import json
import re
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried, settle
from curatorium.llm.urls import host_of

# Fixed lists of element names.
INLINE = "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
RAW = "script style title textarea".split()
SKIPPED = "noscript iframe template svg math object select canvas audio video".split()
FOREIGN = {"svg", "math"}
AUTO_CLOSE = {"p": ["p"], "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "tr": ["tr", "td", "th"], "td": ["td", "th"], "th": ["td", "th"], "option": ["option"]}
BOILER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head", "fieldset"}
BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal", "comment", "comments", "disqus", "respond",
    "footer", "header", "masthead", "share", "sharing", "social", "related", "newsletter", "subscribe", "promo", "sponsor", "sponsored",
    "widget", "toolbar", "pagination", "skip", "complementary", "contentinfo", "alert",
}
COMMENT_NAMES = {"comment", "comments", "respond"}
# Of these, names that articles use for parts of their own as well.
DOUBTFUL = {"alert", "banner", "contentinfo", "header", "modal", "notice", "notices", "popup", "promo", "related", "share", "sharing", "skip", "social", "toolbar", "widget"}
MAIN_TAGS, MAIN_NAMES = {"article", "main"}, {"articlebody", "main"}
BLOCK_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "header", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "main", "hr"}
SAME_PAGES = 3
SAME_SHARE = 0.5
SEEN = 16
#: Blocks of the path that names a slot, beside its role.
PATH = 6
GROUP = 48
#: Sibling blocks of a repeated group, at most.
RUN = 6
REGION = 0.8
#: Characters a page of a doubtful block that counts as prose.
PROSE = 120

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_INLINE, _VOID, _RAW, _SKIPPED = set(INLINE), set(VOID), set(RAW), set(SKIPPED)
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}


def _role(parent: str, block: str) -> str:
    """boiler inside any boilerplate block, doubtful inside one that has a doubtful name only, else main inside article or main, else other.

    doubtful is within article or main; elsewhere it is boiler.  Names of the whole page say nothing, and those of an
    article only whether it is a comment.
    """
    tag, *names = block.split(".")
    if tag in ("html", "body"):
        names = []
    elif tag in MAIN_TAGS:
        names = [n for n in names if n in COMMENT_NAMES]
    found = BOILER_NAMES.intersection(names)
    if parent == "boiler" or tag in BOILER_TAGS or found - DOUBTFUL or (found and parent not in ("main", "doubtful")):
        return "boiler"
    if found or parent == "doubtful":
        return "doubtful"
    return "main" if parent == "main" or tag in MAIN_TAGS or MAIN_NAMES.intersection(names) else "other"


def _block(tag: str, attrs: str) -> str:
    """The token of a block: its tag, then the words of class, id and role without digits."""
    if not attrs:
        return tag
    words = [w for m in _NAMES.findall(attrs) for w in re.split(r"[^a-z]+", "".join(m).lower()) if w]
    return ".".join([tag, *words])


def _after_raw(page: str, tag: str, at: int) -> int:
    end = _RAW_END[tag].search(page, at)
    return end.end() if end else len(page)


def skips(page: str) -> dict[int, int]:
    """Ends of the elements whose content is no text, by the ends of their opening tags; those never closed have none."""
    found: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in SKIPPED}
    at, last = 0, page.rfind(">")
    while at <= last and (m := _TOKEN.search(page, at)):
        at = m.end()
        tag, closing = (m[2] or m[5] or "").lower(), bool(m[1] or m[4])
        empty = m[0].endswith("/>")
        if tag in _RAW and not closing:
            if not (empty and (opened["svg"] or opened["math"])):
                at = _after_raw(page, tag, at)
        elif tag in _SKIPPED and closing:
            if opened[tag]:
                found[opened[tag].pop()] = at
        elif tag in FOREIGN and empty:
            found[at] = at
        elif tag in _SKIPPED:
            opened[tag].append(at)
    return found


def stream(page: str) -> tuple[list, list]:
    """(tokens, texts) of a page: tokens are [symbol, repeated], texts are (token index, text, characters in links)."""
    tokens: list[list] = []
    texts: list[tuple[int, str, int]] = []
    stack: list[tuple[str, str, int, str]] = []  # tag, symbol, first token, role
    starts: list[list[int]] = [[]]  # of the blocks inside each open block, and of the page
    parts: list[str] = []
    links, in_link = 0, 0

    def flush():
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                symbol = f"#{stack[-1][3] if stack else 'other'}:" + "/".join(s[1] for s in stack[-PATH:])
                if tokens and tokens[-1][0] == symbol:
                    tokens[-1][1] = True
                else:
                    tokens.append([symbol, False])
                texts.append((len(tokens) - 1, text, min(links, len(text))))
            parts.clear()
        links = 0

    def close():
        flush()
        _, symbol, first, _ = stack.pop()
        tokens.append(["</" + symbol, False])
        starts.pop()
        siblings = starts[-1]
        siblings.append(first)
        for k in range(1, RUN + 1):
            if len(siblings) < 2 * k:
                break
            a, b = siblings[-2 * k], siblings[-k]
            size = b - a
            if len(tokens) - b == size and all(tokens[a + i][0] == tokens[b + i][0] for i in range(size)):
                for i in range(a, b):
                    tokens[i][1] = True
                del tokens[b:], siblings[-k:]
                at = len(texts) - 1
                while at >= 0 and texts[at][0] >= b:
                    texts[at] = (texts[at][0] - size, *texts[at][1:])
                    at -= 1
                break

    ends: dict[int, int] | None = None
    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        m = _TOKEN.search(page, at) if at <= last else None
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            if in_link:
                links += m.start() - at
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in _RAW and not closing:
            at = _after_raw(page, tag, at)
            continue
        if tag in _SKIPPED:
            if not closing:
                ends = skips(page) if ends is None else ends
                at = ends.get(at, at)
            continue
        if tag in _INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag in _VOID:
            parts.append(" ")
            if tag == "hr":
                flush()
            continue
        if closing:
            if any(s[0] == tag for s in stack):
                while stack[-1][0] != tag:
                    close()
                close()
            else:
                flush()
            continue
        flush()
        implied = AUTO_CLOSE.get(tag, ["p"] if tag in BLOCK_ENDS_P else [])
        while stack and stack[-1][0] in implied:
            close()
        symbol = _block(tag, m[3] or m[6] or "")
        stack.append((tag, symbol, len(tokens), _role(stack[-1][3] if stack else "other", symbol)))
        starts.append([])
        tokens.append(["<" + symbol, False])
    while stack:
        close()
    flush()
    return tokens, texts


# A wrapper is a list of [symbol, repeated, optional, pages, characters, link characters, least hash, greatest hash, least page hashes].


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def page_wrapper(tokens: list, texts: list) -> list:
    own = _hash("\n".join(text for at, text, _ in texts if _own_role(tokens[at][0]) != "boiler"))
    wrapper = [[symbol, repeated, False, 1, 0, 0, None, None, [own]] for symbol, repeated in tokens]
    for at, text, linked in texts:
        item, value = wrapper[at], _hash(text)
        item[4] += len(text)
        item[5] += linked
        item[6] = value if item[6] is None else min(item[6], value)
        item[7] = value if item[7] is None else max(item[7], value)
    return wrapper


def _least(a: list, b: list) -> list:
    """The SEEN least page hashes of both."""
    if a == b or (len(a) == SEEN and b[0] > a[-1]):
        return a
    return sorted({*a, *b})[:SEEN]


def _joined(a: list, b: list) -> list:
    low = [x for x in (a[6], b[6]) if x is not None]
    high = [x for x in (a[7], b[7]) if x is not None]
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], a[4] + b[4], a[5] + b[5], min(low, default=None), max(high, default=None), _least(a[8], b[8])]


def merge(a: list, b: list) -> list:
    """The wrapper of all pages of both: common tokens stay, the others become optional."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [_joined(x, y) for x, y in zip(a, b)]
    out: list = []
    for kind, i, j, k, m in SequenceMatcher(None, left, right, autojunk=False).get_opcodes():
        if kind == "equal":
            out.extend(_joined(x, y) for x, y in zip(a[i:j], b[k:m]))
        else:
            for side in (a[i:j], b[k:m]):
                if not _repeats(out, side):
                    out.extend([*x[:2], True, *x[3:]] for x in side)
    return out


def _repeats(out: list, side: list) -> bool:
    """Folds a mismatch into the end of the wrapper if it is a whole block or several, and equal to what stands there."""
    size, depth = len(side), 0
    for x in side:
        depth += x[0].startswith("<") - 2 * x[0].startswith("</")
        if depth < 0:
            return False
    if not size or depth or side[0][0][0] != "<" or size > len(out) or any(x[0] != y[0] for x, y in zip(out[-size:], side)):
        return False
    for at, x in enumerate(side, len(out) - size):
        own = out[at]
        joined = _joined(own, x)
        # the same pages: a repetition adds text to the slot, not pages
        out[at] = [own[0], True, own[2], own[3], *joined[4:]]
    return True


def expression(wrapper: list) -> str:
    """The wrapper in the notation of regular expressions, tokens between blanks."""
    return " ".join(f"{'#' if x[0][0] == '#' else x[0]}{'+' * x[1]}{'?' * x[2]}" for x in wrapper)


def _own_role(symbol: str) -> str:
    return symbol[1:].split(":", 1)[0] if symbol[0] == "#" else ""


def roles(wrapper: list) -> list[str]:
    """Per token: main, other (main if a page has no main slot), aside, template, doubtful or boiler; tags are none of these."""
    differs = any(x[0][0] == "#" and x[6] != x[7] for x in wrapper)
    pages_of: dict[str, list] = {}
    every: list = []
    for x in wrapper:
        every = _least(every, x[8])
        if x[0][0] == "<":
            pages_of[x[0]] = _least(pages_of.get(x[0], []), x[8])

    def common(symbol: str, seen: list) -> bool:
        blocks = [b for b in symbol.split(":", 1)[1].split("/") if b.split(".")[0] not in ("html", "body")]
        of = pages_of.get("<" + blocks[0], every) if blocks else every
        return len(seen) >= SAME_PAGES and len(set(of).intersection(seen)) >= SAME_SHARE * len(of)

    out, held = [], {}
    path: tuple = ()
    paths = []
    for symbol, _, _, pages, chars, linked, low, high, seen in wrapper:
        role = _own_role(symbol)
        if symbol.startswith("</"):
            # blocks that only some pages have may close twice
            if symbol[2:] in path:
                path = path[: len(path) - 1 - path[::-1].index(symbol[2:])]
        elif symbol[0] == "<":
            path = (*path, symbol[1:])
        paths.append(path)
        if role in ("main", "other", "doubtful"):
            fixed = differs and low == high and common(symbol, seen)
            if fixed or (role != "main" and 2 * linked > chars):
                role = "template"
            elif role == "doubtful":
                role = "main" if low != high and chars >= PROSE * max(1, pages) else "doubtful"
        if role == "other":
            for depth in range(len(path)):
                held[path[: depth + 1]] = held.get(path[: depth + 1], 0) + chars
        out.append(role)
    region = _region(held, paths)
    return ["aside" if role == "other" and path[: len(region)] != region else role for role, path in zip(out, paths)]


def _region(held: dict[tuple, int], paths: list[tuple]) -> tuple:
    """The innermost block with blocks inside that holds REGION of the characters of all fields; () if none does."""
    whole = max(held.values(), default=0)
    nested = {path[:-1] for path in paths if path}
    best = [path for path, chars in held.items() if path in nested and chars >= REGION * whole]
    return max(best, key=len, default=())


def _decided(batches):
    """Wrappers as the symbols and roles of their tokens, which is what a page needs."""
    for batch in batches:
        wrappers = [json.loads(w) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([json.dumps({"symbols": [x[0] for x in w], "roles": roles(w)}) for w in wrappers], pa.string())], ["host", "wrapper"])


class Extractor:
    """Main text of pages by wrapper; alignments of equal streams are done once."""

    def __init__(self):
        self.plans: dict[tuple, list[str]] = {}
        self.wrappers: dict[str, tuple] = {}

    def _plan(self, wrapper_json: str, symbols: tuple) -> list[str]:
        key = (wrapper_json, symbols)
        if key not in self.plans:
            if len(self.plans) > 5_000:
                self.plans.clear()
                self.wrappers.clear()
            if wrapper_json not in self.wrappers:
                wrapper = json.loads(wrapper_json)
                decided = isinstance(wrapper, dict)
                self.wrappers[wrapper_json] = (wrapper["symbols"], wrapper["roles"]) if decided else ([x[0] for x in wrapper], roles(wrapper))
            left, kinds = self.wrappers[wrapper_json]
            plan = [""] * len(symbols)
            for i, k, size in SequenceMatcher(None, left, symbols, autojunk=False).get_matching_blocks():
                plan[k : k + size] = kinds[i : i + size]
            self.plans[key] = plan
        return self.plans[key]

    def __call__(self, page: str, wrapper_json: str) -> str:
        tokens, texts = stream(page)
        plan = self._plan(wrapper_json, tuple(t[0] for t in tokens))
        # a slot that the alignment left out keeps the role of its own path
        kinds = [plan[at] or _own_role(tokens[at][0]) for at, _, _ in texts]
        wanted = next((kind for kind in ("main", "doubtful", "other", "aside") if kind in kinds), "")
        return " ".join(text for (_, text, _), kind in zip(texts, kinds) if kind == wanted)


def _partial(batches):
    """One wrapper per host and slice of pages."""
    for batch in batches:
        for part in W.slices(batch, "html", 8 << 20):
            found: dict = {}
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist()):
                own = page_wrapper(*stream(page or ""))
                found[host] = merge(found[host], own) if host in found else own
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([json.dumps(w) for w in found.values()])], ["host", "wrapper"])


def _merge_groups(batches):
    for table_ in W.complete_runs(batches, "grp"):
        groups, hosts = table_.column("grp").to_numpy(), table_.column("host").to_pylist()
        wrappers = table_.column("wrapper").to_pylist()
        found: dict = {}
        for key, text in zip(zip(groups.tolist(), hosts), wrappers):
            own = json.loads(text)
            found[key] = merge(found[key], own) if key in found else own
        yield pa.RecordBatch.from_arrays([pa.array([h for _, h in found], pa.string()), pa.array([json.dumps(w) for w in found.values()])], ["host", "wrapper"])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) with one row per host of ``pages`` (host, html); wrappers are JSON."""
    rows = settle(pages.mapInArrow(_partial, "host string, wrapper string"), "wrappers")
    while True:
        sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return rows
        parts = F.ceil(F.col("n") / GROUP)
        # by row number: equal wrappers would all get one number by their content
        grouped = rows.withColumn("row", F.monotonically_increasing_id()).join(sizes, "host").select("host", "wrapper", F.xxhash64("host", F.pmod(F.xxhash64("row"), parts)).alias("grp"))
        rows = settle(grouped.repartition("grp").sortWithinPartitions("grp").mapInArrow(_merge_groups, "host string, wrapper string"), "wrappers")


def _extract(batches):
    main_text = Extractor()
    for batch in batches:
        for part in W.slices(batch, "html", 8 << 20):
            texts = [main_text(h, w) if h and w else "" for h, w in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names if c not in ("html", "wrapper")], pa.array(texts, pa.string())], [c for c in part.schema.names if c not in ("html", "wrapper")] + ["text"])


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without their html and with the main text."""
    kept = Carried(pages, html, "html", ["text"])
    site = F.col(kept.names[kept.others.index(url)])
    plain = kept.plain.withColumn("host", F.coalesce(host_of(site), F.lit("")))
    wrappers = infer_wrappers(plain.select("host", "html")).mapInArrow(_decided, "host string, wrapper string")
    joined = plain.join(wrappers, "host", "left").select(*kept.names, "html", "wrapper")
    return kept.back(joined.mapInArrow(_extract, kept.schema("text string")), "text")


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
