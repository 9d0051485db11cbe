"""Secret scans by assignment-aware lexing.

Base kinds are fixed patterns over the whole text.  The method adds ``literal`` spans: source and configuration syntax
(``name = "x"``, ``"name": 'x'``, ``name: x``, ``a["name"] = "x"``, ``name: type = "x"``, ``--name x``, ``<name>x</name>``, and
literals joined by ``+``, also over line breaks, string prefixes, triple quotes, tuples, lists and conversions such as
``String::from("x")``, ``a = b = "x"``, ``setName("x")`` and ``put("name", "x")``) is read into pairs of a name and literals,
constants are propagated (``a = "x"; password = a + b`` reaches the literals of a and b, however many and however far), and a
literal counts when the score of its target name times the score of its characters is high enough: its own, or those of the
whole value that it is joined into.  A literal that meets a base span adds none.

Base spans cover the whole match (name, sign and value for ``assign``); ``value_start`` says where the value begins, which
is what ``redact`` masks.  Positions are code points, ends exclusive.

Cheap substring tests rule out most texts before any pattern runs; every pattern is linear (no nested repeats).  Nothing is
shuffled.  Defined cases: a null or empty text has no spans; repeated rows are scanned alike; other columns pass through (one named like a result is replaced).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatorium.llm import wordhash as W
from curatorium.llm.registry import query, table
from curatorium.llm.store import Carried

# Fixed patterns of the base kinds: pattern, group whose length counts, least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = [*BASE, "literal"]
_HEX = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_HEX_RUN = bytes([1]) * 24

# Stems of sensitive names and their scores.
STRONG = ["password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "accesskey", "privatekey", "secretkey", "credential"]
WEAK = ["key", "auth", "pass", "signature", "salt"]
STEMS = ["pass", "pwd", "secret", "token", "key", "credential", "auth", "signature", "salt"]
PLACEHOLDERS = ["example", "changeme", "placeholder", "your", "xxxx", "dummy", "todo", "none", "null", "true", "false", "undefined"]
LEAST_SCORE = 0.5

_NAME = r"(?<![\w$])(?<![\w$][.\-])[A-Za-z_$][\w$]*+(?:[.\-][A-Za-z_][\w$]*+)*+"
_QUOTED = r'"(?:[^"\\\n]|\\.)*+"' + r"|'(?:[^'\\\n]|\\.)*+'" + r"|`(?:[^`\\\n]|\\.)*+`"
_BARE = r"[^\s\"'`,;(){}\[\]<>&|+]++"
# A type between ':' and '=': one name with its arguments and alternatives, as two words in a row are prose or another pair.
_ARGS = r"[\[<][^\s=:;{}]*+(?:[\x20\t]++[^\s=:;{}]++)*+"
_TYPE = rf"(?:[&*?]++(?:'\w++\x20)?(?:mut\x20)?)?(?P<type>[A-Za-z_][\w$]*+(?:(?:::|\.)[A-Za-z_][\w$]*+)*+)(?:{_ARGS})?+(?:[\x20\t]*+\|[\x20\t]*+[A-Za-z_][\w.$]*+(?:{_ARGS})?+)*+[?!]?+"
# What may stand before a quote, and what may be opened before the first literal: brackets, and calls that only convert.
_PREFIX = r"""(?:(?:[bBfFrRuUL]{1,2}|u8|@|\$)(?=["'`]))?+"""
_OPEN = r"(?P<open>(?:(?:new[\x20\t]++)?(?:[A-Za-z_][\w$]*+(?:(?:::|\.)[A-Za-z_][\w$]*+)*+!?+)?[(\[{]\s*+)++)?+"
# Further names before a literal: a = b = "x".
_CHAINED = rf"""(?:{_NAME}[\x20\t]*+=(?![=>~])[\x20\t]*+){{1,8}}["'`]"""
_TYPED = rf""":[\x20\t]*+{_TYPE}(?:[\x20\t]++=(?=[\x20\t])|[\x20\t]*+=(?=[\x20\t]*+["'`]))"""
_PAIR = re.compile(
    rf"""(?:<(?P<tag>{_NAME})>(?P<body>[^<>\n]++)</)|(?:(?:(?<![\w\-])--(?P<flag>[A-Za-z][\w\-]*+)[\x20=]|(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:(?<=["'])[\x20\t]*+\])?+[\x20\t]*+(?:{_TYPED}|:=|=>|=(?!=)|:(?![:/]))[\x20\t]*+)(?:(?P<chained>(?={_CHAINED}))|{_OPEN}{_PREFIX}(?P<first>{_QUOTED}|{_BARE})))"""
)
# Over a line break only what is no name of a pair itself: a leading '+' may also mark an added line.
_BREAK = r"(?:\s|\\(?=\r?\n))*+"
_MORE = re.compile(rf"""[\x20\t]*+\+[\x20\t]*+(?!\\\r?\n){_PREFIX}({_QUOTED}|{_BARE})|{_BREAK}\+{_BREAK}{_PREFIX}((?:{_QUOTED}|{_NAME})(?![\x20\t]*+(?:\]|[:=])))""")
_NEXT = re.compile(rf"""\s*+,\s*+{_PREFIX}({_QUOTED})(?!\s*+[:=])""")
_KEYED = re.compile(r"\s*+[:=]")
_CALL = re.compile(
    rf"""(?:(?<![\w$])(?:set|with|add|use)_?|\.)(?P<name>[A-Za-z][\w$]*+)\([\x20\t]*+{_PREFIX}(?P<value>{_QUOTED})[\x20\t]*+\)"""
    rf"""|\([\x20\t]*+(?P<q>["'])(?P<key>[A-Za-z_$][\w$.\-]*+)(?P=q)[\x20\t]*+,[\x20\t]*+{_PREFIX}(?P<keyed>{_QUOTED})"""
)
# Calls that hand their text on as it is, by the last part of their name; calls that ask for a value, by their beginning.
CONVERSIONS = ["from", "new", "of", "str", "string", "bytes", "bytearray", "encode", "valueof", "fromstring", "secret", "secretstr", "secretstring", "password", "token", "literal", "value"]
_ASKING = re.compile(r"(?:get|find|read|fetch|load|check|verify|is|has|delete|remove|compare|match|test)", re.I)
_CALLEES = re.compile(r"([A-Za-z_$][\w$]*+)!?+[(\[{]")


def name_score(name: str) -> float:
    flat = re.sub(r"[^a-z]", "", name.lower())
    if any(s in flat for s in STRONG):
        return 1.0
    words = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", name)
    return 0.6 if any(w.lower() in WEAK for w in words) else 0.0


def literal_score(value: str, quoted: bool) -> float:
    """Between 0 and 1: length, entropy and mixture of characters; bare words of prose and placeholders score 0."""
    return _score(value[:REMEMBERED], Counter(value), quoted)


#: Characters of a joined value that are looked at as text; all of them count.
REMEMBERED = 4096


def _score(beginning: str, counts: Counter, quoted: bool) -> float:
    length = sum(counts.values())
    low = beginning.lower()
    if length < 6 or any(p in low for p in PLACEHOLDERS) or re.match(r"[$%@{(]|https?:", beginning) or len(counts) < 4:
        return 0.0
    characters = "".join(counts)
    kinds = sum(bool(re.search(p, characters)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^\sA-Za-z0-9]"))
    if re.search(r"\s", characters) or (kinds < 2 and not quoted) or (not quoted and not re.search("[0-9]", characters)):
        return 0.0
    entropy = -sum(n / length * math.log2(n / length) for n in counts.values())
    return min(1.0, entropy / 3.0) * (0.7 + 0.1 * min(kinds, 3))


class Constants:
    """Assignments in order: the values of each, a value being what is joined: literals (start, end, quoted) and earlier assignments."""

    def __init__(self, text: str):
        self.text = text
        self.values: list[list[list]] = []
        self.named: dict[str, int] = {}
        self.known: dict[int, tuple[str, Counter] | None] = {}
        self.reached: list[float] = []
        self.whole: list[float] = []
        self.found: dict[tuple[int, int], tuple[str, float]] = {}

    def add(self, values: list[list]) -> int:
        self.values.append(values)
        self.reached.append(0.0)
        self.whole.append(0.0)
        return len(self.values) - 1

    def _joined(self, value: list) -> tuple[str, Counter] | None:
        """(beginning, counts of characters) of a joined value, its references known."""
        beginning, counts = "", Counter()
        for part in value:
            if isinstance(part, int):
                known = self.known.get(part)
                if known is None:
                    continue
                beginning, counts = (beginning + known[0])[:REMEMBERED], counts + known[1]
            elif part[2]:
                own = self.text[part[0] : part[1]]
                beginning = (beginning + own)[:REMEMBERED]
                counts.update(own)
        return (beginning, counts) if counts else None

    def _know(self, node: int) -> None:
        """Characters of an assignment's value; of a list, none, as its elements are values of their own."""
        work = [node]
        while work:
            at = work[-1]
            if at in self.known:
                work.pop()
                continue
            open_ = [p for value in self.values[at] for p in value if isinstance(p, int) and p not in self.known]
            if open_:
                work += open_
                continue
            self.known[at] = self._joined(self.values[at][0]) if len(self.values[at]) == 1 else None
            work.pop()

    def _report(self, part: tuple, name: str, score: float) -> None:
        start, end = part[:2]
        if end > start and score >= LEAST_SCORE and score > self.found.get((start, end), ("", 0.0))[1]:
            self.found[start, end] = (name, score)

    def reach(self, node: int, name: str, score: float) -> None:
        """Report what a sensitive name reaches: literals that score by themselves, and all literals of joined values that do.

        The walk passes by assignments that one of at least its score has reached, so each is visited once per score.
        """
        walk = [node]
        while walk:
            at = walk.pop()
            if self.reached[at] >= score:
                continue
            self.reached[at] = score
            for value in self.values[at]:
                for part in value:
                    if isinstance(part, int):
                        walk.append(part)
                    else:
                        self._report(part, name, score * literal_score(self.text[part[0] : part[1]], part[2]))
        for value in self.values[node]:
            if len(value) == 1 and not isinstance(value[0], int):
                continue
            for part in value:
                if isinstance(part, int):
                    self._know(part)
            joined = self._joined(value)
            whole = score * _score(*joined, True) if joined else 0.0
            if whole < LEAST_SCORE:
                continue
            for part in value:
                if not isinstance(part, int) and part[2]:
                    self._report(part, name, whole)
            walk = [p for p in value if isinstance(p, int)]
            while walk:
                at = walk.pop()
                if self.whole[at] >= whole:
                    continue
                self.whole[at] = whole
                for own in self.values[at]:
                    for part in own:
                        if isinstance(part, int):
                            walk.append(part)
                        elif part[2]:
                            self._report(part, name, whole)


def _closed(text: str, start: int, missing: set[str]) -> tuple[int, int, int] | None:
    """(start, end, after) of the text in triple quotes at ``start``, or None; ``missing`` holds quotes that close nowhere further on."""
    mark = text[start : start + 3]
    if mark not in ('"""', "'''") or mark in missing:
        return None
    end = text.find(mark, start + 3)
    if end < 0:
        missing.add(mark)
        return None
    return start + 3, end, end + 3


def literal_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, target name, score) of the literals that reach a sensitive name."""
    constants = Constants(text)
    named = constants.named
    missing: set[str] = set()
    chain: list[str] = []
    resume = chained = 0
    while pair := _PAIR.search(text, resume):
        if pair.start() != chained:
            chain = []
        name, values, after = pair["tag"] or pair["name"] or pair["flag"], [[]], pair.end()
        if pair["chained"] is not None:
            chain.append(name)
            resume = chained = after
            continue
        if pair["tag"]:
            values = [[(pair.start("body"), pair.end("body"), True)]]
        else:
            opened = pair["open"] or ""
            if any(c.lower() not in CONVERSIONS for c in _CALLEES.findall(opened)) or (opened and (text[pair.start("first")] not in "\"'`" or _KEYED.match(text, after))):
                # an unknown call, or brackets around something else than literals: what is inside is read by itself
                if "(" in opened and _CALLEES.search(opened):
                    start = pair.start("open")
                    values[0].append((start, start + len(re.match(r"[\w$:.]*", text[start:after])[0]), False))
                resume = pair.end("open")
                constants.named[name] = constants.add(values)
                chain = []
                continue
            if pair["type"]:
                values[0].append((*pair.span("type"), False))
                values.append([])
            at, group = pair, "first"
            while at:
                start, end = at.span(group)
                if triple := _closed(text, start, missing):
                    values[-1].append((*triple[:2], True))
                    after = triple[2]
                elif text[start] in "\"'`":
                    values[-1].append((start + 1, end - 1, True))
                    after = at.end()
                else:
                    values[-1].append(named[text[start:end]] if text[start:end] in named else (start, end, False))
                    after = at.end()
                at = _MORE.match(text, after)
                group = at.lastindex if at else 0
                if not at and opened and (at := _NEXT.match(text, after)):
                    values.append([])
                    group = 1
        resume = after
        node = constants.add([v for v in values if v] or [[]])
        score = name_score(name)
        for target in [*chain, name]:
            named[target] = node
            if name_score(target) > score:
                name, score = target, name_score(target)
        chain = []
        # "note: password = x" may be a word and a pair as well
        if pair["type"] and name_score(pair["type"]) > score:
            name, score = pair["type"], name_score(pair["type"])
            named[name] = node
        if score:
            constants.reach(node, name, score)
    for call in _CALL.finditer(text):
        group = "value" if call["name"] else "keyed"
        start, end = call.span(group)
        value = text[start + 1 : end - 1]
        if call["name"] and _ASKING.match(call["name"]) or not call["name"] and not re.search("[0-9]", value):
            continue
        constants._report((start + 1, end - 1), call["name"] or call["key"], name_score(call["name"] or call["key"]) * literal_score(value, True))
    return [(start, end, name, value) for (start, end), (name, value) in sorted(constants.found.items())]


def scan(text: str) -> list[tuple[str, int, int, int, str, float]]:
    """(kind, start, end, value_start, name, score) of all spans, by start, then kind."""
    low = text.lower()
    hinted = any(s in low for s in STEMS)
    spans = []
    if hinted:
        rule, group, least = BASE["assign"]
        spans += [("assign", *m.span(), m.start(2), m[1], 1.0) for m in rule.finditer(text) if len(m[group]) >= least]
    if "AKIA" in text:
        spans += [("access", *m.span(), m.start(), "", 1.0) for m in BASE["access"][0].finditer(text) if len(m[0]) >= BASE["access"][2]]
    if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX):
        spans += [("hex", *m.span(), m.start(), "", 1.0) for m in BASE["hex"][0].finditer(text)]
    if hinted:
        base = sorted((s[1], s[2]) for s in spans)
        reach, k = 0, 0
        for start, end, name, score in literal_spans(text):
            while k < len(base) and base[k][0] < end:
                reach = max(reach, base[k][1])
                k += 1
            if reach <= start:
                spans.append(("literal", start, end, start, name, score))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def mask(text: str, spans, word: str = "[REDACTED]") -> str:
    """The text with every secret value replaced; overlapping values are replaced once."""
    out, at = [], 0
    for start, end in sorted((s[3], s[2]) for s in spans):
        if start >= at:
            out.append(text[at:start])
            out.append(word)
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = "array<struct<kind:string,start:int,end:int,value_start:int,name:string,score:double>>"
_ARROW = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("name", pa.string()), ("score", pa.float64())])
)


def find_secrets(docs: DataFrame, text: str = "text", redact: bool = False) -> DataFrame:
    """``docs`` without its text and with ``spans``; with ``redact`` also ``redacted``, the text with values masked."""
    kept = Carried(docs, text, "body", ["spans", *["redacted"] * redact])
    names, fields = kept.names, [f.name for f in _ARROW.value_type]

    def run(batches):
        for batch in batches:
            for part in W.slices(batch, "body"):
                texts = part.column("body").to_pylist()
                found = [scan(t) if t else [] for t in texts]
                out = [*[part.column(n) for n in names], pa.array([[dict(zip(fields, s)) for s in f] for f in found], _ARROW)]
                if redact:
                    out.append(pa.array([mask(t, f) if f else t for t, f in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [*names, "spans", *["redacted"] * redact])

    done = kept.plain.mapInArrow(run, kept.schema(f"spans {_SPAN}" + ", redacted string" * redact))
    return kept.back(done, "spans", *["redacted"] * redact)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")


@query("op1_secrets")
def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [_count(kind).alias(f"n_{kind}") for kind in BASE]
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
