"""Operator 8: secrets found by assignment-aware lexing, beside three fixed patterns.

A scanner goes once over a text and gives name-literal pairs in order: assignments and declarations (name = "x", name: type = "x", name := "x",
name => "x", "name": "x", x["name"] = "x", export NAME=x), elements of arrays and maps under a name, arguments of calls (set_name("x"),
put("name", "x")), strings with prefixes, escapes, triple quotes and back quotes, joined by + or by standing side by side, f-strings, YAML
blocks and lists, XML elements and key-value attributes. A name on the right stands for its last definition before that place, through any
number of steps. A value is scored by the most sensitive name that it reaches and by its own look; the literals of those at or
above the threshold become spans of kind `literal`, unless a fixed pattern already covers them.

Every step takes time linear in the text (up to sorting). For a score, a joined value counts with its first SCORED characters.

Nulls and edge cases: a null or empty text has no spans (counts 0, the hash of the empty string, empty spans); repeated
rows each give a row; a null doc_id stays null; an empty table gives an empty result; other columns are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

KINDS = ("assign", "access", "hex", "literal")
# The three base patterns, with letters in either case spelled out (so that no other letter folds to them).
_ASSIGN = re.compile(
    r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# How telling a part of a name is, alone or joined to the next part.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.7, "secret": 1.0, "secrets": 1.0, "token": 0.9,
    "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "secretkey": 1.0, "authkey": 1.0, "credential": 0.9, "credentials": 0.9,
    "auth": 0.6, "bearer": 0.8, "key": 0.5, "private": 0.4, "signature": 0.5, "salt": 0.5, "pin": 0.5,
}
_PLACEHOLDER = re.compile(r"(?i)(?:change.?me|example|placeholder|your[_-]|dummy|none|null|true|false|x{4,}|\*{3,}|\$\{.*|\$\(.*|<.*>|%.*%|\{\{.*)")


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _NAME_PARTS.findall(name)]
    return max([0.0, *(SENSITIVE.get(p, SENSITIVE.get(p.removesuffix("s"), 0.0)) for p in parts), *(SENSITIVE.get(a + b, 0.0) for a, b in zip(parts, parts[1:], strict=False))])


_KINDS = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")]
SCORED = 4096
#: What the name around a value (of its map, array or call) counts beside the value's own.
AROUND = 0.9


def literal_weight(value: str) -> float:
    """0 to 1: by length, by the entropy of the characters, and by the kinds of characters."""
    if len(value) < 6 or _PLACEHOLDER.match(value) or value.isdigit() and len(value) < 10:
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(bool(p.search(value)) for p in _KINDS)
    spread = 0.5 if re.search(r"\s", value) else 1.0
    return spread * (0.4 * min(1.0, n / 16) + 0.4 * min(1.0, entropy / 3.5) + 0.2 * min(1.0, (kinds - 1) / 2))


_TOKEN = re.compile(
    r"""[ \t\r\f\v]*+(?:(?P<name>[A-Za-z_$@][A-Za-z0-9_$]*+(?:[.-][A-Za-z0-9_$]++)*+)|(?P<line>\n)|(?P<op>[=!]==?|<=|>=|::|:=|=>|[=:])|(?P<quote>\"\"\"|'''|["'`])|(?P<open>[\[({])|(?P<close>[\])}])|(?P<mark>[,;<+])|(?P<other>\\.|[0-9][A-Za-z0-9_]*+|.))""",
    re.DOTALL,
)
_ONE_LINE = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}", re.DOTALL) for q in "\"'"}
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_NAME = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$]*+(?:[.-][A-Za-z0-9_$]++)*+")
_KEY = re.compile(r"[A-Za-z_$@][A-Za-z0-9_$ .:/-]{0,199}")
_TYPED = re.compile(r"""[ \t]*+[&*A-Za-z_][A-Za-z0-9_.&*\[\]<>,|? ]{0,80}?=[ \t]*+[A-Za-z]{0,2}["'`]""")
_JOIN = re.compile(r"""[ \t]*+(?:(?:\+|\.\.?|&)\s*+)?(?=[A-Za-z]{0,2}["'`]|[A-Za-z_$])""")
_PREFIX = re.compile(r"""[rRbBuUfFlL@$]{1,2}(?=["'`])""")
_BLOCK = re.compile(r"[ \t]*+[|>][-+0-9]*+[ \t]*+\n")
_ITEM = re.compile(r"[ \t]*+-[ \t]++(?![\"'\[{])([^\s:#][^\s#]*+)[ \t]*+(?:\n|$)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)>")
_INSIDE = re.compile(r"\{([^{}]*+)\}")
_WORDS = re.compile(r"[A-Za-z$@_.-]*+\Z")


@dataclass
class Value:
    """What a name was given from a place on: literals as (start, end, formatted) and names, in order; and the name around it."""

    name: str
    around: str | None
    at: int
    parts: list[tuple[int, int, bool] | str]


class _Scanner:
    def __init__(self, text: str):
        self.text, self.found = text, []
        self.unclosed: set[str] = set()  # quotes over several lines that never close again

    def string(self, quote: str, at: int) -> tuple[int, int, int] | None:
        """(start, end, next) of the string whose opening quote ends before `at`."""
        if len(quote) == 3 or quote == "`":
            end = -1 if quote in self.unclosed else self.text.find(quote, at)
            if end < 0:
                self.unclosed.add(quote)
                return None
            return at, end, end + len(quote)
        m = _ONE_LINE[quote].match(self.text, at)
        return (at, m.end() - 1, m.end()) if m else None

    def operand(self, at: int) -> tuple[tuple[int, int, bool] | str | None, int]:
        """A string or a name at a place, and the next place."""
        prefix = _PREFIX.match(self.text, at)
        formatted = prefix is not None and any(c in "fF$" for c in prefix.group())
        if prefix:
            at = prefix.end()
        quote = self.text[at : at + 3] if self.text[at : at + 3] in ('"""', "'''") else self.text[at : at + 1]
        if quote and quote[0] in "\"'`":
            got = self.string(quote, at + len(quote))
            if got is None and len(quote) == 3:
                got = self.string(quote[0], at + 1)
            return ((got[0], got[1], formatted or quote == "`"), got[2]) if got else (None, at + 1)
        if name := _NAME.match(self.text, at):
            return name.group(), name.end()
        return None, at

    def joined(self, first, at: int) -> tuple[list, int]:
        """The operand and those joined to it."""
        parts = [first]
        while (m := _JOIN.match(self.text, at)) is not None:
            plain = not self.text[at : m.end()].strip()
            if plain and (isinstance(parts[-1], str) or self.text[m.end()] not in "\"'" and not _PREFIX.match(self.text, m.end())):
                break  # only strings join by standing side by side
            part, to = self.operand(m.end())
            if part is None:
                break
            parts.append(part)
            at = to
        return parts, at

    def value(self, name: str, around: str | None, op: str, at: int) -> int:
        """What follows an operator: records it, and gives the place to go on from."""
        text = self.text
        if op == ":" and (typed := _TYPED.match(text, at)):
            at = text.index("=", at) + 1 if "=" in text[at : typed.end()] else at
        if op in (":", "=") and (block := _BLOCK.match(text, at)):
            return self.block(name, around, block.end(), text.rfind("\n", 0, at) + 1, at)
        start = at
        while at < len(text) and text[at] in " \t\r":
            at += 1
        if at >= len(text) or text[at] == "\n":
            if op == ":" and at < len(text):
                return self.items(name, around, at + 1)
            return at
        part, to = self.operand(at)
        if part is None or isinstance(part, str):
            bare = _BARE.match(text, at)
            if bare is None:
                return at if text[at] not in "\"'`" else at + 1
            if isinstance(part, str) and text[to : to + 1] == "(":
                return at  # a call
            if not isinstance(part, str) or to < bare.end():
                self.add(name, around, start, [(at, bare.end(), False)])
                return bare.end()
        parts, to = self.joined(part, to)
        self.add(name, around, start, parts)
        return to

    def add(self, name: str, around: str | None, at: int, parts: list) -> None:
        self.found.append(Value(name, around, at, parts))

    def block(self, name: str, around: str | None, at: int, line: int, start: int) -> int:
        """The more deeply indented lines from a place on, each a literal of the name."""
        text, own = self.text, 0
        while line + own < len(text) and text[line + own] in " \t-":
            own += 1
        parts: list = []
        while at < len(text):
            end = text.find("\n", at)
            end = len(text) if end < 0 else end
            row = text[at:end]
            if row.strip():
                indent = len(row) - len(row.lstrip())
                if indent <= own:
                    break
                parts.append((at + indent, at + len(row.rstrip()), False))
            at = end + 1
        if parts:
            self.add(name, around, start, parts)
        return min(at, len(text))

    def items(self, name: str, around: str | None, at: int) -> int:
        while m := _ITEM.match(self.text, at):
            self.add(name, around, at, [(m.start(1), m.end(1), False)])
            if m.end() == at:
                break
            at = m.end()
        return at

    def scan(self) -> list[Value]:
        text, at, size = self.text, 0, len(self.text)
        last: str | None = None  # the name just before
        key: str | None = None  # of key="name" value="literal"
        stack: list[list] = []  # open brackets: their name (or that around them), the last string in them, how many strings
        next_name: str | None = None
        while at < size and (m := _TOKEN.match(text, at)):
            kind, token = m.lastgroup, m.group(m.lastgroup)
            start, at = m.start(kind), m.end()
            if kind == "name":
                last = token
            elif kind == "op":
                if last is not None and token not in ("<=", ">=", "::"):
                    name, last = last, None
                    inside = stack[-1][0] if stack else None
                    to = self.value(name, inside, token, at)
                    made = self.found[-1] if self.found and self.found[-1].at >= start and to > at else None
                    if made and len(made.parts) == 1 and not isinstance(made.parts[0], str):
                        content = text[made.parts[0][0] : made.parts[0][1]]
                        if name.lower() in ("key", "name", "id") and _KEY.fullmatch(content):
                            key = content
                        elif name.lower() == "value" and key is not None:
                            made.name, key = key, None
                    while to < size and text[to] in " \t":
                        to += 1
                    next_name = name if to < size and text[to] in "[({" else None
                    at = max(at, to)
                last = None
            elif kind == "quote":
                if last is not None and at - len(token) - len(last) >= 0 and text[start - len(last) : start] == last and _PREFIX.match(text, start - len(last)):
                    at = start - len(last)  # a prefix
                else:
                    at = start
                part, to = self.operand(at)
                last = None
                at = max(to, start + 1)
                if part is None:
                    continue
                content = text[part[0] : part[1]] if part[1] - part[0] <= 200 else ""
                follows = text[to : to + 16].lstrip(" \t")[:1]
                if follows in (":", "=") and _KEY.fullmatch(content):
                    last = content
                    continue
                if stack and follows != "]" or stack and stack[-1][2]:
                    parts, at = self.joined(part, to)
                    at = max(at, start + 1)
                    name, before = stack[-1][:2]
                    if before or name:
                        self.add(before or name, name, start, parts)
                if stack:
                    stack[-1][1] = content if content and _KEY.fullmatch(content) and not stack[-1][2] % 2 else None
                    stack[-1][2] += 1
            elif kind == "open":
                called = last if token == "(" and last is not None and text[start - 1 : start] != " " else None
                stack.append([next_name or called or (stack[-1][0] if stack else None), None, 0])
                next_name = last = None
            elif kind == "close":
                gone = stack.pop() if stack else None
                last = gone[1] if gone and token == "]" and gone[2] == 1 else None
                if gone is None or not stack:
                    key = None
            elif kind == "mark":
                last = None
                if token == ";":
                    key = None
                elif token == "<" and (tag := _ELEMENT.match(text, start)):
                    end = text.find("<", tag.end())
                    if end > tag.end() and text.startswith(f"</{tag.group(1)}", end):
                        body = text[tag.end() : end]
                        lead = len(body) - len(body.lstrip())
                        if body.strip():
                            self.add(tag.group(1), None, start, [(tag.end() + lead, tag.end() + len(body.rstrip()), False)])
                        at = end + 1
            elif kind == "line":
                last = None
                if not stack:
                    key = None
            else:
                last = None
        return self.found


def pairs(text: str) -> list[Value]:
    """The names and what each was given, in order of place."""
    return sorted(_Scanner(text).scan(), key=lambda v: v.at)


def literal_spans(text: str, threshold: float = 0.55) -> list[tuple[int, int, float]]:
    """Spans of sensitive literals with their scores; a name passes its own weight on to what it stands for."""
    found = pairs(text)
    defined: dict[str, int] = {}
    values: list[str] = []
    uses: list[list[int]] = []
    literals: list[list[tuple[int, int]]] = []
    for k, v in enumerate(found):
        made, own, to = [], [], []
        for part in v.parts:
            if isinstance(part, str):
                if part in defined:
                    to.append(defined[part])
                    made.append(values[defined[part]])
                elif len(v.parts) == 1 and not _WORDS.match(part) and v.at >= 0:
                    at = text.index(part, v.at)  # a bare value that looks like a name
                    own.append((at, at + len(part)))
                    made.append(part)
                continue
            start, end, formatted = part
            raw = text[start : min(end, start + SCORED)]
            if formatted and "{" in raw:
                for inner in _INSIDE.findall(raw):
                    if (name := inner.strip(" $")) in defined:
                        to.append(defined[name])
                raw = _INSIDE.sub("", raw)
            if not (end - start < SCORED and _WORDS.match(raw) and text[start - 1 : start] not in ("\"", "'", "`", ">")):
                own.append((start, end))
                made.append(raw)
        values.append("".join(made)[:SCORED])
        uses.append(to)
        literals.append(own)
        defined[v.name] = k
    weight = [max(name_weight(v.name), AROUND * name_weight(v.around or "")) for v in found]
    passed = [0.0] * len(found)
    out: dict[tuple[int, int], float] = {}
    for k in range(len(found) - 1, -1, -1):
        score = passed[k]
        if weight[k]:
            score = max(score, round(weight[k] * literal_weight(values[k]), 9))
        for j in uses[k]:
            weight[j] = max(weight[j], weight[k])
            if score >= threshold:
                passed[j] = max(passed[j], score)
        if score >= threshold:
            for span in literals[k]:
                if span[1] - span[0] >= 4:
                    out[span] = max(out.get(span, 0.0), score)
    return sorted((a, b, x) for (a, b), x in out.items())


_FORMS = {k: rf"(?:(?<![A-Za-z])[{k[0]}{k[0].upper()}]|{k[0].upper()}){k[1:]}s?(?![a-z])|{k.upper()}S?(?![a-z])" for k in SENSITIVE}
_BEHIND = r"""(?:[A-Za-z0-9_.$-]{64}|[A-Za-z0-9_.$-]{0,63}["'`\])]{0,3}[ \t]{0,80}[:=(,>"'A-Za-z!])"""


@cache
def _near(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(f"(?:{'|'.join(_FORMS[w] for w in words)}){_BEHIND}")


def may_assign(text: str) -> bool:
    """Whether a sensitive name, or a part of one, stands where something might be given to it."""
    if not any(c in text for c in "=:(<,"):
        return False
    low = text.lower()
    words = tuple(w for w in SENSITIVE if w in low)
    return bool(words) and _near(words).search(text) is not None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def scan(text: str, threshold: float = 0.55) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and all spans."""
    base = base_spans(text)
    more = []
    if may_assign(text):
        starts, ends, end = [], [], 0
        for x, _, y in base:  # the ends of spans that begin at or before a place, the furthest
            end = max(end, y)
            starts.append(x)
            ends.append(end)
        for s, e, _ in literal_spans(text, threshold):
            before = bisect_left(starts, e)
            if not before or ends[before - 1] <= s:
                more.append((s, 3, e))
    return base, sorted(base + more)


def _write(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Per document: counts of the base kinds, the hash of the base spans, all spans, and how many the lexing adds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = scan(text, threshold)
                counts = Counter(k for _, k, _ in base)
                rows.append((doc, counts[0], counts[1], counts[2], hashlib.sha256(_write(base).encode()).hexdigest(), _write(spans), len(spans) - len(base)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
