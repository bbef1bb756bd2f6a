"""Secret scans: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer finds what gives a name a value, wherever it stands (code, comments, configuration, inside other literals): a bare or quoted
name, also as an option (``--name``), a subscript (``x["name"]``) or an array (``name[]``), a type annotation if there is one, one of the signs
``=``, ``:=``, ``=>``, ``:``, ``+=``, ``?=``, ``||=``, and an expression; further several names with as many expressions (``a, b = "...", "..."``), typed
declarations (``var name type = ...``), lists, each element by itself, macros (``#define name "..."``), calls of a name with its value (``define("name", "...")``,
``getenv("name", "...")``), block scalars (``name: |``), elements
(``<name>...</name>``) and attributes (``<x name="name" value="..."/>``). An expression is made of literals (single, double, triple
and back quotes, prefixes, escapes, bare words) and names, joined by ``+``, ``.``, ``..``, ``&`` or by nothing, in brackets or over
continued lines, with comments in between; a literal after ``or``, ``||``, ``??`` or as a call's second argument is a default. Literals can hold names in braces. A block that
holds another block is a document, not a literal: its innermost blocks are. What each name holds is kept, so a literal is followed through names
(``k = "..."`` ... ``password = k``, in either order), sums and templates. What reaches a sensitive name counts if it looks random enough; both
scores are multiplied. Kept are which literals and names a value is made of and how often it has each character, not its
text, so time and memory are linear in the text whatever names are made of.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

#: The patterns of the contract. Where only the length of a greedy run decides, the run has it as its least.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "named")

HEAD = re.compile(
    r"""(?<![\w.-])-{0,2}["']?([A-Za-z_][A-Za-z0-9_.-]*+)(?:["']\]?|\[\w*\])?[\x20\t]*+(:=|=>|[+?]=|\|\|=|[:=](?![:=]))[\x20\t]*+"""
)
#: After a colon: a type, then what follows its name up to the sign of a value. A sign without space around it belongs to a bare word, unless a quote follows.
TYPE = re.compile(r"[*&]?[A-Za-z_][\w.:]*+")
TYPED = re.compile(r"""(?:\[(?:[^\[\]\n=]|\[[^\[\]\n=]*\])*\]|<[^<>\n=]*>)?[?!*&]*(?:[\x20\t]*\|[\x20\t]*[A-Za-z_][\w.]*+)*(?:[\x20\t]+=(?![=>])|=(?=["'`]))[\x20\t]*+""")
#: Heads with other targets than the name before the sign: several names, and a name before its type.
SEVERAL = re.compile(r"(?m)^[\x20\t]*+(?:(?:const|let|var|my|local)[\x20\t]+)?[(\[]?((?:\$?[A-Za-z_]\w*+,[\x20\t]*+)++\$?[A-Za-z_]\w*+)[)\]]?[\x20\t]*+:?=(?![=>])[\x20\t]*+")
DECLARED = re.compile(r"\b(?:var|const|let|Dim|static)[\x20\t]++([A-Za-z_]\w*+)[\x20\t]++(?:As[\x20\t]++)?[*&\[\]\w.]++[\x20\t]*+=(?![=>])[\x20\t]*+")
#: A name and its value without a sign.
MACRO = re.compile(r"""(?m)^[\x20\t]*+#[\x20\t]*+define[\x20\t]++([A-Za-z_]\w*+)[\x20\t]++(?=[A-Z]{0,2}["'])""")
PUT = re.compile(r"""\b(?:define|getenv|setenv|putenv|getProperty|setProperty|get|set|env|fetch)\(\s*+["']([A-Za-z_][\w.-]*+)["']\s*+,\s*+(?=[A-Za-z]{0,2}["'`])""")
STRING = re.compile(
    r"""([A-Za-z]{0,2})(?:"{3}((?:[^"\\]|\\.|"(?!""))*+)"{3}|'{3}((?:[^'\\]|\\.|'(?!''))*+)'{3}|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`)""",
    re.S,
)
BARE = re.compile(r"[A-Za-z0-9_.+/=$%{}<>!@^&*~-]+")
#: A bare word that is a name, not a literal: no digit, no other sign.
NAME = re.compile(r"[A-Za-z_][A-Za-z_.]*")
COMMENT = re.compile(r"#|//|--|/\*")
BLANK, LINES = re.compile(r"(?:[\x20\t]|\\\r?\n)*+"), re.compile(r"(?:[\x20\t\r\n]|\\\r?\n)*+")
JOINER = re.compile(r"\+(?=[\s\"'`A-Za-z_(])|\.\.?(?=[\s\"'])|&(?=[\s\"'])|(?:or|\|\||\?\?|\?:)(?=[\x20\t]*+[\"'`])")
#: What a call of unknown value is asked for, up to its default: its second argument, or what follows an ``or``.
DEFAULTED = re.compile(r"""\([\x20\t]*+(?:"[^"\n]*+"|'[^'\n]*+')[\x20\t]*+,[\x20\t]*+(?=["'`])|\([^()\n]*+\)[\x20\t]*+(?:or|\|\||\?\?|\?:)[\x20\t]*+(?=["'`])""")
WRAPPER = re.compile(r"(?:new\s+)?(?:[A-Za-z_]\w*\.)*(?:Secret|SecretStr|SecureString|String|str|bytes|b64decode|from)\(")
HOLE = re.compile(r"[$#]?\{([A-Za-z_][A-Za-z0-9_.-]*)[^{}\n]*\}|\$([A-Za-z_]\w*)")
BLOCK_SIGN = re.compile(r"[|>][+-]?[\x20\t]*+\r?\n")
BLOCK_HEAD = re.compile(r":[\x20\t]*+[|>][+-]?[\x20\t]*+\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>]+)</\1\s*>")
TAG = re.compile(r"<[A-Za-z_][^<>]*+>")
ATTRIBUTE = re.compile(r"""([A-Za-z_][\w.:-]*+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
ARMOUR = re.compile(r"-----[A-Z\x20]+-----")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
PLACEHOLDER = re.compile(r"(?i)(.)\1*|[<$%{].*|.*(your|change.?me|example|placeholder|dummy|redacted|xxxx|\*\*\*).*|none|null|true|false")

SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "token": 0.9, "bearer": 0.9, "auth": 0.9, "pass": 0.9, "pin": 0.5}
#: Before "key".
KEY_OF = {"api", "access", "private", "secret", "signing", "encryption", "master", "account", "auth", "ssh", "client"}
#: Last parts of names that speak about a secret and don't hold it.
ABOUT = {"count", "length", "size", "type", "name", "id", "url", "uri", "path", "file", "policy", "max", "min", "limit", "expiry", "ttl", "hint", "field", "label"}
THRESHOLD = 0.5


def name_score(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[-1] in ABOUT or "public" in parts:
        return 0.0
    keys = [1.0 for a, b in zip(parts, parts[1:]) if b in ("key", "keys") and a in KEY_OF]
    return max([0.0, *keys, *(SENSITIVE.get(p) or SENSITIVE.get(p.removesuffix("s"), 0.0) for p in parts)])


class Value:
    """What an expression is made of: characters and how often each occurs (as shares of size once they are many), and parts."""

    __slots__ = ("size", "counts", "spaced", "empty_like", "parts", "told")

    def __init__(self) -> None:
        self.size, self.counts, self.spaced, self.empty_like, self.told = 0.0, {}, False, True, False
        self.parts: list[Value | tuple[int, int]] = []

    def add_literal(self, text: str, span: tuple[int, int]) -> None:
        """A literal without what is filled into it; line ends with their indent and armour lines are no part of its value."""
        text = re.sub(r"\s*\n\s*", "", ARMOUR.sub("", text).strip())
        self.size += len(text)
        for c, n in Counter(text).items():
            self.counts[c] = self.counts.get(c, 0) + n
        self.spaced |= any(c.isspace() for c in text)
        self.empty_like &= not text or bool(PLACEHOLDER.fullmatch(text))
        self.parts.append(span)

    def add(self, other: Value) -> None:
        self.size += other.size
        for c, n in other.counts.items():
            self.counts[c] = self.counts.get(c, 0) + n
        if self.size > 1e9:
            # Only shares matter from here on.
            scale = 1e6 / self.size
            self.size, self.counts = 1e6, {c: n * scale for c, n in self.counts.items()}
        self.spaced |= other.spaced
        self.empty_like &= other.empty_like
        self.parts.append(other)

    def score(self) -> float:
        """How much it looks like a secret, 0 to 1: by entropy and by kinds of characters."""
        if self.size < 8 or self.spaced or self.empty_like:
            return 0.0
        entropy = -sum(k / self.size * math.log2(k / self.size) for k in self.counts.values())
        kinds = [False] * 4
        for c in self.counts:
            kinds[0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3] = True
        return min(1.0, entropy / 3.0) * min(1.0, 0.35 + 0.25 * (sum(kinds) - 1))

    def tell(self, found: dict[tuple[int, int], None]) -> None:
        """Adds the spans of all literals that it is made of; each value does so once."""
        todo = [self]
        while todo:
            value = todo.pop()
            if value.told:
                continue
            value.told = True
            for part in value.parts:
                if isinstance(part, Value):
                    todo.append(part)
                else:
                    found[part] = None


class Lexer:
    """Reads one text: what names hold, in order of the text."""

    def __init__(self, text: str):
        self.text = text
        self.held: dict[str, Value] = {}
        self.found: dict[tuple[int, int], None] = {}
        self.stops: dict[str, list[int]] = {}
        #: Names that are made of one that nothing is known of yet, by that.
        self.waiting: dict[str, list[str]] = {}
        #: The last type met: where its name ends, and where its value begins (None without one).
        self.typed: tuple[int, int | None] = (0, None)
        #: Where the last list ends that was read element by element, and the last expression.
        self.listed = self.stop = 0
        #: Of each line: begin, indent, and the next line that is indented less; begins of all blocks. Made when the first block is met.
        self.lines: list[tuple[int, int]] | None = None

    def after(self, mark: str, at: int) -> int:
        """Behind the next mark from at on (the text's end without one), from a list of all, made once."""
        if mark not in self.stops:
            self.stops[mark] = [m.start() for m in re.finditer(re.escape(mark), self.text)]
        k = bisect_left(self.stops[mark], at)
        return self.stops[mark][k] + len(mark) if k < len(self.stops[mark]) else len(self.text)

    def give(self, name: str, value: Value, more: bool = False) -> None:
        if not value.parts:
            return
        if more and name in self.held:
            both = Value()
            both.add(self.held[name])
            both.add(value)
            value = both
        given = [name]
        while given:
            one = given.pop()
            self.held[one] = value
            if (score := name_score(one)) and score * value.score() >= THRESHOLD:
                value.tell(self.found)
            given += self.waiting.pop(one, ())

    def literal(self, value: Value, begin: int, end: int) -> None:
        """Adds the literal, without white space around it, and the names that are filled into it."""
        raw = self.text[begin:end]
        own = raw.strip()
        begin += len(raw) - len(raw.lstrip())
        holes = [m for m in HOLE.finditer(own) if (m[1] or m[2]) in self.held]
        for m in holes:
            value.add(self.held[m[1] or m[2]])
        if own:
            at, kept = 0, []
            for m in holes:
                kept.append(own[at : m.start()])
                at = m.end()
            kept = "".join([*kept, own[at:]])
            if kept:
                value.add_literal(kept, (begin, begin + len(own)))

    def blank(self, at: int, depth: int) -> int:
        """Where the next term can stand: in brackets, line ends and comments are passed over as well."""
        while True:
            at = (LINES if depth else BLANK).match(self.text, at).end()
            m = depth and COMMENT.match(self.text, at)
            if not m:
                return at
            at = self.after("*/" if m[0] == "/*" else "\n", m.end())

    def expression(self, at: int) -> Value:
        value, depth, joined, text = Value(), 0, True, self.text
        first, self.unknown = True, None
        while True:
            at = self.blank(at, depth or (joined and not first))
            if joined and (m := WRAPPER.match(text, at)):
                at, depth = m.end(), depth + 1
            elif joined and text.startswith(("(", "["), at):
                at, depth = at + 1, depth + 1
            elif depth and text.startswith((")", "]"), at):
                at, depth, joined = at + 1, depth - 1, False
            elif m := STRING.match(text, at):
                # Literals that follow each other are one; after a name, a quote begins something else.
                k = m.lastindex
                self.literal(value, *m.span(k))
                at, joined, first = m.end(), False, False
            elif joined and (m := BARE.match(text, at)):
                at, joined = m.end(), False
                alone = first and not depth and not text.startswith("(", at) and not JOINER.match(text, self.blank(at, 0))
                if m[0] in self.held:
                    value.add(self.held[m[0]])
                elif alone and not NAME.fullmatch(m[0]):
                    self.literal(value, *m.span())
                elif alone:
                    self.unknown = m[0]
                # Else a name of which nothing is known, or a call.
                if not depth and (m := DEFAULTED.match(text, at)):
                    at, depth, joined = m.end(), m[0].count("(") - m[0].count(")"), True
                elif alone or text.startswith("(", at):
                    self.stop = at
                    return value
                first = False
            else:
                m = None if joined else JOINER.match(text, at)
                if not m:
                    self.stop = at
                    return value
                at, joined = m.end(), True

    def outline(self) -> None:
        """Lines with their indents, the next line indented less of each (blank ones count as deeper than all), and where blocks begin."""
        text, at, self.lines, open_ = self.text, 0, [], []
        self.less: list[int] = []
        while at < len(text):
            stop = text.find("\n", at)
            stop = len(text) if stop < 0 else stop
            own = text[at:stop]
            indent = len(own) - len(own.lstrip(" \t")) if own.strip() else len(text)
            while open_ and self.lines[open_[-1]][1] > indent:
                self.less[open_.pop()] = len(self.lines)
            open_.append(len(self.lines))
            self.lines.append((at, indent))
            self.less.append(-1)
            at = stop + 1
        self.blocks = [m.end() for m in BLOCK_HEAD.finditer(text)]

    def block(self, head: int, at: int) -> Value:
        """The lines of a block scalar: all that are indented deeper than the line that head stands in. Nothing if another block begins in it."""
        if self.lines is None:
            self.outline()
        text, value = self.text, Value()
        k = bisect_left(self.lines, (at, -1))
        line = self.lines[k - 1][0]
        indent = len(text[line:head]) - len(text[line:head].lstrip(" -"))
        while 0 <= k < len(self.lines) and self.lines[k][1] > indent:
            k = self.less[k]
        end = self.lines[k][0] if 0 <= k < len(self.lines) else len(text)
        inner = bisect_right(self.blocks, at)
        if inner == len(self.blocks) or self.blocks[inner] > end:
            self.literal(value, at, end)
        return value

    def annotated(self, at: int) -> int:
        """Behind the type and the sign that begin at at, or at itself. Of a chain of words with colons, which all end alike, the end is tried once."""
        end, begin = self.typed
        if at >= end:
            if not (m := TYPE.match(self.text, at)):
                return at
            m = TYPED.match(self.text, end := m.end())
            self.typed = end, (begin := m and m.end())
        elif not (self.text[at] == "_" or self.text[at].isascii() and self.text[at].isalpha()):
            return at
        return at if begin is None else begin

    def elements(self, name: str, at: int) -> None:
        """Gives name each element of the list that begins at at, by itself; of nested lists only the outermost is read so."""
        value = self.expression(at + 1)
        while True:
            self.give(name, value)
            at = self.blank(self.stop, 1)
            if self.stop == at == self.listed or not self.text.startswith(",", at):
                break
            self.listed = at + 1
            value = self.expression(self.blank(at + 1, 1))
        self.listed = max(self.listed, at)

    def give_at(self, name: str, at: int, more: bool = False) -> None:
        """Gives name what is written at at."""
        if self.text.startswith(("[", "{"), at) and at >= self.listed:
            self.elements(name, at)
            return
        value = self.expression(at)
        if self.unknown and self.unknown != name and not value.parts:
            self.waiting.setdefault(self.unknown, []).append(name)
        self.give(name, value, more)

    def read(self) -> list[tuple[int, int]]:
        """Spans of literals that reach a sensitive name, each once."""
        text = self.text
        others = {m.end(): [n.strip(" \t$") for n in m[1].split(",")] for m in SEVERAL.finditer(text)}
        others.update((m.end(), [m[1]]) for m in DECLARED.finditer(text))
        for m in HEAD.finditer(text):
            at = m.end()
            if at in others:
                for name in others[at]:
                    self.give_at(name, at)
                    at = self.blank(self.stop, 0)
                    if not text.startswith(",", at):
                        break
                    at = self.blank(at + 1, 1)
                continue
            if m[2] == ":" and (sign := BLOCK_SIGN.match(text, at)):
                self.give(m[1], self.block(m.start(), sign.end()))
                continue
            if m[2] == ":":
                at = self.annotated(at)
            self.give_at(m[1], at, more=m[2] == "+=")
        for pattern in (MACRO, PUT):
            for m in pattern.finditer(text):
                self.give_at(m[1], m.end())
        if "<" in text:
            for m in ELEMENT.finditer(text):
                value = Value()
                self.literal(value, *m.span(2))
                self.give(m[1], value)
            for tag in TAG.finditer(text):
                named = {m[1].lower(): m for m in ATTRIBUTE.finditer(text, *tag.span())}
                name = next((named[k] for k in ("name", "key", "id") if k in named), None)
                for k in ("value", "default"):
                    if name and k in named:
                        value = Value()
                        self.literal(value, *named[k].span(named[k].lastindex))
                        self.give(name[name.lastindex], value)
        return list(self.found)


def named_literals(text: str) -> list[tuple[int, int]]:
    """Spans of literals that reach a sensitive name, each once."""
    return Lexer(text).read()


def spans(text: str) -> list[tuple[int, int, int, int]]:
    """(kind's number, start, end, where the secret itself starts), by start, then kind; code points, end exclusive.

    The method's own spans that overlap a base one are left out.
    """
    out = []
    joined = "=" in text or ":" in text
    if joined:
        out += [(0, *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    out += [(1, *m.span(), m.start()) for m in ACCESS.finditer(text)]
    out += [(2, *m.span(), m.start()) for m in HEX.finditer(text)]
    if joined or "</" in text or "define" in text or "," in text and "(" in text:
        # The furthest end of the base spans that begin before each of them.
        base = sorted((s, e) for _, s, e, _ in out)
        begins, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max))
        for a, b in named_literals(text):
            k = bisect_left(begins, b)
            if not k or reach[k - 1] <= a:
                out.append((3, a, b, a))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def digest(found: list[tuple[int, int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _ in found)


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with each secret replaced by mark (of an assignment, its value); overlapping ones by one mark."""
    out, done = [], 0
    for begin, end in sorted((s[3], s[2]) for s in spans(text)):
        if begin >= done:
            out += [text[done:begin], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_named, base_sha256, spans for each row of docs (doc_id, text).

    A null or empty text has no spans. Repeated rows, null ids and other columns make no difference; whole texts are
    scanned, each by itself. An empty table gives an empty result.
    """
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = spans(text or "")
                counts = [sum(s[0] == k for s in found) for k in range(len(KINDS))]
                base = digest([s for s in found if s[0] < 3])
                rows.append((doc, *counts, hashlib.sha256(base.encode()).hexdigest(), digest(found)))
            kinds = [pa.int64()] * (1 + len(KINDS)) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns whatever their names, with secrets in text replaced and n_chars (if there) counted anew for those.

    Null and empty texts stay as they are, as do null ids and repeated rows. An empty table gives an empty result.
    """

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            old = part.column("text").to_pylist()
            new = [redact(t) if t else t for t in old]
            if new != old:
                at = part.schema.get_field_index("text")
                part = part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))
                if (at := part.schema.get_field_index("n_chars")) >= 0:
                    counts = [len(b) if a != b else n for a, b, n in zip(old, new, part.column(at).to_pylist())]
                    part = part.set_column(at, part.schema.field(at), pa.array(counts, part.schema.field(at).type))
            yield part

    return docs.mapInArrow(replace, docs.schema)
