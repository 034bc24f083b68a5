"""Secret scans by assignment-aware lexing.

Two layers look at every whole text. The base layer finds three fixed kinds of span. The lexing
layer reads the text as source or configuration: at every assignment sign it takes the target's
name on the left and the value on the right, token by token with a stack of open brackets: joined
literals and names, arguments of calls, lists, pairs in braces or by indentation, triple quotes, bare
words and blocks of lines of a configuration; elements of markup and bearer headers are pairs too. It remembers what each dotted name holds (so ``part = "..."; key =
part + "..."`` leads back to both literals) and scores a value by how sensitive its target's name is,
that of the pair around it included, and how much it looks like a credential. What is joined is
scored as one, elements and arguments each on their own.

Nothing is cut: a name is as long as it is, a value has as many literals as it has. Joined values are
trees that share their parts, and every step looks at a character a bounded number of times, so time
is linear in the text.

Spans are in code points, end exclusive. A lexed span that overlaps a base span is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame

from .common import map_text, unused

KINDS = ("assign", "access", "hex", "literal")
#: Score from which a value counts as a secret; a value of more characters is no placeholder.
THRESHOLD, PLACEHOLDER_CHARS = 0.5, 256
#: Classes of the characters that are not ASCII.
OTHERS = 32

# The base patterns: fixed values of the contract. Only ASCII letters fold their case.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a maximal run of 20 or more
_HEX = re.compile(r"[0-9a-f]{24,}")
_ASSIGN_HINT = re.compile(r"[:=]")

# What words in a target's name say about its literal.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.7, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "secrets": 0.9,
    "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6, "authorization": 0.8, "bearer": 0.9,
    "privatekey": 1.0, "accesskey": 1.0, "secretkey": 1.0, "signingkey": 0.9, "encryptionkey": 0.9, "connectionstring": 0.8,
    "salt": 0.5, "cookie": 0.5, "session": 0.53, "webhook": 0.5, "jwt": 0.8, "pin": 0.5, "key": 0.53,
}
KEY_WORDS = {"api", "private", "access", "secret", "signing", "encryption", "auth", "client", "master", "service", "account", "storage", "ssh"}
MILD = {"public", "hint", "length", "len", "count", "min", "max", "url", "uri", "path", "file", "field", "label", "regex", "pattern", "type", "policy", "expiry", "ttl", "message", "error", "prompt", "placeholder"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|nil|true|false|undefined|changeme|change_me|example\w*|your[_-]?\w*|todo|test|dummy|redacted|<.*>|\$\{?.*|%\(.*|\{\{.*)$")

_OP = re.compile(r"[!=]==?|[<>]=|->|::|\+=|:=|=>|[=:]")
_NO_ASSIGNMENT = {"==", "===", "!=", "!==", "<=", ">=", "->", "::"}
_NAME_END = re.compile(r"[ \t]*([A-Za-z0-9_.$-]+)")  # of the reversed text before a sign
_KEY_END = re.compile(r"""[ \t]*(?:\][ \t]*)?(["'`])""")
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+|\\\n)|(?P<line>\n)|(?P<string>(?:[rbfuRBFU]{1,2}(?=["']))?(?:\"{3}(?P<a>.*?)\"{3}|'{3}(?P<b>.*?)'{3}|"(?P<c>(?:\\.|[^"\\\n])*+)"|'(?P<d>(?:\\.|[^'\\\n])*+)'|`(?P<e>(?:\\.|[^`\\])*+)`))"""
    r"""|(?P<ref>[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z_$][A-Za-z0-9_$]*)*)|(?P<comment>\#[^\n]*|//[^\n]*)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<other>[!=]==?|[<>]=|->|::|[0-9][A-Za-z0-9_.]*)|(?P<sign>\+=|:=|=>|[=:])|(?P<join>\+|\.\.|~|\.|<<)|(?P<comma>[,;])|(?P<any>.)""",
    re.S,
)
_BARE = re.compile(r"""[ \t]*([^\s"'`,;#(){}\[\]<>]+)[ \t]*(?:[,;]|\#[^\n]*)?[ \t\r]*(?=\n|\Z)""")
_ITEM = re.compile(r"""[ \t\r]*\n[ \t]*-[ \t]+(?:"([^"\n]*)"|'([^'\n]*)'|([^\s"'`,;#(){}\[\]<>:]+))[ \t]*(?:\#[^\n]*)?(?=\r?\n|\Z)""")
_NOTHING = re.compile(r"[ \t\r]*(?:#[^\n]*)?(?:\n|\Z)")
_SPACE = re.compile(r"\s")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[0-9]?[+-]?[ \t]*(?:\#[^\n]*)?\r?(?:\n|\Z)")
_LINE = re.compile(r"([ \t]*)([^\n]*)(?:\n|\Z)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*)(?:[ \t\r\n][^<>]*)?>([^<>]*)</([A-Za-z_][A-Za-z0-9_.:-]*)")
_BEARER = re.compile(r"""authorization["']?[ \t]*[:=,][ \t]*[frbFRB]?["']?(?:bearer|basic|token)[ \t]+([A-Za-z0-9._~+/=-]+)""", re.I | re.A)
_CONTINUES = re.compile(r"\s*(?:\+|\.\.|~)")
_LINE_HEAD = re.compile(r"[ \t\-]*(?:(?:export|set|ENV|const|let|var|val|final|static|public|private)[ \t]+)*\Z")
_WORD_OPERATORS = {"or", "and", "if", "else", "not", "await", "new", "return", "str", "String", "bytes"}
_IDENTIFIER = re.compile(r"[A-Za-z]+(?:[_.-][A-Za-z]+)*")
_OWNER = re.compile(r"^(?:self|this)\.")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the three fixed kinds, by start and then by kind."""
    found = []
    if _ASSIGN_HINT.search(text):
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def name_score(name: str) -> float:
    """How sensitive a target's name is, from 0 to 1."""
    words = [w.lower() for w in _WORDS.findall(name)]
    score = max((SENSITIVE.get(w, 0.0) for w in [*words, *(a + b for a, b in zip(words, words[1:], strict=False)), "".join(words)]), default=0.0)
    if words and words[-1] in ("key", "id") and KEY_WORDS & set(words[:-1]):
        score = max(score, 0.9 if words[-1] == "key" else 0.4)
    return score * (0.4 if MILD & set(words) else 1.0)


def _class_counts(value: str) -> np.ndarray:
    """Numbers of characters by class: the ASCII ones each, the others in OTHERS classes by code point."""
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(np.where(codes < 128, codes, 128 + codes % OTHERS), minlength=128 + OTHERS).astype(np.int32)


class Value:
    """A literal or two joined values: its spans as a tree, and what its score needs.

    Counts are of a fixed number of classes, so joining two values takes the same time and memory
    whatever they hold; those of a short literal are counted when they are asked for.
    """

    __slots__ = ("left", "right", "span", "n", "counted", "literal", "text", "spaced", "key_block")

    def __init__(self, text: str, span: tuple[int, int] | None, left: Value | None = None, right: Value | None = None):
        self.left, self.right, self.span, self.counted, self.literal = left, right, span, None, None
        if left is None or right is None:
            value = text[span[0] : span[1]] if span else ""
            self.n = len(value)
            if self.n <= PLACEHOLDER_CHARS:
                self.literal = value
            else:
                self.counted = _class_counts(value)
            self.text = self.literal
            self.spaced, self.key_block = _SPACE.search(value) is not None, "PRIVATE KEY-----" in value
        else:
            self.n = left.n + right.n
            self.counted = left.counts + right.counts
            self.text = left.text + right.text if left.text is not None and right.text is not None and self.n <= PLACEHOLDER_CHARS else None
            self.spaced, self.key_block = left.spaced or right.spaced, left.key_block or right.key_block

    @property
    def counts(self) -> np.ndarray:
        return _class_counts(self.literal or "") if self.counted is None else self.counted

    def score(self) -> float:
        """How much it looks like a credential, from 0 to 1."""
        if self.key_block:
            return 1.0
        if self.n < 6 or self.spaced or self.text is not None and PLACEHOLDER.match(self.text):
            return 0.0
        counts = self.counts
        share = counts[counts > 0] / self.n
        bits = -float((share * np.log2(share)).sum())
        lower, upper, digits = int(counts[97:123].sum()), int(counts[65:91].sum()), int(counts[48:58].sum())
        kinds = bool(lower) + bool(upper) + bool(digits) + (lower + upper + digits < self.n)
        return min(1.0, 0.35 + 0.12 * bits + 0.08 * kinds)


class _Open:
    """An open bracket, or the statement itself: the names that values go to, and the values so far."""

    __slots__ = ("bracket", "path", "targets", "values", "joining", "call", "index_of")

    def __init__(self, bracket: str, path: str, targets: list[str], call: bool = False, index_of: str | None = None):
        self.bracket, self.path, self.targets, self.call, self.index_of = bracket, path, targets, call, index_of
        self.values: list[Value] = []
        self.joining = False

    def add(self, value: Value, follows_string: bool) -> None:
        if self.values and (self.joining or follows_string):
            self.values[-1] = Value("", None, self.values[-1], value)
        else:
            self.values.append(value)
        self.joining = False


class _Lexer:
    def __init__(self, text: str):
        self.text = text
        self.holds: dict[str, Value] = {}
        self.found: dict[tuple[int, int], None] = {}
        self.seen: dict[int, Value] = {}  # parts whose spans are in found
        self.parents: list[tuple[int, str]] = []  # (indent, name) of the open keys of a configuration

    def literal(self, a: int, b: int) -> Value:
        """A literal; one of several lines is what stands between white space."""
        inner = self.text[a:b]
        if "\n" not in inner:
            return Value(self.text, (a, b))
        a += len(inner) - len(inner.lstrip())
        return Value(self.text, (a, a + len(inner.strip())))

    def report(self, value: Value) -> None:
        stack = [value]
        while stack:
            v = stack.pop()
            if id(v) in self.seen:
                continue
            self.seen[id(v)] = v
            if v.span and v.span[1] > v.span[0]:
                self.found[v.span] = None
            stack += [x for x in (v.left, v.right) if x is not None]

    def settle(self, targets: list[str], values: list[Value], adds: bool = False) -> None:
        if not values:
            return
        whole = values[0]
        for v in values[1:]:
            whole = Value("", None, whole, v)
        for name in targets:
            key = _OWNER.sub("", name)
            self.holds[key] = Value("", None, self.holds[key], whole) if adds and key in self.holds else whole
            sensitive = name_score(name)
            for v in [self.holds[key]] if adds else values:
                if sensitive and sensitive * v.score() >= THRESHOLD:
                    self.report(v)

    def statement(self, at: int, name: str, adds: bool) -> int:
        """Reads the value that is assigned to a name and the pairs in it; where it ends."""
        text, size = self.text, len(self.text)
        top = _Open("", name, [name])
        stack = [top]
        before, word = "sign", ""  # the kind of the token before, and its name if it is one
        goes_on = 0  # up to here only white space comes before a sign that joins
        while at < size:
            f = stack[-1]
            m = _TOKEN.match(text, at)
            kind = m.lastgroup if m.lastgroup not in "abcde" else "string"
            if kind == "line" and len(stack) == 1 and not f.joining and at >= goes_on:
                ahead = _CONTINUES.match(text, at)
                if not ahead:
                    break
                goes_on = ahead.end() - 1
            start, at = at, m.end()
            if kind in ("space", "line", "comment"):
                continue
            if kind == "string":
                if before in ("ref", "close", "other") and not f.joining and len(stack) == 1:
                    at = start
                    break
                k = next(g for g in "abcde" if m[g] is not None)
                f.add(self.literal(*m.span(k)), before == "string")
                word = m[k]
            elif kind == "ref":
                if m[0] in _WORD_OPERATORS:
                    before = "any"
                    continue
                if before in ("string", "ref", "close", "other") and not f.joining and len(stack) == 1:
                    at = start
                    break
                word = m[0]
                held = self.holds.get(_OWNER.sub("", word))
                if held is not None and text[at : at + 1] not in ("(", "["):
                    f.add(held, False)
                else:
                    f.joining = False
            elif kind == "open":
                touching = before in ("ref", "close") and text[start - 1 : start] not in (" ", "\t", "\n")
                index_of = word if m[0] == "[" and touching else None
                path = f.targets[-1].rpartition(".")[2] if f.targets else f.path
                stack.append(_Open(m[0], path, [], m[0] == "(" and touching, index_of))
                before, word = "sign", ""
                continue
            elif kind == "close":
                if len(stack) == 1:
                    at = start
                    break
                self.shut(stack)
                word = f"{f.index_of}.{f.values[0].text}" if f.index_of and f.values and f.values[0].text else f.index_of or ""
            elif kind == "sign":
                if before in ("string", "ref", "close") and word:
                    if before == "string" or f.values and _OWNER.sub("", word) in self.holds:
                        f.values = f.values[:-1]
                    if len(stack) == 1 and not f.values:
                        f.targets.append(word)
                    else:
                        self.settle(f.targets, f.values, adds)
                        f.targets, f.values, adds = [f"{f.path}.{word}" if f.bracket in ("{", "[") else word], [], False
                f.joining = False
            elif kind == "join":
                f.joining = bool(f.values) and before in ("string", "ref", "close")
            elif kind == "comma":
                if m[0] == ";" and len(stack) == 1:
                    break
                if len(stack) > 1 and f.targets:
                    self.settle(f.targets, f.values)
                    f.targets, f.values = [], []
                f.joining = False
            else:
                f.joining = False
            before = kind
        while len(stack) > 1:
            self.shut(stack)
        self.settle(top.targets, top.values, adds)
        return at

    def shut(self, stack: list[_Open]) -> None:
        """Closes a bracket: a pair in it is settled, other values go to what is around it."""
        f = stack.pop()
        around = stack[-1]
        if f.index_of is not None:
            around.joining = False
            return
        if f.targets:
            self.settle(f.targets, f.values)
            around.joining = False
            return
        values = f.values
        if f.call:  # a plain word among arguments names what is looked up
            word = lambda v: v.span is not None and _IDENTIFIER.fullmatch(self.text, *v.span)
            plain = [m[0] for v in values if (m := word(v))]
            values = [v for v in values if not word(v)]
            if len(plain) == 1 and name_score(plain[0]):
                for v in values:
                    if name_score(plain[0]) * v.score() >= THRESHOLD:
                        self.report(v)
        if len(values) == 1:
            around.add(values[0], False)
        else:
            around.values += values
            around.joining = False

    def run(self) -> list[tuple[int, int]]:
        text = self.text
        floor = line = scanned = 0
        for m in _OP.finditer(text):
            if m.start() < floor or m[0] in _NO_ASSIGNMENT:
                continue
            at = m.start()
            newline = text.rfind("\n", scanned, at)
            line, scanned = (newline + 1 if newline >= 0 else line), at
            name, begin = self.name_before(max(line, floor), at)
            if not name:
                floor = m.end()
                continue
            head = text[max(line, floor) : begin]
            at_head = line >= floor and bool(_LINE_HEAD.match(head))
            path = name
            if at_head and m[0] in (":", "="):
                indent = len(head) - len(head.lstrip(" \t-"))
                while self.parents and self.parents[-1][0] >= indent:
                    self.parents.pop()
                if self.parents and self.parents[-1][0] < indent:
                    path = f"{self.parents[-1][1]}.{name}"
                if m[0] == ":" and _NOTHING.match(text, m.end()):
                    self.parents.append((indent, name))
                    floor = self.items(m.end(), path)
                    continue
                if m[0] == ":" and (block := _BLOCK.match(text, m.end())):
                    floor = self.block(block.end(), path, indent)
                    continue
                bare = _BARE.match(text, m.end())
                if bare:
                    held = self.holds.get(_OWNER.sub("", bare[1]))
                    self.settle([path], [held if held is not None else Value(text, bare.span(1))], m[0] == "+=")
                    floor = bare.end()
                    continue
            floor = max(m.end(), self.statement(m.end(), path, m[0] == "+="))
        for e in _ELEMENT.finditer(text):
            if e[1] == e[3]:
                inner = e[2].strip()
                start = e.start(2) + len(e[2]) - len(e[2].lstrip())
                self.settle([e[1].rpartition(":")[2]], [Value(text, (start, start + len(inner)))] if inner else [])
        for b in _BEARER.finditer(text):
            self.settle(["authorization"], [Value(text, b.span(1))])
        return sorted(self.found)

    def block(self, at: int, path: str, indent: int) -> int:
        """Reads a block of lines below a key of a configuration, which are joined; where it ends."""
        values = []
        while at < len(self.text) and (m := _LINE.match(self.text, at)):
            inner = m[2].rstrip()
            if inner and len(m[1]) <= indent:
                break
            if inner:
                values.append(Value(self.text, (m.start(2), m.start(2) + len(inner))))
            at = m.end()
        whole = None
        for v in values:
            whole = v if whole is None else Value("", None, whole, v)
        self.settle([path], [whole] if whole else [])
        return at

    def name_before(self, low: int, at: int) -> tuple[str, int]:
        """The name that ends before a sign, not before low, and where it begins."""
        back = self.text[low:at][::-1]
        if k := _KEY_END.match(back):
            end = at - k.end()
            begin = self.text.rfind(k[1], low, end)
            if begin >= 0:
                inner = self.text[begin + 1 : end]
                if "]" in k[0] and (o := _NAME_END.match(self.text[low:begin][::-1], 1)) and self.text[begin - 1 : begin] == "[":
                    return f"{o[1][::-1]}.{inner}", begin - len(o[0])
                return inner, begin
            return "", at
        n = _NAME_END.match(back)
        if not n:
            return "", at
        name = n[1][::-1].lstrip("-.0123456789")
        return name, at - n.end(1) + len(n[1]) - len(name)

    def items(self, at: int, path: str) -> int:
        """Reads the items of a list below a key of a configuration; where it ends."""
        at = max(0, at)
        values = []
        while m := _ITEM.match(self.text, at):
            values.append(self.literal(*m.span(m.lastindex)))
            at = m.end()
        self.settle([path], values)
        return at


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name."""
    return _Lexer(text).run()


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans and the lexed ones that overlap none of them, by start and then by kind."""
    base = base_spans(text)
    more = lexed_spans(text) if _ASSIGN_HINT.search(text) or "</" in text else []
    free, i = [], 0
    ends = []  # the furthest end of the base spans so far
    for s in base:
        ends.append(max(s[2], ends[-1] if ends else 0))
    for a, b in more:
        while i < len(base) and base[i][1] < b:
            i += 1
        if not i or ends[i - 1] <= a:
            free.append(("literal", a, b))
    return sorted([*base, *free], key=lambda s: (s[1], KINDS.index(s[0]))) if free else base


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str) -> str:
    """The text with every span replaced by a mark that names its kind; overlapping spans become one."""
    out, at, end = [], 0, 0
    for kind, a, b in all_spans(text):
        if a >= end:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = end = max(end, b)
    return "".join([*out, text[at:]])


def _scan(texts: list[str]):
    rows = []
    for t in texts:
        spans = all_spans(t)
        base = [s for s in spans if s[0] != "literal"]
        n = Counter(s[0] for s in spans)
        rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), n["literal"]))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6


def scan_secrets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_literal of each row.

    A null or empty text has no spans (the hash of the empty string). Null ids, ties and repeated
    rows pass through row by row; an empty table gives no rows; other columns of df are ignored.
    """
    fields = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long"
    return map_text(df, lambda: _scan, fields, text, [doc_id])


def redact_secrets(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """df with every secret in the text replaced by a mark, and n_chars, if there, counted anew.

    Null texts stay null, empty ones empty; all rows, repeated ones too, and all other columns stay,
    whatever their names; an empty table stays empty.
    """
    from pyspark.sql import functions as F

    def clean(texts: list[str]):
        return [[redacted(t) for t in texts]]

    name = unused(df.columns, "clean")
    made = map_text(df, lambda: clean, f"`{name}` string", text)
    cleaned = F.when(F.col(f"`{text}`").isNotNull(), F.col(name)).alias(text)
    cols = {text: cleaned}
    if n_chars in df.columns:
        cols[n_chars] = F.when(F.col(f"`{text}`").isNotNull(), F.char_length(name)).otherwise(F.col(f"`{n_chars}`")).cast(df.schema[n_chars].dataType).alias(n_chars)
    return made.select(*(cols.get(c, F.col(f"`{c}`")) for c in df.columns))
