"""Secret scan by assignment-aware lexing.

Base spans come from three fixed patterns.  The method adds more: a lexer reads source and
configuration syntax into name-literal pairs: ``name = literal``, ``"name": literal``, ``name: literal``, ``name := literal``,
``"a" + "b"``, a literal inside a call (``name = decode("x")``), a call with a name and a literal (``set("name", "literal")``), strings in
triple quotes or back quotes over several lines, and blocks of YAML (``name: |``), whose indented lines are literals.  It propagates
constants (a name used as a value stands for the literal that was assigned to it, through any chain of names), and scores each literal by
the sensitivity of the names it reaches plus its own form.  A value put together from several literals is
scored as a whole too, and counts with all of them: a name in it stands for what was last assigned to it before that place, or for what
is assigned first behind it; a value that would need itself leaves itself out.

Names are resolved once each and values are held as summaries (length, counts of characters, both ends), so the work grows
with the text, whatever the chains.

Defined results: a null text counts as empty; every row gives one row, repeated rows included;
an empty table gives an empty result; only the key and text columns are read.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, texts_of, tune

# Fixed patterns of the base contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # a run of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_CHARS = 6
KINDS = ("assign", "access", "hex", "lexed")

#: Weights of the parts of a target name.
NAME_WEIGHTS = {
    "password": 4, "passwd": 4, "pwd": 4, "passphrase": 4, "passcode": 4, "secret": 4, "secrets": 4, "token": 4, "credential": 4, "credentials": 4,
    "apikey": 4, "accesskey": 4, "privatekey": 4, "secretkey": 4, "authkey": 4, "auth": 3, "bearer": 3, "private": 2, "access": 2, "api": 2,
    "key": 2, "signing": 2, "encryption": 2, "salt": 3, "dsn": 2, "session": 1, "client": 1,
}
NAME_LEAST = 4
SCORE_LEAST = 6.0
PLACEHOLDER = re.compile(r"(?:change|replace|example|placeholder|your[-_ ]|dummy|redacted|\$\{|\{\{|<[^>]*>|x{6,}|\*{3,}|null|none|true|false)", re.I)

LITERAL = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[^\s"'`,;(){}\[\]<>+]+)"""
PAIR = re.compile(rf"""(?<![\w$.-])(?:["']([\w$. -]+)["']|([A-Za-z_$][\w$.-]*))[ \t]*(?::=|=>|[:=](?![=:]))[ \t]*({LITERAL}(?:[ \t]*\+[ \t]*{LITERAL})*)""")
PART = re.compile(LITERAL)
QUOTED = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
#: A name that is given a call of a literal, and a call that is given a name and a literal.
CALLS = (
    re.compile(rf"""(?<![\w$.-])([A-Za-z_$][\w$.-]*)[ \t]*(?::=|=>|[:=](?![=:]))[ \t]*[A-Za-z_$][\w$.]*\([ \t]*[bru]?({QUOTED})"""),
    re.compile(rf"""\([ \t]*["']([\w$.-]+)["'][ \t]*,[ \t]*[bru]?({QUOTED})"""),
)
LONG_STRING = re.compile(r"""(?<![\w$.-])(?:["']([\w$. -]+)["']|([A-Za-z_$][\w$.-]*))[ \t]*(?::=|=>|[:=](?![=:]))[ \t]*(\"{3}|'{3}|`)((?:(?!\3).)+)\3""", re.S)
LINE_BODY = re.compile(r"\S(?:[^\n]*\S)?")
YAML_BLOCK = re.compile(r"""([ \t]*(?:-[ \t]+)?)(?:["']([\w$. -]+)["']|([\w$.-]+))[ \t]*:[ \t]*[|>][+-]?[ \t]*\r?\Z""")
SPACES = " \t\r"
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
IDENTIFIER = re.compile(r"[A-Za-z_$][\w$.-]*")


def name_score(name: str) -> int:
    """How sensitive a target name is: the weights of its parts and of neighbouring parts joined."""
    parts = [p.lower() for p in NAME_PARTS.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(NAME_WEIGHTS.get(p, 0) for p in {*parts, *joined})


class Value:
    """What scoring needs of a string that is put together from others: no characters but its ends."""

    __slots__ = ("pieces", "length", "counts", "spaced", "held", "head", "tail", "opens", "closes")
    #: One character less than the longest fixed word or run of ``PLACEHOLDER``.
    EDGE = 10

    def __init__(self, text: str = ""):
        self.pieces, self.length, self.counts = int(bool(text)), len(text), Counter(text)
        self.spaced, self.held = " " in text, bool(PLACEHOLDER.search(text))
        self.head, self.tail, self.opens, self.closes = text[: self.EDGE], text[-self.EDGE :], "<" in text, ">" in text

    def add(self, other: Value) -> None:
        """Append the other value."""
        edge = self.tail + other.head
        self.held = self.held or other.held or bool(PLACEHOLDER.search(edge)) or (self.opens and other.closes)
        self.head = (self.head + other.head)[: self.EDGE] if self.length < self.EDGE else self.head
        self.tail = (self.tail + other.tail)[-self.EDGE :]
        self.pieces, self.length, self.spaced = self.pieces + other.pieces, self.length + other.length, self.spaced or other.spaced
        self.opens, self.closes = self.opens or other.opens, self.closes or other.closes
        self.counts.update(other.counts)

    def score(self) -> float:
        """0 to 6 by length, alphabet and entropy; below 0 for placeholders and prose."""
        n = self.length
        if n < 8 or self.spaced or self.held:
            return -9.0
        entropy = -sum(c / n * math.log2(c / n) for c in self.counts.values())
        mixed = any(c.isdigit() for c in self.counts) + any(c.isalpha() for c in self.counts) + any(not c.isalnum() for c in self.counts)
        return min(entropy, 4.0) + (mixed >= 2) - (mixed < 2) * 2 + (n >= 16)


def literal_score(value: str) -> float:
    return Value(value).score() if len(value) >= 8 else -9.0


#: A literal or name of a pair: start, end, quoted.
Part = tuple[int, int, bool]


def parts_of(line: str, a: int, b: int, at: int) -> list[Part]:
    """The parts of a value, without their quotes; a call is none."""
    out = []
    for p in PART.finditer(line, a, b):
        quoted = p.group()[0] in "\"'" and len(p.group()) > 1
        if not quoted and line.startswith("(", p.end()):
            continue  # the name of a call
        out.append((at + p.start() + quoted, at + p.end() - quoted, quoted))
    return out


def lex(text: str) -> list[tuple[str, list[Part]]]:
    """Name-literal pairs in the order of the text: the name and its value's parts."""
    pairs: list[tuple[str, list[Part]]] = []
    if any(mark in text for mark in ('"""', "'''", "`")):
        for m in LONG_STRING.finditer(text):
            # the lines of a long string are its literals
            pairs.append((m.group(1) or m.group(2), [(m.start(4) + x.start(), m.start(4) + x.end(), True) for x in LINE_BODY.finditer(m.group(4))]))
    at, block = 0, None  # an open YAML block: its name's indent and its pair
    for line in text.split("\n"):
        if block is not None:
            indent = len(line) - len(line.lstrip(" \t"))
            body = line.strip(SPACES)
            if not body:
                pass
            elif indent > block[0]:
                start = at + line.index(body)
                block[1].append((start, start + len(body), True))
            else:
                block = None
        if ":" in line or "=" in line:
            if line.rstrip(SPACES)[-1:] in "|>-+" and (m := YAML_BLOCK.match(line)):
                block = (len(m.group(1)), [])
                pairs.append((m.group(2) or m.group(3), block[1]))
            for m in PAIR.finditer(line):
                pairs.append((m.group(1) or m.group(2), parts_of(line, m.start(3), m.end(3), at)))
        if "(" in line:
            for m in (m for call in CALLS for m in call.finditer(line)):
                pairs.append((m.group(1), parts_of(line, m.start(2), m.end(2), at)))
        at += len(line) + 1
    return sorted((p for p in pairs if p[1]), key=lambda p: p[1][0])


class Constants:
    """The pairs of a text as a graph: a pair's value is its parts, and a part that is a name stands for another pair."""

    def __init__(self, text: str, pairs: list[tuple[str, list[Part]]]):
        self.text, self.pairs = text, pairs
        self.places: dict[str, tuple[list[int], list[int]]] = {}  # by name: where its values begin, and their pairs
        for i, (name, parts) in enumerate(pairs):
            starts, own = self.places.setdefault(name, ([], []))
            starts.append(parts[0][0])
            own.append(i)
        self.values: dict[int, Value] = {}

    def meant(self, part: Part) -> int | None:
        """The pair that a part stands for: the last of its name before it, or the first."""
        a, b, quoted = part
        name = self.text[a:b]
        if quoted or name not in self.places or not IDENTIFIER.fullmatch(name):
            return None
        starts, own = self.places[name]
        return own[max(0, bisect.bisect_left(starts, a) - 1)]

    def literal(self, part: Part) -> bool:
        """Whether a part is a literal: quoted, or not a name."""
        a, b, quoted = part
        return a < b and (quoted or not IDENTIFIER.fullmatch(self.text, a, b))

    def value(self, i: int) -> Value:
        """The whole value of a pair; each pair is put together once, a pair inside itself counts as nothing."""
        todo, inside = [(i, 0, Value())], {i}
        while todo:
            at, k, made = todo.pop()
            if at in self.values:
                continue
            parts = self.pairs[at][1]
            while k < len(parts):
                if (j := self.meant(parts[k])) is None:
                    if self.literal(parts[k]):
                        made.add(Value(self.text[parts[k][0] : parts[k][1]]))
                elif j in self.values:
                    made.add(self.values[j])
                elif j not in inside:
                    todo += [(at, k, made), (j, 0, Value())]
                    inside.add(j)
                    break
                k += 1
            else:
                self.values[at] = made
                inside.discard(at)
        return self.values[i]

    def literals(self, found: list[int]) -> set[tuple[int, int]]:
        """The literals that pairs are put together from; each pair is followed once."""
        out, todo, seen = set(), list(found), set(found)
        while todo:
            for part in self.pairs[todo.pop()][1]:
                if (j := self.meant(part)) is None:
                    out |= {part[:2]} if self.literal(part) else set()
                elif j not in seen:
                    seen.add(j)
                    todo.append(j)
        return out


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Literals whose own form and whose best target name together score high enough."""
    pairs = lex(text)
    weights = [name_score(name) for name, _ in pairs]
    wanted = sorted((i for i, w in enumerate(weights) if w >= NAME_LEAST), key=lambda i: -weights[i])
    if not wanted:
        return []
    owners: dict[str, list[Part]] = {}
    for name, parts in pairs:
        owners.setdefault(name, []).extend(parts)
    best: dict[tuple[int, int], int] = {}
    seen: set[str] = set()
    for i in wanted:  # from the most sensitive name on, so what a name reaches first is its best
        todo = [(p, True) for p in pairs[i][1]]
        while todo:  # constants: follow names to all literals assigned to them
            (a, b, quoted), direct = todo.pop()
            value = text[a:b]
            if not quoted and value in owners and IDENTIFIER.fullmatch(value):
                if value not in seen:
                    seen.add(value)
                    todo.extend((p, False) for p in owners[value])
            elif quoted or direct:
                best[a, b] = max(best.get((a, b), 0), weights[i])
    good = {span for span, weight in best.items() if weight + literal_score(text[span[0] : span[1]]) >= SCORE_LEAST}
    held = Constants(text, pairs)
    whole = [i for i in wanted if held.value(i).pieces > 1 and weights[i] + held.value(i).score() >= SCORE_LEAST]
    return sorted(good | held.literals(whole))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), leftmost and without overlap within a kind; failing matches are dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str) -> tuple[list, list]:
    """Base spans, and all spans: a lexed literal counts where no base span already covers it."""
    base = base_spans(text)
    more, reach, i = [], 0, 0  # the furthest end of the base spans that begin so far
    for a, b in lexed_spans(text) if any(c in text for c in ":=(`") else []:
        while i < len(base) and base[i][0] <= a:
            reach = max(reach, base[i][2])
            i += 1
        if b > reach:
            more.append((a, 3, b))
    return base, sorted(base + more)


def join_spans(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its secret spans; no shuffle."""
    tune(docs.sparkSession)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = ([], [], []), [], []
        for t in texts_of(b):
            base, every = scan(t)
            kinds = [k for _, k, _ in base]
            for i, c in enumerate(counts):
                c.append(kinds.count(i))
            shas.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            spans.append(join_spans(every))
        i64 = pa.int64()
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, i64) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    kind = dict(src.dtypes)["doc_id"]
    return per_batch(src, run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask(text: str, spans: list, put: str = "[SECRET]") -> str:
    """Text with every span, overlapping ones together, replaced."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """The documents with the spans of ``scan`` masked in their texts; ``n_chars``, where there is one, follows the new text.

    Every other column stays, whatever it is called; a null text stays null, repeated rows stay repeated, an empty table stays empty.
    """
    tune(docs.sparkSession)
    names = docs.columns
    i, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(b.columns)
        made = [None if t is None else mask(t, scan(t)[1]) for t in texts_of(b, empty=None)]
        columns[i] = pa.array(made, b.schema.field(i).type)
        if n is not None:
            columns[n] = pa.array([c if t is None else len(t) for t, c in zip(made, columns[n].to_pylist(), strict=True)], b.schema.field(n).type)
        return pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return per_batch(docs, run, docs.schema)
