"""Personal data: fixed patterns, and a character BiLSTM-CRF that finds what the patterns miss.

The tagger is trained here, in numpy, from generated sentences with labelled spans (fixed seed).  It finds
forms outside the patterns: spelled-out addresses (``ann at mail dot com``), phone numbers without a plus sign, card numbers with
dots, addresses of the longer internet protocol.  Texts are cut into overlapping windows; every window is decoded, spans that touch
a cut and are whole in no window are decoded again in a window around them that grows until they are whole, and one set of spans without overlap and of the greatest total score is chosen over the whole text.
Each added span must pass a plain check of its kind, and may not overlap a base span.

Every form that passes its check holds a trigger: a digit, an at sign, the word ``dot``, a bracketed ``at``, a plain ``at`` before a
host with a full stop, or colons as the longer internet protocol has them.  Windows lie on a fixed grid over the whole text, and
only those that meet a trigger are decoded: a span that lies whole in any other would fail its check, and spans that fail it are left out
before the choice.  What a span that reaches out of a window needs is decided by the windows that meet its trigger.  Tests hold the
gate against ``plausible`` on generated forms, and the spans against those of decoding every window on whole tables.

Defined results: a null text counts as empty; every row gives one row; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import per_batch, tune
from .tagger import KINDS, Tagger, encode

# Fixed patterns of the base contract, written so that each run of characters is tried once.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]+\Z")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: One of these is in whatever ``plausible`` accepts. Each begins with a character that a text is searched for quickly.
TRIGGERS = (
    re.compile(r"[0-9@]+|\b[dD][oO][tT]\b|[\[({<] ?[aA][tT] ?[\])}>]"),
    re.compile(r" [aA][tT] [\w-]+\.\w"),
    re.compile(r":(?::|(?<=[a-fA-F]:)[a-fA-F])"),
)
WINDOW, STRIDE = 96, 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), leftmost and without overlap within a kind; failing matches are dropped and not retried."""
    out, last = [], 0
    if "@" in text:
        for m in EMAIL_HOST.finditer(text):
            a = m.start()
            while a > last and text[a - 1] in NAME_CHARS:
                a -= 1
            if a < m.start():
                out.append((0, a, m.end()))
                last = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = only_digits(m.group())
        if 13 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


SPELLED = re.compile(r"[\w.+-]+(?: ?@ ?| ?[\[({<] ?at ?[\])}>] ?| at )[\w-]+(?:(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[\w-]+)*(?:\.| ?[\[({<] ?dot ?[\])}>] ?| dot )[A-Za-z]{2,}", re.I)
LOCAL_PHONE = re.compile(r"(?:\+?\d{1,3}[ .-]?)?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}")


def plausible(kind: int, s: str) -> bool:
    """The plain check of an added span."""
    if kind == 0:
        return bool(SPELLED.fullmatch(s))
    if kind == 1:
        try:
            return ipaddress.ip_address(s).version == 6 and len(s) >= 9
        except ValueError:
            return False
    digits = only_digits(s)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return bool(LOCAL_PHONE.fullmatch(s)) and 10 <= len(digits) <= 13


class Samples:
    """Sentences with labelled spans, in several alphabets of syllables."""

    SYLLABLES = "an er in th on re at en ion ti es or st ha nd ou ea ng al it as is le se ve co me de hi ri ro li ra io ic ne sch ung ä ö ü é è ç ñ ó í keit que tion ment".split()
    SHORT = "the of and to in is was for on with as by from that this it not are be or you we my his her der die das und zu mit von ist ein la le de et les des un une pour el los y que por para con una del se al".split()
    PLAIN = "an el ri ta mo ka be jo lu na ro vi ste mar ger tom pe ter son lin da bert ha ru ben fra nk the co li ver ma post mail box web net lab uni ber lin fir ma".split()
    ENDS = ("com", "org", "net", "de", "fr", "es", "io", "edu", "co.uk", "example.com")
    AT = (" at ", " [at] ", "(at)", " (at) ", " @ ", " AT ", "[at]", " At ", " {at} ")
    DOT = (" dot ", ".", " [dot] ", "(dot)", " DOT ", "[dot]", " (dot) ")

    def __init__(self, seed: int = 11):
        self.r = random.Random(seed)

    def word(self) -> str:
        if self.r.random() < 0.35:
            return self.r.choice(self.SHORT)
        w = "".join(self.r.choice(self.SYLLABLES) for _ in range(self.r.randint(1, 4)))
        return w.capitalize() if self.r.random() < 0.12 else w

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def name(self) -> str:
        """Like a word, like a name, or letters without sense; in parts, with digits."""
        r = self.r
        kind = r.random()
        if kind < 0.55:
            plain = "".join(r.choice(self.PLAIN) for _ in range(r.randint(1, 3)))
        elif kind < 0.75:
            plain = "".join(c for c in self.word().lower() if c.isascii()) or "anna"
        else:
            plain = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9)))
        plain = plain.capitalize() if r.random() < 0.1 else plain
        return plain + r.choice(["", "", "", "", f".{self.digits(2)}", self.digits(2), self.digits(1), r.choice("._-") + r.choice(self.PLAIN) + r.choice(self.PLAIN)])

    def host(self) -> str:
        r = self.r
        part = lambda: "".join(r.choice(self.PLAIN) for _ in range(r.randint(1, 3))) if r.random() < 0.7 else "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 8)))
        return part() + r.choice(["", "", "", "", self.digits(1), "-" + part(), "." + part()])

    def card(self) -> str:
        body = self.r.choice("3456") + self.digits(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def span(self) -> tuple[int, str]:
        r, kind = self.r, self.r.choice((0, 0, 0, 1, 2, 3, 3))
        if kind == 0:
            end = r.choice(self.ENDS) if r.random() < 0.8 else "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 4)))
            if r.random() < 0.15:
                return 0, f"{self.name()}@{self.host()}.{end}"
            dot = r.choice(self.DOT)
            return 0, self.name() + r.choice(self.AT) + f"{self.host()}.{end}".replace(".", dot)
        if kind == 1:
            if r.random() < 0.3:
                return 1, ".".join(str(r.randint(1, 255)) for _ in range(4))
            group = lambda: f"{r.randint(0, 65535):x}" if r.random() < 0.7 else r.choice(["dead", "beef", "cafe", "face", "babe", "fe80", "2001", "db8", "a", "ab", "abc"])
            if r.random() < 0.5:
                return 1, ":".join(group() for _ in range(8))
            return 1, ":".join(group() for _ in range(r.randint(1, 4))) + "::" + ":".join(group() for _ in range(r.randint(1, 3)))
        if kind == 2:
            c, sep = self.card(), r.choice(["", " ", "-", ".", ".", "/"])
            return 2, sep.join(c[i : i + 4] for i in range(0, 16, 4))
        a, b, c = self.digits(3), r.choice(["555", self.digits(3)]), self.digits(4)
        return 3, r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}"])

    def noise(self) -> str:
        """Things that look alike and are not personal: dates, times, prices, versions, digests, keys, order numbers."""
        r, d = self.r, self.digits
        return r.choice([
            f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(10, 23)}:{r.randint(10, 59)}:{r.randint(10, 59)}", f"${d(3)}.{d(2)}", f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}",
            "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 24, 40]))), "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), d(r.randint(1, 9)), d(r.randint(20, 24)), f"#{d(5)}",
            f"{d(3)}-{d(2)}", f"@{self.word()}", f"{self.word()} at {self.word()}", f"{self.word()} at {self.word()}. {self.word()}", f"{self.word()} at {self.word()}, {self.word()}", f"at {d(2)}.{d(2)}", f"dot {self.word()}", f"{self.word()}.{self.word()}", f"{d(1)}.{d(2)}", f"{d(2)}%", f"{self.word()}{r.choice(['###', '%%%', '$$$', '&&&'])}",
            f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', f"at {self.word()} dot", f"{d(4)}/{d(2)}/{d(2)}", f"ISBN {d(3)}-{d(1)}-{d(5)}-{d(3)}-{d(1)}",
        ])

    def window(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Codes and tags of one training window; it begins anywhere, or where a unit does."""
        r, text, tags, begins = self.r, "", [], []
        while len(text) < size + 60:
            u = r.random()
            if u < 0.2:
                kind, s = self.span()
                mark = [1 + 2 * kind] + [2 + 2 * kind] * (len(s) - 1)
                if r.random() < 0.4:  # in brackets or quotes, or before a sign
                    head, tail = r.choice([("(", ")"), ("(", ")"), ("(", ")"), ('"', '"'), ("<", ">"), ("", ","), ("", "."), ("", "?"), ("", ";"), (":", "")])
                    s, mark = head + s + tail, [0] * len(head) + mark + [0] * len(tail)
            else:
                s = self.noise() if u < 0.33 else self.word() + r.choice(["", "", "", "", ",", ".", "?"])
                s = f"({s})" if r.random() < 0.04 else s
                mark = [0] * len(s)
            begins.append(len(text))
            text, tags = text + s, tags + mark
            end = r.choice([" ", " ", " ", " ", ". ", "\n", ": "])
            text, tags = text + end, tags + [0] * len(end)
        a = r.randrange(0, len(text) - size) if r.random() < 0.7 else max(x for x in begins if x <= len(text) - size) if r.random() < 0.5 else 0
        y = np.array(tags[a : a + size])
        if y[0] and y[0] % 2 == 0:
            y[0] -= 1  # a span cut at the window's start begins there
        return encode(text[a : a + size]), y

    def batch(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        x, y = zip(*(self.window() for _ in range(n)), strict=True)
        return np.stack(x), np.stack(y)


@functools.lru_cache(1)
def trained(windows: int = 10_000, steps: int = 1_500, hidden: int = 24) -> Tagger:
    """The tagger, the same for every process: fixed seeds; trained once."""
    tagger = Tagger(hidden)
    tagger.train(*Samples().batch(windows), steps=steps)
    return tagger


def windows_of(text: str, gated: bool = True) -> list[tuple[int, int, int, int]]:
    """Overlapping windows (start, end, and the text they cut): those of a fixed grid that meet a trigger, or all.

    The last window ends with the text and is as long as the others, if the text is.
    """
    n = len(text)
    last = -(-max(0, n - WINDOW) // STRIDE)
    if gated:
        hits = [m.span() for t in TRIGGERS for m in t.finditer(text)]
        met = {k for a, b in hits for k in range(max(0, (a - WINDOW) // STRIDE + 1), min(last, (b - 1) // STRIDE) + 1)}
        if any(b > n - WINDOW for _, b in hits):
            met.add(last)
    else:
        met = range(last + 1 if n else 0)
    starts = (min(k * STRIDE, max(0, n - WINDOW)) for k in sorted(met))
    return [(a, min(a + WINDOW, n), 0, n) for a in starts]


def spans_in(tags: np.ndarray, margin: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of a decoded window."""
    out, i, n = [], 0, len(tags)
    while i < n:
        if tags[i] and tags[i] % 2:
            j = i + 1
            while j < n and tags[j] == tags[i] + 1:
                j += 1
            out.append((int(tags[i]) // 2, i, j, float(margin[i:j].sum())))
            i = j
        else:
            i += 1
    return out


def reconcile(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """The spans without overlap of the greatest total score over a whole text (weighted interval scheduling)."""
    best_of: dict[tuple[int, int, int], float] = {}
    for k, a, b, s in found:
        best_of[k, a, b] = max(s, best_of.get((k, a, b), -np.inf))
    spans = sorted(((b, a, k, s) for (k, a, b), s in best_of.items() if s > 0), key=lambda x: x[:3])
    ends = [s[0] for s in spans]
    total, take = [0.0], []
    for i, (_, a, _, s) in enumerate(spans):
        j = int(np.searchsorted(ends[:i], a, "right"))
        take.append((total[j] + s > total[i], j))
        total.append(max(total[i], total[j] + s))
    out, i = [], len(spans)
    while i:
        used, j = take[i - 1]
        if used:
            b, a, k, _ = spans[i - 1]
            out.append((k, a, b))
        i = j if used else i - 1
    return sorted(out)


def in_batches(work: list[tuple[int, ...]], batch: int) -> Iterator[list[tuple[int, ...]]]:
    """Windows (text, start, end, ...) of one length together, so that none is padded: a window's tags do not hang on the others.

    A batch holds the characters of ``batch`` plain windows at most, or one window.
    """
    by_length: dict[int, list] = {}
    for w in work:
        by_length.setdefault(w[2] - w[1], []).append(w)
    for length, same in by_length.items():
        size = max(1, batch * WINDOW // max(WINDOW, length))
        yield from (same[s : s + size] for s in range(0, len(same), size))


def joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Intervals, with those that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def grown(a: int, b: int, n: int, size: int) -> tuple[int, int]:
    """A window around (a, b) of a text of n characters: ``size``, doubled until it leaves half of itself free, or the text."""
    while size < 2 * (b - a):
        size *= 2
    start = max(0, min((a + b - size) // 2, n - size))
    return start, min(start + size, n)


def tagged_spans(texts: list[str], tagger: Tagger, batch: int = 2_048, gated: bool = True) -> list[list[tuple[int, int, int]]]:
    """Reconciled plausible spans of each text; windows of all texts are decoded together, a bounded number at a time."""
    work = [(i, *w[:2]) for i, t in enumerate(texts) for w in windows_of(t, gated)]
    around: dict[tuple[int, int, int], tuple[int, int]] = {}  # a grown window's interval
    codes: dict[int, np.ndarray] = {}
    found: list[list] = [[] for _ in texts]
    size = WINDOW
    while work:
        whole: dict[int, list] = {}
        cut: dict[int, list] = {}
        for part in in_batches(work, batch):
            for i in {w[0] for w in part} - codes.keys():
                codes[i] = encode(texts[i])
            x = np.stack([codes[i][a:b] for i, a, b in part])
            tags, margin = tagger.decode(x)
            for r, (i, a, b) in enumerate(part):
                if not tags[r].any():
                    continue
                lo, hi = around.get((i, a, b), (a, b))
                for k, p, q, score in spans_in(tags[r], margin[r]):
                    if a + q <= lo or a + p >= hi:
                        continue
                    if (p == 0 and a) or (q == b - a and b < len(texts[i])):
                        cut.setdefault(i, []).append((k, min(lo, a + p) if around else a + p, max(hi, a + q) if around else a + q))
                        continue
                    whole.setdefault(i, []).append((k, a + p, a + q))
                    if plausible(k, texts[i][a + p : a + q]):
                        found[i].append((k, a + p, a + q, score))
        # what is cut in one window and whole in another is settled; the rest grows
        size, work, around = 2 * size, [], {}
        for i, pieces in cut.items():
            rest = joined([(a, b) for k, a, b in pieces if not any(k == j and s <= a and b <= e for j, s, e in whole.get(i, ()))])
            for a, b in rest:
                w = (i, *grown(a, b, len(texts[i]), size))
                work += [w] if w not in around else []
                at = around.get(w, (a, b))
                around[w] = min(a, at[0]), max(b, at[1])
    return [reconcile(f) for f in found]


def scan(texts: list[str], tagger: Tagger, gated: bool = True) -> list[tuple[list, list]]:
    """For each text its base spans and all spans, by kind, then start."""
    out = []
    for text, more in zip(texts, tagged_spans(texts, tagger, gated=gated), strict=True):
        base = base_spans(text)
        added = [(k, a, b) for k, a, b in more if not any(a < e and s < b for _, s, e in base)]
        out.append((base, sorted(base + added)))
    return out


def join_spans(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its spans; no shuffle. The weights (about 20,000 numbers) are broadcast."""
    spark = docs.sparkSession
    tune(spark)
    shipped = spark.sparkContext.broadcast(tagger or trained())

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        counts, shas, spans = ([], [], [], []), [], []
        for base, every in scan(["" if t is None else t for t in b.column(1).to_pylist()], shipped.value):
            kinds = [k for k, _, _ in base]
            for i, c in enumerate(counts):
                c.append(kinds.count(i))
            shas.append(hashlib.sha256(join_spans(sorted(base)).encode()).hexdigest())
            spans.append(join_spans(every))
        return pa.RecordBatch.from_arrays(
            [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())],
            names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        )

    src = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    return per_batch(src, run, f"doc_id {dict(src.dtypes)['doc_id']}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
