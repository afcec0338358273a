"""Personal data: base spans by rule, and further ones from scored candidates.

Base spans are fixed patterns with checks (parts of an address, Luhn, number of digits). Beyond them,
high-recall generators propose overlapping spans - addresses spelled with "at" and "dot", numbers grouped
otherwise than the base patterns allow, addresses of eight hexadecimal groups - and boosted trees score
each from its format and its context. Scores are calibrated on held-out candidates (isotonic regression), and a candidate
is taken where its calibrated score reaches its kind's threshold, set on further candidates for a wanted precision; of overlapping ones the best stays, and none may overlap
a base span. The trees are fitted on candidates made by a seeded grammar of personal and of innocent
strings, so no labelled personal data is needed.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytes as B
from .boosting import BoostedTrees, isotonic

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A number's start that fails fails at every later digit of its run as well.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    """The base spans of a text by start, then kind."""
    out = _emails(text) if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


#: Generators: wide on purpose, the trees tell what is meant.
_PROPOSE = {
    "email": re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?(?:[(\[{] ?(?:at|AT) ?[)\]}]|(?<= )at(?= )|&#64;) ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?(?:dot|DOT) ?[)\]}]|(?<= )dot(?= )|\.) ?[A-Za-z0-9-]{1,24}){1,4}"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){3,7}(?::?[0-9A-Fa-f]{1,4})(?![\w:])|(?<![\w.])[0-9]{1,3}(?: ?[\[(]?\.[\])]? ?[0-9]{1,3}){3}(?![\w])"),
    "card": re.compile(r"(?<![\w.,/-])[0-9]{4}(?:[ ._/-]{1,2}[0-9]{4}){3}(?![\w])|(?<![\w.,/-])[0-9]{12,19}(?![\w])"),
    "phone": re.compile(r"(?<![\w.,/-])(?:\(?0{0,2}[0-9]{2,4}\)?[ ./-]{1,2}){1,4}[0-9]{3,5}(?:[ ./-][0-9]{2,5}){0,3}(?![\w])"),
}
_WORDS = {
    "email": re.compile(r"mail|contact|write|reach|@", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|login|ping", re.I),
    "card": re.compile(r"card|visa|credit|pay|account|konto|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|cell|dial|ring", re.I),
}
_INNOCENT = re.compile(r"version|isbn|order|ticket|section|item|year|page|release|serial|figure|table|licen|id\b|no\.", re.I)
_CONTEXT = 24
#: What each match of the e-mail generator has in it.
_AT = re.compile(r"[(\[{] ?(?:at|AT)| at |&#64;")


def candidates(text: str) -> list[Span]:
    digits = bool(_DIGIT.search(text))
    out = []
    for kind, pattern in _PROPOSE.items():
        if kind == "email" and not _AT.search(text):
            continue
        if kind in ("card", "phone") and not digits or kind == "ip" and not (digits or ":" in text):
            continue
        out += [(kind, *m.span()) for m in pattern.finditer(text)]
    return out


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    s = text[a:b]
    before, after = text[max(0, a - _CONTEXT) : a], text[b : b + _CONTEXT]
    digits = re.sub(r"[^0-9]", "", s)
    groups = [g for g in re.split(r"[^0-9A-Za-z]+", s) if g]
    letters = sum(c.isalpha() for c in s)
    return [
        KINDS.index(kind),
        len(s),
        len(digits),
        letters,
        len(groups),
        max(map(len, groups), default=0),
        min(map(len, groups), default=0),
        len({len(g) for g in groups}),
        float(12 <= len(digits) <= 19 and luhn(digits)),
        float(all(g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(bool(re.search(r"[(\[{] ?(?:at|AT)", s))) + 2 * float(" at " in s) + 4 * float("&#64;" in s),
        float(bool(re.search(r"[(\[{] ?(?:dot|DOT)", s))) + 2 * float(" dot " in s),
        float(groups[-1].lower() in ("com", "org", "net", "de", "fr", "es", "edu", "io", "gov", "info", "uk") if groups else 0),
        s.count("-"),
        s.count("."),
        s.count(" "),
        s.count("/"),
        s.count("("),
        s.count(":"),
        float(bool(digits) and digits[0] == "0"),
        float(len(digits) >= 4 and 1900 <= int(digits[:4]) <= 2100),
        float(bool(_WORDS[kind].search(before))),
        float(bool(_WORDS[kind].search(after))),
        float(bool(_INNOCENT.search(before))),
        float(before[-1:].isalnum()),
        float(before[-1:] in "$€£#=" and before != ""),
        float(after[:1] in "%°€$" and after != ""),
    ]


def _examples(seed: int, n: int) -> list[tuple[str, Span, int]]:
    """Candidates of generated sentences: (sentence, span, 1 if the span was planted as personal)."""
    r = Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(("an", "the", "re", "on", "er", "ti", "st", "en", "ou", "la", "de", "ch", "ung")) for _ in range(r.randint(1, 4)))

    def card() -> str:
        body = r.choice("3456") + d(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def personal(kind: str) -> tuple[str, str]:
        if kind == "email":
            at, dot = r.choice(((" (at) ", " (dot) "), (" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "."), (" [at] ", "."), ("&#64;", "."), ("(AT)", "(DOT)")))
            return r.choice(("write to", "mail me:", "contact", "e-mail", "reach us under", word())), f"{word()}{r.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'edu'))}"
        if kind == "ip":
            v6 = ":".join("%x" % r.randint(0, 65535) for _ in range(8))
            v4 = r.choice((" . ", "[.]", "(.)")).join(str(r.randint(0, 255)) for _ in range(4))
            return r.choice(("host", "server", "login from", "IP", word())), r.choice((v6, v4))
        if kind == "card":
            c, s = card(), r.choice((".", "_", "/", " - ", "  "))
            return r.choice(("card", "pay with", "Visa", "credit card no", word())), s.join(c[i : i + 4] for i in (0, 4, 8, 12))
        return r.choice(("tel", "phone", "call", "fax", "mobile:", "call me at")), r.choice((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(4)} {d(3)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)}/{d(7)}"))

    def innocent() -> tuple[str, str]:
        year = str(r.randint(1900, 2030))
        return r.choice((
            ("look", f"at {word()} dot {word()}"), ("she was", f"{word()} at {word()}.{word()}"), ("they met", f"{word()} at {word()}. {word().title()} {word()}"),
            ("version", ".".join(str(r.randint(0, 30)) for _ in range(4))), ("section", " . ".join(str(r.randint(1, 9)) for _ in range(4))), ("time", ":".join(d(2) for _ in range(r.choice((4, 5))))),
            ("ISBN", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"), ("order", d(r.randint(12, 19))), ("ticket", f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"), (word(), d(16)), (word(), f"{d(4)} {d(4)} {d(4)} {d(4)}"),
            ("from", f"{year}-{year}"), ("on", f"{r.randint(10, 31)}.{r.randint(10, 12)}.{year}"), ("on", f"{year}-{r.randint(10, 12)}-{r.randint(10, 31)} {d(3)}"), ("pages", f"{d(3)}-{d(3)}"), (word(), f"{d(3)} {d(3)}"), ("sum", f"{d(3)}.{d(3)}.{d(3)}"), ("table", f"{d(2)} {d(3)} {d(4)} {d(3)}"), ("release", f"{year}.{d(2)}.{d(3)}"),
        ))

    out = []
    for _ in range(n):
        good = r.random() < 0.5
        lead, what = personal(r.choice(KINDS)) if good else innocent()
        text = f"{word()} {word()} {lead} "
        a = len(text)
        text += what + r.choice((" ", ". ", ", ")) + f"{word()} {word()}."
        for s in candidates(text):
            if s[1] < a + len(what) and s[2] > a:
                inside = max(0, min(s[2], a + len(what)) - max(s[1], a))
                out.append((text, s, int(good and inside >= 0.9 * max(len(what), s[2] - s[1]))))
    return out


@dataclass(frozen=True)
class Detector:
    trees: BoostedTrees
    thresholds: dict[str, float]
    curve: tuple[np.ndarray, np.ndarray]

    def scores(self, text: str, found: list[Span]) -> np.ndarray:
        """Calibrated: the share of such candidates that are personal data."""
        at, share = self.curve
        return np.interp(self.trees.predict(np.array([features(text, s) for s in found])), at, share)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """Spans that the candidates add, none over a base span or another added one."""
        found = [s for s in candidates(text) if not any(s[1] < b[2] and b[1] < s[2] for b in base)]
        if not found:
            return []
        scores = self.scores(text, found)
        out: list[Span] = []
        for p, s in sorted(zip(scores, found, strict=True), key=lambda x: (-x[0], x[1][1], x[1][2])):
            if p >= self.thresholds[s[0]] and not any(s[1] < o[2] and o[1] < s[2] for o in out):
                out.append(s)
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """(base spans, all spans), each by start, then kind."""
        base = base_spans(text)
        every = base + self.added(text, base)
        return base, sorted(every, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


@lru_cache(maxsize=4)
def fit(examples: int = 6000, precision: float = 0.99, seed: int = 7) -> Detector:
    """Trees on generated candidates, calibrated on others, and thresholds on a third set for the wanted precision of each kind."""
    learn, held, last = (_examples(seed + i, n) for i, n in enumerate((examples, examples // 2, examples // 2)))
    trees = BoostedTrees().fit(np.array([features(t, s) for t, s, _ in learn]), np.array([y for *_, y in learn], float))
    curve = isotonic(trees.predict(np.array([features(t, s) for t, s, _ in held])), np.array([y for *_, y in held], float))
    p = np.interp(trees.predict(np.array([features(t, s) for t, s, _ in last])), *curve)
    y, kinds = np.array([y for *_, y in last]), np.array([s[0] for _, s, _ in last])
    thresholds = {}
    for kind in KINDS:
        pk, yk = p[kinds == kind], y[kinds == kind]
        # The least score from which on the wanted share is personal.
        fit = [t for t in np.unique(pk) if yk[pk >= t].mean() >= precision]
        thresholds[kind] = max(0.5, float(fit[0])) if fit else 1.1
    return Detector(trees, thresholds, curve)


def _texts(column: pa.Array):
    return ((x or "") for x in column.to_pylist())


def find_pii(docs: DataFrame, detector: Detector | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans) for each row of ``docs``; spans are arrays of (kind, first, after) in code points.

    Every row is read whole and alone: repeated rows and ids give repeated results, a null or empty text
    none, an empty table an empty one. No other column is read.
    """
    detector = detector or fit()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int64()), ("after", pa.int64())]))

    def rows(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                found = [detector.spans(t) for t in _texts(part.column(1))]
                cols = [pa.array([[{"kind": k, "first": a, "after": b} for k, a, b in x[i]] for x in found], kind) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "base", "spans"])

    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind: string, first: long, after: long>>"
    return thin.mapInArrow(B.released(rows), f"id {thin.schema[0].dataType.simpleString()}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch that spans cover replaced by its first span's kind in brackets."""
    out, done = [], 0
    for kind, a, b in spans:
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def redact(docs: DataFrame, detector: Detector | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text_col`` replaced by its kind; other columns, whatever their names, stay.

    Every row is read whole and alone: repeated rows stay repeated, null and empty texts as they are, an empty table is empty.
    """
    detector = detector or fit()
    at = docs.columns.index(text_col)

    def rows(batches):
        for batch in B.slices(batches):
            texts = [None if t is None else redacted(t, detector.spans(t)[1]) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(B.released(rows), docs.schema)


def spans_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(spans_text(spans).encode()).hexdigest()
