"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stay. Beside them stand candidates of looser
patterns: spelled-out addresses, IPv6 whole or with ::, phone numbers without a plus, card numbers that the base
pattern swallows with their neighbours, keys and tokens; and what looks alike but isn't one: card-like numbers that
fail the checksum, dotted numbers of other lengths, dates and codes, names with an @. Labelers vote on every span, base
or candidate: yes, no or nothing. They are of three kinds:
- regex: how well formed the span is, with its checksum; digits, groups, entropy
- gazetteer: known domain endings, card issuers, dialling codes, reserved networks, key prefixes
- context: telling words before the span, or code and tables around it

Expectation-maximisation over the counts of vote patterns estimates, for each labeler, how often it says yes to
what is personal data and no to what isn't (after Dawid and Skene, with priors that trust a checksum or a full form more
than the others; a labeler that says yes to all tells nothing, and comes out so), and each pattern's probability. With
those as soft labels a logistic span classifier is trained on the votes and on features of the span itself: length,
share of digits, distinct characters, and the characters beside it. A candidate that doesn't overlap a base span or an
added one before it (by start, then kind), and that the classifier gives THRESHOLD or more, is added. Counts of
patterns are all that reaches the driver: there are a few hundred as a rule, and never more than the ways to vote times
the features' ways, whatever the input; all documents count.

Cases: null text is empty. Texts of any length are searched whole, in time linear in their length. Equal rows are rows each.
An empty table gives no rows, and a model that adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.9
CONTEXT = 40

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Up to seven groups of an IPv6 address, and keys whose form their prefix tells: those of AWS, and web tokens of two to five parts.
GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}"
KEYS = r"eyJ[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){1,4}(?<![.])|(?:AKIA|ASIA)[A-Z0-9]{16}"
KEY = re.compile(KEYS)
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?![A-Za-z0-9.-])|\b[A-Za-z0-9][A-Za-z0-9._-]{0,63} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?|\.)[A-Za-z]{2,24}\b", re.IGNORECASE),
    "ip": re.compile(rf"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}(?![0-9A-Fa-f:])|(?<![0-9A-Za-z_:.])(?:{GROUPS}::(?:{GROUPS})?|::{GROUPS})(?![0-9A-Za-z_:])|(?<![0-9A-Za-z.])[0-9]{{1,4}}(?:\.[0-9]{{1,4}}){{2,5}}(?!\.?[0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+().-])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9+().-])[0-9]{2,4}(?:[ ./-][0-9]{2,4}){2,3}(?![0-9])"),
    "secret": re.compile(rf"(?<![A-Za-z0-9_+/-])(?:{KEYS}|[A-Za-z0-9_+/-]{{24,}}+={{0,2}}+)(?![A-Za-z0-9_+/=-])"),
}

#: Gazetteers.
ENDINGS = frozenset("com org net edu gov io co uk de fr es it nl eu ru cn jp info biz us ca au ch at be pl se".split())
DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 60 61 62 63 64 65 66 81 82 84 86 90 91 92".split())
KEY_PREFIXES = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xox", "AKIA", "ASIA", "AIza", "eyJ")
TELLING = {
    "email": re.compile(r"mail|contact|write|reach|from|to:|correo|courriel|schreib", re.IGNORECASE),
    "ip": re.compile(r"\bip\b|address|host|server|from|login|client|network", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|debit|pay|tarjeta|carte|karte", re.IGNORECASE),
    "phone": re.compile(r"phone|tel|call|mobile|cell|fax|whatsapp|ring|tel[eé]fono|handy", re.IGNORECASE),
    "secret": re.compile(r"token|secret|passw|api|key|credential|bearer", re.IGNORECASE),
}
DATE = re.compile(r"(?:1[89]|20)[0-9]{2}[ ./-][0-9]{1,2}[ ./-][0-9]{1,2}|[0-9]{1,2}[ ./-][0-9]{1,2}[ ./-](?:1[89]|20)[0-9]{2}")
ASSIGN = re.compile(r"[=:]\s*[\"']?$")
CODE = re.compile(r"(?:version|ver\.?|release|isbn|issn|doi|page|pp\.|§|build)\s*[=:]?\s*$", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from each @, as far left as letters go that no earlier match took, and right along the domain."""
    at, free = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        found = DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if text.count(".") >= 3:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = digits_of(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates that overlap no base span, leftmost of each kind."""
    out = []
    low = text.lower() if "(" in text or "[" in text else ""
    has_digit = DIGIT.search(text) is not None
    for kind, pattern in LOOSE.items():
        if kind == "email" and "@" not in text and "at)" not in low and "at]" not in low and "at ]" not in low and "at )" not in low:
            continue
        if kind == "ip" and "::" not in text and text.count(":") < 7 and not (has_digit and text.count(".") > 1):
            continue
        if kind in ("phone", "card") and not has_digit or kind == "secret" and not has_digit and not any(x in text for x in ("eyJ", "AKIA", "ASIA")):
            continue
        k = KINDS.index(kind)
        for m in pattern.finditer(text):
            if kind == "secret" and not (DIGIT.search(m[0]) and any(c.isalpha() for c in m[0])) and not KEY.fullmatch(m[0]):
                continue
            if kind == "ip" and "::" in m[0] and sum(map(bool, m[0].split(":"))) > 7:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(x for x in out if not any(x[0] < b and a < x[2] for a, _, b in base))


def in_order(span: str, *patterns: re.Pattern) -> bool:
    """Whether the span has each pattern, each after the one before; in linear time."""
    at = 0
    for p in patterns:
        found = p.search(span, at)
        if not found:
            return False
        at = found.end()
    return True


def path_like(span: str) -> bool:
    """Whether a span with slashes or plus signs is mostly words and numbers between signs, as in addresses of pages."""
    parts = SIGNS.split(span) if "/" in span or "+" in span else []
    return bool(parts) and 5 * sum(len(x) for x in parts if PLAIN.fullmatch(x)) >= 4 * sum(map(len, parts))


SIGNS, PLAIN = re.compile(r"[/_+=-]"), re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
LOWER, UPPER, LETTER = re.compile(r"[a-z]"), re.compile(r"[A-Z]"), re.compile(r"[A-Za-z]")
HEX = re.compile(r"[0-9a-f]{32,64}|[0-9A-F]{32,64}")

#: Labelers in the order of their votes: 1 yes, -1 no, 0 nothing.
LABELERS = ("regex_form", "regex_digits", "gazetteer_known", "gazetteer_reserved", "context_words", "context_assign", "context_code")


def votes(text: str, start: int, kind: int, end: int) -> tuple[int, ...]:
    name, span, before = KINDS[kind], text[start:end], text[max(0, start - CONTEXT) : start]
    digits = digits_of(span)
    form = shape = known = reserved = 0
    if name == "email":
        domain = re.split(r"@|at[\])]? ?", span)[-1]
        form = -1 if "@" in span and "." not in domain or span[:1] in ".-%" else 1 if "@" in span and not domain.startswith("-") and ".." not in span else 0
        shape = 1 if any(c.isalpha() for c in span) else -1
        known = 1 if domain.rsplit(".", 1)[-1].lower() in ENDINGS else -1 if domain.rsplit(".", 1)[-1].isdigit() else 0
    elif name == "ip":
        parts = span.split(".") if "." in span else []
        # a::b is rather a name in code; other dotted numbers are versions, sections, dates
        form = -1 if "::" in span and not digits or parts and not (len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in parts)) else 1
        shape = -1 if parts and all(len(p) == 1 for p in parts) else 1
        reserved = -1 if parts and parts[0] in ("0", "255") or span == "::1" else 0
        known = 1 if parts and not any(len(p) > 1 and p[0] == "0" for p in parts) else 0
    elif name == "card":
        form = 1 if luhn(digits) else -1
        shape = 1 if len(digits) in (15, 16) else -1 if len(set(digits)) < 3 else 0
        known = 1 if digits[:1] in "4" or digits[:2] in ("34", "37", "51", "52", "53", "54", "55", "65") or digits[:4] == "6011" else 0
    elif name == "phone":
        form = 1 if span[:1] == "+" else -1 if DATE.fullmatch(span) else 0
        shape = 1 if len(digits) in (10, 11, 12) else -1
        known = 1 if span[:1] == "+" and any(digits[:n] in DIALLING for n in (1, 2)) else 0
        reserved = -1 if len(set(digits)) < 3 else 0
    else:
        whole = KEY.fullmatch(span) is not None
        mixed = HEX.fullmatch(span) or in_order(span, LOWER, UPPER, DIGIT) or in_order(span, DIGIT, LETTER, DIGIT)
        form = 1 if whole or len(set(span)) >= 12 and mixed and not path_like(span) else -1
        shape = 0 if whole else 1 if 0.15 <= len(digits) / len(span) <= 0.9 else -1
        known = 1 if span.startswith(KEY_PREFIXES) else 0
    words = 1 if TELLING[name].search(before) else 0
    assign = (1 if ASSIGN.search(before) else -1 if name == "secret" else 0) if name != "phone" else 0
    code = -1 if CODE.search(before) or name == "secret" and "/" in span and (before[-1:] in (".", ":") or span[0] == "/") else 0
    return form, shape, known, reserved, words, assign, code


#: The span's own features, each as one of so many values: length, share of digits, distinct characters, and the characters before and after.
OWN = (4, 4, 3, 4, 4)


def _beside(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalnum() else 2 if c in "\"'=:<([" else 3


def own_features(text: str, start: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    digits, distinct = len(digits_of(span)) / len(span), len(set(span))
    length = sum(len(span) > n for n in (12, 24, 48))
    return length, sum(digits > x for x in (0, 0.5, 0.95)), sum(distinct > n for n in (5, 11)), _beside(text[start - 1 : start]), _beside(text[end : end + 1])


def pattern_of(kind: int, base: bool, given: tuple[int, ...], own: tuple[int, ...] = (0,) * len(OWN)) -> int:
    """Kind, base or not, votes and features as one number."""
    out = kind * 2 + base
    for v in given:
        out = out * 3 + v + 1
    for x, n in zip(own, OWN, strict=True):
        out = out * n + x
    return out


def unpack_pattern(pattern: int) -> tuple[int, bool, tuple[int, ...], tuple[int, ...]]:
    own, given = [], []
    for n in reversed(OWN):
        pattern, x = divmod(pattern, n)
        own.append(x)
    for _ in LABELERS:
        pattern, v = divmod(pattern, 3)
        given.append(v - 1)
    return pattern // 2, bool(pattern % 2), tuple(reversed(given)), tuple(reversed(own))


@dataclass(frozen=True)
class Model:
    """Each labeler's reliability by kind (its yes to what is personal data, its no to what isn't), the prior by kind, and the span classifier."""

    reliability: dict[str, list[tuple[float, float]]]
    prior: dict[str, float]
    weights: np.ndarray

    def probability(self, pattern: int) -> float:
        return float(1 / (1 + np.exp(-(features(pattern) @ self.weights))))


def features(pattern: int) -> np.ndarray:
    """By kind: an intercept, each labeler's yes and no, and the span's own features; and whether the span is a base one."""
    kind, base, given, own = unpack_pattern(pattern)
    each = 1 + 2 * len(LABELERS) + sum(OWN)
    x = np.zeros(1 + each * len(KINDS))
    at = 1 + each * kind
    x[0], x[at] = base, 1
    for i, v in enumerate(given):
        x[at + 1 + 2 * i + (v < 0)] = v != 0
    at += 1 + 2 * len(LABELERS)
    for value, n in zip(own, OWN, strict=True):
        x[at + value] = 1
        at += n
    return x


#: What is known of labelers beforehand: how often each is right, and how much that counts, as a share of the kind's spans.
PRIOR, FORM_PRIOR = (0.7, 0.02), (0.99, 0.5)


def posterior(v: np.ndarray, hit: np.ndarray, clear: np.ndarray, yes: float) -> np.ndarray:
    """The probability of personal data, given rows of votes, each labeler's reliabilities and the prior."""
    odds = np.log(yes / (1 - yes)) + (v > 0) @ np.log(hit / (1 - clear)) + (v < 0) @ np.log((1 - hit) / clear)
    return 1 / (1 + np.exp(-odds))


def aggregate(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], dict[str, list[tuple[float, float]]], dict[str, float]]:
    """Expectation-maximisation, kind by kind: each pattern's probability, reliabilities and priors. Only votes count here.

    Where a labeler says nothing it tells nothing. A kind with few spans stays near what is known beforehand.
    """
    truth, reliability, prior = {}, {}, {}
    belief = np.array([FORM_PRIOR if name == "regex_form" else PRIOR for name in LABELERS])
    for k, name in enumerate(KINDS):
        own = [(p, n, np.array(unpack_pattern(p)[2])) for p, n in sorted(counts.items()) if unpack_pattern(p)[0] == k]
        hit, clear, yes = belief[:, 0].copy(), belief[:, 0].copy(), 0.6
        if own:
            v, n = np.stack([x[2] for x in own]), np.array([x[1] for x in own], float)
            n = n / n.sum() * min(n.sum(), 10_000)
            weight = belief[:, 1] * n.sum() + 10
            for _ in range(rounds):
                q = posterior(v, hit, clear, yes)
                is_one, is_none = (q * n)[:, None], ((1 - q) * n)[:, None]
                hit = np.clip(((v > 0) * is_one).sum(0) + belief[:, 0] * weight, 0, None) / (((v != 0) * is_one).sum(0) + weight)
                clear = np.clip(((v < 0) * is_none).sum(0) + belief[:, 0] * weight, 0, None) / (((v != 0) * is_none).sum(0) + weight)
                hit, clear = np.clip(hit, 0.01, 0.99), np.clip(clear, 0.01, 0.99)
                yes = float(np.clip((q @ n + 6) / (n.sum() + 10), 0.05, 0.95))
            truth |= {p: float(x) for (p, _, _), x in zip(own, q, strict=True)}
        reliability[name], prior[name] = list(zip(hit.tolist(), clear.tolist(), strict=True)), yes
    return truth, reliability, prior


def fit(counts: dict[int, int], rounds: int = 600, rate: float = 0.5) -> Model:
    """The classifier: logistic regression on soft labels, each pattern weighing by the logarithm of its count.

    Each pattern stands once more with its form vote turned, so that the classifier knows what a wrong form means
    also where the documents have none.
    """
    truth, reliability, prior = aggregate(counts)
    counts = dict(counts)
    for p in sorted(truth):
        kind, _, given, own = unpack_pattern(p)
        turned = (-given[0], *given[1:])
        other = pattern_of(kind, False, turned, own)
        if given[0] and other not in truth:
            hit, clear = map(np.array, zip(*reliability[KINDS[kind]], strict=True))
            truth[other], counts[other] = float(posterior(np.array([turned]), hit, clear, prior[KINDS[kind]])[0]), 1
    w = np.zeros(1 + len(KINDS) * (1 + 2 * len(LABELERS) + sum(OWN)))
    if truth:
        known = sorted(truth)
        x, y = np.stack([features(p) for p in known]), np.array([truth[p] for p in known])
        n = np.log1p(np.array([counts[p] for p in known], float))
        n /= n.sum()
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(x @ w)))
            w = w - rate * 4 * (x.T @ ((p - y) * n) + 1e-4 * w)
    return Model(reliability, prior, w)


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[int, int] = {}
    for batch in batches:
        for text in _texts(batch.column(0)):
            base = base_spans(text)
            for spans, is_base in ((base, True), (loose_spans(text, base), False)):
                for start, kind, end in spans:
                    p = pattern_of(kind, is_base, votes(text, start, kind, end), own_features(text, start, end))
                    counts[p] = counts.get(p, 0) + 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])


def _texts(column: pa.Array) -> Iterator[str]:
    for i in range(0, len(column), 256):
        for x in column.slice(i, 256).to_pylist():
            yield x or ""


def train(docs: DataFrame) -> Model:
    """A model from all the documents' spans."""
    counts = docs.select("text").mapInArrow(_patterns, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    return fit({r["pattern"]: r["n"] for r in counts.collect()})


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model, memo: dict[int, float]) -> list[tuple[int, int, int]]:
    out, free = [], 0
    for start, kind, end in loose_spans(text, base):
        p = pattern_of(kind, False, votes(text, start, kind, end), own_features(text, start, end))
        if p not in memo:
            memo[p] = model.probability(p)
        if memo[p] >= THRESHOLD and start >= free:
            out.append((start, kind, end))
            free = end
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base), whole documents' spans in order, for any use."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[int, float] = {}
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
        for batch in batches:
            rows = []
            for text in _texts(batch.column(1)):
                base = base_spans(text)
                both = sorted([(*x, True) for x in base] + [(*x, False) for x in added_spans(text, base, model, memo)])
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for a, k, b, is_base in both])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def pii_report(docs: DataFrame) -> DataFrame:
    """The contract's columns, from the spans found."""
    found = find(docs, train(docs))
    base = F.filter("spans", lambda s: s["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
