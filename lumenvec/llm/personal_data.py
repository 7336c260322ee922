"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Spans of four kinds are found. *Base* spans follow fixed patterns (``base_spans``)
and always stay. They miss data that stands side by side (a telephone number and
a card number read as one long number), groups after a wrong first number, and
addresses written out ("name (at) host (dot) org"). Such places are candidates:
every form of a kind that overlaps no base span.

Five labelers vote on a span: +1, 0 (no opinion) or -1. Two are patterns (the
base rule on the span alone; the usual layout), one is a gazetteer (domain ends,
card issuers' first digits, country codes, address blocks), two read the context
(words before it; the characters at its edges). For each kind, expectation-
maximisation over the counts of all vote patterns estimates how often each
labeler is right, without any label, and gives a span the probability that it
is personal data. Each labeler is taken to speak for the truth rather than
against it. A logistic classifier is then trained on the spans' own features with these
probabilities as targets; it decides on the candidates.

Scale: texts are read where they lie, twice: once for counts, once for results.
Counts of vote patterns, at most 4 * 3^5, cover the whole corpus; the classifier
is fitted on the ``max_patterns`` commonest feature patterns. No text leaves its
row. The time for a text grows with its length: long runs of digits, signs or
letters are read once, not once for each place in them.

Defined results: a null or empty text has no spans; positions are code points,
the end exclusive; spans come by kind as in ``KINDS``, then by start; rows that
repeat have a result each; a null doc_id passes; without any span in the corpus
nothing is added; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize
from lumenvec.session import ship_package

KINDS = ("email", "ip", "card", "phone")
VOTES = 5
SPANS = "array<struct<kind:string,start:int,end:int,base:boolean,probability:double>>"

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: What numbers are written with; no number of any kind is shorter.
ISLAND = re.compile(r"[0-9 ().:+-]{7,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r" ?[\[({] ?(?:at|AT) ?[\])}] ?")
WRITTEN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?[\[({] ?(?:dot|DOT) ?[\])}] ?)[A-Za-z0-9-]+)+")
QUAD = re.compile(r"(?<![0-9])(?=([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]))")
LONG = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])")
CALL = re.compile(r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])")

# Ends of domains, words around personal data, words around other numbers.
DOMAIN_ENDS = frozenset("com org net edu gov mil int info biz io dev app ai me eu uk de fr es it nl be ch at pl se no dk fi ie pt br mx ar cl co us ca au nz jp cn in kr ru za".split())
CUES = {
    "email": frozenset("mail email e-mail mailto contact write reply correo courriel adresse kontakt".split()),
    "ip": frozenset("ip ipv4 host server address adresse dirección client login gateway dns ping".split()),
    "card": frozenset("card visa mastercard amex credit debit payment tarjeta carte karte kreditkarte".split()),
    "phone": frozenset("phone telephone tel call mobile cell fax whatsapp teléfono téléphone telefon anruf móvil handy".split()),
}
OTHER_NUMBERS = frozenset("version v release build revision rev isbn issn doi order invoice id token hash sha md5 uuid section chapter figure table page key secret password".split())


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(twice)) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets_fit(s: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in s.split("."))


def rule_holds(kind: str, s: str) -> bool:
    """The check a base match has to pass."""
    if kind == "email":
        return True
    if kind == "ip":
        return octets_fit(s)
    n = len(d := digits_of(s))
    return 16 <= n <= 19 and luhn(d) if kind == "card" else 8 <= n <= 15


def islands(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in ISLAND.finditer(text)]


def base_spans(text: str, places: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and apart for each kind, by kind and start."""
    found, done = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        at = lo = m.start()
        while lo > done and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at:
            done = m.end()
            found.append(("email", lo, done))
    places = islands(text) if places is None else places
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for a, b in places:
            found += [(kind, *m.span()) for m in pattern.finditer(text, a, b) if rule_holds(kind, m[0])]
    return found


def candidates(text: str, base: list[tuple[str, int, int]], places: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Other forms of each kind that overlap no base span."""
    found = []
    for m in AT.finditer(text):
        lo = m.start()
        while lo and text[lo - 1] in LOCAL and m.start() - lo < 64:  # no local part is longer
            lo -= 1
        if lo < m.start() and (rest := WRITTEN.match(text, m.end())):
            found.append(("email", lo, rest.end()))
    for a, b in places:
        found += [("ip", *m.span(1)) for m in QUAD.finditer(text, a, b) if octets_fit(m[1])]
        found += [("card", *m.span()) for m in LONG.finditer(text, a, b)]
        found += [("phone", *m.span()) for m in CALL.finditer(text, a, b)]
    if not found:
        return []
    taken = sorted((lo, hi) for _, lo, hi in base)
    return [x for x in found if not overlaps(taken, x[1], x[2])]


def overlaps(taken: list[tuple[int, int]], lo: int, hi: int) -> bool:
    """``taken`` is sorted; spans of different kinds can overlap each other there."""
    from bisect import bisect_left

    at = bisect_left(taken, (hi, 0))
    # Base spans of one kind are apart, so only the last few that begin before hi can reach lo.
    return any(end > lo for _, end in taken[max(0, at - 2 * len(KINDS)) : at])


WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*", re.UNICODE)


def edge(c: str) -> str:
    return "" if not c else "w" if c.isalnum() or c in "_=\"'" else "s" if c.isspace() else "p"


def votes_and_features(text: str, kind: str, lo: int, hi: int) -> tuple[tuple[int, ...], tuple[str, ...]]:
    """The five votes on a span, and its features for the classifier."""
    s, d = text[lo:hi], digits_of(text[lo:hi])
    if kind == "email":
        strict = 1 if DOMAIN.search(s) else 0
        end = s.rpartition(".")[2] if "." in s else re.split(r"[\])}] ?", s)[-1]
        layout = 1 if "@" in s and s[0] not in ".-%+" else -1 if s[0] in ".-%+" else 0
        listed = 1 if end.lower() in DOMAIN_ENDS else -1
    elif kind == "ip":
        parts = s.split(".")
        strict = 1 if octets_fit(s) else -1
        layout = 1 if all(p == (p.lstrip("0") or "0") for p in parts) else -1
        first = int(parts[0].lstrip("0")[:4] or "0")
        listed = 1 if 0 < first < 224 and first != 127 else 0 if first < 256 else -1
        if sum(len(p) for p in parts) < 6:  # as versions are written
            layout = 0
    elif kind == "card":
        strict = 1 if rule_holds(kind, s) else -1
        layout = 1 if len(d) == 16 and (s == d or re.fullmatch(r"[0-9]{4}(?:[ -][0-9]{4}){3}", s)) else 0
        prefix = int(d[:2])
        listed = 1 if prefix // 10 == 4 or 51 <= prefix <= 55 or 22 <= prefix <= 27 or prefix in (34, 35, 37, 60, 62, 64, 65) else -1
    else:
        strict = 1 if s[0] == "+" and rule_holds(kind, s) else 0 if 7 <= len(d) <= 15 else -1
        layout = 1 if "(" in s or s.count("-") + s.count(".") + s.count(" ") >= 2 else -1 if len(set(d)) < 3 else 0
        listed = 1 if s[0] == "+" and s[1] != "0" else 0
    before = [w.lower() for w in WORD.findall(text[max(0, lo - 40) : lo])][-4:]
    cue = 1 if not CUES[kind].isdisjoint(before) else -1 if not OTHER_NUMBERS.isdisjoint(before) else 0
    left, right = edge(text[lo - 1 : lo]), edge(text[hi : hi + 1])
    clear = -1 if "w" in (left, right) else 1
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))[:24] if kind != "email" else ("@" if "@" in s else "at")
    return (strict, layout, listed, cue, clear), (f"shape {shape}", f"digits {min(len(d), 20)}", f"rule {strict}", f"listed {listed}", f"cue {cue}", f"left {left}", f"right {right}")


def spans_of(text: str) -> Iterator[tuple[str, int, int, bool]]:
    places = islands(text)
    base = base_spans(text, places)
    for x in base:
        yield *x, True
    for x in candidates(text, base, places):
        yield *x, False


@dataclass(frozen=True)
class Fit:
    rounds: int = 100
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-4
    max_patterns: int = 4096
    least_probability: float = 0.8


@dataclass(frozen=True)
class Model:
    reliability: dict = field(default_factory=dict)  # kind -> (prior, P(vote | no), P(vote | yes)), votes -1, 0, 1
    weights: dict = field(default_factory=dict)  # (kind, feature) -> weight
    least_probability: float = 0.8

    def probability(self, kind: str, features: tuple[str, ...]) -> float:
        if (kind, "") not in self.weights:
            return 0.0
        z = self.weights[kind, ""] + sum(self.weights.get((kind, f), 0.0) for f in features)
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100):
    """Dawid-Skene EM on counts of vote patterns: (prior, P(vote | no), P(vote | yes), posterior by pattern)."""
    import numpy as np

    votes = np.array([v for v, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], float)
    hot = np.eye(3)[votes]  # pattern, labeler, vote
    lead = np.array([[-1.0, 0.0, 1.0]])
    p = 1 / (1 + np.exp(-(hot * lead).sum(axis=(1, 2))))  # the majority to begin with
    # Beforehand a labeler is right more often than not, as if seen on a few spans.
    no, yes = np.array([3.0, 2.0, 1.0]), np.array([1.0, 2.0, 3.0])
    for _ in range(rounds):
        prior = (n @ p + 1) / (n.sum() + 2)
        given = []
        for weight, seen in ((n * (1 - p), no), (n * p, yes)):
            c = np.einsum("i,ijk->jk", weight, hot) + seen
            given.append(c / c.sum(axis=1, keepdims=True))
        # No labeler speaks against the truth: its votes' odds rise from -1 over 0 to 1.
        odds = np.maximum.accumulate(np.log(given[1]) - np.log(given[0]), axis=1)
        odds = np.where(odds[:, 2:] < 0, 0.0, odds)
        z = np.log(prior / (1 - prior)) + np.einsum("ijk,jk->i", hot, odds)
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    return float(prior), given[0], given[1], p


def fit_classifier(rows: list[tuple[str, tuple[str, ...], float, float]], fit: Fit = Fit()) -> dict:
    """Weights of a logistic classifier for each kind; rows: (kind, features, probability, count)."""
    import numpy as np

    out = {}
    for kind in KINDS:
        own = [r for r in rows if r[0] == kind]
        if not own:
            continue
        names = sorted({f for r in own for f in r[1]})
        place = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(own), len(names) + 1))
        x[:, -1] = 1
        for i, r in enumerate(own):
            x[i, [place[f] for f in r[1]]] = 1
        y = np.array([r[2] for r in own])
        w = np.log1p(np.array([r[3] for r in own], float))  # common patterns count more, but don't drown the rest
        w /= w.sum()
        theta, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
        for step in range(1, fit.steps + 1):
            g = x.T @ (w * (1 / (1 + np.exp(-np.clip(x @ theta, -40, 40))) - y)) + fit.decay * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta -= fit.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9) / math.sqrt(step)
        out |= {(kind, f): float(theta[i]) for f, i in place.items()} | {(kind, ""): float(theta[-1])}
    return out


def train(docs: DataFrame, fit: Fit = Fit(), text: str = "text") -> Model:
    """The model from all texts; counts of patterns are all that reaches the driver."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            seen: Counter = Counter()
            for t in b.column(0).to_pylist():
                for kind, lo, hi, _ in spans_of(t or ""):
                    votes, features = votes_and_features(t, kind, lo, hi)
                    seen[kind, ",".join(map(str, votes)), "\t".join(features)] += 1
            columns = list(zip(*((*k, n) for k, n in seen.items()))) or [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["kind", "votes", "features", "n"])

    made = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, votes string, features string, n long")
    counts = made.groupBy("kind", "votes", "features").agg(F.sum("n").alias("n"))
    counts = materialize(counts, "span-patterns")
    reliability, posterior = {}, {}
    ballots = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()  # at most 4 * 3^5
    for kind in KINDS:
        own = [(tuple(map(int, r["votes"].split(","))), r["n"]) for r in ballots if r["kind"] == kind]
        if own:
            prior, no, yes, p = estimate(own, fit.rounds)
            reliability[kind] = (prior, no.tolist(), yes.tolist())
            posterior |= {(kind, v): float(x) for (v, _), x in zip(own, p)}
    common = counts.orderBy(F.desc("n"), "kind", "votes", "features").limit(fit.max_patterns).collect()
    rows = [(r["kind"], tuple(r["features"].split("\t")), posterior[r["kind"], tuple(map(int, r["votes"].split(",")))], r["n"]) for r in common]
    return Model(reliability, fit_classifier(rows, fit), fit.least_probability)


def decided(text: str | None, model: Model) -> list[tuple[str, int, int, bool, float]]:
    """The spans of one text: all base ones and the candidates the classifier takes, apart within a kind."""
    out = []
    for kind, lo, hi, base in spans_of(text or ""):
        p = model.probability(kind, votes_and_features(text, kind, lo, hi)[1])
        if base or p >= model.least_probability:
            out.append((kind, lo, hi, base, p))
    if all(x[3] for x in out):
        return out
    out.sort(key=lambda x: (KINDS.index(x[0]), x[1], x[2]))
    apart: list[tuple[str, int, int, bool, float]] = []
    for x in out:
        if x[3] or not apart or apart[-1][0] != x[0] or apart[-1][2] <= x[1]:
            apart.append(x)
    return apart


def found(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, spans) for every row; ``spans`` tells kind, start, end, whether it is a base span, and its probability."""
    ship_package(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ("kind", "start", "end", "base", "probability")
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("probability", pa.float64())]))
        for b in batches:
            rows = [[dict(zip(names, x)) for x in decided(t, model)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, spans)], ["doc_id", "spans"])

    lean = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return lean.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind; overlapping spans become the first one's."""
    if not spans:
        return text
    out, at = [], 0
    for kind, lo, hi in sorted(spans, key=lambda x: (x[1], -x[2])):
        if lo >= at:
            out += [text[at:lo], f"[{kind.upper()}]"]
        at = max(at, hi)
    return "".join([*out, text[at:]])
