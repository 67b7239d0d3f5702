"""Personal data by weak supervision.

Base spans of four kinds (email, ip, card, phone) follow fixed patterns and
always stay. Candidates of further forms (``EXTRA``: account numbers, secrets,
names, IBANs, ...) come from wide generators and are kept where a final span
classifier accepts them. For that, labelers of three sorts vote on every
candidate, base or not: regex labelers (a stricter form, a checksum, a varied
make-up), gazetteer labelers (known endings, issuers, codes, names) and context
labelers (words just before, characters beside).

1. Every candidate of every document becomes a row of (kind, votes, features).
2. Expectation-maximisation over the counts of all vote patterns estimates,
   without labels, how reliable each labeler is and how likely each pattern is
   personal data. What reaches the driver is one row for each kind and pattern.
3. A logistic classifier is fitted to these posteriors on features that the
   votes don't cover as well: make-up, length, and the hashed words before and
   after. It reads a sample, stratified by pattern and weighted back to the true
   counts: ``max_rows`` candidates in all, yet at least ``LEAST`` of a pattern.

Defined cases: a null text counts as empty and has no span; repeated rows give
repeated rows; very long texts take time in proportion to their length; of
candidates that overlap the first, then the longest, counts, and none that
overlaps a base span; an empty table or one without candidates gives a model
that accepts none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import checkpoint, slices

# The kinds in their order, and the characters of an address's local part.
BASE = ("email", "ip", "card", "phone")
EXTRA = ("iban", "local_phone", "name", "national_id", "obscured_email", "account", "secret", "birth_date")
KINDS = BASE + EXTRA
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is entered at its start only and never given back, so long runs stay linear.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

# Further forms.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_OBSCURED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(] ?dot ?[\])] ?[A-Za-z0-9-]{1,63}){1,4}", re.IGNORECASE)
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9_])[0-9]{4}(?:[ -]?[0-9]){4,20}+(?![A-Za-z0-9_])")
# Any opaque token: long words are candidates too, and it is for the labelers to tell them from secrets.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+={0,2}")
_BIRTH = re.compile(r"(?<![0-9/.-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9/-])")
_TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Mme", "Señor", "Señora", "Don", "Doña")

# Gazetteers: generic endings of domains (those of countries are any two letters), given names, calling codes.
_ENDINGS = frozenset("com org net edu gov mil int info biz name pro mobi app dev xyz online site shop blog cloud eus cat asia".split())
_FIRST = frozenset(
    "Alice Anna Anne Antonio Ben Carlos Carmen Charles Clara Claire Daniel David Elena Emma Felix Francisco Frank George Hans Helen Henry Isabel Jack James Jan Jean Jennifer Johann John Jose Juan Julia Jürgen Karl "
    "Klaus Laura Lena Linda Louis Lucia Luis Maria Marie Mark Martin Mary Max Michael Michel Monica Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Rafael Richard Robert Sarah Sofia Sophie Stefan Susan Thomas Tom Ursula "
    "Victor William Wolfgang".split()
)
_NAME = re.compile(r"(?<!\w)(?:(?:%s)\.? (?:[A-Z][a-zà-ÿ]{1,30})(?: [A-Z][a-zà-ÿ]{1,30})?|(?:%s)(?: [A-Z][a-zà-ÿ]{1,30}){1,2})(?!\w)" % ("|".join(_TITLES), "|".join(sorted(_FIRST))))
_PAIR = re.compile(r"(?<!\w)[A-ZÀ-Þ][a-zà-ÿ]{1,30} [A-ZÀ-Þ][a-zà-ÿ]{1,30}(?!\w)")
_TITLED = re.compile(r"(?:%s)\.? " % "|".join(_TITLES))
_ZONES_1, _ZONES_2 = frozenset("17"), frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_ZONES_3 = frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
_PREFIXES = ("sk-", "sk_", "pk_", "AKIA", "ASIA", "ghp_", "gho_", "xox", "eyJ", "AIza", "glpat-")
_NEAR = {
    "email": frozenset(("mail", "e-mail", "email", "contact", "write", "correo", "courriel")),
    "ip": frozenset(("ip", "server", "host", "address", "client", "adresse")),
    "card": frozenset(("card", "visa", "credit", "pay", "karte", "carte", "tarjeta")),
    "phone": frozenset(("tel", "phone", "call", "fax", "mobile", "telefon", "móvil")),
    "iban": frozenset(("iban", "account", "konto", "bank", "compte", "cuenta")),
    "local_phone": frozenset(("tel", "phone", "call", "fax", "mobile", "telefon", "móvil")),
    "name": frozenset(("dear", "sincerely", "patient", "client", "signed", "regards")),
    "national_id": frozenset(("ssn", "social", "security", "id")),
    "obscured_email": frozenset(("mail", "e-mail", "email", "contact", "write", "reach")),
    "account": frozenset(("account", "card", "konto", "nr", "no", "number", "compte", "cuenta", "visa", "credit")),
    "secret": frozenset(("token", "key", "secret", "password", "passwd", "pwd", "bearer", "apikey", "api_key", "auth", "credential")),
    "birth_date": frozenset(("born", "birth", "dob", "geboren", "né", "née", "nacido", "nacida", "geb")),
}
_AGAINST = frozenset("version license licence isbn issn serial order sha sha1 sha256 md5 hash digest commit checksum total invoice ticket release doi page".split())
#: Kinds whose form alone says little, so that the lack of a word beside them speaks against them.
_OPAQUE = ("secret", "account", "name")
LABELERS = ("strict", "gazetteer", "near", "against", "beside", "varied")

# Features of the span classifier: votes, kind, length, share of digits, make-up, hashed words before and after.
_WORDS = 128
_AT_KIND = 2 * len(LABELERS)
_AT_LENGTH = _AT_KIND + len(KINDS)
_AT_DIGITS = _AT_LENGTH + 8
_AT_VARIED = _AT_DIGITS + 5
_AT_BEFORE = _AT_VARIED + 4
_AT_AFTER = _AT_BEFORE + _WORDS
WIDTH = _AT_AFTER + _WORDS
#: Candidates of each vote pattern that the classifier reads at least (all, if there are fewer).
LEAST = 8
_LAST_WORDS = re.compile(r"[^\W_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, in time linear in the text: from each @ outwards."""
    free = 0
    at = text.find("@")
    while at >= 0:
        local = at - free - len(text[free:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if local else None
        if domain:
            yield at - local, domain.end()
            free = domain.end()
        else:
            free = at + 1
        at = text.find("@", free)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base spans by start, then kind as listed."""
    found = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [(s, BASE[k], e) for s, k, e in sorted(found)]


def extra_candidates(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Candidates of the further forms that overlap no base span and no earlier candidate."""
    found = [(m.start(), "secret", m.end()) for m in _SECRET.finditer(text)]
    if _DIGIT.search(text):
        for pattern, kind in ((_IBAN, "iban"), (_LOCAL_PHONE, "local_phone"), (_NATIONAL, "national_id"), (_ACCOUNT, "account"), (_BIRTH, "birth_date")):
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if kind != "birth_date" or _near(text, m.start(), kind)]
    if "(" in text or "[" in text:
        found += [(m.start(), "obscured_email", m.end()) for m in _OBSCURED.finditer(text)]
    found += [(m.start(), "name", m.end()) for m in _NAME.finditer(text)]
    kept = _apart(found, base)
    # Two capitalised words are a name where nothing more is known of them; so they don't hide what is.
    pairs = [(m.start(), "name", m.end()) for m in _PAIR.finditer(text)]
    return sorted(kept + _apart(pairs, sorted(base + kept))) if pairs else kept


def _apart(found: list[tuple[int, str, int]], taken: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Of the found spans, by start and then length, those that overlap no earlier one and none that is taken."""
    # Both lists by start; taken spans may overlap each other, so the furthest end up to a place counts.
    kept, end, k, reach = [], 0, 0, 0
    for s, kind, e in sorted(found, key=lambda c: (c[0], -c[2], KINDS.index(c[1]))):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][2])
            k += 1
        if s >= end and s >= reach:
            kept.append((s, kind, e))
            end = e
    return kept


def _words_before(text: str, start: int) -> list[str]:
    return [w.lower() for w in _LAST_WORDS.findall(text[max(0, start - 40) : start])[-3:]]


def _near(text: str, start: int, kind: str) -> bool:
    return not _NEAR[kind].isdisjoint(_words_before(text, start))


def _varied(s: str) -> int:
    """1 for a make-up of many different characters, -1 for repeats or a counting sequence, else 0."""
    marks = [c for c in s if c.isalnum()]
    if len(set(marks)) <= 2 or (s.isdigit() and s in "01234567890123456789"):
        return -1
    return 1 if len(set(marks)) >= min(len(marks), 10) * 0.5 else 0


def _strict(kind: str, s: str) -> int:
    if kind == "email":
        local, _, domain = s.partition("@")
        return 1 if local[0] not in ".-%+" and ".." not in local and domain.rpartition(".")[2].isalpha() else -1
    if kind == "ip":
        return 1 if all(p == (p.lstrip("0") or "0") for p in s.split(".")) and not s.startswith(("0.", "255.")) else -1
    if kind == "card":
        return 1 if len(_digits(s)) in (13, 15, 16, 19) and len(set(s)) > 2 else -1
    if kind == "phone":
        return 1 if 10 <= len(_digits(s)) <= 14 and s.count("(") == s.count(")") else -1
    if kind == "iban":
        t = s.replace(" ", "")
        return 1 if 15 <= len(t) <= 34 and int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1 else -1
    if kind == "local_phone":
        return 1 if _digits(s)[0] in "23456789" else -1
    if kind == "national_id":
        return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
    if kind == "account":
        # As long as a card's number, but its check digit is wrong: the strongest sign against.
        return 0 if not 12 <= len(_digits(s)) <= 19 else 1 if luhn(_digits(s)) else -1
    if kind == "name":
        return 1 if _TITLED.match(s) or s.count(" ") == 2 else 0 if s.partition(" ")[0] in _FIRST else -1
    if kind == "secret":
        letters, digits = sum(c.isalpha() for c in s), sum(c.isdigit() for c in s)
        return 1 if letters >= 4 and digits >= 4 and "/" not in s and s.count("-") + s.count("_") <= 3 else -1
    if kind == "birth_date":
        parts = [int(x) for x in re.split(r"[./-]", s)]
        year, rest = (parts[0], parts[1:]) if parts[0] > 31 else (parts[2], parts[:2])
        return 1 if 1900 <= year <= 2025 and min(rest) >= 1 and min(rest) <= 12 and max(rest) <= 31 else -1
    return 1


def _gazetteer(kind: str, s: str) -> int:
    if kind in ("email", "obscured_email"):
        ending = re.split(r"[^A-Za-z]+", s.rstrip(")] "))[-1].lower()
        return 1 if ending in _ENDINGS or len(ending) == 2 else -1
    if kind == "card":
        return 1 if s[0] in "3456" else -1
    if kind == "phone":
        d = _digits(s)
        return 1 if d[0] in _ZONES_1 or d[:2] in _ZONES_2 or d[:2] in _ZONES_3 else -1
    if kind == "name":
        return 1 if any(w in _FIRST for w in s.split(" ")) or _TITLED.match(s) else -1
    if kind == "secret":
        return 1 if s.startswith(_PREFIXES) else 0
    return 0


def votes(text: str, span: tuple[int, str, int]) -> tuple[int, ...]:
    """Each labeler's vote: 1 for, -1 against, 0 none."""
    start, kind, end = span
    clean = lambda c: not (c.isalnum() or c in "_@")
    beside = (start == 0 or clean(text[start - 1])) and (end == len(text) or clean(text[end]))
    s = text[start:end]
    return (
        _strict(kind, s),
        _gazetteer(kind, s),
        1 if _near(text, start, kind) else -1 if kind in _OPAQUE else 0,
        0 if _AGAINST.isdisjoint(_words_before(text, start)) else -1,
        0 if kind in EXTRA else 1 if beside else -1,  # the generators of the further forms ask for it themselves
        _varied(s),
    )


def _bucket(words: list[str]) -> int:
    return zlib.crc32(words[0].lower().encode("utf-8", "surrogatepass")) % (_WORDS - 1) + 1 if words else 0


def features(text: str, span: tuple[int, str, int], vote: tuple[int, ...]) -> list[int]:
    """Indices of the indicators of a candidate; beyond the votes its kind, length, make-up and the words beside it."""
    start, kind, end = span
    s = text[start:end]
    out = [2 * k + (v < 0) for k, v in enumerate(vote) if v]
    out += [_AT_KIND + KINDS.index(kind), _AT_LENGTH + min(7, len(s).bit_length()), _AT_DIGITS + 4 * sum(map(str.isdigit, s)) // len(s), _AT_VARIED + 4 * len(set(s)) // (len(s) + 1)]
    out.append(_AT_BEFORE + _bucket(_LAST_WORDS.findall(text[max(0, start - 40) : start])[-1:]))
    out.append(_AT_AFTER + _bucket(_LAST_WORDS.findall(text[end : end + 40])[:1]))
    return out


@dataclass
class SpanModel:
    """A weight of log-odds for each indicator, and what expectation-maximisation says of each labeler."""

    weights: np.ndarray
    reliability: dict[str, float]

    def probability(self, indicators: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[indicators].sum(), -30, 30))))


Pattern = tuple[str, tuple[int, ...], int]


def expectation_maximisation(patterns: list[Pattern], rounds: int = 200) -> tuple[np.ndarray, dict[str, float]]:
    """Posterior that each pattern (kind, votes, count) is personal data, and each labeler's estimated accuracy.

    In each kind a labeler votes for with one probability where the span is personal data and with another where it
    is not; what is strong evidence on one kind may say nothing on another. Each kind has a prior of its own. It
    starts from a majority of the votes.
    """
    counts = np.array([n for *_, n in patterns], dtype=float)
    v = np.array([vote for _, vote, _ in patterns])
    kinds = np.array([KINDS.index(k) for k, *_ in patterns])
    own = np.eye(len(KINDS))[kinds]
    posterior = np.clip(0.5 + 0.15 * v.sum(axis=1), 0.05, 0.95)
    table = np.zeros((2, len(KINDS), len(LABELERS), 3))
    for _ in range(rounds):
        for side, p in enumerate((1 - posterior, posterior)):
            for value in (-1, 0, 1):
                # Pseudo-counts: labelers are better than chance.
                lean = 2.0 + 2.0 * (value == (1 if side else -1))
                table[side, :, :, value + 1] = own.T @ ((v == value) * (p * counts)[:, None]) + lean
            table[side] /= table[side].sum(axis=2, keepdims=True)
        prior = ((own.T @ (posterior * counts)) + 1) / (own.T @ counts + 2)
        score = np.log(prior[kinds] / (1 - prior[kinds]))
        for j in range(len(LABELERS)):
            score = score + np.log(table[1, kinds, j, v[:, j] + 1] / table[0, kinds, j, v[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        settled = np.abs(new - posterior).max() < 1e-6
        posterior = new
        if settled:
            break
    accuracy = {}
    for j, name in enumerate(LABELERS):
        right = (counts * np.where(v[:, j] > 0, posterior, np.where(v[:, j] < 0, 1 - posterior, 0))).sum()
        cast = (counts * (v[:, j] != 0)).sum()
        accuracy[name] = float(right / cast) if cast else 0.5
    return posterior, accuracy


def fit_classifier(rows: list[list[int]], weight: np.ndarray, goal: np.ndarray, steps: int = 60) -> np.ndarray:
    """Logistic regression of indicators against soft labels, by damped Newton steps; the penalty is half the squared weights."""
    x = np.zeros((len(rows), WIDTH))
    for k, r in enumerate(rows):
        x[k, r] = 1
    w = np.zeros(WIDTH)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(WIDTH)
        step = np.clip(np.linalg.solve(hessian, x.T @ (weight * (p - goal)) + w), -2, 2)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(patterns: list[Pattern], sample: list[tuple[str, tuple[int, ...], list[int], int]]) -> SpanModel:
    """Expectation-maximisation over all patterns, then the classifier over sampled candidates (kind, votes, indicators, count).

    The sample of a pattern stands for all of it: counts are scaled to the pattern's own.
    """
    if not patterns or not sample:
        w = np.zeros(WIDTH)
        w[_AT_KIND:_AT_LENGTH] = -5
        return SpanModel(w, {})
    patterns, sample = sorted(patterns), sorted(sample)
    posterior, accuracy = expectation_maximisation(patterns)
    of = {(k, v): (p, n) for (k, v, n), p in zip(patterns, posterior)}
    drawn: Counter = Counter()
    for k, v, _, c in sample:
        drawn[k, v] += c
    weight = np.array([of[k, v][1] * c / drawn[k, v] for k, v, _, c in sample], dtype=float)
    goal = np.array([of[k, v][0] for k, v, _, _ in sample])
    return SpanModel(fit_classifier([r for _, _, r, _ in sample], weight, goal), accuracy)


_VOTES, _MARKS = "array<int>", "array<int>"


def candidates(docs: DataFrame) -> DataFrame:
    """Every candidate, base or not, of every document: kind, votes, marks (indicators), draw."""

    def run(batches):
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    for span in base + extra_candidates(text, base):
                        vote = votes(text, span)
                        draw = hashlib.blake2b(f"{span[0]}:{len(text)}:{text[span[0]:span[2]]}".encode("utf-8", "surrogatepass"), digest_size=4).digest()
                        rows.append((span[1], list(vote), features(text, span, vote), int.from_bytes(draw, "little") / 2**32))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.float64())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["kind", "votes", "marks", "draw"])

    return docs.select("text").mapInArrow(run, f"kind string, votes {_VOTES}, marks {_MARKS}, draw double")


def train(docs: DataFrame, max_rows: int = 20_000) -> SpanModel:
    """Counts the vote patterns of every candidate of every document and fits the model."""
    spark = docs.sparkSession
    found = checkpoint(candidates(docs))
    # One row at most for each kind and pattern.
    counts = [(r.kind, tuple(r.votes), r.n) for r in found.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()]
    if not counts:
        return fit([], [])
    each = max(LEAST, max_rows // len(counts))
    shares = spark.createDataFrame([(k, list(v), min(1.0, each / n)) for k, v, n in sorted(counts)], f"kind string, votes {_VOTES}, share double")
    # As many rows as there are patterns. The draw is by content, so reruns agree; copies are drawn together and counted.
    drawn = found.join(F.broadcast(shares), ["kind", "votes"]).filter("draw < share").groupBy("kind", "votes", "marks").agg(F.min("draw").alias("draw"), F.count("*").alias("n"))
    # The row of the least draw of each pattern stands for it where the share drew none.
    first = found.groupBy("kind", "votes").agg(F.min_by("marks", F.struct("draw", "marks")).alias("marks")).select("kind", "votes", "marks", F.lit(-1.0).alias("draw"), F.lit(0).cast("long").alias("n"))
    rows = drawn.unionByName(first).orderBy("draw", "kind", "votes", "marks").limit(max(max_rows, LEAST * len(counts)) + len(counts)).collect()
    met = {(r.kind, tuple(r.votes)) for r in rows if r.n}
    return fit(counts, [(r.kind, tuple(r.votes), list(r.marks), r.n or 1) for r in rows if r.n or (r.kind, tuple(r.votes)) not in met])


def spans(text: str, model: SpanModel, threshold: float = 0.9) -> tuple[list, list]:
    """(base spans, all spans), each by start."""
    base = base_spans(text)
    more = [s for s in extra_candidates(text, base) if model.probability(features(text, s, votes(text, s))) >= threshold]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[1]))) if more else base


def _join(found: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def find(docs: DataFrame, model: SpanModel | None = None, threshold: float = 0.9) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, n_added (of them those that the method adds)."""
    model = model or train(docs)

    def run(batches):
        for b in slices(batches):
            counts, digests, joined, every_n, added = [], [], [], [], []
            for text in b.column("text").to_pylist():
                base, every = spans(text or "", model, threshold)
                c = Counter(k for _, k, _ in base)
                counts.append([c[k] for k in BASE])
                digests.append(hashlib.sha256(_join(base).encode()).hexdigest())
                joined.append(_join(every))
                every_n.append(len(every))
                added.append(len(every) - len(base))
            yield pa.record_batch(
                [b.column("doc_id"), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(4)], pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(every_n, pa.int64()), pa.array(added, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "n_added"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_added long")


def redact_text(text: str, found: list) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the union goes."""
    out, at = [], 0
    for start, kind, end in found:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: SpanModel | None = None, threshold: float = 0.9) -> DataFrame:
    """All rows and columns of ``docs`` with personal data in ``text`` replaced; nulls stay null."""
    model = model or train(docs)
    at = docs.columns.index("text")

    def run(batches):
        for b in slices(batches):
            texts = [t if t is None else redact_text(t, spans(t, model, threshold)[1]) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at).with_nullable(True), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
