"""Personal data: generators propose overlapping spans, boosted trees judge them, calibrated thresholds select.

Base spans (email, ip, card, phone by format and check) always stay.  The generators look beyond them, at every run of
digits, every @ or (at), every quoted value after = or :, every value after a cue of secrets, quoted or not, and every
long mark, and propose spans of the kinds below; many proposals are wrong or overlap.  For each the trees read format features (length, digits, separators, group sizes, checks, letters by
kind) and context features (cue words before it, marks around it).  A proposal whose calibrated chance reaches its kind's
threshold becomes a span; of overlapping ones the likeliest stays, at equal chance the more specific kind
(SPECIFIC), then the longer, then the first; none may touch a base span.

The trees are trained in the driver on TRAIN_ROWS labelled examples that :func:`examples` writes from format grammars
with a fixed seed (true forms and look-alikes: dates, versions, prices, order numbers, hashes of files), so the
model does not depend on the table.  Thresholds are the least at which held-out precision reaches PRECISION.

Defined cases: a null or empty text has no spans; a null doc_id is carried through; repeated rows are judged alike; an
empty table gives an empty result; further columns are ignored by :func:`report` and kept by :func:`redact`.
Positions are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.boost import Boosted
from corvane.llm.common import bounded_batches

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds.
ADDED = ("mail", "number", "ssn", "secret")
KINDS = BASE + ADDED
#: Kinds whose form says more come first where chances are equal.
SPECIFIC = ("ssn", "mail", "secret", "number")
TRAIN_ROWS, HELD_ROWS, PRECISION = 4000, 2000, 0.99

_DIGITS = re.compile(r"[0-9]++")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_AT = re.compile(r"\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]+(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?)[A-Za-z0-9-]+)+")
_VALUE = re.compile(r"[=:]\s*[\"']([^\"'\s]{8,}+)[\"']")
_CUED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|key|bearer|credentials?|contraseña|clave|passwort|kennwort|mot de passe)[\"']?\s{0,2}(?:[=:]\s{0,2}|\s)[\"']?([^\"'\s,;<>()\[\]{}]{6,}+)")
#: Words without which _CUED matches nothing; a plain search for each is cheaper than the pattern.
_CUE_WORDS = ("token", "secret", "passw", "pwd", "key", "bearer", "credential", "contraseña", "clave", "kennwort", "mot de passe")
_TOKEN = re.compile(r"[A-Za-z0-9_+/=-]{20,}+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits that go on before or after a proposal: joined by a mark, or set apart by a space.
_BESIDE = [re.compile(r"[0-9][-./(]$"), re.compile(r"[0-9][)./-]? [(+]?$"), re.compile(r"^[-./)][0-9]"), re.compile(r"^[)./-]? [(]?[0-9]")]
_CUES = {
    "phone": re.compile(r"(?i)\b(tel|phone|call|mobile|cell|fax|contact|reach|dial|text me|whatsapp|telefon|téléphone|teléfono|appelez|móvil|llame|portable|handy|anrufen|rufen)\W*\w*\W*$"),
    "id": re.compile(r"(?i)\b(ssn|social security|tax id|passport|national id|id number|licen[cs]e no)\W*\w*\W*$"),
    "secret": re.compile(r"(?i)(token|secret|passw(or)?d|api[_ -]?key|access[_ -]?key|bearer|credentials?|private[_ -]?key|passwd|pwd|(aws|ssh|secret)[_ -]?key|contraseña|clave|passwort|kennwort|mot de passe)\W*$"),
    "other": re.compile(r"(?i)\b(order|invoice|isbn|version|page|price|date|ref|no|id|sha|commit|checksum|md5|build|release|ticket)\W*$"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """The base spans of a text; runs: where its digits are.

    Emails grow to the left of each @ and so need no search for their start; ip and card are read off the runs.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((a, m.end(), "email"))
            done = m.end()
        at = text.find("@", at + 1)
    k = 0
    while k + 3 < len(runs):  # ip: four runs joined by one dot each
        part = runs[k : k + 4]
        if all(text[x[1] : y[0]] == "." for x, y in zip(part, part[1:])):
            if all(b - a <= 3 and int(text[a:b]) <= 255 or not text[a:b].lstrip("0") or int(text[max(a, b - 9) : b]) <= 255 and not text[a : max(a, b - 9)].lstrip("0") for a, b in part):
                out.append((part[0][0], part[3][1], "ip"))
            k += 4
        else:
            k += 1
    k = 0
    while k < len(runs):  # card: runs joined by one space or hyphen each
        j = k
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
        n = sum(b - a for a, b in runs[k : j + 1])
        if 12 <= n <= 19 and luhn("".join(text[a:b] for a, b in runs[k : j + 1])):
            out.append((runs[k][0], runs[j][1], "card"))
        k = j + 1
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def candidates(text: str, runs: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """What might be personal data beyond the base: more than is, and overlapping."""
    if "at" in text and ("(" in text or "[" in text):
        for m in _AT.finditer(text):
            lo = m.start()
            while lo > 0 and text[lo - 1] in _NAME:
                lo -= 1
            if m.start() - lo >= 2:
                yield lo, m.end(), "mail"
    if '"' in text or "'" in text:
        for m in _VALUE.finditer(text):
            yield m.start(1), m.end(1), "secret"
    folded = text.casefold()
    for m in _CUED.finditer(text) if any(w in folded for w in _CUE_WORDS) else ():
        yield m.start(1), m.start(1) + len(m.group(1).rstrip(".:!?")), "secret"
    if runs:
        for m in _TOKEN.finditer(text):
            if _DIGITS.search(text, m.start(), m.end()):
                yield m.start(), m.end(), "secret"
    for k, (a, b) in enumerate(runs):
        if b - a == 3 and k + 2 < len(runs) and runs[k + 1][1] - runs[k + 1][0] == 2 and runs[k + 2][1] - runs[k + 2][0] == 4 and text[b : runs[k + 1][0]] == text[runs[k + 1][1] : runs[k + 2][0]] == "-":
            yield a, runs[k + 2][1], "ssn"
        j, n = k, b - a
        while n <= 19:
            if n >= 7:
                yield a - (a > 0 and text[a - 1] in "(+"), runs[j][1], "number"
            if j + 1 == len(runs) or runs[j + 1][0] - runs[j][1] > 2 or text[runs[j][1] : runs[j + 1][0]].strip(" ().-/"):
                break
            j += 1
            n += runs[j][1] - runs[j][0]


def describe(text: str, a: int, b: int, kind: str) -> list[float]:
    """The features of a proposal."""
    s, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 2]
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    digits = "".join(c for c in s if c.isdigit())
    letters = sum(c.isalpha() for c in s)
    changes = sum(x.isdigit() != y.isdigit() for x, y in zip(s, s[1:]))
    return [
        float(ADDED.index(kind)), len(s), len(digits), letters, len(groups), groups[0] if groups else 0, groups[-1] if groups else 0, max(groups, default=0),
        s.count("-"), s.count("."), s.count("/"), s.count(" "), float("(" in s), float(s.startswith("+")), float(luhn(digits)) if len(digits) >= 12 else 0.5,
        changes / max(1, len(s) - 1), len(set(s)) / max(1, len(s)), float(bool(re.fullmatch("[0-9a-f]+", s))), float(s.lower() != s and s.upper() != s), float(bool(re.search(r"\bdot\b|\.", s))),
        *(float(bool(c.search(before))) for c in _CUES.values()), float(before[-1:] in "\"'"), float(after[:1] in "\"'"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(re.search(r"[$€£#]\s?$", before))),
        float(digits[:2] in ("19", "20")) if len(digits) <= 8 else 0.0,
        *(float(bool(c.search(before))) for c in _BESIDE[:2]), *(float(bool(c.search(text[b : b + 4]))) for c in _BESIDE[2:]), groups[1] if len(groups) > 1 else 0, float(groups[:1] == [4] and digits[:2] in ("19", "20")),
    ]


def examples(n: int, seed: int) -> tuple[list[tuple[str, int, int, str]], np.ndarray]:
    """Labelled proposals (text, start, end, kind) from format grammars: true forms and look-alikes, with and without cues."""
    r = np.random.default_rng(seed)
    pick = lambda *xs: xs[int(r.integers(len(xs)))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    chars = lambda k, of: "".join(of[int(i)] for i in r.integers(0, len(of), k))
    low, hexa, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    word = lambda: chars(int(r.integers(2, 9)), low)

    def cue() -> str:
        """What stands before a value that may be secret, without a quote."""
        return pick("password", "passwd", "pwd", "token", "secret", "api_key", "API key", "AWS key", "access key", "credential", "contraseña", "mot de passe", "Passwort") + pick("=", " = ", ": ", ":", " ")

    def chosen() -> str:
        """A password as people choose them: words, digits and marks."""
        return pick(word() + word() + digits(int(r.integers(1, 4))), word() + digits(1) + word(), word().capitalize() + pick("!", "@", "#", "$", "_") + digits(int(r.integers(2, 5))) + word(), word() + "-" + digits(4) + word())

    def true_form() -> tuple[str, str, str]:
        kind = pick("mail", "number", "ssn", "secret", "secret")
        if kind == "mail":
            return kind, pick("mail ", "", f"{word()} "), word() + pick(" (at) ", "(at)", " [at] ") + word() + pick(".", " (dot) ", " [dot] ") + pick("com", "org", "net", "de", "fr")
        if kind == "number":
            return kind, pick("call ", "phone: ", "tel. ", "tel ", "Tel: ", "mobile ", "contact ", "teléfono ", "téléphone : ", "Telefon: ", "móvil ", "appelez "), phone()
        if kind == "ssn":
            return kind, pick("ssn ", "SSN: ", "social security ", "", f"{word()} "), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if pick(True, False):
            return kind, cue(), pick(chosen(), chosen(), "AKIA" + chars(16, capitals), chars(int(r.integers(8, 20)), mixed), chars(40, hexa))
        return kind, pick('token = "', 'secret = "', 'api_key: "', "password='", 'access_key = "', "Bearer "), pick(chars(40, hexa), chars(32, hexa), chars(int(r.integers(20, 44)), mixed), chars(int(r.integers(20, 44)), mixed), chars(int(r.integers(44, 2500)), mixed))

    def look_alike() -> tuple[str, str, str]:
        kind = pick("mail", "number", "number", "ssn", "secret", "secret")
        if kind == "mail":
            return kind, f"{word()} ", f"{word()} (at) {word()}.{digits(1)}"
        if kind == "number":
            return kind, pick("order ", "isbn ", "invoice no ", "on ", "version ", "date ", "ref ", "$", f"{word()} ", f"{word()} "), pick(f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", digits(8), digits(int(r.integers(7, 18))), f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{digits(1)}.{digits(2)}.{digits(4)}", f"19{digits(2)} - 20{digits(2)}")
        if kind == "ssn":
            return kind, pick("order ", "ref ", "ticket "), f"{digits(3)}-{digits(2)}-{digits(4)}"
        if pick(True, False, False):
            return kind, cue(), pick(word() + word(), word() + "-" + word(), f"{word()}_{word()}", word().capitalize() + word(), "*" * int(r.integers(6, 12)), f"{word()}/{word()}/{word()}", f"20{digits(2)}-{digits(2)}-{digits(2)}")
        return kind, pick("commit ", "sha ", "checksum ", "md5: ", f"{word()} ", 'title = "', 'name: "', "build "), pick(chars(40, hexa), chars(32, hexa), "-".join(word() for _ in range(5)) + digits(1), word() + word() + word() + digits(2), digits(24))

    def phone() -> str:
        area = digits(2)
        return pick(
            f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"0{area} {digits(3)} {digits(4)}",
            f"0{area[0]} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"0{area[0]}.{digits(2)}.{digits(2)}.{digits(2)}.{digits(2)}", f"9{area} {digits(3)} {digits(3)}", f"6{area} {digits(2)} {digits(2)} {digits(2)}", f"0{digits(3)}/{digits(7)}", f"0{area} {digits(7)}",
        )

    def beside() -> tuple[str, list[tuple[int, int]]]:
        """Numbers in a row, or after a date, and where they are."""
        text, at = " ".join(word() for _ in range(3)) + " " + pick("", "call ", "phone: ", "tel. "), []
        if pick(True, False):
            text += pick(f"20{digits(2)}-{digits(2)}-{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}") + " "
        for _ in range(pick(1, 2, 2, 3)):
            s = phone()
            at.append((len(text), len(text) + len(s)))
            text += s + " "
        return text + word(), at

    rows, labels = [], []
    for i in range(n):
        if i % 8 > 5:
            text, at = beside()
            of = [(a, b) for a, b, kind in candidates(text, [m.span() for m in _DIGITS.finditer(text)]) if kind == "number" and ((a, b) in at) == bool(i % 2)]
            if of:
                rows.append((text, *pick(*of), "number"))
                labels.append(i % 2)
                continue
        kind, before, s = true_form() if i % 2 else look_alike()
        text = " ".join(word() for _ in range(3)) + " " + before
        a = len(text)
        rows.append((text + s + pick('"', "") * before.endswith('"') + " " + word(), a, a + len(s), kind))
        labels.append(i % 2)
    return rows, np.array(labels, float)


_model: list[tuple[Boosted, np.ndarray]] = []


def model() -> tuple[Boosted, np.ndarray]:
    """The trees and the threshold of each added kind; trained once in a driver."""
    if not _model:
        (rows, y), (held, held_y) = examples(TRAIN_ROWS, 1), examples(HELD_ROWS, 2)
        x, held_x = (np.array([describe(*r) for r in part]) for part in (rows, held))
        trees = Boosted().fit(x, y, held_x, held_y)
        chance, limits = trees.chance(held_x), []
        for k in range(len(ADDED)):
            own = held_x[:, 0] == k
            right = [c for c in np.unique(chance[own]) if held_y[own & (chance >= c)].mean() >= PRECISION]
            limits.append(min(right, default=2.0))
        _model.append((trees, np.array(limits)))
    return _model[0]


def find(text: str | None, trees: Boosted, limits: np.ndarray) -> tuple[list, list]:
    """The base spans and all spans of a text, each (start, end, kind) by start, then kind as listed."""
    if not text:
        return [], []
    runs = [m.span() for m in _DIGITS.finditer(text)]
    base = base_spans(text, runs)
    taken = bytearray(len(text))
    for a, b, _ in base:
        taken[a:b] = b"\1" * (b - a)
    proposed = [c for c in dict.fromkeys(candidates(text, runs)) if taken.find(1, c[0], c[1]) < 0] 
    added: list[tuple[int, int, str]] = []
    if proposed:
        chance = trees.chance(np.array([describe(text, *c) for c in proposed]))
        for i in sorted(range(len(proposed)), key=lambda i: (-chance[i], SPECIFIC.index(proposed[i][2]), proposed[i][0] - proposed[i][1], proposed[i])):
            a, b, kind = proposed[i]
            if chance[i] >= limits[ADDED.index(kind)] and taken.find(1, a, b) < 0:
                taken[a:b] = b"\1" * (b - a)
                added.append(proposed[i])
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _listed(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def _replaced(text: str | None, spans: list) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced as one."""
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + (text or "")[at:]


def report(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    trees, limits = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py(), trees, limits) for t in b.column(1)]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE]
            sums = pa.array([hashlib.sha256(_listed(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, sums, pa.array([_listed(s) for _, s in found], pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind; a null text stays null."""
    bounded_batches(docs.sparkSession)
    trees, limits = model()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(at)]
            new = pa.array([t if t is None else _replaced(t, find(t, trees, limits)[1]) for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
