"""Personal data by weak supervision.

Fixed patterns give the base spans.  Beside them wide generators propose candidates (runs of digits that the base
drops, anything that reads like an address at a host, pairs of capitalised words), and five labelers vote on
base spans and candidates alike: the form of the span, a gazetteer, the neighbouring words, the structure of its
parts, and words that deny.  None repeats what a generator requires, so votes of one kind differ and conflict.
Expectation-maximisation over the counts of vote patterns estimates, kind by kind, how reliable each labeler is and how
likely each pattern is personal data; those probabilities train the final span classifier, a logistic
regression over kind, votes and shape of a span.

Texts are read once.  What leaves the scan is a row for each text with its spans and candidates; the driver only
gets counts by vote pattern and shape, whose number the table of codes bounds, whatever the size of the corpus.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, map_rows, table, texts, tune

KINDS = ("email", "ip", "card", "phone")
EXTRA = ("address", "number", "person")
EVERY = KINDS + EXTRA
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: No match begins within a run of digits, so starts are tried once a run, however long it is.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Wide generators: an address at a host, a run of digits with separators, two capitalised words.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(]?(?:@| at )[\])]? ?[A-Za-z0-9-]{1,64} ?[\[(]?(?: dot |\.)[\])]? ?[A-Za-z]{2,12}\b")
DIGITS = re.compile(r"[0-9 ().-]{7,}")
CAPITALS = re.compile(r"\b[A-Z][a-z]+[ \t][A-Z][a-z]+\b")
#: Gazetteers (given names, honorifics, top-level domains, country codes, role mailboxes), cue words and words that deny.
GIVEN = frozenset(
    "james mary john anna peter maria paul linda robert susan michael laura david karen thomas emma daniel julia mark sofia hans greta jürgen ingrid pierre marie jean claire carlos lucia miguel elena "
    "ahmed fatima omar aisha wei li ming yuki kenji priya raj anita ivan olga dmitri natasha kofi ama william elizabeth richard barbara joseph jessica charles sarah".split()
)
HONORIFIC = frozenset("mr mrs ms dr prof sir herr frau señor señora madame monsieur".split())
COUNTRY = frozenset("com org net edu gov io de fr es uk eu info us ca au jp cn in br it nl ch at se".split())
DIALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 52 54 55 61 62 64 65 81 82 86 90 91 351 353 358 420 971 972".split())
ROLES = frozenset("info admin support sales contact noreply no-reply postmaster webmaster root test example".split())
SMALL = frozenset("a an the of and or in on at to for is it as by be was with from that this der die das und les des une que los las el la del de en un est por".split())
CUES = frozenset("call phone tel telephone mobile fax contact mail email e-mail address card account ssn visa mastercard name named write by from ip host server client regards dear signed".split())
DENIALS = frozenset("version isbn issn order invoice page figure table section chapter law act number no build release id ref sku hash token serial example sample".split())
SPEECH = frozenset("said says wrote told born died lives asked replied".split())
LABELERS = 5
SHAPES = 48
#: How often labelers are taken to be right, before their votes are compared.
TRUST = 0.8
DIGIT = re.compile("[0-9]")
_TOKEN = re.compile(r"[\w-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def valid(kind: str, text: str) -> bool:
    if kind == "ip":
        return all(int(x[-20:]) <= 255 and (len(x) <= 20 or not x[:-20].strip("0")) for x in text.split("."))
    if kind == "card":
        d = only_digits(text)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(only_digits(text)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """The leftmost non-overlapping matches of EMAIL, sought from each @ on, so that long runs without one cost nothing."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def matches(text: str) -> list[tuple[str, int, int, bool]]:
    """All leftmost non-overlapping matches by kind, with whether each passes."""
    out = []
    if "@" in text:
        out += [("email", a, z, True) for a, z in emails(text)]
    if DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
            if kind != "phone" or "+" in text:
                out += [(kind, m.start(), m.end(), valid(kind, m[0])) for m in pattern.finditer(text)]
    return out


def candidates(text: str, base: list[tuple[str, int, int, bool]]) -> list[tuple[int, int, int]]:
    """(code, start, end) of the base spans and of what the base doesn't report; a code packs kind, votes and shape, see coded()."""
    spans = [(k, a, z) for k, a, z, ok in base if ok]
    held = sorted((a, z) for _, a, z in spans)
    starts = [a for a, _ in held]
    reach = list(itertools.accumulate((z for _, z in held), max))  # the furthest end of the spans up to each
    found = []
    if "@" in text or " at " in text:
        found += [("address", m.start(), m.end()) for m in SPELLED.finditer(text)]
    if DIGIT.search(text):
        for m in DIGITS.finditer(text):
            a, z = m.start(), m.end()
            while a < z and not ("0" <= text[a] <= "9" or (text[a] == "(" and "0" <= text[a + 1 : a + 2] <= "9")):
                a += 1
            while z > a and not "0" <= text[z - 1] <= "9":
                z -= 1
            if 7 <= len(only_digits(text[a:z])) <= 19:
                found.append(("number", a, z))
    found += [("person", m.start(), m.end()) for m in CAPITALS.finditer(text)]
    out, last = [(coded(k, text, a, z), a, z) for k, a, z in spans], -1
    for kind, a, z in sorted(found, key=lambda x: (x[1], -x[2])):
        before = bisect.bisect_left(starts, z)
        if a >= last and not (before and reach[before - 1] > a):
            out.append((coded(kind, text, a, z), a, z))
            last = z
    return out


def _vote(yes: bool, no: bool) -> int:
    return 2 if yes and not no else 1 if no else 0


def ballots(kind: str, text: str, a: int, z: int) -> list[int]:
    """Votes of the labelers (0 abstains, 1 no, 2 yes): form, gazetteer, neighbours, structure, denial."""
    span = text[a:z]
    d = only_digits(span)
    before = [w.lower() for w in _TOKEN.findall(text[max(0, a - 40) : a])[-3:]]
    after = [w.lower() for w in _TOKEN.findall(text[z : z + 24])[:2]]
    cue = bool(CUES & {*before, *after[:1]})
    deny = bool(DENIALS & set(before))
    if kind in ("email", "address"):
        local, host = re.split(r"@| at ", span, maxsplit=1)
        parts = [x for x in re.split(r"[ .\[\]()]+|\bdot\b", host) if x]
        local = local.strip(" [(").lower()
        end = parts[-1].lower() if parts else ""
        spelled = kind == "address" and bool(re.search(r"[\[(]|\bdot\b", span))
        form = _vote(kind == "email" or spelled, kind == "address" and bool(re.search(r"\. ", span)))
        gazetteer = _vote(end in COUNTRY, end not in COUNTRY and (len(end) > 4 or end in SMALL))
        structure = _vote(bool(re.search(r"[0-9._+-]", local)) or local in GIVEN, local in SMALL or local in ROLES)
        deny = deny or "example" in parts or local in SMALL
    elif kind == "ip":
        parts = [int(x[-3:]) for x in span.split(".")]
        form = _vote(all(x == str(int(x[-3:])) for x in span.split(".")), max(parts) < 10)
        gazetteer = _vote(False, parts[0] in (0, 10, 127) or parts[0] >= 224 or parts[:2] in ([192, 168], [169, 254]))
        structure = _vote(min(parts[1:]) > 9, 0 in parts[1:3])
        deny = deny or text[max(0, a - 1) : a].lower() == "v"
    elif kind in ("card", "phone", "number"):
        groups = [len(x) for x in re.findall("[0-9]+", span)]
        issuer = d[0] in "45" or d[:2] in ("34", "37", "65") or d[:4] == "6011"
        telephone = groups in ([3, 3, 4], [1, 3, 3, 4], [2, 3, 3, 4]) or (kind == "phone" and len(groups) > 2)
        form = _vote(telephone or groups in ([3, 2, 4], [4, 4, 4, 4], [4, 6, 5]), kind == "number" and (len(groups) > 6 or (len(groups) > 1 and max(groups) > 10)))
        if kind == "phone":
            gazetteer = _vote(any(d.startswith(c) for c in DIALLING), d.startswith("0"))
        else:
            gazetteer = _vote(13 <= len(d) <= 19 and issuer, (13 <= len(d) <= 19 and not issuer) or d[:3] in ("000", "666"))
        structure = _vote(13 <= len(d) <= 19 and luhn(d), len(set(d)) <= 2 or (kind == "number" and 13 <= len(d) <= 19 and not luhn(d)))
        touching = (text[a - 1 : a] + text[z : z + 1]).strip()
        deny = deny or any(c.isalnum() or c in "\"'_=" for c in touching)
    else:
        first, second = span.lower().split()
        form = _vote(first != second and min(len(first), len(second)) > 2, first == second or len(second) < 2)
        gazetteer = _vote(first in GIVEN, first in SMALL or second in SMALL)
        structure = _vote(False, a == 0 or text[max(0, a - 2) : a].strip()[-1:] in (".", "!", "?", ""))
        cue = cue or bool(before and before[-1] in HONORIFIC) or bool(SPEECH & set(after))
    return [form, gazetteer, 2 if cue else 0, structure, 1 if deny else 0]


def coded(kind: str, text: str, a: int, z: int) -> int:
    """Kind, votes and shape of a span as one number under len(EVERY) * 3**LABELERS * SHAPES."""
    n = sum("0" <= c <= "9" for c in text[a:z])
    follows = text[z : z + 24].lstrip()[:1]
    votes = sum(v * 3**i for i, v in enumerate(ballots(kind, text, a, z)))
    shape = min(3, n // 4) + 4 * min(2, (z - a) // 12) + 12 * follows.isupper() + 24 * (a == 0 or text[a - 1] in "\n(<[\"'")
    return (EVERY.index(kind) * 3**LABELERS + votes) * SHAPES + shape


def decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes as a matrix, features as a matrix): votes mean other things for other kinds, so each kind has its own columns."""
    shape, rest = code % SHAPES, code // SHAPES
    votes, kind = rest % 3**LABELERS, rest // 3**LABELERS
    v = np.stack([votes // 3**i % 3 for i in range(LABELERS)], axis=1)
    columns = [(kind == k) & c for k in range(len(EVERY)) for c in [kind == k, *(v[:, i] == j for i in range(LABELERS) for j in (1, 2))]]
    columns += [shape % 4 == i for i in range(4)] + [shape // 4 % 3 == i for i in range(3)] + [shape // 12 % 2 == 1, shape // 24 == 1]
    return kind, v, np.stack(columns, axis=1).astype(float)


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for two classes: P(personal | votes), P(vote | class) by labeler, P(personal).

    An abstention says nothing.  Labelers are taken to be right TRUST of the time beforehand.  That counts little for one that
    votes both ways, as much as its votes for one that only ever denies or affirms: such a labeler can't be
    told from the others' agreement, and would lose all weight.
    """
    yes, cast = (votes == 2).sum(1), (votes > 0).sum(1)
    post = (yes + 0.5) / (cast + 1.0)
    theta, prior = np.ones((2, votes.shape[1], 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([n * (1 - post), n * post])
        prior = float((weight[1].sum() + 1) / (n.sum() + 2))
        for i in range(votes.shape[1]):
            one_way = not ((votes[:, i] == 1).any() and (votes[:, i] == 2).any())
            trusted = 2 + (n[votes[:, i] > 0].sum() if one_way else 0)
            for c in range(2):
                count = np.array([weight[c][votes[:, i] == j].sum() for j in (1, 2)]) + trusted * np.array([1 - TRUST, TRUST] if c else [TRUST, 1 - TRUST])
                theta[c, i, 1:] = count / count.sum()
        balance = (2 * prior + 0.5) / 3
        log = np.log([[1 - balance], [balance]]) + np.stack([sum(np.log(theta[c, i, votes[:, i]]) for i in range(votes.shape[1])) for c in range(2)])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return post, theta, prior


def train(codes: np.ndarray, n: np.ndarray, rounds: int = 400) -> dict[int, float]:
    """The probability that a span of each code is personal data, from the final classifier."""
    if not len(codes):
        return {}
    kind, votes, x = decode(codes)
    target = np.zeros(len(codes))
    for k in range(len(EVERY)):
        own = kind == k
        if own.any():
            target[own] = reliabilities(votes[own], n[own].astype(float))[0]
    share = n / n.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = share * (p - target)
        w -= 2.0 * (x.T @ g + 1e-4 * w)
        b -= 2.0 * g.sum()
    p = 1 / (1 + np.exp(-(x @ w + b)))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts and digest, the joined base spans, and the coded base spans and candidates of each text."""

    def run(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found")}
        for t in texts(part.column(1)):
            every = matches(t)
            base = [(k, a, z) for k, a, z, ok in every if ok]
            for k in KINDS:
                out[f"n_{k}"].append(sum(x[0] == k for x in base))
            out["base"].append(_joined(base))
            out["base_sha256"].append(hashlib.sha256(out["base"][-1].encode()).hexdigest())
            out["found"].append([{"code": c, "start": a, "stop": z} for c, a, z in candidates(t, every)])
        return out

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, ["doc_id", "text"], run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, found array<struct<code:int,start:int,stop:int>>")


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_extra and n_doubtful, a row for each of docs.

    spans has the base spans (kind:start:end in code points, by kind and start) and then the candidates whose
    probability reaches the threshold; n_doubtful counts the base spans whose probability doesn't, which stay.  Null texts are empty and
    have no spans.  Without candidates nothing is trained.  Repeated rows give repeated rows, a null id stays null, other columns are left out.
    """
    rows = durable(extract(docs, id_col, text_col))
    per = 3**LABELERS * SHAPES
    counts = rows.select(F.explode("found.code").alias("code")).groupBy("code").count().collect()  # at most len(EVERY) * per codes
    model = train(np.array([r["code"] for r in counts], np.int64), np.array([r["count"] for r in counts], np.int64))
    accepted = {c: EVERY[c // per] for c, p in model.items() if p >= threshold}

    def run(part: pa.RecordBatch) -> dict:
        base, found = part.column("base").to_pylist(), part.column("found").to_pylist()
        extra = [sorted(((accepted[x["code"]], x["start"], x["stop"]) for x in f if x["code"] in accepted and accepted[x["code"]] in EXTRA), key=lambda s: (EXTRA.index(s[0]), s[1])) for f in found]
        keep = {k: part.column(k) for k in ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")}
        doubtful = [sum(x["code"] // per < len(KINDS) and x["code"] not in accepted for x in f) for f in found]
        return keep | {"spans": [",".join(x for x in (b, _joined(e)) if x) for b, e in zip(base, extra, strict=True)], "n_extra": [len(e) for e in extra], "n_doubtful": doubtful}

    return map_rows(rows, rows.columns, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_extra long, n_doubtful long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    return detect(table(spark, sf_dir, "documents"))
