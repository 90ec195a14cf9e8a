"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation finds how far each is to be trusted, and a classifier learns from what they say together.

Candidates are all spans that strict patterns find, and spans of looser ones: addresses with spelled-out signs, numbers with odd separators or a failed check. A candidate's code holds
its kind, its votes and two traits of its shape; there are at most MOST_CODES of them, and everything is learned from how often each occurs in all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import saved, small_batches, spread

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "shape", "gazetteer", "context", "border")
VOTES = "-0+"
#: Kinds, votes, digits (0 to 19), separators (none, plain, several, spelled out).
MOST_CODES = len(KINDS) * len(VOTES) ** len(LABELERS) * 20 * 4

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Looser forms. All repeats are bounded, so no text makes them slow.
SIGN = re.compile(r"(?: ?[\[({<] ?(?:at|@) ?[\])}>] ?| ?@ ?)", re.I)
SPELLED_SIGN = re.compile(f"{SIGN.pattern}| at ", re.I)
SPELLED = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| dot |\.)[A-Za-z0-9-]{1,63}){1,8}", re.I)
DEFANGED = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\{\.\}| ?[\[(]dot[\])] ?)[0-9]{1,3}){3}(?![0-9.])", re.I)
LOOSE_CARD = re.compile(r"(?<![0-9])[0-9](?:[ ._/-]{0,2}[0-9]){12,18}(?![0-9])")
LOOSE_PHONE = re.compile(r"(?<![0-9+])(?:\+|00 ?)?\(?[0-9](?:[ ()./-]{0,2}[0-9]){8,14}(?![0-9])")
SIGN_AT = re.compile(r"[@\[({<]")
#: Longest local part that is read before a spelled-out sign.
LONGEST_LOCAL = 64

#: Endings of hosts, countries' calling codes, first digits of cards by length.
ENDINGS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es it nl be ch at se no dk fi pl pt ie us ca au nz in jp cn br mx ar ru eu".split())
CALLING = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
ISSUERS = (("34", 15), ("37", 15), ("36", 14), ("4", 16), ("4", 19), ("51", 16), ("52", 16), ("53", 16), ("54", 16), ("55", 16), ("2", 16), ("35", 16), ("6011", 16), ("62", 16), ("65", 16))
#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": re.compile(r"\b(?:e-?mail|mail|correo|courriel|contact|write|from|to|cc)\W{0,3}$", re.I),
    "ip": re.compile(r"\b(?:ip|ipv4|address|host|server|client|from|login)\W{0,3}$", re.I),
    "card": re.compile(r"\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|debit|pan)\b[^0-9]{0,12}$", re.I),
    "phone": re.compile(r"\b(?:phone|tel|telefon|telephone|téléphone|teléfono|mobile|cell|call|fax|ring)\b[^0-9]{0,8}$", re.I),
}
AGAINST = re.compile(r"(?:\b(?:version|v|isbn|issn|doi|id|no|nr|ref|order|invoice|sku|key|token|hash|sha|build|release|rev|cc by[a-z-]*)\b\W{0,4}|[=#/\\$€£%\"])$", re.I)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def small_part(part: str) -> bool:
    """At most 255, whatever zeros lead and however long it is."""
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the strict address pattern: from each sign the local part is read backwards, so the time is linear."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def quads(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers joined by dots, leftmost first, and whether all are at most 255."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            yield at, at + size, all(map(small_part, four))
            at += size + 1


def strict(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end of the base spans; what fails its check is dropped, and nothing else is tried in its place."""
    found = [("email", a, b) for a, b in emails(text)]
    if not DIGIT.search(text):
        return found
    found += [("ip", a, b) for a, b, good in quads(text) if good]
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", *m.span()))
    return found


def loose(text: str) -> Iterator[tuple[str, int, int]]:
    """kind, start, end of what may be personal data but isn't of the strict form."""
    spelled = " dot " in text.lower()
    for sign in (SPELLED_SIGN if spelled else SIGN).finditer(text) if spelled or SIGN_AT.search(text) else ():
        start = sign.start()
        while start > 0 and sign.start() - start < LONGEST_LOCAL and text[start - 1] in LOCAL:
            start -= 1
        host = SPELLED.match(text, sign.end()) if start < sign.start() else None
        if host:
            yield "email", start, host.end()
    if not DIGIT.search(text):
        return
    for a, b, good in quads(text):
        if not good:
            yield "ip", a, b
    for kind, pattern in (("ip", DEFANGED), ("card", LOOSE_CARD), ("phone", LOOSE_PHONE)):
        for m in pattern.finditer(text):
            yield kind, *m.span()


def code_of(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """The candidate's kind, votes, digits and separators."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before, next_one = text[max(0, start - 24) : start], text[end : end + 1]
    words = re.findall(r"[A-Za-z0-9-]+", span)
    marks = set(re.findall(r"[^A-Za-z0-9]", span)) - set("_%")
    spelled = bool(re.search(r"[\[({<]|\b(?:at|dot)\b", span, re.I)) if kind in ("email", "ip") else False
    if kind == "email":
        shape = 2 <= len(words[-1]) <= 24 and words[-1].isalpha() and (base or spelled)
        known = words[-1].lower() in ENDINGS
        bad = not base and bool(re.search(r" at [^ ]*\.", span, re.I))
    elif kind == "ip":
        parts = re.findall(r"[0-9]+", span)
        shape = all(p == "0" or p[0] != "0" for p in parts)
        bad = not all(map(small_part, parts))
        known = not bad and parts[0].lstrip("0") not in ("", "127") and int(parts[0]) < 224
    elif kind == "card":
        groups = [len(g) for g in re.findall(r"[0-9]+", span)]
        shape = len(groups) == 1 or groups in ([4, 4, 4, 4], [4, 6, 5], [4, 6, 4], [4, 4, 4, 4, 3])
        bad = not luhn(digits)
        known = any(len(digits) == n and digits.startswith(p) for p, n in ISSUERS)
    else:
        bare = digits.removeprefix("00")
        groups = re.findall(r"[0-9]+", span)
        abroad = span[0] == "+" or digits[:2] == "00"
        local = [len(g) for g in groups] == [3, 3, 4]
        shape = (abroad and 10 <= len(bare) <= 13 and len(groups) >= 2) or local
        bad = not 10 <= len(digits) <= 15
        known = any(bare.startswith(c) for c in CALLING) if abroad else local and digits[0] not in "01" and digits[3] not in "01"
    votes = (
        "+" if base else "-" if bad else "0", "+" if shape else "-", "+" if known else "-" if kind in ("ip", "card") else "0",
        "+" if FOR[kind].search(before) else "-" if AGAINST.search(before) else "0",
        "-" if (before and (before[-1].isalnum() or before[-1] in "_@")) or (next_one and (next_one.isalnum() or next_one in "_@")) else "+",
    )
    style = "s" if spelled else "n" if not marks else "p" if len(marks) == 1 else "m"
    return f"{KINDS.index(kind)}{''.join(votes)}{min(19, len(digits)):02d}{style}"


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """start, kind's number, end, whether it is a base span, and code. Loose spans that meet a base span are left out."""
    if not text:
        return []
    base = strict(text)
    found = [(a, KINDS.index(k), b, True, code_of(text, k, a, b, True)) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in taken] or [0])
    furthest = np.maximum.accumulate([b for _, b in taken]) if taken else np.array([0])
    for kind, a, b in loose(text):
        k = int(np.searchsorted(starts, b)) - 1  # the last base span that starts before b
        if not taken or k < 0 or furthest[k] <= a:
            found.append((a, KINDS.index(kind), b, False, code_of(text, kind, a, b, False)))
    return sorted(set(found))


@dataclass
class Judges:
    """Of each kind: its share of true candidates, and the probability of each labeler's vote for true and for false ones; then the weights of the span classifier."""

    prior: np.ndarray
    votes: np.ndarray
    weights: np.ndarray

    def probability(self, codes: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(traits(codes) @ self.weights, -30, 30))) if codes else np.zeros(0)


def votes_of(codes: list[str]) -> np.ndarray:
    return np.array([[VOTES.index(v) for v in c[1 : 1 + len(LABELERS)]] for c in codes])


def traits(codes: list[str]) -> np.ndarray:
    """A row for each code: kind; votes, for and against, for all kinds and by kind; digits and separators by kind."""
    kinds, labels = len(KINDS), len(LABELERS)
    per = 1 + 2 * labels + 20 + 4
    out = np.zeros((len(codes), 2 * labels + kinds * per))
    for i, c in enumerate(codes):
        at = 2 * labels + per * int(c[0])
        out[i, at] = 1
        for j, v in enumerate(c[1 : 1 + labels]):
            if v != "0":
                k = 2 * j + (v == "+")
                out[i, k] = out[i, at + 1 + k] = 1
        out[i, at + 1 + 2 * labels + int(c[1 + labels : 3 + labels])] = 0.5
        out[i, at + 21 + 2 * labels + "npms".index(c[3 + labels])] = 0.5
    return out


def reliabilities(codes: list[str], times: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation over votes, kind by kind: prior[kind], votes[kind, class, labeler, vote] and the probability that each code is true.

    Begun at the majority of the votes. Every labeler is taken to be better than chance to the extent of a few made-up votes, which also keep probabilities off 0 and 1; base spans are true.
    """
    seen, kinds = votes_of(codes), np.array([int(c[0]) for c in codes])
    true = 1 / (1 + np.exp(-1.5 * (seen - 1).sum(axis=1)))
    fixed = seen[:, 0] == 2
    true = np.where(fixed, 0.999, true)
    prior, table = np.full(len(KINDS), 0.5), np.zeros((len(KINDS), 2, len(LABELERS), 3))
    made = np.array([[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]])  # votes against, none, for: of false and of true spans
    for _ in range(rounds):
        before = true.copy()
        for k in range(len(KINDS)):
            mine = kinds == k
            for cls in (0, 1):
                w = times[mine] * (true[mine] if cls else 1 - true[mine])
                for j in range(len(LABELERS)):
                    counts = np.bincount(seen[mine, j], w, 3) + made[cls]
                    table[k, cls, j] = counts / counts.sum()
            prior[k] = (times[mine] @ true[mine] + 1) / (times[mine].sum() + 2)
            both = [np.log(p) + sum(np.log(table[k, cls, j, seen[mine, j]]) for j in range(len(LABELERS))) for cls, p in ((0, 1 - prior[k]), (1, prior[k]))]
            true[mine] = 1 / (1 + np.exp(np.clip(both[0] - both[1], -30, 30)))
        true = np.where(fixed, 0.999, true)
        if np.abs(true - before).max(initial=0) < 1e-9:
            break
    return prior, table, true


def learn(codes: list[str], times: np.ndarray, l2: float = 0.05, rounds: int = 40) -> Judges:
    """The classifier: logistic regression of the labelers' joint opinion on a span's traits, by Newton steps. Each code weighs as the logarithm of how often it occurs.

    Three made-up spans of each kind are learned too, so that corpora without doubtful spans give a model: one that all labelers are for, one that all are against, and one that only fails its kind's check.
    """
    prior, table, true = reliabilities(codes, times) if codes else (np.full(len(KINDS), 0.5), np.full((len(KINDS), 2, len(LABELERS), 3), 1 / 3), np.zeros(0))
    ends = [f"{k}{v}{d}p" for k, d in enumerate(("00", "12", "16", "11")) for v in ("+++++", "-----", "-++0+")]
    x, y = traits([*codes, *ends]), np.concatenate([true, [1.0, 0.0, 0.0] * len(KINDS)])
    w = np.concatenate([np.log1p(times), np.full(len(ends), 6.0)]) if codes else np.full(len(ends), 6.0)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(b)), x.T @ (w * (y - p)) - l2 * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return Judges(prior, table, b)


FOUND = ArrayType(StructType([StructField("start", IntegerType()), StructField("kind", IntegerType()), StructField("stop", IntegerType()), StructField("base", BooleanType()), StructField("code", StringType())]))
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("stop", IntegerType()), StructField("base", BooleanType()), StructField("score", DoubleType())]))


def with_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, found: each document's candidates, in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("code", pa.string())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("start", "kind", "stop", "base", "code"), c)) for c in candidates(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "found"])

    return spread(rows).mapInArrow(find, StructType([rows.schema.fields[0], StructField("found", FOUND)]))


def chosen(found: list[dict], score: dict[str, float], least: float) -> list[dict]:
    """All base spans, and those others that score enough and meet none that is taken already: the surest first, then the longest, then the leftmost."""
    out = [{"kind": KINDS[c["kind"]], "start": c["start"], "stop": c["stop"], "base": c["base"], "score": 1.0 if c["base"] else score[c["code"]]} for c in found if c["base"] or score.get(c["code"], 0) >= least]
    taken: list[tuple[int, int]] = []  # disjoint, in order
    kept = [c for c in out if c["base"]]
    for c in sorted((c for c in out if not c["base"]), key=lambda c: (-c["score"], c["start"] - c["stop"], c["start"])):
        at = bisect_left(taken, (c["start"], c["stop"]))
        if (at == 0 or taken[at - 1][1] <= c["start"]) and (at == len(taken) or c["stop"] <= taken[at][0]):
            taken.insert(at, (c["start"], c["stop"]))
            kept.append(c)
    return sorted(kept, key=lambda c: (c["start"], KINDS.index(c["kind"]), c["stop"]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.6) -> DataFrame:
    """One row per input row: doc_id, spans(kind, start, stop, base, score) by start, then by KINDS; offsets are code points, stop exclusive.

    Base spans always stay; others are added from a score of `least`, where they meet no base span. Null and empty texts have no spans; repeated rows and equal or null ids are each a row;
    other columns are ignored. Counts of codes, at most MOST_CODES whatever the corpus, come to the driver.
    """
    small_batches(docs.sparkSession)
    found = saved(with_candidates(docs, id_col, text_col), "candidates")
    seen = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()
    codes, times = [r.code for r in seen], np.array([r.n for r in seen], float)
    score = dict(zip(codes, map(float, learn(codes, times).probability(codes))))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([chosen(f, score, least) for f in batch.column(1).to_pylist()], kind)], names=["doc_id", "spans"])

    return found.mapInArrow(judge, StructType([found.schema.fields[0], StructField("spans", SPANS)]))


def digests(spans: DataFrame) -> DataFrame:
    """doc_id, a count of base spans for each kind, base_sha256, spans as text: `kind:start:end`, joined by commas."""
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast(LongType()).alias(f"n_{k}")
    return spans.select("doc_id", *[count(k) for k in KINDS], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))
