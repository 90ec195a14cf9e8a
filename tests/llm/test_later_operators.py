"""Personal data, conversation repair and the Merkle manifest against plain Python."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from odd_rows import LONG, ROWS
from pyspark.sql import functions as F

from medialake.llm import conversation, merkle, personal, queries

SMALL = "/root/testdata/sf0.001"
H = lambda text: hashlib.sha256(text.encode()).hexdigest()

# --- personal data


def plain_base(text):
    """The base spans by the patterns as they are written."""
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], personal.KINDS.index(s[0])))


def test_base_spans_against_the_patterns(spark):
    rng = random.Random(11)
    parts = ["a@b.c", "x.y@h", "@", "a@b@c.d", ".", "..", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "00300.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (624) 555-2408", "+12", "+1 234 567 890 ()", " ", "  ", "-", "9", "12345", "é", "日本", "\n", "q@w.e-r.t_y", "+", "5500000000000004"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(4000)]
    for t in texts:
        assert sorted(personal.strict(t), key=lambda s: (s[1], personal.KINDS.index(s[0]))) == plain_base(t), t
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_personal_data(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        base = plain_base(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == b[0] for b in base) for k in personal.KINDS]
        assert r.base_sha256 == H(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(r.spans.split(","))


def test_votes_add_spans_and_leave_numbers_alone(spark):
    """Learned from plain cases only: spelled-out addresses and odd separators are found, versions, orders, dates and hexadecimal aren't."""
    clean = [f"order {i}12345678901 shipped, version 1.2.{i}.400, isbn 978-3-16-1484{i}0-0, on 2024-01-0{i} 10:20:30, token = \"ab{i}98855103314c\"" for i in range(10)]
    seen = [f"mail me at user{i}@host{i}.example.com or +1 (62{i}) 555-2408 from 10.20.{i}.40" for i in range(30)]
    added = {"write to jane.doe [at] example [dot] com": "jane.doe [at] example [dot] com", "call (624) 555-2408 now": "(624) 555-2408", "the ip 10[.]20[.]30[.]40 is": "10[.]20[.]30[.]40", "Visa 4111.1111.1111.1111 it": "4111.1111.1111.1111", "so +1 (569) 555-6633 4795326016703902 is": "+1 (569) 555-6633"}
    docs = spark.createDataFrame(list(enumerate([*clean, *seen, *added])), "doc_id int, text string")
    got = {r.doc_id: r.spans for r in personal.personal_data(docs).collect()}
    assert not any(got[i] for i in range(len(clean)))
    assert all([s.base for s in got[len(clean) + i]] == [True] * 3 for i in range(len(seen)))
    for i, (text, want) in enumerate(added.items()):
        spans = got[len(clean) + len(seen) + i]
        assert want in {text[s.start : s.stop] for s in spans} and not any(a.start < b.stop and b.start < a.stop for a, b in itertools.combinations([s for s in spans if not s.base], 2))


def test_reliabilities_are_found():
    """Votes drawn from known labelers: EM finds which is right how often, better labelers weigh more."""
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.4
    right = [0.95, 0.9, 0.6, 0.85]
    votes = np.stack([np.where(rng.random(4000) < p, truth, ~truth) for p in right], axis=1)
    codes = [f"30{''.join('-+'[int(v)] for v in row)}11p" for row in votes]
    unique = sorted(set(codes))
    times = np.array([codes.count(c) for c in unique], float)
    _, table, true = personal.reliabilities(unique, times)
    for j, p in enumerate(right):
        assert abs(table[3, 1, j + 1, 2] - p) < 0.05 and abs(table[3, 0, j + 1, 0] - p) < 0.05
    said = dict(zip(unique, true))
    assert np.mean([(said[c] > 0.5) == t for c, t in zip(codes, truth)]) > 0.96


def test_personal_data_of_odd_rows(odd, none):
    rows = personal.digests(personal.personal_data(odd)).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _, _ in ROWS), key=repr)
    assert {r.base_sha256 for r in rows if r.doc_id in (0, 1, None)} == {H("")}
    assert personal.personal_data(none).count() == 0
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "@" * 100_000, "+1" * 100_000, "1-" * 100_000, " at " * 50_000 + " dot ", "(" * 100_000, LONG):
        begun = time.process_time()
        personal.candidates(text)
        assert time.process_time() - begun < 8, text[:10]


# --- conversations


def cheapest(codes):
    """Every way of editing, by plain recursion over the output's roles."""
    best = {}

    def go(i, state, cost, audit):
        if len(audit) > 2 * len(codes) + 3 or cost > 4 * len(codes):
            return
        if i == len(codes) and state in (0, 3) and (cost, audit) < best.get("v", (10**9, "")):
            best["v"] = (cost, audit)
        if audit[-2:] != "II":
            go(i, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 3, audit + "I")
        if i < len(codes):
            initial, fault = conversation.MEANING[codes[i]]
            go(i + 1, state, cost + 4, audit + "D")
            if fault not in (1, 2):
                more = 3 * (fault == 3)
                go(i + 1, {0: 2, 1: 2, 2: 3, 3: 2}[state], cost + 3 + more, audit + "R")
                to = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}.get((initial, state))
                if to:
                    go(i + 1, to, cost + more, audit + "K")

    go(0, 0, 0, "")
    return best["v"]


def test_lightest_derivations_by_enumeration():
    rng = random.Random(2)
    words = ["".join(p) for n in range(3) for p in itertools.product(conversation.CODES, repeat=n)] + ["".join(rng.choices(conversation.CODES, k=rng.randrange(3, 6))) for _ in range(250)]
    for w in words:
        want = cheapest(w)
        assert all(conversation.lightest(w, segment) == want for segment in (1, 2, 512)), w
    long = "".join(rng.choices("AEIDHL", k=3000))
    assert conversation.lightest(long) == conversation.lightest(long, 7)


def plain_repair(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit, hash of one conversation's damaged rows, in order."""
    white, seen, faults = " \t\n\x0b\x0c\r", set(), []
    for _, role, text in rows:
        bare = text.rstrip(white)
        faults.append(1 if not text.strip(white) else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    letters = "".join(conversation.CODES[4 * ("sua".index(i) if i and i in "sua" else 3) + f] for i, f in zip(initials, faults))
    cost, audit = conversation.lightest(letters)
    turns = [t for t, _, _ in rows if t is not None]
    out, i, state = [], 0, 0
    for e in audit:
        if e in "IR":
            state = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            out.append(("user" if state == 2 else "assistant", "" if e == "I" else rows[i][2]))
        elif e == "K":
            state = {"s": 1, "u": 2, "a": 3}[initials[i]]
            out.append(rows[i][1:])
        i += e != "I"
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(k) for k in (1, 2, 3)], illegal, cost, audit, H("\n".join(f"{r}:{t}" for r, t in out)))


def damage(rows):
    blank = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        which = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = blank(role) if which != 4 else "user", blank(text)
        text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
        for _ in range((which != 0) + (which == 3)):
            yield conv, turn, role, text


def test_conversations_by_plain_python(spark, monkeypatch):
    """A third of all rows in the null conversation, over several segments and partitions; nulls in every column, ties, odd roles, conversations that lose all their rows."""
    monkeypatch.setattr(conversation, "SEGMENT", 64)
    rng = random.Random(9)
    said = lambda: rng.choice(["Yes.", "Yes.", "no", " \t\n", None, "what?", "why!", "a longer one without an end", "naïve 日本。", ""])
    rows = [(rng.choice([None, *range(60)]) if rng.random() < 0.6 else None, rng.choice([None, *range(30)]), rng.choice(["user", "assistant", "user", "assistant", "system", "", None, "tool", "agent"]), said()) for _ in range(900)]
    rows += [(None, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(100, 400)] + rows[:5]
    rows += [(c, t, "user", "Gone.") for c in range(1000, 1400) for t in (7,)]
    table = spark.createDataFrame([(c, t, r, x, "clash", "clash") for c, t, r, x in rows], "conv_id long, turn long, role string, text string, key string, audit string")
    fixed = conversation.repair(table, conversation.damaged(table))
    hashes = {r.conv_id: r.repaired_sha256 for r in conversation.joined_sha256(fixed.turns).collect()}
    got = {r.conv_id: (*r[1:], hashes.get(r.conv_id, H(""))) for r in fixed.report.collect()}
    by = {c: [] for c, _, _, _ in rows}
    for c, t, r, x in damage(rows):
        by[c].append((t, r, x))
    assert set(got) == set(by) and any(not v for v in by.values())
    for c, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        assert got[c] == plain_repair(turns), c
    empty = table.limit(0)
    fixed = conversation.repair(empty, conversation.damaged(empty))
    assert fixed.report.count() == 0 and fixed.turns.count() == 0


# --- manifest


def plain_manifest(rows, changed):
    """leaf, subroot, root, proof, folded root of each row (doc_id, source, lang, n_chars, text), by whole trees."""
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r: H("".join(map(field, r)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    def path(tree, at):
        for level in tree[:-1]:
            run = at - at % 3
            yield "".join(level[run:at]), "".join(level[at + 1 : run + 3])
            at //= 3

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[1], []).append(k)
    trees = {}
    for s, ks in groups.items():
        ks.sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, bytes.fromhex(leaf(rows[k])), changed[k] is not None, bytes.fromhex(leaf((*rows[k][:4], changed[k]))) if changed[k] is not None else b""))
        trees[s] = levels([leaf(rows[k]) for k in ks])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    for s, ks in groups.items():
        for at, k in enumerate(ks):
            up = [*path(trees[s], at), *path(top, order.index(s))]
            now = leaf((*rows[k][:4], changed[k])) if changed[k] is not None else leaf(rows[k])
            for before, after in up:
                now = H(before + now + after)
            yield rows[k][0], leaf(rows[k]), trees[s][-1][0], top[-1][0], H("".join(b + a for b, a in up)), now, now == top[-1][0]


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_by_whole_trees(spark, depth):
    """One source with most rows, null and empty ones, single rows, repeated rows, null ids; blocks of 3, 9 and 2187 leaves."""
    rng = random.Random(depth)
    rows = [(rng.choice([None, *range(40)]) if i % 4 == 0 else i, rng.choices(["hot", "b", None, "", "é", f"own{i}"], [60, 10, 5, 3, 5, 4])[0], rng.choice([None, "en"]), rng.choice([None, 7]), rng.choice([None, "", "a\nb", "\n", "plain", "日\n\n本"])) for i in range(150)]
    rows += rows[:6] + [(1000, "hot", "en", 3, "a\nb")] * 4
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, group string, digest string")
    changed = [None if i is None or zlib.crc32(str(i).encode()) % 2 or t is None else t.replace("\n", "") for i, _, _, _, t in rows]
    got = [tuple(r) for r in merkle.manifest(docs, merkle.without_line_ends(), depth=depth).collect()]
    assert sorted(got, key=repr) == sorted(plain_manifest(rows, changed), key=repr)
    assert {g[-1] for g in got} == {True, False}


def test_manifest_of_odd_rows(odd, none):
    rows = merkle.manifest(odd).collect()
    assert sorted((r.doc_id for r in rows), key=repr) == sorted((i for i, _, _ in ROWS), key=repr) and all(r.verified for r in rows)
    assert merkle.manifest(none).count() == 0
    one = merkle.manifest(odd.where("doc_id = 9"), F.lit("other")).first()
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == H("") and not one.verified


def test_versions_share_what_is_untouched():
    base = merkle.tree([H(str(i)) for i in range(27)], 3)
    new = merkle.version(base, merkle.turns(14, 3), H("x"))
    assert new[0] != base[0] and [a is b for a, b in zip(base[1], new[1])] == [True, False, True]
    assert [a is b for a, b in zip(base[1][1][1], new[1][1][1])] == [True, False, True]
    assert new == merkle.tree([H("x" if i == 14 else str(i)) for i in range(27)], 3)
