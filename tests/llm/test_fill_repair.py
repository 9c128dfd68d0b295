"""Operators 11 and 12 against plain versions."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from quartermill.llm import fill_middle as fm
from quartermill.llm import repair
from quartermill.llm._common import table


DATA = "/root/testdata/sf0.01"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# ---- 11


def plain_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return len(units), "plain", None, None, sha(text), sha(text)
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), sha(out), sha(text)


def test_fill_rows(spark, odd, empty):
    made = fm.fill_in_middle(odd).collect()
    rows = {}
    for r in odd.collect():
        rows.setdefault(r["doc_id"], []).append(plain_fill(r["doc_id"], r["text"]))
    got = {}
    for r in made:
        got.setdefault(r["doc_id"], []).append((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], sha(r["output"]), sha(r["restored"])))
    key = lambda rows: sorted(rows, key=str)
    assert {k: key(v) for k, v in got.items()} == {k: key(v) for k, v in rows.items()}
    assert fm.fill_in_middle(empty).count() == 0
    assert fm.fill_in_middle(odd.withColumnRenamed("words", "output").withColumnRenamed("fp", "N")).count() == odd.count()


def test_fill_ranks():
    rng = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rng.integers(0, 8, n).astype(np.uint8)
        matrix = fm.WaveletMatrix(symbols)
        for _ in range(50):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            for symbol in range(8):
                assert matrix.rank(symbol, b, a) == (symbols[a:b] == symbol).sum()
                assert matrix.rank_below(symbol, b, a) == (symbols[a:b] < symbol).sum()


@pytest.mark.parametrize("text", ["<<S<P", "a<P><S", "é1b\n\nBc  <", "x" * 300, "\U0001f600a\U0001f600", "<M", "P><S>"])
def test_fill_back(text):
    for doc_id in range(200):
        n, form, a, b, out = fm.transformed(text, doc_id, 1, 90, 20)
        assert fm.restored(out, form) == text
        assert (n, form, a, b, sha(out), sha(text)) == plain_fill(doc_id, text)


def test_fill_long(spark):
    text = "ab1 é" * 700_000
    r = fm.fill_in_middle(spark.createDataFrame([(k, text) for k in range(3)], "doc_id long, text string")).collect()
    for x in r:
        assert (x["n"], x["form"], x["prefix_chars"], x["middle_chars"], sha(x["output"]), sha(x["restored"])) == plain_fill(x["doc_id"], text)


# ---- 12


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """One conversation's ordered (turn, role, text): the cheapest edits by trying all, letters compared as text."""
    faults, seen = [], set()
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    role_of = {"u": "user", "a": "assistant"}

    @lru_cache(maxsize=None)
    def best(i, state, inserted):
        options = []
        if i == len(rows):
            if state in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            cost, edits, made = best(i + 1, state, 0)
            options.append((3 + cost, "D" + edits, made))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for initial in "sua":
                    to = moves.get((state, initial))
                    if to and role[:1] == initial:
                        cost, edits, made = best(i + 1, to, 0)
                        options.append((extra + cost, "K" + edits, (f"{role}:{text}", *made)))
                    if to and initial != "s":
                        cost, edits, made = best(i + 1, to, 0)
                        options.append((2 + extra + cost, "R" + edits, (f"{role_of[initial]}:{text}", *made)))
        if inserted < 3:
            for initial in "ua":
                to = moves.get((state, initial))
                if to:
                    cost, edits, made = best(i, to, inserted + 1)
                    options.append((2 + cost, "I" + edits, (f"{role_of[initial]}:", *made)))
        return min(options, default=(10**9, "~", ()))

    cost, audit, made = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(made)))


def plain_conversations(rows, damage=True):
    kept = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in kept if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        out[conv] = plain_repair(own)
    return out


def result_of(df):
    rows = df.collect()
    assert len(rows) == len({r["conv_id"] for r in rows})
    return {r["conv_id"]: tuple(r)[1:] for r in rows}


def test_repair_whole_table(spark):
    rows = [tuple(r) for r in table(spark, DATA, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result_of(repair.op12(spark, DATA)) == plain_conversations(rows)


WIDE = "conv_id long, turn int, role string, text string, at long, kind int, copies int"


def random_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = ["a.", "b!", "c", "", " \t", None, "d? ", "e.\n"]
    return [(rng.choice([*range(convs), None]), rng.choice([*range(9), None]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(texts), 1, 2, 3) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_random(spark, seed):
    rows = random_rows(seed, 260, 40)
    df = spark.createDataFrame(rows, WIDE)
    assert result_of(repair.repaired(repair.damaged(df))) == plain_conversations([r[:4] for r in rows])
    assert result_of(repair.repaired(repair.undamaged(df))) == plain_conversations([r[:4] for r in rows], damage=False)


def test_repair_long_conversation(spark):
    """One conversation of many blocks and parts, and the plain version over it without recursion: costs, then letters."""
    rng = random.Random(9)
    n = 6000
    rows = [(7, k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["x.", f"y{k}.", f"z{k}", "", f"w{k}?"])) for k in range(n)] + [(8, 1, "user", "q."), (6, 1, "user", "q.")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = result_of(repair.repaired(repair.damaged(df)))
    own = sorted((r[1:] for r in plain_damage(rows) if r[0] == 7), key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
    # the same choice in one piece: all vectors, one walk
    faults, seen = [], set()
    for _, role, text in own:
        words = text.strip()
        faults.append(1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0)
        seen.add((role, text))
    codes = bytes(4 * "?sua".index(role[0]) + f for (_, role, _), f in zip(own, faults))
    inside = repair.vectors(codes, repair.FINAL)
    state, audit = repair.walk(codes, inside, 0)
    audit += repair.closing(state)[1]
    assert got[7][4:7] == (got[7][4], inside[0][0], audit)
    assert got[7][1:4] == tuple(faults.count(k) for k in (1, 2, 3))
    assert got[7][4] == sum((a[1][0] + b[1][0]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
    assert got[8] == plain_conversations(rows[-2:-1])[8] and got[6] == plain_conversations(rows[-1:])[6]
    made, at, state = [], 0, ""
    for edit in audit:  # the repaired rows by the audit alone
        if edit == "I":
            state = "a" if state == "u" else "u"
            made.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = own[at]
        at += 1
        if edit == "K":
            state = role[0]
            made.append(f"{role}:{text}")
        elif edit == "R":
            state = "a" if state == "u" else "u"
            made.append({"u": "user:", "a": "assistant:"}[state] + text)
    assert re.fullmatch("(s?(ua)+)?", "".join(m[0] for m in made))
    assert got[7][7] == sha("\n".join(made))


def test_repair_empty(spark):
    none = spark.createDataFrame([], WIDE)
    assert repair.repaired(repair.damaged(none)).count() == 0
