"""Operator 13 against all pairs."""

import random
import re

import numpy as np
import pytest

from quartermill.llm import jaccard_join as jj
from quartermill.llm._common import table

DATA = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    """(doc_id, n, component) of rows (doc_id, text): every pair of sets that shares a shingle is compared."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    by = {}
    for i, own in enumerate(sets):
        for s in own:
            by.setdefault(s, []).append(i)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in by[s] if j < i}:
            both = len(own & sets[j])
            if root(i) != root(j) and 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_join_whole_table(spark):
    rows = [tuple(r) for r in table(spark, DATA, "documents").select("doc_id", "text").collect()]
    got = of(jj.op13(spark, DATA))
    assert got == plain_components(rows)
    assert len({c for _, _, c in got}) < len(got) - 20


def test_join_rows(spark, odd, empty):
    assert of(jj.jaccard_components(odd)) == plain_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert jj.jaccard_components(empty).count() == 0


def near_copies(seed, groups, passages):
    """Groups of edited copies from 2 to 150, and passages quoted in many texts."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    prose = lambda n: [rng.choice(words) for _ in range(n)]
    quoted = [prose(60) for _ in range(passages)]
    texts = []
    for size in groups:
        base = prose(rng.choice([6, 12, 30, 80, 300]))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[rng.choice(words)], [], [own[at], rng.choice(words)]])
            texts.append(own)
    for k in range(150):
        texts.append(prose(rng.randint(3, 60)) + quoted[k % passages] + prose(rng.randint(0, 200)))
    for k in range(60):  # nothing but quotes, in turns
        texts.append(quoted[k % passages] + quoted[(k * 7 + 1) % passages] + prose(k % 4))
    rng.shuffle(texts)
    return [(k * 3, " ".join(t)) for k, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_join_groups(spark, seed):
    rows = near_copies(seed, [2, 3, 5, 20, 26, 60, 150], 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert of(jj.jaccard_components(df)) == plain_components(rows)


def test_prefixes_meet():
    """Similar sets share a single token or a pair of frequent ones in their prefixes, whatever is frequent."""
    rng = np.random.default_rng(4)
    met = 0
    for trial in range(3000):
        n = int(rng.integers(4, 200))
        base = rng.integers(0, 1 << 63, n + n // 2, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(trial % 2)
        a = np.unique(base[: n - int(rng.integers(0, n // 8 + 1))])
        b = np.unique(base[int(rng.integers(0, n // 8 + 1)) : n + int(rng.integers(0, n // 8 + 1))])
        both = len(np.intersect1d(a, b))
        if len(b) < 4 or len(a) < 4 or 100 * both < 80 * (len(a) + len(b) - both):
            continue
        frequent = base[rng.random(len(base)) < rng.choice([0, 0.3, 0.7, 0.9, 1])]
        (s, p), (t, q) = (jj.combined(x, frequent, len(x), 80) for x in (a, b))
        assert len(np.intersect1d(s, t)) or len(np.intersect1d(p, q))
        met += not len(np.intersect1d(s, t))
    assert met > 50


def test_sketches_lose_no_similar_pair():
    """Pairs at and above the bound always pass, of one size class or two; most unlike ones don't."""
    rng, passed, unlike = np.random.default_rng(5), 0, 0
    for _ in range(3000):
        n = int(rng.integers(1, 700))
        u = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        kept = u[rng.random(len(u)) < rng.choice([0.5, 0.8, 0.9, 1.0])]
        v = np.unique(np.concatenate([kept, rng.integers(0, 1 << 64, int(rng.integers(0, n // 4 + 1)), np.uint64)]))
        both = len(np.intersect1d(u, v))
        found = jj.perhaps_similar(jj.sketch(u), jj.sketch(v), 80)
        if 100 * both >= 80 * (len(u) + len(v) - both):
            assert found
        elif 100 * both < 60 * (len(u) + len(v) - both) and n >= 50:
            unlike, passed = unlike + 1, passed + found
    assert unlike > 500 and passed < unlike / 50
    assert jj.perhaps_similar(jj.sketch(u[:0]), jj.sketch(u[:0]), 80)


def test_marks_tell_row_numbers_apart(spark):
    """No member is lost, and few others pass: numbers of rows differ in their high digits alone."""
    from pyspark.sql import functions as F

    rows = spark.range(4000, numPartitions=8).select(F.monotonically_increasing_id().alias("node"))
    members = rows.where(F.shiftright("node", 33) < 2)
    passed = {r[0] for r in jj.possibly(rows, "node", members).collect()}
    assert passed >= {r[0] for r in members.collect()} and len(passed) < 1010
    assert jj.possibly(rows, "node", members.limit(0)).count() == 0


def test_heads_without_copies_stay(spark, tmp_path):
    """Sets with copies and without give one row each, with the least doc_id and the head that all of them have."""
    rows = [(k, " ".join(f"w{(k % 50) * 40 + j if k < 60 else k * 40 + j}" for j in range(30))) for k in range(400)] + [(None, ""), (None, "w0 x"), (7, None)]
    headed = spark.createDataFrame(rows, "doc_id long, text string")
    headed = jj.set_rows(headed, 5, 80)
    got = {bytes(r["digest"]): r for r in jj.distinct_sets(headed, jj.Scratch(spark, "test")).collect()}
    sets = {}
    for r in headed.where("n > 0").collect():
        sets.setdefault(bytes(r["digest"]), []).append(r)
    assert got.keys() == sets.keys() and len(got) == 391
    for digest, own in sets.items():
        r, least = got[digest], min(own, key=lambda x: -1 if x["doc_id"] is None else x["doc_id"])
        assert (r["least"], r["n"], r["head"]) == (least["doc_id"], own[0]["n"], own[0]["head"])
        assert r["first"]["text_hash"] in {x["text_hash"] for x in own if x["doc_id"] == r["first"]["doc_id"]}
