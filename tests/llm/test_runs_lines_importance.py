"""Runs of repeated words, repeated lines and importance resampling against brute force, and their defined cases."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scholia.llm import common, importance, linededup, tandem

DOCS = "doc_id long, text string, n long, h1 long, d1 long, place int, start long, rank long, weight long, score long, digest string, dropped string"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7, 8, "x", "y") for i, t in rows], DOCS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# runs


def brute_runs(words, min_length=12):
    """All maximal stretches, each with the smallest of its periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j + q), q)
            i = max(i + 1, j)
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= min_length)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=70), st.integers(1, 9), st.integers(0, 69))
def test_runs_equal_brute_force(words, p, a):
    periodic = [w if i < a or a + (i - a) % p >= len(words) else words[a + (i - a) % p] for i, w in enumerate(words)]
    for w in (words, periodic):
        assert list(zip(*(x.tolist() for x in tandem.find_in(np.array(w))), strict=True)) == brute_runs(w, 2)


def test_suffixes_sorted_and_extended():
    rng = random.Random(3)
    w = [rng.randint(1, 2) for _ in range(300)]
    s = tandem.Suffixes(np.array(w))
    assert s.sorted.tolist() == sorted(range(300), key=lambda i: w[i:])
    for _ in range(200):
        i, j = rng.sample(range(300), 2)
        k = next((k for k in range(300 - max(i, j)) if w[i + k] != w[j + k]), 300 - max(i, j))
        assert s.ahead(np.array([i]), np.array([j]))[0] == k
        k = next((k for k in range(min(i, j) + 1) if w[i - k] != w[j - k]), min(i, j) + 1)
        assert s.behind(np.array([i]), np.array([j]))[0] == k


def test_blocks_are_longest_earlier_stretches():
    rng = random.Random(4)
    for _ in range(50):
        w = [rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        cuts, at = [0], 0
        while at < len(w):
            k = 0
            while at + k < len(w) and any(w[j : j + k + 1] == w[at : at + k + 1] for j in range(at)):
                k += 1
            at += max(1, k)
            cuts.append(at)
        assert tandem.Suffixes(np.array(w)).blocks().tolist() == cuts


@pytest.mark.parametrize("words", [[1] * 100_000, [1, 2] * 50_000, [int(c) for c in bin(0x9E3779B97F4A7C15)[2:]] * 1500])
def test_hostile_runs_take_little_time(words):
    begin = time.perf_counter()
    start, length, period = tandem.find_in(np.array(words))
    assert (start[0], length.max()) == (0, len(words)) and time.perf_counter() - begin < 20


def expected_runs(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(((-m, s, q) for s, m, q in runs), default=None)
    head = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    return (doc_id, len(runs), *head, sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_op11_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for i in range(160):
        unit = [rng.choice("Ab ab ß 日本 x,y".split()) for _ in range(rng.randint(1, 12))]
        words = [rng.choice("ab cd ef gh ij kl".split()) for _ in range(rng.randint(0, 60))] + unit * rng.randint(0, 6) + [str(rng.random()) for _ in range(rng.randint(0, 20))]
        rows.append((i, rng.choice([" ", "\n", " \x0b\t", "  "]).join(words)))
    rows += [(901, None), (902, ""), (903, " \n\t "), (904, "a " * 12), (904, "a " * 12), (905, "a " * 11), (906, "a a " * 13)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) >= 10
    got = tandem.digest(tandem.find_runs(tandem.plant_runs(frame(spark, rows))))
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected_runs(*r) for r in rows), key=str)


def test_runs_odd_tables(spark):
    got = {r["doc_id"]: r for r in tandem.find_runs(frame(spark, [(None, "b c " * 6), (2, "b c " * 5), (3, None)])).collect()}
    assert [tuple(x) for x in got[None]["runs"]] == [(0, 12, 2)] and got[None]["collapsed"] == "b c"
    assert (got[2]["runs"], got[3]["runs"], got[3]["collapsed"], got[3]["n_words"]) == ([], [], "", 0)
    assert tandem.digest(tandem.find_runs(tandem.plant_runs(frame(spark, [])))).count() == 0
    found = tandem.digest(tandem.find_runs(tandem.plant_runs(frame(spark, [(None, None), (None, "a")])))).collect()
    assert [r["n_runs"] for r in found] == [0, 0]


def test_very_long_text(spark):
    rng = random.Random(1)
    once = [f"w{rng.randint(0, 5000)}" for _ in range(40_000)]
    (row,) = tandem.find_runs(frame(spark, [(1, " ".join(once * 5))])).collect()
    assert max((r["length"], r["period"]) for r in row["runs"]) == (200_000, 40_000) and row["n_words"] == 200_000
    assert len(row["collapsed"].split()) <= 40_000


# lines


def expected_lines(rows, min_docs=10, min_chars=1):
    blank = " \t\n\x0b\f\r"
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x).strip(blank)
    count = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or count[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return sorted(out, key=str)


def line_rows(n, seed=2):
    rng = random.Random(seed)
    pool = [f"Line {k} Ünïcode" if k % 3 else f"Plain {k}" for k in range(60)] + ["", "  ", " ", "ALL Rights reserved", "😀"]
    rows = []
    for i in range(n):
        lines = [rng.choice(["", " ", "\t", "\x0b"]) + rng.choice([str.upper, str.lower, str])(rng.choice(pool[: rng.choice([5, 65])])) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(0, 9))]
        rows.append((i, "\n".join([*lines, f"only {i}"][: rng.randint(0, 10)])))
    return [*rows, (901, None), (902, ""), (903, "\n\n"), (904, "Plain 3\nPlain 3"), (904, "Plain 3\nPlain 3"), (None, "x\nAll rights reserved\n")]


@pytest.mark.parametrize(("batches", "fanout", "keys"), [(1, 2, 10**6), (4, 3, 10**6), (5, 2, 0), (9, 2, 10**6)])
def test_op12_equals_brute_force(spark, batches, fanout, keys, monkeypatch):
    rows = line_rows(150)
    monkeypatch.setattr(linededup, "HOT_KEYS", 3)
    whole = linededup.drop_lines
    monkeypatch.setattr(linededup, "drop_lines", lambda *a: whole(*a, broadcast_keys=keys))
    got = linededup.digest(linededup.drop_repeated_lines(frame(spark, rows), batches=batches, fanout=fanout))
    assert sorted(map(tuple, got.collect()), key=str) == expected_lines(rows)


def test_line_store_levels_and_antijoin(spark):
    """Runs are compacted by levels, known frequent keys are not carried again, and nothing stays behind."""
    store = linededup.LineStore(spark, min_docs=2, fanout=2, buckets=3)
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("scholia_lines")}
    before = tables()
    for k in range(5):
        store.add(frame(spark, [(k, f"both\nonly {k}"), (k + 100, "BOTH ")]))
    assert [len(level) for level in store.levels] == [1, 0, 1]
    top, last = store.levels[2][0][0], store.levels[0][0][0]
    assert sorted(r["n"] for r in spark.table(top).collect()) == [1, 1, 1, 1, 2]  # "both" is counted in the first batch alone
    assert [r["n"] for r in spark.table(last).collect()] == [1]
    assert [r["n"] for r in store.frequent().collect()] == [2]
    plan = spark.table(top).join(spark.table(last).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    store.close()
    assert tables() == before


def test_lines_odd_tables(spark):
    assert linededup.drop_repeated_lines(frame(spark, [])).count() == 0
    rows = [(i, "same\n" + "y" * i) for i in range(1, 12)] + [(50, "same")]
    assert sorted(map(tuple, linededup.digest(linededup.drop_repeated_lines(frame(spark, rows), min_docs=12)).collect()), key=str) == expected_lines(rows, 12)
    assert sorted(map(tuple, linededup.digest(linededup.drop_repeated_lines(frame(spark, rows), min_docs=2, min_chars=5)).collect()), key=str) == expected_lines(rows, 2, 5)
    begin = time.perf_counter()
    long_ = "\n".join(f"l{k % 60_000}" for k in range(120_000))
    rows = [(i, long_) for i in range(3)]
    assert sorted(map(tuple, linededup.digest(linededup.drop_repeated_lines(frame(spark, rows), min_docs=3)).collect()), key=str) == expected_lines(rows, 3)
    assert time.perf_counter() - begin < 60


def test_lines_plan_is_native(spark):
    plan = linededup.digest(linededup.drop_repeated_lines(frame(spark, line_rows(20))))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# importance


def word_runs(text, max_run=2):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, max_run + 1) for i in range(len(w) - k + 1)]


def expected_draw(docs, bench, percent=25, min_words=20, buckets=10_000, seed=7, max_run=2):
    def count(texts):
        out = [0] * buckets
        for t in texts:
            for f in word_runs(t, max_run)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = count(x for _, x in docs), count(bench)
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        n, f = word_runs(text, max_run)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(sha(f"{seed}:{i}")[:8], 16)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted((*r[:1], *r[2:], rank.get(r[0])) for r in rows)


def importance_rows(n):
    rng = random.Random(9)
    vocabulary = [f"Wort{k}" for k in range(40)] + ["été", "日本", "x" * 90, "É" * 200, "7"]
    texts = [rng.choice([" ", ", ", "-", " "]).join(rng.choice(vocabulary) for _ in range(rng.randint(0, 50))) for _ in range(n // 2)]
    return [(i, rng.choice(texts[: rng.choice([2, n])])) for i in range(n)] + [(9001, None), (9002, ""), (9003, "!?"), (9004, "one")]


@given(st.lists(st.text("aB é0-\t\n😀" + "q" * 3, max_size=40), min_size=1, max_size=5), st.integers(1, 4))
def test_buckets_equal_brute_force(texts, max_run):
    for _, offs, raw in common.text_slices(pa.array(range(len(texts))), pa.array(texts), limit=64):
        n, ends, found = importance.buckets_of(offs, raw, max_run, 10_000)
        data = raw.tobytes()
        for k in range(len(offs) - 1):
            words, features = word_runs(data[offs[k] : offs[k + 1]].decode(), max_run)
            assert words == n[k]
            assert found[ends[k] : ends[k + 1]].tolist() == [zlib.crc32(f.encode()) % 10_000 for f in features]


@pytest.mark.parametrize(("hot", "block"), [(10**9, 512), (3, 7)])
def test_op13_equals_brute_force(spark, hot, block, monkeypatch):
    monkeypatch.setattr(importance, "HOT_ROWS", hot)
    monkeypatch.setattr(importance, "BLOCK", block)
    rows, bench = importance_rows(200), ["wort1 wort2 wort3", None, "Wort1 日本 été été", "wort1 wort2 wort3"]
    target = spark.createDataFrame([(i, t, "x") for i, t in enumerate(bench)], "item_id long, text string, weight string")
    got = importance.resample(frame(spark, rows), target).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect())) == expected_draw(rows, bench)


def test_ranks_of_ties(spark):
    rows = [(i, 30, 1, 0, s) for i, s in [(5, 10), (3, 10), (4, 10), (9, 11), (1, -600), (2, 10), (7, 2000)]]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r["doc_id"]: r["rank"] for r in importance.rank_highest(scored, F.col("n_words") > 20, 4).collect()}
    assert got == {7: 1, 9: 2, 2: 3, 3: 4, 4: None, 5: None, 1: None}


def test_importance_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(frame(spark, []), none).count() == 0
    rows = [(None, "a b " * 30), (1, "a b " * 30), (1, "a b " * 30), (2, "c " * 20), (3, None)]
    got = importance.resample(frame(spark, rows), none, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 5
    assert [r["weight"] for r in got if r["doc_id"] == 3] == [0]
