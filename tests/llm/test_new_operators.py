"""Periodic runs, b-bit MinHash and spelling variants: against brute force on the small tables, and on odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from radiolake.llm import minhash, periodic_runs, registry, simhash, spelling

QUERIES = registry.queries()
LONG = "word " * 30_000
ODD = [(1, "a b c d e f " * 20, "x"), (1, "a b c d e f " * 20, "x"), (2, None, None), (None, "no id here", "y"), (3, "", "z"), (4, LONG, "z"), (None, None, None), (5, " \t\n ", "q")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, word string").withColumns({c: F.lit(7) for c in ("key", "runs", "n", "near", "size", "node", "root", "part")})


@pytest.fixture(scope="module")
def texts(sf_dir):
    return duckdb.sql(f"select doc_id, text from '{sf_dir}/documents.parquet' order by doc_id").fetchall()


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 11


def brute_runs(w):
    """Every stretch by each period, smallest first; a stretch that a smaller period has isn't another run."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((start, length, q) for (start, length), q in found.items())


def collapsed(w, runs):
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in dropped)


def test_runs_of_many_documents_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(400):
        docs = []
        for _ in range(rng.integers(1, 6)):
            d = rng.integers(0, rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 20, 70])).tolist()
            if d and rng.random() < 0.5:
                a, p = int(rng.integers(len(d))), int(rng.integers(1, 7))
                d = [d[min(len(d) - 1, a + (i - a) % p)] if i > a else x for i, x in enumerate(d)]
            docs.append(d)
        first = np.cumsum([0, *map(len, docs)])
        start, length, period = periodic_runs.runs(np.array([x for d in docs for x in d], np.int64), first)
        want = sorted((s + int(first[k]), n, q) for k, d in enumerate(docs) for s, n, q in brute_runs(d))
        assert sorted(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_suffix_ranks_and_common_prefixes():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 2, 300)
    end = np.repeat([100, 150, 300], [100, 50, 150])
    rank = periodic_runs.suffix_ranks(codes, end)
    order = sorted(range(300), key=lambda i: (end[i], codes[i : end[i]].tolist()))
    assert np.argsort(rank).tolist() == order
    lcp = periodic_runs.common_prefixes(codes, end, rank, np.array(order))
    for k in range(1, 300):
        a, b = (codes[i : end[i]].tolist() for i in order[k - 1 : k + 1])
        same = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert lcp[k] == (same if end[order[k - 1]] == end[order[k]] else 0)


def test_runs_query(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert len(got) == len(texts)
    with_runs = 0
    for key, text in texts:
        w = split(text)
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        row = got[key]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == digest and row["collapsed_sha256"] == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
        with_runs += bool(runs)
    assert with_runs > 5


def test_runs_on_odd_rows(odd):
    got = periodic_runs.find_runs(odd).collect()
    assert len(got) == len(ODD) and periodic_runs.find_runs(odd.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert [tuple(r) for r in by[1]["runs"]] == [(0, 120, 6)] and by[1]["collapsed"] == "a b c d e f"
    assert [tuple(r) for r in by[4]["runs"]] == [(0, 30_000, 1)] and by[4]["collapsed"] == "word"
    for k in (2, 3, 5):
        assert (by[k]["n_words"], by[k]["runs"], by[k]["collapsed"]) == (0, [], "")
    kept = odd.select("doc_id", periodic_runs.made_periodic(F.col("doc_id"), F.col("text")).alias("text")).where("doc_id is null").collect()
    assert {r["text"] for r in kept} == {"no id here", None}


# 12


def sets_of(texts, width=3):
    out = []
    for t in texts:
        w = split(lowered(t))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()})
    return out


def roots_of(sets):
    """The smallest place reachable over pairs of 85 %, from shared shingles."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x]).items():
            if 100 * both >= 85 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(i)
    return [find(i) for i in range(len(sets))]


def test_minhash_query(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in QUERIES["op12_minhash"](spark, sf_dir).collect()}
    sets = sets_of(t for _, t in texts)
    roots = roots_of(sets)
    ids = [k for k, _ in texts]
    assert len(got) == len(ids) and len(set(roots)) < len(ids)
    for i, key in enumerate(ids):
        assert tuple(got[key])[1:] == (len(sets[i]), ids[roots[i]], roots[i] == i)


def test_minhash_on_odd_rows(odd):
    got = minhash.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and minhash.near_duplicates(odd.limit(0)).count() == 0
    rows = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert rows == Counter({(1, 6, 1, True): 2, (2, 0, 2, True): 1, (None, 1, None, True): 1, (3, 0, 3, True): 1, (4, 1, 4, True): 1, (None, 0, None, True): 1, (5, 0, 5, True): 1})


def test_signatures():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**64, 120, np.uint64) for _ in range(2))
    b[:60] = a[:60]
    left, right = (minhash.signature(x)[:, None] for x in (a, b))
    assert len(left) == 4 and int(minhash.unequal(left, right)[0]) == int(((a & np.uint64(3)) != (b & np.uint64(3))).sum())
    assert minhash.estimate(np.array([0]), 120)[0] == 1 and abs(minhash.estimate(np.array([90]), 120)[0]) < 1e-9
    long = pa.array(["One two  three\tFOUR", "one two", None, "", "one two three four"])
    assert [len(s) for s in minhash.shingles(long)] == [2, 1, 0, 0, 2] and (minhash.shingles(long)[0] == minhash.shingles(long)[4]).all()


def variants(rng, base, most, name):
    words = list(base)
    for at in rng.choice(len(base), most, replace=False):
        words[at] = f"x{name}y{at}"
    return " ".join(words)


@pytest.mark.parametrize("lots", [100, 0])
def test_large_mixed_groups(spark, monkeypatch, lots):
    """A passage that unlike texts share and near copies among them, in small blocks, by strays or dealt anew: as by brute force."""
    monkeypatch.setattr(simhash, "COPY_BLOCK", 4)
    monkeypatch.setattr(simhash, "WORD_BLOCK", 8)
    monkeypatch.setattr(simhash, "MANY_LOTS", lots)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(150)]
    made = [" ".join([*passage, *(f"u{k}v{i}" for i in range(90))]) for k in range(40)]
    made += [variants(rng, made[k % 7].split(), 1 + k % 9, k) for k in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}
    want = roots_of(sets_of(made))
    assert 40 <= len(set(want)) < 80 and [got[i] for i in range(80)] == want


def test_large_groups_are_dealt_in_proportion(spark, monkeypatch):
    """Unlike texts that share a band don't meet each other: what is compared in full grows no faster than they do."""
    monkeypatch.setattr(simhash, "COPY_BLOCK", 8)
    monkeypatch.setattr(simhash, "WORD_BLOCK", 16)
    pairs = []
    for n in (400, 800):
        rng = np.random.default_rng(n)
        low = rng.integers(0, 256, (n, simhash.BANDS * simhash.MINIMA)).astype(np.uint8)
        low[:, :5] = 7  # the band that all share
        nodes = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(low)], "node long, low binary")
        rows = nodes.select(F.lit(1).cast("long").alias("value"), "node", F.lit(100).cast("long").alias("size"))
        dealt = simhash._dealt_anew(rows, nodes)
        pairs.append(dealt.groupBy("value").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0])
    assert pairs[1] <= 3 * pairs[0] + 800


# 13


def slip(key, word):
    h = zlib.crc32(f"{key}:{word}".encode())
    at = h % len(word)
    return word[:at] + word[at + 1 :] if h % 97 == 0 else word


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def spelled(counts):
    """(word, form, root, n, n_near, form_n) of a vocabulary; words that are near share a text with one place left open."""
    open_ = defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            open_[w[:i] + "*" + w[i:]].add(w)
            if i < len(w):
                open_[w[:i] + "*" + w[i + 1 :]].add(w)
    found = defaultdict(set)
    for w in counts:
        for i in range(len(w) + 1):
            for gap in (w[:i] + "*" + w[i:], w[:i] + "*" + w[i + 1 :]):
                found[w] |= open_[gap]
    rows, forms = {}, {}
    for w, n in counts.items():
        others = [v for v in found[w] if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        rows[w] = [len(others), counts[forms[w]] if forms[w] else None]
    out = set()
    for w, n in counts.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.add((w, forms[w], root, n, *rows[w]))
    return out


def test_spelling_query(spark, sf_dir, texts):
    counts = Counter()
    for key, text in texts:
        counts.update(slip(key, w) for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(text)))
    want = spelled({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = QUERIES["op13_spelling"](spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 500 and any(r["form"] for r in got)


@pytest.mark.parametrize("block", [30, 20_000])
def test_spelling_of_crowded_words(spark, monkeypatch, block):
    """Words over few letters, most of which share halves: the same in blocks that split a half and in one."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = np.random.default_rng(6)
    words = {"".join(rng.choice(list("abé"[: 2 + k % 2]), 5 + k % 5)) for k in range(900)}
    counts = {w: int(rng.integers(3, 200)) for w in sorted(words)}
    rows = [*counts.items(), (None, 5), ("nothing", None)]
    got = spelling.group_variants(spark.createDataFrame(rows, "word string, n long"))
    assert {tuple(r) for r in got.collect()} == spelled(counts)


def test_intervals_are_those_of_both_directions():
    words = ["abcde", "abcdf", "bcdea", "aaaaa", "ébcde"]
    index = spelling.TwoWayIndex(words)
    whole = np.array([[0], [0], [len(index.suffixes)]])
    code = index.encode(np.array([ord(c) for c in "bcz"]))
    to_right = index.extend(index.extend(whole, code[:1], True), code[1:2], True)
    to_left = index.extend(index.extend(whole, code[1:2], False), code[:1], False)
    assert to_right.tolist() == to_left.tolist() and to_right[2, 0] == 4 and code[2] == -1
    assert index.extend(whole, code[2:], True)[2, 0] == 0


def test_spelling_on_odd_rows(spark, odd):
    vocab = {r["word"]: r["n"] for r in spelling.vocabulary(odd).collect()}
    assert vocab == {} or set(vocab) <= {"word"}  # all words are short
    assert spelling.group_variants(spelling.vocabulary(odd.limit(0))).count() == 0
    rows = [(1, "CafÉs " * 3), (1, None), (None, "×÷abcde1abcde"), (2, "abcde" * 4000 + " é" * 3), (3, "abcde_abcde")]
    vocab = {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = Counter(slip(k, w) if k is not None else w for k, t in rows for w in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)))
    assert vocab == {w: n for w, n in want.items() if len(w) >= 5 and n >= 3} and len(vocab) == 2
