"""Fingerprints, periodic runs and fill-in-middle rows against their definitions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from orderflow.llm import fingerprints, middles, runs

from .test_exact import ODD, SCHEMA

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest_by_definition(text):
    data, buckets = text.encode(), fingerprints.BUCKETS
    counts = [0] * buckets
    for multiplier, (j, k) in zip(fingerprints.MULTIPLIERS.tolist(), fingerprints.SHAPES):
        for i in range(len(data) - k):
            counts[(data[i] | data[i + j] << 8 | data[i + k] << 16) * multiplier % 2**32 >> int(fingerprints.SHIFT)] += 1
    q1, q2, q3 = (sorted(counts)[buckets * i // 4 - 1] for i in (1, 2, 3))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    length = sum(len(data) >= n for n in fingerprints.LENGTHS.tolist())
    head = [zlib.crc32(data) & 255, length, (15 * q1 // max(q3, 1)) << 4 | 15 * q2 // max(q3, 1)]
    return bytes([*head, *(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, buckets, 4))]).hex()


def likeness_by_definition(a, b):
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    difference = (x[0] != y[0]) + min(fingerprints.MOST_STEPS, abs(x[1] - y[1])) + abs((x[2] >> 4) - (y[2] >> 4)) + abs((x[2] & 15) - (y[2] & 15))
    difference += sum(abs((u >> s & 3) - (v >> s & 3)) for u, v in zip(x[3:], y[3:]) for s in (0, 2, 4, 6))
    return 1 - min(difference, fingerprints.BOUND) / fingerprints.BOUND


@pytest.mark.parametrize("window", [7, 64, 1 << 20])
def test_fingerprints_are_the_definition(monkeypatch, window):
    monkeypatch.setattr(fingerprints, "WINDOW", window)
    rng = random.Random(5)
    texts = ["", "a", "ab", "abc", "é", "x" * 500, *("".join(rng.choices("abcdé \n", k=rng.randint(0, 400))) for _ in range(60))]
    assert fingerprints.digests(pa.array(texts)) == [digest_by_definition(t) for t in texts]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_edited_texts_follow_ids(spark, monkeypatch, parts):
    monkeypatch.setattr(fingerprints, "shuffle_partitions", lambda _: parts)
    monkeypatch.setattr(fingerprints, "SLICE_ROWS", 3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(1)
    rows = [(5 * r.doc_id - 300, r.text, "x") for r in docs] + [(10**6, None, "x"), (10**6 + 1, "é😀z", "x"), (2**40, "tail end", "x")]
    rng.shuffle(rows)
    found = {r.doc_id: r for r in fingerprints.fingerprint_table(spark.createDataFrame(rows, "doc_id long, text string, edited string").repartition(5)).collect()}
    order = sorted((i, t or "") for i, t, _ in rows)
    assert sorted(found) == [i for i, _ in order]
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want = [digest_by_definition(x) for x in (t, edited, n)]
        r = found[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), want[0], want[1])
        assert (r.near_edited, r.near_next) == (likeness_by_definition(*want[:2]), likeness_by_definition(want[0], want[2]))


def test_fingerprints_of_odd_rows(spark):
    rows = fingerprints.fingerprint_table(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD) and all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert fingerprints.fingerprint_table(spark.createDataFrame([], SCHEMA)).collect() == []
    alone = fingerprints.fingerprint_table(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).collect()
    assert [(r.edited_sha256, r.near_next) for r in alone] == [(sha("abab"), 1.0)]
    nulls = fingerprints.edited_fingerprints(spark.createDataFrame([(None, "aa"), (None, "bb"), (1, "cc"), (1, "cc")], "doc_id long, text string")).collect()
    assert sorted(r.edited for r in nulls) == ["ab", "bc", "ca", "cc"]  # null ids first, then by text, the last followed by the first
    both = spark.createDataFrame([("abc", "abc"), (None, "")], "a string, b string").select(fingerprints.fingerprint("a").alias("a"), fingerprints.fingerprint("b").alias("b"))
    assert [r[0] for r in both.select(fingerprints.likeness("a", "b")).collect()] == [1.0, 1.0]


def test_half_a_text_is_nearer_than_another(spark):
    rows = fingerprints.fingerprint_table(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.98


def runs_by_definition(words):
    found = set()
    for q in range(1, len(words) // 4 + 1):
        same = [a == b for a, b in zip(words, words[q:])]
        i = 0
        while i < len(same):
            e = i
            while e < len(same) and same[e]:
                e += 1
            length = e - i + q
            if e > i and length >= max(6, 4 * q):
                smaller = any(all(words[x] == words[x + p] for x in range(i, i + length - p)) for p in range(1, q))
                if not smaller:
                    found.add((i, length, q))
            i = e + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_are_the_definition():
    rng = random.Random(7)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = rng.choices(range(rng.choice([1, 2, 3, 8])), k=rng.randint(0, 60))
            for _ in range(rng.randint(0, 3)):
                unit = rng.choices(range(3), k=rng.randint(1, 12))
                at = rng.randint(0, len(words))
                words[at:at] = (unit * 7)[: rng.randint(1, 7 * len(unit))]
            texts.append(words)
        bounds = np.cumsum([0, *map(len, texts)])
        found = runs.find_runs(np.array([w for t in texts for w in t], np.int64), bounds)
        assert found.tolist() == [[s + int(b), n, q] for t, b in zip(texts, bounds) for s, n, q in runs_by_definition(t)]


def planted_by_definition(key, words):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def check_run_rows(docs, rows):
    texts = {r.doc_id: r.text or "" for r in docs}
    assert len(rows) == len(docs)
    for r in rows:
        words = planted_by_definition(r.doc_id, [w.decode() for w in texts[r.doc_id].encode().split()])
        found = runs_by_definition(words)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        longest = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        want = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(found), *want)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in found))
        assert r.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def test_run_rows_are_the_definition(spark):
    docs = [r for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect() if len(r.text) < 4000]
    check_run_rows(docs, runs.run_table(spark.createDataFrame(docs)).collect())


def test_runs_of_odd_rows(spark):
    rows = runs.run_table(spark.createDataFrame(ODD, SCHEMA)).collect()
    assert len(rows) == len(ODD)
    assert [(r.n_runs, r.start, r.length, r.period) for r in rows if r.doc_id == 5] == [(1, 0, 30_000, 1)]
    assert {(r.n_runs, r.collapsed_sha256) for r in rows if r.doc_id in (1, 2, 7)} == {(0, sha(""))}
    assert runs.run_table(spark.createDataFrame([], SCHEMA)).collect() == []
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a b " * 9, "\x1c  x" * 8, "é é é é é é"] * 12)], "doc_id long, text string")
    check_run_rows(docs.collect(), runs.run_table(docs).collect())


def middle_by_definition(key, text):
    group = [int(hashlib.sha256(f"1:{key}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(m in text for m in middles.MARKS) or group[2] % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((group[0] % (n + 1), group[1] % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if group[3] % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("window", [5, 1 << 20])
def test_middles_are_the_definition(spark, monkeypatch, window):
    monkeypatch.setattr(middles, "WINDOW", window)
    rng = random.Random(11)
    texts = ["", None, "a", "é", "😀", "<P>", "x<M>y", "<P<S<M", "<" * 40, "a<S", "plain <p> <s>", *("".join(rng.choices("ab<>PSMé😀\n", k=rng.randint(0, 40))) for _ in range(200))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, output string")
    out = middles.restore(middles.fill_in_middle(docs), ("doc_id", "n", "form", "prefix_chars", "middle_chars")).collect()
    assert len(out) == len(texts)
    for r in out:
        text = texts[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_definition(r.doc_id, text)
        assert r.restored == text
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_middles_of_odd_rows(spark):
    assert len(middles.middle_table(spark.createDataFrame(ODD, SCHEMA)).collect()) == len(ODD)
    assert middles.middle_table(spark.createDataFrame([], SCHEMA)).collect() == []
    lost = spark.createDataFrame([(1, "psm", None), (2, None, "x")], "doc_id long, form string, output string")
    assert [r.restored for r in middles.restore(lost).collect()] == [None, None]
