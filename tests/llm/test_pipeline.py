"""Stages of the pipeline against brute force."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from orderflow.llm import language

DOCS = "/root/testdata/sf0.001/documents.parquet"


def grams(text: str) -> Counter:
    data = [c if c >= 128 or 97 <= c <= 122 else 32 for c in (b + 32 if 65 <= b <= 90 else b for b in text.encode())]
    found = Counter()
    for n in (2, 3):
        for i in range(len(data) - n + 1):
            code = 0
            for c in data[i : i + n]:
                code = (code * 0x01000193 & 0xFFFFFFFF) ^ c
            found[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 17] += 1
    return found


def kept_by_definition(rows) -> set:
    """Ids of (id, text, lang) that are not ambiguous, nor beyond LOSS to the nearest codeword or below FIT."""
    sums = {}
    for _, text, lang in rows:
        if text is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(grams(text))
    langs, buckets = sorted(sums), 1 << 15
    share = [[(sums[x][b] + 0.5) / (sums[x].total() + 0.5 * buckets) for b in range(buckets)] for x in langs]
    codes = language.codewords(len(langs)).tolist()
    odds, trust = [], []
    for bit in zip(*codes):
        sides = [[s for s, c in zip(share, bit) if c == v] for v in (1, 0)]
        means = [[sum(x) / len(side) for x in zip(*side)] for side in sides]
        odds.append([math.log(a) - math.log(b) for a, b in zip(*means)])
        inner = lambda s: sum(a * b for a, b in zip(s, odds[-1]))
        trust.append(max(min(min(map(inner, sides[0])), -max(map(inner, sides[1]))), 1e-3))
    kept = set()
    for doc_id, text, _ in rows:
        if not text or not any(map(str.isalpha, text)):
            continue
        mine = grams(text)
        n = max(mine.total(), 1)
        score = [sum(k * o[b] for b, k in mine.items()) / n for o in odds]
        loss = [sum(t * math.log1p(math.exp(-6 * s * (2 * c - 1))) for t, s, c in zip(trust, score, code)) / sum(trust) for code in codes]
        best = loss.index(min(loss))
        sure = sorted((math.exp(-(x - loss[best]) * min(mine.total(), language.EVIDENCE) / 4) for x in loss), reverse=True)
        fit = sum(k * math.log(share[best][b] * buckets) for b, k in mine.items()) / n
        if (sure[0] - sure[1]) / sum(sure) >= 0.1 and loss[best] <= language.LOSS and fit >= language.FIT:
            kept.add(doc_id)
    return kept


def test_language_stage_rejects_what_its_decoder_rejects(spark):
    rng = random.Random(3)
    docs = spark.read.parquet(DOCS)
    word = lambda a: "".join(rng.choice(a) for _ in range(rng.randint(2, 9)))
    noise = [" ".join(word(a) for _ in range(60)) for a in ("abcdefghijklmnopqrstuvwxyz", "qxzwkj", "QWZ", "жщфыъ", "漢字假名語", "¿¡þßæµ")]
    noise += ["qz" * 200, "", "1234 5678", None]
    fake = [(-i - 1, x, None if i in (1, 2, 3, 4, 5, 6) else "en", "a", 9) for i, x in enumerate(noise)]  # six letters over and over would be learned, were they labelled
    mixed = docs.select("doc_id", F.substring("text", 1, 700).alias("text"), "lang", "source", "n_chars").unionByName(spark.createDataFrame(fake, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = {r.doc_id for r in corpus_pipeline.keep_languages(spark, mixed, "").collect()}
    rows = [(r.doc_id, r.text, r.lang) for r in mixed.collect()]
    assert kept == kept_by_definition(rows)
    assert [noise[-i - 1] for i in kept if i < 0] == []
    clean = [i for i, text, _ in rows if i >= 0 and text and any(map(str.isalpha, text))]
    assert kept >= set(clean)


def test_a_single_language_has_no_bits_to_lose(spark):
    docs = spark.read.parquet(DOCS).filter("lang = 'en'")
    assert corpus_pipeline.keep_languages(spark, docs, "").count() == docs.filter("text rlike '[A-Za-z]'").count()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, n_lines string, copies string, node string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *("x",) * 6) for i, t, s in rows], SCHEMA)


def as_rows(df):
    return sorted(([str(v) for v in r] for r in df.collect()))


WORDS = [f"word{i}" for i in range(60)]


def passages(rng, n):
    rows = []
    for i in range(n):
        words = rng.choices(WORDS, k=rng.choice((3, 9, 40, 80)))
        rows.append((i, " ".join(words), rng.choice(("a", "b", None))))
        if i % 3 == 0:
            near = list(words)
            near[-1] = "other"
            rows.append((1000 + i, " ".join(near), "b"))
        if i % 5 == 0:
            rows.append((2000 + i, " ".join(words).upper(), "a"))
    return rows + [(None, "no id here at all", "a"), (None, "no id here at all", "a"), (7, "shares an id with another row", "c"), (8, None, "a"), (9, "", "a"), (3, rows[3][1], rows[3][2])]


def test_near_duplicates_stage_keeps_one_of_each_group(spark):
    rows = passages(random.Random(1), 60)
    ids = sorted({i for i, _, _ in rows if i is not None})
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        grams = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
        sets.setdefault(i, []).append(grams)
    label = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if b < a and any(100 * len(x & y) >= 75 * len(x | y) > 0 for x in sets[a] for y in sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if v == old else v for i, v in label.items()}
    got = corpus_pipeline.drop_near_duplicates(spark, table(spark, rows), "")
    kept = [(i, t, s) for i, t, s in rows if i is None or label[i] == i]
    assert as_rows(got) == as_rows(table(spark, kept))
    assert len(kept) < len(rows) - 20


def test_lines_stage_removes_what_came_before(spark):
    rows = [(1, "a line of the first text, long enough\nshared boilerplate at the end", "a"), (2, "shared boilerplate at the End\nown line of two", "a"), (3, "shared boilerplate at the end", "b"), (4, "", "b"), (5, None, "b"), (None, "shared boilerplate at the end\nlast words", "b"), (6, "own line of two\n\nkept", "c"), (6, "another text of the same id", "c")]
    got = {(r.doc_id, r.text, r.n_chars, r.n_lines) for r in corpus_pipeline.drop_lines(spark, table(spark, rows), "").collect()}
    want = [(1, rows[0][1]), (2, "own line of two"), (4, ""), (5, None), (None, "last words"), (6, "\nkept"), (6, "another text of the same id")]
    assert got == {(i, t, None if t is None else len(t), "x") for i, t in want}


def test_mix_stage_takes_whole_copies(spark):
    from orderflow.llm import mixing

    rows = passages(random.Random(2), 90)
    docs = table(spark, rows)
    key = F.xxhash64(F.struct(*docs.columns))
    mixed = {}
    for r in mixing.mix_sources(docs.select(key.alias("doc_id"), "source", "text"), corpus_pipeline.WEIGHTS).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + r.copies
    want = sorted([str(v) for v in r[:-1]] for r in docs.withColumn("k", key).distinct().collect() for _ in range(mixed[r.k]))
    got = corpus_pipeline.mix(spark, docs, "")
    assert got.columns == docs.columns and as_rows(got) == want
    assert as_rows(corpus_pipeline.mix(spark, docs.repartition(3), "")) == want


def test_tokens_stage_is_the_library(spark):
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from orderflow.llm import bpe

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    rows = passages(random.Random(3), 20)
    want = sorted([str(i), str(len(ids)), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] for i, t, _ in rows for ids in [library.encode_ordinary(t or "")])
    assert as_rows(corpus_pipeline.tokenize(spark, table(spark, rows), "").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == want


def test_stages_on_empty_tables_and_odd_rows(spark):
    empty = table(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").collect() == []
        if name != "tokens":
            assert stage(spark, table(spark, passages(random.Random(4), 9)), "").columns == empty.columns


def test_run_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert as_rows(corpus_pipeline.run(spark, str(tmp_path))) == as_rows(step)
