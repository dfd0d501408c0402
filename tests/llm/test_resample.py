import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import resample as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features_of(text):
    words = words_of(text)
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def bucket(feature, buckets=10_000):
    return zlib.crc32(feature.encode()) % buckets


def hashed(texts):
    """`(features, words)` per text, as the operator hashes them."""
    found, words = [[] for _ in texts], [0] * len(texts)
    for pieces in R._batches(texts):
        documents, buckets, of_words = R.features(pieces)
        for document, value in zip(documents.tolist(), buckets.tolist()):
            found[document].append(value)
        for document in of_words.tolist():
            words[document] += 1
    return found, words


def check_features(texts):
    found, words = hashed(texts)
    for text, got, n in zip(texts, found, words):
        assert Counter(got) == Counter(map(bucket, features_of(text))), text
        assert n == len(words_of(text))


TEXTS = [None, "", " ", "---", "a", "A b", "é É\x7fß", "x" * 700 + " y " + "z" * 3000, "[a]b`c{d}e@f/g:h0 9", "中文 字"]


def test_features_equal_crc_of_each_run():
    check_features(TEXTS)
    check_features(["only one"])
    check_features([None])
    assert R.crc_of_slices(np.zeros(3, "u1"), np.array([0, 1]), np.array([0, 2])).tolist() == [0, zlib.crc32(b"\0\0")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab B9.é \n_", max_size=60), max_size=6))
def test_features_of_any_texts(texts):
    check_features(texts)


def test_features_of_cut_texts(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abZ 9.é \n") for _ in range(rng.randrange(400))) for _ in range(200)] + TEXTS
    for size in (1, 7, 50):
        monkeypatch.setattr(R, "PIECE_BYTES", size)
        check_features(texts)
    monkeypatch.setattr(R, "MATRIX_BYTES", 16)
    monkeypatch.setattr(R, "LONG", 5)
    check_features(texts)


def brute(docs, target, percent=5, min_words=20):
    s = Counter(b for _, t in docs for b in map(bucket, features_of(t)))
    t = Counter(b for x in target for b in map(bucket, features_of(x)))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(
        1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))
    )
    rows = []
    for key, text in docs:
        found = features_of(text)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([key, len(words_of(text)), len(found), weight, score, None])
    able = [r for r in rows if r[1] >= min_words]
    able.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, rows), key=str)


def rows_of(df):
    return sorted(((r.id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in df.collect()), key=str)


def test_draw_equals_brute_force(spark, documents):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "9", "é", "delta-x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(150)]
    rows = list(enumerate([*TEXTS, *texts])) + [(None, texts[0]), (7, texts[1]), (7, texts[1]), (7, texts[2])]
    docs = documents(rows, "rank long, weight string").repartition(5)
    docs = docs.withColumnRenamed("source", "id").withColumnRenamed("lang", "bucket")
    target = ["alpha alpha gamma", None, "", "Beta 9 é"]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    assert rows_of(R.resample(docs, table)) == brute(rows, target)
    assert rows_of(R.resample(docs, table, percent=40, min_words=30)) == brute(rows, target, 40, 30)
    assert rows_of(R.resample(docs, table.limit(0), percent=100, min_words=0)) == brute(rows, [], 100, 0)


def test_empty_documents_and_long_texts(spark, documents):
    target = spark.createDataFrame([("a b",)], "text string")
    assert R.resample(documents([(1, "x")]).limit(0), target).collect() == []
    rows = [(1, "long Text here " * 400_000), (2, "a b " * 20)]
    assert rows_of(R.resample(documents(rows), target, percent=50)) == brute(rows, ["a b"], 50)


def test_documents_like_the_target_are_drawn(spark, documents):
    rng = random.Random(8)
    common = [f"w{i}" for i in range(400)]
    wanted = [f"t{i}" for i in range(60)]
    make = lambda pool: " ".join(rng.choice(pool) for _ in range(40))
    rows = [(i, make(wanted if i % 20 == 0 else common)) for i in range(600)]
    target = spark.createDataFrame([(make(wanted),) for _ in range(30)], "text string")
    drawn = [r.id for r in R.resample(documents(rows), target).where("rank is not null").collect()]
    assert len(drawn) == 30 and all(i % 20 == 0 for i in drawn)
