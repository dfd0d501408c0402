import io
import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from locusframe.llm import token_codes as T


class Memory(io.BytesIO):
    """A file in memory that counts the bytes that are read."""

    read_bytes = 0

    def size(self):
        return len(self.getbuffer())

    def read_at(self, n, place):
        self.read_bytes += n
        return bytes(self.getbuffer()[place : place + n])


def written(documents, segment_ids=T.SEGMENT_IDS):
    stream = Memory()
    writer = T.TokenFileWriter(stream, segment_ids)
    for key, ids in documents:
        writer.begin(key)
        writer.append(np.array(ids, "<u4"))
    assert writer.close() == (len(documents), sum(len(ids) for _, ids in documents))
    return T.TokenFile(stream)


ids = st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.text(max_size=5)), ids), max_size=12), st.integers(1, 50))
def test_files_give_back_what_was_written(documents, segment_ids):
    file = written(documents, segment_ids)
    every = [i for _, part in documents for i in part]
    assert [file.token(at) for at in range(len(file))] == every
    found, before = [], 0
    for key, start, part, last in file.pieces():
        if not found or found[-1][3]:
            found.append([key, start, [], False])
        found[-1][2] += part.tolist()
        found[-1][3] = last
    expected = []
    for key, part in documents:
        expected.append([key, before, part, True])
        before += len(part)
    assert found == expected
    with pytest.raises(IndexError):
        file.token(len(every))


@given(st.lists(st.integers(0, 2**32 - 1), max_size=1500))
@settings(max_examples=50, deadline=None)
def test_levels_give_back_their_ids(values):
    levels = T.levels_of(np.array(values, "<u4"))
    assert T.ids_of([(chunks, bitmap) for chunks, bitmap, _ in levels]).tolist() == values
    for chunks, bitmap, directory in levels[:-1]:
        bits = np.unpackbits(bitmap, bitorder="little")
        assert directory.tolist() == [int(bits[: i * T.BLOCK].sum()) for i in range(len(directory))]


def test_one_id_costs_a_few_bytes():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 49_000, 300_000)
    file = written([("a", values)], 100_000)
    file.token(5)
    for position in (0, 99_999, 100_000, 254_321):
        file.token(position)
        before = file.source.read_bytes
        assert file.token(position) == values[position]
        assert file.source.read_bytes - before <= 2 * (1 + T.BLOCK // 8 + 4)


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        T.TokenFile(Memory(b"x" * 100))


# --- texts ----------------------------------------------------------------------------


@lru_cache
def tokenizer():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def expected_ids(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [2]


TEXTS = [
    None,
    "",
    " \n\t ",
    "It's the users' 3rd don't-care test, isn't it?! 'S 're ''ll",
    "Straße ÀÉÎ œuvre Ǆ İstanbul ΣΑΣ ſ ª º ² ½ ³x",
    "end <|endoftext|>next <|startoftext|> and <|endoftext| >",
    "中文没有空格的文本 と 日本語 😀👍🏽 עברית ไทย",
    "é a ́b  non breaking em\u0085nel\x1cfs\x00nul",
    "a​b ﻿c it’s “quoted” – dash… €5",
    "word " * 3000,
    "x" * 5000,
    "it's\x0bvertical\x0cform\rreturn",
]


def test_ids_equal_those_of_the_tokenizer():
    encoder = T.WordEncoder()
    plain = [chr(c) for c in range(1, 0x250)] + [chr(c) for c in range(0x2010, 0x2028)] + ["€"]
    mixed = [f"{c} a{c}b {c}{c} '{c} {c}'s 9{c}9 A{c}." for c in plain]
    rng = random.Random(3)
    pool = "aZ9'.é$ \n<|sStTreEvVmMlLdD²ßΣ中́ "
    noise = ["".join(rng.choice(pool) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in [*TEXTS, *mixed, *noise]:
        got = np.frombuffer(b"".join(encoder.encode(text or "")), "<u4").tolist()
        assert [*got, 2] == expected_ids(text), text


def test_remembered_words_are_bounded(monkeypatch):
    monkeypatch.setattr(T, "_REMEMBERED", 20)
    encoder = T.WordEncoder()
    text = " ".join(f"w{i}. é{i}" for i in range(100)) + " " + "y" * 200
    assert np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist() + [2] == expected_ids(text)
    assert len(encoder.words) <= 20 and len(encoder.parts) <= 20


def test_another_kind_of_vocabulary_is_refused():
    with pytest.raises(ValueError):
        T.WordEncoder("byte_bpe_50k")


# --- the operator ---------------------------------------------------------------------


def check_rows(rows, texts):
    """Rows in order of their start, against `(id, text)` in the order of the files."""
    rows = sorted(rows, key=lambda r: r.start)
    start = 0
    for row, (key, text) in zip(rows, texts, strict=True):
        values = expected_ids(text)
        crc = zlib.crc32(np.array(values, "<u4").tobytes())
        assert (row.id, row.start, row.n_tokens, row.ids_crc32) == (key, start, len(values), crc)
        assert row.middle_id == values[len(values) // 2]
        start += len(values)


def test_round_trip_of_documents(spark, documents):
    texts = [(3 * i % 100, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (7, "seven"), (7, "seven"), (7, "again")]
    docs = documents(texts, "start long, at string").selectExpr("*", "lang AS key", "'x' AS id", "1 AS ids", "2 AS part")
    rows = T.round_trip(spark, docs.coalesce(1)).collect()
    # Rows of one id follow in the order of the table.
    check_rows(rows, sorted(texts, key=lambda t: (t[0] is not None, t[0] or 0)))


def test_files_and_segments_of_any_size(spark, documents, tmp_path):
    rng = random.Random(5)
    texts = [(i, " ".join(rng.choice(["the", "zyx", "é1"]) for _ in range(rng.randrange(60)))) for i in range(200)]
    texts[50] = (50, "long " * 3000)
    rng.shuffle(texts)
    docs = documents(texts).repartition(5)
    manifest = T.write_token_files(docs, f"{tmp_path}/files", file_bytes=3000, segment_ids=100)
    files = sorted(manifest.collect(), key=lambda r: r.number)
    assert len(files) > 5
    assert [f.before for f in files] == [sum(g.tokens for g in files[:i]) for i in range(len(files))]
    rows = T.read_token_files(manifest).collect()
    check_rows([r for r in rows if r.last], sorted(texts))
    parts = {}
    for row in sorted(rows, key=lambda r: (r.id, r.offset)):
        assert row.offset == len(parts.get(row.id, b"")) // 4 and len(row.ids) <= 400
        parts[row.id] = parts.get(row.id, b"") + row.ids
    for key, text in texts:
        assert np.frombuffer(parts[key], "<u4").tolist() == expected_ids(text)


def test_a_frequent_id_is_spread_over_files(spark, documents, tmp_path):
    docs = documents([(1, f"word number {i}") for i in range(3000)] + [(0, "first"), (2, "last")])
    manifest = T.write_token_files(docs.repartition(4), f"{tmp_path}/files", file_bytes=8000)
    files = manifest.collect()
    assert len(files) >= 6 and max(f.documents for f in files) < 1500


def test_ids_of_any_type_and_an_empty_table(spark):
    docs = spark.createDataFrame([("b", "two"), ("a é", "one"), (None, "none")], "doc_id string, text string")
    rows = T.round_trip(spark, docs).collect()
    check_rows(rows, [(None, "none"), ("a é", "one"), ("b", "two")])
    assert T.round_trip(spark, docs.limit(0)).collect() == []


def test_long_texts_come_in_bounded_parts(spark, documents):
    long = "many different words 12 " * 150_000
    parts = list(T.WordEncoder().encode(long))
    assert max(map(len, parts)) < 3 << 20 and len(parts) > 3
    rows = T.round_trip(spark, documents([(2, long), (1, "short")])).collect()
    check_rows(rows, [(1, "short"), (2, long)])
