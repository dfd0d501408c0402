import gzip
import hashlib
import io
import random
import struct
from collections import defaultdict

import pytest

from locusframe.llm import packing, warc


def test_both_encoders_agree_on_plain_texts():
    slow, fast = packing._encoders(packing.VOCABULARY, None)
    rng = random.Random(1)
    plain = [chr(c) for c in range(0x250) if packing._PLAIN.fullmatch(chr(c))] + ["—", "€", "’"]
    for _ in range(3000):
        text = "".join(rng.choice(plain if rng.random() < 0.5 else " 'stre\n9aDé") for _ in range(40))
        assert slow.encode(text, add_special_tokens=False).ids == fast.encode_ordinary(text)


def test_long_text_is_cut_without_changing_ids(monkeypatch):
    text = "Ab c'd  e\n f 12 g, h. " * 40 + "日本 語"
    whole = packing.token_ids(text).tolist()
    monkeypatch.setattr(packing, "PART_CHARS", 7)
    assert packing.token_ids(text).tolist() == whole
    slow, _ = packing._encoders(packing.VOCABULARY, None)
    assert whole == [*slow.encode(text, add_special_tokens=False).ids, 0]


def test_added_tokens_are_encoded_as_the_tokenizer_does(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(str(public_tokenizers.path(f"{packing.VOCABULARY}.json")))
    own = lambda text: [*fresh.encode(text, add_special_tokens=False).ids, 0]
    texts = ["end of doc <|endoftext|> next", "<|endoftext|>", "a<|endoftext|><|endoftext|>b <|endoftext |>", "日 <|endoftext|>\n本",
             "one two <|endoftext|> three four<|endoftext|>five six " * 30]
    assert own(texts[0])[4] == 50256
    for chars in (packing.PART_CHARS, 5, 9):
        monkeypatch.setattr(packing, "PART_CHARS", chars)
        for text in texts:
            assert packing.token_ids(text).tolist() == own(text)


def test_cuts_leave_added_tokens_with_spaces_whole():
    text = "ab cd ef gh ij" * (packing.PART_CHARS // 7)
    added = packing.re.compile("cd ef")
    parts = list(packing._parts(text, added))
    assert "".join(parts) == text and len(parts) > 1
    assert sum(len(added.findall(p)) for p in parts) == len(added.findall(text))


def test_fill_places_everything_within_capacity():
    rng = random.Random(4)
    for n in (1, 2, 7, 60, 400, 3000):
        sizes = [rng.choice([rng.randint(1, 256), rng.randint(1, 9)]) for _ in range(n)]
        windows = packing.fill(sizes)
        assert all(0 < sum(sizes[i] for i in w) <= 1024 for w in windows)
        assert sorted(i for w in windows for i in w) == list(range(n))
        assert len(windows) <= max(1.03 * sum(sizes) / 1024, sum(sizes) / 1024 + 2)


def test_the_window_count_rises_until_all_fit():
    # Two such pieces share no window.
    assert sorted(map(len, packing.fill([600] * 70))) == [1] * 70
    assert len(packing.fill([1024] * 5 + [1])) == 6
    assert packing.fill([]) == [] and packing.fill([7]) == [[0]]
    with pytest.raises(ValueError):
        packing.fill([1025])


def test_a_block_of_tiny_pieces_is_small():
    import time
    import tracemalloc

    sizes = [1] * (packing.WINDOW * packing.BLOCK_WINDOWS)
    start = time.process_time()
    tracemalloc.start()
    windows = packing.fill(sizes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows) == packing.BLOCK_WINDOWS and {len(w) for w in windows} == {packing.WINDOW}
    assert peak < 150 << 20 and time.process_time() - start < 40


def test_differencing_is_near_equal():
    rng = random.Random(6)
    sizes = [rng.randint(1, 200) for _ in range(400)]
    totals = [sum(sizes[i] for i in g) for g in packing.difference(sizes, 16)]
    assert max(totals) - min(totals) <= 8


def test_pack_is_a_round_trip(documents):
    rng = random.Random(2)
    texts = [None, "", "x", "<|endoftext|>", *(" ".join(rng.choice(["the", "año", "12,", "日本"]) for _ in range(rng.randint(1, 2500))) for _ in range(60))]
    rows = packing.pack(documents(list(enumerate(texts))).repartition(3)).collect()
    slow, _ = packing._encoders(packing.VOCABULARY, None)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(texts):
        data = b"".join(bytes(r.ids) for r in sorted(docs[i], key=lambda r: r.start))
        expected = [*slow.encode(text or "", add_special_tokens=False).ids, 0]
        assert list(struct.unpack(f"<{len(data) // 4}I", data)) == expected
        assert {r.doc_tokens for r in docs[i]} == {len(expected)}
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length * 4 == len(r.ids)
            at += r.length
        assert at <= 1024
    assert packing.pack(documents([])).count() == 0


@pytest.fixture
def pages(spark):
    big = "é" * 700
    huge = "".join(chr(97 + i % 26) for i in range(3_000_001))
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (5, "http://c", big), (3, "u", None), (4, "u", ""),
            (6, "u", "short"), (7, "u", "short"), (8, "u", huge), (9, "u", "WARC/1.1\r\n\r\n" * 200), (None, "n", big),
            (None, None, None), (9, "u", "WARC/1.1\r\n\r\n" * 200)]
    return rows, spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip_of_archives(spark, pages, tmp_path):
    rows, df = pages
    out = warc.round_trip(spark, df, f"file://{tmp_path}/archives").collect()
    assert len(out) == len(rows)
    got = sorted((str(r.record_id), r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in out)
    expected = []
    for i, _, html in rows:
        data = (html or "").encode()
        last = max((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(data) >= 1000 and i != last
        expected.append((str(i), len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last if again else None))
    assert got == sorted(expected, key=lambda r: r[:4])


def test_chunks_carry_running_digests(spark, pages, tmp_path):
    rows, df = pages
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives")
    parts = warc.read_archives(manifest).where("record_id = 8").orderBy("chunk").collect()
    assert [r.chunk for r in parts] == list(range(len(parts))) and len(parts) > 1
    data = b""
    for r in parts:
        data += bytes(r.data)
        assert (r.digest, r.bytes) == (hashlib.sha1(data).hexdigest(), len(data))
    assert data == rows[7][2].encode() and parts[-1].last and parts[-1].digest == parts[-1].payload_digest


def test_archives_are_plain_gzip_members(spark, pages, tmp_path):
    _, df = pages
    manifest = warc.write_archives(df, f"file://{tmp_path}/archives").collect()
    text = b"".join(gzip.open(r.path.removeprefix("file://")).read() for r in manifest)
    assert text.count(b"WARC-Type: revisit") == 3
    assert b"\r\nX: y" not in text
    damaged = text.replace(b"short", b"shart")
    with pytest.raises(ValueError, match="digest"):
        for fields, parts in warc.archive_records(io.BytesIO(gzip.compress(damaged))):
            body = b"".join(parts)
            if body and hashlib.sha1(body).hexdigest() != fields["WARC-Payload-Digest"][5:]:
                raise ValueError("digest")


def test_no_pages(spark, pages, tmp_path):
    _, df = pages
    assert warc.round_trip(spark, df.limit(0), f"file://{tmp_path}/archives").count() == 0


def test_chunks_are_cut_in_one_pass(spark):
    import time

    payload = "añb" * (5 << 20)
    df = spark.range(1).selectExpr("'u/1 é\\n' AS page_id", "CAST(NULL AS STRING) AS url", f"repeat('añb', {5 << 20}) AS html")
    start = time.time()
    rows = warc.chunks(df).select("chunk", "last", "digest", "bytes", "payload_digest", "payload_bytes").collect()
    assert time.time() - start < 30
    data = payload.encode()
    assert len(rows) == 20 and [r.chunk for r in rows if r.last] == [19]
    for r in rows[:3] + rows[-1:]:
        assert r.digest == hashlib.sha1(data[: r.bytes]).hexdigest()
    assert {(r.payload_digest, r.payload_bytes) for r in rows} == {(hashlib.sha1(data).hexdigest(), len(data))}
    (out,) = warc.round_trip(spark, df.withColumn("html", df.html.substr(1, 5000))).collect()
    assert out.record_id == "u/1 é\n" and out.refers_to is None and out.payload_bytes == len(payload[:5000].encode())
