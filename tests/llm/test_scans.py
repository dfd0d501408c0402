import base64
import hashlib
import json
import random
import re

from locusframe.llm import license_scan, secret_scan

# --- secrets --------------------------------------------------------------------------


def brute_base(text):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    ascii_only = "(?ia:" + pattern + ")"
    found += [(m.start(), 0, m.end()) for m in re.finditer(ascii_only, text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_equal_brute_force(documents):
    rng = random.Random(1)
    bits = ["password", "Token", "secret=", "api_key: ", "apikey='", "AKIA", "ABCDEFGHIJKLMNOP2", "0af1" * 7, "abc", " ", "\n",
            "=", ":", "é", "ſecret=abcdefgh", "toKen=xyzxyz", "passwd = ", "token=token: abcdefgh", '"']
    texts = [None, "", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(400))]
    rows = secret_scan.scan(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert row.base_text == brute_base(texts[row.id] or "")
        for s in row.spans:
            assert texts[row.id][s.start : s.end] == s.secret


def der(tag, *parts):
    body = b"".join(parts)
    size = len(body)
    head = bytes([size]) if size < 128 else (lambda n: bytes([0x80 | len(n)]) + n)(size.to_bytes((size.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + head + body


RSA = der(0x30, der(2, b"\0"), *(der(2, b"\x01" * 40) for _ in range(8)))
PKCS8 = der(0x30, der(2, b"\0"), der(0x30, der(6, bytes.fromhex("2b6570"))), der(4, der(4, b"k" * 32)))


def test_key_structures_are_confirmed():
    assert secret_scan.is_der_key(RSA) and secret_scan.is_der_key(PKCS8)
    assert not secret_scan.is_der_key(RSA[:-1])
    assert not secret_scan.is_der_key(RSA[:5] + b"\xff" + RSA[6:])
    assert not secret_scan.is_der_key(der(0x30, der(6, b"abc"), der(2, b"1")))
    field = lambda b: len(b).to_bytes(4, "big") + b
    key = secret_scan.OPENSSH_MAGIC + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 90)
    assert secret_scan.is_openssh_key(key) and not secret_scan.is_openssh_key(key[:-1])


def test_confirmed_spans(documents):
    part = lambda value: base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl"
    fake = f"{part({'a': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'a'})}.c2lnbmF0dXJl"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(RSA).decode()}-----END RSA PRIVATE KEY-----"
    bad = f"-----BEGIN RSA PRIVATE KEY-----\n{base64.encodebytes(RSA[:-9]).decode()}-----END RSA PRIVATE KEY-----"
    texts = [f"é {token} x", f"é {fake} x", f"a {pem} b", f"a {bad} b", f"key {base64.b64encode(PKCS8).decode()}", f"é{RSA.hex().upper()}"]
    kinds = [[s.kind for s in r.spans] for r in secret_scan.scan(documents(list(enumerate(texts)))).orderBy("id").collect()]
    assert kinds == [["token"], [], ["pem"], [], ["der"], ["hex", "der"]]
    assert secret_scan.digest("") == hashlib.sha256(b"").hexdigest()


def test_keys_behind_breaks_escapes_and_encodings():
    field = lambda b: len(b).to_bytes(4, "big") + b
    ssh = secret_scan.OPENSSH_MAGIC + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"p" * 51) + field(b"s" * 90)
    wrapped = base64.encodebytes(RSA).decode()
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{wrapped}-----END RSA PRIVATE KEY-----\n"
    plain = base64.b64encode(RSA).decode()
    kinds = lambda text: [k for _, _, k in secret_scan.confirmed_spans(text)]
    assert kinds(json.dumps({"private_key": pem})) == ["pem"]
    assert kinds(json.dumps(json.dumps({"private_key": pem}))) == ["pem"]
    assert kinds(json.dumps({"key": "\n" + wrapped})) == ["der"]
    assert kinds(f"key:\n{wrapped}") == kinds(f"abcdefghijklmnopq{plain}") == ["der"]
    for before in ("", "#", "##"):
        assert kinds("tls.key: " + base64.b64encode((before + pem).encode()).decode()) == ["pem"]
    assert kinds("x " + ssh.hex().upper()) == ["openssh"]
    assert kinds(f"key:\n{base64.encodebytes(RSA[:-9]).decode()}") == kinds(base64.b64encode(pem.replace("M", "N").encode()).decode()) == []
    text = f"a {plain} b"
    assert [text[a:b] for a, b, _ in secret_scan.confirmed_spans(text)] == [plain]


# --- licenses -------------------------------------------------------------------------


def licenses_of(text, templates):
    return {r[0] for a, b in license_scan.regions(text) for r in templates.found(text[a:b])}


def brute_licenses(text, templates):
    """Every template against the words from every word of the text on, without regions and pairs."""
    words = license_scan.words_of(text)
    return {name for name, _, template in templates.templates if templates.best(words, template)}


def test_every_template_finds_itself_and_its_neighbours_do_not():
    templates = license_scan.Templates()
    for name, text, _ in templates.templates:
        for place in (text, f"Some words before.\n{text}\nAnd after.", re.sub(r"((?:\S+ ){5})", r"\1\n * ", text)):
            assert name in licenses_of(place, templates), name
    assert licenses_of("Licensed under the Apache License, Version 3.0.", templates) == set()


def test_licenses_equal_brute_force():
    """Notices with dropped, added and exchanged words, between other sentences."""
    templates, rng = license_scan.Templates(), random.Random(6)
    others = ["Copyright (c) 2019 Some Body.", "The plate was red.", "No licence is needed for a dog.", "Version 3.0 came in 2011.",
              "All rights are reserved.", "Permission was granted to the public.", "This is free software."]
    found = 0
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(templates.templates)[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = rng.choice([[], ["the"], [words[at]], ["license"]])
            parts += [rng.choice(others) for _ in range(rng.randrange(4))] + [" ".join(words)]
        text = "\n".join(parts)
        got, expected = licenses_of(text, templates), brute_licenses(text, templates)
        assert got == expected, (text, got, expected)
        found += len(got)
    assert found > 100


def test_a_license_behind_any_number_of_lines_is_found():
    templates = license_scan.Templates()
    for name in ("MIT", "BSD", "ISC", "Zlib"):
        text = max((t for n, t, _ in templates.templates if n == name), key=len)
        for lines in [*range(0, 200, 23), *range(100, 140)] if name == "MIT" else [0, 117, 400]:
            head = "".join(f"Copyright (c) {1900 + i} Holder Number {i}. All rights reserved.\n" for i in range(lines))
            wrapped = re.sub(r"(.{60,75}) ", r"\1\n", text)
            assert name in licenses_of(f"{head}{wrapped}\n{head}", templates), (name, lines)


def test_license_rows(documents):
    mit = license_scan.TEMPLATES[3][1].rstrip(".")
    texts = [None, "", "no word of it", f"Intro here.\nCopyright (c) 2020 A. Author\n\n{mit}\nmore",
             "é first. All rights reserved. last", "The license plate was stolen.",
             "Released under the MIT License.\nAll rights reserved."]
    rows = license_scan.scan(documents(list(enumerate(texts)))).collect()
    assert sorted((r.id, r.license) for r in rows) == [(3, "MIT"), (4, "proprietary"), (6, "MIT"), (6, "proprietary")]
    for r in rows:
        assert texts[r.id][r.start : r.end] == r.block
    assert license_scan.scan(documents([])).count() == 0


def test_long_runs_take_linear_time():
    import time

    start = time.process_time()
    for text in ("-----BEGIN RSA PRIVATE KEY-----\n" * 20_000, "M" * 2_000_000, "30" * 500_000, "token=" * 200_000, "eyJ" * 300_000):
        secret_scan.spans(text)
    for text in ("copyright " * 50_000, "All rights reserved. " * 5_000, "license\n" * 5_000):
        templates = license_scan.Templates()
        for a, b in license_scan.regions(text):
            templates.found(text[a:b])
    assert time.process_time() - start < 120
