import random
import re
from collections import Counter, defaultdict

import pytest

from locusframe.llm import line_dedup, quality_rules

SPACE = " \t\n\x0b\f\r"


def words_of(text):
    return [w for w in re.split(f"[{SPACE}]+", text or "") if w]


def repeat_words(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def random_texts(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        pool = [rng.choice(["a", "bb", "Ccc", "é", "#x", "|", "DD"]) for _ in range(rng.randint(1, 6))]
        yield "".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\n\n"]) for _ in range(rng.randint(0, 60)))


def test_measurements_equal_brute_force(documents):
    texts = [None, "", "  \n ", "w " * 9, "one line\none line\n one line", *random_texts(1, 60), "ab cd ef gh " * 3000]
    rows = quality_rules.ledger(documents(list(enumerate(texts)))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        text = texts[row.doc_id] or ""
        words, m = words_of(text), row.measures
        lines = [x for x in text.split("\n") if words_of(x)]
        assert m.n_words == len(words)
        assert m.word_chars == sum(map(len, words))
        assert m.n_repeat_words == repeat_words(words)
        assert m.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert m.n_dup_lines == len(lines) - len(set(lines))
        assert m.n_stutter == sum(a == b for a, b in zip(words, words[1:]))
        assert bool(row.failed & 1) == (len(words) < 20)


def test_ledger_replaces_clashing_columns_and_keeps_others(documents):
    df = quality_rules.ledger(documents([(1, "x"), (1, "x"), (None, None)]))
    assert dict(df.dtypes)["failed"] == "int"
    assert df.count() == 3
    assert quality_rules.ledger(documents([])).count() == 0


def test_ablation_counts_by_bits(spark):
    judged = spark.createDataFrame([(0,), (1,), (3,), (2,), (2,)], "failed int")
    rows = {r.rule: r for r in quality_rules.ablation(judged, 1).collect()}
    assert (rows["too_few_words"].failing, rows["too_few_words"].only_by_it) == (2, 1)
    assert rows["repeated_windows"].failing == 3
    assert rows["repeated_windows"].kept_without_it == 3
    assert judged.where(quality_rules.passes(judged["failed"], 1)).count() == 1


def brute_runs(docs, least):
    """Words to delete of `(order, text)`: those of windows that occur at an earlier place."""
    units = {key: words_of(text) for key, text in docs}
    first = {}
    for key in sorted(units):
        for i in range(len(units[key]) - least + 1):
            first.setdefault(tuple(units[key][i : i + least]), (key, i))
    gone = {key: set() for key in units}
    for key, words in units.items():
        for i in range(len(words) - least + 1):
            other, at = first[tuple(words[i : i + least])]
            if (other, at) < (key, i):
                # A run that repeats itself overlaps its first place, whose words stay.
                begin = max(i, at + least) if other == key else i
                gone[key] |= set(range(begin, i + least))
    return gone


def without(text, gone):
    """A text without some words and the white space before them."""
    parts = re.findall(r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", text)
    tail = text[sum(map(len, parts)) :]
    return "".join(p for i, p in enumerate(parts) if i not in gone) + tail


def check_runs(documents, docs, least):
    rows = line_dedup.dedup_lines(documents(list(docs.items())).repartition(3), min_words=least).collect()
    assert len(rows) == len(docs)
    gone = brute_runs(docs.items(), least)
    for row in rows:
        key = row.doc_id
        assert row.text == without(docs[key], gone[key]), (key, docs[key])
        assert row.removed_words == len(gone[key])
        assert row.removed_runs == sum(i - 1 not in gone[key] for i in gone[key])
    return sum(map(len, gone.values()))


@pytest.mark.parametrize("seed", range(4))
def test_line_dedup_equals_brute_force(documents, seed):
    """Word runs across and inside lines, of few words and of few different ones."""
    rng = random.Random(seed)
    letters = "abcdefgh"[: 2 + 2 * seed]
    space = lambda: rng.choice([" ", " ", "\n", "  ", "\t\n", "\x0b"])
    pool = [[rng.choice(letters) + str(rng.randrange(1 + 40 * seed)) for _ in range(rng.randrange(3, 25))] for _ in range(8)]
    def text():
        words = []
        for _ in range(rng.randrange(6)):
            part = rng.choice(pool)
            a = rng.randrange(len(part))
            words += part[a : a + rng.randrange(1, 20)] if rng.random() < 0.7 else [rng.choice(letters)]
        return rng.choice(["", " ", "\n"]) + "".join(w + space() for w in words)
    docs = {i: text() for i in range(60)}
    for least in (2, 6, 11):
        assert check_runs(documents, docs, least) > 20


def test_runs_that_repeat_themselves(documents):
    docs = {1: "a " * 300, 2: "a b " * 150, 3: "x " * 20 + "a b " * 40, 4: "a " * 301, 5: "a b c " * 30 + "q " + "a b c " * 40}
    assert check_runs(documents, docs, 50) > 700
    assert check_runs(documents, docs, 3) > 900


def numbered(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_passages_inside_and_across_lines(documents):
    """Sixty shared words inside one line, and sixty of which 36 are whole lines."""
    inside, across = numbered("p", 60), numbered("q", 60).split()
    broken = "\n".join(" ".join(across[i : i + 12]) for i in range(0, 60, 12))
    docs = {
        1: f"{numbered('a', 30)} {inside} {numbered('b', 30)}",
        2: f"{numbered('c', 20)} {inside} {numbered('d', 20)}",
        3: f"{numbered('e', 9)} {broken} {numbered('f', 9)}",
        4: f"{numbered('g', 5)} {broken} {numbered('h', 5)}",
        5: f"{numbered('i', 5)}\n{' '.join(across[:49])}\n{numbered('j', 5)}",
    }
    assert check_runs(documents, docs, 50) == 120


def test_a_passage_in_many_documents_is_kept_once(documents):
    passage = numbered("p", 55)
    docs = {i: f"{numbered(f'a{i}x', 60)}\n{passage}\n{numbered(f'b{i}x', 60)}" for i in range(400)}
    rows = line_dedup.dedup_lines(documents(list(docs.items()))).collect()
    assert sorted(r.doc_id for r in rows if passage in r.text) == [0]
    assert all(r.removed_words == 55 and r.removed_runs == 1 for r in rows if r.doc_id)


def test_line_dedup_edge_rows(spark, documents):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(2, long), (1, long), (1, long), (None, long), (None, None), (3, ""), (4, f"head\n{long}\ntail"), (5, "short"), (6, " \n ")]
    docs = documents(rows, "removed_words long, start string")
    out = line_dedup.dedup_lines(docs).collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out), key=str)
    assert len(out) == len(rows)
    assert (False, 1, long) in got and got.count((False, 1, long)) == 2  # one document, given twice
    assert (False, 2, "") in got and (True, 0, "") in got and (True, 0, None) in got
    assert (False, 4, "head\ntail") in got and (False, 5, "short") in got and (False, 6, " \n ") in got
    assert out[0].start == "x" and {r.doc_id: r.removed_words for r in out}[4] == 60
    assert line_dedup.dedup_lines(documents([])).count() == 0
    named = spark.createDataFrame([("b", long), ("a", long), (None, long)], "doc_id string, text string")
    assert {r.doc_id: r.removed_words for r in line_dedup.dedup_lines(named).collect()} == {"a": 0, "b": 60, None: 60}


def test_line_dedup_of_a_very_long_text(documents):
    half = numbered("w", 250_000)
    out = line_dedup.dedup_lines(documents([(1, f"{half}\nmiddle\n{half}"), (2, f"x {half[:4000]}")])).collect()
    by_id = {r.doc_id: r for r in out}
    assert by_id[1].text == f"{half}\nmiddle" and by_id[1].removed_words == 250_000
    assert by_id[2].text.split()[0] == "x" and len(by_id[2].text.split()) <= 2


def test_hashes_do_not_depend_on_batches_and_parts(monkeypatch):
    """The windows of texts are the same alone, together and cut into parts."""
    import pyarrow as pa

    rng = random.Random(3)
    texts = ["", " \n", "few words", *(" ".join(rng.choice("ab cd efg h éé".split()) for _ in range(n)) for n in (49, 50, 51, 400, 3000))]

    def windows(texts):
        out = {}
        for made in line_dedup.winnowed(pa.array(texts), 50):
            for row in zip(made.document.tolist(), made.start.tolist(), made.hash.tolist(), made.least.tolist()):
                out[row[:2]] = row[2:]
        return out

    whole = windows(texts)
    assert len(whole) == 1 + 2 + 351 + 2951
    for i, text in enumerate(texts):
        assert {(i, s): v for (_, s), v in windows([text]).items()} == {k: v for k, v in whole.items() if k[0] == i}
    for size in (1, 30, 700):
        monkeypatch.setattr(line_dedup, "PIECE_BYTES", size)
        assert windows(texts) == whole
    words = texts[-1].split()
    equal = defaultdict(set)
    for (document, start), value in whole.items():
        if document == len(texts) - 1:
            equal[value[0]].add(tuple(words[start : start + 50]))
    assert all(len(v) == 1 for v in equal.values())


def test_line_dedup_runs_no_python_on_executors(documents, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    docs = documents([(i, f"{numbered('p', 60)} {numbered(f'a{i}x', 9)}") for i in range(3)])
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(docs), name, refuse)
    found = line_dedup.dedup_lines(docs)
    assert {r.doc_id: r.removed_words for r in found.collect()} == {0: 0, 1: 60, 2: 60}
    texts = docs.select(*line_dedup._identity(docs, "doc_id", "text"), "text")
    plan = line_dedup.window_groups(texts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_every_window_lies_in_one_group(documents):
    """Groups of one `whole` have the same windows, and equal windows one fingerprint."""
    import pyarrow as pa

    rng = random.Random(5)
    texts = [" ".join(rng.choice(kind) + str(rng.randrange(n)) for _ in range(size)) for kind, n, size in
             (("ab", 1, 200), ("abc", 2, 300), ("xyz", 90, 400), ("q", 1, 50), ("q", 1, 49), ("xyz", 900, 120))]
    texts += [texts[2][300:1500], f" {texts[2]}\n"]
    docs = documents(list(enumerate(texts)))
    rows = line_dedup.window_groups(docs.select(*line_dedup._identity(docs, "doc_id", "text"), "text")).collect()
    windows = {}
    for made in line_dedup.winnowed(pa.array(texts), 50):
        windows.update(zip(zip(made.document.tolist(), made.start.tolist()), made.hash.tolist()))
    places = [(r["rank"], r.start + i) for r in rows for i in range(r.windows)]
    assert sorted(places) == sorted(windows)
    contents, prints = defaultdict(set), defaultdict(set)
    for r in rows:
        held = tuple(windows[r["rank"], r.start + i] for i in range(r.windows))
        contents[r.whole].add(held)
        for window in held:
            prints[window].add(r.fingerprint)
    assert all(len(v) == 1 for v in (*contents.values(), *prints.values()))
    assert len(contents) < len(rows) and max(map(len, (h for v in contents.values() for h in v))) > 5


def test_native_plans_have_no_python(documents):
    for df in (quality_rules.ledger(documents([(1, "x")])),):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
