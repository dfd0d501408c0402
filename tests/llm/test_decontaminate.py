import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from locusframe.llm import decontaminate as D
from locusframe.llm.common import hash_filter

ITEM = "Tom Brown has 12 red apples and gives 5 apples to his sister before lunch. How many apples does Tom keep after 3 days?"
SECOND = "The river that crosses the old town carries melted snow from the northern hills every spring until late may."


@pytest.fixture
def benchmark(spark):
    rows = [(1, ITEM), (2, SECOND), (3, "too short"), (4, None), (5, ""), (None, "also one item without any id but with enough words")]
    return spark.createDataFrame(rows, "item_id long, text string")


def items_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "item_id long, text string")


# --- the same by hand -----------------------------------------------------------------


def tokens_of(text):
    """`(kind, folded)` of the words of a text."""
    out = []
    for word in (text or "").split():
        word = re.sub(r"^[^\w$€£%]+|[^\w%]+$|_+$", "", word)
        folded = word.casefold()
        if not folded:
            continue
        if re.search(r"\d", word) or folded in D.NUMBER_WORDS:
            kind = "number"
        elif len(word) > 1 and word[0].isupper() and word[1:].islower():
            kind = "name"
        else:
            kind = "word"
        if folded in D.UNITS and out and (out[-1][0] == "number" or out[-1][2]):
            # A unit follows a word that is a number by itself.
            kind = "unit" if out[-1][2] else kind
        out.append((kind, folded, bool(re.search(r"\d", word)) or folded in D.NUMBER_WORDS))
    return [(kind, folded) for kind, folded, _ in out]


def windows_of(tokens, size):
    """`{reading: {place: window}}` of the windows that may count."""
    out = {0: {}, 1: {}, 2: {}}
    for place in range(len(tokens) - size + 1):
        part = tokens[place : place + size]
        words = sum(k == "word" for k, _ in part)
        names = sum(k == "name" for k, _ in part)
        if 8 * words >= 3 * size:
            out[0][place] = tuple(v if k == "word" else f"<{k}>" for k, v in part)
        if 8 * (words + names) >= 3 * size:
            out[1][place] = tuple(f"<{k}>" if k in ("number", "unit") else v for k, v in part)
        out[2][place] = tuple(v for _, v in part)
    return out


def shape_of(tokens):
    seen = {}
    return tuple(v if k == "word" else (k, seen.setdefault((k, v), len(seen))) for k, v in tokens)


def found_at(item, text, offset):
    """Tokens of the item found at an offset, and how many of them have another value."""
    size = min(8, len(item))
    mine, theirs = windows_of(item, size), windows_of(text, size)
    starts = sorted({p for r in mine for p, w in mine[r].items() if theirs[r].get(p + offset) == w})
    met = defaultdict(Counter)
    for place in {p for s in starts for p in range(s, s + size)}:
        if item[place][0] != "word":
            met[item[place]][text[place + offset][1]] += 1
    kept = set()
    for start in starts:
        good, here = True, {}
        for place in range(start, start + size):
            key, value = item[place], text[place + offset][1]
            if key[0] == "word" or len(met[key]) == 1:
                continue
            others = Counter({v: n for v, n in met[key].items() if v != key[1]})
            top = max(others.values())
            best = [v for v, n in others.items() if n == top]
            exchanged = best[0] if top > 1 and len(best) == 1 else None
            good = good and value in (key[1], exchanged) and here.setdefault(key, value) == value
        if good:
            kept |= set(range(start, start + size))
    return kept, sum(item[p][0] != "word" and text[p + offset][1] != item[p][1] for p in kept)


def brute(docs, items, frequent=D.FREQUENT):
    order = lambda i: (i is not None, i or 0)
    entries = {}
    for key, text in items:
        tokens = tuple(tokens_of(text))
        if len(tokens) >= 4:
            known = entries.get(tokens)
            entries[tokens] = key if known is None else known if key is None else min(known, key)
    families = {}
    for tokens, key in entries.items():
        shape = shape_of(tokens)
        if shape not in families or order(key) < order(entries[families[shape]]):
            families[shape] = tokens
    carried, holders = {}, defaultdict(set)
    for tokens in entries:
        made = windows_of(tokens, min(8, len(tokens)))
        readings = made if families[shape_of(tokens)] == tokens else {2: made[2]}
        carried[tokens] = [(r, w, p) for r in readings for p, w in made[r].items()]
        for r, w, _ in carried[tokens]:
            holders[r, w].add(tokens)
    for tokens, windows in carried.items():
        rarest = min(len(holders[r, w]) for r, w, _ in windows)
        carried[tokens] = [x for x in windows if len(holders[x[:2]]) <= max(frequent, rarest)]
    rows = set()
    for doc, text in docs:
        tokens = tokens_of(text)
        for entry, item in entries.items():
            made = windows_of(tokens, min(8, len(entry)))
            at = defaultdict(list)
            for r in made:
                for p, w in made[r].items():
                    at[r, w].append(p)
            offsets = {p - place for r, w, place in carried[entry] for p in at[r, w]}
            whole, run, changed = set(), 0, 0
            for offset in offsets:
                kept, other = found_at(list(entry), tokens, offset)
                whole |= kept
                changed += other
                now = 0
                for place in range(len(entry) + 1):
                    now = now + 1 if place in kept else 0
                    run = max(run, now)
            if 2 * len(whole) >= len(entry) or run >= 20:
                rows.add((doc, item, round(len(whole) / len(entry), 9), run, changed))
    return rows


def rows_of(df):
    return {(r.id, r.item_id, round(r.coverage, 9), r.run, r.changed_slots) for r in df.collect()}


@pytest.mark.parametrize("seed", range(3))
def test_leaks_equal_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    words = "has gives the of and to how many red apples keeps after before lunch town".split()
    slots = ["Tom", "Ann", "Bob", "12", "7", "3", "five", "km", "days", "Town", "-", "(the)", "x9"]
    def text(n, share):
        return " ".join(rng.choice(words) if rng.random() < share else rng.choice(slots) for _ in range(n))
    pool = [text(rng.randrange(2, 40), rng.choice([0.2, 0.6, 0.9])) for _ in range(25)]
    def exchanged(t):
        values = {w: rng.choice(slots) for w in slots}
        return " ".join(values.get(w, w) if rng.random() < 0.95 else w for w in t.split())
    items = [(i, t) for i, t in enumerate(pool)]
    items += [(100 + i, exchanged(rng.choice(pool))) for i in range(12)] + [(200, pool[0]), (None, text(12, 0.8)), (300, None)]
    docs = [(i, f"{text(rng.randrange(12), 0.7)} {exchanged(rng.choice(pool))} {text(rng.randrange(9), 0.7)}") for i in range(40)]
    docs += [(50 + i, " ".join(rng.choice(pool).split()[rng.randrange(6) :])) for i in range(30)] + [(90, None), (91, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for frequent in (1, D.FREQUENT):
        expected = brute(docs, items, frequent)
        assert len(expected) > 20
        assert rows_of(D.leaks(documents(docs).repartition(4), benchmark, frequent=frequent)) == expected


# --- cases ----------------------------------------------------------------------------


def test_leaks_of_all_kinds(documents, benchmark):
    changed = ITEM.replace("Tom", "Ann").replace("12", "40").replace("5", "7").replace("3 days", "9 hours").replace("Brown", "White")
    mixed = ITEM.replace("How many apples does Tom", "How many apples does Ann").replace("12 red", "30 red")
    half = " ".join(SECOND.split()[:12])
    texts = [None, "", ITEM, f"before {ITEM} after", f"before {changed} after", ITEM.upper(), mixed, half, " ".join(SECOND.split()[:7]),
             "Words that have nothing to do with any question in the set, 12 of them and Tom.",
             "x " * 5000 + SECOND, f"{ITEM} {SECOND}"]
    rows = D.leaks(documents(list(enumerate(texts))), benchmark).collect()
    found = {(r.id, r.item_id) for r in rows}
    assert found >= {(2, 1), (3, 1), (4, 1), (5, 1), (7, 2), (10, 2), (11, 1), (11, 2)}
    assert not {i for i, _ in found} & {0, 1, 8, 9}
    by_id = {(r.id, r.item_id): r for r in rows}
    assert by_id[2, 1].changed_slots == 0 and by_id[4, 1].changed_slots > 4
    assert by_id[10, 2].first_token == 5000


def test_slots_that_disagree_do_not_count(documents, spark):
    item = "alpha 1 beta 2 gamma 1 delta 2 epsilon 1 zeta 2 eta 1 theta 2 iota 1 kappa"
    one = spark.createDataFrame([(1, item)], "item_id long, text string")
    same = item.replace("1", "7").replace("2", "8")
    random_slots = "alpha 1 beta 3 gamma 4 delta 5 epsilon 6 zeta 7 eta 8 theta 9 iota 3 kappa"
    rows = D.leaks(documents([(1, same), (2, random_slots)]), one).collect()
    assert [r.id for r in rows] == [1]


def test_one_disagreeing_slot_drops_only_its_windows(documents, benchmark, spark):
    once = ITEM.replace("does Tom", "does Ann")
    mixed = once.replace("12 red", "30 red")
    opener = "The " + SECOND.split(" ", 1)[1].replace("river", "stream") + " The bridge that spans it was built of grey stone by men who lived far away."
    other = opener.replace("The bridge", "One bridge")
    rows = D.leaks(documents([(1, once), (2, mixed)]), benchmark).collect()
    by_id = {r.id: r for r in rows}
    assert set(by_id) == {1, 2}
    # The eight windows with the second name are lost, and the five tokens only they have.
    assert by_id[1].coverage == 19 / 24 and by_id[1].changed_slots == 0
    assert by_id[2].changed_slots == 1
    one = spark.createDataFrame([(1, opener)], "item_id long, text string")
    assert [r.id for r in D.leaks(documents([(1, other)]), one).collect()] == [1]
    # A value exchanged twice and once by another: the windows of the odd one are lost.
    item = " ".join(f"Tom {' '.join(f'w{i}{c}' for c in 'abcdefghi')}".replace("w", "v").replace("0", "o").replace("1", "i").replace("2", "z") for i in range(3))
    copy = item.replace("Tom", "Ann", 2).replace("Tom", "Bob")
    one = spark.createDataFrame([(1, item)], "item_id long, text string")
    (row,) = D.leaks(documents([(1, copy)]), one).collect()
    assert row.coverage > 0.9 and row.changed_slots == 2


def test_edge_rows(spark, documents, benchmark):
    docs = documents([(1, ITEM), (2, SECOND), (2, SECOND), (None, SECOND), (3, "nothing")], "item_id long, entry string")
    # Rows that repeat an id and a text are one document.
    assert sorted((str(r.id), r.item_id) for r in D.leaks(docs, benchmark).collect()) == [("1", 1), ("2", 2), ("None", 2)]
    assert D.leaks(docs, benchmark.limit(0)).count() == 0
    assert D.leaks(documents([]), benchmark).count() == 0
    twice = benchmark.union(benchmark).selectExpr("*", "1 AS id", "2 AS window", "'x' AS literal")
    assert D.leaks(docs, twice).count() == 3
    named = spark.createDataFrame([("doc é", ITEM), (None, "x")], "doc_id string, text string")
    items = spark.createDataFrame([("q/1", ITEM)], "item_id string, text string")
    assert [(r.id, r.item_id) for r in D.leaks(named, items).collect()] == [("doc é", "q/1")]
    short = {(r.item, r.tokens) for r in D.unsearched_items(benchmark).collect()}
    assert short == {(3, 2), (4, 0), (5, 0)}


def test_long_texts(documents, benchmark):
    texts = [(1, "word " * 1_200_000 + SECOND + " word" * 1000), (2, ("filler " * 3 + ITEM + " ") * 2000)]
    rows = {(r.id, r.item_id): r for r in D.leaks(documents(texts), benchmark).collect()}
    assert set(rows) == {(1, 2), (2, 1)}
    assert rows[1, 2].first_token == 1_200_000 and rows[2, 1].coverage == 1.0


def test_tables_of_numbers_and_names_do_not_leak(spark, documents):
    rng = random.Random(4)
    rows = "Name Age City Tom 12 Paris Ann 13 Rome Bob 14 Oslo Eva 15 Bern"
    numbers = [" ".join(str(rng.randrange(10_000)) for _ in range(30)) for _ in range(200)]
    table = " ".join(str(rng.randrange(10_000)) for _ in range(400))
    docs = documents([(1, "Ulf 77 Kiel Ida 78 Lyon Max 79 Nice Leo 80 Cork Amy 81 Bath"), (2, table), (3, f"see {numbers[57]} here"), (4, rows)])
    found = D.leaks(docs, items_of(spark, rows, *numbers)).collect()
    # Literal copies are found, layouts are not.
    assert {(r.id, r.item_id) for r in found} == {(3, 59), (4, 1)}


def test_a_family_of_questions_is_searched_once(spark, documents):
    """300 items that differ in their values: a new instance is found, and a known one literally."""
    make = lambda a, b, name: f"{name} buys {a} pencils and gives {b} of them to a friend at school, how many are left"
    items = [make(10 + i, 1000 + i, "Tom") for i in range(300)]
    found = D.leaks(documents([(1, make(9999, 8888, "Zoe")), (2, f"so {items[200]} is asked")]), items_of(spark, *items)).collect()
    assert {(r.id, r.item_id, r.changed_slots > 0) for r in found} == {(1, 1, True), (2, 1, True), (2, 201, False)}


def test_the_filter_holds_what_it_was_given(spark):
    rng = random.Random(7)
    windows = [rng.randrange(-(2**63), 2**63) for _ in range(3000)]
    rows = spark.createDataFrame([(w,) for w in windows], "window long")
    for most in (8, 16, 28):
        made = hash_filter(rows, most)
        assert made.words.nbytes == 1 << (made.bits - 3) and made.bits <= most
        assert all(w % 2**64 in made for w in windows)
    others = [rng.randrange(2**64) for _ in range(10_000)]
    assert sum(w in made for w in others) < 50


def test_a_small_filter_changes_no_result(spark, documents, benchmark):
    docs = documents([(1, ITEM), (2, f"a {SECOND} b"), (3, "nothing of it at all but enough words to make windows")])
    assert rows_of(D.leaks(docs, benchmark, most_bits=6)) == rows_of(D.leaks(docs, benchmark)) != set()


def test_alignments_take_linear_time():
    words = D._Words()
    rng = random.Random(2)
    table = D.Template.of(" ".join(str(rng.randrange(10)) for _ in range(400)), words)
    start = time.process_time()
    for size in (8, 30):
        assert [len(p) for p, _ in table.windows(size)][:2] == [0, 0]
    item = D.Template.of(ITEM, words)
    for offset in range(-20, 400):
        D.aligned(item, table, offset)
    assert time.process_time() - start < 1


def test_frequent_windows_leave_no_leak_out(spark, documents):
    """100 items share their first 25 words: a document with these alone has leaked all of them."""
    shared = " ".join(f"word{c}{d}" for c in "abcde" for d in "vwxyz")
    items = [f"{shared} {' '.join(f'own{a}{chr(97 + i // 26)}{chr(97 + i % 26)}' for a in 'abcdefghijk')}" for i in range(100)]
    found = D.leaks(documents([(1, shared), (2, f"so {items[7]}"), (3, " ".join(shared.split()[:10]))]), items_of(spark, *items)).collect()
    assert {(r.id, r.item_id, r.run) for r in found} == {(d, i, 36 if (d, i) == (2, 8) else 25) for d in (1, 2) for i in range(1, 101)}


@pytest.mark.parametrize("seed", range(2))
def test_leaks_of_frequent_windows_equal_brute_force(spark, documents, monkeypatch, seed):
    """With every shared window frequent, the rows are those of all windows."""
    rng = random.Random(seed)
    words = [a + b for a in "bdfgk" for b in ("al", "er", "in", "ot", "un", "esh")]
    blocks = [" ".join(rng.choice(words) for _ in range(rng.randrange(9, 16))) for _ in range(4)]
    items = [(i, " ".join(rng.choice(blocks) for _ in range(3)) + f" {rng.choice(words)} {rng.choice(words)}") for i in range(20)]
    docs = [(i, f"{rng.choice(blocks)} {rng.choice(words)} {rng.choice(blocks)} and so {rng.choice(blocks)}") for i in range(25)]
    docs += [(50 + i, blocks[i]) for i in range(4)]
    expected = brute(docs, items, 1000)
    assert brute(docs, items, 1) < expected
    monkeypatch.setattr(D, "FREQUENT", 1)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(D.leaks(documents(docs).repartition(4), benchmark)) == expected


def test_windows_carry_until_the_rest_cannot_leak():
    # Ten places of windows in seventeen tokens, each with its own number of entries.
    limit = D.carrying_limit(17, np.arange(10), np.array([1, 900, 800, 700, 1, 1, 1, 1, 1, 1]))
    # Two windows cover nine tokens, more than half; one alone does not.
    assert limit == 800
    assert D.carrying_limit(17, np.arange(10), np.full(10, 5)) == D.FREQUENT
    assert D.carrying_limit(60, np.arange(53), np.array([99] * 12 + [1] * 41)) == D.FREQUENT
    assert D.carrying_limit(60, np.arange(53), np.array([99] * 13 + [1] * 40)) == 99
