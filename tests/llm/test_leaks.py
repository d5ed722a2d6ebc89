import re
from collections import defaultdict

import regex

from labelloom.llm import leaks
from tests.llm import data


def plain_values(text, reading="capitalised"):
    """Plain version of the template rule."""
    text = text.translate({2: " ", 3: " ", 4: " ", 5: " "})
    if re.search("[0-9]", text):
        text = regex.sub(rf"(?<=[0-9])[ \t\n\x0b\f\r]?({leaks.UNITS})(?![\p{{L}}\p{{N}}])", " \x02\\1 ", text)
        text = re.sub(r"([$€£¥])(?=[ \t\n\x0b\f\r]?[0-9])", " \x02 ", text)
        text = re.sub(r"(?<=[0-9])[.,:/-](?=[0-9])", "\x05", text)
        text = re.sub("[0-9][0-9\x05]*", " \x03\\g<0> ", text)
    if reading == "beginnings":
        text = regex.sub(r"((?:^|[.?!][\"')]*[ \t\n\x0b\f\r]+)[\"'(]*)(\p{Ll}+)", "\\1\x04\\2", text)
    if reading == "within":
        text = regex.sub(r"(?<=[\p{L}\p{N},;] )(\p{Lu}\p{Ll}+)", "\x04\\1", text)
    elif reading != "none":
        text = regex.sub(r"(?<![\p{L}\p{N}])(\p{Lu}\p{Ll}+)", "\x04\\1", text)
    return regex.sub(r"[^\p{L}\p{N}\x02-\x05]+", " ", text.lower()).strip().split()


def plain_leaks(docs, items):
    """All (document, item) pairs by walking every diagonal."""
    sign = lambda w: w[0] if w[0] in "\x02\x03\x04" else w
    found = {}
    first = {}
    for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0])):
        for reading in leaks.READINGS:
            first.setdefault(tuple(plain_values(t or "", reading)), i)
    parsed = [(i, v) for v, i in first.items() if v]
    for d, text in docs:
        words = plain_values(text or "")
        places = defaultdict(list)
        for size in {min(8, len(v)) for _, v in parsed if len(v) >= 4}:
            for k in range(len(words) - size + 1):
                places[tuple(map(sign, words[k : k + size]))].append(k)
        for i, own in parsed:
            if len(own) < 4:
                if tuple(words) == own:
                    found[d, i] = max(found.get((d, i), (0, 0, 0)), (len(own), sum(w[0] in "\x02\x03\x04" for w in own), 0))
                continue
            size, shifts = min(8, len(own)), defaultdict(set)
            for k in range(len(own) - size + 1):
                for at in places.get(tuple(map(sign, own[k : k + size])), ()):
                    shifts[at - k].update(range(k, k + size))
            for shift, covered in shifts.items():
                if len(covered) < min(13, len(own)):
                    continue
                slots = [(own[k], words[k + shift]) for k in covered if own[k][0] in "\x02\x03\x04"]
                pairs = set(slots)
                changed = sum(a != b for a, b in slots)
                if len({a for a, _ in pairs}) != len(pairs) or len({b for _, b in pairs}) != len(pairs):
                    continue
                if len(covered) - len(slots) < 4 and changed:
                    continue
                best = (len(covered), len(slots), changed)
                if (d, i) not in found or (best[0], -best[2], -best[1]) > (found[d, i][0], -found[d, i][2], -found[d, i][1]):
                    found[d, i] = best
    return found


def as_dict(frame):
    return {(r.key, r.item): (r.n_words, r.n_slots, r.n_changed) for r in frame.collect()}


QUESTION = "A train leaves Berlin with 120 passengers and travels 300 km in 4 hours, how fast does Anna see the train going past?"
OTHER = "A train leaves Madrid with 85 passengers and travels 450 km in 6 hours, how fast does Carla see the train going past?"
MIXED = "First 7 of 9 apples go to the old man and then 7 more apples go to the young woman."
WRONG = "First 3 of 4 apples go to the old man and then 5 more apples go to the young woman."
RIGHT = "First 3 of 4 apples go to the old man and then 3 more apples go to the young woman."


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_parameters_and_slots(spark):
    docs = [
        (1, data.prose(40, 1) + " " + QUESTION + " " + data.prose(30, 2)),
        (2, "We ask: " + OTHER),
        (3, data.prose(100, 3)),
        (4, WRONG),
        (5, RIGHT),
        (6, "the small dog barks loudly today"),
        (7, "the small dog barks"),
        (8, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16"),
        (9, "5 5 5 5 5 5 5 5 5 5 5 5 5 5 5 5"),
    ]
    items = [(1, QUESTION), (2, MIXED), (3, "The small dog barks loudly!"), (4, "too short"), (5, None), (6, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16")]
    found = as_dict(leaks.find_leaks(*frames(spark, docs, items)))
    assert set(found) == {(1, 1), (2, 1), (5, 2), (6, 3), (8, 6)}
    assert found[2, 1][2] > 0 and found[1, 1][2] == 0
    assert found == plain_leaks(docs, items)


CAPITAL = "What is the capital city of the old northern river kingdom"
SKY = "Why is the sky blue at noon, explain it in short words"
TOM = "Tom has 3 apples. Tom buys 5 more at the shop. How many apples does Tom have at the end?"


def test_every_verbatim_copy_is_found(spark):
    items = [(1, CAPITAL), (2, SKY), (3, TOM), (4, "Name three primes"), (5, "the tall tower stands near a quiet harbour with nine small boats")]
    docs = [
        (10, f"we were asked {CAPITAL}"), (11, f"asked: {CAPITAL}"), (12, CAPITAL.lower()), (13, f"they said that {CAPITAL.lower()} was asked"),
        (20, f"the Old book said {SKY}"), (21, SKY.upper()),
        (30, TOM.replace("Tom", "Ann")), (31, TOM.replace("3", "7").replace("5", "2")), (32, TOM.lower()),
        (40, "Name three primes"), (41, "name three primes!"), (42, "We name three primes here"),
        (50, "The tall tower stands near a quiet harbour with nine small boats."),
        (60, data.prose(80, 4)), (61, None), (62, ""),
    ]
    found = as_dict(leaks.find_leaks(*frames(spark, docs, items)))
    assert set(found) == {(10, 1), (11, 1), (12, 1), (13, 1), (20, 2), (21, 2), (30, 3), (31, 3), (32, 3), (40, 4), (41, 4), (50, 5)}
    assert all(found[k][2] == 0 for k in found if k[0] not in (30, 31))
    assert found == plain_leaks(docs, items)


def test_query_equals_brute_force(spark, sf_dir):
    frame = leaks.op5_leaks(spark, sf_dir)
    found = {(r.doc_id, r.item_id): (r.n_words, r.n_slots, r.n_changed) for r in frame.collect()}
    items = [(r.item_id, r.text) for r in data.table(spark, sf_dir, "benchmark").collect()]
    assert found == plain_leaks(list(data.texts(spark, sf_dir).items()), items) and found
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_odd_inputs(spark):
    docs, items = data.odd(spark), spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (None, "no key here at")], "item_id long, text string")
    assert as_dict(leaks.find_leaks(docs, items)) == {(1, 1): (8, 1, 0)}  # the first word may be a name
    kept = leaks.drop_leaks(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 2, 3, 4, 5]
    assert leaks.find_leaks(data.empty(spark), items).count() == 0
    assert leaks.find_leaks(docs, items.limit(0)).count() == 0
    assert leaks.drop_leaks(docs, items.limit(0)).count() == docs.count()
