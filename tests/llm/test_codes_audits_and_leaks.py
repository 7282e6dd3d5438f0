"""Vector codes, filter audits and decontamination against plain versions of what they have to return, and their odd cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pageloom.llm import decontamination, filter_audit, vector_codes

CODES = ["id", "code", "error", "label_error"]


def brute_codes(rows, n_parts, n_entries, rounds):
    """{id: (code, error)}, by exact whole numbers and full search, and the digest of the codebooks."""
    kept = sorted((r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    whole = [[math.floor(256 * x) if abs(x) < 1e300 else (256 * x.as_integer_ratio()[0]) // x.as_integer_ratio()[1] for x in r[2]] for r in kept]
    width = len(whole[0]) // n_parts
    parts = [[tuple(w[p * width : (p + 1) * width]) for w in whole] for p in range(n_parts)]
    books = [list(own[:n_entries]) for own in parts]
    near = lambda own, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(own, book[e], strict=True)), e))
    for _ in range(rounds):
        for own, book in zip(parts, books, strict=True):
            held = defaultdict(list)
            for x in own:
                held[near(x, book)].append(x)
            for e, xs in held.items():
                book[e] = tuple(sum(c) // len(xs) for c in zip(*xs, strict=True))
    out = []
    for k, r in enumerate(kept):
        chosen = [near(own[k], book) for own, book in zip(parts, books, strict=True)]
        error = sum((a - b) ** 2 for own, book, e in zip(parts, books, chosen, strict=True) for a, b in zip(own[k], book[e], strict=True))
        out.append((r[0], r[1], "".join(f"{e:02x}" for e in chosen), min(error, (1 << 63) - 1)))
    return out, hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-4, 4), st.integers(-4, 4)), min_size=1, max_size=80), st.lists(st.tuples(st.integers(-9, 9), st.integers(-9, 9)), min_size=1, max_size=30), st.sampled_from([1, 1 << 40]))
def test_tree_search_keeps_lower_indexes(entries, points, scale):
    entries, points = np.array(entries, np.int64) * scale, np.array(points, np.int64) * scale
    index, distance = vector_codes.nearest(vector_codes.tree_of(entries), points)
    for k, p in enumerate(points.tolist()):
        every = [sum((a - b) ** 2 for a, b in zip(p, e, strict=True)) for e in entries.tolist()]
        assert distance[k] == min(every) and index[k] == every.index(min(every))


def test_vector_codes(spark):
    rng = np.random.default_rng(4)
    rows = [(k, k % 3 if k % 4 else None, [float(np.float32(x)) for x in rng.normal(size=8) * (k % 5)]) for k in range(60)]
    rows += [(3, 1, rows[7][2]), (3, 1, rows[7][2]), (None, 0, rows[9][2]), (70, 1, None), (71, 1, [1.0] * 7 + [None]), (72, 1, [float("nan")] * 8), (73, 1, [float("inf")] * 8), (74, 1, [1.0] * 4), (75, 1, []), (76, 1, [1.0] * 5)]
    whole = [r for r in rows if r[0] not in (70, 74, 75, 76)]
    for kind in ("float", "double"):
        frame = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").withColumn("id", F.lit("x")).withColumn("code", F.lit(1)).repartition(5)
        coded, books = vector_codes.compress(frame, n_parts=4, n_entries=7)
        expected, digest = brute_codes(whole, 4, 7, 2)
        errors = Counter()
        for _, label, _, error in expected:
            errors[label] += error
        got = [tuple(r[c] for c in CODES) for r in vector_codes.with_label_errors(coded).select(*CODES).collect()]
        assert sorted(got, key=repr) == sorted(((i, code, error, errors[label]) for i, label, code, error in expected), key=repr) and books.sha256() == digest
        assert len(books.decoded(got[0][1])) == 8


def test_vector_codes_of_few_and_huge(spark):
    schema = "vec_id long, label int, embedding array<double>"
    few = spark.createDataFrame([(1, None, [0.5] * 16), (2, None, [0.5] * 16)], schema)
    coded, books = vector_codes.compress(few)
    assert [(r.code, r.error, r.label_error) for r in vector_codes.with_label_errors(coded).collect()] == [("00" * 16, 0, 0)] * 2 and len(books.entries[0]) == 2
    huge = [(k, 1, [1e308 * (-1) ** k, 1e-300, 3.0 * k, 1e200]) for k in range(9)]
    coded, books = vector_codes.compress(spark.createDataFrame(huge, schema), n_parts=2, n_entries=2)
    expected, digest = brute_codes(huge, 2, 2, 2)
    assert sorted((r.id, r.label, r.code, r.error) for r in coded.collect()) == expected and books.sha256() == digest
    assert {r.label_error for r in vector_codes.with_label_errors(coded).collect()} == {min(sum(e[3] for e in expected), (1 << 63) - 1)}
    none, books = vector_codes.compress(few.limit(0))
    assert vector_codes.with_label_errors(none).count() == 0 and books is None


def test_sums_of_tasks_are_added_exactly():
    tasks = pa.table({"n": [2, 3], "sums": ["9223372036854775807,-1", "9223372036854775807,-4"]})
    out = vector_codes.add_up((pa.scalar(3, pa.int32()), pa.scalar(5, pa.int32())), tasks).to_pylist()
    assert out == [{"part": 3, "entry": 5, "n": 5, "sums": "18446744073709551614,-5"}]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_audit(docs, labels):
    fails, first = {}, {}
    for k, (doc, text, _) in enumerate(docs):
        text, w = text or "", words(text)
        smaller = [d for d, t, _ in docs if (t or "") == text and d is not None and doc is not None and d < doc]
        tests = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": bool(smaller)}
        fails[k] = {f for f, failed in tests.items() if failed}
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        own = [k for k, d in enumerate(docs) if (d[2] or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k in own:
                first[k, order] = next((s for s, f in enumerate(order, 1) if f in fails[k]), 6)
            for s, f in enumerate(order, 1):
                gone = [k for k in own if first[k, order] == s]
                shapley[f] += len(gone)
                marked = lambda c, gone=gone: sum(any(y[0] == docs[k][0] and y[c] == 1 for y in labels) for k in gone if docs[k][0] is not None)
                out[part, order, s] = (sum(first[k, order] > s for k in own), len(gone), sum(first[k, order] < s and f in fails[k] for k in own), sum(fails[k] == {f} for k in own), marked(1), marked(2))
        for (p, order, s), row in list(out.items()):
            if p == part:
                out[p, order, s] = (*row, shapley[order[s - 1]])
    return out


def test_filter_audit(spark):
    varied = " ".join(f"w{k}" for k in range(120))
    docs = [(1, varied, "en"), (2, varied, "de"), (3, varied + " #", "en"), (4, None, "en"), (5, "", None), (6, "ABC DEF", ""), (6, "ABC DEF", ""), (7, "one " * 150, "en"), (None, varied, "en"), (None, None, "de"), (8, varied.upper(), "en"), (9, "x " * 99 + "y\x0bz", "de")]
    docs += [(k, "the same text", "en") for k in range(20, 30)]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, None), (3, 0, 1), (4, 1, 1), (25, 1, 0), (None, 1, 1), (99, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "digest", "A", "first_id", "step")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(3))
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in columns) for r in filter_audit.audit(frame, marks).collect()}
    assert got == brute_audit(docs, labels) and len(got) == 3 * 600
    assert filter_audit.audit(frame.limit(0), marks).count() == 0 and filter_audit.audit(frame, marks.limit(0)).where("good_lost > 0").count() == 0


def test_replay_of_other_filters(spark):
    flagged = spark.createDataFrame([("p", True, False, True), ("p", True, True, False), ("p", False, False, True)], "part string, X boolean, Y boolean, dear boolean")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.dear_lost, r.shapley) for r in filter_audit.replay(flagged, "XY", ["dear"]).collect()}
    assert got == {("XY", 1): (1, 2, 0, 1, 1, 3), ("XY", 2): (1, 0, 1, 0, 0, 1), ("YX", 1): (2, 1, 0, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 1, 3)}


def low_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_hits(docs, items, width):
    grams = defaultdict(set)
    for item, text in items:
        w = low_words(text)
        n = min(len(w), width)
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = low_words(text), set(), set()
        for g, owners in grams.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= {str(i) for i in owners if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


PASSAGE = "Who, on the 3rd day, SAID that É was here and left?"


def leaky(spark):
    own = "clean words of a text that nobody has seen before in any list of questions"
    long_text = " ".join(f"w{k % 991}" for k in range(30_000)) + " " + PASSAGE + " tail" * 5000
    docs = [(1, own), (2, f"{own} {PASSAGE} {own}"), (3, PASSAGE.upper().replace(",", " -- ")), (4, None), (5, ""), (6, " ?! "), (7, long_text), (2, f"{own} {PASSAGE} {own}"), (None, "x " + PASSAGE), (None, own), (8, "short item, Short ITEM!"), (9, PASSAGE[:30]), (10, "a b c d e f g h i j k l m a b c"), (10, "other text " + PASSAGE)]
    docs += [(100 + k, f"{PASSAGE} copy") for k in range(15)]
    items = [(11, PASSAGE), (2, PASSAGE + " And more words that follow it"), (3, "short item"), (4, None), (5, "!!"), (None, "nobody has seen"), (7, "a b c d e f g h i j k l"), (7, "c d e f g h i j k l m a"), (11, PASSAGE)]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("most", [1 << 26, 0])  # a broadcast set, and a shuffled one
def test_decontamination(spark, most):
    docs, items, frame, bench = leaky(spark)
    more = frame.withColumns({c: F.lit("x") for c in ("digest", "words", "at", "gram", "spans")}).repartition(3)
    found = decontamination.contamination(more, bench.withColumn("item", F.lit(0)), broadcast_bytes=most)
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(brute_hits(docs, items, 10), key=repr)
    assert decontamination.contamination(frame, bench.limit(0), broadcast_bytes=most).where("contaminated").count() == 0
    assert decontamination.contamination(frame.limit(0), bench, broadcast_bytes=most).count() == 0


def test_removal_of_spans_and_documents(spark):
    docs, items, frame, bench = leaky(spark)
    clean = [d for d, b in zip(docs, brute_hits(docs, items, 10), strict=True) if not b[5]]
    more = frame.withColumns({c: F.lit(c) for c in ("digest", "hit_id", "spans")})
    kept = decontamination.remove_documents(more, bench)
    assert kept.columns == more.columns and sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(clean, key=repr)
    cut = decontamination.remove_spans(more, bench)
    texts = [(r.doc_id, r.text) for r in cut.collect()]
    assert cut.columns == more.columns and len(texts) == len(docs)
    assert decontamination.contamination(cut.select("doc_id", "text"), bench).where("doc_id <> 10 and n_hit > 0").count() == 0
    own = docs[0][1]
    assert texts.count((8, "")) == 1 and (1, own.replace("nobody has seen ", "")) in texts and (4, None) in texts and texts.count((101, "copy")) == 1 and (3, "") in texts
