"""Similarity behind bounds, and the pages that entries stand for."""

import random
from statistics import median

from pyspark.sql import functions as F

from pageloom.operators import similarity, targets
from pageloom.operators.sequential import similarity as plain_similarity
from pageloom.operators.sequential import with_keys

ENTRIES = "doc_id long, sequence long, title string, level int, printed string, target long, contents_end int"
LINES = "doc_id long, page int, pos int, text string, t double"


def made_titles(n_titles, n_lines, seed):
    """Titles, and lines of which a third are titles with some letters changed, put otherwise or numbered."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghilmnoprstué") for _ in range(r.randint(1, 9))) for _ in range(300)]
    titles = [" ".join(r.choice(words) for _ in range(r.randint(1, 8))) for _ in range(n_titles)]

    def changed(text):
        letters = list(text)
        for _ in range(r.randint(0, 4)):
            letters[r.randrange(len(letters))] = r.choice("abc ")
        own = "".join(letters).split()
        if r.random() < 0.2:
            r.shuffle(own)
        return ("4.2 " if r.random() < 0.2 else "") + " ".join(own)

    return titles, [changed(r.choice(titles)) if r.random() < 0.3 else " ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(n_lines)]


def marked(spark, titles, lines):
    e = spark.createDataFrame([(1, k, t) for k, t in enumerate(titles)], "doc_id long, sequence long, title string")
    x = spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)], "doc_id long, pos long, text string")
    return e, x, similarity.with_marks(e, "title", "a"), similarity.with_marks(x, "text", "b")


def test_bounds_lose_no_pair(spark):
    titles, lines = made_titles(25, 300, 3)
    e, x, a, b = marked(spark, titles, lines)
    keys = lambda df, text: [{k for k in r[0] if k} for r in with_keys(df, text, "keys").orderBy(df.columns[1]).select("keys").collect()]
    scores = {(i, j): plain_similarity(p, q) for i, p in enumerate(keys(e, "title")) for j, q in enumerate(keys(x, "text"))}
    for least in (0.7, 0.82, 0.96):
        expected = {pair: s for pair, s in scores.items() if s >= least}
        for pairs in (a.join(b, "doc_id"), similarity.likely_pairs(a, b, ["doc_id"], "a", "b", least)):
            assert {(r.sequence, r.pos): r.score for r in similarity.scored(pairs, "a", "b", least).collect()} == expected


def test_bounds_leave_few_pairs(spark):
    titles, lines = made_titles(500, 5000, 4)
    _, _, a, b = marked(spark, titles, lines)
    likely = similarity.likely_pairs(a, b.repartition(4), ["doc_id"], "a", "b", 0.82)
    assert 1000 < likely.where(similarity.may_reach(F.col("a"), F.col("b"), F.lit(0.82))).select("sequence", "pos").distinct().count() < 500 * 5000 / 50


def brute_targets(entries, labels, bookmarks, lines, pages):
    """{(doc, sequence): (target, source)} one entry and signal after another."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    texts = sorted({e[2] for e in entries} | {b[1] for b in bookmarks} | {x[3] for x in lines})
    found = {r.text: {k for k in r["keys"] if k} for r in with_keys(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "keys").collect()}
    whole = {t: with_key for t, with_key in found.items()}
    like = lambda p, q: plain_similarity(whole[p], whole[q])
    out = {}
    for doc, last in pages:
        own = [dict(zip(("seq", "title", "level", "printed", "page", "end"), e[1:], strict=True)) | {"source": "given" if e[5] else None} for e in entries if e[0] == doc]
        number = lambda e: int(e["printed"]) if e["printed"] and e["printed"].isdigit() else None
        end = own[0]["end"] or 0
        for e in own:
            held = [p for d, p, label in labels if d == doc and e["printed"] and label.lower() == e["printed"].lower() and p > end]
            if e["page"] is None and held:
                e |= {"page": min(held), "source": "label"}
        offs = [e["page"] - number(e) for e in own if e["page"] is not None and number(e) is not None]
        offset = round(median(offs)) if offs else None
        if offset is None:
            anchors = [e for e in own if e["level"] == 1 and number(e) is not None and max(len(k.split()) for k in whole[e["title"]]) >= 2][:16]
            page_text = {}
            for d, p, _, text, _ in lines:
                if d == doc:
                    page_text[p] = page_text.get(p, "") + " " + " ".join(text.lower().split())
            hits = {o: sum(end < number(e) + o <= last and any(len(k) >= 8 and k in page_text.get(number(e) + o, "") for k in whole[e["title"]]) for e in anchors) for o in range(-10, 81)}
            best = max(hits, key=lambda o: (hits[o], -o))
            offset = best if hits[best] >= (2 if len(anchors) >= 2 else 1) else None
        for e in own:
            if e["page"] is None and offset is not None and number(e) is not None and end < number(e) + offset <= last:
                e |= {"page": number(e) + offset, "source": "offset"}
        for e in own:
            near = number(e) + offset if offset is not None and number(e) is not None else None
            marks = [(like(e["title"], t), -abs(p - near) if near is not None else p, p) for d, t, p in bookmarks if d == doc and p > end]
            if e["page"] is None and marks and max(marks)[0] >= 0.84:
                e |= {"page": max(marks)[2], "source": "bookmark"}
        for e in own:
            if e["page"] is None:
                least = 0.9 if len(max(whole[e["title"]], key=len).split()) <= 2 else 0.82
                held = [p for d, p, _, text, _ in lines if d == doc and p > end and 0 < len(text) <= 320 and like(e["title"], text) >= least]
                if held:
                    e |= {"page": min(held), "source": "text"}
            out[doc, e["seq"]] = (e["page"], e["source"])
    return out


def test_targets_against_plain_steps(spark):
    titles, lines = made_titles(24, 150, 9)
    r = random.Random(1)
    entries, labels, bookmarks, text = [], [], [], []
    for doc in range(4):
        own = titles[6 * doc : 6 * doc + 6]
        for k, title in enumerate(own):
            printed = (str(k + 1), "iv", None)[0 if k < 4 else k - 3]
            entries.append((doc, k, title, 1, printed, 9 if doc == 3 and k == 0 else None, 2))
        labels += [(0, 5, "1"), (0, 6, "2"), (0, 1, "2"), (0, 8, "IV"), (0, 4, "IV")]
        bookmarks += [(doc, "7. " + t, r.randint(1, 20)) for t in own if r.random() < 0.6]
        text += [(doc, r.randint(1, 20), k, line, float(k)) for k, line in enumerate(lines) if r.random() < 0.5]
        text += [(2, k + 7, 900 + k, t, 1.0) for k, t in enumerate(own)] if doc == 2 else []
    pages = [(doc, 20) for doc in range(4)]
    got = targets.located(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(labels, "doc_id long, page int, label string"), spark.createDataFrame(bookmarks, "doc_id long, title string, page int"), spark.createDataFrame(text, LINES), spark.createDataFrame(pages, "doc_id long, pages int"))
    found = {(x.doc_id, x.sequence): (x.target, x.source) for x in got.collect()}
    assert found == brute_targets(entries, labels, bookmarks, text, pages)
    assert {s for _, s in found.values()} >= {"label", "offset", "given"} and {s for _, s in found.values()} & {"bookmark", "text"}


def test_labels_win_over_bookmarks(spark):
    entries = [(1, 0, "Introduction", 1, "1", None, 1), (1, 1, "Conclusion", 1, "5", None, 1), (1, 2, "Unpaged Matters of Law", 1, None, None, 1)]
    bookmarks = [(1, "Introduction", 30), (1, "Conclusion", 2), (1, "Unpaged matters of laws", 12), (1, "Unpaged matters of law", 1)]
    labels = [(1, 3, "1"), (1, 7, "5"), (1, 9, "5")]
    got = targets.located(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(labels, "doc_id long, page int, label string"), spark.createDataFrame(bookmarks, "doc_id long, title string, page int"), spark.createDataFrame([], LINES), spark.createDataFrame([(1, 40)], "doc_id long, pages int"))
    assert [(r.target, r.source) for r in got.orderBy("sequence").collect()] == [(3, "label"), (7, "label"), (12, "bookmark")]
