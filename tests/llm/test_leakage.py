import random

import numpy as np
from pyspark.sql import functions as F

from zonalis.llm import leakage
from zonalis.llm.leakage import index_items, leaked, reading_order, search

BOX = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:float>>"


def words(rnd, n):
    return ["".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiouáó") for _ in range(rnd.randint(1, 4))) for _ in range(n)]


def page(columns, width=1000, advert=None, join=()):
    """Lines and boxes of columns of words, 10 pixels a letter, hyphenated at line ends."""
    pitch, out = (width - 160) // len(columns), []
    for c, w in enumerate(columns):
        text, y, line = " ".join(w), 100, 0
        while text:
            cut = min(len(text), 26)
            part, text = text[:cut], text[cut:]
            if text and text[0] != " " and part[-1] != " ":
                part += "-"
            x = 80 + c * pitch
            out.append([part.strip(), x, y, x + 10 * len(part), y + 20])
            text, y, line = text.lstrip(), y + 30, line + 1
            if advert and line == 3 and c == 0:
                for a in advert:
                    mid = 80 + 130
                    out.append([a, mid - 5 * len(a), y, mid + 5 * len(a), y + 20])
                    y += 30
    out.sort(key=lambda r: (r[2], r[1]))  # line by line across the columns, the wrong order
    if join:
        a, b = out[join[0]], out[join[1]]
        out[join[0]] = [a[0] + " " + b[0], a[1], a[2], b[3], a[4]]
        del out[join[1]]
    return "\n".join(r[0] for r in out), [(r[1], r[2], r[3], r[4], 0.9) for r in out], width


def test_passages_in_columns(spark):
    rnd = random.Random(8)
    item = words(rnd, 30)
    other = words(rnd, 25)
    fill = lambda n: words(rnd, n)
    misread = lambda w: [x.replace("l", "1") if i % 5 == 0 else x for i, x in enumerate(w)]
    cut = item[4:20]
    shuffled = [w for k in (3, 0, 2, 1) for w in cut[4 * k : 4 * k + 4]]
    pages = {
        1: page([fill(20) + cut + fill(20)]), 2: page([fill(20) + cut + fill(9), fill(40)]), 3: page([fill(5) + cut + fill(20)], advert=["OFERTA", "COMPRE HOY", "PRECIO 12"]),
        4: page([fill(8) + misread(cut) + fill(9)]), 5: page([fill(8) + [w.upper() + "," for w in cut] + fill(9)]), 6: page([fill(30) + cut[:8] + fill(30)]),
        7: page([fill(20) + shuffled + fill(20)]), 8: page([fill(60)]), 9: page([fill(10) + item + fill(4), fill(10) + other]), 10: page([fill(30) + cut + fill(30), fill(70)], join=(4, 5)),
    }
    text, boxes, width = page([fill(9) + cut + fill(9)])
    pages[11] = (text.encode().decode("cp437"), boxes, width)
    pages[12] = (text, None, None)
    pages[13] = ("", [], 700)
    pages[14] = (None, None, None)
    pages[15] = (" ".join(words(rnd, 60_000) + item), [(0, 0, 9, 9, None)], 500)
    docs = spark.createDataFrame([(k, *v) for k, v in pages.items()], f"doc_id bigint, text string, line_boxes {BOX}, page_width int").withColumn("words", F.lit(1)).withColumn("item_id", F.lit(2))
    docs = docs.union(docs.where("doc_id = 1"))
    items = spark.createDataFrame([(70, " ".join(item)), (71, " ".join(other)), (72, None), (73, "uno dos"), (74, "")], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaked(docs, items).collect()}
    assert found == {(k, 70) for k in (1, 2, 3, 4, 5, 9, 10, 11, 12, 15)} | {(9, 71)}
    assert leaked(docs.limit(0), items).count() == 0 and leaked(docs, items.limit(0)).count() == 0


def test_reading_order_splits_joined_lines():
    text, boxes, width = page([["aaa"] * 24, ["bbb"] * 24], join=(2, 3))
    b = np.array([x[:4] for x in boxes], float)
    lines = reading_order(text.split("\n"), b[:, 0], b[:, 1], b[:, 2], width)
    joined = " ".join(lines)
    assert joined.index("bbb") > joined.rindex("aaa")


def plain(text):
    return [text], np.empty(0), np.empty(0), np.empty(0), None


def test_many_short_items_on_late_pages():
    rnd = random.Random(3)
    texts = [" ".join(words(rnd, 12)) for _ in range(40_000)]
    pages = [plain("nada") for _ in range(256)]
    for p, k in ((0, 5), (209, 39_998), (210, 7), (255, 39_999)):
        pages[p] = plain(" ".join(words(rnd, 20) + [texts[k]] + words(rnd, 20)))
    assert [r[:2] for r in search([index_items(list(enumerate(texts)))], pages)] == [(0, 5), (209, 39_998), (210, 7), (255, 39_999)]


def test_blocks_of_items_in_one_pass(spark, monkeypatch):
    rnd = random.Random(6)
    texts = [words(rnd, 20) for _ in range(60)]
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id bigint, text string")
    docs = spark.createDataFrame(
        [(k, " ".join(words(rnd, 15) + t[3:17] + words(rnd, 15)), None, None) for k, t in enumerate(texts)], f"doc_id bigint, text string, line_boxes {BOX}, page_width int"
    )
    for letters, at_once in ((1000, 100), (1000, 2), (10**9, 1)):
        monkeypatch.setattr(leakage, "BLOCK_LETTERS", letters)
        monkeypatch.setattr(leakage, "BLOCKS", at_once)
        assert sorted((r["doc_id"], r["item_id"]) for r in leaked(docs, items).collect()) == [(k, k) for k in range(60)]


def test_item_of_a_hundred_thousand_letters():
    rnd = random.Random(4)
    item = words(rnd, 22_000)
    assert sum(map(len, item)) > 100_000
    pages = [plain(" ".join(words(rnd, 9) + item[k : k + 14] + words(rnd, 9))) for k in (3, 10_000, 21_980)]
    assert [r[:2] for r in search([index_items([(1, " ".join(item))])], pages)] == [(0, 1), (1, 1), (2, 1)]


def test_twelve_words_with_a_misread_short_or_end_word():
    rnd = random.Random(5)
    long = [w + "ra" for w in words(rnd, 40)]
    # (words of the item, as the page has them); the words before and after differ
    cases = [
        (["la", *long[:11]], ["1a", *long[:11]]), (["la", *long[:11]], ["l4", *long[:11]]), ([*long[:11], "de"], [*long[:11], "dc"]), ([*long[:11], "mes"], [*long[:11], "nes"]),
        (["casa", *long[:11]], ["ca5a", *long[:11]]), ([*long[:11], "camino"], [*long[:11], "cam1no"]), (["la", *long[:10], "de"], ["1a", *long[:10], "dc"]),
        ([*long[:8], "o", *long[8:19]], [*long[:8], "0", *long[8:19]]),
    ]
    for mine, read in cases:
        items = index_items([(1, " ".join(["zzzz"] * 5 + mine + ["kkkk"] * 5))])
        assert [r[:2] for r in search([items], [plain(" ".join(["xxxx"] * 9 + read + ["qqqq"] * 9))])] == [(0, 1)], read
    # eight shared words, of the next ones some by chance
    items = index_items([(1, " ".join([*long[:8], "para", "de", "que", "de", "un", "kkkk"]))])
    assert search([items], [plain(" ".join(["xxxx"] * 9 + [*long[:8], "sora", "de", "que", "da", "qqqq", "qqqq"]))]) == []
