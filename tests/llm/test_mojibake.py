import random

from zonalis.llm.mojibake import evidence, garbled, restored, segments, undone

WORDS = "mañana cigüeña corazón árbol café canción también jamón niño señor pingüino razón lápiz música".split()


def corpus(seed=6):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(WORDS) + ("" if rnd.random() < 0.5 else " de la") for _ in range(40)) for _ in range(120)]


def test_undo():
    assert undone("mañana".encode().decode("latin-1"), "cp1252", "utf-8") == "mañana"
    assert undone("mañana".encode().decode("cp1252").encode().decode("cp1252"), "cp1252", "utf-8") == "mañana"
    assert undone("corazón".encode("cp1252").decode("mac_roman"), "mac_roman", "cp1252") == "corazón"
    assert undone("mañana", "cp1252", "utf-8") is None and undone("abc", "cp437", "cp1252") is None
    assert segments("rotrÃ¡ura", "rotráura") == [("Ã¡", "á", "r", "u")] and segments("abc", "abd") is None


def test_garbled_lines_are_found_and_restored(spark):
    texts = corpus()
    wrong = {
        3: lambda t: t.encode().decode("latin-1"), 9: lambda t: t.encode("cp1252").decode("cp437"), 17: lambda t: t.encode("cp1252").decode("mac_roman"),
        30: lambda t: t.encode().decode("latin-1"), 44: lambda t: t.encode("cp1252").decode("cp1251"), 51: lambda t: t.replace("ñ", "�"),
    }
    docs = []
    for i, t in enumerate(texts):
        lines = [t[: len(t) // 2], t[len(t) // 2 :]]
        if i in wrong:
            lines[1] = wrong[i](lines[1])
        docs.append((i, "\n".join(lines)))
    rare = [(500, "правда Ελλάδα Žižek § 4º — 3ª 25 °C ± 2"), (501, "luplo\xad mañ¬ corazón­"), (502, ""), (503, None), (504, "cora2ón mañama IRMÃ"), (None, texts[0])]
    df = spark.createDataFrame(docs + rare + docs[3:4], "doc bigint, text string").repartition(3)
    found = {r["doc"] for r in garbled(df, "doc", "text").collect()}
    assert found == set(wrong)
    back = {r["doc"]: r for r in restored(df, "doc", "text").collect()}
    for i in wrong:
        if i != 51:
            assert back[i]["restored_text"].replace("\n", "") == texts[i] and back[i]["n_lost"] == 0
    assert back[51]["n_lost"] > 0
    assert evidence(df.limit(0), "doc", "text").count() == 0


def planted(wrong, words=WORDS, filler=" de la", n=200):
    """Texts of two lines, the second of some garbled; (rows, clean texts)."""
    rnd = random.Random(9)
    texts = ["\n".join(" ".join(rnd.choice(words) + ("" if rnd.random() < 0.5 else filler) for _ in range(20)) for _ in range(2)) for _ in range(n)]
    docs = []
    for i, t in enumerate(texts):
        a, b = t.split("\n")
        docs.append((i, a + "\n" + (wrong[i](b) if i in wrong else b)))
    return docs, texts


def check(spark, docs, texts, wrong, **more):
    df = spark.createDataFrame(docs, "doc bigint, text string").repartition(3)
    back = {r["doc"]: r["restored_text"] for r in restored(df, "doc", "text", **more).collect()}
    assert set(back) == set(wrong) and all(back[i] == texts[i] for i in wrong)
    assert {r["doc"] for r in evidence(df, "doc", "text", **more).collect()} == set(wrong)


def test_code_page_that_is_not_usual(spark):
    wrong = {i: lambda t: t.encode("cp1252").decode("koi8_r") for i in range(3, 200, 25)}
    check(spark, *planted(wrong), wrong)
    check(spark, *planted(wrong), wrong, broadcast=0)


def test_a_mapping_of_no_code_page(spark):
    odd = str.maketrans("áéíóúñü", "Ж☂λЩ╬♞д")
    wrong = {i: lambda t: t.translate(odd) for i in range(4, 200, 30)}
    # every letter in three words at least
    more = "público último número rápido página pájaro vergüenza ungüento bilingüe bebé médico época país raíz aquí bahía pequeño".split()
    check(spark, *planted(wrong, WORDS + more, n=300), wrong)


RUSSIAN = "правда столица городской газета сегодня утром площадь министр заседание объявил письмо читатель вечерний театр".split()
GREEK = "εφημερίδα σήμερα πρωτεύουσα κυβέρνηση άνθρωπος θάλασσα δρόμος πλατεία γράμμα επιστολή υπουργός θέατρο".split()


def test_words_without_ascii_letters(spark):
    for words in (RUSSIAN, GREEK):
        wrong = {i: lambda t: t.encode().decode("latin-1") for i in (3, 60)} | {99: lambda t: t.encode().decode("cp1252", "replace").replace("�", "\x81") if "\x81" in t else t.encode().decode("latin-1")}
        check(spark, *planted(wrong, words, ""), wrong)
    # one byte a letter; and a few lines of another script among others
    wrong = {i: lambda t: t.encode("cp1251").decode("cp1252") for i in (3, 60)}
    check(spark, *planted(wrong, RUSSIAN, ""), wrong)
    docs, texts = planted({i: lambda t: t.encode().decode("latin-1") for i in (3, 60)})
    docs += [(300, ("«" + " ".join(RUSSIAN) + "»").encode().decode("latin-1")), (301, " ".join(GREEK)), (302, "ESPAÑ… Ñ… NIÑ“ Ð Î")]
    texts += [""] * 100 + ["«" + " ".join(RUSSIAN) + "»"]
    check(spark, docs, texts, {3, 60, 300})
