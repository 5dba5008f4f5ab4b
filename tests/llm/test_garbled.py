"""Repairs, the model, and whole corpora with known alterations."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import garbled as G

CLEAN = {
    "de": "Über die schöne Brücke führt im Frühling täglich ein Weg zum größten Fluss – „fast“ für alle Gärtner möglich später",
    "fr": "La forêt près de l’école était légère où les élèves répètent très bientôt leçon château déjà première lumière",
    "ru": "Малый мост через реку очень старый и тихий потому что весной здесь всегда праздник книга бумага окно",
    "pl": "Żółty młyn w małej wsi jest później zamknięty ponieważ święto światło książka źródło często łąka",
    "ja": "春の川で静かな水車を見るのはとても楽しいです。 橋の近くに小さい市場があります。",
    "en": "The keeper’s café — “almost” narrow — costs £12 or 15 € in the façade of naïve visitors",
}


def wrong(text, right="utf-8", read="cp1252"):
    b = text.encode(right)
    return "".join(G.TABLE[read][x] for x in b) if read in G.SINGLE else b.decode(read, "replace")


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
@pytest.mark.parametrize("word", ["größer", "“naïve”", "книга", "静かな水車", "€9", "–"])
def test_repairs_undo_utf8(read, word):
    assert word in G.repairs(wrong(word, read=read))


def test_repairs_of_other_chains():
    assert "Śnieg" in G.repairs(wrong("Śnieg", "cp1250", "cp1252"))
    assert "книга" in G.repairs(wrong("книга", "cp1251", "latin-1"))
    assert "книга" in G.repairs(wrong("книга", "koi8-r", "cp1251"))
    assert "静かな水車" in G.repairs(wrong("静かな水車", "cp932", "latin-1"))
    assert "€" in G.repairs(wrong(wrong("€")))
    assert all(v != "größer" for v in G.repairs("größer"))
    assert G.repairs("Which".join(["ï»¿", ""])) and "Which" in G.repairs("ï»¿Which")


def test_counts_are_a_model():
    counts = np.zeros(G.SIZE)
    words = ["größer", "schöner", "früher"] * 20
    G.expected_counts(words, np.ones(len(words)), counts)
    good, bad, empty = G.likelihoods(["größer", "grÃ¶Ãer", "x"], counts)
    assert good > bad and np.isfinite(empty)


def test_posteriors_sum_to_one():
    owner, logs = np.array([0, 0, 1]), np.array([-3.0, -2.0, -1.0])
    pair, cand, post = G.posteriors(owner, logs, np.array([0, 5, 0]), np.array([0, 1, 2]), np.array([0, 0, 1]), np.array([2, 3, 2]), G.start_prior())
    assert np.allclose(np.bincount(pair, post), 1) and len(cand) == 5


def corpus(seed=0):
    """(docs, altered): a corpus of clean pages, altered ones and ones that quote."""
    rng = random.Random(seed)
    docs, altered = [], set()

    def page(lang, lines=4):
        words = CLEAN[lang].split()
        return [" ".join(rng.choice(words) for _ in range(8)) for _ in range(lines)]

    i = 0
    for lang in CLEAN:
        for _ in range(60):
            docs.append((i, "\n".join(page(lang)), rng.choice(["s1", "s2", None])))
            i += 1
    kinds = [("de", "utf-8", "cp1252"), ("fr", "utf-8", "latin-1"), ("ru", "utf-8", "cp1251"), ("ru", "cp1251", "cp1252"), ("pl", "cp1250", "cp1252"), ("ja", "utf-8", "cp1252"), ("en", "utf-8", "cp437")]
    for lang, a, b in kinds:
        for _ in range(5):
            lines = [x.encode(a, "ignore").decode(a) for x in page(lang)]
            docs.append((i, "\n".join(wrong(x, a, b) for x in lines), "s1"))
            altered.add(i)
            i += 1
    for _ in range(4):  # one line of many
        lines = page("fr", 10)
        lines[5] = wrong(lines[5])
        docs.append((i, "\n".join(lines), "s2"))
        altered.add(i)
        i += 1
    docs.append((i, "\n".join([*page("de"), "fr" + chr(0xFFFD) + "her kommt"]), "s1"))
    altered.add(i)
    for q in ("Test line: é becomes Ã©; leave it.", "If it shows “Ã¶” where “ö” should stand, ask."):
        i += 1
        docs.append((i, "\n".join([*page("en"), q]), "s1"))
    docs += [(i + 1, None, "s1"), (i + 2, "", None), (i + 3, "plain ascii text", "s2"), (i + 4, " \n\t\n", "s2"), (i + 5, CLEAN["de"] * 400, "s1")]
    return docs, altered


def test_finds_and_repairs(spark):
    docs, altered = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id bigint, text string, source string, token string").repartition(5)
    g = G.find_garbled(df)
    found = {r["doc_id"] for r in g.documents.collect()}
    assert len(found & altered) >= 0.95 * len(altered) and len(found - altered) <= 1
    texts = {r["doc_id"]: r["text"] for r in G.repaired(df, g).collect()}
    assert set(texts) == found
    right = sum("Ã" not in t and "Ð" not in t for t in texts.values())
    assert right >= 0.9 * len(texts)


def test_nothing_to_find(spark):
    schema = "doc_id bigint, text string, source string"
    assert G.find_garbled(spark.createDataFrame([], schema)).documents.count() == 0
    df = spark.createDataFrame([(1, "ascii", "a"), (2, None, None), (3, "", "a")], schema)
    g = G.find_garbled(df)
    assert g.documents.count() == 0 and G.repaired(df, g).count() == 0


def test_chain_that_shares_most_letters(spark):
    """Tokens that the line's chain leaves as they are say nothing about it, and a piece of a line is enough."""
    docs, _ = corpus()
    word, other = "l’œuvre cœur œuf Šárka sœur", "même été forêt déjà légère très école première"
    clean = [(1000 + i, f"{other} {word} {other}", "s1") for i in range(60)]
    turned = [(2000 + i, f"{other}\n{other} " + wrong(word.replace("’", "'"), "iso8859-15", "cp1252") + f" {other}", "s1") for i in range(3)]
    g = G.find_garbled(spark.createDataFrame([*docs, *clean, *turned], "doc_id bigint, text string, source string"))
    found = {r["doc_id"] for r in g.documents.collect()}
    assert {d[0] for d in turned} <= found and not found & {d[0] for d in clean}
    assert all("cœur" in r["text"] for r in G.repaired(spark.createDataFrame(turned, "doc_id bigint, text string, source string"), g).where("doc_id >= 2000").collect())


def test_best_pieces():
    one = np.array([[-5.0, 0.0], [6.0, 4.0], [0.0, 0.0], [7.0, -9.0]])
    best, lo, hi = (x[0] for x in G.best_pieces(one[None]))
    pieces = G._pieces([(np.array([3]), np.array([False])), (np.arange(4), np.zeros(4, dtype=bool)), (np.array([1, 1]), np.array([False, True]))], one)
    assert np.allclose(pieces[0][1], best) and np.allclose(pieces[0][2], [6 - np.log(1), 4 - np.log(1)]) and pieces[2][0].tolist() == [0, -1]
    assert (lo[0], hi[0], lo[1], hi[1]) == (1, 3, 1, 1) and np.allclose(best, [13 - np.log(6), 4 - np.log(3)])


def test_copies_and_lone_letters_are_no_examples(spark):
    """Copies of a page don't make its damage an example, nor does a lone letter that is a word beside a neighbour."""
    docs, _ = corpus()
    dash = [(3000 + i, "Nimtandor bridge\nToday Orlando " + wrong("–") + " Nimtandor again", "s1") for i in range(4)]
    lone = [(3100, "nous allons " + wrong("à", read="latin-1").replace("\xa0", chr(0xA0)) + " pied", "s1"), (3101, "nous allons " + chr(0xFFFD) + " pied", "s1")]
    words = [(3200 + i, "nous allons à Paris puis à pied\nil va à Lyon", "s1") for i in range(5)]
    quoting = [(3300 + i, f"why do I read {wrong(c)} in old exports", "s1") for i, c in enumerate(("ñ", "’", "£"))]
    rows = [*docs, *dash, *lone, *words, *quoting, (3400, "the glyph " + chr(0xFFFD) + " is drawn by a font", "s1")]
    found = {r["doc_id"] for r in G.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).documents.collect()}
    assert {d[0] for d in dash} | {3101} <= found
    assert not found & {d[0] for d in [*words, *quoting, (3400,)]}


def test_tokens_of_lines_without_spaces():
    cut = lambda l: [l[a:z] for a, z in G.tokens_of(l)]
    assert cut("文字「Ã©」は、(Ã©)です。 plain größer x") == ["文字「", "Ã©", "」は、", "(Ã©)", "です。", "größer"]
    assert cut("他说“好”…—，Torhul测量") == ["他说“好”…—，Torhul测量"] and cut("å¾ˆæ˜Ž") == ["å¾ˆæ˜Ž"] and cut("ascii only") == []
    assert cut("ï»¿村紙の最初") == ["ï»¿村紙の最初"]
    assert G.neighbours("a  7 b\xa0Ã© c", 7, 9) == ("b", "c") and G.neighbours("Ã©", 0, 2) == ("^", "$")
    assert len(G.neighbours("村" * 500 + " Ã©", 501, 503)[0]) == 33
    assert G.shape("Ljus,\xa0Ån") == G._JOINT.join(("ljus,", "ån")) and G.shape("Home\xad") == "home"


def test_repair_keeps_to_its_place(spark):
    """The same token is damage in one line and a quoted example in another, and once more in a line of its own field."""
    docs, _ = corpus()
    both = "grün\nDie BrÃ¼cke und Ã¶stlich am grÃ¶ÃŸten spÃ¤ter\nWrite Ã¶ not ö\nschön"
    g = G.find_garbled(spark.createDataFrame([*docs, (9000, both, "s1")], "doc_id bigint, text string, source string"))
    hits = g.hits.where("doc_id = 9000 AND line = 1")
    assert hits.count() >= 3
    only = G.Garbled(g.documents, hits, g.verdicts, g.turned)  # as if the example had been told apart
    text = G.repaired(spark.createDataFrame([(9000, both, "s1")], "doc_id bigint, text string, source string"), only).first()["text"]
    assert text == "grün\nDie Brücke und östlich am größten später\nWrite Ã¶ not ö\nschön"


def test_what_is_left_of_a_lost_token_is_repaired(spark):
    docs, _ = corpus()
    bad = [(9100 + i, "Die schöne BrÃ¼cke f�r GÃ¤rtner\nmÃ¶glich� spÃ¤ter grÃ¶ÃŸten", "s1") for i in range(2)]
    df = spark.createDataFrame([*docs, *bad], "doc_id bigint, text string, source string")
    texts = {r["doc_id"]: r["text"] for r in G.repaired(df, G.find_garbled(df)).collect()}
    assert texts[9100] == "Die schöne Brücke f�r Gärtner\nmöglich� später größten"


def test_examples_in_long_tokens(spark):
    """In text without spaces an example is told apart as elsewhere."""
    docs, _ = corpus()
    rows = [*docs, (9200, CLEAN["ja"] + "\n" + "静かな水車の「Ã©」は「é」の間違いです。", "s2")]
    found = {r["doc_id"] for r in G.find_garbled(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).documents.collect()}
    assert 9200 not in found


@pytest.mark.parametrize(("lang", "right", "read"), [("de", "cp1252", "gb18030"), ("pl", "cp1250", "cp932"), ("ja", "cp932", "cp1252"), ("ja", "cp932", "mac_roman")])
def test_chains_over_several_bytes(spark, lang, right, read):
    """Pages of one-byte encodings read in one of several bytes, and the other ways round."""
    docs, _ = corpus()
    rng = random.Random(2)
    words = CLEAN[lang].split() if lang != "ja" else ["春の川で", "静かな", "水車を", "見るのは", "とても", "楽しい", "です。", "橋の近くに", "小さい", "市場が", "あります", "本と紙を", "朝の庭"]
    if lang == "ja":
        words = ["".join(rng.choice(words) for _ in range(6)) for _ in range(500)]
        docs = [*docs, *[(9400 + i, " ".join(rng.choice(words) for _ in range(20)), "s1") for i in range(80)]]
    bad = [(9300 + i, "\n".join(wrong(" ".join(rng.choice(words) for _ in range(8)).encode(right, "ignore").decode(right), right, read).replace("\ufffd", "") for _ in range(4)), "s1") for i in range(4)]
    found = {r["doc_id"] for r in G.find_garbled(spark.createDataFrame([*docs, *bad], "doc_id bigint, text string, source string")).documents.collect()}
    assert {d[0] for d in bad} <= found and not found & {d[0] for d in docs if d[0] < 360 or d[0] >= 9400}


def test_model_comes_to_the_driver_in_blocks(spark, monkeypatch):
    """However many places of the model are taken, few rows of it come to the driver, and the sums are right."""
    docs, _ = corpus()
    rows, frame = [], type(spark.range(1))
    to_arrow = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda df: rows.append((t := to_arrow(df)).num_rows) or t)
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(5)
    occ = df.select("doc_id", "source", "text").mapInArrow(G._find_occurrences, G.OCC).cache()
    _, (counts, _, words) = G.learn(occ, 1)
    assert rows and max(rows) <= 256
    tokens = [w for _, text, _ in docs for _, _, w, *_ in G.occurrences(text or "")]
    expected = np.zeros(2 * G.WORDS)
    np.add.at(expected, np.array([G.word_places(w) for w in tokens]).ravel(), 1)
    assert words.dtype == np.float32 and (words == expected).all()
    types = occ.groupBy("token", "sf").count().groupBy("token").agg(F.collect_list("sf"), F.collect_list("count")).repartition(3)
    first = np.zeros(G.SIZE)
    G.expected_counts([G.shape(w) for w in tokens], np.ones(len(tokens)), first)
    gathered = G._gather(types.mapInArrow(G._first_counts, G.PART))
    assert len(gathered) == G.STATS and np.allclose(gathered[: G.SIZE], first) and not gathered[G.SIZE :].any()
    assert not G._gather(types.limit(0).mapInArrow(G._first_counts, G.PART)).any()
    occ.unpersist()
