"""Wrong decoding: found where planted, restored, and nothing else touched."""

import random

import pytest

from driftwell.llm.encoding import garble, repair, train

RNG = random.Random(5)
STEMS = {"de": ["für", "größe", "straße", "mädchen", "schön", "über", "haus", "kirche", "der", "und", "müde", "prüfte"], "fr": ["été", "forêt", "après", "château", "élève", "où", "maître", "le", "et", "reçu", "côté"], "pl": ["święto", "żądał", "łąka", "ręka", "ćma", "wóz", "dzień", "jest", "źródło"], "ru": ["старый", "новый", "город", "вокзал", "этот", "между", "один", "после"], "en": ["the", "old", "harbour", "of", "market", "opened", "without", "£20", "delay"]}
CHAINS = [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1250"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("mac_roman", "cp1252"), ("koi8_r", "cp1251"), ("cp1251", "cp1252"), ("utf-8", "cp1251")]


def page(lang, n=80):
    w = [RNG.choice(STEMS[lang]) for _ in range(n)]
    w[0] = "“" + w[0]
    w[9] += "”"
    return " ".join(" ".join(w[i : i + 8]) + ("\n" if i % 16 else ", “" + RNG.choice(STEMS[lang]) + "” — ") for i in range(0, n, 8))


def sure(text, right):
    try:
        return bool(text.encode(right)) and not text.isascii()
    except UnicodeEncodeError:
        return False


@pytest.fixture(scope="module")
def corpus(spark):
    clean = {i: page(("de", "fr", "pl", "ru", "en")[i % 5]) for i in range(600)}
    clean |= {1000: None, 1001: "", 1002: "plain ascii only", 1003: "ΑΘΗνα. " + page("en"), 1004: "¶ 3½°. " + page("de"), 1005: "GRÖSSE ÜBER STRASSE " + page("de")}
    bad, k = {}, 0
    for i in range(600):
        right, wrong = CHAINS[i % len(CHAINS)]
        if i % 4 == 0 and sure(clean[i], right) and len(bad) < 60:
            if i % 8:
                bad[i] = garble(clean[i], right, wrong)
            else:
                a, b = clean[i][:200], clean[i][200:]
                bad[i] = a + garble(b, right, wrong)
            if bad[i] == clean[i]:
                del bad[i]
    lost = {2000: page("en") + " h�lutz", 2001: page("de") + " \x81x"}
    docs = {**clean, **bad, **lost}
    df = spark.createDataFrame(list(docs.items()) + [(None, docs[2000])], "doc_id long, text string")
    return clean, bad, lost, df


def test_damaged_records_are_found_and_restored(spark, corpus):
    clean, bad, lost, df = corpus
    got = {r.doc_id: r for r in repair(df, validation=200).collect()}
    assert None in got and set(lost) <= set(got)
    assert len(set(bad) - set(got)) <= 0.05 * len(bad)
    assert len(set(got) - set(bad) - set(lost) - {None}) <= 2
    same = sum(got[i].restored == clean[i] for i in bad if i in got)
    assert same >= 0.7 * len(bad)
    assert got[2000].n_lost >= 1 and all(r.n_spans > 0 or r.n_lost > 0 for r in got.values())


def test_empty_and_undamaged_tables(spark, corpus):
    df = corpus[3]
    assert repair(df.limit(0)).count() == 0
    assert repair(df.where("doc_id IN (1000, 1001, 1002)")).count() == 0


def test_garble():
    assert garble("é", "utf-8", "cp1252") == "Ã©" and garble("ü", "cp1252", "mac_roman") == "¸"


def test_margin_is_validated_on_all_records(spark):
    """A word that only seems damaged, in a record that is not among the 600 least by hash: it must raise the margin."""
    clean = [(page(("de", "fr", "pl", "ru", "en")[i % 5], 24),) for i in range(900)]
    seeming = [(page("de", 24) + " вz",) for _ in range(40)]
    rare = spark.createDataFrame(seeming, "text string").where("xxhash64(text) > 1L << 62").limit(1)
    df = spark.createDataFrame(clean, "text string").unionByName(rare).localCheckpoint()
    margin = train(df)[0].margin
    assert margin == train(df, validation=10_000)[0].margin > train(df, validation=600)[0].margin
