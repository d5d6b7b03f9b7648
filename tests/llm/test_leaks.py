"""Leaks: passages through print and scan damage, and no alarm below the least run."""

import random

import pytest

from driftwell.llm.leaks import ALIKE, GROUPS, Passages, alike, find, words

RNG = random.Random(3)
VOWELS, CONSONANTS = "aeiou", "bdfgklmnprstvz"


def word():
    return "".join(RNG.choice(CONSONANTS) + RNG.choice(VOWELS) for _ in range(RNG.randint(1, 4)))


VOCABULARY = [word() for _ in range(400)] + ["the", "a", "of"] * 20
PASSAGES = [" ".join(RNG.choice(VOCABULARY) for _ in range(60)) for _ in range(30)]


def filler(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def noisy(text, share=0.06):
    swap = {"e": "c", "o": "0", "n": "u", "i": "l", "s": "5", "b": "h", "a": "o", "t": "f", "m": "rn"}
    return "".join(swap[c] if c in swap and RNG.random() < share else c for c in text)


def lines(text, width=6):
    w = text.split()
    out = [w[i : i + width] for i in range(0, len(w), width)]
    for i in range(len(out) - 1):
        if len(out[i][-1]) > 5 and RNG.random() < 0.5:
            x = out[i][-1]
            out[i][-1] = x[:3] + RNG.choice("-¬‐")
            out[i + 1].insert(0, x[3:])
    return [" ".join(x) for x in out]


@pytest.fixture(scope="module")
def passages():
    return Passages(PASSAGES)


def hits(passages, text, least=18):
    return {h[0]: h[1] for h in passages.search(text, least)[0]}


def part(k, n, at=10):
    return " ".join(PASSAGES[k].split()[at : at + n])


def test_runs_of_the_least_length_and_below(passages):
    for k in range(10):
        assert hits(passages, f"{filler(30)} {part(k, 18)} {filler(30)}").get(k, 0) >= 18
        # A run below the least may go on by a like word or two by chance, not by three.
        assert k not in hits(passages, f"{filler(30)} qqqq {part(k, 15)} wwww {filler(30)}")


def test_case_punctuation_line_ends_and_misread_letters(passages):
    found = 0
    for k in range(30):
        text = "\n".join(lines(noisy(f"{filler(40)} {part(k, 30)} {filler(40)}").upper() if k % 3 == 0 else noisy(f"{filler(40)}, {part(k, 30).replace(' ', ', ', 3)}. {filler(40)}")))
        found += k in hits(passages, text)
    assert found >= 29


def test_other_columns_and_adverts_between(passages):
    found = 0
    for k in range(30):
        own, other = lines(part(k, 40, 5), 7), lines(filler(60), 7)
        if k % 2:
            text = "\n".join(x for pair in zip(own, other, strict=False) for x in pair)
        else:
            text = "\n".join([*own[:2], "* * SALE 4/6 * *", "Mobs & Dorn", *own[2:]])
        found += k in hits(passages, f"{filler(50)}\n{text}\n{filler(50)}")
    assert found >= 29


def test_columns_side_by_side(passages):
    own, other = lines(part(4, 40, 5), 6), lines(filler(60), 6)
    assert 4 in hits(passages, "\n".join(f"{a}        {b}" for a, b in zip(own, other, strict=False)))


def test_changed_words_end_a_run(passages):
    w = PASSAGES[7].split()
    for i in range(9, 60, 10):
        w[i] = "zzzzqqq"
    assert 7 not in hits(passages, f"{filler(20)} {' '.join(w)} {filler(20)}")


def test_no_alarm_in_unrelated_text(passages):
    assert not any(passages.search(filler(2000), 18)[0] for _ in range(10))


def test_alike():
    assert alike("cattle", "caffle") and alike("of", "0f") and alike("modern", "modem") and alike("the", "tbe")
    assert not alike("the", "that") and not alike("of", "by") and not alike("council", "carriage")
    assert words("Straße, l’été (hapel a!l") == ["strasse", "l", "été", "chapel", "all"]


def test_find_reports_all_items_and_places(spark):
    items = spark.createDataFrame([(1, PASSAGES[0]), (2, PASSAGES[0]), (3, PASSAGES[1]), (4, None), (5, ""), (6, "too short")], "item_id int, passage string")
    text = f"{filler(25)} {part(0, 25)}. {filler(25)}"
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, filler(3000)), (5, text), (None, text), (6, part(0, 25) * 1)], "doc_id long, text string").withColumnRenamed("text", "t")
    got = find(docs, items, text="t").collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 5, None, 6) for i in (1, 2)}
    r = next(r for r in got if r.doc_id == 1)
    assert r.run_words >= 25 and part(0, 25) in text[r.first_char : r.last_char]
    assert find(docs.limit(0), items, text="t").count() == 0 and find(docs, items.limit(0), text="t").count() == 0
    assert find(docs, items, text="t", block_bytes=400).count() == len(got)


def test_interruptions_of_any_length(passages):
    found = [0, 0, 0, 0]
    for k in range(30):
        for n, (first, gap) in enumerate(((13, 180), (9, 400), (9, 3000), (12, 6000))):
            text = f"{filler(30)}\n{part(k, first)}\n{filler(gap)}\n{part(k, 18 - first, 10 + first)}\n{filler(30)}"
            found[n] += k in hits(passages, text)
    assert min(found[:3]) >= 27 and found[3] >= 24, found  # six words among 6,000 may be too common to tell from chance


def test_far_words_that_go_on_by_chance_are_no_case(passages):
    other = lambda n: " ".join("".join(RNG.choice("hjqwxy") for _ in range(RNG.randint(2, 8))) for _ in range(n))
    for k in range(30):
        lone = "\n".join(f"{other(400)}\n{part(k, 1, i)}\n" for i in range(25, 29))
        assert k not in hits(passages, f"{other(30)}\n{part(k, 15)}\n{lone}{other(30)}")


def misread(text, every):
    """One misread letter in each ``every``-th word."""
    other = {a: b for p in ALIKE.split() for a, b in (p, p[::-1])}
    out = text.split()
    for i in range(every - 1, len(out), every):
        at = [k for k, c in enumerate(out[i]) if c in other]
        if at:
            k = RNG.choice(at)
            out[i] = out[i][:k] + other[out[i][k]] + out[i][k + 1 :]
    return " ".join(out)


@pytest.mark.parametrize("every", [4, 3, 2])
def test_recall_of_the_least_run_with_misread_letters(passages, every):
    found = sum(k in hits(passages, f"{filler(60)} {misread(part(k, 18, at), every)} {filler(60)}") for k in range(30) for at in (0, 10, 20, 42))
    assert found >= 0.9 * 120


def test_questions_answers_and_places_in_the_original_text(spark):
    items = spark.createDataFrame([(1, PASSAGES[0], "Which straße was\nlong?", "İzmir"), (2, None, "Which straße was long", None)], "item_id int, passage string, question string, answer string")
    text = f"{'İ ß ' * 40}{part(0, 20)} ... WHICH Stras-\nse was-long! In izmir, not izmirs. {'ß' * 30}"
    docs = spark.createDataFrame([(1, text), (2, "which strasse was longer"), (3, None), (4, "izmir alone")], "doc_id long, text string")
    assert {r.doc_id for r in find(docs, items, whole=("question", "answer")).collect()} == {1, 4}
    got = sorted((r.doc_id, r.item_id, r.field, text[r.first_char : r.last_char]) for r in find(docs, items, whole=("question", "answer"), beside=("answer",)).collect())
    assert [g[:3] for g in got] == [(1, 1, "answer"), (1, 1, "passage"), (1, 1, "question"), (1, 2, "question")]
    assert got[0][3] == "izmir" and part(0, 20) in got[1][3] and got[2][3] == "WHICH Stras-\nse was-long"


def test_texts_without_enough_exact_words_are_not_followed():
    """Neither automaton nor following is paid for where no passage has enough words in exact stretches."""

    class Refusing:
        def __len__(self):
            return 1

        def iter(self, letters):
            raise AssertionError("searched")

    own = Passages(PASSAGES)
    own.automaton = Refusing()
    for k in range(10):
        assert own.search(f"{'qqq xxx ' * 30} {part(k, 8)} {'xxx qqq ' * 30}", 18) == ([], [])
    with pytest.raises(AssertionError, match="searched"):
        own.search(f"{'qqq xxx ' * 30} {part(0, 18)}", 18)


def test_bounds_before_the_edit_distance_refuse_no_like_words():
    for w in VOCABULARY * 5:
        other = noisy(w, 0.3)
        room, free = 0.34 * len(w) + 0.07, lambda x: not any(m in x or o in x for m, o in GROUPS)
        if len(w) == len(other) and free(w) and free(other) and len({*w} - {*other}) <= 2 * room + 1:
            cost = sum(0.4 if f"{a}{b}" in ALIKE.split() or f"{b}{a}" in ALIKE.split() else 1 for a, b in zip(w, other, strict=True) if a != b)
            assert cost > room or alike(w, other)
