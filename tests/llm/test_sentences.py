"""Sentence units: outer structure, hand-made cases, and accuracy on lists held out from the training."""

import pytest

from jobmill.llm import queries as q
from jobmill.llm import sentences as s


@pytest.fixture(scope="module")
def lists(sf):
    import pandas as pd

    found = {"\n".join(x): x for d in (sf, "/root/testdata/sf0.1") for t in pd.read_parquet(f"{d}/documents.parquet").text.dropna() for x in s.lists_of(t)}
    return [found[k] for k in sorted(found)]


@pytest.fixture(scope="module")
def tagger(lists):
    return s.train(lists[::2])


def test_held_out_lists(tagger, lists):
    wrong = total = 0
    for n, items in enumerate(lists[1::2]):
        text, ends = s.example(items, n)
        places = s.candidates(text, 0, len(text))
        labels = tagger.decode([tagger.score(s.context(text, 0, len(text), p)) for p in places])
        total += len(places)
        wrong += sum(label != (p[0] in ends) for p, label in zip(places, labels))
    assert total > 10_000 and wrong / total < 0.005


CASES = [
    ("We hire in the U.S. and in Paris. Pay starts at 7.5 lakh p.a. plus a bonus.", 2),
    ('He said, "Ship it. Then fix it." That was 2023.', 2),
    ("Dr. Irkfen leads the group. J. Tok and K. Zor review every change.", 2),
    ("„Wir liefern freitags. Samstags ruhen wir“, sagt Pidfis. Wer fragt, lernt.", 2),
    ("「金曜に出荷します。土曜は休みます。」とLoprezさんは言います。チームは8人です。", 2),
    ("会议很少（每周7次。不会再多。），文档很多。欢迎立即申请！", 2),
    ("เราประชุมกันน้อยมาก ต้องมีประสบการณ์ 6.1 ปีขึ้นไป", 2),
    ("About us\nWe ask.\n\n1) One thing\n2. Two things\n## Place: Rome\n- x", 6),
    ("Place: Rome\nTeam size: 4", 2),
    # other scripts: Urdu, Armenian, Khmer, Burmese, Arabic, Ethiopic by their marks, Lao by its blanks
    ("ہم ہفتے میں دو بار ملتے ہیں۔ کام دور سے ہوتا ہے۔", 2),
    ("Մենք աշխատում ենք հեռավար։ Թիմը փոքր է։", 2),
    ("យើងធ្វើការពីចម្ងាយ។ ក្រុមការងារ តូច។", 2),
    ("ကျွန်ုပ်တို့ အဝေးမှ အလုပ်လုပ်သည်။ အဖွဲ့ သေးငယ်သည်။", 2),
    ("نعمل عن بعد. الفريق صغير. هل أنت مستعد؟", 3),
    ("ከርቀት እንሰራለን። ቡድኑ ትንሽ ነው።", 2),
    ("ພວກເຮົາເຮັດວຽກທາງໄກ ທີມງານຂະໜາດນ້ອຍ", 2),
]


@pytest.mark.parametrize("text, n", CASES)
def test_cases(tagger, text, n):
    assert len(tagger.units(text)) == n


def test_offsets(tagger):
    text = "  # What we do:\r\n\r\n• “Go.” 🎉 is ours!  \n\n We ask often. You answer."
    units = [text[a:b] for a, b in tagger.units(text)]
    assert units[0] == "What we do:" and units[-1] == "You answer." and all(u == u.strip() for u in units)
    assert tagger.units("") == tagger.units(None) == tagger.units(" \n\t　") == tagger.units("--- ***\n…!") == []
    assert tagger.units("word " * 20_000) == [(0, 99_999)]


def test_wrapped_lines(tagger):
    text = "Review quality gates and audit trails that the portal of this firm\nrelies on daily. Nobody counts hours here, and the office opens\nlateishly.\n\nBenefits\nNone so far."
    assert [text[a:b] for a, b in tagger.units(text)][1:] == ["Nobody counts hours here, and the office opens\nlateishly.", "Benefits", "None so far."]


def test_viterbi_is_the_best_path():
    from itertools import product

    t = s.Tagger({}, [[0.3, -0.2], [-0.5, 0.1]])
    for scores in ([0.4, -0.1, 0.2, -0.3], [1.0, 1.0], [-1.0], []):
        best = max(product((0, 1), repeat=len(scores)), key=lambda p: sum(x for x, y in zip(scores, p) if y) + sum(t.chain[a][b] for a, b in zip((1, *p), p)))
        assert t.decode(scores) == list(best)


def test_tables(spark, sf):
    rows = q.p9_found(spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(rows) == len(set(rows))
    for r in rows:
        unit = texts[r.doc_id][r.sent_from : r.sent_to]
        assert unit == unit.strip() and any(map(str.isalnum, unit))
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "A b. C d.", 0), (2, "x", 0), (2, "x", 0)], "k int, t string, sent_from int")
    got = s.sentence_units(odd, "k", "t").collect()
    assert sorted((str(r.k), r.sent_from, r.sent_to) for r in got) == [("2", 0, 1), ("2", 0, 1), ("None", 0, 4), ("None", 5, 9)]
    assert s.sentence_units(odd.limit(0), "k", "t").count() == 0


LONG = "Our group maintains the tools that the other groups of this house rely on every day, from the first draft to the last check. Nobody counts hours here, and whoever asks a question gets an answer the same day, even late in the week."


@pytest.mark.parametrize("width", [30, 40, 55, 70, 90, 110, 130])
def test_wrapped_at_any_width(tagger, width):
    import textwrap

    text = textwrap.fill(LONG, width)
    assert [" ".join(text[a:b].split()) for a, b in tagger.units(text)] == [x if x.endswith(".") else x + "." for x in LONG.split(". ")]
    # a longer line beside it changes nothing
    pasted = text + "\n\n" + "Notice " * 60
    assert len(tagger.units(pasted)) == 3


def test_lines_that_are_not_wrapped(tagger):
    assert len(tagger.units("About the team\nWe ship on Fridays\nNo meetings before noon\nRemote work is fine with us\nBring your own chair")) == 5


def test_widths_of_the_corpus_decide_where_a_text_is_in_doubt():
    text = "Die Gruppe trifft sich an jedem Montag im großen\nGarten."
    width = max(map(len, text.split("\n"))) // s.WIDTH_STEP
    assert len(s.blocks(text, {width: 3.0})) == 1 and len(s.blocks(text, {width: -3.0})) == 2


def test_lists_are_cut_between_items():
    items = ["x" * 50, "y" * 50, "z" * 50]
    assert s.whole_items(items, 110) == items[:2] and s.whole_items(items, 10) == [] and s.whole_items(items) == items


def _sentence(words):
    return " ".join(words).capitalize() + "."


def test_all_items_of_a_long_list_are_learned_from(spark):
    plain = [_sentence(["we", "meet", "the", "group", f"{n % 7}", "in", "hall", "b"]) for n in range(1500)]
    items = plain + [f"The plant sends qux. Parts to hall {n} every week." for n in range(30)]
    assert len("".join(plain)) > s.TRAIN_LIST and [x for r in s.runs_of(items) for x in r] == items
    assert [len(r) for r in s.runs_of(["x" * 9, "y" * 50, "z", "z"], 20)] == [1, 1, 2]
    df = spark.createDataFrame([(1, "\n".join(f"- {x}" for x in items))], "k int, text string")
    assert len(s.fit_tagger(df, "text").units("We send qux. Parts to Rome. It is fun.")) == 2


def test_all_lists_and_widths_are_learned_from(spark, monkeypatch):
    import math
    import textwrap

    monkeypatch.setattr(s, "TRAIN_BYTES", 1, raising=False)  # a bound that there was
    words = [f"{a}{b}ux" for a in "bdfgk" for b in "aeiou"]
    text = textwrap.fill(LONG, 70)
    rows = [(n, f"- Our plant sends {w}. Parts to hall {k} by night.\n- We meet in hall {k}.\n\n{text}") for n, (w, k) in enumerate((w, k) for w in words for k in range(4))]
    df = spark.createDataFrame(rows, "k int, text string").repartition(4)
    lists, widths = s.training_data(df, "text")
    assert lists.count() == len(rows) and max(widths.values()) == pytest.approx(math.log((len(rows) + 0.5) / 0.5))
    tagger = s.fit_tagger(df, "text", first=3, shard=30)
    assert all(len(tagger.units(f"Our plant sends {w}. Parts to hall 9 by night. We meet in hall 2.")) == 2 for w in words)
    again = s.fit_tagger(df.repartition(3), "text", first=3, shard=30)
    assert (again.weights, again.chain, again.widths) == (tagger.weights, tagger.chain, tagger.widths)


def test_a_tagger_is_kept(spark, tagger, tmp_path):
    tagger.widths = {12: 1.5}
    s.save_tagger(spark, tagger, f"{tmp_path}/tagger")
    again = s.load_tagger(spark, f"{tmp_path}/tagger")
    tagger.widths, widths = {}, tagger.widths
    assert (again.weights, again.chain, again.widths) == (tagger.weights, tagger.chain, widths)
