import pytest

from fathom.llm.packing import default_vocabulary
from fathom.llm.sentences import mask, sentence_spans, sentences, terminator_path, word_lattice


def split(text):
    return [text[a:b] for a, b in sentence_spans(text)]


@pytest.mark.parametrize("text, want", [
    ("One. Two! Three? Four.", ["One.", "Two!", "Three?", "Four."]),
    ("Use a value, e.g. 12.8, for Dr. Ilmar vs. the rest. See sec. 13 and Fig. 27. decodeModule blocks.", ["Use a value, e.g. 12.8, for Dr. Ilmar vs. the rest.", "See sec. 13 and Fig. 27.", "decodeModule blocks."]),
    ("We read a, b, etc. After that we stop. It uses a, etc. in full.", ["We read a, b, etc.", "After that we stop.", "It uses a, etc. in full."]),
    ("It failed at 7 p.m. on the host. The table. handleStorage runs.", ["It failed at 7 p.m. on the host.", "The table.", "handleStorage runs."]),
    ('"Why local?" asked the reviewer. The log says "it is late." Next one.', ['"Why local?" asked the reviewer.', 'The log says "it is late."', "Next one."]),
    ("(It is cheap.) Then (cf. a.py) go. Really?! Yes.", ["(It is cheap.)", "Then (cf. a.py) go.", "Really?!", "Yes."]),
    ("We waited ... and it ran… then slept. v1.15.10 of x.read() is 0.5; done.", ["We waited ... and it ran… then slept.", "v1.15.10 of x.read() is 0.5; done."]),
    ("Laut Dr. M. Ruvec ca. 3 usw. Bis zum 21. Mai auf 18,2 GB. Siehe Abs. 4 bzw. Abb. 2, z. B. so, d. h. nur 4. Ohne.", ["Laut Dr. M. Ruvec ca. 3 usw.", "Bis zum 21. Mai auf 18,2 GB.", "Siehe Abs. 4 bzw. Abb. 2, z. B. so, d. h. nur 4.", "Ohne."]),
    ("Es steht: „Der Dienst ruht.“ Jeder liest. „Warum?“, fragte er.", ["Es steht: „Der Dienst ruht.“", "Jeder liest.", "„Warum?“, fragte er."]),
    ("« Pourquoi tard ? » demande M. Fent. Le journal dit : « Le lot est lent. » Puis p. ex. 8. Oui.", ["« Pourquoi tard ? » demande M. Fent.", "Le journal dit : « Le lot est lent. »", "Puis p. ex. 8.", "Oui."]),
    ("¡Nunca confíes! ¿Está lleno? Núm. 26 es b.py, pág. 2. Fin.", ["¡Nunca confíes!", "¿Está lleno?", "Núm. 26 es b.py, pág. 2.", "Fin."]),
    ("К 2025 г. фильтр вырос, т. е. вдвое. «Почему?» — спросил А. В. Йор. См. рис. 3 и т. д. Конец.", ["К 2025 г. фильтр вырос, т. е. вдвое.", "«Почему?» — спросил А. В. Йор.", "См. рис. 3 и т. д.", "Конец."]),
    ("旧的路径。日志写着“不可用！”，随后停止。评审问：“吗？”当模块不可用。版本4.5.9把……然后写入。", ["旧的路径。", "日志写着“不可用！”，随后停止。", "评审问：“吗？”", "当模块不可用。", "版本4.5.9把……然后写入。"]),
    ("担当者は「するのか？」と尋ねた。なぜか？値を48.5にする。", ["担当者は「するのか？」と尋ねた。", "なぜか？", "値を48.5にする。"]),
    ("รุ่น 9.8 จะเก็บคำถาม ดัชนีจะนับ pickCamera จะตรวจ", ["รุ่น 9.8 จะเก็บคำถาม", "ดัชนีจะนับ pickCamera จะตรวจ"]),
    ("डॉ. Okesun के अनुसार है। क्या फ़ाइल खाली है? नया।", ["डॉ. Okesun के अनुसार है।", "क्या फ़ाइल खाली है?", "नया।"]),
    ("يقول د. Okesun إن الملف. هل الجواب؟ بعد؛ ثم.", ["يقول د. Okesun إن الملف.", "هل الجواب؟", "بعد؛ ثم."]),
])
def test_scripts(text, want):
    assert split(text) == want


def test_blocks():
    text = "# Title one\nText goes\non here.\n\n> Quoted one. More\n> of it.\n\n- item a\n- item b. And c.\n1. first\n2. second\n   goes on\n\n```py\na = 1. Not\n```\nAfter.\n---\n* [x] done\n"
    assert split(text) == ["Title one", "Text goes\non here.", "Quoted one.", "More\n> of it.", "item a", "item b.", "And c.", "first", "second\n   goes on", "After.", "done"]
    assert len(mask(text)) == len(text)
    assert split("see pág.\n16. Cada uno.") == ["see pág.\n16.", "Cada uno."]
    assert split("~~~\nopen fence. never closed") == [] and split("a\n \nb") == ["a", "b"]


def test_defined_cases(spark):
    long = "A sentence here. " * 20_000
    rows = [(1, "One. Two."), (2, None), (3, ""), (4, " \n\t"), (5, "---\n***"), (6, long), (None, "x"), (7, "One. Two.")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start_char int")
    got = {}
    for r in sentences(df).collect():
        got.setdefault(r["doc_id"], []).append((r["position"], r["start_char"], r["end_char"], r["sentence"]))
    assert got[1] == [(0, 0, 4, "One."), (1, 5, 9, "Two.")] == got[7] and len(got[6]) == 20_000 and set(got) == {1, 6, 7}
    assert sentences(df.limit(0)).count() == 0
    assert split("\r\nOne.\r\n\r\nTwo.\r\n") == ["One.", "Two."]


def test_word_lattice_tells_particles_from_words_that_begin_alike():
    lattice = word_lattice(default_vocabulary())
    assert lattice.segment("という話")[0] == ("という", "particle") and lattice.segment("とても良い")[0][1] != "particle"
    assert [w for w, _ in lattice.segment("但是我们没有")] == ["但是", "我们", "没有"]
    assert lattice.around("値は正しいか。」しかし違う", 6, 8) == ("final", "opening") and lattice.around("x", 0, 1) == ("", "")
    path = default_vocabulary()
    go_on, stop = "彼は「遅い。」と言った。", "彼は「遅い。」とても静かだ。"
    assert [go_on[a:b] for a, b in sentence_spans(go_on, path)] == [go_on]
    assert [stop[a:b] for a, b in sentence_spans(stop, path)] == ["彼は「遅い。」", "とても静かだ。"]


def test_thai_gaps_are_cut_whatever_stands_around_them():
    assert split("ดีครับ แต่ช้า ที่นี่") == ["ดีครับ", "แต่ช้า", "ที่นี่"]


def test_thai_gaps_ask_no_word_lattice():
    assert sentence_spans("ดีครับ แต่ช้า ที่นี่", "/no/vocabulary") == [(0, 6), (7, 13), (14, 20)]


def test_terminator_lattice_weighs_the_whole_block():
    assert split('It says "Stop. Go. Wait." and ends. Next.') == ['It says "Stop. Go. Wait." and ends.', "Next."]
    assert split('An open " quote. Then one. And more.') == ['An open " quote.', "Then one.", "And more."]
    assert split("He (see a. Then b. And c.) goes. “One. Two.” Three.") == ["He (see a. Then b. And c.) goes.", "“One.", "Two.”", "Three."]
    assert terminator_path("no mark here") == []


def test_time_grows_with_the_length():
    import time

    text = 'Words (with one. Two. "three. Four." here) go on. ' * 2_000
    began = time.time()
    few = sentence_spans(text)
    first = time.time() - began
    began = time.time()
    assert len(sentence_spans(text * 8)) == 8 * len(few) and time.time() - began < 8 * 4 * first + 1
