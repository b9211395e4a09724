from __future__ import annotations

import random

from papyra.llm import language

# Two sentences a language, in wordings of their own.
TEXTS = {
    "en": ["The weather in the north was colder than they had expected.", "Some of the children and their teachers went to the library by the river."],
    "fr": ["Le boulanger ouvre sa boutique très tôt, puis il prépare du pain pour tout le quartier.", "Hier soir, mes voisins ont oublié leurs clés et ils ont dû attendre dehors."],
    "de": ["Der Bäcker öffnet seinen Laden sehr früh und backt Brot für die ganze Straße.", "Gestern Abend haben meine Nachbarn ihre Schlüssel vergessen und mussten draußen warten."],
    "es": ["El panadero abre su tienda muy temprano y prepara pan para todo el barrio.", "Anoche mis vecinos olvidaron sus llaves y tuvieron que esperar fuera."],
    "zh": ["面包师很早就开门，为整条街的邻居做面包。", "昨天晚上我的邻居忘了带钥匙，只好在外面等。"],
    "ja": ["パン屋さんは朝早く店を開けて、町のみんなのためにパンを焼きます。", "昨日の夜、隣の人が鍵を忘れて、外で待たなければなりませんでした。"],
    "ru": ["Пекарь открывает свою лавку очень рано и печёт хлеб для всей улицы.", "Вчера вечером соседи забыли ключи и ждали на улице."],
}
# Sentences that no machine is trained on.
HELD_OUT = {
    "en": ["My brother bought two tickets, but nobody wanted to come with him.", "Does this road lead to the old harbour?", "We were tired, so we slept until noon."],
    "fr": ["Mon frère a acheté deux billets, mais personne ne voulait venir avec lui.", "Est-ce que cette route mène au vieux port ?", "Nous étions fatigués, alors nous avons dormi jusqu'à midi."],
    "de": ["Mein Bruder hat zwei Karten gekauft, aber niemand wollte mitkommen.", "Führt diese Straße zum alten Hafen?", "Wir waren müde und haben bis zum Mittag geschlafen."],
    "es": ["Mi hermano compró dos entradas, pero ninguno de sus amigos quiso ir con él.", "¿Este camino lleva al puerto viejo?", "Estábamos cansados, así que dormimos hasta el mediodía."],
    "zh": ["我哥哥买了两张票，可是没有人愿意跟他去。", "这条路通到老港口吗？", "我们很累，所以一直睡到中午。"],
    "ja": ["兄は切符を二枚買いましたが、誰も一緒に行きたがりませんでした。", "この道は古い港に続いていますか。", "とても疲れていたので、昼まで寝ていました。"],
    "ru": ["Мой брат купил два билета, но никто не хотел идти с ним.", "Эта дорога ведёт к старому порту?", "Мы устали и спали до полудня."],
}


def test_sentences_of_other_wording():
    m = language.Separator().fit([(t[i], k) for k, t in TEXTS.items() for i in (0, 1)])
    asked = [(k, s) for k, ss in HELD_OUT.items() for s in ss]
    right = [k == m.tell([s])[0][0] for k, s in asked]
    assert sum(right) >= 0.95 * len(right), [x for x, ok in zip(asked, right, strict=True) if not ok]


def test_short_sentences_count_as_a_language(spark):
    text = HELD_OUT["zh"][0] + "Он устал. Мы спали. Они ждали долго." + HELD_OUT["zh"][2]
    rows = [("short", text, "zh"), ("closed", HELD_OUT["fr"][0] + " Соседи забыли свои ключи.", "fr"), ("word", HELD_OUT["fr"][0] + " (Спутник.)", "fr")]
    rows += [(f"x{i}", t[i % 2], k) for i in range(20) for k, t in TEXTS.items()]
    df = spark.createDataFrame(rows, "k string, t string, l string")
    got = {r["k"]: r["langs"] for r in language.label_texts(df, ["k"], "t", language.train(df, "t", "l")).collect()}
    assert [got[k] for k in ("short", "closed", "word")] == [["ru", "zh"], ["fr", "ru"], ["fr"]]


def test_separates_held_out_sentences_despite_wrong_labels():
    rng = random.Random(1)
    labelled = [(t[0], k if rng.random() > 0.3 else rng.choice(language.LANGUAGES)) for k, t in TEXTS.items() for _ in range(30)]
    m = language.Separator().fit(labelled)
    assert [m.tell([t[1]])[0][0] for t in TEXTS.values()] == list(TEXTS)
    assert m.tell(["12 %", ""]) == [(None, 0.0, 0.0)] * 2
    assert all(0.5 < m.tell([t[1]])[0][1] <= 1 for t in TEXTS.values())


def test_declared_names(spark):
    names = {"zh-CN": "zh", "ZHO": "zh", "中文": "zh", "English": "en", "en_GB": "en", "fra": "fr", "日语": "ja", "RU": "ru", "und": None, "?": None, "": None, None: None, " de ": "de"}
    df = spark.createDataFrame([(i, k) for i, k in enumerate(names)], "i int, l string")
    assert [r["d"] for r in df.select("i", language.declared(df["l"]).alias("d")).orderBy("i").collect()] == list(names.values())


def test_texts_segments_and_edge_cases(spark):
    rows = [("one", TEXTS["en"][0], "en"), ("mixed", TEXTS["zh"][0] + " " + TEXTS["fr"][0], "zh"), ("bracket", TEXTS["zh"][1] + "（" + TEXTS["en"][1] + "）", "zh"), ("title", "他读了“The Old Man and the Sea”，然后去了图书馆的 CPU cache 那里。", "zh"), ("none", "12 %", "en"), ("blank", "  ", None), ("null", None, "fr"), ("long", TEXTS["de"][0] * 2000, "de")]
    rows += [(f"x{i}", t[i % 2], k) for i in range(20) for k, t in TEXTS.items()]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "k string, t string, l string, main_lang string")
    m = language.train(df, "t", "l")
    got = {r["k"]: r for r in language.label_texts(df, ["k"], "t", m).collect() if not r["k"].startswith("x")}
    assert {k: r["langs"] for k, r in got.items()} == {"one": ["en"], "mixed": ["fr", "zh"], "bracket": ["en", "zh"], "title": ["zh"], "none": [], "blank": [], "null": [], "long": ["de"]}
    parts = language.label_segments(df.where("k = 'mixed'"), ["k"], "t", m).orderBy("segment").collect()
    assert [r["lang"] for r in parts] == ["zh", "fr"] and "".join(r["segment_text"] for r in parts) == rows[1][1]
    empty = df.limit(0)
    assert language.label_texts(empty, ["k"], "t", language.train(empty, "t", "l")).count() == 0
