import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import garbled, leakage, lookalike, markup, pairs, pieces, repetition, sentences
from quire.llm.ngram import codes, grams, letters

WORDS = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈剑号巨阙珠称夜光"


def prose(rng, n):
    return "".join(rng.choice(WORDS) for _ in range(n))


# Problem 1


@pytest.mark.parametrize(
    ("original", "answer", "defect"),
    [
        ("谁抄录了地钟地契？", "谁抄录了的钟地契？", None),
        ("谁抄录了地契？", None, "empty"),
        ("谁抄录了地契？", " \t​", "empty"),
        ("谁抄录了地契？", "```\n```", "empty"),
        ("谁抄录了地契？", "N/A", "empty"),
        ("谁抄录了地契？", "（空）", "empty"),
        ("谁抄录了地地契？", "谁抄录了地地契？", "copy"),
        ("谁抄录了，地地契？", "修改后：谁抄录了,地地契？", "copy"),
        ("What a a kiln!", "Corrected: What a a kiln!", "copy"),
        ("高下难分高", "高下难分高下", None),
        ("卷三十一页“航图十分牢固。”一句，窑匠已核算算。", "卷三十一页“航图十分牢", "truncated"),
        ("The kiln opened at nine and closed at two two.", "The kiln opened at nine and cl", "truncated"),
        ("The kiln opened at nine and closed at two two.", "The kiln opened at nine and closed at two.", None),
        ("Why did the clerk sketch the frontispiece frontispiece?", "Why did the clerk sketch the frontispiece?", None),
        ("The kiln opened at nine and closed at two two.", "The kiln opened at ni...", "truncated"),
        ("谁抄录了地地契？", "很抱歉，我不能处理这一句，请换一段再试。", "refusal"),
        ("What a a kiln!", "Unfortunately, I must decline to correct this passage.", "refusal"),
        ("谁抄录了地地契？", "The kiln opened at nine.", "other_lang"),
        ("谁抄录了地地契？", "なぜ司書は印章を運んだのか？", "other_lang"),
        ("The kiln opened at nine and the the clerk left.", "Der Lehrling prüfte das Register und die Brücke.", "other_lang"),
        ("“抱歉，我无法再抄录目录了。”他说说。", "“抱歉，我无法再抄录目录了。”他说。", None),
        ("", "", "empty"),
        ("？！", "？！", "empty"),
    ],
)
def test_defects(original, answer, defect):
    assert pairs.defect(original, answer)[0] == defect


#: None of these is among the test data, nor were the templates written from them.
OTHER_REFUSALS = {
    "zh": ["对不起，我没法帮您改这句话。", "很抱歉，我无法协助处理该内容。", "这段话超出了我的能力，请另请高明。", "我拒绝修改这样的句子。", "该文本我不便评价。", "本助手无权更正这份材料。", "抱歉，暂时不能为您润色这一段。", "您的要求我实在办不到，恕不校对。", "请原谅，这个任务我不能完成。", "此段文字我改不了，也不宜代劳。"],
    "en": ["I apologize, but I can't help with that.", "Sorry, I'm unable to edit this paragraph.", "As an assistant I will not rewrite such content.", "We regret that we cannot process your request.", "My apologies; fixing this is beyond my scope.", "I don't feel able to proofread the text.", "Unfortunately this is not something I can revise.", "I refuse to change that sentence.", "I am afraid I cannot comply.", "This passage I cannot improve."],
    "de": ["Es tut mir leid, ich kann diesen Text nicht korrigieren.", "Leider kann ich Ihnen dabei nicht helfen.", "Ich darf diese Anfrage nicht bearbeiten.", "Entschuldigung, eine Verbesserung ist mir nicht möglich, ich muss ablehnen zu helfen.", "Ihre Bitte kann ich nicht erfüllen."],
    "fr": ["Désolé, je ne peux pas vous aider.", "Je refuse de modifier cette phrase.", "Malheureusement, je ne suis pas capable de traiter ce texte, cela n'est pas possible.", "Il m'est impossible de réviser ce contenu, je le regrette.", "Je ne saurais répondre à cette demande."],
    "es": ["Lo siento, no puedo ayudarle con eso.", "Me es imposible revisar este fragmento.", "No estoy en condiciones de modificar la frase; no puedo procesar esta solicitud.", "Esta petición queda fuera de mi alcance.", "Lamento no poder atender su solicitud."],
    "ja": ["申し訳ございませんが、この文章は修正できません。", "すみません、私にはお手伝いできません。", "このリクエストは対応できかねます。", "残念ながら、内容の訂正はいたしかねます。", "ご要望には対応いたしかねます。"],
    "ru": ["Извините, я не могу помочь с этим текстом.", "К сожалению, исправить эту фразу невозможно, я не могу.", "Я отказываюсь редактировать это предложение.", "Этот запрос выходит за рамки моих возможностей.", "Простите, мне нельзя обработать этот отрывок."],
    "ko": ["죄송하지만 이 문장을 고칠 수 없습니다.", "저는 이 요청을 처리할 수 없습니다.", "유감스럽지만 도와드릴 수 없습니다.", "이 내용은 제가 수정하기 어렵습니다.", "죄송합니다. 교정을 거절합니다."],
}


@pytest.mark.parametrize("lang", sorted(OTHER_REFUSALS))
def test_refusals_not_seen_before(lang):
    for original in ("谁抄录了地地契，又把它送到渡口？", "The kiln opened at nine and the the clerk left."):
        got = [pairs.defect(original, x)[0] for x in OTHER_REFUSALS[lang]]
        assert got.count("refusal") >= 0.9 * len(got), [x for x, g in zip(OTHER_REFUSALS[lang], got) if g != "refusal"]


def test_templates_need_denial_and_deed(monkeypatch):
    for text in ("The clerk did not open the kiln today.", "我昨天去了渡口，书稿已经送到。", "Извините, я опоздал.", "Sorry, the barge is late and I have no lamp.", "難しい話を聞いた。"):
        assert not pairs.refuses(text)
    assert pairs.refuses("很抱歉，我无法协助处理该内容。")
    monkeypatch.setattr(pairs, "TEMPLATES", ())
    assert not pairs.refuses("很抱歉，我无法协助处理该内容。")


def test_defect_rows(spark):
    rows = [(1, "谁抄录了地地契？", "谁抄录了地地契？"), (1, "谁抄录了地地契？", "谁抄录了地地契？"), (2, None, None), (3, "甲乙丙", None), (4, prose(random.Random(1), 30000), prose(random.Random(1), 30000))]
    df = spark.createDataFrame(rows, "finding_id long, original_sentence string, corrected_sentence string")
    assert sorted((r["finding_id"], r["defect"]) for r in pairs.defects(df).collect()) == [(1, "copy"), (1, "copy"), (3, "empty"), (4, "copy")]
    assert pairs.defects(df.limit(0)).count() == 0


# Problem 2


@pytest.mark.parametrize(
    ("text", "languages"),
    [
        ("甲<br/>乙", {"html"}), ("甲&nbsp;乙", {"html"}), ("<!-- 待核 -->甲", {"html"}),
        ("# 题\n", {"markdown"}), ("题\n===\n", {"markdown"}), ("- 项\n", {"markdown"}), ("甲**乙**丙", {"markdown"}), ("甲*乙*丙", {"markdown"}), ("[甲](http://x.y)", {"markdown"}), ("甲[^2]", {"markdown"}), ("`x`", {"markdown"}), ("~~甲~~", {"markdown"}), ("|---|---:|", {"markdown"}), ("> 甲", {"markdown"}), ("```\nx\n```", {"markdown"}),
        ("== 题 ==", {"wiki"}), ("[[甲|乙]]", {"wiki"}), ("{{引用|甲}}", {"wiki"}), ("'''甲'''", {"wiki"}), ("{| class=\"x\"\n|}", {"wiki"}), ("[https://x.y 甲]", {"wiki"}),
        ("\\section{甲}", {"latex"}), ("$x_{1}$", {"latex"}), ("\\(a \\leq b\\)", {"latex"}), ("\\textbf{甲}", {"latex"}), ("{\\it 甲}", {"latex"}),
        ("1. 甲\n2、乙", set()), ("每页$18，另计$20。", set()), ("若1 < 63 且 35 > 3，则", set()), ("D:\\稿件\\第3卷", set()), ("字段 page_no_28 与 4*9 一栏，4*7 一栏", set()), ("编号#658，注[2]", set()), ("用 C# 写", set()), ("S = 4 / 18 + 22", set()), ("A & B || C", set()), ("", set()),
    ],
)
def test_constructs(text, languages):
    assert {x[2] for x in markup.constructs(text)} == languages


def test_conversion():
    source = "# 题\n\n甲**乙**[丙](http://x.y)&amp;\n\n- 一\n- 二\n\n| 项 | 值 |\n|---|---|\n| a | 1 |\n\n```\nfor x\n  y\n```\n\n$x_{1}$ 见 \\textbf{丁}。{{引用|戊|页=3}}"
    clean, spans = markup.convert(source)
    assert [k for k, _, _ in spans] == ["heading", "item", "item", "table", "code", "formula"]
    assert "甲乙丙&" in clean and "• 一" in clean and "项\t值" in clean and "    for x\n      y" in clean and "x_{1} 见 丁。戊" in clean
    assert [clean[a:b] for k, a, b in spans if k == "heading"] == ["题"]
    assert markup.convert("") == ("", []) and markup.convert("平文。")[0] == "平文。"


@pytest.mark.parametrize(
    ("text", "kind"),
    [("<!--" + "甲" * 60_000 + "-->", "comment"), ("<pre>" + "甲\n" * 60_000 + "</pre>", "pre"), ("\\(" + "x" * 5000 + "\\)", "formula"), ("\\[" + "x" * 5000 + "\\]", "formula"), ("{{引|" + "甲" * 5000 + "}}", "template"), ("{{引|" * 40 + "甲" + "}}" * 40, "template")],
)
def test_constructs_of_any_length(text, kind):
    found = [x for x in markup.constructs("乙" + text + "丙") if x[3] == kind]
    assert [(a, b) for a, b, _, _ in found] == [(1, 1 + len(text))]
    clean, _ = markup.convert("乙" + text + "丙")
    assert not any(x[3] == kind for x in markup.constructs(clean))


def test_unclosed_constructs_stay_linear():
    import time

    began = time.perf_counter()
    for mark in ("<!--", "<pre>", "\\(", "\\[", "{{", "}}", "<![CDATA["):
        markup.constructs(mark * 20_000)
    assert time.perf_counter() - began < 20


def rendered(blocks, lang):
    """A document in one markup language, and the text and structure that must come out."""
    bold = {"markdown": "**{}**", "html": "<b>{}</b>", "wiki": "'''{}'''", "latex": "\\textbf{{{}}}"}[lang]
    source, plain, kinds = [], [], []
    for kind, body in blocks:
        if kind == "text":
            source.append({"html": "<p>{}</p>"}.get(lang, "{}").format(body[0] + bold.format(body[1]) + body[2]))
            plain.append("".join(body))
        elif kind == "heading":
            source.append({"markdown": "## {}", "html": "<h2>{}</h2>", "wiki": "== {} ==", "latex": "\\section{{{}}}"}[lang].format(body))
            plain.append(body)
            kinds.append("heading")
        elif kind == "items":
            line, before, after = {"markdown": ("- {}", "", ""), "html": ("<li>{}</li>", "<ul>\n", "\n</ul>"), "wiki": ("* {}", "", ""), "latex": ("\\item {}", "\\begin{itemize}\n", "\n\\end{itemize}")}[lang]
            source.append(before + "\n".join(line.format(x) for x in body) + after)
            plain += ["• " + x for x in body]
            kinds += ["item"] * len(body)
        elif kind == "table":
            row, before, after, between = {"markdown": ("| {} | {} |", "", "", "\n"), "html": ("<tr><td>{}</td><td>{}</td></tr>", "<table>\n", "\n</table>", "\n"), "wiki": ("| {} || {}", "{| class=\"x\"\n|-\n", "\n|}", "\n|-\n"), "latex": ("{} & {}", "\\begin{tabular}{ll}\n", "\n\\end{tabular}", " \\\\\n")}[lang]
            rows = [row.format(*r) for r in body]
            if lang == "markdown":
                rows.insert(1, "|---|---|")
            source.append(before + between.join(rows) + after)
            plain += ["\t".join(r) for r in body]
            kinds.append("table")
        else:
            source.append({"markdown": "```\n{}\n```", "html": "<pre>{}</pre>", "wiki": "<pre>{}</pre>", "latex": "\\begin{{verbatim}}\n{}\n\\end{{verbatim}}"}[lang].format("\n".join(body)))
            plain += body
            kinds.append("code")
    return "\n\n".join(source), "\n".join(plain), kinds


@pytest.mark.parametrize("lang", ["markdown", "html", "wiki", "latex"])
def test_rendered_documents_come_back(lang):
    rng = random.Random(24)
    word = lambda: prose(rng, rng.randint(2, 9))
    make = {"text": lambda: (word(), word(), word() + "。"), "heading": word, "items": lambda: [word() for _ in range(rng.randint(1, 4))], "table": lambda: [(word(), word()) for _ in range(rng.randint(1, 3))], "code": lambda: [f"for {k} in range({rng.randint(2, 99)}):" for k in "abc"]}
    same = structured = 0
    for _ in range(150):
        kinds = [rng.choice(list(make)) for _ in range(rng.randint(2, 8))]
        source, plain, expected = rendered([(k, make[k]()) for k in kinds], lang)
        clean, spans = markup.convert(source)
        lines = lambda t: [x.strip() for x in t.split("\n") if x.strip()]
        same += lines(clean) == lines(plain)
        structured += [k for k, _, _ in spans] == expected
    assert same >= 0.98 * 150 and structured >= 0.98 * 150, (same, structured)


def test_region_keeps_the_words():
    weights = markup.learn(["甲乙丙丁戊", "<hr>", "<hr>", "甲乙丙丁"])
    text = "<hr><hr><hr>甲乙丙丁<hr><hr>"
    assert text[slice(*markup.region(text, markup.constructs(text), weights))] == "甲乙丙丁"


def test_markup_rows(spark):
    df = spark.createDataFrame([(1, "# 甲"), (2, None), (3, ""), (4, "平文"), (1, "# 甲"), (5, "<b>甲</b> " * 20000)], "chunk_id long, target string")
    got = markup.cleaned(df, {"word": 1.0}).collect()
    assert sorted((r["chunk_id"], r["languages"]) for r in got) == [(1, ["markdown"]), (1, ["markdown"]), (5, ["html"])]


# Problem 3


def test_pieces():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("甲乙丙丁。，\n a") for _ in range(rng.randint(0, 900)))
        limit, pad = rng.randint(1, 200), rng.randint(0, 80)
        got = pieces.cut(text, limit, pad)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= limit for a, b in got)
        for (_, end), (start, _) in zip(got, got[1:]):
            assert end - start == min(pad, limit - 1)


def test_an_edit_changes_neighbours_only():
    rng = random.Random(5)
    text = "".join(prose(rng, rng.randint(5, 30)) + "。" for _ in range(400))
    edited = text[:3000] + "新增一句。" + text[3000:]
    a, b = ({t[i:j] for i, j in pieces.cut(t, 400, 60)} for t in (text, edited))
    assert len(b - a) <= 4


def test_piece_rows(spark):
    chunks = spark.createDataFrame([(1, "p", "甲" * 30, None), (2, "p", "甲" * 10, "乙" * 21), (3, None, "甲" * 99, "x"), (4, "q", "甲" * 99, "x"), (5, "p", None, None)], "chunk_id long, profile string, target string, context string")
    settings = spark.createDataFrame([("p", 10, None, 20), ("r", 1, 1, 1)], "profile string, cut_by int, context_pad int, max_context int")
    got = pieces.pieces(chunks, settings)
    assert {(r["chunk_id"], r["field"]) for r in got.collect()} == {(1, "target"), (2, "context")}
    assert pieces.pieces(chunks.limit(0), settings).count() == 0


# Problem 4


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("甲。乙！丙？", ["甲。", "乙！", "丙？"]),
        ("他说：“甲。乙？”丙来了。", ["他说：“甲。乙？”", "丙来了。"]),
        ("“甲吗？”他问。乙。", ["“甲吗？”他问。", "乙。"]),
        ("《甲？》一书（旧称乙。）在此。", ["《甲？》一书（旧称乙。）在此。"]),
        ("他想了想……还是走了。", ["他想了想……还是走了。"]),
        ("修好,不大可靠.快走!真的?", ["修好,不大可靠.", "快走!", "真的?"]),
        ("甲\n乙。\n\n丙", ["甲\n乙。", "丙"]),
        ("甲。\r\n\r\n乙", ["甲。", "乙"]),
        ("Dr. Ash met Mr. J. Fox at 9 a.m. on p. 3. He left.", ["Dr. Ash met Mr. J. Fox at 9 a.m. on p. 3.", "He left."]),
        ('"Is it?" asked Ann. "Yes."', ['"Is it?" asked Ann.', '"Yes."']),
        ("glue, thread, etc. No. 62 is 3.5 cm, v1.2.3.", ["glue, thread, etc.", "No. 62 is 3.5 cm, v1.2.3."]),
        ("Am 4. Juni kam er, z. B. früh. „Ist er da?“, fragte sie.", ["Am 4. Juni kam er, z. B. früh.", "„Ist er da?“, fragte sie."]),
        ("« Où est-il ? » demanda-t-il. Oui.", ["« Où est-il ? » demanda-t-il.", "Oui."]),
        ("См. стр. 5, т. е. А. П. Иванова. Да.", ["См. стр. 5, т. е. А. П. Иванова.", "Да."]),
        ("製本屋は「もうない。」と言った。はい。", ["製本屋は「もうない。」と言った。", "はい。"]),
        ("교정자는 “늦었다.”라고 말했다. 예.", ["교정자는 “늦었다.”라고 말했다.", "예."]),
        ("डॉ. माली ने पत्र रखी। क्या खोई?", ["डॉ. माली ने पत्र रखी।", "क्या खोई?"]),
        ("ในปี 1649 คนสวนซ่อม ช่างปั้นเก็บ 3 ชิ้น", ["ในปี 1649 คนสวนซ่อม", "ช่างปั้นเก็บ 3 ชิ้น"]),
        ("لماذا؟ نعم.", ["لماذا؟", "نعم."]),
        ("ខ្ញុំទៅផ្សារ។ គាត់មក។", ["ខ្ញុំទៅផ្សារ។", "គាត់មក។"]),
        ("သူလာသည်။ ကျွန်ုပ်သွားသည်။", ["သူလာသည်။", "ကျွန်ုပ်သွားသည်။"]),
        ("Ｄｒ. Ａｓｈ left. 𝖬𝗋. Fox stayed.", ["Ｄｒ. Ａｓｈ left.", "𝖬𝗋. Fox stayed."]),
        ("ຂ້ອຍໄປຕະຫຼາດ ລາວມາ", ["ຂ້ອຍໄປຕະຫຼາດ", "ລາວມາ"]),
        ("“甲。乙。”", ["“甲。", "乙。”"]),
        ("修改后：“甲吗？”他问。", ["修改后：“甲吗？”他问。"]),
        ("“甲吗？\u200b”\u2063他问。乙\u00ad。", ["“甲吗？\u200b”\u2063他问。", "乙\u00ad。"]),
        ("D\u200br. Ash is 3.\u200b5 cm. Yes.", ["D\u200br. Ash is 3.\u200b5 cm.", "Yes."]),
        ("不足为凭。β版在此。", ["不足为凭。", "β版在此。"]),
        ("他说：“涨水了！快", ["他说：“涨水了！快"]),
        ("甲。……！", ["甲。……！"]),
        ("……", []),
        ("", []),
    ],
)
def test_sentences(text, expected):
    got = [text[a:b] for a, b in sentences.sentence_spans(text, sentences.Words())]
    if text == "甲。……！":
        assert got and got[0].startswith("甲。")
    else:
        assert got == expected


def test_bare_stretch_is_split():
    rng = random.Random(7)
    starts, ends = ["盐贩", "茶商", "渡夫", "药农"], ["走了", "来过", "修好", "不见"]
    unit = lambda: rng.choice(starts) + prose(rng, rng.randint(6, 14)) + rng.choice(ends)
    words = sentences.fit([unit() + "。" for _ in range(2000)])
    made = [unit() for _ in range(12)]
    text = "".join(made)
    want = np.cumsum([len(x) for x in made]).tolist()
    got = [b for _, b in sentences.sentence_spans(text, words)]
    assert len({*got} & {*want}) >= 0.8 * len(want) and len(got) <= 1.3 * len(want)


def test_kana_and_digits_do_not_hide_a_bare_stretch():
    rng = random.Random(23)
    unit = lambda: rng.choice(["製本屋は", "司書が"]) + prose(rng, rng.randint(6, 12)) + str(rng.randint(2, 99)) + rng.choice(["を運びました", "を数えたのです"])
    words = sentences.fit([unit() + "。" for _ in range(1500)])
    made = [unit() for _ in range(10)]
    text = "".join(made)
    want = set(np.cumsum([len(x) for x in made]).tolist())
    got = {b for _, b in sentences.sentence_spans(text, words)}
    assert len(got & want) >= 0.9 * len(want) and len(got) <= 1.2 * len(want)
    words.grams = {}
    assert len(sentences.sentence_spans(text, words)) == 1  # without the n-grams nothing is found


def test_all_answers_tell_abbreviations(spark, tmp_path):
    left = next(r["id"] for r in spark.range(20).selectExpr("id", "pmod(xxhash64(id), 2) AS h").collect() if r["h"])  # a sample of every second key leaves these answers out
    filler = spark.range(30, 24_130).selectExpr("id AS finding_id", "'是。' AS corrected_sentence")
    told = spark.range(400).selectExpr(f"{left}L AS finding_id", "'Here the zzq. of it was seen.' AS corrected_sentence")
    filler.unionByName(told).write.parquet(f"{tmp_path}/max_pipeline.parquet")
    spark.createDataFrame([(1, "paragraph", "He met zzq. Brown there.")], "chunk_id long, kind string, target string").write.parquet(f"{tmp_path}/your_markdown.parquet")
    assert [r["end_pos"] for r in sentences.found(spark, str(tmp_path)).where("tbl = 'your_markdown'").collect()] == [24]


@pytest.mark.parametrize("limit", [0, 200_000])
def test_bare_stretches_meet_the_ngrams_of_all_answers(spark, monkeypatch, limit):
    monkeypatch.setattr(sentences, "KEYS", limit)
    rng = random.Random(7)
    starts, ends = ["盐贩", "茶商", "渡夫", "药农"], ["走了", "来过", "修好", "不见"]
    unit = lambda: rng.choice(starts) + prose(rng, rng.randint(6, 14)) + rng.choice(ends)
    answers = [unit() + "。" for _ in range(600)] + ["", "Plain words."]
    texts = ["".join(unit() for _ in range(8)), "甲。" + "".join(unit() for _ in range(6)) + "。\n\n" + "".join(unit() for _ in range(5)), "甲乙。丙丁。", "", None]
    words = sentences.fit([t for t in answers if t])
    want = sorted((k, a, b) for k, t in enumerate(texts) if t for a, b in sentences.sentence_spans(t, words))
    records = spark.createDataFrame([("t", k, t) for k, t in enumerate(texts)], "tbl string, rec_id long, text string").repartition(3)
    got = sentences.split(records, spark.createDataFrame([(t,) for t in answers], "text string").repartition(5))
    assert sorted((r["rec_id"], r["start_pos"], r["end_pos"]) for r in got.collect()) == want and len(want) > 15


@pytest.mark.parametrize("kinds", [12, 1 << 16])
def test_ngrams_of_a_task_are_counted_at_once(monkeypatch, kinds):
    monkeypatch.setattr(sentences, "KINDS", kinds)
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 30)) + "。" + prose(rng, rng.randint(2, 9)) + "𠀋。" for _ in range(90)] + ["Plain words.", "", None]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10], pa.string())], ["text"]) for k in range(0, len(texts), 10)]
    want, lengths = Counter(), Counter()
    for text in texts[:90]:
        units = text.split("。")[:2]
        lengths.update(map(len, units))
        run = "\n" + "\n".join(units) + "\n"
        grams = [run[k : k + n] for n in range(1, 5) for k in range(len(run) - n + 1)]
        want.update(g for g in grams if "\n" not in g[1:-1])
        want["\n"] -= 1
    out = list(sentences.letter_rows(batches, sentences.Words()))
    rows = [r for batch in out for r in batch.to_pylist()]
    got = Counter()
    for r in rows:
        got[r["gram"]] += r["n"] if r["gram"] else 0
    assert {g: n for g, n in got.items() if g} == want and {r["length"]: r["n"] for r in rows if r["length"]} == lengths
    assert len(out) == 1 and (kinds == 12 or len(rows) == len(want) + len(lengths) + 1)  # once a task, not once a batch; events apart


def test_every_end_mark_ends_a_sentence():
    marks = "\u3002\uff01\uff1f!?\u061f\u0964\u0965\u06d4\uff61\ufe12\uff0e\u1362\u17d4\u17d5\u104b\u0f0d\u0589"
    left = [hex(ord(ch)) for ch in marks if [m.span() for m in sentences.TOKEN.finditer(f"ab{ch}{ch} Cd")] != [(2, 4)]]
    assert not left


def test_only_texts_of_dense_scripts_are_split_for_ngrams(monkeypatch):
    split = []
    monkeypatch.setattr(sentences, "paragraph", lambda text, *_: split.append(text) or [])
    sentences.units_of(["Plain words. And more.", "Слова. Ещё.", "甲乙。"], sentences.Words())
    assert split == ["甲乙。"]


def test_each_character_of_a_bare_stretch_is_weighed_once(monkeypatch):
    asked, log_p = [], sentences.Words.log_p
    monkeypatch.setattr(sentences.Words, "log_p", lambda self, history, ch: asked.append((history, ch)) or log_p(self, history, ch))
    rng = random.Random(3)
    words = sentences.fit([prose(rng, 12) + "。" for _ in range(50)])
    text = prose(rng, 100)
    odds = sentences.event_odds(text, 0, 100, words)
    assert len(asked) <= 5 * 100  # with an event four for each slot, without one each character once

    def without(k):
        return sum(log_p(words, text[max(0, j - 3) : j], text[j]) for j in range(k, min(100, k + 3)))

    def within(k):
        return log_p(words, text[max(0, k - 3) : k], "\n") + sum(log_p(words, ("\n" + text[k:j])[-3:], text[j]) for j in range(k, min(100, k + 3)))

    assert np.allclose(odds, [within(k) - without(k) for k in range(1, 100)])


def test_counts_move_the_prior():
    base = sentences.Words()
    told = sentences.Words(cells={("mark", "clause", "upper"): (0.0, 400.0)}, following={("clause", ""): (200.0, 200.0), ("clause", "said"): (0.0, 50.0)})
    assert told.cell("mark", "clause", "upper", 4.0) < 0 < base.cell("mark", "clause", "upper", 4.0)
    assert told.next_word("clause", "said") < -2 and base.next_word("clause", "said") == 0


def test_posteriors_without_coupling_are_logistic():
    got = sentences.posteriors([2.0, -1.0, 0.5], [False] * 3)
    assert np.allclose(got, 1 / (1 + np.exp([-2.0, 1.0, -0.5])))


# Problem 5


@pytest.fixture(scope="module")
def model():
    rng = random.Random(8)
    lines = [prose(rng, 40) + "，" + prose(rng, 20) + "。" for _ in range(1500)]
    lines += ["Der Müller prüfte die Brücke und die Fähre über dem Gewölbe." for _ in range(60)] + ["Le relevé abîmé est près de l’écluse, à côté." for _ in range(60)] + ["Паромщик сравнил печать в архиве после дождя." for _ in range(60)] + ["SÃO TOMARIM Â"] * 10
    return garbled.fit(lines)


@pytest.mark.parametrize("chain", [("utf-8", "cp1252"), ("utf-8", "gb18030"), ("utf-8", "latin-1"), ("gb18030", "cp1252")])
def test_chains_are_inverted(model, chain):
    rng = random.Random(9)
    clean = prose(rng, 31) + "。" + prose(rng, 20)
    bad = garbled.garble(clean, chain)
    assert garbled.scan([clean, bad], model) == [1]
    _, text, fixes, damage = garbled.restore(bad, model)
    assert fixes and (damage or text == clean or sum(a == b for a, b in zip(text, clean)) > 0.8 * len(clean))


def test_words_in_clean_text(model):
    for bad, good in (("Der MÃ¼ller prüfte die Brücke.", "Der Müller prüfte die Brücke."), ("Паромщик " + garbled.garble("печать", ("utf-8", "cp1251")) + " в архиве.", "Паромщик печать в архиве.")):
        assert garbled.restore(bad, model)[1] == good
    for fine in ("封底印着“SÃO TOMARIM Â”。", "Le relevé abîmé", "café naïf", ""):
        assert garbled.restore(fine, model)[2:] == (0, 0)


def test_letters_that_became_capitals(model):
    swapped = "Паромщик сравнил " + garbled.garble("печать", ("koi8-r", "cp1251")) + " в архиве."
    for bad, good in ((swapped, "Паромщик сравнил печать в архиве."), ("Le relevÈ abîmé", "Le relevé abîmé")):
        assert garbled.restore(bad, model)[1:3] == (good, 1)
    for fine in ("МОСКВА АРХИВ", "iPhoneÉ", "Le RELEVÉ"):
        assert garbled.restore(fine, model)[2:] == (0, 0)


def test_every_strict_chain_is_tried(model, monkeypatch):
    bad = garbled.garble("天地玄黄宇宙洪荒", ("utf-8", "cp1252"))
    monkeypatch.setattr(garbled, "TRIES", 0)
    monkeypatch.setattr(garbled, "LONG", 10**9)
    assert garbled.restore(bad, model)[1] == "天地玄黄宇宙洪荒"


@pytest.mark.parametrize(("chain", "least"), [(("utf-8", "cp1252"), 0.97), (("utf-8", "latin-1"), 0.97), (("utf-8", "gb18030"), 0.6), (("gb18030", "cp1252"), 0.9)])
def test_restored_text_is_the_original(model, chain, least):
    """Held-out texts garbled as a whole: the share of those with every byte left that come back exactly."""
    rng = random.Random(25)
    back = whole = 0
    for _ in range(80):
        clean = prose(rng, rng.randint(20, 60)) + "。" + prose(rng, 15)
        bad = garbled.garble(clean, chain)
        if "\ufffd" not in bad:
            whole += 1
            back += garbled.restore(bad, model)[1] == clean
    assert not whole or back >= least * whole, (back, whole)


def test_garbled_rows(spark, model):
    df = spark.createDataFrame([(1, "地�玄"), (2, None), (3, ""), (4, "天地玄黄"), (1, "地�玄")], "chunk_id long, target string")
    assert [r["chunk_id"] for r in garbled.restored(df, model).collect()] == [1, 1]


def test_lone_damage_is_found(spark, model):
    texts = ["天地玄黄\ue000宇宙洪荒。", "Der Müller prüfte\x85 die Brücke.", "Der Müller\x81 prüfte die Brücke."]
    unseen = garbled.Model(model.best - 100, model.odds, model.common)  # a score that no text reaches
    assert garbled.scan(texts, unseen) == []
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, target string")
    assert sorted((r["chunk_id"], r["damage"]) for r in garbled.restored(df, unseen).collect()) == [(0, 1), (2, 1)]


def test_characters_are_counted_in_all_rows(spark, tmp_path):
    rng = random.Random(10)
    rare, chain = "벽새용조", ("utf-8", "cp1252")
    rows = [(k, prose(rng, 12) + "。") for k in range(18_000)]
    rows += [(18_000 + k, f"天地{rare}玄黄。") for k in range(4)] + [(18_010, "天地" + garbled.garble(rare * 3, chain) + "玄黄。")]
    spark.createDataFrame(rows, "chunk_id long, target string").write.parquet(f"{tmp_path}/your_markdown.parquet")
    got = {r["chunk_id"]: r["restored"] for r in garbled.repairs(spark, str(tmp_path)).collect()}
    assert got == {18_010: "天地" + rare * 3 + "玄黄。"}


def test_words_are_counted_in_all_rows(spark, tmp_path):
    left = next(r["id"] for r in spark.range(20).selectExpr("id", "pmod(xxhash64(id), 2) AS h").collect() if r["h"])  # a sample of every second key leaves these rows out
    rng = random.Random(11)
    swapped = "Паромщик сравнил " + garbled.garble("печать", ("koi8-r", "cp1251")) + " в архиве."
    rows = [(k, prose(rng, 12) + "。") for k in range(30, 12_030)] + [(left, "Паромщик сравнил печать в архиве после дождя.")] * 60 + [(20_000, swapped)]
    spark.createDataFrame(rows, "chunk_id long, target string").write.parquet(f"{tmp_path}/your_markdown.parquet")
    assert {r["chunk_id"]: r["restored"] for r in garbled.repairs(spark, str(tmp_path)).collect()} == {20_000: "Паромщик сравнил печать в архиве."}


def test_counts_of_parts_make_the_model_of_the_whole(spark):
    rng = random.Random(12)
    texts = [prose(rng, 30) + "。\n" + prose(rng, 9) for _ in range(300)] + ["Der Müller prüfte die Brücke.", "Паромщик сравнил печать.", "印刷工がインクを運んだ。", "인쇄공이 왔다.", "plain", "", "甲�"] * 20
    texts += [garbled.garble(texts[0], ("utf-8", "cp1252"))] * 2
    want = garbled.fit(texts)
    rows = [(k, t) for k, t in enumerate([*texts, None])]
    got = garbled.fitted(spark.createDataFrame(rows, "chunk_id long, target string").repartition(7))
    assert (got.odds == want.odds).all() and (got.best == want.best).all() and got.pairs == want.pairs
    lines = garbled.Tally()
    lines.add(texts[:300])
    for chain in garbled.CHAINS:  # those read by single bytes are derived and not garbled
        have = [x for t in texts[:300] for x in t.split("\n") if x.encode(chain[0], "ignore").decode(chain[0]) == x]
        assert (lines.of_chain(chain) == garbled.pairs_of(garbled.garble("\n".join(["", *have, ""]), chain).encode()) * bool(have)).all()


# Problem 6


def spelled(text, words):
    trie = lookalike.build(words)
    return {m[0]: c for m, ask in lookalike.words_of(lookalike.composed(text)[1]) if ask and (c := lookalike.canonical(m[0], trie))}


def test_automaton_takes_the_cheapest_spelling():
    trie = lookalike.build({"copy": 3, "сорт": 9, "Copy": 1, "коpа": 2})
    assert lookalike.canonical("сору", trie) == "copy"  # Cyrillic letters at no cost
    assert lookalike.canonical("Сору", trie) == "Copy"  # the same case before another
    assert lookalike.canonical("с\u200bo\u00adру", trie) == "copy"
    assert lookalike.canonical("сapy", trie) is None and lookalike.canonical("cop", trie) is None  # an edit leads to another word
    assert lookalike.canonical("COPY", lookalike.build({"copy": 1})) is None  # four times another case is beyond the budget
    assert lookalike.canonical("bυt", lookalike.build({"but": 2, "bυt": 1})) == "but"  # of equal cost the more frequent


def test_vocabulary_decides(spark):
    rows = [("a", 1, "copy copy copy сору река река река"), ("a", 2, "a сору of"), ("a", 3, "peкa"), ("a", 4, "a рое of")]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, text string")
    got = {r["rec_id"]: r["normalized"] for r in lookalike.normalized(df).collect()}
    assert got == {2: "a copy of", 3: "река"}  # without the vocabulary "сору" is a word of its own
    assert lookalike.normalize("a сору of", {}) == ("", "a сору of")


def test_vocabulary_decides_on_capitals_and_misspelled_words(spark):
    rows = [("a", 1, "copy copying copy copying copy copying"), ("a", 2, "THE СОРУ OF"), ("a", 3, "a соруng of"), ("a", 4, "a Сорyying of"), ("a", 5, "THE СОРЕ OF"), ("a", 6, "a сорe of")]
    df = spark.createDataFrame(rows, "tbl string, rec_id long, text string")
    got = {r["rec_id"]: r["normalized"] for r in lookalike.normalized(df).collect()}
    # an edit tells the script of a word of two scripts and leaves its letters; a word of one script is no other word, and a short one is too near to others
    assert got == {2: "THE COPY OF", 3: "a copyng of", 4: "a Copyying of", 6: "a соре of"}


def test_an_edit_tells_only_a_script_the_word_could_be_of():
    assert lookalike.open_scripts("соруng") == {"C", "L"} and not lookalike.open_scripts("сорe")
    token, other = "aoχptik", "аортік"  # Latin and one Greek letter; a Cyrillic word that looks like it but for one letter
    assert lookalike.open_scripts(token) == {"L", "G"} and lookalike.spelling(token, lookalike.build({other: 9}), 2.0)
    tries = {"L": lookalike.build({"aoxptk": 3}), "C": lookalike.build({other: 9})}
    assert lookalike.matched(token, tries)[2] == "aoxptk" and lookalike.matched(token, {"C": tries["C"]}) is None


@pytest.mark.parametrize(
    ("text", "plain"),
    [
        ("ＡＢ１２", "AB12"), ("\uff72\uff9d\uff78", "インク"), ("\u2f08\u2f2d", "人山"), ("\uf9ba", "了"), ("\ufb01rst", "first"), ("\U0001d41e\U0001d5c7", "en"), ("\u304b\u3099", "\u304c"), ("e\u0301", "\u00e9"), ("\u1100\u1161\u11a8", "\uac01"),
        ("甲\u200b乙\u00ad丙", "甲乙丙"), ("甲\u00a0乙\u2009丙", "甲 乙 丙"),
        ("Тhe рapеr", "The paper"), ("пaрoмщик", "паромщик"), ("bυt", "but"),
    ],
)
def test_forms(text, plain):
    signs, got = lookalike.normalize(text, spelled(text, {"the": 3, "paper": 3, "but": 3}))
    assert signs and got == plain


@pytest.mark.parametrize("text", ["甲，乙！（丙）；“丁”…", "Grade β paper", "α版", "тетрадь и карта", "甲　乙\t丙\r\n丁", "น้ำ", "™℃№", "café", "डॉ. पुस्तक", "", "Ωμέγα"])
def test_no_forms(text):
    assert lookalike.normalize(text, spelled(text, {"paper": 3})) == ("", text)


@pytest.mark.parametrize("limit", [100_000, -1])
def test_look_alike_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(lookalike, "CANON_ROWS", limit)
    df = spark.createDataFrame([("a", 1, "a сору of"), ("a", 2, None), ("a", 3, ""), ("b", 1, "a сору of"), ("a", 4, "Ａ" * 50000), ("c", 9, "copy copy copy")], "tbl string, rec_id long, text string")
    assert sorted((r["tbl"], r["rec_id"]) for r in lookalike.normalized(df).collect()) == [("a", 1), ("a", 4), ("b", 1)]


# Problem 8


def leaked(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leakage.leaks(d, i).collect())


def test_leaks(spark):
    rng = random.Random(11)
    items = [(k, "请阅读下文。" + prose(rng, 120)) for k in range(30)] + [(99, None), (98, ""), (97, "短")]
    text = lambda k: items[k][1]
    edited = "".join(ch if n % 25 else "改" for n, ch in enumerate(text(3)[10:90]))
    docs = [(1, prose(rng, 300) + text(0) + prose(rng, 50)), (2, prose(rng, 100) + edited + prose(rng, 9)), (3, "请阅读下文。" + prose(rng, 200)), (4, text(5)[20:60]), (5, text(6)[6:50] + "插入几个字" + text(6)[50:100]), (6, None), (7, ""), (8, "\n".join(text(7)[6:90])), (8, text(8))]
    assert leaked(spark, docs, items) == [(1, 0), (2, 3), (5, 6), (8, 7), (8, 8)]
    assert leaked(spark, docs[:0] or [(1, None)], items) == []
    assert leaked(spark, docs, [(1, None)]) == []


def test_prefix_loses_no_pair_and_joins_less(spark):
    rng = random.Random(12)
    stock = "请找出下列段落中的错误并逐条写在答卷背面"
    texts = [stock + prose(rng, 90) for _ in range(20)]
    docs = [(k, prose(rng, 40) + t[len(stock) + 10 : len(stock) + 75] + prose(rng, 40)) for k, t in enumerate(texts)] + [(100 + k, stock + prose(rng, 60)) for k in range(20)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    items = leakage.items_of(spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")).cache()
    bits = leakage.bitmap_of(items)[0]
    windows = leakage.windows_of(d, bits, 1).cache()
    places = [(r["doc_id"], r["key"]) for r in leakage.candidates_of(windows, items, 10_000).join(windows, "win").select("doc_id", "key").distinct().collect()]
    key = {r["item_id"]: r["key"] for r in items.collect()}
    assert {(k, key[k]) for k in range(20)} <= set(places)
    shared = windows.select("doc_id", F.explode("gram").alias("gram")).join(items.select("key", F.explode("gram").alias("gram")), "gram").select("doc_id", "key").distinct()
    assert len(places) < shared.count() / 5  # without prefix and bounds every text with the stock words meets every item
    assert leaked(spark, docs, list(enumerate(texts))) == [(k, k) for k in range(20)]


def test_hot_shingles_are_split_and_lose_nothing(spark, monkeypatch):
    rng = random.Random(18)
    item = prose(rng, 80)
    docs = [(k, prose(rng, 30) + item + prose(rng, 30)) for k in range(60)]
    for name, value in (("HOT", 10_000), ("PREFIX_ROWS", -1), ("HOT", 2), ("ITEM_BYTES", -1)):
        monkeypatch.setattr(leakage, name, value)
        assert leaked(spark, docs, [(1, item), (1, item), (2, prose(rng, 90))]) == sorted([(k, 1) for k in range(60)] * 2)


def test_corpus_is_read_once(spark, tmp_path):
    rng = random.Random(19)
    texts = [prose(rng, 100) for _ in range(50)]
    spark.createDataFrame([(k, prose(rng, 50) + t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    got = leakage.leaks(spark.read.parquet(str(tmp_path / "d")), items)
    assert "parquet" not in got._jdf.queryExecution().executedPlan().toString().lower()  # what is left reads the windows only
    assert got.count() == 50


# Problem 9


def brute_share(text):
    x = letters(text)
    seen, marked = set(), [False] * len(x)
    for k in range(len(x) - 29):
        g = x[k : k + 30]
        if g in seen:
            marked[k : k + 30] = [True] * 30
        seen.add(g)
    return sum(marked) / len(x) if x else 0.0


def test_exact_share():
    rng = random.Random(13)
    texts = ["", "甲", None or "。", "a" * 100]
    for _ in range(60):
        parts = [prose(rng, rng.randint(20, 60)) for _ in range(rng.randint(1, 6))]
        texts.append("。\n".join(rng.choice(parts) for _ in range(rng.randint(1, 12))))
    assert np.allclose(repetition.exact_shares(texts), [brute_share(t) for t in texts])


@pytest.fixture(scope="module")
def field():
    rng = random.Random(20)
    return repetition.fit(["。".join(prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(3, 12))) for _ in range(120)])


def labelled_share(texts, field):
    _, _, size, bad = repetition.label_batch(texts, *field)
    return bad / size


def test_labels_decide_like_the_exact_share(field):
    rng = random.Random(14)
    texts = []
    for _ in range(400):
        parts = [prose(rng, rng.randint(15, 60)) for _ in range(rng.randint(2, 8))]
        texts.append("。".join([*parts, *(rng.choice(parts) for _ in range(rng.randint(0, 8)))]))
    exact, share = repetition.exact_shares(texts), labelled_share(texts, field)
    assert (share[exact >= repetition.SHARE] >= repetition.LEAST).all()
    clear = (exact < 0.2) | (exact > 0.4)
    assert np.mean((share >= repetition.SHARE)[clear] == (exact >= repetition.SHARE)[clear]) > 0.95


def test_every_run_labels_a_unit(field):
    rng = random.Random(17)
    texts = []
    for _ in range(300):  # runs of just 30 letters between fresh ones, with no marks at all
        runs = [prose(rng, 30) for _ in range(3)]
        texts.append("".join(runs) + "".join(prose(rng, rng.randint(1, 40)) + rng.choice(runs) for _ in range(rng.randint(2, 8))))
    exact, share = repetition.exact_shares(texts), labelled_share(texts, field)
    assert (exact >= repetition.SHARE).sum() > 50 and (share[exact >= repetition.SHARE] >= repetition.LEAST).all()


def test_without_the_field_nothing_is_found(spark, field):
    s = prose(random.Random(21), 60)
    df = spark.createDataFrame([(1, s + "。" + s)], "doc_id long, text string")
    zero = tuple(np.zeros_like(x) for x in field)
    assert repetition.labelled(df, field, repetition.LEAST).count() == 1 and repetition.labelled(df, zero, repetition.LEAST).count() == 0
    assert not repetition.fit([])[0].any() and not repetition.fit(["短"])[0].any()


def test_forward_backward_sums_to_one():
    rng = np.random.default_rng(22)
    post, pair = repetition.forward_backward(rng.normal(size=(3, 6, 2)), rng.normal(size=(2, 2)))
    assert np.allclose(post.sum(2), 1) and np.isclose(pair.sum(), 15)


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(15)
    for _ in range(50):
        score, trans = rng.normal(size=(6, 2)), rng.normal(size=(2, 2))
        total = lambda y: sum(score[t, y[t]] for t in range(6)) + sum(trans[y[t], y[t + 1]] for t in range(5))  # noqa: E731, B023
        best = max(product((0, 1), repeat=6), key=total)
        assert repetition.viterbi(score, trans).astype(int).tolist() == list(best)


def test_repetition_rows(spark, field):
    rng = random.Random(16)
    s = prose(rng, 50)
    df = spark.createDataFrame([(1, s + "。" + s), (2, None), (3, ""), (4, prose(rng, 200)), (1, s + "。" + s)], "doc_id long, text string")
    assert [r["doc_id"] for r in repetition.labelled(df, field, 0.1).where("repeated_share >= 0.3").collect()] == [1, 1]
    assert repetition.labelled(df, field, 0.0).count() == 5


def test_grams_tell_positions_apart():
    chars, _ = codes(["abcabcabd"])
    for n in (1, 2, 3, 5, 6, 7):
        h = grams(chars, n)
        assert all((h[i] == h[j]) == ("abcabcabd"[i : i + n] == "abcabcabd"[j : j + n]) for i in range(len(h)) for j in range(len(h)))
