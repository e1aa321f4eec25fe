"""Problem 1: broken prompt and response pairs.

Prompt and response are aligned by the containment of their character shingles and by their longest
common subsequence: copies keep every letter of the prompt in one block, truncated answers leave its
tail unmatched, and answers that share too little are aligned with refusal templates and compared in
language. A template is an order of words (regret, speaker, request, denial, deed) with gaps; an answer is
aligned by the heaviest common subsequence of its words and the template.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, spread, table
from .leakage import common_subsequence
from .ngram import NOT_ALNUM

SHARED = 0.45  # shingles of the answer that a real correction shares with the original, at least
TAIL_LETTERS, TAIL_SHARE = 8, 0.2  # unmatched end of the original from which an ended answer still counts as broken off

#: What stands for "nothing", letters and digits only.
NOTHING = frozenset("无 空 没有 暂无 无内容 略 na none null nil nan undefined empty nothing なし 無し 없음 нет ninguno keine aucun".split())

#: The words of refusal templates, by language: S regret, I the speaker, T what was asked for, N denial, R denial that says regret, D the deed denied.
#: Words of languages with blanks are stems that any ending may follow; ``=`` ends a whole word.
REFUSAL_WORDS = {
    "zh": {
        "S": "抱歉 对不起 不好意思 遗憾 见谅 谅解 原谅 恕",
        "I": "我 本人 助手 系统 模型 本站",
        "T": "请求 要求 内容 文字 文本 句子 这句 这段 这一句 该句 原文 任务 段落 材料 问题 这话 句话 委托",
        "N": "无法 不能 不可 不便 不予 不宜 不适合 不会 不愿 没有办法 没办法 没法 难以 拒绝 婉拒 谢绝 无权 无从 未能 超出 不在 做不到 办不到 帮不了 改不了 处理不了 不了",
        "R": "恕难 恕不 碍难 爱莫能助",
        "D": "处理 修改 校对 校改 改写 修订 更正 纠正 改正 润色 编辑 评论 评价 回答 回应 提供 给出 协助 帮助 帮您 帮你 帮忙 完成 满足 受理 答复 支持 执行 范围 权限 能力 改动 代劳 改 办",
    },
    "ja": {
        "S": "申し訳 すみません 恐れ入り 恐縮 残念 あいにく ごめん 失礼",
        "I": "私 わたし 当方 アシスタント こちら 弊",
        "T": "内容 文章 この文 依頼 要望 リクエスト テキスト 原文 質問 一文 ご希望",
        "N": "できません 出来ません できかね いたしかね 致しかね しかね 控え お断り 辞退 応えできません 応じられません 応じかね 対象外 範囲外 不可能 難しい られません 致しません 遠慮",
        "D": "校正 修正 直す 直し 訂正 添削 編集 書き換え 対応 お手伝い 手伝 お応え 応え 応じ 処理 回答 提供 コメント 支援 改稿 推敲 お答え",
    },
    "ko": {
        "S": "죄송 미안 유감 아쉽 안타깝",
        "I": "저는 제가 저로서는 도우미 저희",
        "T": "문장 내용 요청 글 텍스트 원문 질문 부탁",
        "N": "수없 없습니다 못합니다 어렵습니다 불가 거절 거부 않겠 드릴수없 벗어나 못해 곤란",
        "D": "수정 교정 도와 도움 처리 고칠 고쳐 편집 답변 제공 응할 응답 범위 다듬 작성 검토",
    },
    "th": {
        "S": "ขออภัย ขอโทษ เสียใจ",
        "I": "ฉัน ผม ดิฉัน เรา ผู้ช่วย",
        "T": "ข้อความ ประโยค คำขอ เนื้อหา",
        "N": "ไม่สามารถ ไม่ได้ ปฏิเสธ ไม่อาจ ไม่ขอ เกินขอบเขต",
        "D": "แก้ไข ช่วย ตรวจ ปรับ ดำเนินการ ตอบ ให้",
    },
    "en": {
        "S": "sorry apolog unfortunate regret afraid forgive pardon",
        "I": "i= im= we= ill= id= ive= assistant model= my= me=",
        "T": "request text= sentence passage content this= that= it= task paragraph question",
        "N": "cannot cant= unable not= wont= couldnt= dont= decline declin refus outside beyond impossible unwilling prohibit refrain",
        "D": "help assist correct revis edit rewrit chang comment fulfil process handl provid proofread= proofreading= answer respond complet do= comply support improv fix= fixing modif accommodat scope remit work= perform",
    },
    "de": {
        "S": "leider entschuldig bedau verzeih tut=",
        "I": "ich mir mich wir uns assistent",
        "T": "satz text= textes anfrage inhalt abschnitt bitte= aufgabe passage dies= diese= diesen= dazu",
        "N": "nicht kein keine keinen unmöglich ablehn lehne verweiger außerhalb übersteigt unzulässig",
        "D": "korrig korrektur bearbeit überarbeit helf hilf änder verbesser beantwort liefer umschreib kommentier lektorier erfüll leisten behilflich entsprech verarbeit",
    },
    "fr": {
        "S": "désol regret malheureus excus pardon navré",
        "I": "je= j= moi me= nous assistant ma= mes=",
        "T": "texte phrase passage demande contenu cette ce= cela requête",
        "N": "pas= impossible refus décline déclin dépasse dépass incapable ne= hors aucun saurais",
        "D": "corrig correct révis modif aid traiter traite répond reformul réécri comment fourni donner suite satisfaire accéder retouch peux= possible= mesure= faire",
    },
    "es": {
        "S": "siento lament perdón disculp desgraciad desafortunad",
        "I": "yo= me= puedo= podemos= asistente mis= estoy= soy= debo= mi=",
        "T": "texto frase pasaje solicitud petición contenido esta= este= esto= oración fragmento",
        "N": "no= imposible rechaz decl rehús niego fuera excede supera ningun",
        "D": "correg corrig corrección revis edit modific ayud procesar respond reescrib coment proporcion atend complet cambi alcance posible= tramit",
    },
    "ru": {
        "S": "извин прости сожален увы=",
        "I": "я= мне= мы= ассистент помощник нам=",
        "T": "текст фраз предложени отрыв запрос содержан это= этот= эту= просьб",
        "N": "не= невозможно отказ вынужден нельзя выходит вне=",
        "D": "исправ редактир помоч помощ обработ измен правк прав ответ предостав комментир переписа выполн рамк возможност проверить",
    },
    "ar": {
        "S": "عذرا آسف أعتذر للأسف نعتذر",
        "I": "أنا لي= أستطيع يمكنني أقدر بإمكاني يسعني",
        "T": "النص الجملة الطلب طلب المحتوى الفقرة هذا هذه طلبك",
        "N": "لا= لن= أرفض يتعذر عاجز خارج ليس غير لست",
        "D": "تصحيح تعديل مساعد تحرير معالجة أصحح أعدل أساعد الرد التعليق تنقيح نطاق تلبية أستطيع يمكن",
    },
    "hi": {
        "S": "क्षमा माफ खेद दुर्भाग्य",
        "I": "मैं मुझे हम सहायक",
        "T": "वाक्य पाठ अनुरोध सामग्री इस यह",
        "N": "नहीं असमर्थ अस्वीकार बाहर न=",
        "D": "सुधार संपादन मदद सहायता संशोधन ठीक बदल उत्तर पूरा जाँच संसाधित",
    },
}
#: What an aligned word of a template counts. A refusal denies a deed and says who denies or what was asked.
WEIGHT = {"S": 1, "I": 1, "T": 1, "N": 2, "R": 3, "D": 2}
REFUSED = 5
#: Orders of the words; other words may stand between them, and any but REFUSED's worth may be missing.
TEMPLATES = ("SITNDT", "SITDNT", "SNIDT")
WITHIN = {True: 18, False: 48}  # letters between two words of one template, in scripts without and with blanks

#: Frequent short words that tell Latin languages apart.
WORDS_OF = {
    "en": frozenset("the of and to in is it was for from on with that by at how why what who has have had not or as be a an its her his no one never".split()),
    "de": frozenset("der die das und ist nicht ein eine mit auf im am den dem des von zu zum zur er sie war wer warum wenn auch als schon vor bei sagte um".split()),
    "fr": frozenset("le la les un une des et est dans du de en au aux il elle qui que ce cette pour sur par pas où pourquoi a dès après avant malgré quelle".split()),
    "es": frozenset("el la los las un una y es en de del al por que qué con sin se no para su está dónde según más después cómo".split()),
}

END = re.compile(r"[。.?？！!।؟۔︒｡﹒…]+[\"'”’»“」』）)\]】›》〉*_~`\s​]*$")
CLOSERS = re.compile(r"[\"'”’»«“」』）)\]】›》〉*_~`\s​]+$")
DOTS = re.compile(r"…|\.{2,}")
BREAK = re.compile(r"[^\w\s]|[\n\r]|_")

ROWS = "finding_id long, defect string, containment double"


def letters(text: str) -> str:
    return NOT_ALNUM.sub("", text)


def shingles(text: str, n: int) -> set[str]:
    return {text[k : k + n] for k in range(len(text) - n + 1)} or {text}


def language(text: str) -> str:
    """zh, ja, ko, ru, ar, hi, th, el, he or a Latin language (``la`` if its words do not tell)."""
    n = {"L": 0, "H": 0, "K": 0, "ko": 0, "ru": 0, "ar": 0, "hi": 0, "th": 0, "el": 0, "he": 0}
    for ch in text:
        o = ord(ch)
        if o < 0x250:
            n["L"] += ch.isalpha()
        elif 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF or 0xF900 <= o <= 0xFAFF or 0x2F00 <= o <= 0x2FDF or o >= 0x20000:
            n["H"] += 3
        elif 0x3041 <= o <= 0x30FF or 0xFF66 <= o <= 0xFF9D:
            n["K"] += 2
        elif 0xAC00 <= o <= 0xD7A3 or 0x1100 <= o <= 0x11FF:
            n["ko"] += 2
        elif 0x400 <= o <= 0x52F:
            n["ru"] += 1
        elif 0x600 <= o <= 0x6FF:
            n["ar"] += 1
        elif 0x900 <= o <= 0x97F:
            n["hi"] += 1
        elif 0xE00 <= o <= 0xE7F:
            n["th"] += 1
        elif 0x370 <= o <= 0x3FF:
            n["el"] += 1
        elif 0x590 <= o <= 0x5FF:
            n["he"] += 1
        elif 0xFF21 <= o <= 0xFF5A or 0x1D400 <= o <= 0x1D7FF:
            n["L"] += 1
    top = max(n, key=n.get)
    if n["K"] and (top == "K" or top == "H") and n["K"] * 12 >= n["H"]:
        return "ja"
    if top == "H":
        return "zh"
    if top == "K":
        return "ja"
    if top != "L":
        return top
    words = re.findall(r"[^\W\d_]+", text.lower())
    score = {k: sum(w in v for w in words) for k, v in WORDS_OF.items()}
    best = max(score, key=score.get)
    return best if score[best] and sum(v == score[best] for v in score.values()) == 1 else "la"


DENSE = frozenset(("zh", "ja", "ko", "th"))


def _pattern(words: dict[str, str], dense: bool) -> re.Pattern:
    parts = []
    for sign in "RNDTIS":
        for w in words.get(sign, "").split():
            parts.append((len(w), sign, re.escape(w) if dense else rf"\b{re.escape(w[:-1])}\b" if w.endswith("=") else rf"\b{re.escape(w)}\w*"))
    parts.sort(key=lambda p: -p[0])  # longer words first
    return re.compile("|".join(f"(?P<{sign}{k}>{p})" for k, (_, sign, p) in enumerate(parts)))


PATTERNS = {lang: _pattern(words, lang in DENSE) for lang, words in REFUSAL_WORDS.items()}
APOSTROPHE = re.compile("(?<=[^\\W\\d_])['’](?=[^\\W\\d_])")


def aligned(answer: str, lang: str) -> int:
    """Weight of the best alignment of the answer's words with a refusal template: a common subsequence with bounded gaps."""
    dense = lang in DENSE
    # French elides before its words, English contracts within them
    text = NOT_ALNUM.sub("", answer.lower()) if dense else APOSTROPHE.sub(" " if lang in ("fr", "de") else "", answer.lower())
    best, within = 0, WITHIN[dense]
    last = [[(-(10**9), 0)] * len(t) for t in TEMPLATES]  # of each place in each template: (end, weight) of the latest alignment up to it
    for m in PATTERNS[lang].finditer(text):
        sign = m.lastgroup[0]
        for t, ends in zip(TEMPLATES, last):
            for j in range(len(t) - 1, -1, -1):
                if t[j] == sign or t[j] == "N" and sign == "R":
                    before = max((w for end, w in ends[:j] if m.start() - end <= within), default=0)
                    if ends[j][1] <= before + WEIGHT[sign] or m.start() - ends[j][0] > within:
                        ends[j] = m.end(), before + WEIGHT[sign]
                    best = max(best, ends[j][1])
    return best


def refuses(answer: str) -> bool:
    """Whether the answer aligns with a refusal template of its language; short Latin answers may be of any Latin language."""
    lang = language(answer)
    return any(aligned(answer, x) >= REFUSED for x in (WORDS_OF if lang in WORDS_OF or lang == "la" else (lang,) if lang in PATTERNS else ()))


def wraps(original: str, answer: str, o: str, a: str) -> bool:
    """Whether what the answer has around the original's letters is set off from them by a mark."""
    at = a.find(o)
    while at >= 0:
        where = [k for k, ch in enumerate(answer) if ch.isalnum()]  # a wrapper is rare, so the positions are only made here
        before = at == 0 or BREAK.search(answer, where[at - 1] + 1, where[at])
        end = at + len(o)
        after = end == len(a) or BREAK.search(answer, where[end - 1] + 1, where[end])
        if before and after:
            return True
        at = a.find(o, at + 1)
    return False


def tail(o: str, a: str) -> int:
    """Letters at the end of the original that follow its shortest beginning with the whole common subsequence."""
    whole = common_subsequence(o, a)
    low, high = 0, len(o)
    while low < high:
        mid = (low + high) // 2
        if common_subsequence(o[:mid], a) >= whole:
            high = mid
        else:
            low = mid + 1
    return len(o) - low


def defect(original: str, answer: str | None) -> tuple[str | None, float]:
    """``(defect or None, share of the answer's shingles found in the original)``.

    The order is empty, copy, refusal, other_lang, truncated. An original without letters has no copies.
    """
    a = letters(answer) if answer else ""
    if not a or a.lower() in NOTHING and letters(original).lower() != a.lower():
        return "empty", 0.0
    o = letters(original)
    dense = sum(ord(ch) > 0x2E7F for ch in a) * 2 > len(a)
    n = min(2 if dense else 3, max(1, len(a)))
    theirs = a.lower()
    mine, was_ = shingles(theirs, n), shingles(o.lower(), n)
    common = len(mine & was_)
    # a copy holds all shingles of the original and all its letters in order; exactly, in one block that marks set off
    if o and common == len(was_) and (len(o) < n or common_subsequence(o, a) == len(o)) and (a == o or wraps(original, answer, o, a)):
        return "copy", 1.0
    share = common / len(mine)
    if share < SHARED:
        if refuses(answer):
            return "refusal", share
        was, now = language(original), language(answer)
        if was != now and "la" not in (was, now) or was != now and (was in WORDS_OF) + (now in WORDS_OF) < 2 and not ({was, now} <= {"la", *WORDS_OF}):
            return "other_lang", share
    elif len(a) > 1.2 * len(o) and refuses(answer) and not refuses(original):
        return "refusal", share
    text = answer.rstrip()
    ended = END.search(text)
    if ended and (not DOTS.search(ended[0]) or DOTS.search(original[-8:]) or CLOSERS.search(text)):
        if len(a) < (1 - TAIL_SHARE) * len(o) and share >= SHARED and not theirs.endswith(o.lower()[-4:]):
            t = tail(o, a)
            if t >= TAIL_LETTERS and t > TAIL_SHARE * len(o):
                return "truncated", share
        return None, share
    if ended or END.search(original.rstrip()):
        return "truncated", share
    t = tail(o, a)  # the original has no end mark either, as in Thai
    return ("truncated" if t >= 2 and len(a) <= len(o) - 2 else None), share


def defects(findings: DataFrame) -> DataFrame:
    """``finding_id, defect, containment`` of every defective pair.

    ``findings``: finding_id, original_sentence, corrected_sentence. A null original is no pair; a null answer is
    ``empty``. Whole texts are compared; repeated rows come out each for itself.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, kinds, shares = [], [], []
        for k, (original, answer) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            kind, share = defect(original, answer)
            if kind:
                keep.append(k)
                kinds.append(kind)
                shares.append(share)
        if not keep:
            return None
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(kinds), pa.array(shares, pa.float64())], ["finding_id", "defect", "containment"])

    pairs = findings.where(F.col("original_sentence").isNotNull()).select(F.col("finding_id").cast("long"), "original_sentence", "corrected_sentence")
    return arrow_map(pairs, rows, ROWS)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(spread(table(spark, sf_dir, "max_pipeline", "finding_id", "original_sentence", "corrected_sentence")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("finding_id", "defect")
