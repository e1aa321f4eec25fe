"""Headings are made from the rules, so that what must be found is known by construction."""

import random

import pytest

from quire.functions.numbers import chinese, roman
from quire.operators.structure import RULES, check, overlaps, scan

DIGITS = "零一二三四五六七八九"
TOPICS = ["盐场旧账", "渡口沿革", "灯塔值更", "茶山雨季", "纸坊工序"]


def han(n):
    tens, ones = divmod(n, 10)
    return ("" if tens == 1 else DIGITS[tens]) * (tens > 0) + "十" * (tens > 0) + (DIGITS[ones] if ones else "")


def romans(n):
    out = ""
    for value, sign in ((10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        while n >= value:
            out, n = out + sign, n - value
    return out


WRITE = {"cn": han, "arabic": str, "roman": romans}
SHAPES = {
    "part": ("第{}编", ("cn", "arabic", "roman")),
    "chapter": ("第{}章", ("cn", "arabic", "roman")),
    "section": ("第{}节", ("cn", "arabic", "roman")),
    "subsection": ("{}.", ("arabic",)),
    "cn_item": ("{}、", ("cn",)),
    "paren_cn": ("（{}）", ("cn",)),
    "ar_punct": ("{}、", ("arabic",)),
}


def label(rule, n, system=None):
    shape, systems = SHAPES[rule]
    return shape.format(WRITE[system or systems[0]](n))


def found(text):
    return [(t.rule.id, t.number) for t in scan(text)]


def faults(text):
    return sorted({d.kind for d in check(text)[1]})


@pytest.mark.parametrize("rule", sorted(SHAPES))
def test_every_shape_and_number_is_read(rule):
    for system in SHAPES[rule][1]:
        for n in (1, 4, 9, 10, 11, 19, 20, 26, 38):
            name = label(rule, n, system)
            text = f"## {name} {TOPICS[n % 5]}\n"
            assert found(text) == [(rule, n)], text
            assert all(text[t.start : t.end] == t.raw == name for t in scan(text))


@pytest.mark.parametrize("wide", ["第３８节", "第３８節", "第XXXVIII节", "第xxxviii节"])
def test_forms_of_one_number(wide):
    assert found(f"# {wide} 灯塔") == [("section", 38)]


@pytest.mark.parametrize("before", ["（", "【", "「", "《", "“", "`", "* ", "+ ", "　", "「『"])
def test_decoration_is_looked_through(before):
    assert found(f"# {before}{label('chapter', 6)}") == [("chapter", 6)]


def test_lines_that_are_no_headings():
    for rule in ("part", "chapter", "section", "cn_item", "paren_cn", "ar_punct"):
        assert found(f"{label(rule, 7)} {TOPICS[0]}\n") == [(rule, 7)]
    for line in ("3. 仅为条目", "7.2 仅为条目", "结语 盐场", "第七章盐价另议", "所谓第七章 见下", "第七条 盐价", "第七回 盐价"):
        assert found(line + "\n") == []
    assert found(" # 第七章 缩进") == found("\t# 第七章 缩进") == []


def test_underlined_lines_are_headings():
    assert found("第七章盐价另议\n=====\n") == [("chapter", 7)]
    assert found("第七章盐价另议\n-----\n") == []


def test_fences_hide_their_lines():
    rng = random.Random(1)
    for _ in range(40):
        fence, text, want = rng.choice(["```", "~~~~"]), "", []
        for n in range(1, 8):
            if rng.random() < 0.5:
                text += f"{fence}\n# {label('chapter', n)} 样例\n{fence}\n"
            else:
                text += f"# {label('chapter', n)} 正文\n"
                want.append(("chapter", n))
        assert found(text) == want


@pytest.mark.parametrize("line", ["38.6亿斤盐", "7. 4万", "38.6%的船户", "1987.6 大水", "７．４ 万元"])
def test_amounts_and_dates_are_no_numbers(line):
    assert found("# " + line) == []


@pytest.mark.parametrize(("line", "rule", "number"), [("7. 4号码头", "subsection", 7), ("38. 盐仓", "subsection", 38), ("7.4 盐仓", "num_dot", None), ("7.4.2 盐仓", "num_dot", None), ("附录乙", None, None), ("附录3 船户名册", "special", None), ("致谢", "special", None)])
def test_points_and_names(line, rule, number):
    assert found("### " + line) == ([(rule, number)] if rule else [])


def test_dots_give_the_level():
    assert [t.level for t in scan("# 7.4 甲\n# 7.4.2 乙\n# 7.4.2.9 丙\n")] == [2, 3, 4]


def test_several_numbers_on_one_line():
    deeper = ["part", "chapter", "section"]
    for a in range(3):
        for b in range(a + 1, 3):
            for gap in ("", " ", "　"):
                assert found(f"# {label(deeper[a], 2)}{gap}{label(deeper[b], 5)} 渡口") == [(deeper[a], 2), (deeper[b], 5)]
                assert found(f"# {label(deeper[b], 2)} {label(deeper[a], 5)}渡口") == [(deeper[b], 2)]
    assert found("# 第二章 第五节之后的渡口") == [("chapter", 2)]


def book(rng, skip=None, drop=False, system=None):
    """A numbered book. ``skip``: a rule whose last number is one too high; ``drop``: the sections of one chapter are left out."""
    system = system or rng.choice(["cn", "arabic"])
    chapters = rng.randint(2, 4)
    lines = []
    for c in range(1, chapters + 1):
        lines.append(f"# {label('chapter', c + (skip == 'chapter' and c == chapters), system)} {rng.choice(TOPICS)}")
        sections = rng.randint(2, 3)
        for s in range(1, sections + 1):
            if drop and c == chapters:
                lines += ["### 1. 只有小目", "### 2. 仍是小目"]
                break
            lines.append(f"## {label('section', s + (skip == 'section' and s == sections and c == 1), system)} {rng.choice(TOPICS)}")
            items = rng.randint(0, 3) if skip != "subsection" else 3
            lines += [f"### {k + (skip == 'subsection' and k == items)}. {rng.choice(TOPICS)}" for k in range(1, items + 1)]
            lines.append("盐船逆水而上，码头夜里点灯。")
    return "\n".join(lines) + "\n"


def test_sound_books_have_no_fault():
    rng = random.Random(2)
    for _ in range(60):
        text = book(rng)
        assert faults(text) == [], text
    assert faults("") == faults("盐船逆水而上。\n") == []


@pytest.mark.parametrize("rule", ["chapter", "section", "subsection"])
def test_a_skipped_number_is_told(rule):
    rng = random.Random(3)
    for _ in range(20):
        text = book(rng, skip=rule)
        assert faults(text) == ["continuity_error"], text


def test_a_missing_level_is_told():
    rng = random.Random(4)
    for _ in range(20):
        assert faults(book(rng, drop=True)) == ["hierarchy_gap"]
    assert faults("## 第一节 盐场\n## 第二节 渡口\n") == ["hierarchy_gap"]


def test_repeats_and_unreadable_numbers():
    assert faults("# 第七章 盐\n# 第七章 茶\n") == ["continuity_error"]
    assert faults("# 第VVI章 盐\n") == ["number_missing"]
    assert faults("# 第8章\n# 第9章\n# 第X章\n# 第10章\n") == ["number_missing"]  # a lone X among digits stands for no number
    assert faults("# 第VIII章\n# 第IX章\n# 第1章\n# 第2章\n") == []  # another system starts anew


def test_items_start_anew_and_parts_take_chapters_in():
    for rule in ("cn_item", "paren_cn", "ar_punct"):
        ok = [label(rule, n) for n in (1, 2, 1, 2, 3)]
        assert faults("".join(f"# {x}盐\n" for x in ok)) == []
        assert faults(f"# {label(rule, 2)}盐\n# {label(rule, 4)}茶\n") == ["continuity_error"]
    text = "".join(f"# 第{han(p)}编 盐\n" + "".join(f"# {label('chapter', c)} 茶\n" for c in range(1, 4)) for p in (1, 2))
    assert faults(text) == []
    nodes, _ = check(text)
    assert [n.parent.token.number if n.parent else None for n in nodes] == [None, 1, 1, 1, None, 2, 2, 2]


def test_a_chapter_named_with_each_section_goes_on():
    line = lambda c, s: f"# {label('chapter', c)} {label('section', s)}\n"
    assert faults("".join(line(1, s) for s in range(1, 5)) + line(2, 1)) == []
    assert faults(line(5, 1) + line(5, 2) + line(5, 4)) == ["continuity_error"]


def test_overlaps_keep_the_best_of_each_chain():
    rng = random.Random(5)
    tokens = scan("".join(f"# {label('chapter', n)} 盐\n" for n in range(1, 30)))
    for _ in range(50):
        some = []
        for t in rng.sample(tokens, 12):
            a = rng.randint(0, 40)
            some.append(type(t)(**{**vars(t), "start": a, "end": a + rng.randint(1, 6), "rule": rng.choice(RULES)}))
        kept, lost = overlaps(some)
        assert len(kept) + len(lost) == 12 and all(d.kind == "overlap_discard" for d in lost)
        kept.sort(key=lambda t: t.start)
        assert all(a.end <= b.start for a, b in zip(kept, kept[1:]))


def test_numerals():
    for n in range(1, 100):
        assert chinese(han(n)) == n and (n > 39 or roman(romans(n)) == roman(romans(n).lower()) == n)
    assert [chinese(x) for x in ("三百零七", "四千八百", "六万五千", "一九八七", "盐", "")] == [307, 4800, 65000, 1987, None, None]
    assert [roman(x) for x in ("VVI", "IC", "")] == [None, None, None]
