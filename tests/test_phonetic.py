import pytest

from quire.functions import phonetic as P


@pytest.mark.parametrize(
    ("pinyin", "expected"),
    [("zhōngguó", ["zhōng", "guó"]), ("dōng·xi", ["dōng", "xi"]), ("xī'ān", ["xī", "ān"]), ("huār", ["huār"]), ("", []), ("nǚ'ér", ["nǚ", "ér"])],
)
def test_syllables(pinyin, expected):
    assert P.syllables(pinyin) == expected


def test_light_and_er():
    assert P.light_positions("dōng·xi") == [1] and P.requires_light("dōng·xi") and not P.requires_light("zhōngguó")
    assert not P.requires_light("kè·qì") and P.requires_light("kè·qì；kè·qi")
    assert P.er_kind("花儿", "huār") == "attached" and P.er_kind("女儿", "nǚ'ér") == "syllabic" and P.er_kind("花", "huā") is None
    assert P.on_characters("花儿", "huār") == [("花", "huār"), ("儿", None)]
