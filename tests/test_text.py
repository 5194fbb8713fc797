import pytest
from topicloom.functions import fixed_values as V
from topicloom.functions import text as T


@pytest.mark.parametrize(
    "build, text, want",
    [
        (T.split_sentences, "A b. C.", ["A b.", "C.", "."]),
        (T.split_sentences, " one\n.\ttwo　", ["one.", "two."]),
        (T.split_sentences, "", ["."]),
        (T.clean_corpus, "x [y] “z”", "x y. z"),
        (T.clean_corpus, "a-b (c) %", "a-b (c) %"),
        (T.clean_corpus, "precedent", "edent"),
        (T.clean_corpus, "a 　b", "a b"),
        (T.clean_corpus, ".,!?;ㆍ", ". ;"),
        (T.clean_corpus, "k a href AJAX class link onclick javascript fncLawPop m", "k  m"),
        (T.clean_record, "가나 abc 12%", "가나 12%"),
        (T.clean_record, "]x[", ""),
        (T.clean_record, None, None),
        (T.squeeze, "  a \x1c\x85 b ", "a b"),
        (T.trailing_year, "J 2018", 2018),
        (T.trailing_year, "vol", None),
        (T.trailing_year, None, None),
        (T.tokens, "The A1 b, ünd_x 7", ["the", "a1", "ünd_x"]),
        (T.keywords_text, "a, b", "a b"),
    ],
)
def test_goldens(one, build, text, want):
    assert one(build, text) == want


def test_length_filter_comes_before_cleaning(one):
    pieces = one(T.corpus_sentences, "?" + "!" * 21 + "/" + "a" * 20)
    assert [(p["pos"], p["raw"]) for p in pieces] == [(1, "!" * 21)]
    assert one(T.clean_corpus, "!" * 21) == ""


def test_clean_record_takes_a_wider_class(one):
    assert one(lambda x: T.clean_record(x, V.RECORD_KEEP + "a-z"), "가 ab;cd  E") == "가 ab cd"


def test_substitute_then_clean(one):
    assert one(lambda x: T.clean_sentence(x, {"法": "법"}), "法 (1)") == "법 (1)"
    with pytest.raises(ValueError):
        T.substitute_chars(None, {"ab": "c"})


@pytest.mark.parametrize(
    "text, ruling",
    [
        ("【주    문】 기각 【이    유】 r", "기각"),
        ("【주  문】 각하 【이  유】", "각하"),
        ("【주    문】 인용 【이  유】", "인용"),
        ("xyz", None),
    ],
)
def test_ruling_sections(one, text, ruling):
    assert one(lambda x: T.first_section(x, V.RULING_RULES), text) == ruling


@pytest.mark.parametrize(
    "text, reasoning",
    [
        ("【이    유】 가 나 주문과 같이 판결한다. 끝", "가 나 주문과 같이 판결한다."),
        ("【이    유】 가 나 주문과 같이 결정한다.", "가 나 주문과 같이 결정한다."),
        ("【이    유】 가나다라 대법관 홍길동(재판장", "가나다라"[:4]),
        ("【이  유】12345678재판장", ""),
        ("【이유】xyz", "x"),
        ("【이    유】xyz", "x"),
        ("none", None),
    ],
)
def test_reasoning_sections(one, text, reasoning):
    got = one(lambda x: T.first_section(x, V.REASONING_RULES), text)
    assert got == reasoning


def test_missing_part_is_skipped_not_carried_over(one):
    assert one(T.joined_sections, "【주    문】a【이    유】b주심") == "ab"
    assert one(T.joined_sections, "【이    유】b주심") == "b"
    assert one(T.joined_sections, "nothing") is None


def test_sections_run_over_carriage_returns_but_not_line_feeds(one):
    assert one(lambda x: T.joined_sections(x, ("<(.+?)>",)), "<a\rb>") == "a\rb"
    assert one(lambda x: T.joined_sections(x, ("<(.+?)>",)), "<a\nb>") is None


@pytest.mark.parametrize(
    "words, low, high, want",
    [
        ("aa bb cc", 1, 2, ["aa", "bb", "cc", "aa bb", "bb cc"]),
        ("aa bb cc", 2, 3, ["aa bb", "bb cc", "aa bb cc"]),
        ("a1", 2, 2, []),
        ("", 1, 1, []),
    ],
)
def test_ngrams(one, words, low, high, want):
    assert one(lambda x: T.ngrams(T.tokens(x), low, high), words) == want


def test_stopwords_keep_repeated_words(one):
    assert one(lambda x: T.drop_words(T.tokens(x), ["the"]), "the cat the cat") == ["cat", "cat"]


def test_extend_link(one):
    assert one(lambda x: T.extend_link(x, "https://h"), "/d?type=HTML") == "https://h/d?type=XML"


def test_patterns_are_searched_only_where_their_fixed_text_is():
    assert T.fixed_part("【주    문】(.+?)【이    유】") == "【주    문】"
    assert T.fixed_part("[이    유](.+?) 이를 기각한다.") == " 이를 기각한다"
    assert T.fixed_part("ab?cd*") in ("a", "c")
    assert [T.fixed_part(p) for p in ("a|b", r"^(.+?)\n", "(abc)?", "[abc]+", "")] == [""] * 5
