import itertools
import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from siltstone.llm import confusable as C

SAME = [
    ("paypal", "раураl"),
    ("Hello 12", "Ｈｅｌｌｏ １２"),
    ("café", "café"),
    ("a b", "a b"),
    ("word", "wo​rd﻿"),
    ("Москва", "Moсквa"),
    ("кот cop", "кот сор"),
    ("Οδος", "Oδoς"),
    ("ガ", "ｶﾞ"),
    ("ë", "ё"),
    ("Kelvin", "Kelvin"),
]
DIFFERENT = [("a", "A"), ("e", "é"), ("1", "2"), ("a\nb", "a\r\nb"), ("a b", "a  b"), ("a\tb", "a b"), ("x2", "x²"), ("word", "words"), ("O", "0"), ("Hi", "𝐇𝐢"), ("1", "①"), ("...", "…"), ("k", "ᵏ")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert a != b and C.consistent_form(a) == C.consistent_form(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_visible_differences_stay(a, b):
    assert C.consistent_form(a) != C.consistent_form(b)


def test_tokens_keep_their_script():
    assert C.consistent_form("Москва") == "Москва"
    assert C.consistent_form("Mосkva") == "Mockva"


@given(st.text(alphabet=st.sampled_from("aоoeеcсpρ  ​ｅé́йдñ漢1①\n"), max_size=30))
def test_forms_are_stable(text):
    f = C.consistent_form(text)
    assert C.consistent_form(f) == f
    assert unicodedata.is_normalized("NFC", f)


def brute(rows):
    t = {i: x for i, x in rows if i is not None and x}
    return {(a, b) for a, b in itertools.combinations(sorted(t), 2) if t[a] != t[b] and C.consistent_form(t[a]) == C.consistent_form(t[b])}


def test_pairs(spark):
    rows = [(k, x) for k, x in enumerate(y for p in SAME + DIFFERENT for y in p)] + [(100, None), (101, ""), (102, "paypal"), (103, "​"), (104, "⁠"), (102, "paypal"), (None, "paypal"), (105, "раураl " * 20_000)]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id bigint, text string, look binary")
    got = {tuple(r) for r in C.same_look_pairs(df, "doc_id", "text").collect()}
    assert got == brute(rows) and (103, 104) in got
    forms = {r.doc_id: r.form for r in C.consistent_texts(df, "doc_id", "text").collect()}
    assert forms[100] is None and forms[101] == ""
    groups = C.same_look_groups(df, "doc_id", "text")
    assert groups.where("doc_id = 102").first().n_texts == 2
    assert C.same_look_pairs(df.where("1 = 0"), "doc_id", "text").count() == 0


@pytest.mark.parametrize("text,want", [
    ("plain words", (0, 0)), ("Москва слово", (0, 0)), ("Mосkva", (1, 0)), ("оса and wasp", (0, 1)), ("日本のテスト", (0, 0)), ("한국漢字", (0, 0)), ("日本a", (1, 0)), ("нос сор ком", (0, 1)), ("Ꭺpple ꓐꓰꓔꓮ", (1, 1)), ("ｗｉｄｅ", (0, 0)), ("", (0, 0)),
])
def test_kinds_of_tokens(text, want):
    assert C.token_kinds(text) == want


def test_a_hot_look_is_paired_in_blocks(spark):
    rows = [(k, "wо" + "​" * (k % 5) + "rd") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {tuple(r) for r in C.same_look_pairs(df, "doc_id", "text", block=4).collect()}
    assert got == brute(rows)
