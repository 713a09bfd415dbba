import random

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import split as S

ALPHABET = st.sampled_from(["ab ", "\n", "\n\n", "# Title\n", "x", "_", ".", " ", "é", "。", "漢", "fn go() ", "\r\n", "\t"])


def check(text, pieces, limit, overlap):
    assert "".join(text[p[5] : p[6]] for p in pieces) == text
    for k, p in enumerate(pieces):
        tokens = S.TOKEN.findall(p[2])
        assert p[2] == text[p[4] : p[6]] and len(tokens) == p[3] <= limit
        if k:
            assert S.TOKEN.findall(pieces[k - 1][2])[-overlap:] == tokens[:overlap]


@given(st.lists(ALPHABET, max_size=400).map("".join))
@settings(max_examples=150, deadline=None)
def test_pieces_fit_share_and_lose_nothing(text):
    pieces = S.split_text(text, ["Title"], ["go"], max_tokens=40, overlap=4)
    check(text, pieces, 40, 4)
    n = len(S.TOKEN.findall(text))
    stretch = max([len(S.TOKEN.findall(w)) for w in text.split()] or [0])
    want = "none" if n <= 40 else "forced" if stretch > 40 else "boundary"
    assert {p[8] for p in pieces} == {want}


def test_an_edit_changes_only_pieces_around_it():
    r = random.Random(2)
    lines = [" ".join(f"v{r.randrange(500)}" for _ in range(9)) + "\n" for _ in range(1500)]
    a = S.split_text("".join(lines))
    lines.insert(700, "a new line here\n")
    b = S.split_text("".join(lines))
    same = {p[2] for p in a} & {p[2] for p in b}
    assert len(a) > 12 and len(same) >= len(a) - 4


def test_an_edit_of_a_text_without_spaces_changes_only_pieces_around_it():
    r = random.Random(3)
    chars = [chr(r.randrange(0x4E00, 0x9000)) for _ in range(40_000)]
    a = S.split_text("".join(chars))
    chars.insert(15_000, "漢")
    b = S.split_text("".join(chars))
    check("".join(chars), b, 1024, 64)
    same = {p[2] for p in a} & {p[2] for p in b}
    assert {p[8] for p in b} == {"forced"} and len(same) >= len(a) - 6


def test_a_stretch_that_fits_is_not_cut():
    text = "word " * 200 + "a." * 430 + " " + "word " * 900
    pieces = S.split_text(text)
    check(text, pieces, 1024, 64)
    assert {p[8] for p in pieces} == {"boundary"} and "forced" not in {p[7] for p in pieces}
    assert [p[3] for p in pieces][:2] == [200, 64 + 860 + 100] or pieces[0][3] == 200
    long = S.split_text("word " * 200 + "a." * 520 + " " + "word " * 900)
    assert {p[8] for p in long} == {"forced"}


def test_headings_and_symbols_are_preferred():
    body = "\n".join(f"word{k} and more of it here" for k in range(40))
    text = "\n".join(["# One", body, "# Two", body, "# Three", body, "# Four", body, "# Five", body])
    kinds = {p[7] for p in S.split_text(text, ["Two", "Three"], max_tokens=512, overlap=16)}
    assert "heading" in kinds


def test_dirty_rows(spark):
    long = "tok " * 30_000
    rows = [("a", None), ("b", ""), ("c", "one"), ("d", long), ("d", long), ("e", "x" * 5000), ("f", "." * 1500), (None, "z")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "id string, text string, piece int")
    got = S.split_oversized(df, "id", "text").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r)
    assert set(by) == {"b", "c", "d", "e", "f", None}
    assert [len(by[k]) for k in ("b", "c", "e")] == [1, 1, 1]
    assert {r.cut for r in by["d"]} == {"boundary"} and {r.cut for r in by["f"]} == {"forced"}
    assert len({r.piece for r in by["d"]}) == len(by["d"])
    only = S.split_oversized(df, "id", "text", only_oversized=True).select("id").distinct().collect()
    assert {r.id for r in only} == {"d", "f"}
    assert S.split_oversized(df.where("1 = 0"), "id", "text").count() == 0
