"""One consistent form of texts that look the same.

Levelled are: width of characters, composition of accents, invisible characters, the kind of a
space, letters that are others written together (ligatures, digraphs, Roman numerals) and letters of
the same shape in Latin, Cyrillic, Greek, Armenian, Cherokee, Coptic and Lisu. Case, accents, digits,
words, line ends and tabs stay as they are; fonts (bold, script), circled, raised and lowered forms
look different and stay too.

For letters, each token (a run of letters and marks) is resolved by scripts: every letter stands
for a shape, every shape has the scripts that can write it, and the sets of all letters of the
token are intersected. If a script remains, the token is spelled in it, Latin before Cyrillic
before Greek and so on, so that mixed tokens and whole-script look-alikes get one spelling.
If none remains (a token that no single script can write), each letter takes the first script
that has its shape. The choice depends on shapes only, so equal looks give equal forms. Tokens that mix
scripts, and whole-script look-alikes of Latin words, are counted beside the form.

Defined cases: null texts have a null form and are in no pair; empty texts stay empty and are in
no pair; a text of invisible characters only has an empty form and pairs with its like. Equal
texts are no pair. Repeated rows count once. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import ship, staged, table

# Letters of the same shape, by script: Latin letters and those of the script in the same order.
SHAPES: dict[str, tuple[str, str]] = {
    "Cyrl": ("AaBCcdEeGHhIiJjKlMOoPpQqSsTWwXxYyVvYy", "АаВСсԁЕеԌНһІіЈјКӏМОоРрԚԛЅѕТԜԝХхУуѴѵҮү"),
    "Grek": ("ABEZHIKMNOPTYXoviupyacjCJ", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιυργαςϳϹͿ"),
    "Armn": ("OoSUhnuqgjlL", "ՕօՏՍհոսզցյլԼ"),
    "Cher": ("DRTiyAJEWMHYGhZbRWSVSLCPKdGB", "ᎠᎡᎢᎥᎩᎪᎫᎬᎳᎷᎻᎽᏀᏂᏃᏏᏒᏔᏕᏙᏚᏞᏟᏢᏦᏧᏳᏴ"),
    "Copt": ("ABEZHIKMNOoPpCcTYX", "ⲀⲂⲈⲌⲎⲒⲔⲘⲚⲞⲟⲢⲣⲤⲥⲦⲨⲬ"),
    "Lisu": ("BPdDTGKJCZFMNLSRVHWXYAEIOU", "ꓐꓑꓒꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"),
}
#: Latin letters that look like another Latin letter.
LATIN = ("ga", "ɡɑ")
PREFERENCE = ("Latn", *SHAPES)

# Characters without a look of their own.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xFFF9, 0xFFFC), *range(0xE0000, 0xE1000)]
SPACES = [0x00A0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]


def _shape_table() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """(letter -> shape, shape -> script -> letter); a shape is named by its Latin letter."""
    shape_of: dict[str, str] = {}
    letters: dict[str, dict[str, str]] = {}
    for script, (latin, own) in SHAPES.items():
        for a, b in zip(latin, own, strict=True):
            shape_of[b] = a
            letters.setdefault(a, {"Latn": a}).setdefault(script, b)
    for a in letters:
        shape_of[a] = a
    return shape_of, letters


SHAPE_OF, LETTERS = _shape_table()
OWN_SCRIPT: dict[str, frozenset[str]] = {b: frozenset([script]) for script, (_, own) in SHAPES.items() for b in own}


def _level_table() -> dict[int, str | None]:
    """From the character database: full-width and half-width forms, letters and letter-like numbers that
    are others written together (ligatures, digraphs, Roman numerals), and characters that differ from
    another only in where a line may break. Fonts, circles, raised and lowered forms look different."""
    out: dict[int, str | None] = {}
    for block in (range(0x80, 0x3400), range(0xA640, 0xABFF), range(0xFB00, 0xFFF0)):
        for c in block:
            kind, _, parts = unicodedata.decomposition(chr(c)).partition(" ")
            joined = "".join(chr(int(x, 16)) for x in parts.split()) if kind.startswith("<") else ""
            letters = unicodedata.category(chr(c)) in ("Lu", "Ll", "Lt", "Lo", "Nl") and all(unicodedata.category(x)[0] in "LN" for x in joined)
            if kind in ("<wide>", "<narrow>", "<noBreak>") or (kind == "<compat>" and letters and len(joined) > 1 - (unicodedata.category(chr(c)) == "Nl")):
                out[c] = joined
    for c, d in out.items():  # what is left may be levelled itself
        out[c] = "".join(out.get(ord(x), x) for x in d)
    return {**out, **dict.fromkeys(SPACES, " "), **dict.fromkeys(INVISIBLE), 0x00B5: "μ", **{ord(b): a for a, b in zip(*LATIN, strict=True)}}


LEVEL = _level_table()
_PLAIN = re.compile(r"[\x00-\x7f]*")
#: Runs of letters with their marks; only such with a letter beyond ASCII can change.
_TOKEN = re.compile(r"(?:[^\W\d_]|[̀-ͯ])+")
_MIXABLE = re.compile("[" + "".join(sorted(c for c in SHAPE_OF if ord(c) > 127)) + "]")


# Scripts by the first word of a letter's name, with the writing systems that mix them.
SCRIPT_SETS: dict[str, frozenset[str]] = {
    "LATIN": frozenset(["Latn"]), "CYRILLIC": frozenset(["Cyrl"]), "GREEK": frozenset(["Grek"]), "ARMENIAN": frozenset(["Armn"]), "CHEROKEE": frozenset(["Cher"]), "COPTIC": frozenset(["Copt"]), "LISU": frozenset(["Lisu"]),
    "CJK": frozenset(["Hani", "Jpan", "Hanb", "Kore"]), "HIRAGANA": frozenset(["Hira", "Jpan"]), "KATAKANA": frozenset(["Kana", "Jpan"]), "KATAKANA-HIRAGANA": frozenset(["Hira", "Kana", "Jpan"]), "BOPOMOFO": frozenset(["Bopo", "Hanb"]), "HANGUL": frozenset(["Hang", "Kore"]),
}


def _script(letter: str) -> frozenset[str] | None:
    """Resolved script set of a letter outside the shapes; None where the letter fixes none."""
    if unicodedata.category(letter)[0] != "L":
        return None
    word = unicodedata.name(letter, "").split(" ")[0]
    return SCRIPT_SETS.get(word, frozenset([word]))


_SCRIPTS: dict[str, frozenset[str] | None] = {}
_ALL = frozenset(PREFERENCE)


def scripts_of(base: str) -> frozenset[str] | None:
    """The scripts that can write this shape; None for marks."""
    if base not in _SCRIPTS:
        shape = SHAPE_OF.get(base)
        _SCRIPTS[base] = frozenset(LETTERS[shape]) if shape else _script(base)
    return _SCRIPTS[base]


def script_of_letter(base: str) -> frozenset[str] | None:
    """The scripts of the letter itself."""
    return OWN_SCRIPT[base] if base in OWN_SCRIPT else _script(base)


def token_kind(token: str) -> str | None:
    """'mixed' for a token whose letters have no script in common, 'whole_script' for one in a script
    other than Latin that Latin letters could write all the same, else None."""
    own: frozenset[str] | None = None
    can: frozenset[str] | None = None
    for c in unicodedata.normalize("NFD", token):
        a, b = script_of_letter(c), scripts_of(c)
        if a is not None:
            own, can = a if own is None else own & a, b if can is None else can & b
    if own is None:
        return None
    return "mixed" if not own else "whole_script" if "Latn" in can and "Latn" not in own else None


def token_kinds(text: str) -> tuple[int, int]:
    """(mixed tokens, whole-script look-alikes) of a text."""
    if text.isascii():
        return 0, 0
    kinds = [token_kind(w) for w in _TOKEN.findall(text.translate(LEVEL)) if not w.isascii()]
    return kinds.count("mixed"), kinds.count("whole_script")


def spell(token: str) -> str:
    """The consistent spelling of a token of letters and marks."""
    parts = unicodedata.normalize("NFD", token)
    left = _ALL
    for c in parts:
        can = scripts_of(c)
        if can is not None:
            left = left & can
    script = next((s for s in PREFERENCE if s in left), None)
    out = []
    for c in parts:
        shape = SHAPE_OF.get(c)
        out.append(c if shape is None else LETTERS[shape].get(script, shape) if script else shape)
    return unicodedata.normalize("NFC", "".join(out))


def consistent_form(text: str) -> str:
    """The form; equal for texts that look the same."""
    if text.isascii():
        return text
    t = unicodedata.normalize("NFC", text.translate(LEVEL))
    if not _MIXABLE.search(unicodedata.normalize("NFD", t)):
        return t
    cache: dict[str, str] = {}

    def one(m: re.Match) -> str:
        w = m.group()
        if w.isascii():
            return w
        if w not in cache:
            cache[w] = spell(w)
        return cache[w]

    return _TOKEN.sub(one, t)


def _form_batches(with_form: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            forms = [None if t is None else consistent_form(t) for t in texts]
            if with_form:
                kinds = [(None, None) if t is None else token_kinds(t) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forms, pa.string()), pa.array([x for x, _ in kinds], pa.int32()), pa.array([x for _, x in kinds], pa.int32())], names=["doc_id", "form", "n_mixed", "n_whole_script"])
            else:
                name = [xxhash.xxh3_128_digest(f.encode("utf-8", "surrogatepass")) for f in forms]
                own = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(name, pa.binary()), pa.array(own, pa.binary())], names=["doc_id", "look", "own"])

    return run


def consistent_texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, form, n_mixed, n_whole_script) of every row: the form, and how many tokens of the text mix
    scripts or are whole-script look-alikes of Latin ones."""
    ship(df.sparkSession)
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(_form_batches(True), "doc_id bigint, form string, n_mixed int, n_whole_script int")


def _looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(df.sparkSession)
    src = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> '' and doc_id is not null")
    return staged(src.mapInArrow(_form_batches(False), "doc_id bigint, look binary, own binary").distinct(), "looks")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str, block: int = 4096) -> DataFrame:
    """(doc_id_a, doc_id_b): different texts of one look. Texts are named by 128-bit hashes of
    their form and of themselves; only looks with two different texts are joined. The rows of a look are
    cut into blocks of about `block`, and a pair of blocks is a join key of its own, so no key is hot.
    `same_look_groups` gives the same without one row a pair."""
    looks = _looks(df, id_col, text_col)
    several = staged(looks.groupBy("look").agg(F.min("own").alias("x"), F.max("own").alias("y"), F.count("*").alias("n")).where("x <> y").select("look", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "several")
    rows = looks.join(several, "look").withColumn("k", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = rows.select("look", F.col("doc_id").alias("da"), F.col("own").alias("oa"), F.col("k").alias("ka"), each.alias("kb"))
    b = rows.select("look", F.col("doc_id").alias("db"), F.col("own").alias("ob"), F.col("k").alias("kb"), each.alias("ka"))
    return a.join(b, ["look", "ka", "kb"]).where("oa <> ob AND da < db").select(F.col("da").alias("doc_id_a"), F.col("db").alias("doc_id_b")).distinct()


def same_look_groups(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, look_id, n_texts) of the texts whose look has more than one text."""
    looks = _looks(df, id_col, text_col)
    n = looks.select("look", "own").distinct().groupBy("look").agg(F.count("*").alias("n_texts")).where("n_texts > 1")
    return looks.join(n, "look").select("doc_id", F.lower(F.hex("look")).alias("look_id"), "n_texts")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def p8_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
