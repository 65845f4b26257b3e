import re

import pytest
from pyspark.sql import functions as F

from trigrove.functions.pattern import PatternTooWeak, compile_pattern
from trigrove.functions.preview import label_field, preview, truncated
from trigrove.functions.text import flatten_json, gram_rows, normalize, normalized, trigrams


@pytest.mark.parametrize(
    ("raw", "out"),
    [("Русский", "русскии"), ("котёнок", "котенок"), ("Éionç", "eionc"), ("ﬁne", "fine"), ("１２３", "123"), ("straße", "straße"), ("ΟΔΟΣ", "οδος"), ("ℌello", "Hello"), ("ABC", "abc"), ("", "")],
)
def test_normalize(raw, out):
    assert normalize(raw) == out
    assert len(normalize("한국어")) == 8


def test_normalized_column_equals_the_function(spark):
    raw = ["Русский", "ﬁne", None, "", "Plain ASCII", "ΟΔΟΣ", "İstanbul", "ℌello"]
    rows = spark.createDataFrame([(s,) for s in raw], "s string").select("s", normalized("s").alias("n")).collect()
    assert [r.n for r in rows] == [None if s is None else normalize(s) for s in raw]


def test_flatten_keeps_strings_only_and_later_paths_win():
    doc = {"_id": "1", "a": {"b": "x", "n": 3, "t": True}, "tags": ["p", None, "q"], "z": None}
    assert flatten_json(doc) == [("_id", "1"), ("a.b", "x"), ("tags[0]", "p"), ("tags[2]", "q")]
    assert flatten_json(["r"]) == [("[0]", "r")]
    assert flatten_json({"a.b": "1", "a": {"b": "2"}}) == [("a.b", "1"), ("a.b", "2")]


def test_pattern_grams_and_weakness():
    assert compile_pattern("*играет*").grams == ("игр", "гра", "рае", "ает")
    assert compile_pattern("ab*cdé").grams == ("cde",)
    for weak in ("*", "", "ab*cd?e", "??"):
        with pytest.raises(PatternTooWeak):
            compile_pattern(weak)
    assert compile_pattern("ab", allow_weak=True).runs == ("ab",)
    assert compile_pattern("ＡＢＣ＊d").runs == ("abc", "d")
    assert compile_pattern("аб*abcd").needle == "аб"  # both have four bytes; the first wins


@pytest.mark.parametrize("wildcard", ["*игра*", "игра?т", "a.b%c_d*[x]", "ent*rie", "e?ti*the", "abc?", "x\\yz*"])
def test_matches_equals_a_regex(spark, wildcard):
    values = ["щенок играет с мячиком", "игра", "a.b%c_d and [x]", "aXb%c_d [x]", "entry series\nrie", "rie ent", "the etti the", "abc", "abcd", "x\\yz", None, ""]
    p = compile_pattern(wildcard)
    rx = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in p.text), re.S)
    got = spark.createDataFrame([(v,) for v in values], "v string").select(p.matches(F.col("v")).alias("m")).collect()
    assert [bool(r.m) for r in got] == [bool(v and rx.search(v)) for v in values]


def test_long_values_match_in_linear_time(spark):
    v = "ent " * 60_000
    p = compile_pattern("*ent*ent*rient")
    assert not spark.createDataFrame([(v + "rien",)], "v string").where(p.matches(F.col("v"))).count()


def test_previews(spark):
    v = "щенок играет с мячиком и снова играет дома"
    df = spark.createDataFrame([(v,)], "v string")

    def show(w, mode, most=180):
        return df.select(preview(F.col("v"), compile_pattern(w), mode, most).alias("p")).first().p

    assert show("*игра*", "span") == f"[{v}]"
    assert show("*игра*", "literal") == v.replace("игра", "[игра]", 1)
    assert show("*играет*", "literal", 20) == "щенок [играет] с мяч…"
    assert show("*мячик*", "literal", 17) == "…ет с [мячик]ом и …"
    assert show("*играх*", "literal") == v.replace("игра", "[игра]", 1)  # a shorter prefix is marked
    assert show("*игра*", "plain", 5) == "щенок…"
    long = spark.createDataFrame([("abc" * 100,)], "v string").select(preview(F.col("v"), compile_pattern("*abc*"), "span").alias("p")).first().p
    assert len(long) == 185 and long.endswith("…") and long.startswith("[abc")
    assert df.select(truncated(F.lit("abc"), 3).alias("p")).first().p == "abc"


def test_label_field(spark):
    row = spark.range(1).select(F.create_map(F.lit("b"), F.lit("x"), F.lit("title"), F.lit("t"), F.lit("text.body"), F.lit("")).alias("f"))
    assert row.select(label_field(F.col("f")).alias("l")).first().l == "title"
    assert row.select(label_field(F.col("f"), "b").alias("l")).first().l == "b"


def test_gram_rows(spark):
    texts = ["abcabc", "ab", None, "", "ёжик и ёж", "𝒳𝒴𝒵a"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = sorted((r.i, r.gram) for r in gram_rows(df, "t", ["i"]).collect())
    assert got == sorted((i, g) for i, t in enumerate(texts) for g in set(trigrams(t or "")))


def test_sql_functions(spark):
    from trigrove.functions.text import register

    register(spark)
    row = spark.sql("""SELECT normalize_text('Éa') AS n, flatten_json('{"a": {"b": "Ж"}}') AS f""").first()
    assert (row.n, row.f) == ("ea", {"a.b": "ж"})


def test_a_batch_is_normalized_in_pieces(monkeypatch):
    import pyarrow as pa

    from trigrove.functions import text

    rows = [None, "", "Ünï", "x" * 300, "Étés " * 30, None, "ＡＢＣ"] * 9
    held = []
    pieces = text._pieces
    monkeypatch.setattr(text, "_PIECE_BYTES", 200)
    monkeypatch.setattr(text, "_pieces", lambda c: (held.append(p) or p for p in pieces(c)))
    for column in (pa.array(rows, pa.string()), pa.array(rows, pa.string()).slice(3, 40), pa.array([], pa.string())):
        held.clear()
        assert text._normalize_other.func(column).to_pylist() == [None if s is None else text.normalize(s) for s in column.to_pylist()]
        assert all(len(p) == 1 or sum(len((s or "").encode()) for s in p.to_pylist()) <= 200 for p in held) and sum(map(len, held)) == len(column)
