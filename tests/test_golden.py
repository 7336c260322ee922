"""Golden micro-cases (FIXTURES.md section 4)."""

import json
import math

import pytest
from helpers import make_vocab, texts
from pyspark.sql import functions as F

from lumenvec.functions.text import v2_words, v3_pretokens
from lumenvec.functions.vectors import l2_normalize
from lumenvec.operators.pooling import masked_mean_pool
from lumenvec.operators.subword import segment_table
from lumenvec.operators.tokens import decode, framed, raw_tokens, task_ids, token_ids
from lumenvec.profiles import SUBWORD1024, WORDS768
from lumenvec.sources.vocab import tasks_from_json, vocabulary_from_json


def words(spark, s):
    return spark.createDataFrame([(s,)], "text string").select(v2_words("text").alias("w")).first().w


def pretokens(spark, s):
    return spark.createDataFrame([(s,)], "text string").select(v3_pretokens("text").alias("p")).first().p


def framed_tokens(spark, s, profile):
    nested = framed(raw_tokens(texts(spark, [s]), profile), profile)
    return nested.first().tokens


def test_v2_plain(spark):
    assert framed_tokens(spark, "This is an apple", WORDS768) == ["[CLS]", "this", "is", "an", "apple", "[SEP]"]


def test_v2_punctuation_stays(spark):
    assert framed_tokens(spark, "Hi, you!", WORDS768) == ["[CLS]", "hi,", "you!", "[SEP]"]


def test_v2_empty(spark):
    assert framed_tokens(spark, "", WORDS768) == ["[CLS]", "[SEP]"]
    assert framed_tokens(spark, None, WORDS768) == ["[CLS]", "[SEP]"]


def test_v2_unicode_white_space(spark):
    assert words(spark, "a b　c") == ["a", "b", "c"]
    assert words(spark, "\u0085x y\u000bz ") == ["x", "y", "z"]


def test_v2_lowercase_like_go(spark):
    assert words(spark, "İ ΟΔΟΣ") == ["i", "οδοσ"]


def test_v2_unknown_is_zero(spark):
    v = make_vocab(spark, {"apple": 5}, {"[CLS]": 1, "[SEP]": 2})
    ids = token_ids(texts(spark, ["pear apple"]), v, WORDS768).orderBy("pos")
    assert [r.token_id for r in ids.collect()] == [1, 0, 5, 2]
    assert [r.attention for r in ids.collect()] == [1, 1, 1, 1]


def test_unknown_uses_unk_special(spark):
    v = make_vocab(spark, {"apple": 5}, {"[CLS]": 1, "[SEP]": 2, "<unk>": 9})
    ids = token_ids(texts(spark, ["pear"]), v, WORDS768).orderBy("pos")
    assert [r.token_id for r in ids.collect()] == [1, 9, 2]


def test_v3_pretokens(spark):
    assert pretokens(spark, "Café don't_x") == ["▁Caf", "▁é", "▁don", "'", "▁t_x"]
    assert pretokens(spark, "_") == ["_"]
    assert len(pretokens(spark, "x\u000by")) == 3
    assert pretokens(spark, " a") == ["▁a"]
    assert pretokens(spark, "") == []


def seg(spark, vocab_tokens, word):
    v = make_vocab(spark, {t: i + 10 for i, t in enumerate(vocab_tokens)}, {"<unk>": 3})
    d = spark.createDataFrame([(word,)], "token string")
    return segment_table(d, v, SUBWORD1024).first().pieces


def test_v3_greedy(spark):
    assert seg(spark, ["ab", "c"], "abcdab") == ["ab", "c", "<unk>", "ab"]
    assert seg(spark, ["a", "ab", "abc"], "abcab") == ["abc", "ab"]


def test_v3_unknown_code_point(spark):
    assert seg(spark, ["▁x"], "▁x😀") == ["▁x", "<unk>"]


def test_v3_empty(spark):
    v = make_vocab(spark, {"▁a": 4}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    ids = token_ids(texts(spark, [""]), v, SUBWORD1024).orderBy("pos", "sub")
    assert [r.token for r in ids.collect()] == ["<s>", "</s>"]


def test_v3_pieces_concatenate_back(spark):
    v = make_vocab(spark, {"▁ab": 4, "c": 5, "d": 6, "cd": 7}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    d = spark.createDataFrame([("▁abcd",), ("▁abdc",), ("▁ab",)], "token string")
    for r in segment_table(d, v, SUBWORD1024).collect():
        assert "".join(r.pieces) == r.token
        assert "<unk>" not in r.pieces


def doc(spark, obj):
    return spark.createDataFrame([(json.dumps(obj),)], "value string")


def test_vocab_object(spark):
    v = vocabulary_from_json(doc(spark, {"model": {"vocab": {"a": 0, "b": 1.7, "c": "5", "d": True}}}))
    assert sorted(map(tuple, v.tokens.collect())) == [("a", 0), ("b", 1)]


def test_vocab_array(spark):
    arr = [["<s>", 0.0], ["x"], [3, 1.0], ["b", -1.5], ["n", None]]
    v = vocabulary_from_json(doc(spark, {"model": {"vocab": arr}}))
    assert sorted(map(tuple, v.tokens.collect())) == [("<s>", 0), ("b", 3), ("n", 4)]
    assert sorted(map(tuple, v.reverse.collect())) == [(0, "<s>"), (3, "b"), (4, "n")]


def test_vocab_array_duplicate_last_wins(spark):
    v = vocabulary_from_json(doc(spark, {"model": {"vocab": [["a", 0], ["b", 0], ["a", 0]]}}))
    assert sorted(map(tuple, v.tokens.collect())) == [("a", 2), ("b", 1)]


def test_special_tokens_last_wins(spark):
    d = doc(spark, {"model": {"vocab": {}}, "added_tokens": [
        {"id": 1, "content": "<s>", "special": True}, {"id": 7, "content": "<s>", "special": True},
        {"id": 3, "content": "<unk>", "special": True}]})
    v = vocabulary_from_json(d)
    assert sorted(map(tuple, v.specials.collect())) == [("<s>", 7), ("<unk>", 3)]


def test_tasks_strict_and_lenient(spark):
    tasks = tasks_from_json(doc(spark, {"lora_adaptations": ["a", "text-matching", "a"]}))
    df = spark.createDataFrame([("text-matching",), ("a",), ("zzz",)], "task string")
    strict = {r.task: (r.task_id, r.task_error) for r in task_ids(df, tasks, SUBWORD1024).collect()}
    assert strict["text-matching"] == (1, None)
    assert strict["a"] == (0, None)
    assert strict["zzz"][0] is None and "not found" in strict["zzz"][1]
    lenient = {r.task: r.task_id for r in task_ids(df, tasks, WORDS768).collect()}
    assert lenient == {"text-matching": 1, "a": 0, "zzz": 0}


def pool(spark, hidden, mask):
    rows = [(0, i, [float(x) for x in h], m) for i, (h, m) in enumerate(zip(hidden, mask))]
    df = spark.createDataFrame(rows, "doc_id bigint, pos int, hidden array<double>, attention bigint")
    return masked_mean_pool(df, len(hidden[0])).first().pooled


def test_pool(spark):
    assert pool(spark, [[1, 2], [3, 4], [9, 9]], [1, 1, 0]) == [2.0, 3.0]
    assert pool(spark, [[5, 5]], [0]) == [0.0, 0.0]


def test_normalise(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    out = [r.n for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert out[0] == pytest.approx([0.6, 0.8])
    assert all(math.isnan(x) for x in out[1])


def test_decode_v2(spark):
    v = make_vocab(spark, {"an": 5, "apple": 6}, {"[CLS]": 1, "[SEP]": 2})
    ids = token_ids(texts(spark, ["an apple"]), v, WORDS768)
    assert decode(ids, v, WORDS768).first().text == "[CLS]anapple[SEP]"


def test_decode_v3(spark):
    v = make_vocab(spark, {"▁an": 5, "▁app": 6, "le": 7}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    ids = token_ids(texts(spark, ["an apple"]), v, SUBWORD1024)
    assert [r.token for r in ids.orderBy("pos", "sub").collect()] == ["<s>", "▁an", "▁app", "le", "</s>"]
    assert decode(ids, v, SUBWORD1024).first().text == "an apple"


def test_preview_shape(spark):
    from lumenvec.operators.pooling import embedding_preview

    df = spark.createDataFrame([([float(x) for x in range(20)],)], "embedding array<double>")
    r = embedding_preview(df).first()
    assert r.shape == 20 and r.head == [float(x) for x in range(10)]


def test_unicode_trim_matches_edge_regex(spark):
    from lumenvec.functions.text import EDGE_SPACE, unicode_trim

    vals = ["\x0bx　", "  a b\t", "", "  ", " y z ", "\U0001F600\u0085"]
    df = spark.createDataFrame([(v,) for v in vals], "t string")
    rows = df.select(unicode_trim("t").alias("a"), F.regexp_replace("t", EDGE_SPACE, "").alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert pretokens(spark, "\x0bx") == ["▁x"]


def test_pretokens_of_any_length_are_cut_alike(spark):
    v = make_vocab(spark, {"ab": 10, "c": 11, "▁ab": 12}, {"<unk>": 3})
    words = ["▁" + "ab" * 150 + "c" + "x" * 30, "▁abcab", "ab" * 20, "x" * 5000]
    d = spark.createDataFrame([(w,) for w in words], "token string")
    got = {r.token: r for r in segment_table(d, v, SUBWORD1024).collect()}
    assert got[words[0]].pieces == ["▁ab"] + ["ab"] * 149 + ["c"] + ["<unk>"] * 30
    assert got[words[0]].sources == [None] * 151 + ["x"] * 30
    assert got[words[1]].pieces == ["▁ab", "c", "ab"] and got[words[2]].pieces == ["ab"] * 20
    assert got[words[3]].pieces == ["<unk>"] * 5000


def test_unknown_pieces_are_reported(spark):
    from lumenvec.operators.reports import top_unknown_tokens, unknown_token_report

    v = make_vocab(spark, {"▁a": 4}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    df = spark.createDataFrame([(1, "a é é", "x"), (2, "", "x"), (3, None, "y")], "doc_id bigint, text string, lang string")
    ids = token_ids(df, v, SUBWORD1024, keep=["lang"])
    rep = {r.lang: tuple(r)[1:] for r in unknown_token_report(ids, ["lang"]).collect()}
    # Each é is cut into an unknown prefix and an unknown letter.
    assert rep == {"x": (2, 5, 4, 0.8), "y": (1, 0, 0, None)}
    top = {(r.rank, r.token, r.n) for r in top_unknown_tokens(ids, ["lang"]).collect()}
    assert top == {(1, "é", 2), (2, "▁", 2)}


def test_max_tokens_in_all_forms(spark):
    from lumenvec.operators.tokens import decode_rows, id_rows

    v = make_vocab(spark, {"▁a": 4, "b": 5}, {"<s>": 0, "</s>": 2, "<unk>": 3})
    p = SUBWORD1024.with_(max_tokens=4)
    df = texts(spark, ["a b, a", "", "a"])
    long = token_ids(df, v, p).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "token_id"))).alias("x"))
    assert {r.doc_id: [y.token_id for y in r.x] for r in long.collect()} == {0: [0, 4, 3, 2], 1: [0, 2], 2: [0, 4, 2]}
    rows = id_rows(df, v, p)
    assert {r.doc_id: r.ids for r in rows.collect()} == {0: [0, 4, 3, 2], 1: [0, 2], 2: [0, 4, 2]}
    assert {r.doc_id: r.text for r in decode_rows(rows, v, p, sep=" ", strip=("<s>", "</s>", "<unk>")).collect()} == {
        0: "a", 1: "", 2: "a"}
