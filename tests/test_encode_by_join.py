"""Lines coded with a vocabulary too large to ship, against the shipped form and sequential brute force."""

from collections import defaultdict

import pytest

from lexigraft.operators import corpus

VOCAB = [("a", 10), ("b", 11), ("b", 7), ("é", 12), (None, 13), ("c", None)]
LINES = [(i, f"l{i}", " ".join("a b é zz c".split()[k] for k in (i % 5, i % 3, i % 2) for _ in range(1 + i % 4))) for i in range(60)]
LINES += [(100, "empty", ""), (101, None, "b a"), (None, None, "zz b")]


def coded(spark, lines, vocab=VOCAB, n=256, **more):
    frame = spark.createDataFrame(lines, "doc int, part string, text string").repartition(3)
    out = corpus.encode(frame, spark.createDataFrame(vocab, "token string, id int"), 3, n, ["doc", "part"], **more)
    assert out.dtypes[2] == ("ids", "array<bigint>")
    return sorted(((r["doc"], r["part"], r["ids"]) for r in out.collect()), key=repr)


@pytest.mark.parametrize("chunk", [1, 7, 1 << 22])
def test_joined_vocabulary_gives_the_shipped_result(spark, monkeypatch, chunk):
    monkeypatch.setattr(corpus, "CHUNK_TOKENS", chunk)
    assert coded(spark, LINES, shipped_bytes=0) == coded(spark, LINES)
    assert coded(spark, LINES, shipped_bytes=0, n=2) == coded(spark, LINES, n=2)
    assert coded(spark, LINES, [("none", 1)], shipped_bytes=0) == coded(spark, LINES, [("none", 1)])
    assert coded(spark, [], shipped_bytes=0) == []


def test_lines_of_equal_keys_are_one_line_of_the_joined_form(spark):
    lines = [*LINES, (5, "l5", "b zz"), (None, None, "a a é"), (101, None, "")]
    want = defaultdict(list)
    for doc, part, text in lines:
        want[doc, part] += enumerate({"a": 10, "b": 7, "é": 12}.get(w, 3) for w in text.split())
    got = coded(spark, lines, shipped_bytes=0)
    assert got == sorted(((*k, [i for _, i in sorted(v)]) for k, v in want.items()), key=repr)


def test_a_token_is_joined_once_for_each_chunk(spark, monkeypatch):
    asked = []

    def counted(probe, table, key, value, how="inner", join=corpus.lookup_join):
        asked.append(probe.count())
        return join(probe, table, key, value, how)

    monkeypatch.setattr(corpus, "lookup_join", counted)
    lines = [(i, "x", "a b zz " * 50) for i in range(90)]
    assert all(r[2] == [10, 7, 3] * 50 for r in coded(spark, lines, shipped_bytes=0))
    assert asked == [9]
