import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexigraft.functions import answers as A
from lexigraft.functions.tags import entity_spans
from lexigraft.operators import corpus, ner, qa
from lexigraft.operators.keys import split_80_10_10
from lexigraft.sources import squad, text as src

TAGS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC", "BO", "I-", "B-"]


def spans_of(tags):
    """Sequential reading, for comparison."""
    out, opened = [], None
    for i, tag in enumerate([*tags, "O"]):
        kind = tag[2:] if tag[:2] in ("B-", "I-") else None
        goes_on = tag.startswith("I-") and opened is not None and opened[0] == kind
        if not goes_on:
            if opened:
                out.append((*opened, i))
            opened = (kind, i) if kind is not None else None
    return out


def random_sentences(seed, n):
    rng = random.Random(seed)
    return [[rng.choice(TAGS) for _ in range(rng.randrange(0, 15))] for _ in range(n)]


def test_entity_spans_equal_a_sequential_reading(spark):
    data = random_sentences(3, 300)
    df = spark.createDataFrame(list(enumerate(data)), "i int, tags array<string>")
    rows = df.select("i", entity_spans(F.col("tags")).alias("s")).collect()
    for r in rows:
        assert [(s["etype"], s["start"], s["end"]) for s in r["s"]] == spans_of(data[r["i"]])


def test_entity_f1(spark):
    gold, pred = random_sentences(4, 80), random_sentences(5, 80)
    pred[::2] = gold[::2]
    frame = lambda d: spark.createDataFrame(list(enumerate(d)), "i int, tags array<string>")
    got = ner.entity_f1(frame([*pred, ["B-PER"]]), frame(gold), ["i"]).first()
    tp = fp = fn = 0
    for p, g in zip(pred, gold):
        p, g = set(spans_of(p)), set(spans_of(g))
        tp, fp, fn = tp + len(p & g), fp + len(p - g), fn + len(g - p)
    assert (got["tp"], got["fp"], got["fn"]) == (tp, fp, fn)
    assert got["f1"] == pytest.approx(200 * tp / (2 * tp + fp + fn))
    empty = ner.entity_f1(frame([["O"]]), frame([["O"]]), ["i"]).first()
    assert (empty["precision"], empty["recall"], empty["f1"]) == (0.0, 0.0, 0.0)


def test_first_piece_labels_and_decode(spark):
    df = spark.createDataFrame([(["abcdefgh", "x", "yz"], [5, 6, 7])], "words array<string>, labels array<int>")
    r = df.select(
        ner.piece_word_ids(F.col("words"), 4, 5).alias("w"), F.col("labels")
    ).select("w", ner.first_piece_labels(F.col("w"), F.col("labels")).alias("l")).first()
    assert r["w"] == [None, 0, 0, 1, None] and r["l"] == [-100, 5, -100, 6, -100]
    s = spark.createDataFrame([([[1.0, 3.0, 3.0], [9.0, 0.0, 0.0]], [2, -100])], "s array<array<double>>, l array<int>")
    d = s.select(ner.decode_predictions(F.col("s"), F.col("l")).alias("d")).first()["d"]
    assert [(x["predicted"], x["gold"]) for x in d] == [(1, 2)]


def test_conll_round_trip(spark, tmp_path):
    data = [(i, [(f"t{i}_{j}", "B-PER" if j % 2 else "O") for j in range(1 + i % 4)]) for i in range(60)]
    df = spark.createDataFrame(data, "i int, sentence array<struct<token:string,tag:string>>")
    src.write_conll(split_80_10_10(df, 1, ["i"]), str(tmp_path / "out"), ["i"])
    back = src.read_conll(spark, str(tmp_path / "out" / "split=*"))
    got = {}
    for r in back.collect():
        got.setdefault((r["file"], r["sent_id"]), {})[r["pos"]] = (r["token"], r["tag"])
    assert sorted([s[p] for p in sorted(s)] for s in got.values()) == sorted(s for _, s in data)


def test_squad_forms_and_round_trip(spark, tmp_path):
    q = lambda i, start: {"id": i, "question": "q", "answers": [{"text": "b", "answer_start": start}]}
    doc = {"data": [
        {"title": "t", "paragraphs": [{"context": "abc", "qas": [q(1, 1), q(2, -1), {"id": 3, "question": "q", "answers": []}]}, {"context": "", "qas": [q(4, 0)]}]},
        {"title": "u", "context": "bb", "qas": [q("five", 0)]},
    ]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    (tmp_path / "b.json").write_text(json.dumps(doc["data"]))
    for name in ("a.json", "b.json"):
        docs = squad.read_documents(spark, str(tmp_path / name))
        assert sorted(r["id"] for r in squad.flatten_squad(docs).collect()) == ["1", "2", "five"]
        c = qa.classify(squad.paragraphs(docs).filter("context <> ''")).first()
        assert (c["extractive"], c["abstractive"], c["unanswerable"]) == (2, 1, 1)
    kept = qa.keep_valid(squad.paragraphs(squad.read_documents(spark, str(tmp_path / "a.json"))).filter("context <> ''"))
    items = kept.withColumn("split", F.lit("train"))
    path = str(tmp_path / "out")
    squad.write_squad(items, path)
    back = squad.flatten_squad(squad.read_documents(spark, path, lines=True))
    assert sorted(r["id"] for r in back.collect()) == ["1", "five"]


def test_to_squad_leaves_gaps(spark):
    t = spark.createDataFrame([(0, "abc", "q", "c"), (1, "abc", "q", "x"), (2, "abc", "q", "a")], "n int, context string, question string, answer string")
    located = qa.to_squad(t, [F.col("n")], "T", "set")
    assert sorted(r["id"] for r in qa.squad_items(located).collect()) == ["set-0", "set-2"]
    assert tuple(qa.located_counts(located).first()) == (2, 1)


def f1_of(p, g):
    p, g = p.split(), g.split()
    if not p or not g:
        return float(p == g)
    hits = sum((Counter(p) & Counter(g)).values())
    return 0.0 if not hits else 2 * (hits / len(p)) * (hits / len(g)) / (hits / len(p) + hits / len(g))


def test_overlap_f1(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice("aabbcde") for _ in range(rng.randrange(0, 9)))
    pairs = [(text(), text()) for _ in range(300)] + [("", ""), ("a", ""), ("", "a")]
    rows = spark.createDataFrame(pairs, "p string, g string").select("p", "g", A.overlap_f1(F.col("p"), F.col("g")).alias("f")).collect()
    for r in rows:
        assert r["f"] == pytest.approx(f1_of(r["p"], r["g"]))


def test_dataset_scores(spark):
    refs = spark.createDataFrame([("a", ["x y", "z"]), ("b", ["q"]), ("c", []), ("d", ["m"])], "id string, golds array<string>")
    preds = spark.createDataFrame([("a", " z "), ("b", "q r"), ("zz", "?")], "id string, prediction string")
    r = qa.dataset_scores(qa.score_questions(refs, preds)).first()
    assert r["n"] == 4 and r["f1"] == pytest.approx(100 * (1 + 2 / 3) / 4) and r["exact_match"] == 25.0


@pytest.mark.parametrize("n", [0, 1, 12, 13, 40, 41, 100])
def test_windows_cover_and_label(spark, n):
    context = " ".join(f"w{i}" for i in range(n)) or "  "
    max_length, stride, q_len = 20, 5, 4
    ex = spark.createDataFrame([("x", context, "a b c d", 0, "w0")], "id string, context string, question string, a_start int, a_text string")
    rows = qa.label_windows(qa.context_windows(ex, max_length, stride)).orderBy("window").collect()
    cap = max_length - 4 - q_len
    starts = [0]
    while starts[-1] + cap < n:
        starts.append(starts[-1] + cap - stride)
    assert [r["first"] for r in rows] == starts
    for r in rows:
        words = [context[o["start"] : o["end"]] for o in r["offsets"]]
        assert words == context.split()[r["first"] : r["first"] + cap]
    if n:
        assert (rows[0]["label"]["start"], rows[0]["label"]["end"]) == (q_len + 3, q_len + 3)
        assert all((r["label"]["start"], r["label"]["end"]) == (0, 0) for r in rows[1:])


def test_question_longer_than_the_window_is_an_error(spark):
    ex = spark.createDataFrame([("x", "a b", "q " * 30)], "id string, context string, question string")
    with pytest.raises(Exception, match="question too long"):
        qa.context_windows(ex, 20, 5).collect()


def test_best_span_equals_exhaustive_search(spark):
    rng = random.Random(7)
    examples, features, want = [], [], {}
    for e in range(40):
        context = " ".join(f"t{e}{i}" for i in range(12))
        examples.append((str(e), context))
        best = (-1e9, "")
        for w in range(rng.randrange(0, 4)):
            offsets = [None] * 3 + [(m * 4, m * 4 + 2) for m in range(10)] + [None]
            s = [float(rng.randrange(6)) for _ in offsets]
            t = [float(rng.randrange(6)) for _ in offsets]
            features.append((str(e), w, [o and {"start": o[0], "end": o[1]} for o in offsets], s, t))
            rank = lambda x: sorted(range(len(x)), key=lambda i: (-x[i], i))[:5]
            for a in rank(s):
                for b in rank(t):
                    if offsets[a] and offsets[b] and a <= b < a + 4 and s[a] + t[b] > best[0]:
                        best = (s[a] + t[b], context[offsets[a][0] : offsets[b][1]])
        want[str(e)] = best[1]
    ex = spark.createDataFrame(examples, "id string, context string")
    ft = spark.createDataFrame(features, "id string, window int, feature_offsets array<struct<start:int,end:int>>, s_scores array<double>, e_scores array<double>")
    got = qa.predicted_texts(ex, qa.best_spans(ft, n_best=5, max_answer_len=4))
    assert {r["id"]: r["prediction"] for r in got.collect()} == want


def test_encode_mask_and_pad(spark):
    lines = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(i))) for i in range(40)], "k int, text string")
    vocab = spark.createDataFrame([(f"w{j}", j + 5) for j in range(9)], "token string, id long")
    ship = corpus.encode(lines, vocab, 3, 12, ["k"])
    join = corpus.encode(lines, vocab, 3, 12, ["k"], shipped_bytes=0)
    want = {i: [(lambda t: t + 5 if t < 9 else 3)((i * j) % 11) for j in range(min(i, 12))] for i in range(40)}
    assert {r["k"]: r["ids"] for r in ship.collect()} == want
    assert {r["k"]: r["ids"] for r in join.collect()} == want
    masked = corpus.masked_copy(ship, ["k"], 4, 14, special_below=5, probability=0.5).collect()
    for r in masked:
        for i, x, y in zip(r["ids"], r["input_ids"], r["labels"]):
            assert (y == -100 and x == i) or (y == i and i >= 5 and (x == 4 or 5 <= x < 14))
    assert any(y != -100 for r in masked for y in r["labels"])
    rows = corpus.pad_batches(corpus.batches(ship, ["k"], 8, 1), 1).collect()
    assert Counter(r["batch"] for r in rows) == {b: 8 for b in range(5)}
    for r in rows:
        assert len(r["ids"]) == len(r["attention_mask"]) == max(len(want[x["k"]]) for x in rows if x["batch"] == r["batch"])
        assert r["ids"][: sum(r["attention_mask"])] == want[r["k"]]


@pytest.mark.parametrize("shipped", [1 << 20, 0])
def test_a_token_listed_twice_has_its_smallest_id(spark, shipped):
    vocab = spark.createDataFrame([("a", 5), ("a", 1), ("b", 2)], "token string, id long")
    lines = spark.createDataFrame([(0, "a b c a"), (1, None)], "k int, line string")
    got = corpus.encode(lines, vocab, 0, 9, ["k"], "line", shipped_bytes=shipped)
    assert {r["k"]: r["ids"] for r in got.collect()}[0] == [1, 2, 0, 1]


def test_a_question_without_room_is_reported_or_fails(spark):
    rows = spark.createDataFrame([("a", "q " * 50, "c d e"), ("b", "q", "c d e")], "id string, question string, context string")
    assert {r["id"] for r in qa.context_windows(rows, 40, 8, long_questions="skip").collect()} == {"b"}
    assert [r["id"] for r in qa.too_long(rows, 40, 8).collect()] == ["a"]
    with pytest.raises(Exception, match="no room"):
        qa.context_windows(rows, 40, 8).collect()
