"""The prefix trie, packing and periodic runs against brute force and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexigraft.llm import packing, periodic_runs, prefix_trie
from lexigraft.llm.queries import PACK_FILE, QUERIES

SF = "/root/testdata/sf0.001"
PACK = P.path(PACK_FILE)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def with_documents(tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


# ---------------------------------------------------------------- prefix trie

def rebuilt_by_hand(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            letter = hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, letter, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts)] for c, ts in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))  # as SQL has it for negative ids
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def nodes_by_hand(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    under = {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        kids = children.get(path, [])
        under[path] = (sum(under[k][0] for k in kids) or 1, own + sum(under[k][1] for k in kids))
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), *under[p],
            sha(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))),
        )
        for p, m in members.items()
    )


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def node_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def odd_conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(-3, 60), 10**12]:
        if c % 7 == 3:
            continue
        for k in range(rng.choice([1, 2, 3, 9, 12])):
            rows.append((c, rng.choice([None, k, k, 2]), rng.choice(["user", None, ""]), rng.choice(["a", "b", None, "", "é🙂"])))
    long = [(c, k, "user", "w" if k != stop else "stop") for c, stop in ((70, 200), (71, 150), (75, -1), (76, 260)) for k in range(260)]
    copies = [(c, k, "user", f"same {k}") for c in range(100, 130) for k in range(11)]
    return [*rows, *rows[:5], *long, *copies, (None, 0, "user", "lost")]


def test_trie_equals_grouping_all_prefixes(spark, tmp_path):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("key", "cid", "depth", "n", "length", "bytes"):
        df = df.withColumn(name, F.lit(-7))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert node_rows(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == nodes_by_hand(rebuilt_by_hand(rows))


def test_trie_of_the_given_table(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    assert node_rows(QUERIES["op11_prefix_trie"](spark, SF)) == nodes_by_hand(rebuilt_by_hand(rows))


def test_trie_of_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op11_prefix_trie"](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("batches", [(1,), (1, 1), (1, 3, 12)])
def test_compacted_trie_does_not_depend_on_batches(spark, batches):
    rng = random.Random(4)
    strings = {c: [rng.choice("ab") for _ in range(rng.randint(1, 14))] for c in range(120)}
    turns = spark.createDataFrame([(c, i + 1, x, 1) for c, s in strings.items() for i, x in enumerate(s)], "cid long, place long, letter string, bytes long")
    known = prefix_trie.written(prefix_trie.prefixes(turns), "test")
    whole = known.join(known.groupBy("cid").agg(F.max("depth").alias("depth")), ["cid", "depth"])
    sequences = prefix_trie.written(whole.groupBy("key", F.col("depth").alias("length")).agg(F.min("cid").alias("cid")), "test")
    trie = prefix_trie.build(sequences.select("cid", "length"), known, batches)
    found = {"".join(strings[r["via"]][: r["depth"]]): (r["top"], r["handle"]) for r in trie.nodes.collect()}
    texts = {"".join(s) for s in strings.values()}
    prefixes = {t[:d] for t in texts for d in range(1, len(t) + 1)}
    wanted = {p for p in prefixes if p in texts or len({q for q in prefixes if len(q) == len(p) + 1 and q.startswith(p)}) > 1}
    assert set(found) == wanted
    key_of = {("".join(strings[r["cid"]][: r["depth"]])): r["key"] for r in known.collect()}
    for text, (top, handle) in found.items():
        assert top == max((len(w) for w in wanted if w != text and text.startswith(w)), default=0)
        fat = max(range(top + 1, len(text) + 1), key=lambda x: x & -x)
        assert handle == key_of[text[:fat]]
    # every sequence that the trie has comes out at its own node, without a comparison left to make
    at = trie.along(trie.locate(sequences.select("cid", "length"), 14)).collect()
    assert all(r["at"] == r["length"] for r in at)


def test_long_member_lists_are_digested_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    ids = random.Random(1).sample(range(10**6), 500)
    members = spark.createDataFrame([(b"a" if i % 3 else b"b", i) for i in ids], "key binary, cid long").repartition(9)
    got = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie._sha_of_ids(members).collect()}
    assert got == {k: sha(",".join(map(str, sorted(i for i in ids if bool(i % 3) == (k == b"a"))))) for k in (b"a", b"b")}


# ---------------------------------------------------------------- packing

def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PACK).encode_batch(texts, add_special_tokens=False)]


def noise(alphabet, n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_ids_equal_the_library(monkeypatch):
    odd = noise(" \n\t\x1c\x1f\x85\xa0ab'sSTreVEllmd''é1½²ªµºÀß×÷.,­\x00\x7f\x9f", 3000, 40, 1)
    odd += noise(" \ńaͅeéEÀŒœİΣςσ🙂‍　가가's1", 2000, 30, 2)
    odd += ["x" * 5000, "é " * 4000, "a<|endoftext|>b <|startoftext|> É", " " * 70000 + "y", "á b" * 2000, ""]
    monkeypatch.setattr(packing, "CHUNK", 64)
    monkeypatch.setattr(packing, "MEMO", 50)
    own = packing.WordPieces(PACK)
    assert own.by_match and own.cut_at_blanks
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in odd] == library_ids(odd)


def by_hand(sizes, limit):
    """Best fit decreasing with a plain search."""
    bins = []
    for s in sizes:
        fits = [b for b in bins if b + s <= limit]
        if fits:
            bins[bins.index(max(fits))] += s
        else:
            bins.append(s)
    return sorted(bins)


def test_best_fit_equals_a_plain_search():
    rng = random.Random(2)
    for limit in (1, 7, 64):
        for _ in range(50):
            sizes = sorted((rng.randint(1, limit) for _ in range(rng.randint(0, 60))), reverse=True)
            first, place, fill = packing.best_fit(np.array(sizes, np.int64), limit)
            bins = {}
            for b, p, f, s in zip(first.tolist(), place.tolist(), fill.tolist(), sizes, strict=True):
                assert p == bins.get(b, 0)
                bins[b] = p + s
            assert sorted(bins.values()) == by_hand(sizes, limit)
            assert all(bins[b] == f for b, f in zip(first.tolist(), fill.tolist(), strict=True))


def check_packed(rows, limit):
    """(id, sequence, place, length): gapless places, no sequence too long. Returns the fills."""
    by_sequence = {}
    for _, s, place, n in rows:
        by_sequence.setdefault(s, []).append((place, n))
    fills = []
    for parts in by_sequence.values():
        at = 0
        for place, n in sorted(parts):
            assert place == at
            at += n
        assert at <= limit
        fills.append(at)
    return fills


@pytest.mark.parametrize("group,low,high", [(10**6, 1, 100), (50, 1, 100), (20, 51, 99), (16, 100, 100), (64, 1, 3)])
def test_tree_of_groups_packs_about_as_well_as_one(spark, monkeypatch, group, low, high):
    monkeypatch.setattr(packing, "GROUP", group)
    rng = random.Random(7)
    sizes = [rng.randint(low, high) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "piece_id long, length long")
    rows = packing.pack(df, 100).collect()
    assert sorted(r["piece_id"] for r in rows) == list(range(700))
    fills = check_packed([(r["piece_id"], r["sequence_id"], r["place"], sizes[r["piece_id"]]) for r in rows], 100)
    assert sum(fills) == sum(sizes)
    assert len(fills) <= 1.05 * len(by_hand(sorted(sizes, reverse=True), 100)) + 1


def test_packing_of_documents(spark, edge, empty, tmp_path):
    odd = edge.unionByName(spark.createDataFrame([(9, "ab " * 2047), (10, "ab " * 2048), (11, "q " * 5000)], "doc_id long, text string"), allowMissingColumns=True)
    folder = with_documents(tmp_path / "odd", odd)
    rows = QUERIES["op12_packing"](spark, folder).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd.collect()]
    ids = [i + [0] for i in library_ids([t for _, t in texts])]
    want = [
        (str(d), k // 2048, k, len(x[k : k + 2048]), zlib.crc32(np.array(x[k : k + 2048], "<u4").tobytes()))
        for (d, _), x in zip(texts, ids, strict=True) for k in range(0, len(x), 2048)
    ]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    fills = check_packed([(0, r["sequence_id"], r["offset"], r["length"]) for r in rows], 2048)
    assert len(fills) <= -(-sum(fills) // 2048) + 1
    assert QUERIES["op12_packing"](spark, with_documents(tmp_path / "none", empty)).count() == 0


def test_sequences_hold_their_pieces(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = packing.with_piece_ids(packing.encode_pieces(docs, PACK, limit=512, end=0))
    placed = packing.pack(pieces, 512)
    got = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(pieces, placed).collect()}
    want = {}
    for r in sorted(pieces.join(placed, "piece_id").collect(), key=lambda r: (r["sequence_id"], r["place"])):
        want[r["sequence_id"]] = want.get(r["sequence_id"], b"") + bytes(r["ids"])
    assert got == want and max(map(len, got.values())) <= 4 * 512


# ---------------------------------------------------------------- periodic runs

def runs_by_hand(t, least):
    found = {}
    for q in range(1, len(t) // 2 + 1):
        s = 0
        while s + q < len(t):
            e = s
            while e + q < len(t) and t[e] == t[e + q]:
                e += 1
            if e - s >= q and e + q - s >= least:
                found.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least", [1, 3, 12])
def test_runs_equal_a_plain_search(least):
    rng = random.Random(least)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            t = [rng.randrange(k) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 2))
                t = [t[a + (i - a) % p] if i >= a else t[i] for i in range(n)]
            texts.append(t)
        assert periodic_runs.runs_of([np.array(t, np.int64) for t in texts], least) == [runs_by_hand(t, least) for t in texts]


def test_previous_smaller_by_pointers_and_by_stack(monkeypatch):
    rng = random.Random(3)
    for rounds in (64, 0):
        monkeypatch.setattr(periodic_runs, "POINTER_ROUNDS", rounds)
        for _ in range(100):
            v = [-1] + [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
            want = [0] + [max(j for j in range(i) if v[j] < v[i]) for i in range(1, len(v))]
            assert periodic_runs.previous_smaller(np.array(v)).tolist() == want


def test_long_runs_take_little_time():
    n = 400_000
    assert periodic_runs.runs_of([np.zeros(n, np.int64)]) == [[(0, n, 1)]]
    assert periodic_runs.runs_of([np.append(np.zeros(n, np.int64), 1)]) == [[(0, n, 1)]]
    assert periodic_runs.runs_of([np.arange(n) % 70_000]) == [[(0, n, 70_000)]]


def runs_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = runs_by_hand(words, 12)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    return (
        str(doc_id), len(runs), *(map(str, best or [None] * 3)), str(1000 * best[1] // best[2] if best else None),
        sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_periodic_runs_of_documents(spark, edge, empty, tmp_path):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def rows(folder):
        found = QUERIES["op13_periodic_runs"](spark, folder).select(*names).collect()
        return sorted((str(r[0]), r[1], *map(str, r[2:6]), *r[6:]) for r in found)

    short = edge.filter("length(text) < 1000 or text is null").unionByName(
        spark.createDataFrame([(i, " ".join(random.Random(i).choices("ab é 🙂\x85".split(" "), k=i))) for i in range(20, 90)], "doc_id long, text string"), allowMissingColumns=True
    )
    assert rows(with_documents(tmp_path / "odd", short)) == sorted(runs_row(r["doc_id"], r["text"]) for r in short.collect())
    few = spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars < 6000")
    assert rows(with_documents(tmp_path / "few", few)) == sorted(runs_row(r["doc_id"], r["text"]) for r in few.collect())
    assert rows(with_documents(tmp_path / "none", empty)) == []
    long = QUERIES["op13_periodic_runs"](spark, with_documents(tmp_path / "long", edge.filter("doc_id = 7"))).first()
    assert (long["start"], long["length"], long["period"]) == (0, 60_000, 2)
