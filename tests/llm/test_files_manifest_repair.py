"""Token files, the Merkle manifest and conversation repair against plain versions, and on odd cases."""

import hashlib
import heapq
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.llm import conversations, merkle, queries, rans, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")
BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
DATA = "/root/testdata/sf0.001"
#: columns whose names an operator might use inside
CLASH = "key bigint, h string, n bigint, ids string, item string, kids string, digit int, start bigint, turns bigint"
CLASHING = (1, "x", 2, "y", "z", "k", 3, 4, 5)


# ---- rANS ----------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, rans.LANES - 1, rans.LANES, rans.LANES + 1, rans.CHECKPOINT + 3, 2 * rans.CHECKPOINT])
def test_rans_round_trip_from_any_place(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), 5000).astype(np.uint16)
    table = rans.Table(rans.frequencies(np.bincount(ids, minlength=6000)))
    block = rans.encode(ids, table)
    assert (rans.decode(block, table) == ids).all()
    for first, last in ((0, 5), (n // 2, n // 2 + 100), (rans.CHECKPOINT - 2, rans.CHECKPOINT + 2), (n - 1, n + 9)):
        if first >= 0:
            assert (rans.decode(block, table, first, last) == ids[first:last]).all()


@pytest.mark.parametrize("counts", [[5], [0, 7, 0], [10 ** 15] + [1] * 49_000, [3] * 50_000, [0, 0]])
def test_frequencies_fill_the_table_and_keep_every_id(counts):
    counts = np.array(counts)
    f = rans.frequencies(counts)
    assert f.sum() in (0, 1 << rans.SCALE_BITS) and ((f > 0) == (counts > 0)).all()


# ---- token files ---------------------------------------------------------------------------------------------------
ODD = ["ΟΔΟΣ ΟΔΟΣ\tΣ. Σ", "á ́b é", "x\x1cy\x85z\xa0w it's I'LL 'S 12 3", "<|endoftext|> a<|startoftext|>b", "​ 　zz",
       "İI ǅ ﬁ ÀÉÿß straße,. e\u0301a é.'s <|ENDOFTEXT|> a<|endoftext|>, ªº µ ÷a",
       "ab's a' ''' |*** x%$# a_b __ don't'. 's' n't... it'll've", " ", "", None, "word " * 300_000, "w" * 30_000]


def token_rows(texts):
    return [(i if i % 7 else None, t, *CLASHING) for i, t in enumerate(texts)] + [(3, texts[3], *CLASHING)] * 3


def plain_tokens(rows, model, end):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(model)
    out = []
    for key, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
        out.append((key, len(ids), np.array(ids, "<u4").tobytes()))
    return out


@pytest.mark.parametrize("model, end, words", [(WORD_MODEL, 1, token_files.LATIN_WORDS), (WORD_MODEL, None, None), (BYTE_MODEL, None, None)])
def test_tokens_come_back(spark, model, end, words):
    rows = token_rows(ODD)
    docs = spark.createDataFrame(rows, f"doc_id bigint, text string, {CLASH}").repartition(3)
    folder = token_files.write_tokens(docs, model, end=end, words=words, shard_ids=100_000)
    got = [tuple(r) for r in token_files.read_tokens(spark, folder).collect()]
    assert sorted((str(k), n, bytes(x)) for k, _, n, x in got) == sorted((str(k), n, x) for k, n, x in plain_tokens(rows, model, end))
    at = 0
    for key, start, n, _ in sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])):
        assert start == at
        at += n
    some = token_files.read_tokens(spark, folder, keys=(2, 5)).collect()
    assert sorted(r["key"] for r in some) == [2, 3, 3, 3, 3, 4, 5]


def test_units_begin_inside_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 4096), ("CHECKPOINT", 2048), ("LANES", 64)):
        monkeypatch.setattr(rans, name, value)
    monkeypatch.setattr(token_files, "UNIT_IDS", 1000)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.choice([0, 3, 200, 5000])))) for i in range(80)]
    table = rans.Table(rans.frequencies(np.bincount(np.arange(50))))
    rows_ids = [np.array([rng.randrange(50) for _ in range(rng.choice([0, 3, 700, 5000]))], "<u2") for _ in rows]
    import io
    out = io.BytesIO()
    f = token_files._File(out, table, np.dtype("<u2"))
    f.add([r[0] for r in rows], [len(x) for x in rows_ids], [x.tobytes() for x in rows_ids])
    f.close()
    units = f.units("p", 0).to_pylist()
    assert len(units) > 10 and sum(u["docs"] for u in units) == len(rows)
    _, _, sizes, blocks, sums = token_files._index(out, out.getbuffer().nbytes)
    for u in units:
        want = np.concatenate(rows_ids[u["first_doc"]:u["first_doc"] + u["docs"]])
        assert (token_files._ids(out, blocks, sums, table, u["first_id"], u["ids"]) == want).all()
    data = bytearray(out.getvalue())
    data[int(blocks[0, 0]) + 2 * 8 * 65 + 100] ^= 1  # in the first stream
    with pytest.raises(ValueError, match="damaged"):
        token_files._ids(io.BytesIO(bytes(data)), blocks, sums, table, 0, len(np.concatenate(rows_ids)))


def test_no_tokens(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_files.read_tokens(spark, token_files.write_tokens(docs, WORD_MODEL, end=1, words=token_files.LATIN_WORDS)).count() == 0
    one = spark.createDataFrame([(None, None)], "doc_id bigint, text string")
    got = token_files.read_tokens(spark, token_files.write_tokens(one, WORD_MODEL)).collect()
    assert [tuple(r) for r in got] == [(None, 0, 0, b"")]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_token_query_equals_whole_texts(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    want, at = [], 0
    for key, n, ids in plain_tokens(docs, WORD_MODEL, 1):
        want.append((key, at, n, zlib.crc32(ids)))
        at += n
    assert sorted(tuple(r) for r in queries.QUERIES["op11_token_files"](spark, DATA).collect()) == want


# ---- Merkle manifest -----------------------------------------------------------------------------------------------
def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(leaves, arity):
    """Root, and for each leaf its (position, other hashes) from the leaf up."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // arity * arity:p // arity * arity + arity]
            proofs[i].append((p % arity, run[:p % arity] + run[p % arity + 1:]))
        level = [H(*level[i:i + arity]) for i in range(0, len(level), arity)]
        at = [p // arity for p in at]
    return level[0], proofs


@pytest.mark.parametrize("arity, digits, n", [(2, 10, 40), (2, 2, 37), (3, 2, 29), (2, 1, 9), (4, 3, 1)])
def test_manifest_equals_plain_trees(spark, arity, digits, n):
    rng = random.Random(n)
    langs = [None, "", "en", "de", "é", "z"]
    rows = [(i - 3, rng.choice(["ü", "a", None]), langs[min(rng.randrange(12), 5)], rng.choice([None, 7]), rng.choice(["x" * i, "", None]),
             *CLASHING) for i in range(n)]
    rows += rows[:2] + [(None, None, "en", None, None, *CLASHING)]
    docs = spark.createDataFrame(rows, f"doc_id bigint, source string, lang string, n_chars bigint, text string, {CLASH}").repartition(3)
    got = merkle.manifest(docs, arity=arity, digits=digits, carry={"twice": F.col("doc_id") * 2})
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("proof"))).collect()

    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    leaf = {r[:5]: H(*map(field, r[:5])) for r in rows}
    groups = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        of = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is None, r[0] or 0, leaf[r[:5]]))
        trees[g] = [(r[0], leaf[r[:5]]) for r in of], *plain_tree([leaf[r[:5]] for r in of], arity)
    root, tops = plain_tree([trees[g][1] for g in groups], arity)
    want = [(key, g, h, trees[g][1], root, p + tops[i]) for i, g in enumerate(groups)
            for (key, h), p in zip(trees[g][0], trees[g][2])]
    have = [(r["doc_id"], r["lang"], r["leaf"], r["subroot"], r["root"], [(s["position"], s["siblings"]) for s in r["proof"]]) for r in got]
    assert sorted(map(str, have)) == sorted(map(str, want))
    assert all(r["folded"] == root and r["twice"] == (None if r["doc_id"] is None else 2 * r["doc_id"]) for r in got)


def test_empty_manifest(spark):
    docs = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert merkle.manifest(docs).count() == 0


# ---- conversation repair -------------------------------------------------------------------------------------------
def cheapest(rows):
    """Faults, cost, ASCII-least edits and repaired rows, by a search over all edits."""
    faults, seen = [], set()
    for _, role, text in rows:
        w = text.strip(conversations.SPACES)
        faults.append(1 if not w else 2 if (role, text) in seen else 3 if w[-1] not in ".!?" else 0)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", [])], set()
    while heap:
        cost, edits, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return faults, cost, edits, out
        nxt = "a" if state == "u" else "u"
        full = {"u": "user", "a": "assistant"}[nxt]
        heapq.heappush(heap, (cost + 5, edits + "I", i, nxt, out + [(full, "")]))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, out))
            if faults[i] not in (1, 2):
                more = 5 if faults[i] == 3 else 0
                if role[:1] == nxt or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, role[:1], out + [(role, text)]))
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, nxt, out + [(full, text)]))


def plain_repair(rows):
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, g in groups.items():
        g.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults, cost, edits, kept = cheapest(g)
        turns = [r[0] for r in g if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(g, g[1:]))
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()), kept
    return out


def random_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(40)]:
        for t in range(rng.choice([1, 2, 5, 9, 30])):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, ["user", "assistant"][t % 2], ["user", "assistant"][t % 2]])
            text = rng.choice(["Yes.", "No!", "", " \n", None, f"Turn {t}.", f"Turn {t}?\t", f"cut {t}", "É… fin"])
            rows.append((conv, rng.choice([None, t, t, t, t + 2]), role, text, *CLASHING))
    return rows + rows[:3]


@pytest.mark.parametrize("bits", [0, 2, 12])
def test_repair_equals_a_search_over_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = random_conversations(bits)
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, text string, {CLASH}").repartition(3)
    want = plain_repair(rows)
    r = conversations.Repair(df)
    assert {x[0]: tuple(x)[1:] for x in r.report().collect()} == {k: v[0] for k, v in want.items()}
    kept = {}
    for x in r.repaired().orderBy("_c", "place", "nth").collect():
        kept.setdefault(None if x["_c"] == "0" else int(x["_c"][1:]), []).append((x["role"], x["text"]))
    assert kept == {k: v[1] for k, v in want.items() if v[1]}


def test_one_conversation_of_many_rows(spark):
    rows = [(7, i, ["user", "assistant"][i % 2] if i % 50 else "tool", f"Turn {i}." if i % 9 else "Again.") for i in range(30_000)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string").repartition(4)
    got = conversations.Repair(df).report().first()
    audit, state, text = got["audit"], "", []
    letters = iter(audit)
    seen, cost = set(), 0
    for _, _, role, x in rows:
        a = next(letters)
        while a == "I":
            state = "a" if state == "u" else "u"
            text.append({"u": "user:", "a": "assistant:"}[state])
            cost, a = cost + 5, next(letters)
        assert a == "D" or (role, x) not in seen
        seen.add((role, x))
        if a == "D":
            cost += 2
            continue
        nxt = "a" if state == "u" else "u"
        assert a == "R" or role[0] == nxt
        cost, state = cost + (a == "R"), nxt
        text.append({"u": "user:", "a": "assistant:"}[state] + x)
    assert list(letters) == list("" if state == "a" else "I") and cost + 5 * (state == "u") == got["cost"]
    assert got["duplicate"] == 30_000 - len(seen) and got["gaps"] == 0


def test_no_conversations(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    r = conversations.Repair(df)
    assert r.report().count() == 0 and r.repaired().count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_repair_query_equals_plain(spark):
    rows, want_all = [], []
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect():
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", r["text"]) if kind == 2 else r["text"]
        want_all.append(r["conv_id"])
        rows += [(r["conv_id"], r["turn"], "user" if kind == 4 else r["role"], text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {k: v[0] for k, v in plain_repair(rows).items()}
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {x[0]: tuple(x)[1:] for x in queries.QUERIES["op13_conversation_repair"](spark, DATA).collect()}
    assert got == {c: want.get(c, none) for c in set(want_all)}
