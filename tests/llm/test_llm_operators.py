"""The operators of the llm subpackage against plain versions, and on the odd cases that their docstrings define."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelloom.llm import (byte_windows, components, decontamination, factorisation, html_text, mixing, quality, run_length_index,
                           secrets, simhash, similarity, superkmers, url_filter, word_windows)

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la le the of and die der que Überweg été".split()
#: columns whose names an operator might use inside
EXTRA = "slot bigint, start bigint, nth bigint, spans string, fingerprint string, score double, h bigint, n bigint, label int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts, start=0):
    return [(i + start, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, len(t) if t else None,
             1, 2, 3, "x", "y", 0.5, 4, 5, 6) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, shared passages, repeats inside a text, empty and missing texts, a long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randint(1, 160)) for _ in range(12)]
    passage = prose(rng, 70)
    edited = base[3].split()
    edited[len(edited) // 2] = "changed"
    return [*base, base[3], base[3], " ".join(edited), f"{base[1]} {passage} {base[2]}", f"{passage}\n{base[5]}",
            f"{base[6]}\t{passage}", passage, passage + " end", "", None, "   \n ", "one", "a b c", "ab" * 400,
            "line one two three\n" * 60, "á" * 130, base[0] + " " + base[0], prose(rng, 4000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = rows_of(texts)
    rows += [rows[3], rows[3], (None, texts[3], None, None, None, *rows[0][5:]), (None, None, None, None, None, *rows[0][5:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def kept_columns(out, docs):
    assert set(docs.columns) <= set(out.columns)
    return out


# ---- secrets -------------------------------------------------------------------------------------------------------

def plain_spans(text):
    kinds = [("assign", re.compile(secrets.BASE_KINDS[0].pattern, re.I | re.A), 2, 12),
             ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16)]
    out = [(m.start(), k, name, m.end()) for k, (name, r, g, n) in enumerate(kinds) for m in r.finditer(text)
           if len(m.group(g)) >= n]
    return [f"{name}:{s}:{e}" for s, _, name, e in sorted(out)]


def test_secret_spans_equal_plain_expressions(spark):
    rng = random.Random(2)
    bits = ["password=", "PASSWD: ", "token = \"", "secret=", "api_key:'", "apikey=", "AKIA", "ABCDEF0123456789XY", "akia",
            "deadbeef", "0123456789abcdef", "é", "İ", "ſecret=", "Kelvin", " ", "\n", "token=secret=abcdefghijkl", "x" * 14, "=", "ab12"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)] + ["", None, "a" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    base = [k.name for k in secrets.BASE_KINDS]
    got = secrets.find_secrets(df).select("doc_id", secrets.spans_text(F.col("secrets"), base).alias("s")).collect()
    for r in got:
        assert r["s"] == ",".join(plain_spans(texts[r["doc_id"]] or "")), texts[r["doc_id"]]


def test_checksums_decide_and_redaction(spark, docs, empty):
    body = "Ab3" * 10
    good = "ghp_" + body + secrets.base62_checksum(body)
    bad = good[:-1] + ("0" if good[-1] != "0" else "1")
    npm = "npm_" + body + secrets.base62_checksum(body)
    df = spark.createDataFrame([(1, f"é {good} x", 99), (2, bad, 99), (3, npm, 99), (4, None, None), (5, "plain", 5)],
                               "doc_id int, text string, n_chars int")
    got = {r[0]: r[1] for r in secrets.find_secrets(df).select("doc_id", secrets.spans_text(F.col("secrets"))).collect()}
    assert got == {1: "github:2:42", 2: "", 3: "npm:0:40", 4: "", 5: ""}
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact(df).collect()}
    assert out == {1: ("é [github] x", 12), 2: (bad, 40), 3: ("[npm]", 5), 4: (None, None), 5: ("plain", 5)}
    overlap = spark.createDataFrame([(1, "token=0123456789abcdef0123 and 0123456789abcdef")], "doc_id int, text string")
    assert secrets.redact(overlap).first()["text"] == "[assign] and [hex]"
    assert secrets.redact(docs).count() == docs.count() and secrets.redact(docs).columns == docs.columns
    assert secrets.redact(empty).count() == 0


# ---- urls ----------------------------------------------------------------------------------------------------------

def plain_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_rules_equal_plain_search(spark):
    rng = random.Random(4)
    labels = ["net", "org", "example", "blog", "a", "b-c", "ex", "example-x"]
    rules = list({(".".join(rng.choice(labels) for _ in range(rng.randint(1, 3))), rng.choice(["/", "/en/", "/en", "/de/", ""])): v
                  for v in ["block", "allow"] * 15}.items())
    rules = [(h, p, v) for (h, p), v in rules]
    urls = [rng.choice(["http://", "https://", "x"]) + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
            + rng.choice(["", "/", "/en/x", "/EN/", "/de/?q=/en/", "#/en/", "/en"]) for _ in range(400)]
    urls += [None, "", "http://", "HTTP://A.NET/en/", "http://blog.example.net/en/"] + ["http://blog.example.net/en/hot"] * 300
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in url_filter.judge_urls(df, r, ranges=7).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        assert got[i] == plain_rule(u, rules), u
    assert url_filter.judge_urls(df.limit(0), r).count() == 0
    none = url_filter.judge_urls(df, r.limit(0)).select("rule", "verdict").distinct().collect()
    assert [tuple(x) for x in none] == [(None, "allow")]


# ---- near-duplicates -------------------------------------------------------------------------------------------------

def plain_fingerprint(text, k):
    import xxhash
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, d):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ps = sorted(parent)
    for i, a in enumerate(ps):
        for b in ps[i + 1:]:
            if bin(a ^ b).count("1") <= d:
                parent[root(a)] = root(b)
    return {p: root(p) for p in ps}


@pytest.mark.parametrize("shingle,bits", [(4, 4), (5, 7), (3, 1)])
def test_near_duplicates_equal_plain_components(docs, shingle, bits):
    rows = docs.select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"], shingle) for r in rows]
    roots = plain_components(prints, bits)
    least = {}
    for r, p in zip(rows, prints):
        if r["doc_id"] is not None:
            least[roots[p]] = min(least.get(roots[p], r["doc_id"]), r["doc_id"])
    want = sorted((str(r["doc_id"]), p, least.get(roots[p])) for r, p in zip(rows, prints))
    got = sorted((str(r["doc_id"]), r["fingerprint"] % (1 << 64), r["component_id"])
                 for r in simhash.near_duplicates(docs, shingle=shingle, max_bits=bits).collect())
    assert got == want


def test_links_between_random_fingerprints(spark):
    rng = random.Random(8)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = set()
    for c in centres:
        x = c
        for _ in range(60):  # chains and balls
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            prints |= {x, c ^ (1 << rng.randrange(64))}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint bigint")
    for bits in (0, 3, 4):
        stars = {r["a"]: r["b"] for r in components.components(simhash.links(df, bits)).collect()}
        got = {}
        for (p,) in signed:
            got.setdefault(stars.get(p, p), set()).add(p % (1 << 64))
        want = {}
        for p, r in plain_components(prints, bits).items():
            want.setdefault(r, set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_runs_grow_trees():
    state = simhash._Links(4)
    prints = np.arange(200, dtype=np.uint64)
    assert len(state.of_runs(np.zeros(200, np.int64), prints)) == 199


def test_one_of_each(docs, empty):
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and not {12, 13} & set(ids) and None not in ids
    assert simhash.one_of_each(empty).count() == 0


@pytest.mark.parametrize("exact, most", [(False, 1_000_000), (True, 1_000_000), (True, 150)])
def test_similar_texts_equal_plain_pairs(spark, exact, most, monkeypatch):
    monkeypatch.setattr(similarity, "GROUP_SHINGLES", most)
    rng = random.Random(21)
    texts, vocabulary = [], [f"w{i}" for i in range(400)]
    for _ in range(12):  # copies of each base with more and more changed words, so similarities around the bound
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for edits in (0, 1, 1, 2, 3, 4, 6):
            words = base.copy()
            for at in rng.sample(range(len(words)), edits):
                words[at] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", None, "one two", "One  two", texts[0].upper(), texts[3]]

    def shingles(t):
        words = (t or "").lower().split()
        return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    between = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                between += a != b
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert between > 20
    clash = "set bigint, n int, keys string, h bigint, a int, b int, hashes string, digest string"
    rows = [(i, t, 1, 2, "x", 3, 4, 5, "y", "z") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:3], f"doc_id bigint, text string, {clash}").repartition(3)
    found = similarity.similar_texts(df, shingle=5, exact=exact).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert got == {i: root(i) for i in range(len(texts))} and len(found) == len(texts) + 3


def test_bands_find_what_is_similar_enough():
    rng = np.random.default_rng(3)
    met = 0
    for _ in range(400):  # two sets of 900 with 800 in common: a similarity of 0.8
        x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
        met += bool(np.intersect1d(similarity.bands(x[:900]), similarity.bands(x[100:])).size)
    assert met >= 396


def test_a_key_whose_sets_are_no_copies_of_its_first_one(spark, monkeypatch):
    """All sets share one key, but the first one is similar to none; the others make two groups and a chain."""
    monkeypatch.setattr(similarity, "bands", lambda s: np.zeros(1, np.uint64))
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[i:i + 60]) for i in (0, 4, 8, 12)]
    texts = ["lone text of its own that is like none of them", *chain, *(" ".join(reversed(x.split())) for x in chain), "and another one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["component_id"] for r in sorted(similarity.similar_texts(df, shingle=5).collect())]
    assert got == [0, 1, 1, 1, 1, 5, 5, 5, 5, 9]


def test_similar_texts_meet_by_fingerprint(spark, monkeypatch):
    """Without any band, texts whose fingerprints are near are still compared, and linked only if they are similar."""
    monkeypatch.setattr(similarity, "bands", lambda s: s[:0])
    words = [f"w{i}" for i in range(3000)]
    one, other = " ".join(words), " ".join([*words[:-1], "end"])
    assert (simhash.fingerprint(one, 5) ^ simhash.fingerprint(other, 5)).bit_count() <= corpus_pipeline.NEAR_BITS
    repeated = " ".join(["same old line of words"] * 400)  # its fingerprint has that of few shingles
    more = " ".join(["same old line of words"] * 400 + words[:20])
    assert (simhash.fingerprint(repeated, 5) ^ simhash.fingerprint(more, 5)).bit_count() <= corpus_pipeline.NEAR_BITS
    texts = [one, "another text of its own kind", other, repeated, more, None, "", repeated.upper()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r["component_id"] for r in sorted(similarity.similar_texts(df, shingle=5, bits=corpus_pipeline.NEAR_BITS).collect())]
    assert got == [0, 1, 0, 3, 4, 5, 5, 3]
    kept = corpus_pipeline.near_dedup_stage(spark, df, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 3, 4, 5]


def test_components_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(200)] + [(5, 5), (3, 0), (3, 0)]
    stars = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert stars == {i: 0 for i in range(1, 300)} | {1001 + i: 1000 for i in range(200)}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- classifier ------------------------------------------------------------------------------------------------------

def test_pair_sums_equal_explicit_pairs():
    rng = np.random.default_rng(0)
    m = factorisation.Model(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    at, value = np.array([3, 9, 9, 40], np.int32), np.array([0.5, 1.0, 2.0, -1.0], np.float32)
    want = 0.3 + (m.weights[at] * value).sum() + sum(
        float(m.vectors[at[i]] @ m.vectors[at[j]]) * value[i] * value[j] for i in range(4) for j in range(i + 1, 4))
    assert abs(m.margins(at, value, np.array([0]))[0][0] - want) < 1e-3


def test_classifier_learns_and_ignores_held_out_labels(spark, docs, empty):
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) if i % 2 else " ".join(w + "###" for w in prose(rng, 40).split())) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    held = [zlib.crc32(str(i).encode()) % 3 == 1 for i in range(240)]
    labels = spark.createDataFrame([(i, i % 2 if not held[i] else 1 - i % 2) for i in range(240)] + [(1, None), (10 ** 6, 1)],
                                   "doc_id bigint, quality int")
    model = factorisation.train(df, labels)
    got = {r["doc_id"]: r["score"] for r in factorisation.score(df, model).collect()}
    assert all((got[i] >= 0.5) == bool(i % 2) for i in range(240))
    marks = {r["doc_id"]: r["h"] for r in df.select("doc_id", factorisation.held_out().alias("h")).collect()}
    assert [marks[i] for i in range(240)] == held
    scores = [r["score"] for r in kept_columns(factorisation.score(docs, model), docs).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    assert factorisation.score(empty, factorisation.train(empty, labels.limit(0))).count() == 0


# ---- decontamination -------------------------------------------------------------------------------------------------

def plain_hits(text, items, window):
    def words(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)

    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        k = min(window, len(v))
        for i in range(len(v) - k + 1) if v else ():
            for j in range(len(w) - k + 1):
                if w[j:j + k] == v[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_contamination_equals_plain_search(spark, docs, texts, empty, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontamination, "SEGMENT_TOKENS", 500)
    rng = random.Random(3)
    items = [(1, " ".join(texts[3].split()[2:30])), (2, "the of"), (3, ""), (4, None), (5, texts[18]), (6, prose(rng, 30)),
             (7, "A b!c"), (5, texts[4]), (None, texts[5]), (8, "absent words only")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination(docs, bench).collect()
    keyed = [(i, t) for i, t in items if i is not None]
    want = sorted((str(r["doc_id"]), *plain_hits(r["text"], keyed, 10)) for r in docs.collect())
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items"]) for r in got) == want
    for r in got:
        spans = [m for m in r["matches"] if m["kind"] == "phrase"]
        assert len(set().union(*[set(range(m["start"], m["end"])) for m in spans])) == r["n_hit"]
        assert all(0 <= m["start"] < m["end"] <= r["n_words"] for m in r["matches"])
    clean = decontamination.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert clean.count() == sum(1 for w in want if w[2] == 0)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    bench = spark.createDataFrame([(1, "red green blue black white")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "x white black filler blue green red y"), (2, "red green blue black"),
                                (3, "red " + "z " * 30 + "green blue black white")], "doc_id bigint, text string")
    got = {r["doc_id"]: [(m["kind"], m["start"], m["end"]) for m in r["matches"]]
           for r in decontamination.contamination(df, bench).collect()}
    assert got == {1: [("proximity", 1, 7)], 2: [], 3: []}


def test_proximity_matches_equal_plain_search_in_short_documents(spark):
    rng = random.Random(17)
    items = [(1, "red green blue"), (2, "blue white red black"), (3, "green green red")]
    texts = [" ".join(rng.choice("red green blue white black x y z u v w".split()) for _ in range(rng.randint(0, 30))) for _ in range(150)]
    texts += ["white end red", "green blue u", "blue " + "x " * 4 + "red y green blue"]

    def plain(text, item, span):
        words, terms, found = text.split(), set(item.split()), set()
        for a in range(len(words)):
            for z in range(a + 1, min(a + span, len(words)) + 1):
                if terms <= set(words[a:z]):
                    found.add((a, z))
        return {t: {min((z - a, a, z) for a, z in found if a <= i < z)[1:] for i, w in enumerate(words) if w == t
                    and any(a <= i < z for a, z in found)} for t in terms}

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = decontamination.contamination(df, bench, near_span=8).collect()
    n = 0
    for item, text in items:
        want = [plain(t, text, 8) for t in texts]
        got = {r["doc_id"]: {(m["start"], m["end"]) for m in r["matches"] if m["kind"] == "proximity" and m["item_id"] == item} for r in rows}
        def rarest(t):
            return min(dict.fromkeys(text.split()), key=t.split().count)

        assert got == {i: w[rarest(t)] for i, (t, w) in enumerate(zip(texts, want))}
        n += sum(map(len, got.values()))
    assert n > 50


# ---- repeated windows --------------------------------------------------------------------------------------------------

def test_matching_statistics_equal_plain_search():
    rng = random.Random(3)
    for trial in range(60):
        letters = b"ab" if trial % 2 else b"abcd"
        held = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 5))]
        asked = [bytes(rng.choice(letters + b"z") for _ in range(rng.randint(1, 30))) for _ in range(4)]
        asked.append(held[0][3:20] + b"q" + held[-1][1:])
        for p, lengths in zip(asked, run_length_index.RunLengthIndex(held).longest_matches(asked, 6)):
            for i in range(len(p)):
                n = 0
                while i + n < len(p) and any(p[i:i + n + 1] in t for t in held):
                    n += 1
                assert min(n, 6) == min(int(lengths[i]), 6)


def covered(flags, k, n):
    out = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(flags):
        out[i:i + k] = True
    return out


@pytest.mark.parametrize("most", [2, 1000])
def test_word_repeats_equal_plain_search(docs, empty, most):
    k = 12
    rows = docs.select("doc_id", "text").collect()
    first = {}
    cut = [(r["doc_id"] if r["doc_id"] is not None else 1 << 62, (r["text"] or "").encode().split()) for r in rows]
    for i, w in cut:
        for j in range(len(w) - k + 1):
            x = tuple(w[j:j + k])
            first[x] = min(first.get(x, i), i)
    want = []
    for (i, w), r in zip(cut, rows):
        gone = covered([first[tuple(w[j:j + k])] < i for j in range(len(w) - k + 1)], k, len(w))
        want.append((str(r["doc_id"]), len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    out = kept_columns(word_windows.remove_repeats(docs, window=k, piece=4, most_strings=most), docs)
    got = [(str(r["doc_id"]), r["_repeats"]["n_words"], r["_repeats"]["n_removed"], r["_repeats"]["kept"]) for r in out.collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 0
    assert word_windows.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("most,indexed", [(2, 2), (1000, 2), (1000, 1000)])
def test_byte_repeats_equal_plain_search(spark, texts, docs, empty, most, indexed, monkeypatch):
    monkeypatch.setattr(byte_windows, "MOST_INDEXED", indexed)
    k = 40
    rows = sorted((r for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None))
    seen, want = {}, []
    for r in rows:
        b = (r["text"] or "").encode()
        flags = []
        for j in range(len(b) - k + 1):
            at = seen.setdefault(b[j:j + k], (r["doc_id"], j))
            flags.append(at < (r["doc_id"], j))
        gone = covered(flags, k, len(b))
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want.append((r["doc_id"], len(b), int(gone.sum()), hashlib.sha256(left).hexdigest()))
    out = kept_columns(byte_windows.remove_repeats(docs.filter("doc_id is not null"), window=k, piece=8, most_strings=most), docs)
    got = [(r["doc_id"], r["_repeats"]["n_bytes"], r["_repeats"]["n_removed"], hashlib.sha256(r["_repeats"]["kept"]).hexdigest())
           for r in out.collect()]
    assert sorted(got) == sorted(want)
    null_key = byte_windows.remove_repeats(docs, window=k, piece=8).filter("doc_id is null and text is not null").first()
    assert null_key["_repeats"]["n_removed"] == len(texts[3].encode())  # a copy under a missing id comes last
    assert byte_windows.remove_repeats(empty).count() == 0


def test_repeats_leave_nothing_large_on_the_driver(docs, monkeypatch):
    plans, made, freed = [], [], []
    staged, init, free = superkmers.staged, superkmers.Known.__init__, superkmers.Known.free

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return staged(df)

    monkeypatch.setattr(superkmers, "staged", seen)
    monkeypatch.setattr(superkmers.Known, "__init__", lambda self, values: (made.append(self), init(self, values))[1])
    monkeypatch.setattr(superkmers.Known, "free", lambda self: (freed.append(self), free(self))[1])
    out = word_windows.remove_repeats(docs, window=10, piece=4)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert made and freed == made and not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)
    assert out.count() == docs.count()


def test_bitmap_comes_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(superkmers, "_PIECE", 1 << 14)
    values = superkmers.mixed(np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    known = superkmers.Known(spark.createDataFrame([(int(v),) for v in values], "h bigint"))
    assert known(values).all()
    assert known(superkmers.mixed(np.arange(5000, 9000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)).mean() < 0.02
    known.free()


def test_runs_share_windows_and_minimisers():
    rng = np.random.default_rng(1)
    sizes = np.array([0, 30, 3, 50, 9])
    pieces = superkmers.mixed(rng.integers(0, 6, sizes.sum()).astype(np.uint64))
    r = superkmers.runs_of(sizes, pieces[:sizes.sum() - 3], 10, 4, True)
    assert r.n.sum() == np.maximum(sizes - 9, 0).sum()
    at = np.cumsum(sizes) - sizes
    for row, start, n, value, twice in zip(r.row, r.start, r.n, r.value, r.twice):
        span = pieces[at[row] + start:at[row] + start + n + 6]
        assert span.min() == value and (np.sum(span == value) > 1) == twice


# ---- mixing --------------------------------------------------------------------------------------------------------

def test_mixture_stays_within_one_block_of_its_weights(spark, docs, empty):
    q = 64
    weights = spark.createDataFrame([("a", 30), ("b", 1), ("c", 9), ("d", None)], "source string, weight bigint")
    slots = {r["source"]: r["slots"] for r in mixing.cycle_slots(weights, q).collect()}
    assert sum(slots.values()) == q and min(slots.values()) >= 1
    turns = [r["source"] for r in mixing.earliest_deadline_first(mixing.cycle_slots(weights, q), q).orderBy("slot").collect()]
    assert len(turns) == q
    for t in range(q + 1):
        for s, a in slots.items():
            assert abs(turns[:t].count(s) - t * a / q) < 1
    out = kept_columns(mixing.mix(docs, cycle=q, block_chars=50), docs).collect()
    assert len(out) == docs.count()
    owner = {}
    for r in out:
        assert r["release"] <= r["slot"] < r["deadline"] and r["block"] == r["start"] // 50
        assert owner.setdefault(r["slot"], r["source"] or "") == (r["source"] or "")  # a slot is one source's
    assert mixing.mix(empty).count() == 0


def test_mixture_uses_no_python(docs):
    plan = mixing.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---- quality -------------------------------------------------------------------------------------------------------

def plain_counts(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))


def plain_distance(p, q):
    m = (p + q) / 2
    def kl(a):
        return float(np.sum(a[a > 0] * np.log2(a[a > 0] / m[a > 0])))
    return ((kl(p) + kl(q)) / 2) ** 0.5


def test_quality_counts_and_verdicts(spark, docs, texts, empty):
    small = docs.filter("length(text) < 3000 or text is null")
    out = kept_columns(quality.quality_rules(small), small).collect()
    assert len(out) == small.count()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in out:
        n = plain_counts(r["text"])
        assert tuple(r["_quality"][c] for c in names) == n
        failed = n[0] < 10 or 100 * n[4] > 20 * n[0]
        assert r["_quality"]["base_failed"] == failed
        assert not (failed and r["_quality"]["kept"])
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.quality_rules(empty).count() == 0


def test_distances_equal_plain_formula(spark):
    rng = np.random.default_rng(3)
    p, q = rng.dirichlet(np.ones(9)), rng.dirichlet(np.ones(9))
    p[2] = 0
    p /= p.sum()
    df = spark.createDataFrame([(p.tolist(), q.tolist()), (p.tolist(), p.tolist()), (None, q.tolist())], "p array<double>, q array<double>")
    got = [r[0] for r in df.select(quality.jensen_shannon(F.col("p"), F.col("q"))).collect()]
    assert abs(got[0] - plain_distance(p, q)) < 1e-9 and got[1] < 1e-6 and got[2] is None


def test_odd_texts_are_told_from_prose(spark):
    rng = random.Random(6)
    good = [prose(rng, 120) for _ in range(60)]
    odd = [" ".join(w + "###" for w in prose(rng, 120).split()), prose(rng, 120).upper(),
           " | ".join(x for x in (prose(rng, 300)).split() if len(x) > 4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(good + odd)], "doc_id int, text string, lang string")
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept >= set(range(60)) - {i for i in range(60) if plain_counts(good[i])[4] * 5 > 120}
    assert not kept & {60, 61, 62}


def test_texts_of_unknown_language_are_held_against_the_nearest(spark):
    rng = random.Random(31)
    rows = []
    for lang, words in quality.COMMON_WORDS.items():  # function words of one language between content words of its own
        content = [f"{lang}{rng.choice('aeiou')}{x}{'é' * (lang == 'fr')}" for x in "bdfgklmnprst"]
        for _ in range(30):
            t = " ".join(rng.choice(words.split() if rng.random() < 0.6 else content) for _ in range(120))
            rows.append((len(rows), t, lang))
    junk = [" ".join(w + "###" for w in rows[0][1].split()), rows[40][1].upper()]
    clean = spark.createDataFrame([(i, t, None if i % 2 else x) for i, t, x in rows], "doc_id int, text string, lang string")
    odd = spark.createDataFrame([(1000 + i, t, x) for i, t in enumerate(junk) for x in (None, "", "xx")], "doc_id int, text string, lang string")
    assert {r["doc_id"] for r in quality.keep_good(clean).collect()} == set(range(len(rows)))
    refs = quality.language_references(clean)
    assert {r["__lang"] for r in refs.collect()} == set(quality.COMMON_WORDS)
    assert quality.quality_rules(odd, references=refs).filter("_quality.kept").count() == 0
    # without any reference only the other rules hold
    out = quality.quality_rules(clean.withColumn("lang", F.lit(None).cast("string"))).select("_quality.*")
    assert out.filter("kept and class_distance is null and word_distance is null").count() == len(rows)


# ---- pages -------------------------------------------------------------------------------------------------------------

PAGES = [
    ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Home</a>"
     "</ul></nav><div class='ad'>Buy</div><article><h1>Head</h1><p><b>First  line<br><p>Second &amp; third\n line</p></article>"
     "<footer>&copy; x</footer>", "Head\nFirst line\nSecond & third line"),
    ("<body><div id=main-menu>Menu</div><div class='content'><h2>Big</h2><p>" + "long text here " * 20 + "</p><p>tail</p></div>"
     "<aside>side</aside><div class='comments'><p>" + "reader says " * 40 + "</p></div></body>",
     "Big\n" + ("long text here " * 20).strip() + "\ntail"),
    ("<main><p>One<p>Two<ul><li>a<li>b</ul><div class='cookie-notice'>ok</div><form>q<input></form></main>", "One\nTwo\na\nb"),
    ("<article><p>Kept</p><section class='comments'><article class='comment'>gone</article></section><p>also</p></article>",
     "Kept\nalso"),
    ("just text &lt;b&gt; &eacute;", "just text <b> é"), ("", ""), (None, ""), ("<div></div>", ""), ("<p>cut <a href='x", "cut <a href='x"),
    ("<!-- c --><p>a<!-- b -->b</p>", "ab"), ("<p title=don't>it isn't</p><p data-x='a>b'>yes</p>", "it isn't\nyes"), ("<table><tr><td>x<td>y<tr><td>z</table>", "x y\nz"),
    ("<div>" * 3000 + "deep", "deep"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_page_text(page, want):
    assert html_text.extract(page) == want


def test_text_of_the_article_stays():
    long = "a sentence with words " * 10
    assert html_text.extract(f"<body>Intro text<div><p>{long}</p><p>{long}</p></div>Closing text</body>") == "\n".join(
        ["Intro text", long.strip(), long.strip(), "Closing text"])
    assert html_text.extract('<article><h2 id="share-prices">Prices</h2><section id="related-work"><p>Work</p></section>'
                             '<p data-id="promo">x <math><mi>y</mi></math></p></article>') == "Prices\nWork\nx y"
    assert html_text.extract("<article><p>Text</p><div id=related-links><a href=x>more</a></div></article>") == "Text"


def test_page_frame(spark):
    df = spark.createDataFrame([(i, p, "old") for i, (p, _) in enumerate(PAGES)], "page_id int, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.main_text(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(PAGES)}
    assert html_text.main_text(df.limit(0)).count() == 0


# ---- pages without an article element ------------------------------------------------------------------------------------

def sentences(n, word):
    return " ".join(f"{word.capitalize()} number {i} says a little more than the one before it." for i in range(n))


@pytest.mark.parametrize("page, want", [
    (f"<body><div id=content><div><h2>One</h2><p>{sentences(4, 'first')}</p></div><div><h2>Two</h2><p>{sentences(12, 'second')}</p></div></div></body>",
     ["One", sentences(4, "first"), "Two", sentences(12, "second")]),
    (f"<body><div><h1>Title</h1></div><div><p>{sentences(5, 'a')}</p><p>{sentences(6, 'b')}</p></div></body>", ["Title", sentences(5, "a"), sentences(6, "b")]),
    (f"<body><div><p>{sentences(5, 'a')}</p><p>{sentences(6, 'b')}</p></div><p>The end.</p></body>", [sentences(5, "a"), sentences(6, "b"), "The end."]),
    (f'<article><p class="lead share-buttons-none">{sentences(1, "lead")}</p><div class="search-results-analysis"><p>{sentences(3, "a")}</p></div>'
     f'<div class="share-buttons">Share</div><div class="cookie-consent-banner">Cookies</div></article>', [sentences(1, "lead"), sentences(3, "a")]),
    (f"<body><div><a href=x>One link</a> <a href=y>and another one</a></div><div><p>{sentences(5, 'a')}</p><p>{sentences(6, 'b')}</p></div></body>",
     [sentences(5, "a"), sentences(6, "b")]),
])
def test_pages_keep_all_their_text(page, want):
    assert html_text.extract(page).split("\n") == want


def plain_density_sums(page):
    """Composite text density by its definition, each element counted anew: (density sum, element) of all elements."""
    import math

    root = html_text.parse(page)

    def text(n):
        return "".join(text(c) if isinstance(c, html_text.Node) else "".join(c.split()) for c in n.children)

    def inside(n):
        return [x for c in n.children if isinstance(c, html_text.Node) for x in (c, *inside(c))]

    def link_text(n):
        return len(text(n)) if n.tag == "a" else sum(link_text(c) for c in n.children if isinstance(c, html_text.Node))

    total, links = max(len(text(root)), 1), link_text(root)

    def density(n):
        c, t, lc, lt = len(text(n)), max(len(inside(n)), 1), link_text(n), sum(x.tag == "a" for x in inside(n))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * lc + links / total * c + math.e)
        return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1.0)) / max(base, 1e-9)

    return [sum(density(c) for c in n.children if isinstance(c, html_text.Node)) for n in html_text._nodes(root)]


def test_density_sums_equal_their_definition():
    rng = random.Random(9)

    def element(depth):
        tag = rng.choice(["div", "p", "a", "span", "section"])
        inner = "".join(element(depth - 1) if depth and rng.random() < 0.6 else sentences(rng.randint(0, 3), "x") for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    for _ in range(40):
        page = element(4)
        want = plain_density_sums(page)
        assert np.allclose([n.total for n in html_text.measure(html_text.parse(page))], want)


def test_suffixes_told_apart_are_not_sorted_again(monkeypatch):
    sizes, sort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda x, *a, **kw: sizes.append(len(x)) or sort(x, *a, **kw))
    rng = np.random.default_rng(3)
    texts = [rng.integers(97, 123, 20_000, dtype=np.uint8).tobytes(), b"ab" * 150, b"ab" * 150, b"", b"x"]
    _, order = run_length_index.suffix_array(texts)
    assert sum(sizes) < 40_000
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    # an end is less than every symbol, and ends are ordered by text
    plain = sorted((tuple(x + len(texts) for x in t[i:i + 400]) + (j,), int(ends[j]) - len(t) + i)
                   for j, t in enumerate(texts) for i in range(len(t) + 1))
    assert order.tolist() == [at for _, at in plain]


def test_staged_rows_leave_no_shuffle_files(spark):
    from pathlib import Path
    import time

    from labelloom.llm.base import CLEANUP, staged

    def files():
        folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
        return {p.name for d in folders for p in Path(str(d)).glob("*/shuffle_*.data")}

    old, before = spark.conf.get(CLEANUP), files()
    rows = staged(spark.range(5000).groupBy((F.col("id") % 700).alias("g")).count().repartition(3))
    until = time.monotonic() + 10
    while files() - before and time.monotonic() < until:  # they are deleted in the background
        time.sleep(0.1)
    assert not files() - before and rows.count() == 700 and spark.conf.get(CLEANUP) == old
