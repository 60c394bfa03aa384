"""The pipeline against a plain version of all its stages, on a small fixture."""

from collections import Counter
import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from labelloom.llm import mixing, quality, secrets
from tests.llm.test_llm_operators import plain_components, plain_counts, plain_fingerprint, plain_hits, plain_spans


def plain_histograms(text):
    classes = [0] * 8
    for c in text:
        classes[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r"
                else 4 if c in quality.SYMBOLS else 5 if c in ".,;:!?'\"()-" else 6 if ord(c) < 128 else 7] += 1
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in re.findall("[^\x20\x09-\x0d]+", text)]
    times = Counter(words)
    common = [times[w] for w in quality.VOCABULARY]
    return classes, common + [len(words) - sum(common)]


def plain_quality(rows):
    sides = ((quality.MIN_CHARS_JUDGED, 0), (quality.MIN_WORDS_JUDGED, 1))
    sums = {}
    for r in rows:
        h = plain_histograms(r["text"] or "")
        for least, i in sides:
            n = sum(h[i])
            if n >= least:
                total = sums.setdefault((r["lang"] or "", i), [0] * len(h[i]))
                for j, x in enumerate(h[i]):
                    total[j] += 1_000_000 * x // n
    kept = []
    for r in rows:
        n = plain_counts(r["text"])
        h, far = plain_histograms(r["text"] or ""), [None, None]
        for least, i in sides:
            if sum(h[i]) >= least:
                p, q = [x / sum(h[i]) for x in h[i]], sums[r["lang"] or "", i]
                q = [x / sum(q) for x in q]
                d = sum(x * math.log2(2 * x / (x + y)) for x, y in zip(p, q) if x) + sum(
                    y * math.log2(2 * y / (x + y)) for x, y in zip(p, q) if y)
                far[i] = math.sqrt(max(d / 2, 0))
        bad = n[0] < 10 or 100 * n[4] > 20 * n[0]
        bad |= (far[0] or 0) > quality.MAX_CLASS_DISTANCE or (far[1] or 0) > quality.MAX_WORD_DISTANCE
        bad |= None not in far and sum(far) / 2 > quality.MAX_MEAN_DISTANCE
        if not bad:
            kept.append(r)
    return kept


def plain_one_of_each(rows):
    """Of every group of texts chained by a similarity of 0.8 of their five-word shingles, all pairs compared."""
    def shingles(text):
        words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        n = corpus_pipeline.NEAR_SHINGLE
        return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()

    prints = [shingles(r["text"]) for r in rows]
    roots = {p: p for p in prints}

    def root(p):
        while roots[p] is not p:
            p = roots[p]
        return p

    some = list(roots)
    for i, p in enumerate(some):
        for q in some[:i]:
            if p and q and 100 * len(p & q) >= corpus_pipeline.NEAR_PERCENT * len(p | q):
                roots[root(p)] = root(q)
    roots = {p: root(p) for p in prints}
    least = {}
    for r, p in zip(rows, prints):
        least[roots[p]] = min(least.get(roots[p], r["doc_id"]), r["doc_id"])
    return [r for r, p in zip(rows, prints) if least[roots[p]] == r["doc_id"]]


def plain_redacted(text):
    out, at = "", 0
    for s in plain_spans(text):
        kind, a, z = s.split(":")
        if int(a) >= at:
            out += text[at:int(a)] + f"[{kind}]"
        at = max(at, int(z))
    return out + text[at:]


def plain_mixture(rows):
    """doc_id -> (slot, start), slot by slot."""
    q, size = mixing.CYCLE, mixing.BLOCK_CHARS
    chars = Counter()
    for r in rows:
        chars[r["source"] or ""] += len(r["text"])
    w = {s: max(1, math.isqrt(n)) for s, n in chars.items()}
    total = sum(w.values())
    a = {s: max(1, q * x // total) for s, x in w.items()}
    left = q - sum(a.values())
    assert left >= 0
    for s in sorted(w, key=lambda s: (-(q * w[s] - a[s] * total), s))[:left]:
        a[s] += 1
    done, turns = Counter(), {s: [] for s in a}
    for t in range(q):
        s = min((-(-(done[s] + 1) * q // a[s]), s) for s in a if done[s] < a[s] and done[s] * q // a[s] <= t)[1]
        done[s] += 1
        turns[s].append(t)
    out, at = {}, Counter()
    for r in sorted(rows, key=lambda r: hashlib.md5(f"{mixing.SEED}:{r['doc_id']}".encode()).hexdigest()):
        s = r["source"] or ""
        block = at[s] // size
        out[r["doc_id"]] = (block // a[s] * q + turns[s][block % a[s]], at[s])
        at[s] += len(r["text"])
    return out


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    rng = random.Random(12)
    words = "alpha beta gamma delta epsilon zeta the of and der die le la que von un plus était größer".split()

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    texts = [prose(rng.randint(5, 300)) for _ in range(90)]
    items = [prose(25) for _ in range(5)] + ["two words", ""]
    texts += [texts[3], texts[3], texts[4] + " tail", f"{texts[5]} {items[0]} {texts[6]}", f"{items[1]}", None, "",
              texts[7] + " token = 0123456789abcdef0123 " + texts[8], "AKIA" + "X" * 16 + " " + texts[9],
              prose(100).upper(), " ".join(w + "###" for w in words * 6), "same line of words here again\n" * 30]
    texts[10] = " ".join([*texts[11].split()[:-1], "other"])
    rows = [(i, t, ("en", "fr", None)[i % 3], f"s{i % 4}" if i % 9 else None, len(t or ""), i) for i, t in enumerate(texts)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, extra int").write.parquet(
        f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline_equals_plain_stages(spark, corpus):
    rows = sorted(spark.read.parquet(f"{corpus}/documents.parquet").collect())
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    good = plain_quality(rows)
    single = plain_one_of_each(good)
    clean = [r for r in single if not plain_hits(r["text"], items, 10)[1]]
    assert len(rows) > len(good) > len(single) > len(clean) > 20
    want = [{**r.asDict(), "text": plain_redacted(r["text"])} for r in clean]
    places = plain_mixture(want)
    got = corpus_pipeline.run(spark, corpus).collect()
    assert {r["doc_id"]: (r["text"], r["slot"], r["start"], r["lang"], r["extra"]) for r in got} == {
        r["doc_id"]: (r["text"], *places[r["doc_id"]], r["lang"], r["extra"]) for r in want}
    assert len(got) == len(want) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert any(f"[{k.name}]" in r["text"] for r in got for k in secrets.BASE_KINDS)
