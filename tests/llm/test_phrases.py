"""Collocations against plain counting, whatever the ranges, tries and merges are cut into."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pairwell.llm import phrases
from pairwell.llm.phrases import FOLD, PrefixRanges, count_trie, merged, pack_trie, unpack_trie


def brute(rows, least=10, covered=50, top=2000):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in (1, 2, 3):
                counts[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            score, k, l, r = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            longer = (b for q, b in candidates.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not any(100 * b >= covered * a for b in longer):
                kept.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, words[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out, key=str)


def rows(seed, n=400):
    r = random.Random(seed)
    bits = ["the", "The", "cat", "sat", "on", "mat", "mat.", "a\x01b", "a", "ß", "漢字", "x!", "\t", "\n", "the cat sat", "the\x01", "b"]
    out = [(i, " ".join(r.choice(bits) for _ in range(r.randrange(30))), r.choice(["en", "de", None, "und"])) for i in range(n)]
    return [*out, (None, None, "en"), (1, "", "fr"), (2, "z " * 30, "fr"), (2, "z " * 30, "fr")]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, make_docs, monkeypatch, small):
    if small:  # many tries, ranges and early merges
        monkeypatch.setattr(phrases, "TRIE_BYTES", 300)
        monkeypatch.setattr(phrases, "MERGE_NODES", 20)
        monkeypatch.setattr(phrases, "RANGE_NODES", 40)
    data = rows(1)
    docs = make_docs(data).withColumns({c: F.lit("clash") for c in ("phrase", "rank", "range", "block", "f")}).repartition(5)
    assert sorted(map(tuple, phrases.collocations(docs).collect()), key=str) == brute(data)
    assert sorted(map(tuple, phrases.collocations(docs, least=3, covered=80, top=7).collect()), key=str) == brute(data, 3, 80, 7)


def test_blocks_keep_a_trie_whole():
    t = count_trie("b a\na b c\n\nc c c c\x01".encode().translate(FOLD))
    u = unpack_trie(pack_trie(t))
    assert [t.key(i) for i in range(len(t))] == [u.key(i) for i in range(len(u))] == sorted(t.key(i) for i in range(len(t)))
    assert t.counts.tolist() == u.counts.tolist()
    twice = merged([t, u])
    assert twice.counts.tolist() == (2 * t.counts).tolist()


def test_cut_ranges_give_the_trie_back():
    r = random.Random(2)
    t = count_trie(" ".join(r.choice("abcd") for _ in range(200)).encode())
    keys = sorted({t.key(r.randrange(len(t))) for _ in range(6)})
    ranges = PrefixRanges((("", b""), *(("en", k) for k in keys)))
    blocks = [(first, unpack_trie(block)) for _, _, first, block in ranges.cut("en", t)]
    whole = merged([b for first, b in blocks if first])
    assert whole.counts.tolist() == t.counts.tolist() and len(whole) == len(t)


def test_exact_beyond_64_bits(spark):
    nodes = [("en", "", 0, 10**15, 0, 0), ("en", "a", 1, 3 * 10**12, 3 * 10**12, 0), ("en", "b", 1, 7 * 10**12, 7 * 10**12, 0), ("en", "a b", 2, 10**12, 3 * 10**12, 0)]
    df = spark.createDataFrame(nodes, phrases.NODES)
    real = phrases.phrase_counts
    phrases.phrase_counts = lambda *_: df
    try:
        got = phrases.collocations(df).first()
    finally:
        phrases.phrase_counts = real
    assert got.score == 10**6 * 10**24 // (21 * 10**24)


def test_empty(make_docs):
    assert phrases.collocations(make_docs([])).count() == 0
