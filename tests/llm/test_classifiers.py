import random
import zlib

import numpy as np
import pytest

from pairwell.llm import language, linear, quality

WORDS = {
    "en": "the and of that with house water people never because through light small".split(),
    "de": "der und nicht wasser haus menschen schön weil durch licht klein größer über".split(),
    "fr": "le et les maison eau gens jamais parce lumière petit être très où".split(),
}


ENDINGS = ["", "", "", "s", "ing", "lich", "tion", "ment", "er", "es", "al", "ness", "bar", "eur"]


def words(rng, lang, n):
    """Words of a language with endings, and now and then two in one, so that long texts vary as prose does."""
    return [rng.choice(WORDS[lang]) + rng.choice(ENDINGS) + (rng.choice(WORDS[lang]) if rng.random() < 0.5 else "") for _ in range(n)]


def prose(rng, lang, n):
    return " ".join(words(rng, lang, n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(1)
    return [(i, prose(rng, lang, rng.randint(5, 120)), lang) for i, lang in enumerate(rng.choices(list(WORDS), k=400))]


def test_ngrams_in_chunks(monkeypatch):
    codes = np.random.default_rng(0).integers(32, 400, 5000).astype(np.uint32)
    whole = linear.ngram_counts(codes)
    assert whole.sum() == 3 * 5000 - 3
    monkeypatch.setattr(linear, "CHUNK", 7)
    assert (linear.ngram_counts(codes) == whole).all()
    assert linear.ngram_counts(codes[:1]).sum() == 1


def test_temperature_of_overconfident_logits():
    rng = np.random.default_rng(2)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in linear.softmax(logits)])
    assert linear.temperature(logits * 4, np.eye(3)[labels]) == pytest.approx(4, rel=0.15)


def test_l1_makes_weights_sparse(corpus):
    idf = np.ones(linear.BUCKETS, np.float32)
    examples = [(*language.tf_idf(language.normal_codes(t), idf), np.eye(3)[list(WORDS).index(lang)]) for _, t, lang in corpus]
    w, _ = linear.fit(examples, 3)
    used = np.unique(np.concatenate([i for i, _, _ in examples]))
    assert 0 < np.count_nonzero(w[:-1]) < 3 * len(used)


def test_document_frequencies_against_brute_force(make_docs, corpus):
    rows = corpus[:50] + [(900, None), (901, "123 !")]
    got = language.document_frequencies(make_docs(rows).select("text").repartition(3))
    want = sum((linear.ngram_counts(language.normal_codes(t[1])) > 0).astype(int) for t in corpus[:50])
    assert got[-1] == 50 and (got[:-1] == want).all()


def test_held_out_accuracy_and_cases(make_docs, corpus):
    rows = corpus + [(1000, None, "en"), (1001, "12 34 !?", "de"), (1002, "the people of that house", None), (None, "le et les gens", "fr"), (0, corpus[0][1], corpus[0][2])]
    docs = make_docs(rows)
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for doc_id, text, lang in corpus:
        assert by[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)
        assert by[doc_id].lang_pred == lang and 0.5 < by[doc_id].score <= 1
    assert (by[1000].lang_pred, by[1000].score, by[1001].lang_pred) == ("und", 0.0, "und")
    assert by[1002].lang_pred == "en" and by[None].lang_pred == "fr" and by[None].held_out is False


def test_language_never_reads_the_label_of_a_prediction(make_docs, corpus):
    model = language.train(make_docs(corpus))
    other = [(i + 5000, t, "xx") for i, t, _ in corpus]
    found = {r.doc_id: r.lang_pred for r in language.identify(make_docs(other), model).collect()}
    assert all(found[i + 5000] == lang for i, _, lang in corpus)


def test_language_without_training_rows(make_docs):
    docs = make_docs([(1, "some text", None)])
    assert [r.lang_pred for r in language.identify(docs, language.train(docs)).collect()] == ["und"]
    empty = make_docs([])
    assert language.identify(empty, language.train(empty)).count() == 0


def test_language_filter_keeps_columns(make_docs, corpus):
    from pyspark.sql import functions as F

    docs = make_docs(corpus[:60] + [(1000, None, "en"), (1001, "77", "en")]).withColumn("found_language", F.lit(3))
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 60


def junk(rng, lang):
    some = words(rng, lang, rng.randint(30, 120))
    return rng.choice(
        [
            " ".join(w.upper() + "!!" for w in some),
            " ".join(w + rng.choice(["$$$", "###", "%%%"]) for w in some),
            " | ".join(some),
            " ".join(w for w in some for _ in range(9)),
        ]
    )


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(4)
    return [(i, junk(rng, lang) if i % 6 == 0 else prose(rng, lang, rng.randint(5, 200))) for i, lang in enumerate(rng.choices(list(WORDS), k=600))]


def test_em_recovers_planted_accuracies():
    rng = np.random.default_rng(3)
    good = rng.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.85, 0.9])
    right = rng.random((20_000, 5)) < accuracy
    votes = np.where(right, np.where(good, 1, -1)[:, None], np.where(good, -1, 1)[:, None])
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    posterior, prob, share = quality.expectation_maximisation(patterns, counts)
    assert share == pytest.approx(0.7, abs=0.02)
    assert 1 - prob[1] == pytest.approx(accuracy, abs=0.03)
    assert prob[0] == pytest.approx(accuracy, abs=0.03)
    assert ((posterior > 0) & (posterior < 1)).all()


def test_patterns_against_brute_force(make_docs, mixed):
    rows = mixed + [(1000, None), (1001, " \n")]
    codes, counts = quality.pattern_counts(make_docs(rows).repartition(3))
    want = {}
    for _, t in rows:
        votes = tuple(f(quality.statistics(t)) if (t or "").split() else 0 for f in quality.LABELLERS.values())
        want[votes] = want.get(votes, 0) + 1
    assert {tuple(v): n for v, n in zip(quality.votes_of(codes).tolist(), counts.tolist())} == want


def test_quality_keeps_clean_and_drops_junk(make_docs, mixed):
    docs = make_docs(mixed)
    model = quality.train(docs)
    assert all((model.score(t) >= 0.5) == (i % 6 != 0) for i, t in mixed)
    kept = quality.keep_good(docs.withColumnRenamed("source", "quality_score"))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _ in mixed if i % 6]
    assert model.score(None) == 0.0 and model.score(" ") == 0.0


def test_quality_of_an_empty_table(make_docs):
    assert quality.keep_good(make_docs([])).count() == 0
    assert quality.keep_good(make_docs([(1, None)])).count() == 0
